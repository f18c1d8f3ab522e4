"""Operators where a cheaper form loses part of the job: links, words, margins, names."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tessera.llm import embed_dedup, mixing, queries, simhash, toxicity


def lone_pairs(n_pairs, n_single, common, seed):
    """Unit vectors of one label: pairs at cosine 0.981 (after a common part is added), then single ones."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    base = unit(unit(rng.standard_normal((n_pairs + n_single, 64))) + common * unit(np.ones(64)))
    away = rng.standard_normal((n_pairs, 64))
    away = unit(away - (away * base[:n_pairs]).sum(axis=1, keepdims=True) * base[:n_pairs])
    return np.concatenate([base, 0.981 * base[:n_pairs] + np.sqrt(1 - 0.981**2) * away])


@pytest.mark.parametrize("common", [0.0, 0.7])
def test_lone_pairs_are_found_in_large_labels(spark, common):
    pairs, single = 1500, 5000
    v = lone_pairs(pairs, single, common, 5)
    df = spark.createDataFrame([(i, 1, x.tolist()) for i, x in enumerate(v)], "vec_id long, label int, embedding array<double>")
    got = embed_dedup.linked_vectors(df, window=32).toPandas().set_index("vec_id").sort_index()
    assert len(got) == len(v)
    close = v @ v.T >= 0.98
    assert close.sum() - len(v) == 2 * pairs
    missed = (got.n_links.loc[: pairs - 1] == 0).sum()
    assert missed <= 4


def test_mass_is_words_and_topics_are_whole_ranges(spark):
    texts = ["a\tb\rc  d\n\ne", "z" * 50, "  Zebra\tZoo\nx", "Moon moon\nHill kelp", "NOON\tsun\rpop a", "é 1 2", None, "b c\td"]
    want = [(5, "a-f"), (1, "t-z"), (3, "t-z"), (4, "g-m"), (4, "n-s"), (3, "other"), (1, "other"), (3, "a-f")]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = mixing.with_cells(docs).orderBy("doc_id").collect()
    assert [(r["_tokens"], r["_topic"]) for r in got] == want


def test_raking_converges_on_dependent_margins_with_the_querys_parameters(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(3000):
        lang = int(rng.integers(3)) if i % 25 else 3
        topic = lang if rng.random() < 0.96 else int(rng.integers(4))
        source = (lang + topic) % 4 if rng.random() < 0.9 else int(rng.integers(4))
        rows.append((i, "w " * int(rng.integers(1, 9)), f"l{lang}", f"s{source}", f"t{topic}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, topic string")
    cells = mixing.mix(docs, **queries.MIX).groupBy("_source", "_lang", "_topic").agg({"_tokens": "sum", "cell_weight": "max"}).toPandas()
    for d in ("_source", "_lang", "_topic"):
        by = cells.groupby(d)[["sum(_tokens)", "max(cell_weight)"]].sum()
        want = (by["sum(_tokens)"] / by["sum(_tokens)"].sum()) ** queries.MIX["temper"]
        assert by["max(cell_weight)"].to_numpy() == pytest.approx((want / want.sum()).to_numpy(), abs=1e-9)


def test_long_identity_terms_move_no_score():
    rows = [(f"the immigrants are {w}", y) for w, y in [("idiots", 1), ("here", 0)] * 40] + [("the refugees are here today", 0)] * 60 + [("immigrants stay", 1)] * 60
    rng = random.Random(8)
    rows = [(t + " " + " ".join("".join(rng.choice("bcdfg") for _ in range(6)) for _ in range(25)), y) for t, y in rows]
    model = toxicity.fit(rows)
    a, b, c = (toxicity.score_text(f"{w} are", model) for w in ("immigrants", "refugees", "asian"))
    assert max(a, b, c) - min(a, b, c) < 0.05
    assert toxicity.score_text("they are idiots", model) > 0.5


def test_swap_is_of_the_whole_feature_set():
    for text, word, other in [("the muslims pray", "muslims", "christians"), ("immigration of immigrants", "immigrants", "migrant"), ("christian life", "christian", "christians"), ("old men", "men", "trans")]:
        before, after = (toxicity.features_of(t) for t in (text, text.replace(word, other)))
        starts = toxicity.Counter(w[:6] for w in toxicity.words_of(text) if len(w) > 6)
        lost, gained = toxicity._swapped(starts, word, other)
        assert (set(lost), set(gained)) == (before - after, after - before)


def test_every_class_keeps_a_row_where_ids_repeat(spark):
    rng = random.Random(3)
    a, b, c = (" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(60)) for _ in range(3))
    # id 1 names two classes; one row of id 5 names a class, the other is a copy of id 2
    rows = [(1, a), (1, b), (1, b), (3, a), (4, b), (5, c), (2, "other text"), (5, "other text"), (6, c)]
    kept = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, kept)) == sorted([(1, a), (1, b), (2, "other text"), (5, c)])


def test_every_stage_of_the_pipeline_against_brute_force(spark, tmp_path):
    """The stages on the documents of sf0.01, each held against a plain computation on its own input."""
    import duckdb

    import corpus_pipeline
    from tests.conftest import SF
    from tests.llm.test_tables import brute_fingerprint, classes

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").df()
    word = __import__("re").compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    fold = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in word.findall(t or "")]

    def toxic(docs):
        model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), labels)
        return docs[[toxicity.score_text(t or "", model) < 0.3 for t in docs.text]]

    def copies(docs):
        v = np.array([brute_fingerprint(t) for t in docs.text], dtype=np.uint64)
        roots = classes(len(v), [(i, int(j)) for i in range(len(v)) for j in np.flatnonzero(np.bitwise_count(v[i] ^ v) <= 4) if i < j])
        least = docs.doc_id.groupby(np.array(roots)).transform("min") if len(docs) else docs.doc_id
        return docs[docs.doc_id == least]

    def clean(docs):
        items = [w for w in map(fold, bench.text) if w]
        windows = {tuple(w[i : i + 13]) for w in items for i in range(max(1, len(w) - 12))}
        sizes = {len(w) for w in windows}

        def share(text):
            words = fold(text)
            hit = {i + j for m in sizes for i in range(len(words) - m + 1) if tuple(words[i : i + m]) in windows for j in range(m)}
            return len(hit) > 0 and 20 * len(hit) >= len(words)

        return docs[[not share(t) for t in docs.text]]

    def drawn(docs):
        con = duckdb.connect()
        con.register("documents", docs)
        parameters = queries.MIX
        try:
            queries.MIX = {"share": 0.8, "temper": 0.7, "rounds": 6, "seed": 11}  # the operator's own, which the stage uses
            kept = con.execute(queries.op5_sql()).df()
        finally:
            queries.MIX = parameters
        return docs[docs.doc_id.isin(kept[kept.sampled].doc_id)]

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for (name, stage), brute in zip(corpus_pipeline.STAGES, [toxic, copies, clean, drawn]):
        want = brute(docs.toPandas())
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns
        found = got.toPandas()
        assert sorted(found.doc_id) == sorted(want.doc_id), name
        assert 0 < len(found) < docs.count(), name
        got.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    dealt = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert sorted(dealt.doc_id) == sorted(found.doc_id) and dealt.groupby("shard").size().agg(["min", "max"]).diff().iloc[1] <= 1


def test_pipeline_on_nulls_empty_tables_and_clashing_names(spark, tmp_path):
    import corpus_pipeline

    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "one two three four five", "en", "a"), (3, "one two three four five", "en", "a"), (None, "no id at all here", None, None), (4, "x " * 30_000, "de", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "7 AS fp", "7 AS score", "7 AS spans", "7 AS probability", "7 AS shard", "7 AS curve")
    for name, some in (("whole", docs), ("empty", docs.limit(0))):
        folder = str(tmp_path / name)
        some.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for stage, function in corpus_pipeline.STAGES[:3]:
            kept = function(spark, kept, folder)
            assert kept.columns == docs.columns
        assert sorted((r.doc_id for r in kept.collect()), key=str) == ([] if name == "empty" else sorted([1, 3, 4, None], key=str))
        assert corpus_pipeline.run(spark, folder).count() <= kept.count()
