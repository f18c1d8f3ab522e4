"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import components, decontam, embed_dedup, langid, mixing, quality, sharding, simhash, substr_dedup, token_counts, toxicity
from tests.llm.test_tables import brute_repeats

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside.
CLASHING = ["fp", "u", "v", "key", "n_words", "spans", "items", "score", "label", "size", "shard", "slot", "tokens", "w", "_n", "_h", "component_id", "content", "n_tokens", "curve", "times", "first"]


def docs_of(spark, rows, extra=True):
    df = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)
    return df.withColumns({c: F.lit(7) for c in CLASHING}) if extra else df


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(60_000))


@pytest.fixture(scope="module")
def odd(spark, long_text):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", "a"), (4, "one", "en", "a"), (5, "one", "en", "a"), (5, "one", "en", "a"), (6, long_text, "en", "b"),
        (7, "x " + passage + " y", "de", "b"), (8, "p " + passage + " q", "de", None), (8, "other words here", "de", None), (None, "no id", None, "a"), (9, "12 34 !!", "en", "a"), (10, "z" * 200_000, "en", "a"), (11, "ÀÉ ÜÖ x　y 漢字", "de", "c"),
    ]
    return docs_of(spark, rows)


def ids(df):
    return sorted((r.doc_id for r in df.select("doc_id").collect()), key=lambda x: (x is None, x))


ALL = [1, 2, 3, 4, 5, 5, 6, 7, 8, 8, 9, 10, 11, None]


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, i % 2, (i + 1) % 2) for i in range(1, 12)] + [(None, 1, 1), (3, None, None), (4, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumns({c: F.lit(1) for c in ("text", "score")})


def test_token_counts(spark, odd, empty, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    t = Tokenizer.from_file(path)
    store = str(tmp_path / "store")
    got = token_counts.token_counts(odd, store, path, ranks)
    want = sorted((r.doc_id if r.doc_id is not None else -1, len(t.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got.collect()) == want
    stored = spark.read.parquet(store).count()
    assert stored == odd.select(F.coalesce("text", F.lit(""))).distinct().count()
    assert token_counts.token_counts(odd, store, path, ranks).count() == len(ALL)
    assert spark.read.parquet(store).count() == stored  # nothing was encoded again
    assert token_counts.token_counts(empty, str(tmp_path / "none"), path).count() == 0


def test_encoders_agree_on_latin_texts():
    import public_tokenizers

    path, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    rng = random.Random(2)
    signs = [chr(c) for c in range(1, 0x250) if not 0xD800 <= c < 0xE000]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 60))) for _ in range(3000)]
    texts += ["".join(rng.choice(" \n\t'asdtre1\u0085 ") for _ in range(rng.randint(1, 40))) for _ in range(3000)]
    texts += ["a <|endoftext|> b<|endoftext|>", "<|endoftext", " " * 3000, "a" * 5000, " " * 50 + "x", "don't I'll we'RE"]
    assert token_counts.count_tokens(texts, path, ranks) == token_counts.count_tokens(texts, path)


@pytest.mark.parametrize("operator", [quality.quality, toxicity.toxicity])
def test_scorers(odd, empty, labels, operator):
    got = operator(odd, labels)
    assert ids(got) == ALL and got.where("score IS NULL OR score < 0 OR score > 1 OR held_out IS NULL OR predicted NOT IN (0, 1)").count() == 0
    assert operator(empty, labels).count() == 0
    assert ids(operator(odd, labels.limit(0))) == ALL


def brute_bag(text, s):
    """A text's features one by one: words, pairs and n-grams, hashed alone in buffers of their own."""
    from collections import Counter

    words = quality._plain(text).tobytes().split()
    kinds = lambda data: quality.features(np.frombuffer(b" " + data + b" ", dtype=np.uint8), s)[0]
    one = lambda data, kind: kinds(data)[kind][1] if kind < len(kinds(data)) else np.zeros(0, dtype=int)
    bag = Counter()
    for w in words:
        bag.update(one(w, 0).tolist())
        bag.update(i for kind in range(2, 2 + s.high - s.low + 1) for i in one(w, kind).tolist())
    for a, b in zip(words, words[1:]):
        bag.update(one(a + b" " + b, 1).tolist())
    return bag


def test_subword_scores_are_the_mean_of_all_features(monkeypatch):
    rng = random.Random(9)
    texts = [b"", b" \n", b"a", b"b b b", b"\x00 x\x00y", "é ü é é".encode()] + [" ".join(rng.choice(["ab", "abc", "x", "ab"]) for _ in range(rng.randint(1, 80))).encode() for _ in range(30)]
    s = quality.Settings(1 << 12, 3, 5)
    model = quality.SubwordModel(np.random.default_rng(1).normal(size=s.buckets).astype(np.float32), 0.25, s)
    want = []
    for t in texts:
        bag = brute_bag(t, s)
        want.append(0.25 + sum(n * float(model.weight[i]) for i, n in bag.items()) / max(1, sum(bag.values())))
    for size in (1 << 20, 50):  # texts longer than a buffer go in pieces
        monkeypatch.setattr(quality, "BUFFER", size)
        p = quality.score_texts(texts, model)
        assert np.log(p / (1 - p)) == pytest.approx(want, rel=1e-5, abs=1e-5)


def test_language(odd, empty):
    got = langid.languages(odd)
    assert ids(got) == ALL
    und = {r.doc_id for r in got.where("lang_pred = 'und'").collect()}
    assert {1, 2, 3, 9} <= und and 7 not in und
    assert langid.languages(empty).count() == 0
    assert [langid.has_letter(t) for t in ("", "½ 12", "½ a", "_9", "漢")] == [False, False, True, False, True]


def brute_bits(trees_of, text, languages):
    """Code lengths from plain counts, for one order-3 context tree of each language."""
    import math

    out = []
    for lang in languages:
        stream = b"\n" + b"\n".join(trees_of[lang]) + b"\n"
        met = {x for k in languages for x in b"\n" + b"".join(trees_of[k])}
        counts = {}
        for order in range(4):
            for i in range(order, len(stream)):
                counts.setdefault(stream[i - order : i], {}).setdefault(stream[i], 0)
                counts[stream[i - order : i]][stream[i]] += 1
        known = {stream[i - o : i] for o in range(4) for k in languages for s in [b"\n" + b"\n".join(trees_of[k]) + b"\n"] for i in range(o, len(s)) for stream in [s]}
        total = 0.0
        data = b"\n\n\n" + text
        for i in range(3, len(data)):
            context = data[i - 3 : i]
            while True:
                if context in counts:
                    here = counts[context]
                    n, d = sum(here.values()), len(here)
                    if data[i] in here:
                        total -= math.log2(here[data[i]] / (n + d))
                        break
                    total -= math.log2(d / (n + d))
                if not context:
                    total += 8.0
                    break
                context = context[1:]
        out.append(total)
    return out


def test_code_lengths_are_exact():
    rng = random.Random(3)
    texts = {k: ["".join(rng.choice(a) for _ in range(80)).encode() for _ in range(4)] for k, a in (("aa", "abc d"), ("bb", "abxy z\n"))}
    trees = langid.fit(texts)
    for text in (b"", b"abc", b"xyz abx q\xff a", b"dd\nab"):
        assert langid.code_lengths([text], trees)[0] == pytest.approx(brute_bits(texts, text, ["aa", "bb"]), rel=1e-4, abs=1e-4)
    long = b"abc xyz" * 1000
    assert langid.code_lengths([long], trees, chunk=512)[0] == pytest.approx(langid.code_lengths([long], trees)[0], rel=1e-6)


def test_shards(odd, empty):
    got = sharding.hilbert_shards(odd, 4)
    assert ids(got) == ALL
    sizes = sorted(r["count"] for r in got.groupBy("shard").count().collect())
    assert sizes == [3, 3, 4, 4]
    assert got.where("doc_id = 1").select("size", "text_crc32").first()[:] == (8, 0)
    assert sharding.hilbert_shards(empty).count() == 0


def test_hilbert_curve_is_a_walk():
    import itertools

    import numpy as np

    for bits, dims in ((1, 2), (3, 2), (2, 3), (3, 3)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        index = sharding.hilbert_index(list(points.T), bits)
        walk = points[np.argsort(index)]
        assert sorted(index) == list(range(len(points))) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_mixture(odd, empty):
    got = mixing.mix(odd.withColumn("topic", F.lit(None).cast("string")))
    assert ids(got) == ALL and got.where("probability IS NULL OR probability < 0 OR probability > 1").count() == 0
    assert mixing.mix(empty).count() == 0
    assert mixing.sampled_documents(odd).columns == odd.columns


def test_raking_meets_its_targets(spark):
    rows = [(i, "w " * (1 + i % 5), "en" if i % 3 else "de", f"s{i % 4}") for i in range(400)]
    docs = docs_of(spark, rows, extra=False)
    given = {"source": {"s0": 0.4, "s1": 0.3, "s2": 0.2, "s3": 0.1}, "lang": {"en": 0.5, "de": 0.5}}
    cells = mixing.mix(docs, share=0.2, rounds=25, given=given).select("_source", "_lang", "_topic", "cell_weight", "probability").distinct()
    for d in ("source", "lang"):
        got = {r[f"_{d}"]: r.w for r in cells.groupBy(f"_{d}").agg(F.sum("cell_weight").alias("w")).collect()}
        assert got == pytest.approx(given[d], abs=1e-6)
    expected = mixing.mix(docs, share=0.2, rounds=25, given=given).agg(F.sum(F.col("probability") * F.col("_tokens")) / F.sum("_tokens")).first()[0]
    assert expected == pytest.approx(0.2, abs=1e-6)
    only = mixing.mix(docs, rounds=3, given={"source": {"s0": 1.0}, "lang": {"fr": 1.0}}).collect()
    assert len(only) == 400 and all(0 <= r.probability <= 1 for r in only)


@pytest.mark.parametrize("given", [None, {"source": {"s0": 0.1}, "lang": {"en": 0.9}}])
def test_many_cells_rake_like_few(spark, monkeypatch, given):
    rng = random.Random(11)
    rows = [(i, "w " * rng.randint(1, 30), rng.choice(["en", "en", "de", None]), f"s{rng.randrange(3) * rng.randrange(2)}") for i in range(300)]
    docs = docs_of(spark, rows, extra=False).withColumn("topic", F.concat(F.lit("t"), F.col("doc_id") % 3))
    key = lambda df: {r.doc_id: (r.sampled, r.cell_weight, r.probability, r.residual) for r in df.collect()}
    monkeypatch.setattr(mixing, "ROUNDS_AT_ONCE", 2)
    monkeypatch.setattr(mixing, "MOST_ROUNDS", 4)
    few = key(mixing.mix(docs, given=given, rounds=4, keep=["doc_id"]))
    monkeypatch.setattr(mixing, "SMALL_CELLS", 0)
    many = key(mixing.mix(docs, given=given, rounds=4))
    assert few.keys() == many.keys()
    for i, want in few.items():
        assert many[i][0] == want[0] and many[i][1:] == pytest.approx(want[1:], abs=1e-9)


def test_simhash(spark, odd, empty):
    got = simhash.near_duplicates(odd)
    assert ids(got) == ALL
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got.collect()}
    assert by[1, "0" * 16] == by[2, "0" * 16] == by[3, "0" * 16] == 1
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sum(i == 5 for i in ids(kept)) == 0 and ids(kept).count(4) == 1 and ids(kept).count(1) == 1
    assert simhash.near_duplicates(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_every_four_bytes_hold_an_index_key():
    from itertools import combinations

    keys = simhash.index_positions()
    assert len(keys) == 20 and all(any(set(k) <= set(four) for k in keys) for four in combinations(range(8), 4))


def test_hot_lists_are_cut_without_loss(spark):
    rng = random.Random(4)
    fps = set()
    while len(fps) < 900:
        x = 0x0123456789ABCDEF
        for _ in range(rng.randint(0, 7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    df = spark.createDataFrame([(x if x < 1 << 63 else x - (1 << 64),) for x in fps], "fp long")
    one = {(r.node, r.root) for r in components.components(simhash.links(df)).collect()}
    cut = {(r.node, r.root) for r in components.components(simhash.links(df, block=50)).collect()}
    values = sorted(x if x < 1 << 63 else x - (1 << 64) for x in fps)
    root = {x: x for x in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {(x, find(x)) for x in values if any(y != x and find(y) == find(x) for y in values)}
    assert one == cut == want


def test_long_chains_join_up(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "u long, v long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}
    assert components.components(edges.limit(0)).count() == 0


def test_decontamination(spark, odd, empty):
    passage = " ".join(f"W{i}." for i in range(13))
    bench = spark.createDataFrame([(1, passage), (2, "one"), (3, None), (4, ""), (None, "12, 34"), (2, "ONE")], "item_id long, text string").withColumns({"doc_id": F.lit(1), "spans": F.lit(2)})
    df = odd.drop("n_words", "spans", "items")
    whole = {(r.doc_id, r.n_words): (r.spans, r["items"]) for r in decontam.contamination(df, bench, keep=["doc_id"]).collect()}
    blocks = {(r.doc_id, r.n_words): (r.spans, r["items"]) for r in decontam.contamination(df, bench, keep=["doc_id"], block_bytes=1).collect()}
    assert whole == blocks
    assert whole[4, 1][1] == ["2"] and whole[9, 2][1] == ["null"] and whole[7, 42][1] == ["1"] and whole[1, 0] == ([], [])
    assert [tuple(s) for s in whole[7, 42][0]] == [(1, 14)]
    assert ids(decontam.contamination(odd, bench, keep=["doc_id"])) == ALL
    clean = decontam.drop_contaminated(odd, bench)
    assert clean.columns == odd.columns and 4 not in ids(clean) and 6 in ids(clean)
    assert decontam.drop_contaminated(odd, bench.limit(0)).count() == len(ALL) and decontam.drop_contaminated(empty, bench).count() == 0


def test_shift_tables_find_every_occurrence():
    rng = random.Random(12)
    for _ in range(200):
        words = [b"a", b"b", b"c", b"d"][: rng.randint(2, 4)]
        items = [(str(i % 7), b" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 9])))) for i in range(12)]
        text = [rng.choice([*words, b"z"]) for _ in range(rng.randint(0, 30))]
        spans, names = set(), set()
        for item, t in items:
            w = t.split()
            m = min(4, len(w))
            for i in range(len(w) - m + 1 if m else 0):
                for at in range(len(text) - m + 1):
                    if text[at : at + m] == w[i : i + m]:
                        spans.add((at, at + m))
                        names.add(item)
        found, items_found = decontam.PatternSet(items, 4).search(text)
        assert (set(found), items_found) == (spans, names)


def test_samples_keep_their_bounds(spark):
    from tessera.llm.common import labelled_sample

    docs = docs_of(spark, [(1, f"text {i} " + "x" * 100, "en", "s") for i in range(300)] + [(i, f"other {i}", "de" if i % 2 else "fr", "s") for i in range(2, 200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 1, 3, 50)
    assert len(rows) == 50 and rows == labelled_sample(docs.repartition(7), labels, "quality", 1, 3, 50)
    assert 0 < sum(len(t) for t, _ in labelled_sample(docs, labels, "quality", 1, 3, 500, most_bytes=1000)) <= 1000
    texts = langid.language_sample(docs, 1, 3, 20)
    assert set(texts) == {"en", "de", "fr"} and all(0 < len(t) <= 20 for t in texts.values())
    assert set(langid.language_sample(docs, 1, 3, 20, most_languages=1)) == {"en"}


def test_toxic_rows_go_and_columns_stay(odd, labels):
    kept = toxicity.drop_toxic(odd, labels, limit=1.1)
    assert kept.columns == odd.columns and ids(kept) == ALL


def test_identity_terms_move_no_score():
    rows = [(f"the women are {w}", y) for w, y in [("idiots", 1), ("here", 0)] * 40] + [("the men are here today", 0)] * 20 + [("gay idiots", 1)] * 20
    rng = random.Random(8)
    rows = [(t + " " + " ".join("".join(rng.choice("bcdfg") for _ in range(6)) for _ in range(25)), y) for t, y in rows]
    model = toxicity.fit(rows)
    a, b = (toxicity.score_text(f"the {w} are here", model) for w in ("women", "men"))
    assert abs(a - b) < 0.05 and toxicity.score_text("gay people are here", model) < 0.3
    assert toxicity.score_text("they are idiots", model) > 0.5


def test_embeddings(spark):
    a, b = [1.0, 0.0, 0.0], [1.0, 0.05, 0.0]
    rows = [(1, a, 1), (2, b, 1), (2, b, 1), (3, a, 2), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("nan"), 1.0, 0.0], 1), (8, a, None), (9, [float("inf"), 0.0, 0.0], 1), (10, [2.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1), (None, [0.0, 1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("node", "n", "root", "mine", "least", "usable")})
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embed_dedup.linked_vectors(df, passes=2).collect()), key=str)
    want = [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 1, 10), (11, 0, 11), (12, 1, 10), (None, 0, None)]
    assert got == sorted(want, key=str)
    assert embed_dedup.linked_vectors(df.limit(0), passes=1).count() == 0


def test_large_classes_of_vectors_count_every_link(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    v = (rng.normal(size=(1, 16)) + 0.05 * rng.normal(size=(700, 16))).astype(np.float32)
    df = spark.createDataFrame([(i, v[i].tolist(), 1) for i in range(700)], "vec_id long, embedding array<float>, label int")
    unit = v.astype(float) / np.linalg.norm(v.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= 0.98
    got = {r.vec_id: r.n_links for r in embed_dedup.linked_vectors(df, passes=3, window=64, block=100).collect()}
    assert [got[i] for i in range(700)] == (close.sum(axis=1) - 1).tolist()


def test_substring(spark, odd, empty):
    got = substr_dedup.remove_repeats(odd).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    rows = odd.select("doc_id", "text").collect()
    want = [(r.doc_id, *b) for r, b in zip(rows, brute_repeats([r.text for r in rows]))]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=key) == sorted(want, key=key)
    assert substr_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("hot", [2_000, 1])
def test_substring_on_many_repeats(spark, monkeypatch, hot):
    monkeypatch.setattr(substr_dedup, "HOT_SEGMENTS", hot)
    monkeypatch.setattr(substr_dedup, "SHARD_WORDS", 3_000)
    rng = random.Random(6)
    passages = [" ".join(f"p{k}_{i}" for i in range(rng.randint(30, 50))) for k in range(4)]
    texts = []
    for i in range(80):
        parts = [" ".join(f"n{rng.randrange(10_000)}" for _ in range(rng.randint(0, 60))), rng.choice(passages), rng.choice(["", "a b " * 60, "loop " * 90, rng.choice(passages)])]
        rng.shuffle(parts)
        texts.append(" ".join(parts))
    texts += texts[:5]
    df = docs_of(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substr_dedup.remove_repeats(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts)


def test_pipeline_stages(spark, tmp_path, long_text):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    clean = [" ".join(word() for _ in range(60)) for _ in range(40)]
    bench = " ".join(word() for _ in range(20))
    rows = [(i, t, "en", "a") for i, t in enumerate(clean)] + [(100, clean[3], "en", "b"), (101, bench, "en", "b"), (102, clean[0] + " idiot moron scum", "en", "b")]
    rows += [(200 + i, " ".join(word() for _ in range(40)) + " idiot moron scum", "en", "b") for i in range(30)]
    docs = docs_of(spark, rows, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i >= 200)) for i in [*range(40), *range(200, 230)]], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, names = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, str(tmp_path))
        seen[name] = ids(kept)
        assert name == "sharding" or kept.columns == names
    assert seen["toxicity"] == [*range(40), 100, 101]
    assert seen["simhash_near_dedup"] == [*range(40), 101]
    assert seen["decontamination"] == [*range(40)]
    assert set(seen["mixing"]) <= set(range(40)) and seen["sharding"] == seen["mixing"]
    assert ids(corpus_pipeline.run(spark, str(tmp_path))) == seen["sharding"]
