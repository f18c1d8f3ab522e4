"""SimHash near-duplicates through a byte-position inverted index.

A fingerprint's 64 bits are eight bytes by position. Two fingerprints that
differ in at most four bits differ in at most four bytes, so they share at
least four positional bytes: that is the guaranteed count. The index is keyed
by three positional bytes together, chosen so that every four positions hold
one of the chosen threes (20 of the 56; a Turán design), which leaves far
shorter lists than single bytes do and loses no pair. Within a list the shared
positional bytes of each pair are tallied, pairs that reach four are kept, and
their differing bits are counted.

Only distinct fingerprints are indexed. A list gives a spanning forest of its
links, not its pairs. A list longer than `block` is cut into blocks and every
two blocks meet in a task of their own, so no task holds more than two blocks,
and no pair is lost.

Nulls and odd input: a null or empty text has the fingerprint zero and is
linked like any other; a text of fewer words than a shingle is one shingle;
whole texts count; repeated rows share a fingerprint and a class; a null
doc_id gets a class like any other row but is never its name, unless all of
the class are null; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations, repeat

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import cut, set_apart, utf8
from .components import components

WORDS, MOST_BITS, SEED = 4, 4, 42
SHARED = 8 - MOST_BITS


def index_positions() -> list[tuple[int, int, int]]:
    """Threes of byte positions of which every four positions hold one."""
    groups = [{0, 1, 2}, {3, 4, 5}, {6, 7}]
    out = []
    for three in combinations(range(8), 3):
        sizes = [len(g & set(three)) for g in groups]
        if 3 in sizes or any(sizes[i] == 2 and sizes[(i + 1) % 3] == 1 for i in range(3)):
            out.append(three)
    return out


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Bits set in over half of the shingles' hashes."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        shingles = [joined]
    else:
        ends = list(accumulate(map(len, parts), lambda a, b: a + b + 1))
        starts = [0, *(e + 1 for e in ends)]
        shingles = [joined[a:b] for a, b in zip(starts, ends[words - 1 :])]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(shingles), 65536):
        part = shingles[at : at + 65536]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), dtype=np.uint64, count=len(part))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def links_of_list(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links among the distinct fingerprints of one list."""
    left = np.unique(fps)
    bytes_of = left.view(np.uint8).reshape(-1, 8)
    a, b = [], []
    front: list = []
    while len(left):
        if front:
            one, one_bytes = front.pop()
        else:
            one, one_bytes = left[0], bytes_of[0]
            left, bytes_of = left[1:], bytes_of[1:]
        if not len(left):
            break
        tally = (bytes_of == one_bytes).sum(axis=1) >= SHARED
        near = np.flatnonzero(tally)
        near = near[np.bitwise_count((left[near] ^ one).view(np.uint64)) <= MOST_BITS]
        if len(near):
            a += [int(one)] * len(near)
            b += left[near].tolist()
            front += [(left[i], bytes_of[i]) for i in near]
            keep = np.ones(len(left), dtype=bool)
            keep[near] = False
            left, bytes_of = left[keep], bytes_of[keep]
    return a, b


def links(fps: DataFrame, block: int = 4096) -> DataFrame:
    """(u, v) links that join up every class of the distinct fingerprints `fp`."""
    keys = [
        f"{i}L << 24 | " + " | ".join(f"(shiftrightunsigned(fp, {8 * p}) & 255L) << {8 * k}" for k, p in enumerate(three))
        for i, three in enumerate(index_positions())
    ]
    listed = fps.select("fp", F.explode(F.array(*(F.expr(k) for k in keys))).alias("key"))
    sizes = cut(listed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    listed = listed.join(sizes, "key").withColumn("blocks", F.expr(f"cast(ceil(n / {block}) as int)"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("mine", j).alias("i"), F.greatest("mine", j).alias("j")))
    dealt = listed.withColumn("mine", mine).select("key", "fp", F.explode(pairs).alias("p")).select("key", "p.i", "p.j", "fp")
    sorted_lists = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        import pyarrow as pa

        kept, kept_key = [], None
        us, vs = [], []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            change = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            bounds = [0, *change.tolist(), batch.num_rows]
            for lo, hi in zip(bounds, bounds[1:]):
                key = (cols[0][lo], cols[1][lo], cols[2][lo])
                if key == kept_key:
                    kept.append(cols[3][lo:hi])
                    continue
                if kept:
                    a, b = links_of_list(np.concatenate(kept))
                    us += a
                    vs += b
                kept, kept_key = [cols[3][lo:hi]], key
            if len(us) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])
                us, vs = [], []
        if kept:
            a, b = links_of_list(np.concatenate(kept))
            us += a
            vs += b
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return sorted_lists.mapInArrow(run, "u long, v long").distinct()


def _classes(docs: DataFrame, words: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) of every row, and (fp, root, component_id) of every fingerprint."""
    prints = cut(fingerprints(docs, words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp")))
    named = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    # a table of its own, not an aggregate in the join's stage: so Spark can split the rows of a large class
    names = cut(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints, named.join(names, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    A class is named by its least doc_id.
    """
    prints, named = _classes(docs, words)
    fingerprint_hex = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(named, "fp").select("doc_id", fingerprint_hex, "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row of docs for each class: that of its least doc_id.

    Rows that repeat that doc_id are told apart by their class and their text;
    of rows alike in both one stays. A class whose ids are all null keeps all
    its rows.
    """
    apart, names = set_apart(docs, {"doc_id", "text"})
    prints, named = _classes(apart, words)
    kept = prints.join(named, "fp").groupBy("doc_id").agg(F.count("*").alias("rows"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("names")).where("names")
    rows = apart.join(kept, "doc_id")
    once = rows.where("rows = 1").select(*names)
    repeated = rows.where("rows > 1").withColumn("digest", F.xxhash64("text"))
    texts = repeated.select(F.struct("doc_id", "digest").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    least = fingerprints(texts, words).select("doc_id.*", "fp").join(named, "fp").where("doc_id = component_id")
    least = least.groupBy("doc_id", "root").agg(F.min("digest").alias("digest")).select("doc_id", "digest")
    repeated = repeated.join(least, ["doc_id", "digest"]).dropDuplicates(["doc_id", "digest"]).select(*names)
    nameless = apart.where(F.col("doc_id").isNull()).select(*names)
    return once.unionByName(repeated).unionByName(nameless).toDF(*docs.columns)
