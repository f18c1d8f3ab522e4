"""Exact removal of repeated 35-word passages with an FM-index per shard.

1. Each window of 35 words is keyed by the least hash among its runs of eight
   words. Neighbouring windows mostly share the key, so a document falls into
   a few segments (about one for each fourteen words), and equal windows have
   equal keys wherever they stand. A key met once holds no repeat.
2. Segments of the other keys are cut from the texts, equal ones are counted
   together, and distinct ones are dealt to shards by key. A key with very
   many distinct segments is dealt by its single windows instead, so that no
   key fills a shard; of equal ones two copies go to the index.
3. Each shard builds a compressed FM-index of its segments and streams them
   against it: backward search gives, for each place, how far the words to its
   left still occur twice; intervals of 35 words or more are reported.
4. Words inside reported windows are removed from their documents.

A hash only deals segments out; whether a window repeats is told by the index.

Nulls and odd input: a null or empty text has no words and keeps none; texts
of fewer than 35 words keep all; repeated rows are copies of each other, so
all their windows go; rows of one doc_id with different texts stay apart;
whole texts count; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import cut, discard, new_folder, utf8
from .fm_index import repeated_windows

WINDOW, RUN = 35, 8
#: Windows in a segment: as many as can share one run of eight words.
MOST = WINDOW - RUN + 1
#: Words of distinct segments in a shard, about; it bounds a task's memory.
SHARD_WORDS = 400_000
#: Distinct segments of one key beyond which its windows are dealt singly.
HOT_SEGMENTS = 2_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def segments_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, windows, occurrences of the key: 1, or 2 for more) of a text's segments."""
    import xxhash

    n = len(words)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    runs = np.zeros(n - RUN + 1, dtype=np.uint64)
    for i in range(RUN):
        runs = runs * _ODD + h[i : n - RUN + 1 + i]
    runs ^= runs >> np.uint64(32)
    runs *= _ODD
    runs ^= runs >> np.uint64(29)
    least, size = runs, 1
    while 2 * size <= MOST:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if MOST > size:
        least = np.minimum(least[: len(least) - (MOST - size)], least[MOST - size :])
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    counts = np.diff(np.append(starts, len(least)))
    if counts.max() > MOST:
        pieces = [np.arange(s, s + c, MOST) for s, c in zip(starts.tolist(), counts.tolist())]
        starts = np.concatenate(pieces)
        counts = np.diff(np.append(starts, len(least)))
    keys = least[starts]
    in_order = np.sort(runs)
    again = in_order[1:][in_order[1:] == in_order[:-1]]
    occurrences = np.where(np.isin(keys, again), 2, 1) if len(again) else np.ones(len(keys), dtype=np.int64)
    return keys.view(np.int64), starts, counts, occurrences


def _segments(docs: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(2).to_pylist()
            rows, parts = [], []
            for i, text in enumerate(texts):
                words = text.split()
                if len(words) >= WINDOW:
                    parts.append(segments_of(words))
                    rows.append(np.full(len(parts[-1][0]), i))
            if not rows:
                continue
            row = pa.array(np.concatenate(rows))
            cols = [np.concatenate([p[k] for p in parts]) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())],
                names=["doc_id", "text_key", "key", "first", "windows", "times"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, key long, first int, windows int, times int")


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, packed): texts by themselves, compressed for their way through a shuffle."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = [packer.compress(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["doc_id", "text_key", "packed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, text_key long, packed binary")


def _cut_out(joined: DataFrame) -> DataFrame:
    """(doc_id, text_key, key, first, windows, words) of each listed segment."""

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows, keys, firsts, counts, texts = [], [], [], [], []
                for j, (packed, listed) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    words = unpacker.decompress(packed).split()
                    for s in listed:
                        first, n = s["first"], s["windows"]
                        rows.append(j)
                        keys.append(s["key"])
                        firsts.append(first)
                        counts.append(n)
                        texts.append(b" ".join(words[first : first + n + WINDOW - 1]))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(keys, pa.int64()), pa.array(firsts, pa.int32()), pa.array(counts, pa.int32()), pa.array(texts, pa.binary())],
                    names=["doc_id", "text_key", "key", "first", "windows", "words"],
                )

    kind = joined.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, text_key long, key long, first int, windows int, words binary")


def _search_shard(frame):
    """Which windows of a shard's segments repeat, as bits of a number."""
    import pandas as pd

    number: dict[bytes, int] = {}
    sequences = [np.array([number.setdefault(w, len(number) + 1) for w in text.split(b" ")], dtype=np.int64) for text in frame["words"]]
    found = repeated_windows(sequences, frame["times"].to_numpy(), WINDOW)
    hit = [int(f.dot(1 << np.arange(len(f), dtype=np.int64))) for f in found]
    out = pd.DataFrame({"words_digest": frame["words_digest"], "hit": np.array(hit, dtype=np.int64)})
    return out[out["hit"] != 0].drop_duplicates("words_digest")  # copies of a window stand in one shard


def _single_windows(hot: DataFrame) -> DataFrame:
    """Each window of a hot key's distinct segments as a segment of its own."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            digests, offsets, times, texts = [], [], [], []
            for digest, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = text.split(b" ")
                for i in range(len(words) - WINDOW + 1):
                    digests.append(digest)
                    offsets.append(i)
                    times.append(n)
                    texts.append(b" ".join(words[i : i + WINDOW]))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(times, pa.int64()), pa.array(texts, pa.binary()), pa.array(offsets, pa.int32())], names=["words_digest", "times", "words", "offset"])

    return hot.select("words_digest", "times", "words").mapInArrow(run, "words_digest binary, times long, words binary, offset int")


def repeated_segments(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, listed) of texts that repeat: bit i of a listed hit tells that window first + i repeats."""
    spark = docs.sparkSession
    segments, cut_out, kept = (new_folder(spark, name) for name in ("segments", "passages", "distinct"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), utf8(F.col("text")).alias("text"))
    _segments(texts).write.option("compression", "zstd").parquet(segments)
    listed = spark.read.parquet(segments)
    # a table of its own, not an aggregate in the join's stage: so Spark can split a hot key's rows
    shared_keys = cut(listed.groupBy("key").agg(F.sum("times").alias("n")).where("n > 1").select("key"))
    listed = listed.join(shared_keys, "key", "left_semi")
    of_doc = listed.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("key", "first", "windows")).alias("listed"))
    long_enough = texts.where(F.octet_length("text") >= 2 * WINDOW - 1)
    packed = _packed(long_enough)
    same = packed["doc_id"].eqNullSafe(of_doc["doc_id"]) & (packed["text_key"] == of_doc["text_key"])
    joined = packed.join(of_doc.hint("shuffle_hash"), same).select(packed["doc_id"], packed["text_key"], "packed", "listed")
    _cut_out(joined).write.option("compression", "zstd").parquet(cut_out)
    discard(spark, segments)
    passages = spark.read.parquet(cut_out).withColumn("words_digest", F.unhex(F.sha2("words", 256)))

    distinct = passages.groupBy("key", "words_digest", "words").agg(F.count("*").alias("times"))
    distinct.write.option("compression", "zstd").parquet(kept)
    distinct = spark.read.parquet(kept)
    sizes = cut(distinct.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size(F.split(F.col("words").cast("string"), " "))).alias("w")))
    is_hot = F.col("n") > HOT_SEGMENTS
    total, single = sizes.agg(F.sum(F.when(~is_hot, F.col("w"))), F.sum(F.when(is_hot, F.col("w") - (WINDOW - 1) * F.col("n")))).first()
    shards = max(1, -(-(total or 0) // SHARD_WORDS))
    # a hot key's segments become windows of 35 words, two copies of each at most
    window_shards = max(1, -(-(single or 0) * 2 * WINDOW // SHARD_WORDS))
    hot = sizes.where(is_hot).select("key")
    calm = distinct.join(hot, "key", "left_anti").select("words_digest", "times", "words", F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard"))
    found = "words_digest binary, hit long"
    hits = calm.groupBy("shard").applyInPandas(_search_shard, found)
    windows = _single_windows(distinct.join(hot, "key", "left_semi")).withColumn("window_digest", F.unhex(F.sha2("words", 256)))
    # two copies of a window are as good as thousands: the index finds the second, and no shard fills with one window
    apart = windows.groupBy(F.col("window_digest").alias("words_digest"), "words").agg(F.sum("times").alias("n"))
    apart = apart.select("words_digest", "words", F.explode(F.array_repeat(F.lit(1).cast("long"), F.least("n", F.lit(2)).cast("int"))).alias("times"))
    apart = apart.withColumn("shard", F.pmod(F.xxhash64("words_digest"), F.lit(window_shards)))
    apart_hits = apart.groupBy("shard").applyInPandas(_search_shard, found).select(F.col("words_digest").alias("window_digest"))
    of_windows = windows.select("words_digest", "offset", "window_digest").join(apart_hits, "window_digest")
    of_windows = of_windows.groupBy("words_digest").agg(F.bit_or(F.expr("shiftleft(1L, offset)")).alias("hit"))
    hits = hits.unionByName(of_windows)
    hit = passages.select("doc_id", "text_key", "first", "words_digest").join(cut(hits), "words_digest")
    of_doc = cut(hit.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "hit")).alias("listed")))
    discard(spark, cut_out)
    discard(spark, kept)
    return of_doc


def removed_words(n: int, listed: list[dict]) -> np.ndarray:
    """Which of n words lie in a window that repeats."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s in listed:
        first, hit = s["first"], s["hit"]
        while hit:
            i = (hit & -hit).bit_length() - 1
            hit &= hit - 1
            edge[first + i] += 1
            edge[first + i + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) of every row; spans are the removed [start, end) word ranges."""
    of_doc = repeated_segments(docs)
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), utf8(F.col("text")).alias("text"))
    packed = _packed(texts)
    same = packed["doc_id"].eqNullSafe(of_doc["doc_id"]) & (packed["text_key"] == of_doc["text_key"])
    joined = packed.join(of_doc.hint("shuffle_hash"), same, "left").select(packed["doc_id"], "packed", "listed")

    def run(batches):
        import pyarrow as pa
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            counts, removed, digests, spans = [], [], [], []
            for data, listed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = unpacker.decompress(data).split()
                gone = removed_words(len(words), listed or [])
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if listed else words
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>")
