"""Benchmark decontamination by Wu-Manber search over words.

Items' windows of 13 consecutive words are the patterns (an item of fewer is
one pattern). For each pattern length a block of two consecutive words has a
shift: how far the search may move on when that block ends at the current
word; a block in no pattern allows the longest shift, a word in no pattern a
whole pattern. Where the shift is zero the block is some pattern's end: its
bucket holds the patterns to compare word by word.

The benchmark is searched in blocks of at most `block_bytes` of its text, each
broadcast on its own and searched for in a stage of its own, with what earlier
blocks found written to the shared folder between. The driver holds one block
and one partition of the benchmark at a time. A Python worker builds the
tables of a block once (some thirty to fifty times the block's size) and keeps
them for its next tasks, so what a task holds has a fixed bound whatever the
benchmark's size; the documents are read once for each block.

Nulls and odd input: null texts and texts without a word have no hits; items
without a word match nothing; null item ids count under the name `null`;
repeated items of one id count once; whole texts are read; repeated rows each
get a row; empty tables on either side give whole results.
"""

from __future__ import annotations

import hashlib
import uuid
from array import array
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame, functions as F

from .common import discard, new_folder, set_apart, utf8

WINDOW = 13
BLOCK = 2

#: Lower-cases A-Z and makes a space of every ASCII byte that is neither letter nor digit.
FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)

RESULTS = {"n_words": "long", "spans": "array<struct<start:int,end:int>>", "items": "array<string>"}


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class PatternSet:
    """Tables of (item, text) rows, one for each pattern length.

    Words are numbered from 1, so that a pattern is a run of four-byte numbers
    and a block is one integer. A table holds for each block its shift, or,
    where that is zero, its bucket: the patterns that end in the block, one as
    (pattern, items), several as a dictionary. Items are numbers too, one as
    itself, several as a tuple.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.items)}
        by_length: dict[int, dict[int, int | tuple | dict]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if m := min(window, len(ids)):
                self._add(by_length.setdefault(m, {}), ids, m, number[item])
        self.tables = sorted(by_length.items())

    @staticmethod
    def _add(table: dict, ids: list[int], m: int, item: int) -> None:
        size = min(BLOCK, m)
        packed = array("I", ids).tobytes()
        width = len(packed) // len(ids)
        # a block that ends at word m or later ends some window; an earlier one is nearest to the end of the first
        for end in range(size, len(ids) + 1):
            block = ids[end - 1] if size == 1 else ids[end - 2] << 32 | ids[end - 1]
            shift = max(0, m - end)
            held = table.get(block, m)
            if shift:
                if isinstance(held, int):
                    table[block] = min(held, shift)
                continue
            pattern = packed[(end - m) * width : end * width]
            if isinstance(held, int):
                table[block] = (pattern, item)
                continue
            if isinstance(held, tuple):
                table[block] = held = dict([held])
            names = held.get(pattern)
            if names is None:
                held[pattern] = item
            elif names != item and (isinstance(names, int) or item not in names):
                held[pattern] = (names, item) if isinstance(names, int) else (*names, item)

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(start, end) of each occurrence, end exclusive, and the items found."""
        ids = list(map(self.vocabulary.get, words, repeat(0)))
        packed = array("I", ids).tobytes()
        width = len(packed) // len(ids) if ids else 0
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        n = len(ids)
        for m, table in self.tables:
            size = min(BLOCK, m)
            longest = m - size + 1
            at = m - 1
            while at < n:
                last = ids[at]
                if not last:
                    at += m
                    continue
                found = table.get(ids[at - 1] << 32 | last if size == 2 else last, longest)
                if found.__class__ is int:
                    at += found
                    continue
                pattern = packed[(at - m + 1) * width : (at + 1) * width]
                names = found.get(pattern) if found.__class__ is dict else found[1] if found[0] == pattern else None
                if names is not None:
                    spans.append((at - m + 1, at + 1))
                    items.update((names,) if names.__class__ is int else names)
                at += 1
        return spans, {self.items[i] for i in items}


#: The block whose tables this Python worker holds.
_built: dict[str, PatternSet] = {}


def _patterns(key: str, shared, window: int) -> PatternSet:
    if key not in _built:
        _built.clear()
        _built[key] = PatternSet(shared.value, window)
    return _built[key]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The items in blocks of bounded text, read one partition at a time, and whether a block is the last; one block at least."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), utf8(F.col("text")))
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block, False
            block, size = [], 0
        block.append((item, bytes(text)))
        size += len(text)
    yield block, True


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, window: int = WINDOW, block_bytes: int = 4 << 20) -> DataFrame:
    """docs' columns (only `keep` where given) with n_words, spans and items, in place of any of these names.

    spans: merged [start, end) word ranges that are hit; items: the ids found,
    as strings.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c not in RESULTS] if keep is None else keep
    out = docs if keep is None else docs.select(*dict.fromkeys([*keep, "text"]))
    out = out.withColumns({k: F.lit(None).cast(v) for k, v in RESULTS.items()})
    before = None
    for block, last in _blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        out_names = [*names, *RESULTS] if last else out.columns
        out = out.mapInArrow(_searcher(shared, window, out_names), out.select(*out_names).schema)
        if not last:
            out.write.option("compression", "zstd").parquet(folder := new_folder(spark, "searched"))
            out = spark.read.parquet(folder)
            if before:
                discard(spark, before)
            before = folder
    return out


def _searcher(shared, window: int, names: list[str]):
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        patterns = _patterns(key, shared, window)
        for batch in batches:
            column = {f.name: batch.column(i) for i, f in enumerate(batch.schema)}
            texts = column["text"].cast(pa.binary()).to_pylist()
            counts, all_spans, all_items = [], [], []
            for text, spans, items in zip(texts, column["spans"].to_pylist(), column["items"].to_pylist()):
                words = words_of(text or b"")
                new, found = patterns.search(words)
                counts.append(len(words))
                both = merged([*((s["start"], s["end"]) for s in spans or ()), *new])
                all_spans.append([{"start": a, "end": b} for a, b in both])
                all_items.append(sorted({*(items or ()), *found}))
            for k, v in (("n_words", counts), ("spans", all_spans), ("items", all_items)):
                column[k] = pa.array(v, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays([column[k] for k in names], names=names)

    return run


def n_hit(spans: str = "spans"):
    return F.expr(f"aggregate({spans}, 0L, (n, s) -> n + (s.end - s.start))")


def contaminated(n_words: str = "n_words"):
    """Some word is hit, and hit words are a twentieth of all or more."""
    hit = n_hit()
    return (hit > 0) & (20 * hit >= F.col(n_words))


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    apart, names = set_apart(docs, {"text"})
    return contamination(apart, benchmark, window=window).where(~contaminated()).select(*names).toDF(*docs.columns)
