"""Language identification by prediction by partial matching over bytes.

For each language a context tree of order three is counted on a bounded
sample: how often each byte follows each context of zero to three bytes. A
byte's code length under a language is that of escape method C without
exclusion: -log2(n / (N + d)) where the byte was seen after the context, else
-log2(d / (N + d)) for the escape plus the length in the next shorter context;
a context never seen costs nothing to leave, and below the empty context all
256 bytes are alike. The statistics are frozen after training, so the length
depends on four bytes alone and is tabled once; a text's lengths are exact
sums over all its bytes, and the shortest wins.

Nulls and odd input: a null text or one without a letter is `und` with score
0; whole texts count, whatever their length; with no labelled rows every text
is `und`; ties go to the language that sorts first; repeated rows each get a
row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import bucket_of, cut, texts_within, utf8

WORD_CHARACTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
ORDER = 3


@dataclass(frozen=True)
class ContextTrees:
    """symbol: byte -> symbol (0 for bytes never met). row: three symbols -> row of
    the longest context met. bits: (row, symbol, language) code lengths."""

    languages: list[str]
    symbol: np.ndarray
    row: np.ndarray
    bits: np.ndarray


def has_letter(text: str) -> bool:
    """Whether any character is a letter; signs such as fractions count as word characters, but are none."""
    first = WORD_CHARACTER.search(text)
    return first is not None and (first[0].isalpha() or any(map(str.isalpha, text)))


def _grams(symbols: np.ndarray, n: int, base: int) -> np.ndarray:
    out = np.zeros(max(0, len(symbols) - n + 1), dtype=np.int64)
    for i in range(n):
        out = out * base + symbols[i : len(symbols) - n + 1 + i]
    return out


def fit(texts: dict[str, list[bytes]]) -> ContextTrees:
    """Count the context trees of each language and table the code lengths."""
    languages = sorted(texts)
    joined = {k: np.frombuffer(b"\n" + b"\n".join(texts[k]) + b"\n", dtype=np.uint8) for k in languages}
    met = np.unique(np.concatenate([*joined.values(), np.zeros(0, np.uint8)]))
    symbol = np.zeros(256, dtype=np.uint8)
    symbol[met[:255]] = np.arange(1, len(met[:255]) + 1)
    base = int(symbol.max()) + 1
    streams = {k: symbol[v].astype(np.int64) for k, v in joined.items()}

    # rows[c] is the table row of context c, or of its longest ending that any language has met
    table = np.full((1, base, len(languages)), 8.0, dtype=np.float32)
    rows = np.zeros(1, dtype=np.int64)
    for order in range(ORDER + 1):
        counts = {k: np.unique(_grams(s, order + 1, base), return_counts=True) for k, s in streams.items()}
        contexts = np.unique(np.concatenate([*(g // base for g, _ in counts.values()), np.zeros(0, np.int64)]))
        shorter = rows[contexts % base ** max(0, order - 1)]
        bits = table[shorter].copy()
        for k, lang in enumerate(languages):
            grams, n = counts[lang]
            if len(grams):
                _add_language(bits[:, :, k], contexts, grams, n, base)
        if order == 0:
            table, rows = bits, np.zeros(1, dtype=np.int64)
            continue
        longer = np.tile(rows, base**order // len(rows))
        longer[contexts] = len(table) + np.arange(len(contexts))
        table, rows = np.concatenate([table, bits]), longer
    return ContextTrees(languages, symbol, rows.astype(np.int32), table)


def _add_language(bits: np.ndarray, contexts: np.ndarray, grams: np.ndarray, n: np.ndarray, base: int) -> None:
    """Turn the lengths of the shorter contexts into those of `contexts`, in place."""
    at = np.searchsorted(contexts, grams // base)
    total = np.bincount(at, n, len(contexts))
    kinds = np.bincount(at, minlength=len(contexts))
    met = kinds > 0
    bits[met] -= np.log2(kinds[met] / (total[met] + kinds[met])).astype(np.float32)[:, None]
    bits[at, grams % base] = -np.log2(n / (total + kinds)[at])


def code_lengths(texts: list[bytes], trees: ContextTrees, chunk: int = 1 << 20) -> np.ndarray:
    """(text, language) bits of every whole text; each starts after line ends."""
    base = int(trees.symbol.max()) + 1
    out = np.zeros((len(texts), len(trees.languages)))
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (size == 0 or size + len(texts[j]) <= chunk):
            size += len(texts[j]) + ORDER
            j += 1
        lead = b"\n" * ORDER
        if j == i + 1 and size > 4 * chunk:  # one very long text, in pieces that overlap by the context
            whole = lead + texts[i]
            for at in range(ORDER, len(whole), chunk):
                out[i] += _bits(np.frombuffer(whole[at - ORDER : at + chunk], dtype=np.uint8), trees, base)[ORDER:].sum(axis=0, dtype=np.float64)
        else:
            data = np.frombuffer(b"".join(lead + t for t in texts[i:j]), dtype=np.uint8)
            bits = _bits(data, trees, base)
            sizes = np.array([len(t) + ORDER for t in texts[i:j]])
            ends = np.cumsum(sizes)
            for k in range(ORDER):
                bits[ends - sizes + k] = 0
            out[i:j] = np.add.reduceat(bits, ends - sizes, axis=0, dtype=np.float64)
        i = j
    return out


def _bits(data: np.ndarray, trees: ContextTrees, base: int) -> np.ndarray:
    s = trees.symbol[data].astype(np.int32)
    context = np.zeros(len(s), dtype=np.int32)
    for back in range(1, ORDER + 1):
        context[back:] += s[:-back] * base ** (back - 1)
    return trees.bits[trees.row[context], s]


def predict(texts: list[bytes], trees: ContextTrees) -> tuple[list[str], list[float]]:
    if not trees.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    bits = code_lengths(texts, trees)
    best = bits.argmin(axis=1)
    with np.errstate(under="ignore"):
        odds = np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000.0))
    share = 1 / odds.sum(axis=1)
    known = [has_letter(t.decode("utf-8", "replace")) for t in texts]
    lang = [trees.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
    return lang, [float(p) if k else 0.0 for p, k in zip(share, known)]


def language_sample(docs: DataFrame, fold: int, parts: int, most: int, most_languages: int = 256, most_bytes: int = 64 << 20) -> dict[str, list[bytes]]:
    """Whole texts of each language outside the fold: at most `most` of each, of the most frequent languages, of most_bytes together.

    A text is a candidate where a hash of doc_id and text falls below twice the share
    that `most` is of its language's rows, so no language's rows meet in one
    task; of rows alike in id and text one counts. The bounds are those of
    what reaches the driver; a text that no longer fits is passed over.
    """
    used = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (bucket_of(F.col("doc_id"), parts) != fold))
    sizes = used.groupBy("lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "lang").limit(most_languages)
    draw = F.pmod(F.xxhash64("doc_id", "_text"), F.lit(1_000_000))
    kept = used.select("doc_id", "lang", utf8(F.col("text")).alias("_text")).join(F.broadcast(sizes), "lang").where(draw * F.col("_n") < 2 * most * 1_000_000)
    rows = cut(kept.select("doc_id", "lang", "_text", F.xxhash64("_text").alias("_hash"), F.octet_length("_text").alias("_size")))
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "_hash"))
    listed = rows.select("doc_id", "lang", "_hash", "_size").distinct().withColumn("_place", first).where(F.col("_place") <= most)
    listed = listed.orderBy("_place", "lang").limit(most * most_languages).collect()
    out: dict[str, list[bytes]] = {}
    for r in sorted(texts_within(rows, ["doc_id", "lang"], listed, most_bytes), key=lambda r: (r["lang"], r["doc_id"], bytes(r["_text"]))):
        out.setdefault(r["lang"], []).append(bytes(r["_text"]))
    return out


def identify(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lang, score = predict(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def languages(docs: DataFrame, fold: int = 1, parts: int = 3, most: int = 300) -> DataFrame:
    """Fit outside the held-out fold, identify all rows."""
    found = identify(docs, fit(language_sample(docs, fold, parts, most)))
    held = F.coalesce(bucket_of(F.col("doc_id"), parts) == fold, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
