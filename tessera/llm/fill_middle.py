"""Fill-in-the-middle rewriting of texts, cut between units found by run-length class encoding.

A text's bytes fall into maximal runs of one class, and each run is kept with
the number of units that have ended by its end. A cut after j units is found by
a binary search for the first run by whose end j units have ended; the place
inside that run follows by arithmetic, without walking the units.

Units: `line` (classes: line feeds, others; a line ends with its line feed),
`run` (classes: blanks, others; each run is one unit) and `char` (classes: the
number of bytes of a code point).

All of a row's choices are draws of a SHA-256 of the seed and the row's id, so
they depend on nothing else and a task that is run again makes the same. Rows
are independent: there is no shuffle. A task holds one Arrow batch and at most
OUT_BYTES of output besides one row's.

Nulls and odd input: a null text is an empty one; an empty text and one that
holds a sentinel stay plain; a null doc_id draws as the empty id; rows alike in
id and text come out alike; an empty table gives no rows; columns of other
names are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .common import utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes of output after which a task hands on what it has.
OUT_BYTES = 8 << 20
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Bytes of the code point that a lead byte begins; bytes that begin none count alone.
WIDTH = np.select([np.arange(256) < 0xC0, np.arange(256) < 0xE0, np.arange(256) < 0xF0], [1, 2, 3], 4)


class Runs:
    """The maximal class runs of a text: where each starts, the units ended by its end, the bytes of a unit inside it (0: units end only at its end)."""

    def __init__(self, data: bytes, unit: str):
        octets = np.frombuffer(data, np.uint8)
        at = np.flatnonzero((octets & 0xC0) != 0x80) if unit == "char" else None
        classes = {"line": lambda: octets == 10, "run": lambda: BLANK[octets], "char": lambda: WIDTH[octets[at]]}[unit]()
        first = np.flatnonzero(np.diff(classes, prepend=~classes[:1] if unit != "char" else 0))
        length = np.diff(first, append=len(classes))
        kind = classes[first]
        if unit == "line":
            units, self.step = np.where(kind, length, 0), kind.astype(np.int64)
            if len(units) and not kind[-1]:
                units[-1] = 1
        elif unit == "run":
            units, self.step = np.ones(len(first), np.int64), np.zeros(len(first), np.int64)
        else:
            units, self.step = length, kind
        self.start = first if at is None else at[first]
        self.end = np.append(self.start[1:], len(octets))
        self.ended = np.cumsum(units)

    @property
    def n(self) -> int:
        return int(self.ended[-1]) if len(self.ended) else 0

    def offset(self, j: int) -> int:
        """The byte offset after the first j units."""
        if j == 0:
            return 0
        i = int(np.searchsorted(self.ended, j))
        before = int(self.ended[i - 1]) if i else 0
        return int(self.start[i]) + (j - before) * int(self.step[i]) if self.step[i] else int(self.end[i])


def code_points(data: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def rewrite(data: bytes, unit: str, a: int, b: int, form: str, marks: tuple[bytes, bytes, bytes]) -> tuple[int, int | None, int | None, bytes]:
    """(units, code points of the prefix and of the middle, output) of one text; a and b are the draws of the cuts."""
    runs = Runs(data, unit)
    if form == "plain":
        return runs.n, None, None, data
    low, high = sorted((a % (runs.n + 1), b % (runs.n + 1)))
    i, j = runs.offset(low), runs.offset(high)
    head, body, tail = data[:i], data[i:j], data[j:]
    p, s, m = marks
    parts = (p, head, s, tail, m, body) if form == "psm" else (s, tail, p, head, m, body)
    return runs.n, code_points(head), code_points(body), b"".join(parts)


def _rewriter(unit: str, marks: tuple[bytes, bytes, bytes]):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def batch_of(ids, rows, forms):
        import pyarrow as pa

        n, head, body, out = zip(*rows, strict=True)
        counted, heads, bodies = (pa.array(x, pa.int64()) for x in (n, head, body))
        return pa.RecordBatch.from_arrays([ids, counted, pa.array(forms, pa.string()), heads, bodies, pa.array(out, pa.binary())], names=names)

    def run(batches):
        for batch in batches:
            forms, rows, held, since = batch.column(4).to_pylist(), [], 0, 0
            firsts, seconds = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, form in enumerate(forms):
                rows.append(rewrite(batch.column(1)[i].as_py(), unit, firsts[i], seconds[i], form, marks))
                held += len(rows[-1][3])
                if held >= OUT_BYTES or i + 1 == len(forms):
                    yield batch_of(batch.column(0).slice(since, i + 1 - since), rows, forms[since : i + 1])
                    rows, held, since = [], 0, i + 1

    return run


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line", marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row.

    rate: of a hundred texts, how many are rewritten; spm: of a hundred of
    those, how many put the suffix first; marks: the sentinels of prefix,
    suffix and middle, none of which is a part of another.
    """
    if unit not in ("line", "run", "char"):
        raise ValueError(f"no unit {unit!r}")
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    held = [F.contains(text, F.lit(m)) for m in marks]
    plain = (text == "") | held[0] | held[1] | held[2] | (draws[2] % 100 >= rate)
    form = F.when(plain, "plain").when(draws[3] % 100 < spm, "spm").otherwise("psm")
    rows = docs.select("doc_id", utf8(F.col("text")).alias("_text"), draws[0].alias("_a"), draws[1].alias("_b"), form.alias("form"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    done = rows.mapInArrow(
        _rewriter(unit, tuple(m.encode() for m in marks)),
        f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary",
    )
    return done.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made of, by its sentinels alone; each occurs once in a rewritten text."""
    p, s, m = (F.lit(x) for x in marks)
    after = lambda mark: F.split_part(output, mark, F.lit(2))
    up_to = lambda text, mark: F.split_part(text, mark, F.lit(1))
    psm = F.concat(up_to(after(p), s), after(m), up_to(after(s), m))
    spm = F.concat(up_to(after(p), m), after(m), up_to(after(s), p))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def fill_in_middle_sql(seed: int = 7, rate: int = 100, spm: int = 50) -> str:
    """DuckDB: the same of `documents` by lines, unit by unit, with the digests of output and restored text."""
    draws = ", ".join(f"CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))
    holds = " OR ".join(f"contains(text, '{m}')" for m in (PREFIX, SUFFIX, MIDDLE))
    return rf"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest FROM documents),
        lined AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines, {draws} FROM texts),
        chosen AS (SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS low, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS high,
            CASE WHEN text = '' OR {holds} OR h3 % 100 >= {rate} THEN 'plain' WHEN h4 % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM lined),
        parted AS (SELECT *, coalesce(array_to_string(lines[1:low], ''), '') AS head, coalesce(array_to_string(lines[low + 1:high], ''), '') AS body, coalesce(array_to_string(lines[high + 1:], ''), '') AS tail FROM chosen),
        put AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || head || '{SUFFIX}' || tail || '{MIDDLE}' || body
            ELSE '{SUFFIX}' || tail || '{PREFIX}' || head || '{MIDDLE}' || body END AS output FROM parted)
        SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(head) AS BIGINT) END AS prefix_chars,
            CASE WHEN form <> 'plain' THEN CAST(length(body) AS BIGINT) END AS middle_chars, sha256(output) AS output_sha256,
            sha256(CASE WHEN form = 'plain' THEN output ELSE head || body || tail END) AS restored_sha256 FROM put"""
