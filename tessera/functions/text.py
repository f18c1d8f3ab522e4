"""Text functions: normal form, sentences, sections, tokens, HTML, redaction, line scan.

Column functions stay in the JVM where its regular expressions can say it;
what needs code-point spans or NFKC runs in Arrow-batched functions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import lexicon as L

_TOKEN = re.compile(L.TOKEN)
_SPACED_TOKEN = re.compile(rf"(?:{L.TOKEN})\s*")
_JAVA_TOKEN = "(?U)" + L.TOKEN
_SIGNS = str.maketrans(L.SIGNS | {"\u00ad": None, "\u00a0": " "})


def normalize(text: str) -> str:
    """NFKC, plain quotes and dashes, single blanks, no trailing blanks, one empty line at most."""
    out = unicodedata.normalize("NFKC", text).translate(_SIGNS).replace("\r\n", "\n").replace("\r", "\n")
    out = re.sub(r"[ \t\f\v]+", " ", out)
    out = "\n".join(line.rstrip() for line in out.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", out).strip()


def sentences(text: str) -> list[tuple[int, int]]:
    """[start, end) of each sentence, in code points."""
    cuts = [(m.start(), m.end()) for m in L.SENTENCE_END.finditer(text)]
    starts, ends = [0, *(b for _, b in cuts)], [*(a for a, _ in cuts), len(text)]
    return [(a, b) for a, b in zip(starts, ends) if a < b]


def discussion_section(text: str) -> tuple[int, int] | None:
    """The longest stretch from a heading to the first end after it; None if none is long enough."""
    ends = [m.start() for m in L.DISCUSSION_END.finditer(text)]
    found = [(m.end(), next((e for e in ends if e > m.end()), len(text))) for m in L.DISCUSSION_START.finditer(text)]
    best = max(found, key=lambda s: s[1] - s[0], default=None)  # the first of equals
    return best if best and best[1] - best[0] >= L.SHORTEST_SECTION else None


#: An ASCII character as a letter of a word, a sign or a blank.
_ASCII_KINDS = bytes(ord(" " if chr(i).isspace() else "w" if re.match(r"\w", chr(i)) else ".") for i in range(256))


def count_tokens(text: str) -> int:
    if text.isascii():  # signs, and runs of letters
        kinds = text.encode().translate(_ASCII_KINDS)
        return kinds.count(b".") + len(kinds.replace(b".", b" ").split())
    return len(_TOKEN.findall(text))


def token_starts(text: str) -> list[int]:
    """Where each token begins; as many as begin before a place are in the text up to it."""
    runs = _SPACED_TOKEN.findall(text)
    return list(accumulate(map(len, runs), initial=len(text) - len(text.lstrip())))[: len(runs)]


def truncate(text: str, most: int) -> tuple[str, bool]:
    """The text up to the end of its last allowed token, and whether anything was cut."""
    end = 0
    for i, m in enumerate(_TOKEN.finditer(text)):
        if i == most:
            return text[:end], True
        end = m.end()
    return text, False


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_to_text(raw: str) -> str:
    """Text nodes in order, one trimmed line each, without scripts, styles and empty lines."""
    parser = _Text()
    parser.feed(raw)
    parser.close()
    return "\n".join(line.strip() for line in "\n".join(parser.parts).splitlines() if line.strip())


# Columns. The functions are made on call: a pandas UDF needs a session.

#: Rows of an Arrow batch that are Python objects at one time.
PIECE_ROWS = 256


def pieces(batches: Iterable) -> Iterable:
    """Arrow batches in runs of few rows, so that what Python holds of them does not grow with a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE_ROWS):
            yield batch.slice(at, PIECE_ROWS)


def in_pieces(function: Callable, values: pa.Array, kind: pa.DataType) -> pa.Array:
    """function of each value, null for null, a piece at a time."""
    return pa.concat_arrays([pa.array([], kind), *(pa.array([None if v is None else function(v) for v in values.slice(at, PIECE_ROWS).to_pylist()], kind) for at in range(0, len(values), PIECE_ROWS))])


def normalize_col(text: Column | str) -> Column:
    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        return in_pieces(normalize, s, pa.string())

    return run(text)


def sentences_col(text: Column | str) -> Column:
    @F.arrow_udf("array<struct<start:int,end:int>>")
    def run(s: pa.Array) -> pa.Array:
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return in_pieces(lambda t: [{"start": a, "end": b} for a, b in sentences(t)], s, spans)

    return run(text)


def html_col(html: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html_to_text, na_action="ignore")

    return run(html)


def looks_like_html(raw: Column) -> Column:
    return F.lower(F.substring(raw, 1, 4096)).rlike("<html|<!doctype html|<body")


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(_JAVA_TOKEN))


def head_tokens(text: Column, most: int) -> Column:
    """The text up to the end of its token number `most`, natively.

    One match of `most` repeated tokens from the start; possessive groups keep
    the engine from going back, so it stays linear.
    """
    pattern = rf"(?U)\A(?:\s*+(?:\w++|[^\w\s])){{0,{most}}}+"
    return F.when(token_count(text) <= most, text).otherwise(F.regexp_extract(text, pattern, 0))


class Tokenizer(NamedTuple):
    """How a text's tokens are counted, and how it is cut after so many: functions of columns."""

    count: Callable[[Column], Column]
    truncate: Callable[[Column, int], Column]


#: Tokenizers by name; a caller may put in its own.
TOKENIZERS: dict[str, Tokenizer] = {"regex": Tokenizer(token_count, head_tokens)}


def tokenizer(name: str) -> Tokenizer:
    if name not in TOKENIZERS:
        raise ValueError(f"unknown tokenizer {name!r}; there are {', '.join(sorted(TOKENIZERS))}")
    return TOKENIZERS[name]


def redact(text: Column, live: tuple[str, ...] = ()) -> Column:
    """text with live secret values, then credential shapes, blanked out."""
    for value in live:
        if len(value) >= 8:
            text = F.replace(text, F.lit(value), F.lit(L.REDACTED))
    for shape in L.SECRET_SHAPES:
        text = F.regexp_replace(text, shape, L.REDACTED)
    return text


def redact_map(pairs: Column, live: tuple[str, ...] = ()) -> Column:
    """A map's values redacted, in full under sensitive keys."""
    return F.transform_values(pairs, lambda k, v: F.when(k.rlike(L.SENSITIVE_KEY), L.REDACTED).otherwise(redact(v, live)))


def has_secret(text: Column) -> Column:
    found = F.lit(False)
    for shape in L.SECRET_SHAPES:
        found = found | text.rlike(shape)
    return found


def line_findings(files: DataFrame, key: str, text: str, prose: Column | None = None) -> DataFrame:
    """(key, line_number, rule, excerpt): one row for each rule that a line breaks.

    prose: where true, the rules for public prose hold too. Lines count from 1.
    Few lines hold a mark without which no rule can be broken; only those go
    through the rules.
    """
    lines = files.select(key, (F.lit(False) if prose is None else prose).alias("_prose"), F.posexplode(F.split(text, "\r\n|\n|\r")).alias("_i", "_line"))
    marks = L.LINE_MARKS + (() if prose is None else L.PROSE_MARKS)
    low, marked = F.lower("_line"), F.lit(False)
    for mark in marks:
        marked = marked | low.contains(mark)
    lines = lines.where(marked)
    rules = [(n, p, False) for n, p in L.LINE_RULES] + [(n, p, True) for n, p in L.PROSE_RULES if prose is not None]
    hits = []
    for name, pattern, only_prose in rules:
        hit = F.col("_line").rlike(pattern)
        if name == "email_address":
            hit = hit & ~F.regexp_extract("_line", pattern, 0).rlike(L.EMAIL_ALLOWED)
        if only_prose:
            hit = hit & F.col("_prose")
        hits.append(F.when(hit, F.lit(name)))
    found = lines.select(key, (F.col("_i") + 1).alias("line_number"), F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("rule"), F.trim("_line").alias("excerpt"))
    return found


def path_findings(files: DataFrame, path: str) -> DataFrame:
    """(path, line_number 0, rule, excerpt) of files in folders that must hold no tracked file; paths are relative to the root."""
    relative = F.regexp_replace(path, r"^(?:\./)+", "")
    private = F.lit(False)
    for folder in L.PRIVATE_FOLDERS:
        private = private | F.startswith(relative, F.lit(folder))
    return files.where(private).select(F.col(path).alias("path"), F.lit(0).alias("line_number"), F.lit("tracked_private_directory").alias("rule"), F.col(path).alias("excerpt"))


def source_frames(documents: DataFrame, window: int, section: str = "full", required: bool = False) -> DataFrame:
    """(document_id, text, token_count, tokenizer, window_tokens, truncated, sha256, section).

    section `mdna` takes the management discussion; a document without one is
    left out if it is required, else taken whole. The hash is of the exact
    text of the frame.
    """
    if section not in ("full", "mdna"):
        raise ValueError(f"unknown section {section!r}")

    @F.pandas_udf("struct<text:string,token_count:int,truncated:boolean>")
    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in s:
            body = raw
            if raw is not None and section == "mdna":
                span = discussion_section(raw)
                body = raw[span[0] : span[1]] if span else (None if required else raw)
            if body is None:
                rows.append((None, None, None))
                continue
            cut, truncated = truncate(normalize(body), window)
            cut = cut.rstrip()
            rows.append((cut, count_tokens(cut), truncated))
        return pd.DataFrame(rows, columns=["text", "token_count", "truncated"])

    framed = documents.select("document_id", run("text").alias("f")).where("f.text IS NOT NULL")
    return framed.select(
        "document_id", "f.text", "f.token_count", F.lit("regex").alias("tokenizer"), F.lit(window).alias("window_tokens"),
        "f.truncated", F.sha2(F.col("f.text"), 256).alias("sha256"), F.lit(section).alias("section"),
    )
