"""Questions for a receiver, prompts, masked contexts and what an answer is worth."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions.matching import read

# The wording of prompts and slots, by role.

INSTRUCTION = (
    "You are given a handoff note written by another analyst. Answer the question using the note. If the note does not state the answer, give your "
    "best single answer anyway. Reply with the requested field value only, with no explanation, no units of explanation, and no surrounding sentence."
)
NO_NOTE = "(no note was provided)"
CLOSED_BOOK = "Answer from your own knowledge. No document is provided.\nReply with the requested field value only."
TASK = (
    "You are preparing a handoff note for a second analyst who will not see the source document. Within the stated token budget, preserve the information "
    "an analyst would need to answer factual questions about the source: named entities, business segments and geographies, reporting periods, numeric "
    "values with their units, and references to notes or exhibits. Do not add information that is not in the source. Do not speculate."
)
SLOTS = {
    "entity": ("Which company or organisation is described as {attribute}? Answer with the organisation name only.", "organisation-name"),
    "scope": ("For {subject}, which business segment or geography does the statement about {attribute} apply to? Answer with the segment or geography label only.", "segment-label"),
    "period": ("For {subject}, which reporting period does the statement about {attribute} refer to? Answer as FYYYYY or FYYYYYQn.", "FYYYYY | FYYYYYQn"),
    "numeric": ("For {subject}, what is the reported value of {attribute}? Answer with the number and its unit only.", "number+unit"),
    "provenance": ("For {subject}, which note, item or exhibit is cited for {attribute}? Answer with the reference only.", "Note N | Item N | Exhibit N"),
}
MASK_QUESTION = "Context: {masked_context}\nQuestion: What content should replace <TARGET>?\nAnswer with only the missing content."
TARGET, EQUIVALENT, UNRESOLVED = "<TARGET>", "<EQUIV_REDACTED>", "ATTRIBUTE_NOT_DETERMINISTICALLY_RESOLVABLE"
SENTENCE_CHARS, WINDOW_CHARS = 512, 160


def _by_role(role: Column, place: int) -> Column:
    out = F.lit(None).cast("string")
    for name, slot in SLOTS.items():
        out = F.when(role == name, slot[place]).otherwise(out)
    return out


def question(role: Column, subject: Column, attribute: Column) -> Column:
    """The role's question; null for an unknown role, or without what it asks about."""
    filled = F.replace(_by_role(role, 0), F.lit("{attribute}"), attribute)
    return F.when(filled.contains("{subject}"), F.replace(filled, F.lit("{subject}"), subject)).otherwise(filled)


def _asked(role: Column, subject: Column, attribute: Column) -> Column:
    return F.concat(F.lit("Question: "), question(role, subject, attribute), F.lit("\nAnswer format: "), _by_role(role, 1), F.lit("\nAnswer:"))


def receiver_prompt(message: Column, role: Column, subject: Column, attribute: Column) -> Column:
    note = F.when(F.trim(F.coalesce(message, F.lit(""))) == "", NO_NOTE).otherwise(F.trim(message))
    return F.concat(F.lit(f"{INSTRUCTION}\n\n--- HANDOFF NOTE ---\n"), note, F.lit("\n--- END NOTE ---\n\n"), _asked(role, subject, attribute))


def no_evidence_prompt(role: Column, subject: Column, attribute: Column) -> Column:
    return receiver_prompt(F.lit(""), role, subject, attribute)


def prior_probe_prompt(role: Column, subject: Column, attribute: Column) -> Column:
    return F.concat(F.lit(f"{CLOSED_BOOK}\n\n"), _asked(role, subject, attribute))


def relay_prompt(source: Column, budget: int) -> Column:
    return F.concat(F.lit(f"{TASK}\n\nToken budget: {budget}.\n\n--- SOURCE ---\n"), source, F.lit("\n--- END SOURCE ---\n\nHandoff note:"))


def mock_relay(prompt: Column) -> Column:
    """A relay's answer without a model: the source's sentences after the first, or the source where it has only one."""
    source = F.regexp_extract(prompt, r"(?s)--- SOURCE ---\n(.*)\n--- END SOURCE ---", 1)
    later = F.regexp_extract(source, r"(?s)^.*?[.!?]\s+(\S.*)$", 1)
    return F.when(later == "", source).otherwise(later)


def mock_answer(message: Column, role: Column, prior: Column) -> Column:
    """The value that the note states for the role, else the prior's, else `unknown`; all native.

    prior: map of role to value.
    """
    stated = F.call_function("regexp_extract", message, F.concat(F.lit(r"(?m)^[ \t]*- "), role, F.lit(":([^\n]*)$")), F.lit(1))
    has = F.regexp_like(message, F.concat(F.lit(r"(?m)^[ \t]*- "), role, F.lit(":")))
    return F.when(F.coalesce(has, F.lit(False)), F.trim(stated)).otherwise(F.coalesce(F.element_at(prior, role), F.lit("unknown")))


def k_effective(support_size: Column, natural_excluded: bool = True) -> Column:
    """Answers left to chance; a support of fewer than two values is an error."""
    small = F.raise_error(F.lit("a support needs two values")).cast("long")
    return F.when(support_size <= 1, small).otherwise(support_size - int(natural_excluded))


def answer_class(response: Column, content: Column, reasoning: Column, finish: Column) -> Column:
    """Whether an answer can be scored; only USABLE_ANSWER ever is."""
    blank = F.trim(content) == ""
    return (
        F.when(response.isNull(), "MISSING_CONTENT")
        .when(F.coalesce(blank, F.lit(True)) & (finish == "length"), "TOKEN_CAP_NO_ANSWER")
        .when(F.coalesce(blank, F.lit(True)) & (F.length(F.coalesce(reasoning, F.lit(""))) > 0), "REASONING_ONLY")
        .when(content.isNull(), "NULL_CONTENT")
        .when(blank, "EMPTY_CONTENT")
        .otherwise("USABLE_ANSWER")
    )


def _segment(text: str, start: int, end: int) -> tuple[int, int]:
    """The sentence around a span: from the end of a sentence or an empty line to the next."""
    import re

    cuts = [0]
    for m in re.finditer(r"[.?!](?=\s|$)|\n[ \t]*\n", text):
        cuts.append(m.end())
    cuts.append(len(text))
    low = max(c for c in cuts if c <= start)
    high = min(c for c in cuts if c >= end)
    return low, high


def masked_context(text: str, value: str, role: str, start: int, end: int) -> str:
    """The sentence with the focal span as <TARGET> and the value's other occurrences blanked."""
    if not 0 <= start < end <= len(text):
        return UNRESOLVED
    low, high = _segment(text, start, end)
    if high - low > SENTENCE_CHARS:
        low, high = max(0, start - WINDOW_CHARS), min(len(text), end + WINDOW_CHARS)
    sides = [side.replaced(side.spans(value, role), EQUIVALENT) for side in (read(text[low:start]), read(text[end:high]))]
    return " ".join(f"{sides[0]}{TARGET}{sides[1]}".split())


def masked_context_col(text, value, role, start, end) -> Column:
    """Null where any part is null."""

    @F.pandas_udf("string")
    def run(t: pd.Series, v: pd.Series, r: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        rows = zip(t, v, r, a, b)
        return pd.Series([None if any(x is None or x != x for x in row) else masked_context(*row[:3], int(row[3]), int(row[4])) for row in rows], dtype=object)

    return run(text, value, role, start, end)


def support_values(spark) -> DataFrame:
    """(role, value) supports of periods: fiscal years 2016 to 2021 and their quarters."""
    years = spark.range(2016, 2022).select(F.concat(F.lit("FY"), "id").alias("y"))
    quarters = years.select("y", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("q")).select(F.concat("y", F.lit("Q"), "q").alias("y"))
    return years.withColumn("role", F.lit("period")).unionByName(quarters.withColumn("role", F.lit("quarter"))).select("role", F.col("y").alias("value"))


def leaks(payloads: DataFrame, focals: DataFrame) -> DataFrame:
    """(document_id, value) of focal values inside the payload of their own document, case aside."""
    joined = payloads.join(focals, "document_id")
    inside = (F.trim("value") != "") & F.lower("payload").contains(F.lower(F.trim("value")))
    return joined.where(inside).select("document_id", "value")
