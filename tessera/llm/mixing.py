"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells of equal source, language and topic. The cells'
token masses are raked in turn to a target share for each source, language and
topic. Each cell then has a ratio of target to natural mass, and documents are
drawn with a probability in proportion to it: a factor common to all cells is
set so that the expected tokens are the wanted share of all tokens, with
probabilities that would pass one held at one.

Everything is DataFrame or SQL; what reaches the driver is a count of cells and
sums over all of them. The largest distance of a share from its target that is
left is in the result, as residual.

Targets: the natural share to the power `temper`, rescaled, unless a share is
given for the value; given shares are kept as they are and the others share
what is left of one (cells without a share are never drawn). Topic: the column
`topic` where there is one, else the initial-letter range (a-f, g-m, n-s, t-z,
other) that begins most words, in both cases of letters. Mass: the number of
words between blanks, tabs and line ends, at least one.

Nulls and odd input: a null source, language or topic is the value `(none)`; a
null or empty text has mass 1 so that it can be drawn; the draw is a hash of
seed and doc_id, so repeated ids share their fate and a null id draws as an
empty one; an empty table gives an empty result; long texts count whole.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, functions as F

from .common import cut, set_apart

DIMENSIONS = ("source", "lang", "topic")
NONE = "(none)"
WORD = r"[^\x20\x09-\x0D]+"
RANGES = {"a-f": "[A-Fa-f]", "g-m": "[G-Mg-m]", "n-s": "[N-Sn-s]", "t-z": "[T-Zt-z]"}
#: What is left of a text after replacing this by its second group are its words' first letters; the ranges' letters.
INITIALS = r"(^[\x20\x09-\x0D]+)|([^\x20\x09-\x0D])[^\x20\x09-\x0D]*+[\x20\x09-\x0D]*+"
LETTERS = {x: "".join(c + c.upper() for c in map(chr, range(ord(x[0]), ord(x[-1]) + 1))) for x in RANGES}

#: Up to so many cells are raked in one task and broadcast; a row is under 200 bytes, so that is under 20 MB. More are raked by aggregates and joins, with the same result.
SMALL_CELLS = 100_000
#: Rounds in one plan; between plans the weights are cut off, for a plan's analysis grows with its depth.
ROUNDS_AT_ONCE = 6
#: Raking ends when no value's share is further from its target than this; or, with a warning, when a plan's rounds no longer bring it nearer or after so many rounds.
TOLERANCE, GAIN, MOST_ROUNDS = 1e-12, 0.999, 600


def initials_pattern(letters: str) -> str:
    return rf"(^|[\x20\x09-\x0D]){letters}"


def topic_sql(counts: dict[str, str]) -> str:
    """The range with the largest count; the first of equals; `other` where all are 0.

    The last range is the ELSE, so that the result is never null: else a join
    on it would first filter for nulls and count everything twice.
    """
    best = f"greatest({', '.join(counts.values())})"
    *first, last = counts
    cases = " ".join(f"WHEN {counts[name]} = {best} THEN '{name}'" for name in first)
    return f"CASE WHEN {best} = 0 THEN 'other' {cases} ELSE '{last}' END"


def _literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_NAMES = ", ".join(DIMENSIONS)


def targets_sql(cells: str, temper: float, given: dict[str, dict[str, float]]) -> str:
    """SQL over the cells (source, lang, topic, tokens) for their targets t_... and first weight w."""
    names = _NAMES
    natural = ", ".join(f"power(CAST(sum(tokens) OVER (PARTITION BY {d}) AS DOUBLE) / sum(tokens) OVER (), {temper}e0) AS p_{d}, count(*) OVER (PARTITION BY {d}) AS n_{d}" for d in DIMENSIONS)
    sql = f"SELECT {names}, tokens, {natural} FROM {cells}"
    targets = []
    for d in DIMENSIONS:
        fixed = given.get(d, {})
        if fixed:
            listed = ", ".join(map(_literal, fixed))
            left = max(0.0, 1.0 - sum(fixed.values()))
            cases = " ".join(f"WHEN {_literal(k)} THEN {float(v)!r}e0" for k, v in fixed.items())
            rest = f"sum(CASE WHEN {d} IN ({listed}) THEN 0e0 ELSE p_{d} / n_{d} END) OVER ()"
            targets.append(f"CASE {d} {cases} ELSE {left!r}e0 * p_{d} / {rest} END AS t_{d}")
        else:
            targets.append(f"p_{d} / sum(p_{d} / n_{d}) OVER () AS t_{d}")
    return f"SELECT {names}, tokens, CAST(tokens AS DOUBLE) AS w, {', '.join(targets)} FROM ({sql}) AS natural_share"


def rounds_sql(sql: str, rounds: int) -> str:
    """SQL for the weights after so many rounds over all dimensions."""
    carried = ", ".join(f"t_{d}" for d in DIMENSIONS)
    for i in range(rounds):
        for d in DIMENSIONS:
            sql = f"SELECT {_NAMES}, tokens, {carried}, w * t_{d} / greatest(sum(w) OVER (PARTITION BY {d}), 1e-300) AS w FROM ({sql}) AS raked_{i}_{d}"
    return sql


def fill_sql(sql: str, share: float) -> str:
    """SQL for each cell's final weight and its probability."""
    names = _NAMES
    sql = f"SELECT {names}, tokens, w / greatest(sum(w) OVER (), 1e-300) AS w, w / greatest(sum(w) OVER (), 1e-300) / tokens AS r FROM ({sql}) AS raked"
    # hold the cells with the largest ratios at one until the rest fits below one
    order = f"ORDER BY r DESC, {names} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    sql = f"""SELECT {names}, tokens, w, r, row_number() OVER (ORDER BY r DESC, {names}) AS place,
        ({share}e0 * sum(tokens) OVER () - (sum(tokens) OVER ({order}) - tokens)) / greatest(1e0 - (sum(w) OVER ({order}) - w), 1e-12) AS factor FROM ({sql}) AS ratios"""
    sql = f"SELECT *, min(CASE WHEN factor * r <= 1e0 + 1e-12 THEN place END) OVER () AS first_free FROM ({sql}) AS filled"
    sql = f"SELECT *, max(CASE WHEN place = first_free THEN factor END) OVER () AS common FROM ({sql}) AS free"
    return f"SELECT {names}, tokens, w AS cell_weight, CASE WHEN common IS NULL OR place < first_free THEN 1e0 ELSE least(1e0, greatest(0e0, common * r)) END AS probability FROM ({sql}) AS solved"


def residual_sql(sql: str) -> str:
    """SQL for the weights with gap, the largest distance of a value's share from its target."""
    gaps = ", ".join(f"abs(sum(w) OVER (PARTITION BY {d}) / greatest(sum(w) OVER (), 1e-300) - t_{d})" for d in DIMENSIONS)
    return f"SELECT *, max(off) OVER () AS gap FROM (SELECT *, greatest({gaps}) AS off FROM ({sql}) AS shares) AS gaps"


def rake_sql(cells: str, rounds: int, temper: float, given: dict[str, dict[str, float]], share: float) -> str:
    """All of it as one text for DuckDB, with the rule of mix() for its end."""
    columns = f"{_NAMES}, tokens, {', '.join(f't_{d}' for d in DIMENSIONS)}, w"
    on = f"(k < {rounds} OR (gap > {TOLERANCE!r} AND gap < {GAIN} * before)) AND k < {MOST_ROUNDS}"
    state = rounds_sql(f"SELECT {columns} FROM steps WHERE {on}", ROUNDS_AT_ONCE)
    step = f"SELECT (SELECT max(k) FROM steps) + {ROUNDS_AT_ONCE} AS k, {columns}, (SELECT max(gap) FROM steps) AS before, gap FROM ({residual_sql(state)}) AS stepped"
    first = f"SELECT 0 AS k, {columns}, 1e300 AS before, 1e299 AS gap FROM ({targets_sql(cells, temper, given)}) AS start"
    last = "SELECT * FROM steps WHERE k = (SELECT max(k) FROM steps)"
    return f"WITH RECURSIVE steps AS ({first} UNION ALL {step}) SELECT *, (SELECT max(gap) FROM ({last}) AS ended) AS residual FROM ({fill_sql(last, share)}) AS weighed"


def draw_sql(seed: int, doc_id: str, dialect: str = "spark") -> str:
    """A fixed number in [0, 1) for each doc_id: 48 bits of a SHA-256."""
    key = f"concat('{seed}:', coalesce(CAST({doc_id} AS STRING), ''))"
    if dialect == "spark":
        return f"CAST(conv(substr(sha2({key}, 256), 1, 12), 16, 10) AS DOUBLE) / 281474976710656e0"
    key = key.replace("STRING", "VARCHAR")
    return f"CAST(CAST(concat('0x', substr(sha256({key}), 1, 12)) AS BIGINT) AS DOUBLE) / 281474976710656e0"


def with_cells(docs: DataFrame) -> DataFrame:
    """docs with _source, _lang, _topic and _tokens."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NONE))
    initials = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), INITIALS, "$2")
    out = docs.withColumns({"_source": named("source"), "_lang": named("lang"), "_initials": initials})
    out = out.withColumn("_tokens", F.greatest(F.char_length("_initials"), F.lit(1)).cast("long"))
    if "topic" in docs.columns:
        return out.withColumn("_topic", named("topic")).drop("_initials")
    places = {x: f"_initial_{i}" for i, x in enumerate(RANGES)}
    out = out.withColumns({places[x]: F.char_length("_initials") - F.char_length(F.translate("_initials", letters, "")) for x, letters in LETTERS.items()})
    return out.withColumn("_topic", F.expr(topic_sql(places))).drop("_initials", *places.values())


def _over(cells: DataFrame, sql: str) -> DataFrame:
    """The SQL with `cells` in the place of {cells}."""
    cells.createOrReplaceTempView(view := f"cells_{uuid.uuid4().hex}")
    out = cells.sparkSession.sql(sql.replace("{cells}", view))
    cells.sparkSession.catalog.dropTempView(view)
    return out


def _rake_together(cells: DataFrame, rounds: int, temper: float, given: dict, share: float) -> tuple[DataFrame, float]:
    """(source, lang, topic, cell_weight, probability) of cells that fit one task, and the gap left."""
    state, source = targets_sql("{cells}", temper, given), cells.coalesce(1)
    done, before, gap = 0, float("inf"), float("inf")
    while _goes_on(done, rounds, gap, before):
        source = cut(_over(source, residual_sql(rounds_sql(state, ROUNDS_AT_ONCE))).drop("off")).coalesce(1)
        state = "SELECT * FROM {cells}"
        done, before, gap = done + ROUNDS_AT_ONCE, gap, source.agg(F.max("gap")).first()[0] or 0.0
    return _over(source, fill_sql(state, share)), gap


def _goes_on(done: int, rounds: int, gap: float, before: float) -> bool:
    return not done or (done < rounds or gap > TOLERANCE and gap < GAIN * before) and done < MOST_ROUNDS


def _rake_apart(cells: DataFrame, rounds: int, temper: float, given: dict, share: float) -> tuple[DataFrame, float]:
    """The same for any number of cells: margins are aggregated and joined, and only sums over all cells reach the driver."""
    total = cells.agg(F.sum("tokens")).first()[0]
    targets = {}
    for d in DIMENSIONS:
        fixed = given.get(d, {})
        margin = cells.groupBy(d).agg(F.pow(F.sum("tokens").cast("double") / total, F.lit(temper)).alias("p"))
        free = ~F.col(d).isin(*fixed) if fixed else F.lit(True)
        rest = margin.where(free).agg(F.sum("p")).first()[0] or 1.0
        left = max(0.0, 1.0 - sum(fixed.values()))
        share_of = F.lit(left) * F.col("p") / rest
        for value, given_share in fixed.items():
            share_of = F.when(F.col(d) == value, float(given_share)).otherwise(share_of)
        targets[d] = cut(margin.select(d, share_of.alias("t")))
    margins = lambda raked, d: raked.groupBy(d).agg(F.sum("w").alias("s")).join(targets[d], d)
    raked = cells.withColumn("w", F.col("tokens").cast("double"))
    done, before, gap = 0, float("inf"), float("inf")
    while _goes_on(done, rounds, gap, before):
        for _ in range(ROUNDS_AT_ONCE):
            for d in DIMENSIONS:
                factor = cut(margins(raked, d).select(d, (F.col("t") / F.greatest("s", F.lit(1e-300))).alias("f")))
                raked = raked.join(factor, d).withColumn("w", F.col("w") * F.col("f")).drop("f")
            raked = cut(raked)
        mass = raked.agg(F.sum("w")).first()[0]
        off = F.max(F.abs(F.col("s") / max(mass, 1e-300) - F.col("t")))
        done, before, gap = done + ROUNDS_AT_ONCE, gap, max(margins(raked, d).agg(off).first()[0] for d in DIMENSIONS)
    raked = raked.withColumn("w", F.col("w") / max(mass, 1e-300)).withColumn("r", F.col("w") / F.col("tokens"))
    # cells that would pass one are held at one, and the factor of the rest found again, until no more do
    factor, held = share * total, 0
    while True:
        over = raked.where(F.col("r") * factor > 1 + 1e-12).agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"), F.sum("w").alias("w")).first()
        if over["n"] == held:
            break
        held, factor = over["n"], (share * total - over["tokens"]) / max(1.0 - over["w"], 1e-12)
    chance = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("r") * factor))
    return raked.select(*DIMENSIONS, "tokens", F.col("w").alias("cell_weight"), chance.alias("probability")), gap


def mix(docs: DataFrame, share: float = 0.8, temper: float = 0.7, rounds: int = 6, seed: int = 11, given: dict[str, dict[str, float]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs (only `keep` where given) with _source, _lang, _topic, _tokens, cell_weight, probability, residual and sampled, in place of any of these names.

    rounds: the least number; more follow until the shares meet their targets
    (see TOLERANCE). With `keep`, which has doc_id, words are counted once and
    the few columns kept until the draw; else they are counted again for it.
    """
    placed = with_cells(docs.drop("cell_weight", "probability", "residual", "sampled"))
    if keep is not None:
        placed = cut(placed.select(*keep, *(f"_{d}" for d in DIMENSIONS), "_tokens"))
    cells = placed.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    cells = cut(cells.select(*(F.col(f"_{d}").alias(d) for d in DIMENSIONS), "tokens"))
    n = cells.count()
    small = n <= SMALL_CELLS
    weights, gap = (_rake_together if small or not n else _rake_apart)(cells, rounds, temper, given or {}, share)
    if gap > TOLERANCE:
        logging.getLogger(__name__).warning("a share is still %.3g from its target", gap)
    weights = weights.select(*(F.col(d).alias(f"_{d}") for d in DIMENSIONS), "cell_weight", "probability", F.lit(gap).alias("residual"))
    joined = placed.join(F.broadcast(weights) if small else cut(weights), [f"_{d}" for d in DIMENSIONS])
    return joined.withColumn("sampled", F.expr(draw_sql(seed, "doc_id")) < F.col("probability"))


def sampled_documents(docs: DataFrame, **kw) -> DataFrame:
    """The drawn rows of docs, with its columns only."""
    apart, names = set_apart(docs, {"doc_id", "text", *DIMENSIONS})
    return mix(apart, **kw).where("sampled").select(*names).toDF(*docs.columns)
