"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Native: DataFrame expressions only.

Documents are first summed to cells (source, language, topic) of tokens; partial sums leave no hot source to a task. The cells'
weights are raked: scaled in turn so that each source's, language's and topic's sum meets its target, by sums of each margin joined
back, for a number of rounds or until `residual` is within a tolerance. A cell's ratio of raked to own tokens is what its documents
deserve. One factor c turns ratios into probabilities min(1, c * ratio) whose expected tokens are `budget` of all: starting from no
cell at 1, cells that c takes over 1 are set to 1 and c is settled anew from sums, until none is added. A document stays if the
hash of its id and the seed, as a fraction, lies below its cell's probability.

Targets of a margin are shares by category, given by the caller (categories without one get none), or a power that tempers the
categories' own shares. Topics are a column of the caller, or told by cues: the topic with the most cues for its usual rate, if that is reached.

The cell table has one row for each combination that occurs; its size follows the taxonomies, not the corpus, and no task gathers it.

Defined cases: a null source or language is the category '(none)'; null, empty and blank texts have 0 tokens and topic 'prose';
very long texts are read whole; topics that tie go by their order; cells that tie in ratio have one probability; cells of 0 tokens
have ratio 1; rows with a null id share one fraction; repeated rows stay or go together; a table without rows gives none; other
columns pass through `mix`, also if they are named as its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagequarry.llm._common import SPACE_CLASS, materialised, table, word_count

#: Topics by cues: (topic, pattern of its cues, words to a cue at its usual rate).
TOPICS = (
    ("legal", "[Ll]icen[sc]e|[Cc]opyright|[Ww]arrant", 100),
    ("web", "https?:|[A-Za-z0-9]@[A-Za-z0-9]", 100),
    ("code", "[{};]", 12),
    ("tabular", "[|]", 12),
)
PROSE = "prose"
#: Margins and their targets: powers of the own shares, or shares by category.
MARGINS = (("source", 0.7), ("lang", 0.5), ("topic", 0.8))
ROUNDS = 8
BUDGET, SEED = 0.8, "mix-1"


def topic_of(text: Column, tokens: Column) -> Column:
    """The topic whose cues, times its words to a cue, are most and no fewer than the tokens."""
    full = F.coalesce(text, F.lit(""))
    rates = [F.regexp_count(full, F.lit(pattern)) * words for _, pattern, words in TOPICS]
    best = F.greatest(*rates)
    found = F.lit(PROSE)
    for (topic, _, _), rate in reversed(list(zip(TOPICS, rates, strict=True))):
        found = F.when(rate == best, topic).otherwise(found)
    return F.when((best > 0) & (best >= tokens), found).otherwise(PROSE)


def category(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("(none)"))


def fraction(id_col: str, seed: str = SEED) -> Column:
    """In [0, 1), by the id."""
    digest = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":" + seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def total(cells: DataFrame, *columns: str) -> tuple[float, ...]:
    """Sums of columns over all cells, added up in partial sums."""
    return tuple(float(x or 0) for x in cells.agg(*[F.sum(c) for c in columns]).first())


def with_goals(cells: DataFrame, margins) -> DataFrame:
    """cells with the target `_<margin>` of each margin's category; targets sum to all tokens."""
    (tokens,) = total(cells, "tokens")
    out = cells
    for name, target in margins:
        shares = cells.groupBy(name).agg(F.sum("tokens").alias("_own"))
        if isinstance(target, dict):
            share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in target.items() for x in pair]), F.col(name)), F.lit(0.0)).cast("double") if target else F.lit(0.0)
        else:
            share = F.pow("_own", F.lit(float(target)))
        shares = materialised(shares.select(F.col(name), share.alias("_share")), "shares")
        (whole,) = total(shares, "_share")
        goals = shares.select(F.col(name).alias("_key"), (F.col("_share") / F.lit(whole or 1.0) * F.lit(tokens)).alias(f"_{name}"))
        out = out.join(goals, F.col(name) == F.col("_key")).drop("_key")
    return out


def one_round(cells: DataFrame, names: list[str]) -> DataFrame:
    """cells, of which each margin in turn meets its targets."""
    for name in names:
        sums = cells.groupBy(F.col(name).alias("_key")).agg(F.sum("weight").alias("_sum"))
        cells = cells.join(sums, F.col(name) == F.col("_key")).withColumn("weight", F.coalesce(F.col("weight") * F.try_divide(F.col(f"_{name}"), F.col("_sum")), F.lit(0.0))).drop("_key", "_sum")
    return cells


def residual(cells: DataFrame, names: list[str]) -> float:
    """Greatest distance of a margin's sum from its target, as a share of all tokens; cells as within `raked`."""
    (tokens,) = total(cells, "tokens")
    far = [cells.groupBy(name).agg(F.abs(F.sum("weight") - F.first(f"_{name}")).alias("d")).agg(F.max("d")).first()[0] or 0.0 for name in names]
    return max(far) / (tokens or 1.0)


def raked(cells: DataFrame, margins=MARGINS, rounds: int = ROUNDS, tolerance: float | None = None, rows: int | None = None) -> DataFrame:
    """cells (the margins' columns, tokens) with `weight`, whose sums by margin meet the targets; with a tolerance, rounds end once `residual` is within it. rows: how many cells, if known."""
    names = [name for name, _ in margins]
    out = with_goals(cells, margins).withColumn("weight", F.col("tokens"))
    for _ in range(rounds):  # a table each: within a round the sums of a margin need the one before
        out = materialised(one_round(out, names), "cells", rows)
        if tolerance is not None and residual(out, names) <= tolerance:
            break
    return out.drop(*(f"_{name}" for name in names))


def calibrated(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells with `p`: min(1, c * weight / tokens), where c makes the expected tokens budget of all."""
    out = cells.withColumn("_ratio", F.coalesce(F.try_divide("weight", "tokens"), F.lit(1.0)))
    (tokens,) = total(out, "tokens")
    factor, full = 0.0, -1.0
    while True:
        over = F.col("_ratio") * F.lit(factor) > 1
        sums = out.agg(F.sum(F.when(over, F.col("tokens"))).alias("a"), F.sum(F.when(~over, F.col("weight"))).alias("b"), F.count_if(over).alias("n")).first()
        if sums["n"] == full or not sums["b"]:
            break
        factor, full = (budget * tokens - (sums["a"] or 0.0)) / sums["b"], sums["n"]
    return out.withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(float(factor)) * F.col("_ratio")))).drop("_ratio")


def cell_table(features: DataFrame, keys: list[str]) -> DataFrame:
    return features.groupBy(*keys).agg(F.sum("tokens").cast("double").alias("tokens"), F.count(F.lit(1)).alias("docs"))


def probabilities(features: DataFrame, margins=MARGINS, rounds: int = ROUNDS, budget: float = BUDGET, tolerance: float | None = None) -> DataFrame:
    """(the margins' columns, tokens, docs, weight, p) for every cell of features (the margins' columns, tokens)."""
    cells = materialised(cell_table(features, [name for name, _ in margins]), "cells")
    n = cells.count()
    return materialised(calibrated(raked(cells, margins, rounds, tolerance, n), budget), "cells", n)


def featured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", topic: Column | None = None) -> DataFrame:
    """df with _mix_source, _mix_lang, _mix_topic and _mix_tokens."""
    rows = df.withColumn("_mix_tokens", word_count(F.col(text_col)))
    return rows.withColumns({"_mix_source": category("source"), "_mix_lang": category("lang"), "_mix_topic": topic_of(F.col(text_col), F.col("_mix_tokens")) if topic is None else F.coalesce(topic.cast("string"), F.lit("(none)"))})


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(f"_mix_{c}").alias(c) for c in ("source", "lang", "topic", "tokens")))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: float = BUDGET, seed: str = SEED, margins=MARGINS, topic: Column | None = None) -> DataFrame:
    """The rows of df that the sampling keeps, with df's columns. Rows are written with their features, so texts are read for cues once."""
    rows = materialised(featured(df, id_col, text_col, topic), "features")
    cells = probabilities(cells_of(rows), margins, budget=budget).select(F.col("source").alias("_s"), F.col("lang").alias("_l"), F.col("topic").alias("_t"), F.col("p").alias("_p"))
    same = (F.col("_mix_source") == F.col("_s")) & (F.col("_mix_lang") == F.col("_l")) & (F.col("_mix_topic") == F.col("_t"))
    return rows.join(cells, same).where(fraction(id_col, seed) < F.col("_p")).select(*[F.col(f"`{c}`") for c in df.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cell, probability and fate of every document."""
    rows = materialised(featured(table(spark, sf_dir, "documents")).select("doc_id", "_mix_source", "_mix_lang", "_mix_topic", "_mix_tokens"), "features")
    features = rows.select("doc_id", *(F.col(f"_mix_{c}").alias(c) for c in ("source", "lang", "topic", "tokens")))
    cells = probabilities(features.drop("doc_id")).select("source", "lang", "topic", "p")
    joined = features.join(cells, ["source", "lang", "topic"])
    return joined.select("doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), F.round("p", 6).alias("probability"), (fraction("doc_id") < F.col("p")).alias("kept"))


def cells_sql(documents: str = "documents", rounds: int = ROUNDS, budget: float = BUDGET) -> str:
    """DuckDB WITH clause that ends in `probability_cells`, from a table or query of documents."""
    words = SPACE_CLASS.replace("[", "[^") + "+"
    rates = [f"len(regexp_extract_all(full_text, '{pattern}')) * {n}" for _, pattern, n in TOPICS]
    topic = " ".join(f"WHEN rate_{name} = best THEN '{name}'" for name, _, _ in TOPICS)
    steps = [
        f"mix_text AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang, coalesce(text, '') AS full_text FROM {documents})",
        f"mix_rates AS (SELECT doc_id, source, lang, CAST(len(regexp_extract_all(full_text, '{words}')) AS BIGINT) AS tokens, {', '.join(f'{r} AS rate_{n}' for r, (n, _, _) in zip(rates, TOPICS, strict=True))} FROM mix_text)",
        f"mix_best AS (SELECT *, greatest({', '.join(f'rate_{n}' for n, _, _ in TOPICS)}) AS best FROM mix_rates)",
        f"mix_features AS (SELECT doc_id, source, lang, CASE WHEN best = 0 OR best < tokens THEN '{PROSE}' {topic} END AS topic, tokens FROM mix_best)",
        "mix_cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM mix_features GROUP BY ALL)",
    ]
    for name, power in MARGINS:
        steps.append(f"target_{name} AS (SELECT {name}, pow(sum(tokens), {power}) / sum(pow(sum(tokens), {power})) OVER () * sum(sum(tokens)) OVER () AS goal FROM mix_cells GROUP BY {name})")
    steps.append("rake_0 AS MATERIALIZED (SELECT *, tokens AS weight FROM mix_cells)")
    at = 0
    for _ in range(rounds):
        for name, _ in MARGINS:
            steps.append(f"rake_{at + 1} AS MATERIALIZED (SELECT r.* REPLACE (coalesce(r.weight * g.goal / nullif(sum(r.weight) OVER (PARTITION BY r.{name}), 0), 0) AS weight) FROM rake_{at} r JOIN target_{name} g ON r.{name} = g.{name})")
            at += 1
    steps += [
        f"ratios AS (SELECT *, coalesce(weight / nullif(tokens, 0), 1) AS ratio FROM rake_{at})",
        f"running AS (SELECT *, row_number() OVER o AS place, ({budget} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / nullif(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0) AS c FROM ratios WINDOW o AS (ORDER BY ratio DESC, source, lang, topic))",
        "probability_cells AS (SELECT source, lang, topic, least(1, greatest(0, coalesce((SELECT min_by(c, place) FROM running WHERE c * ratio <= 1), 1) * ratio)) AS p FROM running)",
    ]
    return "WITH " + ",\n".join(steps)


def fraction_sql(column: str = "doc_id", seed: str = SEED) -> str:
    return f"CAST(CAST('0x' || substr(md5(coalesce(CAST({column} AS VARCHAR), '') || ':{seed}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296"


OP10_SQL = f"""{cells_sql()}
SELECT doc_id, f.source, f.lang, f.topic, tokens AS n_tokens, round(p, 6) AS probability, {fraction_sql()} < p AS kept
FROM mix_features f JOIN probability_cells c ON f.source = c.source AND f.lang = c.lang AND f.topic = c.topic"""
