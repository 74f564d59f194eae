"""Quality rules: a ledger of measurements and failure bits, evaluated once, judged by versioned policies.

Native: DataFrame expressions only. Every measure of a text is taken inside its row, so nothing is shuffled however skewed the
sources are. The ledger keeps all measurements and one bit for each failed rule; a policy is a mask over the bits, so another
policy or an ablation never reads a text again, only ledgers.

Repeated three-word windows: the windows of a text are compared as strings. Only a text with fewer distinct windows than
windows sorts them; equal neighbours give the repeated ones, and the gaps between their positions the words they cover.

Defined cases: null, empty and blank texts have no word, all measures 0, and fail `few_words`; very long
texts are measured whole within their row; limits are met at equality (a tie passes); repeated rows get equal rows;
null ids stay null; a table without rows gives none; other columns are left out of the ledger unless asked for by `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagequarry.llm._common import SPACE_CLASS, SPACES, table

SYMBOLS = "#*$%&|<>"
WINDOW = 3

#: Rules in the order of their bits: (name, condition of failure on the measurements, in integers).
RULES = (
    ("few_words", "n_words < 50"),
    ("repeats", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "100 * n_symbols > 20 * word_chars"),
    ("dup_lines", "n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines"),
    ("word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
)
BASE = ("few_words", "repeats")
#: Versioned policies: the rules that reject.
POLICIES = {"base": BASE, "v1": (*BASE, "symbols"), "v2": (*BASE, "symbols", "dup_lines", "word_length")}
CURRENT = "v2"


def bit(rule: str) -> int:
    return 1 << [name for name, _ in RULES].index(rule)


def mask(policy: str) -> int:
    return sum(map(bit, POLICIES[policy]))


def measured(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The columns to keep and the measurements of every whole text."""
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.withColumn("_bare", F.btrim("_t", F.lit(SPACES)))
    rows = rows.withColumn("_w", F.when(F.col("_bare") == "", F.array().cast("array<string>")).otherwise(F.split("_bare", SPACE_CLASS + "+")))
    lines = F.filter(F.split("_t", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    windows = F.transform("_w", lambda word, i: F.concat(word, F.lit(" "), F.get("_w", i + 1), F.lit(" "), F.get("_w", i + 2)))
    rows = rows.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.size("_w") >= WINDOW, F.slice(windows, 1, F.size("_w") - (WINDOW - 1))).otherwise(F.array().cast("array<string>")).alias("_g"),
    )
    rows = rows.withColumns({"n_lines": F.size("_lines").cast("long"), "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long")}).drop("_lines")
    placed = F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
    rows = rows.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), placed)).drop("_g")
    same = lambda x, at: F.coalesce(F.get("_s", at)["g"] == x["g"], F.lit(False))
    repeated = F.filter("_s", lambda x, j: same(x, j - 1) | same(x, j + 1))
    rows = rows.withColumn("_p", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("_s")
    covers = F.transform("_p", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(p - F.get("_p", j - 1), F.lit(WINDOW))))
    covered = F.aggregate(covers, F.lit(0).cast("long"), lambda total, n: total + n)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def ledger(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each of df: kept columns, measurements, and `failed` with a bit for each rule that fails."""
    rows = measured(df, text_col, keep or ["doc_id"])
    failed = F.lit(0).cast("long")
    for name, condition in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(bit(name))).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("failed", failed)


def rejects(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")) != 0


def judged(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with `base_failed` and the policy's `kept`."""
    return entries.withColumns({"base_failed": rejects("base"), "kept": ~rejects(policy) & ~rejects("base")})


def ablation(entries: DataFrame, policy: str = CURRENT) -> DataFrame:
    """(rule, n_failed, n_only, n_kept_without): documents that fail a rule of the policy, that fail no other, and that stay if it is taken out."""
    counts = entries.groupBy(F.col("failed").bitwiseAND(F.lit(mask(policy)).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit(name)).cast("long").alias("bit")) for name in POLICIES[policy]])
    each = counts.select("n", "bits", F.explode(rules).alias("r")).select("n", "bits", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    total = lambda condition, name: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return each.groupBy("rule").agg(total(has, "n_failed"), total(F.col("bits") == F.col("bit"), "n_only"), total(F.col("bits").bitwiseAND(F.bitwise_not("bit")) == 0, "n_kept_without"))


COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "failed"]


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The judged ledger of every document."""
    return judged(ledger(table(spark, sf_dir, "documents"))).select(COLUMNS)


_WORDS = SPACE_CLASS.replace("[", "[^") + "+"
OP6_SQL = f"""WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{_WORDS}')) AS lines FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(3) k(k) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^{SYMBOLS}]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
f AS (SELECT *, CAST({" + ".join(f"CASE WHEN {condition} THEN {bit(name)} ELSE 0 END" for name, condition in RULES)} AS BIGINT) AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {mask("base")}) <> 0 AS base_failed, (failed & {mask(CURRENT)}) = 0 AS kept, n_lines, failed FROM f"""
