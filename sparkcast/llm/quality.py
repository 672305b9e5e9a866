"""Quality rules: a table of thresholds compiled into one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for with as was on are this by be at from it not or an have has "
    "der die das und zu den von mit ist auf für dem ein eine als im des nicht sich auch "
    "le la les des du une un est et dans que qui pour par sur avec pas elle il ne "
    "el los las de que y en una por con para del se su al como es lo más"
).split()


@dataclass(frozen=True)
class Rule:
    """A document fails a rule when the metric is outside [low, high]; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


BASE_RULES = (Rule("n_words", low=20), Rule("repeat_percent", high=30))
RULES = (
    Rule("mean_word_chars", 2.0, 15.0),
    Rule("symbol_ratio", high=0.5),
    Rule("shout_ratio", high=0.4),
    Rule("stop_ratio", low=0.04),
    Rule("dup_line_ratio", high=0.5),
    Rule("ellipsis_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
)


def compiled(rules: tuple[Rule, ...]) -> Column:
    """True when a rule fails; a metric that is NULL fails none."""
    fails = F.lit(False)
    for rule in rules:
        value = F.col(rule.metric)
        if rule.low is not None:
            fails = fails | F.coalesce(value < rule.low, F.lit(False))
        if rule.high is not None:
            fails = fails | F.coalesce(value > rule.high, F.lit(False))
    return fails


def _drop(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def _lines_where(test) -> Column:
    return F.size(F.filter("_lines", test)).cast("long")


def metrics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of counts and ratios per document, by functions of the row alone."""
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    split = base.select(
        "doc_id", "_text",
        F.array_remove(F.split(F.translate("_text", SPACES, " " * len(SPACES)), " "), "").alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: _drop(line, SPACES) != "").alias("_lines"))
    hashed = split.select("*", F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"))
    windows = hashed.select("*", F.when(F.size("_hashes") >= WINDOW, F.transform(
        F.sequence(F.lit(0), F.size("_hashes") - WINDOW),
        lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)])))
        .otherwise(F.array().cast("array<bigint>")).alias("_windows"))
    # Most texts repeat no window; only those that do are sorted.
    runs = windows.select("*", F.when(
        F.size(F.array_distinct("_windows")) < F.size("_windows"),
        F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .otherwise(F.array().cast("array<struct<h: bigint, i: int>>")).alias("_runs"))
    at = lambda k: F.get("_runs", k).h
    starts = runs.select("*", F.array_sort(F.transform(
        F.filter("_runs", lambda x, k: x.h.eqNullSafe(at(k - 1)) | x.h.eqNullSafe(at(k + 1))), lambda x: x.i)).alias("_starts"))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate("_starts", zero, lambda a, x: F.struct(
        x.alias("last"), (a.total + F.least(F.lit(WINDOW), x - a.last)).alias("total"))).total
    counted = starts.select(
        "doc_id", "_lines", "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(_drop(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(_drop(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(_drop(F.col("_text"), "!"))).cast("long").alias("_shouts"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"))
    n_words, n_lines = F.col("n_words"), F.size("_lines")
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        _share(100 * F.col("n_repeat_words"), n_words).alias("repeat_percent"),
        _share(F.col("word_chars"), n_words).alias("mean_word_chars"),
        _share(F.col("n_symbols"), n_words).alias("symbol_ratio"),
        _share(F.col("_shouts"), n_words).alias("shout_ratio"),
        _share(F.size(F.filter("_words", lambda w: F.lower(w).isin(STOP_WORDS))), n_words).alias("stop_ratio"),
        _share(F.col("n_dup_lines"), n_lines).alias("dup_line_ratio"),
        _share(_lines_where(lambda x: x.endswith("...") | x.endswith("…")), n_lines).alias("ellipsis_line_ratio"),
        _share(_lines_where(lambda x: x.startswith("- ") | x.startswith("* ") | x.startswith("• ")), n_lines)
        .alias("bullet_line_ratio"))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", base: tuple[Rule, ...] = BASE_RULES,
          rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The metrics of every row of ``docs`` with ``base_failed`` and ``kept``.

    ``base_failed`` when a base rule fails, ``kept`` when no rule of either table does. Whole texts are measured. A NULL text
    counts as empty: no words, no ratios (NULL), failed by the least number of words. Repeated rows and NULL ids stay as they
    are, other columns are not read, an empty table gives an empty result. One narrow stage, no shuffle.
    """
    failed = metrics(docs, doc_id, text).withColumn("base_failed", compiled(base))
    return failed.withColumn("kept", ~F.col("base_failed") & ~compiled(rules))
