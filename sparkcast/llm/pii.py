"""Personal data: spans found by patterns, and terms that give protected values away.

A term discloses a value when seeing it tells most of what seeing the value would: with lines as contexts, the pointwise
mutual information of the two over the information content of the value, ``log(n_tv N / (n_t n_v)) / log(N / n_v)``.
Counts come from all lines of the corpus; a pair counts only when enough different lines support it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the four kinds. Runs are taken whole and never entered again in the middle, which changes no match.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
SPAN = "struct<kind: string, start: int, stop: int, value: string>"
LETTERS = r"\p{L}"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    parts = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(parts, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _located(kind: str, text: Column, pattern: Column) -> Column:
    """Spans of all matches in code points: the lengths of the matches and of what lies between them, added up."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, pair: Column) -> Column:
        begin = acc.at + F.length(pair.gap)
        end = begin + F.length(pair.match)
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("stop"), pair.match.alias("value"))
        return F.struct(end.alias("at"), F.concat(acc.spans, F.array(span)).alias("spans"))

    pairs = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches)), matches,
                       lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(F.size(matches) > 0, F.aggregate(pairs, start, step, lambda a: a.spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``base``: valid spans by kind as listed, then start; an empty array without any."""
    hints = {"email": F.col(text).contains("@"), "ip": F.col(text).rlike(r"[0-9]\.[0-9]"),
             "card": F.col(text).rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": F.col(text).contains("+")}
    none = F.array().cast(f"array<{SPAN}>")

    def valid(kind: str) -> Column:
        return F.filter(_located(kind, F.col(text), F.lit(PATTERNS[kind])), lambda s: _valid(kind, s.value))

    return docs.withColumn("base", F.concat(*[F.when(hints[k], valid(k)).otherwise(none) for k in KINDS]))


def _value(span: Column) -> Column:
    """What the counts go by: the kind and the value in lower case, numbers without their separators."""
    return F.concat_ws(":", span.kind, F.when(span.kind.isin("card", "phone"), _digits(span.value)).otherwise(F.lower(span.value)))


def _terms(line: Column, shortest: int) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(line), rf"[^{LETTERS}]+"), lambda w: F.length(w) >= shortest))


def _blanked(text: Column) -> Column:
    for pattern in PATTERNS.values():
        text = F.regexp_replace(text, pattern, " ")
    return text


@dataclass(frozen=True)
class Disclosure:
    """From which share of a value's information a term is generalised, and from which it is removed."""

    generalise: float = 0.7
    remove: float = 0.9
    support: int = 3  # different lines that hold both
    shortest: int = 3  # characters of a term


def disclosing_terms(spanned: DataFrame, rule: Disclosure) -> DataFrame:
    """``(value, term, share)`` for the pairs above ``rule.generalise``; ``spanned`` has ``text`` and ``base``."""
    plain = F.when(F.size("base") > 0, _blanked(F.col("text"))).otherwise(F.col("text"))
    words = spanned.select(F.explode(F.split(plain, "\n")).alias("line"))
    n_terms = words.select(F.explode(_terms(F.col("line"), rule.shortest)).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    held = spanned.where(F.size("base") > 0).select(F.explode(F.split("text", "\n")).alias("text"))
    contexts = base_spans(held).where(F.size("base") > 0).select(
        F.xxhash64("text").alias("line"), F.array_distinct(F.transform("base", _value)).alias("found"),
        _terms(_blanked(F.col("text")), rule.shortest).alias("terms"))
    contexts = contexts.groupBy("line").agg(F.count("*").alias("n"), F.first("found").alias("found"), F.first("terms").alias("terms"))
    each = contexts.select("n", "terms", F.explode("found").alias("value"))
    n_values = each.groupBy("value").agg(F.sum("n").alias("n_value"), F.count("*").alias("different"))
    backed = n_values.where(F.col("different") >= rule.support)
    pairs = (each.join(backed.select("value"), "value", "left_semi").select("n", "value", F.explode("terms").alias("term"))
             .groupBy("value", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("support"))
             .where(F.col("support") >= rule.support))
    lines = spanned.agg(F.sum(F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("n_lines"))
    n_lines = lines.first()["n_lines"] or 0
    counted = pairs.join(backed.select("value", "n_value"), "value").join(n_terms, "term")
    share = (F.log(F.col("n_both") * F.lit(float(n_lines)) / (F.col("n_term") * F.col("n_value")))
             / F.log(F.lit(float(n_lines)) / F.col("n_value")))
    return (counted.withColumn("share", share).where((F.col("n_value") < n_lines) & (F.col("share") >= rule.generalise))
            .select("value", "term", "share"))


def _term_spans(rule: Disclosure) -> Column:
    """Spans of the texts' terms outside the base spans; ``terms`` maps each to the share it discloses."""
    pattern = F.concat(F.lit(rf"(?iu)(?<!{LETTERS})(?:"), F.array_join(F.map_keys("terms"), "|"), F.lit(rf")(?!{LETTERS})"))
    found = _located("term", F.col("text"), pattern)
    apart = lambda s: ~F.exists("base", lambda b: (b.start < s.stop) & (s.start < b.stop))
    return F.when(F.size("terms") > 0, F.filter(found, apart)).otherwise(F.array().cast(f"array<{SPAN}>"))


def _sanitised(rule: Disclosure) -> Column:
    """The text with each value replaced by its kind, removed terms by nothing and generalised ones by ``[TERM]``."""
    tag = lambda s: F.when(s.kind != "term", F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))).when(
        F.coalesce(F.element_at("terms", F.lower(s.value)), F.lit(0.0)) >= rule.remove, "").otherwise("[TERM]")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s.start.alias("start"), s.stop.alias("stop"), tag(s).alias("tag"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        parts = F.when(s.start >= acc.at, F.concat(acc.parts, F.array(F.substring("text", acc.at + 1, s.start - acc.at), s.tag)))
        return F.struct(F.greatest(acc.at, s.stop).alias("at"), parts.otherwise(acc.parts).alias("parts"))

    whole = F.aggregate(ordered, zero, step, lambda a: F.concat(
        F.array_join(a.parts, ""), F.substring("text", a.at + 1, F.length("text"))))
    return F.when(F.size("spans") > 0, whole).otherwise(F.col("text"))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Disclosure = Disclosure()) -> DataFrame:
    """``(doc_id, base, spans, sanitised)`` for every row of ``docs``.

    ``base`` has the valid pattern matches of the whole text by kind, then start; ``spans`` adds the disclosing terms of the
    values the text holds. Positions are code points, stop exclusive. A NULL text counts as empty; repeated rows and NULL ids
    stay as they are; other columns are not read; an empty table gives an empty result. Counts one number by a job when called.
    """
    spanned = base_spans(docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    terms = disclosing_terms(spanned, rule)
    spanned = spanned.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit(1), "text"))
    holders = (spanned.where(F.size("base") > 0)
               .select("k1", "k2", F.explode(F.array_distinct(F.transform("base", _value))).alias("value")).distinct())
    told = (holders.join(terms, "value").groupBy("k1", "k2", "term").agg(F.max("share").alias("share"))
            .groupBy("k1", "k2").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("terms")))
    full = spanned.join(told, ["k1", "k2"], "left").withColumn("terms", F.coalesce("terms", F.create_map().cast("map<string, double>")))
    full = full.withColumn("spans", F.concat("base", _term_spans(rule)))
    return full.select("doc_id", "base", "spans", _sanitised(rule).alias("sanitised"))


def written(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.stop.cast("string"))), ",")
