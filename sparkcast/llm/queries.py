"""The queries over the driver tables, each a thin digest of its operator."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.llm import bpe, chat, exact, hamming, lines, mixing, phrases, pii, quality, simhash, substrings, toxicity, whitening
from sparkcast.session import ship_package

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op7_substring_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"), window=35)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    coded = bpe.round_trip(table(spark, sf_dir, "documents"), path)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


_STOPS = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)


@query("op3_quality_rules", rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0b\x0c\r]+'), lambda x: x <> '') AS words,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0b\x0c\r]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 8], ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(0, greatest(len(words) - 7, 0))) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 8)) AS p
        FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, len(lines) AS n_lines,
         CAST(length(regexp_replace(t, '[ \t\n\x0b\x0c\r]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         length(t) - length(replace(t, '!', '')) AS shouts,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(words, lambda x: lower(x) IN ({_STOPS}))) AS stops,
         len(list_filter(lines, lambda x: suffix(x, '...') OR suffix(x, '…'))) AS ellipses,
         len(list_filter(lines, lambda x: prefix(x, '- ') OR prefix(x, '* ') OR prefix(x, '• '))) AS bullets
  FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND word_chars / n_words BETWEEN 2 AND 15 AND n_symbols / n_words <= 0.5 AND shouts / n_words <= 0.4
       AND stops / n_words >= 0.04 AND n_dup_lines / n_lines <= 0.5 AND ellipses / n_lines <= 0.5
       AND bullets / n_lines <= 0.9 AS kept FROM b""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op8_pii")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.sanitise(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, pii.KINDS), F.sha2(pii.written(F.col("base")), 256).alias("base_sha256"),
                        pii.written(F.col("spans")).alias("spans"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.grade(docs, model).withColumn("severity", F.round("severity", 9))


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.without_duplicate_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias("n_removed"),
                        F.sha2("text", 256).alias("kept_sha256"))


def label_domains(labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing queries: toxic, curated (good quality) or raw."""
    return labels.select("doc_id", F.when(F.col("toxic") > 0, "toxic").when(F.col("quality") > 0, "curated")
                         .otherwise("raw").alias("domain"))


@query("op4_source_mixing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = {"curated": 0.85, "raw": 0.10, "toxic": 0.05}
    mixed, _, fitted = mixing.rates(table(spark, sf_dir, "documents"), label_domains(table(spark, sf_dir, "labels")), weights)
    shares = [F.round(F.col("_posterior")[i], 9).alias(f"p_{d}") for i, d in enumerate(weights)]
    return mixed.select("doc_id", F.col("_tokens").alias("n_tokens"), *shares, F.round("_rate", 9).alias("rate"),
                        F.col("_copies").alias("copies"), F.lit(fitted.converged).alias("converged"), F.lit(fitted.met).alias("met"))


@query("op5_exact_top_k", """
WITH bits AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (SELECT q.vec_id AS query_id, e.vec_id AS id,
                 CAST(len(list_filter(range(1, 65), lambda i: q.b[i] <> e.b[i])) AS INTEGER) AS distance
          FROM bits q, bits e WHERE q.vec_id % 20 = 0)
SELECT query_id, id, distance, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM pairs) WHERE rank <= 10""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.nearest(rows, rows.where("vec_id % 20 = 0"), k=10)


@query("op10_chat_format")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chat.repair(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "turn", "step", "action", "role", "cost", F.sha2("rendered", 256).alias("rendered_sha256"))


@query("op13_exact_dedup", """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


@query("op11_embedding_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


@query("op12_phrase_collocations", r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) AS piece FROM documents),
s AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM t),
n AS (SELECT lang, sum(len(ws)) AS n FROM s GROUP BY lang),
e AS (SELECT lang, ws, unnest(range(1, 6)) AS k FROM s),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f
      FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM e) GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM g WHERE k > 1),
m AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n.n, (1000 * CAST(a AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score, cut
      FROM c JOIN n USING (lang) JOIN g x ON x.lang = c.lang AND x.phrase = array_to_string(ws[1:cut], ' ')
      JOIN g y ON y.lang = c.lang AND y.phrase = array_to_string(ws[cut + 1:], ' ')),
b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = b.lang AND g.f >= b.a AND g.phrase <> b.phrase
        AND contains(' ' || g.phrase || ' ', ' ' || b.phrase || ' ')))
SELECT lang, row_number() OVER w AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o
WINDOW w AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER w <= 2000""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"), top=2000, least=100)
