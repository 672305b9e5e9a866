"""From raw documents to token counts: the text operators as stages over one table.

Each stage gets the documents that the one before kept, written and read again, and all but the last return the columns of
documents. In every stage a NULL text counts as empty, rows equal in id and text fare alike, and NULL ids stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkcast.llm import bpe, lines, mixing, simhash, toxicity
from sparkcast.llm.queries import label_domains
from sparkcast.session import scratch_folder, ship_package

#: Curated text is kept whole, low quality is thinned to its share.
WEIGHTS = {"curated": 0.985, "raw": 0.015}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the severity model, fitted on the labels, finds toxic go."""
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of similar lines the first stays; documents stay, with the text that is left and its length."""
    ship_package(spark)
    kept = lines.without_duplicate_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id: five-word shingles, similarity 0.8."""
    ship_package(spark)
    return simhash.first_of_similar(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn by rates of at most 1 that bring the expected tokens of the domains to ``WEIGHTS``."""
    ship_package(spark)
    labels = label_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    whole = docs.select("doc_id", "text", F.struct(*docs.columns).alias("_document"))  # no other name of a column can clash
    mixed = mixing.mix(whole, labels, WEIGHTS, anchor="curated", most=1.0)
    return mixed.where("_copies > 0").select("_document.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with digests of the ids and of the text decoded from them."""
    ship_package(spark)
    coded = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: Fitted models, union-find and byte-pair encoding have no SQL; the tests hold each stage against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_folder(spark)}/stage-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
