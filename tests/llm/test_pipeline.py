import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from sparkcast.llm import simhash, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """What each stage gets, and the last result."""
    root = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append(docs)
        stage(spark, docs, SF).write.parquet(f"{root}/{len(out)}")
        docs = spark.read.parquet(f"{root}/{len(out)}")
    return [*out, docs]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_columns_stay(staged):
    assert all(sorted(d.columns) == sorted(staged[0].columns) for d in staged[:-1])
    assert all(ids(b) <= ids(a) for a, b in zip(staged, staged[1:]))


def test_toxic_go(spark, staged):
    model = toxicity.fit(staged[0], spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = ids(toxicity.grade(staged[0], model).where("toxic"))
    assert ids(staged[0]) - ids(staged[1]) == toxic


def test_lines_go_and_documents_stay(staged):
    assert ids(staged[1]) == ids(staged[2])
    assert staged[2].where(F.length("text") != F.col("n_chars")).count() == 0
    lines = [s for r in staged[2].select("text").collect() for s in {" ".join(x.lower().split()) for x in r.text.split("\n")} if s]
    assert len(lines) == len(set(lines))


def test_one_of_each_group_stays(staged):
    before = {r.doc_id: r.text for r in staged[2].select("doc_id", "text").collect()}
    kept = ids(staged[3])
    for d in set(before) - kept:
        assert any(k < d and simhash.similarity(before[k], before[d]) >= 0.8 for k in kept)
    some = sorted(kept)[:80]
    assert not any(simhash.similarity(before[a], before[b]) >= 0.9 for a in some for b in some if a < b)


def test_mixing_only_draws(staged):
    assert ids(staged[4]) <= ids(staged[3]) and staged[4].count() >= 0.8 * staged[3].count()


def test_tokens(staged):
    rows = staged[5].collect()
    assert len(rows) == staged[4].count() and all(r.n_tokens > 0 and len(r.ids_sha256) == 64 for r in rows if r.n_tokens)


def test_odd_documents(spark):
    """Nulls, empty texts, repeated rows, an empty table and a further column go through every stage."""
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(20).withColumn("component", F.lit(1))
    odd = base.limit(2).withColumn("text", F.lit(None).cast("string")).unionByName(base.limit(3)).unionByName(
        base.limit(2).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit("")))
    for docs in (base.unionByName(odd), base.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            n = out.count()
            assert n <= docs.count()
            if name != "tokens":
                assert sorted(out.columns) == sorted(docs.columns)
