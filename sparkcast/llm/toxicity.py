"""Severity grades of toxicity by cumulative-link regression on sparse word features."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.batches import giving_back
from sparkcast.session import cut_lineage

SAMPLE = 20_000  # labelled rows the model is fitted on
FEATURES = 20_000  # words the model may hold
CUTS = (3, 8)  # telling words from which a toxic document is of grade 2, 3
MIN_DOCS = 3
MIN_Z = 3.5

_words = regex.compile(r"\w+").finditer


def words(text: str | None) -> Iterator[str]:
    for match in _words((text or "").lower()):
        yield match.group()


@dataclass
class SeverityModel:
    """One weight per word for all grades; ``thresholds[k]`` parts the grades up to k from those above."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for each k."""
        hits = Counter(w for w in words(text) if w in self.weights)
        score = sum(self.weights[w] * (1 + math.log(n)) for w, n in sorted(hits.items()))
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int,
                l2: float = 3e-5, steps: int = 600, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and rising thresholds that maximise the cumulative logit likelihood of ``grades`` with an L2 penalty.

    The sparse matrix is given by entries. Thresholds are a first one and positive gaps, so that they stay in order.
    """
    n = len(grades)
    w, base, gaps = np.zeros(n_features), np.array([1.0]), np.zeros(n_grades - 2)
    params = [w, base, gaps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        cuts = np.concatenate([base, base + np.cumsum(np.exp(gaps))]) if n_grades > 2 else base
        score = np.bincount(rows, values * w[cols], n)
        upper = np.where(grades < n_grades - 1, _sigmoid(np.append(cuts, 0.0)[grades] - score), 1.0)
        lower = np.where(grades > 0, _sigmoid(np.concatenate([[0.0], cuts])[grades] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        by_score = upper + lower - 1
        by_cut = (np.bincount(grades, upper * (1 - upper) / p, n_grades)[:-1]
                  - np.bincount(grades, lower * (1 - lower) / p, n_grades)[1:])
        tails = np.cumsum(by_cut[::-1])[::-1]
        ascent = [np.bincount(cols, values * by_score[rows], n_features) / n - l2 * w, tails[:1] / n, tails[1:] * np.exp(gaps) / n]
        for k, g in enumerate(ascent):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            size = rate * min(1.0, 2 - 2 * step / steps)
            params[k] += size * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return w, np.concatenate([base, base + np.cumsum(np.exp(gaps))])


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, toxic: str, sample: int) -> DataFrame:
    """``(id, toxic, words, n)``: the words of at most ``sample`` labelled documents, chosen by a hash of the id."""
    known = (labels.select(F.col(doc_id).cast("long").alias("id"), F.col(toxic).cast("int").alias("toxic"))
             .where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").alias("toxic"))
             .orderBy(F.xxhash64("id"), "id").limit(sample))

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = Counter(words(batch.column(2)[i].as_py()))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(found), pa.int64()),
                         pa.array([batch.column(1)[i].as_py()] * len(found), pa.int32()),
                         pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["id", "toxic", "word", "n"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    joined = rows.join(F.broadcast(known), "id").select("id", "toxic", "text")  # at most ``sample`` rows of two numbers
    return joined.mapInArrow(run, "id long, toxic int, word string, n long")


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic",
        sample: int = SAMPLE, features: int = FEATURES) -> SeverityModel:
    """A model from at most ``sample`` labelled documents.

    Words that part toxic from other labelled documents (z of the log odds) become features. Labels only say toxic or not; a
    toxic document's grade is 1, or more by the number of its telling words (``CUTS``). Without labels of both kinds or
    without telling words the model is empty and finds nothing.
    """
    found = cut_lineage(labelled(docs, labels, doc_id, text, toxic, sample))
    per_doc = found.groupBy("id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"] > 0: r["count"] for r in per_doc.withColumn("toxic", (F.col("toxic") > 0).cast("int")).groupBy("toxic").count().collect()}
    n_toxic, n_other = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_other:
        return SeverityModel()
    table = found.groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("a"), F.count_if(F.col("toxic") <= 0).alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n_toxic + 1 - a)) - F.log(b / (n_other + 1 - b))
    z = odds / F.sqrt(1 / a + 1 / b)
    telling = [r["word"] for r in table.where(F.col("a") >= MIN_DOCS).withColumn("z", z).where(F.col("z") >= MIN_Z)
               .orderBy(F.desc("z"), "word").limit(features).select("word").collect()]
    if not telling:
        return SeverityModel()
    at = {w: i for i, w in enumerate(telling)}
    kept = F.broadcast(docs.sparkSession.createDataFrame(list(at.items()), "word string, at int"))
    # Numbers only, of at most ``sample`` documents.
    entries = found.join(kept, "word").select("id", "at", "n").orderBy("id", "at").toArrow()
    per = per_doc.orderBy("id").toArrow()
    rows = np.searchsorted(per["id"].to_numpy(), entries["id"].to_numpy())
    cols, counts = entries["at"].to_numpy().astype(np.int64), entries["n"].to_numpy().astype(np.float64)
    total = np.bincount(rows, counts, per.num_rows)
    is_toxic = per["toxic"].to_numpy() > 0
    grades = np.where(is_toxic, 1 + sum((total >= c).astype(np.int64) for c in CUTS), 0)
    weights, thresholds = fit_ordinal(rows, cols, 1 + np.log(counts), grades, len(telling), len(CUTS) + 2)
    return SeverityModel({w: float(weights[i]) for w, i in at.items()}, thresholds.tolist())


def grade(docs: DataFrame, model: SeverityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, severity, grade, toxic)`` for every row of ``docs``.

    ``severity`` is the expected grade, ``grade`` the most that is reached with a probability of a half, ``toxic`` whether that
    is above 0. A NULL or empty text is graded by no words at all; repeated rows and NULL ids stay as they are, other columns
    are not read, an empty table gives an empty result. An empty model gives 0. One narrow stage, no shuffle.
    """
    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            above = [model.above(t.as_py()) for t in batch.column(1)]
            grades = [sum(p >= 0.5 for p in a) for a in above]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sum(a) for a in above], pa.float64()), pa.array(grades, pa.int32()),
                 pa.array([g > 0 for g in grades], pa.bool_())], ["doc_id", "severity", "grade", "toxic"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, "doc_id long, severity double, grade int, toxic boolean")


def without_toxic(docs: DataFrame, model: SeverityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that aren't toxic."""
    place = docs.columns.index(text)

    @giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([not any(p >= 0.5 for p in model.above(t.as_py())) for t in batch.column(place)], pa.bool_())
            yield batch.filter(keep)

    return docs.mapInArrow(run, docs.schema)
