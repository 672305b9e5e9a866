"""Rates for documents, so that expected domain totals match target weights.

A document belongs to each domain with a probability: a naive Bayes classifier on the words and signs that tell the domains of a labelled
table apart. With tokens ``t``, memberships ``p`` and rates ``w`` the expected totals are the sum of ``t p w``; they shall equal
the targets ``T``: least squares over rates between their bounds, by projected gradient steps from 1. A document's gradient is
``t p' (totals - T)``; the steps are scaled by the tokens of a document and by the inverse of the small Gram matrix of the memberships, so that a
rare domain moves as fast as a large one. A step is one number for each domain, ``w = clip(w + p' v)``, and one sum over the documents.

The first step is an implicit one: along the gradient at its own end, ``v = (T - totals) / e``. This is the least of a convex function of ``v``,
found by Newton's method with smaller and smaller ``e``. Explicit steps would creep along the bounds of documents that are nearly of one domain.
"""

from __future__ import annotations

import json
import warnings
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkcast.llm.skew import unused
from sparkcast.session import cut_lineage

SAMPLE = 20_000  # labelled documents the classifier is fitted on
WORDS = 2_000  # words it may hold
MIN_DOCS = 3
MIN_Z = 4.0
STEPS = 200
TRIED = (1.0, 0.25, 0.0625, 0.0078125)  # parts of a scaled step that one pass tries
PLAIN = (256.0, 32.0, 4.0, 1.0)  # the same for steps that aren't scaled; a whole one always leads down
EASED = (1e-3, 1e-5, 1e-7, 1e-9)  # parts of the trace of the Gram matrix that weigh the implicit step
HALVED = (1.0, 0.5, 0.125, 0.015625)  # parts of a Newton step that one pass tries
NEWTON = 12  # passes for each weight, at most
NEAR = 1e-3  # of the distance to the targets: what is left of the implicit equation, and what a smaller weight must gain
RIDGE = 1e-9  # of the trace of the Gram matrix
STILL = 1e-7  # of the distance to the targets: no part of a step brings them nearer by more
BUCKETS = 1 << 13
CLOSE = 1e-4  # of each target
_SIGNS = "#*$%&|<>!?@=+~^"
# White space, punctuation and signs, as a class of a pattern: one of plain characters only, which Java tests by a table.
_GAPS = r"[ \t\n\x0B\f\r.,;:()\[\]{}\"'/\\_#*$%&|<>!?@=+~^-]+"


def words_of(text: Column) -> Column:
    """The words of a text in lower case: what is between white space, punctuation and signs."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAPS), "")


def signs_of(text: Column) -> Column:
    """The signs that a text has, each once."""
    return F.filter(F.array(*map(F.lit, _SIGNS)), lambda c: F.contains(F.coalesce(text, F.lit("")), c))


@dataclass
class DomainModel:
    domains: list[str]
    priors: list[float]  # logarithms
    words: dict[str, list[float]] = field(default_factory=dict)  # log odds of each domain against all

    def posterior(self, words: Column, signs: Column) -> Column:
        """An array of the probabilities of the domains, by functions of the row alone."""
        start = F.array(*[F.lit(float(p)) for p in self.priors])
        scores = start
        if self.words:
            names = sorted(self.words)
            # a map would be scanned key by key; in an array the bucket of a word is at hand, with the few words it may hold
            at: list[list] = [[] for _ in range(BUCKETS)]
            for w in names:
                h = xxhash.xxh64_intdigest(w.encode(), 42)
                at[(h - (1 << 64) if h >> 63 else h) % BUCKETS].append({"w": w, "o": self.words[w]})
            buckets = F.from_json(F.lit(json.dumps(at)), "array<array<struct<w: string, o: array<double>>>>")
            held = F.array_distinct(F.filter(F.concat(words, signs), lambda w: w.isin(names)))
            odds = lambda w: F.get(F.filter(F.get(buckets, F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int")), lambda e: e["w"] == w), F.lit(0))["o"]
            scores = F.aggregate(held, start, lambda acc, w: F.zip_with(acc, odds(w), lambda a, b: a + b))
        shifted = F.transform(F.array(scores), lambda s: F.transform(s, lambda x: F.exp(x - F.array_max(s))))
        return F.transform(shifted, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))[0]

    def members(self, docs: DataFrame, text: str) -> DataFrame:
        """``docs`` with ``_tokens`` (its words) and ``_posterior``."""
        words, signs = unused(docs, "_words"), unused(docs, "_signs")
        split = docs.withColumns({words: words_of(F.col(text)), signs: signs_of(F.col(text))})
        found = split.withColumns({"_tokens": F.size(words).cast("long"), "_posterior": self.posterior(F.col(words), F.col(signs))})
        return found.drop(words, signs)


def fit(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text",
        domain: str = "domain", sample: int = SAMPLE, words: int = WORDS) -> DomainModel:
    """Classifier of ``domains`` from at most ``sample`` rows of ``labelled``, chosen by a hash of the id.

    Rows with a NULL id, or a domain that isn't listed, are left out; of two domains of one id the smaller name counts. Without
    labelled documents all domains are equally likely.
    """
    known = (labelled.select(F.col(doc_id).cast("long").alias("id"), F.col(domain).alias("domain"))
             .where(F.col("id").isNotNull() & F.col("domain").isin(domains)).groupBy("id").agg(F.min("domain").alias("domain"))
             .orderBy(F.xxhash64("id"), "id").limit(sample))
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL")
    found = cut_lineage(rows.join(F.broadcast(known), "id").select(  # at most ``sample`` short rows
        "domain", F.array_distinct(F.concat(words_of(F.col("text")), signs_of(F.col("text")))).alias("words")))
    sizes = {r["domain"]: r["count"] for r in found.groupBy("domain").count().collect()}
    total, k = sum(sizes.values()), len(domains)
    priors = [float(np.log((sizes.get(d, 0) + 1) / (total + k))) for d in domains]
    counts = found.select("domain", F.explode("words").alias("word")).groupBy("word").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("domain") == d).alias(f"n{i}") for i, d in enumerate(domains)])
    strengths = []
    for i, d in enumerate(domains):
        size = sizes.get(d, 0)
        a, b = F.col(f"n{i}") + 0.5, F.col("n") - F.col(f"n{i}") + 0.5
        odds = F.log(a / (size + 1 - a)) - F.log(b / (total - size + 1 - b))
        strengths.append(F.abs(odds / F.sqrt(1 / a + 1 / b)))
    strength = F.greatest(*strengths) if k > 1 else strengths[0]
    chosen = (counts.where(F.col("n") >= MIN_DOCS).withColumn("strength", strength).where(F.col("strength") >= MIN_Z)
              .orderBy(F.desc("strength"), "word").limit(words).collect())
    model = DomainModel(list(domains), priors)
    for row in chosen:
        share = (row["n"] + 1) / (total + 2)
        model.words[row["word"]] = [
            float(np.log((row[f"n{i}"] + share) / (sizes.get(d, 0) + 1) / share)) for i, d in enumerate(domains)]
    return model


@dataclass
class Mixture:
    """The steps that the rates are made of, and how far the expected totals are from their targets.

    ``converged``: no step brings the totals nearer; ``met``: the expected total of every domain is its target, up to ``CLOSE`` of it.
    """

    targets: list[float]
    expected: list[float]
    most: float | None
    steps: list[list[float]] = field(default_factory=list)
    converged: bool = True

    @property
    def met(self) -> bool:
        return _within(np.array(self.expected) - np.array(self.targets), np.array(self.targets))

    def rate(self, posterior: Column) -> Column:
        """The rate of a document: 1, moved by every step and brought back between the bounds after each."""
        first = _clip(F.lit(1.0), self.most)
        if not self.steps:
            return first
        steps = F.from_json(F.lit(json.dumps(self.steps)), "array<array<double>>")
        return F.aggregate(steps, first, lambda w, v: _clip(w + _dot(posterior, v), self.most))


def _within(off: np.ndarray, targets: np.ndarray) -> bool:
    """Every domain is off by at most ``CLOSE`` of its target; targets of nothing go by the sum of all."""
    return bool((np.abs(off) <= CLOSE * np.where(targets > 0, targets, max(targets.sum(), 1.0))).all())


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _clip(rate: Column, most: float | None) -> Column:
    low = F.greatest(F.lit(0.0), rate)
    return low if most is None else F.least(F.lit(float(most)), low)


@dataclass
class _Sums:
    """Of the rates that a step leads to: totals, Gram matrix of the documents between the bounds, and the function that an implicit step makes least."""

    totals: np.ndarray
    free: np.ndarray
    value: float


def _passes(members: DataFrame, mix: Mixture, step: np.ndarray, parts: tuple[float, ...], start: np.ndarray | None = None) -> list[_Sums]:
    """The sums for each part of ``step``, of one pass: after the steps of ``mix``, or from ``start``, as one step with it."""
    k, t, posterior = len(step), F.col("tokens"), F.col("posterior")
    p = [posterior[i] for i in range(k)]
    along = lambda v: _dot(posterior, F.from_json(F.lit(json.dumps(list(map(float, v)))), "array<double>"))
    rate = mix.rate(posterior) if start is None else _clip(F.lit(1.0), mix.most) + along(start)
    now = members.select("tokens", "posterior", rate.alias("w"), along(step).alias("v"))
    now = now.select("tokens", "posterior", *[(F.col("w") + F.col("v") * part).alias(f"x{n}") for n, part in enumerate(parts)])
    now = now.select("*", *[_clip(F.col(f"x{n}"), mix.most).alias(f"w{n}") for n in range(len(parts))])
    sums = []
    for n in range(len(parts)):
        w = F.col(f"w{n}")
        free = (w > 0) if mix.most is None else (w > 0) & (w < float(mix.most))
        over = F.lit(0.0) if mix.most is None else F.greatest(F.col(f"x{n}") - float(mix.most), F.lit(0.0)) * float(mix.most)
        sums += [F.sum(t * w * x) for x in p]
        sums += [F.sum(F.when(free, t * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(i + 1)]
        sums += [F.sum(t * (w * w / 2 + over))]
    got = np.array([x or 0.0 for x in now.agg(*[s.alias(f"s{n}") for n, s in enumerate(sums)]).first()]).reshape(len(parts), -1)
    found = []
    for part, row in zip(parts, got):
        gram = np.zeros((k, k))
        gram[np.tril_indices(k)] = row[k:-1]
        end = part * step if start is None else start + part * step
        found.append(_Sums(row[:k], gram + np.tril(gram, -1).T, row[-1] - end @ mix.targets))
    return found


def _implicit(members: DataFrame, mix: Mixture, first: _Sums, all_rows: np.ndarray) -> tuple[np.ndarray, _Sums]:
    """The implicit step from rates of 1 that comes nearest to the targets, and its sums; ``first`` are those of no step.

    The weight ``e`` of the step falls until it gains nothing more. Where Newton's step leads nowhere, because too few documents are
    between the bounds, the Gram matrix of all rows, which is never too small, takes its place.
    """
    k, targets = len(mix.targets), np.array(mix.targets)
    off = lambda s: np.linalg.norm(s.totals - targets)
    v, now = np.zeros(k), first
    best, sums = v, now
    for part in EASED:
        e, bounded, before = part * np.trace(all_rows), False, off(sums)
        for _ in range(NEWTON):
            left = now.totals - targets + e * v
            if _within(now.totals - targets, targets) or np.linalg.norm(left) <= NEAR * off(now):
                break
            step = np.linalg.solve((all_rows if bounded else now.free) + e * np.eye(k), -left)
            tried = _passes(members, mix, step, HALVED, v)
            values = [s.value + e / 2 * (x := v + h * step) @ x for s, h in zip(tried, HALVED)]
            at = int(np.argmin(values))
            if values[at] < now.value + e / 2 * v @ v:
                v, now, bounded = v + HALVED[at] * step, tried[at], False
                if off(now) < off(sums):
                    best, sums = v, now
            elif bounded:
                break
            else:
                bounded = True
        if _within(sums.totals - targets, targets) or part != EASED[0] and off(sums) > before * (1 - NEAR):
            break
    return best, sums


def match(members: DataFrame, weights: list[float], total: float | None = None, anchor: int | None = None,
          most: float | None = None) -> Mixture:
    """Rates for ``members`` (``tokens``, ``posterior``) whose expected totals are nearest to ``weights`` times ``total``.

    ``total`` is the tokens there are, unless given; with ``anchor`` it is what makes the target of this domain the tokens it
    has. Rates are at least 0 and at most ``most``. Stops when every total is its target up to ``CLOSE`` of it, or no step brings them
    nearer: targets that the bounds rule out are missed, see ``met``. If neither is so after ``STEPS`` steps, ``converged`` is
    false and a warning says so. Rows of NULL tokens or posterior count for nothing; without tokens the rates stay 1.
    """
    k, share = len(weights), np.array(weights) / sum(weights)
    sums = [F.sum(F.col("tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in range(k)]
    have = np.array([x or 0.0 for x in members.agg(*sums).first()])
    total = float(have.sum() if total is None else total)
    if anchor is not None:
        total = float(have[anchor] / share[anchor])
    targets, tokens = share * total, have.sum()
    mix = Mixture(targets.tolist(), have.tolist(), most)
    if tokens == 0:
        return mix
    here = _passes(members, mix, np.zeros(k), (1.0,))[0]
    all_rows = np.array(members.agg(*[F.sum(F.col("tokens") * F.col("posterior")[i] * F.col("posterior")[j]).alias(f"g{i}_{j}")
                                            for i in range(k) for j in range(k)]).first(), float).reshape(k, k)
    if not _within(here.totals - targets, targets):
        step, here = _implicit(members, mix, here, all_rows)
        if step.any():
            mix.steps.append(step.tolist())
    stuck, off = 0, here.totals - targets
    while not _within(off, targets) and len(mix.steps) < STEPS:
        if stuck % 2:  # the plain gradient: bounds may leave it as the only way down
            scaled, parts = -off / np.linalg.eigvalsh(all_rows)[-1], PLAIN
        else:
            gram = (here.free if stuck == 0 else all_rows) + 1e-6 * all_rows
            scaled, parts = np.linalg.solve(gram + RIDGE * np.trace(gram) * np.eye(k), -off), TRIED
        found = _passes(members, mix, scaled, parts)
        left = [np.linalg.norm(f.totals - targets) for f in found]
        best = int(np.argmin(left))
        if left[best] < np.linalg.norm(off) * (1 - STILL):
            mix.steps.append((parts[best] * scaled).tolist())
            here, stuck = found[best], stuck % 2
            off = here.totals - targets
            continue
        stuck += 1
        if stuck > 3:
            break
    mix.expected, mix.converged = here.totals.tolist(), stuck > 3 or _within(off, targets)
    if not mix.converged:
        warnings.warn(f"the rates are not settled after {len(mix.steps)} steps: {mix.expected} instead of {mix.targets}", stacklevel=2)
    return mix


def _rated(members: DataFrame, fitted: Mixture, doc_id: str, key: Column, seed: int) -> DataFrame:
    draw = F.pmod(F.xxhash64(F.lit(seed), key, F.col(doc_id)), F.lit(1 << 52)) / float(1 << 52)
    rated = members.withColumn("_rate", fitted.rate(F.col("_posterior")))
    return rated.withColumn("_copies", F.floor(F.col("_rate") + draw).cast("long"))


def rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text",
          domain: str = "domain", anchor: str | None = None, most: float | None = None, seed: int = 0) -> tuple[DataFrame, DomainModel, Mixture]:
    """``(doc_id, _key, _tokens, _posterior, _rate, _copies)`` of every row of ``docs``, with the models they come from.

    ``_posterior`` goes by the order of ``weights``; ``_key`` is a hash of the text. ``_copies`` is the rate rounded up or down by
    a draw from id and text, so that its mean is the rate and a repeated task draws alike; rows equal in both share their
    draw. A NULL or empty text has no tokens and gets the rate of its prior; other columns are not read. An empty table gives an
    empty result. The classifier and the steps run jobs when called.
    """
    domains = list(weights)
    model = fit(docs, labelled, domains, doc_id, text, domain)
    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("_key"), F.col(text).alias("_text"))
    members = cut_lineage(model.members(read, "_text").drop("_text"))
    sums = members.select(F.col("_tokens").alias("tokens"), F.col("_posterior").alias("posterior"))
    fitted = match(sums, list(weights.values()), anchor=None if anchor is None else domains.index(anchor), most=most)
    return _rated(members, fitted, "doc_id", F.col("_key"), seed), model, fitted


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float], doc_id: str = "doc_id", text: str = "text",
        domain: str = "domain", anchor: str | None = None, most: float | None = None, seed: int = 0) -> DataFrame:
    """``docs`` with all columns and ``_tokens``, ``_posterior``, ``_rate`` and ``_copies``; see ``rates``."""
    clash = {"_tokens", "_posterior", "_rate", "_copies"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns of the result that docs has already: {sorted(clash)}")
    _, model, fitted = rates(docs, labelled, weights, doc_id, text, domain, anchor, most, seed)
    return _rated(model.members(docs, text), fitted, doc_id, F.xxhash64(text), seed)
