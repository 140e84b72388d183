"""Toxicity: a factorization machine over hashed terms.

A text is the set of its lower-cased words and their stems (the first letters of longer
words, so that inflected forms count together), hashed to ``BUCKETS`` buckets. The machine adds a weight for
each term and, for each pair of terms, the product of their factors: pairs that mean something only
together raise the score although neither does alone. The sum over all pairs is
``(|sum v|^2 - sum |v|^2) / 2``, so scoring is linear in the number of terms.

Training minimises the log loss. First weights alone are fitted by proximal steps; the penalty of a term
grows with the square root of its document count, at the level that the largest of that many pure-noise
gradients reaches, so that weights of terms that carry no signal become exactly zero. Factors are looked for among
all terms: near zero, the loss falls fastest along the leading eigenvectors of the terms' co-occurrences weighted
by what the weights leave unexplained (``pair_directions``; two sparse products a step, pairs are never listed).
A direction stays if it stands out from those of shuffled errors, and in it the terms that stand out. These terms
and those with a weight are then fitted together with a twentieth of the penalty, which takes the shrinkage
away. The model is small, and a long text gains no noise from its thousands of ordinary words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import written

from .common import free_names

BUCKETS = 1 << 24
STEMS = (4, 5, 6, 7)


def term_buckets(text: Column) -> Column:
    """Distinct hash buckets of a text's words and of the first ``STEMS`` letters of longer words (null: none)."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    words = F.filter(words, lambda w: w != "")
    bucket = lambda *parts: F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")

    def stems(length: int) -> Column:
        longer = F.filter(words, lambda w: F.length(w) > length)
        return F.transform(longer, lambda w: bucket(F.lit(length), F.substring(w, 1, length)))

    return F.array_distinct(F.concat(F.transform(words, lambda w: bucket(w)), *map(stems, STEMS)))


@dataclass(frozen=True)
class Machine:
    """Bias, sorted buckets with a weight and factors each; all other buckets count nothing."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def score(self, terms: list[np.ndarray]) -> np.ndarray:
        """Probabilities of label 1."""
        raw = np.full(len(terms), self.bias)
        if len(self.buckets) and terms:
            doc = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
            flat = np.concatenate([np.asarray(t, np.int64) for t in terms])
            at = np.minimum(np.searchsorted(self.buckets, flat), len(self.buckets) - 1)
            hit = self.buckets[at] == flat
            doc, at = doc[hit], at[hit]
            raw += np.bincount(doc, self.weights[at], len(terms))
            for f in self.factors.T:
                raw += 0.5 * (np.bincount(doc, f[at], len(terms)) ** 2 - np.bincount(doc, f[at] ** 2, len(terms)))
        return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))


def _descend(
    doc: np.ndarray, column: np.ndarray, labels: np.ndarray, penalty: np.ndarray, bias: float, w: np.ndarray,
    v: np.ndarray, rounds: int, rate: float = 0.1,
) -> tuple[float, np.ndarray, np.ndarray]:
    """Adam steps on the mean log loss, with a soft threshold on weights and a ridge on factors."""
    n, p, rank = len(labels), len(w), v.shape[1]
    spread = labels.mean() * (1 - labels.mean())
    mw, vw, mv, vv = np.zeros(p), np.zeros(p), np.zeros((p, rank)), np.zeros((p, rank))
    for step in range(1, rounds + 1):
        raw = bias + np.bincount(doc, w[column], n)
        if rank:
            sums = np.stack([np.bincount(doc, f[column], n) for f in v.T], axis=1)
            raw += 0.5 * ((sums**2).sum(axis=1) - np.bincount(doc, (v**2).sum(axis=1)[column], n))
        error = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels) / n
        bias -= error.sum() / spread
        each, down1, down2 = error[doc], 1 - 0.9**step, 1 - 0.99**step
        gw = np.bincount(column, each, p)
        mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw**2
        pace = rate / (np.sqrt(vw / down2) + 1e-8)
        if rank:
            gv = np.stack([np.bincount(column, each * s[doc], p) for s in sums.T], axis=1)
            gv += (penalty - gw)[:, None] * v
            mv, vv = 0.9 * mv + 0.1 * gv, 0.99 * vv + 0.01 * gv**2
            v = v - rate / np.sqrt(step) * (mv / down1) / (np.sqrt(vv / down2) + 1e-8)
        w = w - pace * mw / down1
        w = np.sign(w) * np.maximum(np.abs(w) - pace * penalty, 0)
    return bias, w, v


def pair_directions(
    doc: np.ndarray, column: np.ndarray, count: np.ndarray, error: np.ndarray, rank: int, steps: int = 5
) -> np.ndarray:
    """Start values of factors, a row for each term, zero for terms and directions within the noise.

    They are the leading eigenvectors of the matrix with entries "sum of ``error`` over the documents that hold
    both terms" (none on the diagonal, and without the terms' means, which carry what single terms say), scaled
    down by the terms' counts, from ``steps`` blocks of Krylov vectors.
    A direction counts if its eigenvalue is 1.3 times the largest one with the errors shuffled over the
    documents, a term if its share passes what the largest of so many random shares reaches.
    """
    p, n = len(count), len(error)
    out = np.zeros((p, rank))
    if p < 2 or not rank:
        return out
    rng, scale, mean = np.random.default_rng(11), 1 / np.sqrt(count + 0.05 * n), count / n

    def leading(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.bincount(column, weight[doc], p) * (1 - 2 * mean) + mean**2 * weight.sum()

        def times(v: np.ndarray) -> np.ndarray:
            v = scale * v
            met = (np.bincount(doc, v[column], n) - mean @ v) * weight
            return scale * (np.bincount(column, met[doc], p) - mean * met.sum() - own * v)

        basis = np.linalg.qr(rng.normal(size=(p, min(rank + 2, p))))[0]
        last, images = basis, []
        while True:
            images.append(np.stack([times(v) for v in last.T], axis=1))
            if len(images) == steps:
                break
            rest = images[-1]
            for _ in range(2):
                rest = rest - basis @ (basis.T @ rest)
            last, sizes = np.linalg.qr(rest)
            last = last[:, np.abs(np.diag(sizes)) > 1e-9]
            if not last.shape[1] or basis.shape[1] + last.shape[1] > p:
                break
            basis = np.hstack([basis, last])
        small = basis.T @ np.hstack(images)
        values, vectors = np.linalg.eigh((small + small.T) / 2)
        return values[::-1], basis @ vectors[:, ::-1]

    values, vectors = leading(error)
    noise = leading(rng.permutation(error))[0][0]
    least = np.sqrt(2 * np.log(p) / p)
    for i in range(min(rank, len(values))):
        if values[i] > 1.3 * noise:
            found = np.where(np.abs(vectors[:, i]) > least, scale * vectors[:, i], 0)
            out[:, i] = 0.5 * found / max(np.abs(found).max(), 1e-12)
    return out


def fit_machine(terms: list[np.ndarray], labels: np.ndarray, rank: int = 4, least_docs: int = 3) -> Machine:
    """Fit on bucket sets and 0/1 labels. One class only, or no row: the bias is all there is."""
    share = float(labels.mean()) if len(labels) else 0.0
    bias = float(np.log(share / (1 - share))) if 0 < share < 1 else 40.0 if share else -40.0
    empty = Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, rank)))
    if not 0 < share < 1:
        return empty
    flat = np.concatenate([np.asarray(t, np.int32) for t in terms])
    doc = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
    buckets, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = column.astype(np.int32)

    def only(keep: np.ndarray, doc: np.ndarray, column: np.ndarray):
        """The problem with the kept terms alone."""
        spot = (np.cumsum(keep) - 1).astype(np.int32)
        rows = keep[column]
        return doc[rows], spot[column[rows]]

    often = count >= least_docs
    doc, column = only(often, doc, column)
    buckets, count = buckets[often].astype(np.int64), count[often]
    if not len(buckets):
        return empty
    noise = np.sqrt(2 * np.log(len(buckets) + 1)) * np.sqrt(share * (1 - share)) / len(labels)
    penalty, stays = noise * np.sqrt(count), np.ones(len(buckets), bool)
    w = np.zeros(len(buckets))
    for rounds in (40, 120):
        bias, w[stays], _ = _descend(*only(stays, doc, column), labels, penalty[stays], bias, w[stays], np.zeros((stays.sum(), 0)), rounds)
        stays = w != 0
    near, at = only(stays, doc, column)
    loose, eased, _ = _descend(near, at, labels, penalty[stays] / 20, bias, w[stays], np.zeros((stays.sum(), 0)), 300)
    left = labels - 1 / (1 + np.exp(-np.clip(loose + np.bincount(near, eased[at], len(labels)), -40, 40)))
    v = pair_directions(doc, column, count, left, rank)
    v[stays] += np.random.default_rng(7).normal(0, 0.1, (stays.sum(), rank))
    stays |= v.any(axis=1)
    if not stays.any():
        return Machine(float(bias), buckets[:0], w[:0], np.zeros((0, rank)))
    bias, w, v = _descend(*only(stays, doc, column), labels, penalty[stays] / 20, bias, w[stays], v[stays], 300)
    return Machine(float(bias), buckets[stays], w, v)


def train_toxicity(
    docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, rank: int = 4, target: str = "toxic"
) -> Machine:
    """Fit on at most about ``max_rows`` labelled documents (chosen by a hash of ``doc_id``; all of them where
    there are fewer). That bounded sample is fitted in one task, whose model alone reaches the driver.

    ``labels``: ``doc_id`` and ``target``; null labels and ids are left out, of repeated labels the largest counts.
    """
    marks = labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max(F.col(target).cast("int")).alias("_y")
    )
    rows = docs.select("doc_id", "text").join(marks, "doc_id")
    total = marks.count()
    if total > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * max_rows / total))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(batches)
        rows = pd.concat(got) if got else pd.DataFrame({"doc_id": [], "terms": [], "_y": []})
        rows = rows.assign(_n=rows.terms.map(len)).sort_values(["doc_id", "_y", "_n"])
        model = fit_machine(list(rows.terms), rows._y.to_numpy(float), rank)
        yield pd.DataFrame({
            "bucket": [-1, *model.buckets], "weight": [model.bias, *model.weights],
            "factors": [np.zeros(rank), *model.factors],
        })

    sample = rows.select("doc_id", term_buckets(F.col("text")).alias("terms"), "_y").repartition(1)
    table = written(sample.mapInPandas(fit, "bucket long, weight double, factors array<double>"), "toxicity-model")
    model = table.orderBy("bucket").toPandas()
    factors = np.stack(model.factors.tolist())[1:] if len(model) > 1 else np.zeros((0, rank))
    bias = float(model.weight[0]) if len(model) else -40.0
    return Machine(bias, model.bucket.to_numpy()[1:], model.weight.to_numpy()[1:], factors)


def toxicity_score(model: Machine, text: Column) -> Column:
    """Score between 0 and 1 of each whole text; null and empty texts get the bias alone."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for terms in batches:
            yield pd.Series(model.score(list(terms)))

    return score(term_buckets(text))


def score_toxicity(docs: DataFrame, model: Machine) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` (1 from 0.5) for each row of ``docs``.

    Repeated rows are scored alike, a score of exactly 0.5 is toxic, other columns are ignored.
    """
    return docs.select("doc_id", toxicity_score(model, F.col("text")).alias("score")).select(
        "doc_id", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(docs: DataFrame, model: Machine) -> DataFrame:
    """The documents (all columns) that score below 0.5."""
    (mark,) = free_names(docs, "toxicity")
    scored = docs.withColumn(mark, toxicity_score(model, F.col("text")))
    return scored.filter(F.col(mark) < 0.5).select(docs.columns)
