"""Language identification in two steps: the family first, then the language within the family.

A text is a vector of hashed letter n-grams (orders 1 to 4, a blank around each word), with square-root
counts and unit length. Families are not given: average linkage joins the languages whose mean vectors
are closest until at most ``sqrt(number of languages)`` rounded up are left. Linear support vector
machines, one against one, then separate each pair of families and each pair of languages inside a
family. Every pair is fitted in a task of its own from a bounded sample of each label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import written

from .common import sized

BITS, ORDERS = 13, 4
WIDTH = 1 << BITS
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letter_grams(text: str | None) -> np.ndarray | None:
    """The unit vector of a whole text's n-grams; None where there is no letter."""
    letters = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, letters)):  # Unicode category L
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    counts = np.zeros(WIDTH, np.float32)
    value = np.zeros(len(codes), np.uint64)
    for order in range(1, ORDERS + 1):
        if len(codes) < order:
            break
        value = value[: len(codes) - order + 1] * np.uint64(0x100000001B3) + codes[order - 1 :]
        mixed = (value + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        counts += np.bincount((mixed >> np.uint64(64 - BITS)).astype(np.int64), minlength=WIDTH)
    counts = np.sqrt(counts)
    return counts / np.linalg.norm(counts)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 30) -> np.ndarray:
    """A linear machine (last value: bias) for labels +1 and -1 by dual coordinate descent; classes weigh alike."""
    x = np.hstack([x, np.full((len(x), 1), 0.3, x.dtype)])
    limit = cost * len(y) / (2.0 * np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum())))
    norms, alpha, w = (x**2).sum(axis=1), np.zeros(len(y)), np.zeros(x.shape[1])
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            step = np.clip(alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i], 0, limit[i]) - alpha[i]
            if step:
                alpha[i] += step
                w += step * y[i] * x[i]
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    w[-1] *= 0.3
    return w


def language_families(names: list[str], centres: np.ndarray) -> list[list[str]]:
    """Average-linkage groups of languages, at most ``ceil(sqrt(n))``."""
    groups = [[i] for i in range(len(names))]
    close = centres @ centres.T
    while len(groups) > ceil(sqrt(len(names))):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: close[np.ix_(groups[p[0]], groups[p[1]])].mean())
        groups[a] += groups.pop(b)
    return sorted(sorted(names[i] for i in g) for g in groups)


@dataclass(frozen=True)
class LanguageModel:
    """Families and, for each pair of families or of languages in one, the machine that parts them."""

    families: list[list[str]]
    pairs: list[tuple[str, str]]
    machines: np.ndarray

    def _winner(self, names: list[str], margins: dict) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        wins = {n: [0, 0.0] for n in names}
        for a, b in combinations(names, 2):
            m = margins[a, b]
            for name, gain in ((a, m), (b, -m)):
                wins[name][0] += gain > 0
                wins[name][1] += gain
        best = max(names, key=lambda n: (wins[n], n))
        least = min(margins[a, b] if a == best else -margins[a, b] for a, b in combinations(names, 2) if best in (a, b))
        return best, 1 / (1 + np.exp(-3 * least))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        vectors = [letter_grams(t) for t in texts]
        known = [v for v in vectors if v is not None]
        margins = iter(np.stack(known) @ self.machines[:, :-1].T + self.machines[:, -1] if known and len(self.pairs) else [()] * len(known))
        labels, scores = [], []
        for v in vectors:
            if v is None or not self.families:
                labels.append("und")
                scores.append(0.0)
                continue
            found = dict(zip(self.pairs, next(margins), strict=True))
            family, sure = self._winner([f"#{i}" for i in range(len(self.families))], found)
            label, within = self._winner(self.families[int(family[1:])], found)
            labels.append(label)
            scores.append(float(sure * within))
        return labels, scores


def training_texts(docs: DataFrame, per_label: int = 600) -> DataFrame:
    """``lang``, ``text``: of each non-null ``lang`` the ``per_label`` distinct texts with the smallest hashes
    (all where there are fewer). Texts without a letter are left out; copies count once, whatever their number.

    The first filter on the hash leaves about twice as many as needed, so that few rows are ranked.
    """
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("text", F.lit(9)).alias("_hash")
    )
    hashes = written(rows.select("lang", "_hash").distinct(), "language-hashes")
    counts = hashes.groupBy("lang").agg(F.count("*").alias("_n"))
    low = F.col("_hash") / F.lit(2.0**64) + 0.5 <= (2 * per_label + 200) / F.col("_n")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_hash"))
    chosen = hashes.join(sized(counts), "lang").filter(low).withColumn("_place", place).filter(F.col("_place") <= per_label)
    chosen = written(chosen.select("lang", "_hash"), "language-chosen")
    return rows.join(sized(chosen), ["lang", "_hash"]).select("lang", "text").distinct()


def train_language(docs: DataFrame, per_label: int = 600) -> LanguageModel:
    """Fit on ``text`` and non-null ``lang`` of at most ``per_label`` distinct texts of each label (``training_texts``).

    Only mean vectors and machines, whose size the number of labels bounds, reach the driver.
    """
    spark = docs.sparkSession
    sample = training_texts(docs, per_label)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [letter_grams(t) for t in batch.text]
            keep = [v is not None for v in found]
            yield pd.DataFrame({"lang": batch.lang[keep], "key": batch.text[keep], "vector": [v.tobytes() for v in found if v is not None]})

    sample = written(sample.mapInPandas(vectors, "lang string, key string, vector binary").select(
        "lang", F.md5("key").alias("key"), "vector"
    ), "language-sample")

    def centre(group: pd.DataFrame) -> pd.DataFrame:
        mean = np.stack([np.frombuffer(v, np.float32) for v in group.vector]).astype(float).mean(axis=0)
        return pd.DataFrame({"lang": [group.lang.iloc[0]], "centre": [mean / np.linalg.norm(mean)]})

    centres = sample.groupBy("lang").applyInPandas(centre, "lang string, centre array<double>").orderBy("lang").toPandas()
    names = list(centres.lang)
    if not names:
        return LanguageModel([], [], np.zeros((0, WIDTH + 1)))
    families = language_families(names, np.stack(centres.centre))
    tasks = [(f"#{i}", f"#{j}", x, 1.0 if x in families[i] else -1.0) for i, j in combinations(range(len(families)), 2) for x in families[i] + families[j]]
    tasks += [(a, b, x, 1.0 if x == a else -1.0) for f in families for a, b in combinations(f, 2) for x in (a, b)]
    if not tasks:
        return LanguageModel(families, [], np.zeros((0, WIDTH + 1)))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["lang", "key"])
        x = np.stack([np.frombuffer(v, np.float32) for v in group.vector])
        return pd.DataFrame({"a": [group.a.iloc[0]], "b": [group.b.iloc[0]], "machine": [fit_svm(x, group.y.to_numpy())]})

    plan = spark.createDataFrame(tasks, "a string, b string, lang string, y double")
    fitted = written(
        sample.join(F.broadcast(plan), "lang").groupBy("a", "b").applyInPandas(fit, "a string, b string, machine array<double>"),
        "language-machines",
    ).orderBy("a", "b").toPandas()
    return LanguageModel(families, list(zip(fitted.a, fitted.b, strict=True)), np.stack(fitted.machine))


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """Struct of ``lang`` (``und`` where a text is null or has no letter, or nothing was learned) and ``score``."""

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            labels, scores = [], []
            for at in range(0, len(texts), 512):
                found = model.predict(list(texts.iloc[at : at + 512]))
                labels += found[0]
                scores += found[1]
            yield pd.DataFrame({"lang": labels, "score": scores})

    return predict(docs[text])
