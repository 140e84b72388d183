"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.session import written

#: Fixed value: the word pattern over ASCII-lower-cased text (ASCII letters and digits, all else non-ASCII).
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of UTF-8: A-Z become a-z, every other ASCII byte that belongs to no word becomes a blank.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def fold_of(key: Column, folds: int) -> Column:
    """crc32 of the key's text modulo ``folds`` (null keys fall into fold null)."""
    return F.pmod(F.crc32(key.cast("string")), F.lit(folds))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; the cheap built-in serves where the text is pure ASCII."""
    pure = F.octet_length(text) == F.length(text)
    return F.when(pure, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def split_words(text: str | None) -> list[bytes]:
    """The same words inside a task, as UTF-8 bytes."""
    return text.encode().translate(_WORD_BYTES).split() if text else []


class WordHashes(dict):
    """Word to 64-bit hash, remembered up to a fixed number of words."""

    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (two multiply-and-shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; a shorter text is one shingle of all its words."""
    n = len(words)
    if n == 0:
        return words
    width = min(size, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total = (total + words[i : n - width + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        total ^= total >> np.uint64(29)
    return np.unique(mix64(total))


def sized(df: DataFrame, limit: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if the summed size of its rows (as JSON, and 64 bytes each) is within
    ``limit``, else for a merge join: left to itself, Spark goes by the compressed size of the files."""
    held = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))) + 64)).first()[0] or 0
    return F.broadcast(df) if held <= limit else df.hint("merge")


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows sorted by ``keys``, also where a group spans batches."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if batch.empty:
            continue
        values = batch[keys].to_numpy()
        starts = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1), len(batch)]
        if rest and (rest[-1][keys].iloc[-1].to_numpy() != values[0]).any():
            yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
            rest = []
        for a, b in zip(starts[:-2], starts[1:-1], strict=True):
            rest.append(batch.iloc[a:b])
            yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]
            rest = []
        rest.append(batch.iloc[starts[-2] :])
    if rest:
        yield pd.concat(rest, ignore_index=True) if len(rest) > 1 else rest[0]


def connected(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for undirected ``edges`` of columns ``u``, ``v``.

    Alternating large-star and small-star steps; every round is written to the shared folder, which cuts
    the lineage, and only a count and a sum of hashes reach the driver.
    """

    def star(e: DataFrame, both: bool) -> DataFrame:
        if both:
            e = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        met = e.join(low, "u")
        out = met.filter(F.col("v") > F.col("u")) if both else met
        out = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not both:
            out = out.unionByName(low.select("u", F.col("m").alias("v")))
        return out.filter("u != v").distinct()

    def state(e: DataFrame) -> tuple:
        mixed = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        return tuple(e.agg(F.count("*"), mixed).first())

    now = written(edges.select("u", "v").filter("u != v").distinct(), "edges")
    seen = state(now)
    while True:
        now = written(star(star(now, True), False), "edges")
        after = state(now)
        if after == seen:
            break
        seen = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
