"""Jaccard self-join on word n-grams with Bayesian pruning of candidates.

1. Every distinct text gets 128 MinHash values of its word five-grams. Texts that agree on the four
   values of any of 32 bands are candidates (a pair at 0.8 has no common band with probability 5e-8).
2. A bucket is cut into blocks of ``block_rows`` rows; a task meets two blocks at a time, so a bucket with
   a third of all rows is many tasks. A pair belongs to its first common band only. Its MinHash values
   are compared 16 at a time; under a uniform prior the similarity's posterior after m of n matches is
   Beta(m+1, n-m+1), and the pair is dropped once the chance of reaching the threshold is below
   ``tolerance``. The rest is kept as positions inside the block pair, never as one row for each pair.
3. Only texts with a remaining candidate get their exact n-gram sets, which verify the candidates block
   by block. Each text adds up its links; a block pair gives one edge for each linked text, and the
   edges give the groups.

Exact copies are one text with a count, so they are never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import shuffle_width, written

from .common import WordHashes, connected, free_names, mix64, shingle_hashes, sized, split_words, whole_groups

BANDS, ROWS, STEP = 32, 4, 16
HASHES = BANDS * ROWS


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash values (32 bits each) of non-empty sets of 64-bit hashes."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k, (a, b) in enumerate(zip(*_multipliers(), strict=True)):
        out[:, k] = np.minimum.reduceat(flat * a + b, starts) >> np.uint64(32)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    parts = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(ROWS):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, i])
    return keys


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """The least matches after 16, 32, ... values at which the posterior still reaches the threshold."""

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, j) * threshold**j * (1 - threshold) ** (n + 1 - j) for j in range(m + 1))

    return [next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in range(STEP, HASHES + 1, STEP)]


def _signed(texts: DataFrame, size: int) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                sets = [shingle_hashes(hashes.of(split_words(t)), size) for t in part.text]
                full = [i for i, s in enumerate(sets) if len(s)]
                signatures: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if full:
                    found = minhash([sets[i] for i in full])
                    keys = band_keys(found).view(np.int64)
                    for k, i in enumerate(full):
                        signatures[i], bands[i] = found[k].tobytes(), keys[k]
                yield pd.DataFrame({"doc_id": part.doc_id, "cls": part.cls, "signature": signatures, "bands": bands})

    return texts.mapInPandas(sign, "doc_id long, cls string, signature binary, bands array<long>")


def _pairs(left: np.ndarray, right: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs between two blocks (or within one), in portions."""
    for at in range(0, len(left), 128):
        a, b = np.meshgrid(left[at : at + 128], right, indexing="ij")
        a, b = a.ravel(), b.ravel()
        keep = a < b if same else slice(None)
        yield a[keep], b[keep]


def _prune(least: list[int]):
    def prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for group in whole_groups(batches, ["band", "i", "j"]):
            if len(group) < 2:
                continue
            group = group.sort_values("cls", ignore_index=True)
            sig = np.stack([np.frombuffer(s, np.uint32) for s in group.signature])
            keys = band_keys(sig)
            band, i, j = group.band[0], int(group.i[0]), int(group.j[0])
            place = int(np.flatnonzero((keys.view(np.int64) == band).all(axis=0))[0])
            block = group.block.to_numpy()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            kept_a, kept_b = [], []
            for a, b in _pairs(left, right, i == j):
                own = ~(keys[a, :place] == keys[b, :place]).any(axis=1)
                a, b = a[own], b[own]
                same = np.zeros(len(a), np.int32)
                for k, need in enumerate(least):
                    cut = slice(k * STEP, (k + 1) * STEP)
                    same = same + (sig[a, cut] == sig[b, cut]).sum(axis=1)
                    ok = same >= need
                    a, b, same = a[ok], b[ok], same[ok]
                kept_a.append(a)
                kept_b.append(b)
            if not kept_a:
                continue
            a, b = np.concatenate(kept_a), np.concatenate(kept_b)
            if not len(a):
                continue
            used = np.unique(np.concatenate([a, b]))
            spot = np.searchsorted(used, np.arange(len(group)))
            order = np.argsort(a, kind="stable")
            a, b = spot[a[order]], spot[b[order]].astype(np.int32)
            edges = np.searchsorted(a, np.arange(len(used) + 1))
            out.append(pd.DataFrame({
                "band": band, "i": i, "j": j, "spot": np.arange(len(used), dtype=np.int32),
                "cls": group.cls.to_numpy()[used], "partners": [b[x:y] for x, y in zip(edges[:-1], edges[1:], strict=True)],
            }))
            held += len(used) + len(b) // 64
            if held > 4096:
                yield pd.concat(out)
                out, held = [], 0
        if out:
            yield pd.concat(out)

    return prune


def _sets(texts: DataFrame, size: int) -> DataFrame:
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_hashes(hashes.of(split_words(t)), size).tobytes() for t in batch.text]
            yield pd.DataFrame({"cls": batch.cls, "grams": sets})

    return texts.mapInPandas(gather, "cls string, grams binary")


def _verify(threshold: float):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for group in whole_groups(batches, ["band", "i", "j"]):
            group = group.sort_values("spot", ignore_index=True)
            grams = [np.frombuffer(g, np.uint64) for g in group.grams]
            sizes, copies = np.array([len(g) for g in grams]), group.copies.to_numpy()
            links, root = np.zeros(len(group), np.int64), np.arange(len(group))

            def top(x: int, root=root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, partners in enumerate(group.partners):
                own = grams[a]
                for at in range(0, len(partners), 64):
                    mates = partners[at : at + 64]
                    flat = np.concatenate([grams[b] for b in mates])
                    near = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    starts = np.concatenate([[0], np.cumsum(sizes[mates])[:-1]])
                    common = np.add.reduceat((own[near] == flat).astype(np.int64), starts)
                    ok = mates[common >= threshold * (sizes[a] + sizes[mates] - common) - 1e-9]
                    links[a] += copies[ok].sum()
                    links[ok] += copies[a]
                    for b in ok:
                        x, y = top(a), top(b)
                        root[max(x, y)] = min(x, y)
            linked = np.flatnonzero(links)
            if len(linked):
                names = group.cls.to_numpy()
                out.append(pd.DataFrame({"cls": names[linked], "links": links[linked], "root": names[[top(x) for x in linked]]}))
                held += len(linked)
            if held > 4096:
                yield pd.concat(out)
                out, held = [], 0
        if out:
            yield pd.concat(out)

    return verify


def ngram_links(
    docs: DataFrame, size: int = 5, threshold: float = 0.8, tolerance: float = 1e-7, block_rows: int = 512
) -> DataFrame:
    """Links and groups of documents whose word ``size``-grams have a Jaccard similarity of ``threshold``.

    Input: ``doc_id``, ``text``. Result: one row for each distinct text: ``cls`` (md5 of the text, null as
    empty), ``class_id`` (smallest doc_id of all documents in its connected group), ``n_links`` (documents,
    this one not counted, within the threshold; every copy counts), ``n_grams_known`` (false where a text
    has no word: such documents are in no group, ``class_id`` is null and ``n_links`` 0).

    Texts of fewer words than ``size`` are one gram of all their words. Repeated rows count as copies.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumn("cls", F.md5("text"))
    reps = written(
        _signed(texts, size).groupBy("cls").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"),
            F.first("signature").alias("signature"), F.first("bands").alias("bands"),
        ),
        "signatures",
    )
    bands = reps.select("cls", F.explode("bands").alias("band"))
    shared = bands.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1")
    members = bands.join(shared, "band").select(
        "band", "cls", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"),
    ).withColumn("block", F.pmod(F.xxhash64("cls", "band"), F.col("blocks")).cast("int"))
    met = members.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls"
    )
    width = shuffle_width(spark)
    keys = ["band", "i", "j"]
    candidates = written(
        met.join(reps.select("cls", "signature"), "cls").repartition(width, *keys).sortWithinPartitions(*keys)
        .mapInPandas(_prune(least_matches(threshold, tolerance)), "band long, i int, j int, spot int, cls string, partners array<int>"),
        "candidates",
    )
    needed = candidates.select("cls").distinct()
    grams = _sets(texts.join(sized(needed), "cls", "left_semi").dropDuplicates(["cls"]).select("cls", "text"), size)
    known = grams.join(reps.select("cls", "copies"), "cls")
    found = written(
        candidates.join(known, "cls").repartition(width, *keys).sortWithinPartitions(*keys)
        .mapInPandas(_verify(threshold), "cls string, links long, root string"),
        "links",
    )
    groups = connected(found.select(F.col("cls").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("cls").agg(F.sum("links").alias("links"))
    rows = (
        reps.select("cls", "first_id", "copies", F.col("bands").isNotNull().alias("n_grams_known"))
        .join(links, "cls", "left")
        .join(groups.withColumnRenamed("node", "cls"), "cls", "left")
        .withColumn("root", F.coalesce("root", "cls"))
    )
    ids = rows.filter("n_grams_known").groupBy("root").agg(F.min("first_id").alias("class_id"))
    return rows.join(ids, "root", "left").select(
        "cls",
        F.when(F.col("n_grams_known"), F.col("class_id")).alias("class_id"),
        F.when(F.col("n_grams_known"), F.col("copies") - 1 + F.coalesce("links", F.lit(0))).otherwise(0).alias("n_links"),
        "n_grams_known",
    )


def ngram_jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: ``doc_id``, ``class_id``, ``n_links`` (see ``ngram_links``).

    A document without words has its own ``doc_id`` as ``class_id``. Rows of null ``doc_id`` are matched
    like others; a group of only such rows has a null ``class_id``.
    """
    found = ngram_links(docs, **options)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("cls"))
    return rows.join(found, "cls").select(
        "doc_id", F.when(F.col("n_grams_known"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_links"
    )


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents (all columns) with the smallest ``doc_id`` of each group; of repeated rows one stays.

    Of different texts of a group under that ``doc_id`` the one with the smallest md5 stays. Equal non-empty texts
    without a word are a group of their own; empty and null texts all stay, each ``doc_id`` once.
    """
    cls, first, every, n, id_, key_ = free_names(docs, "_cls", "_first", "_all", "_n", "_id", "_key")
    key = F.md5(F.coalesce("text", F.lit("")))
    found = ngram_links(docs, **options).select(
        F.col("cls").alias(cls), F.col("class_id").alias("class"), F.col("n_grams_known").alias("known")
    )
    ids = docs.select(F.col("doc_id").alias(id_), key.alias(key_))
    repeated = ids.groupBy(id_, key_).agg(F.count("*").alias(n)).filter(F.col(n) > 1)
    firsts = ids.groupBy(key_).agg(F.min(id_).alias(first))
    one = found.join(firsts, found[cls] == firsts[key_]).drop(key_)
    empty = F.col(cls) == F.md5(F.lit(""))
    worded = one.filter(F.col("known") & F.col(first).eqNullSafe(F.col("class")))
    worded = worded.groupBy("class").agg(F.min(cls).alias(cls)).select(cls, F.col("class").alias(first), F.lit(False).alias(every))
    others = one.filter(~F.col("known")).select(cls, first, empty.alias(every))
    kept = docs.withColumn(cls, key).join(worded.unionByName(others), cls).filter(F.col(every) | F.col("doc_id").eqNullSafe(F.col(first)))
    kept = kept.join(repeated, kept["doc_id"].eqNullSafe(repeated[id_]) & (kept[cls] == repeated[key_]), "left")
    once = kept.filter(F.col(n).isNull()).select(docs.columns)
    return once.unionByName(kept.filter(F.col(n) > 1).dropDuplicates(["doc_id", cls]).select(docs.columns))
