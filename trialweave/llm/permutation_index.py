"""Nearest neighbours by a permutation index.

A vector is represented by the order in which it sees its nearest pivots. The order is kept as weights
(``depth`` for the nearest pivot, then one less for each further one); the footrule distance of two
truncated orders is ``depth (depth + 1) - 2 * sum of min(weights)``, so it can be summed over the pivot
inverted files of the pivots a query has. Distinct rows are cut into blocks by a hash of id and vector; each
block holds the inverted files of its own vectors and meets the queries in blocks. Candidates within the
footrule limit, and the best ``k`` ids of each block whatever their distance, are scored exactly.

Inner products of vectors of different length are turned into angles by one more coordinate
(``sqrt(longest^2 - length^2)`` for indexed vectors, 0 for queries). Pivots are a sample of ``pivots``
vectors; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import shuffle_width, written


def usable_vectors(vectors: DataFrame, key: str = "vec_id", value: str = "embedding") -> DataFrame:
    """``id``, ``v`` (doubles) and ``length`` of vectors that are not null or zero, hold only finite numbers,
    have an id, and have the most common number of components (of equally common ones the larger)."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(value).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull()).filter(finite)
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).filter("length > 0")
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("v") == (common[0] if common else 0))


def _per_id(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The largest value of each id; ``ids`` are sorted."""
    if not len(ids):
        return values
    return np.maximum.reduceat(values, np.flatnonzero(np.append(True, ids[1:] != ids[:-1])))


def _best(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, query: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` best ids of ``rows`` by the exact score of their best row (summed component by component), then smaller id."""
    tops = _per_id(scores, ids[rows])
    if len(tops) > k:
        edge = np.partition(tops, len(tops) - k)[len(tops) - k]
        rows = rows[scores >= edge - 1e-9 * max(1.0, abs(edge))]
    exact = np.zeros(len(rows))
    for d in range(len(query)):
        exact += query[d] * vectors[rows, d]
    order = np.lexsort((ids[rows], -exact))
    rows, exact = rows[order], exact[order]
    _, first = np.unique(ids[rows], return_index=True)
    first = np.sort(first)[:k]
    return ids[rows[first]], exact[first]


def permutation_search(
    vectors: DataFrame, is_query: Column, k: int = 20, pivots: int = 128, depth: int = 32, limit: float = 0.84,
    block_rows: int = 4096, query_rows: int = 8192,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the ``k`` nearest found by inner product.

    ``is_query`` is a condition on ``vec_id``; every other row is a candidate, never the query itself. Ties go
    to the smaller id. ``limit`` is the footrule limit as a share of the largest distance. Repeated rows of an
    id are one query (where its vectors differ, the smallest of them asks) and one candidate (the better one).
    Fewer than ``k`` candidates are all returned; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "query_id long, vec_id long, score double"
    rows = usable_vectors(vectors).select("id", "v", "length").distinct()
    rows = written(rows.withColumn("vec_id", F.col("id")).withColumn("asks", is_query).drop("vec_id"), "vectors")
    queries = rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    n, longest = rows.agg(F.count("*"), F.max("length")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = rows.orderBy(F.xxhash64("id", "v", F.lit(11)), "id", "v").limit(4 * pivots).select("v", "length").toPandas()
    points = np.unique(_raised(np.stack(sample.v), longest), axis=0)
    points = points[np.random.default_rng(2).permutation(len(points))[:pivots]]
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    depth = min(depth, len(points))

    def order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            x = _raised(np.stack(batch.v), longest)
            x[batch.asks.to_numpy(bool), -1] = 0
            seen = np.argsort(-(x @ points.T), axis=1, kind="stable")[:, :depth].astype(np.uint16)
            yield batch.assign(seen=[s.tobytes() for s in seen])

    blocks, query_blocks = -(-n // block_rows), max(1, -(-queries.count() // query_rows))
    own = lambda many, *key: F.pmod(F.xxhash64(*key), F.lit(many)).cast("int")
    every = lambda many: F.sequence(F.lit(0), F.lit(many - 1))
    both = rows.select("id", "v", F.lit(False).alias("asks")).unionByName(queries.withColumn("asks", F.lit(True)))
    ordered = both.mapInPandas(order, "id long, v array<double>, asks boolean, seen binary")
    placed = ordered.withColumn("block", F.explode(F.when(F.col("asks"), every(blocks)).otherwise(F.array(own(blocks, "id", "v")))))
    placed = placed.withColumn("part", F.explode(F.when(F.col("asks"), F.array(own(query_blocks, "id"))).otherwise(every(query_blocks))))
    least = (1 - limit) * depth * (depth + 1) / 2

    def search(group: pd.DataFrame) -> pd.DataFrame:
        asking = group[group.asks].sort_values("id")
        held = group[~group.asks].sort_values("id", ignore_index=True)
        out: list[tuple] = []
        if len(asking) and len(held):
            ids, space = held.id.to_numpy(), np.stack(held.v)
            seen = np.stack([np.frombuffer(s, np.uint16) for s in held.seen])
            files = np.argsort(seen.ravel(), kind="stable")
            edges = np.searchsorted(seen.ravel()[files], np.arange(len(points) + 1))
            where, weight = files // depth, (depth - files % depth).astype(np.int16)
            for query, v, near in zip(asking.id, asking.v, asking.seen, strict=True):
                close = np.zeros(len(ids), np.int16)
                for place, pivot in enumerate(np.frombuffer(near, np.uint16)):
                    a, b = edges[pivot], edges[pivot + 1]
                    close[where[a:b]] += np.minimum(weight[a:b], depth - place)
                close[ids == query] = -1
                found = np.flatnonzero(close >= least)
                if len(np.unique(ids[found])) < k:
                    ranked = np.sort(_per_id(close, ids))[::-1]
                    found = np.flatnonzero((close >= ranked[min(k, len(ranked)) - 1]) & (close >= 0))
                names, scores = _best(space[found] @ v, ids, found, np.asarray(v), space, k)
                out.append((np.full(len(names), query), names, scores))
        joined = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), joined, strict=True)))

    width = max(shuffle_width(spark), min(blocks * query_blocks, 10_000))
    found = placed.repartition(width, "block", "part").groupBy("block", "part").applyInPandas(search, schema)
    found = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _raised(x: np.ndarray, longest: float) -> np.ndarray:
    rest = np.maximum(longest**2 - (x**2).sum(axis=1, keepdims=True), 0)
    return np.hstack([x, np.sqrt(np.where(rest < 1e-6 * longest**2, 0, rest))])
