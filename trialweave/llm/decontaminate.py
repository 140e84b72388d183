"""Benchmark decontamination as a prefix-filtered containment join, with DataFrame functions only.

An item is the set of its windows of ``size`` consecutive words; a document contains a window only if it
contains every ``shingle``-word shingle of it. The filter for full containment therefore needs one
shingle of each window, and takes the one that is rarest in the documents:

1. Documents are scanned once for shingles that any window has. What is found (document, position,
   shingle) is written; its counts over all documents order the shingles by rarity. A window with a
   shingle that no document has is gone.
2. The rarest shingle of each window is joined with the found positions. The position inside the window
   gives the only possible start; starts before the first word (positional bound) or too close to the
   end (length bound) are dropped.
3. The documents meet their remaining starts, and each start is verified word by word.

The join sides made from the benchmark are broadcast only after their rows have been counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import written

from .common import free_names, sized, words_of


def _shingles(words: Column, size: int) -> Column:
    """Hashes of ``size`` words from each position; verification follows, so a clash costs time only."""
    return F.transform(
        words, lambda word, i: F.xxhash64(F.lit(size), word, *(F.get(words, i + k) for k in range(1, size)))
    )


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """``window`` (its words joined by blanks), ``length`` and ``items`` (ids as sorted text, nulls left out)."""
    worded = items.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("w"))
    worded = worded.filter(F.size("w") > 0)
    cut = worded.select(
        "item", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))).alias("at")
    ).select("item", F.slice("w", F.col("at"), size).alias("w"))
    return cut.groupBy(F.array_join("w", " ").alias("window"), F.size("w").alias("length")).agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )


def contamination(
    docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3, hits: str = "_hits"
) -> DataFrame:
    """Every row and column of ``docs`` plus ``hits``: ``n_words``, ``n_hit``, ``items`` (sorted).

    Input: ``doc_id`` and ``text`` among the columns of ``docs``; ``item_id``, ``text`` of ``items``. Null and
    empty texts have no words; items without words have no windows; an item of fewer than ``size`` words
    is one window. Repeated rows and items change nothing but their own rows; items of null ``item_id``
    hit words but are not listed. Empty tables give no rows or no hits. Other columns of ``docs`` may have any
    name but that of ``hits``.
    """
    windows = written(item_windows(items, size), "windows")
    split = F.split("window", " ")
    placed = windows.select("window", "length", split.alias("w")).withColumn("size", F.least("length", F.lit(shingle)))
    sizes = [r[0] for r in placed.select("size").distinct().collect()]  # at most ``shingle`` values
    own = [
        placed.filter(F.col("size") == s).select(
            "window", "length", F.posexplode(_shingles(F.col("w"), s)).alias("offset", "gram")
        ).filter(F.col("offset") + s <= F.col("length")).drop("length")
        for s in sizes
    ]
    texts = docs.select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("w"))
    seen = [
        texts.select(
            "doc_id", "h", F.size("w").alias("n"),
            F.posexplode(_shingles(F.col("w"), s)).alias("pos", "gram"),
        )
        for s in sizes
    ]
    key = F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.xxhash64("text").alias("h"))
    doc_key, begins, w, n, met = free_names(docs, "_key", "_starts", "_w", "_n", "_met")
    out = docs.withColumn(doc_key, key)
    if sizes:
        grams = own[0]
        for more in own[1:]:
            grams = grams.unionByName(more)
        grams = written(grams, "window-shingles")
        wanted = sized(grams.select("gram").distinct())
        found = seen[0]
        for more in seen[1:]:
            found = found.unionByName(more)
        found = written(found.join(wanted, "gram", "left_semi"), "found-shingles")
        counts = found.groupBy("gram").agg(F.count("*").alias("n"))
        rarest = grams.join(counts, "gram", "left").groupBy("window").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "offset")).alias("p")
        ).filter("p.n > 0")
        prefix = written(
            rarest.join(windows, "window").select(F.col("p.gram").alias("gram"), F.col("p.offset").alias("offset"), "window", "length", "items"),
            "window-prefixes",
        )
        starts = found.join(sized(prefix), "gram").withColumn("start", F.col("pos") - F.col("offset"))
        starts = starts.filter("start >= 0 and start + length <= n")
        per_doc = written(
            starts.groupBy(F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), "h").alias(doc_key))
            .agg(F.collect_set(F.struct("start", "length", "window", "items")).alias(begins)),
            "window-starts",
        )
        out = out.join(sized(per_doc), doc_key, "left")
    else:
        out = out.withColumn(begins, F.lit(None).cast("array<struct<start:int,length:int,window:string,items:array<string>>>"))
    out = out.withColumn(w, words_of(F.col("text")))
    same = F.filter(
        F.coalesce(begins, F.array()),
        lambda c: F.array_join(F.slice(F.col(w), c["start"] + 1, c["length"]), " ") == c["window"],
    )
    out = out.withColumn(n, F.size(w)).withColumn(met, same)
    spans = F.flatten(F.transform(met, lambda c: F.sequence(c["start"], c["start"] + c["length"] - 1)))
    return out.select(
        *docs.columns,
        F.struct(
            F.col(n).cast("long").alias("n_words"),
            F.size(F.array_distinct(spans)).cast("long").alias("n_hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform(met, lambda c: c["items"])))).alias("items"),
        ).alias(hits),
    )


def contamination_report(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated`` for each document row."""
    hits = contamination(docs.select("doc_id", "text"), items, **options)
    return hits.select(
        "doc_id", "_hits.n_words", "_hits.n_hit",
        F.size("_hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_hits.items", ","), 256).alias("items_sha256"),
        (F.col("_hits.n_hit") > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents (all columns) in which no window of an item occurs."""
    (hits,) = free_names(docs, "_hits")
    return contamination(docs, items, hits=hits, **options).filter(F.col(hits)["n_hit"] == 0).select(docs.columns)
