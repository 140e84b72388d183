"""How the sources of a language differ in their words, on run-length encoded count columns.

The kept terms of a language are put in an order in which equal counts lie together: by the terms' counts in
all sources, taken as one row of numbers. Cut into blocks of ``BLOCK`` terms, the counts of a source are a column
of a block, stored as runs of equal counts; most columns of small sources are one run of zeros. The divergence of
two sources is summed over the stretches on which both counts stay the same, that is over the intersection of
their run boundaries: one value of ``f`` times the length of the stretch.

With p and q the integer shares (in 10^-9) of a term in two groups, f = floor((p-q)^2 / (p+q)). All numbers are
integers; a count times 10^9 can exceed 2^63, so shares are made in decimals or Python's integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialweave.session import written

from .common import sized

BLOCK = 4096
SCALE = 1_000_000_000
#: Bytes of UTF-8: A-Z become a-z, every other ASCII byte a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def document_terms(text: str) -> list[str]:
    """Runs of ASCII letters and non-ASCII characters, A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).decode().split(" ")


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences), ``docs`` (documents that hold it), summed by task before the shuffle.

    The empty term stands for the group itself, so that groups without a term are seen.
    """

    def count(batches: Iterator[pd.DataFrame], limit: int = 300_000) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str], list[Counter]] = defaultdict(lambda: [Counter(), Counter()])
        held = 0

        def tables() -> Iterator[pd.DataFrame]:
            for (lang, source), (n, docs) in seen.items():
                out = pd.DataFrame({"term": list(n), "n": list(n.values()), "docs": [docs[t] for t in n]})
                out["lang"], out["source"] = lang, source
                yield out[["lang", "source", "term", "n", "docs"]]

        for batch in batches:
            for lang, source, text in zip(batch.lang, batch.source, batch.text, strict=True):
                n, docs = seen[lang, source]
                held -= len(n)
                terms = [*document_terms(text), ""]
                n.update(terms)
                docs.update(set(terms))
                held += len(n)
                if held > limit:
                    yield from tables()
                    seen.clear()
                    held = 0
        yield from tables()

    full = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    parts = full.mapInPandas(count, "lang string, source string, term string, n long, docs long")
    dealt = parts.repartition("lang", "term")  # the sums by term then need no other shuffle
    return dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 kept)) of three columns, exact."""
    return F.expr(
        f"1 + (CAST({n} + 2 AS DECIMAL(20,0)) * {SCALE}) div (CAST({total} AS DECIMAL(20,0)) + 2 * CAST({kept} AS DECIMAL(18,0)))"
    )


def block_columns(kept: DataFrame, block: int = BLOCK) -> DataFrame:
    """Run-length columns of ``kept`` (``lang``, ``term``, ``cells``: an array of ``source`` and ``n``).

    The terms are range-sorted by their counts and cut into blocks of one language. Result: ``lang``, ``block``,
    ``terms`` (in the block), ``source``, ``starts`` and ``counts`` of its runs; for each block also one row with
    ``source`` null and no run, so that sources without any count there are known to be missing.
    """
    cells = F.array_sort("cells")
    order = ["lang", "cells", "term"]
    ranged = kept.select("lang", cells.alias("cells"), "term").repartitionByRange(*order).sortWithinPartitions(*order)
    flat = ranged.select("lang", F.col("cells.source").alias("sources"), F.col("cells.n").alias("ns"), F.spark_partition_id().alias("part"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        serial, lang, part, held = 0, None, 0, []

        def table() -> pd.DataFrame:
            columns: dict[str, tuple[list[int], list[int]]] = defaultdict(lambda: ([], []))
            for at, (sources, ns) in enumerate(held):
                for source, n in zip(sources, ns, strict=True):
                    columns[source][0].append(at)
                    columns[source][1].append(n)
            rows = [(lang, part << 32 | serial, len(held), None, [], [])]
            for source, (at, ns) in columns.items():
                full = np.zeros(len(held), np.int64)
                full[at] = ns
                starts = np.concatenate([[0], np.flatnonzero(np.diff(full)) + 1])
                rows.append((lang, part << 32 | serial, len(held), source, starts, full[starts]))
            return pd.DataFrame(rows, columns=["lang", "block", "terms", "source", "starts", "counts"])

        for batch in batches:
            for now, sources, ns, part in zip(batch.lang, batch.sources, batch.ns, batch.part, strict=True):
                if held and (now != lang or len(held) == block):
                    yield table()
                    serial, held = serial + 1, []
                lang = now
                held.append((sources, ns))
        if held:
            yield table()

    return flat.mapInPandas(cut, "lang string, block long, terms int, source string, starts array<int>, counts array<long>")


def _pair_sums(columns: pd.DataFrame) -> pd.DataFrame:
    """``f`` summed over one block for each two sources of its language, stretch by stretch."""
    head = columns[columns.source.isna()].iloc[0]
    terms, kept = int(head.terms), int(head.kept)
    runs = {r.source: (r.starts, r.counts) for r in columns[columns.source.notna()].itertuples()}
    shared = []
    for source, total in zip(head.sources, head.totals, strict=True):
        starts, counts = runs.get(source, (np.zeros(1, np.int64), np.zeros(1, np.int64)))
        values, at = np.unique(counts, return_inverse=True)
        below = int(total) + 2 * kept
        shared.append((np.asarray(starts), np.array([1 + SCALE * (int(n) + 2) // below for n in values], np.int64)[at]))
    rows = []
    for i, (starts_a, p_a) in enumerate(shared):
        for j in range(i):
            starts_b, p_b = shared[j]
            starts = np.union1d(starts_a, starts_b)
            p = p_a[np.searchsorted(starts_a, starts, "right") - 1]
            q = p_b[np.searchsorted(starts_b, starts, "right") - 1]
            length = np.diff(starts, append=terms)
            rows.append((head.lang, head.sources[i], head.sources[j], int(((p - q) ** 2 // (p + q) * length).sum())))
    return pd.DataFrame(rows, columns=["lang", "source", "item", "value"])


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, block: int = BLOCK) -> DataFrame:
    """Divergence of each source from the others of its language, and the terms that set it apart.

    ``docs``: ``text``, ``lang``, ``source`` (nulls as empty texts; other columns are ignored, repeated rows count as
    often as they occur, an empty table gives no row). The terms of a language are those that at least
    ``least_docs`` of its documents hold. Result: ``lang``, ``source``, ``part``, ``item``, ``value``, ``rank`` (by value,
    ties by item). Part ``pair``: each other source and the sum of f over all terms, 0 where there is none. Part
    ``term``: the ``top`` terms that occur in the source and have a larger share there than in the language.
    """
    # the empty term is kept in any case, as its cells are the groups
    known = written(
        count_terms(docs).groupBy("lang", "term").agg(
            F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("cells")
        ).filter((F.col("docs") >= least_docs) | (F.col("term") == "")).select("lang", "term", "total", "cells"),
        "kept-terms",
    )
    groups = written(known.filter("term = ''").select("lang", F.explode("cells.source").alias("source")), "groups")
    kept = known.filter("term <> ''")
    cells = kept.select("lang", "term", "total", F.explode("cells").alias("c")).select("lang", "term", "total", "c.source", "c.n")
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("lang_total"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("source_total"))
    totals = written(
        groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").select(
            "lang", "source", F.coalesce("source_total", F.lit(0)).alias("source_total"),
            F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("lang_total", F.lit(0)).alias("lang_total"),
        ),
        "group-totals",
    )
    by_lang = totals.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("source", "source_total"))).alias("all"), F.first("kept").alias("kept")
    ).select("lang", "kept", F.col("all.source").alias("sources"), F.col("all.source_total").alias("totals"))
    columns = block_columns(kept, block)
    heads = F.col("source").isNull()
    blank = F.lit(None)
    headed = columns.filter(heads).join(sized(by_lang), "lang").select(*columns.columns, "kept", "sources", "totals")
    plain = columns.filter(~heads).select(
        "*", blank.cast("long").alias("kept"), blank.cast("array<string>").alias("sources"), blank.cast("array<long>").alias("totals")
    )
    part_sums = headed.unionByName(plain).groupBy("lang", "block").applyInPandas(
        _pair_sums, "lang string, source string, item string, value long"
    )
    half = written(part_sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "pair-sums")
    both = half.unionByName(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    other = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.join(other, "lang").filter("source <> item").join(both, ["lang", "source", "item"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")
    )
    shares = cells.join(sized(totals), ["lang", "source"]).select(
        "lang", "source", "term", share("n", "source_total", "kept").alias("p"), share("total", "lang_total", "kept").alias("q")
    )
    terms = shares.filter("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value")
    )
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda df: df.withColumn("rank", place)
    return ranked(pairs).unionByName(ranked(terms).filter(F.col("rank") <= top))
