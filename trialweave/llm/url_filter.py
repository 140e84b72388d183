"""URL rules by a cascade of Bloom filters: exact membership without a join.

A rule names a host and the start of a path and fits that host and its subdomains. A url can only meet the
rules whose key (host, path) is one of its own keys: the last ``n`` labels of its host with the first ``m``
characters of its path, for the shapes (n, m) that rules have. The keys of all urls are the complete universe
in which membership must be exact.

The first level of the cascade is a Bloom filter of the listed keys. Keys of the universe that pass it though
they are not listed go into the second level, listed keys that pass the second go into the third, and so on
until nobody passes wrongly. A key is then decided by the first level that does not hold it. The first level is
sized for the universe (about one false positive for each listed key), the others let one key in two pass, so
all levels together take some 1.44 log2(universe / listed) + 5 bits for each listed key, whatever the corpus.

Only these bits reach the driver; ``max_bits`` bounds them, checked before a level is built, and a longer list is
refused: cut it and judge with each part. They go into the plan as literals, so judging is one narrow pass.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialweave.session import written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``probes`` bits of ``words`` 64-bit words for each key; ``bits`` is a JSON list."""

    probes: int
    words: int
    bits: str


@dataclass(frozen=True)
class Cascade:
    """Levels that alternately hold listed and not listed keys of one universe."""

    levels: tuple[Level, ...]

    def lists(self, host: Column, path: Column) -> Column:
        """Whether the key is listed: exact for every key of the universe it was built on."""
        if not self.levels:
            return F.lit(False)
        verdict = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            verdict = F.when(_holds(self.levels[i], i, host, path), verdict).otherwise(F.lit(i % 2 == 1))
        return verdict


def _place(level: int, words: int, host: Column, path: Column, probe: Column) -> Column:
    return F.pmod(F.xxhash64(host, path, F.lit(level), probe), F.lit(words * 64))


def _word(place: Column) -> Column:
    return F.shiftright(place, 6).cast("int")


def _holds(level: Level, at: int, host: Column, path: Column) -> Column:
    bits = F.from_json(F.lit(level.bits), "array<bigint>")  # folded into one literal

    def found(probe: Column) -> Column:
        place = _place(at, level.words, host, path, probe)
        return F.getbit(F.get(bits, _word(place)), F.pmod(place, F.lit(64)).cast("int")) == 1

    return F.forall(F.sequence(F.lit(1), F.lit(level.probes)), found)


def _build_level(keys: DataFrame, n: int, at: int, share: float, max_bits: int) -> Level:
    """A filter of ``n`` distinct keys that other keys pass with chance ``share``."""
    probes = max(1, math.ceil(math.log2(1 / share)))
    words = max(1, math.ceil(n * probes / math.log(2) / 64))
    if words * 64 > max_bits:
        raise ValueError(f"level {at} needs {words * 64} bits, max_bits is {max_bits}: cut the list of rules")
    spark = keys.sparkSession
    probe = F.explode(F.sequence(F.lit(1), F.lit(probes)))
    placed = keys.withColumn("probe", probe).select(_place(at, words, F.col("host"), F.col("path"), F.col("probe")).alias("place"))
    set_bits = placed.select(
        _word(F.col("place")).alias("word"), F.expr("shiftleft(1L, CAST(pmod(place, 64) AS INT))").alias("bits")
    )
    empty = spark.range(words).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    each = set_bits.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = each.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda x: x.bits)))
    return Level(probes, words, row.first()[0])


def build_cascade(
    listed: DataFrame, universe: Callable[[], DataFrame], universe_size: int, max_bits: int = 1 << 27
) -> Cascade:
    """The cascade of ``listed`` keys (``host``, ``path``) within the keys that ``universe`` yields.

    The universe may repeat keys and may or may not contain the listed ones. It is read once, to find the
    first level's false positives; every later level works on what passed the one before.
    """
    inside = written(listed.select("host", "path").distinct(), "listed")
    n = inside.count()
    share = min(0.5, max(n, 1) / (math.sqrt(2) * max(universe_size, 1)))
    levels: list[Level] = []
    ours, theirs = inside, None
    while n:
        at = len(levels)
        levels.append(_build_level(ours, n, at, share if at == 0 else 0.5, max_bits))
        passes = _holds(levels[-1], at, F.col("host"), F.col("path"))
        if theirs is None:
            met = universe().select("host", "path").filter(passes).distinct().join(inside, ["host", "path"], "left_anti")
        else:
            met = theirs.filter(passes)
        ours, theirs = written(met, "passed"), ours
        n = ours.count()
    return Cascade(tuple(levels))


def _keys(shapes: list[tuple[int, int]], host: Column, path: Column) -> Column:
    """The url's keys of the given shapes (labels of the host, characters of the path)."""
    made = F.from_json(F.lit(json.dumps([{"n": n, "m": m} for n, m in shapes])), "array<struct<n: int, m: int>>")
    labels = F.size(F.split(host, r"\."))
    fits = F.filter(made, lambda s: (s.n <= labels) & (s.m <= F.length(path)))

    def key(s: Column) -> Column:
        tail = F.concat_ws(".", F.slice(F.split(host, r"\."), -s.n, s.n))
        head = F.substring(path, 1, s.m)
        return F.struct(
            (F.length(tail) + F.length(head)).alias("size"), F.length(tail).alias("host_size"),
            tail.alias("host"), head.alias("path"),
        )

    return F.transform(fits, key)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bits: int = 1 << 27) -> DataFrame:
    """The verdict on every url by its longest fitting rule.

    ``pages``: ``page_id``, ``url``; ``rules``: ``verdict`` (allow or block), ``host``, ``path``; further columns
    are ignored. Result, one row for each row of ``pages`` (repeated rows stay): ``page_id``, ``host``, ``path``,
    ``rule`` (the fitting rule's host and path in one string; null if no rule fits) and ``verdict``. A url whose
    keys are not listed gets ``default``. A null url, or one without ``://``, has an empty host and path.

    A rule fits if the url's host is the rule's or ends with a dot and it, and the url's path starts with the
    rule's. The longest rule (host and path together, then host) wins; of two verdicts on one key, block.
    Rules with a null or empty host, or another verdict, fit nothing; a null path is empty.
    """
    spark = pages.sparkSession
    rules = written(
        rules.select(
            "verdict", F.translate("host", _UPPER, _UPPER.lower()).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
        ).filter("host <> '' AND verdict IN ('allow', 'block')"),
        "rules",
    )
    shapes = [
        (r.n, r.m)
        for r in rules.select(F.size(F.split("host", r"\.")).alias("n"), F.length("path").alias("m")).distinct().sort("n", "m").collect()
    ]
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = split.withColumn("keys", _keys(shapes, F.col("host"), F.col("path")))

    def universe() -> DataFrame:
        return keyed.select(F.explode("keys").alias("k")).select("k.host", "k.path")

    seen = universe().agg(F.approx_count_distinct(F.struct("host", "path"))).first()[0]  # only sizes the first level
    listed = build_cascade(rules, universe, seen, max_bits)
    blocked = rules.filter("verdict = 'block'")
    barred = build_cascade(blocked, lambda: rules, rules.count(), max_bits)
    best = F.array_max(F.filter("keys", lambda k: listed.lists(k.host, k.path)))
    judged = keyed.withColumn("best", best)
    verdict = F.when(F.col("best").isNull(), F.lit(default)).when(barred.lists(F.col("best.host"), F.col("best.path")), "block")
    return judged.select(
        "page_id", "host", "path", F.concat("best.host", "best.path").alias("rule"), verdict.otherwise("allow").alias("verdict")
    )
