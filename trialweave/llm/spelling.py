"""Spelling variants: words one letter apart, found by exact PartEnum signatures.

The letters of a word are a multiset, that is a binary vector over (letter, how many-th time). One inserted,
deleted or replaced letter changes one or two of its places, so words that are near have vectors at a Hamming
distance of one or two. The places are dealt to ``PARTS`` parts, evenly by how often a letter occurs. Two vectors
at a distance of at most two differ in at most two parts, so they agree on all others: a word's signatures
are, for each choice of two parts, the remaining ones. One edit also leaves the first or the last half of the
letters that the shortest words have, so each signature is posted with either, which thins out words of the
same letters in another order. Words are equi-joined on the signatures, a pair is kept only under the first
one that it must share, and is then verified by the edit distance itself. No pair is missed, none is met twice.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialweave.session import written

from .common import sized

#: Fixed value: a run of letters.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
PARTS, BITS = 5, 12
PART = (1 << BITS) - 1
LEFT_OUT = list(combinations(range(PARTS), 2))
#: Rows of one key that meet in one task before they are salted.
HOT = 2048
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def document_runs(doc_id: str | None, text: str | None, every: int = 199) -> Counter:
    """Counts of a text's runs, A-Z lower-cased, with a letter left out of those that the crc names."""
    if not text:
        return Counter()
    found = Counter(RUN.findall(text.translate(_LOWER)))
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    out: Counter = Counter()
    for run, n in found.items():
        h = zlib.crc32(run.encode(), start)
        if h % every == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] += n
    return out


def count_words(docs: DataFrame, least_letters: int = 6, least_n: int = 5) -> DataFrame:
    """``word``, ``n``: the words of at least ``least_letters`` code points that occur ``least_n`` times.

    A task sums up the documents it reads, at most ``limit`` words at a time, before the shuffle.
    """

    def count(batches: Iterator[pd.DataFrame], limit: int = 200_000) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()

        def table() -> pd.DataFrame:
            return pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"word": object, "n": "int64"})

        for batch in batches:
            for doc, text in zip(batch.doc_id, batch.text, strict=True):
                for word, n in document_runs(doc, text).items():
                    if len(word) >= least_letters:
                        seen[word] += n
                if len(seen) > limit:
                    yield table()
                    seen = Counter()
        yield table()

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n)


def _letter_ranks(words: DataFrame) -> dict[str, int]:
    """Place of each letter by how many words hold it: at most as many rows as the alphabet reach the driver."""
    held = words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("letter")).filter("letter <> ''")
    rows = held.groupBy("letter").count().collect()
    return {r.letter: i for i, r in enumerate(sorted(rows, key=lambda r: (-r["count"], r.letter)))}


def letter_vector(word: str, ranks: dict[str, int]) -> int:
    """The word's vector in short: ``BITS`` bits of hash for the places that lie in each part.

    Equal parts have equal bits. Unequal parts may too, which only lets a further pair be verified.
    """
    held: list[list[str]] = [[] for _ in range(PARTS)]
    for letter, n in sorted(Counter(word).items()):
        rank = ranks.get(letter, len(ranks))
        for time in range(n):  # the second time of a letter goes to another part than the first
            held[(rank + 2 * time) % PARTS].append(f"{letter}{time}")
    return sum((xxhash.xxh64_intdigest(" ".join(h)) & PART) << (BITS * i) for i, h in enumerate(held) if h)


def letter_vectors(words: DataFrame) -> DataFrame:
    """``word``, ``n`` and the word's ``vector``."""
    ranks = _letter_ranks(words)

    @F.pandas_udf("long")
    def vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([letter_vector(w, ranks) for w in batch], dtype="int64")

    return words.select("word", "n", vector("word").alias("vector"))


def _signed(vectors: DataFrame, half: int) -> DataFrame:
    """A row for each signature of each word: ``key``, ``mask`` (the parts it holds) and ``front``.

    ``key`` joins the parts left in with the first or the last ``half`` letters.
    """
    kinds = [
        F.struct(F.lit(sum(PART << (BITS * i) for i in range(PARTS) if i not in out)).alias("mask"), F.lit(front).alias("front"))
        for out in LEFT_OUT
        for front in (True, False)
    ]
    each = vectors.withColumn("kind", F.explode(F.array(*kinds))).select("word", "n", "vector", "kind.*")
    letters = F.when(F.col("front"), F.left("word", F.lit(half))).otherwise(F.right("word", F.lit(half)))
    return each.withColumn("key", F.xxhash64("mask", "front", F.col("vector").bitwiseAND(F.col("mask")), letters))


def near_pairs(words: DataFrame, least_letters: int, hot: int = HOT) -> DataFrame:
    """``a``, ``b``, ``na``, ``nb``: each pair of words one edit apart once, ``a`` the longer (or else the lesser).

    Keys with more than ``hot`` rows are salted: one side is dealt to shares, the other goes to each of them.
    The signatures are merged, never broadcast: Spark takes the exploded rows for as few bytes as the words' files.
    """
    half = least_letters // 2
    signed = _signed(written(letter_vectors(words), "letter-vectors"), half)
    crowded = signed.groupBy("key").count().filter(F.col("count") > hot)
    shares = sized(written(crowded.select("key", F.ceil(F.col("count") / hot).cast("int").alias("shares")), "crowded-keys"))
    shared = signed.join(shares, "key", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
    left = shared.withColumn("salt", F.pmod(F.xxhash64("word"), "shares").cast("int")).select(
        "key", "salt", "mask", "front", F.col("word").alias("a"), F.col("n").alias("na"), F.col("vector").alias("va")
    )
    right = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).select(
        "key", "salt", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("vector").alias("vb")
    )
    size_a, size_b = F.length("a"), F.length("b")
    ordered = (size_a > size_b) | ((size_a == size_b) & (F.col("a") < F.col("b")))
    fronts = F.left("a", F.lit(half)) == F.left("b", F.lit(half))
    ends = F.right("a", F.lit(half)) == F.right("b", F.lit(half))
    differ = F.col("va").bitwiseXOR(F.col("vb"))
    held = F.lit(0).cast("long")  # the first signature that holds no differing part
    for out in reversed(LEFT_OUT):
        mask = sum(PART << (BITS * i) for i in range(PARTS) if i not in out)
        held = F.when(differ.bitwiseAND(F.lit(mask)) == 0, F.lit(mask).cast("long")).otherwise(held)
    once = (F.col("front") == fronts) & (fronts | ends) & (held == F.col("mask"))
    met = left.join(right.hint("merge"), ["key", "salt"]).filter(ordered & once)
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "na", "nb")


def follow_forms(forms: DataFrame) -> DataFrame:
    """``word``, ``root``: the last word that each word's chain of forms reaches.

    Every round doubles the length of the chains followed, so the rounds grow with the logarithm of the
    longest chain. ``forms``: ``word``, ``form`` without circles (a form occurs more often than its word).
    """
    now = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(
            now.join(sized(step), "root", "left").select(
                "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")
            ),
            "forms",
        )
        now = after.select("word", "root")
        if not after.filter("moved").limit(1).count():
            return now


def spelling_variants(docs: DataFrame, least_letters: int = 6, least_n: int = 5, factor: int = 5) -> DataFrame:
    """The spelling form and root of every word of a corpus.

    ``docs``: ``doc_id`` (null: as an empty text), ``text`` (null: none); other columns are ignored, repeated rows count as often as they
    occur, an empty table has no words. Result, one row for each word: ``word``, ``form`` (its near word of largest
    ``n``, ties to the smallest in code-point order, if that ``n`` is at least ``factor`` times the word's; else
    null), ``root`` (the end of the chain of forms; the word itself where there is none), ``n``, ``n_near``, ``form_n``.
    """
    words = written(count_words(docs, least_letters, least_n), "words")
    pairs = written(near_pairs(words, least_letters), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m"))
    )
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("near"))).alias("best")
    )
    known = words.join(best.hint("merge"), "word", "left")
    strong = -F.col("best.less") >= factor * F.col("n")
    known = written(
        known.select(
            "word", F.when(strong, F.col("best.near")).alias("form"), "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(strong, -F.col("best.less")).alias("form_n"),
        ),
        "word-forms",
    )
    roots = follow_forms(known.filter("form IS NOT NULL"))
    return known.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
