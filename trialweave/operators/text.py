"""Words: cleaning, content words, probes, corpus frequency and surprisal."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.hashing import hex_int, md5_key, unit
from ..session import written

# Characters stripped from both ends of a token.
STRIP = ".,!?;:\"'()"

# Function words that are never probe targets.
STOPWORDS = (
    "the", "and", "that", "with", "this", "from", "they", "have", "were", "their", "what",
    "when", "your", "which", "them", "then", "than", "into", "been", "more", "some", "such",
    "only", "would", "could", "should", "about", "there", "these", "those", "here", "very",
    "just", "also", "upon", "shall", "will", "him", "her", "his", "its", "our", "are", "was",
    "for", "not", "but", "you", "had", "has",
)

# Content words offered as absent probe targets.
COMMON_WORDS = (
    "anchor", "purple", "engine", "harbor", "candle", "ladder", "silver", "meadow", "rocket",
    "pencil", "garden", "bottle", "thunder", "marble", "velvet", "copper", "lantern", "pillow",
    "saddle", "feather", "orchard", "cabinet", "blanket", "compass", "diamond", "kettle",
    "mirror", "ribbon", "tunnel", "wagon", "whistle", "balloon", "biscuit", "cottage",
    "dolphin", "glacier", "hammer", "jacket", "kingdom", "magnet",
)


def clean_token(word: Column) -> Column:
    """Lower case without surrounding punctuation."""
    return F.lower(F.btrim(word, F.lit(STRIP)))


def is_content(token: Column, min_len: int) -> Column:
    """Alphabetic, long enough, not a function word and not the unknown mark."""
    return (
        token.rlike(r"^\p{L}+$") & (F.length(token) >= min_len)
        & ~token.isin(*STOPWORDS) & (token != "unk")
    )


def content_words(words: DataFrame, word: str, min_len: int) -> DataFrame:
    """Rows whose cleaned ``token`` is a content word."""
    return words.withColumn("token", clean_token(F.col(word))).where(is_content(F.col("token"), min_len))


def zipf_values(corpus: DataFrame, token: str) -> DataFrame:
    """Corpus frequency per token on the Zipf scale: log10 of occurrences per billion."""
    counts = corpus.groupBy(token).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.crossJoin(F.broadcast(total)).select(
        token, "n", F.log10(F.col("n") * 1e9 / F.col("_all")).alias("zipf")
    )


def bigram_surprisal(tokens: DataFrame, prev: str, token: str, k: float = 1.0) -> DataFrame:
    """``-log2 p(token | previous)`` with add-k smoothing, one row per distinct pair.

    ``prev`` is null for the first word of a text.  Pairs are counted with partial aggregation
    and written once; contexts are sums of pair counts.
    """
    every = written(tokens.groupBy(prev, token).agg(F.count(F.lit(1)).alias("c2")), "pair-counts")
    pairs = every.where(F.col(prev).isNotNull())
    context = pairs.groupBy(prev).agg(F.sum("c2").alias("c1"))
    size = every.agg(F.countDistinct(token).alias("_v"))
    p = (F.col("c2") + k) / (F.col("c1") + k * F.col("_v"))
    return pairs.join(context, prev).crossJoin(F.broadcast(size)).select(prev, token, (-F.log2(p)).alias("bits"))


def onset_impulses(
    words: DataFrame, by: Sequence[str], start: str, value: Column, rate: float, grid: DataFrame, t: str = "t"
) -> DataFrame:
    """Impulse train: values added at ``round(start * rate)``, out-of-range onsets dropped.

    ``grid`` holds one row per (key, t); the result is 0 where no word starts.
    """
    at = F.rint(F.col(start) * rate).cast("bigint")
    hits = words.groupBy(*by, at.alias(t)).agg(F.sum(value).alias("_v"))
    return grid.join(hits, [*by, t], "left").select(*by, t, F.coalesce("_v", F.lit(0.0)).alias("impulse"))


def probe_per_clip(words: DataFrame, clip: str, token: str, end: str, min_len: int, window_end: float, seed: str) -> DataFrame:
    """One yes/no probe per clip, present or absent by an even coin with fall-back.

    Present targets come from content words heard inside the window; absent targets are the
    common words missing from the whole transcript.  The choice inside a pool follows md5 order.
    """
    heard = words.where((F.col(end) <= window_end) & is_content(F.col(token), min_len))
    rank = md5_key(seed, clip, token)
    present = heard.groupBy(clip).agg(F.min_by(token, rank).alias("_present"))
    spoken = words.where(F.col(token).isin(*COMMON_WORDS)).groupBy(clip).agg(F.collect_set(token).alias("_spoken"))
    clips = words.select(clip).distinct().join(spoken, clip, "left").join(present, clip, "left")
    bank = F.array(*[F.lit(w) for w in COMMON_WORDS if len(w) >= min_len])
    missing = F.array_except(bank, F.coalesce("_spoken", F.array().cast("array<string>")))
    absent = F.element_at(missing, (hex_int(md5_key(seed + "-absent", clip)) % F.size(missing) + 1).cast("int"))
    coin = unit(md5_key(seed + "-coin", clip)) < 0.5
    use_present = (coin & F.col("_present").isNotNull()) | (F.size(missing) == 0)
    target = F.when(use_present, F.col("_present")).otherwise(absent)
    return clips.select(clip, target.alias("target_word"), use_present.alias("present")).where(
        "target_word is not null"
    ).withColumn("question", F.concat(F.lit('Was the word "'), F.col("target_word"), F.lit('" spoken?')))
