"""Word operators and small scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.text import COMMON_WORDS, STOPWORDS, clean_token, content_words, probe_per_clip
from .adapters import EV, LONG, SIG, events, md5_sql, signal, table, unit_sql, words
from .registry import query

PUNCT = """'.,!?;:"''()'"""
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
BANK = ", ".join(f"'{w}'" for w in COMMON_WORDS)


@query("token_cleaning", "F1", f"SELECT doc_id, count(*) AS n, count(DISTINCT lower(trim(w, {PUNCT}))) AS n_distinct FROM (SELECT doc_id, unnest(str_split(text, ' ')) AS w FROM documents) GROUP BY doc_id")
def token_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    w = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w"))
    return w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(clean_token(F.col("w"))).alias("n_distinct"))


@query(
    "content_words", "F2",
    f"""WITH t AS (SELECT conv_id, lower(trim(unnest(str_split(text, ' ')), {PUNCT})) AS tok FROM conversations)
    SELECT conv_id AS clip, tok AS token, count(*) AS n FROM t WHERE regexp_full_match(tok, '\\p{{L}}+') AND length(tok) >= 4 AND tok NOT IN ({STOP}, 'unk') GROUP BY ALL""",
)
def content_words_query(spark: SparkSession, sf: str) -> DataFrame:
    return content_words(words(spark, sf), "word", 4).groupBy("clip", "token").agg(F.count(F.lit(1)).alias("n"))


@query(
    "probe_choice", "R16 P18",
    f"""WITH t AS (SELECT conv_id AS clip, turn, generate_subscripts(str_split(text, ' '), 1) - 1 AS pos, lower(trim(unnest(str_split(text, ' ')), {PUNCT})) AS tok FROM conversations),
    h AS (SELECT clip, tok FROM t WHERE (pos + 1) * 0.4 <= 12.0 AND regexp_full_match(tok, '\\p{{L}}+') AND length(tok) >= 4 AND tok NOT IN ({STOP}, 'unk')),
    p AS (SELECT clip, arg_min(tok, {md5_sql('probe', 'clip', 'tok')}) AS present FROM h GROUP BY clip),
    s AS (SELECT clip, list_filter([{BANK}], lambda b: NOT list_contains(coalesce(list(tok) FILTER (tok IN ({BANK})), []), b)) AS missing FROM t GROUP BY clip),
    c AS (SELECT s.clip, present, missing[CAST('0x' || substr({md5_sql('probe-absent', 's.clip')}, 1, 8) AS BIGINT) % len(missing) + 1] AS absent, {unit_sql(md5_sql('probe-coin', 's.clip'))} < 0.5 AS coin FROM s LEFT JOIN p ON p.clip = s.clip)
    SELECT clip, CASE WHEN coin AND present IS NOT NULL THEN present ELSE absent END AS target_word, coin AND present IS NOT NULL AS present,
    'Was the word "' || CASE WHEN coin AND present IS NOT NULL THEN present ELSE absent END || '" spoken?' AS question FROM c""",
)
def probe_choice(spark: SparkSession, sf: str) -> DataFrame:
    w = words(spark, sf).select("clip", clean_token(F.col("word")).alias("tok"), ((F.col("pos") + 1) * 0.4).alias("end_s"))
    return probe_per_clip(w, "clip", "tok", "end_s", 4, 12.0, "probe")


@query(
    "json_payload_build", "F5 F4",
    """SELECT event_id, event_type AS label, CAST(props ->> '$.k' AS INTEGER) AS k, round(value, 2) AS value FROM events""",
)
def json_payload_build(spark: SparkSession, sf: str) -> DataFrame:
    extra = F.from_json("props", "map<string,double>")
    base = F.create_map(F.lit("value"), F.col("value"))
    built = table(spark, sf, "events").select(
        "event_id", F.to_json(F.struct(F.col("event_type").alias("label"), F.map_concat(base, extra).alias("extras"))).alias("payload")
    )
    back = F.from_json("payload", "label string, extras map<string,double>")
    return built.select("event_id", back.alias("p")).select(
        "event_id", "p.label", F.col("p.extras")["k"].cast("int").alias("k"), F.round(F.col("p.extras")["value"], 2).alias("value")
    )


@query(
    "scalar_rounding", "F9 F10",
    "SELECT l_orderkey, l_linenumber, l_partkey, round_even((l_extendedprice * 7 + 0.5) / 1000, 0) AS half_even, round(pow(greatest(l_quantity - 10, 0), 0.3), 6) AS compressed, round(10 * log10(l_quantity + 1e-30), 6) AS db, round(ln(greatest(l_tax, 1e-12)), 6) AS floored_log FROM lineitem",
)
def scalar_rounding(spark: SparkSession, sf: str) -> DataFrame:
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.rint((F.col("l_extendedprice") * 7 + 0.5) / 1000).alias("half_even"),
        F.round(F.pow(F.greatest(q - 10, F.lit(0.0)), F.lit(0.3)), 6).alias("compressed"),
        F.round(10 * F.log10(q + 1e-30), 6).alias("db"), F.round(F.log(F.greatest("l_tax", F.lit(1e-12))), 6).alias("floored_log"),
    )


@query(
    "nearest_target_lag", "F11",
    f"""WITH {SIG}, g AS (SELECT trial, t, t * 15.625 AS lag_ms FROM sig), x AS (SELECT trial, target, t, row_number() OVER (PARTITION BY trial, target ORDER BY abs(lag_ms - target), t) AS rn FROM g, (VALUES (0), (100), (250), (400)) v(target))
    SELECT trial, target, t FROM x WHERE rn = 1""",
)
def nearest_target_lag(spark: SparkSession, sf: str) -> DataFrame:
    targets = F.explode(F.array(*[F.lit(v) for v in (0, 100, 250, 400)]))
    g = signal(spark, sf).select("trial", "t", targets.alias("target"))
    return g.groupBy("trial", "target").agg(F.min_by("t", F.struct(F.abs(F.col("t") * 15.625 - F.col("target")), F.col("t"))).alias("t"))


@query(
    "lag_major_reshape", "F12",
    f"WITH {LONG} SELECT trial, t, ch // 8 AS lag, ch % 8 AS channel, round(v, 6) AS w FROM long",
)
def lag_major_reshape(spark: SparkSession, sf: str) -> DataFrame:
    flat = signal(spark, sf).select("trial", "t", F.posexplode("x").alias("i", "w"))
    return flat.select("trial", "t", F.floor(F.col("i") / 8).cast("int").alias("lag"), (F.col("i") % 8).alias("channel"), F.round("w", 6).alias("w"))


@query(
    "file_name_parts", "F6",
    "SELECT page_id, regexp_extract(url, '([^/]+)/?$', 1) AS stem, printf('%03d', page_id) AS tag FROM pages",
)
def file_name_parts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", F.regexp_extract("url", r"([^/]+)/?$", 1).alias("stem"), F.format_string("%03d", "page_id").alias("tag")
    )


@query(
    "timestamp_layouts", "F8",
    "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS at_s FROM events",
)
def timestamp_layouts(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", F.date_format("ts", "yyyyMMdd_HHmmss").alias("stamp"), F.date_format("ts", "yyyyMMddHHmmss").alias("long"))
    a = F.to_timestamp_ntz("stamp", F.lit("yyyyMMdd_HHmmss"))
    b = F.to_timestamp_ntz("long", F.lit("yyyyMMddHHmmss"))
    instant = F.from_utc_timestamp(F.when(a == b, a).cast("timestamp"), F.current_timezone())
    return ev.select("event_id", "stamp", F.unix_seconds(instant).alias("at_s"))
