"""Projections, predicates, set operations, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.hashing import md5_key
from ..operators.classify import train_rows as fold_train_rows
from ..operators.ordered import positions
from ..operators.selection import (
    bounded, channels_or_all, decimated, fit_length, high_load, in_vocabulary, ordinal, region_of, rename_by_map,
    rename_if_complete, require, same_names, swap_halves, top_by,
)
from .adapters import EV, LONG, SIG, COND, events, md5_sql, signal, signal_long, table, trial_condition
from .registry import query


@query(
    "rename_channels", "P1",
    """SELECT s_suppkey, coalesce(r_name, n_name) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN region ON n_name = 'NATION_' || r_regionkey""",
)
def rename_channels(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    rows = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        "s_suppkey", F.col("n_name").alias("name")
    )
    mapping = table(spark, sf, "region").select(F.format_string("NATION_%d", "r_regionkey").alias("old"), F.col("r_name").alias("new"))
    return rename_by_map(rows, "name", mapping, "old", "new")


@query(
    "rename_if_complete", "P2",
    """SELECT n_nationkey, 'full' AS kind, 'ch' || n_nationkey AS name FROM nation
    UNION ALL SELECT n_nationkey, 'partial', n_name FROM nation""",
)
def rename_if_complete_query(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    full = nation.select(F.col("name").alias("old"), F.format_string("ch%d", "n_nationkey").alias("new"))
    part = full.where(F.col("old") != "NATION_3")
    a = rename_if_complete(nation, "name", full, "old", "new").withColumn("kind", F.lit("full"))
    b = rename_if_complete(nation, "name", part, "old", "new").withColumn("kind", F.lit("partial"))
    return a.unionByName(b).select("n_nationkey", "kind", "name")


@query(
    "swap_connector_halves", "P3",
    """SELECT p_partkey, CASE WHEN p_partkey <= 900 THEN p_partkey + 900 ELSE p_partkey - 900 END AS swapped FROM part
    WHERE CASE WHEN p_partkey <= 900 THEN p_partkey + 900 ELSE p_partkey - 900 END IN (SELECT p_partkey FROM part)""",
)
def swap_connector_halves(spark: SparkSession, sf: str) -> DataFrame:
    return swap_halves(table(spark, sf, "part").select("p_partkey"), "p_partkey", 900).select("p_partkey", "swapped")


@query(
    "channel_selection", "P4 P5",
    f"""WITH {LONG} SELECT 'excluded' AS kind, ch, count(*) AS n, round(avg(v), 6) AS mean_v FROM long WHERE ch NOT IN (3, 7, 11) GROUP BY ch
    UNION ALL SELECT 'roi', ch, count(*), round(avg(v), 6) FROM long WHERE ch IN (1, 2) GROUP BY ch
    UNION ALL SELECT 'fallback', ch, count(*), round(avg(v), 6) FROM long GROUP BY ch""",
)
def channel_selection(spark: SparkSession, sf: str) -> DataFrame:
    long = signal_long(spark, sf)
    stat = lambda d, k: d.groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean_v")).select(F.lit(k).alias("kind"), "ch", "n", "mean_v")
    per = long.groupBy("ch").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    done = lambda d, k: d.select(F.lit(k).alias("kind"), "ch", "n", F.round(F.col("s") / F.col("n"), 6).alias("mean_v"))
    return (
        stat(long.where(~F.col("ch").isin(3, 7, 11)), "excluded")
        .unionByName(done(channels_or_all(per, "ch", [1, 2]), "roi"))
        .unionByName(done(channels_or_all(per, "ch", [900, 901]), "fallback"))
    )


@query(
    "region_by_prefix", "P6",
    """SELECT CASE WHEN regexp_matches(upper(source), '^(O|P|I)') THEN 'posterior'
      WHEN regexp_matches(upper(source), '^(FP|AF)') OR (upper(source) LIKE 'F%' AND NOT regexp_matches(upper(source), '^(FC|FT|FP)')) THEN 'frontal' ELSE 'other' END AS region, count(*) AS n
    FROM (SELECT chr(CAST(65 + doc_id % 26 AS INTEGER)) || chr(CAST(65 + (doc_id // 26) % 26 AS INTEGER)) AS source FROM documents) GROUP BY 1""",
)
def region_by_prefix(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.char(65 + F.col("doc_id") % 26), F.char(65 + F.floor(F.col("doc_id") / 26) % 26))
    docs = table(spark, sf, "documents").select(F.coalesce(region_of(name), F.lit("other")).alias("region"))
    return docs.groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(
    "vocabulary_filter", "P7",
    "SELECT c_custkey, c_mktsegment FROM customer WHERE upper(c_mktsegment) IN ('BUILDING', 'MACHINERY', 'FURNITURE')",
)
def vocabulary_filter(spark: SparkSession, sf: str) -> DataFrame:
    cust = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    vocab = cust.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "FURNITURE")).select(F.lower("c_mktsegment").alias("w"))
    return in_vocabulary(cust, "c_mktsegment", vocab, "w")


@query("decimation", "P10", f"WITH {SIG} SELECT trial, t FROM sig WHERE t % 4 = 0")
def decimation(spark: SparkSession, sf: str) -> DataFrame:
    return decimated(signal(spark, sf).select("trial", "t"), "t", 250.0, 64.0)


@query(
    "fit_to_length", "P11",
    f"""WITH {LONG}, s AS (SELECT trial, t, ch, v, 20 + trial * 4 AS len FROM long), c AS (SELECT * FROM s WHERE t < len)
    SELECT g.trial, g.ch, CAST(r.t AS BIGINT) AS t, round(CASE WHEN c.v IS NULL THEN l.v ELSE c.v END, 6) AS v
    FROM (SELECT trial, ch, max(t) AS mt FROM c GROUP BY trial, ch) g CROSS JOIN range(40) r(t)
    LEFT JOIN c ON c.trial = g.trial AND c.ch = g.ch AND c.t = r.t JOIN c l ON l.trial = g.trial AND l.ch = g.ch AND l.t = g.mt""",
)
def fit_to_length(spark: SparkSession, sf: str) -> DataFrame:
    s = signal_long(spark, sf).where(F.col("t") < 20 + F.col("trial") * 4)
    return fit_length(s, ["trial", "ch"], "t", "v", 40).withColumn("v", F.round("v", 6))


@query(
    "bounded_scores", "P12",
    """WITH z AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_totalprice - 250000) / 30011 END AS z FROM orders)
    SELECT o_orderkey, round(greatest(-8.0, least(8.0, coalesce(z, 0.0))), 6) AS b FROM z""",
)
def bounded_scores(spark: SparkSession, sf: str) -> DataFrame:
    z = F.when(F.col("o_orderkey") % 7 != 0, (F.col("o_totalprice") - 250000) / 30011).otherwise(F.lit(float("nan")))
    return table(spark, sf, "orders").select("o_orderkey", F.round(bounded(z), 6).alias("b"))


@query(
    "label_encoding", "P13",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, CAST(o_orderpriority[1] AS INTEGER) - 1 AS tier,
    CASE WHEN CAST(o_orderpriority[1] AS INTEGER) - 1 >= 3 THEN 'high' ELSE 'low' END AS load FROM orders""",
)
def label_encoding(spark: SparkSession, sf: str) -> DataFrame:
    tier = ordinal(F.substring("o_orderpriority", 1, 1), [str(i) for i in range(1, 6)])
    return table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("y"), tier.alias("tier"),
        high_load(tier).alias("load"),
    )


@query(
    "complete_blocks_only", "P14",
    f"""WITH {EV}, ext AS (SELECT user_id, max(us) AS mx FROM ev GROUP BY user_id)
    SELECT user_id, event_id FROM ev JOIN ext USING (user_id)
    WHERE event_type = 'signup' AND us - 86400000000 >= 1704067200000000 AND us + 172800000000 <= mx""",
)
def complete_blocks_only(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.intervals import complete_blocks

    ev = events(spark, sf)
    ext = ev.groupBy("user_id").agg((F.max("us") - 1_704_067_200_000_000).alias("mx"))
    blocks = ev.where("event_type = 'signup'").join(ext, "user_id").withColumn(
        "start", F.col("us") - 86_400_000_000 - 1_704_067_200_000_000
    )
    return complete_blocks(blocks, "start", 259_200_000_000, "mx").select("user_id", "event_id")


@query(
    "minimum_trials_guard", "P15",
    f"WITH {SIG}, {COND} SELECT y, count(*) AS n FROM cond GROUP BY y",
)
def minimum_trials_guard(spark: SparkSession, sf: str) -> DataFrame:
    per = trial_condition(spark, sf).groupBy("y").agg(F.count(F.lit(1)).alias("n"))
    return require(per, F.col("n") >= 1, "too few trials in a condition")


@query(
    "valid_trials", "P16 P17 U3",
    """SELECT o_orderkey FROM orders WHERE o_totalprice > 5000 AND o_orderdate IS NOT NULL
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')""",
)
def valid_trials(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    audio = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    game = li.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("o_orderkey"))
    good = table(spark, sf, "orders").where("o_totalprice > 5000 and o_orderdate is not null").select("o_orderkey")
    return good.join(audio, "o_orderkey", "left_semi").join(game, "o_orderkey", "left_semi")


@query(
    "numeric_probe_error", "P19",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.02 THEN abs(l_quantity - 25) END AS err,
    CASE WHEN l_discount > 0.02 THEN l_quantity = 25 END AS correct FROM lineitem""",
)
def numeric_probe_error(spark: SparkSession, sf: str) -> DataFrame:
    answer = F.when(F.col("l_discount") > 0.02, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.abs(answer - 25).alias("err"), (answer == 25).alias("correct")
    )


@query(
    "train_rows", "U1 U2",
    f"WITH {SIG}, {COND} SELECT CAST(f AS INTEGER) AS held, count(*) AS n_train, sum(trial) AS check_sum FROM cond, range(5) r(f) WHERE trial % 5 <> f GROUP BY f",
)
def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Train rows of each of five folds."""
    ids = trial_condition(spark, sf).withColumn("fold", F.col("trial") % 5)
    return fold_train_rows(ids, "fold", 5).groupBy(F.col("model_fold").alias("held")).agg(
        F.count(F.lit(1)).alias("n_train"), F.sum("trial").alias("check_sum")
    )


@query(
    "name_set_check", "U4",
    """SELECT CAST(0 AS BIGINT) AS only_left, (SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40)) AS only_right,
    (SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 40)) = 0 AS equal""",
)
def name_set_check(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf)
    return same_names(ev.where("event_type = 'error' and value > 40"), ev, "user_id")


@query(
    "ranked_group_members", "K2 K3 K5",
    """SELECT s_nationkey, s_suppkey, rank, avg_rank FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank,
     round(avg(g) OVER (PARTITION BY s_nationkey), 6) AS avg_rank FROM (SELECT *, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS g FROM supplier)) WHERE rank <= 8""",
)
def ranked_group_members(spark: SparkSession, sf: str) -> DataFrame:
    """Top eight per group, and the mean overall rank of each group."""
    sup = table(spark, sf, "supplier").withColumn("neg", -F.col("s_acctbal"))
    ranked = positions(sup, [], ["neg", "s_suppkey"])
    mean = ranked.groupBy("s_nationkey").agg(F.round(F.avg("pos"), 6).alias("avg_rank"))
    top = top_by(ranked, ["s_nationkey"], [F.col("s_acctbal").desc()], 8, "s_suppkey")
    return top.join(mean, "s_nationkey").select("s_nationkey", "s_suppkey", "rank", "avg_rank")


@query(
    "best_grid_cell", "K4 A31",
    """SELECT o_custkey, o_orderkey AS cell, pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY b DESC, pos) AS rn
    FROM (SELECT o_custkey, o_orderkey, o_orderkey AS pos, floor(o_totalprice / 100000) AS b FROM orders)) WHERE rn = 1""",
)
def best_grid_cell(spark: SparkSession, sf: str) -> DataFrame:
    """Best score per group, first grid position on a tie."""
    od = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.floor(F.col("o_totalprice") / 100000).alias("b"))
    best = od.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("b", -F.col("o_orderkey"))).alias("cell"))
    return best.select("o_custkey", "cell", F.col("cell").alias("pos"))


@query(
    "most_frequent_value", "A31",
    """SELECT l_suppkey, qty FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY c DESC, qty) AS rn
    FROM (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS qty, count(*) AS c FROM lineitem GROUP BY ALL)) WHERE rn = 1""",
)
def most_frequent_value(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").groupBy("l_suppkey", F.col("l_quantity").cast("int").alias("qty")).agg(F.count(F.lit(1)).alias("c"))
    return c.groupBy("l_suppkey").agg(F.max_by("qty", F.struct("c", -F.col("qty"))).alias("qty"))


@query(
    "top_correlations", "K1",
    f"""WITH {SIG}, v AS (SELECT trial, t, list_transform(x, lambda e: CAST(e AS DOUBLE)) AS x FROM sig)
    SELECT trial, t, round(list_avg(x[1:5]), 6) AS first_k, round(list_avg(list_sort(x, 'DESC')[1:5]), 6) AS largest_k FROM v""",
)
def top_correlations(spark: SparkSession, sf: str) -> DataFrame:
    """Both rules for a top-k mean: the first k components, or the k largest."""
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)
    return signal(spark, sf).select(
        "trial", "t", F.round(mean(F.slice("x", 1, 5)), 6).alias("first_k"),
        F.round(mean(F.slice(F.sort_array("x", False), 1, 5)), 6).alias("largest_k"),
    )


@query(
    "row_thinning", "K8",
    f"""WITH {EV} SELECT 'stride' AS rule, event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS pos, count(*) OVER () AS n FROM ev) WHERE pos % greatest(1, n // 2000) = 0
    UNION ALL SELECT * FROM (SELECT 'random', event_id FROM ev ORDER BY {md5_sql('thin', 'event_id')}, event_id LIMIT 4000)""",
)
def row_thinning(spark: SparkSession, sf: str) -> DataFrame:
    ev = events(spark, sf).select("event_id")
    stride = positions(ev, [], ["event_id"]).where(F.col("pos") % F.greatest(F.lit(1), F.floor(F.col("n") / 2000)) == 0)
    some = ev.orderBy(md5_key("thin", "event_id"), "event_id").limit(4000)
    return stride.select(F.lit("stride").alias("rule"), "event_id").unionByName(some.select(F.lit("random").alias("rule"), "event_id"))
