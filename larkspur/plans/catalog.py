"""Query catalog: name -> callable(spark, sf_dir), and name -> SQL text for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur import operators as ops
from larkspur import streaming as st
from larkspur.functions import safe_ratio, variants
from larkspur.operators import sketches as sk
from larkspur.operators import snapshots, vector_index
from larkspur.sources import FORMATS, bucket_count, read_files, read_table, register_logs, scratch, write_bucketed, write_logs, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (t), where t(name) reads a table, under its own name."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: read_table(spark, sf_dir, name))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def streaming_query(sql: str):
    """Register a function of the event stream; its rows go to files of the shared folder, in append mode.

    The table is a file or a folder; named as a pattern, the stream's source takes either. All files that are there make one
    trigger, however many: files need no order, and the watermark closes windows after the last of them.
    """

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return st.run_to_files(f(st.read_events(spark, f"{sf_dir}/events.parque[t]", files_per_trigger=None)), scratch(spark, f.__name__))

        QUERIES[f.__name__], ORACLES[f.__name__] = run, sql
        return f

    return register


@query("""
SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 10""")
def top_customers(t):
    joined = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("c_custkey", "c_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue")).orderBy(F.desc("revenue"), "c_custkey").limit(10)


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price,
       round(avg(l_discount), 6) AS avg_discount, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t):
    return t("lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_discount"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders
WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def filtered_orders(t):
    d = F.col("o_orderdate")
    return t("orders").where((d >= F.expr("TIMESTAMP_NTZ '1997-01-01'")) & (d < F.expr("TIMESTAMP_NTZ '1998-01-01'")) & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""
SELECT n_name, c_mktsegment, count(*) AS n, grouping(n_name) + 0 AS g
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)""")
def segment_rollup(t):
    return t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.grouping("n_name").cast("long").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def order_cube(t):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished,
       median(o_totalprice) AS mid FROM orders GROUP BY o_orderpriority""")
def distinct_and_filtered(t):
    counts = t("orders").groupBy("o_orderpriority").agg(F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))
    return counts.join(ops.quantiles(t("orders"), "o_orderpriority", "o_totalprice", {"mid": 0.5}), "o_orderpriority")


@query("""
SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c
FROM lineitem GROUP BY l_returnflag""")
def moments(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("vp"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def left_join(t):
    return t("customer").join(t("orders"), (F.col("c_custkey") == F.col("o_custkey")) & (F.col("o_orderstatus") == "P"), "left").select("c_custkey", "o_orderkey")


@query("""
SELECT coalesce(c_custkey, user_id) AS id, c_name, n FROM customer FULL JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ON c_custkey = user_id""")
def full_join(t):
    """Customers and users by number, those of one side alone too."""
    users = t("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return t("customer").join(users, F.col("c_custkey") == F.col("user_id"), "full").select(F.coalesce("c_custkey", "user_id").alias("id"), "c_name", "n")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_join(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT a.s_suppkey AS supplier, b.c_custkey AS customer FROM supplier a JOIN customer b
ON b.c_acctbal BETWEEN a.s_acctbal - 2 AND a.s_acctbal + 2""")
def band_join(t):
    return ops.band_join(t("supplier"), t("customer"), "s_acctbal", "c_acctbal", -2.0, 2.0).select(F.col("s_suppkey").alias("supplier"), F.col("c_custkey").alias("customer"))


@query("""
SELECT p.event_id, p.user_id, v.event_id AS asof_event_id, v.ts AS asof_ts
FROM (FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts""")
def asof_join(t):
    e = t("events")
    return ops.asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", ["ts", "event_id"]).select("event_id", "user_id", "asof_event_id", "asof_ts")


@query("SELECT l_linenumber, p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def salted_join(t):
    right = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return ops.salted_join(t("lineitem").select("l_partkey", "l_linenumber", "l_orderkey"), right, "l_partkey", 4).groupBy("l_linenumber", "p_brand").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, lag(o_totalprice) OVER w AS prev,
       round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def window_functions(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select(
        "o_custkey", "o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(w).alias("rk"), F.dense_rank().over(w).alias("dr"), F.lag("o_totalprice").over(w).alias("prev"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"))


@query("""
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events""")
def range_frame(t):
    seconds = F.unix_micros(F.col("ts").cast("timestamp"))
    return t("events").select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy(seconds).rangeBetween(-86_400_000_000, 0)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_per_group(t):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t("orders").withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("(SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL (SELECT s_nationkey FROM supplier INTERSECT SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def set_operations(t):
    a = t("customer").select(F.col("c_nationkey").alias("k")).subtract(t("supplier").where("s_acctbal > 5000").select("s_nationkey"))
    return a.unionAll(t("supplier").select("s_nationkey").intersect(t("nation").where("n_regionkey = 1").select("n_nationkey")))


@query("""
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'O') AS o, count(*) FILTER (WHERE o_orderstatus = 'P') AS p
FROM orders GROUP BY ALL""")
def pivot(t):
    p = t("orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return p.select("o_orderpriority", *(F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in "FOP"))


@query("SELECT p_partkey, 'size' AS field, CAST(p_size AS DOUBLE) AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part")
def unpivot(t):
    return t("part").select("p_partkey", F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price")).unpivot("p_partkey", ["size", "price"], "field", "v")


@query("""SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type""")
def json_fields(t):
    return t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("""
SELECT upper(p_brand) AS brand, regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') AS slug, md5(p_type) AS m, length(p_name) AS n, split_part(p_type, ' ', 1) AS head FROM part""")
def string_functions(t):
    return t("part").select(F.upper("p_brand").alias("brand"), F.regexp_replace(F.lower("p_name"), "[^a-z]+", "_").alias("slug"), F.md5("p_type").alias("m"), F.length("p_name").cast("long").alias("n"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(week(o_orderdate) AS INT) AS w, CAST(dayofweek(o_orderdate) AS INT) AS d, CAST(datediff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INT) AS age FROM orders")
def date_functions(t):
    d = F.col("o_orderdate")
    return t("orders").select("o_orderkey", F.year(d).alias("y"), F.quarter(d).alias("q"), F.weekofyear(d).alias("w"), (F.dayofweek(d) - 1).alias("d"), F.datediff(d, F.lit("1995-01-01").cast("date")).alias("age"))


@query("""
SELECT vec_id, CAST(count(*) FILTER (WHERE same) AS BIGINT) AS same_label, round(max(sim) FILTER (WHERE same), 5) AS nearest_same, round(max(sim) FILTER (WHERE NOT same), 5) AS nearest_other FROM (
SELECT a.vec_id, a.label = b.label AS same, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 10) GROUP BY vec_id""")
def cosine_pairs(t):
    """For every vector whose id is divisible by 50: how many of its ten nearest among all rows have its label, and the nearest of either kind."""
    e = t("embeddings")
    labels = e.select(F.col("vec_id").alias("i"), F.col("label").alias("l"))
    near = ops.nearest(e.where("vec_id % 50 = 0"), e, 10)
    near = near.join(labels, near["vec_id"] == labels["i"]).drop("i").withColumnRenamed("l", "own")
    near = near.join(labels, near["other"] == labels["i"]).withColumn("same", F.col("own") == F.col("l"))
    best = lambda some: F.max(F.when(some, F.col("sim")))
    return near.groupBy("vec_id").agg(F.count_if("same").alias("same_label"), best(F.col("same")).alias("nearest_same"), best(~F.col("same")).alias("nearest_other"))


@query("""
SELECT a.vec_id, b.vec_id AS other, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 5) AS sim
FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY sim DESC, b.vec_id) <= 10""")
def nearest_vectors(t):
    """The ten nearest of all rows for every vector whose id is divisible by 50."""
    e = t("embeddings")
    return ops.nearest(e.where("vec_id % 50 = 0"), e, 10)


@query("SELECT label, i, round(avg(v), 5) AS mean FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY label, i")
def explode_mean(t):
    return t("embeddings").select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", F.col("i").cast("long").alias("i")).agg(F.round(F.avg("v"), 5).alias("mean"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_rollup(t):
    return ops.rollup(t("events"), "1 hour", ["event_type"], {"n": F.count(F.lit(1)), "total": F.round(F.sum("value"), 4)})


@query("""
WITH m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS b FROM events),
s AS (SELECT *, sum(CAST(b AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM s GROUP BY user_id, s""")
def sessions(t):
    return ops.sessions(t("events"), 7200, "user_id")


@query("""
WITH v AS (SELECT user_id, min(ts) AS t1 FROM events WHERE event_type = 'view' GROUP BY 1),
c AS (SELECT user_id, min(e.ts) AS t2 FROM events e JOIN v USING (user_id) WHERE event_type = 'click' AND e.ts > t1 GROUP BY 1),
p AS (SELECT user_id, min(e.ts) AS t3 FROM events e JOIN c USING (user_id) WHERE event_type = 'purchase' AND e.ts > t2 GROUP BY 1)
SELECT user_id, CAST((t1 IS NOT NULL) AS INT) + CAST((t2 IS NOT NULL) AS INT) + CAST((t3 IS NOT NULL) AS INT) AS depth
FROM (SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click', 'purchase')) LEFT JOIN v USING (user_id) LEFT JOIN c USING (user_id) LEFT JOIN p USING (user_id)""")
def funnel(t):
    return ops.funnel(t("events"), ["view", "click", "purchase"], "user_id")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS v FROM events")
def fill_forward(t):
    e = t("events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "view", F.col("value")).alias("v"))
    return ops.fill_forward(e, "user_id", "ts", "v").select("event_id", "v")


@query("""
SELECT event_id, event_type, round(sum(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM events""")
def running_by_type(t):
    """Five keys of a fifth of all rows each, cut into ranges of a thousand rows."""
    e = ops.running_sum(t("events"), ["event_type"], ["ts", "event_id"], "value", rows=1000)
    return e.select("event_id", "event_type", F.round("running", 3).alias("running"))


@query("""
WITH m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY event_type ORDER BY ts) >= INTERVAL 20 MINUTE, true) AS b FROM events),
s AS (SELECT *, sum(CAST(b AS INT)) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT event_type, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n_events FROM s GROUP BY event_type, s""")
def bursts_by_type(t):
    """Sessions of five keys of a fifth of all rows each, made in ranges of a thousand rows and joined over their edges."""
    return ops.sessions(t("events"), 1200, "event_type", rows=1000)


@query("""
SELECT a.event_id, b.event_id AS asof_event_id FROM events a ASOF LEFT JOIN (FROM events WHERE event_type = 'error') b ON (a.value > 0) = (b.value > 0) AND a.ts >= b.ts""")
def asof_last_error(t):
    """The last error before each event, by the sign of the value alone: a key or two with all rows."""
    e = t("events").withColumn("sign", F.col("value") > 0)
    return ops.asof_join(e, e.where("event_type = 'error'"), ["sign"], "ts", ["ts", "event_id"], rows=1000).select("event_id", "asof_event_id")


_HEAVY = 0.002


@query(f"""
WITH w AS (SELECT unnest(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS word FROM documents)
SELECT word, count(*) AS n FROM w GROUP BY word HAVING count(*) >= {_HEAVY} * (SELECT count(*) FROM w)""")
def heavy_words(t):
    """Words that make up a five-hundredth of all, by summaries of bounded size and an exact recount."""
    words = t("documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))).alias("word"))
    return ops.heavy_hitters(words, "word", _HEAVY)


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS rank,
       row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS row_number FROM lineitem""")
def rank_of_all_lines(t):
    """Every line's place among all lines, in ranges of ten thousand rows."""
    ties = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]
    r = ops.global_rank(t("lineitem"), "l_extendedprice", ties, rows=10_000)
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "rank", "row_number")


@query("""
SELECT l_orderkey, l_linenumber, row_number FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS row_number FROM lineitem)
WHERE row_number > 2000 AND row_number <= 2100""")
def page_of_lines(t):
    """The 21st page of a hundred lines by date of shipment."""
    return ops.page(t("lineitem"), "l_shipdate", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], 21, 100, rows=10_000).select("l_orderkey", "l_linenumber", "row_number")


@query("""
WITH m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS b FROM events),
s AS (SELECT *, sum(CAST(b AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m),
p AS (SELECT user_id, min(ts) AS lo, max(ts) AS hi FROM s GROUP BY user_id, s)
SELECT a.user_id, count(*) AS n, count(DISTINCT b.user_id) AS others FROM p a JOIN p b ON a.lo <= b.hi AND b.lo <= a.hi AND a.user_id <> b.user_id GROUP BY a.user_id""")
def overlapping_sessions(t):
    """How many sessions of others each user's sessions overlap, and of how many others."""
    e = t("events")
    path = scratch(e.sparkSession, "sessions")
    ops.sessions(e, 7200, "user_id").select("user_id", *(F.unix_micros(F.col(c).cast("timestamp")).alias(c) for c in ("session_start", "session_end"))).write.parquet(path)
    return ops.overlap_counts(e.sparkSession.read.parquet(path), "user_id", "session_start", "session_end")


def _stored_sketches(t) -> DataFrame:
    """Hourly sketches of the events by type, written and read again."""
    e = t("events")
    path = scratch(e.sparkSession, "sketches")
    sk.sketch(e, ["event_type"], "user_id", "value", "1 hour").write.parquet(path)
    return e.sparkSession.read.parquet(path)


@query("""
SELECT event_type, time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near FROM events GROUP BY ALL""")
def sketched_days(t):
    """Daily users and medians merged from hourly sketches, beside the exact users; whether each estimate is within its bound."""
    day = F.date_trunc("day", "bucket").alias("day")
    est = sk.roll_up(_stored_sketches(t), "event_type", day).select(F.col("event_type").alias("k"), F.col("day").alias("d"), F.col("n").alias("merged"), sk.n_distinct().alias("about"), sk.quantile(0.5).alias("mid"))
    e = t("events").withColumn("day", F.date_trunc("day", "ts"))
    exact = e.join(est, (F.col("event_type") == F.col("k")) & (F.col("day") == F.col("d")))
    low, same = F.count_if(F.col("value") < F.col("mid")), F.count_if(F.col("value") <= F.col("mid"))
    got = exact.groupBy("event_type", "day").agg(F.count(F.lit(1)).alias("rows"), F.max("merged").alias("n"), F.countDistinct("user_id").alias("users"), F.max("about").alias("about"), low.alias("low"), same.alias("same"))
    slack = sk.rank_error() * F.col("rows") + 1
    near = (F.col("low") <= F.col("rows") / 2 + slack) & (F.col("same") >= F.col("rows") / 2 - slack)
    return got.select("event_type", F.col("day").cast("timestamp_ntz").alias("day"), "n", "users", sk.within(F.col("about"), F.col("users"), sk.hll_error()).alias("users_near"), near.alias("median_near"))


@query("""
WITH u AS (SELECT DISTINCT event_type, user_id FROM events)
SELECT a.event_type AS a, b.event_type AS b, count(*) AS n_both, true AS both_near, true AS only_near, true AS either_near
FROM u a JOIN u b ON a.user_id = b.user_id AND a.event_type < b.event_type GROUP BY ALL""")
def sketched_sets(t):
    """Users of two types of event, of one alone and of either, by set algebra over merged sketches, beside exact counts."""
    of_type = sk.roll_up(_stored_sketches(t), "event_type")
    x, y = (of_type.select(F.col("event_type").alias(c), F.col("theta").alias(f"theta_{c}")) for c in "ab")
    users = t("events").select("event_type", "user_id").distinct()
    own = users.groupBy("event_type").agg(F.count(F.lit(1)).alias("size"))
    u, v = (users.select(F.col("event_type").alias(c), "user_id") for c in "ab")
    pairs = u.join(v, "user_id").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    all_of = pairs.join(x, "a").join(y, "b").join(own.select(F.col("event_type").alias("a"), F.col("size").alias("size_a")), "a").join(own.select(F.col("event_type").alias("b"), F.col("size").alias("size_b")), "b")
    both, either = F.col("n_both"), F.col("size_a") + F.col("size_b") - F.col("n_both")
    near = lambda estimate, exact: sk.within(estimate, exact, sk.theta_error(), either)
    return all_of.select("a", "b", "n_both", near(sk.n_both("theta_a", "theta_b"), both).alias("both_near"), near(sk.n_only("theta_a", "theta_b"), F.col("size_a") - both).alias("only_near"), near(sk.n_either("theta_a", "theta_b"), either).alias("either_near"))


@query("""
SELECT o_orderkey, 'deleted' AS change FROM orders WHERE o_orderkey BETWEEN 100 AND 120 UNION ALL SELECT o_orderkey, 'changed' FROM orders WHERE o_orderkey BETWEEN 500 AND 550
UNION ALL SELECT o_orderkey + 1000000000, 'inserted' FROM orders WHERE o_orderkey < 20""")
def snapshot_changes(t):
    """What differs between the orders and a copy with some deleted, changed and inserted: only ranges of keys that differ are read row by row."""
    o = t("orders")
    path = scratch(o.sparkSession, "snapshots")
    k = F.col("o_orderkey")
    later = o.where(~k.between(100, 120)).withColumn("o_totalprice", F.when(k.between(500, 550), F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    later = later.unionByName(o.where(k < 20).withColumn("o_orderkey", k + 1_000_000_000))
    snapshots.write_snapshot(o, f"{path}/old", "o_orderkey")
    snapshots.write_snapshot(later, f"{path}/new", "o_orderkey", like=f"{path}/old")
    return snapshots.snapshot_difference(o.sparkSession, f"{path}/old", f"{path}/new", "o_orderkey")


@query("""
SELECT o_orderpriority, count(*) AS lines, count(DISTINCT o_orderkey) AS orders, round(sum(l_extendedprice), 2) AS total FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL""")
def bucketed_join(t):
    """Orders with their lines from tables written by buckets of the key: the join and the count by order have no exchange."""
    n = bucket_count(t("lineitem"), 8)
    o = write_bucketed(t("orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority"), ["k"], n, "orders")
    li = write_bucketed(t("lineitem").select(F.col("l_orderkey").alias("k"), "l_extendedprice"), ["k"], n, "lines")
    per = o.join(li.hint("merge"), "k").groupBy("k", "o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_extendedprice").alias("total"))
    return per.groupBy("o_orderpriority").agg(F.sum("lines").alias("lines"), F.count(F.lit(1)).alias("orders"), F.round(F.sum("total"), 2).alias("total"))


_MIXED = """CASE event_type WHEN 'view' THEN props WHEN 'click' THEN '{"k": "' || CAST(event_id AS VARCHAR(20)) || 'x", "z": {"on": true}}' WHEN 'error' THEN '{"k": ' WHEN 'signup' THEN '{"k": null, "z": 1.5}' ELSE '[1, 2]' END"""


@query(f"""
WITH j AS (SELECT event_id, {_MIXED} AS text, event_type FROM events), v AS (SELECT *, CASE WHEN json_valid(text) THEN text END AS ok FROM j)
SELECT event_id, ok IS NOT NULL AS is_json, CASE WHEN json_type(ok, '$.k') IN ('UBIGINT', 'BIGINT') THEN CAST(ok ->> '$.k' AS BIGINT) END AS number,
       CASE WHEN json_type(ok, '$.k') = 'VARCHAR' THEN ok ->> '$.k' END AS word, CAST(ok ->> '$.z.on' AS BOOLEAN) AS is_on FROM v""")
def variant_fields(t):
    """Properties whose field ``k`` is a number, a text or null, or that are no object or no JSON at all: typed columns from variants."""
    v = t("events").select("event_id", variants.parsed(F.expr(_MIXED.replace("VARCHAR(20)", "STRING"))).alias("v"))
    kind = variants.kind_of(F.col("v"), "k")
    number, word = (F.try_variant_get("v", "$.k", x) for x in ("long", "string"))
    return v.select("event_id", F.col("v").isNotNull().alias("is_json"), F.when(kind == "BIGINT", number).alias("number"), F.when(kind == "STRING", word).alias("word"), F.try_variant_get("v", "$.z.on", "boolean").alias("is_on"))


@query("""
SELECT count(*) AS queries, true AS all_answered, true AS recall_90 FROM embeddings WHERE vec_id % 50 = 0""")
def index_recall(t):
    """The vector index over all rows against the exact search: whether nine of ten of the true ten nearest are found, for every vector whose id is divisible by 50."""
    e = t("embeddings")
    path = scratch(e.sparkSession, "index")
    vector_index.build(e, path)
    asked = e.where("vec_id % 50 = 0")
    found = vector_index.search(e.sparkSession, path, asked, 10).select("vec_id", "other", F.lit(1).alias("hit"))
    true = ops.nearest(asked, e, 10)
    per = true.join(found, ["vec_id", "other"], "left").groupBy("vec_id").agg(F.count("hit").alias("hits"), F.count(F.lit(1)).alias("true"))
    return per.agg(F.count(F.lit(1)).alias("queries"), (F.min("hits") > 0).alias("all_answered"), (F.sum("hits") >= 0.9 * F.sum("true")).alias("recall_90"))


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, c_acctbal / nullif(c_nationkey, 0) AS per FROM customer")
def case_and_ratio(t):
    b = F.col("c_acctbal")
    return t("customer").select("c_custkey", F.when(b < 0, "debt").when(b < 5000, "low").otherwise("high").alias("band"), safe_ratio("c_acctbal", "c_nationkey").alias("per"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)")
def scalar_subquery(t):
    limit = t("orders").agg(F.avg("o_totalprice") * 1.9).scalar()
    return t("orders").where(F.col("o_totalprice") > limit).select("o_orderkey")


@query("""
SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def anti_join_urgent(t):
    done = t("orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return t("customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""
SELECT coalesce(c_nationkey, s_nationkey) AS nation, c.n AS customers, s.n AS suppliers
FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY ALL) s ON c_nationkey = s_nationkey""")
def full_join_counts(t):
    c = t("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    s = t("supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, F.col("c_nationkey") == F.col("s_nationkey"), "full").select(F.coalesce("c_nationkey", "s_nationkey").alias("nation"), "customers", "suppliers")


@query("""
SELECT o_custkey, round(sum(o_totalprice), 2) AS total, max(c_name) AS name
FROM orders RIGHT JOIN customer ON o_custkey = c_custkey WHERE o_custkey IS NOT NULL GROUP BY o_custkey HAVING count(*) >= 12""")
def right_join_having(t):
    joined = t("orders").join(t("customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "right").where("o_custkey IS NOT NULL")
    return joined.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("c_name").alias("name"), F.count(F.lit(1)).alias("n")).where("n >= 12").drop("n")


@query("SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < -900)")
def not_in(t):
    """The list is of different nations, so it stays small; a null in it leaves no row, as in SQL."""
    listed = t("supplier").where("s_acctbal < -900").select("s_nationkey").distinct()
    return t("customer").sparkSession.sql("SELECT c_custkey FROM {c} WHERE c_nationkey NOT IN (SELECT s_nationkey FROM {s})", c=t("customer"), s=listed)


@query("SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_scalar(t):
    mean = t("orders").groupBy(F.col("o_custkey").alias("k")).agg((1.5 * F.avg("o_totalprice")).alias("bar"))
    return t("orders").join(mean, F.col("o_custkey") == F.col("k")).where("o_totalprice > bar").select("o_orderkey")


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
def grouping_sets(t):
    c = t("customer")
    return c.groupingSets([["c_mktsegment"], ["c_nationkey"], []], "c_mktsegment", "c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("""
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.1), 4) AS p10, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99
FROM lineitem GROUP BY l_returnflag""")
def percentiles(t):
    q = ops.quantiles(t("lineitem"), "l_returnflag", "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p99": 0.99})
    return q.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("p10", "p50", "p99")))


@query("""
SELECT o_custkey, o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS pr, round(cume_dist() OVER w, 6) AS cd, lead(o_orderkey) OVER w AS following,
       first_value(o_orderkey) OVER w AS first_key, nth_value(o_orderkey, 2) OVER w AS second_key
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def ranking_functions(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select(
        "o_custkey", "o_orderkey", F.ntile(4).over(w).alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("pr"), F.round(F.cume_dist().over(w), 6).alias("cd"),
        F.lead("o_orderkey").over(w).alias("following"), F.first("o_orderkey").over(w).alias("first_key"), F.nth_value("o_orderkey", 2).over(w).alias("second_key"))


@query("SELECT o_orderpriority AS word FROM orders UNION SELECT c_mktsegment FROM customer")
def union_distinct(t):
    return t("orders").select(F.col("o_orderpriority").alias("word")).union(t("customer").select("c_mktsegment")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersectAll(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return t("customer").select(F.col("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query("""
SELECT n_regionkey, count(*) FILTER (WHERE n_name LIKE '%A%') AS entries, CAST(sum(n_nationkey + 1) FILTER (WHERE n_name LIKE '%A%') AS BIGINT) AS total,
       string_agg(lower(n_name), ',' ORDER BY n_name) FILTER (WHERE n_name LIKE '%A%') AS keys
FROM nation GROUP BY n_regionkey""")
def map_functions(t):
    """Nations of a region as a map: there are a few dozen in all."""
    m = t("nation").groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("m"))
    m = m.select("n_regionkey", F.transform_values(F.map_filter("m", lambda k, v: k.contains("A")), lambda k, v: (v + 1).cast("long")).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, v: a + v)
    return m.select("n_regionkey", F.size("m").cast("long").alias("entries"), F.when(F.size("m") > 0, total).alias("total"), F.when(F.size("m") > 0, F.array_join(F.map_keys(F.transform_keys("m", lambda k, v: F.lower(k))), ",")).alias("keys"))


@query("""
SELECT event_id, CAST(hour(ny) AS INT) AS hour_there, CAST(dayofyear(ny) AS INT) AS day_there
FROM (SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS ny FROM events)""")
def time_zones(t):
    there = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))
    return t("events").select("event_id", F.hour(there).alias("hour_there"), F.dayofyear(there).alias("day_there"))


#: Years by recursion, each with its months: the engines stop at 100 steps, which are years here.
_MONTHS = """
WITH RECURSIVE span AS (SELECT date_trunc('month', min(o_orderdate)) AS lo, date_trunc('month', max(o_orderdate)) AS hi FROM {0}),
y(d, hi) AS (SELECT lo, hi FROM span WHERE lo IS NOT NULL UNION ALL SELECT d + INTERVAL 1 YEAR, hi FROM y WHERE d + INTERVAL 1 YEAR <= hi),
m AS (%s),
n AS (SELECT date_trunc('month', o_orderdate) AS d, count(*) AS n FROM {0} GROUP BY 1)
SELECT {1} AS month, coalesce(n, 0) AS n FROM m LEFT JOIN n ON m.d = n.d""" % " UNION ALL ".join(f"SELECT d + INTERVAL {k} MONTH AS d FROM y WHERE d + INTERVAL {k} MONTH <= hi" for k in range(12))


@query(_MONTHS.format("orders", "strftime(m.d, '%Y-%m')"))
def recursive_months(t):
    """A calendar by recursion, from the first order's month to the last one's, joined with counts."""
    o = t("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    return o.sparkSession.sql(_MONTHS.format("{o}", "date_format(m.d, 'yyyy-MM')"), o=o)


@query("SELECT p_partkey, array_to_string(list_reverse(string_split(p_name, ' ')), ' ') AS name FROM part")
def scalar_udf(t):
    return t("part").select("p_partkey", ops.reversed_words("p_name").alias("name"))


@query("SELECT l_returnflag, round(exp(avg(ln(l_extendedprice))), 4) AS geometric, round(1 / avg(1 / l_extendedprice), 4) AS harmonic FROM lineitem GROUP BY l_returnflag")
def aggregate_udf(t):
    """Geometric and harmonic means by a Python aggregate whose states combine before the shuffle."""

    def partial(f):
        x = f["l_extendedprice"]
        states = f.assign(n=1, logs=np.log(x), parts=1 / x).groupby("l_returnflag", as_index=False)[["n", "logs", "parts"]].sum()
        return states

    n = F.sum("n")
    merge = {"geometric": F.round(F.exp(F.sum("logs") / n), 4), "harmonic": F.round(n / F.sum("parts"), 4)}
    return ops.aggregate(t("lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], partial, "l_returnflag string, n long, logs double, parts double", merge)


@query("SELECT p_partkey, CAST(generate_subscripts(w, 1) AS INT) AS place, unnest(w) AS word FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)")
def table_udf(t):
    return t("part").select("p_partkey", "p_name").lateralJoin(ops.Words(F.col("p_name").outer())).select("p_partkey", "place", "word")


@query("SELECT f AS format, s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier, (VALUES ('parquet'), ('orc'), ('json'), ('csv'), ('xml')) v(f)")
def format_round_trips(t):
    """Suppliers written to and read from every format, with their schema."""
    s = t("supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    found = []
    for fmt in FORMATS:
        path = scratch(s.sparkSession, f"formats-{fmt}")
        write_table(s, path, fmt)
        found.append(read_files(s.sparkSession, path, fmt, s.schema).select(F.lit(fmt).alias("format"), *s.columns))
    return reduce(DataFrame.unionByName, found)


_CLOSED = "(SELECT date_trunc('milliseconds', max(ts)) - INTERVAL 1 HOUR FROM events)"


@streaming_query(f"""
SELECT * FROM (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL)
WHERE bucket + INTERVAL 1 HOUR <= {_CLOSED}""")
def stream_window_counts(events):
    """Windows that the watermark has closed, from the event files as a stream."""
    c = st.window_counts(events)
    return c.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n", F.round("total", 4).alias("total"))


@streaming_query("""
SELECT a.user_id, a.event_id AS left_id, b.event_id AS right_id FROM events a JOIN events b
ON a.user_id = b.user_id AND a.event_type = 'view' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR""")
def stream_interval_join(events):
    """Purchases within an hour of a view, both from the event files as streams."""
    return st.interval_join(events.where("event_type = 'view'"), events.where("event_type = 'purchase'")).select("user_id", "left_id", "right_id")


@streaming_query(f"""
WITH m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 2 HOUR, true) AS b FROM events),
s AS (SELECT *, sum(CAST(b AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, s HAVING max(ts) + INTERVAL 2 HOUR <= {_CLOSED}""")
def stream_sessions(events):
    """Sessions that the watermark has closed."""
    return st.session_counts(events).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query(f"""
WITH m AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY, true) AS b FROM events),
s AS (SELECT *, sum(CAST(b AS INT)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM m)
SELECT user_id, CAST(s AS BIGINT) AS alert, max(ts) AS last_event, count(*) AS n_events, count(DISTINCT event_type) AS n_kinds FROM s
GROUP BY user_id, s HAVING max(ts) + INTERVAL 1 DAY <= {_CLOSED}""")
def stream_inactivity(t):
    """An alert for every user who is silent for a day, by state with timers; the events come in four parts with a restart after each."""
    e = t("events")
    spark, path = e.sparkSession, scratch(e.sparkSession, "inactivity")

    def run():
        with st.rocksdb(spark):
            alerts = st.inactivity(st.read_events(spark, f"{path}/events", files_per_trigger=None), 86_400)
            st.run_to_files(alerts, f"{path}/alerts")

    st.replay(e, f"{path}/events", run)
    return spark.read.parquet(f"{path}/alerts/rows").withColumn("last_event", F.col("last_event").cast("timestamp_ntz"))


@query("""
SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def stream_latest_per_user(t):
    """The last event of each user, kept by an idempotent keyed sink; after each of four parts the stream's last batch is forced to come again."""
    e = t("events")
    spark, path = e.sparkSession, scratch(e.sparkSession, "latest")
    table = st.KeyedTable(spark, f"{path}/table", ["user_id"], ["ts", "event_id"])

    def run():
        for _ in range(2):
            st.run_to_keyed_table(st.read_events(spark, f"{path}/events", files_per_trigger=None), table, f"{path}/checkpoint")
            st.forget_last_commit(spark, f"{path}/checkpoint")

    st.replay(e, f"{path}/events", run)
    return table.read().select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type", "value")


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS level, count(*) AS n, CAST(sum(user_id) AS BIGINT) AS users, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def log_lines(t):
    """All events as lines of log files, read back by a data source of the library's own."""
    e = t("events")
    spark, folder = e.sparkSession, scratch(e.sparkSession, "logs")
    write_logs(e, folder)
    register_logs(spark)
    logs = spark.read.format("lines_log").load(folder)
    return logs.groupBy("day", "level").agg(F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("users"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT event_id, ts, event_type AS level, value FROM events")
def stream_log_lines(t):
    """The log files as a stream: the first half of the month, a stop, and the rest from the offset where it stopped."""
    e = t("events")
    spark, path = e.sparkSession, scratch(e.sparkSession, "log-stream")
    register_logs(spark)
    early = F.dayofmonth("ts") <= 15
    for part in (e.where(early), e.where(~early)):
        write_logs(part, f"{path}/logs")
        lines = spark.readStream.format("lines_log").load(f"{path}/logs")
        out = st.run_to_files(lines.select("event_id", "ts", "level", "value"), f"{path}/out")
    return out


flagship = QUERIES["top_customers"]
