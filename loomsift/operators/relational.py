"""Relational operators: baseline, no reference analog."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table

#: A side of a join is sent to all tasks only up to this many rows; beyond, it is shuffled.
MOST_SENT = 1_000_000


def small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """``df`` with a broadcast hint if a count, cut off at the bound, shows that it is small."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@query("SELECT p_brand, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def rel1_broadcast_join(spark, sf_dir):
    part = small(table(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    j = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority")
def rel2_shuffled_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").hint("shuffle_hash")
    j = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_custkey, o_orderkey FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 3 = 0) ON c_custkey = o_custkey AND c_custkey % 2 = 0")
def rel3_outer_joins(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0")
    return table(spark, sf_dir, "customer").join(o, (F.col("c_custkey") == F.col("o_custkey")) & (F.col("c_custkey") % 2 == 0), "full").select("c_custkey", "o_orderkey")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000) AS has FROM customer")
def rel4_semi_anti(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"))
    c = table(spark, sf_dir, "customer").select("c_custkey")
    return c.join(big, "c_custkey", "left_semi").withColumn("has", F.lit(True)).union(c.join(big, "c_custkey", "left_anti").withColumn("has", F.lit(False)))


@query("SELECT r_name, n_name FROM region, nation WHERE r_regionkey < n_regionkey")
def rel5_theta_join(spark, sf_dir):
    return table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("r_regionkey") < F.col("n_regionkey")).select("r_name", "n_name")


@query("SELECT band, count(*) AS n FROM events JOIN (SELECT unnest(range(0, 10)) AS band) ON value >= band * 10 AND value < band * 10 + 15 GROUP BY band")
def rel6_range_join(spark, sf_dir):
    """Ranges of a known width: both sides meet in buckets by an equi join, the bounds filter."""
    bands = spark.range(10).select(F.col("id").alias("band"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 15).alias("hi"))
    bands = bands.select("*", F.explode(F.sequence(F.floor(F.col("lo") / 15), F.floor(F.col("hi") / 15))).alias("b"))
    e = table(spark, sf_dir, "events").select("value", F.floor(F.col("value") / 15).alias("b"))
    return e.join(F.broadcast(bands), "b").where("value >= lo and value < hi").groupBy("band").agg(F.count(F.lit(1)).alias("n"))


@query(
    "SELECT p.event_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts"
)
def rel7_asof_join(spark, sf_dir):
    """Last earlier view of the same user: one window over the union, no join at all."""
    e = table(spark, sf_dir, "events").where("event_type in ('purchase', 'view')")
    order = Window.partitionBy("user_id").orderBy("ts", F.col("event_type").desc(), "event_id").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), ignorenulls=True).over(order)
    return e.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "view_id")


@query("SELECT a.event_id, count(*) AS near FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 10 MINUTE AND a.ts + INTERVAL 10 MINUTE GROUP BY a.event_id")
def rel8_interval_join(spark, sf_dir):
    """Rows within ten minutes of each other: a range frame counts them, no pairs are made."""
    near = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-600_000_000, 600_000_000)
    return table(spark, sf_dir, "events").select("event_id", F.count(F.lit(1)).over(near).alias("near"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(avg(l_discount), 6) AS discount, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY ALL HAVING count(*) > 10")
def rel9_grouped_aggregates(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), F.round(F.avg("l_discount"), 6).alias("discount"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")).where("n > 10")


@query("SELECT event_type, count(*) AS n, true AS users_near, true AS median_near, true AS high_near FROM events GROUP BY event_type")
def rel10_approximate(spark, sf_dir):
    """Approximate distinct counts and quantiles, and whether they lie within their error of the exact ones."""
    users, cut = F.countDistinct("user_id"), F.percentile_approx("value", [0.5, 0.9], 10_000)
    rank = lambda q: F.count_if(F.col("value") < F.col("cut")[q]) / F.count(F.lit(1))
    events = table(spark, sf_dir, "events")
    near = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), (F.abs(F.approx_count_distinct("user_id", 0.02) - users) <= F.greatest(F.lit(1), 0.1 * users)).alias("users_near"))
    cuts = events.groupBy("event_type").agg(cut.alias("cut"))
    ranks = events.join(F.broadcast(cuts), "event_type").groupBy("event_type").agg((F.abs(rank(0) - 0.5) <= 0.01).alias("median_near"), (F.abs(rank(1) - 0.9) <= 0.01).alias("high_near"))
    return near.join(ranks, "event_type")


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) * 2 + grouping(o_orderpriority) AS BIGINT) AS gid, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def rel11_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping_id().cast("long").alias("gid"), F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderstatus, year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (year(o_orderdate)), ())")
def rel11_grouping_sets(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", F.year("o_orderdate").cast("long").alias("y"))
    return o.groupingSets([["o_orderstatus"], ["y"], []], "o_orderstatus", "y").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT user_id, kind, n FROM (SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id) UNPIVOT (n FOR kind IN (click, view)) WHERE n > 0")
def rel12_pivot_unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "view"]).count()
    return wide.unpivot("user_id", ["click", "view"], "kind", "n").where("n > 0")


@query(
    "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, CAST(ntile(4) OVER w AS BIGINT) AS nt, round(percent_rank() OVER v, 6) AS pr, round(cume_dist() OVER v, 6) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderstatus)"
)
def rel13_ranking(spark, sf_dir):
    w, v = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    n = lambda c, name: c.cast("long").alias(name)
    return table(spark, sf_dir, "orders").select("o_orderkey", n(F.row_number().over(w), "rn"), n(F.rank().over(v), "rk"), n(F.dense_rank().over(v), "dr"), n(F.ntile(4).over(w), "nt"), F.round(F.percent_rank().over(v), 6).alias("pr"), F.round(F.cume_dist().over(v), 6).alias("cd"))


@query("SELECT event_id, lag(value) OVER w AS before, lead(value, 2, -1) OVER w AS after, first_value(value) OVER w AS first, last_value(value) OVER w AS last, nth_value(value, 2) OVER w AS second FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def rel14_analytic(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("after"), F.first("value").over(w).alias("first"), F.last("value").over(w).alias("last"), F.nth_value("value", 2).over(w).alias("second"))


@query("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS s3, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING) AS near FROM orders")
def rel15_frames(spark, sf_dir):
    w = Window.partitionBy("o_custkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w.orderBy("o_orderkey").rowsBetween(-2, 0)), 2).alias("s3"), F.count(F.lit(1)).over(w.orderBy("o_totalprice").rangeBetween(-1000, 1000)).alias("near"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20 OFFSET 5")
def rel16_limit_offset(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").offset(5).limit(20)


@query("SELECT 'intersect_all' AS op, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except_all', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL SELECT 'union', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def rel17_set_operations(spark, sf_dir):
    a, b = table(spark, sf_dir, "customer").select("c_nationkey"), table(spark, sf_dir, "supplier").select("s_nationkey")
    count = lambda d, n: d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("op"), "n")
    return count(a.intersectAll(b), "intersect_all").union(count(a.exceptAll(b), "except_all")).union(count(a.union(b).distinct(), "union"))


_SUB = "SELECT c_custkey FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)"


@query(_SUB)
def rel18_subqueries(spark, sf_dir):
    names = ("customer", "orders", "nation")
    text = _SUB
    for n in names:
        text = text.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


@query("SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_diff('day', TIMESTAMP '1992-01-01', o_orderdate) AS BIGINT) AS days, CAST(CAST(o_orderdate AS DATE) + INTERVAL 3 MONTH AS DATE) AS later, CAST(quarter(o_orderdate) AS BIGINT) AS q FROM orders")
def rel19_dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_date(F.date_trunc("month", "o_orderdate")).alias("month"), F.datediff(d, F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.add_months(d, 3).alias("later"), F.quarter("o_orderdate").cast("long").alias("q"))


@query(r"SELECT p_partkey, substring(p_name, 1, 4) AS s, lpad(CAST(p_size AS VARCHAR), 4, '0') AS l, regexp_extract(p_type, '(\w+)$', 1) AS r, round(p_retailprice, 1) AS a, round(pow(p_size, 2), 2) AS b FROM part")
def rel20_strings_math(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.substring("p_name", 1, 4).alias("s"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("l"), F.regexp_extract("p_type", r"(\w+)$", 1).alias("r"), F.round("p_retailprice", 1).alias("a"), F.round(F.pow("p_size", F.lit(2)), 2).alias("b"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 4) AS norm, CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings")
def rel21_arrays(spark, sf_dir):
    square = lambda x: x.cast("double") * x.cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(F.transform("embedding", square), F.lit(0.0), lambda s, x: s + x), 4).alias("norm"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("positive"))


@query("SELECT event_id, CAST(len(json_keys(props)) AS BIGINT) AS n FROM events")
def rel22_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n"))


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def rel23_tumbling(spark, sf_dir):
    g = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


@query("SELECT s AS start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY s")
def rel23_sliding(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


@query("SELECT r_regionkey, r_name, 4 AS copies FROM region")
def rel25_formats(spark, sf_dir):
    """A table through Parquet, ORC, JSON and CSV, and back."""
    from ..sources.formats import round_trip

    out = round_trip(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["parquet", "orc", "json", "csv"])
    return out.groupBy("r_regionkey", "r_name").agg(F.count(F.lit(1)).cast("int").alias("copies"))


@query("SELECT p_brand, round(avg(p_retailprice) * 2, 4) AS twice FROM part GROUP BY p_brand")
def rel26_user_functions(spark, sf_dir):
    """An Arrow function from column to column; built-ins would do, this shows the registration."""
    @F.pandas_udf("double")
    def double(x: pd.Series) -> pd.Series:
        return x * 2

    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("m")).select("p_brand", F.round(double("m"), 4).alias("twice"))
