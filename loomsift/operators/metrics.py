"""Hit rates, percentiles, gates and set operations over results."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import COMMANDS_SQL, shell_commands, table


def nearest_rank(values: Column, p: float) -> Column:
    """Element ``round((n - 1) * p)`` of sorted values; no interpolation."""
    return F.element_at(F.sort_array(values), (F.floor((F.size(values) - 1) * p + 0.5) + 1).cast("int"))


def exact_percentiles(df, group: str, value: str, ps: list[float]):
    """group and a column per p, without gathering a group in one place: values are counted first, and
    the count of smaller ones places each."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(group))
    placed = counts.withColumn("upto", upto).withColumn("total", total)
    picks = [F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * p + 0.5), F.col(value))).alias(f"p{round(p * 100)}") for p in ps]
    return placed.groupBy(group).agg(*picks, F.min(value).alias("least"), F.max(value).alias("most"))


@query("SELECT event_type, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS INT) + 1] AS p50, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS INT) + 1] AS p95, min(value) AS least, max(value) AS most FROM events GROUP BY event_type")
def t2_percentiles(spark, sf_dir):
    return exact_percentiles(table(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.95])


@query(
    "WITH r AS (SELECT user_id % 5 AS category, value > 50 AS passed, event_id % 3 = 0 AS hit FROM events) SELECT CAST(category AS BIGINT) AS category, count(*) AS n, count(*) FILTER (passed) AS passed, round(coalesce(count(*) FILTER (hit) / nullif(count(*), 0), 0), 6) AS hit_rate FROM r GROUP BY ROLLUP (category)"
)
def t1_hit_rates(spark, sf_dir):
    """Per category and in total; nothing over nothing is 0."""
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("category"), (F.col("value") > 50).alias("passed"), (F.col("event_id") % 3 == 0).alias("hit"))
    rate = F.coalesce(F.try_divide(F.count_if("hit"), F.count(F.lit(1))), F.lit(0.0))
    return rows.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("passed"), F.round(rate, 6).alias("hit_rate"))


@query("WITH m AS (SELECT unnest(['a', 'b']) AS stage, unnest([value, value * 2]) AS ms FROM events) SELECT stage, count(*) AS n, round(avg(ms), 4) AS mean, round(max(ms), 4) AS most FROM m GROUP BY stage")
def t4_stage_stats(spark, sf_dir):
    stages = F.create_map(F.lit("a"), F.col("value"), F.lit("b"), F.col("value") * 2)
    rows = table(spark, sf_dir, "events").select(F.explode(stages).alias("stage", "ms"))
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("ms"), 4).alias("mean"), F.round(F.max("ms"), 4).alias("most"))


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(value), 4) AS mean, round(count(*) / 30.0, 6) AS per_day FROM events GROUP BY event_type")
def t5_median_and_throughput(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 4).alias("mean"), F.round(F.count(F.lit(1)) / 30.0, 6).alias("per_day"))


@query(
    "WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank, source FROM documents) SELECT source, min(rank) AS best_rank, min(rank) <= 5 AS hit FROM l WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source"
)
def t6_best_rank(spark, sf_dir):
    """Best rank of a relevant row per query (here: source)."""
    ranked = table(spark, sf_dir, "documents").select("doc_id", "source", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")).cast("long").alias("rank"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return ranked.join(good, "doc_id", "left_semi").groupBy("source").agg(F.min("rank").alias("best_rank")).withColumn("hit", F.col("best_rank") <= 5)


# Gates (metric, hardware, most p50, most p95, least minimum); null: no limit.
GATES = [("click", None, 40.0, 95.0, None), ("view", None, 60.0, 99.0, 0.5), ("view", "big", 30.0, None, None), ("absent", None, 1.0, 1.0, None)]


@query(
    "WITH g(metric, hw, p50, p95, least) AS (VALUES ('click', NULL, 40.0, 95.0, NULL), ('view', NULL, 60.0, 99.0, 0.5), ('view', 'big', 30.0, NULL, NULL), ('absent', NULL, 1.0, 1.0, NULL)), "
    "e AS (SELECT b.metric, coalesce(o.p50, b.p50) AS p50, coalesce(o.p95, b.p95) AS p95, coalesce(o.least, b.least) AS least FROM g b LEFT JOIN g o ON o.metric = b.metric AND o.hw = 'big' WHERE b.hw IS NULL), "
    "s AS (SELECT event_type AS metric, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS INT) + 1] AS v50, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.95 + 0.5) AS INT) + 1] AS v95, min(value) AS v0 FROM events GROUP BY event_type) "
    "SELECT metric, concat_ws(',', CASE WHEN v50 IS NULL THEN 'missing' END, CASE WHEN v50 > p50 THEN 'p50' END, CASE WHEN v95 > p95 THEN 'p95' END, CASE WHEN v0 < least THEN 'least' END) AS violations FROM e LEFT JOIN s USING (metric)"
)
def t7_gates(spark, sf_dir):
    """Limits, overridden for one class of hardware (T8), against measured values; none at all violates."""
    gates = spark.createDataFrame(GATES, "metric string, hw string, p50 double, p95 double, least double")
    base, own = gates.where("hw is null").drop("hw"), gates.where("hw = 'big'").select("metric", F.struct("p50", "p95", "least").alias("o"))
    limits = base.join(own, "metric", "left").select("metric", *[F.coalesce(F.col(f"o.{c}"), c).alias(c) for c in ("p50", "p95", "least")])
    got = exact_percentiles(table(spark, sf_dir, "events"), "event_type", "value", [0.5, 0.95]).select(F.col("event_type").alias("metric"), F.col("p50").alias("v50"), F.col("p95").alias("v95"), F.col("least").alias("v0"))
    bad = [F.when(F.col("v50").isNull(), "missing"), F.when(F.col("v50") > F.col("p50"), "p50"), F.when(F.col("v95") > F.col("p95"), "p95"), F.when(F.col("v0") < F.col("least"), "least")]
    return F.broadcast(limits).join(got, "metric", "left").select("metric", F.concat_ws(",", *bad).alias("violations"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)^[a-z]+ the') OR regexp_matches(text, '\d{3}') AS any_regex, contains(text, 'the') AND contains(text, 'on') AS all_parts, regexp_matches(text, '(?s)the.*and.*on') AS in_order FROM documents")
def t9_expectations(spark, sf_dir):
    """Any expression, all parts, parts in order."""
    def ordered(parts: list[str]) -> Column:
        at = F.lit(1)
        for p in parts:
            found = F.call_function("position", F.lit(p), F.col("text"), at)
            at = F.when((at > 0) & (found > 0), found + len(p)).otherwise(0)
        return at > 0

    return table(spark, sf_dir, "documents").select(
        "doc_id", (F.col("text").rlike("(?i)^[a-z]+ the") | F.col("text").rlike(r"\d{3}")).alias("any_regex"), (F.contains("text", F.lit("the")) & F.contains("text", F.lit("on"))).alias("all_parts"), ordered(["the", "and", "on"]).alias("in_order")
    )


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents) WHERE k <= 3")
def o4_last_n(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("doc_id")))
    return table(spark, sf_dir, "documents").select("source", "doc_id", k.alias("k")).where("k <= 3").drop("k")


@query("(SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier) UNION ALL (SELECT c_nationkey, 'left' FROM customer EXCEPT SELECT s_nationkey, 'left' FROM supplier) UNION ALL (SELECT s_nationkey, 'right' FROM supplier EXCEPT SELECT c_nationkey, 'right' FROM customer)")
def o7_set_sync(spark, sf_dir):
    """What two sets share and what each has alone."""
    a, b = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    named = lambda d, n: d.withColumn("side", F.lit(n))
    return named(a.intersect(b), "both").union(named(a.subtract(b), "left")).union(named(b.subtract(a), "right"))


@query("SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS lines FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)) WHERE k = 1 GROUP BY doc_id")
def o10_ordered_dedup(spark, sf_dir):
    """First of equal lines of a document, in order: inside the row, without a shuffle."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_distinct(F.split("text", "\n")), "\n").alias("lines"))


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS f1, greatest(0, CAST(value AS BIGINT) - 50) AS f6, CAST(ceil(value / 1000) AS BIGINT) AS f5, round(ln(1 + value), 6) AS f4, sha256(event_type) AS f7, base64(encode(event_type)) AS f8, trim(regexp_replace('  ' || event_type || '   x ', '\\s+', ' ', 'g')) AS f11 FROM events"
)
def f1_scalars(spark, sf_dir):
    """Date, clamp, ceiling, logarithm, digest, base64 and collapse."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("f1"), F.greatest(F.lit(0), F.rint("value").cast("long") - 50).alias("f6"), F.ceil(F.col("value") / 1000).cast("long").alias("f5"), F.round(F.log1p("value"), 6).alias("f4"),
        F.sha2(F.col("event_type").cast("binary"), 256).alias("f7"), F.base64(F.col("event_type").cast("binary")).alias("f8"), F.trim(F.regexp_replace(F.concat(F.lit("  "), "event_type", F.lit("   x ")), r"\s+", " ")).alias("f11"),
    )


def lookahead_match(subject: Column, blocked: str, tail: str) -> Column:
    """``^(?!.*\\bblocked\\b).*tail``: the blocked word nowhere in any case, and the tail found."""
    return ~F.contains(F.lower(subject), F.lit(blocked.lower())) & F.rlike(subject, F.lit(tail))


@query(f"WITH {COMMANDS_SQL} SELECT cmd_id, NOT contains(lower(command), 'sudo') AND regexp_matches(command, '(rm|chmod) -') AS matched FROM shell_commands")
def t10_lookahead(spark, sf_dir):
    return shell_commands(spark, sf_dir).select("cmd_id", lookahead_match(F.col("command"), "SUDO", "(rm|chmod) -").alias("matched"))


@query(
    "WITH v AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS ms FROM events), l AS (SELECT event_type, list_sort(list(ms)) AS l, round_even(median(ms), 0)::BIGINT AS p50, round_even((count(*) - 1) * 0.95::DOUBLE, 0)::BIGINT AS i FROM v GROUP BY event_type) "
    "SELECT event_type, 'p50=' || p50 || ' ms, p95=' || l[i + 1] || ' ms, max=' || l[-1] || ' ms' AS summary FROM l"
)
def t11_latency_summary(spark, sf_dir):
    """Median, value at the rounded index of 95 % and maximum in a line; halves round to even.  Values
    are counted before they are placed, so no group is gathered."""
    ms = table(spark, sf_dir, "events").select("event_type", F.floor("value").cast("long").alias("ms"))
    counts = ms.groupBy("event_type", "ms").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("event_type")
    placed = counts.withColumn("upto", F.sum("n").over(by.orderBy("ms").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(by))
    value_at = lambda i: F.min(F.when(F.col("upto") > i, F.col("ms")))
    last = F.col("total") - 1
    g = placed.groupBy("event_type").agg(value_at(F.floor(last / 2)).alias("a"), value_at(F.ceil(last / 2)).alias("b"), value_at(F.bround(last * F.lit(0.95))).alias("p95"), F.max("ms").alias("most"))
    p50 = F.bround((F.col("a") + F.col("b")) / 2).cast("long")
    return g.select("event_type", F.concat(F.lit("p50="), p50.cast("string"), F.lit(" ms, p95="), F.col("p95").cast("string"), F.lit(" ms, max="), F.col("most").cast("string"), F.lit(" ms")).alias("summary"))


def markdown_cell(c: Column) -> Column:
    """Text for a cell of a Markdown table; null is empty."""
    return F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


@query(
    "SELECT doc_id, replace(replace(source || '|' || left(text, 60), '|', chr(92) || '|'), chr(10), '<br>') AS cell FROM documents JOIN labels USING (doc_id) WHERE quality = 0 ORDER BY doc_id LIMIT 50"
)
def t12_failures(spark, sf_dir):
    """The first 50 failures (here: rows of low quality) as cells of a report."""
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id")
    rows = table(spark, sf_dir, "documents").join(bad, "doc_id").orderBy("doc_id").limit(50)
    return rows.select("doc_id", markdown_cell(F.concat(F.col("source"), F.lit("|"), F.substring("text", 1, 60))).alias("cell"))


@query("SELECT source, round(avg(n_chars), 4) AS mean, round(count(*) / (sum(n_chars) / 1000.0), 6) AS per_second, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY source")
def t13_sizes_and_rates(spark, sf_dir):
    """Mean of samples (T13), chunks by elapsed time (T14) and bytes in a folder (T15), per source."""
    g = table(spark, sf_dir, "documents").groupBy("source")
    return g.agg(F.round(F.avg("n_chars"), 4).alias("mean"), F.round(F.try_divide(F.count(F.lit(1)), F.sum("n_chars") / 1000.0), 6).alias("per_second"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
