"""Event streams: batch forms of stateful rules, and Structured Streaming on the same code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.formats import scratch
from ..sources.tables import table


def stream(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int = 1) -> DataFrame:
    """A table's file as a stream, with an event time that watermarks accept."""
    path = f"{sf_dir}/{name}.parquet"
    kind = spark.read.parquet(path).schema
    df = spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet").parquet(path if not path.endswith(".parquet") else f"{sf_dir}/{name}.parquet*")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums per window and type; rows later than ``late`` are left out in a stream
    (baseline, no reference analog)."""
    seen = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    return seen.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def run_to_table(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and return the rows that it gave out."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def debounced(events: DataFrame, key: str = "user_id", path: str = "event_type", gap: str = "30 minutes") -> DataFrame:
    """key, start, n, paths: events that follow one another within a quiet time, each path once."""
    g = events.groupBy(key, F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set(path)), ",").alias("paths"))
    return g.select(key, F.col("session_window.start").alias("start"), "n", "paths")


@query(
    "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM g) "
    "SELECT user_id, min(ts) AS start, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, s"
)
def e4_debounce(spark, sf_dir):
    return debounced(table(spark, sf_dir, "events"))


@query("SELECT user_id, event_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS gap, greatest(0, CAST(date_diff('millisecond', lag(ts) OVER (PARTITION BY user_id ORDER BY event_id), ts) AS BIGINT)) AS ms FROM events")
def e2_pairing(spark, sf_dir):
    """Gap and time since the event before of the same shell (E1, E2, F2); never negative."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    took = F.greatest(F.lit(0), F.coalesce(ms - F.lag(ms).over(w), F.lit(0)))
    return table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") - F.lag("event_id").over(w)).alias("gap"), took.alias("ms"))


# Commands whose output belongs to a terminal, and what prints secrets.
INTERACTIVE = [
    "vim", "nvim", "vi", "emacs", "nano", "less", "more", "man", "ssh", "sftp", "scp", "mosh", "top", "htop", "btop", "watch",
    "fzf", "sk", "tmux", "screen", "node", "python", "python3", "ruby", "irb", "lua", "julia", "mysql", "psql", "sqlite3", "redis-cli", "mongosh",
]
REVEALING = [r"^\s*(env|printenv)(\s|$)", r"^\s*security\s+find-.*password", r"^\s*(op|pass)\s+.*(show|get)", r"^\s*gcloud\s+auth\s+print-access-token", r"^\s*aws\s+configure\s+get"]
# Inputs: commands by event number, with {} for the user.
OBSERVED = [
    "vim notes{}", "ls -la", "  env", "printenv PATH", "environment", "python3 x.py {}", "python4", "git push", "security find-generic-password -a {}", "op item get {}", "pass show x", "pass", "gcloud auth print-access-token", "gcloud auth login", " aws configure get region", "aws configure list",
    "sudo vim x", "redis-cli", "redis-cli-x", "less", "", "man {}", "cat more", "ssh host{}", "env -i x",
]


def observed_status(command: Column) -> Column:
    """``excluded`` where the first word is interactive or a pattern tells of secrets; the event is given out all the same."""
    out = F.split_part(F.btrim(command), F.lit(" "), F.lit(1)).isin(INTERACTIVE)
    for p in REVEALING:
        out = out | command.rlike(p)
    return F.when(out, "excluded").otherwise("captured")


@query(
    f"WITH c AS (SELECT event_id, replace([{', '.join(repr(c) for c in OBSERVED)}][event_id % {len(OBSERVED)} + 1], '{{}}', CAST(user_id AS VARCHAR)) AS command FROM events) "
    r"SELECT event_id, command, CASE WHEN regexp_matches(command, '^ *(vim|nvim|vi|emacs|nano|less|more|man|ssh|sftp|scp|mosh|top|htop|btop|watch|fzf|sk|tmux|screen|node|python|python3|ruby|irb|lua|julia|mysql|psql|sqlite3|redis-cli|mongosh)( |$)') "
    r"OR regexp_matches(command, '^\s*((env|printenv)(\s|$)|security\s+find-.*password|(op|pass)\s+.*(show|get)|gcloud\s+auth\s+print-access-token|aws\s+configure\s+get)') THEN 'excluded' ELSE 'captured' END AS capture FROM events JOIN c USING (event_id)"
)
def e3_exclusion(spark, sf_dir):
    """Whether a command's output is captured, for commands of every kind."""
    chosen = F.element_at(F.array(*map(F.lit, OBSERVED)), (F.col("event_id") % len(OBSERVED) + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.replace(chosen, F.lit("{}"), F.col("user_id").cast("string")).alias("command"))
    return rows.withColumn("capture", observed_status(F.col("command")))


@query("SELECT event_id, coalesce(ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) <= INTERVAL 1 HOUR, false) AS hit FROM events")
def e8_ttl(spark, sf_dir):
    """A cache entry put by the event before is still valid within an hour (E8); the cache itself is ``e8_ttl_cache``."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(micros - F.lag(micros).over(w) <= 3_600_000_000, F.lit(False)).alias("hit"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 50")
def e10_recent(spark, sf_dir):
    k = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return table(spark, sf_dir, "events").select("user_id", "event_id", k.alias("k")).where("k <= 50").drop("k")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS context, count(*) AS n FROM events GROUP BY user_id")
def e11_latest_context(spark, sf_dir):
    """Latest context per shell (E11), and a progress counter."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("context"), F.count(F.lit(1)).alias("n"))


def lru_hits(keys: list, sizes: list[int], times: list[float], most_entries: int, most_bytes: int, ttl: float) -> list[bool]:
    """Hits of a cache with bounded entries, bytes and age, in the order of requests."""
    from collections import OrderedDict

    held: OrderedDict = OrderedDict()
    total, out = 0, []
    for key, size, now in zip(keys, sizes, times, strict=True):
        hit = key in held and now - held[key][1] <= ttl
        if hit:
            held.move_to_end(key)
        else:
            total -= held.pop(key, (0, 0))[0]
            held[key] = (size, now)
            total += size
            while held and (len(held) > most_entries or total > most_bytes):
                total -= held.popitem(last=False)[1][0]
        out.append(hit)
    return out


@query(
    "WITH RECURSIVE b AS MATERIALIZED (SELECT user_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), l AS (SELECT user_id, list(event_type ORDER BY n) AS l FROM b GROUP BY user_id), "
    "d AS (SELECT *, lag(n) OVER (PARTITION BY user_id, event_type ORDER BY n) AS n0 FROM b), "
    # Entries are equal in size and two fit, so a key is held if at most one other was asked for since it was.
    "r AS (SELECT d.*, n0 IS NOT NULL AND len(list_distinct(l[n0 + 1:n - 1])) <= 1 AS held FROM d JOIN l USING (user_id)), s AS (SELECT *, sum(CASE WHEN held THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, event_type ORDER BY n) AS seg FROM r), "
    "o AS MATERIALIZED (SELECT event_id, ts, user_id || ':' || event_type || ':' || seg AS key, row_number() OVER (PARTITION BY user_id, event_type, seg ORDER BY n) AS k FROM s), "
    "p(key, k, put) AS (SELECT key, k, ts FROM o WHERE k = 1 UNION ALL SELECT o.key, min(o.k), arg_min(o.ts, o.k) FROM p JOIN o ON o.key = p.key AND o.k > p.k AND o.ts > p.put + INTERVAL 1 DAY GROUP BY o.key) "
    "SELECT event_id, p.k IS NULL AS hit FROM o LEFT JOIN p ON o.key = p.key AND o.k = p.k"
)
def e9_lru_cache(spark, sf_dir):
    """event_id, hit per user: a sequential fold in order of time."""
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"])
        hits = lru_hits(list(pdf.event_type), [10] * len(pdf), [t.timestamp() for t in pdf.ts], 3, 25, 86_400)
        return pd.DataFrame({"event_id": pdf.event_id, "hit": hits})

    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts").groupBy("user_id").applyInPandas(run, "event_id long, hit boolean")


@query(
    "WITH d AS (SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) SELECT * FROM d WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
)
def rel24_stream_windows(spark, sf_dir):
    """Windows that a stream over the events has closed: watermark, duplicates dropped, late rows left out."""
    base = scratch(spark, "windows")
    counts = windowed_counts(stream(spark, sf_dir)).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
    q = counts.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(counts.schema).parquet(f"{base}/rows")


def observed_events(events: DataFrame) -> DataFrame:
    """user_id, seq, event (JSON): a command's start paired with the prompt after it, as a shell reports them.

    The next event of the same shell ends a command; the last one has not ended."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    rows = events.withColumn("seq", F.row_number().over(w).cast("long")).withColumn("took", F.lead(ms).over(w) - ms).where("took is not null")
    body = F.struct(F.lit("observed_command").alias("type"), F.col("user_id").cast("string").alias("shell_id"), "seq", F.col("event_type").alias("command"), F.greatest("took", F.lit(0)).alias("duration_ms"), (F.col("event_id") % 3).cast("long").alias("exit_code"))
    return rows.select("user_id", "seq", F.to_json(body).alias("event"))


@query(
    "WITH s AS (SELECT user_id, event_id, event_type, row_number() OVER w AS seq, epoch_us(lead(ts) OVER w) // 1000 - epoch_us(ts) // 1000 AS took FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) "
    "SELECT user_id, seq, CAST(user_id AS VARCHAR) AS shell_id, event_type AS command, greatest(took, 0) AS duration_ms, event_id % 3 AS exit_code FROM s WHERE took IS NOT NULL"
)
def s17_observed_commands(spark, sf_dir):
    """Observed commands, written as JSON events and read again."""
    read = F.from_json("event", "shell_id string, command string, duration_ms long, exit_code long")
    return observed_events(table(spark, sf_dir, "events")).select("user_id", "seq", read.alias("e")).select("user_id", "seq", "e.*")


def coalesced(events: DataFrame, every: str, key: str, *latest: str) -> DataFrame:
    """key, start, changes and the latest values: at most one write per key and span, as a stream with a
    trigger of that span does it."""
    of = F.window("ts", every)
    last = F.max_by(F.struct(*latest), F.struct("ts", "event_id")).alias("last")
    return events.groupBy(key, of.alias("_w")).agg(F.count(F.lit(1)).alias("changes"), last).select(key, F.col("_w.start").alias("start"), "changes", "last.*")


@query("SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS start, count(*) AS changes, arg_max(user_id, (ts, event_id)) AS user_id FROM events GROUP BY ALL")
def e7_coalesced_writes(spark, sf_dir):
    return coalesced(table(spark, sf_dir, "events"), "6 hours", "event_type", "user_id")


@query("SELECT event_id, make_timestamp(epoch_us(ts) // 1000 * 1000) AS at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seconds FROM events")
def f3_millis(spark, sf_dir):
    """Milliseconds since the epoch as timestamps."""
    at = F.timestamp_millis(F.unix_millis(F.col("ts").cast("timestamp")))
    return table(spark, sf_dir, "events").select("event_id", at.cast("timestamp_ntz").alias("at"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("seconds"))
