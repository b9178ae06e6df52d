"""Stateful streams: sequences of shells and caches with an age limit, and an index that follows a stream of changes."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..functions.text import tokens, tokens_sql
from ..registry import query
from ..sources.formats import scratch
from ..sources.tables import table

#: State of these operators is kept by RocksDB.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Robots files are kept for so many seconds at least.
ROBOTS_FLOOR = 60


@contextlib.contextmanager
def _state_store(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def replayed(df: DataFrame, name: str, parts: int, by: Column) -> Iterator[DataFrame]:
    """``df`` as a log that grows: rows for which ``by`` is 0, 1, ... are written one part after the other, and a stream over
    what is there is given out after each.  A query that goes on from its checkpoint takes each part as one micro-batch."""
    spark = df.sparkSession
    base = scratch(spark, name)
    for k in range(parts):
        df.where(by == k).write.parquet(f"{base}/part={k:04d}")
        yield spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").parquet(base)


def drained(streams: Iterable[DataFrame], operator: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Run ``operator`` over each stream until it is drained, going on from the same checkpoint, into a table of the shared
    folder, and read that."""
    base, out = None, None
    for stream in streams:
        out = operator(stream)
        base = base or scratch(out.sparkSession, name)
        with _state_store(out.sparkSession):
            q = out.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination()
    return out.sparkSession.read.schema(out.schema).parquet(f"{base}/rows")


class Sequences(StatefulProcessor):
    """Numbers that a shell's reports miss: the state is the last number seen."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = pd.concat(list(rows)).sort_values("seq")  # one shell's reports of one micro-batch
        last, missing = (self.last.get()[0] if self.last.exists() else 0), []
        for seq in pdf.seq.tolist():
            missing.append(seq - last - 1 if seq > last else -1)
            last = max(last, seq)
        self.last.update((last,))
        yield pd.DataFrame({"user_id": pdf.user_id.to_numpy(), "seq": pdf.seq.to_numpy(), "missing": missing})

    def close(self) -> None:
        pass


def sequence_gaps(reports: DataFrame) -> DataFrame:
    """user_id, seq, missing of a stream of reports (user_id, seq): how many numbers are missing before each; -1 for one
    that comes late or twice."""
    return reports.groupBy("user_id").transformWithStateInPandas(Sequences(), "user_id long, seq long, missing long", outputMode="Append", timeMode="None")


def sequence_gaps_batch(reports: DataFrame) -> DataFrame:
    last = F.coalesce(F.lag("seq").over(Window.partitionBy("user_id").orderBy("seq")), F.lit(0))
    return reports.select("user_id", "seq", (F.col("seq") - last - 1).alias("missing"))


#: Groups of keys that a cache's state is kept in.
CACHE_GROUPS = 256


def _folded(rows: pd.DataFrame, keys: list[str], held: dict[tuple, tuple[int, int]]) -> np.ndarray:
    """Hits of requests in the order of key, time and id: one finds its key's entry while that isn't older than the request's age
    limit, else it puts a new one.  ``held`` (put and limit of a key's entry, in microseconds) is brought up to date."""
    hits, own, put, limit = np.zeros(len(rows), bool), None, None, None
    of = zip(*[rows[k].tolist() for k in keys])
    for i, (key, at, age) in enumerate(zip(of, rows["_at"].tolist(), (rows.ttl.to_numpy(np.int64) * 1_000_000).tolist())):
        if key != own:
            if own is not None:
                held[own] = put, limit
            own, put = key, held.get(key, (None,))[0]
        if put is not None and at - put <= age:
            hits[i] = True
        else:
            put = at
        limit = put + age
    if own is not None:
        held[own] = put, limit
    return hits


class Cache(StatefulProcessor):
    """An entry per key that a request finds while it isn't older than the request's age limit; else the request puts
    a new one.  The keys of a group share one state, which is read and written once per micro-batch, and a timer, which takes
    entries away once event time has passed their limits."""

    def __init__(self, keys: list[str]) -> None:
        self.keys = keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "entries binary")

    def _read(self) -> dict[tuple, tuple[int, int]]:
        if not self.held.exists():
            return {}
        t = pa.ipc.open_stream(self.held.get()[0]).read_all().to_pydict()
        return dict(zip(zip(*[t[k] for k in self.keys]), zip(t["_put"], t["_limit"])))

    def _write(self, held: dict[tuple, tuple[int, int]], since: int) -> None:
        """Keep entries whose limit isn't before ``since`` (milliseconds), and wake up when the first of them ends."""
        live = {k: v for k, v in held.items() if v[1] >= since * 1000}
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if not live:
            self.held.clear()
            return
        columns = [pa.array(c) for c in (*zip(*live), *zip(*live.values()))]
        sink = pa.BufferOutputStream()
        t = pa.table(columns, names=[*self.keys, "_put", "_limit"])
        with pa.ipc.new_stream(sink, t.schema) as out:
            out.write_table(t)
        self.held.update((sink.getvalue().to_pybytes(),))
        self.handle.registerTimer(max(min(v[1] for v in live.values()) // 1000, since) + 1)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        pdf = pd.concat(list(rows))  # one group's requests of one micro-batch
        pdf["_at"] = pdf.ts.astype("datetime64[us]").astype("int64")
        pdf, held = pdf.sort_values([*self.keys, "_at", "event_id"]), self._read()
        hits = _folded(pdf, self.keys, held)
        self._write(held, max(timerValues.getCurrentWatermarkInMs(), 0))
        yield pd.DataFrame({"event_id": pdf.event_id.to_numpy(), "hit": hits})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self._write(self._read(), max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()))
        yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "hit": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def cache_hits(requests: DataFrame, *keys: str, late: str = "1 hour") -> DataFrame:
    """event_id, hit of a stream of requests (keys, event_id, ts, ttl in seconds)."""
    grouped = requests.withWatermark("ts", late).withColumn("_group", F.pmod(F.xxhash64(*keys), F.lit(CACHE_GROUPS))).groupBy("_group")
    return grouped.transformWithStateInPandas(Cache(list(keys)), "event_id long, hit boolean", outputMode="Append", timeMode="EventTime")


def cache_hits_batch(requests: DataFrame, *keys: str) -> DataFrame:
    """The same over a table: each key's requests, which the fold takes in the order of time."""

    def step(s: Column, r: Column) -> Column:
        hit = s["put"].isNotNull() & (r["at"] - s["put"] <= r["ttl"] * 1_000_000)
        return F.struct(F.when(hit, s["put"]).otherwise(r["at"]).alias("put"), F.when(hit, s["hits"]).otherwise(F.array_append(s["hits"], r["event_id"])).alias("hits"))

    micros = F.unix_micros("ts")
    every = requests.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(micros.alias("at"), "event_id", F.col("ttl").cast("long").alias("ttl")))).alias("r"))
    begin = F.struct(F.lit(None).cast("long").alias("put"), F.array().cast("array<bigint>").alias("hits"))
    puts = F.aggregate("r", begin, step, lambda s: s["hits"])
    return every.select("r", puts.alias("puts")).select(F.explode("r").alias("r"), "puts").select(F.col("r.event_id").alias("event_id"), (~F.array_contains("puts", F.col("r.event_id"))).alias("hit"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _days(events: DataFrame, parts: int) -> Column:
    """Which of ``parts`` spans of equal length an event falls in."""
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    return F.least(F.floor((F.unix_micros("ts") - F.lit(low)) * parts / F.lit(max(high - low, 1))), F.lit(parts - 1))


@query(
    "WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) SELECT user_id, seq, seq - coalesce(lag(seq) OVER (PARTITION BY user_id ORDER BY seq), 0) - 1 AS missing FROM s WHERE event_id % 7 <> 0"
)
def e1_sequence_gaps(spark, sf_dir):
    """Reports of every shell as a stream of three micro-batches, some lost on the way: what is missing before each."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    events = _events(spark, sf_dir)
    reports = events.select("user_id", "event_id", "ts", seq.alias("seq")).where("event_id % 7 <> 0")
    reports = reports.select("user_id", "seq", _days(events, 3).cast("int").alias("part"))
    return drained(replayed(reports, "reports", 3, F.col("part")), sequence_gaps, "gaps")


def _cache_sql(key: str, ttl: str) -> str:
    """Puts of each key one after the other: the first request, then the first one that the last put is too old for."""
    return (
        f"WITH RECURSIVE r AS MATERIALIZED (SELECT {key} AS key, {ttl} AS ttl, ts, event_id FROM events), o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, event_id) AS n FROM r), "
        "p(key, n, put, ttl) AS (SELECT key, n, ts, ttl FROM o WHERE n = 1 UNION ALL SELECT o.key, min(o.n), arg_min(o.ts, o.n), any_value(o.ttl) FROM p JOIN o ON o.key = p.key AND o.n > p.n AND o.ts > p.put + to_seconds(p.ttl) GROUP BY o.key) "
        "SELECT event_id, p.n IS NULL AS hit FROM o LEFT JOIN p ON o.key = p.key AND o.n = p.n"
    )


@query(_cache_sql("user_id || ':' || event_type", "3600 * 24"))
def e8_ttl_cache(spark, sf_dir):
    """A cache per shell and type with lazy expiry, as a stream of four micro-batches."""
    events = _events(spark, sf_dir)
    requests = events.select("user_id", "event_type", "event_id", "ts", F.lit(86_400).alias("ttl"), _days(events, 4).cast("int").alias("part"))
    return drained(replayed(requests, "requests", 4, F.col("part")), lambda s: cache_hits(s, "user_id", "event_type"), "hits")


def robots_ttl(configured: Column) -> Column:
    return F.greatest(configured, F.lit(ROBOTS_FLOOR))


@query(_cache_sql("user_id % 20", "greatest(CASE WHEN user_id % 20 < 10 THEN 5 ELSE 40000 END, 60)"))
def e13_robots_cache(spark, sf_dir):
    """Robots files by origin, kept for a configured time but for ``ROBOTS_FLOOR`` seconds at least, as a stream."""
    events = _events(spark, sf_dir)
    origin = F.col("user_id") % 20
    ttl = robots_ttl(F.when(origin < 10, 5).otherwise(40_000))
    requests = events.select(F.concat(F.lit("https://h"), origin, F.lit(".example")).alias("origin"), "event_id", "ts", ttl.alias("ttl"), _days(events, 2).cast("int").alias("part"))
    return drained(replayed(requests, "robots", 2, F.col("part")), lambda s: cache_hits(s, "origin"), "fetched")


def coalesced_writes(changes: DataFrame, path: str, key: str, order: list[str], every: str = "30 seconds") -> StreamingQuery:
    """Start a query that persists a stream of changes with one write per ``every`` at most (E7): of all that came meanwhile
    each key's last row by ``order``.  A write that is done again replaces itself."""
    columns = changes.columns

    def write(batch: DataFrame, number: int) -> None:
        last = batch.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("last"))
        last.select("last.*").write.mode("overwrite").parquet(f"{path}/write={number}")

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}-state").trigger(processingTime=every).start()


def persisted(spark: SparkSession, schema: StructType, path: str, key: str, order: list[str]) -> DataFrame:
    """What ``coalesced_writes`` holds: each key's last row over all writes."""
    rows = spark.read.schema(schema).parquet(path)
    last = rows.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*schema.names), F.struct(*order)).alias("last"))
    return last.select("last.*")


class IndexFollower:
    """An index on disk that follows batches of changes (path, size, mtime, removed, text).

    A batch appends what it changes under its own number: postings and entries of what is new, tombstones of what is
    replaced or gone, and the events.  So a batch that is run again writes the same files again.  Once the
    tombstoned entries are more than ``share`` of all, the live rows are written anew as a generation of
    their own, and a reader goes by the generation that the newest marker names."""

    def __init__(self, spark: SparkSession, root: str, share: float = 0.2) -> None:
        self.spark, self.root, self.share = spark, root.rstrip("/"), share

    KINDS = {
        "entries": "path string, version long, size long, mtime long",
        "postings": "path string, version long, token string",
        "tombstones": "path string, version long",
        "events": "batch long, change string, path string",
    }

    def _exists(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def generation(self) -> int:
        """The batch from which the current generation starts."""
        if not self._exists(f"{self.root}/generations"):
            return -1
        return self.spark.read.schema("start long").json(f"{self.root}/generations").agg(F.max("start")).first()[0]

    def _read(self, kind: str, since: int) -> DataFrame:
        schema = self.KINDS[kind]
        if not self._exists(f"{self.root}/{kind}"):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, part long").parquet(f"{self.root}/{kind}")
        return (rows.where(F.col("part") >= since) if kind != "events" else rows).drop("part")

    def live(self, kind: str) -> DataFrame:
        """Rows of entries or postings that no tombstone of the current generation covers."""
        since = self.generation()
        return self._read(kind, since).join(self._read("tombstones", since), ["path", "version"], "left_anti")

    def events(self) -> DataFrame:
        return self._read("events", -1)

    def _write(self, df: DataFrame, kind: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{kind}/part={batch}")

    def apply(self, changes: DataFrame, batch: int) -> None:
        """One micro-batch: of several changes of a path the last one counts."""
        number = 2 * batch  # an odd part is a compaction
        last = changes.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("mtime"), F.desc("size")))).where("k = 1").drop("k")
        held = self._current(number).select("path", "version", F.struct("size", "mtime").alias("was"))
        both = last.join(held, "path", "left")
        now = F.struct("size", "mtime")
        change = F.when(F.col("removed"), F.when(F.col("was").isNotNull(), "removed")).when(F.col("was").isNull(), "added").when(~F.col("was").eqNullSafe(now), "updated")
        both = both.withColumn("change", change).where("change is not null").persist()
        fresh = both.where("change <> 'removed'")
        self._write(both.select(F.lit(batch).cast("long").alias("batch"), "change", "path"), "events", number)
        self._write(both.where("change <> 'added'").select("path", "version"), "tombstones", number)
        self._write(fresh.select("path", F.lit(number).cast("long").alias("version"), "size", "mtime"), "entries", number)
        self._write(fresh.select("path", F.lit(number).cast("long").alias("version"), F.explode(F.array_distinct(tokens("text"))).alias("token")), "postings", number)
        both.unpersist()
        self._compact(number + 1)

    def _current(self, before: int) -> DataFrame:
        """Live entries as batches before ``before`` left them: a batch that is run again doesn't see its own rows."""
        since = self.generation()
        if since >= before:  # this batch was compacted already
            since = max([-1, *[r.start for r in self.spark.read.schema("start long").json(f"{self.root}/generations").where(F.col("start") < before).collect()]])
        upto = lambda kind: self.spark.read.schema(f"{self.KINDS[kind]}, part long").parquet(f"{self.root}/{kind}").where((F.col("part") >= since) & (F.col("part") < before)).drop("part") if self._exists(f"{self.root}/{kind}") else self._read(kind, since)
        return upto("entries").join(upto("tombstones"), ["path", "version"], "left_anti")

    def _compact(self, number: int) -> None:
        since = self.generation()
        entries, gone = self._read("entries", since).count(), self._read("tombstones", since).count()
        if gone <= self.share * entries:
            return
        for kind in ("entries", "postings"):
            rows = self.live(kind)
            self._write(rows.withColumn("version", F.lit(number).cast("long")), kind, number)
        self._write(self.spark.createDataFrame([], self.KINDS["tombstones"]), "tombstones", number)
        self.spark.createDataFrame([(number,)], "start long").coalesce(1).write.mode("overwrite").json(f"{self.root}/generations/start={number}")

    def follow(self, changes: DataFrame) -> None:
        """Apply a stream of changes, batch by batch, until it is drained."""
        q = changes.writeStream.foreachBatch(self.apply).option("checkpointLocation", f"{self.root}-state").trigger(availableNow=True).start()
        q.awaitTermination()


def document_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, path, size, mtime, removed, text: all documents, then edits and removals, then new ones and the same again."""
    docs = table(spark, sf_dir, "documents")
    path = lambda prefix: F.concat(F.lit(prefix), F.col("doc_id")).alias("path")
    row = lambda df, part, prefix, text, removed=False: df.select(F.lit(part).alias("part"), path(prefix), F.char_length(text).cast("long").alias("size"), F.lit(1000 + part).cast("long").alias("mtime"), F.lit(removed).alias("removed"), text.alias("text"))
    text = F.col("text")
    first = row(docs, 0, "d/", text)
    second = row(docs.where("doc_id % 7 = 0"), 1, "d/", F.concat(text, F.lit(" renewed words"))).unionByName(row(docs.where("doc_id % 5 = 0 and doc_id % 7 <> 0"), 1, "d/", text, True))
    again = row(docs.where("doc_id % 11 = 1 and doc_id % 5 <> 0 and doc_id % 7 <> 0"), 2, "d/", text).withColumn("mtime", F.lit(1000).cast("long"))
    third = row(docs.where("doc_id % 9 = 0"), 2, "new/", text).unionByName(again).unionByName(row(docs.where("doc_id % 13 = 0"), 2, "unknown/", text, True))
    return first.unionByName(second).unionByName(third)


_LIVE = (
    "live AS (SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN text || ' renewed words' ELSE text END AS text FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 7 = 0 UNION ALL SELECT 'new/' || doc_id, text FROM documents WHERE doc_id % 9 = 0)"
)


def _followed(spark: SparkSession, sf_dir: str) -> IndexFollower:
    index = IndexFollower(spark, scratch(spark, "followed"))
    for changes in replayed(document_changes(spark, sf_dir), "changes", 3, F.col("part")):
        index.follow(changes)
    return index


@query(
    "SELECT 0 AS batch, 'added' AS change, count(*) AS n FROM documents UNION ALL SELECT 1, 'updated', count(*) FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 1, 'removed', count(*) FROM documents WHERE doc_id % 5 = 0 AND doc_id % 7 <> 0 UNION ALL SELECT 2, 'added', count(*) FROM documents WHERE doc_id % 9 = 0"
)
def e6_index_events(spark, sf_dir):
    """What an index that follows a stream of changes reports of each batch (E6); unchanged and unknown paths report none."""
    return _followed(spark, sf_dir).events().groupBy("batch", "change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_LIVE} SELECT token, count(*) AS df FROM (SELECT DISTINCT path, unnest({tokens_sql('text')}) AS token FROM live) GROUP BY token")
def b7_followed_index(spark, sf_dir):
    """Document frequencies of the index that followed the stream, with tombstones and compaction, as a fresh build has
    them (B7, B9, E6)."""
    return _followed(spark, sf_dir).live("postings").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
