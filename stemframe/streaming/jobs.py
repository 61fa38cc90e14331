"""Structured Streaming forms of the chunked operators; each equals its batch form on the same rows.

All jobs run in append mode, so the watermark bounds their state and drops rows that are too late. ``drained`` runs
a streaming DataFrame over what has landed and returns its result as a table: the file sink commits each batch
once, so a restart repeats nothing. ``drained_to_end`` adds a row of the far future when the source has ended,
which closes the windows that the watermark still holds open.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from stemframe.registry import query, table
from stemframe.storage import delete, new_path

#: Event time of the row that ends a stream.
END = datetime.datetime(2200, 1, 1)  # within what pandas can hold


def _run(stream: DataFrame, where: str) -> None:
    """Read what has landed since the last run with the same folder."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name, None)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # a query takes its settings with it when it starts
    try:
        q = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)
    q.awaitTermination()


def drained(stream: DataFrame) -> DataFrame:
    """The result of a streaming DataFrame over all rows that have landed by now."""
    spark, where = stream.sparkSession, new_path(stream.sparkSession, "stream")
    _run(stream, where)
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def drained_to_end(source: DataFrame, build: Callable[[DataFrame], DataFrame], time: str = "ts") -> DataFrame:
    """The result of ``build(source)`` once the source has ended: all that has landed, then a row whose ``time`` is END.

    The other columns of that row are null; what ``build`` makes of it is never emitted, as no later row closes it.
    """
    spark, where, ends = source.sparkSession, new_path(source.sparkSession, "stream"), new_path(source.sparkSession, "end")
    schema = StructType([StructField(f.name, f.dataType) for f in source.schema.fields])
    spark.createDataFrame([], schema).write.parquet(ends)
    stream = build(source.unionByName(spark.readStream.schema(schema).parquet(ends)))
    _run(stream, where)
    row = tuple(END if f.name == time else None for f in schema.fields)
    spark.createDataFrame([row], schema).write.mode("append").parquet(ends)
    _run(stream, where)
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def latest_by_key(stream: DataFrame, keys: list[str], order: list[str], where: str | None = None, buckets: int = 64) -> DataFrame:
    """One row by key, that of the largest ``order``, with n, the number of its rows: every batch is merged into the table so far.

    The table lies in ``where`` (a folder of its own, if not given) in ``buckets`` by hash of the key, each with its versions. A batch
    rewrites only buckets that it has rows for, as version ``batch`` next to the one before, so a batch that is run again writes
    the same. What is known of versions is what lies there: a query that is stopped and started again with the same
    folder goes on where it was. Versions that no restart can need go.
    """
    spark = stream.sparkSession
    where = where or new_path(spark, "latest")
    schema = stream.withColumn("n", F.lit(0).cast("long")).schema
    row = F.struct(*[F.col(c) for c in stream.columns])

    def merge(df: DataFrame, batch: int) -> None:
        session = df.sparkSession
        kept = _versions(session, f"{where}/table", batch)
        rows = df.select(row.alias("row"), F.lit(1).cast("long").alias("n"), F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = [kept[b] for b in touched if b in kept]
        if old:
            before = session.read.schema(schema).parquet(*[path for _, path in old])
            rows = rows.unionByName(before.select(row.alias("row"), "n", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")))
        out = rows.groupBy("bucket", *[F.col(f"row.{k}").alias(f"_{k}") for k in keys]).agg(F.max_by("row", F.struct(*[F.col(f"row.{o}") for o in order])).alias("row"), F.sum("n").alias("n"))
        if touched:
            out.select("bucket", "row.*", "n").write.mode("overwrite").partitionBy("bucket").parquet(f"{where}/table/version={batch}")
        needed = {path for version, path in [*old, *kept.values()]}
        for path in _paths(session, f"{where}/table"):
            if path not in needed and _numbers(path)[0] < batch:
                delete(session, path)

    q = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    found = [path for _, path in _versions(spark, f"{where}/table", None).values()]
    return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)


def _paths(spark: SparkSession, folder: str) -> list[str]:
    """Folders of single buckets of finished versions."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    below = lambda p: [s.getPath() for s in store.listStatus(p)] if store.exists(p) else []
    done = [v for v in below(place) if any(f.getName() == "_SUCCESS" for f in below(v))]
    return [b.toString() for v in done for b in below(v) if b.getName().startswith("bucket=")]


def _numbers(path: str) -> tuple[int, int]:
    version, bucket = path.rstrip("/").split("/")[-2:]
    return int(version.removeprefix("version=")), int(bucket.removeprefix("bucket="))


def _versions(spark: SparkSession, folder: str, before: int | None) -> dict[int, tuple[int, str]]:
    """Of each bucket the newest version, if ``before`` is given of those before it."""
    found: dict[int, tuple[int, str]] = {}
    for path in _paths(spark, folder):
        version, bucket = _numbers(path)
        if (before is None or version < before) and version > found.get(bucket, (-1, ""))[0]:
            found[bucket] = (version, path)
    return found


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A landing folder as a stream: one table's files, picked up as they come."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*").parquet(f"{sf_dir}/{name}*.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def frame_energy(df: DataFrame, size: str, hop: str, late: str) -> DataFrame:
    """Mean square by key and sliding window of event time; rows later than the watermark are dropped."""
    w = F.window("ts", size, hop)
    out = df.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.avg(F.col("value") * F.col("value")).alias("energy"), F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "energy", "n")


def activity_sessions(df: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of events with no silence of ``gap`` or more between them."""
    out = df.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n", "total")


class OverlapAdd(StatefulProcessor):
    """The unfinished tail of a track: where it begins, its sums, and how many chunks each sample has had.

    A sample is emitted once no later chunk can touch it, so the state never holds more than one chunk. A track that has had
    no chunk for ``idle`` of event time has ended: its timer emits what is left and drops the state. So does a row without samples.
    """

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("tail", "at long, tail array<double>, count array<int>, timer long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802,N803  names of Spark's interface
        at, tail, count, timer = self.state.get() if self.state.exists() else (0, [], [], None)
        tail, count, done = np.array(tail, float), np.array(count, np.int64), []
        found = sorted(((int(r.start), r.samples, r.ts) for pdf in rows for r in pdf.itertuples() if not pd.isna(r.start)), key=lambda r: (r[1] is None, r[0]))
        if not found or pd.isna(key[0]):
            return
        for start, samples, _ in found:
            if samples is None:
                done.append((at, tail / count))
                at, tail, count = at + tail.size, tail[:0], count[:0]
                continue
            k = min(tail.size, max(start - at, 0))
            done.append((at, tail[:k] / count[:k]))
            at, tail, count = at + k, tail[k:], count[k:]
            if not tail.size:
                at = max(at, start)
            samples = np.asarray(samples, float)[max(at - start, 0) :]  # what is out already can't change any more
            place = max(start - at, 0)
            grown = max(0, place + samples.size - tail.size)
            tail, count = np.concatenate((tail, np.zeros(grown))), np.concatenate((count, np.zeros(grown, np.int64)))
            tail[place : place + samples.size] += samples
            count[place : place + samples.size] += 1
        if timer is not None:
            self.handle.deleteTimer(int(timer))
        if found[-1][1] is None:
            self.state.clear()
        else:
            last = max(pd.Timestamp(ts) for _, _, ts in found)
            ends = max(int(timer or 0), int(last.timestamp() * 1000) + self.idle_ms)
            self.handle.registerTimer(ends)
            self.state.update((int(at), tail.tolist(), count.tolist(), ends))
        yield from self._rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802,N803
        at, tail, count, _ = self.state.get()
        self.state.clear()
        yield from self._rows(key, [(at, np.array(tail, float) / np.array(count))])

    @staticmethod
    def _rows(key, done):
        parts = [pd.DataFrame({"track": key[0], "pos": np.arange(at, at + v.size), "v": v}) for at, v in done if v.size]
        if parts:
            yield pd.concat(parts).astype({"track": "int64", "pos": "int64", "v": "float64"})

    def close(self) -> None:
        pass


def overlap_add_stream(chunks: DataFrame, late: str = "1 minute", idle_ms: int = 60_000) -> DataFrame:
    """Overlap-add of chunk rows (track, start, samples, ts) with typed state and event-time timers: track, pos, v.

    ``late`` delays the watermark of ts; a track ends ``idle_ms`` after its last chunk's time, by the watermark. Runs on RocksDB state.
    """
    grouped = chunks.select("track", "start", "samples", "ts").withWatermark("ts", late).groupBy("track")
    return grouped.transformWithStateInPandas(OverlapAdd(idle_ms), "track long, pos long, v double", "append", "EventTime")


def history_latest(events: DataFrame, late: str, job: str = "user_id", where: str | None = None) -> DataFrame:
    """Latest event of each job by time and id, with n, its number of events: deliveries of one event count once, late rows are dropped.

    With ``where``, a folder that stays, a later call goes on with what has landed since.
    """
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return latest_by_key(once, [job], ["ts", "event_id"], where)


def mixdown_stream(a: DataFrame, b: DataFrame, late: str) -> DataFrame:
    """Two live stems added where they meet in the same track and minute; state is bounded by the watermarks."""
    left = a.withWatermark("ts", late).select("user_id", "ts", F.date_trunc("hour", "ts").alias("bucket"), F.col("value").alias("x"))
    right = b.withWatermark("ts", late).select(F.col("user_id").alias("u"), F.col("ts").alias("ts2"), F.date_trunc("hour", "ts").alias("bucket2"), F.col("value").alias("y"))
    near = (F.col("user_id") == F.col("u")) & (F.col("bucket") == F.col("bucket2")) & (F.col("ts2") >= F.col("ts") - F.expr("INTERVAL 1 HOUR")) & (F.col("ts2") <= F.col("ts") + F.expr("INTERVAL 1 HOUR"))
    return left.join(right, near).select("user_id", "ts", "ts2", (F.col("x") + F.col("y")).alias("v"))


@query("s1_stream_blocks", "SELECT event_id, user_id, event_type, value FROM events")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drained(events(spark, sf_dir).select("event_id", "user_id", "event_type", "value"))


@query("s2_stream_frame_energy", """SELECT user_id, make_timestamp(w * 3600000000) AS start, round(avg(value * value), 6) AS energy, count(*) AS n
FROM (SELECT user_id, value, unnest([CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT), CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) - 1]) AS w FROM events) GROUP BY ALL""")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained_to_end(events(spark, sf_dir), lambda e: frame_energy(e, "2 hours", "1 hour", "1 hour"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.round("energy", 6).alias("energy"), "n")


@query("s3_stream_activity_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, round(sum(value), 3) AS total FROM i GROUP BY user_id, k""")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained_to_end(events(spark, sf_dir), lambda e: activity_sessions(e, "6 hours", "1 hour"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n", F.round("total", 3).alias("total"))


@query("s4_stream_overlap_add", """SELECT vec_id AS track, pos, round(v, 5) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)""")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = stream_table(spark, sf_dir, "embeddings")
    # Chunks of 32 at hop 16 over the whole track, a second apart; the end of a track is found by its timer.
    n = F.size("embedding")
    cut = e.withColumn("start", F.explode(F.filter(F.sequence(F.lit(0), n, F.lit(16)), lambda k: k < n)))
    samples = F.transform(F.slice("embedding", F.col("start") + 1, F.lit(32)), lambda v: v.cast("double"))
    chunks = cut.select(F.col("vec_id").alias("track"), F.col("start").cast("long").alias("start"), samples.alias("samples"), F.timestamp_seconds(1_700_000_000 + F.col("start")).alias("ts"))
    return drained_to_end(chunks, overlap_add_stream).withColumn("v", F.round("v", 5))


@query("s5_stream_history_latest", """SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS n FROM events GROUP BY user_id""")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every event is delivered twice.
    e = events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")
    out = history_latest(e.unionByName(events(spark, sf_dir).select("event_id", "user_id", "event_type", "ts")), "40 days")
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", F.col("event_type").alias("status"), "n")


@query("s6_stream_mixdown", """SELECT a.user_id, a.ts, b.ts AS ts2, round(a.value + b.value, 4) AS v FROM events a JOIN events b ON a.user_id = b.user_id AND date_trunc('hour', a.ts) = date_trunc('hour', b.ts) WHERE a.event_type = 'click' AND b.event_type = 'view'""")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = events(spark, sf_dir).filter("event_type = 'click'"), events(spark, sf_dir).filter("event_type = 'view'")
    out = drained(mixdown_stream(a, b, "30 days"))
    return out.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("ts2").cast("timestamp_ntz").alias("ts2"), F.round("v", 4).alias("v"))
