"""Streaming forms of the log aggregations, each with its batch SQL.

Each query feeds its table to a stream, runs over what is available and returns the table that the stream has written.
No result passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import entries, scratch_folder
from ..sources.tables import table
from .calls import repeated_calls, repeated_calls_batch, with_call_columns
from .counters import MergedCounters, appended

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream; event time is a timestamp in the session's zone, since watermarks take no other."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def final_table(stream: DataFrame, folder: str) -> DataFrame:
    """What a stream in complete mode holds in the end: each batch writes the whole state as a version of the table."""
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{folder}/version={n}")
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}-log").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    last = max(int(n.partition("=")[2]) for n in entries(stream.sparkSession, folder))
    return stream.sparkSession.read.parquet(f"{folder}/version={last}")


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """The state store that keyed state and timers ask for, while the query is started."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def fed_by_parts(spark: SparkSession, events: DataFrame, parts: int, jitter_hours: int = 12) -> Iterator[str]:
    """Writes the events to a folder in ``parts`` of time, one after another, and gives the folder after each; rows lie up to ``jitter_hours`` outside their part."""
    folder = scratch_folder(spark)
    at = F.unix_timestamp(F.col("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(jitter_hours * 3600 + 1))
    bounds = events.agg(F.min(at).alias("a"), F.max(at).alias("b")).first()
    step = ((bounds["b"] or 0) - (bounds["a"] or 0)) // parts + 1
    for k in range(parts):
        events.filter(F.floor((at - F.lit(bounds["a"] or 0)) / step) == k).write.mode("append").parquet(folder)
        yield folder


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts and means by event type, with a watermark of a day."""
    day = F.window("ts", "1 day")
    per = event_stream(spark, sf_dir).withWatermark("ts", "1 day").groupBy(day.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.round(F.col("value") * 100).cast("long")) / F.count(F.lit(1)), 2).alias("mean_cents"))
    return final_table(per.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "mean_cents"), scratch_folder(spark))


def stream_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that merge over restarts: rows and total value in whole cents by user, from a query that is started anew for each half of the events."""
    folder = scratch_folder(spark)
    counters = MergedCounters(spark, f"{folder}/table", ["user_id"], ["rows", "cents"])
    for feed in fed_by_parts(spark, table(spark, sf_dir, "events"), 2):
        seen = spark.readStream.schema(EVENTS).parquet(feed).select("user_id", F.lit(1).cast("long").alias("rows"), F.round(F.col("value") * 100).cast("long").alias("cents"))
        counters.start(seen, f"{folder}/log").awaitTermination()
    return counters.read()


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct events by id within the watermark, counted by type in the stream."""
    folder = scratch_folder(spark)
    unique = event_stream(spark, sf_dir).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_id"])
    counters = MergedCounters(spark, f"{folder}/table", ["event_type"], ["n"])
    counters.start(unique.select("event_type", F.lit(1).cast("long").alias("n")), f"{folder}/log").awaitTermination()
    return counters.read()


def stream_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An append-only log of JSON rows, one for each event, appended over restarts: rows, first and last id and total by day."""
    folder = scratch_folder(spark)
    for feed in fed_by_parts(spark, table(spark, sf_dir, "events"), 2):
        rows = spark.readStream.schema(EVENTS).parquet(feed).select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.round(F.col("value") * 100).cast("long").alias("cents"))
        appended(rows, f"{folder}/lines", f"{folder}/log", "json").awaitTermination()
    lines = spark.read.schema("event_id long, day string, cents long").json(f"{folder}/lines")
    return lines.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.sum("cents").alias("cents"))


def _failed(value: str = "value") -> Column:
    return F.coalesce(F.col(value) < 30, F.lit(True))


def _content(value: str = "value") -> Column:
    return F.floor(F.col(value) / 60).cast("string")


def stream_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and failing calls by user and type, from a query with keyed state and timers that is started anew for each of three parts of the events."""
    folder, events = scratch_folder(spark), table(spark, sf_dir, "events")

    def run(feed: str) -> None:
        calls = with_call_columns(spark.readStream.schema(EVENTS).parquet(feed), _failed(), _content())
        appended(repeated_calls(calls), f"{folder}/calls", f"{folder}/log").awaitTermination()

    with keyed_state(spark):
        feed = ""
        for feed in fed_by_parts(spark, events, 3):
            run(feed)
        # a row of no user moves event time past all others, so that what waits comes out
        spark.sql("SELECT CAST(NULL AS BIGINT) AS event_id, TIMESTAMP_NTZ'9000-01-01' AS ts, CAST(NULL AS BIGINT) AS user_id, '' AS event_type, 0D AS value, '' AS props").write.mode("append").parquet(feed)
        run(feed)
    return spark.read.parquet(f"{folder}/calls")


def call_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the whole table at once."""
    return repeated_calls_batch(with_call_columns(table(spark, sf_dir, "events").filter("user_id is not null"), _failed(), _content()))


_CALLS_SQL = """
WITH c AS (SELECT user_id AS task, event_type AS call, ts, event_id AS ordinal, coalesce(value < 30, true) AS failed, floor(value / 60) AS content FROM events WHERE user_id IS NOT NULL),
b AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY task, call ORDER BY ts, ordinal) AS run FROM c),
bad AS (SELECT task, call, ts, ordinal, row_number() OVER (PARTITION BY task, call, run ORDER BY ts, ordinal) AS failures, 0 AS times FROM b WHERE failed),
g AS (SELECT *, CASE WHEN row_number() OVER k = 1 OR content IS DISTINCT FROM lag(content) OVER k THEN 1 ELSE 0 END AS opens FROM c WHERE NOT failed WINDOW k AS (PARTITION BY task, call ORDER BY ts, ordinal)),
h AS (SELECT *, sum(opens) OVER (PARTITION BY task, call ORDER BY ts, ordinal) AS run FROM g),
good AS (SELECT task, call, ts, ordinal, 0 AS failures, row_number() OVER (PARTITION BY task, call, run ORDER BY ts, ordinal) AS times FROM h),
u AS (SELECT * FROM bad UNION ALL SELECT * FROM good),
o AS (SELECT *, failures >= 3 OR times >= 4 AS reached FROM u)
SELECT task, call, ordinal, failures::INT AS failures, times::INT AS times, greatest(failures, times) >= 2 AS warned, reached AND sum(reached::INT) OVER (PARTITION BY task, call ORDER BY ts, ordinal) = 1 AS stops FROM o
"""

QUERIES = {f.__name__: f for f in (stream_metrics, stream_exposure, stream_dedup, stream_log, stream_calls, call_streaks)}
ORACLE_SQL = {
    "stream_metrics": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(round(value * 100)::BIGINT)::DOUBLE / count(*), 2) AS mean_cents FROM events GROUP BY 1, 2",
    "stream_exposure": "SELECT user_id, count(*) AS rows, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1",
    "stream_dedup": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1",
    "stream_log": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, sum(round(value * 100)::BIGINT)::BIGINT AS cents FROM events GROUP BY 1",
    "stream_calls": _CALLS_SQL,
    "call_streaks": _CALLS_SQL,
}
