"""Sequences: runs, records, array programs over orders, logs and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..operators.ordered import islands, top_per_group
from ..sources.tables import table


def _order() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").groupBy("event_type", "length").agg(F.count(F.lit(1)).alias("runs"))


def stuck_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return islands(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type").filter("length >= 3").groupBy("user_id", "event_type", "length").agg(F.count(F.lit(1)).alias("runs"))


def running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", F.max("value").over(_order().rowsBetween(Window.unboundedPreceding, 0)).alias("running_max"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events above all earlier ones of their user."""
    before = F.max("value").over(_order().rowsBetween(Window.unboundedPreceding, -1))
    return _events(spark, sf_dir).withColumn("before", before).filter(F.col("before").isNull() | (F.col("value") > F.col("before"))).groupBy("user_id").agg(F.count(F.lit(1)).alias("records"))


def longest_rise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rise = _events(spark, sf_dir).withColumn("falls", F.when(F.col("value") > F.lag("value").over(_order()), 0).otherwise(1))
    rise = rise.withColumn("island", F.sum("falls").over(_order())).groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"))
    return rise.groupBy("user_id").agg(F.max("n").alias("longest_rise"))


def best_run_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest sum of neighbouring changes, in whole cents: prefix sum less the least prefix before it."""
    change = _events(spark, sf_dir).withColumn("d", F.round((F.col("value") - F.coalesce(F.lag("value").over(_order()), F.lit(0.0))) * 100).cast("long"))
    prefix = change.withColumn("s", F.sum("d").over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    least = F.least(F.lit(0), F.coalesce(F.min("s").over(_order().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return prefix.withColumn("best", F.col("s") - least).groupBy("user_id").agg(F.max("best").cast("long").alias("best_run_sum"))


def metrics_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _events(spark, sf_dir)
    tail = top_per_group(events, ["event_type"], [F.desc("ts"), F.desc("event_id")], 10).groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("tail_mean"))
    ends = events.groupBy("event_type").agg(F.min_by("value", F.struct("ts", "event_id")).alias("first"), F.max_by("value", F.struct("ts", "event_id")).alias("last"))
    return tail.join(ends, "event_type").select("event_type", "tail_mean", "first", "last")


def lr_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate at the step of each document: warm-up over 100 steps, level to 800, cosine decay to a tenth at 1,000, then level."""
    step = F.col("doc_id")
    decay = 0.1 + 0.9 * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * (F.least(step, F.lit(1000)) - 800) / 200))
    return table(spark, sf_dir, "documents").select(step.alias("step"), F.round(F.when(step < 100, (step + 1) / 100).when(step < 800, F.lit(1.0)).otherwise(decay), 8).alias("lr"))


QUERIES = {f.__name__: f for f in (run_lengths, stuck_runs, running_max, records, longest_rise, best_run_sum, metrics_tail, lr_schedule)}
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_ISLANDS = f"WITH c AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER {_W} THEN 0 ELSE 1 END AS c FROM events), i AS (SELECT *, sum(c) OVER {_W} AS island FROM c), r AS (SELECT user_id, island, any_value(event_type) AS event_type, count(*) AS length FROM i GROUP BY 1, 2) "
ORACLE_SQL = {
    "run_lengths": _ISLANDS + "SELECT event_type, length, count(*) AS runs FROM r GROUP BY 1, 2",
    "stuck_runs": _ISLANDS + "SELECT user_id, event_type, length, count(*) AS runs FROM r WHERE length >= 3 GROUP BY 1, 2, 3",
    "running_max": f"SELECT event_id, max(value) OVER {_W} AS running_max FROM events",
    "records": "WITH b AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM events) SELECT user_id, count(*) AS records FROM b WHERE before IS NULL OR value > before GROUP BY 1",
    "longest_rise": f"WITH c AS (SELECT *, CASE WHEN value > lag(value) OVER {_W} THEN 0 ELSE 1 END AS c FROM events), i AS (SELECT user_id, sum(c) OVER {_W} AS island FROM c), n AS (SELECT user_id, island, count(*) AS n FROM i GROUP BY 1, 2) SELECT user_id, max(n) AS longest_rise FROM n GROUP BY 1",
    "best_run_sum": f"WITH c AS (SELECT *, round((value - coalesce(lag(value) OVER {_W}, 0)) * 100)::BIGINT AS d FROM events), s AS (SELECT *, sum(d) OVER {_W} AS s FROM c), b AS (SELECT user_id, s - least(0, coalesce(min(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS best FROM s) SELECT user_id, max(best)::BIGINT AS best_run_sum FROM b GROUP BY 1",
    "metrics_tail": "WITH t AS (SELECT event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 10), m AS (SELECT event_type, round(avg(value), 6) AS tail_mean FROM t GROUP BY 1), e AS (SELECT event_type, arg_min(value, (ts, event_id)) AS first, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY 1) SELECT event_type, tail_mean, first, last FROM m JOIN e USING (event_type)",
    "lr_schedule": "SELECT doc_id AS step, round(CASE WHEN doc_id < 100 THEN (doc_id + 1)::DOUBLE / 100 WHEN doc_id < 800 THEN 1.0::DOUBLE ELSE 0.1 + 0.9 * 0.5 * (1 + cos(3.141592653589793 * (least(doc_id, 1000) - 800) / 200)) END, 8)::DOUBLE AS lr FROM documents",
}
