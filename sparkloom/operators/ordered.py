"""Running totals and budgets over an explicit order, without gathering all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

def running_before(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Adds the total of ``value`` over all rows of smaller ``order`` (unique, of any type that sorts).

    Rows are dealt by ranges of the order that hold about as many rows each, however sparse its values are. Only a total
    for each range reaches the driver. The ranges are written, so that a repeated task deals them alike.
    """
    spark = df.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(ranges, order).withColumn("__range", F.spark_partition_id()))
    before, total = [], 0
    for part, own in sorted(placed.groupBy("__range").agg(F.coalesce(F.sum(value), F.lit(0)).alias("n")).collect()):
        before.append((part, total))
        total += own
    starts = spark.createDataFrame(before or [(0, 0)], "__range int, __before long")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(starts), "__range").withColumn(name, (inside + F.col("__before")).cast("long")).drop("__range", "__before")


def within_budget(df: DataFrame, order: str, value: str, budget: int) -> DataFrame:
    """Rows in order until the budget is reached; the row that crosses it stays."""
    return running_before(df, order, value, "before").filter(F.col("before") < budget)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def islands(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """One row per run of equal values: key, first order, value, length."""
    w = Window.partitionBy(key).orderBy(*order)
    change = F.when(F.col(value).eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    marked = df.withColumn("__change", change).withColumn("__island", F.sum("__change").over(w))
    return marked.groupBy(key, "__island").agg(F.min(order[-1]).alias("first"), F.first(value).alias(value), F.count(F.lit(1)).alias("length")).drop("__island")
