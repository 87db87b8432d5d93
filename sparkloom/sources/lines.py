"""Numbered lines of files of any size: a file is read in splits, and lines still know their number in it.

A first pass counts the lines of each split and notes where its rows begin in their task; sums of those counts over a
file's splits are the numbers of their first lines. The second pass reads the splits again, in the same tasks. If the
session has since cut the files otherwise (another number of cores, say), the read fails instead of numbering wrongly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scratch import written

#: Splits whose first lines are broadcast; beyond that lines are shuffled to meet them.
BROADCAST_SPLITS = 500_000


def _part(at: Column) -> Column:
    return F.shiftright(at, 33)


def numbered_lines(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """path, line (from 1), content of the files of a folder whose names match. Lines end with ``\\n``, ``\\r\\n`` or ``\\r``; a last one may lack its end."""
    raw = spark.read.option("pathGlobFilter", pattern).text(folder)
    placed = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("content"), F.monotonically_increasing_id().alias("at"))
    splits = written(placed.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "split", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    starts = F.broadcast(starts) if splits.count() <= BROADCAST_SPLITS else starts
    moved = F.col("first").isNull() | (_part(F.col("first")) != _part(F.col("at")))
    line = F.when(moved, F.raise_error(F.concat(F.lit("the session has cut this file otherwise since its lines were counted: "), "path")).cast("long")).otherwise(F.col("before") + F.col("at") - F.col("first") + 1)
    return placed.join(starts, ["path", "split"], "left").select("path", line.alias("line"), "content")
