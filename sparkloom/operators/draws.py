"""Ranks, samples and budgets in the order of a draw, without gathering all rows of a group in one task.

Draws lie in (0, 1). A histogram of ``BINS`` equal bins per group, combined
before it is shuffled, tells how many rows (or how much of a value) come before
each bin; only the rows of one bin of one group are ordered together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 4096


def _binned(df: DataFrame, draw: str, group: list[str], value: Column) -> DataFrame:
    """df with __bin, __before (the value of the group's earlier bins), __own (of this bin) and __all (of the group)."""
    df = df.withColumn("__bin", F.floor(F.col(draw) * BINS).cast("int"))
    per = df.groupBy(*group, "__bin").agg(F.sum(value).alias("__own"))
    whole = Window.partitionBy(*group)
    before = F.coalesce(F.sum("__own").over(whole.orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("__before", before).withColumn("__all", F.sum("__own").over(whole))
    keys = [*group, "__bin"]
    named = per.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "__own", "__before", "__all")
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return df.join(named, same).drop(*[f"__k{i}" for i in range(len(keys))])


def _inside(draw: str, order: str, group: list[str]) -> Window:
    return Window.partitionBy(*group, "__bin").orderBy(draw, order)


def draw_rank(df: DataFrame, draw: str, order: str, group: list[str], name: str = "rank") -> DataFrame:
    """Adds the exact rank (from 1) of each row in its group by (draw, order)."""
    binned = _binned(df, draw, group, F.lit(1))
    ranked = binned.withColumn(name, (F.col("__before") + F.row_number().over(_inside(draw, order, group))).cast("long"))
    return ranked.drop("__bin", "__own", "__before", "__all")


def smallest_draws(df: DataFrame, draw: str, order: str, group: list[str], quota: Column) -> DataFrame:
    """The first ``quota`` rows of each group by (draw, order). ``quota`` may use __all, the group's rows, and columns of the group.

    Bins wholly inside or outside the quota need no order; only rows of the bin where it ends are ranked.
    """
    binned = _binned(df, draw, group, F.lit(1)).withColumn("__quota", quota)
    sure = binned.filter("__before + __own <= __quota")
    edge = binned.filter("__before < __quota and __before + __own > __quota").withColumn("__r", F.row_number().over(_inside(draw, order, group)))
    kept = sure.unionByName(edge.filter("__before + __r <= __quota").drop("__r"))
    return kept.drop("__bin", "__own", "__before", "__all", "__quota")


def budget_by_draw(df: DataFrame, draw: str, order: str, value: str, budget: int) -> DataFrame:
    """Rows by (draw, order) until their total reaches the budget; the row that crosses it stays."""
    binned = _binned(df, draw, [], F.col(value))
    sure = binned.filter(F.col("__before") + F.col("__own") < budget)
    edge = binned.filter((F.col("__before") < budget) & (F.col("__before") + F.col("__own") >= budget))
    ahead = F.coalesce(F.sum(value).over(_inside(draw, order, []).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = sure.unionByName(edge.withColumn("__r", ahead).filter(F.col("__before") + F.col("__r") < budget).drop("__r"))
    return kept.drop("__bin", "__own", "__before", "__all")
