"""Rounds of training that are kept or undone, and rows packed into blocks: folds whose state goes from row to row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import ordered_fold

TOLERANCE, GAIN, COST = 3, 2, 3


def accepted_rounds(rounds: DataFrame, key: str = "run", below_anchor: int = TOLERANCE, below_best: int = TOLERANCE) -> DataFrame:
    """run, round, score, accepted, anchor_round, anchor, best of every row of ``rounds`` (run, round, score, new, fixed).

    A run's first round is its anchor. A later one is accepted if its score is no more than ``below_anchor`` under the
    anchor's and ``below_best`` under the best accepted one, or if new and fixed items together gain ``GAIN`` on the
    anchor's while the score costs at most ``COST``. Only an accepted round moves the anchor and the best.
    """

    def step(state: tuple | None, row: dict) -> tuple[tuple, list[tuple]]:
        score, parts = row["score"], row["new"] + row["fixed"]
        if state is None:
            ok, state = True, (row["round"], score, parts, score)
        else:
            _, anchor, before, best = state
            ok = (score >= anchor - below_anchor and score >= best - below_best) or (parts >= before + GAIN and score >= anchor - COST)
            if ok:
                state = (row["round"], score, parts, max(best, score))
        return state, [(row[key], row["round"], score, ok, state[0], state[1], state[3])]

    return ordered_fold(rounds.select(key, *[F.col(c).cast("long").alias(c) for c in ("round", "score", "new", "fixed")]), [key], ["round"], None, step, f"{key} {rounds.schema[key].dataType.simpleString()}, round long, score long, accepted boolean, anchor_round long, anchor long, best long")


def packed_blocks(rows: DataFrame, block: int, carry: DataFrame | None = None) -> DataFrame:
    """shard, block, row, start, used: whole rows (shard, row, length) in order fill blocks of ``block + 1`` tokens; the row that crosses the end is cut and its tail dropped.

    ``start`` is the row's place in the block. ``carry`` (shard, block, filled), as open_blocks() gives it, is the state that earlier rows left.
    """
    need = block + 1
    own = rows.select("shard", F.col("row").cast("long").alias("row"), F.col("length").cast("long").alias("length"), F.lit(0).cast("long").alias("filled"))
    if carry is not None:
        # rows of a state come before all others of their shard
        own = own.unionByName(carry.select("shard", (-1 - F.col("block")).alias("row"), F.lit(-1).cast("long").alias("length"), F.col("filled").cast("long").alias("filled")))

    def step(state: tuple[int, int], row: dict) -> tuple[tuple[int, int], list[tuple]]:
        number, filled = state
        if row["length"] < 0:
            return (-1 - row["row"], row["filled"]), []
        used = min(row["length"], need - filled)
        found = [(row["shard"], number, row["row"], filled, used)]
        return ((number + 1, 0) if filled + used == need else (number, filled + used)), found

    return ordered_fold(own, ["shard"], ["row"], (0, 0), step, f"shard {rows.schema['shard'].dataType.simpleString()}, block long, row long, start long, used long")


def open_blocks(packed: DataFrame, block: int, carry: DataFrame | None = None) -> DataFrame:
    """shard, block, filled: where the next row of each shard goes, from packed_blocks() and the state that it began with."""
    ends = packed.select("shard", "block", (F.col("start") + F.col("used")).alias("filled"))
    if carry is not None:
        ends = ends.unionByName(carry.select("shard", "block", "filled"))
    last = ends.groupBy("shard").agg(F.max(F.struct("block", "filled")).alias("s")).select("shard", "s.*")
    full = F.col("filled") == block + 1
    return last.select("shard", F.when(full, F.col("block") + 1).otherwise(F.col("block")).alias("block"), F.when(full, F.lit(0).cast("long")).otherwise(F.col("filled")).alias("filled"))


def annealed(batches: DataFrame, steps: int, decay_from: int, share_percent: int, rows_per_batch: int) -> DataFrame:
    """step, slot, late, number of ``batches`` (step): slots of a batch; once ``decay_from`` is reached a share of them comes from the second source.

    ``number`` counts the slots of its source up to here, so it names the source's next row. It is a closed form of the step: no state is carried.
    """
    late_slots = rows_per_batch * share_percent // 100
    slots = batches.filter(F.col("step") < steps).select("step", F.explode(F.sequence(F.lit(0), F.lit(rows_per_batch - 1))).alias("slot"))
    late = (F.col("step") >= decay_from) & (F.col("slot") >= rows_per_batch - late_slots)
    first = F.least("step", F.lit(decay_from)) * rows_per_batch + F.greatest(F.col("step") - decay_from, F.lit(0)) * (rows_per_batch - late_slots) + F.col("slot")
    second = (F.col("step") - decay_from) * late_slots + F.col("slot") - (rows_per_batch - late_slots)
    return slots.select(F.col("step").cast("long").alias("step"), F.col("slot").cast("long").alias("slot"), late.alias("late"), F.when(late, second).otherwise(first).cast("long").alias("number"))
