"""Training corpora written in two phases: tables, facts and hashes go to a version folder, and count once it is committed.

A version is committed by creating one empty file, ``<folder>/commits/<number>-<version>``, which a store does wholly or not
at all. Readers take the last committed version, so a job that dies at any point leaves nothing that can be read, and
a reader that has begun keeps its version. Versions that nobody committed are removed by sweep().
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from types import TracebackType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..operators.draws import draw_rank, smallest_draws
from ..operators.scratch import entries, remove, written
from .datasets import content_hash

FACTS = "table string, rows long, content_sha256 string"


def committed(spark: SparkSession, folder: str) -> list[str]:
    """Committed versions, first to last."""
    return [name.partition("-")[2] for name in entries(spark, f"{folder}/commits") if "-" in name]


class CorpusWriter:
    """Writes one version of a corpus. As a context manager it commits at the end, or aborts if the block fails."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.version = spark, folder, uuid.uuid4().hex
        self.facts: list[tuple[str, int, str]] = []

    @property
    def place(self) -> str:
        return f"{self.folder}/versions/{self.version}"

    def write(self, name: str, rows: DataFrame, by: str | None = None) -> DataFrame:
        """Writes a table, in folders by a column where one is named; what was written is read again to count and hash it."""
        out = rows.write.partitionBy(by) if by else rows.write
        out.parquet(f"{self.place}/{name}")
        back = self.spark.read.schema(rows.schema).parquet(f"{self.place}/{name}")
        self.facts.append((name, back.count(), content_hash(back, *sorted(rows.columns)).first()[0]))
        return back

    def commit(self) -> str:
        """Makes the version visible, facts and all."""
        self.spark.createDataFrame(self.facts, FACTS).coalesce(1).write.parquet(f"{self.place}/facts")  # a row for each table
        number = len(committed(self.spark, self.folder))
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/commits/{number:012d}-{self.version}")
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, False).close()
        return self.version

    def abort(self) -> None:
        remove(self.spark, self.place)

    def __enter__(self) -> CorpusWriter:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.abort() if kind else self.commit()


def read_corpus(spark: SparkSession, folder: str, name: str, version: str | None = None) -> DataFrame:
    """A table (or ``facts``) of the last committed version, or of one that is named."""
    versions = committed(spark, folder)
    if not versions or version not in (None, *versions):
        raise ValueError(f"{folder} holds no committed {version or 'version'}")
    return spark.read.parquet(f"{folder}/versions/{version or versions[-1]}/{name}")


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Removes the versions that were not committed; no writer may be at work."""
    left = [v for v in entries(spark, f"{folder}/versions") if v not in committed(spark, folder)]
    for version in left:
        remove(spark, f"{folder}/versions/{version}")
    return left


def with_split(rows: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """``split``: the first max(1, floor(fraction)) rows in the order of a draw are ``val``, the others ``train``; a single row is both."""
    drawn = rows.select(F.col(key).alias("__key"), uniform(seed, F.col(key)).alias("__u"))
    held = smallest_draws(drawn, "__u", "__key", [], F.greatest(F.lit(1), F.floor(F.col("__all") * fraction))).select("__key")
    split = rows.join(held.withColumn("__held", F.lit(1)), F.col(key) == F.col("__key"), "left").withColumn("split", F.when(F.col("__held") == 1, "val").otherwise("train")).drop("__key", "__held")
    alone = split.limit(2).count() == 1
    return split.unionByName(split.withColumn("split", F.lit("train"))) if alone else split


def replayed(pool: DataFrame, key: str, wanted: int, seed: int, reasons: Sequence[tuple[str, Column]], capped: Column, cap_percent: int = 30) -> tuple[DataFrame, DataFrame]:
    """(kept rows, (reason, n)): rows of the pool in the order of a draw until ``wanted`` are kept.

    A row is dropped for its first reason that holds. Of what is left, rows for which ``capped`` holds are kept up to a
    percentage of ``wanted`` and then dropped as ``over cap``. Reasons count the rows that were looked at: those up to
    the last one kept. Ranks come from draws, so no task orders the pool.
    """
    reason = F.coalesce(*[F.when(holds, F.lit(name)) for name, holds in reasons])
    looked = written(pool.withColumn("__u", uniform(seed, F.col(key))).withColumn("__reason", reason).withColumn("__capped", F.coalesce(capped, F.lit(False))))
    fine = looked.filter("__reason is null")
    within = draw_rank(fine.filter("__capped"), "__u", key, [], "__rank").withColumn("__reason", F.when(F.col("__rank") > wanted * cap_percent // 100, F.lit("over cap"))).drop("__rank")
    ranked = written(fine.filter("not __capped").unionByName(within))
    kept = written(draw_rank(ranked.filter("__reason is null"), "__u", key, [], "__rank").filter(F.col("__rank") <= wanted))
    last = kept.agg(F.max(F.struct("__u", key)).alias("x"), F.count(F.lit(1)).alias("n")).first()
    dropped = looked.filter("__reason is not null").unionByName(ranked.filter("__reason is not null"))
    if last["n"] == wanted and wanted:
        u, k = last["x"]["__u"], last["x"][key]
        dropped = dropped.filter((F.col("__u") < u) | ((F.col("__u") == u) & (F.col(key) < F.lit(k))))
    counts = dropped.groupBy(F.col("__reason").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return kept.drop("__u", "__reason", "__capped", "__rank"), counts
