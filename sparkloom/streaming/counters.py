"""Streams that keep their results in tables: counters that merge over batches and restarts, and append-only logs.

A batch writes what it adds as ``<folder>/added/batch=N``, over whatever a failed try of the same batch left, so a batch
that is replayed after a restart counts once. Every ``COMPACT`` batches what lies there is summed into
``<folder>/base/upto=N``, which counts once it is complete; so a batch costs what it adds, and reading costs the base and
a few additions. Nothing passes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.scratch import entries, exists, remove

COMPACT = 8


class MergedCounters:
    """Sums of ``values`` by ``keys`` over all batches of a stream."""

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], values: Sequence[str]):
        self.spark, self.folder, self.keys, self.values = spark, folder, list(keys), list(values)

    def _numbers(self, kind: str) -> list[int]:
        """Batches with a complete table of this kind."""
        found = [int(n.partition("=")[2]) for n in entries(self.spark, f"{self.folder}/{kind}") if "=" in n]
        name = {"added": "batch", "base": "upto"}[kind]
        return sorted(n for n in found if exists(self.spark, f"{self.folder}/{kind}/{name}={n}/_SUCCESS"))

    def _summed(self, df: DataFrame) -> DataFrame:
        return df.groupBy(*self.keys).agg(*[F.sum(v).cast("long").alias(v) for v in self.values])

    def add(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: adds the sums of a batch (keys, values) under its number."""
        self._summed(batch).write.mode("overwrite").parquet(f"{self.folder}/added/batch={number}")
        if number % COMPACT == COMPACT - 1:
            self.compact(number)

    def compact(self, upto: int) -> None:
        bases = self._numbers("base")
        if upto not in bases:
            self.read(upto).write.mode("overwrite").parquet(f"{self.folder}/base/upto={upto}")
        for old in self._numbers("base"):
            if old < upto - COMPACT:  # the one before stays for readers that have begun
                remove(self.spark, f"{self.folder}/base/upto={old}")
        for n in self._numbers("added"):
            if n <= upto - COMPACT:
                remove(self.spark, f"{self.folder}/added/batch={n}")

    def read(self, upto: int | None = None) -> DataFrame:
        """keys, values as of the last complete batch, or of batch ``upto``."""
        bases = [n for n in self._numbers("base") if upto is None or n <= upto]
        base = bases[-1] if bases else -1
        paths = [f"{self.folder}/base/upto={base}"] * bool(bases)
        paths += [f"{self.folder}/added/batch={n}" for n in self._numbers("added") if n > base and (upto is None or n <= upto)]
        if not paths:
            raise ValueError(f"{self.folder} holds no complete batch")
        return self._summed(self.spark.read.parquet(*paths))

    def start(self, partial: DataFrame, checkpoint: str, **options: str) -> StreamingQuery:
        """Runs the stream ``partial`` (keys, values; a row for each row counted) over what is there, from where the checkpoint left off."""
        return partial.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).options(**options).trigger(availableNow=True).start()


def appended(stream: DataFrame, folder: str, checkpoint: str, kind: str = "parquet") -> StreamingQuery:
    """Appends what the stream yields to a log of files; batches that are replayed are not written twice."""
    return stream.writeStream.format(kind).option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
