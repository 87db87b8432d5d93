"""Keys that stand for each other: classes from pairs of equivalent keys, and exclusion by class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def key_classes(pairs: DataFrame, rounds: int = 64) -> DataFrame:
    """key, class: the least key that pairs (a, b) lead to, for every key of a pair.

    In each round a key takes the least name among itself and its neighbours, and then the name of that name, so chains
    shrink by more than half. Names are written between rounds. Pairs of a key with itself, doubles and nulls do no harm.
    """
    pairs = pairs.select("a", "b").dropna()
    both = written(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    names = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("key"), F.least("a", "m").alias("class")))
    for _ in range(rounds):
        near = both.join(names, F.col("b") == F.col("key")).groupBy("a").agg(F.min("class").alias("m"))
        lower = names.join(near, F.col("key") == F.col("a")).select("key", F.col("class").alias("was"), F.least("class", "m").alias("class"))
        named = lower.select(F.col("key").alias("__k"), F.col("class").alias("__c"))
        following = written(lower.join(named, F.col("class") == F.col("__k")).select("key", "was", F.col("__c").alias("class")))
        names = following.select("key", "class")
        if following.filter("was <> class").isEmpty():
            return names
    raise RuntimeError(f"key_classes: names still change after {rounds} rounds")


def excluded(rows: DataFrame, key: str, keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows whose key stands for none of the ``keys`` (key), by any chain of pairs. Rows without a key stay."""
    names = key_classes(pairs)
    named = lambda df, c: df.join(names.withColumnRenamed("key", "__key"), F.col(c) == F.col("__key"), "left").withColumn("__class", F.coalesce("class", F.col(c))).drop("__key", "class")
    out = named(keys.select("key"), "key").select(F.col("__class").alias("__out")).distinct()
    return named(rows, key).join(out, F.col("__class") == F.col("__out"), "left_anti").drop("__class")
