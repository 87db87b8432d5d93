"""Mixing sources to target weights (native: SQL functions only).

Tokens are aggregated per source, targets are water-filled under a repetition
cap, and a document is emitted floor(rate) times plus once more with the
probability that the fraction gives, drawn by a hash of seed and id (or text,
where there is no id).

Edge cases: a null text has size 0; a null source is a source of its own, last
in order; an empty table gives an empty result; repeated rows of one id draw
alike; further columns pass through ``mix`` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, table, unit_hash

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, target, rate.

    The reshare of whatever exceeds a cap is solved in closed form: sources are
    sorted by cap over weight; those below the common level stop at their cap
    and the others share the rest by weight. The frame has one row per source,
    so its windows hold the source dimension, never the documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("full", (F.col("total") - F.col("caps_before")) / F.col("weight_left") > F.col("ratio"))
        .withColumn("full_caps", F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(whole))
        .withColumn("free_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(whole))
    )
    target = F.when(F.col("full"), F.col("cap")).otherwise((F.col("total") - F.col("full_caps")) / F.col("free_weight") * F.col("weight"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(F.lit(0.0))
    return per.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def draw(seed: int) -> Column:
    """A row's draw: by its id, or by its text if it has none. Rows without an id that have the same text share one."""
    return unit_hash(seed, F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit("")))


def mix_plan(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, rate, copies.

    Only (doc_id, source, size) is shuffled. The join side has one row per
    source: Spark broadcasts it where its measured size is under the session's
    threshold, and otherwise sorts and splits the hot source.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(seed).alias("__draw"))
    per = source_targets(sized, weights, cap).withColumnRenamed("source", "__source")
    joined = sized.join(per, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    extra = (F.col("__draw") < F.col("rate") - F.floor("rate")).cast("long")
    return joined.withColumn("copies", F.when(F.col("rate") > 0, F.floor("rate") + extra).otherwise(F.lit(0)).cast("long")).drop("__draw")


def mix(docs: DataFrame, weights=WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """The mixture itself: every document as often as its plan says, all its columns kept.

    The rates are a written table of one row per source, so their size is known before the join is planned:
    under the session's broadcast threshold they go to the rows, and no text is shuffled; beyond it the join sorts.
    """
    sized = docs.select("source", word_count(F.col("text")).alias("size"))
    per = materialised(source_targets(sized, weights, cap).select(F.col("source").alias("__source"), F.col("rate").alias("__rate")))
    joined = docs.join(per, F.col("source").eqNullSafe(F.col("__source")))
    extra = (draw(seed) < F.col("__rate") - F.floor("__rate")).cast("int")
    copies = F.floor("__rate").cast("int") + extra
    return joined.withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP10_SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(doc_id::VARCHAR, md5(text), '') AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
w AS (SELECT *, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM per),
r AS (SELECT *, cap / weight AS ratio, (sum(source_size) OVER ())::DOUBLE AS total FROM w),
p AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
        sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left FROM r),
f AS (SELECT *, (total - caps_before) / weight_left > ratio AS is_full FROM p),
g AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER () AS full_caps, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS free_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE (total - full_caps) / free_weight * weight END AS target FROM g),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0) ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  CAST(size * CASE WHEN rate > 0 THEN floor(rate) + CASE WHEN (('0x' || substr(md5('20:' || key), 1, 8))::BIGINT + 0.5) / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS taken
FROM sized JOIN u ON sized.source IS NOT DISTINCT FROM u.source
"""
