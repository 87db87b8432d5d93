"""From raw documents to packed training sequences, in five stages.

Each stage is written as Parquet and read again as the next one's input, so a
lost executor costs a part of one stage. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded_batches, likely, materialised, shared_folder
from sparkloom.llm.langid import UNKNOWN, fit, predict, training_rows
from sparkloom.llm.mixing import mix
from sparkloom.llm.neardup import classes
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.secrets import redacted, scan

MIN_LANGUAGE_SHARE = 0.5


def guarded(docs: DataFrame, *own: str) -> DataFrame:
    """docs with every column but ``own`` under a name that no operator uses."""
    return docs.select(*[F.col(f"`{c}`").alias(c if c in own else f"__column{i}") for i, c in enumerate(docs.columns)])


def restored(found: DataFrame, docs: DataFrame, *own: str) -> DataFrame:
    """The columns of docs, from a result of guarded(docs, *own)."""
    return found.select(*[F.col(c if c in own else f"__column{i}").alias(c) for i, c in enumerate(docs.columns)])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language go on: not ``und``, and half of the letters or more in one language."""
    bounded_batches(spark)
    plain = guarded(docs, "doc_id", "text")
    labelled = predict(plain, fit(training_rows(docs)), plain.columns)
    return restored(labelled.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SHARE)), docs, "doc_id", "text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each class stays, once if its row is repeated; rows without an id go on.

    The rows to leave out are joined, not the classes, and only rows whose id may
    be among them are shuffled. Rows of one id with different texts are different documents.
    """
    bounded_batches(spark)
    named = materialised(classes(docs, text_hash=True))
    gone = named.filter("doc_id <> class_id").select("doc_id", "v").distinct()
    repeated = named.filter("doc_id = class_id").groupBy("doc_id", "v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id", "v")
    out = materialised(gone.union(repeated)).select(F.col("doc_id").alias("__doc"), F.col("v").alias("__v"))
    once = materialised(repeated).select(F.col("doc_id").alias("__doc"), F.col("v").alias("__v"))
    row, hashed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64("text")
    same = (F.col("doc_id") == F.col("__doc")) & F.when(F.col("text").isNotNull(), hashed).eqNullSafe(F.col("__v"))
    stay = likely(docs, out, "doc_id", key="__doc", inverse=True).unionByName(likely(docs, out, "doc_id", key="__doc").join(out, same, "left_anti"))
    if once.isEmpty():
        return stay
    copies = docs.join(once, same, "left_semi").select("doc_id", "text", row.alias("__whole")).groupBy("doc_id", "text").agg(F.min_by("__whole", F.to_json("__whole")).alias("__whole"))
    return stay.unionByName(copies.select("__whole.*"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in it is replaced by a mark, and n_chars follows the text."""
    own = ("doc_id", "text", "n_chars")
    found = scan(guarded(docs, *own))
    clean = F.when(F.col("text").isNull(), F.col("text")).otherwise(redacted(F.col("text"), F.col("spans")))
    found = found.withColumn("text", clean).withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return restored(found, docs, *own)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    bounded_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: SQL cannot express the models, samples and tokenizers of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them goes to the cluster's shared folder."""
    folder, docs = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}", spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
