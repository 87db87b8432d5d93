"""Writers of training sets: examples with offsets, a mixture with tags, a manifest, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import source_group
from ..operators.ordered import running_before


def content_hash(rows: DataFrame, *columns: str, bits: int = 10) -> DataFrame:
    """One SHA-256 of the rows whatever their order or files: row hashes are sorted within slices of the hash space, then slices are hashed in order.

    A slice holds 1 / 4**bits of the rows, and slices are hashed in two levels, so no task holds all hashes.
    """
    h = rows.select(F.sha2(F.to_json(F.struct(*columns)), 256).alias("h"))
    number = F.conv(F.substring("h", 1, (2 * bits + 3) // 4), 16, 10).cast("long")
    fine = h.groupBy(F.shiftright(number, bits).cast("int").alias("outer"), number.alias("inner")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    merged = lambda key: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "h"))), lambda x: x["h"]), "\n"), 256).alias("h")
    return fine.groupBy("outer").agg(merged("inner")).agg(merged("outer")).select(F.col("h").alias("content_sha256"))


def write_examples(examples: DataFrame, folder: str) -> int:
    """Writes ``examples`` (row, tag, tokens, mask) as <folder>/examples and their offsets as <folder>/index; the number of tokens."""
    sized = examples.withColumn("length", F.size("tokens").cast("long"))
    examples.write.parquet(f"{folder}/examples")
    running_before(sized.select("row", "tag", "length"), "row", "length", "start").select("row", "tag", "start", "length").write.parquet(f"{folder}/index")
    return int(sized.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"])


def tokens_by_group(examples: DataFrame) -> DataFrame:
    """tag_group, examples, tokens, answer_tokens (the first token is never a target), token_share."""
    answers = F.size(F.filter(F.slice("mask", 2, F.greatest(F.size("mask"), F.lit(1))), lambda x: x > 0))
    per = examples.groupBy(source_group(F.col("tag")).alias("tag_group")).agg(F.count(F.lit(1)).alias("examples"), F.sum(F.size("tokens")).cast("long").alias("tokens"), F.sum(answers).cast("long").alias("answer_tokens"))
    return per.withColumn("token_share", F.round(F.col("tokens") / F.greatest(F.sum("tokens").over(Window.partitionBy()), F.lit(1)), 4))


def write_manifest(examples: DataFrame, removed: DataFrame, folder: str, options: dict[str, str]) -> DataFrame:
    """One row of name, value: options, counts by reason, shares by tag group and the content's hash; removed rows (row, reason, prompt) go to <folder>/hygiene, prompts cut to 160 characters."""
    removed.withColumn("prompt", F.left("prompt", F.lit(160))).write.mode("overwrite").json(f"{folder}/hygiene")
    spark = examples.sparkSession
    facts = spark.createDataFrame([(f"option:{k}", str(v)) for k, v in sorted(options.items())], "name string, value string")
    facts = facts.unionByName(removed.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("removed:"), "reason").alias("name"), F.col("n").cast("string").alias("value")))
    facts = facts.unionByName(tokens_by_group(examples).select(F.concat(F.lit("tokens:"), "tag_group").alias("name"), F.col("tokens").cast("string").alias("value")))
    facts = facts.unionByName(content_hash(examples, "row", "tag", "tokens", "mask").select(F.lit("content_sha256").alias("name"), F.col("content_sha256").alias("value")))
    facts.write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def append_lines(rows: DataFrame, folder: str) -> None:
    """Appends rows as JSON lines."""
    rows.write.mode("append").json(folder)


def markdown_table(rows: DataFrame, limit: int = 200) -> str:
    """A Markdown table of a small result; more than ``limit`` rows are an error, not a cut."""
    found = rows.limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"a report holds at most {limit} rows")
    head = "| " + " | ".join(rows.columns) + " |\n|" + " --- |" * len(rows.columns)
    return "\n".join([head, *["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]])
