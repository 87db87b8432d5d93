"""Document fingerprints: a Merkle tree over paragraphs and sections (native: SQL functions only).

A paragraph is a line; its leaves are the clauses that punctuation ends. A
section is a run of paragraphs; the paragraph's own hash decides whether it
opens a section (about one in eight), so an edit moves no distant boundary.
Nodes are SHA-256 of the children's hashes; the root tests equality, and the
levels below it show which branches differ.

Edge cases: a null text counts as empty; the empty text has a tree of one empty
paragraph; equal texts have equal fingerprints; rows that repeat an id are ordered
by their text; the single row of a table is its own neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, text_or_empty

CLAUSE = r"[^.,;:!?]*[.,;:!?]|[^.,;:!?]+"
BLOCK_BITS = 10


def short_hash(value: Column) -> Column:
    return F.substring(F.sha2(value, 256), 1, 12)


def with_tree(df: DataFrame, text: str, prefix: str) -> DataFrame:
    """Adds {prefix}leaves (array per paragraph), {prefix}paragraphs, {prefix}sections and {prefix}root."""
    leaves = F.transform(F.split(F.col(text), "\n", -1), lambda p: F.transform(F.regexp_extract_all(p, F.lit(CLAUSE), F.lit(0)), short_hash))
    df = df.withColumn(f"{prefix}leaves", leaves)
    df = df.withColumn(f"{prefix}paragraphs", F.transform(f"{prefix}leaves", lambda a: short_hash(F.array_join(a, ","))))
    opened = F.regexp_replace(F.array_join(f"{prefix}paragraphs", ","), ",([01])", ";$1")
    df = df.withColumn(f"{prefix}sections", F.transform(F.split(opened, ";", -1), short_hash))
    return df.withColumn(f"{prefix}root", F.sha2(F.array_join(f"{prefix}sections", ","), 256)).withColumn(f"{prefix}leaves", F.flatten(f"{prefix}leaves"))


def fingerprint(prefix: str) -> Column:
    """root|sections|paragraphs|leaves."""
    return F.concat_ws("|", f"{prefix}root", *[F.array_join(f"{prefix}{level}", ",") for level in ("sections", "paragraphs", "leaves")])


def likeness(a: str, b: str) -> Column:
    """1 for equal roots, else shared leaves over the leaves of the larger tree."""
    shared = F.size(F.array_intersect(f"{a}leaves", f"{b}leaves"))
    most = F.greatest(F.size(F.array_distinct(f"{a}leaves")), F.size(F.array_distinct(f"{b}leaves")))
    return F.when(F.col(f"{a}root") == F.col(f"{b}root"), F.lit(1.0)).otherwise(F.coalesce(shared / F.when(most > 0, most), F.lit(0.0)))


def differing(a: str, b: str) -> Column:
    """``first:stop``, the paragraphs of ``a`` from the first branch that differs from ``b`` to past the last; empty for equal trees. Branches are compared from both ends, so an edit that adds or drops paragraphs moves nothing else."""
    same = lambda x, y: F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    first = F.array_position(same(F.col(f"{a}paragraphs"), F.col(f"{b}paragraphs")), F.lit(False)) - 1
    last = F.array_position(same(F.reverse(f"{a}paragraphs"), F.reverse(f"{b}paragraphs")), F.lit(False)) - 1
    stop = F.greatest(F.size(f"{a}paragraphs") - last, first)
    return F.when(first < 0, F.lit("")).otherwise(F.concat_ws(":", first.cast("string"), stop.cast("string")))


def with_next_text(docs: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """doc_id, text, next_text: the text of the next row in descending doc_id; after the last, the first.

    Rows meet in blocks of neighbouring ids, of about 2**bits rows by the mean gap between ids,
    so a task holds a bounded number of them and texts are shuffled once. Rows without an id come last, by
    text, in blocks of equal first bytes. Each block also gets, as its last
    row, the head of the next block below; heads come from a partial aggregate.
    The order of blocks is found over superblocks of blocks.
    """
    base = docs.select("doc_id", text_or_empty().alias("text"))
    whole = docs.agg(F.min(F.col("doc_id").cast("long")).alias("a"), F.max(F.col("doc_id").cast("long")).alias("b"), F.count("doc_id").alias("n")).first()
    gap = (whole["b"] - whole["a"]) // max(1, whole["n"]) if whole["n"] else 0
    none = F.lit(-(1 << 62)) + F.coalesce(F.conv(F.rpad(F.hex(F.substring(F.encode("text", "UTF-8"), 1, 3)), 6, "0"), 16, 10).cast("long"), F.lit(0))
    base = base.withColumn("block", F.coalesce(F.shiftright(F.col("doc_id").cast("long"), bits + max(0, gap.bit_length() - 1)), none))
    order = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63) + 1)).alias("id"), F.col("text"))
    heads = base.groupBy("block").agg(F.max(order).alias("head"))
    blocks = base.select("block").distinct().withColumn("over", F.shiftright("block", bits))
    inside = F.lead("block").over(Window.partitionBy("over").orderBy(F.desc("block")))
    first = blocks.groupBy("over").agg(F.max("block").alias("top"))
    first = first.select("over", F.coalesce(F.lead("top").over(Window.orderBy(F.desc("over"))), F.max("top").over(Window.partitionBy())).alias("after"))
    below = blocks.withColumn("inside", inside).join(first, "over").select(F.coalesce("inside", "after").alias("head_block"), F.col("block").alias("to_block"))
    tails = heads.join(below, F.col("block") == F.col("head_block")).select(F.lit(None).cast(base.schema["doc_id"].dataType).alias("doc_id"), F.col("head.text").alias("text"), F.col("to_block").alias("block"), F.lit(1).alias("tail"))
    both = base.withColumn("tail", F.lit(0)).unionByName(tails)
    chain = Window.partitionBy("block").orderBy("tail", F.col("doc_id").desc_nulls_last(), F.desc("text"))
    return both.withColumn("next_text", F.lead("text").over(chain)).filter("tail = 0").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its tree, that of its edited text and the likeness to that and to the next document."""
    df = with_next_text(docs).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    df = df.withColumn("edited", F.concat(F.left("text", (F.col("n_chars") - cut).cast("int")), F.left("next_text", cut)))
    for text, prefix in (("text", "own_"), ("edited", "edited_"), ("next_text", "next_")):
        df = with_tree(df, text, prefix)
    return df


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("own_").alias("fingerprint"), fingerprint("edited_").alias("edited_fingerprint"),
        likeness("own_", "edited_").alias("near_edited"), likeness("own_", "next_").alias("near_next"),
        differing("edited_", "own_").alias("edited_paragraphs"),
    )


def _tree_sql(text: str) -> str:
    leaves = f"list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.,;:!?]*[.,;:!?]|[^.,;:!?]+'), lambda c: substr(sha256(c), 1, 12)))"
    return f"{leaves}"


OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS next_text, length(text) AS n_chars FROM d),
e AS (SELECT *, left(text, n_chars - n_chars // 3) || CASE WHEN n_chars // 3 > 0 THEN left(next_text, n_chars // 3) ELSE '' END AS edited FROM n),
l AS (SELECT *, {_tree_sql('text')} AS l1, {_tree_sql('edited')} AS l2, {_tree_sql('next_text')} AS l3 FROM e),
p AS (SELECT *, list_transform(l1, lambda a: substr(sha256(array_to_string(a, ',')), 1, 12)) AS p1, list_transform(l2, lambda a: substr(sha256(array_to_string(a, ',')), 1, 12)) AS p2,
   list_transform(l3, lambda a: substr(sha256(array_to_string(a, ',')), 1, 12)) AS p3 FROM l),
s AS (SELECT *, list_transform(string_split(regexp_replace(array_to_string(p1, ','), ',([01])', ';\\1', 'g'), ';'), lambda x: substr(sha256(x), 1, 12)) AS s1,
   list_transform(string_split(regexp_replace(array_to_string(p2, ','), ',([01])', ';\\1', 'g'), ';'), lambda x: substr(sha256(x), 1, 12)) AS s2,
   list_transform(string_split(regexp_replace(array_to_string(p3, ','), ',([01])', ';\\1', 'g'), ';'), lambda x: substr(sha256(x), 1, 12)) AS s3 FROM p),
r AS (SELECT *, sha256(array_to_string(s1, ',')) AS r1, sha256(array_to_string(s2, ',')) AS r2, sha256(array_to_string(s3, ',')) AS r3, flatten(l1) AS f1, flatten(l2) AS f2, flatten(l3) AS f3 FROM s)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256,
  concat_ws('|', r1, array_to_string(s1, ','), array_to_string(p1, ','), array_to_string(f1, ',')) AS fingerprint,
  concat_ws('|', r2, array_to_string(s2, ','), array_to_string(p2, ','), array_to_string(f2, ',')) AS edited_fingerprint,
  CASE WHEN r1 = r2 THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(f1, f2))::DOUBLE / nullif(greatest(len(list_distinct(f1)), len(list_distinct(f2))), 0), 0) END AS near_edited,
  CASE WHEN r1 = r3 THEN 1.0::DOUBLE ELSE coalesce(len(list_intersect(f1, f3))::DOUBLE / nullif(greatest(len(list_distinct(f1)), len(list_distinct(f3))), 0), 0) END AS near_next,
  CASE WHEN p1 = p2 THEN '' ELSE (list_position(list_transform(list_zip(p2, p1), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1) || ':' || greatest(len(p2) - (list_position(list_transform(list_zip(list_reverse(p2), list_reverse(p1)), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1),
    list_position(list_transform(list_zip(p2, p1), lambda z: z[1] IS NOT DISTINCT FROM z[2]), false) - 1) END AS edited_paragraphs
FROM r
"""
