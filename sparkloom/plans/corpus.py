"""Corpus queries: scanning, filtering, exact de-duplication and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LICENSE, chunk_count, chunks, glob_pattern, lines, mean_line_length, without_license
from ..operators.bpe import decoded, encoded, train_merges
from ..operators.dedup import keep_first
from ..sources.tables import table

MERGES = 32


def corpus_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("text_sha1"))
    return keep_first(docs, ["text_sha1"], "doc_id")


def corpus_quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 500,000 bytes, no NUL in the first 4,096, not blank, lines of 200 characters at most on average."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter((F.octet_length("text") <= 500_000) & F.col("text").rlike(r"\S") & (F.instr(F.left("text", F.lit(4096)), "\0") == 0))
    return docs.select("doc_id", F.round(mean_line_length(F.col("text")), 4).alias("mean_len")).filter("mean_len <= 200")


def strip_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    headed = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("# Copyright 2020 A\n# License: B\n#\n\n"), F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(without_license(headed)).alias("text_md5"))


def license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.size(F.filter(lines(F.col("text")), lambda x: x.rlike(LICENSE))).cast("long")
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("n_lines")).filter("n_lines > 0")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", chunk_count(F.col("text")).cast("long").alias("n_chunks"))


def bpe_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the first merge's character pairs, over distinct chunks times their counts; the top 100."""
    counted = table(spark, sf_dir, "documents").select(F.explode(chunks(F.col("text"))).alias("chunk")).groupBy("chunk").agg(F.count(F.lit(1)).alias("n")).filter(F.length("chunk") > 1)
    at = F.explode(F.sequence(F.lit(1), F.length("chunk") - 1))
    pairs = counted.select("n", "chunk", at.alias("i")).select("n", F.expr("substring(chunk, i, 2)").alias("pair"))
    return pairs.groupBy("pair").agg(F.sum("n").cast("long").alias("n")).orderBy(F.desc("n"), "pair").limit(100)


def bpe_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first merges of byte-pair tokens over all chunks of all documents, in order."""
    learned = train_merges(table(spark, sf_dir, "documents"), MERGES)
    return spark.createDataFrame([(i, *m) for i, m in enumerate(learned)], "rank long, left int, right int, n long")


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each text comes back whole from its ids."""
    learned = train_merges(table(spark, sf_dir, "documents"), MERGES)
    ids = table(spark, sf_dir, "documents").select("doc_id", "text", encoded(F.col("text"), learned).alias("ids"))
    return ids.select("doc_id", (decoded(F.col("ids"), learned) == F.col("text")).alias("same"))


def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hash of the table's content, whatever its order: hashes of blocks of ids, of blocks of those blocks, then of all of these in order; no group holds more than 1,024 hashes but the last, with one for each 2**20 ids."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("place"), F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "h"))), lambda x: x["h"]), "\n"), 256).alias("h")
    for _ in range(2):
        rows = rows.groupBy(F.shiftright("place", 10).alias("block")).agg(joined).withColumnRenamed("block", "place")
    return rows.agg(joined.alias("content_sha256"))


def regex_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike("(?i)license"))
    hits = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "content")).filter(F.col("content").rlike("(?i)license"))
    return hits.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), F.left("content", F.lit(200)).alias("content"))


def glob_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").filter(F.col("url").rlike(glob_pattern("*1*"))).select("page_id", "url")


def tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders of the pages' addresses to depth three, with their pages."""
    parts = F.split(F.regexp_replace("url", "^[a-z]+://", ""), "/", -1)
    depths = table(spark, sf_dir, "pages").select(parts.alias("p"), F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size(parts)))).alias("depth"))
    return depths.select(F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("path"), F.col("depth").cast("long").alias("depth")).groupBy("path", "depth").agg(F.count(F.lit(1)).alias("pages"))


# Single-line mutations (old, new).
MUTATIONS = (
    (" + 1)", ")"), ("<=", "<"), (">=", ">"), (" < ", " <= "), (" > ", " >= "), ("[::-1]", ""), ("[0]", "[-1]"), ("[-1]", "[0]"), ("max(", "min("), ("min(", "max("), (".upper()", ".lower()"),
    (".lower()", ".upper()"), ("reverse=True", "reverse=False"), (" not in ", " in "), (" in ", " not in "), ("x * x", "x * 2"), ("return a\n", "return b\n"), ("return b\n", "return a\n"), ("+= 1", "+= 2"),
    ("[:n]", "[:n - 1]"), ("[n:]", "[n + 1:]"), ("startswith", "endswith"), ("endswith", "startswith"), ("[i:i + size]", "[i:i + size - 1]"), ("== 0", "!= 0"), (" // ", " / "), ("2 * (", "("),
    (" < ", " > "), (" > ", " < "), (" <= ", " >= "), (" >= ", " <= "),
)
#: Code lines that stand before each text, since the texts hold prose.
SNIPPET = "def f(a, b, n):\n    for i in range(n + 1):\n        if a[i] <= b and i > 0:\n            a = max(a[::-1], key=len)\n    return a\n"


def text_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with each mutation that applies, its first occurrence replaced; lines that begin a function or a docstring are left alone."""
    changes = F.array(*[F.struct(F.lit(a).alias("old"), F.lit(b).alias("new")) for a, b in MUTATIONS])
    lines = F.split(F.concat(F.lit(SNIPPET), "text"), "(?<=\n)", -1)
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(lines).alias("line", "content"))
    rows = rows.filter(~F.ltrim("content").startswith("def ") & ~F.ltrim("content").startswith('"""')).select("item_id", "line", "content", F.inline(changes)).filter(F.expr("contains(content, old)"))
    mutated = F.expr("concat(left(content, instr(content, old) - 1), new, substring(content, instr(content, old) + length(old)))")
    return rows.select("item_id", F.col("line").cast("long").alias("line"), "old", "new", F.md5(mutated).alias("mutated_md5"))


def _quoted(text: str) -> str:
    """A DuckDB string literal."""
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


QUERIES = {f.__name__: f for f in (corpus_exact_dedup, corpus_quality_filter, strip_license, license_lines, chunk_counts, bpe_pair_counts, bpe_merges, bpe_round_trip, content_fingerprint, regex_search, glob_filter, tree_listing, text_mutations)}
_CHUNK_SQL = r"\n[ \t]*| ?[A-Za-z_][A-Za-z0-9_]*| ?[0-9]{1,3}| ?[^\sA-Za-z0-9_]+|[ \t]+|\s"
_LINES = "string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10))"
ORACLE_SQL = {
    "bpe_round_trip": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN true END AS same FROM documents",
    "corpus_exact_dedup": "SELECT min(doc_id) AS doc_id, sha1(text) AS text_sha1 FROM documents GROUP BY sha1(text)",
    "corpus_quality_filter": f"""WITH l AS (SELECT doc_id, text, {_LINES} AS a FROM documents), m AS (SELECT doc_id, text, round(list_sum(list_transform(a, lambda x: length(x)))::DOUBLE / len(a), 4) AS mean_len FROM l)
        SELECT doc_id, mean_len FROM m WHERE strlen(text) <= 500000 AND regexp_matches(text, '\\S') AND NOT contains(left(text, 4096), chr(0)) AND mean_len <= 200""",
    "strip_license": "SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN regexp_replace(text, '^((#[^\\n]*|[ \\t]*)\\n)+', '') ELSE text END) AS text_md5 FROM documents",
    "license_lines": f"SELECT doc_id, len(list_filter({_LINES}, lambda x: regexp_matches(x, '(?i)licen[sc]e|copyright|\\(c\\) \\d{{4}}')))::BIGINT AS n_lines FROM documents WHERE n_lines > 0",
    "chunk_counts": f"SELECT doc_id, len(regexp_extract_all(text, '{_CHUNK_SQL}'))::BIGINT AS n_chunks FROM documents",
    "bpe_pair_counts": f"""WITH c AS (SELECT unnest(regexp_extract_all(text, '{_CHUNK_SQL}')) AS chunk FROM documents), g AS (SELECT chunk, count(*) AS n FROM c WHERE length(chunk) > 1 GROUP BY chunk),
        p AS (SELECT n, chunk, unnest(range(1, length(chunk))) AS i FROM g) SELECT substr(chunk, i, 2) AS pair, sum(n)::BIGINT AS n FROM p GROUP BY 1 ORDER BY n DESC, pair LIMIT 100""",
    "content_fingerprint": """WITH b AS (SELECT doc_id >> 10 AS block, sha256(string_agg(sha256(doc_id || '|' || text), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1),
        c AS (SELECT block >> 10 AS block, sha256(string_agg(h, chr(10) ORDER BY block)) AS h FROM b GROUP BY block >> 10) SELECT sha256(string_agg(h, chr(10) ORDER BY block)) AS content_sha256 FROM c""",
    "regex_search": """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), p AS (SELECT doc_id, unnest(a) AS content, unnest(range(1, len(a) + 1)) AS line FROM l)
        SELECT doc_id, line::BIGINT AS line, left(content, 200) AS content FROM p WHERE regexp_matches(content, '(?i)license')""",
    "glob_filter": "SELECT page_id, url FROM pages WHERE url LIKE '%1%'",
    "tree_listing": """WITH p AS (SELECT string_split(regexp_replace(url, '^[a-z]+://', ''), '/') AS p FROM pages), d AS (SELECT p, unnest(range(1, least(3, len(p)) + 1)) AS depth FROM p)
        SELECT array_to_string(p[1:depth], '/') AS path, depth::BIGINT AS depth, count(*) AS pages FROM d GROUP BY 1, 2""",
    "text_mutations": f"""WITH l AS (SELECT item_id, string_split({_quoted(SNIPPET)} || text, chr(10)) AS a FROM benchmark), p AS (SELECT item_id, unnest(a) AS c, unnest(range(0, len(a))) AS line, len(a) AS n FROM l),
        k AS (SELECT item_id, line, c || CASE WHEN line < n - 1 THEN chr(10) ELSE '' END AS content FROM p), m(old, new) AS (VALUES """ + ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in MUTATIONS) + """)
        SELECT item_id, line::BIGINT AS line, old, new, md5(left(content, instr(content, old) - 1) || new || substr(content, instr(content, old) + length(old))) AS mutated_md5
        FROM k JOIN m ON contains(content, old) WHERE NOT starts_with(ltrim(content), 'def ') AND NOT starts_with(ltrim(content), '\"\"\"')""",
}
