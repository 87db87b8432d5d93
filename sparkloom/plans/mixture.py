"""Mixtures: shares, budgets, caps, splits and weighted sampling, all with stateless draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform, uniform_sql
from ..functions.text import chunk_count
from ..operators.draws import smallest_draws
from ..operators.ordered import running_before, top_per_group, within_budget
from ..sources.tables import table
from .corpus import _CHUNK_SQL

SEED, BUDGET = 7, 500_000


def tokens_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "documents").select("source", chunk_count(F.col("text")).alias("n")).groupBy("source").agg(F.count(F.lit(1)).alias("examples"), F.sum("n").cast("long").alias("tokens"))
    return per.withColumn("token_share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 4))


def variant_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    rolled = rows.groupingSets([["lang"], ["lang", "source"]], "lang", "source").agg(F.count(F.lit(1)).alias("tasks"), F.sum("quality").cast("long").alias("passed"))
    return rolled.select("lang", F.coalesce("source", F.lit("*")).alias("source"), "tasks", "passed")


def lost_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rows per language and source; combinations without one count 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    failed = table(spark, sf_dir, "labels").filter("quality = 0").join(docs, "doc_id").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    every = docs.select("lang").distinct().crossJoin(docs.select("source").distinct())  # two small dimensions, not rows
    return every.join(failed, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("lost"))


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first max(1, floor(2 %)) rows in the order of a draw are validation."""
    docs = table(spark, sf_dir, "documents").select("doc_id", uniform(SEED, F.col("doc_id")).alias("u"))
    quota = F.greatest(F.lit(1), F.floor(F.col("__all") * 0.02))
    val = smallest_draws(docs, "u", "doc_id", [], quota).select(F.col("doc_id").alias("val_id"))
    return docs.join(val, F.col("doc_id") == F.col("val_id"), "left").select("doc_id", F.when(F.col("val_id").isNotNull(), "val").otherwise("train").alias("split"))


def budget_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return within_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", BUDGET).select("doc_id", "n_chars", "before")


def sft_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_before(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("length")), "doc_id", "length", "start").select("doc_id", "start", "length")


def weighted_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sampling without replacement: per language the 20 largest u ** (1 / w), w the length over its mean."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    mean = docs.groupBy("lang").agg(F.sum("n_chars").alias("s"), F.count(F.lit(1)).alias("c"))
    keyed = docs.join(mean, "lang").withColumn("key", F.round(F.pow(uniform(SEED, F.col("doc_id")), F.col("s") / F.col("c") / F.col("n_chars")), 9))
    return top_per_group(keyed, ["lang"], [F.desc("key"), F.col("doc_id")], 20).select("doc_id", "lang", "key")


def cap_per_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("body")), ["body"], [F.col("doc_id")], 2)


def stratified_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """30 % of each (language, source), by draw; no stratum is ordered as a whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", uniform(SEED, F.col("doc_id")).alias("u"))
    return smallest_draws(docs, "u", "doc_id", ["lang", "source"], F.round(F.col("__all") * 0.3)).select("doc_id", "lang", "source")


def systematic_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items of odd id all of whose words also stand in an item of even id."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word"))
    known = words.filter("item_id % 2 = 0").select("word").distinct().withColumn("known", F.lit(1))
    test = words.filter("item_id % 2 = 1").join(known, "word", "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("parts"), F.count("known").alias("known_parts"))
    return test.select("item_id", "parts", "known_parts", (F.col("parts") == F.col("known_parts")).alias("held_out"))


def exposure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per user, then by event type: mean, least, upper median and most exposures."""
    seen = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"))
    per = seen.groupBy("event_type", "n").agg(F.count(F.lit(1)).alias("users"))  # a histogram: bounded by the distinct counts
    up = F.sum("users").over(Window.partitionBy("event_type").orderBy("n"))
    per = per.withColumn("upto", up).withColumn("all", F.sum("users").over(Window.partitionBy("event_type")))
    return per.groupBy("event_type").agg(F.max("all").cast("long").alias("behaviours"), F.round(F.sum(F.col("n") * F.col("users")) / F.sum("users"), 4).alias("mean"), F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"), F.max("n").alias("most"))


def replay_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that drops a document, and how many each drops."""
    text = F.col("text")
    reason = F.when(F.length(text) > 20_000, "too long").when(text.rlike("(?i)license"), "licence").when(text.rlike(r"[A-Za-z0-9._]+@[A-Za-z0-9.]+"), "address").when(F.length(text) < 100, "too short")
    return table(spark, sf_dir, "documents").groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (tokens_by_source, variant_group_scores, lost_by_category, train_val_split, budget_cutoff, sft_offsets, weighted_replay, cap_per_body, stratified_holdout, systematic_holdout, exposure_summary, replay_filter_reasons)}
_U = uniform_sql(SEED, "doc_id")
ORACLE_SQL = {
    "tokens_by_source": f"WITH t AS (SELECT source, len(regexp_extract_all(text, '{_CHUNK_SQL}')) AS n FROM documents), g AS (SELECT source, count(*) AS examples, sum(n)::BIGINT AS tokens FROM t GROUP BY source) SELECT *, round(tokens / (sum(tokens) OVER ())::DOUBLE, 4) AS token_share FROM g",
    "variant_group_scores": "SELECT lang, coalesce(source, '*') AS source, count(*) AS tasks, sum(quality)::BIGINT AS passed FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((lang), (lang, source))",
    "lost_by_category": "SELECT l.lang, s.source, (SELECT count(*) FROM labels JOIN documents d USING (doc_id) WHERE quality = 0 AND d.lang = l.lang AND d.source = s.source) AS lost FROM (SELECT DISTINCT lang FROM documents) l CROSS JOIN (SELECT DISTINCT source FROM documents) s",
    "train_val_split": f"SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY {_U}, doc_id) <= greatest(1, floor(count(*) OVER () * 0.02)) THEN 'val' ELSE 'train' END AS split FROM documents",
    "budget_cutoff": f"WITH r AS (SELECT doc_id, n_chars, (coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before FROM documents) SELECT * FROM r WHERE before < {BUDGET}",
    "sft_offsets": "SELECT doc_id, (coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, n_chars AS length FROM documents",
    "weighted_replay": f"WITH m AS (SELECT doc_id, lang, round(pow({_U}, (sum(n_chars) OVER (PARTITION BY lang))::DOUBLE / count(*) OVER (PARTITION BY lang) / n_chars), 9) AS key FROM documents) SELECT doc_id, lang, key FROM m QUALIFY row_number() OVER (PARTITION BY lang ORDER BY key DESC, doc_id) <= 20",
    "cap_per_body": "SELECT doc_id, md5(text) AS body FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) <= 2",
    "stratified_holdout": f"SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_U}, doc_id) <= round(count(*) OVER (PARTITION BY lang, source) * 0.3)",
    "systematic_holdout": "WITH w AS (SELECT item_id, unnest(list_distinct(string_split_regex(lower(text), '\\s+'))) AS word FROM benchmark), k AS (SELECT DISTINCT word FROM w WHERE item_id % 2 = 0) SELECT item_id, count(*) AS parts, count(k.word) AS known_parts, count(*) = count(k.word) AS held_out FROM w LEFT JOIN k USING (word) WHERE item_id % 2 = 1 GROUP BY item_id",
    "exposure_summary": "WITH s AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), a AS (SELECT event_type, list_sort(list(n)) AS v FROM s GROUP BY 1) SELECT event_type, len(v)::BIGINT AS behaviours, round(list_sum(v)::DOUBLE / len(v), 4) AS mean, v[1] AS least, v[len(v) // 2 + 1] AS median, v[len(v)] AS most FROM a",
    "replay_filter_reasons": "SELECT CASE WHEN length(text) > 20000 THEN 'too long' WHEN regexp_matches(text, '(?i)license') THEN 'licence' WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 'address' WHEN length(text) < 100 THEN 'too short' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1",
}
