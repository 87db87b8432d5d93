"""Experiments: hygiene of examples, joins of answers and items, failure categories, exposure and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import SENSITIVE, as_task, chunks, docstring_summary, extract_code, middle_cut, source_group
from ..operators.hygiene import last_answers, removal_reasons, transitions
from ..sources.files import line_window
from ..sources.tables import table
from .chat import _PAIRS, pairs
from .corpus import _CHUNK_SQL

SEEDS = 5


def removed_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out answers are those of the first conversations."""
    rows = pairs(spark, sf_dir).withColumn("prompt", F.element_at(F.split("prompt", " "), 1))  # first words alone, so that tasks repeat
    return removal_reasons(rows, rows.filter("idx < 30000").select("response"))


def answers_of_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item (customer) with its last answer (order); items without one stay, answers without an item do not."""
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("item"))
    answers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("item"), "o_orderkey", "o_orderstatus")
    return items.join(last_answers(answers, ["item"], "o_orderkey"), "item", "left").select("item", F.col("o_orderkey").isNotNull().alias("answered"), "o_orderkey", "o_orderstatus")


def answer_diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with their item's facts, duplicates kept, others skipped."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(parts, "l_partkey").groupBy("p_brand", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def _run(spark: SparkSession, sf_dir: str, parity: int) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderkey") % 2 == parity).select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority")
    return last_answers(orders, ["o_custkey"], "o_orderkey").select("o_custkey", (F.col("o_orderstatus") == "F").alias("pass"), F.col("o_orderpriority").alias("category"))


def run_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of two runs: gained, lost, failed otherwise, the same."""
    return transitions(_run(spark, sf_dir, 0), _run(spark, sf_dir, 1), ["o_custkey"])


def regression_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the items that the first run passes, the share that the second fails."""
    both = _run(spark, sf_dir, 0).select("o_custkey", F.col("pass").alias("was")).join(_run(spark, sf_dir, 1), "o_custkey")
    lost = F.count_if(F.col("was") & ~F.col("pass"))
    return both.agg(F.count_if("was").alias("passed"), lost.alias("lost"), F.round(lost / F.count_if("was"), 6).alias("rate"))


def tagged_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents tagged by a lookup of their body among the labelled ones of good quality; the rest get a default tag."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("body"))
    good = table(spark, sf_dir, "labels").filter("quality = 1").join(docs, "doc_id").groupBy("body").agg(F.min("doc_id").alias("first"))
    tag = F.coalesce(F.concat(F.lit("curriculum:"), F.col("first").cast("string")), F.lit("curriculum:other"))
    return docs.join(good, "body", "left").select("doc_id", tag.alias("tag"))


def seen_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their exposure by position, 0 where there is none, summed by source."""
    seen = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("tokens"))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(seen, "doc_id", "left")
    return rows.groupBy("source").agg(F.sum(F.coalesce("tokens", F.lit(0))).cast("long").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("touched"))


def exposure_per_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposures of every customer, those never seen too: mean, least, upper median, most, never seen. Order statistics come from a histogram."""
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    per = table(spark, sf_dir, "customer").select("c_custkey").join(seen, "c_custkey", "left").groupBy(F.coalesce("n", F.lit(0)).alias("n")).agg(F.count(F.lit(1)).alias("k"))
    per = per.withColumn("upto", F.sum("k").over(Window.orderBy("n"))).withColumn("all", F.sum("k").over(Window.partitionBy()))
    return per.agg(F.max("all").cast("long").alias("behaviours"), F.round(F.sum(F.col("n") * F.col("k")) / F.sum("k"), 2).alias("mean"), F.min("n").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("n"))).alias("median"), F.max("n").alias("most"), F.coalesce(F.sum(F.when(F.col("n") == 0, F.col("k"))), F.lit(0)).cast("long").alias("never_seen"))


def answer_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of prompts and answers by task length; the first piece of a row is never a target."""
    rows = pairs(spark, sf_dir).select(F.when(F.length("prompt") > 60, "long").otherwise("short").alias("kind"), F.size(chunks(F.col("prompt"))).alias("p"), F.size(chunks(F.col("response"))).alias("r"))
    per = rows.groupBy("kind").agg(F.count(F.lit(1)).alias("examples"), F.sum(F.col("p") + F.col("r")).cast("long").alias("tokens"), F.sum(F.when(F.col("p") > 0, F.col("r")).otherwise(F.greatest(F.col("r") - 1, F.lit(0)))).cast("long").alias("answer_tokens"))
    return per.withColumn("token_share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 4))


def arm_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specification by arm by seed, seed first: three small dimensions."""
    docs = table(spark, sf_dir, "documents")
    arms, specs = docs.filter("lang is not null").select("lang").distinct(), docs.filter("source is not null").select("source").distinct()
    plan = spark.range(SEEDS).select(F.col("id").alias("seed")).crossJoin(F.broadcast(arms)).crossJoin(F.broadcast(specs))
    return plan.select("seed", "lang", "source", F.row_number().over(Window.partitionBy("seed").orderBy("lang", "source")).cast("long").alias("place"))


def weighted_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of value times weight over sum of weights, overall and by kind."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("w"), F.round(F.col("l_discount") * 100).cast("long").alias("v"))
    return lines.rollup("l_returnflag").agg(F.round(F.sum(F.col("v") * F.col("w")) / F.sum("w"), 6).alias("mean"), F.sum("w").alias("weight")).select(F.coalesce("l_returnflag", F.lit("*")).alias("kind"), "mean", "weight")


def body_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a body occurs in a seed on average; those that occur twice at least."""
    return table(spark, sf_dir, "documents").groupBy(F.md5("text").alias("body")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("body", F.round(F.col("n") / SEEDS, 2).alias("per_seed"))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps and used units of each type, from the events' JSON."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_type", k.alias("k")).groupBy("event_type").agg(F.count(F.lit(1)).alias("steps"), F.sum("k").alias("units"))


def byte_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of text by language, the denominator of bits per byte."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(F.octet_length("text")).cast("long").alias("n_bytes"), F.sum(F.length("text")).cast("long").alias("n_chars"))


def answer_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code of answers: fenced, left open, from the first def on, or all."""
    forms = F.array(F.concat(F.lit("Sure:\n```python\n"), "text", F.lit("\n```\nDone.")), F.concat(F.lit("```\n"), "text"), F.concat(F.lit("So def f: "), "text"), F.col("text"))
    answers = table(spark, sf_dir, "conversations").filter("role = 'assistant'").select("conv_id", "turn", F.element_at(forms, (F.col("conv_id") % 4 + 1).cast("int")).alias("answer"))
    return answers.select("conv_id", "turn", F.md5(extract_code(F.col("answer"))).alias("code_md5"))


def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First paragraphs that can stand as summaries, as tasks in the third person."""
    summary = docstring_summary(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", as_task(summary).alias("task")).filter("task is not null")


def cut_middles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(middle_cut(F.col("text"), 300)).alias("cut_md5"))


def read_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines 2 to 4 of every document, numbered, cut at 80 characters."""
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(line_window(F.col("text"), 2, 3, 80))).select("doc_id", F.col("number").cast("long").alias("number"), "line")


def sensitive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are withheld from a search, among names made of the pages' addresses."""
    last = F.element_at(F.split("url", "/"), -1)
    endings = F.element_at(F.array(*[F.lit(x) for x in (".pem", ".txt", ".key", "_credentials", ".py")]), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", F.concat(last, endings).alias("name")).filter(F.col("name").rlike(SENSITIVE))


def batch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that can make a batch: finite, of the common length, not all zero; the reason where not."""
    v = F.col("embedding")
    reason = F.when(v.isNull() | (F.size(v) != 32), "shape").when(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not finite").when(~F.exists(v, lambda x: x != 0), "no weight").otherwise("valid")
    return table(spark, sf_dir, "embeddings").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def held_out_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose key (brand, type) is not held out; held out are those of size 1."""
    parts = table(spark, sf_dir, "part")
    held = parts.filter("p_size = 1").select("p_brand", "p_type").distinct()
    return parts.join(held, ["p_brand", "p_type"], "left_anti").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


def tag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.concat_ws(":", "lang", "source", F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").filter("lang is not null").groupBy(source_group(tag).alias("tag_group")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (removed_examples, answers_of_items, answer_diagnoses, run_transitions, regression_rate, tagged_bodies, seen_by_position, exposure_per_behaviour, answer_tokens, arm_plan, weighted_means, body_frequency, usage_totals, byte_denominators, answer_code, summaries, cut_middles, read_windows, sensitive_names, batch_checks, held_out_absent, tag_groups)}
_RUN = "(SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) = 'F' AS pass, arg_max(o_orderpriority, o_orderkey) AS category FROM orders WHERE o_orderkey % 2 = {p} GROUP BY 1)"
_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
ORACLE_SQL = {
    "removed_examples": _PAIRS + """, r AS (SELECT idx, string_split(prompt, ' ')[1] AS prompt, response FROM pairs), f AS (SELECT *, min(idx) OVER (PARTITION BY prompt, response) AS first, response IN (SELECT response FROM r WHERE idx < 30000) AS held,
        first_value(response) OVER (PARTITION BY prompt ORDER BY idx) AS kept FROM r), g AS (SELECT idx, CASE WHEN held THEN 'held-out equivalent' WHEN idx > first THEN 'duplicate' WHEN response <> kept THEN 'contradiction' END AS reason FROM f) SELECT idx, reason FROM g WHERE reason IS NOT NULL""",
    "answers_of_items": "SELECT c_custkey AS item, count(o_orderkey) > 0 AS answered, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "answer_diagnoses": "SELECT p_brand, l_returnflag, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey AND p_size <= 25 GROUP BY 1, 2",
    "run_transitions": f"SELECT o_custkey, CASE WHEN n.pass AND NOT o.pass THEN 'gained' WHEN o.pass AND NOT n.pass THEN 'lost' WHEN NOT n.pass AND n.category IS DISTINCT FROM o.category THEN 'category_changed' ELSE 'same' END AS change FROM {_RUN.format(p=0)} o JOIN {_RUN.format(p=1)} n USING (o_custkey)",
    "regression_rate": f"SELECT count(*) FILTER (WHERE o.pass) AS passed, count(*) FILTER (WHERE o.pass AND NOT n.pass) AS lost, round(count(*) FILTER (WHERE o.pass AND NOT n.pass)::DOUBLE / count(*) FILTER (WHERE o.pass), 6) AS rate FROM {_RUN.format(p=0)} o JOIN {_RUN.format(p=1)} n USING (o_custkey)",
    "tagged_bodies": "WITH d AS (SELECT doc_id, md5(text) AS body FROM documents), g AS (SELECT body, min(doc_id) AS first FROM labels JOIN d USING (doc_id) WHERE quality = 1 GROUP BY 1) SELECT doc_id, coalesce('curriculum:' || first, 'curriculum:other') AS tag FROM d LEFT JOIN g USING (body)",
    "seen_by_position": "WITH s AS (SELECT user_id AS doc_id, count(*) AS tokens FROM events GROUP BY 1) SELECT source, sum(coalesce(tokens, 0))::BIGINT AS tokens, count(*) FILTER (WHERE tokens > 0) AS touched FROM documents LEFT JOIN s USING (doc_id) GROUP BY source",
    "exposure_per_behaviour": "WITH s AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1), v AS (SELECT list_sort(list(n)) AS v FROM s) SELECT len(v)::BIGINT AS behaviours, round(list_sum(v)::DOUBLE / len(v), 2) AS mean, v[1] AS least, v[len(v) // 2 + 1] AS median, v[len(v)] AS most, len(list_filter(v, lambda x: x = 0))::BIGINT AS never_seen FROM v",
    "answer_tokens": _PAIRS + f", t AS (SELECT CASE WHEN length(prompt) > 60 THEN 'long' ELSE 'short' END AS kind, len(regexp_extract_all(prompt, '{_CHUNK_SQL}')) AS p, len(regexp_extract_all(response, '{_CHUNK_SQL}')) AS r FROM pairs), g AS (SELECT kind, count(*) AS examples, sum(p + r)::BIGINT AS tokens, sum(CASE WHEN p > 0 THEN r ELSE greatest(r - 1, 0) END)::BIGINT AS answer_tokens FROM t GROUP BY 1) SELECT *, round(tokens / (sum(tokens) OVER ())::DOUBLE, 4) AS token_share FROM g",
    "arm_plan": f"SELECT seed, lang, source, row_number() OVER (PARTITION BY seed ORDER BY lang, source) AS place FROM (SELECT range AS seed FROM range({SEEDS})), (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL), (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL)",
    "weighted_means": "SELECT coalesce(l_returnflag, '*') AS kind, round(sum(round(l_discount * 100)::BIGINT * l_quantity::BIGINT)::DOUBLE / sum(l_quantity::BIGINT), 6) AS mean, sum(l_quantity::BIGINT)::BIGINT AS weight FROM lineitem GROUP BY ROLLUP (l_returnflag)",
    "body_frequency": f"SELECT md5(text) AS body, round(count(*) / {SEEDS}.0::DOUBLE, 2) AS per_seed FROM documents GROUP BY 1 HAVING count(*) > 1",
    "usage_totals": "SELECT event_type, count(*) AS steps, sum((props->>'$.k')::BIGINT)::BIGINT AS units FROM events GROUP BY 1",
    "byte_denominators": "SELECT lang, sum(strlen(text))::BIGINT AS n_bytes, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1",
    "answer_code": f"SELECT conv_id, turn, md5({_STRIP.format('CASE conv_id % 4 WHEN 2 THEN ' + repr('def f: ') + ' || text ELSE text END')}) AS code_md5 FROM conversations WHERE role = 'assistant'",
    "summaries": f"""WITH f AS (SELECT doc_id, {_STRIP.format("regexp_replace(string_split(" + _STRIP.format('text') + ", chr(10) || chr(10))[1], '\\s*\\n\\s*', ' ', 'g')")} AS s FROM documents),
        k AS (SELECT doc_id, s, split_part(s, ' ', 1) AS verb, regexp_extract(s, '(?s)^[^ ]* (.*)$', 1) AS rest FROM f WHERE length(s) BETWEEN 15 AND 300 AND NOT regexp_matches(s, '^(>>>|:|@)') AND NOT regexp_matches(s, '(?i)deprecated|todo|xxx|internal use|undocumented')),
        t AS (SELECT doc_id, {_STRIP.format("CASE WHEN NOT regexp_matches(verb, '^[A-Z][a-z]+$') THEN verb WHEN lower(verb) LIKE '%s' OR lower(verb) IN ('is', 'has') THEN lower(verb) WHEN regexp_matches(lower(verb), '(sh|ch|x|o)$') THEN lower(verb) || 'es' ELSE lower(verb) || 's' END || ' ' || rest")} AS task FROM k)
        SELECT doc_id, CASE WHEN regexp_matches(task, '[.?!]$') THEN task ELSE task || '.' END AS task FROM t""",
    "cut_middles": "SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text ELSE left(text, 100) || chr(10) || '[...]' || chr(10) || right(text, 200) END) AS cut_md5 FROM documents",
    "read_windows": "WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), n AS (SELECT doc_id, unnest(range(2, 5)) AS number, a FROM l) SELECT doc_id, number, left(a[number], 80) AS line FROM n WHERE number <= len(a)",
    "sensitive_names": "WITH n AS (SELECT page_id, string_split(url, '/')[-1] || (['.pem', '.txt', '.key', '_credentials', '.py'])[page_id % 5 + 1] AS name FROM pages) SELECT page_id, name FROM n WHERE regexp_matches(name, '" + SENSITIVE.replace("'", "''") + "')",
    "batch_checks": "SELECT CASE WHEN embedding IS NULL OR len(embedding) <> 32 THEN 'shape' WHEN len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'not finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'no weight' ELSE 'valid' END AS reason, count(*) AS n FROM embeddings GROUP BY 1",
    "held_out_absent": "SELECT p_brand, count(*) AS n FROM part WHERE (p_brand, p_type) NOT IN (SELECT (p_brand, p_type) FROM part WHERE p_size = 1) GROUP BY 1",
    "tag_groups": "SELECT lang AS tag_group, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 1",
}
