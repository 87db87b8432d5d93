"""Samples, quotas, balancing, set operations, streaks and resumable order, all with stateless draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform, uniform_sql
from ..operators.draws import budget_by_draw, draw_rank, smallest_draws
from ..operators.ordered import running_before
from ..sources.tables import table

SEED, SAMPLE, BUDGET, SHARE, WORLD, BLOCK = 9, 0.1, 300_000, 0.25, 4, 4096
QUOTAS = (("en", 40), ("es", 25), ("fr", 10))


def _drawn(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *columns, uniform(SEED, F.col("doc_id")).alias("u"))


def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed fraction of the rows, without replacement: round(10 %) of them."""
    return smallest_draws(_drawn(spark, sf_dir), "u", "doc_id", [], F.round(F.col("__all") * SAMPLE)).select("doc_id")


def sample_to_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a draw until 50 that pass a rule are taken."""
    fit = _drawn(spark, sf_dir, "n_chars").filter("n_chars <= 400")
    return smallest_draws(fit, "u", "doc_id", [], F.lit(50)).select("doc_id", "n_chars")


def size_capped_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order of a draw until their characters reach the budget; the crossing row stays."""
    return budget_by_draw(_drawn(spark, sf_dir, "n_chars"), "u", "doc_id", "n_chars", BUDGET).select("doc_id", "n_chars")


def weighted_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sampling without replacement under a budget: rows by u ** (1 / w), w the length over its language's mean."""
    docs = _drawn(spark, sf_dir, "lang", "n_chars").filter("n_chars > 0")
    mean = docs.groupBy("lang").agg(F.sum("n_chars").alias("s"), F.count(F.lit(1)).alias("c"))
    key = F.round(F.pow("u", F.col("s") / F.col("c") / F.col("n_chars")), 9)
    keyed = docs.join(mean, "lang").withColumn("key", key).withColumn("last", F.least(F.greatest(1 - F.col("key"), F.lit(0.0)), F.lit(0.999999999)))
    return budget_by_draw(keyed, "last", "doc_id", "n_chars", BUDGET).select("doc_id", "key")


def share_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fraction of the other sources that makes them SHARE of the mixture: target = share / (1 - share) * own, at most all."""
    own = F.coalesce(F.sum(F.when(F.col("lang") == "en", F.col("n_chars"))), F.lit(0))
    pool = F.coalesce(F.sum(F.when(F.col("lang") != "en", F.col("n_chars"))), F.lit(0))
    sums = table(spark, sf_dir, "documents").agg(own.cast("long").alias("own"), pool.cast("long").alias("pool"))
    target = SHARE / (1 - SHARE) * F.col("own")
    return sums.select("own", "pool", F.round(target, 4).alias("target"), F.round(F.least(F.lit(1.0), target / F.col("pool")), 6).alias("fraction"))


def balanced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many rows of each language as the smallest one has, by draw."""
    docs = _drawn(spark, sf_dir, "lang").filter("lang is not null")
    least = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least"))
    return smallest_draws(docs.crossJoin(F.broadcast(least)), "u", "doc_id", ["lang"], F.col("least")).select("doc_id", "lang")  # one row is broadcast


def language_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotas = spark.createDataFrame(list(QUOTAS), "lang string, quota int")
    return smallest_draws(_drawn(spark, sf_dir, "lang").join(F.broadcast(quotas), "lang"), "u", "doc_id", ["lang"], F.col("quota")).select("doc_id", "lang")


def shuffled_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded shuffle: each row's position, and with it the worker of a sampler that deals positions in turn."""
    ranked = draw_rank(_drawn(spark, sf_dir), "u", "doc_id", [], "position")
    return ranked.select("doc_id", "position", F.pmod(F.col("position") - 1, F.lit(WORLD)).alias("worker"))


def resumed_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of an epoch for worker 1 after its first 20 rows: the order is fixed, so a cursor is all that is kept."""
    mine = shuffled_positions(spark, sf_dir).filter("worker = 1")
    return mine.filter(F.floor((F.col("position") - 1) / WORLD) >= 20).select("doc_id", "position")


def unseen_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume: events whose (user, type) was not emitted in the first half of the log."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    half = events.agg(F.floor(F.max("event_id") / 2).alias("half"))
    done = events.join(F.broadcast(half), F.col("event_id") <= F.col("half")).select("user_id", "event_type").distinct()
    return events.join(done, ["user_id", "event_type"], "left_anti").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def packed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of BLOCK characters that concatenated documents fill: the row a document begins in and how many it touches."""
    starts = running_before(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", "start")
    last = F.floor((F.col("start") + F.greatest(F.col("n_chars"), F.lit(1)) - 1) / BLOCK)
    return starts.select("doc_id", F.floor(F.col("start") / BLOCK).cast("long").alias("row"), (last - F.floor(F.col("start") / BLOCK) + 1).cast("long").alias("rows"))


def random_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of 128 characters at a drawn place of each document that is long enough."""
    docs = table(spark, sf_dir, "documents").filter("n_chars >= 128").select("doc_id", "n_chars", uniform(SEED + 1, F.col("doc_id")).alias("u"), "text")
    start = F.floor(F.col("u") * (F.col("n_chars") - 127)).cast("int")
    return docs.select("doc_id", start.cast("long").alias("start"), F.md5(F.substring("text", start + 1, 128)).alias("window_md5"))


def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that stay in a context of 600 characters: from the newest on, and the two newest in any case."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    after = F.coalesce(F.sum("n").over(newest.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return turns.select("conv_id", "turn", ((after <= 600) | (F.row_number().over(newest) <= 2)).alias("kept"))


def best_of_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dearest part of each brand; ties to the smaller key."""
    best = F.max_by(F.struct("p_partkey", "p_retailprice"), F.struct("p_retailprice", -F.col("p_partkey"))).alias("b")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(best).select("p_brand", F.col("b.p_partkey").alias("p_partkey"), F.col("b.p_retailprice").alias("p_retailprice"))


def tagged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources put together with tags, then counted by the tag's group."""
    one = table(spark, sf_dir, "documents").select(F.concat(F.lit("corpus:"), F.coalesce("source", F.lit("none"))).alias("tag"), "text")
    two = table(spark, sf_dir, "benchmark").select(F.lit("held:benchmark").alias("tag"), "text")
    three = table(spark, sf_dir, "conversations").select(F.concat(F.lit("chat:"), F.col("role")).alias("tag"), "text")
    both = one.unionByName(two).unionByName(three)
    return both.groupBy(F.substring_index("tag", ":", 1).alias("tag_group")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("tag").alias("tags"), F.sum(F.length("text")).cast("long").alias("chars"))


def later_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An ordered union of two maps by key: a label takes the place of the default."""
    default = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("priority"), F.lit(-1).alias("quality"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("priority"), "quality")
    return default.unionByName(labels).groupBy("doc_id").agg(F.max_by("quality", "priority").cast("long").alias("quality"))


def passed_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that both runs pass, and those that only one does."""
    labels = table(spark, sf_dir, "labels")
    a, b = labels.filter("quality = 1").select("doc_id"), labels.filter("toxic = 0").select("doc_id")
    named = lambda df, name: df.select(F.lit(name).alias("which"), "doc_id")
    rows = named(a.intersect(b), "both").unionByName(named(a.exceptAll(b), "first")).unionByName(named(b.exceptAll(a), "second"))
    return rows.groupBy("which").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"))


def split_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand in both halves of the documents, and repeats within a half."""
    halves = table(spark, sf_dir, "documents").filter("text is not null").select((F.col("doc_id") % 2).alias("half"), F.md5("text").alias("h")).groupBy("h").agg(F.count_if(F.col("half") == 0).alias("even"), F.count_if(F.col("half") == 1).alias("odd"))
    return halves.agg(F.count_if((F.col("even") > 0) & (F.col("odd") > 0)).alias("shared"), F.sum(F.greatest(F.col("even") - 1, F.lit(0))).cast("long").alias("even_repeats"), F.sum(F.greatest(F.col("odd") - 1, F.lit(0))).cast("long").alias("odd_repeats"))


def _order() -> Window:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive failures (value under 20) of a user, set back by each success: the longest, and events at which it stands at three or more."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", (F.col("value") < 20).alias("fails"))
    events = events.withColumn("island", F.sum(F.when(F.col("fails"), 0).otherwise(1)).over(_order()))
    streak = F.sum(F.when(F.col("fails"), 1).otherwise(0)).over(Window.partitionBy("user_id", "island").orderBy("ts", "event_id"))
    return events.withColumn("streak", streak).groupBy("user_id").agg(F.max("streak").cast("long").alias("longest"), F.count_if(F.col("streak") >= 3).alias("stuck"))


def adjacent_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return events.withColumn("next_type", F.lead("event_type").over(_order())).filter("next_type is not null").groupBy("event_type", "next_type").agg(F.count(F.lit(1)).alias("n"))


def half_tie_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each size's share of smaller ones within its brand, ties counted half, from a histogram of sizes."""
    bins = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("p_brand")
    below = F.coalesce(F.sum("n").over(w.orderBy("p_size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    top = F.max("p_size").over(w) == F.col("p_size")
    return bins.select("p_brand", "p_size", F.round((below + F.col("n") / 2) / F.sum("n").over(w), 6).alias("percentile"), top.alias("top"))


def latest_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").filter("value < 5")
    return events.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count(F.lit(1)).alias("failures"))


def recent_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last ten days, by type; the last day is one row, broadcast."""
    events = table(spark, sf_dir, "events").select("event_type", F.to_date("ts").alias("day"))
    last = events.agg(F.max("day").alias("last"))
    return events.join(F.broadcast(last), F.col("day") >= F.date_sub("last", 9)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (uniform_sample, sample_to_quota, size_capped_corpus, weighted_budget, share_solved, balanced_groups, language_quotas, shuffled_positions, resumed_epoch, unseen_keys, packed_rows, random_windows, context_budget, best_of_family, tagged_union, later_wins, passed_sets, split_overlaps, failure_streaks, adjacent_transitions, half_tie_percentile, latest_failure, recent_rounds)}
_U = uniform_sql(SEED, "doc_id")
_W = "(PARTITION BY user_id ORDER BY ts, event_id)"
_SHUFFLED = f"SELECT doc_id, row_number() OVER (ORDER BY {_U}, doc_id) AS position FROM documents"
_BEFORE = "(coalesce(sum(n_chars) OVER (ORDER BY {o} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT"
ORACLE_SQL = {
    "uniform_sample": f"SELECT doc_id FROM documents QUALIFY row_number() OVER (ORDER BY {_U}, doc_id) <= round(count(*) OVER () * {SAMPLE})",
    "sample_to_quota": f"SELECT doc_id, n_chars FROM documents WHERE n_chars <= 400 QUALIFY row_number() OVER (ORDER BY {_U}, doc_id) <= 50",
    "size_capped_corpus": f"SELECT doc_id, n_chars FROM documents QUALIFY {_BEFORE.format(o=f'{_U}, doc_id')} < {BUDGET}",
    "weighted_budget": f"WITH k AS (SELECT doc_id, n_chars, round(pow({_U}, (sum(n_chars) OVER (PARTITION BY lang))::DOUBLE / count(*) OVER (PARTITION BY lang) / n_chars), 9) AS key FROM documents WHERE n_chars > 0 AND lang IS NOT NULL) SELECT doc_id, key FROM k QUALIFY {_BEFORE.format(o='least(greatest(1 - key, 0.0), 0.999999999), doc_id')} < {BUDGET}",
    "share_solved": f"WITH s AS (SELECT coalesce(sum(n_chars) FILTER (WHERE lang = 'en'), 0)::BIGINT AS own, coalesce(sum(n_chars) FILTER (WHERE lang <> 'en'), 0)::BIGINT AS pool FROM documents) SELECT own, pool, round({SHARE / (1 - SHARE)}::DOUBLE * own, 4) AS target, round(least(1.0, {SHARE / (1 - SHARE)}::DOUBLE * own / pool), 6)::DOUBLE AS fraction FROM s",
    "balanced_groups": f"WITH n AS (SELECT min(n) AS least FROM (SELECT count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)) SELECT doc_id, lang FROM documents, n WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_U}, doc_id) <= least",
    "language_quotas": f"SELECT doc_id, lang FROM documents JOIN (VALUES {', '.join(f"('{k}', {n})" for k, n in QUOTAS)}) q(lang, quota) USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY {_U}, doc_id) <= quota",
    "shuffled_positions": f"SELECT doc_id, position, (position - 1) % {WORLD} AS worker FROM ({_SHUFFLED})",
    "resumed_epoch": f"SELECT doc_id, position FROM ({_SHUFFLED}) WHERE (position - 1) % {WORLD} = 1 AND (position - 1) // {WORLD} >= 20",
    "unseen_keys": "WITH h AS (SELECT max(event_id) // 2 AS half FROM events), d AS (SELECT DISTINCT user_id, event_type FROM events, h WHERE event_id <= half) SELECT event_type, count(*) AS n FROM events e ANTI JOIN d USING (user_id, event_type) GROUP BY 1",
    "packed_rows": f"WITH s AS (SELECT doc_id, n_chars, {_BEFORE.format(o='doc_id')} AS start FROM documents) SELECT doc_id, start // {BLOCK} AS row, (start + greatest(n_chars, 1) - 1) // {BLOCK} - start // {BLOCK} + 1 AS rows FROM s",
    "random_windows": f"WITH s AS (SELECT doc_id, text, floor({uniform_sql(SEED + 1, 'doc_id')} * (n_chars - 127))::BIGINT AS start FROM documents WHERE n_chars >= 128) SELECT doc_id, start, md5(substr(text, start + 1, 128)) AS window_md5 FROM s",
    "context_budget": "SELECT conv_id, turn, (sum(length(text)) OVER w <= 600 OR row_number() OVER w <= 2) AS kept FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "best_of_family": "SELECT p_brand, p_partkey, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1",
    "tagged_union": "WITH u AS (SELECT 'corpus:' || coalesce(source, 'none') AS tag, text FROM documents UNION ALL SELECT 'held:benchmark', text FROM benchmark UNION ALL SELECT 'chat:' || role, text FROM conversations) SELECT split_part(tag, ':', 1) AS tag_group, count(*) AS n, count(DISTINCT tag) AS tags, sum(length(text))::BIGINT AS chars FROM u GROUP BY 1",
    "later_wins": "SELECT doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents LEFT JOIN labels l USING (doc_id)",
    "passed_sets": "WITH r AS (SELECT doc_id, quality = 1 AS a, toxic = 0 AS b FROM labels) SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first' ELSE 'second' END AS which, count(*) AS n, min(doc_id) AS least FROM r WHERE a OR b GROUP BY 1",
    "split_overlaps": "WITH h AS (SELECT md5(text) AS h, count(*) FILTER (WHERE doc_id % 2 = 0) AS even, count(*) FILTER (WHERE doc_id % 2 = 1) AS odd FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT count(*) FILTER (WHERE even > 0 AND odd > 0) AS shared, sum(greatest(even - 1, 0))::BIGINT AS even_repeats, sum(greatest(odd - 1, 0))::BIGINT AS odd_repeats FROM h",
    "failure_streaks": f"WITH i AS (SELECT *, value < 20 AS fails, sum(CASE WHEN value < 20 THEN 0 ELSE 1 END) OVER {_W} AS island FROM events), s AS (SELECT user_id, sum(CASE WHEN fails THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM i) SELECT user_id, max(streak)::BIGINT AS longest, count(*) FILTER (WHERE streak >= 3) AS stuck FROM s GROUP BY 1",
    "adjacent_transitions": f"WITH t AS (SELECT event_type, lead(event_type) OVER {_W} AS t FROM events) SELECT event_type, t AS next_type, count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY 1, 2",
    "half_tie_percentile": "WITH p AS (SELECT p_brand, p_size, rank() OVER (PARTITION BY p_brand ORDER BY p_size) - 1 AS below, count(*) OVER (PARTITION BY p_brand, p_size) AS ties, count(*) OVER (PARTITION BY p_brand) AS n, max(p_size) OVER (PARTITION BY p_brand) AS top FROM part) SELECT DISTINCT p_brand, p_size, round((below + ties / 2.0::DOUBLE) / n, 6) AS percentile, p_size = top AS top FROM p",
    "latest_failure": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, count(*) AS failures FROM events WHERE value < 5 GROUP BY 1",
    "recent_rounds": "SELECT event_type, count(*) AS n FROM events WHERE ts::DATE >= (SELECT max(ts::DATE) FROM events) - 9 GROUP BY 1",
}
