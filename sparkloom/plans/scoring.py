"""Evaluation: contamination, clean views, transitions and paired statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.rng import uniform, uniform_sql
from ..operators.contamination import contains_items, gram_hashes, small, word_hashes
from ..operators.scratch import written
from ..sources.tables import table

SEEDS, RESAMPLES = 5, 200


def benchmark_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contains_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def clean_view_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Official and clean scores by language, with their denominators."""
    bad = benchmark_contamination(spark, sf_dir).select("doc_id").distinct().withColumn("bad", F.lit(1))
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").join(bad, "doc_id", "left")
    clean = F.col("bad").isNull()
    return rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of"), F.sum("quality").cast("long").alias("official"), F.count_if(clean).alias("of_clean"), F.coalesce(F.sum(F.when(clean, F.col("quality"))), F.lit(0)).cast("long").alias("clean"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by source and seed (doc_id modulo SEEDS): percent of good labels."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang", (F.col("doc_id") % SEEDS).alias("seed")).agg((100 * F.sum("quality") / F.count(F.lit(1))).alias("score"))


def paired_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language against English on equal seeds: mean difference, deviation, margin, interval, verdict."""
    runs = _runs(spark, sf_dir)
    base = runs.filter("lang = 'en'").select("seed", F.col("score").alias("base"))
    diff = runs.filter("lang <> 'en'").join(base, "seed").withColumn("d", F.col("score") - F.col("base"))
    per = diff.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("m"), F.stddev_samp("d").alias("s"))
    half = lambda t: t * F.col("s") / F.sqrt("n")
    per = per.withColumn("margin", half(stats.student(F.col("n") - 1, stats.T95, 1.8))).withColumn("wide", half(stats.student(F.col("n") - 1, stats.T975, 2.0)))
    verdict = F.when(F.col("n") < 2, "inconclusive").when((F.col("m") < -F.col("margin")) | ((F.col("s") == 0) & (F.col("m") < 0)), "rejected").when((F.col("m") > F.col("margin")) & (F.col("m") > 0), "retained").otherwise("inconclusive")
    return per.select("lang", "n", *[F.round(c, 4).alias(a) for c, a in ((F.col("m"), "mean"), (F.col("s"), "sd"), (F.col("margin"), "margin"), (F.col("m") - F.col("wide"), "low"), (F.col("m") + F.col("wide"), "high"))], verdict.alias("verdict"))


def gained_lost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions from quality to its absence of toxicity, read as an old and a new run, with the sign test."""
    per = table(spark, sf_dir, "labels").agg(F.count_if((F.col("quality") == 0) & (F.col("toxic") == 0)).alias("gained"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("lost"), F.count_if(F.col("quality") == 1 - F.col("toxic")).alias("same"))
    return per.select("gained", "lost", "same")


def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("c"))
    return rows.filter("n >= 4").select("source", "n", "c", F.round(stats.pass_at_k(F.col("n"), F.col("c"), 4), 6).alias("pass_at_4"))


def auc_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of length against quality, by rank sums over a histogram of lengths; ties count half."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    bins = rows.groupBy("n_chars").agg(F.sum("quality").alias("p"), F.sum(1 - F.col("quality")).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.orderBy("n_chars").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = bins.withColumn("won", F.col("p") * (below + F.col("q") / 2))
    return won.agg(F.sum("p").cast("long").alias("positives"), F.sum("q").cast("long").alias("negatives"), F.round(F.sum("won") / (F.sum("p") * F.sum("q")), 6).alias("auc"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisson-free bootstrap of the mean length by quality over sums of seeds: order statistics of the resamples."""
    per = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id").groupBy((F.col("doc_id") % 50).alias("unit")).agg(F.sum("n_chars").alias("s"), F.count(F.lit(1)).alias("c"))
    units = per.select(F.row_number().over(Window.orderBy("unit")).alias("i"), "s", "c", F.count(F.lit(1)).over(Window.partitionBy()).alias("m"))
    draws = units.select("i", "m").crossJoin(spark.range(RESAMPLES).select(F.col("id").alias("r")))  # 50 units at most, whatever the input
    picks = draws.select("r", (F.floor(uniform(11, F.col("r"), F.col("i")) * F.col("m")) + 1).alias("i"))
    means = picks.join(units.select("i", "s", "c"), "i").groupBy("r").agg((F.sum("s") / F.sum("c")).alias("v"))
    ordered = means.agg(F.array_sort(F.collect_list("v")).alias("v"))
    return ordered.select(F.round(F.element_at("v", int(RESAMPLES * 0.025) + 1), 4).alias("low"), F.round(F.element_at("v", RESAMPLES - int(RESAMPLES * 0.025)), 4).alias("high"))


#: Grams of items that are broadcast at most.
BROADCAST_GRAMS = 2_000_000
KEY = ("p_brand", "p_type", "p_size")


def minimal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part and each attribute: the next part by key that differs in that attribute alone.

    Parts of two equal attributes stand in order of their key; where the third changes
    a run of equal values begins, and the next run's first part is the answer for a whole run.
    """
    parts, found = table(spark, sf_dir, "part").select("p_partkey", *KEY), []
    for third in KEY:
        group = [k for k in KEY if k != third]
        w = Window.partitionBy(*group)
        begins = F.when(~F.col(third).eqNullSafe(F.lag(third).over(w.orderBy("p_partkey"))), F.col("p_partkey"))
        nearest = F.last("begins", ignorenulls=True).over(w.orderBy(F.desc("p_partkey")).rowsBetween(Window.unboundedPreceding, -1))
        found.append(parts.withColumn("begins", begins).withColumn("other", nearest).filter("other is not null").select("p_partkey", F.lit(third).alias("varied"), "other"))
    return found[0].unionByName(found[1]).unionByName(found[2])


def nearest_by_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each benchmark item the document with the largest Jaccard similarity of four-word grams, among those with half to ten times its grams; ties to the smaller id."""
    def grams(name: str, key: str, size: str) -> DataFrame:
        """A row for each distinct run of four words, as a number, with the count of them all."""
        hashed = table(spark, sf_dir, name).select(key, word_hashes(F.split(F.lower("text"), r"\s+")).alias("h"))
        return hashed.select(key, F.array_distinct(gram_hashes(F.col("h"), 4)).alias("g")).select(key, F.size("g").cast("long").alias(size), F.explode("g").alias("gram"))

    items = small(written(grams("benchmark", "item_id", "n")), BROADCAST_GRAMS)
    both = grams("documents", "doc_id", "m").join(items, "gram").filter("m between n / 2 and 10 * n").groupBy("item_id", "doc_id", "n", "m").agg(F.count(F.lit(1)).alias("shared"))
    scored = both.withColumn("similarity", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 9))
    best = scored.groupBy("item_id").agg(F.max(F.struct("similarity", (-F.col("doc_id")).alias("m"), "shared")).alias("b"))
    return best.select("item_id", (-F.col("b.m")).alias("doc_id"), F.col("b.shared").alias("shared"), F.col("b.similarity").alias("similarity"))


QUERIES = {f.__name__: f for f in (benchmark_contamination, clean_view_scores, paired_compare, gained_lost, pass_at_k, auc_rank, bootstrap_ci, minimal_pairs, nearest_by_jaccard)}
_T95 = "CASE WHEN n - 1 BETWEEN 1 AND 10 THEN ([" + ", ".join(map(str, stats.T95)) + "])[n - 1] ELSE 1.8 END"
_T975 = "CASE WHEN n - 1 BETWEEN 1 AND 10 THEN ([" + ", ".join(map(str, stats.T975)) + "])[n - 1] ELSE 2.0 END"
_GRAMS = "SELECT {k}, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: array_to_string(w[i:i + 3], ' ')))) AS gram FROM (SELECT {k}, string_split_regex(lower(text), '\\s+') AS w FROM {t})"
ORACLE_SQL = {
    "benchmark_contamination": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "clean_view_scores": "WITH bad AS (SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)) SELECT lang, count(*) AS of, sum(quality)::BIGINT AS official, count(*) FILTER (WHERE bad.doc_id IS NULL) AS of_clean, coalesce(sum(quality) FILTER (WHERE bad.doc_id IS NULL), 0)::BIGINT AS clean FROM labels JOIN documents USING (doc_id) LEFT JOIN bad USING (doc_id) GROUP BY lang",
    "paired_compare": f"""WITH r AS (SELECT lang, doc_id % {SEEDS} AS seed, 100 * sum(quality)::DOUBLE / count(*) AS score FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2),
        d AS (SELECT a.lang, a.score - b.score AS d FROM r a JOIN r b ON a.seed = b.seed AND b.lang = 'en' WHERE a.lang <> 'en'), p AS (SELECT lang, count(*) AS n, avg(d) AS m, stddev_samp(d) AS s FROM d GROUP BY lang),
        q AS (SELECT *, ({_T95})::DOUBLE * s / sqrt(n) AS margin, ({_T975})::DOUBLE * s / sqrt(n) AS wide FROM p)
        SELECT lang, n, round(m, 4) AS mean, round(s, 4) AS sd, round(margin, 4) AS margin, round(m - wide, 4) AS low, round(m + wide, 4) AS high, CASE WHEN n < 2 THEN 'inconclusive' WHEN m < -margin OR (s = 0 AND m < 0) THEN 'rejected' WHEN m > margin AND m > 0 THEN 'retained' ELSE 'inconclusive' END AS verdict FROM q""",
    "gained_lost": "SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS gained, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS lost, count(*) FILTER (WHERE quality = 1 - toxic) AS same FROM labels",
    "pass_at_k": "WITH r AS (SELECT source, count(*) AS n, sum(quality)::BIGINT AS c FROM labels JOIN documents USING (doc_id) GROUP BY source) SELECT source, n, c, round(CASE WHEN n - c < 4 THEN 1.0 ELSE 1 - ((n - c)::DOUBLE / n) * ((n - c - 1)::DOUBLE / (n - 1)) * ((n - c - 2)::DOUBLE / (n - 2)) * ((n - c - 3)::DOUBLE / (n - 3)) END, 6)::DOUBLE AS pass_at_4 FROM r WHERE n >= 4",
    "auc_rank": "WITH r AS (SELECT quality, n_chars FROM labels JOIN documents USING (doc_id)) SELECT (SELECT count(*) FROM r WHERE quality = 1) AS positives, (SELECT count(*) FROM r WHERE quality = 0) AS negatives, round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END)::DOUBLE, 6) AS auc FROM r a, r b WHERE a.quality = 1 AND b.quality = 0",
    "bootstrap_ci": f"""WITH per AS (SELECT doc_id % 50 AS unit, sum(n_chars) AS s, count(*) AS c FROM labels JOIN documents USING (doc_id) GROUP BY 1), u AS (SELECT row_number() OVER (ORDER BY unit) AS i, s, c, count(*) OVER () AS m FROM per),
        d AS (SELECT r.range AS r, (floor({uniform_sql(11, "r.range || ':' || u.i")} * m) + 1)::BIGINT AS i FROM u, range({RESAMPLES}) r), v AS (SELECT r, sum(s)::DOUBLE / sum(c) AS v FROM d JOIN u USING (i) GROUP BY r), o AS (SELECT list_sort(list(v)) AS v FROM v)
        SELECT round(v[{int(RESAMPLES * 0.025) + 1}], 4) AS low, round(v[{RESAMPLES - int(RESAMPLES * 0.025)}], 4) AS high FROM o""",
    "minimal_pairs": " UNION ALL ".join(f"SELECT a.p_partkey, '{third}' AS varied, min(b.p_partkey) AS other FROM part a JOIN part b ON b.p_partkey > a.p_partkey AND a.{third} <> b.{third}" + "".join(f" AND a.{k} = b.{k}" for k in KEY if k != third) + " GROUP BY a.p_partkey" for third in KEY),
    "nearest_by_jaccard": f"""WITH i AS ({_GRAMS.format(k='item_id', t='benchmark')}), d AS ({_GRAMS.format(k='doc_id', t='documents')}), s AS (SELECT item_id, doc_id, count(*) AS shared FROM i JOIN d USING (gram) GROUP BY 1, 2),
        n AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1), m AS (SELECT doc_id, count(*) AS m FROM d GROUP BY 1), j AS (SELECT item_id, doc_id, shared, round(shared::DOUBLE / (n + m - shared), 9) AS similarity FROM s JOIN n USING (item_id) JOIN m USING (doc_id) WHERE m BETWEEN n / 2.0 AND 10 * n)
        SELECT item_id, doc_id, shared, similarity FROM j QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY similarity DESC, doc_id) = 1""",
}
