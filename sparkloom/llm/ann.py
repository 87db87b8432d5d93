"""Approximate nearest neighbours by additive quantisation.

Unit vectors are written as sums of one full-dimensional codeword from each of
several codebooks; the codebooks are residual k-means of a bounded sample, and
encoding keeps a beam of the best partial sums. Each row stores its codes and
the norm of its sum. A query scores all rows through a table of inner products
with the codewords; the best of the shortlist are ranked again by the exact
cosine of the original vectors in double precision.

Queries and rows meet in blocks of bounded size, whatever the table's size;
codes (bytes) are what is sent to the blocks. Vectors come back only for the
shortlists.

Edge cases: vectors that are null, empty, zero, of another length than most, or
hold null or non-finite parts take no part; a query has fewer neighbours if
there are fewer rows; ties go to the smaller id; an empty table gives none; rows that repeat
an id are candidates each, and none of them for a query of the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

BOOKS, WORDS, BEAM = 12, 256, 4
SAMPLE = 16_384
SHORTLIST = 1024
QUERY_BLOCK, ROW_BLOCK = 1024, 65_536


def usable(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and vector (array<double>) of the rows that take part."""
    v = F.col(vector)
    ok = (F.size(v) > 0) & F.col(key).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(v.isNotNull() & ok).select(F.col(key).cast("long").alias("id"), v.cast("array<double>").alias("vector"))


def train(sample: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """(books, words, dim): k-means of what the books before leave over."""
    rng = np.random.default_rng(seed)
    rest, out = sample.astype(np.float32), []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = (rest @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centres, dtype=np.float64)
            np.add.at(total, near, rest)
            centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres).astype(np.float32)
        near = (rest @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        rest = rest - centres[near]
        out.append(centres)
    return np.stack(out)


def encode(vectors: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, books) and norms of the sums, by a beam over the partial sums."""
    n, words = len(vectors), books.shape[1]
    rest, codes = vectors[:, None, :].astype(np.float32), np.zeros((n, 1, 0), dtype=np.uint8)
    for centres in books:
        width = rest.shape[1]
        cost = (rest**2).sum(axis=2)[:, :, None] - 2 * (rest.reshape(-1, rest.shape[2]) @ centres.T).reshape(n, width, words) + (centres**2).sum(axis=1)
        cost = cost.reshape(n, -1)
        best = np.argpartition(cost, beam - 1, axis=1)[:, :beam]
        row, word = best // words, best % words
        rest = np.take_along_axis(rest, row[:, :, None], axis=1) - centres[word]
        codes = np.concatenate([np.take_along_axis(codes, row[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
    pick = (rest**2).sum(axis=2).argmin(axis=1)
    final = codes[np.arange(n), pick]
    total = vectors.astype(np.float32) - rest[np.arange(n), pick]
    return final, np.linalg.norm(total, axis=1)


def shortlist(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray, own: np.ndarray, ids: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its ``size`` best rows by table scores, ties to smaller ids. ``ids`` are sorted."""
    for q, lut in enumerate(tables):
        score = np.zeros(len(codes), dtype=np.float32)
        for m in range(codes.shape[1]):
            score += lut[m][codes[:, m]]
        score /= np.maximum(norms, 1e-12)
        score[ids == own[q]] = -np.inf
        if len(score) > size:
            least = np.partition(score, len(score) - size)[len(score) - size]
            sure, level = np.flatnonzero(score > least), np.flatnonzero(score == least)
            pick = np.concatenate([sure, level[: size - len(sure)]])
        else:
            pick = np.arange(len(score))
        pick = pick[np.isfinite(score[pick])]
        yield q, pick, score[pick]


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", short: int = SHORTLIST, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row for which ``queries`` (on ``id``) holds."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    dims = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not dims:
        return empty
    total = dims[0]["count"]
    rows = rows.filter(F.size("vector") == dims[0]["d"])
    wanted = rows.filter(queries)
    n_query = wanted.count()
    if not n_query:
        return empty
    part = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < min(1.0, 1.1 * sample / total) * 1_000_000
    drawn = np.array([r["vector"] for r in rows.filter(part).orderBy(F.xxhash64("id"), "id").limit(sample).collect()])
    if not len(drawn):
        drawn = np.array([r["vector"] for r in rows.limit(sample).collect()])
    books = spark.sparkContext.broadcast(train(drawn / np.linalg.norm(drawn, axis=1, keepdims=True)))

    def coded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                piece = batch.iloc[at : at + 2048]
                v = np.stack(piece["vector"].to_numpy())
                codes, norms = encode(v / np.abs(v).max(axis=1, keepdims=True) / np.linalg.norm(v / np.abs(v).max(axis=1, keepdims=True), axis=1, keepdims=True), books.value)
                yield pd.DataFrame({"id": piece["id"], "codes": [c.tobytes() for c in codes], "norm": norms})

    query_blocks, row_blocks = -(-n_query // QUERY_BLOCK), -(-total // ROW_BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = rows.mapInPandas(coded, "id long, codes binary, norm float").withColumn("rb", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(row_blocks))).withColumn("qb", each(query_blocks))
    right = wanted.withColumn("qb", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(query_blocks))).withColumn("rb", each(row_blocks))

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "id": [], "near": []})
        rows = rows.sort_values("id", kind="stable")
        ids, norms = rows["id"].to_numpy(), rows["norm"].to_numpy()
        codes = np.asfortranarray(np.frombuffer(b"".join(rows["codes"]), dtype=np.uint8).reshape(len(rows), -1))
        own, v = asked["id"].to_numpy(), np.stack(asked["vector"].to_numpy())
        v = v / np.abs(v).max(axis=1, keepdims=True)
        tables = np.einsum("qd,mwd->qmw", (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32), books.value, optimize=True)
        found = [pd.DataFrame({"query_id": own[q], "id": ids[pick], "near": near}) for q, pick, near in shortlist(tables, codes, norms, own, ids, short)]
        return pd.concat(found)

    listed = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(score, "query_id long, id long, near float")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "id")
    listed = listed.withColumn("__r", F.row_number().over(best)).filter(F.col("__r") <= short).select("query_id", "id").distinct()
    exact = listed.join(rows, "id").join(wanted.dropDuplicates(["id"]).select(F.col("id").alias("query_id"), F.col("vector").alias("asked")), "query_id")
    exact = exact.select("query_id", F.col("id").alias("vec_id"), cosine(F.col("asked"), F.col("vector")).alias("score"))
    near = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return exact.withColumn("rank", F.row_number().over(near)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, 5)
