"""Documents that hold an evaluation text, without comparing every pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

GRAM = 5
#: Items whose grams are broadcast; beyond that documents' grams are shuffled to meet them.
BROADCAST_ITEMS = 200_000


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def gram_hashes(hashes: Column, width: int) -> Column:
    """A number for each run of ``width`` hashed words, one for all words of a shorter text; no run is built as text.

    Arrays are folded together place by place, so that the words are hashed a few times at most, not once for each run.
    """
    runs = hashes
    for j in range(1, width):
        runs = F.zip_with(runs, F.slice(hashes, j + 1, F.size(hashes)), lambda x, y: F.xxhash64(x, y))
    return F.slice(runs, 1, F.greatest(F.size(hashes) - width + 1, F.lit(1)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """A written table, marked for broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def contains_items(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) where the document's text contains the item's.

    Words 2 to 6 of an item stand in a document between spaces wherever the item
    does, so documents are searched for the hash of that run; candidates are
    written, and only then texts are read again to check containment. Items of fewer
    than seven words have no such run; they are searched for by an inner word in the
    same way, or, without one, text by text.
    """
    words = F.split("text", " ", -1)
    keyed = items.select("item_id", F.col("text").alias("item"), words.alias("w"))
    inner = lambda n: gram_hashes(word_hashes(F.slice("w", 2, n)), n)[0]
    searched = keyed.filter(F.size("w") > 2).select("item_id", "item", F.when(F.size("w") >= GRAM + 2, inner(GRAM)).otherwise(inner(1)).alias("gram"), (F.size("w") >= GRAM + 2).alias("long"))
    searched = written(searched)
    hashed = docs.select("doc_id", word_hashes(words).alias("h"))
    runs = {True: F.array_distinct(gram_hashes(F.col("h"), GRAM)), False: F.array_distinct(gram_hashes(F.col("h"), 1))}
    kinds = [r["long"] for r in searched.select("long").distinct().collect()]
    found = [hashed.select("doc_id", F.explode(runs[k]).alias("gram")).join(small(searched.filter(F.col("long") == k).drop("long"), BROADCAST_ITEMS), "gram").select("doc_id", "item_id", "item") for k in kinds]
    holds = F.expr("contains(text, item)")
    bare = docs.join(keyed.filter(F.size("w") <= 2).select("item_id", "item"), holds).select("doc_id", "item_id")
    if not found:
        return bare.distinct()
    candidates = written(reduce(DataFrame.unionByName, found).distinct())
    return docs.select("doc_id", "text").join(candidates, "doc_id").filter(holds).select("doc_id", "item_id").unionByName(bare).distinct()
