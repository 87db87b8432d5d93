"""Maximal repeat groups: every repeated byte string with all of its occurrences.

Anchors and contexts are those of ``suffixes``. The contexts of a gram get a
suffix array of their right sides and its common-prefix interval tree; within an
interval the left sides, in order, give a second one. A set of contexts that
share ``d`` bytes to the right and ``s`` to the left is a repeat; it is maximal
if its left extensions differ and its right extensions differ, or if the context
ends. Only strings whose own anchor is the gram are kept, so that every
occurrence of the string has met in that gram; equal strings of several grams
are one group.

A string reaches at most ``length - gram`` bytes to each side of its gram: longer
repeats come as overlapping strings. Grams with more than ``hot`` distinct
contexts are not gathered: their strings of exactly ``length`` bytes are grouped
by hash, with all occurrences.

Edge cases: as in ``suffixes``; equal rows are two occurrences; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import likely, materialised, text_or_empty
from .suffixes import GRAM, HOT, LENGTH, anchor_rows, anchors, byte_order, common_prefix, interval_tree, matrix
from .textkit import mix64, powers, prefix_hashes


def repeat_sets(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], need: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(members, left, right) of the maximal sets of two or more contexts of a group that share ``need`` bytes or more; ``lefts`` are reversed."""
    left, left_size = matrix(lefts, need)
    right, right_size = matrix(rights, need)
    order = byte_order(right, right_size, groups)
    g = groups[order]
    prefix = np.where(g[:-1] == g[1:], common_prefix(right[order[:-1]], right[order[1:]], right_size[order[:-1]], right_size[order[1:]]), -1)
    left_rank, place = np.empty(len(groups), dtype=np.int64), np.empty(len(groups), dtype=np.int64)
    left_rank[byte_order(left, left_size, groups)] = np.arange(len(groups))
    place[order] = np.arange(len(groups))
    for first, stop, depth in interval_tree(prefix, g):
        members = order[first:stop]
        members = members[np.argsort(left_rank[members])]
        shared = common_prefix(left[members[:-1]], left[members[1:]], left_size[members[:-1]], left_size[members[1:]])
        for a, b, side in interval_tree(np.where(shared + depth >= need, shared, -1), members):
            at = np.sort(place[members[a:b]])
            if prefix[at[0] : at[-1]].min() == depth:  # else all of them share more to the right
                yield members[a:b], side, depth


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """repeat (sha256 of the bytes, or the hash of a hot gram's string), n_bytes, doc_id, row, start: an occurrence a row, over whole texts."""
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("copy", F.monotonically_increasing_id())
    texts = materialised(texts.withColumn("row", F.xxhash64("doc_id", "text", "copy")).select("row", "doc_id", "text"))
    need = length - gram
    found = anchor_rows(texts.select("row", "text"), length, gram)
    again = materialised(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    live = materialised(found.join(again, "gram", "left_semi"))
    kinds = materialised(live.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("at")))
    many = materialised(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")))
    asked = kinds.join(many, "gram").select("at.row", F.struct("at.place", "gram", "context", "n", (F.col("kinds") > hot).alias("hot")).alias("ask"))
    asked = materialised(asked.groupBy("row").agg(F.collect_list("ask").alias("asks")))

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, asks in zip(batch["text"], batch["asks"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for a in asks:
                    p = a["place"]
                    first, stop = max(0, p - need), min(len(raw), p + length)
                    strings = None
                    if a["hot"]:
                        part = np.frombuffer(raw[first:stop], dtype=np.uint8)
                        h, (_, down) = prefix_hashes(part), powers(len(part) + 1)
                        strings = mix64((h[length:] - h[:-length]) * down[: len(h) - length]).view(np.int64).tolist()
                    rows.append((a["gram"], a["context"], a["n"], raw[first:p], raw[p:stop], strings))
            yield pd.DataFrame(rows, columns=["gram", "context", "n", "before", "after", "strings"])

    met = likely(texts.select("row", "text"), asked, "row").join(asked, "row").mapInPandas(contexts, "gram long, context long, n long, before binary, after binary, strings array<long>")
    met = materialised(met)

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        before, after = frame["before"].tolist(), frame["after"].tolist()
        rows = []

        def add(members, left: int, right: int) -> None:
            one = members[0]
            string = before[one][len(before[one]) - left :] + after[one][: gram + right]
            if left in anchors([string], length, gram)[1]:
                name = hashlib.sha256(string).hexdigest()
                rows.extend((name, len(string), frame["gram"].iat[m], frame["context"].iat[m], left) for m in members)

        for members, left, right in repeat_sets(frame["gram"].to_numpy(), [b[::-1] for b in before], [a[gram:] for a in after], need):
            add(members, left, right)
        for m in np.flatnonzero(frame["n"].to_numpy() > 1):
            if len(before[m]) + len(after[m]) >= length:
                add([m], len(before[m]), len(after[m]) - gram)
        return pd.DataFrame(rows, columns=["repeat", "n_bytes", "gram", "context", "left"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in (b for b in batches if len(b)):
            held.append(batch)
            if sum(map(len, held)) >= 20_000:
                frame = pd.concat(held, ignore_index=True)
                done = frame["gram"].to_numpy() != frame["gram"].iloc[-1]
                held = [frame[~done]]
                if done.any():
                    yield solve(frame[done].reset_index(drop=True))
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    plain = met.filter("strings is null").select("gram", "context", "n", "before", "after").repartition("gram").sortWithinPartitions("gram")
    sets = materialised(plain.mapInPandas(scan, "repeat string, n_bytes int, gram long, context long, left int"))
    some = live.join(sets, ["gram", "context"]).select("repeat", "n_bytes", "row", (F.col("place") - F.col("left")).alias("start"))
    # a hot gram's strings: told apart by the gram, its place in them and their hash
    strings = met.filter("strings is not null").select("gram", "context", "n", F.octet_length("before").alias("left"), F.posexplode("strings").alias("i", "hash"))
    strings = strings.withColumn("into", F.col("left") - F.col("i"))
    twice = strings.groupBy("gram", "into", "hash").agg(F.sum("n").alias("total")).filter("total > 1").select("gram", "into", "hash")
    named = strings.join(twice, ["gram", "into", "hash"]).select(F.concat_ws(":", F.hex("gram"), F.col("into").cast("string"), F.hex("hash")).alias("repeat"), F.lit(length).alias("n_bytes"), "gram", "context", "into")
    rest = live.join(named, ["gram", "context"]).select("repeat", "n_bytes", "row", (F.col("place") - F.col("into")).alias("start"))
    return some.unionByName(rest).distinct().join(texts.select("row", "doc_id"), "row").select("repeat", "n_bytes", "doc_id", "row", "start")
