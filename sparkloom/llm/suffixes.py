"""Exact removal of repeated byte strings with a sparse enhanced suffix array.

A string of ``LENGTH`` bytes holds at least one anchor: the least of the hashes
of its ``GRAM``-byte pieces. Two equal strings hold the same anchor at the same
place, so all repeats are found among the occurrences of one anchor, each with
the ``LENGTH - GRAM`` bytes to its left and right (its context).

1. Anchors are emitted as (gram hash, context hash, row, place): about 1.5 % of
   the bytes. Contexts that occur twice are repeated from end to end.
2. Grams with several distinct contexts get a suffix array: contexts sorted by
   their right side, longest common prefixes of neighbours, and a stack scan
   that gives the common-prefix interval tree. In each interval the left sides
   are compared: diverse left extensions that, with the interval's prefix, still
   reach LENGTH bytes make a maximal repeat of all its occurrences.
3. A gram with more than ``HOT`` distinct contexts is not gathered: the hashes of
   its strings of LENGTH bytes are counted instead, combined before the shuffle.

Hashes have 64 bits and are only compared within equal grams.

Edge cases: a null text is empty; texts under LENGTH bytes lose nothing; equal
rows count as two occurrences; rows are told apart by a hash of id and text, so
null or repeated ids do no harm; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, likely, materialised, table, text_or_empty
from .textkit import mix64, powers, prefix_hashes, window_minima

LENGTH, GRAM = 200, 64
HOT = 20_000
CHUNK_BYTES = 250_000


def byte_chunks(texts: pd.Series, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    group, first, total = [], 0, 0
    for i, t in enumerate(texts):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if group and total + len(raw) > size:
            yield first, group
            group, first, total = [], i, 0
        group.append(raw)
        total += len(raw)
    if group:
        yield first, group


def anchors(group: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text, place in it, gram hash and context hash of every anchor."""
    data = np.frombuffer(b"".join(group), dtype=np.uint8)
    ends = np.cumsum([len(g) for g in group])
    starts = ends - [len(g) for g in group]
    if len(data) < length:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.uint64, np.uint64))
    h, (_, down) = prefix_hashes(data), powers(len(data) + 1)
    grams = mix64((h[gram:] - h[:-gram]) * down[: len(h) - gram])
    owner = np.repeat(np.arange(len(group), dtype=np.int32), np.diff(np.append(0, ends)))
    at = window_minima(grams, length - gram + 1, owner[: len(data) - length + 1] == owner[length - 1 :])
    text, side = owner[at].astype(np.int64), length - gram
    left, right = np.minimum(side, at - starts[text]), np.minimum(side, ends[text] - at - gram)
    context = mix64(mix64((h[at + gram + right] - h[at - left]) * down[at - left]) ^ (left * 1024 + right).astype(np.uint64))
    return text, at - starts[text], grams[at], context


def anchor_rows(texts: DataFrame, length: int, gram: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = batch["row"].to_numpy()
            for first, group in byte_chunks(batch["text"]):
                text, place, grams, context = anchors(group, length, gram)
                yield pd.DataFrame({"row": keys[first + text], "place": place.astype(np.int32), "gram": grams.view(np.int64), "context": context.view(np.int64)})

    return texts.mapInPandas(run, "row long, place int, gram long, context long")


def common_prefix(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Common prefix lengths of the rows of two byte matrices with given sizes."""
    if not len(a):
        return np.zeros(0, dtype=np.int64)
    differs = np.concatenate([a != b, np.ones((len(a), 1), dtype=bool)], axis=1)
    return np.minimum(differs.argmax(axis=1), np.minimum(size_a, size_b))


def matrix(parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return np.frombuffer(b"".join([p.ljust(width, b"\0") for p in parts]), dtype=np.uint8).reshape(-1, width), sizes


def byte_order(m: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Order by group, bytes, size."""
    wide = np.zeros((len(m), -(-m.shape[1] // 8) * 8), dtype=np.uint8)
    wide[:, : m.shape[1]] = m
    words = wide.view(">u8").astype(np.uint64)
    return np.lexsort((sizes, *[words[:, k] for k in range(words.shape[1] - 1, -1, -1)], groups))


def interval_tree(prefix: np.ndarray, groups: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, past the last, common prefix) of every interval of two or more suffixes.

    ``prefix[i]`` is the common prefix of suffixes i and i + 1 in order, or -1
    where a group ends. The stack holds open intervals; each is written once, when
    a smaller prefix closes it.
    """
    out, stack = [], []
    for i, value in enumerate([*prefix.tolist(), -1]):
        first = i
        while stack and stack[-1][1] > value:
            first, depth = stack.pop()
            out.append((first, i + 1, depth))
        if value >= 0 and (not stack or stack[-1][1] < value):
            stack.append((first, value))
    return out


def repeats(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], need: int) -> tuple[np.ndarray, np.ndarray]:
    """For each context: the farthest it is repeated to the left and to the right of its gram, or -1.

    ``lefts`` are reversed. Two contexts of a group repeat each other if their
    common left and right together have ``need`` bytes or more.
    """
    left, left_size = matrix(lefts, need)
    right, right_size = matrix(rights, need)
    order = byte_order(right, right_size, groups)
    g = groups[order]
    prefix = common_prefix(right[order[:-1]], right[order[1:]], right_size[order[:-1]], right_size[order[1:]])
    prefix = np.where(g[:-1] == g[1:], prefix, -1)
    tree = interval_tree(prefix, g)
    best_left, best_right = np.full(len(groups), -1, dtype=np.int64), np.full(len(groups), -1, dtype=np.int64)
    left_rank = np.empty(len(groups), dtype=np.int64)
    left_rank[byte_order(left, left_size, groups)] = np.arange(len(groups))
    at = 0
    while at < len(tree):  # about a hundred thousand occurrences at a time
        total, stop = 0, at
        while stop < len(tree) and (stop == at or total + tree[stop][1] - tree[stop][0] <= 100_000):
            total += tree[stop][1] - tree[stop][0]
            stop += 1
        some = tree[at:stop]
        at = stop
        node = np.repeat(np.arange(len(some)), [b - a for a, b, _ in some])
        depth = np.array([d for _, _, d in some])
        member = order[np.concatenate([np.arange(a, b) for a, b, _ in some])]
        by_left = np.lexsort((left_rank[member], node))
        node, member = node[by_left], member[by_left]
        one, two = member[:-1], member[1:]
        pair = np.flatnonzero(node[:-1] == node[1:])
        one, two, deep = one[pair], two[pair], depth[node[pair]]
        shared = common_prefix(left[one], left[two], left_size[one], left_size[two])
        ok = shared + deep >= need
        for side in (one[ok], two[ok]):
            np.maximum.at(best_left, side, shared[ok])
            np.maximum.at(best_right, side, deep[ok])
    return best_left, best_right


def repeated_parts(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(texts with row, text; parts with row, first, stop): bytes that an equal string of ``length`` bytes elsewhere covers."""
    texts = docs.select("doc_id", text_or_empty().alias("text")).withColumn("row", F.xxhash64("doc_id", "text")).select("row", "text", "doc_id")
    need = length - gram
    found = anchor_rows(texts.select("row", "text"), length, gram)
    # nearly all grams stand alone: they are dropped before anything else is shuffled
    # counts are written before they are joined: a join of two plain shuffles is one whose hot gram Spark can split
    again = materialised(found.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"))
    live = materialised(found.join(again, "gram", "left_semi"))
    kinds = materialised(live.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "place")).alias("at")))
    whole = live.join(kinds.filter("n > 1").select("gram", "context"), ["gram", "context"], "left_semi").select("row", F.greatest(F.col("place") - need, F.lit(0)).alias("first"), (F.col("place") + length).alias("stop"))
    several = materialised(kinds.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1"))
    asked = kinds.join(several, "gram").select("at.row", F.struct("at.place", "gram", "n", (F.col("kinds") > hot).alias("hot")).alias("ask")).groupBy("row").agg(F.collect_list("ask").alias("asks"))
    asked = materialised(asked)

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row, text, asks in zip(batch["row"], batch["text"], batch["asks"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                windows = None
                for a in asks:
                    p = a["place"]
                    if not a["hot"]:
                        rows.append((a["gram"], raw[max(0, p - need) : p][::-1], raw[p + gram : p + length], row, p, a["n"], None))
                        continue
                    if windows is None:
                        h, (_, down) = prefix_hashes(np.frombuffer(raw, dtype=np.uint8)), powers(len(raw) + 1)
                        windows = mix64((h[length:] - h[:-length]) * down[: len(h) - length]).view(np.int64)
                    first = max(0, p - need)
                    rows.append((a["gram"], b"", b"", row, p, a["n"], windows[first : p + 1].tolist()))
            yield pd.DataFrame(rows, columns=["gram", "left", "right", "row", "place", "n", "windows"])

    context = "gram long, left binary, right binary, row long, place int, n long, windows array<long>"
    unique_texts = texts.select("row", "text")

    def gathered(which: str) -> DataFrame:
        asks = asked.withColumn("asks", F.expr(f"filter(asks, a -> {which})")).filter("size(asks) > 0")
        return likely(unique_texts, asks, "row").join(asks, "row").mapInPandas(contexts, context)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def solve(frame: pd.DataFrame) -> pd.DataFrame:
            left, right = repeats(frame["gram"].to_numpy(), frame["left"].tolist(), frame["right"].tolist(), need)
            hit = (left >= 0) & (frame["n"].to_numpy() == 1)
            place = frame["place"].to_numpy()[hit]
            return pd.DataFrame({"row": frame["row"].to_numpy()[hit], "first": place - left[hit], "stop": place + gram + right[hit]})

        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) >= 20_000:
                frame = pd.concat(held, ignore_index=True)
                done = frame["gram"].to_numpy() != frame["gram"].iloc[-1]
                held = [frame[~done]]
                if done.any():
                    yield solve(frame[done])
        if held:
            yield solve(pd.concat(held, ignore_index=True))

    plain = gathered("not a.hot").select("gram", "left", "right", "row", "place", "n")
    edges = plain.repartition("gram").sortWithinPartitions("gram").mapInPandas(scan, "row long, first int, stop int")
    # a string is told apart by its gram and the gram's place in it too: two anchors of one string are no repeat of it
    strings = gathered("a.hot").select("gram", "row", "place", "n", F.posexplode("windows").alias("i", "hash"))
    strings = strings.withColumn("start", F.greatest(F.col("place") - need, F.lit(0)) + F.col("i")).withColumn("into", F.col("place") - F.col("start"))
    same = ["gram", "into", "hash"]
    twice = strings.groupBy(*same).agg(F.sum("n").alias("total")).filter("total > 1").select(*same)
    counted = strings.filter("n = 1").join(twice, same, "left_semi").groupBy("row", "place").agg(F.min("start").alias("first"), (F.max("start") + length).alias("stop")).select("row", "first", "stop")
    return texts, materialised(whole.unionByName(edges).unionByName(counted))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, removed (array of first, stop), kept_sha256, kept (bytes that remain, null unless ``with_kept``)."""
    texts, parts = repeated_parts(docs, length, gram, hot)
    lists = materialised(parts.groupBy("row").agg(F.collect_set(F.struct("first", "stop")).alias("parts")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, parts in zip(batch["doc_id"], batch["text"], batch["parts"], strict=True):
                raw, merged = text.encode("utf-8", "surrogatepass"), []
                for first, stop in sorted((p["first"], min(p["stop"], len(raw))) for p in parts) if parts is not None else ():
                    if merged and first <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], stop)
                    else:
                        merged.append([first, stop])
                kept, at = [], 0
                for first, stop in merged:
                    kept.append(raw[at:first])
                    at = stop
                kept = b"".join([*kept, raw[at:]])
                out.append((doc, len(raw), len(raw) - len(kept), len(merged), [{"first": a, "stop": b} for a, b in merged], hashlib.sha256(kept).hexdigest(), kept if with_kept else None))
            frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "removed", "kept_sha256", "kept"])
            frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], dtype="Int64")
            yield frame

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, removed array<struct<first:int,stop:int>>, kept_sha256 string, kept binary"
    touched = likely(texts, lists, "row").join(lists, "row", "left").select("doc_id", "text", "parts")
    clean = likely(texts, lists, "row", inverse=True).select("doc_id", "text", F.lit(None).cast(lists.schema["parts"].dataType).alias("parts"))
    return touched.unionByName(clean).mapInPandas(run, schema)


def op5_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
