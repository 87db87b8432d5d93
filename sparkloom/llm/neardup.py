"""Near-duplicate documents by improved consistent weighted sampling.

Shingles are five words; a shingle weighs its count in the document times its
inverse document frequency, which is counted exactly over all documents. Two
texts are near if their weighted Jaccard similarity reaches the threshold, or if
their sets of shingles would reach it were they in no other text: the more copies
a text has, the less weigh the shingles that they share, so that by weight alone a
copy with an edit of its own would leave a large group that it stays in if it is small.

1. Equal texts are one vertex, named by a 64-bit hash of the text, with the
   number of its documents.
2. Document frequencies: each task sends its distinct shingles in sorted, delta
   coded blocks by hash range; a range is counted by itself. Shingles of one
   document need no row. Ranges grow in number with the corpus, not in size.
3. Sampling: the at most ``HEAVY`` shingles of most documents are broadcast with
   their frequencies; any other counts as unique there. A shared shingle can
   only weigh more by that, so near documents are not sampled apart. As many bands
   again are of the least hashes, for which all shingles weigh the same.
4. Banding: a bucket's documents are compared with its two ends, the least and
   largest. Those that are in neither's class go on to four smaller buckets each,
   of two further bands, for ``DEPTH`` rounds; then they meet again, with four
   times as many ends each round, until no bucket holds two of them. At last all
   pairs of a bucket that are still of two classes are compared, in tiles of at
   most some ``2 * TILE`` texts, so that no pair of a bucket is left out. Tiles
   drop a pair only by upper bounds of both similarities: weights and shingles are
   summed by ``FOLD`` hash bins, whose lesser ones are no less than what is shared.
5. Each pair is verified by the exact similarities: the candidates' repeated
   shingles are joined with the exact frequencies (rare ones alone are joined, so
   no key is hot), and what is unique counts in a document's total.

Classes are the connected components. Shingles are compared by 56-bit hashes.
Only a pair that shares no bucket can be missed: 2 in 10,000 at similarity 0.8.
The tiles of a bucket whose texts stay in different classes grow with its square.

Edge cases: a null text is in no class but its own; equal texts are one class,
however short; a text of fewer than five words is one shingle; rows with a null
id have no class, though their texts count; repeated rows are one vertex; rows of
one id with different texts have a class each; an empty table gives no rows. A
text's shingles are held by one worker at a time, some 50 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bounded_batches, in_bitmap, lean, likely, materialised, return_memory, table
from .graph import components, extended
from .textkit import chunks, mix64, shingle_hashes, word_hashes

#: Bands of each of the two measures.
BANDS, ROWS = 12, 3
THRESHOLD = 0.8
WIDTH = 5
HEAVY = 1 << 20
DEPTH = 3
#: The further bands of a smaller bucket, as steps from the last one.
STEPS = ((1, 2), (1, 3), (2, 3), (2, 4))
#: Texts of a block of a bucket, two of which make a tile, and hash bins of weights.
TILE, FOLD = 2048, 128
#: Bits of a shingle's hash, shingles that a task gathers before it sends blocks, characters of text for each hash range.
SHINGLE_BITS, GATHERED, RANGE_CHARS = 56, 1_000_000, 1 << 25


@lru_cache(1)
def gamma_table(bits: int = 16) -> np.ndarray:
    """Quantiles of the Gamma(2, 1) distribution at the middle of 2**bits equal steps, by Newton's method."""
    u = (np.arange(1 << bits) + 0.5) / (1 << bits)
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / np.maximum(x * np.exp(-x), 1e-300), 1e-9)
    return x.astype(np.float32)


def counted_shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text in order of their hash, their counts, and offsets by text."""
    shingles, at = shingle_hashes(*word_hashes(texts), WIDTH)
    shingles = shingles >> np.uint64(64 - SHINGLE_BITS)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(shingles), dtype=bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return shingles[first], np.diff(np.append(first, len(shingles))), np.searchsorted(owner[first], np.arange(len(texts) + 1))


def samples(shingles: np.ndarray, weights: np.ndarray, at: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """(texts with shingles, n) consistent weighted samples: a hash of the sampled shingle and its level."""
    full = np.flatnonzero(np.diff(at) > 0)
    starts, sizes = at[:-1][full], np.diff(at)[full]
    owner = np.repeat(np.arange(len(full)), sizes)
    gamma, out = gamma_table(), np.empty((len(full), n), dtype=np.uint64)
    log_gamma, log_weight = np.log(gamma), np.log(weights).astype(np.float32)
    for j in range(n):
        h = mix64(shingles + np.uint64((j + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
        r = gamma[(h & np.uint64(0xFFFF)).astype(np.int64)]
        beta = (h >> np.uint64(40)).astype(np.float32) * np.float32(2.0**-24)
        level = np.floor(log_weight / r + beta)
        a = log_gamma[((h >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (level - beta) - r
        hit = np.flatnonzero(a == np.minimum.reduceat(a, starts)[owner])
        pick = hit[np.searchsorted(hit, starts)]
        out[:, j] = mix64(shingles[pick] ^ mix64(level[pick].astype(np.int64).view(np.uint64) + np.uint64(j)))
    return out


def least_hashes(shingles: np.ndarray, at: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """(texts with shingles, n) the least hash of each text's shingles by n functions."""
    starts, mixed = at[:-1][np.diff(at) > 0], shingles ^ (shingles >> np.uint64(31))
    odd = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([np.minimum.reduceat(mixed * k, starts) for k in odd], axis=1)


def distinct_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """v, text, n: each text once, with the number of its documents. Only texts that may repeat are shuffled. ``ids``: doc_id, v."""
    several = materialised(ids.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    hashed = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("v"), "text")
    alone = likely(hashed, several, "v", inverse=True).withColumn("n", F.lit(1).cast("long"))
    return alone.unionByName(likely(hashed, several, "v").groupBy("v").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n")))


def packed_block(values: np.ndarray) -> bytes:
    """Sorted whole numbers as their first one and steps of as few bytes as the largest step needs."""
    if not len(values):
        return b""
    steps = np.diff(values)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + values[:1].astype("<u8").tobytes() + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpacked_block(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, dtype=np.uint64)
    width, first = raw[0], np.frombuffer(raw, dtype="<u8", count=1, offset=1)
    steps = np.zeros(((len(raw) - 9) // width, 8), dtype=np.uint8)
    steps[:, :width] = np.frombuffer(raw, dtype=np.uint8, offset=9).reshape(-1, width)
    return np.cumsum(np.concatenate([first, steps.reshape(-1).view("<u8")]), dtype=np.uint64)


def document_frequencies(texts: DataFrame, ranges: int) -> DataFrame:
    """shingle, df: the exact number of documents of every shingle that two or more have. ``ranges``: a power of two."""
    bounds = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(SHINGLE_BITS - (ranges.bit_length() - 1))

    def blocks(held: list[np.ndarray], times: list[np.ndarray]) -> pd.DataFrame:
        values, counts = np.concatenate(held), np.concatenate(times)
        held.clear()
        times.clear()
        order = np.argsort(values)
        values = values[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=np.int64)
        counts = np.add.reduceat(counts[order], first) if len(first) else counts
        values, rows = values[first], []
        cuts = np.searchsorted(values, bounds)
        for k in np.flatnonzero(np.diff(cuts)):
            v, c = values[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]
            rows.append((int(k), packed_block(v[c == 1]), packed_block(v[c > 1]), c[c > 1].astype("<u8").tobytes()))
        return pd.DataFrame(rows, columns=["part", "once", "more", "times"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, times, size = [], [], 0
        for batch in batches:
            n = batch["n"].to_numpy()
            for first, group in chunks(batch["text"]):
                shingles, _, at = counted_shingles(group)
                held.append(shingles)
                times.append(np.repeat(n[first : first + len(group)], np.diff(at)))
                size += len(shingles)
                if size >= GATHERED:
                    yield blocks(held, times)
                    size = 0
                    return_memory()
        if size:
            yield blocks(held, times)

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        once = [unpacked_block(b) for b in rows["once"]]
        more = [unpacked_block(b) for b in rows["more"]]
        values = np.concatenate(once + more)
        times = np.concatenate([np.ones(sum(map(len, once)), dtype=np.int64), *[np.frombuffer(b, dtype="<i8") for b in rows["times"]]])
        order = np.argsort(values)
        values = values[order]
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
        df = np.add.reduceat(times[order], first)
        return pd.DataFrame({"shingle": values[first][df > 1].view(np.int64), "df": df[df > 1]})

    return texts.select("text", "n").mapInPandas(lean(send), "part long, once binary, more binary, times binary").groupBy("part").applyInPandas(count, "shingle long, df long")


def heaviest(frequencies: DataFrame, most: int = HEAVY) -> tuple[int, np.ndarray, np.ndarray]:
    """The least power of two that at most ``most`` frequencies reach, and those shingles, sorted, with their frequencies."""
    by_size = {r["k"]: r["n"] for r in frequencies.groupBy(F.floor(F.log2("df")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
    cut, total = 64, 0
    while cut > 1 and total + by_size.get(cut - 1, 0) <= most:
        cut -= 1
        total += by_size.get(cut, 0)
    least = 1 << min(cut, 62)

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"shingles": [batch["shingle"].to_numpy().astype("<u8").tobytes()], "dfs": [batch["df"].to_numpy().astype("<i8").tobytes()]})

    # as bytes, 16 a shingle: rows of their own would take far more of the driver's memory
    rows = frequencies.filter(F.col("df") >= least).mapInPandas(lean(packed), "shingles binary, dfs binary").collect()
    shingles, dfs = (np.frombuffer(b"".join(r[c] for r in rows), dtype=t) for c, t in (("shingles", "<u8"), ("dfs", "<i8")))
    order = np.argsort(shingles)
    return least, shingles[order], dfs[order]


def inverse_frequency(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def known_frequency(shingles: np.ndarray, heavy: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The frequencies of the heavy ones among the shingles, 1 for the others."""
    keys, df = heavy
    if not len(keys):
        return np.ones(len(shingles), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, shingles), len(keys) - 1)
    return np.where(keys[at] == shingles, df[at], 1)


def sketches(texts: DataFrame, heavy: Broadcast, total: int) -> DataFrame:
    """v, bands of every text with words: those by weight, then those by least hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = batch["v"].to_numpy()
            for first, group in chunks(batch["text"]):
                shingles, count, at = counted_shingles(group)
                if not len(shingles):
                    continue
                weighted = samples(shingles, count * inverse_frequency(known_frequency(shingles, heavy.value), total), at)
                drawn = np.concatenate([weighted, least_hashes(shingles, at)], axis=1).reshape(-1, 2 * BANDS, ROWS)
                keys = np.zeros(drawn.shape[:2], dtype=np.uint64)
                for k in range(ROWS):
                    keys = mix64(keys ^ drawn[:, :, k])
                yield pd.DataFrame({"v": v[first + np.flatnonzero(np.diff(at) > 0)], "bands": list(keys.view(np.int64))})

    return texts.select("v", "text").mapInPandas(lean(run), "v long, bands array<long>")


def weighted_lists(texts: DataFrame, wanted: Broadcast, repeated: Broadcast, heavy: Broadcast, frequencies: DataFrame, total: int) -> DataFrame:
    """v, total, n, shingles, weights: the repeated shingles of the wanted texts, in order, and the weight and number of all of them.

    ``wanted`` is a bitmap of texts, ``repeated`` one of shingles of frequency two or more that are not heavy.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[in_bitmap(wanted.value, batch["v"].to_numpy())]
            v, rows = batch["v"].tolist(), []
            for first, group in chunks(batch["text"]):
                shingles, count, at = counted_shingles(group)
                df = known_frequency(shingles, heavy.value)
                known = df > 1
                asked = ~known & in_bitmap(repeated.value, shingles.view(np.int64))
                weight = count * inverse_frequency(df, total)
                for i in range(len(group)):
                    own = slice(at[i], at[i + 1])
                    s, c, w, k, q = shingles[own].view(np.int64), count[own], weight[own], known[own], asked[own]
                    rows.append((v[first + i], w[~k & ~q].sum(), len(s), s[k], w[k], s[q], c[q]))
            yield pd.DataFrame(rows, columns=["v", "alone", "n", "known", "weights", "asked", "counts"])

    rows = texts.select("v", "text").mapInPandas(lean(ask), "v long, alone double, n long, known array<long>, weights array<double>, asked array<long>, counts array<long>")
    rows = materialised(rows)
    pairs = lambda a, b: F.explode(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")))
    asked = rows.select("v", pairs("asked", "counts").alias("p")).select("v", F.col("p.x").alias("shingle"), F.col("p.y").alias("c")).join(frequencies, "shingle", "left")
    weight = F.col("c") * (F.log(F.lit(1.0 + total) / (1 + F.coalesce("df", F.lit(1)))) + 1)
    asked = asked.select("v", F.when(F.col("df").isNotNull(), F.col("shingle")).alias("shingle"), weight.alias("w"))
    known = rows.select("v", pairs("known", "weights").alias("p")).select("v", F.col("p.x").alias("shingle"), F.col("p.y").alias("w"))
    every = asked.unionByName(known).unionByName(rows.select("v", "n", F.lit(None).cast("long").alias("shingle"), F.col("alone").alias("w")), allowMissingColumns=True)
    lists = every.groupBy("v").agg(F.sum("w").alias("total"), F.max("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("shingle").isNotNull(), F.struct("shingle", "w")))).alias("l"))
    return materialised(lists.select("v", "total", "n", F.col("l.shingle").alias("shingles"), F.col("l.w").alias("weights")))


def similarity(a: tuple, b: tuple, alone: float) -> float:
    """Weighted Jaccard similarity of two (total, n, sorted shingles, weights), or that of their sets if it is larger.

    In the sets a shingle of one text weighs ``alone`` times as much as one of both, as it would if no other text had them.
    """
    if len(a[2]) > len(b[2]):
        a, b = b, a
    if not len(a[2]):
        return 0.0
    at = np.minimum(np.searchsorted(b[2], a[2]), len(b[2]) - 1)
    shared = b[2][at] == a[2]
    least, both = float(np.minimum(a[3], b[3][at])[shared].sum()), int(np.count_nonzero(shared))
    most = a[0] + b[0] - least
    return max(least / most if most > 0 else 0.0, both / (both + alone * (a[1] + b[1] - 2 * both)))


def verified(pairs: DataFrame, lists: DataFrame, threshold: float, total: int) -> DataFrame:
    """The pairs (a, b) whose similarity reaches the threshold, with it."""
    alone = float(inverse_frequency(1, total) / inverse_frequency(2, total))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sides = [list(zip(batch[f"total_{x}"], batch[f"n_{x}"], batch[f"shingles_{x}"], batch[f"weights_{x}"], strict=True)) for x in "ab"]
            out = batch[["a", "b"]].assign(similarity=[similarity(x, y, alone) for x, y in zip(*sides, strict=True)])
            yield out[out["similarity"] >= threshold - 1e-12]

    side = lambda x: lists.select(F.col("v").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("total", "n", "shingles", "weights")])
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(lean(run), "a long, b long, similarity double")


def with_ends(keyed: DataFrame, salt: int, slots: int = 1) -> tuple[DataFrame, DataFrame]:
    """(v, key, band, ends) of the buckets of two or more texts, and (key, ends): the least and largest of each slot, by v (salt 0) or by a draw."""
    rank = F.struct((F.col("v") if salt == 0 else F.xxhash64("v", "key", F.lit(salt))).alias("rank"), F.col("v").alias("at"))
    slot = F.lit(0) if slots == 1 else F.pmod(F.xxhash64("v", "key", F.lit(-salt)), F.lit(slots))
    ends = keyed.groupBy("key", slot.alias("slot")).agg(F.min(rank)["at"].alias("low"), F.max(rank)["at"].alias("high"))
    ends = ends.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list(F.array("low", "high")))).alias("ends")).filter("size(ends) > 1")
    # written before it is joined: a join of two plain shuffles is one whose hot bucket Spark can split
    ends = materialised(ends)
    return materialised(keyed.join(ends, "key")), ends


def links_of(buckets: DataFrame) -> DataFrame:
    """Distinct (a, b): a text and an end of one of its buckets."""
    return buckets.select("v", F.explode("ends").alias("b")).filter("v <> b").select(F.least("v", "b").alias("a"), F.greatest("v", "b").alias("b")).distinct()


def narrower(rest: DataFrame, sketched: DataFrame) -> DataFrame:
    """The rows of ``rest`` (v, key, band) in the buckets that each of STEPS makes of theirs, by bands of the same measure."""
    band = lambda step: F.col("band") - F.col("band") % BANDS + (F.col("band") + step) % BANDS
    value = lambda step: F.element_at("bands", band(step) + 1)
    made = F.array(*[F.struct(F.xxhash64("key", band(i), value(i), band(j), value(j)).alias("key"), band(j).alias("band")) for i, j in STEPS])
    return rest.join(sketched, "v").select("v", F.inline(made)).distinct()


def folded(lists: DataFrame) -> DataFrame:
    """v, total, n, fold: the weights of each list by hash bin, then its shingles by bin, as 16-bit numbers that are rounded up.

    A text of lists without n has no other shingles than those listed.
    """
    if "n" not in lists.columns:
        lists = lists.withColumn("n", F.size("shingles").cast("long"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = [np.asarray(s, dtype=np.int64) & (FOLD - 1) for s in batch["shingles"]]
            folds = [np.append(np.bincount(s, weights=w, minlength=FOLD), np.bincount(s, minlength=FOLD)) for s, w in zip(bins, batch["weights"], strict=True)]
            yield batch[["v", "total", "n"]].assign(fold=[np.nextafter(f.astype("<f2"), np.float16(np.inf)).tobytes() for f in folds])

    return lists.mapInPandas(lean(run), "v long, total double, n long, fold binary")


def tiles(sketched: DataFrame, labels: DataFrame) -> DataFrame:
    """key, i, j, block, band, v, label, bands: the texts of the buckets with pairs of two classes that were not compared, in tiles of two blocks."""
    single = F.transform("bands", lambda x, i: F.struct(F.xxhash64(i, x).alias("key"), i.alias("band")))
    keyed = materialised(sketched.select("v", F.inline(single)).join(labels, "v", "left").select("key", "band", "v", F.coalesce("label", "v").alias("label")))
    # of three texts all pairs have an end in them
    mixed = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).filter("n > 3 and low <> high")
    rows = materialised(keyed.join(materialised(mixed.select("key", F.ceil(F.col("n") / TILE).cast("int").alias("blocks"))), "key").withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")))
    dealt = rows.join(sketched, "v").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "band", "v", "label", "bands")


def pairs_left(dealt: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs of a tile of two classes that share no earlier band and may reach the threshold by weight or by sets. ``dealt``: tiles with total, n and fold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v, label, block = (rows[c].to_numpy() for c in ("v", "label", "block"))
        band, whole = int(rows["band"].iloc[0]), rows["i"].iloc[0] == rows["j"].iloc[0]
        earlier, totals = np.stack(rows["bands"].to_numpy())[:, :band], rows[["total", "n"]].to_numpy(dtype=np.float64)
        fold = np.frombuffer(b"".join(rows["fold"]), dtype="<f2").reshape(-1, 2 * FOLD).astype(np.float32)
        a, b = [], []
        for x in range(len(v) - 1):
            y = np.arange(x + 1, len(v))
            y = y[(label[y] != label[x]) & (whole | (block[y] != block[x]))]
            y = y[(np.minimum(totals[y], totals[x]) >= threshold * np.maximum(totals[y], totals[x]) * (1 - 1e-9)).any(axis=1)]
            y = y[~(earlier[y] == earlier[x]).any(axis=1)]
            shared = np.minimum(fold[y], fold[x]).reshape(-1, 2, FOLD).sum(axis=2, dtype=np.float64) + 1e-6
            y = y[(shared >= threshold * (totals[y] + totals[x] - shared) * (1 - 1e-9)).any(axis=1)]
            a.append(np.minimum(v[x], v[y]))
            b.append(np.maximum(v[x], v[y]))
        return pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)} if a else {"a": [], "b": []}, dtype=np.int64)

    return dealt.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def linked(sketched: DataFrame, verify, threshold: float = THRESHOLD, folds=None) -> DataFrame | None:
    """v, label of every text that is near another one of a bucket; ``verify(pairs)`` gives the near pairs (a, b). ``sketched``: v, bands.

    ``folds()`` gives v, total, n, fold of the texts that share a bucket; without it, nothing is dropped before the last pairs are verified.
    """
    single = F.transform("bands", lambda x, i: F.struct(F.xxhash64(i, x).alias("key"), i.alias("band")))
    buckets, ends = with_ends(sketched.select("v", F.inline(single)), 0)
    labels = None
    depth = 0
    while not ends.isEmpty():
        found = materialised(verify(materialised(links_of(buckets))).select("a", "b"))
        if labels is None:
            labels = components(found)
        elif not found.isEmpty():
            labels = extended(labels, found)
        ended = ends.select("key", F.explode("ends").alias("v")).join(labels, "v", "left").groupBy("key").agg(F.collect_set(F.coalesce("label", "v")).alias("taken"))
        rest = buckets.filter("not array_contains(ends, v)").join(labels, "v", "left").join(ended, "key").filter("not array_contains(taken, coalesce(label, v))").select("v", "key", "band")
        depth += 1
        rest = materialised(narrower(rest, sketched) if depth <= DEPTH else rest)
        buckets, ends = with_ends(rest, depth, 4 ** max(0, depth - DEPTH))
    if labels is None:
        return None
    dealt = tiles(sketched, labels)
    if folds is not None:
        left = pairs_left(dealt.join(folds(), "v"), threshold)
    else:
        other = dealt.select("key", "i", "j", *[F.col(c).alias(f"other_{c}") for c in ("v", "label")])
        left = dealt.join(other, ["key", "i", "j"]).filter("v < other_v and label <> other_label").select(F.col("v").alias("a"), F.col("other_v").alias("b")).distinct()
    left = materialised(left)
    if left.isEmpty():
        return labels
    found = materialised(verify(left).select("a", "b"))
    return labels if found.isEmpty() else extended(labels, found)


def classes(docs: DataFrame, threshold: float = THRESHOLD, text_hash: bool = False) -> DataFrame:
    """doc_id, class_id for every row with an id; class_id is the least id of the class. With ``text_hash`` also v, xxhash64 of the text."""
    spark = docs.sparkSession
    ids = materialised(docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("v"), F.length("text").cast("long").alias("size")))
    whole = ids.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).collect()[0]
    texts = distinct_texts(docs, ids)
    ranges = 1 << max(7, int(whole["size"] // RANGE_CHARS).bit_length())
    frequencies = materialised(document_frequencies(texts, ranges))
    least, keys, df = heaviest(frequencies)
    heavy = spark.sparkContext.broadcast((keys, df))
    sketched = materialised(sketches(texts, heavy, whole["n"]))
    rare = frequencies.filter(F.col("df") < least)
    state: dict = {}

    def verify(pairs: DataFrame) -> DataFrame:
        if "lists" not in state:  # all later pairs are of texts that share a bucket with another one in the first round
            ends = pairs.select(F.explode(F.array("a", "b")).alias("v"))
            wanted, repeated = bitmap(ends, "v"), bitmap(rare, "shingle")
            state["lists"] = weighted_lists(texts, spark.sparkContext.broadcast(wanted), spark.sparkContext.broadcast(repeated), heavy, rare, whole["n"])
        return verified(pairs, state["lists"], threshold, whole["n"])

    labels = linked(sketched, verify, threshold, lambda: materialised(folded(state["lists"])))
    first = ids.groupBy("v").agg(F.min("doc_id").alias("first"))
    if labels is None:
        named = first.withColumnRenamed("first", "class_id")
    else:
        joined = materialised(first.join(labels, "v").select("v", "label", "first"))
        least_id = joined.groupBy("label").agg(F.min("first").alias("least"))
        named = first.join(joined.select("v", "label"), "v", "left").join(least_id, "label", "left").select("v", F.coalesce("least", "first").alias("class_id"))
    found = ids.filter(F.col("doc_id").isNotNull()).join(materialised(named), "v").select("doc_id", "class_id", "v")
    alone = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNull()).select(F.col("doc_id").cast("long").alias("doc_id")).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(None).cast("long").alias("v"))
    every = found.unionByName(alone)
    return every if text_hash else every.drop("v")


def with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with text_a and text_b. Texts are cut down to those of the pairs once, then joined."""
    ends = pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct()
    texts = likely(docs.select(F.col("doc_id").cast("long").alias("v"), "text"), ends, "v").join(ends, "v", "left_semi")
    texts = materialised(texts)
    left = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a")
    return left.join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b")


def op4_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return classes(table(spark, sf_dir, "documents"))
