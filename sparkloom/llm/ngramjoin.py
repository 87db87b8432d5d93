"""Exact Jaccard join of documents as sets of word n-grams: tiles by size with hashed bitmaps, then sorted arrays.

Two sets are linked when ``100 * common >= percent * union``. Nothing is drawn: every filter only drops pairs that
cannot reach the threshold, so the links between different texts are complete, up to pairs that links connect already.

1. Equal texts are one vertex, named by a 64-bit hash; an n-gram is a 56-bit hash.
2. N-grams are ordered by a level and their hash. Levels come from counts of all n-grams in a table of cells whose size
   is bounded; a cell of 2**k times the mean count has level k. Any order that all sets share is right; this one puts
   what many documents share last.
3. Sets that reach the threshold share one of their first ``n - ceil(percent * n / 100) + 1`` n-grams, their tokens. Each
   task sends its distinct tokens in sorted blocks, those of two or more sets are kept, and of tokens with the same
   sets the first one.
4. All sets of a token are compared with one of them; links make components. What large groups of near copies have in
   common is settled here, by one row for each set and token.
5. Tokens whose sets are still of several components: those outside the token's largest component meet all of its
   sets, in tiles of one band of sizes (powers of two; a set also visits the next band if a partner may be there). A
   tile holds at most ``TILE`` sets of either side, and larger groups are dealt over a grid of tiles. A pair goes on if
   the sizes, the places of the token and the bitmaps allow it: bits of one set that the other lacks are n-grams that it
   lacks, so bit counts bound the common ones from above. Bitmaps have about twice as many bits as n-grams, within bounds.
   In tokens of more than ``LARGE`` sets each set outside the largest component first sends the one pair of a tile that
   its bitmaps find nearest: what is near merges by a row for each set, however many pairs of a large group of near
   copies would reach the threshold. All pairs that are still of different components go on then.
6. Pairs that go on are verified by intersecting sorted arrays.

Edge cases: a null text and one without words have the empty set, which links with nothing, not even its copies; fewer
words than the width are one n-gram; equal texts are one component; rows of one id with different texts are documents
of their own; rows with a null id have a null component unless a linked row has an id; ties in size change nothing; an
empty table gives no rows; other columns do not matter. A long text is hashed whole by one worker, some 60 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, bounded_batches, in_bitmap, likely, materialised, table
from .graph import components, extended
from .neardup import packed_block, unpacked_block
from .textkit import chunks, mix64, powers, prefix_hashes

WIDTH, PERCENT = 5, 80
HASH_BITS, TOKEN_BITS = 56, 48
#: Cells of the table of counts, as powers of two: at least, at most; characters of text for each cell between those.
CELLS, CELL_CHARS = (18, 24), 1 << 12
#: Characters of text for each range of tokens, tokens that a task gathers before it sends them.
RANGE_CHARS, GATHERED = 1 << 25, 1_000_000
#: Sets of either side of a tile, pairs of a tile that are tested at once, bits of a bitmap (powers of two).
TILE, PAIRS, BITS = 1000, 500_000, (6, 13)

#: Tokens of more sets than this send nearest pairs first.
LARGE = 64

_SPACE = np.ones(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of the texts and offsets by text: runs of anything but space and U+0009 to U+000D, with A-Z lowered."""
    raw = [t.encode("utf-8", "replace") for t in texts]
    data = _LOWER[np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)]
    ends = np.cumsum([len(r) + 1 for r in raw])
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _SPACE[data]
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    h, (_, down) = prefix_hashes(data), powers(len(data) + 1)
    return mix64((h[stops] - h[starts]) * down[starts]), np.concatenate([[0], np.searchsorted(starts, ends)]).astype(np.int64)


def ngram_hashes(words: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``width`` words and offsets by text; all words of a text of fewer are one run.

    The factors of the places have no relation in small whole numbers, so runs of the same few words in other orders differ.
    """
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    counts = np.diff(offsets)
    n = np.where(counts == 0, 0, np.maximum(counts - width + 1, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    first = np.repeat(offsets[:-1] - at[:-1], n) + np.arange(at[-1])
    size = np.repeat(np.minimum(counts, width), n)
    total = size.astype(np.uint64)
    for j in range(width):
        inside = size > j
        total[inside] += words[first[inside] + j] * factors[j]
    return mix64(total), at


def ngram_sets(texts: list[str], levels: np.ndarray | None = None, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of each text in the common order, and offsets by text. Without ``levels`` by hash alone."""
    grams, at = ngram_hashes(*word_hashes(texts), width)
    if levels is not None:
        level = levels[(grams >> np.uint64(64 - (len(levels).bit_length() - 1))).astype(np.int64)]
        grams = grams >> np.uint64(64 - HASH_BITS) | level.astype(np.uint64) << np.uint64(HASH_BITS)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.append(True, (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])) if len(grams) else np.zeros(0, dtype=bool)
    return grams[new], np.searchsorted(owner[new], np.arange(len(texts) + 1))


def n_tokens(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of its first n-grams a set of ``n`` shares one of with every set near it."""
    return np.where(n > 0, n + (-percent * n) // 100 + 1, 0)


def least_common(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """How many n-grams sets of these sizes must have in common."""
    return -((-percent * (a + b)) // (100 + percent))


def token_names(tokens: np.ndarray) -> np.ndarray:
    return (mix64(tokens) >> np.uint64(64 - TOKEN_BITS)).view(np.int64)


def cell_levels(texts: DataFrame, bits: int, width: int) -> np.ndarray:
    """The level of each of ``2**bits`` cells, by counts of all n-grams."""
    page = 1 << 14

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << bits, dtype=np.uint32)
        for batch in batches:
            for _, group in chunks(batch["text"]):
                grams, _ = ngram_sets(group, None, width)
                counts += np.bincount((grams >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
        yield pd.DataFrame([(i, part.astype("<u4").tobytes()) for i, part in enumerate(counts.reshape(-1, page)) if part.any()], columns=["page", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch["page"], batch["counts"], strict=True):
                sums[i] = sums.get(i, 0) + np.frombuffer(part, dtype="<u4").astype(np.int64)
        yield pd.DataFrame([(i, s.astype("<i8").tobytes(), int(s.sum())) for i, s in sums.items()], columns=["page", "counts", "total"])

    pages = materialised(texts.select("text").mapInPandas(count, "page long, counts binary").repartition("page").mapInPandas(add, "page long, counts binary, total long"))
    mean = max(1.0, (pages.agg(F.sum("total")).first()[0] or 0) / (1 << bits))

    def level(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            share = [np.frombuffer(c, dtype="<i8") / mean for c in batch["counts"]]
            yield pd.DataFrame({"page": batch["page"], "levels": [np.floor(np.log2(np.maximum(s, 1))).astype(np.uint8).tobytes() for s in share]})

    out = np.zeros(1 << bits, dtype=np.uint8)
    for row in pages.mapInPandas(level, "page long, levels binary").collect():  # a byte for each cell
        out[row["page"] * page : (row["page"] + 1) * page] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out


def shared_tokens(texts: DataFrame, levels: Broadcast, ranges: int, percent: int, width: int) -> DataFrame:
    """token: the names of tokens that two or more texts have (few of the names stand for several tokens). ``ranges``: a power of two."""
    bounds = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(TOKEN_BITS - (ranges.bit_length() - 1))

    def blocks(held: list[np.ndarray]) -> pd.DataFrame:
        names, n = np.unique(np.concatenate(held), return_counts=True)
        cuts, rows = np.searchsorted(names.view(np.uint64), bounds), []
        for k in np.flatnonzero(np.diff(cuts)):
            own, times = names[cuts[k] : cuts[k + 1]].view(np.uint64), n[cuts[k] : cuts[k + 1]]
            rows.append((int(k), packed_block(own[times == 1]), packed_block(own[times > 1])))
        return pd.DataFrame(rows, columns=["part", "once", "more"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for _, group in chunks(batch["text"]):
                tokens, _, _ = tokens_of(group, levels.value, percent, width)
                held.append(token_names(tokens))
                size += len(tokens)
                if size >= GATHERED:
                    yield blocks(held)
                    held, size = [], 0
        if size:
            yield blocks(held)

    def several(rows: pd.DataFrame) -> pd.DataFrame:
        more = [unpacked_block(b) for b in rows["more"]]
        names = np.sort(np.concatenate([unpacked_block(b) for b in rows["once"]] + more + more))
        return pd.DataFrame({"token": np.unique(names[1:][names[1:] == names[:-1]]).view(np.int64)})

    return texts.select("text").mapInPandas(send, "part long, once binary, more binary").groupBy("part").applyInPandas(several, "token long")


def tokens_of(group: list[str], levels: np.ndarray, percent: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of the texts in order, the place of each in its set, and offsets by text."""
    grams, at = ngram_sets(group, levels, width)
    few = n_tokens(np.diff(at), percent)
    upto = np.concatenate([[0], np.cumsum(few)])
    place = np.arange(upto[-1]) - np.repeat(upto[:-1], few)
    return grams[np.repeat(at[:-1], few) + place], place, upto


def bitmap_bits(n: int, further: int) -> int:
    """Bits of the bitmap of a set of n in the band of its size, or ``further`` bands up."""
    return 1 << min(max(n.bit_length() + further, BITS[0]), BITS[1])


def hashed_bitmap(grams: np.ndarray) -> bytes:
    """The bitmap for the band above the set's own; folded in half it is that of its own band."""
    width = bitmap_bits(len(grams), 1)
    bits = np.zeros(width, dtype=np.uint8)
    bits[(mix64(grams & np.uint64((1 << HASH_BITS) - 1)) & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def token_rows(texts: DataFrame, levels: Broadcast, shared: Broadcast, percent: int, width: int) -> DataFrame:
    """v, n, bits, tokens, places of every text: its size, and where tokens may be shared also its bitmap, those tokens and their places."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v, rows = batch["v"].tolist(), []
            for first, group in chunks(batch["text"]):
                grams, at = ngram_sets(group, levels.value, width)
                tokens, place, upto = tokens_of(group, levels.value, percent, width)
                stay = in_bitmap(shared.value, token_names(tokens))
                for i in range(len(group)):
                    own = stay[upto[i] : upto[i + 1]]
                    some = own.any()
                    rows.append((v[first + i], at[i + 1] - at[i], hashed_bitmap(grams[at[i] : at[i + 1]]) if some else None, tokens[upto[i] : upto[i + 1]][own].view(np.int64), place[upto[i] : upto[i + 1]][own]))
            yield pd.DataFrame(rows, columns=["v", "n", "bits", "tokens", "places"])

    return texts.select("v", "text").mapInPandas(run, "v long, n long, bits binary, tokens array<long>, places array<long>")


def sorted_lists(texts: DataFrame, wanted: Broadcast, levels: Broadcast, width: int) -> DataFrame:
    """v, grams: the n-grams of the wanted texts as packed sorted numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[in_bitmap(wanted.value, batch["v"].to_numpy())]
            v, rows = batch["v"].tolist(), []
            for first, group in chunks(batch["text"]):
                grams, at = ngram_sets(group, levels.value, width)
                rows += [(v[first + i], packed_block(grams[at[i] : at[i + 1]])) for i in range(len(group))]
            yield pd.DataFrame(rows, columns=["v", "grams"])

    return texts.select("v", "text").mapInPandas(run, "v long, grams binary")


def folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps as rows of 64-bit words, each folded to ``width`` bits."""
    out = np.zeros((len(bits), width // 64), dtype=np.uint64)
    size = np.array([len(b) for b in bits])
    for length in np.unique(size).tolist():
        own = np.flatnonzero(size == length)
        rows = np.frombuffer(b"".join([bits[i] for i in own.tolist()]), dtype=np.uint64).reshape(len(own), -1)
        while rows.shape[1] > out.shape[1]:
            rows = rows[:, : rows.shape[1] // 2] | rows[:, rows.shape[1] // 2 :]
        out[own] = rows
    return out


def spare(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """How many more n-grams than the threshold asks for sets of these bitmaps (rows) and sizes can have in common; under 0 they are not near."""
    lacks_a, lacks_b = (np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64) for x, y in ((a, b), (b, a)))
    return np.minimum(n_a - lacks_a, n_b - lacks_b) - least_common(n_a, n_b, percent)


def tile_pairs(rows: pd.DataFrame, percent: int, nearest: bool = False) -> Iterator[pd.DataFrame]:
    """Pairs (a, b) of whole tiles, one of the left side and one of the right, that go on; with ``nearest`` only the best of each left set. ``rows`` are in order of tile and side."""
    tile = np.cumsum(np.append(0, (rows["tile"].to_numpy()[1:] != rows["tile"].to_numpy()[:-1]).astype(np.int64)))
    side, v, n, place, label = (rows[c].to_numpy() for c in ("side", "v", "n", "place", "label"))
    lone, band, bits = rows["lone"].to_numpy(), rows["band"].to_numpy(), rows["bits"].tolist()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    start, stop = np.searchsorted(tile[right], tile[left]), np.searchsorted(tile[right], tile[left], "right")
    upto = np.cumsum(stop - start)
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        sizes = (stop - start)[at:end]
        x = np.repeat(left[at:end], sizes)
        y = right[np.repeat(start[at:end], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        at = end
        # a pair of two left sets comes once; of sets that visit a band, one must be at home there
        stay = (label[x] != label[y]) & ((lone[y] == 0) | (v[x] < v[y]) | nearest)
        x, y = x[stay], y[stay]
        need = least_common(n[x], n[y], percent)
        stay = (np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y])) & (np.minimum(n[x] - place[x], n[y] - place[y]) >= need)
        stay &= np.maximum(n[x], n[y]) >= np.left_shift(1, band[x])
        x, y, found = x[stay], y[stay], []
        for k in np.unique(band[x]).tolist():
            i = np.flatnonzero(band[x] == k)
            used, back = np.unique(np.concatenate([x[i], y[i]]), return_inverse=True)
            maps = folded([bits[u] for u in used.tolist()], bitmap_bits(1 << k, 0))
            for part in np.array_split(np.arange(len(i)), 1 + len(i) // 50_000):
                p, q = back[part], back[len(i) + part]
                over = spare(maps[p], maps[q], n[x[i[part]]], n[y[i[part]]], percent)
                ok = over >= 0
                found.append((x[i[part[ok]]], y[i[part[ok]]], over[ok]))
        if not found:
            continue
        x, y, over = (np.concatenate(c) for c in zip(*found, strict=True))
        if nearest and len(x):
            order = np.lexsort((v[y], -over, x))
            first = order[np.append(True, x[order][1:] != x[order][:-1])]
            x, y = x[first], y[first]
        yield pd.DataFrame({"a": np.minimum(v[x], v[y]), "b": np.maximum(v[x], v[y])})


def tiles(members: DataFrame, facts: DataFrame, labels: DataFrame, percent: int, tile: int = TILE, nearest: bool = False) -> DataFrame:
    """Pairs (a, b) of sets of one token, in different components, that sizes, places and bitmaps let through; with ``nearest`` the best of each set and tile. ``members``: token, v, place; ``facts``: v, n, bits."""
    label = F.coalesce("label", F.col("v")).alias("label")
    known = materialised(members.join(labels, "v", "left").select("token", "v", "place", label).join(facts.select("v", "n"), "v"))
    band = F.length(F.bin("n")) - 1
    up = F.length(F.bin(F.expr(f"n * 100 div {percent}"))) > F.length(F.bin("n"))
    banded = known.select("*", F.explode(F.when(up, F.array(band, band + 1)).otherwise(F.array(band))).alias("band"))
    sizes = banded.groupBy("token", "band", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("token", "band")
    sizes = materialised(sizes.agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("total"), (F.sum("n") - F.max("n")).alias("others")).filter("others > 0"))
    dealt = banded.join(sizes, ["token", "band"]).withColumn("lone", (F.col("label") != F.col("largest")).cast("int"))
    lefts, rights = F.ceil(F.col("others") / tile), F.ceil(F.col("total") / tile)
    slot = lambda n, seed: F.pmod(F.xxhash64("v", F.lit(seed)), n)
    sides = F.array(F.struct(F.lit(1).alias("side"), lefts.alias("times")), F.struct(F.lit(0).alias("side"), F.when(F.col("lone") == 1, rights).otherwise(F.lit(0).cast("long")).alias("times")))
    dealt = dealt.select("*", lefts.alias("lefts"), rights.alias("rights"), F.inline(sides)).filter("times > 0")
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("other"))
    i = F.when(F.col("side") == 0, slot(F.col("lefts"), 1)).otherwise(F.col("other"))
    k = F.when(F.col("side") == 0, F.col("other")).otherwise(slot(F.col("rights"), 2))
    # written before bitmaps are joined, so that a set of many tiles can be split
    dealt = materialised(dealt.select(F.xxhash64("token", "band", i, k).alias("tile"), "side", "v", "n", "place", "label", "lone", "band"))
    rows = dealt.join(facts.select("v", "bits"), "v")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            whole = int(np.searchsorted(rows["tile"].to_numpy(), rows["tile"].iloc[-1])) if len(rows) else 0
            held = rows.iloc[whole:].reset_index(drop=True)
            if whole:
                yield from tile_pairs(rows.iloc[:whole], percent, nearest)
        if held is not None and len(held):
            yield from tile_pairs(held, percent, nearest)

    return rows.repartition("tile").sortWithinPartitions("tile", "side").mapInPandas(run, "a long, b long").distinct()


def allowed(pairs: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps let them through."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            # a set visits the next band, whose bitmaps are twice as long: the smaller one's own band may do for both
            width = np.minimum(batch["bits_a"].map(len), batch["bits_b"].map(len)).to_numpy()
            ok = np.zeros(len(batch), dtype=bool)
            for w in np.unique(width).tolist():
                i = np.flatnonzero(width == w)
                a, b = (folded(batch[c].iloc[i].tolist(), 8 * w) for c in ("bits_a", "bits_b"))
                ok[i] = spare(a, b, n_a[i], n_b[i], percent) >= 0
            yield batch.loc[ok, ["a", "b"]]

    side = lambda x: facts.select(F.col("v").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    near = F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")
    sized = pairs.join(side("a").drop("bits_a"), "a").join(side("b").drop("bits_b"), "b").filter(near).select("a", "b")
    return materialised(sized).join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def verified(pairs: DataFrame, lists: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are linked, by intersecting their sorted n-grams."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok, kept = [], (None, None)
            for x, y in zip(batch["grams_a"], batch["grams_b"], strict=True):
                a = kept[1] if kept[0] == x else unpacked_block(x)
                kept, b = (x, a), unpacked_block(y)
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                common = int((large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small).sum()) if len(small) else 0
                ok.append(common > 0 and 100 * common >= percent * (len(a) + len(b) - common))
            yield batch.loc[ok, ["a", "b"]]

    side = lambda x: lists.select(F.col("v").alias(x), F.col("grams").alias(f"grams_{x}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(run, "a long, b long")


def links(texts: DataFrame, size: int, percent: int = PERCENT, width: int = WIDTH, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """(v, label of every text that is linked, the least v of its component; v, n of every text). ``texts``: v, text; ``size``: their characters."""
    if not 50 < percent <= 100:
        raise ValueError(f"percent is {percent}; bands of sizes ask for over 50, up to 100")
    spark = texts.sparkSession
    bits = min(max((size // CELL_CHARS).bit_length(), CELLS[0]), CELLS[1])
    levels = spark.sparkContext.broadcast(cell_levels(texts, bits, width))
    tokens = materialised(shared_tokens(texts, levels, 1 << max(7, (size // RANGE_CHARS).bit_length()), percent, width))
    shared = spark.sparkContext.broadcast(bitmap(tokens, "token"))
    rows = materialised(token_rows(texts, levels, shared, percent, width))
    facts = rows.filter("bits is not null").select("v", "n", "bits")
    members = rows.filter("bits is not null").select("v", F.explode(F.arrays_zip(F.col("tokens").alias("t"), F.col("places").alias("p"))).alias("x")).select(F.col("x.t").alias("token"), "v", F.col("x.p").alias("place"))
    same = members.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v")).alias("x"), F.bit_xor(F.xxhash64("v", F.lit(1))).alias("y"), F.min("v").alias("hub")).filter("n > 1")
    # of tokens with the same sets the first in order is enough
    groups = materialised(same.groupBy("n", "x", "y").agg(F.min("token").alias("token"), F.min("hub").alias("hub")).select("token", "n", "hub"))
    members = materialised(members.join(groups, "token"))
    asked = materialised(members.filter("v <> hub").select(F.col("hub").alias("a"), F.col("v").alias("b")).distinct())

    def check(pairs: DataFrame) -> DataFrame:
        wanted = spark.sparkContext.broadcast(bitmap(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v"))
        return materialised(verified(pairs, materialised(sorted_lists(texts, wanted, levels, width)), percent))

    labels = components(check(materialised(allowed(asked, facts, percent))))

    def further(least: int, nearest: bool) -> DataFrame:
        own = members.filter(F.col("n") > least).select("token", "v", "place")
        return materialised(tiles(own, facts, labels, percent, tile, nearest).join(asked, ["a", "b"], "left_anti"))

    pairs = further(LARGE, True)
    found = check(pairs)
    if not found.isEmpty():
        labels, asked = extended(labels, found), materialised(asked.unionByName(pairs))
    pairs = further(2, False)
    if not pairs.isEmpty():
        found = check(pairs)
        labels = labels if found.isEmpty() else extended(labels, found)
    return labels, rows.select("v", "n")


def texts_once(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """v, text: each text once. Texts that may repeat are shuffled, once, and written; the others are read where they are. ``ids``: v of every text."""
    several = materialised(ids.groupBy("v").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("v"))
    hashed = docs.filter(F.col("text").isNotNull()).select(F.xxhash64("text").alias("v"), "text")
    return likely(hashed, several, "v", inverse=True).unionByName(materialised(likely(hashed, several, "v").groupBy("v").agg(F.first("text").alias("text"))))


def joined_components(docs: DataFrame, percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the size of its set and the least id that links reach."""
    ids = materialised(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("v"), F.length("text").cast("long").alias("size"), F.col("text").isNull().alias("none")))
    size = ids.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()["size"]
    texts = texts_once(docs, ids.filter("not none").select("v"))
    labels, sizes = links(texts, size, percent, width)
    first = ids.filter("not none").groupBy("v").agg(F.min("doc_id").alias("first")).join(sizes, "v").join(labels, "v", "left").select("v", "n", F.coalesce("label", "v").alias("label"), "first")
    first = materialised(first)
    linked = first.filter("label <> v").select("label").distinct()
    least = materialised(first.join(linked, "label").groupBy("label").agg(F.min("first").alias("least")))
    named = materialised(first.join(least, "label", "left").select("v", "n", F.coalesce("least", "first").alias("component_id")))
    found = ids.filter("not none").join(named, "v").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return found.unionByName(ids.filter("none").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op13_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return joined_components(table(spark, sf_dir, "documents"))
