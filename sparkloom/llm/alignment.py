"""Alignment of two tokenizers over the bytes of a text, and corpus-wide counts of the ids that meet.

A text is a space and its characters. It is cut before each space or line end that stands between two other
characters: neither tokenizer has a token across such a place, so a chunk is aligned once and remembered, and a
document's alignment is its chunks'. Token ends are prefix sums of token lengths; a link is a stretch between two
neighbouring ends of either side, and a group ends where both sides do.

1. Counts: a task packs a linked pair into one whole number (``a << ID_BITS | b``), takes each document's once, and sends
   what ``np.unique`` counts, some millions at a time.
2. The partial counts are range-partitioned and sorted by key. A partition sums runs of equal keys as they pass and
   writes them as two plain files of 64-bit numbers into the cluster's shared folder. Only files that a finished task
   has named are read, so a lost executor's half-written ones do no harm.
3. Lookup: workers map the files into memory (of a store that is no mounted folder, an unnamed copy of the ones they
   need) and find keys by ``np.searchsorted``, again once a chunk.

The largest count of each id of the first tokenizer is an array as long as its vocabulary.

Edge cases: null and empty texts, and texts whose tokens do not spell a space and the text (those with U+2581, which
the second tokenizer reads as a space), have no tokens; special tokens inside texts are plain text; repeated rows are
documents each; ties for the largest count are all best; an empty table gives no rows; other columns do not matter.
A long text is worked on a million characters at a time; a single word is held whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialised, shared_folder, table

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
ID_BITS = 20
#: Characters of a text, keys and remembered chunks (and their characters) that a task holds at a time; characters of new chunks that are encoded in one call.
SEGMENT, GATHERED, CHUNKS, CHUNK_CHARS, TOGETHER = 1 << 20, 4_000_000, 600_000, 1 << 24, 1 << 16
BOUNDARY = re.compile(r"(?<=\S)(?=[ \n]\S)")
OTHER_SPACE = re.compile(r"[^\S \n]")
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut where chunks begin."""
    at = 0
    while len(text) - at > size:
        found = BOUNDARY.search(text, at + size)
        stop = found.start() if found else len(text)
        yield text[at:stop]
        at = stop
    if at < len(text):
        yield text[at:]


def split_chunks(text: str) -> list[str]:
    """The chunks of a text that begins with a space or a line end. A chunk's first space is left out where the next character is neither."""
    inner = text[1:]
    if text[0] == " " and not OTHER_SPACE.search(inner) and len(inner.split()) == inner.count(" ") + inner.count("\n") + 1:
        return inner.replace("\n", " \n").split(" ")  # every space and line end stands between two other characters
    return [c[1:] if c[0] == " " and c[1:2] not in ("", " ", "\n") else c for c in BOUNDARY.split(text)]


def distinct(keys: np.ndarray) -> np.ndarray:
    """The distinct values in order. np.unique() of large integer arrays goes by a hash table, which is slow for packed keys."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


class Grown:
    """An array that rows are appended to, in room that doubles."""

    def __init__(self, *shape: int):
        self.room, self.n = np.zeros((1024, *shape), dtype=np.int64), 0

    def append(self, rows: np.ndarray) -> None:
        if self.n + len(rows) > len(self.room):
            room = np.zeros((2 * (self.n + len(rows)), *self.room.shape[1:]), dtype=np.int64)
            room[: self.n] = self.room[: self.n]
            self.room = room
        self.room[self.n : self.n + len(rows)] = rows
        self.n += len(rows)

    @property
    def rows(self) -> np.ndarray:
        return self.room[: self.n]


class Chunks:
    """Remembered alignments of chunks: sizes, links as packed keys, and groups as text."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.first, self.second = Tokenizer.from_file(first), SentencePieceProcessor(model_file=second)
        self.first.encode_special_tokens = True
        alphabet, vocabulary = self._alphabet(), self.first.get_vocab()
        unused = [b for b in range(256) if b not in alphabet.values()]  # bytes of no text
        alphabet |= dict(zip(sorted(t for t in vocabulary if len(t) == 1 and t not in alphabet), unused, strict=False))
        self.first_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.first_bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.second_bytes = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = tuple(np.array([len(x) for x in side], dtype=np.int64) for side in (self.first_bytes, self.second_bytes))
        self.quick = self._by_rank(first)
        # ids as text before another one of their side, and at the end of it
        self.marked = [np.array([[f"{i}{mark}" for i in range(len(side))] for mark in marks], dtype=object) for side, marks in ((self.first_bytes, ",|"), (self.second_bytes, ",;"))]
        self.spell = True
        self.space = self.second.piece_to_id("▁")
        self.forget()

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """How the byte-level alphabet spells bytes, learned from characters that have every byte a text can have."""
        from tokenizers import pre_tokenizers

        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        seen = [*range(0x800), 0x800, *range(0x1000, 0x10000, 0x1000), *range(0x10000, 0x110000, 0x10000)]
        return {letter: byte for c in map(chr, seen) if not "\ud800" <= c <= "\udfff" for letter, byte in zip(spell.pre_tokenize_str(c)[0][0], c.encode(), strict=True)}

    def _by_rank(self, path: str):
        """The first tokenizer's ids of plain text from the second library, whose merging is faster; None unless its ids are the order of its merges."""
        import public_tokenizers
        from tiktoken import Encoding

        model = json.loads(Path(path).read_text())["model"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if model["type"] != "BPE" or any(model["vocab"].get("".join(m)) != 256 + k for k, m in enumerate(pairs)):
            return None
        ranks = {spelled: i for i, spelled in enumerate(self.first_bytes[: 256 + len(pairs)])}
        return Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}) if len(ranks) == 256 + len(pairs) and all(bytes([b]) in ranks for b in range(256)) else None

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []
        self.facts = Grown(6)  # tokens of either side, groups, links, whether the tokens spell the chunk, place of the links in keys
        self.keys = Grown()
        self.looked_up = Grown(2)  # best links, sum of counts
        self.uses, self.chars = Grown(), 0

    def make_room(self) -> None:
        """Once there are CHUNKS of them, or as many characters as allowed, the half that was used most stays."""
        if len(self.known) <= CHUNKS and self.chars <= CHUNK_CHARS:
            return
        uses, names = self.uses.rows, list(self.known)
        stay = np.sort(np.argsort(-uses, kind="stable")[: CHUNKS // 2])
        stay = stay[uses[stay] > 1]
        stay = stay[np.cumsum([len(names[i]) for i in stay.tolist()]) <= CHUNK_CHARS // 2] if len(stay) else stay
        facts, keys, looked, groups = self.facts.rows[stay], self.links(stay)[0], self.looked_up.rows[stay[stay < self.looked_up.n]], self.groups
        self.forget()
        facts[:, 5] = np.cumsum(facts[:, 3]) - facts[:, 3]
        for to, rows in ((self.facts, facts), (self.keys, keys), (self.looked_up, looked), (self.uses, np.zeros(len(stay), dtype=np.int64))):
            to.append(rows)
        self.groups = [groups[i] for i in stay.tolist()] if groups else []
        self.known = {names[i]: k for k, i in enumerate(stay.tolist())}
        self.chars = sum(map(len, self.known))

    def codes(self, parts: list[str]) -> np.ndarray:
        """Numbers of the chunks; new ones are learned."""
        try:
            found = np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))
        except KeyError:
            self._learn([p for p in dict.fromkeys(parts) if p not in self.known])
            found = np.fromiter(map(self.known.__getitem__, parts), dtype=np.int64, count=len(parts))
        self.uses.rows[:] += np.bincount(found, minlength=self.uses.n)
        return found

    def _learn(self, names: list[str]) -> None:
        new = [c if c[0] in " \n" else f" {c}" for c in names]
        parts, at, chars = [], 0, 0
        for i, c in enumerate(new):
            chars += len(c)
            if chars >= TOGETHER or i == len(new) - 1:
                parts.append(self._together(new[at : i + 1]) or self._apart(new[at : i + 1]))
                at, chars = i + 1, 0
        ids = [np.concatenate([p[side] for p in parts]) for side in (0, 1)]
        tokens = [np.concatenate([p[2 + side] for p in parts]) for side in (0, 1)]
        right, size = (np.concatenate([p[k] for p in parts]) for k in (4, 5))
        ends = [np.cumsum(length[i]) for length, i in zip(self.sizes, ids, strict=True)]
        borders = distinct(np.concatenate(ends))
        place = [np.searchsorted(e, borders) for e in ends]
        keys = ids[0][place[0]] << ID_BITS | ids[1][place[1]]
        both = (ends[0][place[0]] == borders) & (ends[1][place[1]] == borders) if len(borders) else np.zeros(0, dtype=bool)
        stop = np.searchsorted(borders, np.cumsum(np.where(right, size, 0)), "right")
        links, closed = np.diff(stop, prepend=0), np.concatenate([[0], np.cumsum(both)])
        self.facts.append(np.stack([*tokens, np.diff(closed[stop], prepend=0), links, right, self.keys.n + stop - links], axis=1))
        self.keys.append(keys)
        self.uses.append(np.zeros(len(new), dtype=np.int64))
        if self.spell:
            self.groups.extend(self._spelled(ids, tokens, place[0][both] + 1, place[1][both] + 1))
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.chars += sum(map(len, names))

    def _together(self, new: list[str]) -> tuple | None:
        """(ids of either side, tokens of each chunk on either side, whether they spell the chunk, its bytes) from one call, if the chunks' borders are token ends of both sides and all bytes are right."""
        text = "".join(new)
        raw, size = text.encode(), np.array([len(c.encode()) for c in new])
        a = self.quick.encode_ordinary(text) if self.quick else self.first.encode_batch_fast([text], add_special_tokens=False)[0].ids
        b = self.second.encode(text[1:] if text[0] == " " else text)
        if text[0] != " ":
            b = b[1:] if b[:1] == [self.space] else []
        stops, tokens = np.cumsum(size), []
        for side, spelled, length in ((a, self.first_bytes, self.sizes[0]), (b, self.second_bytes, self.sizes[1])):
            ends = np.cumsum(length[np.array(side, dtype=np.int64)])
            at = np.searchsorted(ends, stops)
            if not len(ends) or ends[-1] != len(raw) or (ends[at] != stops).any() or b"".join([spelled[i] for i in side]) != raw:
                return None
            tokens.append(np.diff(at + 1, prepend=0))
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), *tokens, np.ones(len(new), dtype=bool), size

    def _apart(self, new: list[str]) -> tuple:
        """The same from a call for each chunk; those whose tokens do not spell them have none."""
        a = [e.ids for e in self.first.encode_batch_fast(new, add_special_tokens=False)]
        # the second tokenizer sets a space before its text; where the chunk has none of its own, that space is dropped
        b = [ids if c[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for c, ids in zip(new, self.second.encode([c[1:] if c[0] == " " else c for c in new], num_threads=1), strict=True)]
        raw = [c.encode() for c in new]
        right = [b"".join([self.first_bytes[i] for i in x]) == r == b"".join([self.second_bytes[i] for i in y]) for x, y, r in zip(a, b, raw, strict=True)]
        a, b = ([x if ok else [] for x, ok in zip(side, right, strict=True)] for side in (a, b))
        ids = [np.array([i for x in side for i in x], dtype=np.int64) for side in (a, b)]
        return *ids, *[np.array([len(x) for x in side]) for side in (a, b)], np.array(right, dtype=bool), np.array([len(r) for r in raw])

    def _spelled(self, ids: list[np.ndarray], tokens: list[np.ndarray], ends_a: np.ndarray, ends_b: np.ndarray) -> Iterator[str]:
        """The groups of each chunk: ids of the first side, ``|``, ids of the second; groups parted by ``;``. ``ends``: how many tokens each group ends after."""
        out = np.empty(len(ids[0]) + len(ids[1]), dtype=object)
        for side, ends, other, marks in ((0, ends_a, np.append(0, ends_b[:-1]), self.marked[0]), (1, ends_b, ends_a, self.marked[1])):
            group = np.searchsorted(ends, np.arange(len(ids[side])), "right")
            closing = np.zeros(len(ids[side]), dtype=np.int64)
            closing[ends - 1] = 1
            out[np.arange(len(ids[side])) + other[group]] = marks[closing, ids[side]]
        at, pieces = 0, out.tolist()
        for n in (tokens[0] + tokens[1]).tolist():
            yield "".join(pieces[at : at + n])[:-1]
            at += n

    def links(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Packed keys of all links of the chunks, in order, and how many each chunk has."""
        n, start = self.facts.rows[codes, 3], self.facts.rows[codes, 5]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.keys.rows[np.repeat(start, n) + within], n


def worker_chunks(first: str, second: str, use: str = "") -> Chunks:
    """The worker process's remembered chunks for one ``use``: they outlive the task."""
    holder = sys.modules.setdefault("_aligned_chunks", types.ModuleType("_aligned_chunks")).__dict__
    if ("use", first, second) not in holder or holder["use", first, second][0] != use:
        kept = holder.get(("use", first, second), (None, None))[1] or Chunks(first, second)
        kept.forget()
        kept.spell = bool(use)  # counting needs no groups
        holder["use", first, second] = (use, kept)
    return holder["use", first, second][1]


def coded(known: Chunks, texts: list[str | None]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, bool]]:
    """(places of the texts, chunks of each, numbers of the chunks, whether the last text goes on) for about SEGMENT characters at a time.

    A longer text comes alone, in several parts. Texts that surely have no tokens are left out. Numbers hold until the next step.
    """
    group, size = [], 0

    def numbered(going_on: bool = False) -> tuple[list[int], np.ndarray, np.ndarray, bool]:
        known.make_room()
        return [i for i, _ in group], np.array([len(p) for _, p in group]), known.codes([c for _, p in group for c in p]), going_on

    for i, text in enumerate(texts):
        if not text or "▁" in text:
            continue
        parts = segments(" " + text) if len(text) > SEGMENT else iter([" " + text])
        if group and size + len(text) > SEGMENT:
            yield numbered()
            group, size = [], 0
        part = next(parts)
        for following in parts:
            group = [(i, split_chunks(part))]
            yield numbered(True)
            group, part = [], following
        group.append((i, split_chunks(part)))
        size += len(text)
    if group:
        yield numbered()


def document_keys(known: Chunks, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Packed pairs, each once for every text that links it."""
    held, wrong = None, False  # of a text that goes on
    for _, sizes, codes, going_on in coded(known, texts):
        right = known.facts.rows[codes, 4] > 0
        if going_on or held is not None:
            wrong |= not right.all()
            held = np.union1d(np.zeros(0, dtype=np.int64) if held is None else held, known.links(distinct(codes[right]))[0])
            if not going_on:
                if not wrong:
                    yield held
                held, wrong = None, False
            continue
        owner = np.repeat(np.arange(len(sizes)), sizes)
        tokenless = np.bincount(owner[~right], minlength=len(sizes)) > 0
        own = distinct((owner << 40 | codes)[~tokenless[owner]])
        keys, n = known.links(own & ((1 << 40) - 1))
        yield distinct(np.repeat(own >> 40 << 2 * ID_BITS, n) | keys) & ((1 << 2 * ID_BITS) - 1)


def _open_shard(uri: str) -> np.ndarray:
    """A file of 64-bit numbers as a memory map."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype="<i8", mode="r")
    with tempfile.TemporaryFile() as own, store.open_input_stream(path) as source:  # has no name: it ends with its map
        while block := source.read(1 << 22):
            own.write(block)
        own.flush()
        return np.memmap(own, dtype="<i8", mode="r")


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Sorted partial counts (key, n) as shards: path, first, last, n of each; and (a, best), the largest count of each first id in the shard."""
    columns = "path string, first long, last long, n long, a long, best long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(f"{folder}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}")
        held = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
        first, last, size = None, None, 0
        store.create_dir(path.rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{path}.keys") as keys_file, store.open_output_stream(f"{path}.counts") as counts_file:
            for batch in chain(batches, [None]):
                keys, n = (np.concatenate([h, batch[c].to_numpy()]) if batch is not None else h for h, c in zip(held, ("key", "n"), strict=True))
                if not len(keys):
                    continue
                starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                keys, n = keys[starts], np.add.reduceat(n, starts)
                if batch is not None:  # the last run may go on
                    held, keys, n = (keys[-1:], n[-1:]), keys[:-1], n[:-1]
                if len(keys):
                    first, last, size = keys[0] if first is None else first, keys[-1], size + len(keys)
                    keys_file.write(keys.astype("<i8").tobytes())
                    counts_file.write(n.astype("<i8").tobytes())
                    ids = keys >> ID_BITS
                    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                    yield pd.DataFrame({"path": None, "first": 0, "last": 0, "n": 0, "a": ids[begin], "best": np.maximum.reduceat(n, begin)})
        if size:
            yield pd.DataFrame({"path": [f"{folder}/{path.rpartition('/')[2]}"], "first": [first], "last": [last], "n": [size], "a": [-1], "best": [0]})

    return rows.mapInPandas(run, columns)


@dataclass(frozen=True)
class PairCounts:
    """In how many documents each pair of ids is linked: shards (path, first key, last key, keys) in order, and the largest count of each first id."""

    shards: list[tuple[str, int, int, int]]
    best: np.ndarray

    def lookup(self, keys: np.ndarray, maps: dict) -> np.ndarray:
        """Counts of packed keys, 0 for a pair that no document links. ``maps`` keeps the open shards."""
        out = np.zeros(len(keys), dtype=np.int64)
        if not self.shards:
            return out
        shard = np.searchsorted(np.array([s[1] for s in self.shards]), keys, "right") - 1
        for k in np.unique(shard[shard >= 0]).tolist():
            path = self.shards[k][0]
            if path not in maps:
                maps[path] = (_open_shard(f"{path}.keys"), _open_shard(f"{path}.counts"))
            own, counts = maps[path]
            mine = np.flatnonzero(shard == k)
            at = np.minimum(np.searchsorted(own, keys[mine]), len(own) - 1)
            out[mine] = np.where(own[at] == keys[mine], counts[at], 0)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """a, b, n of all pairs."""

        def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for path in batch["path"]:
                    keys, counts = _open_shard(f"{path}.keys"), _open_shard(f"{path}.counts")
                    for i in range(0, len(keys), 100_000):
                        k = np.array(keys[i : i + 100_000])
                        yield pd.DataFrame({"a": k >> ID_BITS, "b": k & ((1 << ID_BITS) - 1), "n": np.array(counts[i : i + 100_000])})

        return spark.createDataFrame([(s[0],) for s in self.shards], "path string").repartition(max(1, len(self.shards))).mapInPandas(read, "a long, b long, n long")


def pair_counts(docs: DataFrame, first: str | None = None, second: str | None = None) -> PairCounts:
    """Counts over all texts of ``docs`` for tokenizer files ``first`` (byte-level) and ``second`` (pieces)."""
    spark = docs.sparkSession
    first, second = first or vocabulary_path(FIRST), second or vocabulary_path(SECOND)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = worker_chunks(first, second), [], 0
        for batch in batches:
            for keys in document_keys(known, batch.column("text").to_pylist()):
                held.append(keys)
                size += len(keys)
                if size >= GATHERED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)  # by sorting, as counts are asked for
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    partial = materialised(docs.select("text").mapInArrow(send, "key long, n long"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = partial.repartitionByRange(partitions, "key").sortWithinPartitions("key")
    written = materialised(write_shards(placed, f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"))
    shards = [(r["path"], r["first"], r["last"], r["n"]) for r in written.filter("path is not null").orderBy("first").collect()]  # one for each partition
    largest = written.filter("path is null").groupBy("a").agg(F.max("best").alias("best")).toPandas()  # at most the first vocabulary
    best = np.zeros(int(largest["a"].max()) + 1 if len(largest) else 0, dtype=np.int64)
    best[largest["a"].to_numpy()] = largest["best"].to_numpy()
    return PairCounts(shards, best)


def aligned(docs: DataFrame, counts: PairCounts, first: str | None = None, second: str | None = None, groups: bool = False) -> DataFrame:
    """DIGEST of every row of ``docs`` (doc_id, text); with ``groups`` also the groups themselves, as they are hashed."""
    first, second = first or vocabulary_path(FIRST), second or vocabulary_path(SECOND)
    use = uuid.uuid4().hex

    def look_up(known: Chunks, maps: dict) -> None:
        """The best links and the sum of counts of the chunks learned since."""
        if known.looked_up.n == known.facts.n:
            return
        keys, n = known.links(np.arange(known.looked_up.n, known.facts.n))
        keys, back = np.unique(keys, return_inverse=True)
        found = counts.lookup(keys, maps)
        best = np.append(counts.best, 0)[np.minimum(keys >> ID_BITS, len(counts.best))]
        sums = np.vstack([np.zeros((1, 2), dtype=np.int64), np.cumsum(np.stack([(found == best)[back], found[back]], axis=1), axis=0)])
        stop = np.cumsum(n)
        known.looked_up.append(sums[stop] - sums[stop - n])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, maps = worker_chunks(first, second, use), {}
        for batch in batches:
            rows = [(0, 0, 0, 0, 0, 0, "", "")] * batch.num_rows
            total, digest, spelled, right = np.zeros(6, dtype=np.int64), hashlib.sha256(), [], True
            for places, sizes, codes, going_on in coded(known, batch.column("text").to_pylist()):
                look_up(known, maps)
                starts = np.cumsum(sizes) - sizes
                sums = np.add.reduceat(np.hstack([known.facts.rows[codes, :4], known.looked_up.rows[codes]]), starts)
                fine = np.logical_and.reduceat(known.facts.rows[codes, 4] > 0, starts).tolist()
                names = [known.groups[c] for c in codes.tolist()]
                for k, (place, start, size) in enumerate(zip(places, starts.tolist(), sizes.tolist(), strict=True)):
                    text_of = ";".join(names[start : start + size])
                    right &= fine[k]
                    digest.update((";" if total.any() else "").encode() + text_of.encode())
                    spelled += [text_of] * groups
                    total += sums[k]
                    if going_on:
                        continue
                    if right:
                        rows[place] = (*total.tolist(), digest.hexdigest(), ";".join(spelled))
                    total, digest, spelled, right = np.zeros(6, dtype=np.int64), hashlib.sha256(), [], True
            names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array([r[k] for r in rows], pa.string() if k > 5 else pa.int64()) for k, c in enumerate(names)]], names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST + (", groups string" if groups else ""))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    return aligned(docs, pair_counts(docs))
