"""Sum-of-squares online packing of token sequences.

Documents come in the order of their partition. A document is its token ids and
an end id; whatever fills whole windows is cut off as pieces of full length, and
the rest goes to the fill level that leaves the least sum of squared counts of
partly filled windows. Counts by level are an array of ``window`` numbers, and
open windows hang off their level. At most ``MAX_OPEN`` windows are open, so
memory is bounded: a piece that would need one more is cut, and its head fills a
window of the level with most windows, which lowers the sum of squares most.
When the partition ends, the windows still open are joined into as few as
possible by cutting their pieces; what is padded is less than one window in all.

A sequence id is (partition, number in the partition); a lost executor's
partition is packed again in the same way from the same rows.

Edge cases: a null or empty text is its end id alone; repeated rows are packed
each by itself; an empty table gives no pieces; ids may be null.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import remembered, table

WINDOW = 4096
END_ID = 2
TOKENIZER = "word_bpe_49k.json"
CACHE = 700_000
MAX_OPEN = 512
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: These count as white space for str.split() but not for the tokenizer.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache:
    """Ids of whole texts from remembered ids of their parts.

    The tokenizer lowers letters, drops white space and splits letter runs,
    single digits and runs of other signs; none of these steps looks across a
    part. A text of Latin-1 and Latin Extended-A characters is split that way by
    one substitution, unless it has apostrophes; new letter runs then go through
    the tokenizer's model in one call, whose ids are cut after each id that ends
    a word. The words of any other text are given to the tokenizer as they are.
    Parts are remembered up to a bound.
    """

    def __init__(self, path: str, limit: int = CACHE):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        # The same model without the steps that leave lower-case letter runs as they are; it is given bytes as its alphabet spells them.
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        latin = [chr(i) for i in range(0x130)]
        self.spelling = {ord(c): "".join(p for p, _ in spell.pre_tokenize_str(c)) for c in latin if c >= "\x80" and c.isalpha()}
        digits = [c for c in latin if unicodedata.category(c)[0] == "N"]
        signs = [c for c in latin if not c.isalpha() and not c.isspace() and c not in digits and c != "'"]
        self.parts = re.compile("([" + re.escape("".join(signs)) + "]+|[" + "".join(digits) + "])")

    def _one(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        # the bare model has no normalizer: a run with a capital, as texts that are not lowered hold, is not for it
        runs = [w for w in words if w.isalpha() and max(w) < "\u0130" and w == w.lower()]
        if runs:
            ids = np.array(self.bare.encode_batch_fast([" ".join(runs).translate(self.spelling)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(runs) and cuts[-1] == len(ids):
                raw, cuts = ids.tobytes(), [0, *(cuts * 4).tolist()]
                self.known.update(zip(runs, [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))
        for w in words:
            if w not in self.known:
                self.known[w] = self._one(w)

    def encode(self, text: str) -> np.ndarray:
        if _ODD_SPACE.search(text) or "<|" in text:
            return np.frombuffer(self._one(text), dtype="<u4")
        if "'" not in text and (text.isascii() or max(text) < "\u0130"):
            text = self.parts.sub(r" \1 ", text.lower())
        words, known = text.split(), self.known
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4")
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            self._learn([w for w in dict.fromkeys(words) if w not in known])
            return np.frombuffer(b"".join([known[w] for w in words]), dtype="<u4")


def worker_cache(path: str) -> WordCache:
    """The worker process's cache of a tokenizer file: it outlives the task, until one that is lean."""
    caches = remembered("words")
    if path not in caches:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        caches[path] = WordCache(path)
    return caches[path]


class SumOfSquares:
    """Open windows by fill level; place() gives the window that an item of a size goes to.

    Putting an item of size s into a window of level h takes one from N(h) and
    adds one to N(h + s); the change of the sum of squares is
    2 (N(h + s) - N(h)) + 2, and 2 N(s) + 1 for a new window; a full window counts nothing.
    With ``limit`` windows open no further one is opened: an item that fits none
    is cut, so that its head fills a window of the level h with the largest N(h).
    """

    def __init__(self, window: int = WINDOW, limit: int = MAX_OPEN):
        self.window, self.limit, self.counts, self.open = window, limit, np.zeros(window + 1, dtype=np.int64), defaultdict(list)
        self.next = self.n_open = 0

    def place(self, size: int) -> tuple[int, int, int]:
        """(window's number, level it had, how much of the item goes there)."""
        w, n = self.window, self.counts
        top = w - size
        change = 2 * (n[size + 1 : w + 1] - n[1 : top + 1]) + 2
        if top >= 1:
            change[-1] = 1 - 2 * n[top]  # to the full level, which is not counted
        change = np.where(n[1 : top + 1] > 0, change, np.iinfo(np.int64).max)
        new = 2 * n[size] + 1 if size < w else 0
        if size < w and self.n_open >= self.limit:
            new = np.iinfo(np.int64).max - 1
        # among equal changes the fullest window wins
        best = len(change) - 1 - int(np.argmin(change[::-1])) if len(change) else -1
        if best >= 0 and change[best] <= new:
            level = best + 1
        elif size < w and self.n_open >= self.limit:
            level = int(np.argmax(n))
            size = w - level
        else:
            level = 0
        if level:
            number = self.open[level].pop()
            n[level] -= 1
            self.n_open -= 1
        else:
            number, self.next = self.next, self.next + 1
        if level + size < w:
            n[level + size] += 1
            self.n_open += 1
            self.open[level + size].append(number)
        return number, level, size


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())


def packed(items: Iterator[tuple[object, np.ndarray]], window: int = WINDOW, first: int = 0, limit: int = MAX_OPEN) -> Iterator[tuple]:
    """Rows as PIECES from (doc_id, ids with the end id); windows are numbered from ``first``."""
    bins, held = SumOfSquares(window, limit), {}
    for doc, ids in items:
        n, whole = len(ids), len(ids) // window * window
        for at in range(0, whole, window):
            yield doc, at, window, _crc(ids[at : at + window]), n, first + bins.next, 0
            bins.next += 1
        at = whole
        while at < n:
            number, level, size = bins.place(n - at)
            held.setdefault(number, []).append((doc, at, ids[at : at + size].copy(), n, level))
            at += size
            if level + size == window:
                for d, start, part, total, offset in held.pop(number):
                    yield d, start, len(part), _crc(part), total, first + number, offset
    # what is still open: the fullest windows stay, pieces of the emptiest are cut to fill them
    order = sorted(held, key=lambda b: (-sum(len(p[2]) for p in held[b]), b))
    total = sum(len(p[2]) for b in order for p in held[b])
    stay, rest = order[: -(-total // window)], order[-(-total // window) :]
    spare = [p for b in rest for p in held[b]]
    for b in stay:
        level = 0
        for d, start, part, n, _ in held[b]:
            yield d, start, len(part), _crc(part), n, first + b, level
            level += len(part)
        while level < window and spare:
            d, start, part, n, _ = spare.pop()
            head, tail = part[: window - level], part[window - level :]
            yield d, start, len(head), _crc(head), n, first + b, level
            level += len(head)
            if len(tail):
                spare.append((d, start + len(head), tail, n, 0))


def pack_documents(docs: DataFrame, path: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents. One pass over the input's partitions, without a shuffle."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_cache(path)

        def items() -> Iterator[tuple[object, np.ndarray]]:
            for batch in batches:
                for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                    yield doc, np.append(cache.encode(text) if isinstance(text, str) else np.zeros(0, dtype="<u4"), np.uint32(end_id)).astype("<u4", copy=False)

        names, rows = [c.split()[0] for c in PIECES.split(", ")], []
        for row in packed(items(), window, TaskContext.get().partitionId() << 40):
            rows.append(row)
            if len(rows) == 10_000:
                yield _frame(rows, names)
                rows = []
        yield _frame(rows, names)

    return docs.select("doc_id", "text").mapInPandas(run, PIECES)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    frame["doc_id"] = pd.array([None if pd.isna(x) else int(x) for x in frame["doc_id"]], dtype="Int64")
    return frame


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
