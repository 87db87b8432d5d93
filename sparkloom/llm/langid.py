"""Language identification of words, spans and documents.

Character trigrams and whole words, hashed into tables of fixed size, are
counted per language over a bounded sample of labelled documents. Scripts narrow
the candidates of a word to the languages that were seen to use its script, and
a Viterbi pass with a penalty per switch labels the words, so mixed texts fall
into spans. A document takes the language with most letters; the score is that
share.

The Viterbi pass works on blocks of words at once: a max-plus matrix per block,
a scan over the blocks of each document, then the labels inside the blocks.

Edge cases: a null text, or one without a letter, is ``und`` with score 0; rows
without a language are not learned from; if nothing can be learned every row is
``und``; repeated rows are labelled alike; a kept column named like one that
``predict`` adds (lang_pred, score, spans) gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table
from .textkit import _WORD, CHUNK, chunks, mix64, prefix_hashes, powers

TRIGRAM_BITS, WORD_BITS = 16, 17
PER_LANGUAGE = 2000
SWITCH = 8.0
BLOCK = 32
UNKNOWN = "und"
# First code points of Unicode's blocks, by the script of their letters; "common" holds no letters.
SCRIPT_STARTS = (
    (0, "common"), (0x41, "latin"), (0x5B, "common"), (0x61, "latin"), (0x7B, "common"), (0xAA, "latin"), (0xAB, "common"), (0xB5, "latin"), (0xB6, "common"), (0xBA, "latin"), (0xBB, "common"),
    (0xC0, "latin"), (0xD7, "common"), (0xD8, "latin"), (0xF7, "common"), (0xF8, "latin"), (0x2B0, "common"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
    (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xF00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"),
    (0x1800, "other"), (0x1C80, "cyrillic"), (0x1C90, "georgian"), (0x1CC0, "indic"), (0x1D00, "latin"), (0x1DC0, "common"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "common"), (0x2C60, "latin"),
    (0x2C80, "other"), (0x2D00, "georgian"), (0x2D30, "other"), (0x2DE0, "cyrillic"), (0x2E00, "common"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "common"), (0x31F0, "kana"),
    (0x3200, "common"), (0x3400, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "indic"), (0xA960, "hangul"), (0xA980, "other"), (0xAB30, "latin"),
    (0xAB70, "other"), (0xAC00, "hangul"), (0xE000, "common"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, "common"), (0xFE70, "arabic"),
    (0xFEFF, "common"), (0xFF21, "latin"), (0xFF3B, "common"), (0xFF41, "latin"), (0xFF5B, "common"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "common"), (0x10000, "other"), (0x1F000, "common"),
    (0x20000, "han"), (0x40000, "common"),
)
SCRIPTS = ("common", *dict.fromkeys(name for _, name in SCRIPT_STARTS if name != "common"))
_STARTS, _NAMES = np.array([start for start, _ in SCRIPT_STARTS]), np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS], dtype=np.int8)
_ASCII = _NAMES[np.searchsorted(_STARTS, np.arange(128), side="right") - 1]


def scripts_of(data: np.ndarray) -> np.ndarray:
    """The script of each character of UTF-8 bytes, at its first byte; 0 (common) at all other places."""
    script = np.zeros(len(data), dtype=np.int8)
    plain = data < 128
    script[plain] = _ASCII[data[plain]]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        point = first & (0x7F >> size)
        for k in range(1, 4):
            more = data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) & 0x3F
            point = np.where(size > k, point << 6 | more, point)
        script[lead] = _NAMES[np.searchsorted(_STARTS, point, side="right") - 1]
    return script


def features(texts: list[str]) -> tuple[np.ndarray, ...]:
    """Trigram bucket by byte, word starts and stops, word bucket, word script, letters by word, offsets by text."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join([*raw, b""]), dtype=np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[:-1] = _WORD[data]
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1) + 1
    shape = np.where(inside[:-1] == 1, data, 32).astype(np.uint32)
    after = np.append(shape[1:], 32).astype(np.uint32)
    before = np.append(32, shape[:-1]).astype(np.uint32)
    tri = ((before * np.uint32(0x9E3779B1)) ^ (shape * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F) >> np.uint32(32 - TRIGRAM_BITS)
    h, (_, down) = prefix_hashes(data), powers(len(data) + 1)
    word = (mix64((h[stops] - h[starts]) * down[starts]) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    if len(starts):
        own = scripts_of(data)
        script = np.maximum.reduceat(own, starts)
        prefix = np.concatenate([[0], np.cumsum(own > 0)])
        letters = prefix[stops] - prefix[starts]
    else:
        script, letters = np.zeros(0, dtype=np.int8), np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(r) + 1 for r in raw])
    offsets = np.concatenate([[0], np.searchsorted(starts, ends, side="right")]).astype(np.int64)
    return tri, starts, stops, word, script, letters, offsets


class Model:
    """Log scores by language, centred so that a feature that tells nothing counts 0."""

    def __init__(self, languages: list[str], trigrams: np.ndarray, words: np.ndarray, scripts: np.ndarray):
        self.languages = languages
        self.trigrams, self.words = self._scores(trigrams), self._scores(words)
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.scripts = np.where(share >= 0.001, 0.0, -50.0).T.astype(np.float32)
        self.scripts[(self.scripts < 0).all(axis=1)] = 0.0  # a script that no language was seen to use narrows nothing

    @staticmethod
    def _scores(counts: np.ndarray) -> np.ndarray:
        p = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * counts.shape[1])
        score = np.log(p)
        return np.ascontiguousarray((score - score.mean(axis=0)).T.astype(np.float32))

    def label(self, texts: list[str], switch: float = SWITCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Label and letters of each word, offsets by text."""
        tri, starts, stops, word, script, letters, offsets = features(texts)
        scores = np.empty((len(starts), len(self.languages)))
        for k in range(len(self.languages)):
            total = np.concatenate([[0.0], np.cumsum(self.trigrams[:, k][tri], dtype=np.float64)])
            scores[:, k] = total[stops] - total[starts] + self.words[:, k][word] + self.scripts[:, k][script]
        scores[letters == 0] = 0
        return viterbi(scores, offsets, switch), letters, offsets


def viterbi(scores: np.ndarray, offsets: np.ndarray, switch: float, block: int = BLOCK) -> np.ndarray:
    """The labels of each text's words with the largest sum of scores less ``switch`` for each change."""
    n, kinds = scores.shape
    if not n:
        return np.zeros(0, dtype=np.int16)
    counts = np.diff(offsets)
    blocks = -(-counts // block)
    first = np.concatenate([[0], np.cumsum(blocks)])
    place = np.arange(n) + np.repeat(first[:-1] * block - offsets[:-1], counts)
    padded = np.zeros((first[-1] * block, kinds))
    padded[place] = scores
    padded = padded.reshape(-1, block, kinds)
    step = np.full((len(padded), kinds, kinds), -np.inf)
    step[:, np.arange(kinds), np.arange(kinds)] = 0
    for t in range(block):
        step = padded[:, t, None, :] + np.maximum(step, step.max(axis=2, keepdims=True) - switch)
    order = np.argsort(-blocks, kind="stable")
    value, came = np.zeros((len(counts), kinds)), np.zeros((len(padded), kinds), dtype=np.int16)
    live = np.searchsorted(-blocks[order], -np.arange(blocks.max()), side="left")
    for k, m in enumerate(live):
        docs = order[:m]
        at = first[docs] + k
        through = value[docs][:, :, None] + step[at]
        came[at], value[docs] = through.argmax(axis=1), through.max(axis=1)
    state, leave, enter = value.argmax(axis=1), np.zeros(len(padded), dtype=np.int64), np.zeros(len(padded), dtype=np.int64)
    for k in range(len(live) - 1, -1, -1):
        docs = order[: live[k]]
        at = first[docs] + k
        leave[at] = state[docs]
        enter[at] = state[docs] = came[at, state[docs]]
    run = np.full((len(padded), kinds), -np.inf)
    run[np.arange(len(padded)), enter] = 0
    source = np.empty((block, len(padded), kinds), dtype=np.int16)
    for t in range(block):
        best = run.argmax(axis=1)[:, None]
        jump = np.take_along_axis(run, best, axis=1) - switch
        source[t] = np.where(run >= jump, np.arange(kinds), best)
        run = padded[:, t] + np.maximum(run, jump)
    labels = np.empty((len(padded), block), dtype=np.int16)
    for t in range(block - 1, -1, -1):
        labels[:, t] = leave
        leave = source[t, np.arange(len(padded)), leave]
    return labels.ravel()[place]


def spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """Maximal runs of one label: (first word, past the last word, label)."""
    if not len(labels):
        return []
    cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
    return [(a, b, int(labels[a])) for a, b in zip(cuts, cuts[1:], strict=False)]


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows that may be learned from: those whose crc32 of the id is no multiple of 5, with a language."""
    return docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """Counts over about ``per_language`` rows of each language, chosen by a hash of the id (of the text, without one).

    What comes to the driver is one table of counts per language, of fixed size.
    """
    sizes = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    share = F.create_map(*[x for lang in languages for x in (F.lit(lang), F.lit(min(1.0, per_language / sizes[lang])))])
    chosen = train.filter(F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit(8)), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000).select("lang", "text")
    shapes = (("t", 1 << TRIGRAM_BITS), ("w", 1 << WORD_BITS), ("s", len(SCRIPTS)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[str, str], np.ndarray] = {}
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                for _, group in chunks(rows["text"]):
                    tri, starts, stops, word, script, letters, _ = features(group)
                    covered = np.zeros(len(tri) + 1, dtype=np.int8)
                    covered[starts] += 1
                    covered[stops] -= 1
                    for (kind, size), bucket in zip(shapes, (tri[np.cumsum(covered[:-1]) > 0], word[letters > 0], script[letters > 0]), strict=True):
                        held[lang, kind] = held.get((lang, kind), 0) + np.bincount(bucket, minlength=size)
        for (lang, kind), counts in held.items():
            some = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "kind": kind, "bucket": some, "n": counts[some]})

    sums = chosen.mapInPandas(lean(count), "lang string, kind string, bucket int, n long").groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n")).toPandas()
    tables = {kind: np.zeros((len(languages), size)) for kind, size in shapes}
    at = {lang: i for i, lang in enumerate(languages)}
    for kind, part in sums.groupby("kind"):
        tables[kind][part["lang"].map(at).to_numpy(), part["bucket"].to_numpy()] = part["n"].to_numpy()
    return Model(languages, tables["t"], tables["w"], tables["s"])


PREDICTED = "lang_pred string, score double, spans array<struct<first:int,stop:int,lang:string>>"


def predict(docs: DataFrame, model: Model | None, keep: list[str], switch: float = SWITCH) -> DataFrame:
    """The columns ``keep`` of every row with lang_pred, score and spans (in words)."""
    keep = [c for c in keep if c.lower() not in {p.split()[0] for p in PREDICTED.split(", ")}]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<first:int,stop:int,lang:string>>)").alias("spans"))
    broadcast = docs.sparkSession.sparkContext.broadcast(model)
    read = [*keep, *([] if "text" in keep else ["text"])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = broadcast.value
        for batch in batches:
            best, score, found = [], [], []
            for _, group in chunks(batch["text"], max(20_000, CHUNK * 64 // max(64, len(model.languages) ** 2))):  # a block's matrix has languages squared numbers
                labels, letters, offsets = model.label(group, switch)
                for i, text in enumerate(group):
                    part, weight = labels[offsets[i] : offsets[i + 1]], letters[offsets[i] : offsets[i + 1]]
                    mass = np.bincount(part, weights=weight, minlength=len(model.languages))
                    if mass.sum() == 0 and len(part) and any(map(str.isalpha, text)):  # letters of no known block
                        mass = np.bincount(part, minlength=len(model.languages)).astype(float)
                    if mass.sum() == 0 or not any(map(str.isalpha, text)):
                        best.append(UNKNOWN), score.append(0.0), found.append([])
                        continue
                    k = int(mass.argmax())
                    best.append(model.languages[k]), score.append(float(mass[k] / mass.sum()))
                    found.append([{"first": a, "stop": b, "lang": model.languages[x]} for a, b, x in spans(part)])
            yield batch[keep].assign(lang_pred=best, score=score, spans=found)

    return docs.select(*[F.col(f"`{c}`") for c in read]).mapInPandas(lean(run), ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", " + PREDICTED)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(training_rows(docs))
    return predict(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
