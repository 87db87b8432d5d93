"""Tokenizer alignment against a plain version that encodes whole texts."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import alignment
from sparkloom.llm.alignment import aligned, op12_alignment, pair_counts, segments, vocabulary_path
from sparkloom.llm.common import bounded_batches


@pytest.fixture(scope="module")
def tokenizers():
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    return first, SentencePieceProcessor(model_file=vocabulary_path("piece_bpe_32k.model"))


def byte_alphabet():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def plain_alignment(tokenizers, text):
    """(a, b, groups, links) of a text by encoding it whole, or None."""
    if not text:
        return None
    first, second = tokenizers
    alphabet, whole = byte_alphabet(), (" " + text).encode()
    one = first.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(alphabet[c] for c in t)) for i, t in zip(one.ids, one.tokens, strict=True)]
    b = [(i, bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode()) for i in second.encode(text) for p in [second.id_to_piece(i)]]
    if b"".join(x for _, x in a) != whole or b"".join(x for _, x in b) != whole:
        return None
    spans = []
    for side in (a, b):
        ends = np.cumsum([len(x) for _, x in side]).tolist()
        spans.append([(i, e - len(x), e) for (i, x), e in zip(side, ends, strict=True)])
    links = []
    j = 0
    for i, s, e in spans[0]:
        while j < len(spans[1]) and spans[1][j][2] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][1] < e:
            links.append((i, spans[1][k][0]))
            k += 1
    common = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
    groups, at = [], [0, 0]
    for stop in common:
        parts = []
        for k, side in enumerate(spans):
            first = at[k]
            while at[k] < len(side) and side[at[k]][2] <= stop:
                at[k] += 1
            parts.append(",".join(str(i) for i, *_ in side[first : at[k]]))
        groups.append("|".join(parts))
    return len(a), len(b), groups, links


def expected(tokenizers, docs):
    found = [(i, plain_alignment(tokenizers, t)) for i, t in docs]
    counts = Counter(p for _, x in found if x for p in set(x[3]))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    out = []
    for i, x in found:
        if x is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((i, x[0], x[1], len(x[2]), len(x[3]), sum(counts[p] == best[p[0]] for p in x[3]), sum(counts[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()))
    return sorted(out, key=str)


def made(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


ODD = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a\nb", "a\n\nb", "a \nb", "a\n b", "a \n b", "\na", "a\n", "▁x", "one ▁ two", "<|endoftext|> and <s>", "it's 'tis don't", "tab\there", " nbsp  x", "日本語 テキスト\n漢字", "🙂🙂 emoji 👩‍👩‍👧", "x" * 300, "12345 67,890.12", "\x1c odd \x1f space", "é combining", "�\x00 nul", "\r\nwindows\r\nlines\r\n", "<0x0A> literal", "ÄÖÜ\nß ÿ\nİ"]


def test_texts_of_odd_spaces_and_scripts(spark, tokenizers):
    rng = np.random.default_rng(5)
    letters = list("ab cd ' \n\n  é漢▁ß1.,\t \x1c🙂-<|>")
    docs = [(i, t) for i, t in enumerate(ODD)] + [(1000 + i, "".join(rng.choice(letters, int(rng.integers(1, 40))))) for i in range(700)]
    docs += [(None, "null id"), (2**60 + 1, "large id"), (7, "repeated id")] + docs[:40]
    frame = made(spark, docs).withColumns({"n_a": F.lit("clash"), "a": F.lit(1), "key": F.lit("x")})
    found = aligned(frame, pair_counts(frame))
    assert sorted(map(tuple, found.collect()), key=str) == expected(tokenizers, docs)


def test_query_equals_whole_texts(spark, tokenizers):
    bounded_batches(spark)
    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op12_alignment(spark, folder).collect()), key=str) == expected(tokenizers, docs)


def test_long_texts_by_segment_and_forgotten_chunks(spark, tokenizers, monkeypatch):
    rng = np.random.default_rng(1)
    text = " ".join("".join(rng.choice(list("abcdefgh\n"), int(rng.integers(1, 9)))) for _ in range(4000))
    parts = list(segments(" " + text, 500))
    assert "".join(parts) == " " + text and max(map(len, parts)) < 600 and len(list(segments("x" * 5000, 500))) == 1
    for name, value in (("SEGMENT", 500), ("GATHERED", 300), ("CHUNKS", 50)):
        monkeypatch.setattr(alignment, name, value)
    monkeypatch.setattr(segments, "__defaults__", (500,))
    docs = [(1, text), (2, text[:100]), (3, None)]
    frame = made(spark, docs)
    assert sorted(map(tuple, aligned(frame, pair_counts(frame)).collect()), key=str) == expected(tokenizers, docs)


def test_counts_table_groups_and_empty_table(spark, tokenizers):
    frame = made(spark, [(1, "hello there world"), (2, "hello"), (3, "hello hello")])
    counts = pair_counts(frame)
    table = {(r["a"], r["b"]): r["n"] for r in counts.table(spark).collect()}
    assert table == Counter(p for t in ("hello there world", "hello", "hello hello") for p in set(plain_alignment(tokenizers, t)[3]))
    assert [s[1] for s in counts.shards] == sorted(s[1] for s in counts.shards)
    spelled = {r["doc_id"]: r["groups"] for r in aligned(frame, counts, groups=True).collect()}
    assert spelled[1] == ";".join(plain_alignment(tokenizers, "hello there world")[2])
    assert counts.lookup(np.array([0, 5, 2**45]), {}).tolist() == [0, 0, 0]
    empty = made(spark, [])
    assert aligned(empty, pair_counts(empty)).collect() == [] and pair_counts(empty).shards == []
    alone = made(spark, [(1, None), (2, "")])
    assert [tuple(r)[1:] for r in aligned(alone, pair_counts(alone)).collect()] == [(0, 0, 0, 0, 0, 0, "")] * 2
