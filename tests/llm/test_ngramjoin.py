"""N-gram Jaccard join against all pairs."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import ngramjoin
from sparkloom.llm.common import bounded_batches
from sparkloom.llm.ngramjoin import joined_components, links, op13_ngramjoin

DATA = "/root/testdata/sf0.001"


def grams(text, width=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def all_pairs(docs, percent=80):
    """(doc_id, n_shingles, component_id) of the rows, by comparing all of them."""
    sets = [grams(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    n_links = 0
    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                n_links += 1
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(docs):
        known = [x for x in (least.get(root(i)), doc) if x is not None]
        least[root(i)] = min(known) if known else None
    return sorted(((d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True))), key=str), n_links


def made(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def found(frame):
    return sorted(map(tuple, joined_components(frame).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def edited(rng, words, share):
    out = list(words)
    for i in rng.choice(len(out), max(1, int(len(out) * share)), replace=False):
        out[i] = f"w{rng.integers(10**9)}"
    return out


def test_near_copies_templates_and_edge_cases(spark, monkeypatch):
    bounded_batches(spark)
    monkeypatch.setattr(ngramjoin, "TILE", 7)
    monkeypatch.setattr(links, "__defaults__", (80, 5, 7))
    monkeypatch.setattr(ngramjoin, "PAIRS", 50)
    monkeypatch.setattr(ngramjoin, "LARGE", 6)
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(40)}"
    docs = [(None, None), (1, None), (2, ""), (3, ""), (4, " \n\t "), (5, "one two"), (6, "ONE  Two"), (7, "one two three"), (8, "a b c d e"), (9, "A B\nC d\te"), (10, "Ä b c d e"), (11, "ä b c d e"), (None, "a b c d e f g"), (12, "a b c d e f g")]
    passage = [f"p{i}" for i in range(40)]
    at = 100
    for base in range(6):  # families of copies with edits of all strengths, around powers of two in size
        words = [word() for _ in range(int(rng.integers(20, 140)))]
        for _ in range(14):
            own = edited(rng, words, rng.random() * 0.025) + (passage if rng.random() < 0.15 else []) + [word() for _ in range(int(rng.integers(0, 5)))]
            docs.append((at, " ".join(own)))
            at += 1
    template = [f"t{i}" for i in range(150)]
    for _ in range(25):  # pairs of near texts among texts of one template that are not near one another
        own = edited(rng, template, 0.035)
        docs += [(at, " ".join(own)), (at + 1, " ".join([*own[:-3], "x", "y", str(at)]))]
        at += 2
    docs += docs[20:24]
    want, n = all_pairs(docs)
    assert n > 100 and len({c for *_, c in want}) > 20
    assert found(made(spark, docs).withColumns({"v": F.lit("clash"), "n": F.lit(1), "label": F.lit(None), "token": F.lit(0)})) == want


def test_query_on_all_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op13_ngramjoin(spark, DATA).select("doc_id", "n_shingles", "component_id").collect()), key=str) == all_pairs(docs)[0]


def test_pairs_among_one_template_are_all_linked(spark):
    rng = np.random.default_rng(8)
    template, docs = [f"t{i}" for i in range(300)], []
    for i in range(500):
        own = edited(rng, template, 0.04)
        docs += [(2 * i, " ".join(own)), (2 * i + 1, " ".join([*own[:-6], *[f"e{i}{j}" for j in range(6)]]))]
    rows = joined_components(made(spark, docs)).collect()
    assert all(r["component_id"] <= r["doc_id"] - r["doc_id"] % 2 for r in rows)


def test_empty_table_and_bounds(spark):
    assert joined_components(made(spark, [])).collect() == []
    assert found(made(spark, [(1, None), (2, "")])) == [(1, 0, 1), (2, 0, 2)]
    with pytest.raises(ValueError, match="percent"):
        links(made(spark, []), 0, percent=40)


def test_few_words_in_other_orders_differ(spark):
    docs = [(i, " ".join("xy"[i >> k & 1] for k in range(9))) for i in range(512)]
    assert [n for _, n, _ in found(made(spark, docs))] == [n for _, n, _ in sorted(((i, len(grams(t)), 0) for i, t in docs), key=str)]


def test_a_long_text(spark):
    rng = np.random.default_rng(2)
    words = [f"w{rng.integers(5000)}" for _ in range(30_000)]
    docs = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 0.01))), (3, " ".join(words[:15_000])), (4, " ".join(words[:26_000]))]
    assert found(made(spark, docs)) == all_pairs(docs)[0]


def test_bounds_never_drop_a_near_pair():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 63, 64, 65, 500, 9000):
        a = np.unique(rng.integers(0, 1 << 56, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * 0.9))], rng.integers(0, 1 << 56, max(0, len(a) // 11)).astype(np.uint64)]))
        common, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * common < 80 * union:
            continue
        size = np.array([len(a)]), np.array([len(b)])
        assert common >= ngramjoin.least_common(*size, 80)[0]
        short = min(len(ngramjoin.hashed_bitmap(x)) for x in (a, b))
        assert ngramjoin.spare(*(ngramjoin.folded([ngramjoin.hashed_bitmap(x)], 8 * short) for x in (a, b)), *size, 80)[0] >= 0
        assert set(a[: ngramjoin.n_tokens(size[0], 80)[0]]) & set(b[: ngramjoin.n_tokens(size[1], 80)[0]])
