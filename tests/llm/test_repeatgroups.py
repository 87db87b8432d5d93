"""Repeat groups against brute force."""

import hashlib
import random
from collections import defaultdict

import pytest

from sparkloom.llm.repeatgroups import repeat_groups

LENGTH, GRAM = 12, 4


def places(raws, length):
    """Every string of ``length`` bytes with all its places."""
    out = defaultdict(set)
    for doc, raw in raws.items():
        for i in range(len(raw) - length + 1):
            out[raw[i : i + length]].add((doc, i))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    shared = ["".join(rng.choice("abcdé") for _ in range(n)) for n in (12, 14, 18, 30)]
    made = ["".join(rng.choice([*shared, "xyz", "q", "abab"]) for _ in range(rng.randrange(1, 7))) for _ in range(25)]
    return [*made, made[0], "", None, "short"]


def test_groups_are_whole_and_cover_all_repeats(spark, texts):
    raws = {i: (t or "").encode() for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = defaultdict(set)
    for r in repeat_groups(docs, LENGTH, GRAM).collect():
        groups[r["repeat"], r["n_bytes"]].add((r["doc_id"], r["start"]))
    covered, by_length = set(), {}
    for (name, n), at in groups.items():
        doc, i = min(at)
        string = raws[doc][i : i + n]
        assert n >= LENGTH and hashlib.sha256(string).hexdigest() == name
        assert at == by_length.setdefault(n, places(raws, n))[string] and len(at) > 1
        covered |= {(d, j) for d, s in at for j in range(s, s + n)}
    brute = [at for at in places(raws, LENGTH).values() if len(at) > 1]
    assert covered == {(d, j) for at in brute for d, s in at for j in range(s, s + LENGTH)}
    # strings of LENGTH bytes whose extensions to both sides differ are maximal repeats, and none of them is cut
    for string, at in places(raws, LENGTH).items():
        sides = [{raws[d][s - 1 : s] if s else (d, s) for d, s in at}, {raws[d][s + LENGTH : s + LENGTH + 1] or (d, s) for d, s in at}]
        if len(at) > 1 and all(len(x) > 1 for x in sides):
            assert groups[hashlib.sha256(string).hexdigest(), LENGTH] == at


def test_hot_grams_give_all_strings(spark, texts):
    raws = {i: (t or "").encode() for i, t in enumerate(texts)}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = defaultdict(set)
    for r in repeat_groups(docs, LENGTH, GRAM, hot=0).collect():
        assert r["n_bytes"] == LENGTH
        groups[r["repeat"]].add((r["doc_id"], r["start"]))
    want = [at for at in places(raws, LENGTH).values() if len(at) > 1]
    assert {frozenset(at) for at in want} <= {frozenset(at) for at in groups.values()}


def test_equal_rows_and_empty_table(spark):
    twice = spark.createDataFrame([(1, "abcdefghijklmnop"), (1, "abcdefghijklmnop")], "doc_id long, text string")
    assert len({r["row"] for r in repeat_groups(twice, LENGTH, GRAM).collect()}) == 2
    assert repeat_groups(spark.createDataFrame([], "doc_id long, text string"), LENGTH, GRAM).count() == 0
