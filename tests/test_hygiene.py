"""Failure categories, assertions and the sign test on cases of every kind."""

from math import comb

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import stats
from sparkloom.operators.hygiene import failure_category, parsed_tests

_FAILED = (
    # id, name, code, error kind, defined, buggy, copied, first failed assert's error kind and message, factual, category
    (1, "f", " ", None, [], None, None, None, None, False, "formatting"), (2, "f", "def f(", "SyntaxError", [], None, None, None, None, False, "formatting"),
    (3, "f", "x", "Timeout", [], None, None, None, None, False, "coding"), (4, "f", "x", "NameError", [], None, None, None, None, False, "hallucination"),
    (5, "f", "x", "ValueError", [], None, None, None, None, False, "coding"), (6, "f", "def g(): 1", None, ["g"], None, None, None, None, False, "instruction_following"),
    (7, "f", "x = 1", None, [], None, None, None, None, False, "formatting"), (8, "f", "def f(): 1 ", None, ["f"], "def f(): 1", None, None, None, False, "instruction_following"),
    (9, "f", "def f(): 2", None, ["f"], None, "g", None, None, False, "instruction_following"), (10, "f", "def f(): 2", None, ["f"], None, "f", "TypeError", "f() missing 1 required argument", False, "instruction_following"),
    (11, "f", "def f(): 2", None, ["f"], None, None, "AttributeError", "no x", False, "hallucination"), (12, "f", "def f(): 2", None, ["f"], None, None, "KeyError", "k", False, "coding"),
    (13, "f", "def f(): 2", None, ["f"], None, None, None, None, True, "factual"), (14, "f", "def f(): 2", None, ["f"], None, None, None, None, False, "reasoning"),
)


def test_failed_answers_of_every_kind(spark):
    schema = "id int, name string, code string, kind string, defined array<string>, buggy string, copied string, fail_kind string, fail_msg string, factual boolean"
    rows = spark.createDataFrame([r[:-1] for r in _FAILED], schema)
    error = F.when(F.col("kind").isNotNull(), F.struct("kind", F.lit("").alias("msg")))
    failed = F.when(F.col("fail_kind").isNotNull(), F.struct(F.col("fail_kind").alias("kind"), F.col("fail_msg").alias("msg")))
    rows = rows.withColumns({"error": error, "asserts": F.array(F.struct(F.lit(False).alias("ok"), failed.alias("error")))})
    found = rows.select("id", failure_category(*[F.col(c) for c in ("name", "code", "error", "defined", "buggy", "asserts", "copied", "factual")]).alias("category"))
    assert {r["id"]: r["category"] for r in found.collect()} == {r[0]: r[-1] for r in _FAILED}


def test_assertions_are_read_line_by_line(spark):
    tests = "assert f(1) == 2\nassert f(2) is None\nassert abs(f(3) - 0.5) < 1e-9\nassert not f(4)\nassert f(5)\nassert (\nprint(1)"
    found = spark.createDataFrame([(1, tests)], "id int, tests string").select(F.inline(parsed_tests(F.col("tests")))).select("call", "expected", "kind").collect()
    assert [tuple(r) for r in found] == [("f(1)", "2", "eq"), ("f(2)", "None", "is"), ("f(3)", "0.5", "approx"), ("f(4)", "False", "truth"), ("f(5)", "True", "truth")]


def test_sign_test_of_all_small_counts(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(15) for b in range(15)], "gained long, lost long")
    for r in pairs.select("gained", "lost", stats.sign_test(F.col("gained"), F.col("lost")).alias("p")).collect():
        n = r["gained"] + r["lost"]
        assert r["p"] == pytest.approx(min(1.0, 2 * sum(comb(n, i) for i in range(min(r["gained"], r["lost"]) + 1)) / 2**n) if n else 1.0, abs=1e-6)
