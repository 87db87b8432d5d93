"""Line numbers over splits, two-phase corpora, folds with state, resamples, classes of keys and rules over JSON."""

import json
import subprocess
import sys
import textwrap
from pathlib import Path

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.operators.bootstrap import RESAMPLES, interval, resample_sums, weights
from sparkloom.operators.closure import excluded, key_classes
from sparkloom.operators.folds import ordered_fold
from sparkloom.operators.ordered import running_before
from sparkloom.operators.rounds import accepted_rounds, open_blocks, packed_blocks
from sparkloom.operators.validation import Rule, last_entries, merged_maps, validated
from sparkloom.sinks.corpus import CorpusWriter, committed, read_corpus, replayed, sweep, with_split
from sparkloom.sources.files import read_code, read_examples
from sparkloom.sources.lines import numbered_lines


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "20000", "spark.sql.files.openCostInBytes": "0"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_lines_of_files_in_many_splits(spark, tmp_path, small_splits):
    rng, want = np.random.default_rng(0), set()
    for name, end, n in (("a.jsonl", "\n", 5000), ("b.jsonl", "\r\n", 3000), ("empty.jsonl", "\n", 0), ("one.jsonl", "", 1)):
        rows = ["é" * int(rng.integers(0, 60)) + str(i) for i in range(n)]
        (tmp_path / name).write_bytes(end.join(rows).encode())
        want |= {(name, i + 1, row) for i, row in enumerate(rows)}
    lines = numbered_lines(spark, str(tmp_path))
    assert lines.rdd.getNumPartitions() > 10
    assert {(r["path"].rsplit("/", 1)[-1], r["line"], r["content"]) for r in lines.collect()} == want


def test_an_error_deep_in_a_file_names_its_line(spark, tmp_path, small_splits):
    rows = [json.dumps({"prompt": f"p{i}", "response": "r" * 50}) for i in range(4000)]
    rows[3210] = '{"prompt": "no response"}'
    (tmp_path / "long.jsonl").write_text("\n".join(rows))
    with pytest.raises(PySparkException, match=r"long.jsonl:3211"):
        read_examples(spark, str(tmp_path)).collect()


def test_files_cut_otherwise_since_they_were_counted_are_an_error(spark, tmp_path, small_splits):
    (tmp_path / "x.jsonl").write_text("\n".join(map(str, range(30_000))))
    lines = numbered_lines(spark, str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    with pytest.raises(PySparkException, match="cut this file otherwise"):
        lines.collect()


def test_bytes_that_are_no_text_are_replaced(spark, tmp_path):
    (tmp_path / "bad.PY").write_bytes(b"x = '\xff\xfe'\n")
    assert [r["text"] for r in read_code(spark, str(tmp_path)).collect()] == ["x = '��'\n"]


def test_a_corpus_counts_once_it_is_committed(spark, tmp_path):
    folder, rows = str(tmp_path), spark.range(10).withColumn("text", F.lit("t"))
    with pytest.raises(ValueError, match="no committed"):
        read_corpus(spark, folder, "texts")
    first = CorpusWriter(spark, folder)
    first.write("texts", rows)
    assert committed(spark, folder) == []
    first.commit()
    with CorpusWriter(spark, folder) as second:
        second.write("texts", with_split(rows.limit(5), "id", 0.2, 1), "split")
    assert committed(spark, folder) == [first.version, second.version]
    assert read_corpus(spark, folder, "texts").count() == 5 and read_corpus(spark, folder, "texts", first.version).count() == 10
    facts = read_corpus(spark, folder, "facts").first()
    assert (facts["table"], facts["rows"]) == ("texts", 5) and len(facts["content_sha256"]) == 64
    with pytest.raises(RuntimeError, match="half-way"), CorpusWriter(spark, folder) as third:
        third.write("texts", rows)
        raise RuntimeError("half-way")
    assert read_corpus(spark, folder, "texts").count() == 5 and sweep(spark, folder) == []
    left = CorpusWriter(spark, folder)
    left.write("texts", rows)
    assert sweep(spark, folder) == [left.version] and read_corpus(spark, folder, "texts").count() == 5


def test_a_killed_job_leaves_no_half_set(spark, tmp_path):
    job = f"""
        import os, sys
        sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
        from pyspark.sql import SparkSession
        from sparkloom.sinks.corpus import CorpusWriter
        spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / "c")!r}).getOrCreate()
        corpus = CorpusWriter(spark, {str(tmp_path / "out")!r})
        corpus.write("texts", spark.range(100).withColumnRenamed("id", "n"))
        os._exit(9)
    """
    assert subprocess.run([sys.executable, "-c", textwrap.dedent(job)], capture_output=True, timeout=120, check=False).returncode == 9
    assert list((tmp_path / "out/versions").iterdir()) and committed(spark, str(tmp_path / "out")) == []
    assert len(sweep(spark, str(tmp_path / "out"))) == 1


def test_split_of_few_rows(spark):
    split = lambda n: sorted(tuple(r) for r in with_split(spark.range(n), "id", 0.02, 3).groupBy("split").count().collect())
    assert split(1) == [("train", 1), ("val", 1)] and split(2) == [("train", 1), ("val", 1)] and split(200) == [("train", 196), ("val", 4)] and split(0) == []


@pytest.mark.parametrize("wanted", [0, 5, 40, 500])
def test_replay_counts_what_it_looked_at(spark, wanted):
    rng = np.random.default_rng(2)
    pool = spark.createDataFrame([(i, float(rng.random()), bool(rng.random() < 0.5)) for i in range(200)], "id long, x double, prose boolean")
    kept, counts = replayed(pool, "id", wanted, 9, [("low", F.col("x") < 0.2), ("high", F.col("x") > 0.9)], F.col("prose"))
    from sparkloom.functions.rng import uniform

    order = sorted(map(tuple, pool.select(uniform(9, F.col("id")), "id", "x", "prose").collect()))
    want, dropped, prose = [], {}, 0
    for _, i, x, is_prose in order:
        if len(want) >= wanted:
            break
        reason = "low" if x < 0.2 else "high" if x > 0.9 else "over cap" if is_prose and prose >= wanted * 30 // 100 else None
        if reason:
            dropped[reason] = dropped.get(reason, 0) + 1
            continue
        prose += is_prose
        want.append(i)
    assert sorted(r["id"] for r in kept.collect()) == sorted(want)
    assert wanted == 0 or {r["reason"]: r["n"] for r in counts.collect()} == dropped


def test_running_totals_over_sparse_orders(spark):
    rows = [(i * 2**40 if i < 50 else 2**62 + i, i) for i in range(60)] + [(-5, 7)]
    found = sorted((r["k"], r["before"]) for r in running_before(spark.createDataFrame(rows, "k long, n long"), "k", "n", "before").collect())
    total, want = 0, []
    for k, n in sorted(rows):
        want.append((k, total))
        total += n
    assert found == want
    assert running_before(spark.createDataFrame([], "k long, n long"), "k", "n", "before").collect() == []


def test_folds_of_null_and_equal_keys(spark):
    rows = [(None, 2), ("a", 1), (None, 1), ("a", 3), ("b", 2), ("a", 2)]
    step = lambda s, r: (s + r["n"], [(r["k"], r["n"], s)])
    last = lambda s, r: [(r["k"], -1, s)]
    found = ordered_fold(spark.createDataFrame(rows, "k string, n int"), ["k"], ["n"], 0, step, "k string, n long, s long", last)
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(None, 1, 0), (None, 2, 1), (None, -1, 3), ("a", 1, 0), ("a", 2, 1), ("a", 3, 3), ("a", -1, 6), ("b", 2, 0), ("b", -1, 2)], key=str)
    assert ordered_fold(spark.createDataFrame([], "k string, n int"), ["k"], ["n"], 0, step, "k string, n long, s long", last).collect() == []


def test_rounds_move_the_anchor_only_when_accepted(spark):
    # round, score, new, fixed: anchor; accepted within 3; too low; accepted for its parts at a cost of 3; too far under the best
    rounds = [(1, 50, 5, 5), (2, 48, 5, 5), (3, 44, 5, 5), (4, 45, 7, 5), (5, 42, 7, 5), (6, 47, 7, 5)]
    found = accepted_rounds(spark.createDataFrame([("r", *r) for r in rounds], "run string, round int, score int, new int, fixed int"))
    assert [(r["round"], r["accepted"], r["anchor_round"], r["best"]) for r in found.orderBy("round").collect()] == [(1, True, 1, 50), (2, True, 2, 50), (3, False, 2, 50), (4, True, 4, 50), (5, False, 4, 50), (6, True, 6, 50)]


def test_packing_with_state_equals_one_loop(spark):
    rng, block = np.random.default_rng(6), 15
    rows = [(s, i, int(rng.integers(0, 30))) for s in "ab" for i in range(80)]
    frame = spark.createDataFrame(rows, "shard string, row long, length long")
    want = []
    for s in "ab":
        number = filled = 0
        for _, i, n in (r for r in rows if r[0] == s):
            used = min(n, block + 1 - filled)
            want.append((s, number, i, filled, used))
            filled += used
            if filled == block + 1:
                number, filled = number + 1, 0
    assert sorted(map(tuple, packed_blocks(frame, block).collect())) == sorted(want)
    carry, found = None, []
    for low, high in ((0, 10), (10, 10), (10, 55), (55, 80)):
        part = packed_blocks(frame.filter((F.col("row") >= low) & (F.col("row") < high)), block, carry)
        found += map(tuple, part.collect())
        carry = spark.createDataFrame(open_blocks(part, block, carry).collect() or [], "shard string, block long, filled long")
    assert sorted(found) == sorted(want)


def test_resamples_merge_in_any_partitioning(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(rng.integers(100)), int(rng.integers(1, 9))) for i in range(3000)] + [(None, 1, 1), (5000, None, 1)], "id long, s long, n long")
    sums = lambda df: sorted(map(tuple, resample_sums(df, "id", "s", "n").collect()))
    assert sums(rows) == sums(rows.repartition(7)) and len(sums(rows)) == RESAMPLES
    drawn = weights(np.arange(20_000), np.arange(50))
    assert abs(drawn.mean() - 1) < 0.01 and abs(drawn.var() - 1) < 0.02 and abs((drawn == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(drawn[:, 0], drawn[:, 1])[0, 1]) < 0.03
    r = interval(rows, "id", "s", "n").first()
    sd = (r["high"] - r["low"]) / 3.92
    assert r["rows"] == 3000 and r["low"] < r["mean"] < r["high"] and 0.1 < sd < 0.5


def test_classes_of_long_chains_and_exclusion(spark):
    chain = [(i, i + 1) for i in range(100, 260) if i % 40 != 39] + [(1, 1), (None, 3), (7, 5), (5, 7), (5, 6)]
    names = {r["key"]: r["class"] for r in key_classes(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {names[k] for k in (5, 6, 7)} == {5} and names[1] == 1 and 3 not in names
    assert names[119] == 100 and names[120] == 120 and names[159] == 120 and names[260] == 240
    rows = spark.createDataFrame([(5,), (6,), (8,), (119,), (121,), (None,)], "k long")
    out = excluded(rows, "k", spark.createDataFrame([(7,), (101,), (9,)], "key long"), spark.createDataFrame(chain, "a long, b long"))
    assert sorted((r["k"] for r in out.collect()), key=str) == [121, 8, None]


def test_faults_by_path(spark):
    rules = [Rule("$.a", "long", True, 1, 5), Rule("$.b.c", "string", pattern="^x"), Rule("$.d", "double"), Rule("$.e", "array"), Rule("$.f", "object"), Rule("$.g", "boolean")]
    texts = ['{"a": 3}', '{"a": 9, "b": {"c": "y"}}', '{"b": {"c": 4}}', '{"a": null, "d": 1, "e": {}, "f": [], "g": 0}', '{"a": 1.5, "d": "2"}', '{"a"', None, "[]", '{"a": 1, "a": 2}', '{"a": 0, "b": {"c": "xy"}, "e": [1], "f": {}, "g": true, "d": 1.25}']
    found = validated(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", rules)
    faults = {r["i"]: [tuple(f) for f in r["faults"]] for r in found.collect()}
    assert faults[0] == [] and faults[1] == [("$.a", "more than 5"), ("$.b.c", "not like ^x")]
    assert faults[2] == [("$.a", "missing"), ("$.b.c", "expected string, found long")]
    assert faults[3] == [("$.a", "missing"), ("$.e", "expected array, found object"), ("$.f", "expected object, found array"), ("$.g", "expected boolean, found long")]
    assert faults[4] == [("$.a", "expected long, found double"), ("$.d", "expected double, found string")]
    assert faults[5] == faults[8] == [("$", "no JSON")] and faults[6] == [("$", "missing")] and faults[7] == [("$.a", "missing")] and faults[9] == [("$.a", "less than 1")]


def test_later_entries_and_maps_win(spark):
    row = spark.sql("SELECT map('a', 1, 'b', 2) AS m, map('b', 3) AS n, CAST(NULL AS MAP<STRING, INT>) AS z, array(named_struct('key', 'k', 'value', 1), named_struct('key', CAST(NULL AS STRING), 'value', 5), named_struct('key', 'k', 'value', 2), named_struct('key', 'l', 'value', 3)) AS e")
    found = row.select(merged_maps(F.col("m"), F.col("z"), F.col("n")).alias("x"), last_entries(F.col("e")).alias("y"), merged_maps(F.col("z"), F.col("n")).alias("w")).first()
    assert (found["x"], found["y"], found["w"]) == ({"a": 1, "b": 3}, {"k": 2, "l": 3}, {"b": 3})
