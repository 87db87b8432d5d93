"""Streams with state, timers and restarts against batch forms."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators.scratch import entries
from sparkloom.plans.registry import QUERIES
from sparkloom.streaming.calls import STOP_FAILED, STOP_SAME, advanced, repeated_calls_batch
from sparkloom.streaming.counters import COMPACT, MergedCounters

DATA = "/root/testdata/sf0.001"
COLUMNS = "task long, call string, ts timestamp, ordinal long, failed boolean, content string"


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


def plain_calls(calls):
    """Calls (task, call, ts, ordinal, failed, content) one after another."""
    state, out = {}, []
    for task, call, _, ordinal, failed, content in sorted(calls, key=lambda r: (r[2], r[3])):
        state[task, call], shown = advanced(state.get((task, call), (0, None, 0, False)), failed, content)
        out.append((task, call, ordinal, *shown))
    return sorted(out, key=str)


def test_failures_and_equal_results_stop_once():
    state, seen = (0, None, 0, False), []
    for failed, content in [(True, None)] * STOP_FAILED + [(True, None), (False, "x")] + [(False, "x")] * STOP_SAME:
        state, shown = advanced(state, failed, content)
        seen.append(shown)
    assert seen == [(1, 0, False, False), (2, 0, True, False), (3, 0, True, True), (4, 0, True, False), (0, 1, False, False), (0, 2, True, False), (0, 3, True, False), (0, 4, True, False), (0, 5, True, False)]


def test_batch_runs_equal_the_fold(spark):
    rng = np.random.default_rng(4)
    from datetime import datetime, timedelta

    calls = [(int(rng.integers(4)), "ab"[int(rng.integers(2))], datetime(2024, 1, 1) + timedelta(seconds=int(rng.integers(300))), i, bool(rng.random() < 0.5), None if rng.random() < 0.1 else str(int(rng.integers(2)))) for i in range(600)]
    found = repeated_calls_batch(spark.createDataFrame(calls, COLUMNS))
    assert sorted(map(tuple, found.select("task", "call", "ordinal", "failures", "times", "warned", "stops").collect()), key=str) == plain_calls(calls)


def test_stream_of_three_parts_equals_the_batch(spark):
    assert rows_of(QUERIES["stream_calls"](spark, DATA)) == rows_of(QUERIES["call_streaks"](spark, DATA))


def test_counters_survive_a_stop_half_way(spark, tmp_path):
    feed, folder = tmp_path / "feed", str(tmp_path / "out")
    feed.mkdir()
    made = lambda n, start: (feed / f"{n}.json").write_text("\n".join(json.dumps({"k": i % 3, "n": i}) for i in range(start, start + 10)))
    counters = MergedCounters(spark, f"{folder}/table", ["k"], ["n"])
    with pytest.raises(ValueError, match="complete batch"):
        counters.read()
    stream = lambda: spark.readStream.schema("k int, n long").option("maxFilesPerTrigger", 1).json(str(feed))
    for n in range(4):
        made(n, n * 10)
    failing, tries = MergedCounters(spark, f"{folder}/table", ["k"], ["n"]), []

    def add(batch, number):
        tries.append(number)
        MergedCounters.add(failing, batch, number)
        if number == 2:  # the batch is written, but the stream dies before it says so
            raise RuntimeError("stopped half-way")

    query = stream().writeStream.foreachBatch(add).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="stopped half-way"):
        query.awaitTermination()
    assert tries == [0, 1, 2]
    for n in range(4, 20):
        made(n, n * 10)
    counters.start(stream(), f"{folder}/log").awaitTermination()
    want = {k: sum(i for i in range(200) if i % 3 == k) for k in range(3)}
    assert {r["k"]: r["n"] for r in counters.read().collect()} == want
    assert len(entries(spark, f"{folder}/table/added")) <= 2 * COMPACT and len(entries(spark, f"{folder}/table/base")) <= 2
    counters.start(stream(), f"{folder}/log").awaitTermination()  # nothing new
    assert {r["k"]: r["n"] for r in counters.read().collect()} == want


def test_incomplete_batches_do_not_count(spark, tmp_path):
    counters = MergedCounters(spark, str(tmp_path / "t"), ["k"], ["n"])
    row = spark.createDataFrame([(1, 5)], "k int, n long")
    counters.add(row, 0)
    counters.add(row, 1)
    (tmp_path / "t/added/batch=1/_SUCCESS").unlink()
    assert [tuple(r) for r in counters.read().collect()] == [(1, 5)]
    counters.add(row.union(row), 1)
    assert [tuple(r) for r in counters.read().collect()] == [(1, 15)]


def test_no_stream_query_uses_a_memory_sink():
    from pathlib import Path

    import sparkloom.streaming as here

    assert not [p for p in Path(here.__path__[0]).glob("*.py") if '"memory"' in p.read_text()]
    assert F is not None


def test_state_is_kept_by_share_not_by_key(spark, tmp_path):
    """More keys than shares in two runs of one query: a state store that is asked key by key takes hours on a large table."""
    from datetime import datetime, timedelta

    from sparkloom.streaming.calls import SHARES, repeated_calls
    from sparkloom.streaming.counters import appended
    from sparkloom.streaming.metrics import keyed_state

    n = 2 * SHARES
    part = lambda k: [(i, "a", datetime(2024, 1, 1 + 3 * k) + timedelta(seconds=i % 7), 2 * i + k, k == 0, None) for i in range(n)]
    flush = [(None, "", datetime(2030, 1, 1), None, None, None)]
    feed = str(tmp_path / "feed")
    with keyed_state(spark):
        for rows in (part(0), part(1), flush):
            spark.createDataFrame(rows, COLUMNS).write.mode("append").parquet(feed)
            appended(repeated_calls(spark.readStream.schema(COLUMNS).parquet(feed)), str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(found) == rows_of(repeated_calls_batch(spark.createDataFrame(part(0) + part(1), COLUMNS)))
