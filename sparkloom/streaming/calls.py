"""Repeated and failing calls in a stream: state and timers by (task, call), in shares of many keys.

Rows may come late or out of order within the watermark's delay. A share keeps them until event time has passed them,
which a timer tells; then they are taken in order. What is kept of the past is a small fixed state of each key: failures
since the last success, the last result and how often it came in a row, and whether the key was stopped. State is read
and written a share at a time, since each access is a message between Python and the state store.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Failures or equal results after which a call is warned about, and stopped.
WARN, STOP_FAILED, STOP_SAME = 2, 3, 4
#: Shares of the keys; a share's waiting rows and streaks are in the memory of one worker at a time.
SHARES = 1 << 9
# JSON lists of [task, call, us, ordinal, failed, content] and of [task, call, failures, content, times, stopped]: a row of state costs as much as a message.
PACKED = "rows string"
RESULT = "task long, call string, ordinal long, failures int, times int, warned boolean, stops boolean"


def advanced(streak: tuple, failed: bool, content: str | None) -> tuple[tuple, tuple]:
    """(state after a call, (failures, times, warned, stops)). A failure leaves the last result as it is; only the first stop of a key counts."""
    failures, last, times, stopped = streak
    if failed:
        failures += 1
        shown, over = (failures, 0), failures >= STOP_FAILED
    else:
        failures, times, last = 0, times + 1 if times and last == content else 1, content
        shown, over = (0, times), times >= STOP_SAME
    stops = over and not stopped
    return (failures, last, times, stopped or over), (*shown, max(shown) >= WARN, stops)


class RepeatedCalls(StatefulProcessor):
    """Keeps rows until the watermark has passed them, and folds those of a key in the order of time and ordinal."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", PACKED)
        self.streaks = handle.getValueState("streaks", PACKED)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for frame in rows:
            new = [(int(r.task), None if pd.isna(r.call) else str(r.call), int(r.us), int(r.ordinal), bool(r.failed), None if pd.isna(r.content) else str(r.content)) for r in frame.itertuples(index=False)]
            if new:
                self.pending.appendValue((json.dumps(new),))
                first = min(n[2] for n in new) // 1000
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest)
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = [r for (packed,) in self.pending.get() for r in json.loads(packed)] if self.pending.exists() else []
        due, rest = [r for r in waiting if r[2] // 1000 <= passed], [r for r in waiting if r[2] // 1000 > passed]
        if not due:
            return
        streaks, out = {(r[0], r[1]): tuple(r[2:]) for r in json.loads(self.streaks.get()[0])} if self.streaks.exists() else {}, []
        for task, call, _, ordinal, failed, content in sorted(due, key=lambda r: r[2:4]):
            streaks[task, call], shown = advanced(streaks.get((task, call), (0, None, 0, False)), failed, content)
            out.append((task, call, ordinal, *shown))
        self.streaks.update((json.dumps([(*k, *streak) for k, streak in streaks.items()]),))
        self.pending.clear()
        if rest:
            self.pending.appendValue((json.dumps(rest),))
            self.handle.registerTimer(min(r[2] for r in rest) // 1000)
        yield pd.DataFrame(out, columns=["task", "call", "ordinal", "failures", "times", "warned", "stops"])

    def close(self) -> None:
        pass


def repeated_calls(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """RESULT of every call of a stream (task long, call string, ts timestamp, ordinal long, failed boolean, content string), once event time has passed it.

    The session's state store must be RocksDB. The last rows come when a row of a later time, by ``delay``, is fed.
    """
    # the filter looks at the time as well, so that it stays behind the watermark: rows without a task move event time on
    timed = F.when(F.col("ts").isNotNull(), F.col("task")).isNotNull()
    keyed = stream.withWatermark("ts", delay).filter(timed).withColumn("us", F.unix_micros("ts")).withColumn("share", F.pmod(F.xxhash64("task", "call"), F.lit(SHARES)))
    return keyed.groupBy("share").transformWithStateInPandas(statefulProcessor=RepeatedCalls(), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")


def repeated_calls_batch(calls: DataFrame) -> DataFrame:
    """RESULT of a table of calls, as runs: failures since the last success, and equal results among the successes."""
    by_key = Window.partitionBy("task", "call").orderBy("ts", "ordinal")
    first = lambda c: F.sum(F.when(c, 1).otherwise(0)).over(by_key)
    good = calls.filter("not failed").withColumn("before", F.lag("content").over(by_key)).withColumn("n", F.row_number().over(by_key))
    good = good.withColumn("run", first((F.col("n") == 1) | ~F.col("content").eqNullSafe(F.col("before"))))
    within = Window.partitionBy("task", "call", "run").orderBy("ts", "ordinal")
    good = good.select("task", "call", "ts", "ordinal", F.lit(0).alias("failures"), F.row_number().over(within).alias("times"))
    bad = calls.withColumn("run", first(~F.col("failed"))).filter("failed").select("task", "call", "ts", "ordinal", F.row_number().over(within).alias("failures"), F.lit(0).alias("times"))
    both = good.unionByName(bad).withColumn("warned", F.greatest("failures", "times") >= WARN).withColumn("over", (F.col("failures") >= STOP_FAILED) | (F.col("times") >= STOP_SAME))
    return both.withColumn("stops", F.col("over") & (first(F.col("over")) == 1)).select("task", "call", "ordinal", "failures", "times", "warned", "stops")


def with_call_columns(events: DataFrame, failed: Column, content: Column) -> DataFrame:
    """Events as calls: a task is a user, a call the type of the event."""
    return events.select(F.col("user_id").alias("task"), F.col("event_type").alias("call"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("ordinal"), failed.alias("failed"), content.alias("content"))
