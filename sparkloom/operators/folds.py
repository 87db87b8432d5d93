"""Folds over rows in order, by key: what a row yields depends on a state that earlier rows left.

Rows are sorted by key and order once and pass through a task in Arrow batches. A task holds one batch and the state
of one key, however long the key's sequence is; a key's rows go through one task, since each needs the state before it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

Step = Callable[[Any, dict], tuple[Any, Iterable[tuple]]]


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], first: Any, step: Step, schema: str, last: Callable[[Any, dict], Iterable[tuple]] | None = None) -> DataFrame:
    """Rows of ``schema`` from ``step(state, row) -> (state, rows)`` over each key's rows in order, from the state ``first``.

    ``last(state, row)`` gives further rows after a key's last row. States should be values that are replaced, not changed.
    Equal keys meet, null ones too; an empty table gives no rows. Rows of equal order come in any order: order by enough columns.
    """
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = before = None
        state, begun = first, False
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if not begun or own != key:
                    if begun and last:
                        out.extend(last(state, before))
                    key, state, begun = own, first, True
                state, made = step(state, row)
                out.extend(made)
                before = row
            yield _batch(out)
        if begun and last:
            yield _batch(list(last(state, before)))

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [[r[i] for r in rows] for i in range(len(arrow))]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, kind)
