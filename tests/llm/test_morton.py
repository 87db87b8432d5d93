"""Morton layout against brute force."""

import bisect
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm.morton import OP11_SQL, Grid, Occupied, clustered_documents, op11_morton


def brute(docs, reach, file_rows):
    """docs: (doc_id, text, source, lang). Rows as clustered_documents gives them, as a sorted list."""
    n, rows = len(docs), []
    null = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    raw = [(null(s), null(lang), -1 if t is None else len(t.encode()), null(None if i is None else zlib.crc32(str(i).encode()) % 365)) for i, t, s, lang in docs]
    below = [sorted(r[d] for r in raw) for d in range(4)]
    for (i, *_), r in zip(docs, raw, strict=True):
        c = tuple(16 * bisect.bisect_left(below[d], r[d]) // n for d in range(4))
        z = int("".join(f"{c[d]:04b}"[b] for b in range(4) for d in range(4)), 2)
        rows.append((z, (i is not None, i if i is not None else 0), i, c))
    rows.sort(key=lambda r: r[:2])
    files = defaultdict(list)
    for p, (_, _, _, c) in enumerate(rows):
        files[p // file_rows].append(c)
    bounds = {f: [(min(c[d] for c in own), max(c[d] for c in own)) for d in range(4)] for f, own in files.items()}
    out = []
    for p, (z, _, i, c) in enumerate(rows):
        low, high = [c[d] - reach[d] for d in range(4)], [c[d] + reach[d] for d in range(4)]
        touched = sum(all(a <= high[d] and b >= low[d] for d, (a, b) in enumerate(own)) for own in bounds.values())
        matching = sum(any(all(low[d] <= x[d] <= high[d] for d in range(4)) for x in set(own)) for own in files.values())
        out.append((i, z, p, p // file_rows, ",".join(f"{a},{b}" for a, b in bounds[p // file_rows]), touched, matching))
    return sorted(out, key=str)


def made(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")


@pytest.mark.parametrize("file_rows", [1, 7, 1000])
def test_layout_equals_brute_force(spark, file_rows):
    rng = np.random.default_rng(file_rows)
    rows = []
    for i in range(400):
        source = None if rng.random() < 0.1 else f"s{int(rng.integers(9))}" if rng.random() < 0.6 else "a third of all rows"
        text = None if rng.random() < 0.05 else "é" * int(rng.integers(0, 40)) if rng.random() < 0.7 else "copy"
        rows.append((None if rng.random() < 0.02 else int(i * 37 - 900), text, source, None if rng.random() < 0.2 else ["de", "en", "ü", ""][int(rng.integers(4))]))
    rows += rows[:20]  # repeated rows
    found = clustered_documents(made(spark, rows), file_rows=file_rows).collect()
    columns = ("doc_id", "z", "position", "file", "file_bounds", "files_touched", "files_matching")
    assert sorted((tuple(r[c] for c in columns) for r in found), key=str) == brute(rows, (0, 0, 2, 2), file_rows)


def test_one_value_everywhere_and_empty_table_and_other_columns(spark):
    same = made(spark, [(i, "same", "s", "en") for i in range(30)]).withColumns({"z": F.lit("clash"), "file": F.lit("clash"), "position": F.lit(None)})
    found = clustered_documents(same, reach=(1, 1, 1, 1), file_rows=10).collect()
    assert len(found) == 30 and {r["file"] for r in found} == {0, 1, 2}
    assert all(r["file_bounds"].startswith("0,0,0,0,0,0,") for r in found)
    assert clustered_documents(made(spark, [])).collect() == []
    assert [tuple(r) for r in clustered_documents(made(spark, [(None, None, None, None)])).select("doc_id", "position", "files_touched", "files_matching").collect()] == [(None, 0, 1, 1)]


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    found = op11_morton(spark, "/root/testdata/sf0.001")
    columns = found.columns
    assert sorted(map(tuple, found.collect())) == sorted(con.sql(f"select {', '.join(columns)} from ({OP11_SQL})").fetchall())


@pytest.mark.parametrize("dims,bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_next_in_box_and_intervals(dims, bits):
    grid, rng = Grid(dims, bits), np.random.default_rng(dims)
    every = np.arange(grid.cells)
    where = grid.decode(every)
    assert (grid.encode(where) == every).all()
    a, b = rng.integers(0, 1 << bits, (2, 60, dims))
    low, high = np.minimum(a, b), np.maximum(a, b)
    inside = ((where[None] >= low[:, None]) & (where[None] <= high[:, None])).all(axis=2)
    z = rng.integers(0, grid.cells, 60)
    want = [next((c for c in range(z[k], grid.cells) if inside[k, c]), grid.cells) for k in range(60)]
    assert grid.next_in_box(z, grid.encode(low), grid.encode(high)).tolist() == want
    covered, before = np.zeros_like(inside), np.full(60, -2)
    for query, first, last in grid.intervals(low, high):
        assert (first > before[query] + 1).all()  # intervals are maximal and in order
        before[query] = last
        for q, f, e in zip(query, first, last, strict=True):
            covered[q, f : e + 1] = True
    assert (covered == inside).all()


def test_files_of_cells():
    counts = np.zeros(16, dtype=np.int64)
    counts[[1, 2, 9]] = [25, 1, 4]
    cells = Occupied(Grid(2, 2), counts, 10)
    file, low, high = cells.shared_files()
    assert file.tolist() == [2] and low.tolist() == [[0, 0]] and high.tolist() == [[2, 1]]
    assert cells.own_files().tolist() == [2, 0, 0]


def test_a_grid_is_bounded():
    with pytest.raises(ValueError, match="cells"):
        Grid(6, 4)
