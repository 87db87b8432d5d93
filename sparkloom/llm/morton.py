"""Rows laid out along a Morton curve over equi-depth coordinates, and box queries over the files they fall into.

1. Coordinates: of every value the rows are counted, the counts are range-partitioned and summed, and the values at
   the ``2**bits`` equal steps of all rows are picked; a coordinate is the number of those that are less. What reaches
   the driver is a total for each partition and at most ``2**bits - 1`` values a column.
2. ``z`` interleaves the coordinates' bits. Rows are range-partitioned by (z, id, tie), all of which differ, so one
   hot cell is spread over tasks like any other; a row's position is its place in its partition after the rows of
   those before. Files are runs of ``file_rows`` positions.
3. A grid has ``2**(bits * columns)`` cells however many rows there are, and rows of a cell are neighbours: the
   array of cells' first positions tells which files a cell reaches. Its length is fixed, so it may go to every task.
4. Matching: a query box is split into z-intervals by next-in-box jumps; the occupied cells of an interval are found
   by binary search and reach a run of files; runs of neighbouring intervals may share one file.
5. Touched: a file meets exactly the queries whose cell lies in the file's bounds widened by the reach, so bounds are
   tested for all cells at once by sums over the corners of those boxes. Files inside one cell have that cell for
   bounds and are counted by cell; others hold a border between two occupied cells, so cells bound their number.

Edge cases: null is the smallest value, null ids come first in their cell; rows of equal id and z stand in order of
the tie, the hash of the text; one value in all rows has coordinate 0; an empty table gives no rows; other columns of
the input do not matter. Texts are only measured and hashed, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, table

BITS, FILE_ROWS = 4, 1000
#: Cells of the largest grid; the array of cells' positions has so many numbers.
MOST_CELLS = 1 << 20


@dataclass(frozen=True)
class Grid:
    """``dims`` coordinates of ``bits`` bits; bit ``k`` of z belongs to dimension ``(dims - 1 - k) % dims``."""

    dims: int
    bits: int = BITS

    def __post_init__(self) -> None:
        if self.cells > MOST_CELLS:
            raise ValueError(f"a grid of {self.cells} cells; at most {MOST_CELLS} are allowed")

    @property
    def cells(self) -> int:
        return 1 << (self.dims * self.bits)

    def z(self, coordinates: Sequence[Column]) -> Column:
        total = F.lit(0).cast("long")
        for d, c in enumerate(coordinates):
            for b in range(self.bits):
                total = total + F.shiftleft(F.shiftright(c.cast("long"), b).bitwiseAND(F.lit(1).cast("long")), b * self.dims + self.dims - 1 - d)
        return total

    def encode(self, coordinates: np.ndarray) -> np.ndarray:
        """z of (n, dims) coordinates."""
        z = np.zeros(len(coordinates), dtype=np.int64)
        for d in range(self.dims):
            for b in range(self.bits):
                z |= ((coordinates[:, d] >> b) & 1) << (b * self.dims + self.dims - 1 - d)
        return z

    def decode(self, z: np.ndarray) -> np.ndarray:
        out = np.zeros((len(z), self.dims), dtype=np.int64)
        for d in range(self.dims):
            for b in range(self.bits):
                out[:, d] |= ((z >> (b * self.dims + self.dims - 1 - d)) & 1) << b
        return out

    def next_in_box(self, z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least z' >= z in the box of the corners ``low`` and ``high`` (as z), or ``cells`` where there is none."""
        out = np.full(len(z), self.cells, dtype=np.int64)
        low, high, open_ = low.copy(), high.copy(), np.ones(len(z), dtype=bool)
        lower = [sum(1 << k for k in range(p % self.dims, p, self.dims)) for p in range(self.dims * self.bits)]
        for p in reversed(range(self.dims * self.bits)):
            bit, below = 1 << p, lower[p]
            at, least, most = (z & bit) > 0, (low & bit) > 0, (high & bit) > 0
            raised = (low | bit) & ~below  # the box's part in the upper half begins there
            both = open_ & ~least & most
            out[both & ~at] = raised[both & ~at]
            high[both & ~at] = ((high & ~bit) | below)[both & ~at]
            low[both & at] = raised[both & at]
            above = open_ & ~at & least & most  # the box is wholly above
            out[above] = low[above]
            open_ &= ~above & ~(at & ~least & ~most)  # or wholly below: what was found before holds
        out[open_] = z[open_]
        return out

    def intervals(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, first z, last z): the runs of z inside the boxes of corner coordinates ``low`` and ``high``, each query's in order."""
        first, last = self.encode(low), self.encode(high)
        query, z = np.arange(len(low)), first.copy()
        while len(query):
            z = self.next_in_box(z, first[query], last[query])
            query, z = query[z < self.cells], z[z < self.cells]
            end = z.copy()
            going = np.ones(len(query), dtype=bool)
            while going.any():  # aligned blocks wholly in the box, one after another
                at = np.flatnonzero(going)
                grown = self._block_end(end[at], low[query[at]], high[query[at]])
                end[at] = grown
                going[at] = grown < self.cells
                inside = self.decode(np.minimum(grown, self.cells - 1))
                going[at] &= ((inside >= low[query[at]]) & (inside <= high[query[at]])).all(axis=1)
            yield query, z, end - 1
            query, z = query[end < self.cells], end[end < self.cells]

    def _block_end(self, z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Past the largest aligned block that begins with z and lies in the box; z itself does."""
        end, fits = z + 1, np.ones(len(z), dtype=bool)
        for k in range(1, self.dims * self.bits + 1):
            fits &= (z & ((1 << k) - 1)) == 0
            corner = self.decode(z | ((1 << k) - 1))
            fits &= (corner <= high).all(axis=1) & (corner >= low).all(axis=1)
            if not fits.any():
                break
            end[fits] = z[fits] + (1 << k)
        return end


class Occupied:
    """The occupied cells of a grid and the files that their rows fall into; ``counts``: rows of every cell."""

    def __init__(self, grid: Grid, counts: np.ndarray, file_rows: int = FILE_ROWS):
        self.grid, self.rows, self.total = grid, file_rows, int(counts.sum())
        self.z = np.flatnonzero(counts)
        ends = np.cumsum(counts)[self.z]
        self.start, self.end = ends - counts[self.z], ends
        self.first, self.last = self.start // file_rows, (self.end - 1) // file_rows
        self.coordinates = grid.decode(self.z)

    def shared_files(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(file, least, largest coordinates) of the files with rows of two or more cells: each holds a border between occupied cells."""
        borders = self.start[1:]
        file = np.unique(borders[borders % self.rows > 0] // self.rows)
        low = np.searchsorted(self.start, file * self.rows, "right") - 1
        high = np.searchsorted(self.start, np.minimum((file + 1) * self.rows, self.total) - 1, "right") - 1
        edges = np.stack([low, high + 1], axis=1).ravel()
        padded = np.vstack([self.coordinates, self.coordinates[-1:]])
        if not len(file):
            return file, padded[:0], padded[:0]
        return file, np.minimum.reduceat(padded, edges, axis=0)[::2], np.maximum.reduceat(padded, edges, axis=0)[::2]

    def own_files(self) -> np.ndarray:
        """How many files lie inside each occupied cell."""
        stop = np.where(self.end == self.total, -(-self.end // self.rows), self.end // self.rows)
        return np.maximum(stop + self.start // -self.rows, 0)

    def touched(self, reach: Sequence[int]) -> np.ndarray:
        """For every occupied cell, the files whose bounds meet its query."""
        side, dims = 1 << self.grid.bits, self.grid.dims
        _, low, high = self.shared_files()
        low, high = np.vstack([low, self.coordinates]), np.vstack([high, self.coordinates])
        weight = np.concatenate([np.ones(len(low) - len(self.z), dtype=np.int64), self.own_files()])
        low, high = np.maximum(low - np.array(reach), 0), np.minimum(high + np.array(reach), side - 1) + 1
        sums = np.zeros((side + 1,) * dims, dtype=np.int64)
        for corner in range(1 << dims):
            upper = np.array([corner >> d & 1 for d in range(dims)], dtype=bool)
            np.add.at(sums, tuple(np.where(upper, high, low).T), weight * (-1) ** int(upper.sum()))
        for d in range(dims):
            sums = np.cumsum(sums, axis=d)
        return sums[tuple(self.coordinates.T)]

    def matching(self, cells: np.ndarray, reach: Sequence[int]) -> np.ndarray:
        """For each of the cells, the files that hold a row inside its query."""
        at, top = self.grid.decode(cells), (1 << self.grid.bits) - 1
        found, before = np.zeros(len(cells), dtype=np.int64), np.full(len(cells), -1, dtype=np.int64)
        for query, low, high in self.grid.intervals(np.maximum(at - np.array(reach), 0), np.minimum(at + np.array(reach), top)):
            i, j = np.searchsorted(self.z, low), np.searchsorted(self.z, high, "right") - 1
            some = i <= j
            query, f, g = query[some], self.first[i[some]], self.last[j[some]]
            found[query] += g - f + 1 - (f == before[query])
            before[query] = g
        return found


def running_counts(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
    """(the rows in order of the keys, with ``position`` from 0, number of rows). Keys should differ; rows of equal keys stay together in one task."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(k).asc_nulls_first() for k in keys]
    placed = materialised(df.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    # an id is the partition's number above 33 bits of the row's place in it
    part, place = F.shiftright("__place", 33).cast("int"), F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    before, total = {}, 0
    for p, n in sorted(placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()):
        before[p], total = total, total + n
    offsets = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__part int, __before long")  # a row for each partition
    return placed.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn("position", F.col("__before") + place).drop("__part", "__before", "__place"), total


def quantile_values(df: DataFrame, column: str, steps: int) -> list:
    """The values at ranks ``ceil(k * rows / steps)`` (from 1) of the rows in order, nulls first, for k from 1 to steps - 1."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n"))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialised(counts.repartitionByRange(partitions, F.col(column).asc_nulls_first()).withColumn("__part", F.spark_partition_id()))
    sums, total = {}, 0
    for p, n in sorted(placed.groupBy("__part").agg(F.sum("__n")).collect()):
        sums[p], total = (total, total + n), total + n
    ranks = [-(-k * total // steps) for k in range(1, steps)] if total else []
    parts = {p: [r for r in ranks if a < r <= b] for p, (a, b) in sums.items()}
    hit = [p for p, own in parts.items() if own]
    if not hit:
        return []
    upto = F.sum("__n").over(Window.partitionBy("__part").orderBy(F.col(column).asc_nulls_first()))
    running = placed.filter(F.col("__part").isin(hit)).withColumn("__upto", upto)
    base = F.create_map(*[F.lit(x) for p in hit for x in (p, sums[p][0])])
    running = running.withColumn("__upto", F.col("__upto") + base[F.col("__part")]).withColumn("__from", F.col("__upto") - F.col("__n"))
    wanted = F.filter(F.array(*[F.lit(r) for r in ranks]), lambda r: (r > F.col("__from")) & (r <= F.col("__upto")))
    rows = running.withColumn("__k", F.size(wanted)).filter("__k > 0").select("__from", column, "__k").collect()
    return [value for _, value, k in sorted(rows, key=lambda r: r[0]) for _ in range(k)]


def coordinate(column: str, cuts: Sequence) -> Column:
    """How many of the cuts are less than the value; null is the smallest value."""
    total = F.lit(0)
    for cut in dict.fromkeys(bytes(c) if isinstance(c, bytearray) else c for c in cuts):
        less = F.col(column).isNotNull() if cut is None else F.coalesce(F.col(column) > F.lit(cut), F.lit(False))
        total = total + F.when(less, F.lit(sum(c == cut for c in cuts))).otherwise(0)
    return total


@dataclass(frozen=True)
class Layout:
    """``rows``: the id, z, position and file of every row; ``counts``: rows of every cell of the grid."""

    grid: Grid
    rows: DataFrame
    counts: np.ndarray
    file_rows: int

    def queries(self, reach: Sequence[int]) -> DataFrame:
        """z, files_touched, files_matching of the query of every cell (zeros where no row is): so many rows as the grid has cells."""
        grid, counts, file_rows = self.grid, self.counts, self.file_rows

        def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            cells = Occupied(grid, counts, file_rows)
            touched = cells.touched(reach) if len(cells.z) else None
            for batch in batches:
                z = batch["id"].to_numpy()
                out, at = np.zeros((len(z), 2), dtype=np.int64), np.searchsorted(cells.z, z)
                own = np.flatnonzero((at < len(cells.z)) & (cells.z[np.minimum(at, len(cells.z) - 1)] == z)) if len(cells.z) else []
                if len(own):
                    out[own, 0], out[own, 1] = touched[at[own]], cells.matching(z[own], reach)
                yield pd.DataFrame({"z": z, "files_touched": out[:, 0], "files_matching": out[:, 1]})

        return self.rows.sparkSession.range(0, grid.cells, numPartitions=8).mapInPandas(answer, "z long, files_touched long, files_matching long")

    def with_bounds(self) -> DataFrame:
        """The rows with ``file_bounds``, the least and largest coordinate of each column in their file: those of the cell, unless the file has rows of several cells."""
        file, low, high = Occupied(self.grid, self.counts, self.file_rows).shared_files()
        named = [(int(f), ",".join(map(str, np.stack([a, b], axis=1).ravel()))) for f, a, b in zip(file, low, high, strict=True)]
        shared = self.rows.sparkSession.createDataFrame(named, "file long, shared string")  # fewer rows than the grid has cells
        digits = [reversed([F.shiftright("z", b * self.grid.dims + self.grid.dims - 1 - d).bitwiseAND(F.lit(1).cast("long")) * (1 << b) for b in range(self.grid.bits)]) for d in range(self.grid.dims)]
        own = [sum(bits, F.lit(0)).cast("string") for bits in digits]
        rows = self.rows.join(F.broadcast(shared), "file", "left")
        return rows.withColumn("file_bounds", F.coalesce("shared", F.concat_ws(",", *[c for c in own for _ in range(2)]))).drop("shared")


def layout(df: DataFrame, columns: Sequence[str], key: str, tie: str, bits: int = BITS, file_rows: int = FILE_ROWS) -> Layout:
    """The rows of ``df`` in Morton order of the columns, then by key and tie. ``df`` is read several times: it should be narrow and written."""
    grid = Grid(len(columns), bits)
    cuts = {c: quantile_values(df, c, 1 << bits) for c in columns}
    cells = df.select(F.col(key).alias(key), grid.z([coordinate(c, cuts[c]) for c in columns]).alias("z"), F.col(tie).alias(tie))
    placed, _ = running_counts(cells, ["z", key, tie])
    spark = df.sparkSession
    by_cell = spark.range(grid.cells).join(placed.groupBy(F.col("z").alias("id")).agg(F.count(F.lit(1)).alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    counts = np.zeros(grid.cells, dtype=np.int64)
    found = by_cell.toPandas()  # as many rows as the grid has cells
    counts[found["id"].to_numpy()] = found["n"].to_numpy()
    return Layout(grid, placed.withColumn("file", F.floor(F.col("position") / file_rows).cast("long")).drop(tie), counts, file_rows)


def clustered_documents(docs: DataFrame, reach: Sequence[int] = (0, 0, 2, 2), file_rows: int = FILE_ROWS) -> DataFrame:
    """doc_id, z, position, file, file_bounds, files_touched, files_matching of every document, laid out by source, lang, length and date."""
    number = F.col("doc_id").cast("long")
    narrow = docs.select(
        number.alias("doc_id"), F.col("source").cast("binary").alias("source"), F.col("lang").cast("binary").alias("lang"),
        F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long").alias("length"), (F.crc32(number.cast("string").cast("binary")) % 365).cast("int").alias("date"), F.xxhash64("text").alias("tie"),
    )
    found = layout(materialised(narrow), ["source", "lang", "length", "date"], "doc_id", "tie", file_rows=file_rows)
    return found.with_bounds().join(F.broadcast(found.queries(reach)), "z")


def op11_morton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered_documents(table(spark, sf_dir, "documents")).select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


_SPREAD = " + ".join(f"((c{d} >> {b}) & 1) * {1 << (b * 4 + 3 - d)}" for d in range(4) for b in range(4))
_MEETS = "f.s0 <= q.c0 AND f.s1 >= q.c0 AND f.l0 <= q.c1 AND f.l1 >= q.c1 AND f.n0 <= q.c2 + 2 AND f.n1 >= q.c2 - 2 AND f.d0 <= q.c3 + 2 AND f.d1 >= q.c3 - 2"
OP11_SQL = f"""
WITH crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i)),
d AS (SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length,
  xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 365 AS date FROM documents, crc),
n AS (SELECT count(*) AS n FROM d),
c AS (SELECT doc_id, 16 * (rank() OVER (ORDER BY source NULLS FIRST) - 1) // n AS c0, 16 * (rank() OVER (ORDER BY lang NULLS FIRST) - 1) // n AS c1,
  16 * (rank() OVER (ORDER BY length) - 1) // n AS c2, 16 * (rank() OVER (ORDER BY date NULLS FIRST) - 1) // n AS c3 FROM d, n),
z AS (SELECT *, ({_SPREAD})::BIGINT AS z FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM z),
r AS (SELECT *, position // 1000 AS file FROM p),
f AS (SELECT file, min(c0) AS s0, max(c0) AS s1, min(c1) AS l0, max(c1) AS l1, min(c2) AS n0, max(c2) AS n1, min(c3) AS d0, max(c3) AS d1 FROM r GROUP BY file),
q AS (SELECT DISTINCT z, c0, c1, c2, c3 FROM z),
t AS (SELECT q.z, count(*) AS files_touched FROM q JOIN f ON {_MEETS} GROUP BY 1),
h AS (SELECT DISTINCT file, c0, c1, c2, c3 FROM r),
m AS (SELECT q.z, count(DISTINCT h.file) AS files_matching FROM q JOIN h ON h.c0 = q.c0 AND h.c1 = q.c1 AND abs(h.c2 - q.c2) <= 2 AND abs(h.c3 - q.c3) <= 2 GROUP BY 1)
SELECT doc_id, r.z, r.position, r.file, files_touched, files_matching, concat_ws(',', s0, s1, l0, l1, n0, n1, d0, d1) AS file_bounds
FROM r JOIN f USING (file) JOIN t ON t.z = r.z JOIN m ON m.z = r.z
"""
