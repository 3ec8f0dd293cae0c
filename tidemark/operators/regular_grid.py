"""Irregular readings onto a regular grid, with gaps filled by a low-rank model.

A matrix holds the sources of one resolution in its rows and the periods of one UTC day in its
columns; a cell is the reading of a source at an instant, so that what the other sources did at
that instant tells what one without reading did. Alternating least squares factorises each
matrix on its own: it has at most 1440 columns, and where a day has more than ROWS_MAX sources
they are dealt to several matrices, so that a matrix is one bounded task whatever the data.
Observed cells stay exactly as they are, and cells that too little supports stay marked.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_S = 86_400
RANK = 2
ROUNDS = 8
RIDGE = 0.05
#: Sources of one matrix.
ROWS_MAX = 4096
#: Measures relative to the row's median are held within these bounds while fitting.
CLIP = (0.5, 2.0)
#: A filled cell needs so many observed cells in its row and so many rows in its column.
SUPPORT = 2


def prior(columns: int) -> np.ndarray:
    """Column factors before fitting: a constant, and the time of day from -1 to 1."""
    out = np.ones((columns, RANK))
    out[:, 1] = np.linspace(-1, 1, columns) if columns > 1 else 0
    return out


class _Rows:
    """The packed rows of one matrix as flat cell arrays."""

    def __init__(self, table: pa.Table):
        cells = table.column("cells").combine_chunks()
        cells = cells.chunk(0) if isinstance(cells, pa.ChunkedArray) else cells
        counts = np.diff(np.asarray(cells.offsets))
        flat = cells.flatten()
        self.n = len(counts)
        self.row = np.repeat(np.arange(self.n), counts)
        self.cell = np.asarray(flat.field("cell")).astype(np.int64)
        close = flat.field("value")
        self.value = np.asarray(close.fill_null(float("nan")), dtype=float)
        usable = np.isfinite(self.value) & (self.value > 0)
        self.u_row, self.u_cell = self.row[usable], self.cell[usable]
        v = self.value[usable]
        order = np.lexsort((v, self.u_row))
        self.count = np.bincount(self.u_row, minlength=self.n)
        ends = np.cumsum(self.count)
        begins = ends - self.count
        some = self.count > 0
        self.scale = np.full(self.n, np.nan)
        s = v[order]
        lo = (begins + (self.count - 1) // 2)[some]
        hi = (begins + self.count // 2)[some]
        self.scale[some] = (s[lo] + s[hi]) / 2
        self.y = np.clip(v / self.scale[self.u_row], *CLIP)

    def factors(self, columns: np.ndarray) -> np.ndarray:
        """Row factors by ridge regression on the column factors, drawn towards a constant row."""
        v = columns[self.u_cell]
        start = np.zeros(RANK)
        start[0] = 1
        left = np.zeros((self.n, RANK, RANK))
        right = np.zeros((self.n, RANK))
        off = self.y - v @ start
        for i in range(RANK):
            right[:, i] = np.bincount(self.u_row, v[:, i] * off, self.n)
            for j in range(i, RANK):
                left[:, i, j] = left[:, j, i] = np.bincount(self.u_row, v[:, i] * v[:, j], self.n)
        return start + np.linalg.solve(left + RIDGE * np.eye(RANK), right[..., None])[..., 0]


def factorise(rows: _Rows, base: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(column factors, rows seen per column) of a matrix by alternating least squares."""
    n = len(base)
    enough = (rows.count >= SUPPORT)[rows.u_row]
    row, at, y = rows.u_row[enough], rows.u_cell[enough], rows.y[enough]
    seen = np.bincount(at, minlength=n)
    columns = base
    for _ in range(rounds):
        u = rows.factors(columns)[row]
        off = y - (u * base[at]).sum(axis=1)
        left, right = np.zeros((n, RANK, RANK)), np.zeros((n, RANK))
        for i in range(RANK):
            right[:, i] = np.bincount(at, u[:, i] * off, n)
            for j in range(i, RANK):
                left[:, i, j] = left[:, j, i] = np.bincount(at, u[:, i] * u[:, j], n)
        columns = base + np.linalg.solve(left + RIDGE * np.eye(RANK), right[..., None])[..., 0]
    return columns, seen


def _fill(only_gaps: bool):
    def run(table: pa.Table) -> pa.Table:
        rows = _Rows(table)
        resolution, day = table.column("resolution")[0].as_py(), table.column("day")[0].as_py()
        step = resolution * 60
        columns, seen = factorise(rows, prior(max(int(rows.cell.max()) + 1, DAY_S // step)))
        begins = np.flatnonzero(np.r_[True, rows.row[1:] != rows.row[:-1]])
        first, last = np.minimum.reduceat(rows.cell, begins), np.maximum.reduceat(rows.cell, begins)
        length = last - first + 1
        start = np.cumsum(length) - length
        row = np.repeat(np.arange(rows.n), length)
        cell = np.arange(length.sum()) - start[row] + first[row]
        value = np.full(len(row), np.nan)
        held = np.zeros(len(row), bool)
        at = start[rows.row] + rows.cell - first[rows.row]
        held[at], value[at] = True, rows.value
        backed = (rows.count[row] >= SUPPORT) & (seen[cell] >= SUPPORT)
        guess = (rows.factors(columns)[row] * columns[cell]).sum(axis=1) * rows.scale[row]
        value = np.where(~held & backed, guess, value)
        state = np.where(held, 0, np.where(backed, 1, 2))
        out = np.flatnonzero(~held) if only_gaps else np.arange(len(row))
        slot = -(-day * DAY_S // step) * step + cell[out] * step
        return pa.table(
            {
                "source": table.column("source").take(pa.array(row[out])),
                "resolution": pa.array(np.full(len(out), resolution)),
                "slot_seconds": pa.array(slot),
                "value": pa.array(value[out], mask=np.isnan(value[out])),
                "state": pa.array(["observed", "filled", "unsupported"]).take(pa.array(state[out])),
            }
        )

    return run


def pack(df: DataFrame, source: Column, resolution: Column, seconds: Column, value: Column, tie: Column) -> DataFrame:
    """(source, resolution, day, cells): per source, resolution and UTC day its periods that hold a reading.

    The value of a period is the last one in it that is not null, by time and then by `tie`.
    """
    step = F.col("resolution") * 60
    bars = df.select(source.alias("source"), resolution.cast("long").alias("resolution"), seconds.alias("s"), value.alias("value"), tie.alias("tie"))
    bars = bars.where(F.col("source").isNotNull() & (F.col("resolution") > 0) & F.col("s").isNotNull())
    slot = (F.col("s") - F.pmod("s", step)).alias("slot")
    last = F.max_by("value", F.when(F.col("value").isNotNull(), F.struct("s", "tie"))).alias("value")
    cells = bars.groupBy("source", "resolution", slot).agg(last)
    day = F.floor(F.col("slot") / DAY_S)
    cell = F.floor((F.col("slot") - day * DAY_S) / step).cast("int")
    cells = cells.select("source", "resolution", day.alias("day"), F.struct(cell.alias("cell"), "value").alias("cell"))
    return cells.groupBy("source", "resolution", "day").agg(F.collect_list("cell").alias("cells"))


def regular_grid(
    df: DataFrame, source: Column, resolution: Column, seconds: Column, value: Column, tie: Column, only_gaps: bool = False, rows_max: int = ROWS_MAX
) -> DataFrame:
    """(source, resolution, slot_seconds, value, state): an even series of periods.

    A period starts at a multiple of `resolution` minutes since the epoch. Per source,
    resolution and UTC day the periods run from the first to the last that holds a reading.
    state is `observed` where a period holds one: its value is the last one that is not null,
    exactly as it is, or null if there is none. Periods without reading are `filled` from the
    low-rank model, or `unsupported` with a null value where the row or the column has fewer
    than SUPPORT usable cells. A row is a source's day, a column an instant; a column counts the
    rows of its matrix that have SUPPORT usable cells. Readings that are not positive and finite
    take no part in fitting. Rows without source, resolution (or with one below 1) or time do
    not count. An empty table gives an empty result.
    """
    packed = pack(df, source, resolution, seconds, value, tie)
    # one row for each resolution and day
    sizes = packed.groupBy("resolution", "day").agg(F.ceil(F.count("*") / rows_max).cast("int").alias("parts"))
    dealt = packed.join(sizes, ["resolution", "day"]).withColumn("part", F.pmod(F.xxhash64("source"), F.col("parts")).cast("int"))
    schema = "source string, resolution long, slot_seconds long, value double, state string"
    return dealt.drop("parts").groupBy("resolution", "day", "part").applyInArrow(_fill(only_gaps), schema)
