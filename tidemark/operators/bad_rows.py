"""Rows that fail to parse: typed records and rejects with their first reason.

Lines go in blocks through a columnar parse (one regular expression and a cast of each column
over a whole Arrow array). A block in which anything fails is cut in two, again and again; what
is left of it at the size of a leaf is read line by line by a strict parser, as are lines that have
not the plain form. That parser alone decides that a line is bad, and why. The operator is a narrow map: no shuffle, and a task holds one
Arrow batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import carried

BLOCK_LINES = 4096
LEAF_LINES = 16

REASONS = ("quoting", "column_count", "date_time", "price", "volume")
PRICES = ("open", "high", "low", "close")

_NUMBER = r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_BLOCK = (
    r"\A(?P<date_time>[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2})"
    + "".join(rf",(?P<{p}>{_NUMBER})" for p in PRICES)
    + r",(?P<volume>[0-9]+)\r?\z"
)
_FIELD = r'(?:"(?:[^"]|"")*"|[^",]*)'
_LINE = re.compile(rf"{_FIELD}(?:,{_FIELD})*", re.S)
_FIELDS = re.compile(rf"(?:\A|,)({_FIELD})", re.S)
_STAMP = re.compile(r"([0-9]{4})-([0-9]{2})-([0-9]{2}) ([0-9]{2}):([0-9]{2}):([0-9]{2})")
_PRICE = re.compile(_NUMBER)
_DIGITS = re.compile(r"[0-9]+")
_LONG_MAX = 2**63 - 1
_YEAR_1 = -62135596800
_EPOCH, _MICROSECOND = datetime(1970, 1, 1), timedelta(microseconds=1)

_ARROW = pa.schema(
    [("date_time", pa.timestamp("us")), *((p, pa.float64()) for p in PRICES), ("volume", pa.int64()), ("reason", pa.string())]
)
OUTPUT = T.StructType(
    [
        T.StructField("date_time", T.TimestampNTZType()),
        *(T.StructField(p, T.DoubleType()) for p in PRICES),
        T.StructField("volume", T.LongType()),
        T.StructField("reason", T.StringType()),
    ]
)


class _Block:
    """A block of lines in columnar form: fields by one regular expression, prices and volumes by one
    cast each. Null where a line has not the plain form."""

    def __init__(self, lines: pa.Array):
        self.lines = lines
        parts = pc.extract_regex(lines, _BLOCK)
        field = dict(zip((f.name for f in parts.type), parts.flatten(), strict=True))
        self.odd = np.asarray(field["volume"].is_null())
        self.stamp = field["date_time"]
        self.texts = [field[c] for c in (*PRICES, "volume")]
        self.numbers: list[np.ndarray] | None = None
        try:
            self.numbers = self._cast(0, len(lines))
        except pa.ArrowInvalid:
            pass  # some number is out of range: cast by part

    def _cast(self, a: int, b: int) -> list[np.ndarray]:
        kinds = (pa.float64(),) * len(PRICES) + (pa.int64(),)
        return [np.asarray(pc.fill_null(pc.cast(t[a:b], k), 0)) for t, k in zip(self.texts, kinds, strict=True)]

    def part(self, a: int, b: int) -> tuple[np.ndarray, list[np.ndarray]] | None:
        """(microseconds, numbers) of lines a..b - 1, with anything on odd ones, or None if some field of
        them has the form but not the value."""
        try:
            seconds = np.asarray(pc.fill_null(pc.cast(pc.cast(self.stamp[a:b], pa.timestamp("s")), pa.int64()), 0))
            numbers = self._cast(a, b) if self.numbers is None else [x[a:b] for x in self.numbers]
        except pa.ArrowInvalid:
            return None
        return None if len(seconds) and seconds.min() < _YEAR_1 else (seconds * 1_000_000, numbers)


def parse_line(line: str | None) -> tuple:
    """(date_time, open, high, low, close, volume, reason) of one line; strict, and the norm."""

    def bad(reason: str) -> tuple:
        return (None,) * 6 + (reason,)

    if line is None:
        return bad("column_count")
    if line.endswith("\r"):
        line = line[:-1]
    if '"' in line:
        if not _LINE.fullmatch(line):
            return bad("quoting")
        fields = [f[1:-1].replace('""', '"') if f.startswith('"') else f for f in _FIELDS.findall(line)]
    else:
        fields = line.split(",")
    if len(fields) != 6:
        return bad("column_count")
    m = _STAMP.fullmatch(fields[0])
    try:
        stamp = datetime(*map(int, m.groups())) if m else None
    except ValueError:
        stamp = None
    if stamp is None:
        return bad("date_time")
    if not all(_PRICE.fullmatch(f) for f in fields[1:5]):
        return bad("price")
    digits = fields[5]
    if not _DIGITS.fullmatch(digits) or len(digits.lstrip("0")) > 19 or int(digits) > _LONG_MAX:
        return bad("volume")
    return (stamp, *map(float, fields[1:5]), int(digits), None)


def parse_lines(lines: pa.Array, leaf: int = LEAF_LINES) -> pa.RecordBatch:
    """A block as typed columns with the reasons of its bad lines.

    The regular expression names the lines that have not the plain form: these the strict parser
    reads. All others are taken as a whole if their fields can be cast; else the block is cut in
    two, again and again, down to `leaf` lines, which the strict parser reads as well.
    """
    n = len(lines)
    block = _Block(lines)
    stamp, valid = np.zeros(n, np.int64), np.zeros(n, bool)
    numbers = [*(np.zeros(n) for _ in PRICES), np.zeros(n, np.int64)]
    reasons: list[str | None] = [None] * n
    todo = [(0, n)] if n else []
    strict = block.odd.copy()
    while todo:
        a, b = todo.pop()
        if (good := block.part(a, b)) is not None:
            stamp[a:b], valid[a:b] = good[0], ~block.odd[a:b]
            for to, x in zip(numbers, good[1], strict=True):
                to[a:b] = x
        elif b - a > leaf:
            half = (a + b) // 2
            todo += [(a, half), (half, b)]
        else:
            strict[a:b] = True
    at_odds = np.flatnonzero(strict)
    for i, line in zip(at_odds.tolist(), lines.take(pa.array(at_odds)).to_pylist(), strict=True):
        at, *values, reason = parse_line(line)
        valid[i] = reason is None
        if reason is None:
            stamp[i] = (at - _EPOCH) // _MICROSECOND
            for to, v in zip(numbers, values, strict=True):
                to[i] = v
        reasons[i] = reason
    bad = ~valid
    columns = [pa.array(stamp, mask=bad).cast(pa.timestamp("us")), *(pa.array(x, mask=bad) for x in numbers), pa.array(reasons, pa.string())]
    return pa.record_batch(columns, schema=_ARROW)


def parse_records(df: DataFrame, text: str, block: int = BLOCK_LINES, leaf: int = LEAF_LINES, keep_text: bool = True) -> DataFrame:
    """df with date_time, open, high, low, close, volume and reason parsed from column `text`.

    reason is null for a valid line, and the typed columns are null for a bad one. A null line
    has no field and an empty one has one: both are `column_count`. Repeated lines are parsed
    each for itself. Numbers beyond the range of a double become infinite. Columns of df that
    clash with the output names come out as `<name>_in`; without keep_text the lines themselves
    are left out.
    """
    names = [f.name for f in OUTPUT]
    kept = carried(df if keep_text else df.drop(text), names)
    source = df.select(*kept, F.col(f"`{text}`").cast("string").alias("_tm_line"))
    schema = T.StructType([*source.schema.fields[:-1], *OUTPUT.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                typed = parse_lines(pc.cast(part.column(part.num_columns - 1), pa.string()), leaf)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *typed.columns], names=[*batch.schema.names[:-1], *names])

    return source.mapInArrow(run, schema)


def rejects(df: DataFrame, text: str, keep_text: bool = True) -> DataFrame:
    return parse_records(df, text, keep_text=keep_text).where(F.col("reason").isNotNull())


def records(df: DataFrame, text: str, keep_text: bool = False) -> DataFrame:
    return parse_records(df, text, keep_text=keep_text).where(F.col("reason").isNull()).drop("reason")
