"""Implausible readings: impossible values, frozen runs, and spikes against a source's own normal.

All readings are range-partitioned by (source, time), so that a source of any share of the
rows spreads over as many tasks as it fills, and each task streams its sorted rows through
vectorised kernels with a small carry. The normal of a source is a quantile sketch of its
measures for every hour of the day (a log-spaced histogram); sketches merge by adding their
counts: over the hours where a rule has one context for all of them, and over partitions.
A fence lies a multiple of the distance of two quantiles beyond the upper (or below the lower)
one. Sketches tell the buckets that hold these quantiles, and the exact order statistics are
looked up in these buckets alone. A source inside one partition has its sketches merged there;
only the first and the last source of a partition may reach into the next one: of those, the
readings near the edge are decided in a second small pass that has both sides, and the
sketches of all partitions are merged by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage

LEVEL_READINGS = 21
FROZEN_READINGS = 12
#: Readings on either side that decide a reading.
HALO = max(LEVEL_READINGS // 2, FROZEN_READINGS - 1)
#: Sketch buckets per power of two: a bucket is 0.07 % wide.
PER_OCTAVE = 1024
BLOCK_ROWS = 200_000

CASE, UNDECIDED, CONTEXT, PART = range(4)

_OUT = pa.schema(
    [
        ("kind", pa.int8()),
        ("source", pa.string()),
        ("field", pa.int8()),
        ("rec_id", pa.int64()),
        ("t", pa.int64()),
        ("x", pa.float64()),
        ("m", pa.float64()),
        ("sure", pa.bool_()),
        ("first", pa.bool_()),
        ("hour", pa.int8()),
    ]
)
_OUT_SQL = "kind byte, source string, field byte, rec_id long, t long, x double, m double, sure boolean, first boolean, hour byte"
HOUR_MS = 3_600_000


@dataclass(frozen=True)
class Rule:
    """How readings of one field are judged.

    least: values below it, or equal to it if it is barred, are impossible. relative: the
    measure is the departure from the local level (the rate at which a reading leaves its
    neighbours), else the reading itself. A measure is a case if it lies more than `expand`
    times the distance of the quantiles low and high above the high one (or, with both_sides,
    below the low one). Without low the distance is taken from zero: high = 0.5 and expand = 14
    is a fence at 15 medians. Low = 0.25, high = 0.75 and by_hour are expanded interquartile
    fences of each hour of the day.
    """

    least: float
    barred: bool
    relative: bool
    expand: float
    low: float | None = 0.25
    high: float = 0.75
    by_hour: bool = True
    both_sides: bool = False

    @property
    def quantiles(self) -> tuple[float, ...]:
        return (self.high,) if self.low is None else (self.low, self.high)

    def bounds(self, q):
        """(lower, upper) bound of measures from the quantiles, of numbers or columns."""
        low = q[0] if len(q) > 1 else 0.0
        reach = (q[-1] - low) * self.expand
        return low - reach, q[-1] + reach


def ranks(n, q: float):
    """The two order statistics whose mean is a quantile (floor and ceiling of (n - 1) q)."""
    at = (n - 1) * q
    return np.floor(at).astype(np.int64), np.ceil(at).astype(np.int64)


def buckets(m: np.ndarray) -> np.ndarray:
    """Sketch bucket: order-preserving, and PER_OCTAVE to a power of two for positive measures."""
    with np.errstate(divide="ignore", invalid="ignore"):
        b = np.floor(np.log2(m) * PER_OCTAVE)
    return np.where(m <= 0, -(10**8), np.where(np.isinf(m), 10**8, b)).astype(np.int64)


def sketch(m: np.ndarray, hour: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hour, bucket, count) of measures: a sketch for each hour."""
    code, counts = np.unique(hour.astype(np.int64) << 40 | buckets(m) + (1 << 39), return_counts=True)
    return code >> 40, (code & (1 << 40) - 1) - (1 << 39), counts


def merge_hours(bucket: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of several together."""
    both, at = np.unique(bucket, return_inverse=True)
    return both, np.bincount(at, count).astype(np.int64)


def exact_quantile(bucket: np.ndarray, count: np.ndarray, m: np.ndarray, of: np.ndarray, q: float) -> float:
    """A quantile of m, whose buckets are `of`: the sketch tells the buckets, their own values the rest."""
    upto = np.cumsum(count)
    values = []
    for r in ranks(upto[-1], q):
        k = int(np.searchsorted(upto, r, side="right"))
        inside = m[of == bucket[k]]
        at = int(r - (upto[k] - count[k]))
        values.append(inside[0] if len(inside) == 1 else np.partition(inside, at)[at])
    return float((values[0] + values[1]) / 2)


def local_level(x: np.ndarray, start: np.ndarray, end: np.ndarray, width: int = LEVEL_READINGS) -> np.ndarray:
    """Median of the `width` values centred on each one, fewer towards start and end of its series."""
    half, n = width // 2, len(x)
    out = np.empty(n)
    steps = np.arange(-half, half + 1)
    for a in range(0, n, 1 << 16):
        i = np.arange(a, min(n, a + (1 << 16)))
        at = i[:, None] + steps
        lo, hi = np.maximum(start[i], i - half), np.minimum(end[i], i + half + 1)
        w = x[np.clip(at, 0, n - 1)]
        full = (lo == i - half) & (hi == i + half + 1)
        w[~((at >= lo[:, None]) & (at < hi[:, None]))] = np.inf
        if full.all():
            out[i] = np.partition(w, half, axis=1)[:, half]
        else:
            w.sort(axis=1)
            k, r = hi - lo, np.arange(len(i))
            out[i] = (w[r, (k - 1) // 2] + w[r, k // 2]) / 2
    return out


def frozen(x: np.ndarray, new_series: np.ndarray, least: int = FROZEN_READINGS) -> np.ndarray:
    """Whether a reading stands in an unbroken run of at least `least` equal ones."""
    change = new_series.copy()
    change[1:] |= x[1:] != x[:-1]
    run = np.cumsum(change) - 1
    return np.bincount(run)[run] >= least if len(x) else np.zeros(0, bool)


def measures(x: np.ndarray, start: np.ndarray, end: np.ndarray, rule: Rule) -> np.ndarray:
    if not rule.relative:
        return x
    level = local_level(x, start, end)
    with np.errstate(divide="ignore", invalid="ignore"):
        m = np.abs(x - level) / np.abs(level)
    return np.where(level == 0, np.where(x == 0, 0.0, np.inf), m)


def impossible(x: np.ndarray, rule: Rule) -> np.ndarray:
    return (x < rule.least) | (rule.barred & (x == rule.least))


@dataclass
class _Series:
    """Rows of one partition, sorted by source and time, in numpy form."""

    source: pa.Array
    t: np.ndarray
    rec: np.ndarray
    x: np.ndarray
    new_source: np.ndarray = field(init=False)
    instant: np.ndarray = field(init=False)
    first: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.t)
        self.new_source = np.ones(n, bool)
        if n > 1:
            self.new_source[1:] = pc.not_equal(self.source[1:], self.source[:-1]).to_numpy(zero_copy_only=False)
        self.first = self.new_source.copy()
        self.first[1:] |= self.t[1:] != self.t[:-1]
        self.instant = np.cumsum(self.first) - 1

    def join(self, other: _Series) -> _Series:
        cat = np.concatenate
        return _Series(pa.concat_arrays([self.source, other.source]), cat([self.t, other.t]), cat([self.rec, other.rec]), cat([self.x, other.x]))

    def cut(self, rows: np.ndarray) -> _Series:
        return _Series(self.source.take(pa.array(rows)), self.t[rows], self.rec[rows], self.x[rows])

    def judged(self, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """By instant: measure, sure case, start and end of its source."""
        at = np.flatnonzero(self.first)
        x, new = self.x[at], self.new_source[at]
        starts = np.flatnonzero(new)
        segment = np.cumsum(new) - 1
        ends = np.append(starts[1:], len(x))
        start, end = starts[segment], ends[segment]
        return measures(x, start, end, rule), frozen(x, new) | impossible(x, rule), start, end


class _FieldStream:
    """Feeds the sorted readings of one field of one partition through the kernels."""

    def __init__(self, number: int, rule: Rule):
        self.number, self.rule = number, rule
        self.rest: _Series | None = None
        self.base = 0  # ordinal, within its source, of the first instant kept in rest
        self.first_source = True  # rest begins in the first source of the partition
        self.settled = 0  # instants of rest that are done
        self.parts: list[tuple] = []  # of the source that is not finished

    def _rows(self, s: _Series, rows: np.ndarray, kind: int, m: np.ndarray | None = None, sure: np.ndarray | None = None) -> pa.RecordBatch:
        n = len(rows)
        edge = kind in (UNDECIDED, CONTEXT)
        none = pa.nulls(n, pa.float64())
        return pa.record_batch(
            [
                pa.array(np.full(n, kind, np.int8)),
                s.source.take(pa.array(rows)),
                pa.array(np.full(n, self.number, np.int8)),
                pa.array(s.rec[rows]),
                pa.array(s.t[rows]) if edge else pa.nulls(n, pa.int64()),
                pa.array(s.x[rows]) if edge else none,
                none if m is None else pa.array(m),
                pa.nulls(n, pa.bool_()) if sure is None else pa.array(sure),
                pa.array(s.first[rows]),
                pa.array((s.t[rows] // HOUR_MS % 24).astype(np.int8)),
            ],
            schema=_OUT,
        )

    def _fenced(self, m: np.ndarray, first: np.ndarray, hour: np.ndarray) -> np.ndarray:
        """Which measures of one source lie beyond the fences of its merged sketches."""
        rule = self.rule
        own, own_hour = m[first], hour[first]
        hours, bucket, count = sketch(own, own_hour)
        of, case = buckets(own), np.zeros(len(m), bool)
        for h in np.unique(own_hour) if rule.by_hour else (None,):
            here = slice(None) if h is None else own_hour == h
            b, c = merge_hours(bucket, count) if h is None else (bucket[hours == h], count[hours == h])
            with np.errstate(invalid="ignore"):
                low, high = rule.bounds([exact_quantile(b, c, own[here], of[here], q) for q in rule.quantiles])
            beyond = (m > high) | (rule.both_sides & (m < low))
            case |= beyond if h is None else beyond & (hour == h)
        return case

    def _finish(self) -> Iterator[pa.RecordBatch]:
        """All instants of a source that lies in this partition are done: its sketches are whole."""
        if not self.parts:
            return
        parts, self.parts = self.parts, []
        s = parts[0][0]
        rec, first, m, sure, hour = (np.concatenate([p[i] for p in parts]) for i in range(1, 6))
        case = np.flatnonzero(sure | self._fenced(m, first, hour))
        if len(case):
            n = len(case)
            none = pa.nulls(n, pa.float64())
            yield pa.record_batch(
                [pa.array(np.full(n, CASE, np.int8)), pa.array([s] * n, pa.string()), pa.array(np.full(n, self.number, np.int8)), pa.array(rec[case]), pa.nulls(n, pa.int64()), none, none, pa.nulls(n, pa.bool_()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int8())],
                schema=_OUT,
            )

    def feed(self, new: _Series, final: bool) -> Iterator[pa.RecordBatch]:
        s = new if self.rest is None else self.rest.join(new)
        if not len(s.t):
            return
        m, sure, start, end = s.judged(self.rule)
        n = len(m)
        i = np.arange(n)
        ordinal = i - start + np.where(start == 0, self.base, 0)
        last = end == n
        head = (start == 0) & self.first_source
        done = i < (n if final else n - HALO)
        done |= ~last
        fresh = done & ~((start == 0) & (i < self.settled))
        edge_head, near_head = head & (ordinal < HALO), head & (ordinal < 2 * HALO)
        open_tail = final & last & (i >= n - HALO)
        by_row = s.instant

        undecided = np.flatnonzero((fresh & (edge_head | open_tail))[by_row])
        if len(undecided):
            yield self._rows(s, undecided, UNDECIDED)
        context = fresh & near_head & ~edge_head & ~open_tail
        if final:
            context |= last & (i >= n - 2 * HALO) & ~open_tail & ~near_head
        if len(rows := np.flatnonzero(context[by_row])):
            yield self._rows(s, rows, CONTEXT)

        decided = fresh & ~edge_head & ~open_tail
        rows = np.flatnonzero(decided[by_row])
        if len(mine := rows[head[by_row[rows]]] if len(rows) else rows):
            yield self._rows(s, mine, PART, m[by_row[mine]], sure[by_row[mine]])
        inner = rows[~head[by_row[rows]]] if len(rows) else rows
        if len(inner) or self.parts:
            cuts = np.flatnonzero(s.new_source)
            # rows of the carried source come first; a new source finishes the one before it
            group = np.searchsorted(cuts, inner, side="right") - 1
            carried_open = bool(self.parts)
            if carried_open and len(cuts) > 1 and not (len(group) and group[0] == 0):
                yield from self._finish()
            for g in np.unique(group):
                own = inner[group == g] if len(cuts) > 1 else inner
                k = by_row[own]
                self.parts.append((s.source[int(own[0])].as_py(), s.rec[own], s.first[own], m[k], sure[k], (s.t[own] // HOUR_MS % 24).astype(np.int8)))
                if g < len(cuts) - 1:
                    yield from self._finish()
        if final:
            # the last source may go on in the next partition
            for name, rec, first, mm, ss, hh in self.parts:
                k = len(rec)
                yield pa.record_batch(
                    [pa.array(np.full(k, PART, np.int8)), pa.array([name] * k, pa.string()), pa.array(np.full(k, self.number, np.int8)), pa.array(rec), pa.nulls(k, pa.int64()), pa.nulls(k, pa.float64()), pa.array(mm), pa.array(ss), pa.array(first), pa.array(hh)],
                    schema=_OUT,
                )
            self.parts, self.rest = [], None
            return
        begin = int(start[-1])
        keep = max(begin, n - 2 * HALO)
        same = begin == 0
        self.base = keep - begin + (self.base if same else 0)
        self.first_source = self.first_source and same
        self.settled = max(0, n - HALO - keep)
        self.rest = s.cut(np.flatnonzero(by_row >= keep))


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streams = [_FieldStream(i, r) for i, r in enumerate(rules)]

        def push(kept: list[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
            if kept:
                tab = pa.Table.from_batches(kept).combine_chunks()
                col = [tab.column(i).chunk(0) if tab.num_rows else pa.array([], tab.schema.types[i]) for i in range(tab.num_columns)]
                source = pc.cast(col[0], pa.string())
                t, rec = np.asarray(col[1]), np.asarray(col[2])
                xs = [np.asarray(pc.fill_null(c, float("nan")), dtype=float) for c in col[3:]]
            else:
                source, t, rec, xs = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), [np.zeros(0)] * len(rules)
            for stream, x in zip(streams, xs, strict=True):
                keep = np.flatnonzero(~np.isnan(x))
                yield from stream.feed(_Series(source.take(pa.array(keep)), t[keep], rec[keep], x[keep]), final)

        kept, rows = [], 0
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from push(kept, False)
                kept, rows = [], 0
        yield from push(kept, True)

    return run


def _settle_edges(rules: tuple[Rule, ...]):
    """Decides the undecided readings; the rows of one (source, field) lie together in time order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [b for b in batches if b.num_rows]
        if not kept:
            return
        tab = pa.Table.from_batches(kept)
        number = np.asarray(tab.column("field").combine_chunks())
        for f, rule in enumerate(rules):
            rows = np.flatnonzero(number == f)
            if not len(rows):
                continue
            own = tab.take(pa.array(rows)).combine_chunks()
            get = lambda c, own=own: own.column(c).chunk(0)
            s = _Series(pc.cast(get("source"), pa.string()), np.asarray(get("t")), np.asarray(get("rec_id")), np.asarray(get("x")))
            m, sure, _, _ = s.judged(rule)
            open_rows = np.flatnonzero(np.asarray(get("kind")) == UNDECIDED)
            k = s.instant[open_rows]
            stream = _FieldStream(f, rule)
            yield stream._rows(s, open_rows, PART, m[k], sure[k])

    return run


def bucket_of(m: Column) -> Column:
    """The same as `buckets`."""
    log = F.floor(F.log2(F.when((m > 0) & (m < float("inf")), m)) * PER_OCTAVE)
    return F.when(m <= 0, F.lit(-(10**8))).when(m == float("inf"), F.lit(10**8)).otherwise(log).cast("int")


def _by_field(rules: tuple[Rule, ...], of) -> Column:
    return F.element_at(F.array(*(F.lit(of(r)) for r in rules)), F.col("field") + 1)


def _context(rules: tuple[Rule, ...]) -> Column:
    return F.when(_by_field(rules, lambda r: r.by_hour), F.col("hour")).otherwise(F.lit(-1)).cast("int").alias("context")


def fences(parts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(source, field, context, bucket, rank, which): where the order statistics of the quantiles lie,
    by bucket and rank within it. Sketches of hours and partitions are merged by adding their counts."""
    sketches = parts.where("first").groupBy("source", "field", "hour", bucket_of(F.col("m")).alias("bucket")).agg(F.count("*").alias("n"))
    merged = sketches.groupBy("source", "field", _context(rules), "bucket").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("source", "field", "context").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy("source", "field", "context")
    s = merged.select("*", F.sum("n").over(up).alias("upto"), F.sum("n").over(total).alias("all"))
    most = max(len(r.quantiles) for r in rules)
    wanted = []
    for k in range(most):
        q = _by_field(rules, lambda r, k=k: r.quantiles[k] if k < len(r.quantiles) else None)
        at = (F.col("all") - 1) * q
        wanted += [F.struct(F.lit(2 * k).alias("which"), F.floor(at).alias("r")), F.struct(F.lit(2 * k + 1).alias("which"), F.ceil(at).alias("r"))]
    s = s.select("source", "field", "context", "bucket", "n", "upto", F.explode(F.array(*wanted)).alias("w"))
    s = s.where((F.col("upto") > F.col("w.r")) & (F.col("upto") - F.col("n") <= F.col("w.r")))
    return s.select("source", "field", "context", "bucket", (F.col("w.r") - F.col("upto") + F.col("n")).alias("rank"), "w.which")


def exact_fences(parts: DataFrame, fence: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(source, field, context, low, high): bounds from the exact quantiles, whose order statistics are
    taken from their buckets alone. Equal measures are counted first, so that a bucket that holds
    a source's usual value a billion times is one row."""
    key = ["source", "field", "context", "bucket"]
    named = parts.where("first").select("source", "field", _context(rules), bucket_of(F.col("m")).alias("bucket"), "m")
    inside = named.join(fence.select(*key).distinct(), key, "left_semi").groupBy(*key, "m").agg(F.count("*").alias("n"))
    up = Window.partitionBy(*key).orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.select("*", F.sum("n").over(up).alias("upto"))
    found = ranked.join(fence, key).where((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
    at = lambda w: F.max(F.when(F.col("which") == w, F.col("m")))
    most = max(len(r.quantiles) for r in rules)
    q = found.groupBy("source", "field", "context").agg(*((at(2 * k) / 2 + at(2 * k + 1) / 2).alias(f"q{k}") for k in range(most)))
    low, high = F.lit(None).cast("double"), F.lit(None).cast("double")
    for i, r in enumerate(rules):
        lo, hi = r.bounds([F.col(f"q{k}") for k in range(len(r.quantiles))])
        own = F.col("field") == i
        low, high = F.when(own & F.lit(r.both_sides), lo).otherwise(low), F.when(own, hi).otherwise(high)
    return q.select("source", "field", "context", low.alias("low"), high.alias("high"))


def implausible(readings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(source, field, rec_id) of all implausible readings; field is the position of its rule.

    readings has the columns source string, t long, rec_id long and one double per rule.
    Readings of a source are taken in order of t, one per instant; of rows at one instant
    the first delivered value stands for all, and all of them are cases if it is one. Null
    and NaN values are no readings. Rows without source or t are left out. Where both quantiles
    of a fence are zero any positive measure is a case. t is in milliseconds; the hour of a
    reading is that of the UTC day.
    """
    names = readings.columns[3:]
    rows = readings.where(F.col("source").isNotNull() & F.col("t").isNotNull() & F.col("rec_id").isNotNull())
    ordered = rows.repartitionByRange("source", "t").sortWithinPartitions("source", "t", "rec_id")
    done = stage(ordered.select("source", "t", "rec_id", *names).mapInArrow(_scan(rules), _OUT_SQL), "spikes")
    edges = done.where(F.col("kind").isin(UNDECIDED, CONTEXT))
    # a source has a few dozen edge rows per partition it fills
    settled = (
        edges.repartition("source", "field").sortWithinPartitions("source", "field", "t", "rec_id").mapInArrow(_settle_edges(rules), _OUT_SQL)
    )
    parts = stage(done.where(F.col("kind") == PART).unionByName(settled).select("source", "field", "rec_id", "m", "sure", "first", "hour"), "spike-parts")
    # of at most two sources of each partition of the scan; Spark decides by its size how the table is joined
    bounds = exact_fences(parts, fences(parts, rules), rules)
    own = parts.withColumn("context", _context(rules)).join(bounds, ["source", "field", "context"], "left")
    spanning = own.where(F.col("sure") | (F.col("m") > F.col("high")) | F.coalesce(F.col("m") < F.col("low"), F.lit(False)))
    return done.where(F.col("kind") == CASE).select("source", "field", "rec_id").unionByName(spanning.select("source", "field", "rec_id"))
