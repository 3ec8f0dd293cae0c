"""Aggregations of features: what is kept per key, and how it is read.

Each one is a tuple of components with a mergeable operation, so that the same definition
serves a running window, a trailing one (two frames merged) and a key split over many tasks
(the state before a part is merged into it). Second moments are kept as (number, mean, sum of
squared deviations) and merged in pairs, so that they do not depend on where rows are cut.
Those of unknown form are folded in Python. Expressions are SQL text: a text costs one call to
the JVM, a tree of columns one per node.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.duration import Duration, as_duration

Expr = str | Callable[[], Column]

#: Operations whose states are not one more value of their input.
STATEFUL = ("moments", "comoments", "set")


def column(e: Expr) -> Column:
    """An expression of the graph: SQL text, or a function that builds a column."""
    return F.expr(e) if isinstance(e, str) else e()


class Monoid:
    """An aggregate as a few components, each with an operation that combines it.

    lift: components of an update from its input columns. ops: `sum`, `max`, `min`, `first`,
    `last`, `set`, `moments`, `comoments` or `decay` for each. finish: result columns from
    combined components, which are null where no update has been seen.
    fields: suffixes of the result columns; the empty one stands for the aggregate's own name.
    """

    fields: tuple[str, ...] = ("",)
    inputs: tuple[Expr, ...] = ()
    ops: tuple[str, ...] = ()

    def lift(self, x: list[str]) -> list[str]:
        return x

    def finish(self, c: list[str]) -> list[str]:
        return c


_MERGE_BY = {"sum": "sum", "max": "max", "min": "min"}


def centred(op: str, value: str) -> list[str]:
    """The numbers of a component that are measured from a centre near them."""
    return [value] if op == "moments" else [f"({value}).x", f"({value}).y"] if op == "comoments" else []


def _second(agg: Callable[[str], str], op: str, value: str, centre: list[str]) -> str:
    """The state of second moments: number, centre, mean less centre, and squares around the mean, by
    Spark's own stable aggregates."""
    v = centred(op, value)
    n, off = agg(f"count({v[0]})"), [f"({x} - {c})" for x, c in zip(v, centre, strict=True)]
    if op == "moments":
        names, squares = [""], {"m": f"var_pop({off[0]})"}
    else:
        names, squares = ["x", "y"], {"xx": f"var_pop({off[0]})", "yy": f"var_pop({off[1]})", "xy": f"covar_pop({off[0]}, {off[1]})"}
    parts = [f"'c{s}', {agg(f'first({c}, true)')}, 'r{s}', {agg(f'avg({x})')}" for s, c, x in zip(names, centre, off, strict=True)]
    parts += [f"'{k}', {agg(e)} * {n}" for k, e in squares.items()]
    return f"if({n} > 0, named_struct('n', {n}, {', '.join(parts)}), null)"


def over(op: str, value: str, frame: str, centre: list[str] = ()) -> str:
    """A component combined over a frame; value is null on rows that take no part. centre: columns that
    hold the same numbers on all of them."""
    if op in _MERGE_BY:
        return f"{_MERGE_BY[op]}({value}) over ({frame})"
    if op in ("first", "last"):
        return f"{op}({value}, true) over ({frame})"
    if op == "set":
        return f"collect_set({value}) over ({frame})"
    return _second(lambda a: f"{a} over ({frame})", op, value, centre)


def total(op: str, value: str, point: str, centre: list[str] = ()) -> str:
    """A component combined over a group; point orders the rows."""
    if op in _MERGE_BY:
        return f"{_MERGE_BY[op]}({value})"
    if op in ("first", "last"):
        return f"{'min' if op == 'first' else 'max'}_by({value}, if({value} is not null, {point}, null))"
    if op == "set":
        return f"collect_set({value})"
    return _second(lambda a: a, op, value, centre)


def merged(op: str, early: str, late: str) -> str:
    """Two combined components, of earlier and of later updates, as one; both are column names."""
    match op:
        case "sum":
            return f"coalesce({early} + {late}, {early}, {late})"
        case "max":
            return f"greatest({early}, {late})"
        case "min":
            return f"least({early}, {late})"
        case "first":
            return f"coalesce({early}, {late})"
        case "last":
            return f"coalesce({late}, {early})"
        case "set":
            return f"array_union(coalesce({early}, array()), coalesce({late}, array()))"
    return f"case when {early} is null then {late} when {late} is null then {early} else {paired(op, early, late)} end"


def paired(op: str, a: str, b: str) -> str:
    """Two states of second moments as one, neither of them null."""
    n, share = f"({a}.n + {b}.n)", f"({b}.n / ({a}.n + {b}.n))"
    names = [""] if op == "moments" else ["x", "y"]
    # centres are values, so that their difference is exact where they are near each other
    d = [f"(({b}.c{s} - {a}.c{s}) + ({b}.r{s} - {a}.r{s}))" for s in names]
    parts = [f"'c{s}', {a}.c{s}, 'r{s}', {a}.r{s} + {x} * {share}" for s, x in zip(names, d, strict=True)]
    squares = (("m", 0, 0),) if op == "moments" else (("xx", 0, 0), ("yy", 1, 1), ("xy", 0, 1))
    parts += [f"'{k}', {a}.{k} + {b}.{k} + {d[i]} * {d[j]} * {a}.n * {share}" for k, i, j in squares]
    return f"named_struct('n', {n}, {', '.join(parts)})"


@dataclass(frozen=True)
class Sum(Monoid):
    value: Expr
    ops = ("sum",)

    @property
    def inputs(self):
        return (self.value,)

    def finish(self, c):
        return [f"coalesce({c[0]}, 0)"]


@dataclass(frozen=True)
class Count(Monoid):
    ops = ("sum",)

    def lift(self, x):
        return ["1L"]

    def finish(self, c):
        return [f"coalesce({c[0]}, 0L)"]


@dataclass(frozen=True)
class Max(Monoid):
    value: Expr
    ops = ("max",)

    @property
    def inputs(self):
        return (self.value,)


@dataclass(frozen=True)
class Min(Monoid):
    value: Expr
    ops = ("min",)

    @property
    def inputs(self):
        return (self.value,)


@dataclass(frozen=True)
class Extremum(Monoid):
    """The value of the update with the largest (or smallest) order; of equal ones the newer.

    `order` must be numeric for the smallest. Updates without order do not count."""

    value: Expr
    order: Expr
    largest: bool = True
    ops = ("max",)

    @property
    def inputs(self):
        return (self.value, self.order, "_point")

    def lift(self, x):
        order = x[1] if self.largest else f"-({x[1]})"
        return [f"if({x[1]} is not null, named_struct('o', {order}, 'p', {x[2]}, 'v', {x[0]}), null)"]

    def finish(self, c):
        return [f"({c[0]}).v"]


@dataclass(frozen=True)
class First(Monoid):
    value: Expr
    ops = ("first",)

    @property
    def inputs(self):
        return (self.value,)

    def lift(self, x):
        return [f"named_struct('v', {x[0]})"]

    def finish(self, c):
        return [f"({c[0]}).v"]


@dataclass(frozen=True)
class Last(First):
    ops = ("last",)


@dataclass(frozen=True)
class Bounds(Monoid):
    """First and last time and number of the updates."""

    fields = ("time_min", "time_max", "size")
    inputs = ("_ts",)
    ops = ("min", "max", "sum")

    def lift(self, x):
        return [x[0], x[0], "1L"]

    def finish(self, c):
        return [c[0], c[1], f"coalesce({c[2]}, 0L)"]


@dataclass(frozen=True)
class AnyTrue(Monoid):
    """Logical or; false where nothing has been seen."""

    value: Expr
    ops = ("max",)

    @property
    def inputs(self):
        return (self.value,)

    def finish(self, c):
        return [f"coalesce({c[0]}, false)"]


@dataclass(frozen=True)
class SetUnion(Monoid):
    """The distinct values so far, sorted. Its size grows with the values of one key."""

    value: Expr
    ops = ("set",)

    @property
    def inputs(self):
        return (self.value,)

    def finish(self, c):
        return [f"array_sort(coalesce({c[0]}, array()))"]


def _spread_of(squares: str, n: str) -> str:
    return f"greatest({squares} / {n}, 0D)"


@dataclass(frozen=True)
class Moments(Monoid):
    """count, mean, population variance and standard deviation; nulls do not count."""

    value: Expr
    fields = ("_n", "_mean", "_var", "_std")
    ops = ("moments",)

    @property
    def inputs(self):
        return (self.value,)

    def lift(self, x):
        return [f"cast({x[0]} as double)"]

    def finish(self, c):
        s = f"({c[0]})"
        var = _spread_of(f"{s}.m", f"{s}.n")
        return [f"coalesce({s}.n, 0L)", f"{s}.c + {s}.r", f"if({s} is null, null, {var})", f"if({s} is null, null, sqrt({var}))"]


def zscore(x: Column, mean: Column, std: Column) -> Column:
    """(x - mean) / std, and 0 where x is the mean."""
    diff = x - mean
    return F.when(diff == 0, F.lit(0.0)).otherwise(F.try_divide(diff, std))


def _line(s: str, n: str = "n") -> list[str]:
    """Covariance, correlation, slope and intercept of y against x, variances, means; of a state."""
    # what the rounding of the mean alone would give is no spread
    x, y = (f"({s}.c{k} + {s}.r{k})" for k in "xy")
    some = [f"{s}.{k}{k} / {s}.{n} > 1e-29D * {v} * {v}" for k, v in (("x", x), ("y", y))]
    slope = f"if({some[0]}, {s}.xy / {s}.xx, null)"
    corr = f"if({some[0]} and {some[1]}, {s}.xy / sqrt({s}.xx) / sqrt({s}.yy), null)"
    var = lambda k: f"if({s} is null, null, {_spread_of(f'{s}.{k}', f'{s}.{n}')})"
    return [f"{s}.xy / {s}.{n}", f"greatest(-1D, least(1D, {corr})) + if({corr} is null, null, 0D)", slope, f"{y} - {slope} * {x}", var("xx"), var("yy")]


def _both(x: str, y: str) -> str:
    return f"(cast({x} as double) + cast({y} as double)) is not null"


@dataclass(frozen=True)
class Correlation(Monoid):
    """Covariance, correlation, least squares line and variances of pairs (y against x); null in
    either leaves the pair out."""

    x: Expr
    y: Expr
    fields = ("_cov", "_corr", "_slope", "_intercept", "_var_x", "_var_y")
    ops = ("comoments",)

    @property
    def inputs(self):
        return (self.x, self.y)

    def lift(self, x):
        return [f"if({_both(*x)}, named_struct('x', cast({x[0]} as double), 'y', cast({x[1]} as double)), null)"]

    def finish(self, c):
        return _line(f"({c[0]})")

    def swap(self) -> Correlation:
        """The same of x against y."""
        return Correlation(self.y, self.x)

    def scaled(self, by_x: float, by_y: float = 1.0) -> Correlation:
        """The same of pairs whose sides are multiplied; -1 negates one."""
        times = lambda e, by: (lambda: column(e) * F.lit(float(by))) if by != 1 else e
        return Correlation(times(self.x, by_x), times(self.y, by_y))

    def negate(self) -> Correlation:
        """The same of x against -y."""
        return self.scaled(1.0, -1.0)


def distance_metric(correlation: Column) -> Column:
    """sqrt((1 - correlation) / 2), held within 0 and 1."""
    return F.sqrt(F.greatest(F.lit(0.0), (1 - correlation) / 2))


#: Time is cut into segments of at most so many decay lengths, within which exp() stays finite.
SEGMENT = 300


@dataclass(frozen=True)
class Decay(Monoid):
    """Sum that decays by exp(-dt / length), read at the time of the reading row.

    An update more than SEGMENT / 2 lengths older than the newest one counts as nothing.

    The state of a decay is a row of numbers of the newest update's time: `state` names them.
    An update is such a state too. In a segment weighted sums of `terms` are kept, around
    `centres`, and turned into the state by `of_sums`."""

    value: Expr
    length: Duration
    ops = ("decay",)
    state = ("s",)
    centred = ()

    @classmethod
    def of(cls, value: Expr, length: Duration | str):
        return cls(value, as_duration(length))

    @property
    def inputs(self):
        return (self.value,)

    def lift(self, x):
        return [f"cast({x[0]} as double)"]

    def terms(self, v: list[str], centre: list[str]) -> list[str]:
        return [v[0]]

    def moved(self, s: list[str], by: list[str]) -> list[str]:
        """Sums around centres that lie `by` below the old ones."""
        return s

    def of_sums(self, s: list[str], centre: list[str]) -> list[str]:
        return s

    def fading(self) -> tuple[bool, ...]:
        """Which numbers of the state fade with time."""
        return (True,)

    def merge(self, a: list[str], b: list[str]) -> list[str]:
        """Two states of one time."""
        return [f"{a[0]} + {b[0]}"]

    def finish(self, c):
        return [f"coalesce({c[0]}, 0D)"]


def _less(squares: str, a: str, b: str, weight: str, floor: str | None) -> str:
    """Squares around the mean from those around a centre; what is lost in rounding counts as none."""
    left = f"({squares} - try_divide({a} * {b}, {weight}))"
    return f"if({left} > 1e-13D * {floor}, {left}, 0D)" if floor else left


class _Centred(Decay):
    """Decayed weight, mean and squares around it; the mean as centre and rest."""

    names: tuple[str, ...] = ()
    pairs: tuple[tuple[int, int], ...] = ()

    @property
    def _at(self) -> tuple[int, int]:
        """Where the rests and the squares begin in the state."""
        return 1 + len(self.names), 1 + 2 * len(self.names)

    def _off(self, v: list[str], centre: list[str]) -> list[str]:
        r, _ = self._at
        return [f"(({v[1 + i]} - {c}) + {v[r + i]})" for i, c in enumerate(centre)]

    def terms(self, v, centre):
        d, (_, q) = self._off(v, centre), self._at
        return [v[0], *(f"{v[0]} * {x}" for x in d), *(f"({v[q + k]} + {v[0]} * {d[i]} * {d[j]})" for k, (i, j) in enumerate(self.pairs))]

    def moved(self, s, by):
        n = len(self.names)
        squares = [f"({s[1 + n + k]} + {s[1 + i]} * {by[j]} + {s[1 + j]} * {by[i]} + {s[0]} * {by[i]} * {by[j]})" for k, (i, j) in enumerate(self.pairs)]
        return [s[0], *(f"({s[1 + i]} + {s[0]} * {by[i]})" for i in range(n)), *squares]

    def of_sums(self, s, centre):
        n = len(self.names)
        squares = [_less(s[1 + n + k], s[1 + i], s[1 + j], s[0], s[1 + n + k] if i == j else None) for k, (i, j) in enumerate(self.pairs)]
        return [s[0], *centre, *(f"try_divide({s[1 + i]}, {s[0]})" for i in range(n)), *squares]

    def fading(self):
        n = len(self.names)
        return (True, *(False,) * (2 * n), *(True,) * len(self.pairs))

    def merge(self, a, b):
        n, (r, q) = len(self.names), self._at
        share = f"try_divide({b[0]}, {a[0]} + {b[0]})"
        d = [f"(({b[1 + i]} - {a[1 + i]}) + ({b[r + i]} - {a[r + i]}))" for i in range(n)]
        squares = [f"{a[q + k]} + {b[q + k]} + {d[i]} * {d[j]} * {a[0]} * coalesce({share}, 0D)" for k, (i, j) in enumerate(self.pairs)]
        return [f"{a[0]} + {b[0]}", *a[1 : 1 + n], *(f"{a[r + i]} + {d[i]} * coalesce({share}, 1D)" for i in range(n)), *squares]


@dataclass(frozen=True)
class DecayedMoments(_Centred):
    """Decayed weight, mean, population variance and standard deviation of a value."""

    fields = ("_w", "_mean", "_var", "_std")
    ops = ("decay",) * 4
    state = ("w", "c", "r", "m")
    centred = (1,)
    names = ("",)
    pairs = ((0, 0),)

    def lift(self, x):
        v = f"cast({x[0]} as double)"
        return [f"if({v} is null, null, 1D)", v, *(f"if({v} is null, null, 0D)",) * 2]

    def finish(self, c):
        var = _spread_of(c[3], c[0])
        return [f"coalesce({c[0]}, 0D)", f"{c[1]} + {c[2]}", f"if({c[0]} > 0, {var}, null)", f"if({c[0]} > 0, sqrt({var}), null)"]


@dataclass(frozen=True)
class DecayedCorrelation(_Centred):
    """Decayed covariance, correlation, least squares line of y against x, and variances."""

    value: Expr
    y: Expr
    length: Duration
    fields = Correlation.fields
    ops = ("decay",) * 8
    state = ("w", "cx", "cy", "rx", "ry", "xx", "yy", "xy")
    centred = (1, 2)
    names = ("x", "y")
    pairs = ((0, 0), (1, 1), (0, 1))

    @staticmethod
    def of(x: Expr, y: Expr, length: Duration | str) -> DecayedCorrelation:
        return DecayedCorrelation(x, y=y, length=as_duration(length))

    @property
    def inputs(self):
        return (self.value, self.y)

    def lift(self, x):
        numbers = ["1D", f"cast({x[0]} as double)", f"cast({x[1]} as double)", *["0D"] * 5]
        return [f"if({_both(*x)}, {v}, null)" for v in numbers]

    def finish(self, c):
        s = "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in zip(self.state, c, strict=True)) + ")"
        return [f"if({c[0]} > 0, {e}, null)" for e in _line(s, "w")]


@dataclass(frozen=True)
class Fold(Monoid):
    """Any monoid: `combine(state, value)` in point order, first value as is, `zero` where none.

    Runs in Python, one key after the other with one state at a time; the state is of Spark
    type `kind`. combine must be associative; it need not be commutative."""

    value: Expr
    zero: Any
    combine: Callable[[Any, Any], Any]
    kind: str
    ops = ("last",)

    @property
    def inputs(self):
        return (self.value,)

    def lift(self, x):
        return [f"named_struct('v', {x[0]})"]

    def finish(self, c):
        if self.zero is None:
            return [f"({c[0]}).v"]
        zero = "'" + self.zero.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(self.zero, str) else str(self.zero).lower()
        return [f"coalesce(({c[0]}).v, cast({zero} as {self.kind}))"]


DECAYS = ("10min", "1h", "2h", "1d", "3d", "14d")
