"""From the graph to DataFrames.

Every event is a DataFrame of its columns and of hidden ones: `_ts` (epoch milliseconds),
`_off` (how far a label looks ahead), `_src`, `_ord` (rank within the source) and, where one
source row has several outputs, `_sub`. Points are ordered by (_ts - _off, larger _off first,
_src, _ord). A lookup brings the events and the updates of all features it reads, whatever
their offsets, under one shuffle on the key, and evaluates every window in one order. Updates
that are the events themselves ride on the rows of the events, or are copies of these rows made
in the same scan; only updates of other events are a union.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import monoids as M
from tidemark.functions.duration import INFINITE, LONG_MAX, LONG_MIN, ZERO, Duration
from tidemark.functions.monoids import column
from tidemark.plans import graph as G
from tidemark.session import stage

HIDDEN = ("_ts", "_off", "_src", "_ord")
#: Order of the rows of one point: the state of earlier spans, updates seen after it, the event, updates seen before it.
CARRY, POST, PROBE, PRE = -1, 0, 1, 2
#: A hot key is cut into at most so many spans (a power of two), at quantiles of its times.
SPANS = 256
#: What a row of an input takes at least on average, for telling from Spark's size estimate that no key can be hot.
ROW_BYTES = 8
ALL_BEFORE = "rows between unbounded preceding and current row"


class PlanError(ValueError):
    """The graph and the inputs do not fit together."""


@dataclass(frozen=True)
class TimeBound:
    """lower <= ts of outputs; ts of inputs < upper. None for no bound."""

    lower: int | None = None
    upper: int | None = None

    def __post_init__(self) -> None:
        if self.lower is not None and self.upper is not None and self.lower >= self.upper:
            raise ValueError("the lower bound must lie below the upper one")


def quoted(name: str) -> str:
    return f"`{name}`"


@dataclass
class Rows:
    """A lowered event: its columns, and whether it has the column _sub."""

    df: DataFrame
    payload: tuple[str, ...]
    sub: bool
    extra: tuple[str, ...] = ()  # components that rows carry up to a lookup further on

    @property
    def hidden(self) -> list[str]:
        return [*HIDDEN, *(["_sub"] if self.sub else []), *self.extra]

    def with_sub(self) -> DataFrame:
        return self.df if self.sub else self.df.select("*", F.expr(f"{_NO_SUB} as _sub"))


_NO_SUB = "cast(array() as array<int>)"


def adjusted(offset: Duration) -> str:
    return f"{LONG_MIN + 1}L - 1L" if offset == INFINITE else f"_ts - {offset.ms}L"


class Engine:
    """Lowers graphs over bound inputs: a DataFrame for each source name.

    hot_rows: keys with more rows than this in one lookup are cut into spans of time, at
    quantiles of the key's rows, which run as tasks of their own. Which keys are hot is found
    in the plan itself; nothing runs while the graph is lowered, but that a lookup over the
    result of another one first writes that result to the shared folder, as it is read more
    than once. Where Spark's estimate of the inputs' size leaves room for no hot key, the plan
    does not look for any. Results do not depend on where keys are cut. None leaves each key
    to one task, which sorts and spills; so do folds of unknown form, which are not cut.
    """

    def __init__(self, spark: SparkSession, inputs: dict[str, DataFrame], bound: TimeBound | None = None, hot_rows: int | None = None):
        self.spark, self.inputs, self.bound, self.hot_rows = spark, inputs, bound or TimeBound(), hot_rows
        self._sizes: dict[str, int] = {}
        self._carried: list[tuple[G.Event, list[str], list[Column]]] = []
        self._count = 0

    # --- running --------------------------------------------------------------------------

    def validate(self, node) -> None:
        sources = G.sources_of(node)
        twice = sorted(n for n, s in sources.items() if len(s) > 1)
        if twice:
            raise PlanError(f"different sources of one name: {', '.join(twice)}")
        unknown = sorted(set(sources) - set(self.inputs))
        if unknown:
            raise PlanError(f"no input for: {', '.join(unknown)}")

    def run(self, node, ordered: bool = False, limit: int | None = None, time: str | None = None) -> DataFrame:
        """The columns of an event or labelled event; in point order if asked, or if there is a limit.

        time: also give the event's time under this name.
        """
        self.validate(node)
        rows = self.labeled(node) if isinstance(node, G.LabeledEvent) else self.event(node, ZERO)
        df = rows.df
        if self.bound.lower is not None:
            df = df.where(F.col("_ts") >= self.bound.lower)
        if ordered or limit is not None:
            df = df.orderBy("_ts", "_src", "_ord", *(["_sub"] if rows.sub else []))
        if limit is not None:
            df = df.limit(limit)
        return df.selectExpr(*([f"_ts as {quoted(time)}"] if time else []), *map(quoted, rows.payload))

    # --- events ---------------------------------------------------------------------------

    def event(self, node: G.Event, offset: Duration) -> Rows:
        rows = self._event(node, offset)
        for event, values, built in self._carried:
            if event == node and not set(_names(values)) & set(rows.extra):
                df = (rows.df.select("*", *built) if built else rows.df).selectExpr("*", *values)
                rows = Rows(df, rows.payload, rows.sub, (*rows.extra, *_names(values)))
        return rows

    def _event(self, node: G.Event, offset: Duration) -> Rows:
        match node:
            case G.Empty(schema=schema):
                df = self.spark.createDataFrame([], schema)
                return Rows(df.selectExpr("*", "0L as _ts", "0L as _off", "'' as _src", "0L as _ord"), tuple(df.columns), False)
            case G.Source():
                return self._source(node, offset)
            case G.Lookup():
                return self._lookup(node, offset)
            case G.Keyed(event=inner, keys=keys):
                rows = self.event(inner, offset)
                names = [n for n, _ in keys]
                kept = [c for c in rows.payload if c not in names]
                return Rows(rows.df.select(*(column(e).alias(n) for n, e in keys), *map(quoted, kept), *rows.hidden), (*names, *kept), rows.sub, rows.extra)
            case G.Mapped(event=inner, exprs=exprs):
                rows = self.event(inner, offset)
                return Rows(rows.df.select(*(column(e).alias(n) for n, e in exprs), *rows.hidden), tuple(n for n, _ in exprs), rows.sub, rows.extra)
            case G.Filtered(event=inner, condition=condition):
                rows = self.event(inner, offset)
                return Rows(rows.df.where(column(condition)), rows.payload, rows.sub, rows.extra)
            case G.Timed(event=inner, name=name):
                rows = self.event(inner, offset)
                kept = [c for c in rows.payload if c != name]
                return Rows(rows.df.selectExpr(*map(quoted, kept), f"_ts as {quoted(name)}", *rows.hidden), (*kept, name), rows.sub, rows.extra)
            case G.Exploded(event=inner, items=items, name=name, position=position):
                rows = self.event(inner, offset)
                df = rows.with_sub().select("*", F.posexplode(column(items)).alias("_pos", "_item"))
                kept = [c for c in rows.payload if c not in (name, position)]
                at = [f"_pos as {quoted(position)}"] if position else []
                df = df.selectExpr(*map(quoted, kept), *at, f"_item as {quoted(name)}", *HIDDEN, "concat(_sub, array(_pos)) as _sub")
                return Rows(df, (*kept, *([position] if position else []), name), True)
            case G.Concat(left=left, right=right):
                sides, names = [], []
                for k, side in enumerate((left, right)):
                    rows = self.event(side, offset)
                    names.append(rows.payload)
                    sides.append(rows.with_sub().selectExpr(*map(quoted, rows.payload), *HIDDEN, f"concat(array({k}), _sub) as _sub"))
                lacking = isinstance(left, G.Empty) or isinstance(right, G.Empty)
                return Rows(sides[0].unionByName(sides[1], allowMissingColumns=lacking), tuple(dict.fromkeys((*names[0], *names[1]))), True)
        raise TypeError(type(node))

    def _source(self, node: G.Source, offset: Duration) -> Rows:
        df = self.inputs[node.name]
        names = node.columns or tuple(c for c in df.columns if not c.startswith("_"))
        order = column(node.order).cast("long") if node.order is not None else F.monotonically_increasing_id()
        off = LONG_MAX if offset == INFINITE else offset.ms
        source = node.name.replace("'", "\\'")
        df = df.select(*map(quoted, names), column(node.ts).cast("long").alias("_ts"), F.expr(f"{off}L as _off"), F.expr(f"'{source}' as _src"), order.alias("_ord"))
        if self.bound.upper is not None:
            df = df.where(F.col("_ts") < self.bound.upper)
        return Rows(df, tuple(names), False)

    # --- lookups --------------------------------------------------------------------------

    def _may_be_hot(self, below: G.Event, bases: list) -> bool:
        """Whether the sources of a lookup may have enough rows for a hot key, by Spark's estimate of
        their size. This runs nothing."""
        if not self.hot_rows:
            return False
        names = {n for e in (below, *(b.event for b, _, _ in bases)) for n in G.sources_of(e)}
        for n in names - set(self._sizes):
            self._sizes[n] = int(str(self.inputs[n]._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        return sum(self._sizes[n] for n in names) > self.hot_rows * ROW_BYTES

    def _chain(self, node: G.Event) -> tuple[G.Event, list[tuple[Any, Duration, bool]]]:
        """Lookups on one key that follow each other, as one: (event below, [(feature, offset, after)])."""
        asked: list[tuple[Any, Duration, bool]] = []
        keys = getattr(node, "keys", None)
        while isinstance(node, G.Lookup) and tuple(n for n, _ in node.keys) == tuple(n for n, _ in keys):
            asked.insert(0, (node.feature, ZERO, node.after))
            node = node.event
        return node, asked

    def _lookup(self, node: G.Lookup, offset: Duration) -> Rows:
        below, asked = self._chain(node)
        return self._attach(below, node.key_names, asked, offset)

    def labeled(self, node: G.LabeledEvent) -> Rows:
        below, asked = self._chain(node.event)
        rows = self._attach(below, node.event.key_names, [*asked, (node.label, ZERO, True)], ZERO)
        df, payload = rows.df, rows.payload
        for kind, step in node.steps:
            if kind == "filter":
                df = df.where(column(step))
            else:
                df, payload = df.select(*(column(e).alias(n) for n, e in step), *rows.hidden), tuple(n for n, _ in step)
        return Rows(df, payload, rows.sub, rows.extra)

    def _attach(self, below: G.Event, keys: tuple[str, ...], asked: list, offset: Duration) -> Rows:
        bases = list(dict.fromkeys(b for tree, d, after in asked for b in _bases(tree, d, after)))
        plan = _Lookup(self, below, keys, bases, offset)
        df = plan.rows()
        df = df.where(f"_kind = {PROBE}") if plan.mixed else df
        return _results(df, plan, asked, plan.probe, keys)


class _Lookup:
    """The rows and windows of one lookup on the way."""

    def __init__(self, engine: Engine, below: G.Event, keys: tuple[str, ...], bases: list, offset: Duration):
        self.engine, self.below, self.keys, self.bases, self.offset = engine, below, keys, bases, offset
        branches: dict[tuple, int] = {}
        for b, d, after in bases:
            branches.setdefault((b.event, d, after), len(branches))
        self.states = [_State(j, b, branches[b.event, d, a], d, offset + d) for j, (b, d, a) in enumerate(bases)]
        folds = {s.branch for s in self.states if s.folds}
        # features of constants alone keep no state, so that there is nothing to carry from span to span
        self.split = bool(self.states) and not folds and engine._may_be_hot(below, bases)
        self.by_key = [f"_k{i}" for i in range(len(keys))] or ["_k0"]
        # how the updates of each branch come: on the events' own rows, as copies of them, or as rows of their own
        self.own: dict[int, list] = {}
        self.copies: dict[int, tuple[list, Duration, bool]] = {}
        self.others: dict[int, tuple[G.Keyed, Duration, bool]] = {}
        self.carried: dict[int, G.Keyed] = {}  # branches of events that the events of the lookup are made of
        self.after = {n: after for (_, _, after), n in branches.items()}
        for (event, d, after), n in branches.items():
            if len(event.key_names) != len(keys):
                raise PlanError(f"a feature keyed by {event.key_names} is read by events keyed by {keys}")
            conditions = None if n in folds else _riding(event, below)
            if conditions is None and n not in folds and _derived(below, keys, event):
                conditions = []
                self.carried[n] = event
            if conditions is None:
                self.others[n] = (event, d, after)
            elif d == ZERO and below.amplification.at_most_one:
                self.own[n] = conditions
            else:
                self.copies[n] = (conditions, d, after)
        self.mixed = bool(self.copies or self.others or self.split)
        engine._count += 1
        self.prefix = f"_y{engine._count}"
        self.sources: dict[str, str] = {}
        own = []
        for n, event in self.carried.items():
            values: list[str] = []
            for s in (s for s in self.states if s.branch == n):
                for x in s.inputs(False):
                    text, name = x.rsplit(" as ", 1)
                    values.append(f"{text} as {self.prefix}{name}")
            own.append((event, values, [c for s in self.states if s.branch == n for c in s.built()]))
        engine._carried += own
        probe = engine.event(below, offset)
        for x in own:
            engine._carried.remove(x)
        brought = {name for _, values, _ in own for name in _names(values)}
        self.probe = Rows(probe.df, probe.payload, probe.sub, tuple(c for c in probe.extra if c not in brought))
        self.sub = probe.sub

    def mask(self, s: _State) -> str:
        """Which rows are updates of a state."""
        if s.branch in self.own:
            conditions = [f"_kind = {PROBE}"] if self.mixed else []
            conditions += [f"_c{s.branch}"] if self.own[s.branch] else []
            return " and ".join(conditions) or "true"
        return f"_branch = {s.branch}"

    def condition(self, s: _State) -> str:
        """Which of the events are updates of a state, before there are other rows."""
        return f"_c{s.branch}" if self.conditions(s.branch) else "true"

    def conditions(self, n: int) -> list:
        return self.own[n] if n in self.own else self.copies[n][0]

    # --- rows -----------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        self.order = ["_adj", "_off desc", "_src", "_ord", "_kind"]
        df, cols = self._events()
        prepared = any(s.within is not None or s.decays for s in self.states)
        if not self.others:
            # what an update amounts to does not depend on other rows, so it is told before copies are made
            self.order += ["_sub"] if self.sub else []
            df = df.repartition(*self.by_key) if prepared and not self.split else df
            df, cols = self._trailing(df, cols, self.condition)
            if not self.split:
                order = self.order
                df, cols = self._decayed(df, cols, self.condition)
                if self.copies and order != self.order:  # copies stand in other segments
                    cols, self.order = [c for c in cols if c in order or c not in self.order], order
        df, cols = self._copied(df, cols)
        if self.others:
            df, cols = self._union(df, cols)
            self.order += ["_sub"] if self.sub else []
            # one shuffle on the key serves all windows, also those over a part of a key
            df = df.repartition(*self.by_key) if prepared and not self.split else df
            df, cols = self._trailing(df, cols, self.mask)
            if not self.split:
                df, cols = self._decayed(df, cols, self.mask)
        if self.split:
            df, cols = self._spread(df, cols)
            df, cols = self._decayed(df, cols, self.mask)
        so_far = f"partition by {', '.join(self.by_key)} order by {', '.join(self.order)} {ALL_BEFORE}"
        if centres := list(dict.fromkeys(c for s in self.states for c in s.centres(self.mask(s), so_far))):
            df = df.selectExpr(*cols, *centres)
            cols = [*cols, *_names(centres)]
        windows = [w for s in self.states for w in s.windows(self.mask(s), self.frame(s), self.split)]
        if windows:
            df = df.selectExpr(*cols, *windows)
            cols = [*cols, *_names(windows)]
        if self.split and (merges := [m for s in self.states for m in s.merges()]):
            df = df.selectExpr(*cols, *merges)
        return df

    def frame(self, s: _State) -> str:
        to = "1 preceding" if s.branch in self.own and not self.after[s.branch] else "current row"
        return f"partition by {', '.join(self.by_key)} order by {', '.join(self.order)} rows between unbounded preceding and {to}"

    def _events(self) -> tuple[DataFrame, list[str]]:
        """The events, with the components of the updates that they are."""
        p = self.probe
        riding = [*self.own, *self.copies]
        packed = "named_struct(" + ", ".join(f"'{c}', {quoted(c)}" for c in p.payload) + ")" if p.payload else "named_struct('_', 0)"
        keys = [f"{quoted(k)} as _k{i}" for i, k in enumerate(self.keys)] or ["0 as _k0"]
        conditions = []
        for n in riding:
            if found := self.conditions(n):
                both = column(found[0])
                for c in found[1:]:
                    both = both & column(c)
                conditions.append(F.coalesce(both, F.lit(False)).alias(f"_c{n}"))
        values, built = self._values(riding, p.sub)
        fixed = [f"{packed} as _p", *keys, *p.hidden, f"{adjusted(self.offset)} as _adj", f"{PROBE} as _kind", "-1 as _branch"]
        df = (p.df.select("*", *built) if built else p.df).select(*map(F.expr, fixed), *conditions, *map(F.expr, values))
        return df, ["_p", *self.by_key, *p.hidden, "_adj", "_kind", "_branch", *(f"_c{n}" for n in riding if self.conditions(n)), *_names(values)]

    def _values(self, branches: list[int], sub: bool) -> tuple[list[str], list[Column]]:
        """The components of the updates of branches, one column for each expression, and what they are built from."""
        seen: dict[str, str] = {}
        own = [s for n in branches for s in self.states if s.branch == n]
        for s in own:
            for x in s.inputs(sub):
                text, name = x.rsplit(" as ", 1)
                if self.split:  # each state keeps totals under its own names
                    seen[f"{self.prefix}{name}" if s.branch in self.carried else f"{text} /* {name} */"] = name
                elif s.branch in self.carried:
                    of = f"{self.carried[s.branch].key_names} {list(self.carried.values()).index(self.carried[s.branch])} {text}"
                    s.known[name] = seen.setdefault(of, name)
                    self.sources.setdefault(of, f"{self.prefix}{name}")
                else:
                    s.known[name] = seen.setdefault(text, name)
        return [f"{self.sources.get(text, text)} as {name}" for text, name in seen.items()], [c for s in own if s.branch not in self.carried for c in s.built()]

    def _copied(self, df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
        """The events together with copies of them at the times from which labels see them."""
        if not self.copies:
            return df, cols
        kinds = [f"named_struct('k', {PROBE}, 'b', -1, 'o', {self._off(self.offset)}, 'a', 0L)"]
        for n, (_, d, after) in self.copies.items():
            o = self.offset + d
            kinds.append(f"named_struct('k', {POST if after else PRE}, 'b', {n}, 'o', {self._off(o)}, 'a', {'null' if o == INFINITE else f'{o.ms}L'})")
        df = df.selectExpr(*cols, f"explode(array({', '.join(kinds)})) as _e")
        wanted = " or ".join(["_e.b = -1", *(f"(_e.b = {n} and _c{n})" if self.copies[n][0] else f"_e.b = {n}" for n in self.copies)])
        adj = f"case when _e.b = -1 then _adj when _e.a is null then {adjusted(INFINITE)} else _ts - _e.a end as _adj"
        new = {"_p": "if(_e.b = -1, _p, null) as _p", "_off": "_e.o as _off", "_adj": adj, "_kind": "_e.k as _kind", "_branch": "_e.b as _branch"}
        return df.where(wanted).selectExpr(*(new.get(c, c) for c in cols)), cols

    def _union(self, df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
        """The events together with the updates that are other events."""
        lowered: dict[tuple, Rows] = {}
        parts = []
        for n, (event, d, after) in self.others.items():
            if (event, d) not in lowered:
                lowered[event, d] = self.engine.event(event, self.offset + d)
            rows = lowered[event, d]
            self.sub |= rows.sub
            part = rows.df
            for s in (s for s in self.states if s.branch == n):
                part = s.folded(part, event.key_names, rows)
            values, built = self._values([n], rows.sub)
            keys = [f"{quoted(k)} as _k{i}" for i, k in enumerate(event.key_names)] or ["0 as _k0"]
            fixed = [*keys, *rows.hidden, f"{adjusted(self.offset + d)} as _adj", f"{POST if after else PRE} as _kind", f"{n} as _branch"]
            part = (part.select("*", *built) if built else part).selectExpr(*fixed, *values)
            parts.append((part, rows.sub))
            cols = [*cols, *_names(values)]
        if self.sub:
            if not self.probe.sub:
                df = df.selectExpr("*", f"{_NO_SUB} as _sub")
                cols = [*cols, "_sub"]
            parts = [(part if has else part.selectExpr("*", f"{_NO_SUB} as _sub"), True) for part, has in parts]
        for part, _ in parts:
            df = df.unionByName(part, allowMissingColumns=True)
        return df, cols

    @staticmethod
    def _off(d: Duration) -> str:
        return f"{LONG_MAX if d == INFINITE else d.ms}L"

    # --- trailing windows -----------------------------------------------------------------

    def _trailing(self, df: DataFrame, cols: list[str], mask_of: Callable) -> tuple[DataFrame, list[str]]:
        """The components over the trailing window of each update, in a struct per aggregate.

        Time is cut into blocks as wide as the window. A window is the end of the block before
        its own, from its first update on, and the start of its own block up to the update. The
        starts are running aggregates in point order. For the ends each update also stands in
        the next block, at the time at which it leaves a window; running aggregates against
        the order of time over these give, at each update, all of them that have not left.
        So a row costs the same however many rows its window has; nothing is subtracted; and a
        key is cut at the blocks.
        """
        widths: dict[int, list[_State]] = {}
        for s in self.states:
            if s.within is not None:
                widths.setdefault(s.within.ms, []).append(s)
        for w, states in widths.items():
            used = {s.column(i, k) for s in self.states if s not in states for i, (_, m) in enumerate(s.aggs) for k in range(len(m.ops))}
            dead = {s.column(i, k) for s in states for i, (_, m) in enumerate(s.aggs) for k in range(len(m.ops))} - used
            masks = {s.number: mask_of(s) for s in states}
            point = "named_struct('t', _ts, 's', _src, 'o', _ord" + (", 'u', _sub)" if self.sub else ")")
            if w:
                some = " or ".join(sorted(set(masks.values())))
                df = df.selectExpr(*cols, f"explode(if({some}, array(0, 1), array(0))) as _m")
                blank = lambda c: f"if(_m = 0, {c}, null) as {c}" if c == "_p" else c
                df = df.selectExpr(*map(blank, cols), "_m", f"(_ts - pmod(_ts, {w}L)) div {w}L + _m as _blk", f"_ts + _m * {w}L as _at")
                cols = [*cols, "_m"]
                block = ", ".join((*self.by_key, "_blk"))
            else:
                df = df.selectExpr(*cols, "0 as _m", "_ts as _at")
                cols = [*cols, "_m"]
                block = ", ".join((*self.by_key, "_at"))
            rank = ["_at", "_m", "_src", "_ord", *(["_sub"] if self.sub else [])]
            late = f"partition by {block} order by {', '.join(rank)} {ALL_BEFORE}"
            early = f"partition by {block} order by {', '.join(f'{c} desc' for c in rank)} {ALL_BEFORE}"
            turned = {"first": "last", "last": "first"}
            steps: list[list[str]] = [[], [], [], []]  # centres and aggregates of the starts, then of the ends
            wholes = []
            for s in states:
                for i, (_, m) in enumerate(s.aggs):
                    parts = []
                    for k, op in enumerate(m.ops):
                        v = s.column(i, k)
                        # the last update of a window is the row's own one, so that only other operations look back
                        sides = [(0, "q", late, op)] + ([(1, "e", early, turned.get(op, op))] if w and op != "last" else [])
                        for side, letter, frame, own in sides:
                            x, c = f"if(_m = {side} and {masks[s.number]}, {v}, null)", f"{s.whole(i)}{letter}{k}"
                            centre = [f"{c}k{j}" for j in range(len(M.centred(op, x)))]
                            steps[2 * side] += [f"first({y}, true) over ({frame}) as {n}" for y, n in zip(M.centred(op, x), centre, strict=True)]
                            steps[2 * side + 1].append(f"{M.over(own, x, frame, centre)} as {c}")
                        q, e = f"{s.whole(i)}q{k}", f"{s.whole(i)}e{k}"
                        parts.append(f"'f{k}', {M.merged(op, e, q) if len(sides) > 1 else q}")
                    wholes.append(f"if({masks[s.number]}, named_struct({', '.join(parts)}, 'p', {point}), null) as {s.whole(i)}")
            kept = [c for c in cols if c not in dead and c != "_m"]
            for step in steps:
                if step:
                    df = df.selectExpr("*", *step)
            df = df.where("_m = 0").selectExpr(*kept, *wholes)
            cols = [*kept, *_names(wholes)]
        return df, cols

    # --- decayed sums ---------------------------------------------------------------------

    def _decayed(self, df: DataFrame, cols: list[str], mask_of: Callable) -> tuple[DataFrame, list[str]]:
        """The state of every decayed sum at each of its updates, in the struct `<whole>d`.

        Time is cut into segments, within which exp() stays finite; a state is what its segment
        has so far and what the one before came to. Segments of longer decays are made of those
        of shorter ones, so that one sort is in the order of all of them and of the points.
        """
        found = [(s, i, m) for s in self.states for i, m in s.decays]
        if not found:
            return df, cols
        lengths = sorted({m.length.ms for _, _, m in found})
        width: dict[int, int] = {}
        last = None
        for n in lengths:
            last = n * M.SEGMENT if last is None else last * max(1, n * M.SEGMENT // last)
            width[n] = last
        # the time of rows that all come before any event is that of the updates themselves
        ends = self.offset == INFINITE or any(s.total == INFINITE for s, _, _ in found)
        at = f"if(_adj = {adjusted(INFINITE)}, _ts, _adj)" if ends else "_adj"
        wide = sorted(set(width.values()), reverse=True)
        seg = {w: f"_g{j}" for j, w in enumerate(wide)}
        df = df.selectExpr(*cols, *(f"({at} - pmod({at}, {w}L)) div {w}L as {seg[w]}" for w in wide))
        plain, cols = cols, [*cols, *seg.values()]
        key = ", ".join(self.by_key)
        order = [*seg.values(), *self.order]
        self.order = order
        if any(m.centred for _, _, m in found):
            # windows without an order of their own are met by this sort too
            df = df.sortWithinPartitions(*self.by_key, *(F.expr(o.removesuffix(" desc")).desc() if o.endswith(" desc") else F.col(o) for o in order))

        def within(m: M.Decay) -> tuple[str, str]:
            upto = wide.index(width[m.length.ms]) + 1
            return ", ".join((key, *order[:upto])), ", ".join(order[upto:])

        centres, sums, befores, links, states = [], [], [], [], []
        for s, i, m in found:
            x, mask, w = s.whole(i), mask_of(s), width[m.length.ms]
            g, length = seg[w], f"{float(m.length.ms)!r}D"
            if self.split:
                mask = f"({mask} or _kind = {CARRY})"
            part, rest = within(m)
            raw = [f"if({mask}, {s.column(i, k)}, null)" for k in range(len(m.ops))]
            c = [f"{x}m{k}" for k in range(len(m.centred))]
            centres += [f"avg({raw[j]}) over (partition by {part}) as {n}" for j, n in zip(m.centred, c, strict=True)]
            since = f"(({at} - {g} * {w}L) / {length})"
            a = [f"{x}a{k}" for k in range(len(m.ops) - len(m.centred))]
            sums += [f"sum(({t}) * exp({since})) over (partition by {part} order by {rest} {ALL_BEFORE}) as {n}" for t, n in zip(m.terms(raw, c), a, strict=True)]
            held = ", ".join([f"'g', {g}", *(f"'{n.removeprefix(x)}', {n}" for n in (*a, *c))])
            befores.append(f"lag(named_struct({held})) over (partition by {key} order by {', '.join(order)}) as {x}l")
            near = f"{x}l.g = {g} - 1 and {x}l.a0 is not null"
            links.append(f"last(if(not {g} <=> {x}l.g, if({near}, {x}l, null), null), true) over (partition by {part} order by {rest} {ALL_BEFORE}) as {x}b")
            by = [f"coalesce({x}b.m{k} - {n}, 0D)" for k, n in enumerate(c)]
            past = m.moved([f"coalesce({x}b.a{k}, 0D)" for k in range(len(a))], by)
            both = [f"({n} + {p} * {math.exp(-w / m.length.ms)!r}D)" for n, p in zip(a, past, strict=True)]
            numbers = m.of_sums(both, c)
            fields = [f"'{n}', {f'({v}) * exp(-{since})' if fades else v}" for n, v, fades in zip(m.state, numbers, m.fading(), strict=True)]
            time = f"if(_kind = {CARRY}, _adj + {s.total.ms or 0}L, _ts)" if self.split else "_ts"
            states.append(f"if({mask} and {s.column(i, 0)} is not null, named_struct({', '.join(fields)}, 't', {time}), null) as {x}d")
        for step in (centres, sums, befores, links):
            if step:
                df = df.selectExpr(*cols, *step)
                cols = [*cols, *_names(step)]
        used = {s.column(i, k) for s in self.states for i, (_, m) in enumerate(s.aggs) for k in range(len(m.ops)) if not isinstance(m, M.Decay)}
        dead = {s.column(i, k) for s, i, m in found for k in range(len(m.ops))} - used
        kept = [*(c for c in plain if c not in dead), *seg.values()]
        df = df.selectExpr(*kept, *states)
        return df, [*kept, *_names(states)]

    # --- hot keys -------------------------------------------------------------------------

    def _spread(self, df: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
        """The rows with keys of more than hot_rows rows cut into spans of time, column `_z`.

        A span begins with one more row: the state after all spans before it, from totals per
        span that are made with partial aggregation. There are at most rows / hot_rows hot keys,
        and Spark decides by the size of their table how to join it.
        """
        if any(G.lookups_of(e) for e in (self.below, *(b.event for b, _, _ in self.bases))):
            df = stage(df, "lookup")
        same = " and ".join(f"{k} <=> {k}h" for k in self.by_key)
        named = [f"{k} as {k}h" for k in self.by_key]
        key = ", ".join(self.by_key)
        counts = df.groupBy(*self.by_key).count().where(f"count > {self.engine.hot_rows}").selectExpr(*named)
        cuts = ", ".join(f"{n}D / {SPANS}" for n in range(1, SPANS))
        hot = df.selectExpr(*self.by_key, "_adj").join(counts, F.expr(same), "left_semi").groupBy(*self.by_key)
        hot = hot.agg(F.expr(f"percentile_approx(if(_adj > {adjusted(INFINITE)}, _adj, null), array({cuts}), {SPANS * 16}) as _cuts")).selectExpr(*named, "_cuts")
        steps = ", ".join(str(SPANS >> n) for n in range(1, SPANS.bit_length()))
        z = f"if(_cuts is null, -1, aggregate(array({steps}), 0, (z, n) -> if(_adj >= _cuts[z + n - 1], z + n, z))) as _z"
        spanned = df.join(hot, F.expr(same), "left").selectExpr(*cols, "_cuts", z)
        begin, end = "if(_z > 0, _cuts[_z - 1], null) as _begin", f"if(_z >= 0 and _z < {SPANS - 1}, _cuts[_z], null) as _end"
        spanned = spanned.selectExpr(*cols, "_z", begin, end)
        cols = [*cols, "_z"]
        point = "named_struct('a', _adj, 'n', -_off, 's', _src, 'o', _ord" + (", 'u', _sub)" if self.sub else ")")
        inside = spanned.where("_z >= 0")
        if centres := [c for s in self.states for c in s.span_centres(self.mask(s), f"partition by {key}, _z")]:
            inside = inside.selectExpr("*", *centres)
        totals = [t for s in self.states for t in s.totals(self.mask(s), point)]
        held = inside.groupBy(*self.by_key, "_z", "_begin", "_end").agg(*map(F.expr, totals))
        before = f"partition by {key} order by _z rows between unbounded preceding and 1 preceding"
        held = held.selectExpr(*self.by_key, "_z", "_begin", *(c for s in self.states for c in s.carried(before)))
        carried = [c for s in self.states for c in s.carries()]
        fixed = ["_begin as _adj", "_begin as _ts", f"{LONG_MAX}L as _off", "'' as _src", "0L as _ord", f"{CARRY} as _kind", "-1 as _branch"]
        held = held.where("_z > 0").selectExpr(*self.by_key, "_z", *fixed, *([f"{_NO_SUB} as _sub"] if self.sub else []), *carried)
        cols = list(dict.fromkeys((*cols, *_names(carried))))
        out = spanned.drop("_begin", "_end").unionByName(held, allowMissingColumns=True).selectExpr(*cols)
        self.by_key = [*self.by_key, "_z"]
        return out.repartition(*self.by_key), cols


def _names(exprs: list[str]) -> list[str]:
    return [e.rsplit(" as ", 1)[1] for e in exprs]


def _riding(event: G.Keyed, below: G.Event) -> list | None:
    """The conditions under which rows of `below` are events of `event`; None if they are not the same."""
    conditions: list = []
    while event != below:
        same = isinstance(event, G.Keyed) and not isinstance(event, G.Lookup) and event.keys == event.keys_as_they_are()
        if not (same and isinstance(event.event, G.Filtered) and isinstance(event.event.event, G.Keyed)):
            return None
        conditions.insert(0, event.event.condition)
        if event.event.event.key_names != event.key_names:
            return None
        event = event.event.event
    return conditions


def _derived(below: G.Event, keys: tuple[str, ...], event: G.Keyed) -> bool:
    """Whether each row of `below` is made of one of `event`, and has its key."""
    at, names = below, list(keys)
    while at != event:
        if isinstance(at, G.Lookup):
            if set(names) & set(at.feature.names()):
                return False
        elif isinstance(at, (G.Mapped, G.Keyed)):
            exprs = dict(at.exprs if isinstance(at, G.Mapped) else at.keys)
            if isinstance(at, G.Mapped) and not set(names) <= set(exprs):
                return False
            given = [exprs.get(n, n) for n in names]
            if not all(isinstance(e, str) and re.fullmatch(r"`[^`]+`|[A-Za-z]\w*", e) for e in given):
                return False
            names = [e.strip("`") for e in given]
        elif not isinstance(at, G.Timed) or at.name in names:
            return False
        at = at.event
    return names == list(event.key_names)


def _bases(tree, offset: Duration, after: bool) -> Iterator[tuple[Any, Duration, bool]]:
    if isinstance(tree, G.Label):
        for feature, d in tree.parts(offset):
            for b in feature.bases():
                yield b, d, True
    else:
        for b in tree.bases():
            yield b, offset, after


def fold_states(df: DataFrame, keys: list[str], order: list[str], value: Column, fold: M.Fold, name: str) -> DataFrame:
    """df with the state of a fold after each row. Rows stream through sorted; a task holds one
    batch and one state, whatever the size of a key."""
    source = df.withColumn("_value", value)
    source = source.repartition(*(F.col(k) for k in keys)) if keys else source.repartition(1)
    source = source.sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(fold.kind))])
    plain = [k.strip("`") for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, begun = None, None, False
        for pdf in batches:
            states = []
            key_rows = zip(*(pdf[k] for k in plain), strict=True) if plain else ((),) * len(pdf)
            for key, v in zip(key_rows, pdf["_value"], strict=True):
                if not begun or key != last:
                    last, state, begun = key, v, True
                else:
                    state = fold.combine(state, v)
                states.append(state)
            yield pdf.drop(columns="_value").assign(**{name: pd.Series(states, index=pdf.index, dtype=object if not states else None)})

    return source.mapInPandas(run, schema)


class _State:
    """A base state of a lookup: its component columns, and how they are read."""

    def __init__(self, number: int, base, branch: int, offset: Duration, total: Duration):
        self.number, self.base, self.branch, self.offset = number, base, branch, offset
        self.total = total  # offset, together with those of the labels around the lookup
        latest = isinstance(base, G.Latest)
        self.aggs: tuple = (("", M.Last("_")),) if latest else base.aggs
        self.within = None if latest or base.within == INFINITE else base.within
        if self.within is not None and any(isinstance(m, (M.Decay, M.Fold)) for _, m in self.aggs):
            raise PlanError("a decayed sum or a fold has no trailing window")
        self.decays = [(i, m) for i, (_, m) in enumerate(self.aggs) if isinstance(m, M.Decay)]
        self.folds = any(isinstance(m, M.Fold) for _, m in self.aggs)
        self.known: dict[str, str] = {}  # columns that stand for equal ones

    def column(self, i: int, k: int) -> str:
        name = f"_v{self.branch}_{self.number}_{i}_{k}"
        return self.known.get(name, name)

    def whole(self, i: int) -> str:
        return f"_w{self.branch}_{self.number}_{i}"

    def built(self) -> list[Column]:
        """Inputs that functions build, as columns for `inputs` to name."""
        if isinstance(self.base, G.Latest):
            return []
        return [column(e).alias(f"_i{self.number}_{i}_{j}") for i, (_, m) in enumerate(self.aggs) for j, e in enumerate(m.inputs) if not isinstance(e, str)]

    def inputs(self, sub: bool) -> list[str]:
        """Component columns over the update rows."""
        name = lambda i, k: f"_v{self.branch}_{self.number}_{i}_{k}"
        if isinstance(self.base, G.Latest):
            fields = ", ".join(f"'{c}', {quoted(c)}" for c in self.base.columns)
            return [f"named_struct('v', named_struct({fields}), 't', _ts) as {name(0, 0)}"]
        point = "named_struct('t', _ts, 's', _src, 'o', _ord" + (", 'u', _sub)" if sub else ")")
        out: list[str] = []
        for i, (_, m) in enumerate(self.aggs):
            if isinstance(m, M.Fold):
                lifted = m.lift([f"_fold{self.number}_{i}"])
            else:
                lifted = m.lift([point if e == "_point" else f"({e})" if isinstance(e, str) else f"_i{self.number}_{i}_{j}" for j, e in enumerate(m.inputs)])
            out += [f"{c} as {name(i, k)}" for k, c in enumerate(lifted)]
        return out

    def folded(self, df: DataFrame, keys: tuple[str, ...], rows: Rows) -> DataFrame:
        """df with the states of folds, computed in point order."""
        for i, (_, m) in enumerate(self.aggs):
            if isinstance(m, M.Fold):
                df = fold_states(df, [quoted(k) for k in keys], ["_ts", "_src", "_ord", *(["_sub"] if rows.sub else [])], column(m.value), m, f"_fold{self.number}_{i}")
        return df

    def centre(self, i: int, k: int) -> list[str]:
        op = self.aggs[i][1].ops[k]
        return [f"{self.column(i, k)}k{j}" for j in range(len(M.centred(op, "_")))]

    def centres(self, mask: str, frame: str) -> list[str]:
        """The first value so far, which second moments are measured from."""
        out = []
        for i, (_, m) in enumerate(self.aggs if self.within is None else ()):
            for k, op in enumerate(m.ops):
                for x, n in zip(M.centred(op, f"if({mask}, {self.column(i, k)}, null)"), self.centre(i, k), strict=True):
                    out.append(f"first({x}, true) over ({frame}) as {n}")
        return out

    def windows(self, mask: str, frame: str, split: bool) -> list[str]:
        """Windows in point order, as columns `<whole>c<k>`."""
        out = []
        seen = f"({mask} or _kind = {CARRY})" if split else mask
        masked = lambda c, by: c if by == "true" else f"if({by}, {c}, null)"
        for i, (_, m) in enumerate(self.aggs):
            c = self.whole(i)
            if self.within is not None:
                out.append(f"{M.over('last', masked(c, seen), frame)} as {c}c0")
            elif isinstance(m, M.Decay):
                out.append(f"{M.over('last', masked(f'{c}d', seen), frame)} as {c}c0")
            else:
                for k, op in enumerate(m.ops):
                    v = self.column(i, k)
                    if split and op in M.STATEFUL:
                        out.append(f"{M.over(op, masked(v, mask), frame, self.centre(i, k))} as {c}c{k}i")
                        out.append(f"{M.over('last', f'{v}s', frame)} as {c}c{k}o")
                    else:
                        out.append(f"{M.over(op, masked(v, seen), frame, self.centre(i, k))} as {c}c{k}")
        return out

    def merges(self) -> list[str]:
        """What earlier spans came to, merged into the running states."""
        return [
            f"{M.merged(op, f'{self.whole(i)}c{k}o', f'{self.whole(i)}c{k}i')} as {self.whole(i)}c{k}"
            for i, (_, m) in enumerate(self.aggs) if self.within is None for k, op in enumerate(m.ops) if op in M.STATEFUL
        ]

    def results(self) -> dict[str, str]:
        """The columns of the base as expressions over the windows."""
        out: dict[str, str] = {}
        for i, (name, m) in enumerate(self.aggs):
            c = self.whole(i)
            if isinstance(self.base, G.Latest):
                got = f"{c}c0.v"
                if self.base.within is not None and self.base.within != INFINITE:
                    got = f"if(_ts - {c}c0.t <= {self.base.within.ms}L, {got}, null)"
                return {n: f"({got}).{quoted(n)}" for n in self.base.columns}
            if self.within is not None:
                values = m.finish([f"{c}c0.f{k}" for k in range(len(m.ops))])
            elif isinstance(m, M.Decay):
                fade = f"exp(({c}c0.t - _ts) / {float(m.length.ms)!r}D)"
                values = m.finish([f"({c}c0.{n} * {fade})" if fades else f"{c}c0.{n}" for n, fades in zip(m.state, m.fading(), strict=True)])
            else:
                values = m.finish([f"{c}c{k}" for k in range(len(m.ops))])
            out |= {f"{name}{suffix}": v for suffix, v in zip(m.fields, values, strict=True)}
        return out

    # --- keys cut into spans --------------------------------------------------------------

    def span_centres(self, mask: str, span: str) -> list[str]:
        """Means over a span of the values that second moments are measured from."""
        out = [f"avg(if({mask}, {self.column(i, j)}, null)) over ({span}) as {self.whole(i)}z{k}" for i, m in self.decays for k, j in enumerate(m.centred)]
        for i, (_, m) in enumerate(self.aggs if self.within is None else ()):
            for k, op in enumerate(m.ops):
                out += [f"avg({x}) over ({span}) as {n}" for x, n in zip(M.centred(op, f"if({mask}, {self.column(i, k)}, null)"), self.centre(i, k), strict=True)]
        return out

    def totals(self, mask: str, point: str) -> list[str]:
        """Aggregates of one span; decayed sums are brought to its end."""
        out = []
        for i, (_, m) in enumerate(self.aggs):
            if self.within is not None:
                out.append(f"{M.total('last', f'if({mask}, {self.whole(i)}, null)', point)} as {self.whole(i)}")
                continue
            raw = [f"if({mask}, {self.column(i, k)}, null)" for k in range(len(m.ops))]
            if isinstance(m, M.Decay):
                centre = [f"{self.whole(i)}z{k}" for k in range(len(m.centred))]
                fade = f"exp((_adj - _end) / {float(m.length.ms)!r}D)"
                sums = [f"sum(({t}) * {fade})" for t in m.terms(raw, centre)]
                firsts = [f"first({c})" for c in centre]
                out += [f"{v} as {self.column(i, k)}" for k, v in enumerate(m.of_sums(sums, firsts))]
                if i == self.decays[0][0]:
                    out.append(f"first(_end) as {self.whole(i)}t")
            else:
                out += [f"{M.total(op, v, point, self.centre(i, k))} as {self.column(i, k)}" for k, (op, v) in enumerate(zip(m.ops, raw, strict=True))]
        return out

    def carried(self, before: str) -> list[str]:
        """What all spans before a span come to; of states that merge in pairs, their list."""
        out = []
        for i, (_, m) in enumerate(self.aggs):
            if self.within is not None:
                out.append(f"{M.over('last', self.whole(i), before)} as {self.whole(i)}")
            elif isinstance(m, M.Decay):
                fields = ", ".join(f"'{n}', {self.column(i, k)}" for k, n in enumerate(m.state))
                some, t = f"{self.column(i, 0)} is not null", f"{self.whole(self.decays[0][0])}t"
                out.append(f"collect_list(if({some}, named_struct({fields}, 't', {t}), null)) over ({before}) as {self.whole(i)}l")
            else:
                for k, op in enumerate(m.ops):
                    v = self.column(i, k)
                    out.append(f"collect_list({v}) over ({before}) as {v}l" if op in M.STATEFUL else f"{M.over(op, v, before)} as {v}")
        return out

    def carries(self) -> list[str]:
        """The columns of the row that a span begins with."""
        out = []
        for i, (_, m) in enumerate(self.aggs):
            if self.within is not None:
                out.append(f"{self.whole(i)} as {self.whole(i)}")
            elif isinstance(m, M.Decay):
                # states are brought to the time of the next one and merged, the last one to the begin of the span
                fade = lambda v, t, m=m: [f"{v}.{n} * exp(({v}.t - {t}) / {float(m.length.ms)!r}D)" if f else f"{v}.{n}" for n, f in zip(m.state, m.fading(), strict=True)]
                both = m.merge(fade("s", "x.t"), [f"x.{n}" for n in m.state])
                step = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in zip(m.state, both, strict=True)) + ", 't', x.t)"
                end = "named_struct(" + ", ".join(f"'{n}', {e}" for n, e in zip(m.state, fade("s", "_begin"), strict=True)) + ")"
                seen = f"{self.whole(i)}l"
                all_of = f"if(size({seen}) = 0, null, aggregate(slice({seen}, 2, greatest(size({seen}) - 1, 0)), {seen}[0], (s, x) -> {step}, s -> {end}))"
                out += [f"({all_of}).{n} as {self.column(i, k)}" for k, n in enumerate(m.state)]
            else:
                for k, op in enumerate(m.ops):
                    v = self.column(i, k)
                    if op == "set":
                        out.append(f"array_distinct(flatten({v}l)) as {v}s")
                    elif op in M.STATEFUL:
                        out.append(f"if(size({v}l) = 0, null, aggregate(slice({v}l, 2, greatest(size({v}l) - 1, 0)), {v}l[0], (s, x) -> {M.paired(op, 's', 'x')})) as {v}s")
                    else:
                        out.append(f"{v} as {v}")
        return out


def _results(df: DataFrame, plan: _Lookup, asked: list, probe: Rows, keys: tuple[str, ...]) -> Rows:
    """The events with the columns of all features and labels asked for."""
    places = {}
    for (b, d, a), s in zip(plan.bases, plan.states, strict=True):
        places[b, d, a] = s.results()
    cols = ["_p", *(f"_k{i}" for i in range(len(keys))), *probe.hidden, *(w for s in plan.states for w in _window_names(s))]
    count = 0

    def read(tree, offset: Duration, after: bool) -> dict[str, str]:
        """Expressions of the columns of a feature or label as the events read it."""
        nonlocal df, cols, count
        match tree:
            case G.Summed() | G.Latest():
                return places[tree, offset, after]
            case G.FeatureLabel(feature=feature):
                return read(feature, offset, True)
            case G.Forward(label=label, by=by):
                return read(label, offset + by, True)
            case G.Zipped(left=left, right=right) | G.ZippedLabel(left=left, right=right):
                return read(left, offset, after) | read(right, offset, after)
            case G.Constant(exprs=exprs):
                inner: dict[str, str] = {}
            case G.MappedFeature(feature=below, exprs=exprs) | G.MappedLabel(label=below, exprs=exprs):
                inner = read(below, offset, after)
            case _:
                raise TypeError(type(tree))
        # columns that only change their names need no scope of their own
        names = [e.strip("`") if isinstance(e, str) else "" for _, e in exprs]
        if all(n in inner for n in names):
            return {n: inner[e] for (n, _), e in zip(exprs, names, strict=True)}
        # the expressions see the feature's columns and the key, and nothing else of the event
        scope = [f"{v} as {quoted(n)}" for n, v in inner.items()] + [f"_k{i} as {quoted(k)}" for i, k in enumerate(keys) if k not in inner]
        out = {n: f"_x{count}_{j}" for j, (n, _) in enumerate(exprs)}
        count += 1
        df = df.selectExpr(*cols, *scope).select(*cols, *(column(e).alias(out[n]) for n, e in exprs))
        cols = [*cols, *out.values()]
        return out

    found: list[tuple[str, str]] = []
    for tree, d, after in asked:
        names = tree.names()
        got = read(tree, d, after)
        found += [(n, got[n]) for n in names]
    all_names = [*probe.payload, *(n for n, _ in found)]
    if len(set(all_names)) < len(all_names):
        raise PlanError(f"columns of one name (rename some with map): {sorted({n for n in all_names if all_names.count(n) > 1})}")
    out = [f"_p.{quoted(c)} as {quoted(c)}" for c in probe.payload] + [f"{v} as {quoted(n)}" for n, v in found]
    return Rows(df.selectExpr(*out, *probe.hidden), tuple(all_names), probe.sub, probe.extra)


def _window_names(s: _State) -> list[str]:
    out = []
    for i, (_, m) in enumerate(s.aggs):
        one = s.within is not None or isinstance(m, M.Decay)
        out += [f"{s.whole(i)}c{k}" for k in range(1 if one else len(m.ops))]
    return out
