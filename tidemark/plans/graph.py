"""The immutable graph of a feature program: events, features, labels and labelled events.

Nodes are frozen dataclasses over SQL expression texts, so that equal programs compare equal
and Catalyst sees all user code. Nothing here touches Spark; `lower` turns a graph into a
DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import reduce

from tidemark.functions.duration import INFINITE, ZERO, Duration, as_duration
from tidemark.functions.monoids import Bounds, Count, Expr, Extremum, Monoid

Named = tuple[tuple[str, Expr], ...]


def _named(args: tuple[str, ...], kw: dict[str, Expr]) -> Named:
    return (*((a, f"`{a}`") for a in args), *kw.items())


@dataclass(frozen=True)
class Amplification:
    """How many outputs one source row can have: low..high, high None for no bound."""

    low: int
    high: int | None

    def __add__(self, o: Amplification) -> Amplification:
        return Amplification(self.low + o.low, None if self.high is None or o.high is None else self.high + o.high)

    def __mul__(self, o: Amplification) -> Amplification:
        if 0 in (self.high, o.high):
            high: int | None = 0
        else:
            high = None if self.high is None or o.high is None else self.high * o.high
        return Amplification(self.low * o.low, high)

    @property
    def at_most_one(self) -> bool:
        return self.high is not None and self.high <= 1


NONE, ONE, MAYBE, MANY = Amplification(0, 0), Amplification(1, 1), Amplification(0, 1), Amplification(0, None)


@dataclass(frozen=True)
class Event:
    """A log of things that happen at a time, as columns."""

    # --- building -------------------------------------------------------------------------

    def map(self, *keep: str, **exprs: Expr) -> Event:
        """Only the named columns: kept ones by name, computed ones by expression."""
        return Mapped(self, _named(keep, exprs))

    def filter(self, condition: Expr) -> Event:
        return Filtered(self, condition)

    def concat_map(self, items: Expr, name: str = "item", position: str | None = None) -> Event:
        """One event per element of an array, in order; the other columns stay."""
        return Exploded(self, items, name, position)

    def with_time(self, name: str = "time") -> Event:
        return Timed(self, name)

    def key_by(self, *keep: str, **exprs: Expr) -> Keyed:
        return Keyed(self, _named(keep, exprs))

    def through(self, pipe: Callable[[Event], Event]) -> Event:
        return pipe(self)

    def __add__(self, other: Event) -> Event:
        """Merge; of one source row the left outputs come first."""
        return Concat(self, other)

    # --- looking --------------------------------------------------------------------------

    def children(self) -> tuple[Event, ...]:
        inner = getattr(self, "event", None)
        return (inner,) if inner is not None else ()

    def features(self) -> tuple[tuple[Feature, Duration], ...]:
        return ()

    @property
    def amplification(self) -> Amplification:
        return ONE


@dataclass(frozen=True)
class Empty(Event):
    """No events; `schema` is the SQL schema of the columns it does not have rows of."""

    schema: str

    @property
    def amplification(self) -> Amplification:
        return NONE


@dataclass(frozen=True)
class Source(Event):
    """A named leaf. ts: expression for epoch milliseconds. order: a long that is unique within the
    source and orders rows of one time; without it rows of one time keep the order of a single file."""

    name: str
    ts: Expr
    order: Expr | None = None
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Mapped(Event):
    event: Event
    exprs: Named

    @property
    def amplification(self) -> Amplification:
        return self.event.amplification


@dataclass(frozen=True)
class Filtered(Event):
    event: Event
    condition: Expr

    @property
    def amplification(self) -> Amplification:
        return self.event.amplification * MAYBE


@dataclass(frozen=True)
class Exploded(Event):
    event: Event
    items: Expr
    name: str
    position: str | None

    @property
    def amplification(self) -> Amplification:
        return self.event.amplification * MANY


@dataclass(frozen=True)
class Timed(Event):
    event: Event
    name: str

    @property
    def amplification(self) -> Amplification:
        return self.event.amplification


@dataclass(frozen=True)
class Concat(Event):
    left: Event
    right: Event

    def children(self) -> tuple[Event, ...]:
        return (self.left, self.right)

    @property
    def amplification(self) -> Amplification:
        return self.left.amplification + self.right.amplification


@dataclass(frozen=True)
class Keyed(Event):
    """Events about entities: the key columns are computed from the columns of `event`, all of
    which stay as values."""

    event: Event
    keys: Named

    @property
    def amplification(self) -> Amplification:
        return self.event.amplification

    @property
    def key_names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.keys)

    def map_values(self, *keep: str, **exprs: Expr) -> Keyed:
        """Other values under the same keys."""
        keys = tuple((n, f"`{n}`") for n in self.key_names)
        return Keyed(Mapped(self, (*keys, *(x for x in _named(keep, exprs) if x[0] not in self.key_names))), keys)

    def filter(self, condition: Expr) -> Keyed:
        return Keyed(Filtered(self, condition), tuple((n, f"`{n}`") for n in self.key_names))

    def value_with_time(self, name: str = "time") -> Keyed:
        return Keyed(Timed(self, name), tuple((n, f"`{n}`") for n in self.key_names))

    def values(self, *keep: str) -> Event:
        """Only the named value columns, without the key."""
        return Mapped(self, _named(keep, {}))

    def pre_lookup(self, *features: Feature) -> Keyed:
        """With the columns of features as they stood just before each event."""
        return self._lookup(features, False)

    def post_lookup(self, *features: Feature) -> Keyed:
        """The same, just after each event."""
        return self._lookup(features, True)

    def _lookup(self, features: tuple[Feature, ...], after: bool) -> Keyed:
        return Lookup(self, self.keys_as_they_are(), reduce(Feature.zip, features), after)

    def keys_as_they_are(self) -> Named:
        return tuple((n, f"`{n}`") for n in self.key_names)

    def sum(self, **aggs: Monoid) -> Feature:
        return Summed(self, tuple(aggs.items()), None)

    def count(self, name: str = "n") -> Feature:
        return self.sum(**{name: Count()})

    def latest(self, *columns: str) -> Feature:
        return Latest(self, columns, None)

    def latest_within(self, d: Duration | str, *columns: str, enforce: bool = False) -> Feature:
        """The latest values; only with `enforce` are those older than d left out."""
        return Latest(self, columns, as_duration(d) if enforce else None)

    def window_sum(self, d: Duration | str, **aggs: Monoid) -> Feature:
        """Aggregates over the key's events within d, both ends included, of the key's last event."""
        return Summed(self, tuple(aggs.items()), as_duration(d))

    def window(self, d: Duration | str, **aggs: Monoid) -> Feature:
        """window_sum together with the window's time_min, time_max and size."""
        return Summed(self, (*aggs.items(), ("", Bounds())), as_duration(d))

    def sum_forward(self, d: Duration | str, **aggs: Monoid) -> Label:
        return Label.of(self.window_sum(d, **aggs)).look_forward(d)

    def max(self, value: str, order: Expr | None = None) -> Feature:
        return self.sum(**{value: Extremum(f"`{value}`", order or f"`{value}`", True)})

    def min(self, value: str, order: Expr | None = None) -> Feature:
        return self.sum(**{value: Extremum(f"`{value}`", order or f"`{value}`", False)})

    def triggers(self) -> Keyed:
        """The events at which this one can say something about a key, without values and lookups."""
        return triggers_of(self)

    def labeled(self, label: Label) -> LabeledEvent:
        return LabeledEvent(self, label, ())


@dataclass(frozen=True)
class Lookup(Keyed):
    """Each event with the state of features of its key before or after it."""

    feature: Feature = None
    after: bool = False

    def features(self) -> tuple[tuple[Feature, Duration], ...]:
        return ((self.feature, ZERO),)


# --- features -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Feature:
    """A value of entities that varies with time, given for every key and time."""

    def zip(self, other: Feature) -> Feature:
        return Zipped(self, other)

    def map(self, *keep: str, **exprs: Expr) -> Feature:
        """Computed when read. Expressions see the feature's columns, the key columns of the reading
        event, and `_ts`, the reading event's own time."""
        return MappedFeature(self, _named(keep, exprs))

    def bases(self) -> Iterator[Summed | Latest]:
        return iter(())

    def triggers(self) -> Keyed:
        """An event whenever the feature can change."""
        found = list(dict.fromkeys(triggers_of(b.event) for b in self.bases()))
        if not found:
            raise ValueError("a constant feature never changes")
        both = reduce(lambda a, b: Keyed(Concat(a, b), a.keys_as_they_are()), found)
        return both

    def changes(self, before: str = "before_", after: str = "after_") -> Keyed:
        """At every trigger the columns before and after it, also where they are equal."""
        names = self.names()
        old = self.map(**{f"{before}{n}": f"`{n}`" for n in names})
        new = self.map(**{f"{after}{n}": f"`{n}`" for n in names})
        return self.triggers().pre_lookup(old).post_lookup(new)

    def names(self) -> tuple[str, ...]:
        raise NotImplementedError


@dataclass(frozen=True)
class Constant(Feature):
    """Computed from the key and the time of reading alone."""

    exprs: Named

    @staticmethod
    def of(**exprs: Expr) -> Feature:
        return Constant(tuple(exprs.items()))

    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.exprs)


@dataclass(frozen=True)
class Summed(Feature):
    event: Keyed
    aggs: tuple[tuple[str, Monoid], ...]
    within: Duration | None

    def bases(self):
        yield self

    def names(self) -> tuple[str, ...]:
        return tuple(n + f for n, m in self.aggs for f in m.fields)


@dataclass(frozen=True)
class Latest(Feature):
    event: Keyed
    columns: tuple[str, ...]
    within: Duration | None

    def bases(self):
        yield self

    def names(self) -> tuple[str, ...]:
        return self.columns


@dataclass(frozen=True)
class MappedFeature(Feature):
    feature: Feature
    exprs: Named

    def bases(self):
        return self.feature.bases()

    def names(self) -> tuple[str, ...]:
        return tuple(n for n, _ in self.exprs)


@dataclass(frozen=True)
class Zipped(Feature):
    left: Feature
    right: Feature

    def bases(self):
        yield from self.left.bases()
        yield from self.right.bases()

    def names(self) -> tuple[str, ...]:
        names = (*self.left.names(), *self.right.names())
        if len(set(names)) < len(names):
            raise ValueError(f"features with columns of one name: {names}")
        return names


# --- labels -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Label:
    """What is to be predicted: a feature as it will stand some time after the event."""

    @staticmethod
    def of(feature: Feature) -> Label:
        return FeatureLabel(feature)

    def look_forward(self, d: Duration | str) -> Label:
        return Forward(self, as_duration(d))

    def zip(self, other: Label) -> Label:
        return ZippedLabel(self, other)

    def map(self, *keep: str, **exprs: Expr) -> Label:
        return MappedLabel(self, _named(keep, exprs))

    def parts(self, offset: Duration = ZERO) -> Iterator[tuple[Feature, Duration]]:
        raise NotImplementedError

    def names(self) -> tuple[str, ...]:
        raise NotImplementedError


@dataclass(frozen=True)
class FeatureLabel(Label):
    feature: Feature

    def parts(self, offset=ZERO):
        yield self.feature, offset

    def names(self):
        return self.feature.names()


@dataclass(frozen=True)
class Forward(Label):
    label: Label
    by: Duration

    def parts(self, offset=ZERO):
        return self.label.parts(offset + self.by)

    def names(self):
        return self.label.names()


@dataclass(frozen=True)
class ZippedLabel(Label):
    left: Label
    right: Label

    def parts(self, offset=ZERO):
        yield from self.left.parts(offset)
        yield from self.right.parts(offset)

    def names(self):
        return (*self.left.names(), *self.right.names())


@dataclass(frozen=True)
class MappedLabel(Label):
    label: Label
    exprs: Named

    def parts(self, offset=ZERO):
        return self.label.parts(offset)

    def names(self):
        return tuple(n for n, _ in self.exprs)


@dataclass(frozen=True)
class LabeledEvent:
    """Events joined to a label; only maps and filters remain."""

    event: Keyed
    label: Label
    steps: tuple[tuple[str, Named | Expr], ...] = field(default=())

    def map(self, *keep: str, **exprs: Expr) -> LabeledEvent:
        return replace(self, steps=(*self.steps, ("map", _named(keep, exprs))))

    def filter(self, condition: Expr) -> LabeledEvent:
        return replace(self, steps=(*self.steps, ("filter", condition)))


# --- introspection ------------------------------------------------------------------------


def triggers_of(event: Keyed) -> Keyed:
    """The key-change events of a keyed event: lookups, times and maps of values are stripped, on
    both sides of a merge; equal sides of a merge are one."""
    return Keyed(_stripped(event, event.key_names), event.keys_as_they_are()).map_values()


def _stripped(e: Event, keys: tuple[str, ...]) -> Event:
    """The events below with these columns, without what only adds to them."""
    names = tuple((k, f"`{k}`") for k in keys)
    while True:
        if isinstance(e, Lookup) or (isinstance(e, Keyed) and e.keys == names and set(keys) <= _columns(e.event, set(keys))):
            e = e.event
        elif isinstance(e, Timed) and e.name not in keys:
            e = e.event
        elif isinstance(e, Mapped) and all(n in e.exprs for n in names) and set(keys) <= _columns(e.event, set(keys)):
            e = e.event
        elif isinstance(e, Concat):
            left, right = (_stripped(Mapped(side, names), keys) for side in (e.left, e.right))
            left, right = (side if isinstance(side, Mapped) and side.exprs == names else Mapped(side, names) for side in (left, right))
            return left if left == right else Concat(left, right)
        elif isinstance(e, Mapped) and isinstance(e.event, Lookup) and not _named_in(e.exprs, e.event):
            e = replace(e, exprs=tuple(x for x in e.exprs if x[0] in keys), event=_below(e.event))
        elif isinstance(e, Mapped) and {n for n, _ in e.exprs} > set(keys):
            e = replace(e, exprs=tuple(x for x in e.exprs if x[0] in keys))
        elif isinstance(e, Keyed) and not isinstance(e, Lookup) and isinstance(e.event, Mapped) and {n for n, _ in e.event.exprs} > _needed(e.keys):
            kept = tuple(x for x in e.event.exprs if x[0] in _needed(e.keys))
            if not kept:
                return e
            e = replace(e, event=replace(e.event, exprs=kept))
        elif isinstance(e, Keyed) and not isinstance(e, Lookup) and isinstance(e.event, Mapped) and isinstance(e.event.event, Lookup) and not _named_in(e.event.exprs, e.event.event):
            e = replace(e, event=replace(e.event, event=_below(e.event.event)))
        else:
            return e


def _words(e: Expr) -> set[str]:
    """All that may be a column's name in an expression; what a function builds is unknown."""
    return set(re.findall(r"\w+", e)) if isinstance(e, str) else {"*"}


def _needed(exprs: Named) -> set[str]:
    return set().union(*(_words(e) for _, e in exprs)) if exprs else set()


def _named_in(exprs: Named, lookup: Lookup) -> bool:
    """Whether the expressions of key columns may read what a lookup adds."""
    words = _needed(exprs)
    return "*" in words or bool(words & set(lookup.feature.names()))


def _below(lookup: Lookup) -> Event:
    return lookup.event


def _columns(e: Event, asked: set[str]) -> set[str]:
    """Those of the columns asked for that an event surely has under these names."""
    if isinstance(e, Lookup):
        return _columns(e.event, asked)
    if isinstance(e, Keyed):
        return {n for n, _ in e.keys} & asked | _columns(e.event, asked - {n for n, _ in e.keys})
    if isinstance(e, Mapped):
        return {n for n, _ in e.exprs} & asked
    if isinstance(e, Concat):
        return _columns(e.left, asked) & _columns(e.right, asked)
    if isinstance(e, (Filtered, Timed)):
        return _columns(e.event, asked)
    if isinstance(e, Source) and e.columns:
        return set(e.columns) & asked
    return set()


def _walk(node, offset: Duration = ZERO) -> Iterator[tuple[object, Duration]]:
    """All event nodes with the offset they are read at, and the features as they are met."""
    yield node, offset
    if isinstance(node, LabeledEvent):
        yield from _walk(node.event, offset)
        for f, d in node.label.parts(offset):
            yield from _walk(f, d)
    elif isinstance(node, Event):
        for c in node.children():
            yield from _walk(c, offset)
        for f, d in node.features():
            yield from _walk(f, offset + d)
    elif isinstance(node, Feature):
        for b in node.bases():
            yield from _walk(b.event, offset)


def sources_of(node) -> dict[str, set[Source]]:
    out: dict[str, set[Source]] = {}
    for n, _ in _walk(node):
        if isinstance(n, Source):
            out.setdefault(n.name, set()).add(n)
    return out


def sources_and_offsets_of(node) -> dict[str, tuple[set[Source], set[Duration]]]:
    out: dict[str, tuple[set[Source], set[Duration]]] = {}
    for n, d in _walk(node):
        if isinstance(n, Source):
            own = out.setdefault(n.name, (set(), set()))
            own[0].add(n)
            own[1].add(d)
    return out


def lookups_of(node) -> set[Lookup]:
    return {n for n, _ in _walk(node) if isinstance(n, Lookup)}


def is_infinite(d: Duration) -> bool:
    return d == INFINITE
