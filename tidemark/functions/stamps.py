"""Mixed timestamp texts to epoch milliseconds.

A text is reduced to its character-class shape ("2021-03-04 05:06" becomes "9999-99-99 99:99").
A column has few shapes; each one is compiled once to a parser that knows the positions of
all parts, and the parser runs over all texts of that shape at once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.functions.zones import ZoneTable

# English month names by their first three letters.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
MONTHS_LONG = ("JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER", "OCTOBER", "NOVEMBER", "DECEMBER")
_MONTH_NO = {m: i + 1 for names in (MONTHS, MONTHS_LONG) for i, m in enumerate(names)} | {"SEPT": 9}

_DATES = (
    r"(?P<y>9999)(?P<sep>[-/.])(?P<m>99?)(?P=sep)(?P<d>99?)",
    r"(?P<y>9999)(?P<m>99)(?P<d>99)",
    r"(?P<s1>99?)/(?P<s2>99?)/(?P<y>9999|99)",
    r"(?P<d>99?)\.(?P<m>99?)\.(?P<y>9999|99)",
    r"(?P<d>99?)(?P<sep>[- ])(?P<mon>A{3,9})(?P=sep)(?P<y>9999|99)",
    r"(?P<mon>A{3,9}) (?P<d>99?),? (?P<y>9999)",
)
_TIME = r"(?:,? |(?P<t>A))(?P<H>99?)(?:(?::(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9{1,9}))?)?)|(?P<M2>99)(?P<S2>99)?(?:[.,](?P<f2>9{1,9}))?)"
_TAIL = r"(?: ?(?P<w1>A{1,5}))?(?: (?P<w2>A{1,5}))?(?: ?(?P<sign>[+-])(?P<oh>99):?(?P<om>99)?)?"
_LAYOUTS = [re.compile(d + _TIME + _TAIL) for d in _DATES]
_BARE = re.compile(r"(?P<n>9{9,16})(?:\.(?P<f>9{1,9}))?")
#: A bare number counts seconds below this size and milliseconds from it on.
_MILLIS_FROM = 10**11


@dataclass(frozen=True)
class Shape:
    """Where the parts of a stamp stand in every text of this shape."""

    spans: tuple[tuple[str, int, int], ...]
    bare: bool = False

    def get(self, name: str) -> tuple[int, int] | None:
        return next(((a, b) for n, a, b in self.spans if n == name), None)


@lru_cache(maxsize=4096)
def compile_shape(mask: str) -> Shape | None:
    """The parser of a shape, or None where texts of that shape name no instant."""
    for pattern, bare in ((_BARE, True), *((p, False) for p in _LAYOUTS)):
        if m := pattern.fullmatch(mask):
            spans = tuple((n, *m.span(n)) for n, v in m.groupdict().items() if v is not None)
            return Shape(spans, bare)
    return None


def days_of(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(days since the epoch, valid) in the Gregorian calendar."""
    ok = (m >= 1) & (m <= 12) & (d >= 1) & (y >= 1)
    months = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    first = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    after = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    days = first + d - 1
    return days, ok & (days < after)


@dataclass(frozen=True)
class Place:
    """What a stamp without zone or with an ambiguous date means at its place of origin."""

    zone: ZoneTable | None
    day_first: bool | None


class StampParser:
    """places: code to Place; abbreviations: zone abbreviation to seconds east of Greenwich."""

    def __init__(self, places: dict[str, Place], abbreviations: dict[str, int]):
        self.places = places
        self.abbreviations = {"Z": 0, "UTC": 0, "GMT": 0} | {k.upper(): v for k, v in abbreviations.items()}

    def __call__(self, texts: pa.Array, codes: pa.Array) -> pa.Array:
        texts = pc.utf8_upper(pc.utf8_trim_whitespace(pc.replace_substring_regex(texts, r"\s+", " ")))
        masks = pc.replace_substring_regex(pc.replace_substring_regex(texts, "[A-Z]", "A"), "[0-9]", "9")
        shapes = pc.dictionary_encode(masks)
        index = np.asarray(pc.fill_null(shapes.indices, -1))
        out, valid = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for i, mask in enumerate(shapes.dictionary.to_pylist()):
            if len(mask) <= 64 and (shape := compile_shape(mask)):
                at = np.flatnonzero(index == i)
                ms, ok = (self._bare if shape.bare else self._stamp)(shape, texts.take(pa.array(at)), codes.take(pa.array(at)))
                out[at], valid[at] = ms, ok
        return pa.array(out, mask=~valid)

    @staticmethod
    def _number(texts: pa.Array, span: tuple[int, int] | None, missing: int = 0) -> np.ndarray:
        if span is None:
            return np.full(len(texts), missing, np.int64)
        return np.asarray(pc.cast(pc.utf8_slice_codeunits(texts, *span), pa.int64()))

    @classmethod
    def _millis(cls, texts: pa.Array, span: tuple[int, int] | None) -> np.ndarray:
        """A fraction of a second, cut to milliseconds."""
        if span is None:
            return np.zeros(len(texts), np.int64)
        a, b = span[0], min(span[1], span[0] + 3)
        return cls._number(texts, (a, b)) * 10 ** (3 - (b - a))

    def _bare(self, shape: Shape, texts: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, f = self._number(texts, shape.get("n")), self._millis(texts, shape.get("f"))
        seconds = n < _MILLIS_FROM
        return np.where(seconds, n * 1000 + f, n), np.full(len(texts), True)

    def _words(self, texts: pa.Array, span: tuple[int, int] | None, known: dict[str, int]) -> np.ndarray:
        """The number of each word; -1 where it has none."""
        words = pc.dictionary_encode(pc.utf8_slice_codeunits(texts, *span))
        values = np.array([known.get(w, -1) for w in words.dictionary.to_pylist()], np.int64)
        return values[np.asarray(words.indices)]

    def _stamp(self, shape: Shape, texts: pa.Array, codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        n, get = len(texts), shape.get
        ok = np.full(n, True)
        place = pc.dictionary_encode(codes)
        place_at = np.asarray(pc.fill_null(place.indices, -1))
        known = [self.places.get(c) for c in place.dictionary.to_pylist()]
        year_span = get("y")
        y = self._number(texts, year_span)
        if year_span[1] - year_span[0] == 2:
            y = y + 2000
        if get("mon"):
            m, d = self._words(texts, get("mon"), _MONTH_NO), self._number(texts, get("d"))
        elif get("s1"):
            a, b = self._number(texts, get("s1")), self._number(texts, get("s2"))
            order = np.array([-1 if p is None or p.day_first is None else int(p.day_first) for p in known] + [-1])[place_at]
            m, d = np.where(order == 1, b, a), np.where(order == 1, a, b)
            ok &= order >= 0
        else:
            m, d = self._number(texts, get("m")), self._number(texts, get("d"))
        if get("t"):
            ok &= self._words(texts, get("t"), {"T": 1}) == 1
        hour = self._number(texts, get("H"))
        minute, second = self._number(texts, get("M") or get("M2")), self._number(texts, get("S") or get("S2"))
        noon, offset = np.full(n, -1), np.full(n, -1, np.int64)
        zoned, none = np.full(n, False), np.int64(10**6)
        words = {w: none + o for w, o in self.abbreviations.items()} | {"AM": 0, "PM": 1}
        for w in ("w1", "w2"):
            if get(w):
                v = self._words(texts, get(w), words)
                half, zone = (v == 0) | (v == 1), v > 1
                ok &= (half & (noon < 0)) | (zone & ~zoned)
                noon, offset, zoned = np.where(half, v, noon), np.where(zone, v - none, offset), zoned | zone
        if get("sign"):
            sign = self._words(texts, get("sign"), {"+": 1, "-": 2})
            east = np.where(sign == 2, -1, 1) * (self._number(texts, get("oh")) * 3600 + self._number(texts, get("om")) * 60)
            # "UTC+02:00": the number counts from the named zone, which must then be UTC itself
            ok &= ~zoned | (offset == 0)
            ok &= (self._number(texts, get("oh")) <= 18) & (self._number(texts, get("om")) < 60)
            offset, zoned = east, np.full(n, True)
        twelve = noon >= 0
        ok &= ~twelve | ((hour >= 1) & (hour <= 12))
        hour = np.where(twelve, hour % 12 + 12 * noon, hour)
        days, real = days_of(y, m, d)
        ok &= real & (hour < 24) & (minute < 60) & (second < 60)
        local = days * 86400 + hour * 3600 + minute * 60 + second
        utc = local - np.where(zoned, offset, 0)
        for i, p in enumerate(known):
            here = (place_at == i) & ~zoned
            if p is None or p.zone is None:
                ok &= ~here
            elif here.any():
                at = np.flatnonzero(here)
                utc[at], sure = p.zone.to_utc(local[at])
                ok[at] &= sure
        ok &= (place_at >= 0) | zoned
        return utc * 1000 + self._millis(texts, get("f") or get("f2")), ok
