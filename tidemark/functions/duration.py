"""Durations and the algebra of epoch-millisecond times, on numbers and on columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1
LONG_MIN = -(2**63)


@dataclass(frozen=True, order=True)
class Duration:
    """Milliseconds, not negative; `ms` is None for the infinite duration, which is the largest."""

    sort_key: int
    ms: int | None

    @staticmethod
    def of(ms: int | None) -> Duration:
        if ms is None or ms >= LONG_MAX:
            return INFINITE
        if ms < 0:
            raise ValueError("a duration is not negative")
        return Duration(int(ms), int(ms))

    @property
    def infinite(self) -> bool:
        return self.ms is None

    def __add__(self, other: Duration) -> Duration:
        return INFINITE if self.infinite or other.infinite else Duration.of(self.ms + other.ms)

    def __mul__(self, n: int) -> Duration:
        """Zero times anything is zero; a product beyond a long is infinite."""
        if n < 0:
            raise ValueError("a duration is not negative")
        if n == 0:
            return ZERO
        return INFINITE if self.infinite else Duration.of(self.ms * n)

    __rmul__ = __mul__

    def __truediv__(self, n: int) -> Duration:
        if n <= 0:
            raise ValueError("a duration is divided by a positive number")
        return INFINITE if self.infinite else Duration.of(self.ms // n)

    def __str__(self) -> str:
        return "infinite" if self.infinite else f"{self.ms}ms"


INFINITE = Duration(LONG_MAX, None)
ZERO = Duration(0, 0)
MILLISECOND = Duration.of(1)
SECOND = MILLISECOND * 1000
MINUTE = SECOND * 60
HOUR = MINUTE * 60
DAY = HOUR * 24
WEEK = DAY * 7
# Fixed value: a year is 365.25 days.
YEAR = HOUR * (6 * 1461)
QUARTER = YEAR / 4
MONTH = YEAR / 12

_UNITS = {"ms": MILLISECOND, "millis": MILLISECOND, "s": SECOND, "sec": SECOND, "second": SECOND, "min": MINUTE, "minute": MINUTE, "h": HOUR, "hour": HOUR}
_UNITS |= {"d": DAY, "day": DAY, "w": WEEK, "week": WEEK, "month": MONTH, "quarter": QUARTER, "year": YEAR}


def parse_duration(text: str) -> Duration:
    """`1h`, `3days`, `250 ms`, `infinite`."""
    if text.strip().lower() in ("inf", "infinite"):
        return INFINITE
    m = re.fullmatch(r"\s*(\d+)\s*([a-z]+)\s*", text.lower())
    unit = m and (_UNITS.get(m[2]) or _UNITS.get(m[2].removesuffix("s")))
    if not unit:
        raise ValueError(f"no duration: {text!r}")
    return unit * int(m[1])


def as_duration(d: Duration | str | int) -> Duration:
    return d if isinstance(d, Duration) else parse_duration(d) if isinstance(d, str) else Duration.of(d)


def plus(ts: int, d: Duration) -> int:
    """ts + d, held at the largest long."""
    return LONG_MAX if d.infinite else min(LONG_MAX, ts + d.ms)


def minus(ts: int, d: Duration) -> int:
    return LONG_MIN if d.infinite else max(LONG_MIN, ts - d.ms)


def _positive(d: Duration) -> int:
    if d.infinite or not d.ms:
        raise ValueError("needs a finite positive duration")
    return d.ms


def bucket(ts: Column, d: Duration | str) -> Column:
    """Number of the period of length d that holds ts (rounded down, also before the epoch)."""
    w = _positive(as_duration(d))
    return F.call_function("div", ts - F.pmod(ts, F.lit(w)), F.lit(w).cast("long"))


def remainder(ts: Column, d: Duration | str) -> Column:
    """Milliseconds since the period of length d began."""
    return F.pmod(ts, F.lit(_positive(as_duration(d))).cast("long"))


def unix_day_of_week(ts: Column) -> Column:
    """0 is Thursday, the day of the epoch."""
    return bucket(remainder(ts, WEEK), DAY)


def unix_hour_of_day(ts: Column) -> Column:
    return bucket(remainder(ts, DAY), HOUR)


def unix_minute_of_day(ts: Column) -> Column:
    return bucket(remainder(ts, DAY), MINUTE)


def shifted(ts: Column, d: Duration) -> Column:
    """ts - d for a finite d; columns of real times never come near the ends of a long."""
    return ts - F.lit(d.ms).cast("long")
