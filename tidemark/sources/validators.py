"""How a row's time is read: expressions for epoch milliseconds that fail the run on bad input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.duration import Duration, as_duration

Validator = Callable[[], Column]


def _required(ts: Column, text: Column, what: str) -> Column:
    return F.when(ts.isNotNull(), ts).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(text.cast("string"), F.lit("null")))).cast("long"))


def pure(column: str) -> Validator:
    """A column that is epoch milliseconds already; null is a missing timestamp."""
    return lambda: _required(F.col(column).cast("long"), F.lit(column), "missing timestamp")


def from_epoch_seconds_text(column: str) -> Validator:
    return lambda: _required(F.col(column).try_cast("long") * 1000, F.col(column), "no epoch seconds")


def parse_and_shift(pattern: str, zone: str, column: str, shift: Duration | str | int = 0) -> Validator:
    """Text by a date pattern, local to a zone, and then later by `shift`."""
    ms = as_duration(shift).ms

    def build() -> Column:
        at = F.unix_millis(F.to_utc_timestamp(F.try_to_timestamp(F.col(column), F.lit(pattern)), zone))
        return _required(at, F.col(column), "timestamp does not parse") + F.lit(ms).cast("long")

    return build


def parse_utc(pattern: str, column: str, shift: Duration | str | int = 0) -> Validator:
    return parse_and_shift(pattern, "UTC", column, shift)


def shift_later(validator: Validator, by: Duration | str | int) -> Validator:
    ms = as_duration(by).ms
    return lambda: validator() + F.lit(ms).cast("long")
