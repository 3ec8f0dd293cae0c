"""Mixed timestamp formats and zones to one UTC instant in epoch milliseconds."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stamps import Place, StampParser
from tidemark.functions.zones import ZoneTable

#: A book of exchanges larger than this is refused rather than collected.
MAX_PLACES = 10_000
#: All real instants of a number without unit lie from 1990 to 2030.
FIRST_S, END_S = 631_152_000, 1_893_456_000
#: Stamps that Spark reads as the parser does, if it reads them at all.
_PLAIN = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} UTC\z"


def place_book(exchanges: DataFrame) -> StampParser:
    """The parser for the places of a small table (exch_code, zone, std_abbr, dst_abbr, day_first).

    The table is a directory of exchanges, not data: it is collected, and refused beyond
    MAX_PLACES rows. Rows without code are skipped; a row without zone gives no zone.
    """
    rows = exchanges.select("exch_code", "zone", "std_abbr", "dst_abbr", "day_first").limit(MAX_PLACES + 1).collect()
    if len(rows) > MAX_PLACES:
        raise ValueError(f"more than {MAX_PLACES} places")
    zones = {z: ZoneTable.build(z) for z in {r.zone for r in rows if r.zone}}
    places, abbreviations = {}, {}
    for r in sorted((r for r in rows if r.exch_code is not None), key=lambda r: r.exch_code):
        zone = zones.get(r.zone)
        places[r.exch_code] = Place(zone, r.day_first)
        if zone is not None:
            standard, daylight = zone.seasons()
            if r.std_abbr:
                abbreviations.setdefault(r.std_abbr, standard)
            if r.dst_abbr:
                abbreviations.setdefault(r.dst_abbr, daylight)
    return StampParser(places, abbreviations)


def utc_millis(parser: StampParser, text: Column, code: Column) -> Column:
    """Column of epoch milliseconds of `text`, read as written at the place `code`.

    Null where no instant is named: null, empty, partial and impossible stamps, local times
    that a change of clocks skipped, and stamps without zone of an unknown place. Of a local
    time that occurs twice the earlier instant counts. Fractions are cut.
    """

    @F.arrow_udf("long")
    def parse(texts: pa.Array, codes: pa.Array) -> pa.Array:
        return parser(texts.cast(pa.string()), codes.cast(pa.string()))

    # else a later filter on the result would make Catalyst run the parser twice
    return parse.asNondeterministic()(text.cast("string"), code.cast("string"))


def with_utc_millis(df: DataFrame, parser: StampParser, text: str, code: str, name: str) -> DataFrame:
    """df with epoch milliseconds of the column `text`, read as written at the one place `code`, as the
    column `name`; rows that name no instant are left out.

    The form `yyyy-MM-dd HH:mm:ss UTC` is read without Python. Each other text is parsed once, however
    many rows have it, and joined to its rows, so that few Python workers start and see little.
    """
    stamp = F.col(f"`{text}`").cast("string")
    plain = F.when(stamp.rlike(_PLAIN), F.unix_millis(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss z"))))
    rest = df.where(plain.isNull() & stamp.isNotNull())
    stamps = rest.select(stamp.alias("_stamp")).distinct()
    stamps = stamps.select("_stamp", utc_millis(parser, F.col("_stamp"), F.lit(code)).alias(name)).where(F.col(name).isNotNull())
    read = rest.withColumn("_text", stamp).join(stamps.hint("merge"), F.col("_text") == F.col("_stamp")).drop("_text", "_stamp")
    return df.withColumn(name, plain).where(F.col(name).isNotNull()).unionByName(read)


def with_zone(parser: StampParser, code: str, zone: str) -> StampParser:
    """The same book, but with stamps of `code` that name no zone read in `zone`."""
    place = parser.places.get(code, Place(None, None))
    return StampParser(parser.places | {code: Place(ZoneTable.build(zone), place.day_first)}, parser.abbreviations)


def epoch_unit(value: Column) -> Column:
    """Units per second (1, 1000, 10^6, 10^9) of a number of unknown unit; null for no instant."""
    out = F.when(value.between(FIRST_S, END_S - 1), F.lit(1).cast("long"))
    for unit in (10**3, 10**6, 10**9):
        out = out.when(value.between(FIRST_S * unit, END_S * unit - 1), F.lit(unit).cast("long"))
    return out


def epoch_seconds(value: Column) -> Column:
    """A number in seconds, milli-, micro- or nanoseconds cut to whole seconds; null for no instant."""
    return _div(value, epoch_unit(value))


def epoch_millis(value: Column) -> Column:
    """The same to milliseconds, with finer fractions cut."""
    unit = epoch_unit(value)
    return F.when(unit == 1, value * 1000).otherwise(_div(value, _div(unit, F.lit(1000))))


def _div(value: Column, by: Column) -> Column:
    """Whole division of longs, exact beyond 2^53; null where the divisor is null or zero."""
    return F.call_function("div", value, F.nullif(by, F.lit(0).cast("long")))
