"""Queries of the data-preparation operators of the core, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import bad_rows, known_at, normalise_time, regular_grid, spikes, trailing
from tidemark.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "raw_lines").select("raw_id", "line_text")
    return bad_rows.rejects(lines, "line_text", keep_text=False).select("raw_id", "reason")


def p1_records(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "raw_lines").select("raw_id", "file_name", "line_no", "line_text")
    good = bad_rows.records(lines, "line_text")
    return good.select("raw_id", F.unix_millis(F.col("date_time").cast("timestamp")).alias("ts_ms"), "open", "high", "low", "close", "volume")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    book = normalise_time.place_book(table(spark, d, "exchanges"))
    first = table(spark, d, "first_rate_input").select(
        F.lit("first_rate_input").alias("src"),
        F.col("input_id").alias("rec_id"),
        normalise_time.utc_millis(book, F.col("date_time"), F.col("exch_code")).alias("utc_ms"),
    )
    hong_kong = normalise_time.with_zone(book, "QHK", "UTC")
    usual = F.coalesce(F.col("bar_start_utc").rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2} UTC\z"), F.lit(False))
    hk = (
        table(spark, d, "hk_stocks")
        .where(~usual)
        .select(
            F.lit("hk_stocks").alias("src"),
            F.col("hk_id").alias("rec_id"),
            normalise_time.utc_millis(hong_kong, F.col("bar_start_utc"), F.lit("QHK")).alias("utc_ms"),
        )
    )
    value = F.col("timestamp_seconds")
    bars = (
        table(spark, d, "finnhub_bar")
        .where(normalise_time.epoch_unit(value) > 1)
        .select(F.lit("finnhub_bar").alias("src"), F.col("bar_id").alias("rec_id"), normalise_time.epoch_millis(value).alias("utc_ms"))
    )
    return first.unionByName(hk).unionByName(bars).where(F.col("utc_ms").isNotNull())


def p4_totals(spark: SparkSession, d: str) -> DataFrame:
    candles = table(spark, d, "stock_candles")
    out = trailing.trailing_totals(candles, "symbol", "candle_start_epoch_millis", "candle_id", "volume", "close")
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    busy = F.col("volume_7") / 7 > 2 * F.col("volume_30") / 30
    cheap = F.col("close_avg_7") < 0.995 * F.col("close_avg_30")
    return p4_totals(spark, d).where(busy & cheap).select("symbol", "day")


def p7_known(spark: SparkSession, d: str) -> DataFrame:
    return known_at.known_at(
        table(spark, d, "stock_candles"),
        table(spark, d, "exchange_rates"),
        event_id="candle_id",
        event_key="currency",
        event_ms="candle_end_epoch_millis",
        version_id="rate_id",
        version_key="base_currency",
        valid_ms="timestamp_epoch_millis",
        known_ms="received_epoch_millis",
        value="one_quote_in_base",
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_known(spark, d).select("candle_id", "rate_id")


#: The rule of the cases asked for: one context for all hours, and fences at 15 and 20 medians.
TICK_RULES = (
    spikes.Rule(least=0, barred=True, relative=True, expand=14, low=None, high=0.5, by_hour=False),  # price_micro_dollars, close
    spikes.Rule(least=0, barred=False, relative=False, expand=19, low=None, high=0.5, by_hour=False),  # volume
)


def p2_hourly(spark: SparkSession, d: str) -> DataFrame:
    """The operator with fences of its own method: interquartile fences of each source and hour, expanded
    eight times, on the departure from the local level."""
    ticks = table(spark, d, "stock_ticks").select(
        F.col("symbol").alias("source"), F.col("timestamp_ms").alias("t"), F.col("tick_id").alias("rec_id"), F.col("price_micro_dollars").cast("double").alias("price")
    )
    found = spikes.implausible(ticks, (spikes.Rule(least=0, barred=True, relative=True, expand=8),))
    return found.select(F.col("rec_id").alias("tick_id"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    ticks = table(spark, d, "stock_ticks").select(
        F.concat(F.lit("t"), F.col("symbol")).alias("source"),
        F.col("timestamp_ms").alias("t"),
        F.col("tick_id").alias("rec_id"),
        F.col("price_micro_dollars").cast("double").alias("price"),
        F.col("volume").cast("double").alias("volume"),
    )
    bars = table(spark, d, "finnhub_bar").select(
        F.concat(F.lit("b"), F.col("resolution").cast("string"), F.lit("|"), F.col("symbol")).alias("source"),
        (normalise_time.epoch_seconds(F.col("timestamp_seconds")) * 1000).alias("t"),
        F.col("bar_id").alias("rec_id"),
        F.col("close").alias("price"),
        F.lit(None).cast("double").alias("volume"),
    )
    found = spikes.implausible(ticks.unionByName(bars), TICK_RULES)
    tick = F.col("source").startswith("t")
    return found.select(
        F.when(tick, "stock_ticks").otherwise("finnhub_bar").alias("src"),
        "rec_id",
        F.when(F.col("field") == 1, "volume").when(tick, "price_micro_dollars").otherwise("close").alias("field"),
    )


def _grid(spark: SparkSession, d: str, only_gaps: bool) -> DataFrame:
    bars = table(spark, d, "finnhub_bar")
    out = regular_grid.regular_grid(
        bars,
        source=F.col("symbol"),
        resolution=F.col("resolution"),
        seconds=normalise_time.epoch_seconds(F.col("timestamp_seconds")),
        value=F.col("close"),
        tie=F.col("bar_id"),
        only_gaps=only_gaps,
    )
    return out.withColumnRenamed("source", "symbol").withColumn("resolution", F.col("resolution").cast("int"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, True).select("symbol", "resolution", "slot_seconds")


def p3_states(spark: SparkSession, d: str) -> DataFrame:
    """The series with what is certain of it: the state of each period, and the values that are observed."""
    out = _grid(spark, d, False)
    return out.withColumn("value", F.when(F.col("state") == "observed", F.col("value")))


def p3_series(spark: SparkSession, d: str) -> DataFrame:
    return _grid(spark, d, False)


QUERIES = {
    f.__name__: f for f in (p1_found, p1_records, p2_found, p2_hourly, p3_found, p3_series, p3_states, p4_found, p5_found, p7_found)
}
