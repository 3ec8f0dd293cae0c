"""Queries over the market tables: candles from ticks, histories and labels of bars and candles,
exchange rates, dense price tables, and the statistics of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import duration as D
from tidemark.functions import monoids as M
from tidemark.operators import normalise_time, tables
from tidemark.plans.graph import Label, Source
from tidemark.plans.lower import Engine
from tidemark.queries.engine import HOT_ROWS, rounded
from tidemark.session import code_of, table

TICKS = Source("stock_ticks", "timestamp_ms", "tick_id")
BARS = Source("finnhub_bar", "at_ms", "bar_id")
CANDLES = Source("stock_candles", "candle_end_epoch_millis", "candle_id")
RATES = Source("exchange_rates", "timestamp_epoch_millis", "rate_id")


def ticks_candles(spark: SparkSession, d: str) -> DataFrame:
    """A candle of the trailing five minutes at the first tick of every five-minute period."""
    ticks = TICKS.filter("price_micro_dollars is not null and volume is not null and symbol is not null").with_time()
    by_symbol = ticks.map("tick_id", "symbol", "time", "volume", price="price_micro_dollars").key_by("symbol")
    candle = by_symbol.window_sum(
        "5min", open=M.First("price"), high=M.Max("price"), low=M.Min("price"), close=M.Last("price"), total=M.Sum("volume"), ticks=M.Count()
    )
    before = by_symbol.latest("time").map(was="time")
    crossing = by_symbol.pre_lookup(before).post_lookup(candle).filter("was is null or was div 300000 <> time div 300000")
    out = crossing.values("symbol", "tick_id", "time", "open", "high", "low", "close", "total", "ticks")
    return Engine(spark, {"stock_ticks": table(spark, d, "stock_ticks")}, hot_rows=HOT_ROWS).run(out)


def ticks_targets(spark: SparkSession, d: str) -> DataFrame:
    """The candles made of ticks as the events of a job of their own: the volume of their last ten minutes, the
    volume-weighted price of that time, and the close 15 and 30 minutes later."""
    ticks = TICKS.filter("price_micro_dollars is not null and volume is not null and symbol is not null").with_time()
    by_symbol = ticks.map("tick_id", "symbol", "time", "volume", price="price_micro_dollars").key_by("symbol")
    candle = by_symbol.window_sum("5min", high=M.Max("price"), low=M.Min("price"), close=M.Last("price"), total=M.Sum("volume"), paid=M.Sum("cast(price as double) * volume"))
    before = by_symbol.latest("time").map(was="time")
    crossing = by_symbol.pre_lookup(before).post_lookup(candle).filter("was is null or was div 300000 <> time div 300000")
    candles = crossing.map("tick_id", "symbol", "close", "total", "paid", vwap="paid / nullif(total, 0)", digits="length(cast(close as string))").key_by("symbol")
    recent = candles.window_sum("10min", total_10=M.Sum("total"), candles_10=M.Count())
    later = Label.of(candles.latest("close", "total"))
    label = later.look_forward("15min").map(c15="close", v15="total").zip(later.look_forward("30min").map(c30="close", v30="total"))
    out = candles.post_lookup(recent).labeled(label).map("tick_id", "digits", "total_10", "candles_10", "v15", "v30", vwap="round(vwap, 3)", c15="c15", c30="c30")
    return rounded(Engine(spark, {"stock_ticks": table(spark, d, "stock_ticks")}, hot_rows=HOT_ROWS).run(out), "vwap")


def candle_targets(spark: SparkSession, d: str) -> DataFrame:
    """The whole candle job: rates looked up by currency, six decays of linear and logarithmic moments of the
    close with z-scores, and five labels zipped: turnover and volume of ten minutes from now on,
    the close and volume 15 and 30 minutes later, and turnover and volume from then on."""
    candles = table(spark, d, "stock_candles").withColumn("code", code_of(F.col("currency")))
    rates = table(spark, d, "exchange_rates").withColumn("code", code_of(F.col("base_currency")))
    rates = rates.where("code is not null and one_quote_in_base is not null")
    rate = RATES.map("code", rate="one_quote_in_base").key_by("code").latest("rate")
    priced = CANDLES.map("candle_id", "symbol", "code", "close", "volume").key_by("code").post_lookup(rate).with_time("at_ms")
    usd = "case when code = 'USD' then close * volume else close * volume / rate end"
    minute, weekday = (lambda: D.unix_minute_of_day(F.col("at_ms"))), (lambda: D.unix_day_of_week(F.col("at_ms")))
    rows = priced.map("candle_id", "symbol", "close", "volume", usd=usd, log_close="ln(close + 1e-6)", minute=minute, weekday=weekday).key_by("symbol")
    moments = rows.sum(**{f"{n}_{x}": M.DecayedMoments.of(c, x) for n, c in (("lin", "close"), ("log", "log_close")) for x in M.DECAYS})
    ten = Label.of(rows.window_sum("10min", usd_10=M.Sum("usd"), vol_10=M.Sum("volume"))).look_forward("10min")
    latest = Label.of(rows.latest("close", "volume"))
    label = ten.map(entry_usd="usd_10", entry_vol="vol_10").zip(latest.look_forward("15min").map(c15="close", v15="volume"))
    label = label.zip(latest.look_forward("30min").map(c30="close", v30="volume"))
    label = label.zip(ten.look_forward("15min").map(exit15_usd="usd_10", exit15_vol="vol_10")).zip(ten.look_forward("30min").map(exit30_usd="usd_10", exit30_vol="vol_10"))
    # where values differ by less than a thousandth a z-score says nothing
    score = lambda n, c, x: f"case when {n}_{x}_std < 1e-3 * abs({n}_{x}_mean) then 0 else ({c} - {n}_{x}_mean) / {n}_{x}_std end"
    z = {f"{n}_z_{x}": score(n, c, x) for n, c in (("lin", "close"), ("log", "log_close")) for x in M.DECAYS}
    means = [f"{n}_{x}_mean" for n in ("lin", "log") for x in M.DECAYS]
    plain = ("entry_vol", "c15", "v15", "c30", "v30", "exit15_vol", "exit30_vol")
    gains = {"gain15": "c15 / nullif(close, 0) - 1", "gain30": "c30 / nullif(close, 0) - 1"}
    out = rows.post_lookup(moments).labeled(label).map("candle_id", "minute", "weekday", *plain, "entry_usd", "exit15_usd", "exit30_usd", *means, **z, **gains)
    out = Engine(spark, {"stock_candles": candles, "exchange_rates": rates}, hot_rows=HOT_ROWS).run(out)
    out = out.withColumns({n: F.round(F.col(n) + 1.234e-5, 2) for n in ("entry_usd", "exit15_usd", "exit30_usd")})
    return rounded(out, *means, *z, *gains)


def candles_usd(spark: SparkSession, d: str) -> DataFrame:
    """Candles with the latest rate of their currency, turnover of the last three days in dollars,
    and the close a day later: lookups on two keys, a window and a label."""
    candles = table(spark, d, "stock_candles").withColumn("code", code_of(F.col("currency")))
    rates = table(spark, d, "exchange_rates").withColumn("code", code_of(F.col("base_currency")))
    rates = rates.where("code is not null and one_quote_in_base is not null")
    rate = RATES.map("code", rate="one_quote_in_base").key_by("code").latest("rate")
    priced = CANDLES.map("candle_id", "symbol", "code", "close", "volume").key_by("code").post_lookup(rate)
    turnover = "case when code = 'USD' then close * volume else close * volume / rate end"
    rows = priced.map("candle_id", "symbol", "close", "rate", usd=turnover).key_by("symbol")
    recent = rows.window_sum("3d", usd_3d=M.Sum("usd"), n_3d=M.Count())
    past = rows.latest("close").map(last_close="close")
    future = Label.of(rows.filter("close is not null").latest("close").map(next_close="close")).look_forward("1d")
    labeled = rows.pre_lookup(past).post_lookup(recent).labeled(future).map("candle_id", "rate", "usd_3d", "n_3d", "last_close", gain="next_close / nullif(close, 0) - 1")
    out = Engine(spark, {"stock_candles": candles, "exchange_rates": rates}, hot_rows=HOT_ROWS).run(labeled)
    return out.withColumns({"usd_3d": F.round(F.col("usd_3d") + 1.234e-5, 2), "gain": F.round(F.col("gain") + 1.234e-8, 6) + 0.0})


def bar_history(spark: SparkSession, d: str) -> DataFrame:
    """Moments and z-score of the log close so far, its decayed mean, and the close 15 and 30 minutes later."""
    bars = table(spark, d, "finnhub_bar").withColumn("at_ms", normalise_time.epoch_seconds(F.col("timestamp_seconds")) * 1000)
    bars = bars.where("at_ms is not null and symbol is not null and resolution is not null and close > 0")
    rows = BARS.map("bar_id", "symbol", "resolution", "close", log_close="ln(close)").key_by("symbol", "resolution")
    history = rows.sum(m=M.Moments("log_close"), d=M.DecayedMoments.of("log_close", "1d"))
    later = Label.of(rows.latest("close"))
    label = later.look_forward("15min").map(c15="close").zip(later.look_forward("30min").map(c30="close"))
    z = lambda: M.zscore(F.col("log_close"), F.col("m_mean"), F.col("m_std"))
    out = rows.post_lookup(history).labeled(label).map("bar_id", "m_n", "m_mean", "d_mean", "c15", "c30", z=z)
    return rounded(Engine(spark, {"finnhub_bar": bars}, hot_rows=HOT_ROWS).run(out), "m_mean", "d_mean", "z")


def _hk_bars(spark: SparkSession, d: str) -> DataFrame:
    hk = table(spark, d, "hk_stocks").where("symbol is not null and close is not null")
    return hk.select("hk_id", "symbol", F.col("close").cast("double").alias("close"), "volume", "bar_start_utc")


def _dense(hk: DataFrame) -> DataFrame:
    """Every symbol at every bar end since it was first seen, with its close so far and the bar's
    volume, which is 0 where the symbol has no bar. Rows without start_ms are left out."""
    minutes = F.when(F.hour(F.timestamp_millis("start_ms")) == 1, 30).otherwise(60)
    hk = hk.select("hk_id", "symbol", "close", "volume", (F.col("start_ms") + minutes * 60_000).alias("bar_end"))
    hk = hk.where("bar_end is not null")
    out = tables.dense_latest(hk, "symbol", "bar_end", "hk_id", ["close", "volume"])
    volume = F.when(F.col("since") == F.col("bar"), F.col("volume")).otherwise(0)
    return out.select("symbol", "bar", "close", volume.alias("volume"))


def dense_bars(spark: SparkSession, d: str) -> DataFrame:
    """The dense table of the bars whose start is written `yyyy-MM-dd HH:mm:ss UTC`, as its SQL has it.

    Rows in any other form are dropped: 3,681 of the 20,000 of sf0.1, though 3,386 of them name
    an instant. `dense_bars_all` keeps those.
    """
    start_ms = F.unix_millis(F.try_to_timestamp("bar_start_utc", F.lit("yyyy-MM-dd HH:mm:ss 'UTC'")))
    return _dense(_hk_bars(spark, d).withColumn("start_ms", start_ms))


def dense_bars_all(spark: SparkSession, d: str) -> DataFrame:
    """The dense table of all bars, with starts read in any form as p5_found reads them; only rows
    that name no instant are left out. Starts without zone are UTC."""
    book = normalise_time.with_zone(normalise_time.place_book(table(spark, d, "exchanges")), "QHK", "UTC")
    return _dense(normalise_time.with_utc_millis(_hk_bars(spark, d), book, "bar_start_utc", "QHK", "start_ms"))


def _trades(spark: SparkSession, d: str) -> DataFrame:
    """Trades made of events: the score is props.k / 100, the amount the value, the gain follows both."""
    e = table(spark, d, "events")
    score = (F.get_json_object("props", "$.k").cast("double") / 100).alias("score")
    ts = F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")
    return e.select("event_id", "event_type", "user_id", ts, score, (F.col("value") * 100).alias("amount"), (F.col("value") - 40).alias("profit"))


def threshold_stats(spark: SparkSession, d: str) -> DataFrame:
    out = tables.threshold_stats(_trades(spark, d), [0.0, 0.25, 0.5, 0.75, 0.9], "score", "ts_ms", "amount", "profit")
    numbers = [c for c, kind in out.dtypes if kind == "double" and c != "threshold"]
    return rounded(out, *numbers)


def balance_sim(spark: SparkSession, d: str) -> DataFrame:
    good = _trades(spark, d).where("score >= 0.25")
    out = tables.balances(good, ["event_type"], "ts_ms", "event_id", "amount", "profit", initial=25_000.0, smallest=50.0)
    return rounded(out, "last", "high", "low")


def sort_inputs(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return tables.with_position(orders, "o_orderdate", "o_orderkey").select("o_orderkey", "position")


def diff_rows(spark: SparkSession, d: str) -> DataFrame:
    left = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    right = left.withColumn("s_nationkey", F.when(F.col("s_nationkey") > 20, 20).otherwise(F.col("s_nationkey")))
    return tables.diff_rows(left, right, ["s_suppkey"])


def top_values(spark: SparkSession, d: str) -> DataFrame:
    """A report of the 25 largest orders."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return tables.top_k(orders, 25, F.desc("o_totalprice"), F.col("o_orderkey"))


QUERIES = {f.__name__: f for f in (ticks_candles, ticks_targets, candle_targets, candles_usd, bar_history, dense_bars, dense_bars_all, threshold_stats, balance_sim, sort_inputs, diff_rows, top_values)}
