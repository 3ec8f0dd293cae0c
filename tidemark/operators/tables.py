"""Sorting, comparing and summing up of whole tables."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stage


def sort_rows(df: DataFrame, ts: Column, *order: Column | str) -> DataFrame:
    """Rows in point order: by time, then by the columns given. An external range sort."""
    return df.orderBy(ts, *order)


def with_position(df: DataFrame, *order: str, name: str = "position") -> DataFrame:
    """df with the position of each row in a total order, from 0.

    Sorted by range, counted per task, and numbered from the counts of the tasks before: no task
    sees more than its part. Ties beyond `order` are broken arbitrarily.
    """
    ordered = stage(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "positions")
    # one row per task of the sort
    parts = ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()
    start, starts = 0, {}
    for r in sorted(parts, key=lambda r: r["_part"]):
        starts[r["_part"]] = start
        start += r["n"]
    table = F.create_map(*(F.lit(x).cast("long") for pair in starts.items() for x in pair)) if starts else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    low = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    return ordered.withColumn(name, table[F.col("_part").cast("long")] + low).drop("_part", "_at")


def diff_rows(left: DataFrame, right: DataFrame, order: list[str], limit_in: int | None = None, limit: int | None = None) -> DataFrame:
    """(position, column, left, right) of all cells that differ, comparing the n-th rows of both.

    Compared up to the shorter table, or the first limit_in rows; nulls are equal. limit: of rows.
    """
    names = [c for c in left.columns if c in right.columns]
    a = with_position(left.select(*names), *order)
    b = with_position(right.select(*names), *order)
    if limit_in is not None:
        a, b = (x.where(F.col("position") < limit_in) for x in (a, b))
    a = a.select("position", F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).alias("l"))
    b = b.select("position", F.struct(*(F.col(f"`{c}`").cast("string").alias(c) for c in names)).alias("r"))
    both = a.join(b, "position").where(~F.col("l").eqNullSafe(F.col("r")))
    if limit is not None:
        both = both.orderBy("position").limit(limit)
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"l.`{c}`").alias("left"), F.col(f"r.`{c}`").alias("right")) for c in names))
    return both.select("position", F.inline(F.filter(cells, lambda x: ~x["left"].eqNullSafe(x["right"]))))


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows of an order; each task keeps k at most."""
    return df.orderBy(*order).limit(k)


def threshold_stats(trades: DataFrame, thresholds: list[float], score: str, ts: str, amount: str, profit: str) -> DataFrame:
    """Per threshold statistics of the trades that score at least as much; one row for each threshold
    that some trade reaches. One scan, with partial aggregation: a task sends one row per threshold."""
    levels = F.array(*(F.lit(float(t)) for t in thresholds))
    rows = trades.select(F.explode(F.filter(levels, lambda t: F.col(score) >= t)).alias("threshold"), F.col(ts).alias("ts"), F.col(amount).alias("a"), F.col(profit).alias("p"))
    out = rows.groupBy("threshold").agg(
        F.min("ts").alias("min_ts"),
        F.max("ts").alias("max_ts"),
        F.count("*").alias("trades"),
        F.avg("a").alias("trade_mean"),
        F.stddev_pop("a").alias("trade_std"),
        F.max("a").alias("trade_max"),
        F.avg("p").alias("profit_mean"),
        F.stddev_pop("p").alias("profit_std"),
        F.min("p").alias("profit_min"),
    )
    safe = F.nullif(F.col("trade_mean"), F.lit(0.0))
    return out.withColumns({"mean_return": F.col("profit_mean") / safe, "two_sigma_return": (F.col("profit_mean") - 2 * F.col("profit_std")) / safe})


def balances(
    trades: DataFrame,
    keys: list[str],
    ts: str,
    order: str,
    amount: str,
    profit: str,
    initial: float,
    smallest: float,
    hold_ms: int = 900_000,
    release_when_rejected: bool = False,
) -> DataFrame:
    """(keys, last, high, low, entered) of a cash balance that follows the trades of each key in time order.

    A trade takes its amount, or what cash there is; less than `smallest` is not entered. Its
    proceeds come back after hold_ms, before the next trade is counted but after it has taken
    its cash. A rejected trade does not move the clock, so that nothing is released by it;
    release_when_rejected does the opposite. What is still out returns at the end.

    Each step depends on the one before, so one key is one task's work: rows stream through it
    in order, and it holds the open trades only.
    """
    rows = trades.select(*keys, F.col(ts).cast("long").alias("_ts"), F.col(order).alias("_order"), F.col(amount).cast("double").alias("_amount"), F.col(profit).cast("double").alias("_profit"))
    rows = rows.dropna(subset=["_ts", "_amount", "_profit"])
    rows = (rows.repartition(*keys) if keys else rows.repartition(1)).sortWithinPartitions(*keys, "_ts", "_order")

    class Account:
        def __init__(self) -> None:
            self.cash = self.high = self.low = float(initial)
            self.clock: int | None = None
            self.out: list[tuple[int, float, int]] = []
            self.entered = 0

        def note(self) -> None:
            self.high, self.low = max(self.high, self.cash), min(self.low, self.cash)

        def trade(self, at: int, wanted: float, gain: float) -> None:
            stake = min(wanted, self.cash)
            enters = not stake < smallest
            if enters:
                self.cash -= stake
                self.clock = at
            until = at if release_when_rejected else self.clock
            while self.out and until is not None and self.out[0][0] <= until:
                self.cash += heapq.heappop(self.out)[1]
            self.note()
            if enters:
                self.entered += 1
                share = stake / wanted if wanted else 0.0
                heapq.heappush(self.out, (at + hold_ms, stake + share * gain, self.entered))

        def close(self) -> tuple[float, float, float, int]:
            while self.out:
                self.cash += heapq.heappop(self.out)[1]
                self.note()
            return self.cash, self.high, self.low, self.entered

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, account, done = None, None, []
        for pdf in batches:
            names = zip(*(pdf[k] for k in keys), strict=True) if keys else ((),) * len(pdf)
            for k, at, wanted, gain in zip(names, pdf["_ts"], pdf["_amount"], pdf["_profit"], strict=True):
                if account is None or k != key:
                    if account is not None:
                        done.append((*key, *account.close()))
                    key, account = k, Account()
                account.trade(at, wanted, gain)
            if len(done) > 10_000:
                yield pd.DataFrame(done, columns=[*keys, "last", "high", "low", "entered"])
                done = []
        if account is not None:
            done.append((*key, *account.close()))
        if done:
            yield pd.DataFrame(done, columns=[*keys, "last", "high", "low", "entered"])

    kinds = dict(trades.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "last double, high double, low double, entered long"])
    return rows.mapInPandas(run, schema)


#: Instants of a dense table are dealt to blocks of so many.
BLOCK = 256


def dense_latest(readings: DataFrame, entity: str, at: str, order: str, values: list[str]) -> DataFrame:
    """(entity, bar, since, values): every entity at every instant at which any entity has a reading, from its
    own first one on, with its latest reading so far and the instant of that. Of the readings of an
    entity at one instant the last in `order` counts. Rows without entity or instant are left out.

    The grid itself is never moved or sorted. Instants are numbered over all entities, so that a
    reading holds for a span of numbers, up to the next reading of its entity. Spans are cut at blocks of BLOCK
    instants and joined with these: one row for each reading and each block of an entity,
    which becomes rows of the grid only when it is written. The join is never a broadcast, as
    Spark does not see that spans are cut into many rows; it looks blocks up, a few bytes for each
    instant, so that spans are not sorted either.
    """
    rows = readings.where(F.col(entity).isNotNull() & F.col(at).isNotNull())
    last = F.max(F.struct(F.col(order).alias("_order"), *(F.col(v).alias(v) for v in values))).alias("_last")
    one = stage(rows.groupBy(F.col(entity), F.col(at).cast("long").alias("since")).agg(last), "readings")
    bars = with_position(one.select(F.col("since").alias("bar")).distinct(), "bar", name="_n")
    count = (bars.agg(F.max("_n")).first()[0] or 0) + 1
    one = one.join(bars.select(F.col("bar").alias("since"), "_n"), "since")
    until = F.coalesce(F.lead("_n").over(Window.partitionBy(entity).orderBy("since")), F.lit(count).cast("long"))
    spans = one.withColumn("_until", until)
    block = lambda n: F.floor(n / BLOCK).cast("long")
    spans = spans.select("*", F.explode(F.sequence(block(F.col("_n")), block(F.col("_until") - 1))).alias("_block"))
    packs = bars.groupBy(block(F.col("_n")).alias("_block")).agg(F.sort_array(F.collect_list("bar")).alias("_bars"))
    begin = F.greatest(F.col("_n") - F.col("_block") * BLOCK, F.lit(0))
    end = F.least(F.col("_until") - F.col("_block") * BLOCK, F.lit(BLOCK))
    own = F.slice("_bars", (begin + 1).cast("int"), (end - begin).cast("int"))
    out = spans.join(packs.hint("shuffle_hash"), "_block").select(entity, "since", "_last", F.explode(own).alias("bar"))
    return out.select(entity, "bar", "since", *(F.col(f"_last.`{v}`").alias(v) for v in values))
