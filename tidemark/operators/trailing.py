"""Rolling totals over trailing calendar periods, quiet days included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def latest_rows(df: DataFrame, keys: dict[str, Column], version: Column, values: dict[str, Column]) -> DataFrame:
    """One row per keys: the values of the row with the largest version."""
    packed = F.struct(*(v.alias(k) for k, v in values.items()))
    one = df.groupBy(*(c.alias(k) for k, c in keys.items())).agg(F.max_by(packed, version).alias("_tm_last"))
    return one.select(*keys, *(F.col(f"_tm_last.{k}").alias(k) for k in values))


def trailing_totals(
    df: DataFrame,
    entity: str,
    start_ms: str,
    version: str,
    volume: str,
    close: str,
    periods: tuple[int, ...] = (7, 30),
) -> DataFrame:
    """(entity, day, volume_<n>, close_n_<n>, close_avg_<n> per period of n days).

    There is a row for every UTC day from the entity's first to its last row. A period of n
    days ends with the day itself. Of rows with equal entity and start only the one of the
    largest version counts; a null volume is 0, a null close is left out; an average over no
    close is null. Rows without entity or start have no place in the calendar and are left
    out. An empty table gives an empty result.

    Daily totals are joined to calendar days by range. Both sides meet in coarse buckets of
    as many days as the longest period, of which a total can reach two at most, so that a day
    sees less than two periods of candidates; the totals after the join need no shuffle of
    their own, as a day lies in one bucket. The widest row set is one row per entity and day.
    """
    rows = df.where(F.col(f"`{entity}`").isNotNull() & F.col(f"`{start_ms}`").isNotNull())
    day = F.floor(F.col("start") / DAY_MS).cast("int")
    last = latest_rows(
        rows,
        {"entity": F.col(f"`{entity}`"), "start": F.col(f"`{start_ms}`")},
        F.col(f"`{version}`"),
        {"volume": F.col(f"`{volume}`"), "close": F.col(f"`{close}`")},
    )
    daily = last.groupBy("entity", day.alias("day")).agg(
        F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"),
        F.sum("close").alias("close"),
        F.count("close").alias("n"),
    )
    longest = max(periods)
    bucket = F.floor(F.col("date") / longest).cast("int")
    calendar = (
        daily.groupBy("entity")
        .agg(F.min("day").alias("first"), F.max("day").alias("until"))
        .select("entity", F.explode(F.sequence("first", "until")).alias("date"))
        .withColumn("bucket", bucket)
    )
    reach = daily.select(
        "*",
        F.explode(
            F.array_distinct(F.array(F.floor(F.col("day") / longest).cast("int"), F.floor((F.col("day") + longest - 1) / longest).cast("int")))
        ).alias("bucket"),
    )
    inside = (F.col("t.day") <= F.col("c.date")) & (F.col("t.day") > F.col("c.date") - longest)
    pairs = calendar.alias("c").join(
        reach.alias("t"), (F.col("c.entity") == F.col("t.entity")) & (F.col("c.bucket") == F.col("t.bucket")) & inside, "left"
    )
    age = F.col("c.date") - F.col("t.day")
    sums = []
    for n in periods:
        sums += [
            F.coalesce(F.sum(F.when(age < n, F.col("t.volume"))), F.lit(0.0)).alias(f"volume_{n}"),
            F.coalesce(F.sum(F.when(age < n, F.col("t.n"))), F.lit(0)).alias(f"close_n_{n}"),
            F.sum(F.when(age < n, F.col("t.close"))).alias(f"close_sum_{n}"),
        ]
    out = pairs.groupBy(F.col("c.entity").alias("entity"), F.col("c.bucket").alias("bucket"), F.col("c.date").alias("date")).agg(*sums)
    return out.select(
        F.col("entity").alias(entity),
        F.date_from_unix_date("date").alias("day"),
        *(F.col(f"volume_{n}") for n in periods),
        *(F.col(f"close_n_{n}") for n in periods),
        *(F.try_divide(F.col(f"close_sum_{n}"), F.col(f"close_n_{n}")).alias(f"close_avg_{n}") for n in periods),
    )
