"""Matching records by nearest time within a tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import code_of

#: Width of an index partition in tolerances: one in 16 intervals then also lies in a neighbour.
SPAN = 32
#: Left rows of one part of the index that one task merges.
PART_ROWS = 500_000


def interval_index(points: DataFrame, tolerance: int, span: int = SPAN) -> DataFrame:
    """(key, part, low, high, id): for each point of (key, t, id) the times nearest to it.

    Intervals are closed, disjoint per key, and end at the midpoint to the next point or at
    the tolerance. Of points at one time the smallest id stands for all; a time halfway
    between two points belongs to the earlier one. The index is cut into parts of equal time,
    so that a key of any share of the points is spread. A part also holds the points up to one
    tolerance outside of it: points further away reach no time inside, and neighbours missing
    at its rim are too far to matter.
    """
    width = tolerance * span
    lowest, highest = F.floor((F.col("t") - tolerance) / width), F.floor((F.col("t") + tolerance) / width)
    parted = points.select("key", "t", "id", F.explode(F.sequence(lowest, highest)).alias("part")).repartition("key", "part")
    one = parted.groupBy("key", "part", "t").agg(F.min("id").alias("id"))
    by = Window.partitionBy("key", "part").orderBy("t")
    before, after = F.lag("t").over(by), F.lead("t").over(by)
    half = lambda a, b: F.call_function("shiftright", a + b, F.lit(1))  # noqa: E731  (rounds down)
    return one.select(
        "key",
        "part",
        F.greatest(F.col("t") - tolerance, half(before, F.col("t")) + 1).alias("low"),
        F.least(F.col("t") + tolerance, half(F.col("t"), after)).alias("high"),
        "id",
    )


def match_nearest(
    left: DataFrame,
    right: DataFrame,
    left_id: str,
    left_key: str,
    left_ms: str,
    right_id: str,
    right_key: str,
    right_ms: str,
    right_value: str,
    tolerance_ms: int = 600_000,
    span: int = SPAN,
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """(left_id, right_id): each left row with the right row of its key nearest in time.

    Only right rows at most tolerance_ms away, before or after, count; of equally near ones the
    earlier, of those at one time the one with the smallest id. Keys are compared without
    letter case and surrounding blanks. Right rows with a null key, value, time or id match
    nothing; left rows without match are left out, repeated ones come out each for itself.

    The right side becomes a partitioned index of disjoint intervals. The range join is a
    merge inside each part: intervals and left times in one order, where the last interval
    begun is the only candidate. There is no row per pair of candidates.
    Parts are counted first: where many left rows meet in one (they may share an instant), they
    are salted into about part_rows each, and the part's intervals go to all of these. Its
    intervals are at most a few for each distinct time of the right side.
    """
    points = right.select(
        code_of(F.col(f"`{right_key}`")).alias("key"),
        F.col(f"`{right_ms}`").cast("long").alias("t"),
        F.col(f"`{right_id}`").cast("long").alias("id"),
        F.col(f"`{right_value}`").alias("value"),
    ).dropna()
    index = interval_index(points.select("key", "t", "id"), tolerance_ms, span)
    probes = left.select(
        code_of(F.col(f"`{left_key}`")).alias("key"),
        F.floor(F.col(f"`{left_ms}`") / (tolerance_ms * span)).alias("part"),
        F.col(f"`{left_ms}`").cast("long").alias("at"),
        F.col(f"`{left_id}`").alias("left_id"),
    ).where(F.col("key").isNotNull() & F.col("at").isNotNull())
    # a row for each part that is too dense, one in part_rows of the data at most
    dense = probes.groupBy("key", "part").count().where(F.col("count") > part_rows)
    dense = dense.select("key", "part", F.ceil(F.col("count") / part_rows).cast("int").alias("salts"))
    probes = probes.join(dense, ["key", "part"], "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("left_id", "at"), F.col("salts")).cast("int"), F.lit(0)))
    index = index.join(dense, ["key", "part"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    merged = probes.select("key", "part", "salt", "at", "left_id", F.lit(1).alias("probe")).unionByName(
        index.select("key", "part", "salt", F.col("low").alias("at"), F.lit(0).alias("probe"), F.struct("high", "id").alias("interval")),
        allowMissingColumns=True,
    )
    order = Window.partitionBy("key", "part", "salt").orderBy("at", "probe").rowsBetween(Window.unboundedPreceding, 0)
    out = merged.withColumn("last", F.last("interval", ignorenulls=True).over(order))
    out = out.where((F.col("probe") == 1) & (F.col("last.high") >= F.col("at")))
    return out.select(F.col("left_id").alias(left_id), F.col("last.id").alias(right_id))
