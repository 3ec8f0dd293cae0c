"""Attributes as they were in force and already known at the time of an event."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import code_of

#: Events and versions that a span of time of one entity is made of, and events of a salted part.
SPAN_ROWS = 100_000
#: Width of the buckets of time that spans are made of.
BUCKET_MS = 60_000


def _parted(e: DataFrame, v: DataFrame, span_rows: int, bucket_ms: int) -> tuple[DataFrame, DataFrame]:
    """Events and the versions they may need, both with key, span and part; a part is one task's work."""
    e = e.withColumn("bucket", F.floor(F.col("at") / bucket_ms))
    v = v.withColumn("bucket", F.floor(F.col("since") / bucket_ms))
    counted = e.select("key", "bucket", F.lit(1).alias("e")).unionByName(v.select("key", "bucket", F.lit(0).alias("e")))
    counted = counted.groupBy("key", "bucket").agg(F.count("*").alias("n"), F.sum("e").alias("e"))
    earlier = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.floor(F.coalesce(F.sum("n").over(earlier), F.lit(0)) / span_rows)
    spans = counted.select("key", "bucket", "e", cut.alias("span"))
    together = Window.partitionBy("key", "span")
    spans = spans.select("key", "bucket", "span", F.ceil(F.sum("e").over(together) / span_rows).alias("parts"), F.min("bucket").over(together).alias("begin"))
    spans = spans.withColumn("parts", F.greatest("parts", F.lit(1)).cast("int"))
    e = e.join(spans, ["key", "bucket"]).withColumn("part", F.pmod(F.xxhash64("event_id", "at"), F.col("parts")).cast("int"))
    v = v.join(spans, ["key", "bucket"])
    best = F.max(F.struct("valid", "known", "version", "value"))
    whole = spans.groupBy("key", "span").agg(F.max("parts").alias("parts"), F.min("begin").alias("begin"))
    tops = whole.join(v.groupBy("key", "span").agg(best.alias("best")), ["key", "span"], "left")
    before = Window.partitionBy("key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carry = tops.select("key", "span", "parts", "begin", F.max("best").over(before).alias("best")).where(F.col("best").isNotNull())
    carry = carry.select("key", "span", "parts", "best.*", (F.col("begin") * bucket_ms - 1).cast("long").alias("since"))
    usable = v.drop("bucket", "begin").unionByName(carry).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # both sides have columns of one origin, which aliases tell apart
    usable = usable.select(*(F.col(c).alias(c) for c in ("key", "span", "part", "valid", "known", "version", "value", "since")))
    return e.select(*(F.col(c).alias(c) for c in ("event_id", "at", "key", "span", "part"))), usable


def known_at(
    events: DataFrame,
    versions: DataFrame,
    event_id: str,
    event_key: str,
    event_ms: str,
    version_id: str,
    version_key: str,
    valid_ms: str,
    known_ms: str,
    value: str,
    span_rows: int = SPAN_ROWS,
    bucket_ms: int = BUCKET_MS,
) -> DataFrame:
    """(event_id, event_ms, version_id, value): each event with its version, if it has one.

    That is the version of the same key (letter case and blanks aside) with the largest
    valid_ms among those with both valid_ms and known_ms not after event_ms; ties go to the
    largest known_ms, then the largest version_id. Versions without key, value, either time or
    id and events without key or time match nothing; events without version are left out.
    Repeated events come out as often as they go in.

    A version can be used from max(valid_ms, known_ms) on, and the answer at an instant is the
    greatest (valid_ms, known_ms, id) usable by then: a prefix maximum. So each key splits into
    spans of time, whatever share of the rows it holds: the maximum of each span is found with
    a partial aggregation, its prefix goes into the following spans as one extra version, and
    a span of events is co-grouped with its versions and searched in a sorted array.

    Spans follow the rows, not the clock: rows are counted by key and bucket of bucket_ms, and a
    span ends once span_rows rows have come. A bucket in which more events than that lie is
    salted: its events go to parts of about so many, each with all its versions.
    """
    e = events.select(
        F.col(f"`{event_id}`").alias("event_id"),
        code_of(F.col(f"`{event_key}`")).alias("key"),
        F.col(f"`{event_ms}`").cast("long").alias("at"),
    ).where(F.col("key").isNotNull() & F.col("at").isNotNull())
    v = versions.select(
        code_of(F.col(f"`{version_key}`")).alias("key"),
        F.col(f"`{valid_ms}`").cast("long").alias("valid"),
        F.col(f"`{known_ms}`").cast("long").alias("known"),
        F.col(f"`{version_id}`").cast("long").alias("version"),
        F.col(f"`{value}`").cast("double").alias("value"),
    ).dropna()
    v = v.withColumn("since", F.greatest("valid", "known"))
    e, usable = _parted(e, v, span_rows, bucket_ms)

    def match(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["since"], kind="stable", ignore_index=True)
        rank = np.empty(len(right), np.int64)
        rank[np.lexsort((right["version"], right["known"], right["valid"]))] = np.arange(len(right))
        top = np.maximum.accumulate(rank) if len(right) else rank
        at = np.searchsorted(right["since"].to_numpy(), left["at"].to_numpy(), side="right") - 1
        left = left[at >= 0]
        by_rank = np.argsort(rank)
        chosen = right.iloc[by_rank[top[at[at >= 0]]]]
        return pd.DataFrame(
            {"event_id": left["event_id"].to_numpy(), "at": left["at"].to_numpy(), "version": chosen["version"].to_numpy(), "value": chosen["value"].to_numpy()}
        )

    kind = dict(e.dtypes)["event_id"]
    out = (
        e.groupBy("key", "span", "part")
        .cogroup(usable.groupBy("key", "span", "part"))
        .applyInPandas(match, f"event_id {kind}, at long, version long, value double")
    )
    return out.select(
        F.col("event_id").alias(event_id), F.col("at").alias(event_ms), F.col("version").alias(version_id), F.col("value").alias(value)
    )
