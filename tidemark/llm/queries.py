"""Queries of the operators of this folder, over whole tables and whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import encode, nearest, packing, pii
from tidemark.session import table

TOLERANCE_MS = 600_000


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nearest.match_nearest(
        table(spark, d, "stock_candles"),
        table(spark, d, "exchange_rates"),
        left_id="candle_id",
        left_key="currency",
        left_ms="candle_end_epoch_millis",
        right_id="rate_id",
        right_key="base_currency",
        right_ms="timestamp_epoch_millis",
        right_value="one_quote_in_base",
        tolerance_ms=TOLERANCE_MS,
    )


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode(table(spark, d, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    sizes = encode.encode(table(spark, d, "documents"), "doc_id", "text", count_only=True)
    return packing.pack(sizes, "doc_id", "n_tokens")


def p9_kept(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of all containers, as one row: no container over its capacity, no token lost or twice,
    no text split that would fit, every piece where the one before it ends, and at most one in a
    hundred containers more than the tokens fill."""
    sizes = encode.encode(table(spark, d, "documents"), "doc_id", "text", count_only=True)
    return packing.kept(sizes, packing.pack(sizes, "doc_id", "n_tokens"), "doc_id", "n_tokens")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents"), "doc_id", "text")


def p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p6_found, p8_ids, p9_containers, p9_kept, p10_found, p10_redacted)}
