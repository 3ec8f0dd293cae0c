"""Queries that pass whole tables through the readers, writers and validators, and the algebra of times."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import duration as D
from tidemark.functions import monoids as M
from tidemark.plans import graph as G
from tidemark.plans.graph import Label, Source
from tidemark.plans.lower import Engine
from tidemark.queries.engine import BY_USER, EVENTS, rounded
from tidemark.session import stage_path, table
from tidemark.sources import io as S
from tidemark.sources import validators as V


def csv_source(spark: SparkSession, d: str) -> DataFrame:
    """Events written as compressed rows with a header, read back by position, and summed up per user."""
    path = stage_path(spark, "csv")
    events = table(spark, d, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), "user_id", "value")
    S.write_csv(events, path)
    source = S.csv_source("rows", V.pure("at"), "event_id")
    keys = source.map("event_id", "user_id", "value").key_by("user_id")
    out = Engine(spark, {"rows": S.read_csv(spark, path, "event_id long, at long, user_id long, value double")}).run(keys.post_lookup(keys.sum(total=M.Sum("value"), n=M.Count())))
    return rounded(out.select("event_id", "total", "n"), "total")


def json_source(spark: SparkSession, d: str) -> DataFrame:
    """Orders through JSON lines, and regions through one JSON array."""
    lines, array = stage_path(spark, "lines"), stage_path(spark, "array")
    S.write_json(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), lines)
    regions = table(spark, d, "region").select("r_regionkey", "r_name")  # five rows at every scale
    regions.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).coalesce(1).write.text(array)
    orders = S.read(spark, lines, "json", "o_orderkey long, o_custkey long, o_totalprice double")
    back = S.read_json_array(spark, array, "r_regionkey int, r_name string")
    return orders.withColumn("r_regionkey", (F.col("o_custkey") % 5).cast("int")).join(back, "r_regionkey").select("o_orderkey", "o_totalprice", "r_name")


def zip_source(spark: SparkSession, d: str) -> DataFrame:
    """The lines of every file, put into one archive for each and read from it again."""

    def archive(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(key[0], "".join(x + "\n" for x in pdf.sort_values("raw_id")["line_text"]))
        return pd.DataFrame({"path": [key[0] + ".zip"], "content": [out.getvalue()]})

    lines = table(spark, d, "raw_lines").where("file_name is not null and line_text is not null and not contains(line_text, '\n')")
    files = lines.select("file_name", "raw_id", "line_text").groupBy("file_name").applyInPandas(archive, "path string, content binary")
    return S.zip_members(files).select("member", "line_no", "line")


def reshard_source(spark: SparkSession, d: str) -> DataFrame:
    """Events in a folder for each type, read back, with the type from the folder's name; two inputs of one name are merged."""
    path = stage_path(spark, "shards")
    events = table(spark, d, "events").select("event_id", "event_type", "value")
    S.reshard(events, path, ["event_type"], kind="parquet")
    back = spark.read.parquet(path).select("event_id", "event_type", "value")
    odd, even = (back.where(F.col("event_id") % 2 == r) for r in (1, 0))
    return S.Inputs(events=odd).combine(S.Inputs(events=even, unused=back)).bound()["events"]


def validated_times(spark: SparkSession, d: str) -> DataFrame:
    """Stamps of one form, local to a zone, a minute later; and the seconds of bars as text."""
    rows = table(spark, d, "first_rate_input").where(r"date_time rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$'")
    form = "yyyy-MM-dd HH:mm:ss"
    rows = rows.where(F.try_to_timestamp("date_time", F.lit(form)).isNotNull())  # a day that does not exist fails the run
    tokyo, utc = V.parse_and_shift(form, "Asia/Tokyo", "date_time", "1min"), V.shift_later(V.parse_utc(form, "date_time"), "2h")
    seconds = V.from_epoch_seconds_text("text")
    return rows.select("input_id", tokyo().alias("tokyo_ms"), utc().alias("utc_ms")).unionByName(
        table(spark, d, "events").select(F.unix_seconds(F.col("ts").cast("timestamp")).cast("string").alias("text"), "event_id").select((-F.col("event_id")).alias("input_id"), seconds().alias("tokyo_ms"), F.lit(None).cast("long").alias("utc_ms"))
    )


def durations(spark: SparkSession, d: str) -> DataFrame:
    """The algebra of durations and times, with its ends."""
    inf = D.INFINITE
    got = [
        ("year", D.YEAR.ms), ("quarter", D.QUARTER.ms), ("month", D.MONTH.ms), ("3days", D.parse_duration("3days").ms), ("250 ms", D.parse_duration("250 ms").ms),
        ("sum", (D.HOUR + D.MINUTE).ms), ("product", (D.WEEK * 3).ms), ("share", (D.HOUR / 7).ms), ("infinite", (inf + D.DAY).ms), ("infinite product", (inf * 2).ms),
        ("zero product", (inf * 0).ms), ("later", D.plus(5, D.SECOND)), ("latest", D.plus(5, inf)), ("held later", D.plus(D.LONG_MAX - 3, D.SECOND)),
        ("earlier", D.minus(5, D.SECOND)), ("earliest", D.minus(5, inf)), ("held earlier", D.minus(D.LONG_MIN + 3, D.SECOND)),
    ]
    return spark.createDataFrame(got, "name string, ms long")


def graph_facts(spark: SparkSession, d: str) -> DataFrame:
    """What a program reads and how much it may give, told from its graph alone."""
    label = Label.of(BY_USER.count("n")).look_forward("10min").look_forward("15min")
    node = BY_USER.pre_lookup(BY_USER.sum(s=M.Sum("value"))).labeled(label)
    sources = [(f"source {n}", float(x.ms)) for n, (_, offsets) in G.sources_and_offsets_of(node).items() for x in sorted(offsets)]
    many = (EVENTS + EVENTS.filter("value > 1")).concat_map("array(1, 2)")
    high = {"low": many.amplification.low, "high": many.amplification.high, "lookups": len(G.lookups_of(node)), "merged": len(G.sources_of(EVENTS + Source("orders", "0")))}
    return spark.createDataFrame(sources + [(k, None if v is None else float(v)) for k, v in high.items()], "name string, x double")


QUERIES = {f.__name__: f for f in (csv_source, json_source, zip_source, reshard_source, validated_times, durations, graph_facts)}

_VALUES = """('year', 31557600000), ('quarter', 7889400000), ('month', 2629800000), ('3days', 259200000), ('250 ms', 250), ('sum', 3660000), ('product', 1814400000), ('share', 514285),
('infinite', null), ('infinite product', null), ('zero product', 0), ('later', 1005), ('latest', 9223372036854775807), ('held later', 9223372036854775807), ('earlier', -995),
('earliest', -9223372036854775808), ('held earlier', -9223372036854775808)"""
SQL = {
    "csv_source": """select event_id, round(sum(value) over w + 1.234e-8, 6) + 0.0 total, count(*) over w n from events
window w as (partition by user_id order by ts, event_id rows unbounded preceding)""",
    "json_source": "select o_orderkey, o_totalprice, r_name from orders join region on r_regionkey = o_custkey % 5",
    "zip_source": r"""select file_name member, row_number() over (partition by file_name order by raw_id) - 1 line_no, line_text line from raw_lines
where file_name is not null and line_text is not null and not contains(line_text, chr(10))""",
    "reshard_source": "select event_id, event_type, value from events",
    "validated_times": """select input_id, epoch_ms(try_cast(date_time as timestamp)) - 32400000 + 60000 tokyo_ms, epoch_ms(try_cast(date_time as timestamp)) + 7200000 utc_ms
from first_rate_input where try_cast(date_time as timestamp) is not null and regexp_full_match(date_time, '[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}') union all select -event_id, epoch_us(ts) // 1000000 * 1000, null from events""",
    "durations": f"select * from (values {_VALUES}) v(name, ms)",
    "graph_facts": "select name, cast(x as double) x from (values ('source events', 0), ('source events', 1500000), ('low', 0), ('high', null), ('lookups', 1), ('merged', 2)) v(name, x)",
}
