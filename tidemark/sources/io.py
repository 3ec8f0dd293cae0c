"""Readers and writers, and the binding of named sources to inputs.

Spark reads and writes local paths, s3a:// and other file systems alike, and unpacks .gz by
the file's name.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.naming import flatten
from tidemark.plans.graph import Source

DUMMY = "_dummy"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | T.StructType, header: bool = True) -> DataFrame:
    """Delimited rows by position: the header line is skipped unread, blank lines are dropped, and a
    row that does not fit the schema fails the run (operators.bad_rows keeps such rows instead)."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST").option("enforceSchema", "true")
    return reader.csv(path, header=header)


def read_json_array(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Files that hold one JSON array of objects each. A file is one task's work; prefer JSON lines."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path, multiLine=True)


def read(spark: SparkSession, path: str | list[str], kind: str, schema: str | T.StructType | None = None, **options: str) -> DataFrame:
    """Any format Spark knows, for instance parquet, orc, json lines or a table."""
    reader = spark.read.format(kind).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def read_query(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A SQL query over JDBC. Give partitionColumn, lowerBound, upperBound and numPartitions to read in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    return (reader.option("dbtable", f"({query}) as q") if "partitionColumn" in options else reader.option("query", query)).load()


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_zip_members(spark: SparkSession, path: str, pattern: str = ".*") -> DataFrame:
    """(archive, member, line_no, line) of all text members of zip archives whose name matches.

    Archives spread over tasks, and a member is streamed line by line; an archive itself is read
    whole by one task, as the format has its directory at the end.
    """
    return zip_members(spark.read.format("binaryFile").load(path).select("path", "content"), pattern)


def zip_members(files: DataFrame, pattern: str = ".*") -> DataFrame:
    """The same of archives that are rows (path, content) already."""
    import re

    wanted = re.compile(pattern)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(n for n in z.namelist() if not n.endswith("/") and wanted.search(n)):
                        with io.TextIOWrapper(z.open(member), "utf-8", errors="replace", newline="\n") as lines:
                            rows: list[tuple[int, str]] = []
                            for i, line in enumerate(lines):
                                rows.append((i, line.rstrip("\n")))
                                if len(rows) == 50_000:
                                    yield _lines(archive, member, rows)
                                    rows = []
                            if rows:
                                yield _lines(archive, member, rows)

    return files.mapInPandas(run, "archive string, member string, line_no long, line string")


def _lines(archive: str, member: str, rows: list[tuple[int, str]]) -> pd.DataFrame:
    return pd.DataFrame({"archive": archive, "member": member, "line_no": [r[0] for r in rows], "line": [r[1] for r in rows]})


def member_symbol(member: str = "member") -> list:
    """Columns symbol and year of member names like `ticker_A_C/ABC_2000_2009.txt`; null for others."""
    form = r"^[^/]+/([A-Z]+)_(20\d\d)_20\d\d\.txt$"
    symbol, year = F.regexp_extract(member, form, 1), F.regexp_extract(member, form, 2)
    return [F.nullif(symbol, F.lit("")).alias("symbol"), F.nullif(year, F.lit("")).cast("int").alias("year")]


# --- sinks --------------------------------------------------------------------------------


def write_csv(df: DataFrame, path: str, compress: bool = True, one_file: bool = False, mode: str = "errorifexists") -> None:
    """Header and rows, nested columns flattened to dotted names. one_file is for small results."""
    flat = flatten(df)
    (flat.coalesce(1) if one_file else flat).write.mode(mode).csv(path, header=True, compression="gzip" if compress else "none")


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line."""
    df.write.mode(mode).json(path)


def tap(df: DataFrame, path: str) -> DataFrame:
    """Writes df and goes on with what was written, so that it is computed once."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reshard(df: DataFrame, path: str, by: list[str], rows_per_file: int = 5_000_000, kind: str = "csv") -> None:
    """Rows partitioned into folders by columns, such as symbol, year and month.

    Rows are shuffled by the columns so that a folder gets few files; AQE splits large ones.
    """
    spread = df.hint("rebalance", *by)
    writer = spread.write.partitionBy(*by).option("maxRecordsPerFile", rows_per_file)
    writer.option("header", "true").option("compression", "gzip").format(kind).save(path) if kind == "csv" else writer.format(kind).save(path)


# --- binding ------------------------------------------------------------------------------


class Inputs:
    """Inputs by source name. One name may have several, which are merged; names of no source are ignored."""

    def __init__(self, **frames: DataFrame):
        self.frames: dict[str, list[DataFrame]] = {n: [f] for n, f in frames.items()}

    def add(self, name: str, df: DataFrame) -> Inputs:
        self.frames.setdefault(name, []).append(df)
        return self

    def combine(self, other: Inputs) -> Inputs:
        out = Inputs()
        for side in (self, other):
            for n, frames in side.frames.items():
                out.frames.setdefault(n, []).extend(frames)
        return out

    def bound(self) -> dict[str, DataFrame]:
        return {n: reduce(DataFrame.unionByName, frames) for n, frames in self.frames.items()}

    @staticmethod
    def from_paths(spark: SparkSession, pairs: list[tuple[str, str]], schemas: dict[str, str] | None = None) -> Inputs:
        """name=path pairs; the format follows the path: .csv, .csv.gz, .json, else parquet."""
        out = Inputs()
        for name, path in pairs:
            plain = path.removesuffix(".gz")
            schema = (schemas or {}).get(name)
            if plain.endswith(".csv"):
                df = read_csv(spark, path, schema) if schema else spark.read.csv(path, header=True, inferSchema=True)
            elif plain.endswith(".json"):
                df = read(spark, path, "json", schema)
            else:
                df = read(spark, path, "parquet", schema)
            out.add(name, df)
        return out


def csv_source(name: str, ts, order=None, columns: tuple[str, ...] | None = None) -> Source:
    """A named source; its input is bound when the engine is made."""
    return Source(name, ts, order, columns)
