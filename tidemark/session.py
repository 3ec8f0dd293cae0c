"""Session helpers: default settings, table loading, and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "tidemark", cpus: str | int = "*") -> SparkSession:
    """A local session with the settings the engine is tuned for.

    On a cluster the session comes from spark-submit; nothing here is required there but UTC.
    """
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # the place in the code of every column is noted for error messages at three calls to the JVM each
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, or the folder given to
    SparkContext.setCheckpointDir.

    Only a session that runs in one process (master `local`) makes a temporary folder where
    neither is set, and remembers it. On a cluster that would be another folder on each machine,
    and tables staged in it would be lost without an error: there it is an error at once.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tidemark.sharedDir", None)
    if not named:
        set_by_code = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_by_code.get() if set_by_code.isDefined() else None
    if not named:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^]]*\])?", master):
            raise ValueError(f"no folder that all executors share: set spark.checkpoint.dir (master {master})")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.tidemark.sharedDir", named)
    return named


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors. Unlike a checkpoint the
    table is columnar and compressed, and later scans prune its columns.
    """
    spark = df.sparkSession
    path = stage_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which clear_stages deletes."""
    return f"{_stages(spark)}/{name}-{uuid.uuid4().hex}"


def _stages(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tidemark/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Delete the tables this application has staged, once all results that read them are written.

    The command line and the benchmark do so after each result."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(_stages(spark))
    except ValueError:
        return  # nowhere to stage, so that nothing has been
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def code_of(col: Column) -> Column:
    """A currency code as it is compared: letter case and surrounding blanks do not matter."""
    return F.upper(F.trim(col))


def carried(df: DataFrame, outputs: list[str]) -> list[Column]:
    """The columns of df, with those that clash with an output name renamed to `<name>_in`.

    Names are compared as Spark does, without letter case. The operators of this package
    address the columns they need by the names they are given, so that any other column of
    the input is only passed on.
    """
    taken = {o.lower() for o in outputs}
    names = {c.lower() for c in df.columns} | taken
    out = []
    for c in df.columns:
        to = c
        if c.lower() in taken:
            to = f"{c}_in"
            while to.lower() in names:
                to += "_"
            names.add(to.lower())
        out.append(F.col(f"`{c}`").alias(to))
    return out
