"""Files in and out: rankings and analyses as JSON, event text, request bodies, JSON results."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or else one in the warehouse.

    Without that setting the warehouse has to be a folder that executors share too: on a
    cluster, one of the driver's own machine is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and re.match(r"file:|/", warehouse):
        raise ValueError("spark.checkpoint.dir isn't set, and the warehouse is a folder of the driver's machine")
    return f"{warehouse}/_ledgerline"


def place(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    at, system = place(spark, path)
    system.deleteOnExit(at)
    return path


def settled(df: DataFrame, name: str = "round") -> DataFrame:
    """df, computed once: written to the shared folder and read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at, system = place(spark, path)
    return system.exists(at)


def marked(spark: SparkSession, path: str) -> None:
    """An empty file at path."""
    at, system = place(spark, path)
    system.create(at, True).close()


def listed(spark: SparkSession, path: str) -> list[str]:
    """The sorted names in a folder; none if there is no such folder."""
    at, system = place(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(at)) if system.exists(at) else []


def rankings(spark: SparkSession, path: str) -> DataFrame:
    """One row for each ranked stock of prediction files, with the file's analysis_date."""
    files = spark.read.schema(schemas.RANKINGS).option("multiLine", True).json(path)
    return files.select("analysis_date", F.explode("rankings").alias("r")).select("analysis_date", "r.*")


def analyses(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """investor, ticker, signal, confidence, reasoning of one JSON file for each investor."""
    out = None
    for investor, path in paths.items():
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(F.from_json("value", schemas.ANALYSES)).alias("ticker", "a")).select(F.lit(investor).alias("investor"), "ticker", "a.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def literal(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def model_catalog(spark: SparkSession, path: str | None, fallback: list[tuple[str, str, str]]) -> DataFrame:
    """display_name, model_name, provider of a JSON file, or of the given rows where there is no such file."""
    schema = "display_name string, model_name string, provider string"
    return spark.read.schema(schema).option("multiLine", True).json(path) if path and exists(spark, path) else spark.createDataFrame(fallback, schema)


def request_rows(bodies: DataFrame, column: str = "body", schema: str = schemas.BACKTEST_REQUEST) -> DataFrame:
    """Decoded request bodies with the reference's defaults; bad ones keep only ``_corrupt``."""
    parsed = F.from_json(column, schema)
    rows = bodies.select(F.when(parsed.isNull() | parsed["tickers"].isNull(), F.col(column)).alias("_corrupt"), parsed.alias("r")).select("_corrupt", "r.*")
    return rows.withColumns({"initial_capital": F.coalesce("initial_capital", F.lit(100000.0)), "margin_requirement": F.coalesce("margin_requirement", F.lit(0.0)), "model_name": F.coalesce("model_name", F.lit("gpt-4.1"))})


def events_of_text(df: DataFrame, column: str = "value") -> DataFrame:
    """type and the fields of every event in server-sent event text; works on batches and streams."""
    block = F.explode(F.split(F.col(column), "\n\n"))
    blocks = df.select(block.alias("b")).filter(F.trim("b") != "")
    parsed = F.from_json(F.regexp_extract("b", "(?m)^data: (.*)$", 1), schemas.EVENTS)
    return blocks.select(F.regexp_extract("b", "(?m)^event: (.*)$", 1).alias("event"), parsed.alias("e")).select("event", "e.*")


def event_text(kind: Column, data: Column) -> Column:
    return F.format_string("event: %s\ndata: %s\n\n", kind, F.to_json(data))


def save_json(df: DataFrame, folder: str, name: str) -> str:
    """Write df as JSON lines under a plain file name; the path."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", name) or name.startswith("."):
        raise ValueError(f"not a plain file name: {name!r}")
    path = f"{folder.rstrip('/')}/{name}"
    df.write.mode("overwrite").json(path)
    return path
