"""Reading the inputs and keeping intermediate results where every executor sees them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or else one in the warehouse.

    Without that setting the warehouse has to be a folder that executors share too: on a
    cluster, one of the driver's own machine is an error.
    """
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and warehouse.startswith(("file:", "/")):
        raise ValueError("spark.checkpoint.dir isn't set, and the warehouse is a folder of the driver's machine")
    return f"{warehouse}/_ledgerline"


def _place(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    at, system = _place(spark, path)
    system.deleteOnExit(at)
    return path


def kept(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read again.

    This cuts the lineage: a lost executor costs no recomputation of what led here.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove the files of a kept table that nothing reads any more."""
    at, system = _place(df.sparkSession, df.kept_at)
    system.delete(at, True)


def map_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply work to every Arrow batch of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def map_groups(df: DataFrame, key: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, rows: int = 5_000) -> DataFrame:
    """Apply work to tables of whole groups, sorted by key; as many groups at a time as give about ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < rows:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = 0
            for at in range(n - 1, 0, -1):
                if any(table.column(k)[at] != table.column(k)[at - 1] for k in key):
                    last = at
                    break
            if last:
                if (out := work(table.slice(0, last).combine_chunks())) is not None:
                    yield out
                table = table.slice(last)
            held, n = table.to_batches(), table.num_rows
        if n and (out := work(pa.Table.from_batches(held).combine_chunks())) is not None:
            yield out

    return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, schema)


def folded(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others as one column _rest, so that no other name of docs can clash."""
    others = [c for c in docs.columns if c not in names]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.lit(None).cast("string")
    return docs.select(*names, rest.alias("_rest"))


def unfolded(df: DataFrame, docs: DataFrame, *names: str, **changed: Column) -> DataFrame:
    """The columns of docs from a folded frame; ``changed`` gives new values for some, if docs has them."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col(c) if c in names else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))
