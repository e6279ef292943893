"""An event queue in a shared folder: segments of numbered rows, and a streaming source over them.

A producer publishes frames of events; each becomes a segment, whose rows are numbered on
from those before, and then an entry of the index, which is what makes it visible. Consumers
read it as the streaming source ``event_queue``: its offset is the number of rows that were
published, so a query that is stopped goes on from its checkpoint with the next row. One
queue has one producer, as a run has one queue.

The folder has to be one that pyarrow can open on the driver and the executors, such as
file: (a shared mount), hdfs: or s3:.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.numbering import numbered
from .registry import known

OFFSET = "queue_offset"


def _index(path: str) -> list[dict]:
    """The entries of the queue's index, first segments first."""
    system, folder = fs.FileSystem.from_uri(path)
    found = system.get_file_info(fs.FileSelector(f"{folder}/index", allow_not_found=True))
    entries = []
    for name in sorted(x.path for x in found if x.path.endswith(".json")):
        with system.open_input_stream(name) as f:
            entries.append(json.loads(f.read()))
    return entries


def _end(entries: list[dict]) -> int:
    return entries[-1]["first"] + entries[-1]["count"] if entries else 0


def publish(events: DataFrame, path: str, order: list[str]) -> int:
    """Append events to the queue in the given order, as one segment; the number of rows published so far.

    A segment without an index entry, as a producer leaves that dies on the way, is not seen
    and is overwritten by the next call.
    """
    first = _end(_index(path))
    rows = numbered(events, order, OFFSET, start=first)
    segment = f"{path}/rows/segment={first:020d}"
    rows.write.mode("overwrite").parquet(segment)
    spark = events.sparkSession
    files = spark.read.parquet(segment).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(OFFSET).alias("first"), F.max(OFFSET).alias("last")).orderBy("first").collect()
    if not files:
        return first
    count = files[-1]["last"] + 1 - first
    system, folder = fs.FileSystem.from_uri(path)
    system.create_dir(f"{folder}/index")
    with system.open_output_stream(f"{folder}/index/{first:020d}.tmp") as f:
        f.write(json.dumps({"first": first, "count": count, "files": [[r["file"], r["first"], r["last"] + 1] for r in files]}).encode())
    system.move(f"{folder}/index/{first:020d}.tmp", f"{folder}/index/{first:020d}.json")  # all of the entry or none
    return first + count


class QueueReader(DataSourceStreamReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": _end(_index(self.path))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """A partition for each file that has rows between the offsets."""
        files = [f for entry in _index(self.path) for f in entry["files"]]
        return [InputPartition((name, max(first, start["rows"]), min(last, end["rows"]))) for name, first, last in files if first < end["rows"] and last > start["rows"]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        name, first, last = partition.value
        system, file = fs.FileSystem.from_uri(name)
        wanted = to_arrow_schema(self.schema)
        with system.open_input_file(file) as f:
            for batch in pq.ParquetFile(f).iter_batches():
                at = batch.column(batch.schema.get_field_index(OFFSET))
                batch = batch.filter(pc.and_(pc.greater_equal(at, first), pc.less(at, last)))
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)).cast(t) for n, t in zip(wanted.names, wanted.types, strict=True)], schema=wanted)

    def commit(self, end: dict) -> None:
        """Nothing: the segments stay for other consumers."""


class EventQueue(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_queue"

    def streamReader(self, schema: StructType) -> QueueReader:
        return QueueReader(self.options["path"], schema)


def queue_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The queue's events as a stream, with their numbers in ``queue_offset``; schema is that of the published frames."""
    known(spark, EventQueue)
    return spark.readStream.format("event_queue").option("path", path).schema(StructType([*schema.fields, StructField(OFFSET, LongType())])).load()
