"""Progress events as streams: deduplication, results of drained streams, cancellation, ticks.

Keyed state is in ``state``, a run's events from start to end in ``bus``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import exists, shared_path
from .state import state_settings

def distinct_events(events: DataFrame, keys: list[str], within: str = "10 minutes") -> DataFrame:
    """Events without repeats of the keys; on a stream, repeats within the time."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def drained(stream: DataFrame, name: str, mode: str = "append", at_end: Callable[[DataFrame], None] | None = None) -> DataFrame:
    """All that a stream yields from the input that is there now, as a batch frame.

    Batches go to folders of their own number, so a repeated batch overwrites
    itself. ``at_end`` gets the result after the last batch: nothing is lost
    between the last row and the final event.
    """
    spark = stream.sparkSession
    base = shared_path(spark, name)
    schema = stream.schema

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows/batch={number}")

    with state_settings(spark):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
    any_batch = exists(spark, f"{base}/rows")
    out = spark.read.schema(schema).parquet(f"{base}/rows/*") if any_batch else spark.createDataFrame([], schema)
    if at_end:
        at_end(out)
    return out


def cancel(query: StreamingQuery) -> None:
    """End a stream, as a client's leaving does."""
    query.stop()


def ping(spark, rows: int = 5) -> DataFrame:
    """A stream of ``rows`` ticks, one a second: n, text."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load().filter(F.col("value") < rows)
    return ticks.select((F.col("value") + 1).alias("n"), F.format_string("Ping %d/%d", F.col("value") + 1, F.lit(rows)).alias("text"))
