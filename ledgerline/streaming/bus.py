"""A run's event bus: rows of a stream, in numbered batches, to any number of sinks, with one start and one end.

Every micro-batch is first written to the bus's folder under its number, as rows of

    run_id, batch, type (start, progress, complete or error), data (JSON)

and then delivered to each sink in order. A sink is a function of a frame and the batch's
number; it has to overwrite what it has under that number, because a batch whose delivery
broke off comes again. What a sink has had is marked in the folder, so a sink that fails
stops no other one: its batches stay due, and are delivered before any later one when the
next batch comes, or with ``catch_up``. The run's id is part of every row, so sinks can
serve many runs.

A run that is started again with the same folder goes on where it was; a run has exactly
one start, before all rows, and one end, after them, ``error`` if the query has failed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.files import exists, listed, marked
from .state import state_settings

Sink = Callable[[DataFrame, int], None]
BUS = "run_id string, batch long, type string, data string"
#: Batches of the query are numbered from 1: 0 is the start.
FIRST = 1


@dataclass
class Progress:
    """What a query has reported while it ran: rows of each batch, and how it ended."""

    rows: dict[int, int] = field(default_factory=dict)
    error: str | None = None

    def total(self) -> int:
        return sum(self.rows.values())


class Watch(StreamingQueryListener):
    """Calls ``told`` with (batch, rows) for each batch of one query, from what the query has observed."""

    def __init__(self, name: str, told: Callable[[int, int], None]):
        self.name, self.told, self.ended = name, told, False

    def onQueryStarted(self, event) -> None:
        """Nothing: the bus writes the start itself."""

    def onQueryProgress(self, event) -> None:
        if seen := event.progress.observedMetrics.get(self.name):
            self.told(event.progress.batchId, seen.n)

    def onQueryTerminated(self, event) -> None:
        """Nothing: the bus writes the end, after the last row."""


@dataclass
class Bus:
    spark: SparkSession
    folder: str
    run_id: str
    sinks: dict[str, Sink]
    failures: list[tuple[str, int, str]] = field(default_factory=list)

    def _batch(self, number: int) -> str:
        return f"{self.folder}/batches/batch={number:020d}"

    def numbers(self) -> list[int]:
        """The whole batches on the bus."""
        return [int(name.removeprefix("batch=")) for name in listed(self.spark, f"{self.folder}/batches") if exists(self.spark, f"{self.folder}/batches/{name}/_SUCCESS")]

    def read(self, *numbers: int) -> DataFrame:
        """The rows of the given batches, or of all."""
        chosen = numbers or tuple(self.numbers())
        return self.spark.read.schema(BUS).parquet(*map(self._batch, chosen)) if chosen else self.spark.createDataFrame([], BUS)

    def put(self, rows: DataFrame, number: int, kind: str = "progress") -> None:
        """rows as a batch of the bus, and to all sinks."""
        data = F.to_json(F.struct(*(F.col(f"`{c}`") for c in rows.columns)))
        rows.select(F.lit(self.run_id).alias("run_id"), F.lit(number).cast("long").alias("batch"), F.lit(kind).alias("type"), data.alias("data")).write.mode("overwrite").parquet(self._batch(number))
        self.catch_up()

    def _one(self, number: int, kind: str, **data: object) -> None:
        """A batch of one event, once in the bus's life."""
        if not exists(self.spark, f"{self._batch(number)}/_SUCCESS"):
            self.put(self.spark.range(1).select(*(F.lit(v).alias(k) for k, v in data.items())), number, kind)

    def due(self, sink: str) -> list[int]:
        """The batches that a sink hasn't had."""
        had = {int(name) for name in listed(self.spark, f"{self.folder}/delivered/{sink}")}
        return [n for n in self.numbers() if n not in had]

    def catch_up(self) -> dict[str, list[int]]:
        """Deliver what is due, in order; what still is, by sink."""
        for name, sink in self.sinks.items():
            for number in self.due(name):
                try:
                    sink(self.read(number), number)
                except Exception as failed:  # a sink is the caller's code: whatever it raises is its own failure
                    self.failures.append((name, number, str(failed)[:500]))
                    break  # later batches have to wait for this one
                marked(self.spark, f"{self.folder}/delivered/{name}/{number:020d}")
        return {name: due for name in self.sinks if (due := self.due(name))}

    def follow(self, stream: DataFrame, mode: str = "append", trigger: dict | None = None, on_progress: Callable[[int, int], None] | None = None, while_running: Callable[[StreamingQuery], None] | None = None) -> Progress:
        """Run stream to its end: start, its rows, end. ``trigger`` is all that is there now, or for example {"processingTime": "1 second"}.

        ``on_progress`` is told of every batch; ``while_running`` gets the running query, and may
        wait, feed its source or stop it. A stopped run has no end yet: it can be taken up again.
        """
        ended = f"{self.folder}/ended"
        progress = Progress()
        if exists(self.spark, ended):
            return progress
        self._one(0, "start", run_id=self.run_id)

        def told(batch: int, rows: int) -> None:
            progress.rows[batch] = rows
            if on_progress:
                on_progress(batch, rows)

        name = f"bus_{self.run_id}"
        watch = Watch(name, told)
        self.spark.streams.addListener(watch)
        stopped = False
        try:
            with state_settings(self.spark):
                observed = stream.observe(name, F.count(F.lit(1)).alias("n"))
                writer = observed.writeStream.outputMode(mode).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(**(trigger or {"availableNow": True}))
                query = writer.foreachBatch(lambda rows, number: self.put(rows, number + FIRST)).start()
                try:
                    if while_running:
                        while_running(query)
                        stopped = not query.isActive and query.exception() is None
                    query.awaitTermination()
                except StreamingQueryException as failed:
                    progress.error = str(failed)
            self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        finally:
            self.spark.streams.removeListener(watch)
        if stopped and progress.error is None:
            return progress
        last = max(self.numbers()) + 1
        if progress.error is None:
            self._one(last, "complete", batches=last - FIRST, rows=self.read(*range(FIRST, last)).count() if last > FIRST else 0)
        else:
            self._one(last, "error", message=progress.error.splitlines()[0][:500])
        marked(self.spark, ended)
        return progress


def folder_sink(folder: str) -> Sink:
    """A sink that keeps the rows as Parquet, a folder for each batch."""
    return lambda rows, number: rows.write.mode("overwrite").parquet(f"{folder}/delivery={number}")


def text_sink(folder: str) -> Sink:
    """A sink of server-sent event text."""
    text = F.format_string("event: %s\ndata: %s\n\n", F.col("type"), F.col("data"))
    return lambda rows, number: rows.select(text.alias("value")).write.mode("overwrite").text(f"{folder}/delivery={number}")
