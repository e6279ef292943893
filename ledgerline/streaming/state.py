"""Keyed state over event streams: partial merges, bounded histories, timed expiry, removal.

The state of a key lives in the RocksDB state store, as values and maps of its own columns. Time is event time: timers fire when the watermark passes them, so a run over the
same events always gives the same last rows, and every operator has a batch twin for them.
A row is yielded whenever a key changes; ``version`` grows with each of a key's rows, and
``final_rows`` keeps each key's last one.

Events have flow_id, agent, event_id (their order within a key), ts (a timestamp), status,
and fields that may be null, which leave what the state has.
"""

from __future__ import annotations

import contextlib
import datetime
import json
from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

START, COMPLETE, IDLE = "START", "COMPLETE", "IDLE"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = ("flow_id", "agent")
FIELDS = ("status", "ticker", "message", "analysis")
MESSAGE = "ts timestamp, message string, ticker string"
NODE = f"flow_id long, agent string, status string, ticker string, message string, analysis string, n long, last_id long, messages array<struct<{MESSAGE.replace(' ', ':', 1).replace(', message ', ',message:').replace(', ticker ', ',ticker:')}>>, version long"
MODEL = "model string, status string, percentage double, last_id long, removed boolean, version long"


#: State in RocksDB, and a last batch without rows for what the final watermark sets off, also where the source has no batches of its own.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, "spark.sql.streaming.triggerAvailableNowWrapper.enabled": "true"}


@contextlib.contextmanager
def state_settings(spark: SparkSession) -> Iterator[None]:
    """The settings that queries with the states of this module need, from their start to their first batch."""
    before = {name: spark.conf.get(name, None) for name in SETTINGS}
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _ms(ts) -> int:
    return round(ts.timestamp() * 1000)


#: Distinct messages of a key that are held in its one value; older ones are in a map of their own.
RECENT = 64
EPOCH, MICRO = datetime.datetime(1970, 1, 1, tzinfo=datetime.UTC), datetime.timedelta(microseconds=1)


def _packed() -> Column:
    """event_id, ts and FIELDS of an event as one text: a worker pays for each value that it is handed."""
    return F.to_json(F.array(F.col("event_id").cast("string"), F.unix_micros("ts").cast("string"), *FIELDS))


def _unpacked(event: str) -> tuple[int, int | None, list]:
    """event_id, microseconds, values of FIELDS."""
    last_id, at, *said = json.loads(event)
    return int(last_id), None if at is None else int(at), said


class NodeState(StatefulProcessor):
    """The state of an agent node: merged fields, events since the last start, the last messages.

    Each call to the state store is a round trip, so all that most keys have is one value: one
    is read and one written for a key and a batch. Only messages beyond the last ones, by which
    repeats are known, are in a map, which is asked for the keys alone that have any there.
    """

    def __init__(self, keep: int, expire_ms: int | None):
        self.keep, self.expire_ms = keep, expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fields = handle.getValueState("fields", "status string, ticker string, message string, analysis string, n long, last_id long, due long, version long, older long, recent array<struct<ts:long,message:string,ticker:string>>")
        self.met = handle.getMapState("met", "ts long, message string, ticker string", "older boolean")

    def _row(self, key: tuple, fields: list, recent: list[tuple]) -> Row:
        status, ticker, message, analysis, n, last_id, _, version, _ = fields
        messages = [(EPOCH + ts * MICRO, *rest) for ts, *rest in recent[-self.keep :]]
        return Row(flow_id=key[0], agent=key[1], status=status, ticker=ticker, message=message, analysis=analysis, n=n, last_id=last_id, messages=messages, version=version)

    def _state(self) -> tuple[list, list[tuple]]:
        """The fields, and the last messages."""
        if (old := self.fields.get()) is None:
            return [None] * 4 + [0, -1, None, 0, 0], []
        *fields, recent = old
        return fields, [tuple(m) for m in recent]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fields, recent = self._state()
        before, known = fields[6], set(recent)
        most = max(self.keep, RECENT)
        for last_id, at, said in sorted((_unpacked(r.event) for r in rows), key=itemgetter(0)):
            if fields[6] is not None and at is not None and at // 1000 >= fields[6]:
                fields[0] = IDLE  # the timer is due, whether or not a batch ends in between
            fields[6] = None
            if said[0] == START:
                fields[:5] = [None] * 4 + [0]
                recent, known = [], set()
                if fields[8]:
                    self.met.clear()
                    fields[8] = 0
            for k, value in enumerate(said):
                if value is not None:
                    fields[k] = value
            fields[4], fields[5] = fields[4] + 1, last_id
            _, ticker, message, _ = said
            if message is not None and at is not None:
                item = (at, message, ticker)
                if item not in known and not (fields[8] and self.met.containsKey(item)):
                    recent.append(item)
                    known.add(item)
            if len(recent) > 2 * most:
                for item in recent[:-most]:
                    self.met.updateValue(item, (True,))
                fields[8] += len(recent) - most
                recent = recent[-most:]
                known = set(recent)
            if self.expire_ms is not None and fields[0] == COMPLETE and at is not None:
                fields[6] = at // 1000 + self.expire_ms
        fields[7] += 1
        if before != fields[6]:
            if before is not None:
                self.handle.deleteTimer(before)
            if fields[6] is not None:
                self.handle.registerTimer(fields[6])
        self.fields.update((*fields, recent))
        yield self._row(key, fields, recent)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        fields, recent = self._state()
        if fields[6] == expiredTimerInfo.getExpiryTimeInMs():
            fields[0], fields[6] = IDLE, None
            fields[7] += 1
            self.fields.update((*fields, recent))
            yield self._row(key, fields, recent)

    def close(self) -> None:
        pass


def node_states(events: DataFrame, keep: int = 50, expire_ms: int | None = None, delay: str = "0 seconds") -> DataFrame:
    """The states of (flow_id, agent) after every batch and timer: NODE rows.

    Fields of an event that are null keep their old value; START forgets what was before. A
    message that the key has had since (same ts, message and ticker) isn't added again. With
    ``expire_ms`` a key that stays COMPLETE for so long turns IDLE; a later event finds it so.
    """
    slim = _with_fields(events).select(*KEYS, "ts", _packed().alias("event"))
    timed = slim.withWatermark("ts", delay) if expire_ms is not None else slim.drop("ts")
    return timed.groupBy(*KEYS).transformWithState(NodeState(keep, expire_ms), NODE, "Update", "EventTime" if expire_ms is not None else "None")


def _with_fields(events: DataFrame) -> DataFrame:
    extra = {c: F.lit(None).cast("string") for c in FIELDS if c not in events.columns}
    return events.withColumns(extra).select(*KEYS, "event_id", "ts", *FIELDS)


def node_states_batch(events: DataFrame, keep: int = 50, expire_ms: int | None = None) -> DataFrame:
    """The batch twin of node_states: the last row of each key, without version.

    Keys that are COMPLETE at their last event are IDLE if expire_ms before the table's last
    event at least; and between two events of a key, where the second has no status.
    """
    slim = _with_fields(events)
    w = Window.partitionBy(*KEYS).orderBy("event_id")
    run = F.count_if(F.col("status") == START).over(w)
    last_run = slim.withColumn("_run", run).withColumn("_last", F.max("_run").over(Window.partitionBy(*KEYS))).filter("_run = _last")
    if expire_ms is not None:
        # what the status was before an event, and whether it was idle by then
        sofar = F.last("status", ignorenulls=True).over(w)
        idle = (F.lag("_sofar").over(w) == COMPLETE) & (F.unix_millis("ts") >= F.unix_millis(F.lag("ts").over(w)) + expire_ms)
        last_run = last_run.withColumn("_sofar", sofar).withColumn("status", F.when(F.col("status").isNull() & idle, IDLE).otherwise(F.col("status"))).drop("_sofar")
    first = F.row_number().over(Window.partitionBy(*KEYS, "ts", "message", "ticker").orderBy("event_id")) == 1
    marked = last_run.withColumn("_new", F.col("message").isNotNull() & F.col("ts").isNotNull() & first)
    newer = F.count_if("_new").over(Window.partitionBy(*KEYS).orderBy(F.desc("event_id")))
    item = F.when(F.col("_new") & (F.col("_newer") <= keep), F.struct("event_id", F.struct("ts", "message", "ticker").alias("m")))
    latest = {c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("event_id"))).alias(c) for c in FIELDS}
    out = marked.withColumn("_newer", newer).groupBy(*KEYS).agg(*latest.values(), F.count("*").alias("n"), F.max("event_id").alias("last_id"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["m"]).alias("messages"), F.max_by("ts", "event_id").alias("_ts"))
    if expire_ms is not None:
        ended = events.agg(F.max("ts")).scalar()
        out = out.withColumn("status", F.when((F.col("status") == COMPLETE) & (F.unix_millis("_ts") + expire_ms <= F.unix_millis(ended)), IDLE).otherwise(F.col("status")))
    return out.drop("_ts")


class Download(StatefulProcessor):
    """A model's download: its latest progress; gone after its end, or after a silence."""

    def __init__(self, ended: tuple[str, ...], silence_ms: int):
        self.ended, self.silence_ms = ended, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "status string, percentage double, last_id long, due long, version long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        r = max(rows, key=lambda r: r.event_id)
        old = self.latest.get() if self.latest.exists() else None
        if old is not None:
            self.handle.deleteTimer(old[3])
        version = (old[4] if old is not None else 0) + 1
        gone = r.status in self.ended
        if gone:
            self.latest.clear()
        else:
            due = _ms(r.ts) + self.silence_ms
            self.handle.registerTimer(due)
            self.latest.update((r.status, r.percentage, r.event_id, due, version))
        yield Row(model=key[0], status=r.status, percentage=r.percentage, last_id=r.event_id, removed=gone, version=version)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, percentage, last_id, due, version = self.latest.get()
        if due == expiredTimerInfo.getExpiryTimeInMs():
            self.latest.clear()
            yield Row(model=key[0], status=status, percentage=percentage, last_id=last_id, removed=True, version=version + 1)

    def close(self) -> None:
        pass


def downloads(updates: DataFrame, ended: tuple[str, ...] = ("completed", "error"), silence_ms: int = 3_600_000, delay: str = "0 seconds") -> DataFrame:
    """The running downloads of updates(model, event_id, ts, status, percentage) as MODEL rows.

    A model leaves the state with a status in ``ended``, or silence_ms of event time after its
    last update; its last row then says that it is removed.
    """
    slim = updates.select(F.col("model").cast("string").alias("model"), "event_id", "ts", "status", F.col("percentage").cast("double").alias("percentage"))
    return slim.withWatermark("ts", delay).groupBy("model").transformWithState(Download(ended, silence_ms), MODEL, "Update", "EventTime")


def running_downloads_batch(updates: DataFrame, ended: tuple[str, ...] = ("completed", "error"), silence_ms: int = 3_600_000) -> DataFrame:
    """The batch twin: model, status, percentage, last_id of the models that are still in the state."""
    now = updates.agg(F.max("ts")).scalar()
    last = updates.groupBy(F.col("model").cast("string").alias("model")).agg(F.max_by(F.struct("status", F.col("percentage").cast("double").alias("percentage"), F.col("event_id").alias("last_id"), "ts"), "event_id").alias("s"))
    return last.select("model", "s.*").filter(~F.col("status").isin(*ended) & (F.unix_millis("ts") + silence_ms > F.unix_millis(now))).drop("ts")


def final_rows(updates: DataFrame, keys: tuple[str, ...] = KEYS, gone: Column | None = None) -> DataFrame:
    """Of the rows that were yielded over time, each key's last; without those that are gone."""
    fields = [c for c in updates.columns if c not in keys]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*fields), "version").alias("s")).select(*keys, "s.*")
    return last if gone is None else last.filter(~gone)
