import datetime
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from ledgerline.catalog import streams
from ledgerline.sources import files
from ledgerline.sources import fixtures as fx
from ledgerline.sources import queue as Q
from ledgerline.streaming import bus as B
from ledgerline.streaming import events as E
from ledgerline.streaming import state as S

SF = "/root/testdata/sf0.001"
FIELDS = ["flow_id", "agent", "status", "ticker", "message", "analysis", "n", "last_id", "messages"]


def at(seconds):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=seconds)


def events(spark, rows):
    """Rows of (agent, event_id, second, status, ticker, message, analysis) as events of flow 1."""
    return spark.createDataFrame([(1, a, i, at(t), *rest) for a, i, t, *rest in rows], "flow_id long, agent string, event_id long, ts timestamp, status string, ticker string, message string, analysis string")


def rows_of(df):
    return sorted(map(str, df.select(FIELDS).collect()))


def streamed(spark, *parts, **how):
    """The last states of events that are published part by part, each its own batch."""
    path, out = files.shared_path(spark, "queue"), files.shared_path(spark, "states")
    stream = Q.queue_stream(spark, path, parts[0].schema)
    for part in parts:
        Q.publish(part, path, ["ts", "event_id"])
        with S.state_settings(spark):
            query = S.node_states(stream, **how).writeStream.outputMode("update").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start()
            query.awaitTermination()
    return S.final_rows(spark.read.parquet(f"{out}/rows").drop("batch"))


@pytest.mark.parametrize("expire_ms", [6 * 3_600_000])
def test_states_equal_their_batch_twin_after_a_restart(spark, expire_ms):
    e = streams._partial(fx.table(spark, SF, "events"))
    got = streamed(spark, e.filter("ts < '2024-01-14'"), e.filter("ts >= '2024-01-14'"), keep=4, expire_ms=expire_ms)
    assert rows_of(got) == rows_of(S.node_states_batch(e, keep=4, expire_ms=expire_ms))


def test_absent_fields_keep_their_value(spark):
    first = events(spark, [("a", 1, 0, "START", None, None, None), ("a", 2, 1, "busy, waiting", "T1", "one", "x"), ("a", 3, 2, None, None, "two", None)])
    again = events(spark, [("a", 4, 2, None, None, "two", None), ("a", 5, 9, None, "T2", "three", None)])
    (r,) = streamed(spark, first, again, keep=3).collect()
    assert (r.status, r.ticker, r.message, r.analysis, r.n, r.last_id) == ("busy, waiting", "T2", "three", "x", 5, 5)
    assert [(m.message, m.ticker) for m in r.messages] == [("one", "T1"), ("two", None), ("three", "T2")]  # the repeat of two isn't there
    (r,) = streamed(spark, first.unionByName(again), events(spark, [("a", 6, 20, "START", None, None, None)]), keep=3).collect()
    assert (r.status, r.ticker, r.message, r.n, r.messages) == ("START", None, None, 1, [])


def test_complete_turns_idle(spark):
    """At 30 seconds of event time exactly, for a key that had no event since; a restart in between changes nothing."""
    done = [("a", 1, 0, "COMPLETE", None, None, None), ("b", 2, 1, "COMPLETE", None, None, None), ("c", 3, 1, "ERROR", None, None, None)]
    parts = events(spark, done), events(spark, [("d", 4, 30, "IN_PROGRESS", None, None, None)])
    got = streamed(spark, *parts, expire_ms=30_000)
    assert {r.agent: r.status for r in got.collect()} == {"a": "IDLE", "b": "COMPLETE", "c": "ERROR", "d": "IN_PROGRESS"}
    assert rows_of(got) == rows_of(S.node_states_batch(parts[0].unionByName(parts[1]), expire_ms=30_000))
    # a late event without a status finds the key idle, in one batch as in two
    late = events(spark, [("a", 5, 60, None, "T", None, None)])
    for parts in ((events(spark, done), late), (events(spark, done).unionByName(late),)):
        assert {r.agent: r.status for r in streamed(spark, *parts, expire_ms=30_000).collect()} == {"a": "IDLE", "b": "IDLE", "c": "ERROR"}


class _Store:
    """A handle whose states are kept here, and that counts the calls."""

    def __init__(self):
        self.calls, self.value, self.map = 0, None, set()

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def containsKey(self, item):
        self.calls += 1
        return item in self.map

    def updateValue(self, item, _):
        self.calls += 1
        self.map.add(item)

    def clear(self):
        self.calls += 1
        self.map.clear()


def test_a_key_is_read_and_written_once():
    """Whatever its events, as long as the distinct messages since the start are no more than it holds; more of them are all known too."""
    event = lambda i, message: Row(event=json.dumps([str(i), str(i * 10**6), "START" if i % 40 == 0 else None, None, message, None]))
    node, store = S.NodeState(5, None), _Store()
    node.init(store)
    (r,) = node.handleInputRows((1, "a"), [event(i, f"m{i}") for i in range(100)], None)
    assert store.calls == 2 and r.n == 20 and [m[1] for m in r.messages] == [f"m{i}" for i in range(95, 100)]
    (r,) = node.handleInputRows((1, "a"), [event(i, f"m{i}") for i in range(81, 100)], None)  # again
    assert store.calls == 4 and len(store.value[-1]) == 20
    many = [e for i in range(1000) for e in [Row(event=json.dumps([str(1000 + i), str(i), None, None, f"x{i}", None]))]]
    node.handleInputRows((1, "a"), many, None).__next__()
    assert len(store.value[-1]) <= 2 * S.RECENT and len(store.map) + len(store.value[-1]) == 1020
    (r,) = node.handleInputRows((1, "a"), many, None)
    assert len(store.map) + len(store.value[-1]) == 1020 and [m[1] for m in r.messages] == [f"x{i}" for i in range(995, 1000)]
    node.handleInputRows((1, "a"), [event(1040, "new")], None).__next__()
    assert not store.map and len(store.value[-1]) == 1


def test_many_messages_of_a_key(spark):
    """More than a key's value holds, in two batches, and all again."""
    rows = [("a", i, i, "START" if i == 0 else None, None, f"m{i}", None) for i in range(300)]
    again = [("a", 300 + i, i, None, None, f"m{i}", None) for i in range(0, 300, 7)] + [("a", 900, 900, None, None, "last", None)]
    parts = events(spark, rows[:200]), events(spark, rows[200:] + again)
    got = streamed(spark, *parts, keep=80)
    assert rows_of(got) == rows_of(S.node_states_batch(parts[0].unionByName(parts[1]), keep=80))


def test_ended_downloads_leave_the_state(spark):
    up = spark.createDataFrame([("m", 1, at(0), "downloading", 10.0), ("m", 2, at(1), "completed", 100.0), ("n", 3, at(2), "downloading", 20.0), ("o", 4, at(3), "downloading", 1.0), ("p", 5, at(63), "starting", 0.0)], "model string, event_id long, ts timestamp, status string, percentage double")
    path = files.shared_path(spark, "queue")
    Q.publish(up, path, ["ts", "event_id"])
    updates = E.drained(S.downloads(Q.queue_stream(spark, path, up.schema), silence_ms=61_000), "downloads", "update")
    got = S.final_rows(updates, ("model",), F.col("removed")).select("model", "status", "percentage", "last_id")
    assert sorted(got.collect()) == [("o", "downloading", 1.0, 4), ("p", "starting", 0.0, 5)]
    assert sorted(S.running_downloads_batch(up, silence_ms=61_000).collect()) == sorted(got.collect())


def test_queue_gives_every_row_once(spark):
    e = fx.table(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    path = files.shared_path(spark, "queue")
    assert [Q.publish(e.filter(p), path, ["ts", "event_id"]) for p in ("event_id < 400", "event_id < 0", "event_id >= 400")] == [400, 400, 1000]
    got = E.drained(Q.queue_stream(spark, path, e.schema), "rows")
    assert sorted(r.queue_offset for r in got.collect()) == list(range(1000)) and got.select("event_id").distinct().count() == 1000
    reader = Q.QueueReader(path, got.schema)
    assert sum(last - first for _, first, last in (p.value for p in reader.partitions({"rows": 150}, {"rows": 420}))) == 270


def _bus(spark, sinks, predicate="true"):
    e = streams._columns(fx.table(spark, SF, "events")).filter(predicate)
    path, stream = streams._queue(spark, e)
    return B.Bus(spark, files.shared_path(spark, "bus"), "r", sinks), stream


def test_sinks_are_equal_after_a_failure(spark):
    out, away = files.shared_path(spark, "out"), [True]

    def unsteady(rows, number):
        if away[0]:
            raise ConnectionError("away")
        B.folder_sink(f"{out}/b")(rows, number)

    bus, stream = _bus(spark, {"b": unsteady, "a": B.folder_sink(f"{out}/a")})
    bus.follow(stream)
    assert bus.due("a") == [] and bus.due("b") == bus.numbers() and {name for name, _, _ in bus.failures} == {"b"}
    away[0] = False
    assert bus.catch_up() == {}
    a, b = (sorted(map(str, spark.read.schema(B.BUS).parquet(f"{out}/{x}").collect())) for x in "ab")
    assert a == b and len(a) == 1002


def test_one_end_after_the_last_row(spark):
    told = []
    bus, stream = _bus(spark, {})
    progress = bus.follow(stream, on_progress=lambda batch, rows: told.append(rows))
    assert sum(told) == progress.total() == 1000 and progress.error is None
    bus.follow(stream)  # nothing more
    rows = bus.read().collect()
    last = max(r.batch for r in rows)
    assert [r.type for r in rows if r.batch == last] == ["complete"] and [r.type for r in rows if r.batch == 0] == ["start"] and len(rows) == 1002


def test_a_failed_query_ends_with_an_error(spark):
    bus, stream = _bus(spark, {})
    progress = bus.follow(stream.withColumn("x", F.when(F.col("event_id") == 950, F.raise_error(F.lit("bad row")))))
    assert progress.error and [r.type for r in bus.read().orderBy("batch").collect()] == ["start", "error"]


def test_live_run_is_fed_and_cancelled(spark):
    """Events that come while the query runs, a poll a second; then a cancellation, and the rest."""
    e = streams._columns(fx.table(spark, SF, "events"))
    path, stream = streams._queue(spark, e.filter("event_id < 100"))
    bus = B.Bus(spark, files.shared_path(spark, "bus"), "r", {})

    def live(query):
        query.processAllAvailable()
        Q.publish(e.filter("event_id >= 100 and event_id < 300"), path, ["event_id"])
        query.processAllAvailable()
        E.cancel(query)

    bus.follow(stream, trigger={"processingTime": "1 second"}, while_running=live)
    seen = bus.read().groupBy("type").count().collect()
    assert dict(map(tuple, seen)) == {"start": 1, "progress": 300}
    Q.publish(e.filter("event_id >= 300"), path, ["event_id"])
    bus.follow(stream)
    assert dict(map(tuple, bus.read().groupBy("type").count().collect())) == {"start": 1, "progress": 1000, "complete": 1}


def test_end_marker_comes_after_all_rows(spark):
    seen = []
    out = E.drained(streams._stream(spark, SF), "end", at_end=lambda df: seen.append(df.count()))
    assert seen == [out.count()] == [1000]


def test_ping_can_be_cancelled(spark):
    q = E.ping(spark).writeStream.format("memory").queryName("ticks").start()
    while spark.table("ticks").count() < 2:
        assert q.isActive
    E.cancel(q)
    assert not q.isActive and spark.table("ticks").filter("n > 5").count() == 0
