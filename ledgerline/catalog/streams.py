"""Streams over the events and conversations tables, drained to batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import windows
from ..sources import files
from ..sources import fixtures as fx
from ..sources import queue as Q
from ..streaming import bus as B
from ..streaming import events as E
from ..streaming import state as S


def _columns(df: DataFrame) -> DataFrame:
    status = F.create_map(*(F.lit(x) for x in ("signup", S.START, "click", "IN_PROGRESS", "view", "IN_PROGRESS", "purchase", S.COMPLETE, "error", "ERROR")))
    return df.select(F.col("user_id").alias("flow_id"), F.concat(F.lit("agent_"), (F.col("event_id") % 5).cast("string")).alias("agent"), status[F.col("event_type")].alias("status"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _partial(df: DataFrame) -> DataFrame:
    """Events whose fields may be absent, and of which some have the status ``busy, waiting``."""
    status = F.when(F.col("event_type") == "signup", S.START).when(F.col("event_type") == "purchase", S.COMPLETE).when(F.col("event_type") == "click", "busy, waiting")
    ticker = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("T"), (F.col("event_id") % 7).cast("string")))
    return df.select(
        F.col("user_id").alias("flow_id"), F.concat(F.lit("agent_"), (F.col("event_id") % 5).cast("string")).alias("agent"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), ticker.alias("ticker"),
        F.when(F.col("event_type") != "click", F.concat_ws(" ", "event_type", "props")).alias("message"), F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("analysis"),
    )


def _updates(df: DataFrame) -> DataFrame:
    status = F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "error").otherwise("downloading")
    return df.select((F.col("user_id") % 200).cast("string").alias("model"), "event_id", F.col("ts").cast("timestamp").alias("ts"), status.alias("status"), F.get_json_object("props", "$.k").cast("double").alias("percentage"))


def _stream(spark, d) -> DataFrame:
    schema = fx.table(spark, d, "events").schema
    return _columns(spark.readStream.schema(schema).parquet(f"{d}/events.parquet*"))


def _queue(spark, events: DataFrame, *days: str) -> tuple[str, DataFrame]:
    """events published in time order, in segments that end before the days; the queue's path and its stream."""
    path = files.shared_path(spark, "queue")
    for first, last in zip((None, *days), (*days, None), strict=True):
        part = events.filter(F.col("ts") >= first) if first else events
        Q.publish(part.filter(F.col("ts") < last) if last else part, path, ["ts", "event_id"])
    return path, Q.queue_stream(spark, path, events.schema)


def t01(spark, d):
    """Events published in two segments, and a consumer that stops after the first and goes on from its checkpoint."""
    events = fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type")
    path, stream = _queue(spark, events.filter("ts < '2024-01-16'"))
    out = files.shared_path(spark, "consumed")
    for more in (events.filter("ts >= '2024-01-16'"), None):
        query = stream.writeStream.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/rows/batch={n}")).start()
        query.awaitTermination()
        if more is not None:
            Q.publish(more, path, ["ts", "event_id"])
    return spark.read.parquet(f"{out}/rows").select(Q.OFFSET, "event_id", "user_id", "event_type")


def t02(spark, d):
    """The bus of a run: one start, a row for every event, one end with their number."""
    bus = B.Bus(spark, files.shared_path(spark, "bus"), "run 1", {})
    bus.follow(_queue(spark, _columns(fx.table(spark, d, "events")))[1])
    rows = bus.read().withColumn("said", F.when(F.col("type") == "complete", F.get_json_object("data", "$.rows").cast("long")))
    return rows.groupBy("run_id", "type").agg(F.count("*").alias("n"), F.max("said").alias("said"), F.sum(F.get_json_object("data", "$.event_id").cast("long")).alias("event_ids"))


def t03(spark, d):
    """A run that is cancelled after its first rows, and taken up again: what the bus had then and in the end."""
    bus = B.Bus(spark, files.shared_path(spark, "bus"), "run 1", {})
    events = _columns(fx.table(spark, d, "events"))
    path, stream = _queue(spark, events.filter("ts < '2024-01-16'"))

    def left(query) -> None:
        query.processAllAvailable()
        E.cancel(query)

    bus.follow(stream, trigger={"processingTime": "1 second"}, while_running=left)
    before = bus.read().withColumn("at_", F.lit("cancelled"))
    Q.publish(events.filter("ts >= '2024-01-16'"), path, ["ts", "event_id"])
    numbers = bus.numbers()
    bus.follow(stream)
    return before.unionByName(bus.read(*(n for n in bus.numbers() if n not in numbers)).withColumn("at_", F.lit("taken up"))).groupBy("at_", "type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("data", "$.event_id").cast("long")).alias("event_ids"))


def t04(spark, d):
    return S.final_rows(E.drained(S.node_states(_stream(spark, d)), "state", "update")).select("flow_id", "agent", "status", "n", "last_id")


def t08(spark, d):
    with_status = _stream(spark, d).withColumn("message", F.col("status"))
    out = S.final_rows(E.drained(S.node_states(with_status, keep=5), "history", "update"))
    return out.select("flow_id", "agent", F.array_join(F.transform("messages", lambda m: m["message"]), ",").alias("history"))


def _shown(states: DataFrame) -> DataFrame:
    return states.select("flow_id", "agent", "status", "ticker", "message", "analysis", "n", "last_id", F.array_join(F.transform("messages", lambda m: F.concat_ws("@", m["message"], m["ticker"])), "; ").alias("messages"))


def t04_partial(spark, d):
    """Fields that an event doesn't have keep their value; the last 10 messages."""
    stream = _queue(spark, _partial(fx.table(spark, d, "events")), "2024-01-11", "2024-01-21")[1]
    return _shown(S.final_rows(E.drained(S.node_states(stream, keep=10), "merged", "update")))


def t11(spark, d):
    """Keys that stay COMPLETE for 30 hours turn IDLE."""
    stream = _queue(spark, _partial(fx.table(spark, d, "events")), "2024-01-16")[1]
    return _shown(S.final_rows(E.drained(S.node_states(stream, keep=3, expire_ms=30 * 3_600_000), "expired", "update")))


def t10_stream(spark, d):
    """Downloads that are running: neither ended nor silent for five hours."""
    stream = _queue(spark, _updates(fx.table(spark, d, "events")), "2024-01-16")[1]
    return S.final_rows(E.drained(S.downloads(stream, silence_ms=5 * 3_600_000), "downloads", "update"), ("model",), F.col("removed")).select("model", "status", "percentage", "last_id")


def t12(spark, d):
    """One run's rows in three sinks, of which one fails at first: what each has in the end."""
    out, failing = files.shared_path(spark, "sinks"), {"left": 2}

    def unsteady(rows: DataFrame, number: int) -> None:
        if number == 1 and failing["left"]:
            failing["left"] -= 1
            raise ConnectionError("the sink is away")
        B.folder_sink(f"{out}/c")(rows, number)

    bus = B.Bus(spark, files.shared_path(spark, "bus"), "run 1", {"a": B.folder_sink(f"{out}/a"), "unsteady": unsteady, "b": B.folder_sink(f"{out}/b")})
    bus.follow(_queue(spark, _columns(fx.table(spark, d, "events")))[1])
    bus.catch_up()
    each = [spark.read.schema(B.BUS).parquet(f"{out}/{sink}").withColumn("sink", F.lit(sink)) for sink in "abc"]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("sink", "run_id", "type").agg(F.count("*").alias("n"), F.sum(F.get_json_object("data", "$.event_id").cast("long")).alias("event_ids"))


def t05(spark, d):
    once = E.distinct_events(_stream(spark, d), ["flow_id", "agent", "ts"], "1 hour")
    return E.drained(once, "distinct").groupBy("flow_id").agg(F.count("*").alias("n"))


def t07(spark, d):
    e = _columns(fx.table(spark, d, "events"))
    return e.groupBy("flow_id", "agent").agg(F.max_by("status", "event_id").alias("status"), F.min(F.when(F.col("status") == "IN_PROGRESS", F.col("event_id"))).alias("first_running"))


def t09(spark, d):
    e = _columns(fx.table(spark, d, "events")).withColumnsRenamed({"flow_id": "run_id", "event_id": "seq"})
    return windows.progress(e).select("run_id", "seq", F.round("progress", 8).alias("progress"))


def u11(spark, d):
    m = fx.messages(spark, d)
    return m.dropDuplicates(["conv_id", "role", "text"]).groupBy("role").agg(F.count("*").alias("n"))


def a31(spark, d):
    """The last message of each role with any text, newer over older."""
    return fx.messages(spark, d).filter("text is not null").groupBy("conv_id", "role").agg(F.max("turn").alias("turn"), F.max_by(F.length("text"), "turn").alias("n_chars"))


def l13(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role")
    return fx.messages(spark, d).select("conv_id", "turn", "role", F.row_number().over(w).alias("place"))


def sc09(spark, d):
    """Events written as event text, 100 to a text, and read back."""
    e = fx.table(spark, d, "events").withColumn("e", F.struct(F.col("event_type").alias("type"), F.col("user_id").cast("string").alias("agent")))
    text = e.groupBy(F.floor(F.col("event_id") / 100).alias("g")).agg(F.concat_ws("", F.collect_list(files.event_text(F.col("event_type"), F.col("e")))).alias("value"))
    return files.events_of_text(text).groupBy("event", "agent").agg(F.count("*").alias("n"))


_EV = """ev AS (SELECT user_id AS flow_id, 'agent_' || (event_id % 5) AS agent, CASE event_type WHEN 'signup' THEN 'START' WHEN 'click' THEN 'IN_PROGRESS' WHEN 'view' THEN 'IN_PROGRESS' WHEN 'purchase' THEN 'COMPLETE' WHEN 'error' THEN 'ERROR' END AS status, ts, event_id FROM events)"""
_RUNS = f"""{_EV}, r AS (SELECT *, count(*) FILTER (status = 'START') OVER (PARTITION BY flow_id, agent ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM ev), m AS (SELECT *, max(run) OVER (PARTITION BY flow_id, agent) AS last FROM r), s AS (SELECT *, row_number() OVER (PARTITION BY flow_id, agent ORDER BY event_id DESC) AS k FROM m WHERE run = last)"""
_PART = """ev AS (SELECT user_id AS flow_id, 'agent_' || (event_id % 5) AS agent, event_id, ts, CASE event_type WHEN 'signup' THEN 'START' WHEN 'purchase' THEN 'COMPLETE' WHEN 'click' THEN 'busy, waiting' END AS status,
 CASE WHEN event_id % 3 = 0 THEN 'T' || (event_id % 7) END AS ticker, CASE WHEN event_type <> 'click' THEN event_type || ' ' || props END AS message, CASE WHEN event_id % 2 = 0 THEN props END AS analysis FROM events),
 r AS (SELECT *, count(*) FILTER (status = 'START') OVER (PARTITION BY flow_id, agent ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM ev)"""


def _states(keep: int, hours: int | None = None) -> str:
    """The last state of each key of _PART; with hours, idle ones."""
    late = f"coalesce(status, CASE WHEN before = 'COMPLETE' AND epoch_ms(ts) >= epoch_ms(lag(ts) OVER (PARTITION BY flow_id, agent ORDER BY event_id)) + {(hours or 0) * 3_600_000} THEN 'IDLE' END)"
    end = f"CASE WHEN s.status = 'COMPLETE' AND epoch_ms(s.ts) + {(hours or 0) * 3_600_000} <= (SELECT epoch_ms(max(ts)) FROM ev) THEN 'IDLE' ELSE s.status END"
    return f"""WITH {_PART}, f AS (SELECT *, last_value(status IGNORE NULLS) OVER (PARTITION BY flow_id, agent, run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS sofar FROM r),
 g AS (SELECT *, lag(sofar) OVER (PARTITION BY flow_id, agent, run ORDER BY event_id) AS before FROM f), m AS (SELECT * REPLACE ({late if hours else 'status'} AS status), max(run) OVER (PARTITION BY flow_id, agent) AS last FROM g),
 l AS (SELECT *, message IS NOT NULL AND row_number() OVER (PARTITION BY flow_id, agent, ts, message, ticker ORDER BY event_id) = 1 AS fresh FROM m WHERE run = last),
 k AS (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY flow_id, agent ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS newer FROM l),
 s AS (SELECT flow_id, agent, arg_max(status, event_id) FILTER (status IS NOT NULL) AS status, arg_max(ticker, event_id) FILTER (ticker IS NOT NULL) AS ticker, arg_max(message, event_id) FILTER (message IS NOT NULL) AS message, arg_max(analysis, event_id) FILTER (analysis IS NOT NULL) AS analysis,
 count(*) AS n, max(event_id) AS last_id, coalesce(string_agg(message || coalesce('@' || ticker, ''), '; ' ORDER BY event_id) FILTER (fresh AND newer <= {keep}), '') AS messages, max(ts) AS ts FROM k GROUP BY 1, 2)
 SELECT s.* EXCLUDE (ts, status), {end if hours else 's.status'} AS status FROM s"""


QUERIES = {
    "t01_event_queue": (t01, "SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS queue_offset, event_id, user_id, event_type FROM events"),
    "t02_end_event": (t02, "SELECT 'run 1' AS run_id, 'start' AS type, 1 AS n, CAST(NULL AS BIGINT) AS said, CAST(NULL AS BIGINT) AS event_ids UNION ALL SELECT 'run 1', 'progress', count(*), NULL, CAST(sum(event_id) AS BIGINT) FROM events UNION ALL SELECT 'run 1', 'complete', 1, count(*), NULL FROM events"),
    "t03_cancelled": (t03, "SELECT 'cancelled' AS at_, 'start' AS type, 1 AS n, CAST(NULL AS BIGINT) AS event_ids UNION ALL SELECT CASE WHEN ts < '2024-01-16' THEN 'cancelled' ELSE 'taken up' END, 'progress', count(*), CAST(sum(event_id) AS BIGINT) FROM events GROUP BY 1 UNION ALL SELECT 'taken up', 'complete', 1, NULL"),
    "t04_partial_merge": (t04_partial, _states(10)),
    "t10_download_stream": (t10_stream, "WITH u AS (SELECT CAST(user_id % 200 AS VARCHAR) AS model, event_id, ts, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'error' ELSE 'downloading' END AS status, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS percentage FROM events), s AS (SELECT model, arg_max(status, event_id) AS status, arg_max(percentage, event_id) AS percentage, max(event_id) AS last_id, arg_max(ts, event_id) AS ts FROM u GROUP BY 1) SELECT model, status, percentage, last_id FROM s WHERE status = 'downloading' AND epoch_ms(ts) + 18000000 > (SELECT epoch_ms(max(ts)) FROM events)"),
    "t11_expiry": (t11, _states(3, 30)),
    "t12_fan_out": (t12, "SELECT sink, 'run 1' AS run_id, type, n, event_ids FROM (VALUES ('a'), ('b'), ('c')) s(sink), (SELECT 'start' AS type, 1 AS n, CAST(NULL AS BIGINT) AS event_ids UNION ALL SELECT 'progress', count(*), CAST(sum(event_id) AS BIGINT) FROM events UNION ALL SELECT 'complete', 1, NULL)"),
    "t04_latest_state": (t04, f"WITH {_RUNS} SELECT flow_id, agent, arg_max(status, event_id) AS status, count(*) AS n, max(event_id) AS last_id FROM s GROUP BY 1, 2"),
    "t05_distinct_events": (t05, f"WITH {_EV} SELECT flow_id, count(DISTINCT (agent, ts)) AS n FROM ev GROUP BY 1"),
    "t07_status": (t07, f"WITH {_EV} SELECT flow_id, agent, arg_max(status, event_id) AS status, min(event_id) FILTER (status = 'IN_PROGRESS') AS first_running FROM ev GROUP BY 1, 2"),
    "t08_bounded_history": (t08, f"WITH {_RUNS} SELECT flow_id, agent, string_agg(status, ',' ORDER BY event_id) AS history FROM s WHERE k <= 5 GROUP BY 1, 2"),
    "t09_progress": (t09, f"WITH {_EV} SELECT flow_id AS run_id, event_id AS seq, round(row_number() OVER (PARTITION BY flow_id ORDER BY event_id) / CAST(count(*) OVER (PARTITION BY flow_id) AS DOUBLE), 8) AS progress FROM ev"),
    "u11_dedup_events": (u11, "SELECT role, count(DISTINCT (conv_id, text)) AS n FROM conversations GROUP BY 1"),
    "a31_last_values": (a31, "SELECT conv_id, role, max(turn) AS turn, arg_max(length(text), turn) AS n_chars FROM conversations WHERE text IS NOT NULL GROUP BY 1, 2"),
    "l13_log_order": (l13, "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role) AS place FROM conversations"),
    "sc09_event_text": (sc09, "SELECT event_type AS event, CAST(user_id AS VARCHAR) AS agent, count(*) AS n FROM events GROUP BY 1, 2"),
}
