"""The domain's relations as views of the driver's tables (see the survey, 7.3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INVESTORS = ("buffett", "lynch", "fisher")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close: volume-weighted price of each supplier and day."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg((exact("l_extendedprice") / exact("l_quantity")).alias("close"))


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, seq, date, value: every supplier's prices as an equity curve."""
    return bars(spark, sf_dir).select(F.col("ticker").alias("run_id"), F.row_number().over(Window.partitionBy("ticker").orderBy("date")).cast("long").alias("seq"), "date", F.col("close").alias("value"))


def _event_columns(events: DataFrame) -> DataFrame:
    action = F.create_map(*(F.lit(x) for x in ("purchase", "buy", "error", "sell", "signup", "short", "click", "cover", "view", "hold")))
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", action[F.col("event_type")].alias("action"), F.get_json_object("props", "$.k").cast("double").alias("k"), (F.col("event_id") % 3).cast("int").alias("ticker"), F.to_date("ts").alias("date")
    )


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, seq, ticker, action, quantity, price."""
    e = _event_columns(table(spark, sf_dir, "events"))
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("run_id"), seq.alias("seq"), "ticker", "action", F.col("k").alias("quantity"), F.col("value").alias("price"))


def daily_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, date, ticker, action, quantity: the last event of a run's day for a ticker."""
    e = _event_columns(table(spark, sf_dir, "events"))
    last = F.max_by(F.struct("action", "k"), F.struct("ts", "event_id"))
    return e.groupBy(F.col("user_id").alias("run_id"), "date", "ticker").agg(last.alias("d")).select("run_id", "date", "ticker", F.col("d.action").alias("action"), F.col("d.k").alias("quantity"))


def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ticker, date, close: the last positive value of a day."""
    e = _event_columns(table(spark, sf_dir, "events")).filter("value > 0")
    return e.groupBy("ticker", "date").agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """agent, ticker, signal, confidence."""
    e = _event_columns(table(spark, sf_dir, "events"))
    signal = F.when(F.col("event_type").isin("purchase", "signup"), "Bullish").when(F.col("event_type") == "error", "bearish").when(F.col("event_type") == "view", "neutral").otherwise("unsure")
    return e.select((F.col("user_id") % 7).cast("int").alias("agent"), (F.col("event_id") % 50).cast("int").alias("ticker"), signal.alias("signal"), F.col("k").alias("confidence"))


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, rank, ticker, sector, cap_value, expected_return, pe: rankings of 30 parts each."""
    size = F.col("p_size").cast("double")
    return table(spark, sf_dir, "part").select(
        F.floor(F.col("p_partkey") / 30).cast("long").alias("run_id"),
        (F.col("p_partkey") % 30 + 1).cast("int").alias("rank"),
        F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ticker"),
        F.col("p_type").alias("sector"),
        (F.col("p_retailprice") * size / 200).alias("cap_value"),
        F.when(F.col("p_partkey") % 11 != 0, size - 10).alias("expected_return"),
        F.when(F.col("p_size") % 7 != 0, size).alias("pe"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, ticker, investor, score: 0 to 10, or null."""
    key = F.col("p_partkey")
    by = F.array(
        F.struct(F.lit("buffett").alias("investor"), (F.col("p_size") / 5.0).alias("score")),
        F.struct(F.lit("lynch").alias("investor"), ((key * 37) % 101 / 10.0).alias("score")),
        F.struct(F.lit("fisher").alias("investor"), F.when(key % 17 != 0, (key * 7) % 101 / 10.0).alias("score")),
    )
    each = table(spark, sf_dir, "part").select(F.floor(key / 30).cast("long").alias("run_id"), F.concat(F.lit("T"), key.cast("string")).alias("ticker"), F.explode(by).alias("s"))
    return each.select("run_id", "ticker", "s.investor", "s.score")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow_id, name, description, is_template, tags, created_at, updated_at."""
    key = F.col("c_custkey")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    return table(spark, sf_dir, "customer").select(
        key.alias("flow_id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), (key % 10 == 0).alias("is_template"), F.array(F.lower("c_mktsegment"), F.lit("default")).alias("tags"), day(key % 300).alias("created_at"), F.when(key % 3 != 0, day(key % 365)).alias("updated_at")
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, flow_id, status, created_at."""
    status = F.create_map(*(F.lit(x) for x in ("F", "COMPLETE", "O", "IN_PROGRESS", "P", "IDLE")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("flow_id"), status[F.col("o_orderstatus")].alias("status"), F.to_date("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("cost"))


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """nodes(id, type) and edges(source, target) of region, nation, supplier and customer."""
    r, n, s = (table(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = r.select(name("r_", "r_regionkey").alias("id"), F.lit("region").alias("type")).unionAll(n.select(name("n_", "n_nationkey"), F.lit("nation"))).unionAll(s.select(name("s_", "s_suppkey"), F.lit("supplier")))
    edges = n.select(name("r_", "n_regionkey").alias("source"), name("n_", "n_nationkey").alias("target")).unionAll(s.select(name("n_", "s_nationkey"), name("s_", "s_suppkey")))
    return nodes, edges


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")
