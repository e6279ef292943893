"""Queries and updates of flows, runs and keys; updates give the new table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_name(flows: DataFrame, part: str) -> DataFrame:
    """Case-insensitive; % and _ in the text are wildcards."""
    return flows.filter(F.col("name").ilike(f"%{part}%"))


def search(flows: DataFrame, text: str) -> DataFrame:
    """Flows whose name, description or any tag has the text."""
    has = lambda c: F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
    return flows.filter(has(F.col("name")) | has(F.col("description")) | F.coalesce(F.exists("tags", has), F.lit(False)))


def listed(flows: DataFrame, include_templates: bool = True) -> DataFrame:
    kept = flows if include_templates else flows.filter(~F.col("is_template"))
    return kept.orderBy(F.desc_nulls_last("updated_at"), "flow_id")


def touched() -> Column:
    return F.coalesce("updated_at", "created_at")


def page(runs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit is 1 to 100, offset 0 or more")
    return runs.orderBy(F.desc("created_at"), "run_id").offset(offset).limit(limit)


def latest(runs: DataFrame, by: str = "flow_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("created_at"), F.desc("run_id"))
    return runs.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def next_run_numbers(runs: DataFrame, flows: DataFrame) -> DataFrame:
    return flows.select("flow_id").join(runs.groupBy("flow_id").agg(F.max("run_number").alias("m")), "flow_id", "left").select("flow_id", (F.coalesce("m", F.lit(0)) + 1).alias("next_run_number"))


def with_status(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """runs(run_id, status, started_at, completed_at) after changes(run_id, status, at); the times are set once."""
    c = changes.select("run_id", F.col("status").alias("_s"), "at")
    j = runs.join(c, "run_id", "left")
    return j.withColumns(
        {
            "started_at": F.when((F.col("_s") == "IN_PROGRESS") & F.col("started_at").isNull(), F.col("at")).otherwise(F.col("started_at")),
            "completed_at": F.when(F.col("_s").isin("COMPLETE", "ERROR") & F.col("completed_at").isNull(), F.col("at")).otherwise(F.col("completed_at")),
            "status": F.coalesce("_s", "status"),
        }
    ).drop("_s", "at")


def upserted(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """table with rows written over it; of several rows of a key the last counts, absent (null) fields stay."""
    fields = [c for c in table.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_new"))
    return table.join(last, key, "full").select(key, *(F.coalesce(f"_new.{c}", c).alias(c) for c in fields))


def duplicated(flows: DataFrame, flow_id: int, new_id: int) -> DataFrame:
    copy = flows.filter(F.col("flow_id") == flow_id).withColumns({"flow_id": F.lit(new_id).cast("long"), "name": F.concat("name", F.lit(" (Copy)")), "is_template": F.lit(False)})
    return flows.unionByName(copy.select(*flows.columns))


def without_runs(runs: DataFrame, flow_id: int) -> DataFrame:
    return runs.filter(F.col("flow_id") != flow_id)


def key_map(keys: DataFrame) -> DataFrame:
    """One row: active providers' values as a map."""
    return keys.filter("is_active").agg(F.map_from_entries(F.collect_list(F.struct("provider", "key_value"))).alias("keys"))


def model_config(agents: DataFrame, configs: DataFrame, default: str) -> DataFrame:
    """agents(id, base) with model: of configs(pos, agent, model) the first whose agent is the id or the base, else the default.

    Only the first config of each agent is joined, so an agent meets two of them at most.
    """
    agents = agents.select("id", "base")
    configs = configs.groupBy("agent").agg(F.min_by(F.struct("pos", "model"), "pos").alias("c")).select("agent", "c.*")
    exact = agents.join(configs.withColumnRenamed("agent", "id"), "id").select("id", "pos", "model")
    base = agents.join(configs.withColumnRenamed("agent", "base"), "base").select("id", "pos", "model")
    first = exact.unionByName(base).groupBy("id").agg(F.min_by("model", "pos").alias("model"))
    return agents.join(first, "id", "left").select("id", F.coalesce("model", F.lit(default)).alias("model"))
