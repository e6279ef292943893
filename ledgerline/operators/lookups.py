"""Joins against lists and lookups, nested groups, and new rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def newest(rows: DataFrame, key: str, by: str, n: int, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """The n newest rows of each key between start and end; ties in by go by the other columns."""
    inside = rows if start is None else rows.filter(F.col(by).between(start, end))
    others = [c for c in rows.columns if c not in (key, by)]
    return inside.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(by), *others))).filter(F.col("_k") <= n).drop("_k")


def all_matched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """An inner join on key, which fails if a row of left has no match."""
    marked = left.join(right.withColumn("_found", F.lit(True)), key, "left")
    checked = F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit(f"no row of {key} "), F.col(key).cast("string")))).otherwise(F.col(key))
    return marked.withColumn(key, checked).drop("_found")


def filled(rows: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """rows with column taken from lookup(key, column) where it is null or 0."""
    found = lookup.select(key, F.col(column).alias("_other"))
    return rows.join(found, key, "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit(0.0)), "_other")).drop("_other")


def resolved_edges(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """named(source, target) with node names as edges of ids; nodes(id, name); edges with an unknown end are dropped."""
    ends = [nodes.select(F.col("name").alias(c), F.col("id").alias(f"_{c}")) for c in ("source", "target")]
    both = named.join(ends[0], "source").join(ends[1], "target")
    return both.select(F.col("_source").alias("source"), F.col("_target").alias("target"))


def without(rows: DataFrame, key: str, *lists: DataFrame) -> DataFrame:
    """The rows whose key is in none of the lists."""
    for x in lists:
        rows = rows.join(x.select(key), key, "left_anti")
    return rows


def filtered_groups(groups: DataFrame, items: str, wanted: Callable[[Column], Column]) -> DataFrame:
    """groups with only the wanted items, and without the groups that have none of them."""
    return groups.withColumn(items, F.filter(items, wanted)).filter(F.size(items) > 0)


def nonempty_groups(rows: DataFrame, key: str, wanted: Column) -> DataFrame:
    """key, n of the groups that have wanted rows: filtered_groups for rows that aren't nested, before they are grouped."""
    return rows.filter(wanted).groupBy(key).agg(F.count("*").cast("int").alias("n"))


def nested(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """key, block, items: each key's rows in lists of at most ``size``, so a key of any number of rows has many lists."""
    others = [c for c in rows.columns if c != key]
    block = F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).alias("block")
    return rows.select("*", block).groupBy(key, "block").agg(F.array_sort(F.collect_list(F.struct(*others))).alias("items"))


def inserted(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """table and rows, which get the next free keys in order; rows may be as many as the table's."""
    least = table.agg(F.max(key)).first()[0] or 0
    new = numbered(rows.drop(key) if key != order else rows.withColumnRenamed(key, "_order"), [order if key != order else "_order"], key, start=least + 1)
    return table.unionByName(new.withColumn(key, F.col(key).cast(table.schema[key].dataType)).select(*table.columns))


def running(updates: DataFrame, key: str, order: list[str], ended: Column) -> DataFrame:
    """The latest update of each key, without the keys whose latest one has ended."""
    fields = [c for c in updates.columns if c != key]
    last = updates.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(*order)).alias("_s"))
    return last.select(key, "_s.*").filter(~ended)
