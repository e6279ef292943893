"""Rows to columns and back, and rows appended to reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_cash_row(positions: DataFrame, cash: DataFrame, least: float = 0.01) -> DataFrame:
    """positions and a CASH row for every run whose cash weight is over the least."""
    row = cash.filter(F.col("weight") > least).select("run_id", F.lit("CASH").alias("ticker"), "weight")
    return positions.select("run_id", "ticker", "weight").unionByName(row)


def with_totals(df: DataFrame, by: str, key: str, value: str) -> DataFrame:
    total = df.groupBy(by).agg(F.sum(value).alias(value)).withColumn(key, F.lit("TOTAL"))
    return df.select(by, key, value).unionByName(total)


def metric_rows(df: DataFrame, by: str, metrics: list[str]) -> DataFrame:
    """One row for each metric: by, metric, value."""
    return df.select(by, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(by, metrics, "metric", "value")


def matrix(df: DataFrame, by: list[str], column: str, values: list[str], cell: str) -> DataFrame:
    """One row for each ``by``, one column for each of the listed values."""
    return df.groupBy(*by).pivot(column, values).agg(F.first(cell, ignorenulls=True))


def detail(df: DataFrame, by: list[str], column: str, values: list[str], cell: str) -> DataFrame:
    """A matrix back to rows, cells without a value left out."""
    return df.unpivot(by, values, column, cell).filter(F.col(cell).isNotNull())


def listed(key: Column, order: Column, n: int = 8) -> Column:
    """An aggregate: the first n keys in order, and how many more there are."""
    every = F.array_sort(F.collect_list(F.struct(order.alias("o"), key.cast("string").alias("k"))))
    more = F.size(every) - n
    return F.concat(F.array_join(F.transform(F.slice(every, 1, n), lambda x: x["k"]), ", "), F.when(more > 0, F.concat(F.lit(" +"), more.cast("string"))).otherwise(""))


def right_wins(left: Column, right: Column) -> Column:
    """The union of two maps; keys of both take the right one's value."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)
