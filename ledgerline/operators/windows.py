"""Sequence operators over runs; every one is a running window of linear cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

RISK_FREE = 0.0434 / 252
YEAR = 252


def in_order(by: str = "run_id", order: str = "seq") -> WindowSpec:
    return Window.partitionBy(by).orderBy(order)


def so_far(by: str = "run_id", order: str = "seq") -> WindowSpec:
    return in_order(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def returns(equity: DataFrame, first: float | None = None) -> DataFrame:
    """equity with daily_return; the first row's is null, or ``first``."""
    r = F.try_divide("value", F.lag("value").over(in_order())) - 1
    return equity.withColumn("daily_return", r if first is None else F.coalesce(r, F.lit(first)))


def drawdowns(equity: DataFrame) -> DataFrame:
    """equity with peak and drawdown (0 or less, a fraction)."""
    peak = F.max("value").over(so_far())
    return equity.withColumn("peak", peak).withColumn("drawdown", F.try_divide(F.col("value") - F.col("peak"), F.col("peak")))


def ratio(mean: Column, deviation: Column) -> Column:
    return F.sqrt(F.lit(float(YEAR))) * mean / deviation


def expanding_metrics(equity: DataFrame) -> DataFrame:
    """Sharpe, Sortino and worst drawdown up to each row; 0 until two returns are known."""
    d = drawdowns(returns(equity))
    w = so_far()
    mean = F.avg("daily_return").over(w) - RISK_FREE
    deviation = F.stddev_samp("daily_return").over(w)
    down = F.stddev_samp(F.when(F.col("daily_return") < RISK_FREE, F.col("daily_return"))).over(w)
    known = F.count("daily_return").over(w) >= 2
    sharpe = F.when(deviation > 1e-12, ratio(mean, deviation)).otherwise(0.0)
    sortino = F.when(down > 1e-12, ratio(mean, down)).when(mean > 0, F.lit(None)).otherwise(0.0)
    return d.select(
        "run_id", "seq", "date", F.when(known, sharpe).otherwise(0.0).alias("sharpe"), F.when(known, sortino).otherwise(0.0).alias("sortino"), F.when(known, 100 * F.min("drawdown").over(w)).otherwise(0.0).alias("max_drawdown")
    )


def last_rows(df: DataFrame, n: int = 50, by: str = "run_id", order: str = "seq") -> DataFrame:
    """The last n rows of each run."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def progress(df: DataFrame, by: str = "run_id", order: str = "seq") -> DataFrame:
    done = F.row_number().over(in_order(by, order)) / F.count("*").over(Window.partitionBy(by))
    return df.withColumn("progress", done)


def changes_only(df: DataFrame, value: str, n: int = 50, by: str = "run_id", order: str = "seq") -> DataFrame:
    """Rows whose value differs from the one before, at most the last n of each run."""
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(in_order(by, order))), F.lit(True)) | (F.row_number().over(in_order(by, order)) == 1)
    return last_rows(df.withColumn("_new", new).filter("_new").drop("_new"), n, by, order)


def numbered_names(df: DataFrame, by: str, order: str, name: str) -> DataFrame:
    """df with display: the name, and its number among equals where there are several."""
    k = F.row_number().over(Window.partitionBy(by).orderBy(order))
    many = F.count("*").over(Window.partitionBy(by)) > 1
    return df.withColumn("display", F.when(many, F.concat(F.col(name), F.lit(" #"), k.cast("string"))).otherwise(F.col(name)))
