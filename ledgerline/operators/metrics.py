"""Performance of equity curves (run_id, seq, date, value), and exposures of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import RISK_FREE, drawdowns, ratio, returns


def sharpe() -> Column:
    mean, deviation = F.avg("daily_return") - RISK_FREE, F.stddev_samp("daily_return")
    return F.when(F.count("daily_return") < 2, 0.0).when(deviation > 1e-12, ratio(mean, deviation)).otherwise(0.0)


def sortino() -> Column:
    """Over the deviation of the returns below the risk-free rate; null where there is none and the mean is positive."""
    mean = F.avg("daily_return") - RISK_FREE
    down = F.stddev_samp(F.when(F.col("daily_return") < RISK_FREE, F.col("daily_return")))
    return F.when(F.count("daily_return") < 2, 0.0).when(down > 1e-12, ratio(mean, down)).when(mean > 0, F.lit(None)).otherwise(0.0)


def performance(equity: DataFrame) -> DataFrame:
    """One row for each run: sharpe, sortino, max_drawdown (percent, 0 or less) and the first date that attains it."""
    worst = F.min(F.struct("drawdown", "seq", "date"))
    return drawdowns(returns(equity)).groupBy("run_id").agg(sharpe().alias("sharpe"), sortino().alias("sortino"), worst.alias("w")).select("run_id", "sharpe", "sortino", (100 * F.col("w.drawdown")).alias("max_drawdown"), F.when(F.col("w.drawdown") < 0, F.col("w.date")).alias("max_drawdown_date"))


def exposures(positions: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """positions(…by, long, short, price) summed up: long, short, gross, net, and their ratio where there is a short side; and more aggregates."""
    sums = positions.groupBy(*by).agg(F.sum(F.col("long") * F.col("price")).alias("long_exposure"), F.sum(F.col("short") * F.col("price")).alias("short_exposure"), *more)
    long, short = F.col("long_exposure"), F.col("short_exposure")
    return sums.withColumns({"gross_exposure": long + short, "net_exposure": long - short, "long_short_ratio": F.when(short > 1e-9, F.try_divide(long, short))})


def client_statistics(equity: DataFrame) -> DataFrame:
    """Of the retained rows of each run: total return, profit, share of rising periods, and worst drawdown."""
    d = drawdowns(returns(equity))
    first, last = F.min_by("value", "seq"), F.max_by("value", "seq")
    won = F.coalesce(F.avg(F.when(F.col("daily_return").isNotNull(), F.when(F.col("daily_return") > 0, 100.0).otherwise(0.0))), F.lit(0.0))
    return d.groupBy("run_id").agg((100 * (F.try_divide(last, first) - 1)).alias("total_return"), (last - first).alias("profit"), won.alias("win_rate"), (100 * F.min("drawdown")).alias("max_drawdown"))


def signal_counts(signals: DataFrame, by: list[str]) -> DataFrame:
    """Bullish, bearish and neutral signals, case ignored; other words count in none."""
    n = lambda word: F.count_if(F.lower("signal") == word)
    return signals.groupBy(*by).agg(n("bullish").alias("bullish_count"), n("bearish").alias("bearish_count"), n("neutral").alias("neutral_count"))
