"""A backtest as one plan: calendar, as-of prices, complete days, the ledger, and daily results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ledger, metrics


def business_days(df: DataFrame, start, end) -> DataFrame:
    """date: Monday to Friday between two date columns of a one-row frame."""
    return df.select(F.explode(F.sequence(start, end)).alias("date")).filter(F.weekday("date") < 5)


def asof_close(calendar: DataFrame, prices: DataFrame, tolerance: int = 1) -> DataFrame:
    """date, ticker, close: the latest close of the window [date - tolerance, date].

    Each price is offered to the days that it can serve, so this is an equi-join
    and one aggregate, whatever the number of days and tickers.
    """
    offered = prices.select("ticker", "close", F.col("date").alias("quoted"), F.explode(F.sequence(F.col("date"), F.date_add("date", tolerance))).alias("date"))
    return offered.join(calendar, "date", "left_semi").groupBy("date", "ticker").agg(F.max_by("close", "quoted").alias("close"))


def complete_days(priced: DataFrame, tickers: int) -> DataFrame:
    """The days on which every ticker has a price."""
    return priced.groupBy("date").agg(F.count_distinct("ticker").alias("n")).filter(F.col("n") == tickers).select("date")


def trading(decisions: DataFrame, priced: DataFrame) -> DataFrame:
    """The decisions that trade, with the day's price, in trading order: days, and a day's tickers by number."""
    real = decisions.filter(F.col("action").isin(*ledger.TRADES) & (F.col("quantity") >= 1))
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("date", "ticker")).cast("long")
    return real.join(priced, ["date", "ticker"]).select("run_id", "date", "ticker", "action", "quantity", F.col("close").alias("price")).withColumn("seq", seq)


def details_of(runs: DataFrame, calendar: DataFrame, priced: DataFrame, decisions: DataFrame, steps: DataFrame, cash: float) -> DataFrame:
    """A row for every run, priced day and ticker, hold by default: what was traded, and what the run has then.

    Cash and margin stay as the run's last step has left them, a ticker's shares as the
    ticker's last one, so days without a trade are filled from the step before.
    """
    ends = [calendar.agg(f("date")).scalar() for f in (F.min, F.max)]
    days = runs.select("run_id", F.explode(F.sequence(*ends)).alias("date"))  # as many as the calendar is long
    given = decisions.select("run_id", "date", "ticker", "action")
    traded = steps.select("run_id", "date", "ticker", "executed", "cash", "margin_used", "long", "short")
    keys = ["run_id", "date", "ticker"]
    full = days.join(priced, "date").join(given, keys, "left").join(traded, keys, "left")
    of_run = Window.partitionBy("run_id").orderBy("date", "ticker")
    of_ticker = Window.partitionBy("run_id", "ticker").orderBy("date")
    last = lambda c, w, first: F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(first)).alias(c)
    return full.select(
        "run_id", "date", "ticker", F.row_number().over(of_run).cast("long").alias("seq"), F.coalesce("action", F.lit("hold")).alias("action"), F.col("close").alias("price"), F.coalesce("executed", F.lit(0.0)).alias("executed"),
        last("cash", of_run, cash), last("margin_used", of_run, 0.0), last("long", of_ticker, 0.0), last("short", of_ticker, 0.0),
    )


def backtest(runs: DataFrame, calendar: DataFrame, prices: DataFrame, decisions: DataFrame, tickers: int, cash: float = 100_000.0, margin: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Details (a row for each day and ticker), days (value and exposures) and one row of metrics for each run.

    The ledger folds only the decisions that trade.
    """
    priced = asof_close(calendar, prices)
    priced = priced.join(complete_days(priced, tickers), "date", "left_semi")
    steps = ledger.steps(trading(decisions, priced), tickers, cash, margin, carry=("date",))
    details = details_of(runs, calendar, priced, decisions, steps, cash)
    days = metrics.exposures(details, ["run_id", "date"], F.max_by("cash", "seq").alias("cash")).withColumn("value", F.col("cash") + F.col("net_exposure"))
    days = days.withColumn("portfolio_return", 100 * (F.col("value") / cash - 1))
    return details, days, metrics.performance(with_seed(days, calendar, cash)).join(last_exposures(days), "run_id")


def with_seed(days: DataFrame, calendar: DataFrame, cash: float) -> DataFrame:
    """The equity curve with the initial capital on the first business day as its first row."""
    first = calendar.agg(F.min("date")).scalar()
    seq = F.row_number().over(Window.partitionBy("run_id").orderBy("date")).cast("long")
    seed = days.select("run_id").distinct().select("run_id", F.lit(0).cast("long").alias("seq"), first.alias("date"), F.lit(cash).alias("value"))
    return seed.unionByName(days.select("run_id", seq.alias("seq"), "date", "value"))


def last_exposures(days: DataFrame) -> DataFrame:
    last = F.max_by(F.struct("gross_exposure", "net_exposure", "long_short_ratio"), "date")
    return days.groupBy("run_id").agg(last.alias("x"), F.count("*").alias("n_days")).select("run_id", "x.*", "n_days")
