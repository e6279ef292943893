import random

import pytest
from ledgerline.operators import ledger, metrics, windows
from ledgerline.plans import backtest
from pyspark.sql import functions as F

#: action, quantity, price; executed, cash, margin used, long, short after it.
GOLDEN = [
    ("buy", 50, 100, 50, 5000, 0, 50, 0), ("buy", 100.9, 110, 45, 50, 0, 95, 0), ("hold", 5, 105, 0, 50, 0, 95, 0), ("sell", 40, 120, 40, 4850, 0, 55, 0), ("short", 30, 120, 30, 6650, 1800, 55, 30),
    ("short", 1000, 125, 106, 13275, 8425, 55, 136), ("cover", 20, 110, 20, 12313.9706, 7186.0294, 55, 116), ("cover", 999, 115, 116, 6160, 0, 55, 0), ("sell", 999, 118, 55, 12650, 0, 0, 0),
]
EQUITY = [10000, 10000, 10500, 10025, 11450, 9650, 3150, 5603.970588235294, 12485, 12650]
SCHEMA = "run_id long, seq long, ticker int, action string, quantity double, price double"


def test_golden_steps(spark):
    rows = [(1, i, 0, a, float(q), float(p)) for i, (a, q, p, *_) in enumerate(GOLDEN)]
    got = ledger.steps(spark.createDataFrame(rows, SCHEMA), 1, cash=10_000.0).orderBy("seq").collect()
    assert [tuple(round(x, 4) for x in (r.executed, r.cash, r.margin_used, r.long, r.short)) for r in got] == [g[3:] for g in GOLDEN]
    last = ledger.final_state(spark.createDataFrame(rows, SCHEMA), 1, cash=10_000.0).first()
    assert (last.cash, last.realized_long, last.realized_short) == (12650.0, [pytest.approx(1340)], [pytest.approx(1310)])


def test_golden_performance(spark):
    curve = spark.createDataFrame([(1, i, f"d{i}", float(v)) for i, v in enumerate(EQUITY)], "run_id long, seq long, date string, value double")
    r = metrics.performance(curve).first()
    assert (r.sharpe, r.sortino, r.max_drawdown, r.max_drawdown_date) == (pytest.approx(4.280795805445945), pytest.approx(7.590147561751643), pytest.approx(-72.48908296943232), "d6")
    last = windows.expanding_metrics(curve).orderBy(F.desc("seq")).first()
    assert (last.sharpe, last.sortino, last.max_drawdown) == (pytest.approx(r.sharpe), pytest.approx(r.sortino), pytest.approx(r.max_drawdown))
    flat = spark.createDataFrame([(2, i, "d", 5.0) for i in range(4)] + [(3, 0, "d", 1.0)], curve.schema)
    assert {(x.run_id, x.sharpe, x.max_drawdown_date) for x in metrics.performance(flat).collect()} == {(2, 0.0, None), (3, 0.0, None)}


def test_both_forms_agree_and_keep_the_rules(spark):
    r = random.Random(8)
    rows = [(run, i, r.randrange(3), r.choice(["buy", "sell", "short", "cover", "hold", "odd"]), r.choice([None, -3.0, 0.0, 2.9, 40.0, 500.0]), r.choice([None, 0.0, 0.01, 10.0, 99.5])) for run in range(25) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    steps = ledger.steps(df, 3).toPandas()
    assert (steps["executed"] >= 0).all() and (steps["long"] >= 0).all() and (steps["short"] >= 0).all() and (steps["executed"] <= 500).all()
    final = ledger.final_state(df, 3).toPandas().set_index("run_id")
    last = steps.sort_values("seq").groupby("run_id").last()
    assert final["cash"].sort_index().tolist() == pytest.approx(last["cash"].tolist())
    assert final["executed"].sort_index().tolist() == steps.groupby("run_id")["executed"].sum().tolist()
    assert [sum(x) for x in final["short_margin_used"].sort_index()] == pytest.approx(last["margin_used"].tolist())


def test_asof_and_seed(spark):
    prices = spark.sql("select * from values (date'2024-01-04', 0, 5D), (date'2024-01-05', 0, 6D), (date'2024-01-07', 0, 7D) t(date, ticker, close)")
    days = backtest.business_days(spark.sql("select date'2024-01-04' a, date'2024-01-09' b"), F.col("a"), F.col("b"))
    got = {(str(r.date), r.close) for r in backtest.asof_close(days, prices).collect()}
    assert got == {("2024-01-04", 5.0), ("2024-01-05", 6.0), ("2024-01-08", 7.0)}


@pytest.mark.parametrize("chunk,block", [(7, 3), (60, 1)])
def test_runs_in_chunks(spark, monkeypatch, chunk, block):
    """Runs of several chunks, of exactly one, of less, give what one row gives."""
    r = random.Random(4)
    rows = [(run, i, r.randrange(3), r.choice(["buy", "sell", "short", "cover"]), float(r.randint(0, 90)), r.choice([0.5, 10.0, 99.5])) for run, n in enumerate([1, 7, 14, 60, 61]) for i in range(n)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted(map(tuple, ledger.steps(df, 3).collect())), sorted(map(str, ledger.final_state(df, 3).collect()))
    monkeypatch.setattr(ledger, "CHUNK", chunk)
    monkeypatch.setattr(ledger, "BLOCK", block)
    got = sorted(map(tuple, ledger.steps(df, 3).collect())), sorted(map(str, ledger.final_state(df, 3).collect()))
    assert got == want and len(got[0]) == len(rows) and len(got[1]) == 5
    assert ledger.steps(df.limit(0), 3).count() == 0


def test_only_trades_are_folded(spark):
    """A backtest is the fold of every day's row, with hold where there is no decision, but reads the trades only."""
    r = random.Random(2)
    days = [f"2024-01-{d:02d}" for d in range(1, 13)]
    prices = spark.createDataFrame([(t, d, r.choice([5.0, 9.5, 20.0])) for t in range(2) for d in days], "ticker int, date string, close double").withColumn("date", F.to_date("date"))
    decisions = spark.createDataFrame([(run, r.choice(days), t, r.choice(["buy", "sell", "short", "cover", "hold", "odd"]), r.choice([0.0, 0.5, 3.0, 7000.0])) for run in range(6) for t in range(2) for _ in range(4)], "run_id long, date string, ticker int, action string, quantity double").withColumn("date", F.to_date("date")).dropDuplicates(["run_id", "date", "ticker"])
    calendar = backtest.business_days(spark.sql("select date'2024-01-01' a, date'2024-01-12' b"), F.col("a"), F.col("b"))
    details, _, _ = backtest.backtest(spark.range(7).withColumnRenamed("id", "run_id"), calendar, prices, decisions, 2)
    every = details.select("run_id", "seq", "date", "ticker", "action", "price").join(decisions.select("run_id", "date", "ticker", "quantity"), ["run_id", "date", "ticker"], "left")
    want = ledger.steps(every.select("run_id", "seq", "ticker", "action", "quantity", "price"), 2)
    columns = ["run_id", "seq", "ticker", "action", "price", "executed", "cash", "margin_used", "long", "short"]
    assert sorted(map(tuple, details.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    assert details.count() == 7 * 10 * 2 and details.filter("executed > 0").count() > 0
