"""Prices, equity curves, the ledger and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ledger, metrics, windows
from ..plans import backtest as B
from ..sources import fixtures as fx

BARS = """bars AS (SELECT l_suppkey AS ticker, CAST(l_shipdate AS DATE) AS date,
 CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS close FROM lineitem GROUP BY 1, 2)"""
EQUITY = f"""{BARS}, equity AS (SELECT ticker AS run_id, row_number() OVER (PARTITION BY ticker ORDER BY date) AS seq, date, close AS value FROM bars)"""
RETURNS = f"""{EQUITY}, rets AS (SELECT *, value / nullif(lag(value) OVER w, 0) - 1 AS r, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM equity WINDOW w AS (PARTITION BY run_id ORDER BY seq)),
 dds AS (SELECT *, (value - peak) / nullif(peak, 0) AS dd FROM rets)"""
RF = "(0.0434 / CAST(252 AS DOUBLE))"
ACTION = "CASE event_type WHEN 'purchase' THEN 'buy' WHEN 'error' THEN 'sell' WHEN 'signup' THEN 'short' WHEN 'click' THEN 'cover' WHEN 'view' THEN 'hold' END"
K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
EVENTS = f"""ev AS (SELECT event_id, ts, user_id, event_type, value, {ACTION} AS action, {K} AS k, CAST(event_id % 3 AS INT) AS ticker, CAST(ts AS DATE) AS date FROM events)"""
DECISIONS = f"""{EVENTS}, decisions AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, ticker, action, trunc(k) AS q, value AS p FROM ev)"""
TICKERS = 3


def _fold(source: str, order: str = "seq", m: float = 0.5, cash: float = 100000.0) -> str:
    """SQL that folds source(run_id, seq, ticker, action, q, p) into folded(run_id, s); s.hist has a struct a step."""
    zero = "[" + ", ".join(["CAST(0 AS DOUBLE)"] * TICKERS) + "]"
    at = lambda n: f"list_extract(s.{n}, x.t + 1)"
    arr = lambda n, v: f"list_transform(s.{n}, lambda v, i: CASE WHEN e > 0 AND i = x.t + 1 THEN {v} ELSE v END)"
    rel = f"(e / nullif({at('s')}, 0) * {at('sm')})"
    executed = f"""CASE WHEN x.q <= 0 THEN 0.0 WHEN x.a = 'buy' THEN CASE WHEN x.q * x.p <= s.cash THEN x.q ELSE greatest(floor(s.cash / nullif(x.p, 0)), 0.0) END
 WHEN x.a = 'sell' THEN least(x.q, {at('l')}) WHEN x.a = 'short' THEN CASE WHEN x.q * x.p * {m} <= s.cash THEN x.q ELSE greatest(floor(s.cash / nullif(x.p * {m}, 0)), 0.0) END
 WHEN x.a = 'cover' THEN least(x.q, {at('s')}) ELSE 0.0 END"""
    cashx = f"CASE WHEN e > 0 THEN CASE x.a WHEN 'buy' THEN s.cash - e * x.p WHEN 'sell' THEN s.cash + e * x.p WHEN 'short' THEN s.cash + x.p * e - x.p * e * {m} WHEN 'cover' THEN s.cash + {rel} - e * x.p ELSE s.cash END ELSE s.cash END"
    margin = f"CASE WHEN e > 0 THEN CASE x.a WHEN 'short' THEN s.margin + x.p * e * {m} WHEN 'cover' THEN s.margin - {rel} ELSE s.margin END ELSE s.margin END"
    longs, shorts = arr("l", "CASE x.a WHEN 'buy' THEN v + e WHEN 'sell' THEN v - e ELSE v END"), arr("s", "CASE x.a WHEN 'short' THEN v + e WHEN 'cover' THEN v - e ELSE v END")
    state = f"""{{'cash': {cashx}, 'margin': {margin}, 'l': {longs}, 's': {shorts},
 'sm': {arr('sm', f"CASE x.a WHEN 'short' THEN v + x.p * e * {m} WHEN 'cover' THEN CASE WHEN {at('s')} = e THEN 0.0 ELSE v - {rel} END ELSE v END")},
 'executed': s.executed + e,
 'hist': list_append(s.hist, {{'seq': x.seq, 't': x.t, 'p': x.p, 'e': CAST(e AS DOUBLE), 'cash': CAST({cashx} AS DOUBLE), 'margin': CAST({margin} AS DOUBLE), 'long': list_extract({longs}, x.t + 1), 'short': list_extract({shorts}, x.t + 1)}})}}"""
    init = f"""{{'cash': CAST({cash} AS DOUBLE), 'margin': CAST(0 AS DOUBLE), 'l': {zero}, 's': {zero}, 'sm': {zero}, 'executed': CAST(0 AS DOUBLE),
 'hist': CAST([] AS STRUCT(seq BIGINT, t INTEGER, p DOUBLE, e DOUBLE, cash DOUBLE, margin DOUBLE, long DOUBLE, short DOUBLE)[])}}"""
    return f"""xs AS (SELECT run_id, list({{'seq': CAST({order} AS BIGINT), 't': CAST(ticker AS INTEGER), 'a': action, 'q': CAST(q AS DOUBLE), 'p': CAST(p AS DOUBLE)}} ORDER BY {order}) AS xs FROM {source} GROUP BY run_id),
 folded AS (SELECT run_id, list_reduce(xs, lambda s, x: list_extract(list_transform([{executed}], lambda e: {state}), 1), {init}) AS s FROM xs),
 steps AS (SELECT run_id, unnest(s.hist) AS h FROM folded)"""


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    span = fx.table(spark, d, "events").agg(F.to_date(F.min("ts")).alias("a"), F.to_date(F.max("ts")).alias("b"))
    return B.business_days(span, F.col("a"), F.col("b"))


CALENDAR = "calendar AS (SELECT CAST(unnest(generate_series(CAST(min(ts) AS DATE)::TIMESTAMP, CAST(max(ts) AS DATE)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS date FROM events), business AS (SELECT date FROM calendar WHERE isodow(date) < 6)"
PRICED = f"""{EVENTS}, {CALENDAR}, prices AS (SELECT ticker, date, arg_max(value, (ts, event_id)) AS close FROM ev WHERE value > 0 GROUP BY 1, 2),
 offered AS (SELECT ticker, close, date AS quoted, date FROM prices UNION ALL SELECT ticker, close, date, date + 1 FROM prices),
 priced AS (SELECT date, ticker, arg_max(close, quoted) AS close FROM offered WHERE date IN (SELECT date FROM business) GROUP BY 1, 2),
 complete AS (SELECT date FROM priced GROUP BY 1 HAVING count(DISTINCT ticker) = {TICKERS})"""
TRADES = f"""{PRICED}, daily AS (SELECT user_id AS run_id, date, ticker, arg_max({{'a': action, 'k': k}}, (ts, event_id)) AS d FROM ev GROUP BY 1, 2, 3),
 run_ids AS (SELECT DISTINCT user_id AS run_id FROM events),
 trades AS (SELECT r.run_id, p.date, p.ticker, coalesce(d.d.a, 'hold') AS action, trunc(coalesce(d.d.k, 0)) AS q, p.close AS p, row_number() OVER (PARTITION BY r.run_id ORDER BY p.date, p.ticker) AS seq
 FROM run_ids r CROSS JOIN (SELECT * FROM priced WHERE date IN (SELECT date FROM complete)) p LEFT JOIN daily d ON d.run_id = r.run_id AND d.date = p.date AND d.ticker = p.ticker)"""
DAYS = f"""{TRADES}, {_fold('trades')}, joined AS (SELECT s.run_id, t.date, s.h.seq AS seq, s.h.cash AS cash, s.h.long * s.h.p AS l, s.h.short * s.h.p AS sh FROM steps s JOIN trades t ON t.run_id = s.run_id AND t.seq = s.h.seq),
 days AS (SELECT run_id, date, arg_max(cash, seq) AS cash, sum(l) AS long_exposure, sum(sh) AS short_exposure FROM joined GROUP BY 1, 2)"""


def _backtest(spark: SparkSession, d: str):
    decisions = fx.daily_decisions(spark, d)
    return B.backtest(fx.table(spark, d, "events").select(F.col("user_id").alias("run_id")).distinct(), _calendar(spark, d), fx.daily_prices(spark, d), decisions, TICKERS)


def _r(df: DataFrame, *columns: str, n: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


def sc07(spark, d):
    return _calendar(spark, d)


def j03(spark, d):
    return _r(B.asof_close(_calendar(spark, d), fx.daily_prices(spark, d)), "close")


def j04(spark, d):
    return B.complete_days(B.asof_close(_calendar(spark, d), fx.daily_prices(spark, d)), TICKERS)


def w01(spark, d):
    return _r(windows.returns(fx.equity(spark, d), first=0.0).select("run_id", "seq", "date", "daily_return"), "daily_return", n=6)


def w02(spark, d):
    return _r(windows.drawdowns(fx.equity(spark, d)).select("run_id", "seq", "peak", "drawdown"), "peak", "drawdown", n=6)


def w03(spark, d):
    return _r(windows.expanding_metrics(fx.equity(spark, d)), "sharpe", "sortino", "max_drawdown")


def a07(spark, d):
    return _r(metrics.performance(fx.equity(spark, d)).select("run_id", "sharpe"), "sharpe", n=6)


def a08(spark, d):
    return _r(metrics.performance(fx.equity(spark, d)).select("run_id", "sortino"), "sortino", n=6)


def a09(spark, d):
    return _r(metrics.performance(fx.equity(spark, d)).select("run_id", "max_drawdown", "max_drawdown_date"), "max_drawdown", n=6)


def o01_final(spark, d):
    s = ledger.final_state(fx.decisions(spark, d), TICKERS)
    each = [F.get(c, F.lit(i)).alias(f"{c}_{i}") for c in ("long", "short") for i in range(TICKERS)]
    return _r(s.select("run_id", "cash", "margin_used", "executed", *each), "cash", "margin_used")


def o01_steps(spark, d):
    return _r(ledger.steps(fx.decisions(spark, d), TICKERS).select("run_id", "seq", "ticker", "executed", "cash", "margin_used", "long", "short"), "cash", "margin_used")


def o02(spark, d):
    e = fx.decisions(spark, d).filter("price > 0")
    lots = e.select("run_id", F.col("seq").alias("pos"), "ticker", F.when(F.col("action").isin("buy", "hold"), F.col("quantity")).otherwise(-F.col("quantity")).alias("quantity"), F.col("price").alias("trade_price"))
    return _r(ledger.opening_positions(lots, 0.5), "long_cost_basis", "short_cost_basis", "short_margin_used", "margin_posted")


def a01(spark, d):
    return _r(_backtest(spark, d)[1].select("run_id", "date", "value", "portfolio_return"), "value", "portfolio_return", n=3)


def a02(spark, d):
    return _r(_backtest(spark, d)[1].select("run_id", "date", "long_exposure", "short_exposure", "gross_exposure", "net_exposure"), "long_exposure", "short_exposure", "gross_exposure", "net_exposure", n=3)


def a04(spark, d):
    return _r(_backtest(spark, d)[1].select("run_id", "date", "long_short_ratio"), "long_short_ratio", n=5)


def o03(spark, d):
    return _r(_backtest(spark, d)[2].select("run_id", "sharpe", "max_drawdown", "max_drawdown_date", "gross_exposure", "net_exposure", "n_days"), "sharpe", "max_drawdown", "gross_exposure", "net_exposure", n=3)


def a32(spark, d):
    return _r(metrics.client_statistics(windows.last_rows(fx.equity(spark, d), 50)), "total_return", "profit", "win_rate", "max_drawdown")


def w07(spark, d):
    return windows.last_rows(fx.equity(spark, d), 50)


def w09(spark, d):
    return _r(windows.progress(fx.equity(spark, d)).select("run_id", "seq", "progress"), "progress", n=8)


def w11(spark, d):
    return windows.changes_only(fx.decisions(spark, d), "action", 50).select("run_id", "seq", "action")


def p01(spark, d):
    details, _, _ = _backtest(spark, d)
    net = F.col("long") - F.col("short")
    return _r(details.select("run_id", "seq", "ticker", "action", F.col("executed").alias("quantity"), "price", net.alias("shares_owned"), (net * F.col("price")).alias("position_value")), "price", "position_value", n=3)


def a05(spark, d):
    return metrics.signal_counts(fx.signals(spark, d), ["ticker"])


def l09(spark, d):
    """The 50 newest rows of details and day summaries together; then only the details are shown."""
    details, days, _ = _backtest(spark, d)
    one = details.select("run_id", "seq", F.lit("trade").alias("kind"), "ticker", F.col("executed").alias("quantity"))
    mixed = one.unionByName(days.groupBy("run_id").agg(F.count("*").alias("seq")).withColumn("kind", F.lit("summary")), allowMissingColumns=True)
    return mixed.orderBy(F.desc("seq"), "run_id", "kind").limit(50).filter("kind = 'trade'").select("run_id", "seq", "ticker", "quantity")


def a10(spark, d):
    return _r(B.last_exposures(_backtest(spark, d)[1]), "gross_exposure", "net_exposure", "long_short_ratio", n=3)


_PERF = f"""{RETURNS}, perf AS (SELECT run_id, count(r) AS n, avg(r) - {RF} AS mean, stddev_samp(r) AS sd, stddev_samp(CASE WHEN r < {RF} THEN r END) AS down, min(dd) AS dd, arg_min(date, (dd, seq)) AS worst FROM dds GROUP BY 1)"""
_CLIENT = f"""{EQUITY}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM equity) WHERE k <= 50)"""
QUERIES = {
    "sc07_business_days": (sc07, f"WITH {CALENDAR} SELECT date FROM business"),
    "j03_asof_close": (j03, f"WITH {PRICED} SELECT date, ticker, round(close, 4) AS close FROM priced"),
    "j04_complete_days": (j04, f"WITH {PRICED} SELECT date FROM complete"),
    "w01_daily_return": (w01, f"WITH {RETURNS} SELECT run_id, seq, date, round(coalesce(r, 0), 6) AS daily_return FROM rets"),
    "w02_drawdown_series": (w02, f"WITH {RETURNS} SELECT run_id, seq, round(peak, 6) AS peak, round(dd, 6) AS drawdown FROM dds"),
    "w03_expanding_metrics": (
        w03,
        f"""WITH {RETURNS}, x AS (SELECT run_id, seq, date, count(r) OVER w AS n, avg(r) OVER w - {RF} AS mean, stddev_samp(r) OVER w AS sd, stddev_samp(CASE WHEN r < {RF} THEN r END) OVER w AS down, min(dd) OVER w AS dd FROM dds WINDOW w AS (PARTITION BY run_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
 SELECT run_id, seq, date, round(CASE WHEN n >= 2 AND sd > 1e-12 THEN sqrt(252) * mean / sd ELSE 0 END, 4) AS sharpe, round(CASE WHEN n < 2 THEN 0 WHEN down > 1e-12 THEN sqrt(252) * mean / down WHEN mean > 0 THEN NULL ELSE 0 END, 4) AS sortino, round(CASE WHEN n >= 2 THEN 100 * dd ELSE 0 END, 4) AS max_drawdown FROM x""",
    ),
    "a07_sharpe": (a07, f"WITH {_PERF} SELECT run_id, round(CASE WHEN n >= 2 AND sd > 1e-12 THEN sqrt(252) * mean / sd ELSE 0 END, 6) AS sharpe FROM perf"),
    "a08_sortino": (a08, f"WITH {_PERF} SELECT run_id, round(CASE WHEN n < 2 THEN 0 WHEN down > 1e-12 THEN sqrt(252) * mean / down WHEN mean > 0 THEN NULL ELSE 0 END, 6) AS sortino FROM perf"),
    "a09_max_drawdown": (a09, f"WITH {_PERF} SELECT run_id, round(100 * dd, 6) AS max_drawdown, CASE WHEN dd < 0 THEN worst END AS max_drawdown_date FROM perf"),
    "o01_ledger_final": (o01_final, f"WITH {DECISIONS}, {_fold('decisions')} SELECT run_id, round(s.cash, 4) AS cash, round(s.margin, 4) AS margin_used, s.executed AS executed, " + ", ".join(f"s.{c[0]}[{i + 1}] AS {c}_{i}" for c in ("long", "short") for i in range(TICKERS)) + " FROM folded"),
    "o01_ledger_steps": (o01_steps, f"WITH {DECISIONS}, {_fold('decisions')} SELECT run_id, h.seq AS seq, h.t AS ticker, h.e AS executed, round(h.cash, 4) AS cash, round(h.margin, 4) AS margin_used, h.long AS long, h.short AS short FROM steps"),
    "o02_portfolio_init": (
        o02,
        f"""WITH {DECISIONS}, lots AS (SELECT run_id, seq, ticker, CASE WHEN action IN ('buy', 'hold') THEN q ELSE -q END AS q, p FROM decisions WHERE p > 0)
 SELECT run_id, ticker, coalesce(arg_max(q, seq) FILTER (q > 0), 0) AS long, coalesce(arg_max(-q, seq) FILTER (q < 0), 0) AS short, round(coalesce(arg_max(p, seq) FILTER (q > 0), 0), 4) AS long_cost_basis, round(coalesce(arg_max(p, seq) FILTER (q < 0), 0), 4) AS short_cost_basis,
 round(coalesce(arg_max(-q * p * 0.5, seq) FILTER (q < 0), 0), 4) AS short_margin_used, round(coalesce(sum(-q * p * 0.5) FILTER (q < 0), 0), 4) AS margin_posted FROM lots GROUP BY 1, 2""",
    ),
    "a01_equity": (a01, f"WITH {DAYS} SELECT run_id, date, round(cash + (long_exposure - short_exposure), 3) AS value, round(100 * ((cash + (long_exposure - short_exposure)) / 100000.0::DOUBLE - 1), 3) AS portfolio_return FROM days"),
    "a02_exposure": (a02, f"WITH {DAYS} SELECT run_id, date, round(long_exposure, 3) AS long_exposure, round(short_exposure, 3) AS short_exposure, round(long_exposure + short_exposure, 3) AS gross_exposure, round(long_exposure - short_exposure, 3) AS net_exposure FROM days"),
    "a04_ls_ratio": (a04, f"WITH {DAYS} SELECT run_id, date, round(CASE WHEN short_exposure > 1e-9 THEN long_exposure / short_exposure END, 5) AS long_short_ratio FROM days"),
    "a10_last_exposures": (a10, f"WITH {DAYS}, z AS (SELECT run_id, max(date) AS date, count(*) AS n_days FROM days GROUP BY 1) SELECT run_id, round(long_exposure + short_exposure, 3) AS gross_exposure, round(long_exposure - short_exposure, 3) AS net_exposure, round(CASE WHEN short_exposure > 1e-9 THEN long_exposure / short_exposure END, 3) AS long_short_ratio, n_days FROM days JOIN z USING (run_id, date)"),
    "o03_backtest_metrics": (
        o03,
        f"""WITH {DAYS}, curve AS (SELECT run_id, 0 AS seq, (SELECT min(date) FROM business) AS date, 100000.0::DOUBLE AS value FROM (SELECT DISTINCT run_id FROM days) UNION ALL SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY date), date, cash + (long_exposure - short_exposure) FROM days),
 rr AS (SELECT *, value / nullif(lag(value) OVER w, 0) - 1 AS r, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM curve WINDOW w AS (PARTITION BY run_id ORDER BY seq)), dd AS (SELECT *, (value - peak) / nullif(peak, 0) AS dd FROM rr),
 perf AS (SELECT run_id, count(r) AS n, avg(r) - {RF} AS mean, stddev_samp(r) AS sd, min(dd) AS dd, arg_min(date, (dd, seq)) AS worst FROM dd GROUP BY 1), z AS (SELECT run_id, max(date) AS date, count(*) AS n_days FROM days GROUP BY 1)
 SELECT p.run_id, round(CASE WHEN n >= 2 AND sd > 1e-12 THEN sqrt(252) * mean / sd ELSE 0 END, 3) AS sharpe, round(100 * dd, 3) AS max_drawdown, CASE WHEN dd < 0 THEN worst END AS max_drawdown_date, round(long_exposure + short_exposure, 3) AS gross_exposure, round(long_exposure - short_exposure, 3) AS net_exposure, n_days FROM perf p JOIN z USING (run_id) JOIN days d ON d.run_id = p.run_id AND d.date = z.date""",
    ),
    "a32_client_statistics": (
        a32,
        f"""WITH {_CLIENT}, y AS (SELECT *, value / nullif(lag(value) OVER w, 0) - 1 AS r, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM l WINDOW w AS (PARTITION BY run_id ORDER BY seq))
 SELECT run_id, round(100 * (arg_max(value, seq) / nullif(arg_min(value, seq), 0) - 1), 4) AS total_return, round(arg_max(value, seq) - arg_min(value, seq), 4) AS profit, round(coalesce(avg(CASE WHEN r > 0 THEN 100.0 WHEN r IS NOT NULL THEN 0.0 END), 0), 4) AS win_rate, round(100 * min((value - peak) / nullif(peak, 0)), 4) AS max_drawdown FROM y GROUP BY 1""",
    ),
    "w07_last50": (w07, f"WITH {_CLIENT} SELECT run_id, seq, date, value FROM l"),
    "w09_progress": (w09, f"WITH {EQUITY} SELECT run_id, seq, round(row_number() OVER (PARTITION BY run_id ORDER BY seq) / CAST(count(*) OVER (PARTITION BY run_id) AS DOUBLE), 8) AS progress FROM equity"),
    "w11_history": (w11, f"WITH {DECISIONS}, c AS (SELECT *, lag(action) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM decisions), n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS k FROM c WHERE seq = 1 OR action IS DISTINCT FROM b) SELECT run_id, seq, action FROM n WHERE k <= 50"),
    "p01_ticker_detail": (p01, f"WITH {TRADES}, {_fold('trades')} SELECT s.run_id, s.h.seq AS seq, s.h.t AS ticker, t.action, s.h.e AS quantity, round(s.h.p, 3) AS price, s.h.long - s.h.short AS shares_owned, round((s.h.long - s.h.short) * s.h.p, 3) AS position_value FROM steps s JOIN trades t ON t.run_id = s.run_id AND t.seq = s.h.seq"),
    "a05_signal_counts": (a05, "WITH s AS (SELECT CAST(event_id % 50 AS INT) AS ticker, CASE WHEN event_type IN ('purchase', 'signup') THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' WHEN event_type = 'view' THEN 'neutral' END AS g FROM events) SELECT ticker, count(*) FILTER (g = 'bullish') AS bullish_count, count(*) FILTER (g = 'bearish') AS bearish_count, count(*) FILTER (g = 'neutral') AS neutral_count FROM s GROUP BY 1"),
    "l09_activity_table": (l09, f"WITH {TRADES}, {_fold('trades')}, m AS (SELECT run_id, h.seq AS seq, 'trade' AS kind, h.t AS ticker, h.e AS quantity FROM steps UNION ALL SELECT run_id, count(DISTINCT date), 'summary', NULL, NULL FROM trades GROUP BY 1), top AS (SELECT * FROM m ORDER BY seq DESC, run_id, kind LIMIT 50) SELECT run_id, seq, ticker, quantity FROM top WHERE kind = 'trade'"),
}
