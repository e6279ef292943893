"""Scalars, consensus, allocation, report figures and reshaping over rankings of stocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import reshape
from ..operators import selection as S
from ..plans import reports
from ..sources import fixtures as fx

STOCKS = """stocks AS (SELECT CAST(floor(p_partkey / 30) AS BIGINT) AS run_id, CAST(p_partkey % 30 + 1 AS INT) AS rank, 'T' || p_partkey AS ticker, p_type AS sector, p_retailprice * CAST(p_size AS DOUBLE) / 200 AS cap_value,
 CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size AS DOUBLE) - 10 END AS expected_return, CASE WHEN p_size % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS pe FROM part)"""
SCORES = """scores AS (SELECT CAST(floor(p_partkey / 30) AS BIGINT) AS run_id, 'T' || p_partkey AS ticker, 'buffett' AS investor, p_size / 5.0::DOUBLE AS score FROM part
 UNION ALL SELECT CAST(floor(p_partkey / 30) AS BIGINT), 'T' || p_partkey, 'lynch', ((p_partkey * 37) % 101) / 10.0::DOUBLE FROM part
 UNION ALL SELECT CAST(floor(p_partkey / 30) AS BIGINT), 'T' || p_partkey, 'fisher', CASE WHEN p_partkey % 17 <> 0 THEN ((p_partkey * 7) % 101) / 10.0::DOUBLE END FROM part)"""
EVALUATED = f"""{SCORES}, ev0 AS (SELECT *, coalesce(score, 0) AS z FROM scores), ev AS (SELECT run_id, ticker, investor, score, CASE WHEN z >= 7 THEN 'bullish' WHEN z <= 3 THEN 'bearish' ELSE 'neutral' END AS signal,
 CASE WHEN z >= 7 THEN least(95.0, round_even(60 + (z - 7) / 3 * 35, 0)) WHEN z <= 3 THEN least(90.0, round_even(60 + (3 - z) / 3 * 30, 0)) ELSE round_even(55 + abs(z - 5) * 4, 0) END AS confidence FROM ev0)"""
CONSENSUS = f"""{STOCKS}, {EVALUATED}, votes AS (SELECT run_id, ticker, count(*) FILTER (signal = 'bullish') AS bullish_count, count(*) FILTER (signal = 'bearish') AS bearish_count, round_even(sum(confidence) / 3, 0) AS combined_confidence,
 sum(CASE signal WHEN 'bullish' THEN confidence WHEN 'bearish' THEN 100 - confidence ELSE 50.0 END) / 3 AS adjusted_confidence FROM ev GROUP BY 1, 2),
 con AS (SELECT *, 3 - bullish_count - bearish_count AS neutral_count, bullish_count / 3.0::DOUBLE AS consensus_ratio, CASE WHEN bullish_count = 3 THEN 'strong_buy' WHEN bullish_count >= 2 THEN 'buy' WHEN bearish_count >= 2 THEN 'sell' ELSE 'hold' END AS combined_signal, bullish_count >= 2 AS included FROM votes)"""
WATERFALL = f"""{CONSENSUS}, inc AS (SELECT s.*, c.combined_confidence, c.bullish_count, c.bearish_count, c.combined_signal, c.combined_confidence * (1 + coalesce(expected_return, 0) / 100) AS b FROM stocks s JOIN con c USING (run_id, ticker) WHERE included),
 o AS (SELECT *, row_number() OVER w AS i, sum(b) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM inc WINDOW w AS (PARTITION BY run_id ORDER BY b DESC, rank)),
 cp AS (SELECT *, coalesce(b * (100 - 15.0 * (i - 1)) / nullif(rest, 0) > 15, false) AS capped FROM o), k AS (SELECT *, count(*) FILTER (capped) OVER (PARTITION BY run_id) AS k, sum(b) FILTER (NOT capped) OVER (PARTITION BY run_id) AS free FROM cp),
 w0 AS (SELECT *, CASE WHEN capped THEN 15.0 ELSE coalesce(b * (100 - 15.0 * k) / nullif(free, 0), 0) END AS raw FROM k), w1 AS (SELECT *, CASE WHEN raw < 2 THEN 0.0 ELSE raw END AS w FROM w0),
 wf AS (SELECT *, CASE WHEN sum(w) OVER g > 35 THEN w * 35 / sum(w) OVER g ELSE w END AS weight FROM w1 WINDOW g AS (PARTITION BY run_id, sector)), pos AS (SELECT * FROM wf WHERE weight > 0)"""



def _caps(passes: int = 20) -> str:
    """The passes one after the other: a run without a change stays as it is in all later ones."""
    base = """el AS (SELECT s.run_id, s.rank, s.ticker, s.sector AS g, coalesce(c.adjusted_confidence, 0) AS c FROM stocks s JOIN con c USING (run_id, ticker) WHERE included),
 sh AS (SELECT *, coalesce(100 * c / nullif(sum(c) OVER (PARTITION BY run_id), 0), 0) AS share FROM el), p0 AS (SELECT run_id, rank, ticker, g, 100 * share / sum(share) OVER (PARTITION BY run_id) AS w FROM sh WHERE share >= 2)"""
    one = """,
 a{k} AS MATERIALIZED (SELECT run_id, rank, ticker, g, CASE WHEN sum(w) OVER q > 35.01 THEN w * 35 / sum(w) OVER q ELSE w END AS w FROM p{j} WINDOW q AS (PARTITION BY run_id, g)),
 b{k} AS MATERIALIZED (SELECT run_id, rank, ticker, g, CASE WHEN w > 15.01 THEN 15.0 ELSE w END AS w, w > 15.01 AS high, coalesce(sum(w - 15) FILTER (w > 15.01) OVER (PARTITION BY run_id), 0) AS excess FROM a{k}),
 d{k} AS MATERIALIZED (SELECT *, NOT high AND w < 14.99 AND sum(w) OVER (PARTITION BY run_id, g) < 34.99 AS free FROM b{k}),
 f{k} AS MATERIALIZED (SELECT *, coalesce(sum(w) FILTER (free) OVER (PARTITION BY run_id), 0) AS total FROM d{k}),
 p{k} AS MATERIALIZED (SELECT run_id, rank, ticker, g, CASE WHEN free AND excess > 0.01 AND total > 0.01 THEN w + excess * w / total ELSE w END AS w FROM f{k})"""
    return f"WITH {CONSENSUS}, {base}" + "".join(one.format(j=k, k=k + 1) for k in range(passes)) + f" SELECT run_id, rank, ticker, round(w, 6) AS weight FROM p{passes}"


def _consensus(spark, d) -> DataFrame:
    return S.consensus(S.evaluated(fx.scores(spark, d)))


def _included(spark, d) -> DataFrame:
    return fx.stocks(spark, d).join(_consensus(spark, d), ["run_id", "ticker"]).filter("included")


def _positions(spark, d) -> DataFrame:
    return S.waterfall(_included(spark, d)).filter("weight > 0")


def _r(df: DataFrame, *columns: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in columns})


def x02(spark, d):
    return S.evaluated(fx.scores(spark, d))


def o05(spark, d):
    return _r(_consensus(spark, d).drop("adjusted_confidence"), "consensus_ratio")


def o06(spark, d):
    """Missing evaluators are left out of the votes, and the mean still divides by three."""
    return S.consensus(S.evaluated(fx.scores(spark, d).filter("score is not null"))).select("run_id", "ticker", "bullish_count", "combined_confidence", "combined_signal")


def o07(spark, d):
    c = _consensus(spark, d)
    reason = F.when(~F.col("included"), F.concat(F.lit("no majority ("), F.col("bullish_count").cast("string"), F.lit("/3 bullish)")))
    return _r(c.select("run_id", "ticker", "bullish_count", "bearish_count", "neutral_count", "adjusted_confidence", "included", reason.alias("reason")), "adjusted_confidence")


def f07(spark, d):
    """Majorities of other panels: seven evaluators (agents), four bullish ones."""
    s = fx.signals(spark, d).groupBy("ticker", "agent").agg(F.max_by(F.lower("signal"), F.struct("confidence", F.lower("signal"))).alias("signal"))
    return s.groupBy("ticker").agg(F.count_if(F.col("signal") == "bullish").alias("bullish_count")).filter("bullish_count >= 4")


def o08(spark, d):
    return _r(S.waterfall(_included(spark, d)).select("run_id", "rank", "ticker", "weight"), "weight")


def o09(spark, d):
    return _r(S.iterative_caps(_included(spark, d)), "weight")


def w06(spark, d):
    return S.ranked_by_weight(_positions(spark, d)).select("run_id", "ticker", "place")


def a17(spark, d):
    w = _positions(spark, d).groupBy("run_id").agg(S.weighted_average("expected_return").alias("expected_return"), S.weighted_average("pe").alias("pe"), F.avg("expected_return").alias("plain_return"))
    return _r(w, "expected_return", "pe", "plain_return")


def a18(spark, d):
    return _r(S.group_weights(_positions(spark, d), X.cap_bucket("cap_value")), "weight")


def a19(spark, d):
    return _r(S.group_weights(_positions(spark, d), F.col("sector")), "weight")


def a20(spark, d):
    return _r(S.concentration(_positions(spark, d)).drop("hhi"), "top1", "top3", "top5", "top10")


def a21(spark, d):
    p = _positions(spark, d)
    with_cash = p.select("run_id", "weight").unionByName(S.cash(p)).groupBy("run_id").agg(S.hhi().alias("hhi_with_cash"))
    return _r(S.concentration(p).select("run_id", "hhi").join(with_cash, "run_id"), "hhi", "hhi_with_cash")


def a22(spark, d):
    return _r(S.largest_group(_positions(spark, d)), "largest_weight", "top3_groups")


def a24(spark, d):
    return _r(_positions(spark, d).groupBy("run_id").agg((100 * F.avg(F.when(F.col("bullish_count") == 3, 1.0).otherwise(0.0))).alias("unanimity")), "unanimity")


def a25(spark, d):
    return _consensus(spark, d).groupBy("run_id").agg(F.count_if((F.col("bullish_count") >= 1) & (F.col("bearish_count") >= 1)).alias("split_opinions"))


def a26(spark, d):
    reason = F.concat(F.col("bullish_count").cast("string"), F.lit("/3"))
    return _consensus(spark, d).filter("not included").groupBy("run_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def a27(spark, d):
    s = lambda k: F.coalesce(F.sum(F.when(F.col("combined_signal") == k, F.col("weight"))), F.lit(0.0))
    return _r(_positions(spark, d).groupBy("run_id").agg(s("strong_buy").alias("strong_buy"), s("buy").alias("buy")), "strong_buy", "buy")


def a28(spark, d):
    return _r(_consensus(spark, d).groupBy("run_id").agg((F.count_if("included") / F.count("*")).alias("inclusion_rate")), "inclusion_rate")


def a29(spark, d):
    return fx.stocks(spark, d).groupBy("run_id").agg(reshape.listed(F.col("ticker"), F.col("rank"), 8).alias("tickers"))


def u01(spark, d):
    p = _positions(spark, d)
    return _r(reshape.with_cash_row(p, S.cash(p)), "weight")


def u02(spark, d):
    return _r(reshape.with_totals(_positions(spark, d), "run_id", "ticker", "weight"), "weight")


def u05(spark, d):
    return _r(reshape.metric_rows(S.concentration(_positions(spark, d)), "run_id", ["top1", "top3", "top5", "top10", "hhi"]), "value")


def u06(spark, d):
    return reshape.matrix(S.evaluated(fx.scores(spark, d)), ["run_id", "ticker"], "investor", list(fx.INVESTORS), "signal")


def u07(spark, d):
    return reshape.detail(u06(spark, d), ["run_id", "ticker"], "investor", list(fx.INVESTORS), "signal")


def j09(spark, d):
    return fx.stocks(spark, d).join(_positions(spark, d), ["run_id", "ticker"], "left_semi").select("run_id", "ticker", "rank")


def j10(spark, d):
    return fx.stocks(spark, d).join(_positions(spark, d), ["run_id", "ticker"], "left_anti").select("run_id", "ticker", "rank")


def l05(spark, d):
    return fx.stocks(spark, d).filter("rank <= 10").select("run_id", "rank", "ticker")


def l11(spark, d):
    return S.ranked_by_weight(_positions(spark, d)).filter("place <= 5").select("run_id", "place", "ticker")


def p05(spark, d):
    s = fx.stocks(spark, d)
    return _r(s.select("run_id", "rank", "ticker", (F.coalesce("expected_return", F.lit(0.0)) / 100).alias("expected_return"), F.coalesce(F.col("pe").cast("int").cast("string"), F.lit("N/A")).alias("pe")), "expected_return")


def x05(spark, d):
    return fx.stocks(spark, d).select("ticker", X.cap_bucket("cap_value").alias("bucket"))


def o10(spark, d):
    return _r(reports.risk_panel(_consensus(spark, d), _positions(spark, d)), "value", n=5)


def o11(spark, d):
    return _r(reports.summary_panel(_consensus(spark, d), _positions(spark, d)), "value", n=5)


def _sql(body: str, base: str = WATERFALL) -> str:
    return f"WITH {base} {body}"


_SUMS = "g AS (SELECT run_id, sector, sum(weight) AS w FROM pos GROUP BY 1, 2), gr AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY w DESC, sector) AS p FROM g)"
_PLACED = "pl AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC, rank) AS place FROM pos)"
_CONC = f"""{_PLACED}, cc AS (SELECT run_id, coalesce(sum(weight) FILTER (place <= 1), 0) AS top1, coalesce(sum(weight) FILTER (place <= 3), 0) AS top3, coalesce(sum(weight) FILTER (place <= 5), 0) AS top5, coalesce(sum(weight) FILTER (place <= 10), 0) AS top10, sum(pow(weight / 100, 2)) AS hhi FROM pl GROUP BY 1)"""
_CASH = "cash AS (SELECT run_id, greatest(100 - sum(weight), 0) AS weight FROM pos GROUP BY 1)"
_BUCKET = "CASE WHEN cap_value > 200 THEN 'mega' WHEN cap_value > 10 THEN 'large' WHEN cap_value > 2 THEN 'mid' ELSE 'small' END"
_MATRIX = f"{EVALUATED}, mx AS (SELECT run_id, ticker, max(signal) FILTER (investor = 'buffett') AS buffett, max(signal) FILTER (investor = 'lynch') AS lynch, max(signal) FILTER (investor = 'fisher') AS fisher FROM ev GROUP BY 1, 2)"
_WAVG = lambda c: f"coalesce(sum(weight * coalesce({c}, 0)) / nullif(sum(weight), 0), 0)"
QUERIES = {
    "x02_confidence": (x02, f"WITH {EVALUATED} SELECT * FROM ev"),
    "o05_consensus_scores": (o05, _sql("SELECT run_id, ticker, bullish_count, bearish_count, combined_confidence, neutral_count, round(consensus_ratio, 6) AS consensus_ratio, combined_signal, included FROM con", CONSENSUS)),
    "o06_consensus_agents": (o06, f"WITH {EVALUATED}, v AS (SELECT run_id, ticker, count(*) FILTER (signal = 'bullish') AS b, count(*) FILTER (signal = 'bearish') AS s, round_even(sum(confidence) / 3, 0) AS c FROM ev WHERE score IS NOT NULL GROUP BY 1, 2) SELECT run_id, ticker, b AS bullish_count, c AS combined_confidence, CASE WHEN b = 3 THEN 'strong_buy' WHEN b >= 2 THEN 'buy' WHEN s >= 2 THEN 'sell' ELSE 'hold' END AS combined_signal FROM v"),
    "o07_consensus_adjusted": (o07, _sql("SELECT run_id, ticker, bullish_count, bearish_count, neutral_count, round(adjusted_confidence, 6) AS adjusted_confidence, included, CASE WHEN NOT included THEN 'no majority (' || bullish_count || '/3 bullish)' END AS reason FROM con", CONSENSUS)),
    "f07_majority_of_seven": (f07, """WITH s AS (SELECT CAST(user_id % 7 AS INT) AS agent, CAST(event_id % 50 AS INT) AS ticker, CASE WHEN event_type IN ('purchase', 'signup') THEN 'bullish' WHEN event_type = 'error' THEN 'bearish' WHEN event_type = 'view' THEN 'neutral' ELSE 'unsure' END AS g, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS c FROM events),
 l AS (SELECT ticker, agent, arg_max(g, (c, g)) AS g FROM s GROUP BY 1, 2) SELECT ticker, count(*) FILTER (g = 'bullish') AS bullish_count FROM l GROUP BY 1 HAVING count(*) FILTER (g = 'bullish') >= 4"""),
    "o08_waterfall": (o08, _sql("SELECT run_id, rank, ticker, round(weight, 6) AS weight FROM wf")),
    "o09_iterative_caps": (o09, _caps()),
    "w06_rank_by_weight": (w06, _sql(f", {_PLACED} SELECT run_id, ticker, place FROM pl")),
    "a17_weighted_avg": (a17, _sql(f"SELECT run_id, round({_WAVG('expected_return')}, 6) AS expected_return, round({_WAVG('pe')}, 6) AS pe, round(avg(expected_return), 6) AS plain_return FROM pos GROUP BY 1")),
    "a18_cap_buckets": (a18, _sql(f", {_CASH} SELECT run_id, {_BUCKET} AS bucket, round(sum(weight), 6) AS weight FROM pos GROUP BY 1, 2 UNION ALL SELECT run_id, 'cash', round(weight, 6) FROM cash WHERE weight > 0.01")),
    "a19_sector_weights": (a19, _sql(f", {_CASH} SELECT run_id, sector AS bucket, round(sum(weight), 6) AS weight FROM pos GROUP BY 1, 2 UNION ALL SELECT run_id, 'cash', round(weight, 6) FROM cash WHERE weight > 0.01")),
    "a20_topk": (a20, _sql(f", {_CONC} SELECT run_id, round(top1, 6) AS top1, round(top3, 6) AS top3, round(top5, 6) AS top5, round(top10, 6) AS top10 FROM cc")),
    "a21_hhi": (a21, _sql(f", {_CONC}, {_CASH}, ac AS (SELECT run_id, sum(pow(weight / 100, 2)) AS h FROM (SELECT run_id, weight FROM pos UNION ALL SELECT run_id, weight FROM cash) GROUP BY 1) SELECT run_id, round(hhi, 6) AS hhi, round(h, 6) AS hhi_with_cash FROM cc JOIN ac USING (run_id)")),
    "a22_argmax": (a22, _sql(f", {_SUMS} SELECT run_id, max(sector) FILTER (p = 1) AS largest, round(max(w), 6) AS largest_weight, round(sum(w) FILTER (p <= 3), 6) AS top3_groups FROM gr GROUP BY 1")),
    "a24_unanimity": (a24, _sql("SELECT run_id, round(100 * avg(CASE WHEN bullish_count = 3 THEN 1.0 ELSE 0.0 END), 6) AS unanimity FROM pos GROUP BY 1")),
    "a25_split": (a25, _sql("SELECT run_id, count(*) FILTER (bullish_count >= 1 AND bearish_count >= 1) AS split_opinions FROM con GROUP BY 1", CONSENSUS)),
    "a26_rejections": (a26, _sql("SELECT run_id, bullish_count || '/3' AS reason, count(*) AS n FROM con WHERE NOT included GROUP BY 1, 2", CONSENSUS)),
    "a27_sumif": (a27, _sql("SELECT run_id, round(coalesce(sum(weight) FILTER (combined_signal = 'strong_buy'), 0), 6) AS strong_buy, round(coalesce(sum(weight) FILTER (combined_signal = 'buy'), 0), 6) AS buy FROM pos GROUP BY 1")),
    "a28_inclusion_rate": (a28, _sql("SELECT run_id, round(count(*) FILTER (included) / CAST(count(*) AS DOUBLE), 6) AS inclusion_rate FROM con GROUP BY 1", CONSENSUS)),
    "a29_string_agg": (a29, f"WITH {STOCKS}, k AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY rank, ticker) AS i, count(*) OVER (PARTITION BY run_id) AS n FROM stocks) SELECT run_id, string_agg(ticker, ', ' ORDER BY i) FILTER (i <= 8) || CASE WHEN max(n) > 8 THEN ' +' || (max(n) - 8) ELSE '' END AS tickers FROM k GROUP BY 1"),
    "u01_cash_row": (u01, _sql(f", {_CASH} SELECT run_id, ticker, round(weight, 6) AS weight FROM pos UNION ALL SELECT run_id, 'CASH', round(weight, 6) FROM cash WHERE weight > 0.01")),
    "u02_totals": (u02, _sql("SELECT run_id, ticker, round(weight, 6) AS weight FROM pos UNION ALL SELECT run_id, 'TOTAL', round(sum(weight), 6) FROM pos GROUP BY 1")),
    "u05_unpivot_metrics": (u05, _sql(f", {_CONC} SELECT run_id, m.metric AS metric, round(m.value, 6) AS value FROM (SELECT run_id, unnest([{{'metric': 'top1', 'value': top1}}, {{'metric': 'top3', 'value': top3}}, {{'metric': 'top5', 'value': top5}}, {{'metric': 'top10', 'value': top10}}, {{'metric': 'hhi', 'value': hhi}}]) AS m FROM cc)")),
    "u06_matrix": (u06, f"WITH {_MATRIX} SELECT * FROM mx"),
    "u07_detail": (u07, f"WITH {EVALUATED} SELECT run_id, ticker, investor, signal FROM ev"),
    "j09_semi": (j09, _sql("SELECT run_id, ticker, rank FROM stocks s WHERE EXISTS (SELECT 1 FROM pos p WHERE p.run_id = s.run_id AND p.ticker = s.ticker)")),
    "j10_anti": (j10, _sql("SELECT run_id, ticker, rank FROM stocks s WHERE NOT EXISTS (SELECT 1 FROM pos p WHERE p.run_id = s.run_id AND p.ticker = s.ticker)")),
    "l05_first_ranks": (l05, f"WITH {STOCKS} SELECT run_id, rank, ticker FROM stocks WHERE rank <= 10"),
    "l11_first_positions": (l11, _sql(f", {_PLACED} SELECT run_id, place, ticker FROM pl WHERE place <= 5")),
    "p05_ranking_sheet": (p05, f"WITH {STOCKS} SELECT run_id, rank, ticker, round(coalesce(expected_return, 0) / 100, 6) AS expected_return, coalesce(CAST(CAST(pe AS INT) AS VARCHAR), 'N/A') AS pe FROM stocks"),
    "x05_cap_bucket": (x05, f"WITH {STOCKS} SELECT ticker, {_BUCKET} AS bucket FROM stocks"),
    "o10_risk_panel": (
        o10,
        _sql(f", {_CONC}, {_SUMS}, lg AS (SELECT run_id, max(w) AS largest_sector, sum(w) FILTER (p <= 3) AS top3_sectors FROM gr GROUP BY 1), un AS (SELECT run_id, 100 * avg(CASE WHEN bullish_count = 3 THEN 1.0 ELSE 0.0 END) AS unanimity FROM pos GROUP BY 1), vo AS (SELECT run_id, count(*) FILTER (bullish_count >= 1 AND bearish_count >= 1) AS split, count(*) FILTER (NOT included) AS rejected FROM con GROUP BY 1), al AS (SELECT * FROM cc JOIN lg USING (run_id) JOIN un USING (run_id) JOIN vo USING (run_id)) SELECT run_id, m.metric AS metric, round(m.value, 5) AS value FROM (SELECT run_id, unnest(["
             + ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in ("top1", "top3", "top5", "top10", "hhi", "largest_sector", "top3_sectors", "unanimity", "split", "rejected"))
             + "]) AS m FROM al)"),
    ),
    "o11_summary_panel": (
        o11,
        _sql(f", s AS (SELECT run_id, count(*) AS positions, sum(weight) AS invested, greatest(100 - sum(weight), 0) AS cash, {_WAVG('expected_return')} AS weighted_return, {_WAVG('combined_confidence')} AS weighted_confidence FROM pos GROUP BY 1), n AS (SELECT run_id, count(*) AS universe FROM con GROUP BY 1), al AS (SELECT *, positions / CAST(universe AS DOUBLE) AS inclusion FROM s JOIN n USING (run_id)) SELECT run_id, m.metric AS metric, round(m.value, 5) AS value FROM (SELECT run_id, unnest(["
             + ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in ("positions", "invested", "cash", "weighted_return", "weighted_confidence", "universe", "inclusion"))
             + "]) AS m FROM al)"),
    ),
}
QUERIES = {k: (f, s.replace(" , ", ", ") if s else s) for k, (f, s) in QUERIES.items()}
