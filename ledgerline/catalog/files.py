"""Files written from the tables and read back through the sources; joins and texts that go with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import selection as S
from ..plans import reports
from ..sources import files
from ..sources import fixtures as fx
from .selection import CONSENSUS, EVALUATED, STOCKS, WATERFALL


def _lists(rows: DataFrame, group, path: str) -> str:
    """A file for each group, a JSON array of its objects: groups are of a stated number of rows."""
    one = F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct(*rows.columns))), ","), F.lit("]"))
    rows.groupBy(group.alias("g")).agg(one.alias("value")).write.partitionBy("g").text(path)
    return path


def sc03(spark, d):
    """Rankings of 30 stocks in prediction files, read back and taken apart."""
    ranked = F.array_sort(F.collect_list(F.struct("rank", "ticker", F.struct(F.col("cap_value").alias("value")).alias("market_cap"), F.struct("pe").alias("metrics"))))
    runs = fx.stocks(spark, d).groupBy("run_id").agg(ranked.alias("rankings")).select(F.concat(F.lit("run "), F.col("run_id").cast("string")).alias("analysis_date"), "rankings", "run_id")
    path = _lists(runs, F.floor(F.col("run_id") / 50), files.shared_path(spark, "predictions"))
    return files.rankings(spark, f"{path}/*/*").select("analysis_date", "rank", "ticker", F.round("market_cap.value", 4).alias("cap"), F.col("metrics.pe").alias("pe"))


def _analyses(spark, d) -> DataFrame:
    return S.evaluated(fx.scores(spark, d).filter("score is not null")).select("investor", "ticker", "signal", "confidence")


def sc04(spark, d):
    """Each investor's analyses, maps of tickers in files of up to some hundred of them."""
    base = files.shared_path(spark, "analyses")
    entry = F.struct("ticker", F.struct("signal", "confidence", F.concat(F.lit("because of "), "ticker").alias("reasoning")))
    block = F.floor(F.substring("ticker", 2, 20).cast("long") / 300).alias("g")
    maps = _analyses(spark, d).groupBy("investor", block).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    maps.write.partitionBy("investor", "g").text(base)
    return files.analyses(spark, {i: f"{base}/investor={i}/*/*" for i in fx.INVESTORS})


def j07(spark, d):
    """Every stock and investor, with the analysis where there is one; missing ones don't vote but count in the mean."""
    return S.joined_analyses(fx.stocks(spark, d).select("run_id", "ticker"), _analyses(spark, d), list(fx.INVESTORS))


def j07_votes(spark, d):
    full = S.joined_analyses(fx.stocks(spark, d).select("run_id", "ticker"), _analyses(spark, d), list(fx.INVESTORS))
    return S.consensus(full).select("run_id", "ticker", "bullish_count", "bearish_count", "combined_confidence", "included")


def sc05(spark, d):
    """Literal rows beside the table's."""
    labels = files.literal(spark, [("buffett", "Warren Buffett"), ("lynch", "Peter Lynch"), ("fisher", "Phil Fisher"), ("graham", None)], "investor string, label string")
    return fx.scores(spark, d).join(labels, "investor", "right").groupBy("investor", "label").agg(F.count("score").alias("n"))


def sc08(spark, d):
    """Models of a catalog file, and those of the fallback where there is no file."""
    models = fx.table(spark, d, "part").select(F.col("p_name").alias("display_name"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("model_name"), F.col("p_brand").alias("provider"))
    path = _lists(models, F.floor(F.substring("model_name", 2, 20).cast("long") / 500), files.shared_path(spark, "models"))
    fallback = [("GPT", "gpt-4.1", "OpenAI")]
    found, missing = files.model_catalog(spark, f"{path}", fallback), files.model_catalog(spark, f"{path}/none.json", fallback)
    return found.select("display_name", "model_name", "provider").unionByName(missing)


def sc10(spark, d):
    """Requests of runs as bodies, with fields left out and bodies that are none."""
    o = fx.table(spark, d, "orders")
    full = F.to_json(F.struct(F.array(F.concat(F.lit("T"), F.col("o_custkey").cast("string"))).alias("tickers"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("initial_capital"), F.when(F.col("o_orderkey") % 2 == 0, "m").alias("model_name")))
    bodies = o.select(F.when(F.col("o_orderstatus") == "P", "{oops").otherwise(full).alias("body"))
    return files.request_rows(bodies).select(F.get("tickers", F.lit(0)).alias("ticker"), F.round("initial_capital", 2).alias("initial_capital"), "model_name", "margin_requirement", F.col("_corrupt").alias("corrupt"))


def sk03(spark, d):
    rows = fx.flows(spark, d).select("flow_id", "name", "is_template")
    return spark.read.schema(rows.schema).json(files.save_json(rows, files.shared_path(spark, "outputs"), "flows.json"))


def sk01(spark, d):
    """The six sheets written, and what each file has."""
    folder = files.shared_path(spark, "workbook")
    sheets = reports.workbook(fx.stocks(spark, d), S.evaluated(fx.scores(spark, d)), list(fx.INVESTORS))
    reports.write_workbook(sheets, folder)
    read = {name: spark.read.parquet(f"{folder}/{name}") for name in sheets}
    sums = {"portfolio": F.round(F.sum("weight") / F.count_distinct("run_id"), 4), "ranking": F.count_distinct("ticker").cast("double"), "matrix": F.count("buffett").cast("double"), "detail": F.round(F.sum("confidence"), 0), "summary": F.sum(F.when(F.col("metric") == "universe", F.col("value"))), "risk": F.count_distinct("metric").cast("double")}
    out = None
    for name, df in read.items():
        one = df.agg(F.lit(name).alias("sheet"), F.count_distinct("run_id").alias("runs"), sums[name].alias("figure"))
        out = one if out is None else out.unionByName(one)
    return out


def sk02(spark, d):
    """The text report of every run, written as text in order and read back."""
    lines = reports.text_report(fx.stocks(spark, d), S.evaluated(fx.scores(spark, d)), list(fx.INVESTORS))
    folder = files.shared_path(spark, "report")
    text = F.concat_ws("\t", "run_id", "section", "line_no", "line").alias("value")
    lines.repartitionByRange("run_id").sortWithinPartitions("run_id", "section", "line_no").select(text).write.text(folder)
    parts = F.split("value", "\t", 4)
    return spark.read.text(folder).select(parts[0].cast("long").alias("run_id"), parts[1].cast("int").alias("section"), parts[2].cast("int").alias("line_no"), parts[3].alias("line"))


def x09_full(spark, d):
    """Every investor's sentence on each stock."""
    both = S.evaluated(fx.scores(spark, d)).join(fx.stocks(spark, d).select("run_id", "ticker", "rank", "sector", "expected_return", "pe"), ["run_id", "ticker"])
    factors = F.when(F.col("rank") % 4 != 0, F.array("sector", "ticker", F.lit("third"))).otherwise(F.array().cast("array<string>"))
    peg = F.try_divide("pe", F.nullif(F.col("expected_return"), F.lit(0.0)))
    return both.select("run_id", "ticker", "investor", X.full_reasoning("investor", "signal", F.col("pe") * 2, "pe", F.when(F.col("rank") % 5 == 0, F.lit(None)).otherwise(peg), "expected_return", "score", factors).alias("reasoning"))


def x18(spark, d):
    t = fx.messages(spark, d)
    return t.select("conv_id", "turn", F.posexplode(X.paragraphs("text")).alias("place", "paragraph"))


def x22_signals(spark, d):
    s = fx.signals(spark, d).groupBy("agent", "signal").agg(F.count("*").alias("n"))
    return s.select("agent", "signal", X.label(F.upper("signal"), X.SIGNAL_COLOURS, "muted").alias("colour"), "n")


def x22_actions(spark, d):
    e = fx.decisions(spark, d).withColumn("action", F.when(F.col("quantity") > 90, "wait").otherwise(F.col("action")))
    return e.groupBy("action").agg(F.count("*").alias("n")).select(F.upper("action").alias("action"), X.label(F.upper("action"), X.ACTION_COLOURS, "muted").alias("colour"), "n")


_ANALYSED = f"{EVALUATED}, an AS (SELECT ticker, investor, signal, confidence FROM ev WHERE score IS NOT NULL)"
_FULL = f"WITH {_ANALYSED}, st AS (SELECT CAST(p_partkey // 30 AS BIGINT) AS run_id, 'T' || p_partkey AS ticker FROM part), fl AS (SELECT run_id, st.ticker, i.investor, an.signal, an.confidence FROM st CROSS JOIN (VALUES ('buffett'), ('lynch'), ('fisher')) i(investor) LEFT JOIN an ON an.ticker = st.ticker AND an.investor = i.investor)"
def _num(x: str, digits: int = 1) -> str:
    return f"printf('%.{digits}f', round_even({x}, {digits}))"


def _signed(x: str) -> str:
    return f"coalesce(printf('%+.1f%%', round_even({x}, 1)), 'N/A')"


def _reasons_sql() -> str:
    """The sentences, with the figures of x09_full."""
    figures = {
        "roe": "coalesce(printf('%.1f%%', round_even(pe * 2, 1)), 'N/A')", "pe": f"coalesce({_num('pe')}, 'N/A')", "growth": "coalesce(printf('%.1f%%', round_even(expected_return, 1)), 'N/A')",
        "peg": f"coalesce(CASE WHEN rank % 5 <> 0 THEN {_num('pe / nullif(expected_return, 0)')} END, 'N/A')", "momentum": f"coalesce({_num('score')}, 'N/A')", "factors": f"CASE WHEN rank % 4 <> 0 THEN sector || '; ' || ticker ELSE '{X.NO_FACTORS}' END",
    }
    cases = []
    for (investor, signal), text in X.REASONS.items():
        for name, value in figures.items():
            text = text.replace(f"{{{name}}}", f"' || {value} || '")
        cases.append(f"WHEN investor = '{investor}' AND signal = '{signal}' THEN '{text}'")
    return f"WITH {STOCKS}, {EVALUATED} SELECT run_id, ticker, investor, CASE {' '.join(cases)} END AS reasoning FROM ev JOIN stocks USING (run_id, ticker)"


def _report_sql() -> str:
    mean = lambda x: f"coalesce(sum(weight * coalesce({x}, 0)) / nullif(sum(weight), 0), 0)"
    bucket = "CASE WHEN cap_value > 200 THEN 'mega' WHEN cap_value > 10 THEN 'large' WHEN cap_value > 2 THEN 'mid' ELSE 'small' END"
    first = f"concat_ws(' ', place, ticker, {_num('weight')} || '%', {bucket}, sig, {_num('combined_confidence', 0)} || '%', {_signed('expected_return')}, coalesce({_num('pe')}, 'N/A'), bullish_count || '/3')"
    facts = [("held ", "held || '/' || universe"), ("confidence ", _num("confidence", 0)), ("return ", _signed("expected")), ("strong buy ", _num("strong")), ("buy ", _num("rest")), ("cash ", _num("cash"))]
    cash, total = f"'CASH ' || {_num('cash')} || '%'", f"'total ' || {_num('invested + cash')} || '% avg ' || {_num('confidence', 0)} || '% avg ' || {_signed('expected')}"
    parts = [
        f"SELECT run_id, 1 AS section, place AS line_no, {first} AS line FROM rk",
        f"SELECT run_id, 1, 1000000, {cash} FROM fg WHERE cash > 0.01",
        f"SELECT run_id, 1, 1000001, {total} FROM fg",
        "SELECT run_id, 2, rank, ticker || ' ' || said FROM stocks JOIN sd USING (run_id, ticker)",
        "SELECT run_id, 3, place, ticker || ' ' || sig || ' ' || said FROM rk JOIN sd USING (run_id, ticker) WHERE place <= 5",
        *(f"SELECT run_id, 4, {i}, '{name}' || {value} FROM fg JOIN un USING (run_id)" for i, (name, value) in enumerate(facts)),
        "SELECT run_id, 5, 0, 'all: ' || coalesce(string_agg(ticker, ', ' ORDER BY place) FILTER (bullish_count = 3), '') FROM rk GROUP BY 1",
        "SELECT run_id, 5, 1, 'most: ' || coalesce(string_agg(ticker, ', ' ORDER BY place) FILTER (bullish_count < 3), '') FROM rk GROUP BY 1",
        f"SELECT run_id, 6, k, sector || ' ' || {_num('w')} || CASE WHEN w > 30 AND w <= 35.5 THEN ' (within the cap of 35)' ELSE '' END FROM sr",
        f"SELECT run_id, 6, 1000000, {cash} FROM fg WHERE cash > 0.01",
        "SELECT run_id, 7, rank, concat_ws(' ', ticker, rank, bullish_count || '/3') FROM stocks JOIN con USING (run_id, ticker) WHERE NOT included",
        f"SELECT run_id, 8, 0, 'top 5 ' || {_num('sum(weight) FILTER (place <= 5)')} FROM rk GROUP BY 1",
        f"SELECT run_id, 8, 1, concat_ws(' ', 'largest', ticker, {_num('weight')}) FROM rk WHERE place = 1",
        f"SELECT run_id, 8, 2, concat_ws(' ', 'largest sector', sector, {_num('w')}) FROM sr WHERE k = 1",
        "SELECT run_id, 9, rank, ticker || ' ' || said FROM stocks JOIN con USING (run_id, ticker) JOIN sd USING (run_id, ticker) WHERE bullish_count >= 1 AND bearish_count >= 1",
    ]
    with_ = f"""WITH {WATERFALL}, rk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY weight DESC, rank) AS place, CASE WHEN bullish_count = 3 THEN 'strong buy' ELSE 'buy' END AS sig FROM pos),
 sd AS (SELECT run_id, ticker, string_agg(signal || '(' || printf('%.0f', confidence) || ')', ' ' ORDER BY CASE investor WHEN 'buffett' THEN 1 WHEN 'lynch' THEN 2 ELSE 3 END) AS said FROM ev GROUP BY 1, 2),
 fg AS (SELECT run_id, sum(weight) AS invested, greatest(100 - sum(weight), 0.0::DOUBLE) AS cash, count(*) AS held, coalesce(sum(weight) FILTER (bullish_count = 3), 0) AS strong, coalesce(sum(weight) FILTER (bullish_count < 3), 0) AS rest, {mean('combined_confidence')} AS confidence, {mean('expected_return')} AS expected FROM pos GROUP BY 1),
 un AS (SELECT run_id, count(*) AS universe FROM stocks GROUP BY 1), sr AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY w DESC, sector) AS k FROM (SELECT run_id, sector, sum(weight) AS w FROM pos GROUP BY 1, 2))"""
    return f"{with_} {' UNION ALL '.join(parts)}"


QUERIES = {
    "x09_reasoning_text": (x09_full, _reasons_sql()),
    "sk02_text_report": (sk02, _report_sql()),
    "sc03_predictions": (sc03, f"WITH {STOCKS} SELECT 'run ' || run_id AS analysis_date, rank, ticker, round(cap_value, 4) AS cap, pe FROM stocks"),
    "sc04_analyses": (sc04, f"WITH {_ANALYSED} SELECT investor, ticker, signal, confidence, 'because of ' || ticker AS reasoning FROM an"),
    "sc05_literal": (sc05, f"WITH {EVALUATED}, l(investor, label) AS (VALUES ('buffett', 'Warren Buffett'), ('lynch', 'Peter Lynch'), ('fisher', 'Phil Fisher'), ('graham', NULL)) SELECT l.investor, label, count(score) AS n FROM l LEFT JOIN ev USING (investor) GROUP BY 1, 2"),
    "sc08_model_catalog": (sc08, "SELECT p_name AS display_name, 'm' || p_partkey AS model_name, p_brand AS provider FROM part UNION ALL SELECT 'GPT', 'gpt-4.1', 'OpenAI'"),
    "sc10_request_bodies": (sc10, "SELECT CASE WHEN o_orderstatus <> 'P' THEN 'T' || o_custkey END AS ticker, round(CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 = 0 THEN o_totalprice ELSE 100000 END, 2) AS initial_capital, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 2 = 0 THEN 'm' ELSE 'gpt-4.1' END AS model_name, 0.0::DOUBLE AS margin_requirement, CASE WHEN o_orderstatus = 'P' THEN '{oops' END AS corrupt FROM orders"),
    "sk03_json_file": (sk03, "SELECT c_custkey AS flow_id, c_name AS name, c_custkey % 10 = 0 AS is_template FROM customer"),
    "j07_left_analyses": (j07, f"{_FULL} SELECT * FROM fl"),
    "j07_votes": (j07_votes, f"{_FULL} SELECT run_id, ticker, count(*) FILTER (signal = 'bullish') AS bullish_count, count(*) FILTER (signal = 'bearish') AS bearish_count, round_even(sum(confidence) / 3, 0) AS combined_confidence, count(*) FILTER (signal = 'bullish') >= 2 AS included FROM fl GROUP BY 1, 2"),
    "x18_paragraphs": (
        x18,
        """WITH RECURSIVE li AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM conversations WHERE text IS NOT NULL),
 se AS (SELECT *, regexp_extract_all(line, '[^.!?]+(?:\\.\\d+[^.!?]*|[.!?]+\\s*)') AS f FROM li WHERE regexp_matches(line, '\\S')),
 s AS (SELECT conv_id, turn, ln, unnest(CASE WHEN len(f) = 0 THEN [line] ELSE f END) AS t, generate_subscripts(CASE WHEN len(f) = 0 THEN [line] ELSE f END, 1) AS i FROM se),
 r AS (SELECT conv_id, turn, ln, i, t, 1 AS n, 1 AS chunk FROM s WHERE i = 1 UNION ALL
  SELECT s.conv_id, s.turn, s.ln, s.i, s.t, CASE WHEN r.n = 3 OR r.n = 2 AND r.t LIKE '%. ' AND NOT regexp_matches(r.t, '\\d\\.\\s*$') THEN 1 ELSE r.n + 1 END, CASE WHEN r.n = 3 OR r.n = 2 AND r.t LIKE '%. ' AND NOT regexp_matches(r.t, '\\d\\.\\s*$') THEN r.chunk + 1 ELSE r.chunk END
  FROM r JOIN s ON s.conv_id = r.conv_id AND s.turn = r.turn AND s.ln = r.ln AND s.i = r.i + 1),
 p AS (SELECT conv_id, turn, ln, chunk, regexp_replace(string_agg(t, '' ORDER BY i), '^\\s+|\\s+$', '', 'g') AS paragraph FROM r GROUP BY ALL)
 SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY ln, chunk) - 1 AS INTEGER) AS place, paragraph FROM p WHERE paragraph <> ''""",
    ),
    "x22_signal_colours": (x22_signals, "WITH s AS (SELECT CAST(user_id % 7 AS INT) AS agent, CASE WHEN event_type IN ('purchase', 'signup') THEN 'Bullish' WHEN event_type = 'error' THEN 'bearish' WHEN event_type = 'view' THEN 'neutral' ELSE 'unsure' END AS signal FROM events) SELECT agent, signal, CASE upper(signal) WHEN 'BULLISH' THEN 'green' WHEN 'BEARISH' THEN 'red' WHEN 'NEUTRAL' THEN 'primary' ELSE 'muted' END AS colour, count(*) AS n FROM s GROUP BY 1, 2, 3"),
    "x22_action_colours": (x22_actions, "WITH a AS (SELECT CASE WHEN CAST(json_extract_string(props, '$.k') AS DOUBLE) > 90 THEN 'WAIT' ELSE CASE event_type WHEN 'purchase' THEN 'BUY' WHEN 'error' THEN 'SELL' WHEN 'signup' THEN 'SHORT' WHEN 'click' THEN 'COVER' ELSE 'HOLD' END END AS action FROM events) SELECT action, CASE WHEN action IN ('BUY', 'COVER') THEN 'green' WHEN action IN ('SELL', 'SHORT') THEN 'red' WHEN action = 'HOLD' THEN 'primary' ELSE 'muted' END AS colour, count(*) AS n FROM a GROUP BY 1, 2"),
    "sk01_workbook": (
        sk01,
        f"""WITH {CONSENSUS}, held AS (SELECT DISTINCT run_id FROM con WHERE included), n AS (SELECT count(*) AS n FROM held), every AS (SELECT count(DISTINCT run_id) AS n, CAST(count(*) AS DOUBLE) AS tickers FROM stocks)
 SELECT 'portfolio' AS sheet, n AS runs, 100.0::DOUBLE AS figure FROM n UNION ALL SELECT 'ranking', n, tickers FROM every UNION ALL SELECT 'matrix', n, tickers FROM every UNION ALL SELECT 'detail', n, (SELECT round(sum(confidence), 0) FROM ev) FROM every
 UNION ALL SELECT 'summary', n, (SELECT CAST(count(*) AS DOUBLE) FROM stocks WHERE run_id IN (FROM held)) FROM n UNION ALL SELECT 'risk', n, 10.0 FROM n""",
    ),
}
