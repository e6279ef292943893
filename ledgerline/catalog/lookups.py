"""Lookups, lists, nested groups, labels and texts, and agents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import graph as G
from ..operators import lookups as L
from ..plans import agents as A
from ..sources import files
from ..sources import fixtures as fx
from ..sources import vendor as V
from .metadata import AGENTS, _agents
from .performance import BARS, EVENTS


def _part(spark, d) -> DataFrame:
    return fx.table(spark, d, "part")


def sc02(spark, d):
    day = lambda x: F.lit(x).cast("date")
    return L.newest(fx.bars(spark, d), "ticker", "date", 10, day("1997-01-01"), day("1999-12-31"))


def j06(spark, d):
    view = fx.scores(spark, d).filter("investor = 'buffett'").select("ticker", "score")
    return L.all_matched(fx.stocks(spark, d).select("ticker", "rank"), view, "ticker").withColumn("score", F.round("score", 4))


def j08(spark, d):
    p = _part(spark, d)
    rows = p.select("p_partkey", F.when(F.col("p_size") % 7 == 0, 0.0).when(F.col("p_size") % 7 == 1, F.lit(None)).otherwise(F.col("p_retailprice")).alias("cap"))
    return L.filled(rows, p.filter("p_partkey % 2 = 0").select("p_partkey", F.col("p_size").cast("double").alias("cap")), "p_partkey", "cap")


def j11(spark, d):
    strong = fx.scores(spark, d).filter("investor = 'buffett' and score >= 7")
    names = _part(spark, d).select(F.concat(F.lit("T"), F.col("p_partkey").cast("string")).alias("ticker"), F.col("p_name").alias("name"))
    return fx.stocks(spark, d).join(strong, ["run_id", "ticker"], "left_semi").join(names, "ticker").select("run_id", "rank", "ticker", "name").orderBy("run_id", "rank")


def j14(spark, d):
    r, n = fx.table(spark, d, "region"), fx.table(spark, d, "nation")
    named = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("source"), F.col("n_name").alias("target"))
    named = named.unionByName(named.select("source", F.concat(F.lit("no "), "target").alias("target")))
    nodes = r.select(F.concat(F.lit("r"), "r_regionkey").alias("id"), F.col("r_name").alias("name")).unionByName(n.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.col("n_name").alias("name")))
    return L.resolved_edges(named, nodes)


def j15(spark, d):
    p = _part(spark, d)
    shown = p.filter("p_partkey % 3 = 0").select("p_partkey", F.concat(F.lit("Model "), "p_partkey").alias("shown"))
    return p.filter("p_size < 10").join(shown, "p_partkey", "left").select("p_partkey", F.coalesce("shown", "p_name").alias("display_name"))


def j16(spark, d):
    p = _part(spark, d)
    return L.without(p.select("p_partkey"), "p_partkey", p.filter("p_size < 30"), p.filter("p_partkey % 2 = 0"))


def j17(spark, d):
    p = _part(spark, d)
    return p.join(p.filter("p_size < 5").select("p_brand", "p_type").distinct(), ["p_brand", "p_type"], "left_semi").select("p_partkey", "p_brand")


def f11(spark, d):
    s = fx.signals(spark, d)
    connected = spark.createDataFrame([(1,), (3,), (5,)], "agent int")
    return s.join(connected, "agent", "left_semi").filter("agent <> 5").groupBy("agent").agg(F.count("*").alias("n"))


def f16(spark, d):
    return L.nonempty_groups(_part(spark, d), "p_brand", F.col("p_size") == 50)


def l04(spark, d):
    return _part(spark, d).groupBy(F.col("p_brand").alias("provider")).agg(F.count("*").alias("n")).orderBy("provider")


def l07(spark, d):
    sums = fx.stocks(spark, d).groupBy("run_id", "sector").agg(F.count("*").alias("n"))
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("n"), "sector")))


def l12(spark, d):
    """In the order of a collation that puts case behind letters."""
    named = _agents(spark, d).select("id").distinct().unionByName(_agents(spark, d).select(F.initcap("id").alias("id")).distinct())
    return named.orderBy(F.collate("id", "UNICODE"), "id")


def l12_groups(spark, d):
    """Names that a collation without case or accents takes as one."""
    p = _part(spark, d).select(F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.lower("p_type")).alias("name"))
    return p.groupBy(F.collate("name", "UNICODE_CI").alias("k")).agg(F.count("*").alias("n"), F.lower(F.min("name").cast("string")).alias("name")).select("name", "n")


def _vendor(spark, d, kind: str):
    """The vendor's files of a kind, written from the tables, in order of ticker and date."""
    e = fx.table(spark, d, "events")
    rows = {
        "prices": lambda: fx.bars(spark, d),
        "metrics": lambda: fx.bars(spark, d).select("ticker", "date", (F.col("close") / 7).alias("pe")),
        "insider_trades": lambda: fx.table(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("ticker"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
        "news": lambda: e.select(F.col("event_type").alias("ticker"), F.to_date("ts").alias("date"), "event_id"),
    }[kind]()
    path = files.shared_path(spark, kind)
    rows.repartitionByRange("ticker", "date").sortWithinPartitions("ticker", "date").write.parquet(path)
    return V.vendor(spark, path, rows.schema)


def sc02_prices(spark, d):
    return V.prices(_vendor(spark, d, "prices"), "1999-12-31", tickers=[1, 3, 8])


def sc02_metrics(spark, d):
    return V.newest_of(_vendor(spark, d, "metrics"), "metrics", "1999-12-31")


def sc02_trades(spark, d):
    return V.newest_of(_vendor(spark, d, "insider_trades"), "insider_trades", "1999-12-31", "1998-06-01")


def sc02_news(spark, d):
    return V.newest_of(_vendor(spark, d, "news"), "news", "2024-01-20", "2024-01-03").groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("oldest"), F.max("date").alias("latest"))


def uf01_opaque(spark, d):
    """An opaque agent on each of three levels; every one hears what all before have said."""
    state = fx.stocks(spark, d).select("ticker", "cap_value")
    first = A.opaque(lambda rows: pd.DataFrame({"ticker": rows["ticker"], "signal": ["bullish" if v > 200 else "bearish" for v in rows["cap_value"]], "confidence": 50.0}))
    return A.run_agents(state, [("first", 0), ("second", 1), ("third", 2)], {"first": first, "second": A.opaque(_client), "third": A.opaque(_client)})


def g08_flow(spark, d):
    """Balances of suppliers, added up by nations and then by regions, each with one of its own, by an opaque step."""
    nodes, edges = fx.graph(spark, d)
    upwards = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    leaves = nodes.join(edges.select(F.col("source").alias("id")).distinct(), "id", "left_anti").select("id")

    def add(rows):
        for r in rows:
            yield pd.DataFrame({"id": r["id"], "total": r["inbox"].fillna(0) + 1, "level": r["level"]})

    step = lambda ready, level: ready.select("id", "level", F.col("inbox").cast("double").alias("inbox")).mapInPandas(add, "id string, total double, level int")
    return A.dataflow(nodes, upwards, leaves, step, {"inbox": F.sum("total")}).withColumn("total", F.col("total").cast("long"))


def u04(spark, d):
    p = _part(spark, d)
    local = p.filter("p_size < 4").select(F.lit("Local").alias("provider"), F.col("p_name").alias("model"))
    return p.filter("p_size > 40").select(F.col("p_brand").alias("provider"), F.col("p_name").alias("model")).unionAll(local)


def u08(spark, d):
    """Models in lists of up to 100 of a provider, flattened again."""
    lists = L.nested(_part(spark, d).select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey", 100)
    return lists.select(F.col("p_brand").alias("provider"), F.inline("items"))


def u09(spark, d):
    days = fx.daily_prices(spark, d).groupBy("date").agg(F.collect_list(F.struct("ticker", "close")).alias("ticker_details"))
    return days.select("date", F.inline("ticker_details"))


def sk04(spark, d):
    f = fx.flows(spark, d).select("flow_id", "name")
    return L.inserted(f, f.filter("flow_id % 10 = 0").select("flow_id", F.concat(F.lit("new "), "name").alias("name")), "flow_id", "flow_id")


def t10(spark, d):
    e = fx.table(spark, d, "events").select((F.col("user_id") % 50).alias("model"), "ts", "event_id", F.col("event_type").alias("status"))
    return L.running(e, "model", ["ts", "event_id"], F.col("status") == "purchase").select("model", "event_id", "status")


def x06(spark, d):
    signal = F.when(F.col("p_size") < 20, "bearish").when(F.col("p_size") < 40, "neutral").when(F.col("p_size") < 48, "bullish").otherwise("other")
    return _part(spark, d).select("p_partkey", X.label(signal, X.SIGNAL_LABELS).alias("label"))


def x07(spark, d):
    x = F.when(F.col("p_size") % 9 != 0, F.col("p_size") * 0.25 - 6)
    return _part(spark, d).select("p_partkey", X.percent_text(x).alias("plain"), X.percent_text(x, signed=True).alias("signed"), X.number_text(x).alias("number"))


def x08(spark, d):
    return _part(spark, d).select("p_partkey", X.clean_warning(F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("⚠️  "), "p_name")).otherwise(F.col("p_name"))).alias("warning"))


def x09(spark, d):
    s = fx.scores(spark, d)
    return s.select("run_id", "ticker", "investor", X.reasoning("investor", X.investor_signal("score"), "score").alias("reasoning"))


def x11(spark, d):
    return _agents(spark, d).select("id", X.display_name("id").alias("name"))


def x12(spark, d):
    return _agents(spark, d).select("pos", X.new_id("base", "pos").alias("id"))


def x16(spark, d):
    return fx.table(spark, d, "customer").select("c_custkey", F.format_number("c_acctbal", 2).alias("amount"))


def x19(spark, d):
    return fx.table(spark, d, "events").select("event_id", X.clock_text("ts").alias("clock"))


def x21(spark, d):
    return _part(spark, d).select("p_partkey", X.confidence_badge(F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 4 - 50)).alias("badge"))


def x22(spark, d):
    return fx.runs(spark, d).select("run_id", X.label("status", X.STATUS_COLOURS).alias("colour"))


def x24(spark, d):
    return _part(spark, d).select("p_partkey", X.progress_percent(F.col("p_size"), F.col("p_partkey") % 4).alias("percent"))


def p04(spark, d):
    keys = _part(spark, d).groupBy("p_type", "p_brand").agg(F.min("p_name").alias("key"))
    found = keys.groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("p_brand", "key"))).alias("keys"))  # a key for each of 25 brands
    return found.select("p_type", F.size("keys").alias("n"), F.try_element_at("keys", F.lit("Brand#11")).alias("brand11"))


def g04(spark, d):
    return G.classified(_agents(spark, d).select("id"), spark.createDataFrame([("warren_buffett",), ("ben_graham",)], "base_key string")).select("id", "base_key")


def _client(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"ticker": rows["ticker"], "signal": ["bullish" if h > 0 else "neutral" for h in rows["heard"]], "confidence": rows["heard"] * 10.0})


def uf01(spark, d):
    state = fx.stocks(spark, d).select("ticker", "cap_value", "expected_return")
    rule = lambda test: lambda seen, name: seen.select(F.lit(name).alias("agent"), "ticker", F.when(test, "bullish").otherwise("bearish").alias("signal"), F.lit(50.0).alias("confidence"))
    registry = {"size": rule(F.col("cap_value") > 200), "growth": rule(F.coalesce(F.col("expected_return") > 0, F.lit(False))), "manager": A.opaque(_client)}
    return A.run_agents(state, [("size_aaaaa1", 0), ("growth_aaaaa2", 0), ("unknown_aaaaa3", 0), ("manager_aaaaa4", 1)], registry, key=lambda i: i.rsplit("_", 1)[0])


_NAMES = "CASE {0} WHEN 'warren_buffett' THEN 'Warren Buffett' WHEN 'peter_lynch' THEN 'Peter Lynch' WHEN 'ben_graham' THEN 'Ben Graham' ELSE 'Cathie Wood' END"
_QUARTERS = "CASE WHEN p_size % 9 <> 0 THEN p_size * 0.25::DOUBLE - 6 END"
_SCORES = "scores AS (SELECT CAST(p_partkey // 30 AS BIGINT) AS run_id, 'T' || p_partkey AS ticker, unnest(['buffett', 'lynch', 'fisher']) AS investor, unnest([p_size / 5.0::DOUBLE, ((p_partkey * 37) % 101) / 10.0::DOUBLE, CASE WHEN p_partkey % 17 <> 0 THEN ((p_partkey * 7) % 101) / 10.0::DOUBLE END]) AS score FROM part)"
_VOTES = "votes AS (SELECT 'T' || p_partkey AS ticker, p_retailprice * p_size / 200 > 200 AS size, coalesce(CASE WHEN p_partkey % 11 <> 0 THEN p_size - 10 END > 0, false) AS growth FROM part), heard AS (SELECT ticker, sum(CASE WHEN v THEN 1 ELSE -1 END) AS h FROM (SELECT ticker, size AS v FROM votes UNION ALL SELECT ticker, growth FROM votes) GROUP BY 1)"
QUERIES = {
    "sc02_prefetch": (sc02, f"WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31') SELECT ticker, date, close FROM k WHERE k <= 10"),
    "j06_must_exist": (j06, "SELECT 'T' || p_partkey AS ticker, CAST(p_partkey % 30 + 1 AS INT) AS rank, round(p_size / 5.0::DOUBLE, 4) AS score FROM part"),
    "j08_cap_lookup": (j08, "SELECT p_partkey, coalesce(CASE WHEN p_size % 7 > 1 THEN p_retailprice END, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END) AS cap FROM part"),
    "j11_ordered_semi": (j11, "SELECT CAST(p_partkey // 30 AS BIGINT) AS run_id, CAST(p_partkey % 30 + 1 AS INT) AS rank, 'T' || p_partkey AS ticker, p_name AS name FROM part WHERE p_size / 5.0::DOUBLE >= 7"),
    "j14_template_edges": (j14, "SELECT 'r' || n_regionkey AS source, 'n' || n_nationkey AS target FROM nation"),
    "j15_installed_names": (j15, "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Model ' || p_partkey ELSE p_name END AS display_name FROM part WHERE p_size < 10"),
    "j16_not_installed": (j16, "SELECT p_partkey FROM part WHERE p_size >= 30 AND p_partkey % 2 <> 0"),
    "j17_downloaded": (j17, "SELECT p_partkey, p_brand FROM part WHERE (p_brand, p_type) IN (SELECT (p_brand, p_type) FROM part WHERE p_size < 5)"),
    "f11_membership": (f11, "SELECT CAST(user_id % 7 AS INT) AS agent, count(*) AS n FROM events WHERE user_id % 7 IN (1, 3) GROUP BY 1"),
    "f16_nonempty_groups": (f16, "SELECT p_brand, CAST(count(*) AS INT) AS n FROM part WHERE p_size = 50 GROUP BY 1"),
    "l04_by_provider": (l04, "SELECT p_brand AS provider, count(*) AS n FROM part GROUP BY 1 ORDER BY 1"),
    "l07_sector_totals": (l07, "WITH s AS (SELECT CAST(p_partkey // 30 AS BIGINT) AS run_id, p_type AS sector, count(*) AS n FROM part GROUP BY 1, 2) SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY n DESC, sector) AS INT) AS place FROM s"),
    "l12_by_name": (l12, f"WITH {AGENTS} SELECT DISTINCT id FROM named UNION ALL SELECT DISTINCT upper(id[1]) || lower(id[2:]) FROM named"),
    "l12_same_names": (l12_groups, "SELECT lower(p_type) AS name, count(*) AS n FROM part GROUP BY 1"),
    "sc02_prices": (sc02_prices, f"WITH {BARS} SELECT ticker, date, close FROM bars WHERE ticker IN (1, 3, 8) AND date BETWEEN DATE '1998-12-31' AND DATE '1999-12-31'"),
    "sc02_metrics": (sc02_metrics, f"WITH {BARS}, k AS (SELECT ticker, date, close / 7 AS pe, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS k FROM bars WHERE date <= DATE '1999-12-31') SELECT ticker, date, pe FROM k WHERE k <= 10"),
    "sc02_insider_trades": (sc02_trades, "WITH k AS (SELECT l_returnflag || l_linestatus AS ticker, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS k FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1998-06-01' AND DATE '1999-12-31') SELECT * EXCLUDE (k) FROM k WHERE k <= 1000"),
    "sc02_news": (sc02_news, "WITH k AS (SELECT event_type AS ticker, CAST(ts AS DATE) AS date, row_number() OVER (PARTITION BY event_type ORDER BY CAST(ts AS DATE) DESC, event_id) AS k FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-20') SELECT ticker, count(*) AS n, min(date) AS oldest, max(date) AS latest FROM k WHERE k <= 1000 GROUP BY 1"),
    "uf01_opaque_levels": (uf01_opaque, "WITH v AS (SELECT 'T' || p_partkey AS ticker, CASE WHEN p_retailprice * p_size / 200 > 200 THEN 1 ELSE -1 END AS h FROM part) SELECT 'first' AS agent, ticker, CASE WHEN h > 0 THEN 'bullish' ELSE 'bearish' END AS signal, 50.0::DOUBLE AS confidence FROM v UNION ALL SELECT 'second', ticker, CASE WHEN h > 0 THEN 'bullish' ELSE 'neutral' END, h * 10.0 FROM v UNION ALL SELECT 'third', ticker, CASE WHEN h > 0 THEN 'bullish' ELSE 'neutral' END, CASE WHEN h > 0 THEN 20.0 ELSE -10.0 END FROM v"),
    "g08_dataflow": (g08_flow, "WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), n AS (SELECT n_nationkey, n_regionkey, count(s_suppkey) + 1 AS total, CASE WHEN count(s_suppkey) > 0 THEN 1 ELSE 0 END AS level FROM nation LEFT JOIN s ON n_nationkey = s_nationkey GROUP BY 1, 2) SELECT 's_' || s_suppkey AS id, 1 AS total, 0 AS level FROM s UNION ALL SELECT 'n_' || n_nationkey, total, level FROM n UNION ALL SELECT 'r_' || r_regionkey, CAST(coalesce(sum(total), 0) + 1 AS BIGINT), coalesce(max(level) + 1, 0) FROM region LEFT JOIN n ON r_regionkey = n_regionkey GROUP BY 1"),
    "u04_cloud_and_local": (u04, "SELECT p_brand AS provider, p_name AS model FROM part WHERE p_size > 40 UNION ALL SELECT 'Local', p_name FROM part WHERE p_size < 4"),
    "u08_flat_models": (u08, "SELECT p_brand AS provider, p_partkey, p_name FROM part"),
    "u09_flat_details": (u09, f"WITH {EVENTS} SELECT date, ticker, arg_max(value, (ts, event_id)) AS close FROM ev WHERE value > 0 GROUP BY 1, 2"),
    "sk04_insert": (sk04, "SELECT c_custkey AS flow_id, c_name AS name FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_custkey), 'new ' || c_name FROM customer WHERE c_custkey % 10 = 0"),
    "t10_running_downloads": (t10, "WITH l AS (SELECT user_id % 50 AS model, arg_max({'event_id': event_id, 's': event_type}, (ts, event_id)) AS x FROM events GROUP BY 1) SELECT model, x.event_id AS event_id, x.s AS status FROM l WHERE x.s <> 'purchase'"),
    "x06_labels": (x06, "SELECT p_partkey, CASE WHEN p_size < 20 THEN '매도' WHEN p_size < 40 THEN '중립' WHEN p_size < 48 THEN '매수' ELSE 'other' END AS label FROM part"),
    "x07_number_text": (x07, f"WITH q AS (SELECT p_partkey, {_QUARTERS} AS x FROM part) SELECT p_partkey, coalesce(printf('%.1f%%', x), 'N/A') AS plain, coalesce(printf('%+.1f%%', x), 'N/A') AS signed, coalesce(printf('%.1f', x), 'N/A') AS number FROM q"),
    "x08_clean_warning": (x08, "SELECT p_partkey, p_name AS warning FROM part"),
    "x09_reasoning": (x09, f"WITH {_SCORES} SELECT run_id, ticker, investor, investor || ': ' || CASE WHEN coalesce(score, 0) >= 7 THEN 'convincing' WHEN coalesce(score, 0) <= 3 THEN 'not convincing' ELSE 'mixed' END || ' at ' || printf('%.1f', round_even(coalesce(score, 0), 1)) || ' of 10' AS reasoning FROM scores"),
    "x11_display_name": (x11, f"WITH {AGENTS} SELECT id, {_NAMES.format('base')} AS name FROM named"),
    "x12_new_id": (x12, f"WITH {AGENTS} SELECT pos, base || '_' || substr(sha256(base || ':' || pos), 1, 6) AS id FROM named"),
    "x16_grouped_number": (x16, "SELECT c_custkey, format('{:,.2f}', c_acctbal) AS amount FROM customer"),
    "x19_clock": (x19, "SELECT event_id, strftime(ts, '%-I:%M:%S %p') AS clock FROM events"),
    "x21_badge": (x21, "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'outline' WHEN p_size * 4 - 50 >= 50 THEN 'success' WHEN p_size * 4 - 50 >= 0 THEN 'warning' ELSE 'outline' END AS badge FROM part"),
    "x22_colours": (x22, "SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'green' WHEN 'O' THEN 'amber' ELSE 'gray' END AS colour FROM orders"),
    "x24_percent": (x24, "SELECT p_partkey, coalesce(p_size * 100.0::DOUBLE / nullif(p_partkey % 4, 0), 0) AS percent FROM part"),
    "p04_key_map": (p04, "SELECT p_type, CAST(count(DISTINCT p_brand) AS INT) AS n, min(p_name) FILTER (p_brand = 'Brand#11') AS brand11 FROM part GROUP BY 1"),
    "g04_known_nodes": (g04, f"WITH {AGENTS} SELECT id, base AS base_key FROM named WHERE base IN ('warren_buffett', 'ben_graham')"),
    "uf01_agents": (uf01, f"WITH {_VOTES} SELECT 'size_aaaaa1' AS agent, ticker, CASE WHEN size THEN 'bullish' ELSE 'bearish' END AS signal, 50.0::DOUBLE AS confidence FROM votes UNION ALL SELECT 'growth_aaaaa2', ticker, CASE WHEN growth THEN 'bullish' ELSE 'bearish' END, 50.0 FROM votes UNION ALL SELECT 'manager_aaaaa4', ticker, CASE WHEN h > 0 THEN 'bullish' ELSE 'neutral' END, h * 10.0 FROM heard"),
}
