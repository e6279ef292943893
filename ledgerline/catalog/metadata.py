"""Flows, runs, keys, text fields and agent graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import graph as G
from ..operators import metadata as M
from ..operators import reshape, windows
from ..sources import fixtures as fx

FLOWS = """flows AS (SELECT c_custkey AS flow_id, c_name AS name, c_mktsegment AS description, c_custkey % 10 = 0 AS is_template, lower(c_mktsegment) AS tag, DATE '2024-01-01' + CAST(c_custkey % 300 AS INT) AS created_at, CASE WHEN c_custkey % 3 <> 0 THEN DATE '2024-01-01' + CAST(c_custkey % 365 AS INT) END AS updated_at FROM customer)"""
RUNS = """runs AS (SELECT o_orderkey AS run_id, o_custkey AS flow_id, CASE o_orderstatus WHEN 'F' THEN 'COMPLETE' WHEN 'O' THEN 'IN_PROGRESS' WHEN 'P' THEN 'IDLE' END AS status, CAST(o_orderdate AS DATE) AS created_at, o_totalprice AS cost FROM orders)"""
NODES = """nodes AS (SELECT 'r_' || r_regionkey AS id, 'region' AS type FROM region UNION ALL SELECT 'n_' || n_nationkey, 'nation' FROM nation UNION ALL SELECT 's_' || s_suppkey, 'supplier' FROM supplier),
 edges AS (SELECT 'r_' || n_regionkey AS source, 'n_' || n_nationkey AS target FROM nation UNION ALL SELECT 'n_' || s_nationkey, 's_' || s_suppkey FROM supplier)"""
AGENTS = "agents AS (SELECT c_custkey AS pos, CASE c_mktsegment WHEN 'BUILDING' THEN 'warren_buffett' WHEN 'MACHINERY' THEN 'peter_lynch' WHEN 'FURNITURE' THEN 'ben_graham' ELSE 'cathie_wood' END AS base, c_custkey FROM customer), named AS (SELECT pos, base, base || '_' || substr(CAST(100000 + c_custkey % 900000 AS VARCHAR), 1, 6) AS id FROM agents)"


def _agents(spark, d) -> DataFrame:
    seg = F.col("c_mktsegment")
    base = F.when(seg == "BUILDING", "warren_buffett").when(seg == "MACHINERY", "peter_lynch").when(seg == "FURNITURE", "ben_graham").otherwise("cathie_wood")
    c = fx.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pos"), base.alias("base"), F.concat(base, F.lit("_"), F.substring((100000 + F.col("c_custkey") % 900000).cast("string"), 1, 6)).alias("id"))


def f01(spark, d):
    return fx.runs(spark, d).filter("flow_id = 7").select("run_id", "status")


def f02(spark, d):
    return fx.runs(spark, d).filter("flow_id = 7 and status = 'IN_PROGRESS'").select("run_id", "flow_id")


def f03(spark, d):
    return M.listed(fx.flows(spark, d), include_templates=False).select("flow_id", "name")


def f04(spark, d):
    return M.by_name(fx.flows(spark, d), "R#0000000_7").select("flow_id", "name")


def f05(spark, d):
    return M.search(fx.flows(spark, d), "MACHIN").select("flow_id")


def f12(spark, d):
    return fx.flows(spark, d).select(F.concat(F.lit("flow:"), F.lower("description"), F.lit(":"), F.col("flow_id").cast("string")).alias("key")).filter(F.col("key").startswith("flow:build"))


def f13(spark, d):
    return fx.runs(spark, d).filter(F.col("status").isin("IDLE", "IN_PROGRESS")).groupBy("status").agg(F.count("*").alias("n"))


def f14(spark, d):
    return fx.flows(spark, d).select("flow_id", F.array_join(F.slice(F.filter("tags", lambda t: t != "default"), 1, 2), ",").alias("tags"))


def f15(spark, d):
    text = F.when(F.col("p_size") % 5 == 0, F.lit("  ")).when(F.col("p_size") % 5 == 1, F.lit("abc")).otherwise(F.concat(F.lit(" "), F.col("p_size").cast("string")))
    return fx.table(spark, d, "part").select("p_partkey", text.alias("t")).filter(F.trim("t") != "").select("p_partkey", F.coalesce(F.trim("t").try_cast("double"), F.lit(0.0)).alias("quantity"))


def p03(spark, d):
    return fx.flows(spark, d).select("flow_id", "name", "is_template", "created_at", "updated_at")


def l01(spark, d):
    return M.listed(fx.flows(spark, d)).select("flow_id", "updated_at")


def l02(spark, d):
    return M.page(fx.runs(spark, d), limit=20, offset=40).select("run_id", "created_at")


def l03(spark, d):
    return M.latest(fx.runs(spark, d)).select("flow_id", "run_id", "created_at")


def l08(spark, d):
    rank = F.when(F.contains("id", F.lit("buffett")), 1).otherwise(0)
    return _agents(spark, d).withColumn("place", F.row_number().over(Window.partitionBy((F.col("pos") % 100).alias("g")).orderBy(rank, "pos", "id"))).select("id", "place")


def l10(spark, d):
    f = fx.flows(spark, d)
    w = Window.partitionBy("description").orderBy(F.desc(M.touched()), "flow_id")
    return f.filter("not is_template").withColumn("k", F.row_number().over(w)).filter("k <= 10").select("description", "k", "flow_id")


def a11(spark, d):
    r = fx.runs(spark, d)
    numbered = r.withColumn("run_number", F.row_number().over(Window.partitionBy("flow_id").orderBy("created_at", "run_id")))
    return M.next_run_numbers(numbered, fx.flows(spark, d))


def a12(spark, d):
    return fx.runs(spark, d).groupBy("flow_id").agg(F.count("*").alias("n_runs"))


def a30(spark, d):
    """The first five models of each provider; only they are put in a list."""
    first = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    models = fx.table(spark, d, "part").select("p_brand", "p_partkey", "p_name", first.alias("k")).filter("k <= 5").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("m"))
    return models.select(F.col("p_brand").alias("provider"), F.array_join(F.transform("m", lambda m: m["p_name"]), "|").alias("models"))


def a36(spark, d):
    r = fx.runs(spark, d)
    return r.groupBy((F.col("flow_id") % 10).alias("part")).agg(F.count_if(F.col("flow_id") % 100 == 7).alias("deleted"), F.count_if(F.col("flow_id") % 100 != 7).alias("left"))


def a37(spark, d):
    return fx.flows(spark, d).groupBy("description").agg(F.min_by("flow_id", F.struct((-F.unix_date(M.touched())).alias("t"), "flow_id")).alias("flow_id"))


def a38(spark, d):
    return fx.runs(spark, d).groupBy("flow_id").agg(F.bool_or(F.col("status") == "IN_PROGRESS").alias("any_running"), F.bool_and(F.col("cost") > 1000).alias("all_costly"))


def a39(spark, d):
    return windows.numbered_names(_agents(spark, d), "base", "pos", "base").select("id", "display")


def a40(spark, d):
    x, y = F.col("s_acctbal"), F.col("s_suppkey").cast("double")
    mid = lambda c: F.round((F.min(c) + F.max(c)) / 2, 4)
    return fx.table(spark, d, "supplier").groupBy("s_nationkey").agg(mid(x).alias("x"), mid(y).alias("y"))


def o12(spark, d):
    r = fx.runs(spark, d).select("run_id", F.lit("IDLE").alias("status"), F.when(F.col("status") == "COMPLETE", F.col("created_at")).alias("started_at"), F.lit(None).cast("date").alias("completed_at"))
    changes = fx.runs(spark, d).select("run_id", "status", F.date_add("created_at", 1).alias("at"))
    return M.with_status(r, changes)


def o13(spark, d):
    keys = fx.table(spark, d, "part").groupBy(F.col("p_brand").alias("provider")).agg(F.min("p_name").alias("key_value"), F.lit("old").alias("note"))
    new = fx.table(spark, d, "part").filter("p_size > 25").select(F.when(F.col("p_partkey") % 9 == 0, F.concat("p_brand", F.lit("x"))).otherwise(F.col("p_brand")).alias("provider"), F.col("p_name").alias("key_value"), F.lit(None).cast("string").alias("note"), "p_partkey")
    return M.upserted(keys, new, "provider", "p_partkey")


def o14(spark, d):
    f = fx.flows(spark, d)
    new = f.filter("flow_id % 4 = 0").select("flow_id", F.upper("name").alias("name"), F.lit(None).cast("string").alias("description"), F.col("flow_id").alias("v"))
    return M.upserted(f.select("flow_id", "name", "description"), new, "flow_id", "v")


def o15(spark, d):
    return M.duplicated(fx.flows(spark, d).select("flow_id", "name", "is_template"), 7, 10**9)


def j18(spark, d):
    agents = _agents(spark, d)
    configs = agents.filter("pos % 40 = 0").select("pos", F.when(F.col("pos") % 80 == 0, F.col("base")).otherwise(F.col("id")).alias("agent"), F.concat(F.lit("m"), F.col("pos").cast("string")).alias("model")).filter("agent <> 'cathie_wood'")
    return M.model_config(agents, configs, "gpt")


def j19(spark, d):
    r = fx.runs(spark, d)
    return r.join(fx.flows(spark, d).filter("is_template").select("flow_id"), "flow_id", "left_semi").select("run_id", "flow_id")


def j20(spark, d):
    nodes = _agents(spark, d).filter("pos % 3 = 0").select("id", "pos")
    return G.first_match(_agents(spark, d).select(F.when(F.col("pos") % 2 == 0, F.col("base")).otherwise(F.col("id")).alias("agent")).distinct(), nodes)


def x10(spark, d):
    return _agents(spark, d).select("id", X.base_agent_key("id").alias("base_key"), X.risk_manager_id("id").alias("risk_manager"))


def x14(spark, d):
    text = F.concat_ws(" , ", F.col("p_brand"), F.col("p_type"), F.lit(""))
    return fx.table(spark, d, "part").select("p_partkey", F.array_join(X.ticker_list(text), "|").alias("tickers"))


def x15(spark, d):
    text = F.when(F.col("c_custkey") % 3 == 0, "n/a").otherwise(F.concat(F.lit("$ "), F.format_number("c_acctbal", 2)))
    return fx.table(spark, d, "customer").select("c_custkey", X.currency(text).alias("amount"))


def x20(spark, d):
    good = F.concat(F.lit('{"AAPL": {"action": "buy", "quantity": '), F.col("event_id").cast("string"), F.lit("}}"))
    text = F.when(F.col("event_id") % 4 == 0, "not json").otherwise(good)
    m = X.parse_decisions(text)
    return fx.table(spark, d, "events").select("event_id", F.size(m).alias("n"), F.coalesce(F.try_element_at(m, F.lit("AAPL"))["quantity"], F.lit(0.0)).alias("quantity"))


def x17(spark, d):
    return fx.table(spark, d, "events").groupBy(X.is_json(F.when(F.col("event_id") % 5 == 0, F.lit('{"a": NaN}')).when(F.col("event_id") % 5 == 1, F.lit("{oops")).otherwise(F.col("props"))).alias("is_json")).agg(F.count("*").alias("n"))


def x23(spark, d):
    day = F.to_date("o_orderdate")
    return fx.table(spark, d, "orders").select("o_orderkey", F.date_sub(day, 30).alias("d30"), F.add_months(day, -12).alias("y1"), F.add_months(day, -3).alias("m3"))


def g01(spark, d):
    _, edges = fx.graph(spark, d)
    return G.reachable(edges, spark.createDataFrame([("r_1",)], "id string"))


def g02(spark, d):
    _, edges = fx.graph(spark, d)
    return G.induced(edges, G.reachable(edges, spark.createDataFrame([("r_1",)], "id string")).select("id"))


def g03(spark, d):
    _, edges = fx.graph(spark, d)
    return G.on_paths(edges, spark.createDataFrame([("r_1",)], "id string"), spark.createDataFrame([("s_5",), ("s_9",)], "id string"))


def g03_cyclic(spark, d):
    """The nations of a region as a ring, with some shortcuts back; from regions to the suppliers that are in debt."""
    n, sup = fx.table(spark, d, "nation"), fx.table(spark, d, "supplier")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    ring = n.select("n_regionkey", "n_nationkey", F.coalesce(F.lead("n_nationkey").over(w), F.first("n_nationkey").over(w)).alias("next"), F.lag("n_nationkey", 2).over(w).alias("back"), F.row_number().over(w).alias("k"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = ring.select(name("n_", "n_nationkey").alias("source"), name("n_", "next").alias("target")).unionByName(ring.filter("back is not null").select(name("n_", "n_nationkey").alias("source"), name("n_", "back").alias("target")))
    edges = edges.unionByName(ring.filter("k = 1").select(name("r_", "n_regionkey").alias("source"), name("n_", "n_nationkey").alias("target"))).unionByName(sup.select(name("n_", "s_nationkey").alias("source"), name("s_", "s_suppkey").alias("target")))
    start = fx.table(spark, d, "region").select(name("r_", "r_regionkey").alias("id"))
    return G.on_paths(edges, start, sup.filter("s_acctbal < 0").select(name("s_", "s_suppkey").alias("id")))


def g05(spark, d):
    nodes, edges = fx.graph(spark, d)
    managers = nodes.filter("type = 'nation'").select("id")
    return G.through_risk_managers(G.numbered_edges(edges), managers)


def g06(spark, d):
    nodes, edges = fx.graph(spark, d)
    return G.with_start_and_end(nodes, edges, nodes.filter("type = 'supplier'").select("id"))


def g07(spark, d):
    nodes, edges = fx.graph(spark, d)
    return G.sources_of(edges, nodes, "region")


def g08(spark, d):
    nodes, edges = fx.graph(spark, d)
    return G.levels(edges, nodes.filter("type = 'region'").select("id"))


def u10(spark, d):
    e = fx.table(spark, d, "events").groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct(F.col("event_type"), F.lit(1))))).alias("a"))
    both = e.select("user_id", reshape.right_wins(F.col("a"), F.create_map(F.lit("view"), F.lit(2), F.lit("extra"), F.lit(3))).alias("m"))
    return both.select("user_id", F.size("m").alias("n"), F.try_element_at("m", F.lit("view")).alias("view"))


_REACH = f"{NODES}, RECURSIVE_ reach AS (SELECT 'r_1' AS id, 0 AS depth UNION SELECT e.target, r.depth + 1 FROM reach r JOIN edges e ON e.source = r.id)"
_R = "WITH RECURSIVE " + _REACH.replace("RECURSIVE_ ", "")
QUERIES = {
    "f01_equality": (f01, f"WITH {RUNS} SELECT run_id, status FROM runs WHERE flow_id = 7"),
    "f02_conjunction": (f02, f"WITH {RUNS} SELECT run_id, flow_id FROM runs WHERE flow_id = 7 AND status = 'IN_PROGRESS'"),
    "f03_without_templates": (f03, f"WITH {FLOWS} SELECT flow_id, name FROM flows WHERE NOT is_template"),
    "f04_ilike": (f04, f"WITH {FLOWS} SELECT flow_id, name FROM flows WHERE name ILIKE '%R#0000000_7%'"),
    "f05_search": (f05, f"WITH {FLOWS} SELECT flow_id FROM flows WHERE lower(name) LIKE '%machin%' OR lower(description) LIKE '%machin%' OR tag LIKE '%machin%'"),
    "f12_key_prefix": (f12, f"WITH {FLOWS} SELECT 'flow:' || lower(description) || ':' || flow_id AS key FROM flows WHERE lower(description) LIKE 'build%'"),
    "f13_status_set": (f13, f"WITH {RUNS} SELECT status, count(*) AS n FROM runs WHERE status IN ('IDLE', 'IN_PROGRESS') GROUP BY 1"),
    "f14_tags": (f14, f"WITH {FLOWS} SELECT flow_id, tag AS tags FROM flows"),
    "f15_parse_positions": (f15, "SELECT p_partkey, CASE WHEN p_size % 5 = 1 THEN 0.0 ELSE CAST(p_size AS DOUBLE) END AS quantity FROM part WHERE p_size % 5 <> 0"),
    "p03_summary": (p03, f"WITH {FLOWS} SELECT flow_id, name, is_template, created_at, updated_at FROM flows"),
    "l01_recent_flows": (l01, f"WITH {FLOWS} SELECT flow_id, updated_at FROM flows ORDER BY updated_at DESC NULLS LAST, flow_id"),
    "l02_run_page": (l02, f"WITH {RUNS} SELECT run_id, created_at FROM runs ORDER BY created_at DESC, run_id LIMIT 20 OFFSET 40"),
    "l03_latest_run": (l03, f"WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY created_at DESC, run_id DESC) AS n FROM runs) SELECT flow_id, run_id, created_at FROM k WHERE n = 1"),
    "l08_agent_order": (l08, f"WITH {AGENTS} SELECT id, row_number() OVER (PARTITION BY pos % 100 ORDER BY CASE WHEN id LIKE '%buffett%' THEN 1 ELSE 0 END, pos, id) AS place FROM named"),
    "l10_recent_by_kind": (l10, f"WITH {FLOWS}, k AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY coalesce(updated_at, created_at) DESC, flow_id) AS k FROM flows WHERE NOT is_template) SELECT description, k, flow_id FROM k WHERE k <= 10"),
    "a11_next_run_number": (a11, f"WITH {FLOWS}, {RUNS}, c AS (SELECT flow_id, count(*) AS n FROM runs GROUP BY 1) SELECT flow_id, coalesce(n, 0) + 1 AS next_run_number FROM flows LEFT JOIN c USING (flow_id)"),
    "a12_run_count": (a12, f"WITH {RUNS} SELECT flow_id, count(*) AS n_runs FROM runs GROUP BY 1"),
    "a30_group_list": (a30, "WITH k AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i FROM part) SELECT p_brand AS provider, string_agg(p_name, '|' ORDER BY i) AS models FROM k WHERE i <= 5 GROUP BY 1"),
    "a36_delete_count": (a36, f"WITH {RUNS} SELECT flow_id % 10 AS part, count(*) FILTER (flow_id % 100 = 7) AS deleted, count(*) FILTER (flow_id % 100 <> 7) AS \"left\" FROM runs GROUP BY 1"),
    "a37_latest_flow": (a37, f"WITH {FLOWS}, k AS (SELECT *, row_number() OVER (PARTITION BY description ORDER BY coalesce(updated_at, created_at) DESC, flow_id) AS k FROM flows) SELECT description, flow_id FROM k WHERE k = 1"),
    "a38_any_all": (a38, f"WITH {RUNS} SELECT flow_id, bool_or(status = 'IN_PROGRESS') AS any_running, bool_and(cost > 1000) AS all_costly FROM runs GROUP BY 1"),
    "a39_display_names": (a39, f"WITH {AGENTS} SELECT id, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || ' #' || row_number() OVER (PARTITION BY base ORDER BY pos) ELSE base END AS display FROM named"),
    "a40_centre": (a40, "SELECT s_nationkey, round((min(s_acctbal) + max(s_acctbal)) / 2, 4) AS x, round((min(s_suppkey) + max(s_suppkey)) / 2.0::DOUBLE, 4) AS y FROM supplier GROUP BY 1"),
    "o12_status_times": (o12, f"WITH {RUNS} SELECT run_id, status, CASE WHEN status = 'COMPLETE' THEN created_at WHEN status = 'IN_PROGRESS' THEN created_at + 1 END AS started_at, CASE WHEN status = 'COMPLETE' THEN created_at + 1 END AS completed_at FROM runs"),
    "o13_upsert_keys": (o13, "WITH k AS (SELECT p_brand AS provider, min(p_name) AS v FROM part GROUP BY 1), n AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN p_brand || 'x' ELSE p_brand END AS provider, arg_max(p_name, p_partkey) AS v FROM part WHERE p_size > 25 GROUP BY 1) SELECT provider, coalesce(n.v, k.v) AS key_value, CASE WHEN k.v IS NOT NULL THEN 'old' END AS note FROM k FULL JOIN n USING (provider)"),
    "o14_partial_update": (o14, f"WITH {FLOWS} SELECT flow_id, CASE WHEN flow_id % 4 = 0 THEN upper(name) ELSE name END AS name, description FROM flows"),
    "o15_duplicate_flow": (o15, f"WITH {FLOWS} SELECT flow_id, name, is_template FROM flows UNION ALL SELECT 1000000000, name || ' (Copy)', false FROM flows WHERE flow_id = 7"),
    "j18_model_config": (j18, f"WITH {AGENTS}, cf AS (SELECT pos, CASE WHEN pos % 80 = 0 THEN base ELSE id END AS agent, 'm' || pos AS model FROM named WHERE pos % 40 = 0), c2 AS (SELECT * FROM cf WHERE agent <> 'cathie_wood'), m AS (SELECT n.id, arg_min(c.model, c.pos) AS model FROM named n JOIN c2 c ON c.agent = n.id OR c.agent = n.base GROUP BY 1) SELECT n.id, coalesce(m.model, 'gpt') AS model FROM named n LEFT JOIN m USING (id)"),
    "j19_run_of_flow": (j19, f"WITH {RUNS}, {FLOWS} SELECT run_id, flow_id FROM runs WHERE flow_id IN (SELECT flow_id FROM flows WHERE is_template)"),
    "j20_event_node": (j20, f"WITH {AGENTS}, f AS (SELECT regexp_replace(id, '_[a-z0-9]{{6}}$', '') AS k, arg_min(id, pos) AS node FROM named WHERE pos % 3 = 0 GROUP BY 1), a AS (SELECT DISTINCT CASE WHEN pos % 2 = 0 THEN base ELSE id END AS agent FROM named) SELECT agent, coalesce(node, agent) AS node FROM a LEFT JOIN f ON f.k = a.agent"),
    "x10_base_key": (x10, f"WITH {AGENTS} SELECT id, regexp_replace(id, '_[a-z0-9]{{6}}$', '') AS base_key, 'risk_management_agent_' || string_split(id, '_')[-1] AS risk_manager FROM named"),
    "x14_ticker_list": (x14, "SELECT p_partkey, trim(p_brand) || '|' || trim(p_type) AS tickers FROM part"),
    "x15_currency": (x15, "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 OR c_acctbal = 0 THEN 100000.0 ELSE abs(round(c_acctbal, 2)) END AS amount FROM customer"),
    "x17_is_json": (x17, "SELECT event_id % 5 <> 1 AS is_json, count(*) AS n FROM events GROUP BY 1"),
    "x20_parse_decisions": (x20, "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END AS n, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE CAST(event_id AS DOUBLE) END AS quantity FROM events"),
    "x23_dates": (x23, "SELECT o_orderkey, CAST(o_orderdate AS DATE) - 30 AS d30, CAST(CAST(o_orderdate AS DATE) - INTERVAL 12 MONTH AS DATE) AS y1, CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 MONTH AS DATE) AS m3 FROM orders"),
    "g01_reachable": (g01, f"{_R} SELECT id, min(depth) AS depth FROM reach GROUP BY 1"),
    "g02_subgraph": (g02, f"{_R} SELECT source, target FROM edges WHERE source IN (SELECT id FROM reach) AND target IN (SELECT id FROM reach)"),
    "g03_cyclic_paths": (g03_cyclic, """WITH RECURSIVE ring AS (SELECT n_regionkey AS r, n_nationkey AS n, coalesce(lead(n_nationkey) OVER w, first(n_nationkey) OVER w) AS next, lag(n_nationkey, 2) OVER w AS back, row_number() OVER w AS k FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
 edges AS (SELECT DISTINCT * FROM (SELECT 'n_' || n AS source, 'n_' || next AS target FROM ring UNION ALL SELECT 'n_' || n, 'n_' || back FROM ring WHERE back IS NOT NULL UNION ALL SELECT 'r_' || r, 'n_' || n FROM ring WHERE k = 1 UNION ALL SELECT 'n_' || s_nationkey, 's_' || s_suppkey FROM supplier WHERE s_acctbal < 0) WHERE source <> target),
 paths AS (SELECT 'r_' || r_regionkey AS id, ['r_' || r_regionkey] AS path FROM region UNION ALL SELECT target, list_append(path, target) FROM paths JOIN edges ON source = id WHERE NOT list_contains(path, target))
 SELECT DISTINCT unnest(path) AS id FROM paths WHERE id LIKE 's_%'"""),
    "g03_on_path": (g03, f"{_R}, back AS (SELECT id FROM (VALUES ('s_5'), ('s_9')) t(id) UNION SELECT e.source FROM back b JOIN edges e ON e.target = b.id) SELECT DISTINCT id FROM reach WHERE id IN (SELECT id FROM back)"),
    "g05_rewrite": (g05, f"WITH {NODES}, m AS (SELECT id FROM nodes WHERE type = 'nation'), l AS (SELECT source, arg_max(target, k) AS target FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM edges) WHERE target IN (SELECT id FROM m) GROUP BY 1) SELECT source, target FROM edges WHERE target NOT IN (SELECT id FROM m) UNION ALL SELECT source, 'risk_management_agent_' || string_split(target, '_')[-1] FROM l UNION ALL SELECT 'risk_management_agent_' || string_split(id, '_')[-1], id FROM m"),
    "g06_roots": (g06, f"WITH {NODES} SELECT source, target FROM edges UNION ALL SELECT 'start_node', id FROM nodes WHERE id NOT IN (SELECT target FROM edges) UNION ALL SELECT id, 'END' FROM nodes WHERE type = 'supplier'"),
    "g07_in_neighbours": (g07, f"WITH {NODES} SELECT target, source AS id FROM edges WHERE source IN (SELECT id FROM nodes WHERE type = 'region')"),
    "g08_levels": (g08, f"WITH RECURSIVE {NODES}, lv AS (SELECT id, 0 AS level FROM nodes WHERE type = 'region' UNION SELECT e.target, l.level + 1 FROM lv l JOIN edges e ON e.source = l.id) SELECT id, max(level) AS level FROM lv GROUP BY 1"),
    "u10_map_merge": (u10, "SELECT user_id, count(DISTINCT event_type) FILTER (event_type <> 'view') + 2 AS n, 2 AS \"view\" FROM events GROUP BY 1"),
}
