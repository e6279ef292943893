import itertools
import json
import os
import random
import uuid
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pyspark.sql.datasource as DS
import pytest
from ledgerline.functions import scalars as X
from ledgerline.operators import graph as G
from ledgerline.operators import lookups as L
from ledgerline.operators import metadata as M
from ledgerline.operators import selection as S
from ledgerline.operators.numbering import numbered
from ledgerline.plans import agents as A
from ledgerline.plans import reports
from ledgerline.sources import files
from ledgerline.sources import fixtures as fx
from ledgerline.sources import vendor as V
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def loop_waterfall(bases, groups):
    """The rounds themselves: cap all that are over, share out the rest."""
    weights, active, left = [0.0] * len(bases), list(range(len(bases))), 100.0
    while active and (total := sum(bases[i] for i in active)) > 0:
        over = [i for i in active if bases[i] / total * left > 15]
        if not over:
            for i in active:
                weights[i] = bases[i] / total * left
            break
        for i in over:
            weights[i] = 15.0
        left -= 15.0 * len(over)
        active = [i for i in active if i not in over]
    weights = [0.0 if w < 2 else w for w in weights]
    sums = {g: sum(w for w, h in zip(weights, groups, strict=True) if h == g) for g in groups}
    return [w * 35 / sums[g] if sums[g] > 35 else w for w, g in zip(weights, groups, strict=True)]


def test_waterfall_equals_the_rounds(spark):
    r = np.random.default_rng(6)
    rows, want = [], {}
    for run in range(60):
        n = int(r.integers(1, 26))
        conf, groups = np.round(r.choice([40.0, 60.0, 90.0, 400.0], n) + r.integers(0, 3, n)), [f"g{x}" for x in r.integers(0, 4, n)]
        rows += [(run, k, float(c), 0.0, g) for k, (c, g) in enumerate(zip(conf, groups, strict=True))]
        want |= {(run, k): w for k, w in enumerate(loop_waterfall(conf.tolist(), groups))}
    df = spark.createDataFrame(rows, "run_id long, rank int, combined_confidence double, expected_return double, sector string")
    got = {(x.run_id, x["rank"]): x.weight for x in S.waterfall(df).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_caps_converge():
    r = np.random.default_rng(7)
    for _ in range(200):
        n = int(r.integers(8, 20))
        w = r.uniform(1, 10, n)
        out = S.capped_weights(w / w.sum() * 100, r.integers(0, 5, n).astype(str))
        assert out.max() <= 15.02 and out.sum() <= 100.01
    assert S.capped_weights(np.array([50.0, 50.0]), np.array(["a", "b"])).tolist() == [15.0, 15.0]


def test_scalars(spark):
    row = spark.range(1).select(
        X.base_agent_key(F.lit("ben_graham")).alias("a"), X.base_agent_key(F.lit("warren_buffett_abc123")).alias("b"), X.investor_confidence(F.lit(None).cast("double")).alias("c"), X.investor_signal(F.lit(7.0)).alias("d"),
        X.currency(F.lit("$1,234.50")).alias("e"), X.percent_text(F.lit(3.25), True).alias("f"), F.size(X.parse_decisions(F.lit("nope"))).alias("g"), X.paragraphs(F.lit("A b. C d! E? F. \n\nrate 2.5 of x. Then 3. So? tail")).alias("h"), X.display_name(F.lit("warren_buffett_agent_x1y2z3")).alias("i"), X.is_json(F.lit('{"a": NaN}')).alias("j"),
    ).first()
    assert tuple(row) == ("ben", "warren_buffett", 90.0, "bullish", 1234.5, "+3.2%", 0, ["A b. C d! E?", "F.", "rate 2.5 of x Then 3. So?"], "Warren Buffett", True)


def test_graphs_with_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "source string, target string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {tuple(r) for r in G.reachable(edges, start).collect()} == {("a", 0), ("b", 1), ("c", 2), ("d", 3)}
    with pytest.raises(ValueError):
        G.levels(edges, start)


def simple_paths(edges, starts, ends):
    found, stack = set(), [[s] for s in starts]
    while stack:
        path = stack.pop()
        if path[-1] in ends:
            found |= set(path)
        stack += [[*path, t] for s, t in edges if s == path[-1] and t not in path]
    return found


@pytest.mark.parametrize("seed", [1])
def test_nodes_on_simple_paths(spark, seed):
    """Cyclic graphs with components of several sizes, against all paths."""
    r = random.Random(seed)
    nodes = [f"n{i}" for i in range(14)]
    edges = sorted({(nodes[i], nodes[j]) for i in range(14) for j in range(14) if r.random() < (0.3 if i // 5 == j // 5 else 0.06 if i < j else 0)} | {("n1", "n1")})
    starts, ends = r.sample(nodes, 2), r.sample(nodes, 3)
    df = spark.createDataFrame([*edges, edges[0]], "source string, target string")
    ids = lambda x: spark.createDataFrame([(v,) for v in x], "id string")
    assert {x.id for x in G.on_paths(df, ids(starts), ids(ends)).collect()} == simple_paths(edges, starts, ends)
    with pytest.raises(ValueError, match="bound"):
        G.on_paths(spark.createDataFrame([(a, b) for a in nodes[:5] for b in nodes[:5] if a != b], "source string, target string"), ids(["n0"]), ids(["n1"]), bound=10)


def test_strong_components(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c"), ("d", "e")], "source string, target string")
    got = {x.id: x.component for x in G.strong_components(spark.createDataFrame([(v,) for v in "abcdef"], "id string"), df).collect()}
    assert got == {"a": "b", "b": "b", "c": "d", "d": "d", "e": "e", "f": "f"}


def test_a_client_is_asked_once_for_each_row(spark, tmp_path):
    """Opaque steps on three levels, and in a dataflow whose nodes are read by several others."""
    asked = str(tmp_path)

    def ask(rows):
        for t in rows["ticker"]:
            with open(f"{asked}/{uuid.uuid4().hex}", "w") as f:
                f.write(t)
        return pd.DataFrame({"ticker": rows["ticker"], "signal": "bullish", "confidence": rows["heard"] * 1.0})

    state = spark.createDataFrame([(f"T{i}",) for i in range(10)], "ticker string").repartition(3)
    out = A.run_agents(state, [("a", 0), ("b", 0), ("c", 1), ("d", 2), ("odd", 2)], dict.fromkeys("abcd", A.opaque(ask)))
    assert {(r.agent, r.confidence) for r in out.collect()} == {("a", 0.0), ("b", 0.0), ("c", 2.0), ("d", 3.0)} and out.count() == 40
    assert len(os.listdir(asked)) == 40

    def step(parts):
        for rows in parts:
            for _ in rows["id"]:
                open(f"{asked}/{uuid.uuid4().hex}", "w").close()
            yield pd.DataFrame({"id": rows["id"], "n": rows["below"].fillna(0) + 1})

    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "d"), ("d", "e")], "source string, target string")
    nodes = spark.createDataFrame([(x,) for x in "abcdez"], "id string")
    flow = A.dataflow(nodes, edges, spark.createDataFrame([("a",)], "id string"), lambda ready, level: ready.select("id", F.col("below").cast("double").alias("below")).mapInPandas(step, "id string, n double"), {"below": F.sum("n")})
    assert {tuple(x) for x in flow.collect()} == {("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 6.0), ("e", 7.0)} and flow.count() == 5
    assert len(os.listdir(asked)) == 45


def test_a_missing_match_fails(spark):
    left, right = spark.range(5).withColumnRenamed("id", "k"), spark.range(4).withColumnRenamed("id", "k").withColumn("v", F.lit(1))
    with pytest.raises(Exception, match="no row of k 4"):
        L.all_matched(left, right, "k").collect()


def test_numbers_without_one_task(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("v")).repartition(7)
    got = numbered(rows, ["v"], "n", start=5)
    assert [(r.v, r.n) for r in got.orderBy("n").collect()] == [(i, i + 5) for i in range(1000)]
    table = spark.createDataFrame([(3, "a")], "k int, v string")
    assert sorted(map(tuple, L.inserted(table, spark.createDataFrame([(9, "c"), (8, "b")], "k int, v string"), "k", "v").collect())) == [(3, "a"), (4, "b"), (5, "c")]
    plan = L.inserted(rows, rows, "id", "v")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_vendor_takes_filters(spark, tmp_path):
    rows = spark.range(4000).selectExpr("cast(id % 40 as int) as ticker", "date_add(date'2024-01-01', cast(id / 40 as int)) as date", "id as v")
    path = str(tmp_path / "prices")
    rows.repartitionByRange(8, "ticker", "date").sortWithinPartitions("ticker", "date").write.option("parquet.block.size", 1024).parquet(path)
    source = V.vendor(spark, path, rows.schema)
    wanted = V.prices(source, "2024-02-01", tickers=[3, 5], years=1).filter("v % 2 = 1")
    assert sorted(map(tuple, wanted.collect())) == sorted(map(tuple, rows.filter("ticker in (3, 5) and date <= '2024-02-01' and v % 2 = 1").collect()))
    reader = V.VendorReader(path, rows.schema)
    assert list(reader.pushFilters([DS.In(("ticker",), (3, 5)), DS.StringContains(("ticker",), "x")])) == [DS.StringContains(("ticker",), "x")]
    assert 1 <= len(reader.partitions()) <= 3  # of eight files
    assert V.vendor(spark, path, rows.schema).filter("ticker = 77").count() == 0
    plan = V.vendor(spark, path, rows.schema).filter("ticker = 3")._jdf.queryExecution().executedPlan().toString()
    assert ") Filter" not in plan and "- Filter" not in plan  # the source has taken it
    assert V.newest_of(source, "metrics", "2024-03-01").groupBy("ticker").count().filter("count <> 10").count() == 0


def test_vendor_holds_a_batch_of_a_file(tmp_path):
    """Of a file of one row group and 12 MB no more than some pages are in memory at a time."""
    n = 1_500_000
    table = pa.table({"ticker": pa.array(np.arange(n) // 1000, pa.int64()), "v": np.random.default_rng(1).random(n)})
    path = str(tmp_path / "part-0.parquet")
    pq.write_table(table, path, row_group_size=n)
    reader = V.VendorReader(str(tmp_path), StructType().add("ticker", "long").add("v", "double"))
    assert list(reader.pushFilters([DS.GreaterThanOrEqual(("ticker",), 1)])) == []
    del table
    (part,), first = reader.partitions(), pa.total_allocated_bytes()
    rows, most = 0, 0
    for batch in reader.read(part):
        rows, most = rows + batch.num_rows, max(most, pa.total_allocated_bytes() - first)
    assert rows == n - 1000 and most < 10_000_000


def test_vendor_is_asked_by_several_threads(spark, tmp_path):
    rows = spark.range(40).selectExpr("cast(id % 4 as int) as ticker", "date'2024-01-01' as date")
    path = str(tmp_path / "prices")
    rows.write.parquet(path)
    session = spark.newSession()  # one that knows no source yet
    with ThreadPoolExecutor(8) as threads:
        found = list(threads.map(lambda n: V.vendor(session, path, rows.schema).filter(f"ticker = {n % 4}").count(), range(16)))
    assert found == [10] * 16


def test_updates(spark):
    table = spark.createDataFrame([(1, "a", "n"), (2, "b", "n")], "k int, v string, w string")
    new = spark.createDataFrame([(2, "c", None, 1), (2, "d", None, 2), (3, "e", "z", 3)], "k int, v string, w string, o int")
    assert {tuple(r) for r in M.upserted(table, new, "k", "o").collect()} == {(1, "a", "n"), (2, "d", "n"), (3, "e", "z")}
    with pytest.raises(ValueError):
        M.page(table, limit=0)


def test_files(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"analysis_date": "2026-01-01", "rankings": [{"rank": 1, "ticker": "A", "metrics": {"pe": 3}}]}, indent=1))
    (tmp_path / "b.json").write_text(json.dumps({"A": {"signal": "bullish", "confidence": 70}}))
    assert files.rankings(spark, str(tmp_path / "p.json")).select("ticker", "metrics.pe").first() == ("A", 3.0)
    assert files.analyses(spark, {"buffett": str(tmp_path / "b.json")}).select("investor", "ticker", "confidence").first() == ("buffett", "A", 70.0)
    bodies = spark.createDataFrame([('{"tickers": ["A"], "start_date": "2024-01-01"}',), ("oops",)], "body string")
    assert sorted((r._corrupt or "", r.initial_capital) for r in files.request_rows(bodies).collect()) == [("", 100000.0), ("oops", 100000.0)]
    with pytest.raises(ValueError):
        files.save_json(bodies, str(tmp_path), "../x")
    assert spark.read.json(files.save_json(bodies, str(tmp_path), "out.json")).count() == 2


def test_workbook(spark, tmp_path):
    from ledgerline.sources import fixtures as fx

    d = "/root/testdata/sf0.001"
    sheets = reports.workbook(fx.stocks(spark, d), S.evaluated(fx.scores(spark, d)), list(fx.INVESTORS))
    assert set(sheets) == {"summary", "portfolio", "ranking", "matrix", "detail", "risk"}
    reports.write_workbook({k: sheets[k] for k in ("portfolio", "risk")}, str(tmp_path))
    total = spark.read.parquet(str(tmp_path / "portfolio")).groupBy("run_id").agg(F.sum("weight").alias("w"))
    assert total.filter("abs(w - 100) > 0.02").count() == 0


def _rows_out(plan):
    """The rows that each node of an executed plan gave."""
    found = plan.metrics().get("numOutputRows")
    here = [found.get().value()] if found.isDefined() else []
    children = plan.children()
    return here + [n for i in range(children.size()) for n in _rows_out(children.apply(i))]


def test_an_agent_meets_few_configs(spark):
    """Of 300 configs for one base only the first is joined with its 400 agents."""
    agents = spark.range(400).select(F.format_string("base_%06d", "id").alias("id"), F.lit("base").alias("base"))
    configs = spark.range(300).select(F.col("id").alias("pos"), F.when(F.col("id") % 30 == 29, "base_000007").otherwise("base").alias("agent"), F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = M.model_config(agents, configs.filter("pos > 20"), "none")
        got = df.collect()
        assert max(_rows_out(df._jdf.queryExecution().executedPlan())) <= 800
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert len(got) == 400 and {r.model for r in got} == {"m21"}
    assert {r.model for r in M.model_config(agents, configs.filter("agent <> 'base'"), "none").filter("id = 'base_000007'").collect()} == {"m29"}


def test_sums_of_weights_in_any_order(spark):
    """Equal groups tie in any order of their rows; what isn't finite is added as doubles are."""
    orders = list(itertools.permutations([0.1, 0.2, 0.3]))  # as doubles, 0.6 or a little more
    rows = [(i, "b", w) for i, order in enumerate(orders) for w in order] + [(i, "a", 0.6) for i in range(len(orders))]
    got = S.largest_group(spark.createDataFrame(rows, "run_id int, sector string, weight double").coalesce(1)).collect()
    assert len(got) == 6 and {(r.largest, r.largest_weight, r.top3_groups) for r in got} == {("a", 0.6, 1.2)}
    tenths = spark.createDataFrame([(0.1,)] * 10, "weight double").agg(S.exact_sum("weight")).first()[0]
    large = spark.createDataFrame([(1e300,), (1.0,), (None,)], "weight double").agg(S.exact_sum("weight")).first()[0]
    nan = spark.createDataFrame([(float("nan"),), (1.0,)], "weight double").agg(S.exact_sum("weight")).first()[0]
    assert (tenths, large) == (1.0, 1e300) and nan != nan
    assert spark.createDataFrame([], "weight double").agg(S.exact_sum("weight")).first()[0] is None


def test_weights_are_of_sums_in_falling_order(spark):
    """Bases of a run of part at 60 times sf0.1: by the SQL's sum the fifth has a share of just 15, as the four capped ones have."""
    bases = {18: (111.77999999999999, "a"), 24: (104.52000000000001, "b"), 1: (98.69000000000001, "c"), 7: (95.04, "d"), 15: (93.83999999999999, "e"), 10: (82.0, "f"), 2: (74.39999999999999, "g")}
    for ranks in (sorted(bases), sorted(bases, reverse=True), [10, 18, 2, 7, 15, 24, 1]):
        rows = [(1, r, bases[r][0], 0.0, bases[r][1]) for r in ranks]
        w = S.waterfall(spark.createDataFrame(rows, "run_id long, rank int, combined_confidence double, expected_return double, sector string").coalesce(1))
        got = {x["rank"]: x for x in S.ranked_by_weight(w).collect()}
        assert got[15].weight == 15.0 and [r for r, _ in sorted(got.items(), key=lambda x: x[1].place)] == [1, 7, 15, 18, 24, 10, 2]


def test_groups_are_added_from_the_largest_down(spark):
    """A run of part at 60 times sf0.1: by sums in falling order both groups have 35, by sums of decimals the second a last bit more."""
    groups = {"ECONOMY": [12.31788322507248, 11.764284927887262, 10.917831847040256], "LARGE": [14.091364197308735, 11.625005027338137, 9.283630775353132]}
    rows = [(i, g, w[j]) for i, p in enumerate(itertools.permutations(range(3))) for g, w in groups.items() for j in p]
    positions = spark.createDataFrame(rows, "run_id int, sector string, weight double").coalesce(1)
    assert {(r.sector, r.w) for r in S.group_sums(positions).collect()} == {("ECONOMY", 35.0), ("LARGE", 35.0)}
    assert {r.largest for r in S.largest_group(positions).collect()} == {"ECONOMY"}


def test_report_has_sectors_in_the_order_of_the_sql(spark, tmp_path):
    """Run 1118 of part at 60 times sf0.1: two sectors have their cap of 35, and the second by name a last bit more."""
    sizes = [42, 7, 32, 50, 2, 48, 4, 4, 29, 19, 13, 48, 20, 14, 39, 43, 33, 27, 22, 41, 33, 34, 50, 41, 39, 18, 39, 50, 36, 20]
    types = {"S": "SMALL", "P": "PROMO", "M": "MEDIUM", "L": "LARGE", "E": "ECONOMY", "T": "STANDARD"}
    kinds = "PSPPMPLEMSSSSLTTPSLTELTLTPLTMP"
    rows = [(33540 + i, types[k], n, 954 + i / 10) for i, (k, n) in enumerate(zip(kinds, sizes, strict=True))]
    part = spark.createDataFrame(rows, "p_partkey long, p_type string, p_size int, p_retailprice double")
    part.write.parquet(f"{tmp_path}/part.parquet")
    lines = reports.text_report(fx.stocks(spark, str(tmp_path)), S.evaluated(fx.scores(spark, str(tmp_path))), list(fx.INVESTORS))
    got = {(r.section, r.line_no): r.line for r in lines.filter("section in (6, 8)").collect()}
    assert got[6, 1] == "STANDARD 35.0 (within the cap of 35)" and got[6, 2] == "PROMO 35.0 (within the cap of 35)"
    assert got[8, 2] == "largest sector STANDARD 35.0"
