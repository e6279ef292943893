"""The panels of a portfolio report, and all of its sheets as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X
from ..operators import reshape
from ..operators import selection as S


def risk_panel(consensus: DataFrame, positions: DataFrame) -> DataFrame:
    """run_id, metric, value."""
    groups = S.largest_group(positions).select("run_id", F.col("largest_weight").alias("largest_sector"), F.col("top3_groups").alias("top3_sectors"))
    agreed = positions.groupBy("run_id").agg((100 * F.avg(F.when(F.col("bullish_count") == 3, 1.0).otherwise(0.0))).alias("unanimity"))
    votes = consensus.groupBy("run_id").agg(F.count_if((F.col("bullish_count") >= 1) & (F.col("bearish_count") >= 1)).alias("split"), F.count_if(~F.col("included")).alias("rejected"))
    wide = S.concentration(positions).join(groups, "run_id").join(agreed, "run_id").join(votes, "run_id")
    return reshape.metric_rows(wide, "run_id", ["top1", "top3", "top5", "top10", "hhi", "largest_sector", "top3_sectors", "unanimity", "split", "rejected"])


def summary_panel(consensus: DataFrame, positions: DataFrame) -> DataFrame:
    """run_id, metric, value."""
    w = S.exact_sum("weight")
    sums = positions.groupBy("run_id").agg(F.count("*").alias("positions"), w.alias("invested"), F.greatest(100 - w, F.lit(0.0)).alias("cash"), S.weighted_average("expected_return").alias("weighted_return"), S.weighted_average("combined_confidence").alias("weighted_confidence"))
    wide = sums.join(consensus.groupBy("run_id").agg(F.count("*").alias("universe")), "run_id").withColumn("inclusion", F.col("positions") / F.col("universe"))
    return reshape.metric_rows(wide, "run_id", ["positions", "invested", "cash", "weighted_return", "weighted_confidence", "universe", "inclusion"])


def workbook(stocks: DataFrame, evaluated: DataFrame, investors: list[str]) -> dict[str, DataFrame]:
    """The six sheets; each can be written on its own."""
    consensus = S.consensus(evaluated, len(investors))
    positions = S.waterfall(stocks.join(consensus, ["run_id", "ticker"]).filter("included")).filter("weight > 0")
    return {
        "summary": summary_panel(consensus, positions),
        "portfolio": reshape.with_cash_row(positions, S.cash(positions)),
        "ranking": stocks.join(consensus, ["run_id", "ticker"], "left").withColumn("bucket", X.cap_bucket("cap_value")),
        "matrix": reshape.matrix(evaluated, ["run_id", "ticker"], "investor", investors, "signal"),
        "detail": evaluated,
        "risk": risk_panel(consensus, positions),
    }


def write_workbook(sheets: dict[str, DataFrame], folder: str) -> None:
    for name, sheet in sheets.items():
        sheet.write.mode("overwrite").parquet(f"{folder}/{name}")


def _one(x, digits: int = 1):
    """A figure as text; of several digits, rounded half to even first."""
    return F.format_string(f"%.{digits}f", F.bround(x, digits))


def text_report(stocks: DataFrame, evaluated: DataFrame, investors: list[str]) -> DataFrame:
    """run_id, section, line_no, line: the report of each run as text, in order of section and line.

    1 the positions, the cash and the total; 2 every stock's signals; 3 the votes behind the
    five largest; 4 the figures; 5 who agrees; 6 sectors by weight, and cash; 7 what was left
    out; 8 the concentration; 9 stocks with opinions on both sides.
    """
    n = len(investors)
    consensus = S.consensus(evaluated, n)
    positions = S.waterfall(stocks.join(consensus, ["run_id", "ticker"]).filter("included")).filter("weight > 0")
    ranked = S.ranked_by_weight(positions)
    votes = F.concat(F.col("bullish_count").cast("string"), F.lit(f"/{n}"))
    signal = F.when(F.col("bullish_count") == n, "strong buy").otherwise("buy")
    line = lambda section, number, text: ["run_id", F.lit(section).alias("section"), number.cast("int").alias("line_no"), text.alias("line")]
    numbered = lambda *by: F.row_number().over(Window.partitionBy("run_id").orderBy(*by))
    first = F.concat_ws(" ", F.col("place"), "ticker", F.concat(_one(F.col("weight")), F.lit("%")), X.cap_bucket("cap_value"), signal, F.concat(_one(F.col("combined_confidence"), 0), F.lit("%")), X.percent_text("expected_return", True), X.number_text("pe"), votes)
    sums = positions.groupBy("run_id").agg(
        S.exact_sum("weight").alias("invested"), F.greatest(100 - S.exact_sum("weight"), F.lit(0.0)).alias("cash"), S.weighted_average("combined_confidence").alias("confidence"), S.weighted_average("expected_return").alias("expected"), F.count("*").alias("held"),
        F.coalesce(S.exact_sum(F.when(F.col("bullish_count") == n, F.col("weight"))), F.lit(0.0)).alias("strong"), F.coalesce(S.exact_sum(F.when(F.col("bullish_count") < n, F.col("weight"))), F.lit(0.0)).alias("rest"),
    )
    universe = consensus.groupBy("run_id").agg(F.count("*").alias("universe"))
    figures = sums.join(universe, "run_id")
    cash = F.concat(F.lit("CASH "), _one(F.col("cash")), F.lit("%"))
    total = F.concat(F.lit("total "), _one(F.col("invested") + F.col("cash")), F.lit("% avg "), _one(F.col("confidence"), 0), F.lit("% avg "), X.percent_text("expected", True))
    by_investor = F.array_sort(F.collect_list(F.struct(F.array_position(F.array(*map(F.lit, investors)), F.col("investor")).alias("k"), F.format_string("%s(%.0f)", "signal", "confidence").alias("v"))))
    said = evaluated.groupBy("run_id", "ticker").agg(F.array_join(F.transform(by_investor, lambda x: x["v"]), " ").alias("said"))
    everyone = stocks.join(said, ["run_id", "ticker"])
    names = lambda test: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("place", "ticker")))), lambda x: x["ticker"]), ", ")
    agreed = ranked.groupBy("run_id").agg(names(F.col("bullish_count") == n).alias("all"), names(F.col("bullish_count") < n).alias("most"))
    sectors = S.group_sums(positions)
    left_out = stocks.join(consensus, ["run_id", "ticker"]).filter("not included")
    top = S.concentration(positions).join(S.largest_group(positions), "run_id").join(ranked.filter("place = 1").select("run_id", "ticker"), "run_id")
    split = stocks.join(consensus.filter("bullish_count >= 1 and bearish_count >= 1"), ["run_id", "ticker"]).join(said, ["run_id", "ticker"])
    facts = [("held ", F.concat_ws("/", "held", "universe")), ("confidence ", _one(F.col("confidence"), 0)), ("return ", X.percent_text("expected", True)), ("strong buy ", _one(F.col("strong"))), ("buy ", _one(F.col("rest"))), ("cash ", _one(F.col("cash")))]
    parts = [
        ranked.select(line(1, F.col("place"), first)),
        figures.filter("cash > 0.01").select(line(1, F.lit(1_000_000), cash)),
        figures.select(line(1, F.lit(1_000_001), total)),
        everyone.select(line(2, F.col("rank"), F.concat_ws(" ", "ticker", "said"))),
        ranked.filter("place <= 5").join(said, ["run_id", "ticker"]).select(line(3, F.col("place"), F.concat_ws(" ", "ticker", signal, "said"))),
        *(figures.select(line(4, F.lit(i), F.concat(F.lit(name), value))) for i, (name, value) in enumerate(facts)),
        agreed.select(line(5, F.lit(0), F.concat(F.lit("all: "), "all"))),
        agreed.select(line(5, F.lit(1), F.concat(F.lit("most: "), "most"))),
        sectors.select(line(6, numbered(F.desc("w"), "sector"), F.concat(F.col("sector"), F.lit(" "), _one(F.col("w")), F.when((F.col("w") > 30) & (F.col("w") <= 35.5), " (within the cap of 35)").otherwise("")))),
        figures.filter("cash > 0.01").select(line(6, F.lit(1_000_000), cash)),
        left_out.select(line(7, F.col("rank"), F.concat_ws(" ", "ticker", "rank", votes))),
        top.select(line(8, F.lit(0), F.concat(F.lit("top 5 "), _one(F.col("top5"))))),
        top.select(line(8, F.lit(1), F.concat_ws(" ", F.lit("largest"), "ticker", _one(F.col("top1"))))),
        top.select(line(8, F.lit(2), F.concat_ws(" ", F.lit("largest sector"), "largest", _one(F.col("largest_weight"))))),
        split.select(line(9, F.col("rank"), F.concat_ws(" ", "ticker", "said"))),
    ]
    return reduce(DataFrame.unionByName, parts)
