"""From evaluators' signals to weights: consensus, allocation under caps, and the figures of reports."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as X


def exact_sum(x: Column | str) -> Column:
    """An aggregate: the sum of doubles, rounded once, so that it is the same in any order of the rows.

    Decimals of 20 places are added; values that aren't finite, or are beyond them, are added as doubles.
    """
    x = F.col(x) if isinstance(x, str) else x
    places = x.try_cast("decimal(38,20)")
    return F.coalesce(F.when(F.count(places) == F.count(x), F.try_sum(places).cast("double")), F.sum(x))


def evaluated(scores: DataFrame) -> DataFrame:
    """scores(run_id, ticker, investor, score) with signal and confidence."""
    return scores.withColumns({"signal": X.investor_signal("score"), "confidence": X.investor_confidence("score")})


def joined_analyses(stocks: DataFrame, analyses: DataFrame, investors: list[str]) -> DataFrame:
    """run_id, ticker, investor, signal, confidence for every stock and investor; both last ones null where there is no analysis."""
    each = stocks.select("run_id", "ticker", F.explode(F.array(*map(F.lit, investors))).alias("investor"))
    return each.join(analyses.select("ticker", "investor", "signal", "confidence"), ["ticker", "investor"], "left").select("run_id", "ticker", "investor", "signal", "confidence")


def consensus(evaluated_: DataFrame, evaluators: int = 3, majority: int = 2) -> DataFrame:
    """run_id, ticker and the votes; the mean confidence divides by the number of evaluators, whoever is missing."""
    n = lambda s: F.count_if(F.col("signal") == s)
    votes = evaluated_.groupBy("run_id", "ticker").agg(n("bullish").alias("bullish_count"), n("bearish").alias("bearish_count"), F.bround(F.sum("confidence") / evaluators).alias("combined_confidence"), (F.sum(X.adjusted_score("signal", "confidence")) / evaluators).alias("adjusted_confidence"))
    bull, bear = F.col("bullish_count"), F.col("bearish_count")
    return votes.withColumns({"neutral_count": evaluators - bull - bear, "consensus_ratio": bull / evaluators, "combined_signal": X.combined_signal(bull, bear, evaluators), "included": bull >= majority})


def waterfall(included: DataFrame, confidence: str = "combined_confidence", cap: float = 15.0, floor: float = 2.0, group_cap: float = 35.0, group: str = "sector") -> DataFrame:
    """weight of included(run_id, rank, confidence, expected_return, group); what no name gets is cash.

    With the bases in falling order, name i is capped just if its share of what i - 1
    capped names leave, among the names from i on, is over the cap. Names under the
    floor get 0 and their share stays cash, then groups over the group's cap shrink.
    Sums are of doubles in that falling order, whatever the order of the rows, since
    weights that are equal but for a last bit are told apart by rank.
    """
    base = F.col(confidence) * (1 + F.coalesce("expected_return", F.lit(0.0)) / 100)
    order = Window.partitionBy("run_id").orderBy(F.desc("_base"), "rank")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    falling = lambda *by: Window.partitionBy(*by).orderBy(F.desc("_base"), "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = falling("run_id")
    i = F.row_number().over(order)
    step = included.withColumn("_base", base).withColumns({"_i": i, "_rest": F.sum("_base").over(rest)})
    capped = F.coalesce(F.try_divide(F.col("_base") * (100 - cap * (F.col("_i") - 1)), F.col("_rest")) > cap, F.lit(False))
    step = step.withColumn("_capped", capped)
    step = step.withColumns({"_k": F.count_if("_capped").over(whole), "_free": F.sum(F.when(~F.col("_capped"), F.col("_base"))).over(whole)})
    weight = F.when(F.col("_capped"), F.lit(cap)).otherwise(F.coalesce(F.try_divide(F.col("_base") * (100 - cap * F.col("_k")), F.col("_free")), F.lit(0.0)))
    step = step.withColumn("_w", weight).withColumn("_w", F.when(F.col("_w") < floor, 0.0).otherwise(F.col("_w")))
    of_group = F.sum("_w").over(falling("run_id", group))
    step = step.withColumn("weight", F.when(of_group > group_cap, F.col("_w") * group_cap / of_group).otherwise(F.col("_w")))
    return step.drop("_base", "_i", "_rest", "_capped", "_k", "_free", "_w")


def capped_weights(weights: np.ndarray, groups: np.ndarray, single: float = 15.0, group_cap: float = 35.0, passes: int = 20, slack: float = 0.01) -> np.ndarray:
    """Shrink groups, then names, to their caps and share out what names lose, until nothing changes."""
    w = weights.astype(float).copy()
    codes = np.unique(groups, return_inverse=True)[1]
    for _ in range(passes):
        totals = np.bincount(codes, w)
        over = totals > group_cap + slack
        scale = np.where(over, group_cap / np.where(totals > 0, totals, 1), 1.0)
        w *= scale[codes]
        high = w > single + slack
        excess = float((w[high] - single).sum())
        w[high] = single
        changed = bool(over.any() or high.any())
        if excess > slack:
            totals = np.bincount(codes, w)
            free = ~high & (totals[codes] < group_cap - slack) & (w < single - slack)
            if (total := w[free].sum()) > slack:
                w[free] += excess * w[free] / total
                changed = True
        if not changed:
            break
    return w


def iterative_caps(eligible: DataFrame, confidence: str = "adjusted_confidence", floor: float = 2.0, group: str = "sector", single: float = 15.0, group_cap: float = 35.0) -> DataFrame:
    """run_id, rank, ticker, weight: shares of the confidence, without names under the floor, within both caps."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable")
        w = rows["c"].to_numpy(float)
        w = w / w.sum() * 100 if w.sum() > 0 else w * 0
        keep = w >= floor
        rows, w = rows[keep], w[keep]
        if len(w):
            w = capped_weights(w * 100 / w.sum(), rows["g"].to_numpy(str), single, group_cap)
        return rows[["run_id", "rank", "ticker"]].assign(weight=w)

    picked = eligible.select("run_id", "rank", "ticker", F.coalesce(F.col(confidence), F.lit(0.0)).alias("c"), F.coalesce(F.col(group), F.lit("")).alias("g"))
    return picked.groupBy("run_id").applyInPandas(one, "run_id long, rank int, ticker string, weight double")


def weighted_average(x: str, weight: str = "weight") -> Column:
    """An aggregate; missing values count as 0, and so does an empty group."""
    return F.coalesce(F.try_divide(exact_sum(F.col(weight) * F.coalesce(F.col(x), F.lit(0.0))), exact_sum(weight)), F.lit(0.0))


def hhi(weight: str = "weight") -> Column:
    return F.sum(F.pow(F.col(weight) / 100, 2))


def ranked_by_weight(positions: DataFrame) -> DataFrame:
    return positions.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("weight"), "rank")))


def concentration(positions: DataFrame) -> DataFrame:
    """Weights of the largest 1, 3, 5 and 10 positions, and HHI without cash."""
    top = lambda k: F.coalesce(exact_sum(F.when(F.col("place") <= k, F.col("weight"))), F.lit(0.0)).alias(f"top{k}")
    return ranked_by_weight(positions).groupBy("run_id").agg(*(top(k) for k in (1, 3, 5, 10)), hhi().alias("hhi"))


def cash(positions: DataFrame) -> DataFrame:
    return positions.groupBy("run_id").agg(F.greatest(100 - exact_sum("weight"), F.lit(0.0)).alias("weight"))


def group_weights(positions: DataFrame, group: Column) -> DataFrame:
    """run_id, bucket, weight, with a row of cash where there is any."""
    sums = positions.groupBy("run_id", group.alias("bucket")).agg(exact_sum("weight").alias("weight"))
    rest = cash(positions).filter("weight > 0.01").select("run_id", F.lit("cash").alias("bucket"), "weight")
    return sums.unionByName(rest)


def group_sums(positions: DataFrame, group: str = "sector") -> DataFrame:
    """run_id, group, w: the weights of a group, added as doubles from the largest down, as its cap was measured."""
    falling = Window.partitionBy("run_id", group).orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return positions.select("run_id", group, F.sum("weight").over(falling).alias("w")).groupBy("run_id", group).agg(F.max("w").alias("w"))


def largest_group(positions: DataFrame, group: str = "sector") -> DataFrame:
    """The largest group of a run, the first by name of equal ones, its weight and that of the largest three."""
    sums = group_sums(positions, group)
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("w"), group))
    return sums.withColumn("_p", place).groupBy("run_id").agg(F.max(F.when(F.col("_p") == 1, F.col(group))).alias("largest"), F.max("w").alias("largest_weight"), exact_sum(F.when(F.col("_p") <= 3, F.col("w"))).alias("top3_groups"))
