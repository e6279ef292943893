"""Agents and dataflow: named functions from a state frame to messages, run level by level.

A level is a barrier: its messages are written to the shared folder before the next one
starts, and later levels read what was written. So plans stay as small as one level, and an
opaque step (a model that is asked) is asked once for each row, however deep the graph is and
however often its answers are used. (A task that is lost is run again, and then asks again.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import levels
from ..sources.files import settled

Agent = Callable[[DataFrame, str], DataFrame]
#: Merges the messages so far, agent, ticker, signal, confidence and level, to a frame of one row for each ticker.
Reducer = Callable[[DataFrame], DataFrame]
SIGNALS = "ticker string, signal string, confidence double"


def opaque(ask: Callable[[pd.DataFrame], pd.DataFrame]) -> Agent:
    """An agent whose answers come from a client: ``ask`` gets batches of the state and returns ``SIGNALS`` rows."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield ask(part)

    return lambda state, agent_id: state.mapInPandas(batches, SIGNALS).withColumn("agent", F.lit(agent_id))


def latest(messages: DataFrame) -> DataFrame:
    """Of an agent's messages on a ticker the one of the last level, as in a merge of maps where the right one wins."""
    return messages.groupBy("agent", "ticker").agg(F.max_by(F.struct("signal", "confidence"), "level").alias("s")).select("agent", "ticker", "s.*")


def heard(messages: DataFrame) -> DataFrame:
    """ticker, heard: how many bullish less bearish agents there are."""
    voice = F.when(F.lower("signal") == "bullish", 1).when(F.lower("signal") == "bearish", -1).otherwise(0)
    return latest(messages).groupBy("ticker").agg(F.sum(voice).alias("heard"))


def run_agents(state: DataFrame, agents: list[tuple[str, int]], registry: dict[str, Agent], key: Callable[[str], str] = lambda x: x, reducer: Reducer = heard) -> DataFrame:
    """agent, ticker, signal, confidence of agents(id, level); ids whose key the registry doesn't know are left out.

    Agents of a level see the state, joined with what the reducer makes of the messages of
    all levels before; the columns are null for tickers without any (``heard`` is then 0).
    """
    written: list[DataFrame] = []
    for level in sorted({n for _, n in agents}):
        seen = state
        if written:
            seen = state.join(reducer(reduce(DataFrame.unionByName, written)), "ticker", "left")
        seen = seen.withColumn("heard", F.coalesce("heard", F.lit(0)).cast("long") if "heard" in seen.columns else F.lit(0).cast("long"))
        said = [registry[key(i)](seen, i).select("agent", "ticker", "signal", "confidence") for i, n in agents if n == level and key(i) in registry]
        if said:
            written.append(settled(reduce(DataFrame.unionByName, said).withColumn("level", F.lit(level)), "level"))
    if not written:
        return state.sparkSession.createDataFrame([], f"agent string, {SIGNALS}")
    return reduce(DataFrame.unionByName, written).drop("level")


def dataflow(nodes: DataFrame, edges: DataFrame, roots: DataFrame, step: Callable[[DataFrame, int], DataFrame], merge: dict[str, Column]) -> DataFrame:
    """The messages of every node that the roots lead to: a graph of any size, a stage for each level.

    nodes(id, ...), edges(source, target), roots(id). A node runs when all that lead to it have;
    its level is its longest path from a root. ``step`` gets the level's nodes with ``merge``,
    aggregates of the messages that their in-neighbours have sent (null without any), and
    returns one row of id and a message's fields for each.
    """
    placed = settled(nodes.join(levels(edges, roots), "id"), "placed")
    depth = placed.agg(F.max("level")).first()[0]
    written: list[DataFrame] = []
    for level in range(-1 if depth is None else depth + 1):
        ready = placed.filter(F.col("level") == level)
        into = edges.join(ready.select(F.col("id").alias("target")), "target", "left_semi")
        if written:
            sent = reduce(DataFrame.unionByName, written).withColumnRenamed("id", "source")
            inbox = into.join(sent, "source").groupBy("target").agg(*(c.alias(name) for name, c in merge.items())).withColumnRenamed("target", "id")
            ready = ready.join(inbox, "id", "left")
        else:
            ready = ready.withColumns({name: F.lit(None) for name in merge})
        written.append(settled(step(ready, level), "level"))
    return reduce(DataFrame.unionByName, written) if written else step(placed.withColumns({name: F.lit(None) for name in merge}), 0)
