"""Agent graphs as nodes(id, type) and edges(source, target).

Reachability goes in rounds of a join and an anti-join, so a node is expanded
once however many paths lead to it, and cycles end by themselves. Each round is
written to the shared folder, so a lost executor costs no earlier round.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import base_agent_key, risk_manager_id
from ..sources.files import settled, shared_path


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """id, depth of the nodes that starts(id) lead to, themselves at depth 0.

    Each round writes its front only; what has been seen is all fronts together.
    """
    spark, base = edges.sparkSession, shared_path(edges.sparkSession, "reachable")
    seen = starts.select("id").distinct().withColumn("depth", F.lit(0))
    schema = seen.schema
    for depth in itertools.count():
        front = seen if depth == 0 else step.distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        front.write.parquet(f"{base}/round={depth}")
        front = spark.read.schema(schema).parquet(f"{base}/round={depth}")
        seen = spark.read.schema(schema).parquet(*(f"{base}/round={n}" for n in range(depth + 1)))
        if not front.take(1):
            return seen
        step = edges.join(front.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def between(edges: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """id of the nodes that a start leads to and that lead to an end, both included."""
    return reachable(edges, start).select("id").join(reachable(reversed_edges(edges), end).select("id"), "id", "left_semi")


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component (its largest node) of nodes(id): those that lead to each other share one.

    In rounds over what is left: every node takes the largest node that leads to it as its
    colour, and the nodes that lead back to that one within the colour are its component.
    """
    left, done = settled(nodes.select("id").distinct(), "left"), []
    while left.take(1):
        inner = settled(induced(edges, left).distinct(), "inner")
        colour = left.withColumn("colour", F.col("id"))
        while True:
            sent = inner.join(colour.withColumnRenamed("id", "source"), "source").select(F.col("target").alias("id"), "colour")
            new = settled(colour.unionByName(sent).groupBy("id").agg(F.max("colour").alias("colour")), "colour")
            changed = new.join(colour.withColumnRenamed("colour", "old"), "id").filter("colour <> old").take(1)
            colour = new
            if not changed:
                break
        of = lambda end: colour.select(F.col("id").alias(end), F.col("colour").alias(f"_{end}"))
        same = inner.join(of("source"), "source").join(of("target"), "target").filter("_source = _target").select("source", "target")
        back = reachable(reversed_edges(same), colour.filter("id = colour").select("id")).select("id")
        found = settled(back.join(colour, "id").select("id", F.col("colour").alias("component")), "component")
        done.append(found)
        left = settled(left.join(found, "id", "left_anti"), "left")
    return reduce(DataFrame.unionByName, done) if done else nodes.select("id", F.col("id").alias("component"))


def on_paths(edges: DataFrame, start: DataFrame, end: DataFrame, bound: int = 1_000_000) -> DataFrame:
    """id of the nodes on a path from a start to an end that comes to no node twice, both included.

    On acyclic graphs those are the nodes between them. In general a path crosses each
    strongly connected component once, from a node where it enters to one where it leaves,
    and components on its way are different ones; so only within a component with cycles
    paths are followed, all of them side by side. More than ``bound`` paths at a time in all
    components are an error: their number can grow exponentially with a component's size.
    """
    inside = settled(between(edges, start, end), "between")
    inner = settled(induced(edges, inside).filter("source <> target").distinct(), "inner")
    placed = settled(strong_components(inside, inner), "placed")
    cyclic = placed.groupBy("component").count().filter("count > 1").select("component")
    members = settled(placed.join(cyclic, "component", "left_semi"), "members")
    free = inside.join(members.select("id"), "id", "left_anti")
    at = lambda name: members.select(F.col("id").alias(name), F.col("component").alias(f"_{name}"))
    marked = inner.join(at("source"), "source", "left").join(at("target"), "target", "left")
    within = settled(marked.filter("_source = _target").select("source", "target"), "within")
    across = marked.filter("_source is null or _target is null or _source <> _target")
    enters = across.filter("_target is not null").select(F.col("target").alias("id")).unionByName(start.select("id").join(members, "id", "left_semi")).distinct()
    leaves = settled(across.filter("_source is not null").select(F.col("source").alias("id")).unionByName(end.select("id").join(members, "id", "left_semi")).distinct(), "leaves")
    paths = settled(enters.select("id", F.array("id").alias("path")), "paths")
    found = []
    while n := paths.count():
        if n > bound:
            raise ValueError(f"{n} paths within strongly connected components; the bound is {bound}")
        found.append(settled(paths.join(leaves, "id", "left_semi").select(F.explode("path").alias("id")).distinct(), "found"))
        grown = paths.join(within.withColumnRenamed("source", "id"), "id").filter(~F.array_contains("path", F.col("target")))
        paths = settled(grown.select(F.col("target").alias("id"), F.array_append("path", F.col("target")).alias("path")), "paths")
    return reduce(DataFrame.unionByName, [free, *found]).distinct()


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends among ids(id)."""
    both = edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    return both.join(ids.select(F.col("id").alias("target")), "target", "left_semi").select("source", "target")


def classified(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    """The nodes whose key without suffix the registry(base_key) knows."""
    return nodes.withColumn("base_key", base_agent_key("id")).join(registry, "base_key")


def through_risk_managers(edges: DataFrame, managers: DataFrame) -> DataFrame:
    """Edges to a manager go through its risk manager; of an analyst with several managers the last edge counts.

    edges(pos, source, target), managers(id).
    """
    marked = edges.join(managers.select(F.col("id").alias("target"), F.lit(True).alias("m")), "target", "left")
    kept = marked.filter("m is null").select("source", "target")
    last = marked.filter("m").groupBy("source").agg(F.max_by("target", "pos").alias("target"))
    risk = last.select("source", risk_manager_id("target").alias("target"))
    onward = managers.select(risk_manager_id("id").alias("source"), F.col("id").alias("target"))
    return kept.unionByName(risk).unionByName(onward)


def with_start_and_end(nodes: DataFrame, edges: DataFrame, managers: DataFrame) -> DataFrame:
    """Edges from the start to nodes without incoming ones, and from managers to the end, added."""
    roots = nodes.join(edges.select(F.col("target").alias("id")), "id", "left_anti").select(F.lit("start_node").alias("source"), F.col("id").alias("target"))
    return edges.select("source", "target").unionByName(roots).unionByName(managers.select(F.col("id").alias("source"), F.lit("END").alias("target")))


def levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """id, level: the longest path from a root, the stage in which a node can run; a cycle is an error."""
    best = roots.select("id").distinct().withColumn("level", F.lit(0))
    front = best
    for level in itertools.count(1):
        if level > 1 and level % 16 == 0 and level > best.count():
            break  # a path longer than there are nodes
        front = settled(edges.join(front.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg((F.max("level") + 1).alias("level")))
        if not front.take(1):
            return best
        best = settled(best.unionByName(front).groupBy("id").agg(F.max("level").alias("level")))
    raise ValueError("the graph has a cycle")


def sources_of(edges: DataFrame, nodes: DataFrame, type_: str) -> DataFrame:
    """target, id of the in-neighbours of a type."""
    return edges.join(nodes.filter(F.col("type") == type_).select(F.col("id").alias("source")), "source").select("target", F.col("source").alias("id"))


def first_match(events: DataFrame, nodes: DataFrame) -> DataFrame:
    """events(agent, …) with node: the first node (by pos) of the agent's base key, else the agent itself."""
    named = nodes.select(base_agent_key("id").alias("_key"), "id", "pos").groupBy("_key").agg(F.min_by("id", "pos").alias("_node"))
    return events.join(named, F.col("agent") == F.col("_key"), "left").withColumn("node", F.coalesce("_node", "agent")).drop("_key", "_node")


def numbered_edges(edges: DataFrame) -> DataFrame:
    """edges with pos, their place in (source, target) order within a source."""
    return edges.withColumn("pos", F.row_number().over(Window.partitionBy("source").orderBy("target")))
