"""Nearest vectors by inner product: one robust-pruned directed graph per shard.

Vectors are dealt by hash of their id into shards of bounded size; every vector is
indexed. Inner products become distances by one more component that brings all
vectors to the longest norm. A shard's graph is built in batches: a beam search
from the medoid over the graph so far proposes neighbours, and relaxed pruning
keeps an edge only if no kept neighbour is ``ALPHA`` times closer to its end.
Equal vectors of a shard are one node, so large groups of copies neither fill
the edge lists nor hide each other. Queries go to every shard in blocks; a
query's best candidates of some shards, then of all, are merged, with scores
computed on the original vectors in double precision.

Each shard is one task's work, so shards are built and searched side by side. With
n vectors and n / 20 queries there are n / ``shard_rows`` searches for each query;
``shard_rows`` may be as large as a task has memory for.

Null vectors, zero vectors and vectors with null or non-finite components take no
part, neither do rows without an id. Vectors of other lengths than a query's have no
inner product with it: vectors of each length are searched among their own.
Repeated ids are separate candidates, and none of them is its own query's.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import kept

SHARD_ROWS = 8_000
#: Shards whose candidates of a query are merged first.
MERGED = 32
QUERY_BLOCK = 2_000
DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Beam of searches for queries.
SEARCH_BEAM = 96
_GROUP = 256


def usable(vector: Column) -> Column:
    """Whether a vector has only finite components and is not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def beam_search(graph: np.ndarray, vectors: np.ndarray, entry: int, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For all queries at once: the width nearest nodes found and their squared distances, nearest first.

    graph holds neighbour ids, padded with -1. Each round expands the nearest node
    of every beam that has not been expanded yet.
    """
    m, norms = len(queries), (vectors**2).sum(axis=1)
    q_norms = (queries**2).sum(axis=1)
    node = np.full((m, width), -1, np.int64)
    far = np.full((m, width), np.inf, np.float32)
    done = np.ones((m, width), bool)
    node[:, 0], far[:, 0], done[:, 0] = entry, q_norms + norms[entry] - 2 * queries @ vectors[entry], False
    seen = np.zeros((m, len(vectors)), bool)
    seen[:, entry] = True
    while (open_ := np.flatnonzero(~done.all(axis=1))).size:
        at = np.argmax(~done[open_], axis=1)
        done[open_, at] = True
        near = graph[node[open_, at]]
        new = (near >= 0) & ~seen[open_[:, None], near]
        rows, cols = np.nonzero(new)
        if not len(rows):
            continue
        who, ids = open_[rows], near[rows, cols]
        seen[who, ids] = True
        d = np.full(near.shape, np.inf, np.float32)
        d[rows, cols] = q_norms[who] + norms[ids] - 2 * np.einsum("ij,ij->i", queries[who], vectors[ids])
        all_d = np.concatenate([far[open_], d], axis=1)
        order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
        far[open_] = np.take_along_axis(all_d, order, axis=1)
        node[open_] = np.take_along_axis(np.concatenate([node[open_], np.where(new, near, -1)], axis=1), order, axis=1)
        done[open_] = np.take_along_axis(np.concatenate([done[open_], ~np.isfinite(d)], axis=1), order, axis=1) | ~np.isfinite(far[open_])
    return node, far


def robust_prune(vectors: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Diverse neighbours of points out of their candidates (rows padded with -1)."""
    given = np.where(candidates == points[:, None], -1, candidates)
    x = vectors[np.maximum(given, 0)]
    d = ((x - vectors[points][:, None, :]) ** 2).sum(axis=2)
    d[given < 0] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    d, given = np.take_along_axis(d, order, axis=1), np.take_along_axis(given, order, axis=1)
    x = np.take_along_axis(x, order[:, :, None], axis=1)
    alive, rows = np.isfinite(d), np.arange(len(points))
    out = np.full((len(points), degree), -1, np.int64)
    for k in range(degree):
        best = np.argmax(alive, axis=1)
        some = alive[rows, best]
        if not some.any():
            break
        out[some, k] = given[rows[some], best[some]]
        between = ((x - x[rows, best][:, None, :]) ** 2).sum(axis=2)
        alive &= ~((alpha * alpha * between <= d) & some[:, None])
        alive[rows[some], best[some]] = False
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """The graph of distinct vectors and its entry node."""
    n = len(vectors)
    entry = int(((vectors - vectors.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(5).permutation(n)
    graph = np.full((n, degree), -1, np.int64)
    done, size = 0, 1
    while done < n:
        points = order[done : done + size]
        found, _ = beam_search(graph, vectors, entry, vectors[points], beam)
        own = np.full((len(points), 2 * degree), -1, np.int64)
        if len(points) > 1:  # members of a batch don't see each other in the graph yet
            d = ((vectors[points] ** 2).sum(axis=1)[:, None] + (vectors[points] ** 2).sum(axis=1)[None, :]) - 2 * vectors[points] @ vectors[points].T
            near = np.argsort(d, axis=1, kind="stable")[:, : 2 * degree]
            own[:, : near.shape[1]] = points[near]
        candidates = np.concatenate([found, own], axis=1)
        candidates = np.sort(candidates, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1
        graph[points] = robust_prune(vectors, points, candidates, degree, alpha)
        source, target = np.repeat(points, degree), graph[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        back = np.argsort(target, kind="stable")
        ends, starts, counts = np.unique(target[back], return_index=True, return_counts=True)
        for low in range(0, len(ends), _GROUP):
            e, s, c = ends[low : low + _GROUP], starts[low : low + _GROUP], counts[low : low + _GROUP]
            grown = np.full((len(e), degree + c.max()), -1, np.int64)
            grown[:, :degree] = graph[e]
            for r in range(len(e)):
                grown[r, degree : degree + c[r]] = source[back[s[r] : s[r] + c[r]]]
            grown = np.sort(grown, axis=1)
            grown[:, 1:][grown[:, 1:] == grown[:, :-1]] = -1
            full = (grown >= 0).sum(axis=1) > degree
            if full.any():
                graph[e[full]] = robust_prune(vectors, e[full], grown[full], degree, alpha)
            graph[e[~full]] = -np.sort(-grown[~full], axis=1)[:, :degree]
        done += len(points)
        size = min(_GROUP, max(1, done))
    return graph, entry


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of equal norm whose distances order as the inner products do."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)


def search(ids: np.ndarray, vectors: np.ndarray, graph: np.ndarray, entry: int, node_of: np.ndarray, nodes: np.ndarray, q_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> pd.DataFrame:
    """A shard's best k candidates of each query, without the query's own row."""
    out = []
    q = np.concatenate([queries, np.zeros((len(queries), 1))], axis=1).astype(np.float32)
    members = np.lexsort((ids, node_of))
    first = np.searchsorted(node_of[members], np.arange(len(nodes) + 1))
    for i in range(0, len(q), _GROUP):
        found, _ = beam_search(graph, nodes, entry, q[i : i + _GROUP], max(beam, 2 * k))
        for r, row in enumerate(found):
            # of a node's equal vectors the k + 1 smallest ids are enough: ties go to them, and one may be the query
            own = np.concatenate([members[first[v] : min(first[v + 1], first[v] + k + 1)] for v in row[row >= 0]])
            own = own[ids[own] != q_ids[i + r]]
            score = (vectors[own] * queries[i + r]).sum(axis=1)  # one order of summation for all rows, so equal vectors tie
            best = np.lexsort((ids[own], -score))[:k]
            out.append(pd.DataFrame({"query_id": q_ids[i + r], "vec_id": ids[own][best], "score": score[best]}))
    return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each query of vectors(vec_id, embedding, ...)."""
    rows = kept(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))), "vectors")
    rows = rows.withColumn("dims", F.size("embedding"))
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy("dims").agg(F.count("*").alias("n"), F.sqrt(F.max(norm)).alias("longest"))
    sizes = sizes.select("dims", "longest", F.ceil(F.col("n") / shard_rows).cast("int").alias("shards"), F.greatest(F.lit(1), F.floor(F.col("n") / (20 * QUERY_BLOCK))).cast("int").alias("blocks"))
    sizes = kept(sizes, "sizes")  # a row for each length
    shards, tiles = sizes.agg(F.coalesce(F.sum("shards"), F.lit(1)), F.coalesce(F.sum(F.col("shards") * F.col("blocks")), F.lit(1))).first()
    rows = rows.join(sizes, "dims")
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int"))
    asked = rows.filter(is_query).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), "blocks").cast("int"))
    queries = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))

    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        x = np.stack(pdf["embedding"].to_numpy())
        distinct, node_of = np.unique(x, axis=0, return_inverse=True)
        graph, entry = build(lifted(distinct, pdf["longest"].iloc[0]))
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in ("shard", "longest", "blocks")}, "ids": [pdf["vec_id"].to_numpy()], "vectors": [x.astype("<f8").tobytes()], "graph": [graph.astype("<i4").tobytes()], "entry": [entry], "node_of": [node_of.ravel()], "dims": [x.shape[1]]})

    # numbers of partitions that are named stay as they are, so that shards don't meet in a task
    built = placed.repartition(2 * shards, "dims", "shard").groupBy("dims", "shard").applyInPandas(index, "shard int, longest double, blocks int, ids array<long>, vectors binary, graph binary, entry int, node_of array<long>, dims int")
    graphs = kept(built, "graphs")

    def answer(key: tuple, shard: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(shard) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "shard": []})
        s = shard.iloc[0]
        ids, node_of = np.asarray(s["ids"]), np.asarray(s["node_of"])
        x = np.frombuffer(s["vectors"], "<f8").reshape(len(ids), s["dims"])
        nodes = np.zeros((node_of.max() + 1, s["dims"]))
        nodes[node_of] = x
        graph = np.frombuffer(s["graph"], "<i4").reshape(len(nodes), -1).astype(np.int64)
        found = search(ids, x, graph, int(s["entry"]), node_of, lifted(nodes, s["longest"]), asked["vec_id"].to_numpy(), np.stack(asked["embedding"].to_numpy()), k, beam)
        return found.assign(shard=s["shard"])

    tile = ["dims", "shard", "block"]
    served = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).repartition(2 * tiles, *tile)
    queries = queries.select(*tile, "vec_id", "embedding").repartition(2 * tiles, *tile)
    found = served.groupBy(*tile).cogroup(queries.groupBy(*tile)).applyInPandas(answer, "query_id long, vec_id long, score double, shard int")
    return top(found, k)


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every query; ties go to the smaller vec_id. No list is longer than k rows of ``MERGED`` shards, or of that part of all shards."""

    def best(rows: DataFrame, *keys: Column | str) -> DataFrame:
        first = F.slice(F.array_sort(F.collect_list(F.struct("far", "vec_id"))), 1, k)
        return rows.groupBy(*keys).agg(first.alias("best")).select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", "at", "b.*")

    rows = found.select("query_id", "vec_id", (-F.col("score")).alias("far"), F.floor(F.col("shard") / MERGED).alias("part"))
    each = best(best(rows, "query_id", "part"), "query_id")
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "vec_id", (-F.col("far")).alias("score"))
