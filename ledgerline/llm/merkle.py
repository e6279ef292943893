"""A Merkle manifest of documents: a tree for each source, and a tree of the sources over them.

A leaf is the hash of a document's fields. In each tree every ``ARITY`` consecutive
nodes become their hash (the last run may be shorter, even one node) until one
remains. Trees of any size are built in tiers: ``ARITY ** levels`` consecutive nodes
are a superblock, one group of applyInPandas, whose root is a node of the next tier.

Then proofs come down again by cogrouping: the nodes of a tier and, for each of their
superblocks, the outer nodes that its proofs need, which is one row. At the leaves the
same cogroup finishes the local reduction, joins the proofs, and folds the leaf, or what
tampering has made of it, up to a root. No group has more than a superblock's rows, so a
source with any share of all documents is spread like the others.

Null fields are hashed as ``-``; documents without a source have a tree of their own, the
first one; a null doc_id comes first in its tree and isn't tampered with. Documents of one
source that share a doc_id are ordered by their leaves, and equal rows stand side by side,
each with its own proof. An empty table gives no rows; other columns don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .tables import dropped, kept

ARITY = 3
#: Levels of a superblock: 3 ** 8 is 6,561 nodes, about 2 MB.
LEVELS = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _field(c: Column) -> Column:
    """- if null, else the UTF-8 byte count, a colon and the value."""
    c = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))


def leaf_hash(**changed: Column) -> Column:
    return F.sha2(F.concat(*(_field(changed.get(name, F.col(name))) for name in FIELDS)).cast("binary"), 256)


def is_tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def _h(*nodes: str) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _height(n: int) -> int:
    """Levels until one of n nodes remains."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


def _levels_of(nodes: list[str], n: int, levels: int) -> list[list[str]]:
    """The levels of a superblock of a tier of n nodes, its root last."""
    out = [nodes]
    for _ in range(min(levels, _height(n))):
        row = out[-1]
        out.append([_h(*row[i : i + ARITY]) for i in range(0, len(row), ARITY)])
    return out


def _siblings(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """For node ``at``, level by level, the nodes of its run that stand before and after it, joined."""
    out = []
    for row in levels[:-1]:
        first = at - at % ARITY
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + ARITY])))
        at //= ARITY
    return out


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """rows with pos, their place in their tree, and n, the tree's number of rows; written to the shared folder.

    Rows are dealt by range and numbered within tasks; the counts of (task, tree), at most
    one for each task and one for each tree, give what comes before. rows is read
    twice, so it should be a written table.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            trees = batch.column(batch.schema.get_field_index(tree)).dictionary_encode()
            codes, values = np.asarray(trees.indices), trees.dictionary
            start = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, np.int64)
            rank = np.arange(len(codes)) - np.repeat(start, np.diff(np.append(start, len(codes))))
            for first, end in zip(start[:1], np.append(start, len(codes))[1:2], strict=True):
                if values[codes[first]].as_py() == last:
                    rank[first:end] += seen
            if len(codes):
                last, seen = values[codes[-1]].as_py(), int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(codes), part, np.int32)), pa.array(rank, pa.int64())], [*batch.schema.names, "_part", "_rank"])

    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_rank", LongType())])
    placed = kept(rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).mapInArrow(number, schema), "merkle_placed")
    counts = placed.groupBy("_part", tree).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(tree)  # a row for each task that has rows of the tree
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_part", tree, before.alias("_before"), F.sum("_n").over(w).alias("n"))
    return placed.join(offsets, ["_part", tree]).withColumn("pos", F.col("_rank") + F.col("_before")).drop("_part", "_rank", "_before")


def _block(levels: int) -> Column:
    return F.floor(F.col("pos") / F.lit(ARITY**levels)).cast("long").alias("block")


def _next_tier(nodes: DataFrame, levels: int) -> DataFrame:
    """tree, pos, n, h of the superblock roots of nodes."""

    def reduce(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree, block = key
        n = int(rows["n"].iloc[0])
        root = _levels_of(rows.sort_values("pos")["h"].tolist(), n, levels)[-1]
        return pd.DataFrame({"tree": [tree], "pos": [block], "n": [-(-n // ARITY**levels)], "h": root})

    return nodes.select("tree", "pos", "n", "h").groupBy("tree", _block(levels)).applyInPandas(reduce, "tree string, pos long, n long, h string")


def _tiers(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The tiers over nodes(tree, pos, n, h, ...), themselves first, and tree, h of the roots."""
    tiers = [nodes]
    while True:
        above = kept(_next_tier(tiers[-1], levels), "merkle_tier")
        if not above.filter("n > 1").take(1):
            return tiers, above.select("tree", "h")
        tiers.append(above)


PATH = "array<struct<before:string,after:string>>"


def _paths(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """tree, pos, path, subroot, root of nodes, whose superblocks have them in outer."""

    def extend(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        tree, block = key
        found = _levels_of(rows["h"].tolist(), int(rows["n"].iloc[0]), levels)
        top = [(x["before"], x["after"]) for x in above["path"].iloc[0]]
        paths = [[{"before": b, "after": a} for b, a in _siblings(found, at) + top] for at in range(len(rows))]
        return pd.DataFrame({"tree": tree, "pos": rows["pos"], "path": paths, "subroot": above["subroot"].iloc[0], "root": above["root"].iloc[0]})

    left = nodes.select("tree", "pos", "n", "h").groupBy("tree", _block(levels))
    return left.cogroup(outer.groupBy("tree", "pos")).applyInPandas(extend, f"tree string, pos long, path {PATH}, subroot string, root string")


def proofs(docs: DataFrame, levels: int = LEVELS, with_path: bool = True) -> DataFrame:
    """The manifest of docs(doc_id, source, lang, n_chars, text, ...), a row for each document.

    doc_id, leaf, subroot, root, proof_sha256 (the hash of the siblings up to the root, from
    left to right and level by level), folded_root (from the tampered leaf if is_tampered,
    whose text has lost its line ends, else from the leaf), verified (folded_root is the
    root) and, unless with_path is false, path: the siblings before and after, by level.
    """
    id_type = docs.schema["doc_id"].dataType
    tree = F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("tree")  # null first, then by UTF-8 bytes
    tampered = F.when(is_tampered(F.col("doc_id")), leaf_hash(text=F.replace("text", F.lit("\n"), F.lit(""))))
    hashed = kept(docs.select(tree, "doc_id", leaf_hash().alias("h"), tampered.alias("tampered"), F.monotonically_increasing_id().alias("_row")), "merkle_leaves")
    leaves = kept(numbered(hashed, "tree", ["doc_id", "h", "_row"]).select("tree", "pos", "n", "h", "tampered", F.col("doc_id").cast("string").alias("doc_id")), "merkle_numbered")
    dropped(hashed)

    tiers, subroots = _tiers(leaves, levels)
    sources = numbered(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("source"), "h"), "tree", ["source"])
    source_tiers, root = _tiers(kept(sources, "merkle_sources"), levels)
    # downwards: the root has an empty path; its one row stands for superblock 0 of the sources
    none = F.array().cast(PATH)
    outer = root.select("tree", F.lit(0).cast("long").alias("pos"), none.alias("path"), F.lit("").alias("subroot"), F.col("h").alias("root"))
    for tier in reversed(source_tiers):
        outer = kept(_paths(tier, outer, levels), "merkle_paths")
    outer = source_tiers[0].join(outer, ["tree", "pos"]).select(F.col("source").alias("tree"), F.lit(0).cast("long").alias("pos"), "path", F.col("h").alias("subroot"), "root")
    for tier in reversed(tiers[1:]):
        outer = kept(_paths(tier, outer, levels), "merkle_paths")

    def finish(key: tuple, rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        nodes, root = rows["h"].tolist(), above["root"].iloc[0]
        found = _levels_of(nodes, int(rows["n"].iloc[0]), levels)
        top = [(x["before"], x["after"]) for x in above["path"].iloc[0]]
        digests, folded, paths = [], [], []
        for at, (leaf, changed) in enumerate(zip(nodes, rows["tampered"], strict=True)):
            path = _siblings(found, at) + top
            digests.append(_h(*(side for both in path for side in both)))
            node = changed if isinstance(changed, str) else leaf
            for before, after in path:
                node = _h(before, node, after)
            folded.append(node)
            if with_path:
                paths.append([{"before": b, "after": a} for b, a in path])
        out = pd.DataFrame({"doc_id": rows["doc_id"].tolist(), "leaf": nodes, "subroot": above["subroot"].iloc[0], "root": root, "proof_sha256": digests, "folded_root": folded, "verified": [x == root for x in folded]})
        return out.assign(path=paths) if with_path else out

    schema = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", path {PATH}" * with_path
    out = leaves.groupBy("tree", _block(levels)).cogroup(outer.groupBy("tree", "pos")).applyInPandas(finish, schema)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
