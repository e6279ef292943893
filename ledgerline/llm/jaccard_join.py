"""N-gram Jaccard self-join with the chosen-path method.

A text is the set of its word five-grams. Texts with equal sets are one node.

1. In each of ``RUNS`` runs a set chooses the tokens whose hash is below
   ``CHOSEN / size``: sets that choose a token in common fall into its bucket. Two
   sets of similarity 0.8 share 2.4 choices a run on average, so the probability that
   no run has them in a common bucket is under exp(-14). What the sketches below pass
   over comes on top of it and is not part of this bound.
2. Every member of a bucket is compared with the bucket's first by a sketch (the
   smallest hashes). Members that are like the first are connected with it, so that
   pairs of them need nothing else; every other pair of the bucket is compared: all
   at once in a bucket of at most ``BUCKET``, by a prefix filter in a larger one. Two
   sketches that have the share ``LOOSE`` in common have one of their rarest values in
   common, so the filter passes over no pair. A bucket of at most ``IN_TASK`` is one
   task's; a larger one is dealt by these rarest values, and what is still larger in
   pairs of blocks. Sketches let pass everything that can be similar, and leave stars
   of edges, not pairs.
3. Connected candidates are then compared exactly by their whole sets, a component
   of more than ``BLOCK`` sets or ``BLOCK_TOKENS`` tokens in pairs of blocks. Within a
   task sets are in order of size, and those of sizes that can't be similar are not
   compared. Links are counted in the tasks, not listed.

Words are runs of other bytes than ASCII white space. A text of one to four words
has one token, all its words. Null and empty texts have no token and no link.
Repeated rows are copies of each other. Sets are told apart by 64 bits of hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .quality_model import _spans
from .ragged import U64, blocks, from_arrow, gather, mix, prefix_hash, span_hash
from .tables import folded, kept, map_batches, map_groups, unfolded

GRAM, NUMERATOR, DENOMINATOR = 5, 4, 5
RUNS, CHOSEN = 6, 3.0
SKETCH = 64
#: Of SKETCH smallest hashes, the share that two candidates have in common at least (similar sets have 0.8 or
#: more, give or take 0.05).
LOOSE = 0.5
BUCKET = 512
#: Sets and tokens that a component has up to which one task compares it, and sets compared at a time.
BLOCK, BLOCK_TOKENS, STEP = 1_024, 2_000_000, 256
#: Members (of less than 1 KB each) up to which a bucket is compared within one task.
IN_TASK = 20_000
#: Members that a large bucket's others are compared with before the prefix filter, and entries it looks at at a time.
PIVOTS, AT_ONCE = 32, 2_000_000
BLOCK_BYTES = 2_000_000
_SEEDS = np.random.default_rng(97).integers(1, 1 << 63, RUNS, dtype=np.uint64)
_STEP = U64(0x9FB21C651E98DF25)


def token_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct token hashes of every row, one row after the other, and their offsets."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    begin, end = _spans(~((data == 32) | ((data >= 9) & (data <= 13))), offsets)
    word = span_hash(prefix_hash(data), begin, end)
    first = np.searchsorted(begin, offsets)
    count = np.diff(first)
    padded = np.concatenate([word, np.zeros(GRAM, U64)])
    size = np.where(count >= GRAM, count - GRAM + 1, (count > 0).astype(np.int64))
    row = np.repeat(np.arange(n), size)
    at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) + first[row]
    h = np.zeros(len(row), U64)
    for k in range(GRAM):
        h = h * _STEP + np.where(count[row] > k, padded[at + k], U64(0))
    h = mix(h + np.minimum(count[row], GRAM).astype(U64))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(n + 1))


def _lists(values: pa.Array, size: np.ndarray) -> pa.ListArray:
    at = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=at[1:])
    return pa.ListArray.from_arrays(at, values)


def _sum_of(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.zeros(len(values) + 1, U64)
    np.cumsum(values, out=before[1:])
    return before[offsets[1:]] - before[offsets[:-1]]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, _c (content), cid (hash of the set), n, sketch and the tokens chosen in each run, for rows with a token."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        data, offsets = from_arrow(batch.column(1))
        parts = []
        for i, j in blocks(offsets, BLOCK_BYTES):
            h, at = token_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            size = np.diff(at)
            rows = np.flatnonzero(size)
            cid = mix(_sum_of(mix(h ^ U64(0x5851F42D4C957F2D)), at) ^ size.astype(U64))[rows]
            few = np.minimum(size[rows], SKETCH)
            sketch, _ = gather((h >> U64(32)).astype(np.uint32), at[:-1][rows], few)
            owner = np.repeat(np.arange(len(size)), size)
            limit = (CHOSEN / np.maximum(size, 1))[owner]
            chosen = [np.flatnonzero((mix(h ^ s) >> U64(11)).astype(np.float64) * 2.0**-53 < limit) for s in _SEEDS]
            token = np.concatenate([h[c] for c in chosen])
            run, own = np.repeat(np.arange(RUNS), [len(c) for c in chosen]), np.concatenate([owner[c] for c in chosen])
            paths = mix(token + (run + 1).astype(U64) * _STEP)[np.argsort(own, kind="stable")]
            per_row = np.bincount(own, minlength=len(size))[rows]
            take = pa.array(rows + i)
            parts.append(pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(cid.view(np.int64)), pa.array(size[rows].astype(np.int32)), _lists(pa.array(sketch.view(np.int32)), few), _lists(pa.array(paths.view(np.int64)), per_row)], ["doc_id", "_c", "cid", "n", "sketch", "chosen"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0] if sum(p.num_rows for p in parts) else None

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_c"))
    return map_batches(rows, work, "doc_id long, _c long, cid long, n int, sketch array<int>, chosen array<long>")


def _overlap(a: str, b: str) -> Column:
    """Whether two sketches let their sets be similar."""
    common = F.size(F.array_intersect(f"{a}.sketch", f"{b}.sketch"))
    return common >= LOOSE * F.least(F.lit(SKETCH), F.greatest(f"{a}.n", f"{b}.n"))


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(low, pairs[:, 1], root[pairs[:, 0]])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _common_counts(flat: np.ndarray, owner: np.ndarray, n: int, left: int | None = None) -> np.ndarray:
    """How many values each two of n sets have in common, or each of the ``left`` first with each other one; flat holds the sets' values."""
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    use = count[code] > 1
    number = np.cumsum(count > 1) - 1
    column, row = number[code[use]], owner[use]
    rows, columns = (slice(None), slice(None)) if left is None else (slice(left), slice(left, n))
    out = np.zeros((n, n), np.float32)[rows, columns].copy()
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        m = np.zeros((n, 4096), np.float32)
        m[row[a:b], column[a:b] - low] = 1
        out += m[rows] @ m[columns].T
    return out


def _groups(table: pa.Table, key: list[str]) -> list[tuple[int, int]]:
    columns = [np.asarray(table.column(k).combine_chunks()) for k in key]
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    start = np.flatnonzero(new)
    return list(zip(start.tolist(), [*start[1:].tolist(), table.num_rows], strict=True))


class _Members:
    """The members of buckets, with what edges between them have been found."""

    def __init__(self, table: pa.Table) -> None:
        lists = table.column("sketch").combine_chunks()
        self.at, self.flat = np.asarray(lists.offsets), np.asarray(lists.values)
        self.cid, self.size = np.asarray(table.column("cid")), np.asarray(table.column("n"))
        self.found: list[np.ndarray] = []

    def sketches(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        many = self.at[rows + 1] - self.at[rows]
        return gather(self.flat, self.at[rows], many)[0], np.repeat(np.arange(len(rows)), many)

    def star(self, rows: np.ndarray, root: np.ndarray) -> None:
        moved = np.flatnonzero(root != np.arange(len(rows)))
        self.found.append(np.stack([self.cid[rows][moved], self.cid[rows][root[moved]]]))

    def compare(self, rows: np.ndarray) -> None:
        """Stars of edges between rows whose sketches let pass."""
        common = _common_counts(*self.sketches(rows), len(rows))
        of = np.minimum(SKETCH, np.maximum(self.size[rows][:, None], self.size[rows][None, :]))
        pairs = np.argwhere(np.triu(common >= LOOSE * of, 1))
        if len(pairs):
            self.star(rows, _roots(len(rows), pairs))

    def compare_blocks(self, rows: np.ndarray) -> None:
        parts = [rows[k : k + BUCKET] for k in range(0, len(rows), BUCKET)]
        for i, part in enumerate(parts):
            self.compare(part)
            for other in parts[:i]:
                self.compare(np.concatenate([other, part]))

    def compare_many(self, rows: np.ndarray, like: np.ndarray) -> None:
        """As compare, for more rows; those of ``like`` are known to be connected."""
        n, size = len(rows), self.size[rows]
        flat, owner = self.sketches(rows)
        _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
        many = np.bincount(owner, minlength=n)
        start = np.cumsum(many) - many
        root = np.arange(n)
        root[like] = np.flatnonzero(like)[0] if like.any() else 0
        known = root.copy()
        # a few central members, each with all that are like it
        central = np.argsort(-np.bincount(owner, count[code], n), kind="stable")
        alone, seen = ~like, np.zeros(len(count), bool)
        for _ in range(PIVOTS):
            rest = central[alone[central]]
            if not len(rest):
                break
            pivot = rest[0]
            own = code[start[pivot] : start[pivot] + many[pivot]]
            seen[own] = True
            common = np.bincount(owner, seen[code], n)
            seen[own] = False
            near = np.flatnonzero(common >= LOOSE * np.minimum(SKETCH, np.maximum(size, size[pivot])))
            root = _roots(n, np.stack([root[near], np.full(len(near), root[pivot])], 1))[root]
            alone[near] = alone[pivot] = False
        # the rarest values of each row: what has LOOSE in common has one of them in common
        order = np.lexsort((code, count[code], owner))
        ranked = code[order]
        rare = (np.arange(len(owner)) - start[owner] <= (many - np.ceil(LOOSE * many))[owner]) & (count[ranked] > 1)
        value, holder = ranked[rare], owner[rare]
        order = np.lexsort((holder, root[holder], value))
        value, holder = value[order], holder[order]
        # entries lie by value and component: an entry meets what follows its component under the same value
        group = root[holder]
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        begin = np.searchsorted(np.flatnonzero(new), np.arange(len(value)), "right")
        low = np.append(np.flatnonzero(new), len(value))[begin]
        meets = np.searchsorted(value, value, "right") - low
        by_row = np.argsort(holder, kind="stable")
        asks, low, meets = holder[by_row], low[by_row], meets[by_row]
        columns = int((count > 1).sum())
        if meets.sum() * 3e-7 > 1 + n * n * columns * 8e-11:
            self.compare_blocks(rows)
        else:
            table = np.broadcast_to(-1 - np.arange(SKETCH, dtype=np.int32), (n, SKETCH)).copy()
            table[owner, np.arange(len(owner)) - start[owner]] = code
            upto = np.cumsum(meets)
            i = 0
            while i < len(asks):
                j = max(i + 1, int(np.searchsorted(upto, upto[i] - meets[i] + AT_ONCE, "right")))
                other, _ = gather(holder, low[i:j], meets[i:j])
                mine = np.repeat(asks[i:j], meets[i:j])
                apart = root[mine] != root[other]
                pairs = np.unique(np.minimum(mine, other)[apart] * n + np.maximum(mine, other)[apart])
                for k in range(0, len(pairs), 50_000):
                    a, b = np.divmod(pairs[k : k + 50_000], n)
                    apart = root[a] != root[b]
                    a, b = a[apart], b[apart]
                    both = table[b]
                    both = np.concatenate([table[a], np.where(both < 0, both - SKETCH, both)], axis=1)
                    both.sort(axis=1)
                    common = (both[:, 1:] == both[:, :-1]).sum(axis=1)
                    passed = common >= LOOSE * np.minimum(SKETCH, np.maximum(size[a], size[b]))
                    if passed.any():
                        root = _roots(n, np.stack([root[a[passed]], root[b[passed]]], 1))[root]
                i = j
        # a link from each component known before is enough
        ends = np.flatnonzero((root != np.arange(n)) & (known == np.arange(n)))
        self.found.append(np.stack([self.cid[rows][ends], self.cid[rows][root[ends]]]))


def _bucket_edges(table: pa.Table) -> pa.RecordBatch | None:
    """Edges between the members of each bucket (or pair of blocks) that sketches let pass, beside those of ``like`` members."""
    members = _Members(table)
    like = np.asarray(table.column("like")) if "like" in table.column_names else np.zeros(table.num_rows, bool)
    for a, b in _groups(table, ["path", "i", "j"]):
        if b - a > BUCKET:
            members.compare_many(np.arange(a, b), like[a:b])
        elif b - a > 1:
            members.compare(np.arange(a, b))
    if not members.found:
        return None
    u, v = np.concatenate(members.found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])


def _in_blocks(rows: DataFrame, parts: Column) -> DataFrame:
    """Rows of a group of so many blocks, sent to every pair of blocks (i <= j) that they are part of, with their own block."""
    own = rows.withColumns({"own": F.pmod(F.xxhash64("cid"), parts).cast("int"), "other": F.explode(F.sequence(F.lit(0), (parts - 1).cast("int")))})
    return own.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def _rarest(sketches: DataFrame) -> DataFrame:
    """cid, value: the rarest values of each sketch, so many that two sketches with LOOSE in common share one."""
    values = kept(sketches.select("cid", F.explode("sketch").alias("value")), "values")
    counts = values.groupBy("value").agg(F.count("*").alias("c"))
    many = F.size("all")
    ranked = values.join(counts, "value").groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("all"))
    first = F.slice("all", F.lit(1), (many - F.ceil(LOOSE * many) + 1).cast("int"))
    return ranked.select("cid", F.explode(first).alias("e")).filter("e.c > 1").select("cid", F.col("e.value").alias("value"))


def candidate_edges(nodes: DataFrame) -> DataFrame:
    """u, v between nodes(cid, n, sketch, chosen) that may be similar; what is similar is connected."""
    # merge hints: the same plan at every size, so that a small run tells what a large one moves
    sketches = nodes.select("cid", "n", "sketch").hint("merge")
    members = nodes.select("cid", F.explode("chosen").alias("path"))
    buckets = members.groupBy("path").agg(F.count("*").alias("size"), F.min("cid").alias("first")).filter("size > 1").drop("size")
    inside = kept(members.join(buckets, "path").filter("cid <> first"), "members")
    pairs = inside.select("cid", "first").distinct()
    judged = pairs.join(sketches.alias("a"), "cid").join(sketches.withColumnRenamed("cid", "first").alias("b"), "first").filter(_overlap("a", "b")).select("cid", "first")
    judged = kept(judged, "judged")
    marked = kept(inside.join(judged.withColumn("like", F.lit(True)), ["cid", "first"], "left").select("path", "cid", F.coalesce("like", F.lit(False)).alias("like")), "marked")

    def sizes(rows: DataFrame) -> DataFrame:
        """The sizes of groups that have a pair not known to be connected."""
        return rows.groupBy("path").agg(F.count("*").alias("size"), F.count_if(~F.col("like")).alias("unlike")).filter("size > 1 and unlike > 0").drop("unlike")

    size = kept(sizes(marked), "sizes")
    tiles = marked.join(size.filter(F.col("size") <= IN_TASK), "path")
    large = size.filter(F.col("size") > IN_TASK)
    if large.take(1):
        more = kept(marked.join(large.select("path"), "path"), "more")
        dealt = more.join(_rarest(more.select("cid").distinct().join(sketches, "cid")), "cid")
        dealt = kept(dealt.select(F.xxhash64("path", "value").alias("path"), "cid", "like"), "dealt")
        tiles = tiles.unionByName(dealt.join(sizes(dealt), "path"))
    # what is not whole goes in pairs of blocks that fit a task
    parts = F.when(F.col("size") <= IN_TASK, 1).otherwise(F.ceil(F.col("size") / max(IN_TASK // 2, 1)))
    tiles = _in_blocks(tiles, parts).join(sketches, "cid").select("path", "i", "j", "cid", "n", "sketch", "like")
    found = kept(map_groups(tiles, ["path", "i", "j"], _bucket_edges, "u long, v long"), "found")
    return judged.select(F.col("cid").alias("u"), F.col("first").alias("v")).unionByName(found)


def _exact_links(table: pa.Table) -> pa.RecordBatch | None:
    """For members of a component's block pair with a link in it: the copies linked to, and the smallest member connected."""
    lists = table.column("tokens").combine_chunks()
    at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    cid, own, copies = (np.asarray(table.column(c)) for c in ("cid", "own", "copies"))
    found = []
    for a, b in _groups(table, ["component", "i", "j"]):
        n = b - a
        if n < 2:
            continue
        size = np.diff(at[a : b + 1])
        counted, root = np.zeros(n, np.int64), np.arange(n)
        two = own[a:b].min() != own[a:b].max()  # pairs within one block are another task's
        order = np.lexsort((size, own[a:b]))
        cuts = np.searchsorted(own[a:b][order], [own[a:b].max()]) if two else []
        steps = [part[k : k + STEP] for part in np.split(order, cuts) for k in range(0, len(part), STEP)]
        for y, right in enumerate(steps):
            for left in steps[: y + 1]:
                if two and own[a + left[0]] == own[a + right[0]]:
                    continue
                low, high = (left, right) if size[left[0]] <= size[right[0]] else (right, left)
                if DENOMINATOR * size[low[-1]] < NUMERATOR * size[high[0]]:
                    continue
                same = left is right
                rows = left if same else np.concatenate([left, right])
                tokens, ends = gather(flat, at[a + rows], size[rows])
                owner = np.repeat(np.arange(len(rows)), np.diff(ends))
                common = np.rint(_common_counts(tokens, owner, len(rows), None if same else len(left))).astype(np.int64)
                similar = DENOMINATOR * common >= NUMERATOR * (size[left][:, None] + size[right][None, :] - common)
                if same:
                    np.fill_diagonal(similar, False)
                counted[left] += similar @ copies[a + right]
                if not same:
                    counted[right] += similar.T @ copies[a + left]
                x, z = np.nonzero(similar)
                tied = np.unique(root[left[x]] * n + root[right[z]])
                root = _roots(n, np.stack(np.divmod(tied, n), 1))[root]
        some = np.flatnonzero(counted)
        if len(some):
            found.append((cid[a:b][some], counted[some], cid[a:b][root[some]]))
    if not found:
        return None
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[c] for f in found])) for c in range(3)], ["cid", "links", "root"])


def _token_lists(docs: DataFrame) -> DataFrame:
    """The columns of docs but text, and the row's set."""
    names = [c for c in docs.columns if c != "text"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(0))
        parts = []
        for i, j in blocks(offsets, BLOCK_BYTES):
            h, at = token_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            parts.append(_lists(pa.array(h.view(np.int64)), np.diff(at)))
        return pa.RecordBatch.from_arrays([*batch.columns[1:], pa.concat_arrays(parts)], [*names, "tokens"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return map_batches(docs.select("text", *names), work, f"{fields}, tokens array<long>")


def links(docs: DataFrame) -> DataFrame:
    """doc_id, _c, class_id, n_links, set_id of every row of docs(doc_id, text, ...).

    class_id is the smallest doc_id of the texts that links connect, n_links the
    number of other documents of similarity 0.8 or more, copies included; set_id is
    the smallest doc_id of the texts with the same set. Without an id, they are null.
    """
    rows = kept(described(docs), "sets")
    nodes = kept(rows.groupBy("cid").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("chosen").alias("chosen"), F.count("*").alias("copies"), F.min(F.struct("doc_id", "_c")).alias("one"), F.min("doc_id").alias("set_id")), "nodes")
    parts = components(candidate_edges(nodes)).withColumnRenamed("node", "cid")
    near = kept(nodes.select("cid", "copies", "one", "n").join(parts, "cid"), "near")
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_TOKENS))
    near = near.join(near.groupBy("component").agg(parts.alias("parts")), "component")
    texts = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_c")).alias("one"), "text")
    by_id = F.col("t.one.doc_id").eqNullSafe(F.col("w.one.doc_id")) & (F.col("t.one._c") == F.col("w.one._c"))
    sets = _token_lists(texts.alias("t").join(near.alias("w").hint("merge"), by_id).select("text", "cid", "copies", "component", "parts").dropDuplicates(["cid"]))
    tiles = _in_blocks(sets, F.col("parts")).select("component", "i", "j", "cid", "own", "copies", "tokens")
    found = kept(map_groups(tiles, ["component", "i", "j"], _exact_links, "cid long, links long, root long", rows=2_000), "links")
    many = near.filter("parts > 1").select("cid")
    if many.take(1):  # a class can reach over several block pairs
        wide = found.join(many, "cid")
        linked = components(wide.select(F.col("cid").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("cid"), F.col("component").alias("root2"))
        found = found.join(linked, "cid", "left").withColumn("root", F.coalesce("root2", "root")).drop("root2")
    per_set = found.groupBy("cid").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    placed = nodes.select("cid", "copies", "set_id").join(per_set, "cid", "left").select("cid", "copies", "set_id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "cid").alias("root"))
    placed = kept(placed, "placed")
    classes = placed.groupBy("root").agg(F.min("set_id").alias("class_id"))
    facts = placed.join(classes, "root").select("cid", "set_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    joined = rows.select("doc_id", "_c", "cid").join(facts.hint("merge"), "cid").select("doc_id", "_c", "class_id", "n_links", "set_id")
    bare = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_c"), "text").filter(~F.coalesce("text", F.lit("")).rlike("[^\\x20\\x09-\\x0D]"))
    return joined.unionByName(bare.select("doc_id", "_c", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("set_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of every class of docs the row with the smallest doc_id; rows without any word, or without an id, all stay."""
    found = links(docs).filter(F.col("class_id").isNull() | (F.col("doc_id") == F.col("class_id"))).select("doc_id", "_c").distinct()
    rows = folded(docs, "doc_id", "text").withColumn("_c", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r._c") == F.col("f._c"))
    return unfolded(rows.alias("r").join(found.alias("f"), same, "left_semi").dropDuplicates(["doc_id", "_c"]), docs, "doc_id", "text")
