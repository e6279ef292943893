"""Removal of repeated byte strings with sparse suffix arrays.

Every byte that lies in a string of ``length`` bytes which also starts elsewhere
(in any document, the same one included) is removed. All strings are judged on
the input.

A full suffix array of a corpus is not needed for this. Each window of ``length``
bytes has a content-defined place: the smallest hash of its ``length / 4``-byte
grams. Equal windows have it at equal offsets, so it is enough to sort suffixes
at these places (about one in 150 bytes at 400), and only where the gram itself repeats.

1. Places with a gram that no other place has are dropped (hashes, counted natively).
2. Places whose whole context is alike (all bytes that any window on the place can
   see) form a class. Of each class two places are cut out, or its only one.
3. The contexts of a gram are sorted: the bytes to the right of the place as
   suffixes, those to the left as reversed prefixes. Deep-shallow sorting: multikey
   quicksort over the first bytes, then blind tries for groups with long common
   prefixes. A window repeats if another context falls into its class in both
   orders, as the common prefixes of neighbours tell. This alone decides what is
   removed; hashes only choose what is compared, and carry the verdict to the other
   members of a class.
4. A gram of more than ``together`` contexts does not fit a task. Its windows are
   halved by their offset, and each half is grouped by all the bytes that its windows
   have in common: by the next bytes beside the gram. Halves that are still too
   large are halved again; windows of one offset are equal, so this ends (a context is in one
   part for each of its offsets at most). The same sort then goes on in the parts.
5. The repeated intervals of a document are merged and cut out.

Null texts are empty; nothing is removed from texts shorter than ``length``. Equal
texts, repeated rows among them, are copies of each other whatever their doc_id.
A task holds some thousand contexts of under ``2 * length`` bytes, or the places of
one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ragged import U64, blocks, from_arrow, gather, mix, powers, prefix_hash, span_hash
from .tables import dropped, folded, kept, map_batches, unfolded

LENGTH = 400
#: Contexts of a group that are sorted together at most.
TOGETHER = 16_384
SHALLOW_BYTES = 32
BLOCK_BYTES = 1_000_000
SORT_ROWS = 20_000
#: Contexts that are halved at a time.
HALVED_ROWS = 2_000


def _sliding(values: np.ndarray, width: int, of: np.ufunc, fill) -> np.ndarray:
    """min or max over all runs of width values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, fill, values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = of.accumulate(rows, axis=1).ravel()
    back = of.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[: n - width + 1], ahead[width - 1 : n])


def places(data: np.ndarray, windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined places of the windows that are marked by their starts; the hashes of their grams, and a prefix hash."""
    gram = length // 4
    width = length - gram + 1
    prefix = prefix_hash(data)
    _, down = powers(len(prefix))
    m = len(data) - gram + 1
    h = mix((prefix[gram:] - prefix[:-gram]) * down[:m])
    h[h == 0] = 1
    least = _sliding(h, width, np.minimum, np.iinfo(np.uint64).max)
    least[~windows] = 0
    none = np.zeros(width - 1, np.uint64)
    chosen = _sliding(np.concatenate([none, least, none]), width, np.maximum, 0) == h
    at = np.flatnonzero(chosen)
    return at, h[at], prefix


def _anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, ranges: tuple[int, int] | None = None):
    """row, place, gram hash, context hash, bytes of context to the left and right; for windows that start in ranges."""
    reach = length - length // 4
    marks = np.zeros(len(data) - length + 2, np.int32)
    begin, end = offsets[:-1], np.maximum(offsets[:-1], offsets[1:] - length + 1)
    if ranges:
        begin, end = np.maximum(begin, ranges[0]), np.minimum(end, ranges[1])
    some = end > begin
    np.add.at(marks, begin[some], 1)
    np.add.at(marks, end[some], -1)
    at, gram, prefix = places(data, np.cumsum(marks[:-1]) > 0, length)
    row = np.searchsorted(offsets, at, "right") - 1
    left, right = np.minimum(reach, at - offsets[row]), np.minimum(length, offsets[row + 1] - at)
    context = mix(span_hash(prefix, at - left, at + right) + left.astype(U64) * U64(0x9E3779B97F4A7C15) + right.astype(U64))
    return row, at - offsets[row], gram, context, left, right


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple]:
    """Anchors of whole rows, a block at a time; very long rows in overlapping pieces."""
    for i, j in blocks(offsets, BLOCK_BYTES):
        a, b = offsets[i], offsets[j]
        if b - a < length:
            continue
        if b - a <= 2 * BLOCK_BYTES:
            row, *rest = _anchors_of(data[a:b], offsets[i : j + 1] - a, length)
            yield (row + i, *rest)
            continue
        found: dict[int, tuple] = {}
        for s in range(0, b - a, BLOCK_BYTES):
            low, high = max(0, s - length), min(b - a, s + BLOCK_BYTES + 3 * length)
            if high - low < length:
                continue
            # a piece's own ends cut contexts only of places whose windows start outside the piece's range
            row, at, gram, context, left, right = _anchors_of(data[a + low : a + high], np.array([0, high - low]), length, (s - low, s - low + BLOCK_BYTES))
            for k, p in enumerate((at + low).tolist()):
                found[p] = (gram[k], context[k], left[k], right[k])
        at = np.array(sorted(found), np.int64)
        rest = [np.array([found[p][c] for p in at.tolist()]) for c in range(4)]
        yield (np.full(len(at), i), at, *rest)


class BlindTrie:
    """Strings of one length by the bytes that branch; the bytes between are only looked at once, against one leaf."""

    def __init__(self) -> None:
        self.root: list | None = None

    def insert(self, text: bytes, number: int) -> None:
        leaf = [text, [number]]
        if self.root is None:
            self.root = leaf
            return
        node = self.root
        while isinstance(node[0], int):
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        if (different := int.from_bytes(text, "big") ^ int.from_bytes(node[0], "big")) == 0:
            node[1].append(number)
            return
        common = len(text) - (different.bit_length() + 7) // 8
        old = node[0]
        node, above = self.root, None
        while isinstance(node[0], int) and node[0] < common:
            above, node = node, node[1][text[node[0]]]
        if isinstance(node[0], int) and node[0] == common:
            node[1][text[common]] = leaf
            return
        fork = [common, {old[common]: node, text[common]: leaf}]
        if above is None:
            self.root = fork
        else:
            above[1][text[above[0]]] = fork

    def ordered(self) -> list[int]:
        out: list[int] = []
        stack = [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if isinstance(node[0], int):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                out += node[1]
        return out


def deep_shallow(rows: np.ndarray) -> np.ndarray:
    """The order of byte strings of one length, given as the rows of a matrix."""
    depth_end = min(SHALLOW_BYTES, rows.shape[1]) // 8
    words = np.ascontiguousarray(rows[:, : 8 * depth_end]).view(">u8").astype(np.uint64).reshape(len(rows), depth_end)
    order = np.arange(len(rows))
    stack = [(0, len(rows), 0)]
    while stack:
        low, high, depth = stack.pop()
        if high - low < 2:
            continue
        part = order[low:high]
        if depth == depth_end:
            trie = BlindTrie()
            for i in part.tolist():
                trie.insert(rows[i].tobytes(), i)
            order[low:high] = trie.ordered()
            continue
        symbol = words[part, depth]
        pivot = np.sort(symbol[[0, len(symbol) // 2, -1]])[1]
        less, more = symbol < pivot, symbol > pivot
        a, b = low + int(less.sum()), high - int(more.sum())
        order[low:high] = np.concatenate([part[less], part[~less & ~more], part[more]])
        stack += [(low, a, depth), (a, b, depth + 1), (b, high, depth)]
    return order


def _common(rows: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that neighbours in the order have in common."""
    if len(order) < 2:
        return np.zeros(0, np.int64)
    differ = rows[order[1:]] != rows[order[:-1]]
    return np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])


def repeated_reach(left: np.ndarray, left_length: np.ndarray, right: np.ndarray, right_length: np.ndarray, length: int, group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each context the smallest and largest offset of its place in a window that another context of its group shares, or -1.

    left holds the bytes before the places, nearest first, right those from the places
    on; both padded with zeros. Offsets from low to high are looked at.
    """
    n = len(left)
    orders = [deep_shallow(left), deep_shallow(right)]
    commons = [_common(left, orders[0]), _common(right, orders[1])]
    least, most = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    low, high = np.maximum(low, length - right_length), np.minimum(high, left_length)

    def classes(side: int, depth: int) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[orders[side][1:]] = np.cumsum(commons[side] < depth)
        return out

    for d in range(int(low.min(initial=0)), int(high.max(initial=-1)) + 1):
        valid = np.flatnonzero((low <= d) & (d <= high))
        if len(valid) < 2:
            continue
        both = (group[valid] * n + classes(1, length - d)[valid]) * n + classes(0, d)[valid]
        at = np.argsort(both)
        same = both[at][1:] == both[at][:-1]
        hit = valid[at[np.append(same, False) | np.append(False, same)]]
        most[hit] = d
        least[hit] = np.where(least[hit] < 0, d, least[hit])
    return least, most


def _matrix(column: pa.Array, width: int, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = from_arrow(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.uint8)
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(data)) - np.repeat(offsets[:-1], size)
    out[row, np.repeat(size, size) - 1 - at if backwards else at] = data
    return out, size


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("_k")


def repeated_intervals(docs: DataFrame, length: int = LENGTH, together: int = TOGETHER) -> DataFrame:
    """_k (a text's key), start, end: intervals that cover just the bytes to be removed; they overlap."""
    keyed = docs.select(_key(F.col("text")), "text").filter(F.octet_length("text") >= length)

    def find(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        parts = list(anchors(*from_arrow(batch.column(1)), length))
        if not parts:
            return None
        row, at, gram, context = (np.concatenate([p[c] for p in parts]) for c in range(4))
        return pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), batch.column(0).take(pa.array(row)), pa.array(at.astype(np.int32))], ["gram", "context", "_k", "at"])

    found = kept(map_batches(keyed, find, "gram long, context long, _k long, at int"), "anchors")
    # written first: a join with a finished table can split a gram that very many places share
    grams = kept(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "grams")
    shared = kept(found.join(grams, "gram", "left_semi"), "shared")
    dropped(found)
    ends = [f(c).alias(a) for f, c, a in ((F.min, "_k", "k1"), (F.max, "_k", "k2"))] + [F.min_by("at", "_k").alias("a1"), F.max_by("at", "_k").alias("a2")]
    classes = shared.groupBy("gram", "context").agg(F.count("*").alias("n"), *ends)
    two = F.array(F.struct(F.col("k1").alias("_k"), F.col("a1").alias("at")), F.struct(F.col("k2").alias("_k"), F.col("a2").alias("at")))
    wanted = classes.select("gram", "context", F.explode(F.slice(two, F.lit(1), F.least("n", F.lit(2)).cast("int"))).alias("p")).select("gram", "context", "p.*")
    # as many wanted places as a text has bytes at most, about one in 100
    by_text = wanted.groupBy("_k").agg(F.collect_list(F.struct("gram", "context", "at")).alias("wanted"))
    with_text = keyed.groupBy("_k").agg(F.first("text").alias("text")).join(by_text, "_k").select("text", "wanted")
    reach = length - length // 4

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(0))
        lists = batch.column(1)
        row = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(lists.offsets)))
        inner = lists.flatten()
        at = np.asarray(inner.field("at")) + offsets[row]
        low, high = np.maximum(at - reach, offsets[row]), np.minimum(at + length, offsets[row + 1])
        n = len(at)
        return pa.RecordBatch.from_arrays(
            [inner.field("gram"), inner.field("context"), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, reach, np.int32)), _binary(data, low, at), _binary(data, at, high)],
            _CONTEXT,
        )

    cuts = kept(map_batches(with_text, cut, _COLUMNS), "cuts")
    reaches = _sorted_out(cuts, length, together)
    return shared.join(reaches, (F.col("gram") == F.col("key")) & (F.col("context") == F.col("u"))).select("_k", (F.col("at") - F.col("most")).cast("long").alias("start"), (F.col("at") - F.col("least") + length).cast("long").alias("end"))


#: Contexts: their group, their class in it, the offsets to look at, the bytes before the place and from it on.
_CONTEXT = ["key", "u", "low", "high", "l", "r"]
_COLUMNS = "key long, u long, low int, high int, l binary, r binary"


def _binary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    flat, at = gather(data, start, end - start)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(flat))]).cast(pa.binary())


def _sorted_out(rows: DataFrame, length: int, together: int) -> DataFrame:
    """key, u, least, most: the offsets at which classes of contexts repeat.

    Windows of the least and the most offset overlap, so what is between them is repeated too.
    """
    # windows of one offset are equal: two of them, which nothing can halve
    sizes = rows.filter("low < high").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > together)
    crowded = kept(sizes.select("key"), "crowded")
    if not crowded.take(1):
        return _sorted_in_tasks(rows, length)
    fits, large = rows.join(crowded, "key", "left_anti"), rows.join(crowded, "key", "left_semi")
    parts = kept(large.mapInArrow(lambda batches: (_halves(b.slice(k, HALVED_ROWS), length) for b in batches for k in range(0, b.num_rows, HALVED_ROWS)), f"{_COLUMNS}, of_key long, of_u long"), "halves")
    least, most = ([f(c, F.struct("of_key", "of_u")).alias(c) for c in ("l", "r")] for f in (F.min_by, F.max_by))
    one, other = (parts.groupBy("key", "u", "low", "high").agg(*ends, F.count("*").alias("n")) for ends in (least, most))
    children = kept(one.drop("n").unionByName(other.filter("n > 1").drop("n")).select(*_CONTEXT), "classes")
    of = parts.select("key", "u", "of_key", "of_u").distinct()
    found = _sorted_out(children, length, together).join(of, ["key", "u"]).groupBy(F.col("of_key").alias("key"), F.col("of_u").alias("u")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return kept(_sorted_in_tasks(fits, length).unionByName(found), "reaches")


def _halves(batch: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """Each context twice: for the lower and the upper half of its offsets, grouped by what all windows of the half share."""
    before, l_at = from_arrow(batch.column(4))
    after, r_at = from_arrow(batch.column(5))
    n, left, right = batch.num_rows, np.diff(l_at), np.diff(r_at)
    # one array of whole contexts; place is where the gram begins
    data = np.concatenate([np.concatenate([before[l_at[i] : l_at[i + 1]], after[r_at[i] : r_at[i + 1]]]) for i in range(n)]) if n else before
    place = np.cumsum(left + right) - right
    prefix = prefix_hash(data)
    low, high, key, u = (np.asarray(batch.column(c)) for c in (2, 3, 0, 1))
    middle = (low + high) // 2
    out = []
    for a, b in ((low, middle), (middle + 1, high)):
        some = np.flatnonzero((a <= b) & (left >= a) & (right >= length - b) & (np.minimum(b, left) >= np.maximum(a, length - right)))
        a, b, p = a[some].astype(np.int64), b[some].astype(np.int64), place[some]
        start, end = p - np.minimum(b, left[some]), p + np.minimum(length - a, right[some])
        group = mix(span_hash(prefix, p - a, p + length - b) + (a * 4096 + b).astype(U64) * U64(0x9E3779B97F4A7C15))
        whole = mix(span_hash(prefix, start, end) + (p - start).astype(U64) * U64(0x9E3779B97F4A7C15) + (end - p).astype(U64))
        out.append([pa.array(group.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), _binary(data, start, p), _binary(data, p, end), pa.array(key[some]), pa.array(u[some])])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*out, strict=True)], [*_CONTEXT, "of_key", "of_u"])


def _sorted_in_tasks(rows: DataFrame, length: int) -> DataFrame:
    """The same for groups that fit a task; those of about ``SORT_ROWS`` contexts are sorted at once."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < SORT_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = np.asarray(table.column("key"))
            end = int(np.flatnonzero(np.append(key[1:] != key[:-1], False)).max(initial=-1)) + 1
            if end:
                yield work(table.slice(0, end))
                table = table.slice(end)
            held, n = table.to_batches(), table.num_rows
        if n:
            yield work(pa.Table.from_batches(held).combine_chunks())

    def work(table: pa.Table) -> pa.RecordBatch:
        key, u, low, high = (np.asarray(table.column(c)) for c in _CONTEXT[:4])
        left, l_size = _matrix(table.column("l").combine_chunks(), length - length // 4, True)
        right, r_size = _matrix(table.column("r").combine_chunks(), length, False)
        group = np.cumsum(np.append(False, key[1:] != key[:-1]))
        least, most = repeated_reach(left, l_size, right, r_size, length, group, low, high)
        use = np.flatnonzero(most >= 0)
        use = use[np.unique(np.stack([group[use], u[use]]), axis=1, return_index=True)[1]]  # one of each class
        return pa.RecordBatch.from_arrays([pa.array(x[use]) for x in (key, u, least, most)], ["key", "u", "least", "most"])

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(sort, "key long, u long, least long, most long")


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > ends[:-1])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _with_runs(docs: DataFrame, length: int, columns: list[str]) -> DataFrame:
    # as many intervals as a text has places, about one in 100 bytes
    intervals = repeated_intervals(docs, length).groupBy("_k").agg(F.collect_list(F.struct("start", "end")).alias("_runs"))
    return docs.select(*columns, _key(F.col("text"))).join(intervals, "_k", "left").select(*columns, "_runs")


def _runs(batch: pa.RecordBatch, at: int) -> list[tuple[np.ndarray, np.ndarray]]:
    lists = batch.column(at)
    size = np.asarray(lists.value_lengths().fill_null(0))
    inner = lists.flatten()
    starts, ends = np.asarray(inner.field("start")), np.asarray(inner.field("end"))
    cuts = np.cumsum(size)[:-1]
    return [merged(a, b) for a, b in zip(np.split(starts, cuts), np.split(ends, cuts), strict=True)]


def _rest(text: bytes, runs: tuple[np.ndarray, np.ndarray]) -> bytes:
    starts, ends = runs
    return b"".join(text[a:b] for a, b in zip([0, *ends.tolist()], [*starts.tolist(), len(text)], strict=True))


def removals(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans of every row of docs(doc_id, text, ...)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(1))
        raw, runs = data.tobytes(), _runs(batch, 2)
        kept_ = [hashlib.sha256(_rest(raw[a:b], r)).hexdigest() for a, b, r in zip(offsets[:-1].tolist(), offsets[1:].tolist(), runs, strict=True)]
        spans = [[{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)] for s, e in runs]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array([int((e - s).sum()) for s, e in runs], pa.int64()), pa.array([len(s) for s, _ in runs], pa.int64()), pa.array(kept_, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )

    return map_batches(_with_runs(docs, length, ["doc_id", "text"]), work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut from text, characters that are only partly covered kept; n_chars follows.

    Rows keep all their columns; a text of which nothing is left is the empty string, a null text stays null.
    """
    rows = folded(docs, "doc_id", "text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(1))
        raw, runs, texts = data.tobytes(), _runs(batch, 3), []
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        lead = np.append(lead, len(data))
        for k, (s, e) in enumerate(runs):
            a, b = int(offsets[k]), int(offsets[k + 1])
            s, e = lead[np.searchsorted(lead, s + a)] - a, lead[np.searchsorted(lead, e + a, "right") - 1] - a
            texts.append(_rest(raw[a:b], (s[s < e], e[s < e])).decode())
        texts = pa.array(texts, pa.string(), mask=np.asarray(batch.column(1).is_null()))
        return pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2)], ["doc_id", "text", "_rest"])

    out = map_batches(_with_runs(rows, length, ["doc_id", "text", "_rest"]), work, rows.schema)
    return unfolded(out, docs, "doc_id", "text", n_chars=F.length("text").cast("long"))
