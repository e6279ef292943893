"""BPE encoding with content-defined chunk reuse, and decoding.

A rolling hash over 16 bytes cuts texts into chunks, so passages that documents share give
the same chunks wherever they lie. Chunks are counted over all documents by their hashes (8
bytes for about 512); those that come more than once are encoded once, into a table, and
their ids are joined back to the texts that have them. What is met once is encoded where it
lies. Only texts with shared chunks are moved: two bitmaps of ``BITS`` bits, of their keys
and of the shared hashes, tell tasks which ones they are (a full bitmap moves more, and
changes no result).

Near a cut a chunk's own tokens can differ from the text's; so each join is
encoded anew, between two safe places: changes from something else to white
space. The window reaches one safe place further than it must on either side,
and the ids there have to be those of the chunks. If they are not, the window
grows to the whole text, which is exact. (They always are: none of the splitter's
alternatives has white space after another character, so a pre-token ends at each
safe place whatever precedes it, and what begins there depends on nothing before
it. The comparison finds it out if a file's splitter is another one.) Chunks
without a safe place fall wholly into the window.

Null texts count as empty. Stretches of a text that the splitter doesn't cover go
to the tokenizers library as they are (see ``bpe``).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bpe import SPACE, Encoder, classes, in_parts, pretokens
from .ragged import U64, blocks, from_arrow, gather, prefix_hash, span_hash
from .tables import kept, map_batches
from .token_counts import byte_symbols

WINDOW = 16
#: A cut comes once in so many bytes on average; a power of two.
MEAN_CHUNK = 512
#: Bytes of distinct chunks that a worker remembers before it starts afresh.
REMEMBERED_BYTES = 4_000_000
#: Bytes of texts whose arrays are held at a time, about 70 bytes for each.
BLOCK_BYTES = 500_000
#: Bytes of texts that are encoded at a time with the ids that are given for them.
SLICE_BYTES = 4_000_000
#: Bits of a bitmap of shared chunks or of texts that have some: 8 MB, whatever the corpus.
BITS = 1 << 26


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and hash of the chunks of rows."""
    n = len(data)
    prefix = prefix_hash(data)
    at = np.zeros(n + 1, bool)
    place = np.arange(WINDOW, n)
    at[WINDOW:n] = (span_hash(prefix, place - WINDOW, place) & U64(MEAN_CHUNK - 1)) == 0
    at[:n] &= (data & 0xC0) != 0x80
    at[offsets] = True
    start = np.flatnonzero(at)[:-1]
    length = np.diff(np.append(start, n))
    return start, length, span_hash(prefix, start, start + length)


class ChunkEncoder:
    def __init__(self, path: str) -> None:
        self.words = Encoder(path, "byte")
        with open(path, encoding="utf-8") as f:
            loaded = json.load(f)
        back = {c: b for b, c in enumerate(byte_symbols())}
        pieces = {i: bytes(back[c] for c in s) for s, i in loaded["model"]["vocab"].items()}
        pieces |= {t["id"]: t["content"].encode() for t in loaded["added_tokens"]}
        ordered = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.piece_bytes = np.frombuffer(b"".join(ordered), np.uint8)
        self.piece_length = np.array(list(map(len, ordered)), np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.decimal = [str(i) for i in range(len(ordered))]
        self.id_type = np.dtype("<u2" if len(ordered) <= 1 << 16 else "<u4")
        self.forget()

    def forget(self) -> None:
        self.row: dict[int, int] = {}
        self.bytes_held = 0
        self.ids: list[np.ndarray] = []
        self.facts: list[np.ndarray] = []  # start among ids, number, first and last safe place, ids before either; the same four of the second and the last but one
        self.n_ids = 0
        self.given: dict[int, bool] = {}  # chunks that came with their ids, and whether they have been compared

    def give(self, hashes: list[int], ids: list[bytes], facts: np.ndarray) -> None:
        """Take over chunks that have been encoded elsewhere, until forget."""
        new = list({h: k for k, h in enumerate(hashes) if h not in self.row}.values())
        if not new:
            return
        held = [np.frombuffer(ids[k], self.id_type).astype(np.uint32) for k in new]
        counts = np.array(list(map(len, held)), np.int64)
        self.facts.append(np.concatenate([(self.n_ids + np.cumsum(counts) - counts)[None, :], facts[new].T]))
        self.ids.append(np.concatenate(held))
        self.n_ids += int(counts.sum())
        self.row.update(zip([hashes[k] for k in new], range(len(self.row), len(self.row) + len(new)), strict=True))
        self.given.update(dict.fromkeys((hashes[k] for k in new), False))

    def _test(self, keys: list[int], data: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        """Forget the given ids of a chunk that stand for other bytes: two chunks have one hash."""
        for k, h in enumerate(keys):
            if self.given.get(h) is False:
                if len(self.facts) > 1:
                    self.facts, self.ids = [np.concatenate(self.facts, axis=1)], [np.concatenate(self.ids)]
                first, count = self.facts[0][:2, self.row[h]]
                if self._bytes(self.ids[0][first : first + count]) == data[start[k] : start[k] + length[k]].tobytes():
                    self.given[h] = True
                else:
                    # its place stays, so that the others keep theirs
                    self.row[-1 - h] = self.row.pop(h)
                    del self.given[h]

    def _bytes(self, ids: np.ndarray) -> bytes:
        return gather(self.piece_bytes, self.piece_start[ids], self.piece_length[ids])[0].tobytes()

    def learned(self, chunks: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """The ids of chunks as bytes, and what give() has to know of each."""
        self.forget()
        data, length = np.frombuffer(b"".join(chunks), np.uint8), np.array(list(map(len, chunks)), np.int64)
        self._learn(data, classes(data), np.cumsum(length) - length, length)
        start, count = self.facts[0][:2]
        ids = [self.ids[0][a : a + n].astype(self.id_type).tobytes() for a, n in zip(start.tolist(), count.tolist(), strict=True)]
        facts = self.facts[0][1:].T
        self.forget()
        return ids, facts

    def _learn(self, data: np.ndarray, kind: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
        text, offsets = gather(data, start, length)
        kinds, _ = gather(kind, start, length)
        ids, at = self._ids_at(text, offsets, kinds)
        safe = np.flatnonzero((kinds[1:] == SPACE) & (kinds[:-1] != SPACE)) + 1
        safe = safe[~np.isin(safe, offsets)]
        low, high = np.searchsorted(safe, offsets[:-1]), np.searchsorted(safe, offsets[1:])
        has = high > low
        inner = (low, high - 1, np.minimum(low + 1, high - 1), np.maximum(high - 2, low))
        ends = [np.where(has, safe[np.clip(i, 0, len(safe) - 1)] if len(safe) else 0, offsets[:-1]) for i in inner]
        base = at(offsets[:-1])
        places, before = [np.where(has, e - offsets[:-1], -1) for e in ends], [at(e) - base for e in ends]
        self.facts.append(np.stack([self.n_ids + base, at(offsets[1:]) - base, *places[:2], *before[:2], *places[2:], *before[2:]]))
        self.ids.append(ids)
        self.n_ids += len(ids)

    def _ids_at(self, data, offsets, kind):
        """Ids of rows, and a function from places that are pre-token starts to the number of ids before them."""
        begin, _ = pretokens(data, offsets, kind, "byte")
        ids, at = self.words._plain(data, np.append(begin, len(data)), kind) if len(begin) else (np.zeros(0, np.uint32), np.zeros(1, np.int64))
        return ids, lambda places: at[np.searchsorted(begin, places)]

    def _block(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        start, length, hashes = cut(data, offsets)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if self.bytes_held + n > REMEMBERED_BYTES and not self.given:
            self.forget()
        keys = distinct.tolist()
        self._test(keys, data, start[where], length[where])
        new = [i for i, h in enumerate(keys) if h not in self.row]
        if new:
            at = where[new]
            self._learn(data, kind, start[at], length[at])
            self.row.update(zip([keys[i] for i in new], range(len(self.row), len(self.row) + len(new)), strict=True))
            self.bytes_held += int(length[at].sum())
        if len(self.facts) > 1:
            self.facts, self.ids = [np.concatenate(self.facts, axis=1)], [np.concatenate(self.ids)]
        rows = np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))[inverse]
        base, total, first, last, before_first, before_last, second, penult, before_second, before_penult = self.facts[0][:, rows]
        is_first, is_last = np.isin(start, offsets), np.isin(start + length, offsets)
        low = np.where(is_first, start, start + first)
        high = np.where(is_last, start + length, start + last)
        low = np.where(is_last & ~is_first & (first < 0), start + length, low)
        high = np.where(is_first & ~is_last & (first < 0), start, high)
        id_low = np.where(is_first, 0, np.where(first < 0, total, before_first))
        id_high = np.where(is_last, total, np.where(first < 0, 0, before_last))
        use = is_first | is_last | (first >= 0)
        # what a window reaches beyond the safe places: bytes and ids of the chunks before and after it
        reach = [np.where(is_last, 0, last - penult), np.where(is_last, 0, before_last - before_penult), second - first, before_second - before_first]
        low, high, id_low, id_high, base, is_last, own_first, own_penult, *reach = (x[use] for x in (low, high, id_low, id_high, base, is_last, before_first, before_penult, *reach))
        back, n_back, ahead, n_ahead = reach[0], reach[1], *(np.where(is_last, 0, np.append(x[1:], 0)) for x in reach[2:])
        gap_end = np.where(is_last, high, np.append(low[1:], n))
        begin, end = high - back, gap_end + ahead
        gaps, gap_offsets = gather(data, begin, end - begin)
        gap_kind, _ = gather(kind, begin, end - begin)
        gap_ids, gap_at = self._rows(gaps, gap_offsets, gap_kind)
        apart = np.diff(gap_at) < n_back + n_ahead
        if apart.any():
            n_back, n_ahead = np.where(apart, 0, n_back), np.where(apart, 0, n_ahead)
        for at, own, count in ((gap_at[:-1], base + own_penult, n_back), (gap_at[1:] - n_ahead, np.append(base[1:] + own_first[1:], 0), n_ahead)):
            differ = gather(gap_ids, at, count)[0] != gather(self.ids[0], own, count)[0]
            apart |= np.bincount(np.repeat(np.arange(len(count)), count)[differ], minlength=len(count)) > 0
        pool = np.concatenate([self.ids[0], gap_ids])
        starts = np.stack([base + id_low, len(self.ids[0]) + gap_at[:-1] + n_back], axis=1).ravel()
        counts = np.stack([id_high - id_low, np.diff(gap_at) - n_back - n_ahead], axis=1).ravel()
        ids, at = gather(pool, starts, counts)
        ends = np.zeros(len(offsets), np.int64)
        closed = np.cumsum(is_last)
        filled = np.flatnonzero(np.diff(offsets) > 0)
        last_use = np.searchsorted(closed, np.arange(1, len(filled) + 1))
        ends[filled + 1] = at[2 * (last_use + 1)]
        ends = np.maximum.accumulate(ends)
        return self._grown(ids, ends, data, offsets, kind, np.unique(np.searchsorted(offsets, high[apart], "left") - 1)) if apart.any() else (ids, ends)

    def _grown(self, ids: np.ndarray, ends: np.ndarray, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same ids, but those of some rows encoded as a whole."""
        parts = np.split(ids, ends[1:-1])
        for r in rows.tolist():
            a, b = offsets[r], offsets[r + 1]
            parts[r] = self._rows(data[a:b], np.array([0, b - a]), kind[a:b])[0]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _rows(self, data, offsets, kind):
        """Ids of rows of which some may be empty."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        ids, at = self._ids_at(data, offsets[np.append(True, np.diff(offsets) > 0)], kind)
        return ids, at(offsets)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """The ids of every row."""
        out: list[np.ndarray] = []
        for i, j in blocks(offsets, BLOCK_BYTES):
            a, b = offsets[i], offsets[j]
            ids, ends = in_parts(data[a:b], offsets[i : j + 1] - a, self._block, self.words.whole)
            out += np.split(ids, ends[1:-1])
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text that ids stand for; bytes that are no text become the replacement character."""
        return self._bytes(ids).decode(errors="replace").encode()

    def digest(self, ids: np.ndarray) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids.tolist())).encode()).hexdigest()


_encoders: dict[str, ChunkEncoder] = {}


def chunk_encoder(path: str) -> ChunkEncoder:
    """This worker's encoder of a file."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _release() -> None:
    """Give back what Arrow keeps of batches that are done, which is more than one batch takes."""
    pa.default_memory_pool().release_unused()


def lean_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """map_batches for workers that have to stay small."""

    def lean(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        _release()
        return work(batch)

    return map_batches(df, lean, schema)


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")


def _bitmap(keys: DataFrame, name: str) -> np.ndarray:
    """BITS bits, of which those of the keys are set; at most BITS / 8 bytes come to the driver."""
    place = F.col(name).bitwiseAND(BITS - 1)
    parts = keys.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits")).collect()
    out = np.zeros(max(BITS >> 15, 1) << 12, np.uint8)
    for r in parts:
        out[r.part << 12 : (r.part + 1) << 12] = np.frombuffer(r.bits, np.uint8)
    return out


def _set(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in a bitmap."""
    place = keys.view(np.int64) & (8 * len(bits) - 1)
    return (bits[place >> 3] >> (place & 7) & 1).astype(bool)


def chunk_counts(docs: DataFrame) -> DataFrame:
    """k, h, n: the chunks of each text, by keys and hashes, and how often it has them in all rows."""

    def none(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, U64), np.zeros(len(texts), np.int64)

    def plain(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, U64), np.zeros(len(offsets), np.int64)
        start, _, hashes = cut(data, offsets)
        return hashes, np.searchsorted(start, offsets)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(1))
        keys = np.asarray(batch.column(0))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i, j in blocks(offsets, BLOCK_BYTES):
            hashes, ends = in_parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], plain, none)
            row = np.repeat(np.arange(i, j), np.diff(ends))
            order = np.lexsort((hashes, row))
            hashes, row = hashes[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])])) if len(row) else np.zeros(0, np.int64)
            out.append((keys[row[first]], hashes[first].view(np.int64), np.diff(np.append(first, len(row)))))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, ["k", "h", "n"])

    return lean_batches(docs.select(_text_key(), "text"), work, "k long, h long, n long").groupBy("k", "h").agg(F.sum("n").alias("n"))


def shared_chunks(docs: DataFrame, path: str) -> tuple[DataFrame, np.ndarray]:
    """k, chunks: for each text with shared chunks their hashes, ids and facts; and the bitmap of those texts' keys.

    A chunk is shared if it comes more than once in all rows, in one text or in several.
    """
    counts = kept(chunk_counts(docs), "chunk_counts")
    shared = kept(counts.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "shared")
    wanted = kept(counts.join(shared, "h").select("k", "h"), "wanted")
    texts_with, hashes_of = _bitmap(wanted, "k"), _bitmap(shared, "h")
    held = docs.sparkSession.sparkContext.broadcast((texts_with, hashes_of))

    def none(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            taken: list[tuple[int, bytes]] = []

            def plain(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                if len(data):
                    start, length, hashes = cut(data, offsets)
                    for c in np.flatnonzero(_set(held.value[1], hashes)).tolist():
                        h = int(hashes[c].view(np.int64))
                        if h not in seen:
                            seen.add(h)
                            taken.append((h, data[start[c] : start[c] + length[c]].tobytes()))
                return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)

            _release()
            if len(seen) > 200_000:
                seen.clear()
            rows = batch.filter(pa.array(_set(held.value[0], np.asarray(batch.column(0)))))
            data, offsets = from_arrow(rows.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                in_parts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], plain, none)
            if taken:
                yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in taken], pa.int64()), pa.array([c for _, c in taken], pa.binary())], ["h", "chunk"])

    each = docs.select(_text_key(), "text").mapInArrow(found, "h long, chunk binary").groupBy("h").agg(F.min("chunk").alias("chunk")).join(shared, "h", "left_semi")

    def learn(batch: pa.RecordBatch) -> pa.RecordBatch:
        coder, chunks = chunk_encoder(path), batch.column(1)
        parts = [coder.learned(chunks.slice(i, j - i).to_pylist()) for i, j in blocks(from_arrow(chunks)[1], BLOCK_BYTES)]
        ids, facts = [x for p, _ in parts for x in p], np.concatenate([f for _, f in parts])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(facts.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["h", "ids", "facts"])

    once = kept(lean_batches(each, learn, "h long, ids binary, facts array<int>"), "chunks")
    return wanted.join(once, "h").groupBy("k").agg(F.collect_list(F.struct("h", "ids", "facts")).alias("chunks")), texts_with


def _with_ids(docs: DataFrame, path: str, result: Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``result`` makes of the doc_ids and ids of docs' rows."""
    lists, bits = shared_chunks(docs, path)
    held = docs.sparkSession.sparkContext.broadcast(bits)
    rows = docs.select(_text_key(), "doc_id", "text")

    def in_slices(batch: pa.RecordBatch, text: int, work: Callable[[pa.RecordBatch, ChunkEncoder], pa.RecordBatch]) -> pa.RecordBatch | None:
        """work for so many rows at a time as have SLICE_BYTES: a batch of long texts and their ids takes little memory."""
        coder, out = chunk_encoder(path), []
        for i, j in blocks(from_arrow(batch.column(text))[1], SLICE_BYTES):
            out.append(work(batch.slice(i, j - i), coder))
        return pa.Table.from_batches(out).combine_chunks().to_batches()[0] if out else None

    def alone(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        batch = batch.filter(pa.array(~_set(held.value, np.asarray(batch.column(0)))))
        return in_slices(batch, 2, lambda part, coder: result(part.column(1), coder.encode(*from_arrow(part.column(2)))))

    def moved(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(_set(held.value, np.asarray(batch.column(0)))))

    def together(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        def work(part: pa.RecordBatch, coder: ChunkEncoder) -> pa.RecordBatch:
            coder.forget()  # what is given lasts for one slice
            given = part.column(2).flatten()
            if len(given):
                coder.give(given.field("h").to_numpy(zero_copy_only=False).view(U64).tolist(), given.field("ids").to_pylist(), np.asarray(given.field("facts").flatten(), dtype=np.int64).reshape(len(given), -1))
            out = result(part.column(0), coder.encode(*from_arrow(part.column(1))))
            coder.forget()
            return out

        return in_slices(batch, 1, work)

    lone = lean_batches(rows, alone, schema)
    with_lists = lean_batches(rows, moved, rows.schema).join(lists, "k", "left").select("doc_id", "text", F.coalesce("chunks", F.array().cast(lists.schema["chunks"].dataType)).alias("chunks"))
    return lone.unionByName(lean_batches(with_lists, together, schema))


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of every row of docs(doc_id, text, ...)."""

    def result(doc_ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        at = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=at[1:])
        return pa.RecordBatch.from_arrays([doc_ids, pa.ListArray.from_arrays(at, pa.array(np.concatenate(rows).astype(np.int32)))], ["doc_id", "ids"])

    return _with_ids(docs, path, result, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, comma between) and of the text decoded from them."""

    def result(doc_ids: pa.Array, rows: list[np.ndarray]) -> pa.RecordBatch:
        coder = chunk_encoder(path)
        return pa.RecordBatch.from_arrays(
            [doc_ids, pa.array([len(r) for r in rows], pa.int64()), pa.array(map(coder.digest, rows), pa.string()), pa.array([hashlib.sha256(coder.decode(r)).hexdigest() for r in rows], pa.string())],
            ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    return _with_ids(docs, path, result, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
