"""Token ids as wavelet matrices.

Documents are sorted by doc_id over range partitions and encoded there; every run
of about ``SHARD_TOKENS`` ids becomes one shard: for each bit of an id, from the
highest, a plane of bits in the order that the stable 0/1 partition by the planes
above leaves, with a rank directory. A shard answers access, count and occurrence
queries from its own bytes and can be decoded whole. Shards are rows of Parquet
files in a folder that all executors share; each has its documents' ids and lengths.

Null texts count as empty: their only id is the end id. Rows with equal doc_id
come in the order of a hash of their texts, so that many of them spread over
partitions; a null doc_id comes first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .ragged import blocks, from_arrow
from .tables import map_batches, shared_path

SHARD_TOKENS = 1 << 20
BLOCK_BITS = 512
_HEADER = struct.Struct("<4sQI")
_MAGIC = b"WVM1"


class WaveletMatrix:
    """A sequence of ids below 2**levels."""

    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]) -> None:
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @staticmethod
    def build(ids: np.ndarray, levels: int) -> WaveletMatrix:
        rest, planes, ranks, zeros = ids.astype(np.uint32 if levels > 16 else np.uint16), [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (rest >> level) & 1 == 1
            planes.append(np.packbits(bit, bitorder="little"))
            ranks.append(WaveletMatrix._directory(planes[-1]))
            low = rest[~bit]
            zeros.append(len(low))
            rest = np.concatenate([low, rest[bit]])
        return WaveletMatrix(len(ids), np.array(zeros, np.uint64), planes, ranks)

    @staticmethod
    def _directory(plane: np.ndarray) -> np.ndarray:
        """Ones before each block of BLOCK_BITS bits."""
        step = BLOCK_BITS // 8
        padded = np.zeros(-(-len(plane) // step) * step, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, step // 8).sum(axis=1, dtype=np.uint32)
        return np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])

    def to_bytes(self) -> bytes:
        return b"".join([_HEADER.pack(_MAGIC, self.n, len(self.planes)), self.zeros.astype("<u8").tobytes(), *(x.tobytes() for p, r in zip(self.planes, self.ranks, strict=True) for x in (p, r.astype("<u4")))])

    @staticmethod
    def from_bytes(raw: bytes) -> WaveletMatrix:
        magic, n, levels = _HEADER.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not a wavelet matrix")
        at, size = _HEADER.size, -(-n // 8)
        blocks_ = -(-size // (BLOCK_BITS // 8)) + 1
        zeros, planes, ranks = np.frombuffer(raw, "<u8", levels, at), [], []
        at += 8 * levels
        for _ in range(levels):
            planes.append(np.frombuffer(raw, np.uint8, size, at))
            ranks.append(np.frombuffer(raw, "<u4", blocks_, at + size))
            at += size + 4 * blocks_
        return WaveletMatrix(n, zeros, planes, ranks)

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, inside = divmod(i, BLOCK_BITS)
        from_ = block * BLOCK_BITS // 8
        bits = np.unpackbits(self.planes[level][from_ : from_ + BLOCK_BITS // 8], bitorder="little")[:inside]
        return int(self.ranks[level][block]) + int(bits.sum())

    def access(self, i: int) -> int:
        """The id at place i."""
        out = 0
        for level, zeros in enumerate(self.zeros.tolist()):
            bit = int(self.planes[level][i >> 3]) >> (i & 7) & 1
            out = out << 1 | bit
            ones = self._ones(level, i)
            i = zeros + ones if bit else i - ones
        return out

    def _range(self, symbol: int, i: int) -> tuple[int, int]:
        low, high, levels = 0, i, len(self.planes)
        for level, zeros in enumerate(self.zeros.tolist()):
            a, b = self._ones(level, low), self._ones(level, high)
            low, high = (zeros + a, zeros + b) if symbol >> (levels - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def rank(self, symbol: int, i: int) -> int:
        """How often symbol is among the first i ids."""
        low, high = self._range(symbol, i)
        return high - low

    def count(self, symbol: int) -> int:
        return self.rank(symbol, self.n)

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th symbol, from 0."""
        low, high = self._range(symbol, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        i, levels = low + k, len(self.planes)
        for level in range(levels - 1, -1, -1):
            one = symbol >> (levels - 1 - level) & 1
            i = self._select_bit(level, one, i - int(self.zeros[level]) if one else i)
        return i

    def _select_bit(self, level: int, bit: int, k: int) -> int:
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK_BITS - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        from_ = block * BLOCK_BITS // 8
        bits = np.unpackbits(self.planes[level][from_ : from_ + BLOCK_BITS // 8], bitorder="little")
        return block * BLOCK_BITS + int(np.flatnonzero(bits == bit)[k - int(before[block])])

    def occurrences(self, symbol: int) -> list[int]:
        """All places of symbol."""
        return [self.select(symbol, k) for k in range(self.count(symbol))]

    def decode(self) -> np.ndarray:
        """All ids."""
        rest = np.zeros(self.n, np.uint32 if len(self.planes) > 16 else np.uint16)
        for level in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            zeros = int(self.zeros[level])
            out = np.empty_like(rest)
            out[~bit] = rest[:zeros]
            out[bit] = rest[zeros:]
            out |= bit.astype(rest.dtype) << (len(self.planes) - 1 - level)
            rest = out
        return rest


def write_shards(docs: DataFrame, path: str, end_id: int, to: str, style: str = "word") -> None:
    """Encode docs(doc_id, text, ...) and write the shards to a folder."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, style)
        part, shard, start = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []
        size = 0

        def closed() -> pa.RecordBatch:
            nonlocal held, size, shard, start
            ids, lengths = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            doc_ids = pa.concat_arrays([h[0] for h in held])
            one = pa.array([0, len(doc_ids)], pa.int32())
            matrix = WaveletMatrix.build(ids, levels).to_bytes()
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([start]), pa.array([len(ids)]), pa.ListArray.from_arrays(one, doc_ids), pa.ListArray.from_arrays(one, pa.array(lengths)), pa.array([matrix])],
                ["part", "shard", "start", "n_tokens", "doc_ids", "lengths", "matrix"],
            )
            held, size, shard, start = [], 0, shard + 1, start + len(ids)
            return out

        levels = max(1, max(coder.tokenizer.get_vocab_size() - 1, end_id).bit_length())
        for batch in batches:
            data, offsets = from_arrow(batch.column(1))
            for i, j in blocks(offsets, 1 << 21):
                ids, at = coder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = np.diff(at)
                with_ends = np.full(len(ids) + len(n), end_id, np.uint32)
                with_ends[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids
                held.append((batch.column(0).slice(i, j - i), with_ends, n + 1))
                size += len(with_ends)
                if size >= SHARD_TOKENS:
                    yield closed()
        if held:
            yield closed()

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_c"))
    ordered = rows.repartitionByRange("doc_id", "_c").sortWithinPartitions("doc_id", "_c")
    shards = ordered.mapInArrow(encode, "part int, shard int, start long, n_tokens long, doc_ids array<long>, lengths array<long>, matrix binary")
    shards.write.option("compression", "zstd").parquet(to)


def read_shards(spark, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in a folder of shards."""
    shards = spark.read.parquet(folder)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition that wrote
    before = shards.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.coalesce(F.sum("all").over(w), F.lit(0)).alias("before"))
    placed = shards.join(before, "part").select((F.col("start") + F.col("before")).alias("start"), "doc_ids", "lengths", "matrix")

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids, starts, lengths, crcs = [], [], [], []
        for k in range(batch.num_rows):
            raw = WaveletMatrix.from_bytes(batch.column(3)[k].as_py()).decode().astype("<u4").tobytes()
            n = np.array(batch.column(2)[k].values)
            at = np.concatenate([[0], np.cumsum(n)])
            doc_ids.append(batch.column(1)[k].values)
            lengths.append(n)
            starts.append(batch.column(0)[k].as_py() + at[:-1])
            crcs += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(doc_ids), pa.array(np.concatenate(starts)), pa.array(np.concatenate(lengths)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(placed, decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def written_and_read(docs: DataFrame, path: str, end_id: int = 1, style: str = "word") -> DataFrame:
    """Encode, write, and read back from the files."""
    folder = shared_path(docs.sparkSession, "wavelet")
    write_shards(docs, path, end_id, folder, style)
    return read_shards(docs.sparkSession, folder)
