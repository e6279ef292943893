"""Best-two-fit packing of tokenised documents into sequences.

Documents longer than a sequence are cut so that only the first piece is short.
Pieces are dealt by hash into groups of bounded size and each group is packed on
its own, so no task sees more than a group; a group leaves at most a few bins
that are not full. Within a group a bin takes the longest piece left, then the
longest that fits, and so on; then its smallest piece is replaced by two unpacked
pieces whenever two exist that fill the widened gap more tightly.

Null texts are empty documents: they are one piece, the end id alone. Copies are
packed like other rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .ragged import from_arrow
from .tables import kept, map_batches

#: Pieces in a group, about; the last bins of a group are all that it can waste.
GROUP_PIECES = 30_000


def pieces(docs: DataFrame, path: str, end_id: int, size: int, style: str = "byte") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs(doc_id, text, ...)."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(1))
        ids, at = encoder(path, style).encode(data, offsets)
        total = np.diff(at) + 1
        n = -(-total // size)
        row = np.repeat(np.arange(len(n)), n)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        short = total - (n - 1) * size
        start = np.where(piece == 0, 0, short[row] + (piece - 1) * size)
        length = np.where(piece == 0, short[row], size)
        raw = ids.astype("<u4").tobytes()
        tail = np.array([end_id], "<u4").tobytes()
        first = at[row] + start
        last = np.minimum(first + length, at[row + 1])
        ends = piece == n[row] - 1
        crc = [zlib.crc32(tail, c) if e else c for a, b, e in zip(first.tolist(), last.tolist(), ends.tolist(), strict=True) for c in (zlib.crc32(raw[4 * a : 4 * b]),)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"]
        )

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of every piece and its place there."""
    waiting: list[list[int]] = [[] for _ in range(size + 1)]
    for i, n in enumerate(lengths.tolist()):
        waiting[n].append(i)
    ahead = back = 0  # bit n of ahead, bit size - n of back: a piece of length n waits
    for n in range(1, size + 1):
        if waiting[n]:
            ahead |= 1 << n
            back |= 1 << (size - n)

    def take(n: int) -> int:
        nonlocal ahead, back
        i = waiting[n].pop()
        if not waiting[n]:
            ahead &= ~(1 << n)
            back &= ~(1 << (size - n))
        return i

    def put(n: int, i: int) -> None:
        nonlocal ahead, back
        waiting[n].append(i)
        ahead |= 1 << n
        back |= 1 << (size - n)

    def best_pair(room: int, least: int) -> tuple[int, int] | None:
        for total in range(room, least, -1):
            found = ahead & (back >> (size - total)) & ((1 << total) - 2)
            if total % 2 == 0 and found >> (total // 2) & 1 and len(waiting[total // 2]) < 2:
                found &= ~(1 << (total // 2))
            if found:
                a = found.bit_length() - 1
                return a, total - a
        return None

    bins, places, k = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    while ahead:
        inside, gap = [], size
        while fits := ahead & ((2 << gap) - 1):
            n = fits.bit_length() - 1
            inside.append((n, take(n)))
            gap -= n
        while gap and inside:
            smallest = min(range(len(inside)), key=lambda j: inside[j][0])
            n, i = inside[smallest]
            pair = best_pair(gap + n, n)
            if not pair:
                break
            inside.pop(smallest)
            inside += [(m, take(m)) for m in pair]
            put(n, i)
            gap += n - sum(pair)
        at = 0
        for n, i in inside:
            bins[i], places[i] = k, at
            at += n
        k += 1
    return bins, places


def packed(docs: DataFrame, path: str, end_id: int = 2, size: int = 1024, style: str = "byte") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs(doc_id, text, ...)."""
    cut = kept(pieces(docs, path, end_id, size, style), "pieces")
    groups = max(1, round(cut.count() / GROUP_PIECES))
    dealt = cut.withColumn("pack", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "length", "ids_crc32"], kind="stable")
        bins, places = best_two_fit(rows["length"].to_numpy(), size)
        return rows.drop(columns="pack").assign(sequence_id=bins + (rows["pack"].to_numpy(np.int64) << 32), offset=places)

    return dealt.groupBy("pack").applyInPandas(pack, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
