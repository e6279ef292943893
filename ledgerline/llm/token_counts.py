"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a block of texts are held as one ragged numpy array of
symbols. In each round every sequence merges all places of its own lowest-rank
pair at once; a sequence without a mergeable pair leaves with the number of its
surviving symbols. Work is per row; nothing is shuffled.

Null texts count as empty (0 bytes, 0 tokens). Stretches with characters that the
splitter doesn't cover are split by the tokenizers library, but merged here; a
special token in a text is one token.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import BLOCK_BYTES, REMEMBERED, Encoder, in_parts, pretokens
from .ragged import blocks, from_arrow, gather, prefix_hash, span_hash
from .tables import map_batches

_NEVER = np.int32(2**31 - 1)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairMerger:
    """The merges of a byte-level BPE file as sorted arrays."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.rank = order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.uint64)[order]
        self.byte = np.array([vocab[c] for c in byte_symbols()], np.uint64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left << np.uint64(32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], _NEVER), at

    def count(self, data: np.ndarray, length: np.ndarray) -> np.ndarray:
        """How many symbols of each sequence survive; data holds the sequences one after the other."""
        symbols, length = self.byte[data], length.astype(np.int64)
        left, owner = length.copy(), np.arange(len(length))
        rank, at = np.full(len(symbols), _NEVER), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            rank[:-1], at[:-1] = self._ranks(symbols[:-1], symbols[1:])
        rank[np.cumsum(length) - 1] = _NEVER
        while len(length):
            start = np.cumsum(length) - length
            best = np.minimum.reduceat(rank, start)
            hit = (rank == np.repeat(best, length)) & (rank != _NEVER)
            follows = hit[1:] & hit[:-1]
            if follows.any():  # of pairs that overlap, every second one
                fresh = hit.copy()
                fresh[1:] &= ~hit[:-1]
                place = np.arange(len(hit))
                since = place - np.maximum.accumulate(np.where(fresh, place, 0))
                hit &= since % 2 == 0
            symbols[hit] = self.made[at[hit]]
            keep = np.repeat(best != _NEVER, length)
            keep[1:] &= ~hit[:-1]
            length = length - np.add.reduceat(hit, start, dtype=np.int64)
            left[owner] = length
            alive = best != _NEVER
            length, owner = length[alive], owner[alive]
            symbols, rank, at, hit = symbols[keep], rank[keep], at[keep], hit[keep]
            if not len(length):
                break
            end = np.cumsum(length) - 1
            near = hit.copy()
            near[:-1] |= hit[1:]
            changed = np.flatnonzero(near)
            rank[changed] = _NEVER
            inner = changed[changed + 1 < len(symbols)]
            rank[inner], at[inner] = self._ranks(symbols[inner], symbols[inner + 1])
            rank[end] = _NEVER
        return left


class Counter:
    def __init__(self, path: str) -> None:
        self.merger, self.library = PairMerger(path), Encoder(path, "byte").tokenizer
        special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special)) or "(?!)")
        self.known: dict[int, int] = {}

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in blocks(offsets, BLOCK_BYTES):
            a, b = offsets[i], offsets[j]
            out[i:j] = self._block(data[a:b], offsets[i : j + 1] - a)
        return out

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The tokens of every row: as many as the pre-tokens' counts add up to."""
        counts, at = in_parts(data, offsets, self._plain, self._other)
        before = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=before[1:])
        return before[at[1:]] - before[at[:-1]]

    def _plain(self, data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begin, end = pretokens(data, offsets, kind, "byte")
        return self._merged(data, begin, end), np.searchsorted(begin, offsets)

    def _merged(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The tokens of each pre-token."""
        if not len(begin):
            return np.zeros(0, np.int64)
        distinct, where, inverse = np.unique(span_hash(prefix_hash(data), begin, end), return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > REMEMBERED:
            self.known.clear()
        keys = distinct.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            at = where[new]
            words, _ = gather(data, begin[at], (end - begin)[at])
            self.known.update(zip([keys[i] for i in new], self.merger.count(words, (end - begin)[at]).tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[inverse]

    def _other(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of the parts of each text (pre-tokens, and its special tokens together), and how many parts it has."""
        sizes, parts, specials, merged = [], [], [], []
        for text in texts:
            between = self.special.split(text.decode())
            merged += [t.encode() for t in between]
            split = [len(piece) for t in between for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(t)]  # a character stands for a byte
            sizes += split
            parts.append(len(split) + 1)
            specials.append(len(between) - 1)
        end = np.cumsum(np.array(sizes, np.int64))
        counts = self._merged(np.frombuffer(b"".join(merged), np.uint8), end - np.array(sizes, np.int64), end)
        many = np.array(parts, np.int64)
        return np.insert(counts, np.cumsum(many - 1), specials), many


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """This worker's counter of a file."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row of docs(doc_id, text, ...); other columns are ignored."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(1))
        n = counter(path).count(data, offsets)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return map_batches(docs.select("doc_id", "text"), work, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
