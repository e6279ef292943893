"""A factorisation machine that scores the quality of texts.

Inputs are hashed words (L2-normalised counts), structure statistics of the text
and its length as metadata. Pairwise interactions have rank ``RANK`` and are
summed in time linear in the inputs: half of, for each factor, the square of the
sum less the sum of squares. The model is fitted on at most ``TRAIN_ROWS``
labelled documents, the ones with the smallest hash of their id, and sent to the
executors (about 1.2 MB whatever the corpus); scoring is per row.

Null texts are scored as empty. Rows without a label, with a null label, or held
out take no part in the fit; without any labelled row all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .ragged import blocks, from_arrow, prefix_hash, span_hash
from .tables import folded, map_batches, unfolded

WORD_BITS, RANK = 15, 8
#: Labelled documents that the fit uses at most.
TRAIN_ROWS = 10_000
#: Passes over the rows, and steps that are taken at least where the rows are few.
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 8, 400, 128, 0.02, 1e-5
BLOCK_BYTES = 2_000_000
STATISTICS = ("symbols", "upper", "digits", "marks", "exclaims", "high_bytes", "log_bytes", "log_words", "word_length", "distinct_words", "same_as_previous", "lines", "repeated_lines", "bias")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    before = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=before[1:])
    return (before[offsets[1:]] - before[offsets[:-1]]).astype(np.float64)


def _spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of inside, cut at row starts."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


@dataclass
class Features:
    """Rows of hashed word weights (offsets, bucket, value) and of statistics."""

    offsets: np.ndarray
    bucket: np.ndarray
    value: np.ndarray
    statistics: np.ndarray


def features(data: np.ndarray, offsets: np.ndarray) -> Features:
    n = len(offsets) - 1
    space = (data == 32) | ((data >= 9) & (data <= 13))
    prefix = prefix_hash(data)
    begin, end = _spans(~space, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
    row = np.searchsorted(offsets, begin, "right") - 1
    word = span_hash(prefix, begin, end)
    bucket = (word >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    same = np.bincount(row[1:][(word[1:] == word[:-1]) & (row[1:] == row[:-1])], minlength=n)
    key, count = np.unique(row << WORD_BITS | bucket, return_counts=True)
    owner = key >> WORD_BITS
    norm = np.sqrt(np.bincount(owner, count.astype(np.float64) ** 2, n))
    value = (count / norm[owner]).astype(np.float32) if len(key) else np.zeros(0, np.float32)
    at = np.searchsorted(owner, np.arange(n + 1))
    size, n_words = np.diff(offsets).astype(np.float64), np.bincount(row, minlength=n).astype(np.float64)
    line_begin, line_end = _spans(data != 10, offsets) if len(data) else (np.zeros(0, np.int64),) * 2
    line_row = np.searchsorted(offsets, line_begin, "right") - 1
    n_lines = np.bincount(line_row, minlength=n).astype(np.float64)
    order = np.lexsort((span_hash(prefix, line_begin, line_end), line_row))
    hashes, rows = span_hash(prefix, line_begin, line_end)[order], line_row[order]
    again = np.bincount(rows[1:][(hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])], minlength=n) if len(order) else np.zeros(n)
    letters = ((data | 32) >= 97) & ((data | 32) <= 122)
    share = lambda mask: _sums(mask, offsets) / np.maximum(size, 1)
    columns = [
        10 * share(np.isin(data, np.frombuffer(b"#*$%&|<>", np.uint8))),
        2 * share((data >= 65) & (data <= 90)),
        5 * share((data >= 48) & (data <= 57)),
        5 * share((data > 32) & (data < 127) & ~letters),
        10 * share(data == 33),
        share(data >= 128),
        np.log1p(size) / 10,
        np.log1p(n_words) / 10,
        np.minimum(size / np.maximum(n_words, 1), 40) / 10,
        np.diff(at) / np.maximum(n_words, 1),
        3 * same / np.maximum(n_words, 1),
        np.minimum(n_lines / np.maximum(n_words, 1), 1),
        again / np.maximum(n_lines, 1),
        np.ones(n),
    ]
    return Features(at, key & ((1 << WORD_BITS) - 1), value, np.clip(np.stack(columns, axis=1), -3, 3).astype(np.float32))


@dataclass
class Machine:
    """Weights and factors of words and statistics; column 0 is the linear weight."""

    words: np.ndarray
    statistics: np.ndarray

    @staticmethod
    def untrained() -> Machine:
        return Machine(np.zeros((1 << WORD_BITS, 1 + RANK), np.float32), np.zeros((len(STATISTICS), 1 + RANK), np.float32))

    def margins(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """The margins, and the factor sums that they come from."""
        n = len(x.offsets) - 1
        weighted = self.words[x.bucket] * x.value[:, None]
        squares = np.concatenate([weighted, (weighted[:, 1:] ** 2).sum(axis=1, keepdims=True)], axis=1)
        sums = np.zeros((n, 2 + RANK), np.float32)
        full = np.flatnonzero(np.diff(x.offsets) > 0)
        if len(full):
            sums[full] = np.add.reduceat(squares, x.offsets[full], axis=0)
        linear = sums[:, 0] + x.statistics @ self.statistics[:, 0]
        factors = sums[:, 1:-1] + x.statistics @ self.statistics[:, 1:]
        squared = sums[:, -1] + (x.statistics**2) @ (self.statistics[:, 1:] ** 2).sum(axis=1)
        return linear + 0.5 * ((factors**2).sum(axis=1) - squared), factors

    def scores(self, x: Features) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x)[0].astype(np.float64), -30, 30)))


def fit(rows: list[Features], labels: np.ndarray, seed: int = 11) -> Machine:
    """Adam on the logistic loss; rows are one-document features."""
    model = Machine.untrained()
    if not len(rows) or labels.min() == labels.max():
        return model
    rng = np.random.default_rng(seed)
    model.words[:, 1:] = rng.normal(0, 0.02, (1 << WORD_BITS, RANK))
    model.statistics[:, 1:] = rng.normal(0, 0.05, (len(STATISTICS), RANK))
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (model.words, model.statistics)]
    step = 0
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // max(len(rows), BATCH))):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            part = [rows[k] for k in order[i : i + BATCH]]
            x = Features(np.concatenate([[0], np.cumsum([len(r.bucket) for r in part])]), np.concatenate([r.bucket for r in part]), np.concatenate([r.value for r in part]), np.concatenate([r.statistics for r in part]))
            margin, factors = model.margins(x)
            error = ((1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[order[i : i + BATCH]]) / len(part)).astype(np.float32)
            owner = np.repeat(np.arange(len(part)), np.diff(x.offsets))
            by_word = error[owner] * x.value
            slopes = [np.zeros_like(model.words), np.zeros_like(model.statistics)]
            inner = np.concatenate([by_word[:, None], by_word[:, None] * (factors[owner] - model.words[x.bucket, 1:] * x.value[:, None])], axis=1)
            np.add.at(slopes[0], x.bucket, inner)
            slopes[1][:, 0] = error @ x.statistics
            slopes[1][:, 1:] = x.statistics.T @ (error[:, None] * factors) - (error @ x.statistics**2)[:, None] * model.statistics[:, 1:]
            step += 1
            for p, g, (m, v) in zip((model.words, model.statistics), slopes, moments, strict=True):
                g += DECAY * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, target: str = "quality", rows: int = TRAIN_ROWS) -> Machine:
    """Fit on the labelled documents that are not held out."""
    known = labels.select("doc_id", F.col(target).cast("int").alias("_y")).filter(F.col("_y").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(rows)  # bounded, so it can be broadcast

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(1))
        parts = []
        for i, j in blocks(offsets, BLOCK_BYTES):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            at = pa.array(x.offsets.astype(np.int32))
            stats = pa.FixedSizeListArray.from_arrays(pa.array(x.statistics.ravel()), len(STATISTICS)).cast(pa.list_(pa.float32()))
            parts.append([pa.ListArray.from_arrays(at, pa.array(x.bucket.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(x.value)), stats])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.concat_arrays, zip(*parts, strict=True))], ["doc_id", "_y", "bucket", "value", "stats"])

    # of rows that share an id the smallest text, so the sample stays bounded
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text")).select("doc_id", "text", "_y")
    rows_of = map_batches(chosen, work, "doc_id long, _y int, bucket array<int>, value array<float>, stats array<float>")

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        model = Machine.untrained()
        if tables:
            found = pa.Table.from_batches(tables).combine_chunks().sort_by([("doc_id", "ascending"), ("_y", "ascending")])
            bucket, value, stats = (found.column(c).combine_chunks() for c in ("bucket", "value", "stats"))
            one = lambda a, i, t: np.asarray(a[i].values, dtype=t)
            per_row = [Features(np.array([0, len(bucket[i])]), one(bucket, i, np.int64), one(value, i, np.float32), one(stats, i, np.float32)[None, :]) for i in range(found.num_rows)]
            model = fit(per_row, np.asarray(found.column("_y"), dtype=np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([model.words.astype("<f4").tobytes()]), pa.array([model.statistics.astype("<f4").tobytes()])], ["words", "statistics"])

    # the sample is bounded, so one task fits the model; only its weights come to the driver
    found = rows_of.repartition(1).mapInArrow(learn, "words binary, statistics binary").first()
    return Machine(*(np.frombuffer(x, "<f4").reshape(-1, 1 + RANK) for x in found))


def scored(rows: DataFrame, model: Machine) -> DataFrame:
    """rows(text, …) with _score."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns
    at = names.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(at))
        out = np.zeros(batch.num_rows)
        for i, j in blocks(offsets, BLOCK_BYTES):
            out[i:j] = held.value.scores(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "_score"])

    return map_batches(rows, work, StructType([*rows.schema.fields, StructField("_score", DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text, ...)."""
    out = scored(docs.select("doc_id", "text"), train(docs, labels)).drop("text")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= threshold, 1).otherwise(0).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the model predicts to be good, with the columns of docs."""
    return unfolded(scored(folded(docs, "text"), train(docs, labels)).filter(F.col("_score") >= threshold), docs, "text")
