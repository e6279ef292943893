"""Language identification with string kernels.

The kernel of two texts is the blended spectrum in its presence form: the distinct byte
n-grams of one to ``LONGEST`` bytes that both have, over the root of the product of their
numbers of them (letter case of ASCII, digits and white space are evened out; n-grams are
hashed to ``1 << BITS`` buckets). A Nyström map takes a text's kernels with ``LANDMARKS``
fitted texts to coordinates; kernel ridge regression on them, one language against the
rest, gives weights. Both are one matrix, so scoring a block of texts is a product of its
presence matrix with that of the landmarks, and of the result with the weights.

Up to ``PER_LANGUAGE`` texts of each language, those with the smallest hashes of their
doc_ids, and ``TRAIN_ROWS`` in all, are fitted in one task; the model (about a
megabyte whatever the corpus) is sent to the executors. Scoring covers whole texts.

Null texts and texts without a letter are ``und`` with score 0, as is every text if no
document has a language to learn. Of rows that share a doc_id and language the smallest
text is learned. Empty tables give no rows; other columns don't count.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .ragged import blocks, from_arrow
from .tables import map_batches

LONGEST, BITS, LANDMARKS = 4, 15, 128
PER_LANGUAGE, TRAIN_ROWS = 400, 20_000
RIDGE = 1e-4
#: A block of texts ends at so many rows or bytes; a longer text is cut at no place, only its n-grams are taken so many bytes at a time.
BLOCK_ROWS, BLOCK_BYTES = 64, 1 << 20
UNKNOWN = "und"


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _evened() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64)
    table[65:91] += 32
    table[48:58] = 48
    table[9:14] = 32
    return table


_EVEN = _evened()


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of zeros and ones for each text: the buckets of its n-grams."""
    n = len(offsets) - 1
    out = np.zeros((n, 1 << BITS), np.float32)
    flat, shift = out.reshape(-1), np.uint64(64 - BITS)
    for i, j in blocks(offsets, BLOCK_BYTES):
        for first in range(int(offsets[i]), int(offsets[j]), BLOCK_BYTES):
            last = min(first + BLOCK_BYTES, int(offsets[j]))
            piece = _EVEN[data[first : min(last + LONGEST - 1, int(offsets[j]))]]
            place = np.arange(first, last)
            row = np.searchsorted(offsets, place, "right") - 1
            left = offsets[row + 1] - place
            base = row << BITS
            code = np.zeros(last - first, np.uint64)
            for length in range(1, LONGEST + 1):
                grown = piece[length - 1 : length - 1 + last - first]
                whole = len(grown)  # at the end of the data the last places have no n-gram of this length
                code = (code[:whole] << np.uint64(8)) | grown
                bucket = ((code + np.uint64(length << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
                inside = left[:whole] >= length
                flat[(base[:whole] + bucket.astype(np.int64))[inside]] = 1
    return out


@dataclass
class Model:
    """The landmarks' presence, over the roots of their sums, and for each language the weights of the kernels."""

    languages: list[str]
    landmarks: np.ndarray
    weights: np.ndarray

    def kernels(self, texts: np.ndarray) -> np.ndarray:
        """Of presence rows with the landmarks."""
        return (texts @ self.landmarks.T) / np.sqrt(np.maximum(texts.sum(axis=1, keepdims=True), 1))

    def outputs(self, texts: np.ndarray) -> np.ndarray:
        """For each text and language about 1 if it is that language, about -1 if not."""
        return self.kernels(texts) @ self.weights

    def to_bytes(self) -> tuple[str, bytes, bytes, bytes]:
        sizes = np.sqrt((self.landmarks > 0).sum(axis=1)).astype("<f4")
        return json.dumps(self.languages), np.packbits(self.landmarks > 0, axis=1).tobytes(), sizes.tobytes(), self.weights.astype("<f4").tobytes()

    @staticmethod
    def from_bytes(languages: str, bits: bytes, sizes: bytes, weights: bytes) -> Model:
        names = json.loads(languages)
        present = np.unpackbits(np.frombuffer(bits, np.uint8).reshape(-1, (1 << BITS) // 8), axis=1).astype(np.float32)
        return Model(names, present / np.maximum(np.frombuffer(sizes, "<f4")[:, None], 1), np.frombuffer(weights, "<f4").reshape(-1, len(names)) if names else np.zeros((0, 0), np.float32))


def fit(texts: np.ndarray, languages: list[str]) -> Model:
    """Landmarks are taken from the languages in turn; each language weighs the same in the regression."""
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros((0, 0), np.float32))
    of = np.array([names.index(x) for x in languages])
    turn = np.array([np.count_nonzero(of[:i] == x) for i, x in enumerate(of)])
    chosen = np.lexsort((of, turn))[: max(LANDMARKS, len(names))]
    marks = texts[chosen]
    model = Model(names, marks / np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1)), np.zeros((len(chosen), len(names)), np.float32))
    values, vectors = np.linalg.eigh(model.kernels(marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    to_coordinates = vectors[:, good] / np.sqrt(values[good])
    x = np.concatenate([model.kernels(texts[i : i + 512]) for i in range(0, len(texts), 512)]).astype(np.float64) @ to_coordinates
    weight = (len(of) / len(names) / np.bincount(of))[of][:, None]
    target = np.where(of[:, None] == np.arange(len(names)), 1.0, -1.0)
    normal = x.T @ (weight * x) + RIDGE * len(of) * np.eye(x.shape[1])
    model.weights = (to_coordinates @ np.linalg.solve(normal, x.T @ (weight * target))).astype(np.float32)
    return model


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, rows: int = TRAIN_ROWS) -> Model:
    """Fit on documents with a language that are not held out."""
    known = docs.select("doc_id", F.col("lang").alias("_lang")).filter(F.col("_lang").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    # of a language only rows are ranked whose hash is under a bound: about four times as many as are wanted, at any size
    sizes = known.groupBy("_lang").agg(F.count("*").alias("_n")).orderBy(F.desc("_n"), "_lang").limit(rows)  # bounded, so it can be broadcast
    hash_ = F.xxhash64("doc_id")
    low = hash_.cast("double") < -(2.0**63) + 2.0**64 * F.least(F.lit(1.0), 4 * per_language / F.col("_n"))
    known = known.join(F.broadcast(sizes), "_lang").filter(low | (F.col("_n") <= 4 * per_language)).select("doc_id", "_lang")
    by_hash = Window.partitionBy("_lang").orderBy(hash_, "doc_id")
    sample = known.withColumn("_k", F.row_number().over(by_hash)).filter(F.col("_k") <= per_language).select("doc_id", "_lang", "_k").orderBy("_k", "_lang").limit(rows)
    chosen = docs.select("doc_id", "text", F.col("lang").alias("_lang")).join(F.broadcast(sample.select("doc_id", "_lang").distinct()), ["doc_id", "_lang"])
    texts = chosen.groupBy("doc_id", "_lang").agg(F.min("text").alias("text")).filter(_has_letter("text"))

    def seen(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = from_arrow(batch.column(2))
        bits = [np.packbits(presence(data[offsets[i] : offsets[i + 1]], np.array([0, offsets[i + 1] - offsets[i]]))[0] > 0).tobytes() for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], ["doc_id", "_lang", "bits"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(batches)
        x, languages = np.zeros((0, 1 << BITS), np.float32), []
        if tables:
            found = pa.Table.from_batches(tables).combine_chunks().sort_by([("doc_id", "ascending"), ("_lang", "ascending")])
            languages = found.column("_lang").to_pylist()
            x = np.unpackbits(np.frombuffer(b"".join(found.column("bits").to_pylist()), np.uint8).reshape(len(languages), -1), axis=1).astype(np.float32)
        parts = fit(x, languages).to_bytes()
        yield pa.RecordBatch.from_arrays([pa.array([p]) for p in parts], ["languages", "bits", "sizes", "weights"])

    bits = map_batches(texts, seen, StructType([docs.schema["doc_id"], StructField("_lang", StringType()), StructField("bits", docs.select(F.lit(b"")).schema[0].dataType)]))
    # the sample is bounded, so one task fits the model; only its parts come to the driver
    return Model.from_bytes(*bits.repartition(1).mapInArrow(learn, "languages string, bits binary, sizes binary, weights binary").first())


def _has_letter(name: str) -> Column:
    return F.coalesce(F.col(name).rlike(r"\p{L}"), F.lit(False))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """rows(text, ...) with lang_pred and score, which is half of one more than the language's output, within 0 and 1."""
    held = rows.sparkSession.sparkContext.broadcast(model)
    names = rows.columns
    at = names.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
        data, offsets = from_arrow(batch.column(at))
        known = held.value.languages
        for a, b in blocks(offsets, BLOCK_BYTES) if known else ():
            for i in range(a, b, BLOCK_ROWS):
                j = min(i + BLOCK_ROWS, b)
                out = held.value.outputs(presence(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                best[i:j] = out.argmax(axis=1)
                score[i:j] = np.clip((out.max(axis=1).astype(np.float64) + 1) / 2, 0, 1)
        chosen = pa.array(known or [UNKNOWN], pa.string()).take(pa.array(best))
        return pa.RecordBatch.from_arrays([*batch.columns, chosen, pa.array(score)], [*names, "_best", "_score"])

    out = map_batches(rows, work, StructType([*rows.schema.fields, StructField("_best", StringType()), StructField("_score", DoubleType())]))
    letter = _has_letter("text")
    return out.select(*(F.col(f"`{c}`") for c in names), F.when(letter, F.col("_best")).otherwise(UNKNOWN).alias("lang_pred"), F.when(letter, F.col("_score")).otherwise(0.0).alias("score"))


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs(doc_id, text, lang, ...)."""
    out = scored(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
