import hashlib
import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerline.llm import bpe, chunked_bpe, jaccard_join, packing, quality_model, token_counts, wavelet

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def library(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_counts_equal_the_library(docs):
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, BYTE).collect()}
    want = {(r.doc_id, len((r.text or "").encode()), n, n > 1024) for r in docs.collect() for n in [len(library(BYTE, r.text))]}
    assert got == want


@pytest.mark.parametrize("mean", [8, 512])
def test_chunks_give_the_same_ids(docs, monkeypatch, mean):
    coder = chunked_bpe.ChunkEncoder(BYTE)
    monkeypatch.setattr(chunked_bpe, "MEAN_CHUNK", mean)
    for text in [r.text or "" for r in docs.collect()]:
        raw = np.frombuffer(text.encode(), np.uint8)
        ids = coder.encode(raw, np.array([0, len(raw)]))[0]
        assert ids.tolist() == library(BYTE, text)
        assert coder.decode(ids) == text.encode()


def test_a_join_that_disagrees_is_encoded_with_the_whole_text(texts, monkeypatch):
    monkeypatch.setattr(chunked_bpe, "MEAN_CHUNK", 64)
    coder = chunked_bpe.ChunkEncoder(BYTE)
    raw = [t.encode() for t in (texts[0], texts[3], texts[5])]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    coder.encode(data, offsets)
    grown, whole = [], coder._grown
    monkeypatch.setattr(coder, "_grown", lambda *a: grown.extend(a[-1].tolist()) or whole(*a))
    facts = coder.facts[0]
    k = next(k for k in range(facts.shape[1]) if facts[7, k] < facts[3, k] and facts[0, k] > 0)
    coder.ids[0][facts[0, k] + facts[9, k]] += 1  # the chunk's id at its last but one safe place
    assert [x.tolist() for x in coder.encode(data, offsets)] == [library(BYTE, t.decode()) for t in raw] and grown


def as_rows(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def equal_to_library(texts):
    data, offsets = as_rows(texts)
    want = [library_of(p).encode_batch(texts, add_special_tokens=False) for p in (BYTE, WORD)]
    for path, style, found in ((BYTE, "byte", want[0]), (WORD, "word", want[1])):
        ids, at = bpe.Encoder(path, style).encode(data, offsets)
        assert [x.tolist() for x in np.split(ids, at[1:-1])] == [e.ids for e in found]
    assert token_counts.Counter(BYTE).count(data, offsets).tolist() == [len(e.ids) for e in want[0]]
    assert [x.tolist() for x in chunked_bpe.ChunkEncoder(BYTE).encode(data, offsets)] == [e.ids for e in want[0]]


def library_of(path):
    return Tokenizer.from_file(path)


def test_every_plain_character_is_split_as_in_the_library():
    points = [c for first, last in bpe.PLAIN for c in range(first, last + 1) if not 0x4E00 <= c <= 0xD7A3 or c % 17 == 0]
    equal_to_library([f"a{chr(c)}b {chr(c)} {chr(c)}1 {chr(c) * 2}x\n{chr(c)}'s" for c in points])


def test_texts_of_all_scripts_and_markers():
    rng = random.Random(5)
    pool = [*"ab 'st   \n\t1.!", *"\xa0\u3000\u2003\x85漢ыЖΣ한कﬁİ😀é", "e\u0301", "\u200d", "\u1112\u1161", "\U00020000", "\u212a", "re", "'ll", "<|", "|>", "<|endoftext|>", "<|startoftext|>"]
    equal_to_library(["".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 20, 200]))) for _ in range(2000)])


def test_only_stretches_that_are_not_plain_go_to_the_library(monkeypatch):
    coder = bpe.Encoder(BYTE, "byte")
    seen, whole = [], coder.whole
    monkeypatch.setattr(coder, "whole", lambda texts: seen.extend(texts) or whole(texts))
    coder.encode(*as_rows(["plain words before \u0915\u093f here <|x and after", "", "all plain 漢字 ы"]))
    assert seen == [" \u0915\u093f here".encode(), b" <|x"]


def test_workers_stay_small():
    """Remembered pre-tokens take few bytes each, and arrays are held for a small part of the texts."""
    words = [f"{i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) + "qu" for i in range(120_000)]
    data, offsets = as_rows([" ".join(words[i : i + 300]) for i in range(0, len(words), 300)] * 3)
    coder = chunked_bpe.ChunkEncoder(BYTE)
    tracemalloc.start()
    try:
        for i in range(0, len(offsets) - 1, 25):
            part = offsets[i : i + 26]
            coder.words.encode(data[part[0] : part[-1]], part - part[0])
        remembered = tracemalloc.get_traced_memory()[0]
        tracemalloc.reset_peak()
        ids = coder.encode(data, offsets)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert remembered < 80 * len(words)
    assert len(data) > 2_000_000 and peak - remembered < 25 * len(data)
    assert ids[7].tolist() == library(BYTE, data[offsets[7] : offsets[8]].tobytes().decode())


def test_round_trip_digests(docs):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in chunked_bpe.round_trip(docs, BYTE).collect()}
    tok = Tokenizer.from_file(BYTE)
    want = set()
    for r in docs.collect():
        ids = library(BYTE, r.text)
        text = tok.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == want


def test_packing_places_every_piece(docs):
    rows = packing.packed(docs, BYTE).collect()
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_bin[r.sequence_id].append((r.offset, r.length))
    for r in docs.dropDuplicates(["doc_id"]).collect():
        ids = [*library(BYTE, r.text), 2]
        pieces = sorted({(p.piece, p.start, p.length, p.ids_crc32) for p in by_doc[r.doc_id]})
        assert sum(p[2] for p in pieces) == len(ids)
        assert all(p[2] == 1024 for p in pieces[1:]) and (len(ids) > 1024 or len(pieces) == 1)
        assert all(crc(ids[s : s + n]) == c for _, s, n, c in pieces)
    for places in by_bin.values():
        places.sort()
        assert [p[0] for p in places] == [0, *np.cumsum([p[1] for p in places])[:-1].tolist()]
        assert sum(p[1] for p in places) <= 1024
    assert len(by_bin) <= -(-sum(r.length for r in rows) // 1024) + 3


def test_best_two_fit_fills_bins():
    lengths = np.random.default_rng(2).integers(1, 1025, 4000)
    bins, places = packing.best_two_fit(lengths, 1024)
    filled = np.bincount(bins, lengths)
    assert filled.max() <= 1024 and len(filled) <= 1.05 * lengths.sum() / 1024 + (lengths > 512).sum() * 0.05
    assert sorted(zip(bins, places, strict=True)) and (np.bincount(bins) > 0).all()


def test_wavelet_shards_read_back(docs):
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in wavelet.written_and_read(docs, WORD).collect()), key=lambda r: r[1])
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id if r.doc_id is not None else -1, r.text or ""))
    start, want = 0, []
    for r in rows:
        ids = [*library(WORD, r.text), 1]
        want.append((r.doc_id if r.doc_id is not None else -1, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want


def test_wavelet_queries():
    ids = np.random.default_rng(1).integers(0, 49_408, 3000) % 37 * 1001
    m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, 16).to_bytes())
    assert m.decode().tolist() == ids.tolist()
    assert [m.access(i) for i in range(0, 3000, 97)] == ids[::97].tolist()
    for s in (0, 1001, 36 * 1001, 5):
        at = np.flatnonzero(ids == s).tolist()
        assert m.count(s) == len(at) and m.occurrences(s) == at and m.rank(s, 1500) == sum(p < 1500 for p in at)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert token_counts.token_counts(none, BYTE).count() == 0
    assert chunked_bpe.round_trip(none, BYTE).count() == 0
    assert packing.packed(none, BYTE).count() == 0
    assert wavelet.written_and_read(none, WORD).count() == 0


def test_shared_chunks_are_encoded_once(spark, tmp_path, monkeypatch):
    """A passage in several partitions is learned once, whatever the dealing, and ids are the library's."""
    r = random.Random(3)
    prose = lambda n: " ".join(r.choice(["alpha", "beta,", "gamma.", "délta", "one", "two", "42"]) + str(r.randint(0, 999)) for _ in range(n))
    passage = prose(900)
    texts = [f"{prose(40)} {passage} {prose(60)}" for _ in range(9)] + [passage, passage, None, ""] + [prose(300) for _ in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    counts = chunked_bpe.chunk_counts(docs).groupBy("h").agg(F.sum("n").alias("n"))
    n_shared = counts.filter("n > 1").count()
    lists, bits = chunked_bpe.shared_chunks(docs, BYTE)
    given = lists.select(F.explode("chunks.h").alias("h"))
    assert n_shared > 5 and given.select("h").distinct().count() == n_shared and lists.count() == 10
    got = {x.doc_id: list(x.ids) for x in chunked_bpe.encoded(docs, BYTE).collect()}
    assert got == {i: library(BYTE, t) for i, t in enumerate(texts)}
    # what a task is given it doesn't learn again; ids that stand for other bytes are not used
    coder = chunked_bpe.ChunkEncoder(BYTE)
    raw = np.frombuffer(texts[0].encode(), np.uint8)
    start, length, hashes = chunked_bpe.cut(raw, np.array([0, len(raw)]))
    ids, facts = coder.learned([raw[a : a + n].tobytes() for a, n in zip(start, length, strict=True)])
    learned = []
    monkeypatch.setattr(coder, "_learn", lambda data, kind, at, size, real=coder._learn: (learned.extend(size.tolist()), real(data, kind, at, size)))
    coder.give(hashes.tolist(), ids, facts)
    assert coder.encode(raw, np.array([0, len(raw)]))[0].tolist() == library(BYTE, texts[0]) and not learned
    coder.forget()
    coder.give(hashes.tolist(), [ids[-1], *ids[1:]], np.concatenate([facts[-1:], facts[1:]]))
    assert coder.encode(raw, np.array([0, len(raw)]))[0].tolist() == library(BYTE, texts[0]) and learned == [length[0]]


@pytest.mark.parametrize("bits", [1 << 15])
def test_full_bitmaps_change_nothing(docs, monkeypatch, bits):
    monkeypatch.setattr(chunked_bpe, "BITS", bits)
    assert {(x.doc_id, tuple(x.ids)) for x in chunked_bpe.encoded(docs, BYTE).collect()} == {(x.doc_id, tuple(library(BYTE, x.text))) for x in docs.collect()}


def test_texts_beyond_a_block(spark):
    """A text of several blocks, in one row, through every operator that takes texts in blocks."""
    r = random.Random(9)
    words = ["alpha", "beta,", "gamma.", "naïve", "Überraschung", "42", "\n", "x y", "quick brown"]
    text = " ".join(r.choice(words) for _ in range(420_000))
    assert len(text.encode()) > bpe.BLOCK_BYTES
    docs = spark.createDataFrame([(1, "short one", "en", "s"), (2, text, "en", "s"), (3, None, "en", "s")], "doc_id long, text string, lang string, source string")
    ids = {path: library(path, text) for path in (BYTE, WORD)}
    assert {x.doc_id: x.n_tokens for x in token_counts.token_counts(docs, BYTE).collect()}[2] == len(ids[BYTE])
    trip = {x.doc_id: x for x in chunked_bpe.round_trip(docs, BYTE).collect()}[2]
    assert trip.ids_sha256 == hashlib.sha256(",".join(map(str, ids[BYTE])).encode()).hexdigest() and trip.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {x.doc_id: x.ids_crc32 for x in wavelet.written_and_read(docs, WORD, 1).collect()}[2] == crc([*ids[WORD], 1])
    pieces = sorted((x.start, x.length, x.ids_crc32) for x in packing.packed(docs, BYTE, 2, 1024).collect() if x.doc_id == 2)
    assert all(crc([*ids[BYTE], 2][a : a + n]) == c for a, n, c in pieces) and sum(n for _, n, _ in pieces) == len(ids[BYTE]) + 1
    one = [x for x in quality_model.scored(docs, quality_model.Machine.untrained()).collect()]
    assert [x["_score"] for x in one] == [0.5] * 3
    assert {x.doc_id: x.n_links for x in jaccard_join.links(docs).collect()} == {1: 0, 2: 0, 3: 0}
