import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import quality_model, quality_rules


@pytest.mark.parametrize("few", [0, 64])
def test_base_statistics(docs, few, monkeypatch):
    monkeypatch.setattr(quality_rules, "FEW_WINDOWS", few)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs).collect())
    want = Counter()
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        again = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
        want[(r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 50 or 100 * len(again) > 50 * len(w))] += 1
    assert got == want


def test_frequent_lines_are_removed(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"{body(i)}\nSubscribe  NOW 1", "h") for i in range(40)]
    rows += [(100 + i, "Subscribe now 2\n" * 1 + " ".join(["subscribe", "now"] * 40) + f" {i}", "h") for i in range(2)]
    rows += [(200 + i, f"{body(500)}", "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert all(found[i].n_removed_words == 3 and found[i].kept for i in range(40))
    assert all(found[200 + i].kept and found[200 + i].n_removed_words == 0 for i in range(30))  # copies are one text
    texts = {r.doc_id: r.text for r in quality_rules.clean(docs).collect()}
    assert texts[3] == body(3)


def test_depleted_documents_are_rejected(spark):
    line = " ".join(f"b{k}" for k in range(60))
    rows = [(i, f"{line}\nown{i}", "h") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality_rules.quality_rules(docs).filter("kept or base_failed").count() == 0


def test_clean_keeps_columns(docs):
    out = quality_rules.clean(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_margin_is_the_pairwise_sum():
    r = np.random.default_rng(0)
    m = quality_model.Machine(r.normal(size=(1 << quality_model.WORD_BITS, 1 + quality_model.RANK)).astype(np.float32), r.normal(size=(len(quality_model.STATISTICS), 1 + quality_model.RANK)).astype(np.float32))
    text = b"alpha beta beta gamma"
    x = quality_model.features(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    rows = np.concatenate([m.words[x.bucket] * x.value[:, None], m.statistics * x.statistics[0][:, None]])
    want = rows[:, 0].sum() + sum(rows[i, 1:] @ rows[j, 1:] for i in range(len(rows)) for j in range(i))
    assert abs(m.margins(x)[0][0] - want) < 1e-2


def test_scores_separate_held_out_rows(spark):
    good = [(i, " ".join(f"word{(i * k) % 50}" for k in range(80)), 1) for i in range(300)]
    bad = [(1000 + i, "BUY!! " * 20 + f"### $$$ {i}", 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000, None), (None, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in good + bad] + [(9, None, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.quality_scores(docs, labels)
    held = out.filter("held_out").join(labels.filter("quality is not null"), "doc_id")
    assert held.filter("predicted = quality").count() >= 0.97 * held.count() > 20
    assert out.count() == 402 and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert {r.h for r in out.filter("doc_id = 5").select(F.col("held_out").alias("h")).collect()} == {__import__("zlib").crc32(b"5") % 5 == 0}


def test_query_equals_brute_force(spark):
    texts = [" ".join(f"word{(i * k) % 50}" for k in range(60)) if i % 3 else "BUY!! " * 20 + f"### $$$ {i}" for i in range(120)]
    rows = [*enumerate(texts), (200, None), (201, ""), (202, "long " * 30_000), (3, texts[0]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(3, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    m = quality_model.train(docs, labels)
    want = {}
    for i, text in rows:
        raw = (text or "").encode()
        x = quality_model.features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        parts = np.concatenate([m.words[x.bucket] * x.value[:, None], m.statistics * x.statistics[0][:, None]]).astype(float)
        pairs = sum(parts[a, 1:] @ parts[b, 1:] for a in range(len(parts)) for b in range(a))
        want.setdefault(i, []).append(1 / (1 + np.exp(-(parts[:, 0].sum() + pairs))))
    got = {}
    for r in quality_model.quality_scores(docs, labels).collect():
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        got.setdefault(r.doc_id, []).append(r.score)
    assert got.keys() == want.keys()
    assert all(np.allclose(sorted(got[i]), sorted(want[i]), atol=1e-3) for i in got)


def test_without_labels_all_scores_are_half(docs, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.quality_scores(docs, none).filter("score <> 0.5").count() == 0
    assert quality_model.good(docs, none).columns == docs.columns
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0
