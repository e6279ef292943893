import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import clusters, language_id
from ledgerline.llm.tables import read


def grams(text):
    data = bytes(int(language_id._EVEN[b]) for b in text.encode())
    return {data[i : i + n] for n in range(1, language_id.LONGEST + 1) for i in range(len(data) - n + 1)}


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_presence_is_that_of_all_grams(monkeypatch, block):
    monkeypatch.setattr(language_id, "BLOCK_BYTES", block)
    texts = ["", "a", "Straße 12\tund 99", "", "the cat sat on the mat, THE CAT!", "ééé" * 30]
    raw = [t.encode() for t in texts]
    found = language_id.presence(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    alone = [language_id.presence(np.frombuffer(r, np.uint8), np.array([0, len(r)]))[0] for r in raw]
    assert (found == np.stack(alone)).all()
    for text, row in zip(texts, found, strict=True):
        assert len(grams(text)) * 0.97 <= row.sum() <= len(grams(text))  # few collisions


def test_outputs_are_kernel_ridge_regression():
    r = random.Random(1)
    texts, names = [], []
    for k in range(40):
        names.append("xy"[k % 2])
        texts.append(" ".join(r.choice(["alpha", "beta", "gamma"] if k % 2 else ["uno", "dos", "tres"]) for _ in range(9)).encode())
    x = np.stack([language_id.presence(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts])
    model = language_id.fit(x, names)  # fewer texts than landmarks: the map is exact
    k = (x @ x.T) / np.sqrt(np.outer(x.sum(axis=1), x.sum(axis=1)))
    y = np.where(np.array(names)[:, None] == np.array(["x", "y"]), 1.0, -1.0)
    want = k @ np.linalg.solve(k + language_id.RIDGE * len(x) * np.eye(len(x)), y)
    assert np.abs(model.outputs(x) - want).max() < 1e-2
    again = language_id.Model.from_bytes(*model.to_bytes())
    assert np.abs(again.outputs(x) - model.outputs(x)).max() < 1e-5


def test_held_out_accuracy(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    out = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    right, n = out.agg(F.count_if(F.col("lang") == F.col("lang_pred")), F.count("*")).first()
    assert n > 20 and right >= 0.98 * n


def test_languages_of_odd_rows(spark, docs):
    out = language_id.languages(docs)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"] and out.count() == docs.count()
    odd = {r.doc_id: r for r in out.join(docs.select("doc_id", "text"), "doc_id").collect() if not any(c.isalpha() for c in r.text or "")}
    assert odd and all(r.lang_pred == "und" and r.score == 0 for r in odd.values())
    assert {r.lang_pred for r in out.collect()} == {"und", "en"} and out.filter("score < 0 or score > 1 or held_out is null").count() == 0
    assert language_id.languages(docs.limit(0)).count() == 0
    unknown = language_id.languages(docs.withColumn("lang", F.lit(None).cast("string")))
    assert unknown.select("lang_pred", "score").distinct().collect() == [("und", 0.0)]


def test_labels_and_ids_are_no_inputs(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text", "lang", "source")
    other = docs.withColumn("lang", F.when(language_id.is_held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("other"))
    a, b = ({(r.doc_id, r.lang_pred, r.score) for r in language_id.languages(d).collect()} for d in (docs, other))
    assert a == b


def brute(rows, k, rounds, dims):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest()
    c = [p for _, p in sorted(kept, key=lambda x: (x[0] is None, digest(x[0]), x[1]))[:k]]
    place = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), n) for n, q in enumerate(c))
    for _ in range(rounds):
        own = [place(p)[1] for _, p in kept]
        c = [[sum(x) // len(members) for x in zip(*members, strict=True)] if (members := [p for (_, p), o in zip(kept, own, strict=True) if o == n]) else q for n, q in enumerate(c)]
    last = [(i, *place(p)) for i, p in kept]
    total = lambda n: sum(d for _, d, m in last if n in (None, m))
    return sorted(((i, n, d, total(n), total(None), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in last), key=str)


@pytest.mark.parametrize("k,dims,wide", [(8, 6, 0), (3, 64, 0), (20, 2, 0), (8, 4, 3), (60, 3, 0)])
def test_clusters_equal_brute_force(spark, k, dims, wide):
    r = random.Random(k)
    rows = [(i, [r.choice([-1, 0, 0.5, 1]) + r.randint(-3, 3) / 1024 for _ in range(dims)]) for i in range(40)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[5][1]), (50, None), (51, []), (52, [0.0] * (dims + 1)), (53, [None] * dims), (54, [float("nan")] * dims), (55, [float("inf")] + [0.0] * (dims - 1)), (56, [0.0] * dims)]
    rows += [(70 + i, [float(r.randint(1, 9)) * 2.0**17] * dims) for i in range(wide)]  # beyond what the 64-bit way takes
    df = spark.createDataFrame([(i, v, 0, "c") for i, v in rows], "vec_id long, embedding array<double>, cluster int, p string").repartition(3)
    got = sorted((tuple(x) for x in clusters.clusters(df, k=k, dims=dims).collect()), key=str)
    assert got == brute(rows, k, 10, dims)


def test_no_vector_and_overflow(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert clusters.clusters(df, dims=3).count() == 0
    with pytest.raises(Exception, match="beyond 2"):
        clusters.clusters(df, dims=2).collect()
    far = spark.createDataFrame([(i, [x, 0.0]) for i, x in enumerate([0.0, 1e9])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="fit in a long"):
        clusters.clusters(far, k=1, rounds=0, dims=2).collect()


def test_the_walk_ends_early():
    """Vectors at a centroid of many: the frontiers exceed the distance 0 before all have been met."""
    r = np.random.default_rng(0)
    c = clusters.Centroids(r.integers(-1000, 1000, (200, 16)).tolist())
    met = []
    real = np.put_along_axis
    np.put_along_axis = lambda new, entry, v, axis: (met.append(entry.size), real(new, entry, v, axis))[1]
    try:
        at, d = c.nearest(np.array(c.values, dtype=np.int64))
    finally:
        np.put_along_axis = real
    assert (at == np.arange(200)).all() and (d == 0).all() and sum(met) < 200 * 16 * 200 / 10
