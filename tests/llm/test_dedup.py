import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import jaccard_join, suffix_dedup


def brute_removals(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                mask[i : i + length] = True
        spans = int((np.diff(np.append(0, mask.astype(int))) == 1).sum())
        yield len(t), int(mask.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~mask].tobytes()).hexdigest()


@pytest.mark.parametrize("length", [400, 64])
def test_removals_equal_brute_force(docs, length):
    rows = docs.collect()
    want = Counter(zip([r.doc_id for r in rows], brute_removals([(r.text or "").encode() for r in rows], length), strict=True))
    got = Counter((r.doc_id, (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) for r in suffix_dedup.removals(docs, length).collect())
    assert got == want


@pytest.mark.parametrize("together", [2, 5])
def test_crowded_grams_give_the_same_bytes(spark, docs, together):
    r = np.random.default_rng(8)
    passage = "".join(map(chr, r.integers(97, 123, 90)))
    rows = [(100 + i, f"{'abc'[i % 3] * (i % 7)}{i if i % 2 else ''}{passage[: 64 + i % 26]}{i if i % 5 else 'tail'}") for i in range(40)]
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))

    def cover(df):
        return {k: [x.tolist() for x in suffix_dedup.merged(g["start"].to_numpy(), g["end"].to_numpy())] for k, g in df.toPandas().groupby("_k")}

    assert cover(suffix_dedup.repeated_intervals(more, 64, together)) == cover(suffix_dedup.repeated_intervals(more, 64))


def test_deep_shallow_order():
    r = np.random.default_rng(3)
    rows = r.integers(0, 3, (400, 48)).astype(np.uint8)
    rows[200:, :40] = rows[7, :40]
    rows[300] = rows[301]
    order = suffix_dedup.deep_shallow(rows)
    assert [rows[i].tobytes() for i in order] == sorted(x.tobytes() for x in rows)


def test_long_rows_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 900)
    data = np.random.default_rng(4).integers(97, 123, 6000).astype(np.uint8)
    whole = suffix_dedup._anchors_of(data, np.array([0, 6000]), 100)
    pieces = next(iter(suffix_dedup.anchors(data, np.array([0, 6000]), 100)))
    assert [np.asarray(x).tolist() for x in pieces[1:4]] == [x.tolist() for x in whole[1:4]]


@pytest.mark.parametrize("length", [200, 64])
def test_cut_texts_are_those_of_brute_force(docs, length):
    out = suffix_dedup.without_repeats(docs, length)
    assert out.columns == docs.columns
    rows = docs.collect()
    raw = [(r.text or "").encode() for r in rows]
    seen = Counter(t[i : i + length] for t in raw for i in range(len(t) - length + 1))
    want = Counter()
    for r, t in zip(rows, raw, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        chars, at = [], 0
        for c in r.text or "":  # a character goes if all its bytes go
            n = len(c.encode())
            chars.append("" if gone[at : at + n].all() else c)
            at += n
        text = None if r.text is None else "".join(chars)
        want[(r.doc_id, text, None if text is None else len(text), r.gram, r.score)] += 1
    assert Counter((r.doc_id, r.text, r.n_chars, r.gram, r.score) for r in out.collect()) == want


def sets(rows):
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        yield frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_links_equal_brute_force(docs):
    rows = docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect()
    found = dict(zip([r.doc_id for r in rows], sets(rows), strict=True))
    similar = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    parent = {i: i for i in found}
    for _ in found:
        for a in found:
            for b in found:
                if similar(found[a], found[b]):
                    parent[a] = parent[b] = min(parent[a], parent[b])
    one = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_join.links(one).collect()}
    assert got == {a: (parent[a], sum(similar(found[a], found[b]) for b in found if b != a)) for a in found}


def test_large_bucket_paths(docs, monkeypatch):
    want = {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.links(docs).collect()}
    monkeypatch.setattr(jaccard_join, "BUCKET", 2)
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "STEP", 1)
    monkeypatch.setattr(jaccard_join, "IN_TASK", 2)
    assert {(r.doc_id, r.class_id, r.n_links) for r in jaccard_join.links(docs).collect()} == want


def test_buckets_split_in_a_task_connect_what_is_similar(spark, monkeypatch):
    r = np.random.default_rng(11)
    texts = []
    for _ in range(8):  # families of near copies, all of them in one bucket of each run
        words = [f"w{k}" for k in r.integers(0, 10_000, 300)]
        texts += [" ".join(words[:k] + [f"x{k}"] + words[k + 1 :]) for k in range(5, 300, 30)]
    rows = jaccard_join.described(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("cid").toArrow()
    of = dict(zip(rows["cid"].to_pylist(), rows["doc_id"].to_pylist(), strict=True))
    n = rows.num_rows
    fixed = {"i": pa.array(np.zeros(n, np.int64)), "j": pa.array(np.zeros(n, np.int64)), "whole": pa.array(np.ones(n, bool))}
    tables = []
    for run in range(jaccard_join.RUNS):
        table = rows
        for name, column in (fixed | {"path": pa.array(np.full(n, run)), "run": pa.array(np.full(n, run, np.int32))}).items():
            table = table.append_column(name, column)
        tables.append(table)
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    edges = jaccard_join._bucket_edges(pa.concat_tables(tables).combine_chunks()).to_pydict()
    root = jaccard_join._roots(n, np.array([[of[u], of[v]] for u, v in zip(edges["u"], edges["v"], strict=True)]))
    assert root.tolist() == [10 * (k // 10) for k in range(n)]


def near_pairs(spark):
    """150 pairs of similarity of about 0.8, unlike all others, in nodes of one common path."""
    r = np.random.default_rng(12)
    texts = []
    for _ in range(150):
        words = [f"w{k}" for k in r.integers(0, 100_000, 100)]
        texts += [" ".join(words), " ".join(f"x{k}" if k in (30, 70) else w for k, w in enumerate(words))]
    return jaccard_join.described(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))


def test_a_large_bucket_loses_no_pair(spark, monkeypatch):
    rows = near_pairs(spark).orderBy("cid").toArrow()
    n, of = rows.num_rows, rows["doc_id"].to_pylist()
    for name, column in {"path": np.zeros(n, np.int64), "i": np.zeros(n, np.int64), "j": np.zeros(n, np.int64), "run": np.zeros(n, np.int32), "whole": np.ones(n, bool)}.items():
        rows = rows.append_column(name, pa.array(column))
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    edges = jaccard_join._bucket_edges(rows.combine_chunks())
    of = dict(zip(rows["cid"].to_pylist(), of, strict=True))
    assert sorted(sorted((of[e["u"]], of[e["v"]])) for e in edges.to_pylist()) == [[k, k + 1] for k in range(0, n, 2)]


def test_a_bucket_larger_than_a_task_loses_no_pair(spark, monkeypatch):
    nodes = near_pairs(spark).withColumn("chosen", F.array(F.lit(1).cast("long"))).cache()
    of = {r.cid: r.doc_id for r in nodes.collect()}
    monkeypatch.setattr(jaccard_join, "BUCKET", 4)
    monkeypatch.setattr(jaccard_join, "IN_TASK", 40)
    edges = jaccard_join.candidate_edges(nodes).distinct().collect()
    assert sorted(sorted((of[e.u], of[e.v])) for e in edges) == [[k, k + 1] for k in range(0, len(of), 2)]


@pytest.mark.parametrize("bucket", [512, 2])
def test_what_is_like_a_member_like_the_first_is_connected(spark, monkeypatch, bucket):
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    # 2 has 48 of 64 hashes in common with the first, 3 has 47 with 2 but only 31 with the first
    rows = [(k, 100, list(range(low, low + 64)), [1]) for k, low in ((1, 0), (2, 16), (3, 33), (4, 500))]
    edges = jaccard_join.candidate_edges(spark.createDataFrame(rows, "cid long, n int, sketch array<int>, chosen array<long>")).collect()
    assert {(min(e.u, e.v), max(e.u, e.v)) for e in edges} == {(1, 2), (2, 3)}


def test_sparse_and_dense_comparison_of_many_agree():
    r = np.random.default_rng(13)
    passages = r.integers(0, 1 << 30, (40, 16))
    sketches = [np.unique(np.concatenate([passages[r.integers(0, 40, 3)].ravel(), r.integers(0, 1 << 30, r.integers(2, 17))])) for _ in range(900)]
    table = pa.table({"cid": pa.array(range(900)), "n": pa.array([len(x) for x in sketches], pa.int32()), "sketch": pa.array([x.tolist() for x in sketches], pa.list_(pa.int32()))})
    roots = []
    for work in (lambda m: m.compare_many(np.arange(900), np.zeros(900, bool)), lambda m: m.compare_blocks(np.arange(900))):
        members = jaccard_join._Members(table)
        work(members)
        roots.append(jaccard_join._roots(900, np.concatenate(members.found, axis=1).T).tolist())
    assert roots[0] == roots[1] and 1 < len(set(roots[0])) < 900


@pytest.mark.parametrize("blocks", [1, 2])
def test_exact_links_of_a_component_equal_brute_force(monkeypatch, blocks):
    r = np.random.default_rng(17)
    base = r.integers(0, 1 << 40, 400)
    sets = [np.unique(np.concatenate([base[: r.integers(60, 400)], r.integers(0, 1 << 40, r.integers(0, 40))])) for _ in range(70)]
    own, copies = r.integers(0, blocks, 70), r.integers(1, 4, 70)
    table = pa.table({"component": np.zeros(70, np.int64), "i": np.zeros(70, np.int32), "j": np.full(70, blocks - 1, np.int32), "cid": np.arange(70), "own": own.astype(np.int32), "copies": copies, "tokens": pa.array([x.tolist() for x in sets], pa.list_(pa.int64()))})
    meets = [[a != b and (blocks == 1 or own[a] != own[b]) and 5 * len(np.intersect1d(x, y)) >= 4 * len(np.union1d(x, y)) for b, y in enumerate(sets)] for a, x in enumerate(sets)]
    root = jaccard_join._roots(70, np.argwhere(meets))
    want = sorted((a, int(np.dot(meets[a], copies)), int(root[a])) for a in range(70) if any(meets[a]))
    monkeypatch.setattr(jaccard_join, "STEP", 9)
    got = jaccard_join._exact_links(table).to_pydict()
    classes = dict(zip(got["cid"], got["root"], strict=True))
    assert sorted(zip(got["cid"], got["links"], strict=True)) == [(a, n) for a, n, _ in want]
    assert all((classes[a] == classes[b]) == (x == y) for a, _, x in want for b, _, y in want)


def test_one_of_each_class(docs):
    out = jaccard_join.one_of_each(docs)
    assert out.columns == docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert len(ids) == len(set(ids)) and {12, 20, 21, None} <= set(ids) and not {13, 14, 15, 24} & set(ids)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert suffix_dedup.removals(none).count() == 0
    assert jaccard_join.links(none).count() == 0
