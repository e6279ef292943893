import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
from ledgerline.llm import packing, quality_model, queries, suffix_dedup
from ledgerline.llm.tables import kept
from test_dedup import sets
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs, sizes = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = kept(stage(spark, docs, SF), name)
        assert docs.columns == columns and docs.join(before, "doc_id", "left_anti").count() == 0
        sizes.append(docs.count())
        if name == "ngram_jaccard_join":
            rows = docs.collect()
            found = [s for s in sets(rows) if s]
            assert not any(5 * len(a & b) >= 4 * len(a | b) for i, a in enumerate(found) for b in found[:i])
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == packing.packed(docs, queries.public_tokenizers.path(queries.BYTE_BPE)).columns
    assert out.select("doc_id").distinct().count() == sizes[-1]
    assert suffix_dedup.LENGTH == 400


def test_empty_table_and_clashing_columns(spark, docs, monkeypatch):
    """The whole pipeline over a table without rows, and over one whose extra columns have the operators' own names."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for rows in (docs.limit(0), docs):
        monkeypatch.setattr(corpus_pipeline, "read", lambda spark, d, name, rows=rows: rows if name == "documents" else labels)
        out = corpus_pipeline.run(spark, SF)
        ids = [r.doc_id for r in rows.select("doc_id").collect()]
        assert {r.doc_id for r in out.select("doc_id").collect()} <= set(ids) and (ids or not out.count())


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_every_stage_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    verdicts = con.execute(queries.LINE_FREQUENCY).fetchdf()
    functions = dict(corpus_pipeline.STAGES)

    def after(name, docs):
        out = kept(functions[name](spark, docs, SF), name)
        return out, {r.doc_id: r.text for r in out.collect()} if "text" in out.columns else out.collect()

    before = {r.doc_id: r.text for r in docs.collect()}
    docs, now = after("quality_rules", docs)
    assert set(now) == set(verdicts[verdicts["kept"]]["doc_id"])
    whole = set(verdicts[verdicts["kept"] & (verdicts["n_removed_words"] == 0)]["doc_id"])
    assert all(now[k] == before[k] for k in whole) and all(len(now[k]) < len(before[k]) for k in set(now) - whole)

    scores = {r.doc_id: r.predicted for r in quality_model.quality_scores(docs, labels).collect()}
    before = now
    docs, now = after("quality_classifier", docs)
    assert now == {k: t for k, t in before.items() if scores[k]}

    rows = docs.collect()
    found = dict(zip([r.doc_id for r in rows], sets(rows), strict=True))
    similar = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    near, first = {a: [b for b in found if similar(found[a], found[b])] for a in found}, {}
    for a in sorted(found):
        stack = [] if a in first else [a]
        while stack:
            b = stack.pop()
            if first.setdefault(b, a) == a:
                stack += [c for c in near[b] if c not in first]
    before = now
    docs, now = after("ngram_jaccard_join", docs)
    assert now == {k: t for k, t in before.items() if first[k] == k} and len(now) < len(before)

    n, raw = corpus_pipeline.PASSAGE_BYTES, {k: t.encode() for k, t in now.items()}
    seen = Counter(t[i : i + n] for t in raw.values() for i in range(len(t) - n + 1))
    want = {}
    for k, t in raw.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - n + 1):
            if seen[t[i : i + n]] > 1:
                gone[i : i + n] = True
        ends = np.cumsum([0, *(len(c.encode()) for c in now[k])])
        want[k] = "".join(c for c, a, b in zip(now[k], ends, ends[1:], strict=False) if not gone[a:b].all())
    docs, now = after("suffix_array_dedup", docs)
    assert now == want and any(want[k].encode() != raw[k] for k in want)

    token = Tokenizer.from_file(queries.public_tokenizers.path(queries.BYTE_BPE))
    pieces, places = defaultdict(list), defaultdict(list)
    for r in after("best_fit_packing", docs)[1]:
        pieces[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(now)
    for k, own in pieces.items():
        ids = np.array([*token.encode(now[k], add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    for at in places.values():
        at.sort()
        assert [a for a, _ in at] == [0, *np.cumsum([m for _, m in at])[:-1]] and sum(m for _, m in at) <= 1024
