import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import merkle
from ledgerline.llm.tables import read

DIGESTS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*fields):
    return sha(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree(nodes):
    """All levels, and for each first node its siblings by level."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for row in levels[:-1]:
            first = at // 3 * 3
            path.append((row[first:at], row[at + 1 : first + 3]))
            at //= 3
        paths.append(path)
    return levels[-1][0], paths


def manifest(rows):
    groups = defaultdict(list)
    for r in rows:
        fields = (r.doc_id, r.source, r.lang, r.n_chars, r.text)
        own = leaf(*fields)
        changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        tampered = leaf(*fields[:-1], None if r.text is None else r.text.replace("\n", "")) if changed else own
        groups[r.source].append((r.doc_id is not None, r.doc_id or 0, own, tampered))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: tree([x[2] for x in sorted(groups[s])]) for s in names}
    root, above = tree([built[s][0] for s in names])
    out = Counter()
    for s, top in zip(names, above, strict=True):
        subroot, paths = built[s]
        for (known, doc_id, own, tampered), path in zip(sorted(groups[s]), paths, strict=True):
            node = tampered
            for before, after in path + top:
                node = sha(*before, node, *after)
            proof = sha(*(x for before, after in path + top for x in before + after))
            out[(doc_id if known else None, own, subroot, root, proof, node, node == root)] += 1
    return out


@pytest.mark.parametrize("levels", [2, merkle.LEVELS])
def test_manifest_equals_brute_force(docs, levels):
    many = docs.crossJoin(docs.sparkSession.range(4).withColumnRenamed("id", "copy")).withColumn("doc_id", F.col("doc_id") + 100 * F.col("copy")).drop("copy")
    rows = many.unionByName(docs)  # rows that share an id; some are equal
    got = Counter(tuple(r) for r in merkle.proofs(rows, levels).select(DIGESTS).collect())
    assert got == manifest(rows.collect())


def test_one_document_and_none(spark, docs):
    one = docs.filter("doc_id = 1")
    (r,) = merkle.proofs(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha() and r.path == []
    assert merkle.proofs(docs.limit(0)).count() == 0


def test_paths_fold_to_the_root(spark):
    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = merkle.proofs(docs, levels=2).collect()
    for r in rows:
        node = r.leaf
        for step in r.path:
            node = sha(step.before, node, step.after)
        assert node == r.root
    assert {r.root for r in rows} == {merkle.proofs(docs, with_path=False).first().root} and {r.verified for r in rows} == {True, False}


def test_a_large_source_is_spread(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'one' AS source", "'en' AS lang", "2L AS n_chars", "concat('t', id) AS text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small partitions stay as they are dealt
    try:
        rows = merkle.proofs(docs, levels=4, with_path=False).withColumn("part", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(rows) == 3000 and all(r.verified for r in rows)  # no text has a line end
    assert max(Counter(r.part for r in rows).values()) < 1500
