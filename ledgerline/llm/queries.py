"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunked_bpe, clusters, jaccard_join, language_id, merkle, neighbours, packing, page_text, quality_model, quality_rules, suffix_dedup, token_counts, wavelet
from .tables import read

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_deep_shallow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(read(spark, sf_dir, "documents"), length=400).drop("spans")


def op2_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=2, size=1024)


def op4_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.written_and_read(read(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1)


def op5_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op6_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.links(read(spark, sf_dir, "documents")).drop("_c")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), limit=1024)


def op8_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.extract(read(spark, sf_dir, "pages"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(read(spark, sf_dir, "documents"))


def op10_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_subtree_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(read(spark, sf_dir, "documents"), with_path=False)


def op12_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(read(spark, sf_dir, "documents"))


def op13_threshold_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.clusters(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_deep_shallow, op2_factorisation_machine, op3_best_two_fit, op4_wavelet_shards, op5_pruned_graph, op6_chosen_path, op7_token_counts, op8_page_differencing, op9_line_frequency, op10_chunk_reuse, op11_subtree_exchange, op12_string_kernel, op13_threshold_clusters)}


_GAP = "[\\x20\\x09-\\x0D]"
LINE_FREQUENCY = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce('h' || source, '') AS host FROM documents),
 w AS (SELECT *, list_filter(string_split_regex(text, '{_GAP}+'), lambda x: x <> '') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
 win AS (SELECT doc_id, i, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
 dup AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
 cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup CROSS JOIN (VALUES (0), (1), (2)) t(k) GROUP BY 1),
 lines AS (SELECT doc_id, host, text, l, lower(trim(regexp_replace(l, '{_GAP}+', ' ', 'g'))) AS norm FROM (SELECT doc_id, host, text, unnest(ls) AS l FROM w)),
 hosts AS (SELECT host, count(DISTINCT text) AS n FROM lines GROUP BY 1),
 often AS (SELECT host, norm, count(DISTINCT text) AS n FROM lines GROUP BY 1, 2),
 bad AS (SELECT o.host, o.norm FROM often o JOIN hosts h USING (host) WHERE o.n > 20 AND o.n > 0.005 * h.n),
 gone AS (SELECT doc_id, sum(len(list_filter(string_split_regex(l, '{_GAP}+'), lambda x: x <> ''))) AS n FROM lines JOIN bad USING (host, norm) GROUP BY 1),
 s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN gone USING (doc_id)),
 b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
 SELECT *, NOT base_failed AND n_words - n_removed_words >= 0.3 * n_words AS kept FROM b"""


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


_CRC32 = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
 lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: CAST(0 AS BIGINT))), lambda v, z: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))"""
SUBTREE_EXCHANGE = f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN xor({_CRC32}, 4294967295) % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} END AS tampered FROM documents),
 leaves AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
 nodes AS (SELECT source, 0 AS level, pos, n, leaf AS h FROM leaves UNION ALL SELECT source, level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY source, level, n, pos // 3),
 subroots AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
 tops AS (SELECT 0 AS level, pos, n, h FROM subroots UNION ALL SELECT level + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, n, pos // 3),
 own AS (SELECT source, pos AS i, t.level, pos // CAST(power(3, t.level) AS BIGINT) AS place FROM leaves JOIN (SELECT DISTINCT source AS s, level FROM nodes WHERE n > 1) t ON source IS NOT DISTINCT FROM s),
 inner_steps AS (SELECT o.source, o.i, o.level, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < place), '') AS b, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > place), '') AS a FROM own o JOIN nodes t ON o.source IS NOT DISTINCT FROM t.source AND o.level = t.level AND place // 3 = pos // 3 GROUP BY 1, 2, 3),
 top_own AS (SELECT source, level, pos // CAST(power(3, level) AS BIGINT) AS place FROM subroots, (SELECT DISTINCT level FROM tops WHERE n > 1)),
 top_steps AS (SELECT source, o.level, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos < place), '') AS b, coalesce(string_agg(h, '' ORDER BY pos) FILTER (pos > place), '') AS a FROM top_own o JOIN tops t ON o.level = t.level AND place // 3 = pos // 3 GROUP BY 1, 2),
 steps AS (SELECT *, row_number() OVER (PARTITION BY source, i ORDER BY level) AS k FROM (SELECT * FROM inner_steps UNION ALL SELECT l.source, l.pos, 1000 + level, b, a FROM leaves l JOIN top_steps t ON l.source IS NOT DISTINCT FROM t.source)),
 folds AS (SELECT source, pos AS i, CAST(0 AS BIGINT) AS k, coalesce(tampered, leaf) AS h FROM leaves UNION ALL SELECT f.source, f.i, s.k, sha256(s.b || f.h || s.a) FROM folds f JOIN steps s ON f.source IS NOT DISTINCT FROM s.source AND f.i = s.i AND s.k = f.k + 1),
 ends AS (SELECT source, i, arg_max(h, k) AS h FROM folds GROUP BY 1, 2),
 digests AS (SELECT source, i, sha256(string_agg(b || a, '' ORDER BY k)) AS h FROM steps GROUP BY 1, 2)
 SELECT l.doc_id, l.leaf, s.h AS subroot, r.h AS root, coalesce(p.h, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
 FROM leaves l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source JOIN tops r ON r.n = 1 JOIN ends e ON l.source IS NOT DISTINCT FROM e.source AND l.pos = e.i LEFT JOIN digests p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.i"""

_GAPS = "list_sum(list_transform(list_zip(v.p, c.p), lambda x: (x[1] - x[2]) * (x[1] - x[2])))"


def _round(r: int) -> str:
    """The vectors' places for centroids c{r}, and centroids c{r + 1}."""
    return f"""a{r} AS MATERIALIZED (SELECT v.vec_id, v.p, min({{'d': CAST({_GAPS} AS BIGINT), 'c': c.cluster}}) AS best FROM vectors v, c{r} c GROUP BY 1, 2),
 m{r} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS p FROM (SELECT cluster, dim, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT best.c AS cluster, unnest(p) AS x, generate_subscripts(p, 1) AS dim FROM a{r}) GROUP BY 1, 2) GROUP BY 1),
 c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.p, c.p) AS p FROM c{r} c LEFT JOIN m{r} m USING (cluster))"""


THRESHOLD_CLUSTERS = f"""WITH vectors AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS p FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, p) - 1 AS cluster, p FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, p FROM vectors ORDER BY h, p LIMIT 8)),
 {', '.join(map(_round, range(10)))},
 last AS (SELECT v.vec_id, v.p, min({{'d': CAST({_GAPS} AS BIGINT), 'c': c.cluster}}) AS best FROM vectors v, c10 c GROUP BY 1, 2)
 SELECT vec_id, CAST(best.c AS INTEGER) AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.c) AS BIGINT) AS cluster_inertia, CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.p, ',')) AS centroid_sha256 FROM last JOIN c10 c ON c.cluster = best.c"""


def oracle_sql() -> dict[str, str]:
    return {"op9_line_frequency": LINE_FREQUENCY, "op11_subtree_exchange": SUBTREE_EXCHANGE, "op13_threshold_clusters": THRESHOLD_CLUSTERS}
