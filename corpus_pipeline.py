"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gets all that the stage before has
kept. All but the last return the columns of documents.

1. quality_rules: documents that fail the base rules, or that are depleted once
   lines that are frequent on their host are gone, are dropped; such lines are
   removed from the others.
2. quality_classifier: documents that the factorisation machine scores under 0.3
   are dropped.
3. ngram_jaccard_join: of documents that links of similarity 0.8 connect, the one
   with the smallest doc_id stays.
4. suffix_array_dedup: strings of PASSAGE_BYTES that occur more than once are cut out.
5. best_fit_packing: the pieces of at most 1024 tokens and their places.

SQL can't express stages 2 and 5 (a fitted model, a tokenizer), so ORACLE_SQL is
None; tests/llm/test_pipeline.py compares each stage's documents and texts with a
brute-force version of it (of stage 2, with the verdicts of its scorer).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import jaccard_join, packing, quality_model, quality_rules, suffix_dedup
from ledgerline.llm.queries import BYTE_BPE
from ledgerline.llm.tables import kept, read

#: A passage of 50 words has more bytes than this in all languages of the corpus; it is about 50 tokens of a BPE.
PASSAGE_BYTES = 200


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(docs, length=PASSAGE_BYTES)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizers.path(BYTE_BPE), end_id=2, size=1024)


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("best_fit_packing", sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
