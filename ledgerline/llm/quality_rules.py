"""Quality rules from word and line statistics, with cross-document line frequency.

Everything is built-in Spark SQL expressions. A document's lines are normalised
(lower case, one space between words) and hashed. A line counts once
for each distinct text of a host that has it, so exact copies raise no count. It
is over the limit if it is in more than ``line_docs`` texts of the host and in
more than ``line_share`` of them. Such lines are removed; a document of whose
words less than ``words_left`` remain is depleted and rejected, as is one that
fails the base rules.

Null texts have no words and fail the base rules. A null host is a host of its
own. Repeated rows each get a result, and count as one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import folded, unfolded
from .tables import kept as kept_table

_SPACES = " \t\n\x0b\f\r"
_GAP = "[\\x20\\x09-\\x0D]+"
_SYMBOLS = "#*$%&|<>"
#: Distinct repeated windows of a text up to which each window is looked up among them.
FEW_WINDOWS = 64


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, _GAP), "")


def lines(text: Column) -> Column:
    """The lines that have a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.translate(line, _SPACES, "") != "")


def line_hash(line: Column) -> Column:
    plain = F.trim(F.regexp_replace(line, _GAP, " "))
    return F.xxhash64(F.lower(plain))


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def base_statistics(docs: DataFrame, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; needs text."""
    # each step reads the arrays of the one before; inlined into a lambda they would be built for every element
    step = docs.withColumns({"_words": words(_text()), "_lines": lines(_text())})
    n = F.size("_words")
    window = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(3))))
    step = step.withColumn("_h", F.when(n >= 3, window).otherwise(F.array().cast("array<bigint>")))
    step = step.withColumn("_sorted", F.sort_array("_h"))
    step = step.withColumn("_twice", F.array_distinct(F.filter("_sorted", lambda x, k: F.get("_sorted", k - 1) == x)))
    # few repeated windows are looked up; where there are many, sorted pairs of window and place keep the cost near-linear
    many = F.size("_twice") > FEW_WINDOWS
    step = step.withColumn("_pairs", F.when(many, F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    repeated = F.filter("_pairs", lambda x, k: (F.get("_pairs", k - 1)["h"] == x["h"]) | F.coalesce(F.get("_pairs", k + 1)["h"] == x["h"], F.lit(False)))
    found = F.filter(F.sequence(F.lit(0), F.size("_h") - 1), lambda i: F.array_contains("_twice", F.get("_h", i)))
    step = step.withColumn("_again", F.when(F.size("_twice") == 0, F.array().cast("array<int>")).when(many, F.sort_array(F.transform(repeated, lambda x: x["i"]))).otherwise(found))
    m = F.size("_again")
    covered = F.aggregate(F.zip_with(F.slice("_again", F.lit(1), m - 1), F.slice("_again", F.lit(2), m - 1), lambda a, b: F.least(F.lit(3), b - a)), F.lit(0), lambda s, x: s + x) + 3
    step = step.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(_text(), _SPACES, "")).cast("long"),
            "n_symbols": (F.length(_text()) - F.length(F.translate(_text(), _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.when(m > 0, covered).otherwise(0).cast("long"),
        }
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return step.withColumn("base_failed", failed).drop("_words", "_lines", "_h", "_sorted", "_twice", "_pairs", "_again")


def _keyed(docs: DataFrame, host: str) -> DataFrame:
    return docs.withColumns({"_host": F.coalesce(F.concat(F.lit("h"), F.col(host).cast("string")), F.lit("")), "_content": F.xxhash64(_text())})


def line_table(docs: DataFrame, host: str = "source") -> DataFrame:
    """A row for every line with a word: its document's key, its place, hash and number of words; written once."""
    each = F.transform(lines(_text()), lambda x: F.struct(line_hash(x).alias("h"), F.size(words(x)).alias("n")))
    rows = _keyed(docs, host).select("doc_id", "_host", "_content", F.posexplode(each).alias("_at", "_l"))
    return kept_table(rows.select("doc_id", "_host", "_content", "_at", F.col("_l.h").alias("_line"), F.col("_l.n").alias("_n")), "lines")


def frequent_lines(table: DataFrame, line_docs: int = 20, line_share: float = 0.005) -> DataFrame:
    """host and hash of the lines of a line table that are over the limits, with the number of distinct texts that have them."""
    often = table.groupBy("_host", "_line").agg(F.count_distinct("_content").alias("n_docs")).filter(F.col("n_docs") > line_docs)
    hosts = table.groupBy("_host").agg(F.count_distinct("_content").alias("host_docs"))
    return often.join(hosts, "_host").filter(F.col("n_docs") > line_share * F.col("host_docs")).select("_host", "_line", "n_docs")


def removed_lines(docs: DataFrame, host: str, line_docs: int, line_share: float) -> DataFrame:
    """For every document with lines over the limits: the words in them, and their hashes."""
    table = line_table(docs, host)
    bad = table.join(frequent_lines(table, line_docs, line_share).drop("n_docs"), ["_host", "_line"])
    once = bad.dropDuplicates(["doc_id", "_host", "_content", "_at"])  # repeated rows have the same lines
    return once.groupBy("doc_id", "_host", "_content").agg(F.sum("_n").cast("long").alias("n_removed_words"), F.collect_set("_line").alias("_bad"))


def judged(docs: DataFrame, host: str = "source", line_docs: int = 20, line_share: float = 0.005, words_left: float = 0.3) -> DataFrame:
    """docs with the base statistics, n_removed_words, _bad (hashes of the removed lines, or null) and kept."""
    found = removed_lines(docs, host, line_docs, line_share).alias("f")
    base = _keyed(base_statistics(docs), host).alias("b")
    same = F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b._host") == F.col("f._host")) & (F.col("b._content") == F.col("f._content"))
    out = base.join(found, same, "left").select("b.*", F.coalesce("f.n_removed_words", F.lit(0)).cast("long").alias("n_removed_words"), "f._bad")
    left = F.col("n_words") - F.col("n_removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= words_left * F.col("n_words"))).drop("_host", "_content")


def quality_rules(docs: DataFrame, host: str = "source") -> DataFrame:
    """The verdict on every document of docs(doc_id, text, host, ...)."""
    out = judged(docs.select("doc_id", "text", host), host)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def clean(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents that are kept, without their removed lines; n_chars follows the text."""
    # a filter on the verdict would be pushed into the arrays' lambdas, so the verdicts are written first
    verdicts = kept_table(_keyed(judged(docs.select("doc_id", "text", host), host), host).select("doc_id", "_host", "_content", "kept", "_bad"), "verdicts")
    good = verdicts.filter("kept").drop("kept").dropDuplicates(["doc_id", "_host", "_content"]).alias("v")
    rows = _keyed(folded(docs, "doc_id", "text", host), host).alias("r")
    same = F.col("r.doc_id").eqNullSafe(F.col("v.doc_id")) & (F.col("r._host") == F.col("v._host")) & (F.col("r._content") == F.col("v._content"))
    out = rows.join(good, same).select("r.doc_id", "r.text", f"r.{host}", "r._rest", "v._bad")
    text = F.when(F.col("_bad").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("_bad", line_hash(x))), "\n"))
    return unfolded(out.withColumn("text", text), docs, "doc_id", "text", host, n_chars=F.length("text").cast("long"))
