"""Consecutive numbers over a whole table without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import settled


def numbered(rows: DataFrame, order: list[str], column: str, start: int = 0) -> DataFrame:
    """rows with their place in the given order, from ``start`` on.

    Rows are dealt by ranges of the order and counted within them; only the counts, one
    for each range, come to the driver. Rows equal in the order take any place of theirs.
    """
    # the number of a row within a task, and above it that of the task
    dealt = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()
    offsets, before = [], start
    for r in sorted(counts):
        offsets.append((r["_part"], before))
        before += r.n
    known = rows.sparkSession.createDataFrame(offsets, "_part long, _before long")  # a row for each range
    within = F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.withColumn("_part", part).join(F.broadcast(known), "_part").withColumn(column, within + F.col("_before")).drop("_part", "_before", "_at")
