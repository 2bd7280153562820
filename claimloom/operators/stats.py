"""Value counts, where a present null is a value and an absent key is none."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(rows: DataFrame, key: str, present: Column | None = None) -> DataFrame:
    """(value, n), nulls as a group of their own."""
    rows = rows.where(present) if present is not None else rows
    return rows.groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def summary(counts: DataFrame, excluded: tuple[str, ...] = ("0_0",)) -> DataFrame:
    """(distinct_values, total, total_without): groups, all rows, and rows outside null and ``excluded``."""
    outside = F.col("value").isNotNull() & ~F.coalesce(F.col("value").isin(list(excluded)), F.lit(False))
    return counts.agg(
        F.count(F.lit(1)).alias("distinct_values"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).cast("long").alias("total_without"),
    )


def tree_lines(nodes: DataFrame) -> Iterator[str]:
    """A hierarchy as indented lines and a total, for printing; the rows come a partition at a time, all of them."""
    total = 0
    for r in nodes.orderBy("page_id", "node_id").toLocalIterator():
        total += 1
        yield "  " * r["depth"] + "- " + (r["url"] or "")
    yield f"total: {total}"
