"""One row per key, chosen by evidence or by arrival."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strongest(rows: DataFrame, keys: Sequence[str], evidence: Sequence[str]) -> DataFrame:
    """A1: per key the row of greatest evidence, compared column by column.

    All other columns break ties, so the choice doesn't depend on arrival. One
    aggregation with map-side combining; no sort and no window.
    """
    rest = [c for c in rows.columns if c not in keys and c not in evidence]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*evidence, *rest)).alias("__best"))
    return best.select(*keys, *[F.col("__best")[c].alias(c) for c in [*evidence, *rest]]).select(*rows.columns)


def counters(rows: DataFrame, keys: Sequence[str], evidence: Sequence[str], arrival: Sequence[str], payload: Column) -> DataFrame:
    """A2: rows, kept, duplicates, conflicts and replacements, as a store would count them by arrival.

    A later row conflicts if its payload differs from that of the best before it,
    and replaces it if its evidence is greater.
    """
    before = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    mine = F.struct(*evidence)
    seen = rows.withColumn("__mine", mine).withColumn("__payload", payload)
    seen = seen.withColumn("__best", F.max(F.struct("__mine", "__payload")).over(before))
    return seen.agg(
        F.count("*").alias("seen"),
        F.count_if(F.col("__best").isNull()).alias("kept"),
        F.count_if(F.col("__best").isNotNull()).alias("duplicates"),
        F.count_if(F.col("__best.__payload") != F.col("__payload")).alias("conflicts"),
        F.count_if(F.col("__best.__mine") < F.col("__mine")).alias("replacements"),
    )


def first_arrival(rows: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Per key the row that arrived first."""
    rest = [c for c in rows.columns if c not in keys and c not in arrival]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*arrival, *rest)).alias("__first"))
    return first.select(*keys, *[F.col("__first")[c].alias(c) for c in [*arrival, *rest]]).select(*rows.columns)


def first_source(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """The union of ``parts``, in which an earlier part's row for a key wins over later ones."""
    union = None
    for order, part in enumerate(parts):
        part = part.withColumn("__order", F.lit(order))
        union = part if union is None else union.unionByName(part)
    return first_arrival(union, keys, ["__order"]).drop("__order")


def concatenated(parts: Sequence[DataFrame]) -> DataFrame:
    """All rows of ``parts``, repeats included, by column names, which must be the same."""
    union = parts[0]
    for part in parts[1:]:
        if set(part.columns) != set(union.columns):
            raise ValueError(f"columns differ: {sorted(set(part.columns) ^ set(union.columns))}")
        union = union.unionByName(part)
    return union
