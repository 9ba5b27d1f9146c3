"""A1 and A3 on streams: an addition to the reference's surface, not one of its operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import dedup


def reason_counts(stream: DataFrame, reason: Column, time: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Rows by reason and window of event time; state is dropped once a window is ``late``."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), reason.alias("reason")).agg(F.count("*").alias("n"))


def merge_strongest(path: str, keys: Sequence[str], evidence: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps at ``path`` the strongest row of each key seen so far.

    Versions are written beside each other, so a batch that runs again after a
    failure starts from the same one before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        rows = batch
        if number:
            rows = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/version={number - 1}"))
        dedup.strongest(rows, keys, evidence).write.mode("overwrite").parquet(f"{path}/version={number}")

    return merge
