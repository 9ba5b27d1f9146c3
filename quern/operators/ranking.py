"""Ranks, best rows, ordinals, samples and batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.stage import cut


def top_k(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key; the filter on the rank lets Spark limit before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(rank, place).where(F.col(rank) <= k)


def top_of(values: Column, key, k: int) -> Column:
    """R1 within a row: the first ``k`` elements of an array by ``key``, in order."""
    keyed = F.array_sort(F.transform(values, lambda v: F.struct(key(v).alias("key"), v.alias("value"))))
    return F.slice(F.transform(keyed, lambda x: x["value"]), 1, k)


def first_best(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """R2: per key the first row in ``order``, which must settle ties."""
    return top_k(rows, keys, order, 1, "__rank").drop("__rank")


def argmax_first(values: Column) -> Column:
    """Position from 0 of the greatest element, the first of equals."""
    return F.array_position(values, F.array_max(values)).cast("int") - 1


def forward_fill(value: Column, keys: Sequence[str], order: Sequence[str], start: Column | None = None) -> Column:
    """The last known value up to each row, ``start`` before the first; for keys of which one task can hold the rows."""
    filled = F.last(value, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return filled if start is None else F.coalesce(filled, start)


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """``rows`` dealt by ranges of keys and order, with ``__part``: a key of any size lies in consecutive parts.

    Windows by key and ``__part`` see no more than a part; what a key carries from
    one part to the next is one row a part.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).withColumn("__part", F.spark_partition_id()))


def filled_forward(rows: DataFrame, value: Column, keys: Sequence[str], order: Sequence[str], name: str, start: Column | None = None) -> DataFrame:
    """R10 for keys of any size: the last known value, carried from part to part."""
    placed = runs(rows.withColumn("__value", value), keys, order)
    known = F.when(F.col("__value").isNotNull(), F.struct(*order, "__value"))
    last = placed.groupBy(*keys, "__part").agg(F.max(known).alias("__last"))
    before = F.last("__last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    carried = last.select(*keys, "__part", before.getField("__value").alias("__carried"))
    found = placed.join(carried, [*keys, "__part"])
    own = F.last("__value", ignorenulls=True).over(Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn(name, F.coalesce(own, "__carried", *([] if start is None else [start]))).drop("__part", "__value", "__carried")


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "place") -> DataFrame:
    """The place of each row within its key, from 1, for keys of any size: a place in its part and the counts of parts before."""
    placed = runs(rows, keys, order)
    sizes = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = placed.join(sizes.select(*keys, "__part", before.alias("__base")), [*keys, "__part"])
    return found.withColumn(name, F.col("__base") + F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order))).drop("__part", "__base")


def ordinals(rows: DataFrame, order: Sequence[str], name: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """The place of each row in a global order, from 0.

    Rows are dealt by ranges and sorted where they lie; only the counts of
    partitions are summed in one place.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = cut(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__within", within))
    sizes = sorted_rows.groupBy("__part").agg(F.count("*").alias("__n"))
    base = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sorted_rows.join(sizes.select("__part", base.alias("__base")), "__part").withColumn(name, F.col("__base") + F.col("__within")).drop("__part", "__within", "__base")


def uniform_places(n: int, k: int) -> list[int]:
    """``k`` places spread evenly over ``n``, first and last included, truncated to whole numbers."""
    if k >= n:
        return list(range(n))
    return [0] if k == 1 else [i * (n - 1) // (k - 1) for i in range(k)]


def uniform_sample(rows: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """The rows at evenly spread ordinals; the places are made where they are joined."""
    placed = ordinals(rows, order, "__ordinal")
    n = rows.count()
    spark = rows.sparkSession
    if k >= n:
        return placed.drop("__ordinal")
    step = F.expr(f"cast(cast(id as decimal(20,0)) * {n - 1} div {max(1, k - 1)} as long)")
    places = spark.range(k).select(step.alias("__ordinal"))
    return placed.join(places, "__ordinal").drop("__ordinal")


def limit_ordered(rows: DataFrame, order: Sequence[str], n: int, at_once: int = 10_000) -> DataFrame:
    """S3: the first ``n`` rows by ``order``, which plain limit doesn't promise; more than ``at_once`` of them by their ordinals, so that no task holds all."""
    if n <= at_once:
        return rows.orderBy(*order).limit(n)
    return ordinals(rows, order, "__ordinal").where(F.col("__ordinal") < n).drop("__ordinal")


def order_violations(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column) -> DataFrame:
    """Per key, rows whose value isn't above the one before, and rows that repeat it."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    marked = rows.select(*keys, (before > value).alias("__falls"), (before == value).alias("__repeats"))
    return marked.groupBy(*keys).agg(F.count_if("__falls").alias("falls"), F.count_if("__repeats").alias("repeats"))


def batches(rows: DataFrame, keys: Sequence[str], order: Sequence[str], size: int, name: str = "batch") -> DataFrame:
    """The batch of each row within its key, ``size`` rows each and a short last one."""
    found = numbered(rows, keys, order, "__place")
    return found.withColumn(name, F.expr(f"(__place - 1) div {size}")).drop("__place")
