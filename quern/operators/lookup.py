"""Lookups as joins; Catalyst broadcasts what is small by its statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed_attributes(facts: DataFrame, dimension: DataFrame, key: str, order: Sequence[Column]) -> DataFrame:
    """Inner join with a dimension of which one row per key, the first in ``order``, counts."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    one = dimension.withColumn("__place", place).where("__place = 1").drop("__place")
    return facts.join(one, key)


def left_lookup(facts: DataFrame, dimension: DataFrame, on: Column, value: Column, fallbacks: Sequence[Column], name: str) -> DataFrame:
    """The dimension's value where it has one, else the first fallback that isn't null."""
    return facts.join(dimension, on, "left").withColumn(name, F.coalesce(value, *fallbacks))


def last_match(history: DataFrame, book: DataFrame, key: str, game: str, ply: str, entry: Sequence[str]) -> DataFrame:
    """Per game the entry of the latest ply whose key the book holds, null where none is."""
    found = history.join(book, key, "left")
    latest = F.max(F.when(F.col(entry[0]).isNotNull(), F.struct(ply, *entry)))
    last = found.groupBy(game).agg(latest.alias("__last"))
    return last.select(game, F.col(f"__last.{ply}").alias(ply), *[F.col(f"__last.{c}").alias(c) for c in entry])


def longest_prefix(rows: DataFrame, steps: str, book: DataFrame, prefix: str, name: str, id_col: str) -> DataFrame:
    """The name of the longest sequence of the book with which a row's steps begin.

    Every prefix of the steps up to the book's longest meets the book in an
    equi-join; a row's best is kept by one aggregation.
    """
    longest = book.agg(F.max(F.size(prefix))).first()[0] or 0
    if not longest:
        return rows.select(id_col, F.lit(None).cast("int").alias("matched"), F.lit(None).cast("string").alias(name))
    lengths = F.sequence(F.lit(1), F.least(F.size(steps), F.lit(longest)))
    prefixes = rows.where(F.size(steps) > 0).select(id_col, F.explode(F.transform(lengths, lambda n: F.slice(steps, 1, n))).alias("__prefix"))
    found = prefixes.join(book.select(F.col(prefix).alias("__prefix"), F.col(name)), "__prefix")
    best = found.groupBy(id_col).agg(F.max(F.struct(F.size("__prefix").alias("n"), F.col(name))).alias("__best"))
    return rows.select(id_col).join(best, id_col, "left").select(id_col, F.col("__best.n").alias("matched"), F.col(f"__best.{name}").alias(name))


def first_steps(rows: DataFrame, key: str, order: Sequence[str], step: str, most: int, name: str = "steps") -> DataFrame:
    """The first ``most`` steps of each key in order; ranked before they are collected, so a long history sends no more."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    first = rows.select(key, step, place.alias("__place")).where(F.col("__place") <= most)
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("__place", step))), lambda r: r[step]).alias(name))


def missing(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose key ``right`` lacks."""
    return left.join(right, list(on), "left_anti")


def gather(values: Column, places: Column, none: Column | None = None) -> Column:
    """The elements at ``places`` (from 0); negative places and places beyond the end give ``none``."""
    return F.transform(places, lambda i: F.coalesce(F.when(i >= 0, F.try_element_at(values, (i + 1).cast("int"))), none) if none is not None else F.when(i >= 0, F.try_element_at(values, (i + 1).cast("int"))))


def adjacent_pairs(rows: DataFrame, key: str, order: str, columns: Sequence[str], first: Column, second: Column) -> DataFrame:
    """Each row that is ``first`` with its successor in order where that is ``second``."""
    w = Window.partitionBy(key).orderBy(order)
    ahead = rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).withColumn("__ok", F.lead(second).over(w))
    return ahead.where(first & F.col("__ok")).drop("__ok")


def evaluate_once(rows: DataFrame, key: str, evaluate) -> DataFrame:
    """``evaluate`` sees each distinct key once; its results are joined to all rows."""
    return rows.join(evaluate(rows.select(key).distinct()), key, "left")
