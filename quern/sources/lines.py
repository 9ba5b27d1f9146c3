"""Scans of record, game and position files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.store import Store


def record_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """File, line (its number in the file, from 0), value of every line of ``*.jsonl*`` below ``path`` that isn't blank.

    Files compressed with gzip or zstandard are one task each until they are dealt
    out. A scan numbers lines as they come; the least number of each block of a
    file, and the counts of the blocks before it, make that the line's own. Both
    passes plan the same scan of the same listing, so their numbers agree; only a
    row for each block is summed.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": "*.jsonl*"}
    if not Store(spark, path).exists() or spark.read.options(**options).format("binaryFile").load(path).select("path").isEmpty():
        raise FileNotFoundError(f"no record files below {path}")
    scan = spark.read.options(**options).text(path)
    scan = scan.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seen"), "value")
    blocks = scan.groupBy("file", "block").agg(F.min("seen").alias("least"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = scan.join(blocks.select("file", "block", "least", before.alias("before")), ["file", "block"])
    lines = lines.select("file", (F.col("before") + F.col("seen") - F.col("least")).alias("line"), "value").where(F.trim(F.regexp_replace("value", r"\s+", " ")) != "")
    return lines.repartition(partitions) if partitions else lines


def whole_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """File, value of whole text files below ``path``; what is below ``_extracted`` is left out, a path counts once."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    found = found.select(F.col("_metadata.file_path").alias("file"), "value")
    return found.where(~F.col("file").contains("/_extracted/"))


def tsv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Rows of tab-separated volumes with a header."""
    return spark.read.option("sep", "\t").option("header", True).csv(paths)


def ordered(columns: list[str]) -> list[Column]:
    """Source order: by file, then by line."""
    return [F.col(c) for c in columns]
