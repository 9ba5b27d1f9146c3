"""Shared plumbing: working folders, written tables, files, worker memory, and components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch, and bytes that a writer of Parquet gathers before it writes them.
BATCH_ROWS, BATCH_BYTES, GROUP_BYTES = 500, 16 << 20, 16 << 20
#: Links that one task joins to components.
LAST = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that long texts don't fill a worker; bounds that are lower stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key))
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, str(most))


def release() -> None:
    """Give a worker's freed memory back to the machine."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def released(run):
    """A task's function over batches, after which the worker's memory is given back."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def larger(batches: Iterator, size: int = 8 << 20) -> Iterator:
    """Arrow batches joined to ones of about ``size`` bytes."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.nbytes
        if n >= size:
            yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def rest(spark: SparkSession) -> None:
    """Let executors and the driver collect their garbage and shrink their heaps, so that what one stage let them grow to isn't carried through the next.

    A task for each core calls the collector, and so does the driver, which then
    also drops what it holds of broadcasts and shuffles that nothing reads any more;
    where explicit calls are disabled nothing happens.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.java.lang.System.gc()


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder in the one that driver and executors share.

    It is taken from ``spark.checkpoint.dir``; unset, a local one is made and set
    where driver and executors are one machine, as in tests, and is an error
    elsewhere.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/quern-{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again, which ends its lineage; ``discard`` removes it."""
    spark = df.sparkSession
    path = work_dir(spark, name)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.quern_path = path
    return found


@contextmanager
def open_writers(spark: SparkSession, n: int) -> Iterator[None]:
    """Let a task write to so many folders of a partitioned table at once, rather than sort its rows by them first."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``cut`` wrote and nothing will read again."""
    for found in tables:
        remove(found.sparkSession, found.quern_path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str):
    """(file system, path) for a URI or a plain local path."""
    from pyarrow import fs

    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, parts) -> int:
    """Write ``parts`` as one file under a passing name and move it into place.

    A task that runs twice writes the same bytes to the same place.
    """
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    passing = f"{path}.{uuid.uuid4().hex}"
    size = 0
    with files.open_output_stream(passing) as out:
        for part in parts:
            out.write(part)
            size += len(part)
    files.move(passing, path)
    return size


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links`` (src, dst): node, component (its least node).

    Every round, each node goes over to the one among it and its neighbours whose
    hash is least, by another hash each time, and links are renamed by that. So a
    round takes a quarter of the nodes or more away, as an average over hashes,
    whatever the shape of the links: the number of rounds, and of the jobs that
    the driver keeps account of, follows the logarithm of their number and not the
    length of a chain. A rest of at most ``LAST`` links is joined by one task.
    The names that a node took are then followed from the last round to the first;
    rounds shrink, so this takes no more than they did. Both tables of each join are
    written ones, so adaptive execution can split a hub. Nothing but counts reaches
    the driver. An empty table of links gives an empty result.
    """
    pair = (F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    links = cut(links.where("src != dst").select(F.col("src").cast("long"), F.col("dst").cast("long")).select(*pair).distinct(), "links")
    gone: list[DataFrame] = []
    while links.count() > LAST:
        both = links.union(links.select("dst", "src"))
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(gone)), c).alias("hash"), F.col(c).alias("node"))
        name = both.groupBy("src").agg(F.min(rank("dst")).alias("least")).select(F.col("src").alias("node"), F.least("least", rank("src"))["node"].alias("name"))
        name = cut(name, "names")
        half = cut(links.join(name.select(F.col("node").alias("src"), F.col("name").alias("a")), "src").select("a", "dst"), "half")
        after = half.join(name.select(F.col("node").alias("dst"), F.col("name").alias("b")), "dst").where("a != b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        after = cut(after.select(*pair).distinct(), "links")
        discard(links, half)
        gone.append(name)
        links = after
    label = cut(links.coalesce(1).mapInArrow(released(_joined), "node long, name long"), "labels")
    discard(links)
    if not gone:
        return label.select("node", F.col("name").alias("component"))
    while gone:
        name, held = gone.pop(), label
        further = held.select(F.col("node").alias("name"), F.col("name").alias("further"))
        label = cut(name.join(further, "name", "left").select("node", F.coalesce("further", "name").alias("name")), "labels")
        discard(name, held)
    least = cut(label.groupBy("name").agg(F.min("node").alias("component")), "components")
    found = cut(label.join(least, "name").select("node", "component"), "labels")
    discard(label, least)
    return found


def _joined(batches: Iterator) -> Iterator:
    """node, name (the least of its component) of all links in one task."""
    import pyarrow as pa

    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    for at in range(0, len(nodes), BATCH_ROWS):
        some = nodes[at : at + BATCH_ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], names=["node", "name"])
