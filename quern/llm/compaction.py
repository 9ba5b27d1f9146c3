"""Size-tiered compaction of immutable shards under a versioned manifest.

An arrival is written as small shards and enters the store when a manifest that
lists them is committed. Shards below the target size fall into tiers by size;
when a tier has gathered ``fanout`` of them, the run is rewritten into files of
about the target size and a new manifest puts these in place of the run. A
manifest is written aside and renamed to the next version's name, which fails if
another writer took that version; readers keep the version they opened.

Rows only pass through Spark's own scans and writers: no shuffle, and each task
writes one target-sized file. The driver holds the manifest, a line for each
shard. Columns are kept as they come, nulls and repeated rows included; an empty
arrival commits a version without new shards.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import work_dir


@dataclass(frozen=True)
class Stored:
    """A shard: its file, size, rows, and the version that added it."""

    path: str
    bytes: int
    rows: int
    version: int


class Conflict(RuntimeError):
    """Another writer committed this version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fanout: int = 8):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.target, self.least, self.fanout = target_bytes, least_bytes, fanout
        jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(self._conf)

    def version(self) -> int:
        """The newest committed version, 0 before the first."""
        home = self._path(f"{self.folder}/manifest")
        if not self._files.exists(home):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(home)]
        return max((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> tuple[str | None, list[Stored]]:
        """(schema as JSON, shards) of a version."""
        version = self.version() if version is None else version
        if not version:
            return None, []
        stream = self._files.open(self._path(f"{self.folder}/manifest/v{version:012d}.json"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        held = json.loads(text)
        return held["schema"], [Stored(**s) for s in held["shards"]]

    def _commit(self, version: int, schema: str, shards: list[Stored]) -> int:
        jvm = self.spark._jvm
        passing = self._path(f"{self.folder}/manifest/.{uuid.uuid4().hex}")
        out = self._files.create(passing, False)
        try:
            out.write(bytearray(json.dumps({"schema": schema, "shards": [asdict(s) for s in shards]}).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        target = self._path(f"{self.folder}/manifest/v{version:012d}.json")
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(passing.toUri(), self._conf).rename(passing, target, options)
        except Exception as e:
            self._files.delete(passing, False)
            if self._files.exists(target):
                raise Conflict(f"version {version} is taken") from e
            raise
        return version

    def _listed(self, path: str, schema: str, version: int) -> dict[str, list[Stored]]:
        """The files below ``path`` with size and rows, by their folder."""
        rows = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(path)
        found = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
        out: dict[str, list[Stored]] = {}
        for r in sorted(found.collect()):
            out.setdefault(r["path"].rpartition("/")[0].rpartition("/")[2], []).append(Stored(r["path"], r["bytes"], r["rows"], version))
        return out

    def _write(self, rows: DataFrame, arrival: str | None = None) -> str:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        writer = rows.write.option("compression", "zstd")
        (writer.partitionBy(arrival) if arrival else writer).parquet(path)
        return path

    def _add(self, shards: list[Stored], schema: str, removed: frozenset[str] = frozenset(), tries: int = 20) -> int:
        """Commit what is left of the newest version together with ``shards``."""
        for _ in range(tries):
            version = self.version()
            _, held = self.manifest(version)
            if missing := removed - {s.path for s in held}:
                raise Conflict(f"{len(missing)} shards of the run were replaced by another writer")
            kept = [s for s in held if s.path not in removed]
            try:
                return self._commit(version + 1, schema, kept + [replace(s, version=version + 1) for s in shards])
            except Conflict:
                continue
        raise Conflict("too many writers")

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as small shards; the new version."""
        schema = rows.schema.json()
        path = self._write(rows)
        return self._add([s for group in self._listed(path, schema, 0).values() for s in group], schema)

    def append_arrivals(self, rows: DataFrame, arrival) -> list[int]:
        """Add each arrival of ``rows`` as a version of its own, one version if there is none; all are written in one pass."""
        schema = rows.schema.json()
        name = "_".join(["arrival", *rows.columns])
        path = self._write(rows.withColumn(name, arrival), name)
        arrived = [group for _, group in sorted(self._listed(path, schema, 0).items())]
        return [self._add(group, schema) for group in arrived or [[]]]

    def tier(self, size: int) -> int | None:
        """The tier of a shard by its size; none from half the target on."""
        if 2 * size >= self.target:
            return None
        return max(0, math.ceil(math.log(max(size, 1) / self.least, self.fanout)))

    def runs(self) -> list[list[Stored]]:
        """The runs that are due: of each tier with ``fanout`` shards, all of them."""
        tiers: dict[int, list[Stored]] = {}
        for s in self.manifest()[1]:
            if (t := self.tier(s.bytes)) is not None:
                tiers.setdefault(t, []).append(s)
        return [tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout]

    def compact(self) -> list[int]:
        """Merge runs until none is due; the versions committed."""
        done = []
        while due := self.runs():
            run = due[0]
            schema, _ = self.manifest()
            files = max(1, round(sum(s.bytes for s in run) / self.target))
            rows = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*[s.path for s in run])
            path = self._write(rows.coalesce(files))
            merged = [s for group in self._listed(path, schema, 0).values() for s in group]
            done.append(self._add(merged, schema, frozenset(s.path for s in run)))
        return done

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by the files that its manifest lists."""
        schema, shards = self.manifest(version)
        if schema is None:
            raise ValueError("nothing was committed")
        kind = T.StructType.fromJson(json.loads(schema))
        if not shards:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*[s.path for s in shards])

    def vacuum(self, keep: int = 1) -> int:
        """Delete files that none of the newest ``keep`` versions lists; how many."""
        newest = self.version()
        live = {s.path for v in range(max(1, newest - keep + 1), newest + 1) for s in self.manifest(v)[1]}
        gone = {s.path for v in range(1, newest + 1) if self._files.exists(self._path(f"{self.folder}/manifest/v{v:012d}.json")) for s in self.manifest(v)[1]} - live
        for path in gone:
            self._files.delete(self._path(path), False)
        for v in range(1, newest - keep + 1):
            self._files.delete(self._path(f"{self.folder}/manifest/v{v:012d}.json"), False)
        return len(gone)


def new_folder(spark: SparkSession) -> str:
    return work_dir(spark, "shards")
