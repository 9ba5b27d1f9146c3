"""The evals dataset: validated, deduplicated, split, written and audited."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import encode
from quern.functions.records import EvalConfig, judged
from quern.operators import aggregates, dedup, ranking, shaping
from quern.operators.stage import cut
from quern.sources.lines import record_lines
from quern.sources.store import Store

SCHEMA, SPLITS = "quern-evals-v1", ("train", "validation", "test")
SAMPLE = T.StructType.fromJson(
    {
        "type": "struct",
        "fields": [
            {"name": n, "type": t, "nullable": True, "metadata": {}}
            for n, t in [("position_hash", "binary"), ("board", "binary"), ("score", "short"), ("depth", "integer"), ("policy_indices", {"type": "array", "elementType": "short", "containsNull": True}), ("policy_scores", {"type": "array", "elementType": "short", "containsNull": True}), ("policy_depth", "integer"), ("value_knodes", "decimal(20,0)"), ("policy_knodes", "decimal(20,0)")]
        ],
    }
)
def statistics(rows: DataFrame) -> dict[str, int]:
    """A3: lines by reason and the sums of their counters."""
    reasons = {f"lines_{r['reason']}": r["n"] for r in aggregates.histogram(rows, F.col("reason"), "reason").collect()}
    sums = rows.select(F.explode("counts").alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))
    return reasons | {r["name"]: r["n"] for r in sums.collect()}


EVIDENCE = ["depth", "value_knodes", "policy_depth", "width", "policy_knodes", "score", "policy_indices", "policy_scores"]


def samples(rows: DataFrame, config: EvalConfig) -> DataFrame:
    """The samples of ``rows``, each position once by strongest evidence, with their split."""
    found = rows.where("reason = 'kept'").select(*SAMPLE.fieldNames())
    if config.deduplicate:
        found = found.withColumn("width", F.size("policy_indices"))
        found = dedup.strongest(found, ["position_hash", "board"], EVIDENCE).drop("width")

    @F.pandas_udf(T.StringType())
    def split(keys: pd.Series) -> pd.Series:
        return pd.Series([encode.split_of(bytes(k), config.validation_fraction, config.test_fraction, config.split_seed, config.split_tag.encode()) for k in keys])

    return found.withColumn("split", split("position_hash"))


def duplicate_counters(rows: DataFrame) -> dict[str, int]:
    """A2: duplicates, conflicts of score and replacements, by arrival."""
    found = rows.where("reason = 'kept'").withColumn("width", F.size("policy_indices"))
    counted = dedup.counters(found, ["position_hash", "board"], EVIDENCE, ["file", "line"], F.col("score"))
    return counted.select("duplicates", "conflicts", "replacements").first().asDict()


def identity(manifest: dict) -> str:
    """P5: one hash of what a dataset holds and how it was made."""
    content = {k: manifest[k] for k in ("dataset_schema", "config", "shards")}
    return hashlib.sha256(json.dumps(content, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def checksums(spark: SparkSession, folder: str) -> DataFrame:
    """P5: path below ``folder``, bytes, sha256 of each data file; a file holds at most a shard's records, far less than the reader's 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.regexp_extract("path", r"(split=[^/]+/[^/]+)$", 1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def up_to(rows: DataFrame, accepted: int) -> DataFrame:
    """S3: the rows in source order up to that of the ``accepted``-th kept one."""
    last = ranking.limit_ordered(rows.where("reason = 'kept'").select("file", "line"), ["file", "line"], accepted)
    last = last.agg(F.count("*").alias("n"), F.max(F.struct("file", "line")).alias("at")).first()
    if last["n"] < accepted:
        return rows
    file, line = last["at"]
    return rows.where((F.col("file") < file) | ((F.col("file") == file) & (F.col("line") <= line)))


def build(spark: SparkSession, raw: str, out: str, config: EvalConfig | None = None, max_records: int | None = None, max_positions: int | None = None) -> dict:
    """K1-K3, S3: write the dataset of the record files below ``raw`` to ``out``, whole or not at all; its manifest.

    ``max_records`` limits the lines that are read, ``max_positions`` the positions
    accepted, both in source order and before copies are dropped; lines after the
    last accepted one count nowhere. Files are written beside ``out`` and moved
    there at the end, on any file system that Spark writes. The sources must be as
    they were when the build began.
    """
    config = config or EvalConfig()
    target, source = Store(spark, out), Store(spark, raw)
    if not target.empty():
        raise FileExistsError(f"{out} isn't empty")
    before = source.listing()
    lines = record_lines(spark, raw)
    if max_records is not None:
        lines = ranking.limit_ordered(lines, ["file", "line"], max_records)
    rows = cut(judged(lines, config))
    if max_positions is not None:
        rows = up_to(rows, max_positions)
    stats = statistics(rows)
    if not stats.get("lines_kept"):
        raise ValueError("no usable positions")
    if config.deduplicate:
        stats |= duplicate_counters(rows)
    home, _, name = target.root.rpartition("/")
    passing = Store(spark, f"{home}/.{name}-{uuid.uuid4().hex}")
    try:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = samples(rows, config).repartitionByRange(parts, "split", "position_hash", "board").sortWithinPartitions("split", "position_hash", "board")
        ranged.write.partitionBy("split").option("maxRecordsPerFile", config.shard_size).parquet(passing.root)
        counted = spark.read.parquet(passing.root).groupBy(F.regexp_extract("_metadata.file_path", r"(split=[^/]+/[^/]+)$", 1).alias("path")).agg(F.count("*").alias("rows"))
        shards = [{**r.asDict(), "split": r["path"].split("/")[0].removeprefix("split=")} for r in checksums(spark, passing.root).join(counted, "path").orderBy("path").collect()]
        manifest = {"dataset_schema": SCHEMA, "status": "complete", "config": asdict(config), "stats": stats, "shards": shards}
        manifest["dataset_id"] = identity(manifest)
        if source.listing() != before:
            raise RuntimeError("the sources changed during the build")
        passing.write("metadata.json", json.dumps(manifest, indent=1))
        passing.publish(target)
    except BaseException:
        passing.delete()
        raise
    return manifest


def manifest_problem(manifest: dict) -> str | None:
    """Why a manifest can't be used, or None."""
    if manifest.get("dataset_schema") != SCHEMA or manifest.get("status") != "complete":
        return "not a complete dataset of this kind"
    return None if identity(manifest) == manifest.get("dataset_id") else "the manifest doesn't match its identity"


def load_manifest(spark: SparkSession, out: str) -> dict:
    """A dataset's manifest; raises where it is incomplete or altered."""
    store = Store(spark, out)
    if not store.exists("metadata.json"):
        raise ValueError(f"{out} has no manifest")
    manifest = json.loads(store.read("metadata.json"))
    if problem := manifest_problem(manifest):
        raise ValueError(problem)
    return manifest


def path_problem(path: str, split: str) -> str | None:
    """why a listed path isn't one of a data file of a split, or None."""
    parts = path.split("/")
    if len(parts) != 2 or ".." in parts or "" in parts or not parts[0].startswith("split=") or parts[0].removeprefix("split=") not in SPLITS or not parts[1].endswith(".parquet"):
        return f"unsafe path: {path}"
    return None if split == parts[0].removeprefix("split=") else f"the path isn't of its split: {path}"


def check_shards(spark: SparkSession, out: str, manifest: dict, split: str | None = None) -> list[str]:
    """The listed files of a split; raises at unsafe, missing, altered or unlisted ones."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"no split: {split}")
    store, listed = Store(spark, out), [entry["path"] for entry in manifest["shards"]]
    for entry in manifest["shards"]:
        if problem := path_problem(entry["path"], entry["split"]):
            raise ValueError(problem)
    actual = {name: size for name, size, _ in store.listing() if name.endswith(".parquet")}
    for entry in manifest["shards"]:
        if actual.get(entry["path"]) != entry["bytes"] or store.linked(entry["path"]):
            raise ValueError(f"missing or altered: {entry['path']}")
    if len(set(listed)) != len(listed) or set(listed) != set(actual):
        raise ValueError("files are listed twice, or aren't listed")
    return [p for p in listed if split is None or p.startswith(f"split={split}/")]


def read(spark: SparkSession, out: str, split: str | None = None) -> DataFrame:
    """The samples of a dataset, or of one split, by the files that the manifest lists."""
    return _read(spark, out, check_shards(spark, out, load_manifest(spark, out), split))


def _read(spark: SparkSession, out: str, paths: list[str]) -> DataFrame:
    kind = T.StructType([*SAMPLE.fields, T.StructField("split", T.StringType())])
    if not paths:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).option("basePath", out).parquet(*[f"{out}/{p}" for p in paths])


def clocks_vary(rows: DataFrame, board: str = "board") -> bool:
    """whether the clocks of packed positions differ; positions without clocks have none that do."""
    def byte(at: int) -> Column:
        return F.conv(F.hex(F.substring(board, at, 1)), 16, 10).cast("int")

    width = F.octet_length(board)
    clocks = F.when(width == 146, F.struct(byte(145).alias("a"), byte(146).alias("b"))).when(width == 160, F.struct(F.shiftright(byte(145), 7).alias("a"), F.shiftright(byte(153), 7).alias("b")))
    found = rows.select(clocks.alias("clocks")).distinct().limit(2).collect()
    return len(found) > 1 and all(r["clocks"] is not None for r in found)


def check_input_planes(spark: SparkSession, out: str, channels: int, shards: int = 3) -> None:
    """refuse a model that reads the two clock planes (over 18) where they are constant in the first ``shards`` files."""
    paths = check_shards(spark, out, load_manifest(spark, out))[:shards]
    if channels > 18 and paths and not clocks_vary(_read(spark, out, paths)):
        raise ValueError(f"{channels} planes include the clocks, which are constant in this dataset; use 18")


def policy_problem(places: Column, scores: Column, most: int) -> Column:
    """What is wrong with a position's policy targets, or null."""
    outside = F.exists(places, lambda i: i.isNull() | (i < 0) | (i >= 4672))
    beyond = F.exists(scores, lambda s: s.isNull() | (F.abs(s.cast("int")) > shaping.MATE + shaping.HORIZON))
    return (
        F.when(places.isNull() | (F.size(places) == 0), "none")
        .when(F.size(places) != F.size(scores), "lengths")
        .when(F.size(places) > most, "too many")
        .when(outside, "outside")
        .when(F.size(F.array_distinct(places)) < F.size(places), "repeated")
        .when(beyond, "score")
    )


def audit(spark: SparkSession, out: str, legal_samples: int = 128, verify_checksums: bool = True) -> dict:
    """A report on a dataset; structure of every row, legality of evenly spread ones (0: of all)."""
    report: dict = {"valid": False, "errors": [], "limitations": ["Grouping by position proves no independence of games or times."]}
    try:
        manifest = load_manifest(spark, out)
        paths = check_shards(spark, out, manifest)
        if verify_checksums:
            now = {r["path"]: r["sha256"] for r in checksums(spark, out).collect()}
            if altered := [s["path"] for s in manifest["shards"] if now.get(s["path"]) != s["sha256"]]:
                raise ValueError(f"checksums differ: {altered[:32]}")
        rows = _read(spark, out, paths)
    except (OSError, ValueError, KeyError) as e:
        return report | {"errors": [str(e)], "error_count": 1}
    config = EvalConfig(**manifest["config"])

    @F.pandas_udf("errors array<string>, pieces int, hash_ok boolean, split string, white boolean, half int, full int")
    def look(boards: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        out = []
        for b, h in zip(boards, hashes, strict=True):
            b = bytes(b)
            key = encode.position_key(b)
            out.append((encode.packed_board_errors(b), int.from_bytes(b[:96], "big").bit_count(), key == bytes(h), encode.split_of(key, config.validation_fraction, config.test_fraction, config.split_seed, config.split_tag.encode()), b[96] == 255, b[-2], b[-1]))
        return pd.DataFrame(out, columns=["errors", "pieces", "hash_ok", "split", "white", "half", "full"])

    seen = rows.withColumn("look", look("board", "position_hash"))
    gap = F.abs(shaping.expected(F.col("score")) - shaping.expected(F.array_max("policy_scores")))
    bad_targets = policy_problem(F.col("policy_indices"), F.col("policy_scores"), config.max_policy_targets)
    total = seen.agg(
        F.count("*").alias("positions_checked"),
        F.count_if(bad_targets.isNotNull()).alias("policy_shape"),
        F.count_if(~F.col("look.hash_ok")).alias("hash_mismatch"),
        F.count_if(F.col("look.split") != F.col("split")).alias("wrong_split"),
        F.count_if((F.col("depth") < config.min_depth) | (F.col("policy_depth") < F.col("depth") - config.policy_max_depth_gap)).alias("depth_policy"),
        F.count_if(gap > config.max_policy_value_gap + 1e-7).alias("value_gap"),
        F.count_if(F.size("look.errors") > 0).alias("invalid_positions"),
        F.count_if("look.white").alias("white"),
        F.avg(gap).alias("gap_mean"),
        F.max(gap).alias("gap_max"),
        F.min("look.half").alias("half_min"),
        F.max("look.half").alias("half_max"),
        F.min("look.full").alias("full_min"),
        F.max("look.full").alias("full_max"),
    ).first().asDict()
    repeated = rows.groupBy("position_hash", "board").count().where("count > 1").count() if config.deduplicate else 0
    n = total["positions_checked"]
    sampled = rows if legal_samples == 0 or n <= legal_samples else ranking.uniform_sample(rows, ["position_hash", "board"], legal_samples)

    @F.pandas_udf(T.BooleanType())
    def legal(boards: pd.Series, targets: pd.Series) -> pd.Series:
        def ok(b: bytes, t) -> bool:
            try:
                return set(t) <= set(encode.legal_indices(encode.unpack(bytes(b))))
            except ValueError:
                return False

        return pd.Series([ok(b, t) for b, t in zip(boards, targets, strict=True)])

    checked = sampled.select(legal("board", "policy_indices").alias("ok")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("bad")).first()
    board_errors = {r["value"]: r["n"] for r in aggregates.histogram(seen.select(F.explode("look.errors").alias("e")), F.col("e")).collect()}
    report["errors"] += [f"{k} in {total[k]} positions" for k in ("policy_shape", "hash_mismatch", "wrong_split", "depth_policy", "value_gap") if total[k]]
    report["errors"] += [f"{k} in {v} positions" for k, v in sorted(board_errors.items())]
    report["errors"] += [f"{repeated} positions repeat"] * bool(repeated) + [f"illegal policy targets or positions in {checked['bad']} rows"] * bool(checked["bad"])
    if sum(s["rows"] for s in manifest["shards"]) != n:
        report["errors"].append("the manifest's row counts don't hold")
    report |= {
        "dataset_id": manifest["dataset_id"],
        "positions_checked": n,
        "legal_positions_checked": checked["n"],
        "invalid_positions": total["invalid_positions"] + checked["bad"],
        "board_errors": board_errors,
        "split_positions": {r["split"]: r["count"] for r in rows.groupBy("split").count().collect()},
        "policy_candidates": _hist(rows, F.size("policy_indices")),
        "piece_counts": _hist(seen, F.col("look.pieces")),
        "depth": _hist(rows, F.col("depth")),
        "policy_depth_gap": _hist(rows, F.col("depth") - F.col("policy_depth")),
        "turns": {"white": total["white"], "black": n - total["white"]},
        "score_bin_edges": aggregates.SCORE_EDGES,
        "score_bin_counts": [r["n"] for r in aggregates.fixed_bins(rows, F.col("score")).orderBy("bin").collect()],
        "clock_bytes_min": [total["half_min"], total["full_min"]],
        "clock_bytes_max": [total["half_max"], total["full_max"]],
        "value_policy_expected_gap_mean": total["gap_mean"],
        "value_policy_expected_gap_max": total["gap_max"],
        "checksums_verified": len(manifest["shards"]) if verify_checksums else 0,
    }
    report["error_count"] = len(report["errors"])
    report["valid"] = not report["errors"]
    report["complete_legal_scan"] = report["valid"] and checked["n"] == n
    if not report["complete_legal_scan"]:
        report["limitations"].append("Legality wasn't checked for every position.")
    report["errors"] = report["errors"][:32]
    return report


def _hist(rows: DataFrame, value) -> dict[str, int]:
    return {str(r["value"]): r["n"] for r in aggregates.histogram(rows, value).orderBy("value").collect()}
