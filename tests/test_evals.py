import gzip
import json
from pathlib import Path

import pytest

from quern.functions.records import EvalConfig, judged
from quern.functions.rules import START
from quern.plans import evals


def record(pvs, fen=START, depth=20, knodes=1000, **more):
    return json.dumps({"fen": fen, "evals": [{"depth": depth, "knodes": knodes, "pvs": pvs, **more}]})


def pv(cp, line):
    return {"cp": cp, "line": line}


@pytest.fixture(scope="module")
def judge(spark):
    def run(texts, **config):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string").coalesce(1)
        return judged(rows, EvalConfig(**config)).orderBy("i").collect()

    return run


def test_scores_are_kept_and_ranked(judge):
    black = START.replace(" w ", " b ")
    a, b = judge([record([pv(30, "e2e4 e7e5"), pv(20, "d2d4 d7d5"), pv(20, "d2d4 g8f6")]), record([pv(200, "e7e5")], fen=black)])
    assert (a["policy_indices"], a["policy_scores"], a["score"], a["depth"]) == ([877, 804], [30, 20], 30, 20)
    assert b["score"] == -200


def two(a, b):
    return json.dumps({"fen": START, "evals": [a, b]})


def test_choice_of_snapshots(judge):
    deep, wide = {"depth": 30, "pvs": [pv(25, "e2e4")]}, {"depth": 18, "pvs": [pv(31, "d2d4"), pv(28, "e2e4")]}
    near, other = {"depth": 30, "knodes": 2000, "pvs": [pv(25, "e2e4")]}, {"depth": 28, "knodes": 1000, "pvs": [pv(30, "e2e4"), pv(20, "d2d4")]}
    far = two({"depth": 30, "pvs": [pv(300, "e2e4")]}, {"depth": 28, "pvs": [pv(-300, "e2e4"), pv(-400, "d2d4")]})
    a, b, c = judge([two(deep, wide), two(near, other), far])
    assert a["policy_scores"] == [25] and a["policy_depth"] == 30 and a["counts"] == {"depth_fallbacks": 1}
    assert (b["score"], b["policy_scores"], b["value_knodes"], b["policy_knodes"]) == (25, [30, 20], 2000, 1000)
    assert c["policy_scores"] == [300] and c["counts"] == {"value_disagreements": 1}
    assert judge([two(near, other)], policy_max_depth_gap=0)[0]["policy_scores"] == [25]
    first, last = judge([two({"depth": 20, "pvs": [pv(1, "e2e4")]}, {"depth": 20, "pvs": [pv(2, "d2d4")]}), two({"depth": 20, "pvs": [pv(2, "d2d4")]}, {"depth": 20, "pvs": [pv(1, "e2e4")]})])
    assert (first["score"], last["score"]) == (1, 2) and first["counts"] == {"move_disagreements": 1}


BAD = [{"cp": 1, "mate": 2}, {}, {"cp": True}, {"cp": "30"}, {"cp": 30.0}, {"mate": 0}, {"cp": 1, "lowerbound": True}, {"cp": 1, "line": "e2e5"}, {"cp": 1, "line": "e2e4 e7e3"}, {"cp": 1, "line": None}, {"cp": 1, "line": " \t"}]


def test_bad_lines(judge):
    rows = judge([record([{"line": "e2e4", **bad}, pv(1, "d2d4")]) for bad in BAD] + [record([None, pv(1, "d2d4")])])
    assert {r["reason"] for r in rows} == {"quality"} and all(r["board"] is None and r["policy_indices"] is None for r in rows)
    assert all(r["counts"] == {"evaluations_rejected": 1, "lines_rejected": 1} for r in rows)
    rows = judge([record([pv(1, "d2d4"), {"line": "e2e4", **bad}]) for bad in BAD])
    assert all(r["policy_scores"] == [1] and r["counts"] == {"lines_rejected": 1} for r in rows)
    short, whole = record([pv(1, "e2e4 e7e5 e1e3")]), record([pv(1, "e2e4 e7e5 g1f3")])
    assert [judge([short, whole], validate_pv_plies=n)[0]["reason"] for n in (0, 1, 2, 3)] == ["quality", "kept", "kept", "quality"]


def test_infinite_score_spoils_its_line_alone(judge):
    (out,) = judge(['{"fen": "%s", "evals": [{"depth": 20, "pvs": [{"cp": 3, "line": "e2e4"}, {"cp": Infinity, "line": "d2d4"}]}]}' % START])
    assert out["policy_scores"] == [3] and out["counts"]["lines_rejected"] == 1


def test_reasons(judge):
    over = "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1"
    texts = ["null", "[]", '{"fen": 42, "evals": []}', "broken", "[" * 100_000, json.dumps({"fen": START, "evals": []}), record([pv(1, "e2e4")], fen="8/8/8/8/8/8/8/8 w - - 0 1"), record([pv(1, "e2e4")], fen="x"), record([pv(1, "e2e4")], depth=5), record([pv(1, "e2e4")], depth="20"), record([pv(1, "a1a2")], fen=over), record([pv(1, "e2e4")], lowerbound=True), record([pv(1, "e2e4")], knodes=-1), record([pv(1, "e2e4")], depth=70_000), json.dumps({"fen": START, "evals": [None, 3]}), None]
    wanted = ["schema"] * 5 + ["empty", "fen", "fen", "depth", "depth", "terminal", "quality", "quality", "quality", "depth", "schema"]
    assert [r["reason"] for r in judge(texts)] == wanted


def test_repeated_moves(judge):
    same, clash = judge([record([pv(30, "e2e4"), pv(30, "e2e4"), pv(20, "d2d4")]), record([pv(30, "e2e4"), pv(1, "a1a1"), pv(31, "e2e4"), pv(1, "a1a1")])], max_policy_targets=2)
    assert same["counts"] == {"lines_repeated": 1} and same["policy_scores"] == [30, 20]
    assert clash["reason"] == "quality" and clash["counts"] == {"evaluations_rejected": 1, "lines_rejected": 1, "lines_repeated": 1}
    with pytest.raises(ValueError, match="."):
        EvalConfig(min_depth=0)


FENS = [START, START.replace(" w ", " b "), "8/8/8/8/8/4k3/4p3/4K2R w K - 0 1", "4k3/8/8/8/8/8/4P3/4K3 w - - 3 9"]


def write(folder: Path, lines: list[str]) -> str:
    folder.mkdir(parents=True)
    with gzip.open(folder / "a.jsonl.gz", "wt") as f:
        f.write("\n\n".join(lines))
    return str(folder)


def test_build_read_audit(spark, tmp_path):
    lines = ["broken", record([pv(5, "e2e4")], depth=14), record([pv(30, "d2d4")], depth=24), record([pv(7, "e7e5")], fen=FENS[1]), record([pv(9, "e2e4"), pv(4, "e1d1")], fen=FENS[3])]
    raw = write(tmp_path / "raw", lines)
    config = EvalConfig(validation_fraction=0.2, test_fraction=0.2, shard_size=2)
    out = str(tmp_path / "out")
    manifest = evals.build(spark, raw, out, config)
    assert manifest["stats"] | {"lines_schema": 1, "lines_kept": 4, "duplicates": 1, "conflicts": 1, "replacements": 1} == manifest["stats"]
    rows = evals.read(spark, out).collect()
    assert len(rows) == 3 and {r["score"] for r in rows} == {30, -7, 9}
    report = evals.audit(spark, out, legal_samples=0)
    assert report["valid"] and report["complete_legal_scan"], report["errors"]
    assert report["turns"] == {"white": 2, "black": 1} and sum(report["score_bin_counts"]) == 3
    again = write(tmp_path / "raw2", lines[::-1])
    other = evals.build(spark, again, str(tmp_path / "out2"), config)
    assert {s["split"]: 0 for s in other["shards"]} == {s["split"]: 0 for s in manifest["shards"]}
    with pytest.raises(FileExistsError):
        evals.build(spark, raw, out, config)
    file = Path(out) / manifest["shards"][0]["path"]
    data = bytearray(file.read_bytes())
    data[len(data) // 3] ^= 1
    file.write_bytes(data)
    (file.parent / f".{file.name}.crc").unlink()
    assert "checksum" in str(evals.audit(spark, out)["errors"])


def test_nothing_is_published_without_positions(spark, tmp_path):
    raw = write(tmp_path / "raw", ["null", "[]"])
    with pytest.raises(ValueError, match="no usable"):
        evals.build(spark, raw, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and [p.name for p in tmp_path.iterdir()] == ["raw"]


def test_limits_follow_source_order(spark, tmp_path):
    raw = tmp_path / "raw"
    (raw / "b").mkdir(parents=True)
    (raw / "a.jsonl").write_text("\n".join(["broken", record([pv(1, "e2e4")]), record([pv(2, "e7e5")], fen=FENS[1])]))
    with gzip.open(raw / "b" / "c.jsonl.gz", "wt") as f:
        f.write(record([pv(9, "e2e4")], fen=FENS[3]))
    one = evals.build(spark, str(raw), str(tmp_path / "one"), max_positions=2)
    assert one["stats"] | {"lines_schema": 1, "lines_kept": 2} == one["stats"] and sum(s["rows"] for s in one["shards"]) == 2
    two_ = evals.build(spark, str(raw), str(tmp_path / "two"), max_records=2)
    assert two_["stats"] | {"lines_schema": 1, "lines_kept": 1} == two_["stats"]
    every = evals.build(spark, str(raw), str(tmp_path / "every"), max_positions=99)
    assert every["stats"]["lines_kept"] == 3


def test_lines_are_numbered_in_their_file(spark, tmp_path):
    import zstandard

    from quern.sources.lines import record_lines

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl.zst").write_bytes(zstandard.ZstdCompressor().compress(b"p\n\n  \nq"))
    (tmp_path / "in" / "b.jsonl").write_text("".join(f"{i}\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = [(r["file"][-7:], r["line"], r["value"]) for r in record_lines(spark, str(tmp_path / "in"), 3).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(v for f, i, v in rows if f == "onl.zst" for v in [(i, v)]) == [(0, "p"), (3, "q")]
    assert len(rows) == 5002 and all(str(i) == v for f, i, v in rows if f == "b.jsonl")
    with pytest.raises(FileNotFoundError):
        record_lines(spark, str(tmp_path / "nothing"))


def test_clock_planes(spark, tmp_path):
    raw = write(tmp_path / "raw", [record([pv(5, "e2e4")]), record([pv(7, "e7e5")], fen=FENS[1])])
    evals.build(spark, raw, str(tmp_path / "out"))
    evals.check_input_planes(spark, str(tmp_path / "out"), 18)
    with pytest.raises(ValueError, match="constant"):
        evals.check_input_planes(spark, str(tmp_path / "out"), 20)
    raw = write(tmp_path / "raw2", [record([pv(5, "e2e4")]), record([pv(9, "e2e4")], fen=FENS[3])])
    evals.build(spark, raw, str(tmp_path / "out2"))
    evals.check_input_planes(spark, str(tmp_path / "out2"), 20)
    old = spark.createDataFrame([(bytearray(144),), (bytearray(144),)], "board binary")
    assert not evals.clocks_vary(old)
