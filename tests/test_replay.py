import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import replay
from quern.functions.rules import START


def test_lines_histories_replays(spark):
    fool = ["f2f3", "e7e5", "g2g4", "d8h4"]
    df = spark.createDataFrame([(START, fool), (START, ["e2e5"]), ("bad", ["e2e4"])], "fen string, moves array<string>")
    got = [r[0] for r in df.select(replay.read_lines(F.col("fen"), F.col("moves"))).collect()]
    assert got[0]["san"][-1] == "Qh4#" and got[0]["mate"] == -2 and got[1]["san"] == [] and got[2] is None
    ok = spark.createDataFrame([("startpos", ["e2e4"], None), (None, ["e2e5"], None), (None, ["e2e4"], START)], "a string, m array<string>, b string")
    assert [r[0] for r in ok.select(replay.history_ok(F.col("a"), F.col("m"), F.col("b"))).collect()] == [True, False, False]
    texts = [json.dumps({"frames": [{"fen": START}]}), json.dumps({"frames": []}), json.dumps({"frames": [{"fen": "x"}]}), "{", json.dumps({"frames": [{"fen": START}] * 513})]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(replay.replay_problem(F.col("t"))).collect()]
    assert got[0] is None and got[1] == "no frames" and got[2].startswith("frame 0") and got[3] == "not JSON" and got[4] == "too many frames"


def test_small_things(spark):
    one = spark.range(1)
    assert one.select(replay.shorten(F.lit("abcdef"), 4), replay.board_size(F.lit(1000)), replay.board_size(F.lit(333)), replay.frame_ms(F.lit(None).cast("int"), F.lit(True))).first()[:] == ("abc…", 800, 328, 1800)
    assert one.select(replay.seen_from(F.lit(30), F.lit(None).cast("int"), F.lit(False)).alias("s")).first()["s"][:] == (-30, None)
    assert one.select(replay.seen_from(F.lit(None).cast("int"), F.lit(3), F.lit(True)).alias("s")).first()["s"][:] == (11997, 3)
    assert replay.engine_spec("SF:3") == ("stockfish", 3) and replay.engine_spec("a/b.pt") == ("checkpoint", "a/b.pt")
    with pytest.raises(ValueError, match="levels"):
        replay.engine_spec("stockfish:9")
    assert replay.levels(spark, 0, 20).where("effective_skill = 0").count() == 3
    assert json.loads(replay.report_json({"games": [1, 2]}, ("games",))) == {"games": 2}


def test_array_shards(spark, tmp_path):
    boards = np.zeros((2, 146), np.uint8)
    np.savez(tmp_path / "shard-00000.npz", boards=boards, score=np.array([3, -4], np.int16), depth=np.array([20, 21], np.uint16), policy_indices=np.array([[5, -1], [7, 8]], np.int16), policy_scores=np.array([[3, 0], [-4, -9]], np.int16), policy_depth=np.array([20, 19], np.uint16))
    np.savez(tmp_path / "shard-00001.npz", boards=boards[:1], policies=np.array([877], np.uint16), values=np.array([1.0], np.float32))
    got = sorted(replay.array_shards(spark, str(tmp_path)).collect(), key=str)
    assert sorted((r["score"], r["policy_indices"], r["policy_scores"]) for r in got if r["score"] is not None) == [(-4, [7, 8], [-4, -9]), (3, [5], [3])]
    assert [(r["policy"], r["ply"], r["value"]) for r in got if r["policy"]] == [(877, 0, 1.0)]
