"""Histories, replays, lines, engine names, arrays of older shards, reports."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.encode import board_of
from quern.functions.rules import Board, Move
from quern.operators import shaping

MOST_FRAMES = 512
# Level, skill, milliseconds a move, depth of the eight playing strengths.
LEVELS = [(1, -9, 50, 5), (2, -5, 100, 5), (3, -1, 150, 5), (4, 3, 200, 5), (5, 7, 300, 5), (6, 11, 400, 8), (7, 16, 500, 13), (8, 20, 1000, 22)]


def levels(spark: SparkSession, least_skill: int = -20, most_skill: int = 20) -> DataFrame:
    """The playing strengths as a dimension, with the skill that an engine of a given range can take."""
    found = spark.createDataFrame(LEVELS, "level int, skill int, move_ms int, depth int")
    return found.withColumn("effective_skill", F.greatest(F.lit(least_skill), F.least(F.lit(most_skill), F.col("skill"))))


def engine_spec(text: str) -> tuple[str, int | str]:
    """An engine of a level, named stockfish or sf, or else a path."""
    name, colon, level = text.partition(":")
    if colon and name.lower() in ("stockfish", "sf"):
        if not 1 <= int(level) <= 8:
            raise ValueError("levels are 1 to 8")
        return "stockfish", int(level)
    return "checkpoint", text


def read_line(board: Board, moves: list[Move]) -> dict:
    """The legal beginning of a line in both notations, and in how many moves it mates, for whom."""
    board, san, uci, mate = board.copy(), [], [], None
    for ply, move in enumerate(moves, start=1):
        if not board.is_legal(move):
            break
        san.append(board.san(move))
        uci.append(move.uci())
        board.push(move)
        if board.over() == "checkmate":
            mate = (ply + 1) // 2 * (1 if ply % 2 else -1)
            break
    return {"san": san, "uci": uci, "mate": mate}


def read_lines(fen: Column, moves: Column) -> Column:
    """E20 over columns: a position and a line in UCI."""

    @F.udf("struct<san:array<string>,uci:array<string>,mate:int>", useArrow=True)
    def run(text: str, line: list):
        try:
            return read_line(board_of(text), [Move.of(m) for m in line])
        except (ValueError, TypeError):
            return None

    return run(fen, moves)


def seen_from(cp: Column, mate: Column, white: Column) -> Column:
    """A score for White as (centipawns, mate) from one side's view; a mate counts as 12 000 less its distance."""
    sign = F.when(white, 1).otherwise(-1)
    far = F.when(mate > 0, 12000 - mate).otherwise(-12000 - mate)
    return F.struct((sign * F.coalesce(F.when(mate.isNotNull(), far), cp, F.lit(0))).cast("int").alias("cp"), (sign * mate).cast("int").alias("mate"))


def history_board(start: str | None, moves: list[str], fen: str | None = None) -> Board:
    """the position after a history; raises where a move is illegal or ``fen`` isn't what it leads to."""
    board = Board() if start in (None, "", "startpos") else Board(start)
    for uci in moves:
        board.push(board.parse_uci(uci))
    if fen not in (None, "", "startpos") and board.fen() != Board(fen).fen():
        raise ValueError("the history doesn't lead to the position")
    return board


def history_ok(start: Column, moves: Column, fen: Column) -> Column:
    @F.udf("boolean", useArrow=True)
    def run(a: str, line: list, b: str):
        try:
            history_board(a, list(line) if line is not None else [], b)
        except ValueError:
            return False
        return True

    return run(start, moves, fen)


def frame_problem(payload: dict) -> str | None:
    """why a replay can't be shown, or None."""
    frames = payload.get("frames")
    if not isinstance(frames, list) or not frames:
        return "no frames"
    if len(frames) > MOST_FRAMES:
        return "too many frames"
    for i, frame in enumerate(frames):
        if not isinstance(frame, dict) or not isinstance(frame.get("fen"), str):
            return f"frame {i} has no position"
        try:
            Board(frame["fen"])
        except ValueError as e:
            return f"frame {i}: {e}"
    return None


def replay_problem(text: Column) -> Column:
    """F10 over a column of JSON."""

    @F.udf("string", useArrow=True)
    def run(value: str):
        try:
            payload = json.loads(value)
        except (ValueError, TypeError):
            return "not JSON"
        return frame_problem(payload) if isinstance(payload, dict) else "no frames"

    return run(text)


def frame_ms(shown: Column, last: Column) -> Column:
    """how long a frame stays, within 100 and 5000 ms."""
    return F.greatest(F.lit(100), F.least(F.lit(5000), F.coalesce(shown, F.when(last, 1800).otherwise(700))))


def board_size(asked: Column) -> Column:
    """a board's size in pixels, within 320 and 800, a multiple of eight."""
    size = F.greatest(F.lit(320), F.least(F.lit(800), F.coalesce(asked, F.lit(560))))
    return size - size % 8


def shorten(text: Column, limit: int) -> Column:
    """A text of at most ``limit`` characters, with an ellipsis where it was cut."""
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, max(1, limit - 1)), F.lit("…")))


def array_shards(spark: SparkSession, path: str) -> DataFrame:
    """Rows of array archives below ``path``: board, score, depth, policy lists without padding; older ones' wdl (win, draw, loss) and policy_probs in place of scores; or games' policy, value, ply (0 where none is stored)."""
    names = ["board", "score", "depth", "policy_indices", "policy_scores", "policy_depth", "wdl", "policy_probs", "policy", "value", "ply"]

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with np.load(io.BytesIO(content), allow_pickle=False) as held:
                    arrays = {k: held[k] for k in held.files}
                out = pd.DataFrame({"board": [b.tobytes() for b in arrays["boards"]]}).reindex(columns=names).astype(object)
                for name, own in (("score", "score"), ("depth", "depth"), ("policy_depth", "policy_depth"), ("policy", "policies"), ("value", "values")):
                    if own in arrays:
                        out[name] = arrays[own].tolist()
                if "wdl" in arrays:
                    out["wdl"] = arrays["wdl"].tolist()
                if "policy_indices" in arrays:
                    kept = arrays["policy_indices"] >= 0
                    for name in ("policy_indices", "policy_scores", "policy_probs"):
                        if name in arrays:
                            out[name] = [row[k].tolist() for row, k in zip(arrays[name], kept, strict=True)]
                if "policies" in arrays:
                    out["ply"] = arrays["plies"].tolist() if "plies" in arrays else 0
                yield out.where(out.notna(), None)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").option("recursiveFileLookup", True).load(path).select("content")
    return files.mapInPandas(load, "board binary, score int, depth int, policy_indices array<int>, policy_scores array<int>, policy_depth int, wdl array<double>, policy_probs array<double>, policy int, value double, ply int")


def raw_scores(rows: DataFrame) -> DataFrame:
    """Rows of either layout with score and policy_scores in centipawns; the older ones' are worked out from their shares."""
    old = F.col("wdl").isNotNull()
    score = F.when(old, shaping.old_score(F.col("wdl")[0], F.col("wdl")[2])).otherwise(F.col("score").cast("double"))
    found = rows.withColumn("score", score)
    scores = F.when(old, shaping.old_policy_scores(F.col("score"), F.col("policy_indices"), F.col("policy_probs"))).otherwise(F.col("policy_scores").cast("array<double>"))
    return found.withColumn("policy_scores", scores).drop("wdl", "policy_probs")


def report_json(report: dict, lists_as_lengths: tuple[str, ...] = ()) -> str:
    """K6: a report as JSON; named lists by their length."""
    return json.dumps({k: len(v) if k in lists_as_lengths else v for k, v in report.items()}, indent=1, sort_keys=True)
