"""Games in PGN and opening positions in EPD or FEN."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.encode import board_of, pack, policy_index
from quern.functions.rules import START, Board

_TAG = re.compile(r'^\[([A-Za-z0-9_]+)\s+"((?:[^"\\]|\\.)*)"\]\s*$')
_SKIP = re.compile(r"\{[^}]*\}|;[^\n]*|^%[^\n]*", re.M)
_RESULTS = ("1-0", "0-1", "1/2-1/2", "*")
GAME = "headers map<string,string>, start_fen string, moves array<string>, error string"


def split_games(text: str) -> Iterator[tuple[dict[str, str], str]]:
    """The headers and movetext of each game of a file."""
    headers: dict[str, str] = {}
    body: list[str] = []
    depth = False
    for line in text.replace("\r\n", "\n").split("\n"):
        tag = None if depth else _TAG.match(line.strip())
        if tag:
            if body:
                yield headers, "\n".join(body)
                headers, body = {}, []
            headers[tag[1]] = tag[2].replace('\\"', '"').replace("\\\\", "\\")
        elif line.strip():
            body.append(line)
            for c in line:
                depth = c == "{" or depth and c != "}"
    if headers or body:
        yield headers, "\n".join(body)


def main_line(text: str) -> list[str]:
    """The moves of a movetext without comments, variations, numbers, glyphs and result."""
    text = _SKIP.sub(" ", text)
    out, depth = [], 0
    for token in re.findall(r"[()]|[^\s()]+", text):
        if token in "()":
            depth += 1 if token == "(" else -1
        elif depth <= 0 and token not in _RESULTS and not token.startswith("$"):
            token = re.sub(r"^\d+\.*", "", token)
            if token:
                out.append(token)
    return out


def parse_game(headers: dict[str, str], text: str) -> dict:
    """A game's headers, start and moves in UCI; at a move that can't be read the main line ends and says why."""
    start = headers.get("FEN", START)
    moves, error = [], None
    try:
        board = board_of(start)
        start = board.fen()
        for san in main_line(text):
            move = board.parse_san(san)
            moves.append(move.uci())
            board.push(move)
    except ValueError as e:
        error = str(e)
    return {"headers": headers, "start_fen": start, "moves": moves, "error": error}


def read_games(files: DataFrame) -> DataFrame:
    """File, number (from 0) and fields of every game of ``files`` (file, value)."""

    @F.udf(f"array<struct<{GAME.replace(' ', ':').replace(',:', ',')}>>", useArrow=True)
    def games(text: str):
        return [parse_game(*g) for g in split_games(text or "")]

    found = files.select("file", F.posexplode(games("value")).alias("number", "game"))
    return found.select("file", "number", "game.*")


def plies(games: DataFrame) -> DataFrame:
    """A row for each position of ``games`` (start_fen, moves, result): board, policy, value, ply."""
    names = ["board", "policy", "value", "ply"]
    kept = [f for f in games.schema.fields if f.name not in (*names, "start_fen", "moves", "result")]
    own_names = [f.name for f in kept]

    def unroll(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            owned = list(zip(*(frame[c] for c in own_names), strict=True)) if own_names else [()] * len(frame)
            for own, start, moves, result in zip(owned, frame["start_fen"], frame["moves"], frame["result"], strict=True):
                board = board_of(start)
                for ply, uci in enumerate(moves):
                    move = board.parse_uci(uci)
                    white = {"1-0": 1.0, "0-1": -1.0}.get(result, 0.0)
                    rows.append((*own, pack(board), policy_index(board.turn, move), white * board.turn + 0.0, ply))
                    board.push(move)
            yield pd.DataFrame(rows, columns=own_names + names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["board binary", "policy int", "value float", "ply int"])
    return games.select(*own_names, "start_fen", "moves", "result").mapInPandas(unroll, schema)


def pgn(start: str, moves: list[str], headers: dict[str, str]) -> str:
    """K5: a game as PGN; a start that isn't the usual one is set up in its headers."""
    board = board_of(start)
    if start != START:
        headers = {**headers, "SetUp": "1", "FEN": start}
    out = []
    for i, uci in enumerate(moves):
        move = board.parse_uci(uci)
        number = f"{board.full}. " if board.turn == 1 else f"{board.full}... " if not i else ""
        out.append(number + board.san(move))
        board.push(move)
    tags = "\n".join('[{} "{}"]'.format(k, str(v).replace("\\", "\\\\").replace('"', '\\"')) for k, v in headers.items())
    return f"{tags}\n\n{' '.join([*out, headers.get('Result', '*')])}"


def opening_positions(lines: DataFrame) -> DataFrame:
    """Fen of each usable line of ``value``: a FEN with clocks, or an EPD; comments, blanks and finished positions go."""

    @F.udf("string", useArrow=True)
    def usable(line: str):
        fields = line.split()
        clocks = len(fields) >= 6 and fields[4].isdigit() and fields[5].isdigit()
        try:
            board = Board(" ".join(fields[:6]) if clocks else " ".join([*fields[:4], "0", "1"]))
        except ValueError:
            return None
        return board.fen() if board.is_valid() and not board.over() and board.half < 100 else None

    text = lines.select(F.trim("value").alias("value")).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return text.select(usable("value").alias("fen")).where("fen is not null")
