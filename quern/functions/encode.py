"""Positions as bytes, moves as policy numbers, keys and splits.

A packed position holds 18 planes of 64 bits and two clock bytes. Planes are seen
from the side to move, rows from its far side: six of its own pieces, six of the
other's, the side, four castling rights, the en-passant file. A policy number is
73 times the square a move starts from plus the plane of its step.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.rules import KING, PAWN, Board, Move

# Fixed values of the layout: planes per square, widths of older and newer forms, and the tag of position keys, which must be this one for keys to match.
PLANES, OLD_BYTES, BYTES, FULL_BYTES, KEYED_BYTES = 73, 144, 146, 160, 136
KEY_TAG = b"s-chess-group-v1"
# Steps of the 7-plane directions, of the knight planes, and the promoted pieces of the last nine.
DIRECTIONS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
LEAPS = ((1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2))
UNDER = (2, 3, 4)

#: (files, ranks, promoted piece) of each plane, and the plane of each.
STEPS = [(f * n, r * n, 0) for f, r in DIRECTIONS for n in range(1, 8)] + [(f, r, 0) for f, r in LEAPS] + [(f, 1, p) for p in UNDER for f in (-1, 0, 1)]
PLANE_OF = {step: i for i, step in enumerate(STEPS)}


def seen_by(s: int, turn: int) -> int:
    return s if turn == 1 else s ^ 56


def seen_from(square: Column, turn: Column) -> Column:
    """A square as the side to move (w or b) sees it."""
    return F.when(turn == "b", square.bitwiseXOR(F.lit(56))).otherwise(square)


def policy_index(turn: int, move: Move) -> int:
    """The policy number of a move; promotion to a queen counts as the plain step."""
    a, b = seen_by(move.start, turn), seen_by(move.end, turn)
    step = ((b & 7) - (a & 7), (b >> 3) - (a >> 3), move.promotion if move.promotion in UNDER else 0)
    if step not in PLANE_OF:
        raise ValueError(f"no policy plane for {move.uci()}")
    return a * PLANES + PLANE_OF[step]


def legal_indices(board: Board) -> dict[int, Move]:
    """The legal moves by policy number."""
    return {policy_index(board.turn, m): m for m in board.legal_moves()}


def pack(board: Board) -> bytes:
    """The 146 bytes of a position."""
    out = bytearray(OLD_BYTES)
    for s, p in enumerate(board.cells):
        if p:
            o = seen_by(s, board.turn)
            plane = abs(p) - 1 + (0 if p * board.turn > 0 else 6)
            out[8 * plane + 7 - (o >> 3)] |= 128 >> (o & 7)
    own, other = ("KQ", "kq") if board.turn == 1 else ("kq", "KQ")
    rights = board.clean_rights()
    flags = [board.turn == 1, own[0] in rights, own[1] in rights, other[0] in rights, other[1] in rights]
    for i, flag in enumerate(flags):
        if flag:
            out[96 + 8 * i : 104 + 8 * i] = b"\xff" * 8
    if board.ep is not None:
        out[136:144] = bytes([128 >> (board.ep & 7)]) * 8
    clocks = np.array([min(board.half, 100) / np.float32(100), min(board.full, 200) / np.float32(200)], np.float32)
    return bytes(out) + np.rint(clocks * np.float32(255)).astype(np.uint8).tobytes()


def planes(packed: bytes) -> np.ndarray:
    """The 20 planes of 8 by 8 of a packed position of any of the three widths."""
    if len(packed) == FULL_BYTES:
        return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(np.float32).reshape(20, 8, 8)
    if len(packed) not in (OLD_BYTES, BYTES):
        raise ValueError(f"a packed position hasn't {len(packed)} bytes")
    out = np.zeros((20, 8, 8), np.float32)
    out[:18] = np.unpackbits(np.frombuffer(packed[:OLD_BYTES], np.uint8)).reshape(18, 8, 8)
    for i, value in enumerate(packed[OLD_BYTES:]):
        out[18 + i] = np.float32(value) / np.float32(255)
    return out


def unpack(packed: bytes) -> Board:
    """The position that packs to these bytes; raises where none may."""
    found = planes(packed)
    if (found[:12].sum(axis=0) > 1).any():
        raise ValueError("pieces overlap")
    if any((p != p[0, 0]).any() for p in found[12:17]):
        raise ValueError("a side or castling plane isn't constant")
    if (found[17] != found[17][0]).any() or found[17][0].sum() > 1:
        raise ValueError("the en-passant plane isn't one file")
    board = Board("8/8/8/8/8/8/8/8 w - - 0 1")
    board.turn = 1 if found[12, 0, 0] else -1
    for plane, row, file in np.argwhere(found[:12] > 0.5).tolist():
        board.cells[seen_by(file + 8 * (7 - row), board.turn)] = (plane % 6 + 1) * (board.turn if plane < 6 else -board.turn)
    own, other = ("KQ", "kq") if board.turn == 1 else ("kq", "KQ")
    board.rights = frozenset(c for c, p in zip(own + other, found[13:17], strict=True) if p[0, 0])
    if found[17].any():
        board.ep = int(found[17][0].argmax()) + 8 * (5 if board.turn == 1 else 2)
    board.half, board.full = round(float(found[18, 0, 0]) * 100), max(1, round(float(found[19, 0, 0]) * 200))
    if found_problems := board.problems():
        raise ValueError("; ".join(found_problems))
    return board


def position_key(packed: bytes) -> bytes:
    """One key for all that differ only in clocks and en passant."""
    return hashlib.blake2b(packed[:KEYED_BYTES], digest_size=16, person=KEY_TAG).digest()


def split_fraction(key: bytes, seed: int = 0, tag: bytes = b"quern-split") -> int:
    """The place of a key's hash in 2^64. ``tag`` is a parameter: a dataset that was split under another keeps its splits by naming it."""
    return int.from_bytes(hashlib.blake2b(str(seed).encode() + b":" + key, digest_size=8, person=tag).digest(), "big")


def split_of(key: bytes, validation: float, test: float, seed: int = 0, tag: bytes = b"quern-split") -> str:
    at = split_fraction(key, seed, tag)
    return "test" if at < int(test * 2**64) else "validation" if at < int((test + validation) * 2**64) else "train"


def may_use(piece: int, start: int, plane: int) -> bool:
    """Whether a piece on a square (as its side sees it) may ever use a plane, blockers aside."""
    files, ranks, promoted = STEPS[plane]
    f, r = (start & 7) + files, (start >> 3) + ranks
    if not (0 <= f < 8 and 0 <= r < 8):
        return False
    straight, slanted, far = files == 0 or ranks == 0, abs(files) == abs(ranks), max(abs(files), abs(ranks))
    if promoted:
        return piece == PAWN and start >> 3 == 6
    if 56 <= plane < 64:
        return piece == 2
    if piece == PAWN:
        return ranks == 1 and abs(files) <= 1 or ranks == 2 and files == 0 and start >> 3 == 1
    if piece == KING:
        return far == 1 or ranks == 0 and far == 2 and start == 4
    return piece in (3, 5) and slanted or piece in (4, 5) and straight


def geometry(spark: SparkSession) -> DataFrame:
    """Index, start, plane, end (null off the board), promotion: the policy's dimension table."""
    rows = []
    for s in range(64):
        for plane, (files, ranks, promoted) in enumerate(STEPS):
            f, r = (s & 7) + files, (s >> 3) + ranks
            rows.append((s * PLANES + plane, s, plane, f + 8 * r if 0 <= f < 8 and 0 <= r < 8 else None, promoted))
    return spark.createDataFrame(rows, "index int, start int, plane int, end int, promotion int")


def structural_mask(spark: SparkSession) -> DataFrame:
    """Piece, start, index: which piece may use which policy number."""
    rows = [(p, s, s * PLANES + plane) for p in range(1, 7) for s in range(64) for plane in range(PLANES) if may_use(p, s, plane)]
    return spark.createDataFrame(rows, "piece int, start int, index int")


def policy_index_sql(start: Column, end: Column, promotion: Column, turn: Column) -> Column:
    """E7 as an expression: squares as numbers, promotion as a letter or null, turn as w or b; null where no plane fits."""
    a, b = seen_from(start, turn), seen_from(end, turn)
    files, ranks = b.bitwiseAND(F.lit(7)) - a.bitwiseAND(F.lit(7)), F.shiftright(b, 3) - F.shiftright(a, 3)
    far = F.greatest(F.abs(files), F.abs(ranks))
    line = (files == 0) | (ranks == 0) | (F.abs(files) == F.abs(ranks))
    around = F.create_map(*[x for i, (f, r) in enumerate(DIRECTIONS) for x in (F.lit(3 * f + r), F.lit(i))])
    leap = F.create_map(*[x for i, (f, r) in enumerate(LEAPS) for x in (F.lit(5 * f + r), F.lit(i))])
    under = F.create_map(F.lit("n"), F.lit(0), F.lit("b"), F.lit(1), F.lit("r"), F.lit(2))
    plane = (
        F.when(promotion.isin("n", "b", "r"), F.when((ranks == 1) & (F.abs(files) <= 1), 64 + 3 * under[promotion] + files + 1))
        .when(F.abs(files * ranks) == 2, 56 + leap[5 * files + ranks])
        .when((far > 0) & line, around[(3 * F.signum(files) + F.signum(ranks)).cast("int")] * 7 + far - 1)
    )
    return (a * PLANES + plane).cast("int")


def first_move(board: Board, text: str) -> Move:
    """A move in UCI; a king that takes its own rook castles."""
    try:
        return board.parse_uci(text)
    except ValueError:
        raw = Move.of(text)
    side = board.turn
    rights = {"K": 7, "Q": 0} if side == 1 else {"k": 63, "q": 56}
    home = next((c for c in board.clean_rights() if rights.get(c) == raw.end), None)
    if home is None or raw.promotion or raw.start != board.king(side):
        raise ValueError(f"illegal move {text} for {board.fen()}")
    move = Move(raw.start, raw.start + (2 if raw.end > raw.start else -2))
    if not board.is_legal(move):
        raise ValueError(f"illegal move {text} for {board.fen()}")
    return move


def board_of(fen: str) -> Board:
    """A board from a FEN of six fields, or of four to which clocks are added."""
    n = len(fen.split())
    if n not in (4, 6):
        raise ValueError(f"a FEN hasn't {n} fields")
    return Board(f"{fen} 0 1" if n == 4 else fen)


def packed_board_errors(packed: bytes) -> list[str]:
    """Which rules of structure a packed position breaks, by bit counts alone."""
    pieces = [int.from_bytes(packed[8 * i : 8 * i + 8], "big") for i in range(12)]
    counts = [p.bit_count() for p in pieces]
    flags, ep = [packed[96 + 8 * i : 104 + 8 * i] for i in range(5)], packed[136:144]
    together = 0
    for p in pieces:
        together |= p
    found = {
        "piece_overlap": together.bit_count() != sum(counts),
        "piece_count": max(sum(counts[:6]), sum(counts[6:])) > 16,
        "king_count": counts[5] != 1 or counts[11] != 1,
        "pawn_count": max(counts[0], counts[6]) > 8,
        "backrank_pawns": any(packed[i] for i in (0, 7, 48, 55)),
        "side_castling_planes": any(f not in (bytes(8), b"\xff" * 8) for f in flags),
        "en_passant_plane": len(set(ep)) > 1 or ep[0].bit_count() > 1,
    }
    return [name for name, bad in found.items() if bad]


def _attempt(function):
    def run(value):
        try:
            return None if value is None else function(value)
        except ValueError:
            return None

    return run


def _udf(kind: T.DataType, function):
    safe = _attempt(function)

    @F.pandas_udf(kind)
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([safe(v) for v in values], dtype=object)

    return run


#: Over columns; null for null and for what isn't a position.
pack_fen = _udf(T.BinaryType(), lambda fen: pack(board_of(fen)))
unpack_fen = _udf(T.StringType(), lambda b: unpack(bytes(b)).fen())
key_of = _udf(T.BinaryType(), lambda b: position_key(bytes(b)))
fen_of = _udf(T.StringType(), lambda fen: board_of(fen).fen())
epd_of = _udf(T.StringType(), lambda fen: board_of(fen).epd())
board_errors = _udf(T.ArrayType(T.StringType()), lambda b: packed_board_errors(bytes(b)))
legal_ucis = _udf(T.ArrayType(T.StringType()), lambda fen: sorted(m.uci() for m in board_of(fen).legal_moves()))
legal_policy = _udf(T.ArrayType(T.IntegerType()), lambda fen: sorted(legal_indices(board_of(fen))))


def _status(fen: str) -> dict:
    """What a position's display needs."""
    board = board_of(fen)
    moves: dict[str, list[str]] = {}
    for uci in sorted(m.uci() for m in board.legal_moves()):
        moves.setdefault(uci[:2], []).append(uci)
    over = board.over()
    result = {None: "*", "checkmate": "0-1" if board.turn == 1 else "1-0"}.get(over, "1/2-1/2")
    return {"turn": "w" if board.turn == 1 else "b", "check": board.in_check(), "over": over is not None, "result": result, "termination": over, "halfmove": board.half, "fullmove": board.full, "moves": moves}


STATUS = "turn string, check boolean, over boolean, result string, termination string, halfmove int, fullmove int, moves map<string,array<string>>"


def status(fen: Column) -> Column:
    @F.udf(STATUS, useArrow=True)
    def run(text: str):
        return _attempt(_status)(text)

    return run(fen)


def material(fen: Column) -> Column:
    """White's material less Black's, in pawns, from the letters of a FEN."""
    placed = F.substring_index(fen, " ", 1)
    total = F.lit(0)
    for letter, worth in (("P", 1), ("N", 3), ("B", 3), ("R", 5), ("Q", 9)):
        for c, sign in ((letter, 1), (letter.lower(), -1)):
            total = total + (F.length(placed) - F.length(F.replace(placed, F.lit(c)))) * (sign * worth)
    return total.cast("int")


def captured(fen: Column) -> Column:
    """How many pieces of each letter the initial set has beyond those on the board; fewer than none after promotions."""
    placed = F.substring_index(fen, " ", 1)
    left = [(c, n - (F.length(placed) - F.length(F.replace(placed, F.lit(c))))) for letter, n in (("P", 8), ("N", 2), ("B", 2), ("R", 2), ("Q", 1)) for c in (letter, letter.lower())]
    return F.create_map(*[x for c, n in left for x in (F.lit(c), n)])


def squares(uci: Column) -> Column:
    """Start and end of a move in UCI as numbers."""
    def number(at: int) -> Column:
        return F.ascii(F.substring(uci, at, 1)) - 97 + 8 * (F.ascii(F.substring(uci, at + 1, 1)) - 49)

    return F.struct(number(1).alias("start"), number(3).alias("end"), F.when(F.length(uci) == 5, F.substring(uci, 5, 1)).alias("promotion"))


