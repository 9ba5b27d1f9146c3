"""Queries of the chess domain over literal positions, records, games and pages, with the rows they must give.

The driver's tables hold no such data, so each query makes its inputs, applies an
operator to them, and its SQL lists the expected rows. Files that an operator
reads are written below the shared folder first.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import encode, replay, search, targets, text
from quern.functions.records import EvalConfig, judged
from quern.functions.rules import START, Board
from quern.operators import aggregates, lookup, ranking, shaping, split
from quern.operators.stage import shared_folder
from quern.plans import evals, games
from quern.sources import games as source
from quern.sources import lines
from quern.sources.store import Store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def expects(columns: str, *rows: tuple):
    """Register a query of a session with the rows it must give; ``columns`` are names and SQL types."""
    kinds = [c.split() for c in columns.split(", ")]

    def register(f):
        QUERIES[f.__name__] = lambda spark, _: f(spark)
        shown = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in rows)
        cast = ", ".join(f"{n}::{t} AS {n}" for n, t in kinds)
        ORACLES[f.__name__] = f"SELECT {cast} FROM (VALUES {shown}) AS t({', '.join(n for n, _ in kinds)})"
        return f

    return register


def applied(spark: SparkSession, inputs: list[tuple], schema: str, function: Callable, out: str) -> DataFrame:
    """The struct that ``function`` makes of each row of inputs, in columns; a ValueError gives nulls."""
    names = [c.split()[0] for c in schema.split(", ")]
    fields = [c.split(" ")[0] for c in out.split(", ")]

    def run(*values):
        try:
            found = function(*values)
        except ValueError:
            return None
        return dict(zip(fields, found if isinstance(found, tuple) else (found,), strict=True))

    made = F.udf(run, "struct<" + ", ".join(c.replace(" ", ":", 1) for c in out.split(", ")) + ">", useArrow=True)
    rows = spark.createDataFrame(inputs, schema)
    return rows.select(*names, made(*names).alias("made")).select(*names, *[F.col("made")[f].alias(f) for f in fields])


def folder(spark: SparkSession, files: dict[str, str | bytes]) -> str:
    """A new folder with these files."""
    store = Store(spark, f"{shared_folder(spark)}/quern-fixture-{uuid.uuid4().hex[:12]}")
    for name, content in files.items():
        store.write(name, content)
    return store.root


def name_of(file) -> F.Column:
    return F.element_at(F.split(file, "/"), -1)


BARE, BLACK, CASTLES, MATED = "4k3/8/8/8/8/8/4P3/4K3 w - - 3 9", START.replace(" w ", " b "), "r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1", "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1"
STALE = "7k/5Q2/6K1/8/8/8/8/8 b - - 0 1"
CLOCKS = START.replace("0 1", "37 42")


def record(pvs, fen=START, depth=20, knodes=1000, **more) -> str:
    return json.dumps({"fen": fen, "evals": [{"depth": depth, "knodes": knodes, "pvs": pvs, **more}]})


def pv(cp, line) -> dict:
    return {"cp": cp, "line": line}


def pairs(*evals_) -> str:
    return json.dumps({"fen": START, "evals": list(evals_)})


def judge(spark: SparkSession, texts: dict[str, str], **config) -> DataFrame:
    return judged(spark.createDataFrame(list(texts.items()), "id string, value string"), EvalConfig(**config))


def counted(found: DataFrame, *names: str) -> DataFrame:
    return found.select("id", "reason", *[F.coalesce(F.col("counts")[n], F.lit(0)).alias(n) for n in names])


# Sources


@expects("file VARCHAR, line BIGINT, value VARCHAR", ("a.jsonl", 0, "one"), ("a.jsonl", 3, "two"), ("b.jsonl.gz", 0, "three"), ("b.jsonl.gz", 1, "four"))
def s1_compressed_lines(spark):
    root = folder(spark, {"a.jsonl": "one\n\n  \ntwo", "sub/b.jsonl.gz": gzip.compress(b"three\nfour\n")})
    return lines.record_lines(spark, root).select(name_of("file").alias("file"), "line", "value")


@expects("file VARCHAR, lines BIGINT", ("a.jsonl", 1), ("b.jsonl.gz", 2), ("x.jsonl.part", 1))
def s2_discovery(spark):
    root = folder(spark, {"a.jsonl": "1", "deep/er/b.jsonl.gz": gzip.compress(b"1\n2"), "x.jsonl.part": "1", "c.json": "1", "d.txt": "1"})
    return lines.record_lines(spark, root).groupBy(name_of("file").alias("file")).agg(F.count("*").alias("lines"))


@expects("place INTEGER, value VARCHAR", (0, "a0"), (1, "a2"), (2, "b0"), (3, "b1"), (4, "c0"))
def s4_source_order(spark):
    root = folder(spark, {"c.jsonl": "c0\n", "a.jsonl": "a0\n\na2\n", "b.jsonl.gz": gzip.compress(b"b0\nb1")})
    found = ranking.ordinals(lines.record_lines(spark, root, 3), ["file", "line"])
    return found.select(F.col("ordinal").cast("int").alias("place"), "value")


@expects("line BIGINT, reason VARCHAR", (0, "schema"), (1, "kept"), (2, "schema"), (3, "kept"))
def s3_accepted_limit(spark):
    texts = ["x", record([pv(1, "e2e4")]), "[]", record([pv(2, "d2d4")]), record([pv(3, "c2c4")]), "y"]
    rows = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line long, value string")
    return evals.up_to(judged(rows, EvalConfig()), 2).select("line", "reason")


PGN = """[Event "A"]
[Date "2024.01.01"]
[White "Alpha 1"]
[Black "Beta"]
[Result "1-0"]
[BlackElo "3600"]

1. e4 {good (x)} e5 2. Nf3 (2. f4 exf4) Nc6 1-0

[Event "B"]
[White "Alpha 1"]
[Black "Weak"]
[Result "1-0"]

1. d4 d5 2. Ke4 1-0

[Event "C"]
[Round "7"]
[Date "2024.01.01"]
[White "Alpha 1"]
[Black "Beta"]
[Result "1-0"]
[BlackElo "3600"]

1. e4 e5 2. Nf3 Nc6 1-0

[Event "D"]
[White "Alpha 1"]
[Black "Beta"]
[Result "*"]

1. c4 *
"""


def _games(spark) -> DataFrame:
    return source.read_games(lines.whole_files(spark, folder(spark, {"a.pgn": PGN}), "*.pgn"))


@expects("number INTEGER, event VARCHAR, moves VARCHAR, whole BOOLEAN", (0, "A", "e2e4 e7e5 g1f3 b8c6", True), (1, "B", "d2d4 d7d5", False), (2, "C", "e2e4 e7e5 g1f3 b8c6", True), (3, "D", "c2c4", True))
def s5_pgn_games(spark):
    return _games(spark).select("number", F.col("headers")["Event"].alias("event"), F.array_join("moves", " ").alias("moves"), F.col("error").isNull().alias("whole"))


@expects("file VARCHAR", ("a.pgn",), ("b.pgn",))
def s6_pgn_files(spark):
    root = folder(spark, {"a.pgn": PGN, "deep/b.pgn": PGN, "_extracted/c.pgn": PGN, "d.txt": PGN})
    return lines.whole_files(spark, root, "*.pgn").select(name_of("file").alias("file"))


RATINGS = "<table><tr><th>Rank</th><th>Name</th><th>Elo</th><th>Games</th></tr><tr><td>1</td><td>Stockfish 18 64-bit 4CPU</td><td>3651</td><td>1200</td></tr><tr><td>2</td><td>Carp&nbsp;3.0.0 64-bit</td><td>3'503</td><td>800</td></tr><tr><td>3</td><td>LowBot 1.0</td><td>2499</td></tr><tr><td>4</td><td>Too Low</td><td>999</td></tr><tr><td>5</td><td>Too High</td><td>5001</td></tr><tr><td>x</td><td>No Rank</td><td>3000</td></tr><tr><td>6</td><td>Short</td></tr></table>"


@expects("name VARCHAR, elo INTEGER", ("Stockfish 18 64-bit 4CPU", 3651), ("Carp 3.0.0 64-bit", 3503), ("LowBot 1.0", 2499), ("Beta 2", 3456))
def s7_rating_tables(spark):
    return games.ratings_of(spark.createDataFrame([(RATINGS,), ("<pre>1  Beta 2   3456 x\nno line\n</pre>",), (None,)], "value string"))


@expects("kept BIGINT, least INTEGER, most INTEGER", (3, 2499, 3651))
def e17_rating_rows(spark):
    return games.ratings_of(spark.createDataFrame([(RATINGS,)], "value string")).agg(F.count("*").alias("kept"), F.min("elo").alias("least"), F.max("elo").alias("most"))


ARCHIVES = "<table><tr><th>Engine</th><th>Number of games</th><th>Commented PGN</th></tr><tr><td>Stockfish 18</td><td>1'017</td><td><a href=\"sf.7z\">0.54 MB</a></td></tr></table><table><tr><th>Other</th></tr><tr><td>Not</td><td>1</td><td><a href=\"no.7z\">1 MB</a></td></tr></table><a href=\"c/Stockfish_18.commented.[5].pgn.7z\">9 MB</a><a href=\"c/LowBot_1_0.commented.[64].pgn.7z\">512 KB</a><a href=\"c/Big_2.commented.[7].pgn.7z\">1.5 GB</a>"
ARCHIVE_NAME = r"(?P<name>.+)\.commented\.\[(?P<games>\d+)\]\.pgn\.7z$"


@expects("name VARCHAR, games INTEGER, url VARCHAR, size_mb DOUBLE", ("Stockfish 18", 1017, "https://x.test/4040/sf.7z", 0.54), ("LowBot 1 0", 64, "https://x.test/4040/c/LowBot_1_0.commented.[64].pgn.7z", 0.5), ("Big 2", 7, "https://x.test/4040/c/Big_2.commented.[7].pgn.7z", 1536.0))
def s8_archive_links(spark):
    return games.archives_of(spark.createDataFrame([(ARCHIVES,)], "value string"), "https://x.test/4040/games.html", ARCHIVE_NAME)


@expects("place INTEGER, name VARCHAR, elo INTEGER", (0, "c", 2000), (1, "A", 1000), (2, "b", 1000))
def s9_ratings_order(spark):
    rows = games.ratings_frame(spark, [("b", 1000), ("A", 1000), ("c", 2000)])
    return ranking.ordinals(rows.withColumn("less", -F.col("elo")), ["less", "key"], partitions=1).select(F.col("ordinal").cast("int").alias("place"), "name", "elo")


BOOK = [("C50", "Italian Game", "1. e4 e5 2. Nf3 Nc6 3. Bc4"), ("C20", "Older name", "1. e4 e5"), ("C20", "King's Pawn", "1. e4 e5"), ("X00", "Unplayable", "1. e5"), ("A40", "Queen's Pawn", "1. d4")]


@expects("epd VARCHAR, eco VARCHAR, name VARCHAR", ("r1bqkbnr/pppp1ppp/2n5/4p3/2B1P3/5N2/PPPP1PPP/RNBQK2R b KQkq -", "C50", "Italian Game"), ("rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR w KQkq -", "C20", "King's Pawn"), ("rnbqkbnr/pppppppp/8/8/3P4/8/PPP1PPPP/RNBQKBNR b KQkq -", "A40", "Queen's Pawn"))
def s10_opening_book(spark):
    rows = "\n".join(["eco\tname\tpgn", *["\t".join(r) for r in BOOK]])
    return games.opening_book(lines.tsv(spark, [folder(spark, {"a.tsv": rows})]).coalesce(1))


@expects("fen VARCHAR", (START,), ("rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1",), ("4k3/8/8/8/8/8/4P3/4K3 w - - 0 1",))
def s11_opening_positions(spark):
    rows = [START, "# no", "", 'rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - id "x";', "4k3/8/8/8/8/8/4P3/4K3 w - -", MATED, "junk"]
    return source.opening_positions(spark.createDataFrame([(r,) for r in rows], "value string"))


def _arrays(**held) -> bytes:
    out = io.BytesIO()
    np.savez(out, **held)
    return out.getvalue()


@expects("kind VARCHAR, score DOUBLE, moves VARCHAR, scores VARCHAR, ply INTEGER", ("new", 30.0, "877,804", "30,20", None), ("old", 35.0, "0,1,2", "35,20,-15", None), ("game", None, None, None, 0), ("game", None, None, None, 5))
def s12_array_shards(spark):
    board = np.frombuffer(encode.pack(Board()), np.uint8)[None, :]
    win, loss = (1 / (1 + np.exp(-(s - 100) / 380)) for s in (35.0, -35.0))
    shares = np.exp((np.array([35.0, 20.0, -15.0]) - 35) / 400)
    files = {
        "new/shard-00000.npz": _arrays(boards=board, score=np.array([30], np.int16), depth=np.array([20]), policy_indices=np.array([[877, 804, -1]], np.int16), policy_scores=np.array([[30, 20, 0]], np.int16), policy_depth=np.array([20])),
        "old/shard-00000.npz": _arrays(boards=board, wdl=np.array([[win, 1 - win - loss, loss]]), policy_indices=np.array([[0, 1, 2, -1]]), policy_probs=np.array([[*shares / shares.sum(), 0.0]])),
        "game/shard-00000.npz": _arrays(boards=board, policies=np.array([877]), values=np.array([1.0])),
        "game/shard-00001.npz": _arrays(boards=board, policies=np.array([877]), values=np.array([1.0]), plies=np.array([5])),
    }
    root, found = folder(spark, files), None
    for kind in ("new", "old", "game"):
        part = replay.raw_scores(replay.array_shards(spark, f"{root}/{kind}")).withColumn("kind", F.lit(kind))
        found = part if found is None else found.unionByName(part)
    whole = F.transform("policy_scores", lambda s: F.round(s).cast("int"))
    return found.select("kind", F.round("score", 3).alias("score"), F.array_join("policy_indices", ",").alias("moves"), F.array_join(whole, ",").alias("scores"), "ply")


def _manifest(**changes) -> dict:
    made = {"dataset_schema": evals.SCHEMA, "status": "complete", "config": asdict(EvalConfig()), "shards": [{"path": "split=train/a.parquet", "split": "train", "rows": 1, "bytes": 2, "sha256": "x"}]}
    made["dataset_id"] = evals.identity(made)
    return made | changes


@expects("case_ VARCHAR, problem VARCHAR", ("good", None), ("schema", "not a complete dataset of this kind"), ("status", "not a complete dataset of this kind"), ("altered", "the manifest doesn't match its identity"))
def s13_manifests(spark):
    cases = {"good": _manifest(), "schema": _manifest(dataset_schema="other"), "status": _manifest(status="building"), "altered": _manifest(shards=[])}
    return spark.createDataFrame([(k, evals.manifest_problem(m)) for k, m in cases.items()], "case_ string, problem string")


# Datasets

LINES = ["broken", record([pv(5, "e2e4")], depth=14), record([pv(30, "d2d4")], depth=24), record([pv(7, "e7e5")], fen=BLACK), record([pv(9, "e2e4"), pv(4, "e1d1")], fen=BARE), record([pv(1, "e1g1")], fen=CASTLES)]


def _raw(spark, texts=LINES) -> str:
    return folder(spark, {"a.jsonl.gz": gzip.compress("\n".join(texts[:3]).encode()), "b.jsonl": "\n\n".join(texts[3:])})


def _dataset(spark, texts=LINES, **config) -> tuple[str, dict]:
    out = f"{shared_folder(spark)}/quern-dataset-{uuid.uuid4().hex[:12]}"
    return out, evals.build(spark, _raw(spark, texts), out, EvalConfig(**({"validation_fraction": 0.3, "test_fraction": 0.3, "shard_size": 1} | config)))


@expects("rows_ BIGINT, shards BIGINT, most BIGINT, hashed BOOLEAN", (4, 4, 1, True))
def k1_dataset_shards(spark):
    out, made = _dataset(spark)
    rows = spark.createDataFrame([(s["path"], s["rows"], s["sha256"]) for s in made["shards"]], "path string, rows long, sha256 string")
    found = rows.join(evals.checksums(spark, out).withColumnRenamed("sha256", "now"), "path")
    return found.agg(F.sum("rows").alias("rows_"), F.count("*").alias("shards"), F.max("rows").alias("most"), F.bool_and(F.col("sha256") == F.col("now")).alias("hashed"))


def _outcome(act: Callable) -> str:
    try:
        act()
    except (OSError, ValueError, RuntimeError) as e:
        return type(e).__name__
    return "done"


@expects("case_ VARCHAR, outcome VARCHAR, left_ BOOLEAN", ("again", "FileExistsError", True), ("no positions", "ValueError", False))
def k2_atomic_publish(spark):
    out, _ = _dataset(spark)
    empty = f"{out}-empty"
    rows = [("again", _outcome(lambda: evals.build(spark, _raw(spark), out)), Store(spark, out).exists("metadata.json")), ("no positions", _outcome(lambda: evals.build(spark, _raw(spark, ["null"]), empty)), Store(spark, empty).exists())]
    return spark.createDataFrame(rows, "case_ string, outcome string, left_ boolean")


@expects("case_ VARCHAR, same BOOLEAN", ("untouched", True), ("grown", False))
def k3_source_guard(spark):
    store = Store(spark, _raw(spark))
    before = store.listing()
    untouched = store.listing() == before
    store.write("c.jsonl", "more")
    return spark.createDataFrame([("untouched", untouched), ("grown", store.listing() == before)], "case_ string, same boolean")


RATED = [("ALPHA  1", 3550)]


@expects("ply INTEGER, policy INTEGER, value FLOAT, bytes_ INTEGER", (0, 877, 1.0, 146), (1, 877, -1.0, 146), (2, 501, 1.0, 146), (3, 129, -1.0, 146))
def k4_games_dataset(spark):
    out = f"{shared_folder(spark)}/quern-games-{uuid.uuid4().hex[:12]}"
    games.build(spark, folder(spark, {"a.pgn": PGN}), RATED, out)
    return spark.read.parquet(out).select("ply", "policy", "value", F.octet_length("board").alias("bytes_"))


@expects("case_ VARCHAR, movetext VARCHAR, set_up BOOLEAN", ("start", "1. e4 e5 2. Nf3 *", False), ("later", "9... Ke7 10. e4 1-0", True))
def k5_pgn_text(spark):
    rows = [("start", START, ["e2e4", "e7e5", "g1f3"], "*"), ("later", BARE.replace(" w ", " b "), ["e8e7", "e2e4"], "1-0")]

    def write(_, fen, moves, result):
        head, _, body = source.pgn(fen, list(moves), {"Event": "x", "Result": result}).partition("\n\n")
        return body, "[SetUp" in head

    return applied(spark, rows, "case_ string, fen string, moves array<string>, result string", write, "movetext string, set_up boolean").select("case_", "movetext", "set_up")


@expects("score DOUBLE, games BIGINT", (0.625, 4))
def k6_report_json(spark):
    shown = json.loads(replay.report_json({"score": 0.625, "games": ["w", "x", "y", "z"]}, ("games",)))
    return spark.createDataFrame([(shown["score"], shown["games"])], "score double, games long")


# Positions and moves


@expects("text VARCHAR, fen VARCHAR", (START, START), ("4k3/8/8/8/8/8/4P3/4K3 w - -", "4k3/8/8/8/8/8/4P3/4K3 w - - 0 1"), ("4k3/8/8/8/8/8/4P3/4K3 w - - 0", None), ("nine/8 w - -", None))
def e1_fen_fields(spark):
    rows = [START, "4k3/8/8/8/8/8/4P3/4K3 w - -", "4k3/8/8/8/8/8/4P3/4K3 w - - 0", "nine/8 w - -"]
    return spark.createDataFrame([(r,) for r in rows], "text string").select("text", encode.fen_of("text").alias("fen"))


@expects("square INTEGER, turn VARCHAR, seen INTEGER", (0, "w", 0), (12, "w", 12), (0, "b", 56), (12, "b", 52), (63, "b", 7))
def e2_perspective(spark):
    rows = spark.createDataFrame([(0, "w"), (12, "w"), (0, "b"), (12, "b"), (63, "b")], "square int, turn string")
    return rows.select("square", "turn", encode.seen_from(F.col("square"), F.col("turn")).cast("int").alias("seen"))


@expects("fen VARCHAR, pieces INTEGER, side INTEGER, castling INTEGER, ep INTEGER, half DOUBLE, full_ DOUBLE", (CLOCKS, 32, 64, 256, 0, 0.3686, 0.2118), (BARE, 3, 64, 0, 0, 0.0314, 0.0431), ("4k3/8/8/8/4Pp2/8/8/4K3 b - e3 0 1", 4, 0, 0, 8, 0.0, 0.0039))
def e3_planes(spark):
    def sums(fen):
        p = encode.planes(encode.pack(encode.board_of(fen)))
        return int(p[:12].sum()), int(p[12].sum()), int(p[13:17].sum()), int(p[17].sum()), round(float(p[18, 0, 0]), 4), round(float(p[19, 0, 0]), 4)

    return applied(spark, [(CLOCKS,), (BARE,), ("4k3/8/8/8/4Pp2/8/8/4K3 b - e3 0 1",)], "fen string", sums, "pieces int, side int, castling int, ep int, half double, full_ double")


@expects("fen VARCHAR, bytes_ INTEGER, own_pawns VARCHAR, own_king VARCHAR, other_pawns VARCHAR, clocks VARCHAR", (START, 146, "000000000000FF00", "0000000000000008", "00FF000000000000", "0001"), (CLOCKS, 146, "000000000000FF00", "0000000000000008", "00FF000000000000", "5E36"), (BARE, 146, "0000000000000800", "0000000000000008", "0000000000000000", "080B"))
def e4_packed(spark):
    rows = spark.createDataFrame([(START,), (CLOCKS,), (BARE,)], "fen string").withColumn("b", encode.pack_fen("fen"))
    part = lambda at, n: F.hex(F.substring("b", at, n))
    return rows.select("fen", F.octet_length("b").alias("bytes_"), part(1, 8).alias("own_pawns"), part(41, 8).alias("own_king"), part(49, 8).alias("other_pawns"), part(145, 2).alias("clocks"))


@expects("width INTEGER, pieces INTEGER, castling INTEGER", (144, 32, 256), (146, 32, 256), (160, 32, 256), (145, None, None))
def e5_unpacked(spark):
    packed = encode.pack(Board(CLOCKS))
    rows = [(144, bytearray(packed[:144])), (146, bytearray(packed)), (160, bytearray(packed[:144] + bytes(16))), (145, bytearray(packed[:145]))]

    def sums(_, board):
        p = encode.planes(bytes(board))
        return int(p[:12].sum()), int(p[13:17].sum())

    return applied(spark, rows, "width int, board binary", sums, "pieces int, castling int").select("width", "pieces", "castling")


def _broken(name: str) -> bytes:
    """A packed position of two kings and a pawn with one thing wrong."""
    out = bytearray(encode.pack(Board(BARE)))
    if name == "overlap":
        out[14] |= 8
    elif name == "two kings":
        out[44] |= 1
    elif name == "side":
        out[96] ^= 1
    elif name == "en passant":
        out[136:144] = b"\x03" * 8
    elif name == "back rank":
        out[0] |= 128
    return bytes(out)


BREAKS = ["none", "overlap", "two kings", "side", "en passant", "back rank"]


@expects("case_ VARCHAR, fen VARCHAR", ("none", BARE), *[(b, None) for b in BREAKS[1:]])
def e6_legal_positions(spark):
    rows = spark.createDataFrame([(b, bytearray(_broken(b))) for b in BREAKS], "case_ string, board binary")
    return rows.select("case_", encode.unpack_fen("board").alias("fen"))


@expects("turn VARCHAR, uci VARCHAR, number INTEGER", ("w", "e2e4", 877), ("w", "d2d4", 804), ("b", "e7e5", 877), ("w", "g1f3", 501), ("w", "a7a8q", 3504), ("w", "a7a8n", 3569), ("w", "b7a8r", 3647), ("w", "e1g1", 307), ("w", "a1b4", None))
def e7_policy_numbers(spark):
    rows = spark.createDataFrame([("w", "e2e4"), ("w", "d2d4"), ("b", "e7e5"), ("w", "g1f3"), ("w", "a7a8q"), ("w", "a7a8n"), ("w", "b7a8r"), ("w", "e1g1"), ("w", "a1b4")], "turn string, uci string")
    rows = rows.withColumn("s", encode.squares(F.col("uci")))
    return rows.select("turn", "uci", encode.policy_index_sql(F.col("s.start"), F.col("s.end"), F.col("s.promotion"), F.col("turn")).alias("number"))


@expects("numbers BIGINT, on_board BIGINT, promoting BIGINT", (4672, 2254, 576))
def e8_geometry(spark):
    return encode.geometry(spark).agg(F.count("*").alias("numbers"), F.count("end").alias("on_board"), F.count_if(F.col("promotion") > 0).alias("promoting"))


@expects("piece INTEGER, numbers BIGINT", (1, 228), (2, 336), (3, 560), (4, 896), (5, 1456), (6, 422))
def e9_piece_masks(spark):
    return encode.structural_mask(spark).groupBy("piece").agg(F.count("*").alias("numbers"))


PERFT = ["r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", "8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", "r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", "rnbq1k1r/pp1Pbppp/2p5/8/2B5/8/PPP1NnPP/RNBQK2R w KQ - 1 8"]


@expects("fen VARCHAR, moves INTEGER, numbers INTEGER", (START, 20, 20), (PERFT[0], 48, 48), (PERFT[1], 14, 14), (PERFT[2], 6, 6), (PERFT[3], 44, 44), (MATED, 0, 0))
def e10_legal_moves(spark):
    rows = spark.createDataFrame([(f,) for f in (START, *PERFT, MATED)], "fen string")
    return rows.select("fen", F.size(encode.legal_ucis("fen")).alias("moves"), F.size(F.array_distinct(encode.legal_policy("fen"))).alias("numbers"))


@expects("text VARCHAR, move VARCHAR", ("e1h1", "e1g1"), ("e1a1", "e1c1"), ("e1g1", "e1g1"), ("e1f3", None), ("e1h8", None), ("e1e3", None), ("e1b1", None), ("e1e2", "e1e2"))
def e11_first_moves(spark):
    rows = [(t,) for t in ("e1h1", "e1a1", "e1g1", "e1f3", "e1h8", "e1e3", "e1b1", "e1e2")]
    return applied(spark, rows, "text string", lambda t: encode.first_move(Board(CASTLES), t).uci(), "move string")


@expects("raw VARCHAR, cleaned VARCHAR, folded VARCHAR, matched VARCHAR", ("  A&nbsp;&amp;\n B ", "A & B", "a & b", "a b"), ("Straße 3.0", "Straße 3.0", "strasse 3.0", "strasse 3 0"), (" x ", "x", "x", "x"), (None, None, None, None))
def e15_names(spark):
    rows = spark.createDataFrame([("  A&nbsp;&amp;\n B ",), ("Straße 3.0",), (" x ",), (None,)], "raw string")
    return rows.select("raw", text.clean_text("raw").alias("cleaned"), text.fold_key("raw").alias("folded"), text.match_key("raw").alias("matched"))


@expects("spec VARCHAR, kind VARCHAR, level INTEGER, path VARCHAR", ("stockfish:5", "stockfish", 5, None), ("SF:8", "stockfish", 8, None), ("stockfish:9", None, None, None), ("a/b.pt", "checkpoint", None, "a/b.pt"))
def e19_engine_specs(spark):
    def parse(spec):
        kind, value = replay.engine_spec(spec)
        return kind, value if kind == "stockfish" else None, value if kind != "stockfish" else None

    return applied(spark, [("stockfish:5",), ("SF:8",), ("stockfish:9",), ("a/b.pt",)], "spec string", parse, "kind string, level int, path string")


MATE_IN_ONE = "6k1/5ppp/8/8/8/8/5PPP/R5K1 w - - 0 1"


@expects("id INTEGER, san VARCHAR, mate INTEGER", (1, "Ra8#", 1), (2, "e4,e5", None), (3, "f3,e5,g4,Qh4#", -2), (4, None, None))
def e20_lines(spark):
    rows = spark.createDataFrame([(1, MATE_IN_ONE, ["a1a8", "g8f8"]), (2, START, ["e2e4", "e7e5", "e1e4"]), (3, START, ["f2f3", "e7e5", "g2g4", "d8h4"]), (4, "x", ["e2e4"])], "id int, fen string, moves array<string>")
    return rows.withColumn("l", replay.read_lines(F.col("fen"), F.col("moves"))).select("id", F.array_join("l.san", ",").alias("san"), F.col("l.mate").alias("mate"))


@expects("id INTEGER, turn VARCHAR, in_check BOOLEAN, finished BOOLEAN, result VARCHAR, termination VARCHAR, from_squares INTEGER, half INTEGER", (1, "w", False, False, "*", None, 10, 37), (2, "b", False, True, "1/2-1/2", "stalemate", 0, 0), (3, "b", True, True, "1-0", "checkmate", 0, 1), (4, "w", False, True, "1/2-1/2", "insufficient material", 1, 0))
def e21_status(spark):
    fens = [(1, CLOCKS), (2, STALE), (3, "R5k1/5ppp/8/8/8/8/5PPP/6K1 b - - 1 1"), (4, "4k3/8/8/8/8/8/8/4K3 w - - 0 1")]
    s = spark.createDataFrame(fens, "id int, fen string").withColumn("s", encode.status(F.col("fen")))
    return s.select("id", "s.turn", F.col("s.check").alias("in_check"), F.col("s.over").alias("finished"), "s.result", "s.termination", F.size("s.moves").alias("from_squares"), F.col("s.halfmove").alias("half"))


@expects("id INTEGER, balance INTEGER, taken VARCHAR", (1, 0, ""), (2, 1, "B2,N2,P7,Q1,R2,b2,n2,p8,q1,r2"), (3, -9, "Q1"), (4, 8, "P1,Q-1"))
def e22_material(spark):
    fens = [(1, START), (2, BARE), (3, START.replace("RNBQKBNR", "RNB1KBNR")), (4, "rnbqkbnr/pppppppp/8/8/8/4Q3/PPPPPPP1/RNBQKBNR w KQkq - 0 1")]
    rows = spark.createDataFrame(fens, "id int, fen string").withColumn("c", encode.captured(F.col("fen")))
    some = F.array_sort(F.filter(F.map_entries("c"), lambda e: e["value"] != 0))
    return rows.select("id", encode.material(F.col("fen")).alias("balance"), F.array_join(F.transform(some, lambda e: F.concat(e["key"], e["value"].cast("string"))), ",").alias("taken"))


# Records

SHALLOW = {"depth": 18, "pvs": [pv(31, "d2d4"), pv(28, "e2e4")]}
DEEP = {"depth": 30, "knodes": 2000, "pvs": [pv(25, "e2e4")]}
WIDE = {"depth": 28, "knodes": 1000, "pvs": [pv(30, "e2e4"), pv(20, "d2d4")]}


@expects("id VARCHAR, reason VARCHAR", ("null", "schema"), ("list", "schema"), ("types", "schema"), ("broken", "schema"), ("empty", "empty"), ("board", "fen"), ("fen", "fen"), ("over", "terminal"), ("shallow", "depth"), ("text depth", "depth"), ("bad lines", "quality"), ("good", "kept"))
def f1_record_gates(spark):
    texts = {"null": "null", "list": "[]", "types": '{"fen": 42, "evals": []}', "broken": "{", "empty": json.dumps({"fen": START, "evals": []}), "board": record([pv(1, "e2e4")], fen="8/8/8/8/8/8/8/8 w - - 0 1"), "fen": record([pv(1, "e2e4")], fen="x y"), "over": record([pv(1, "h8g8")], fen=MATED), "shallow": record([pv(1, "e2e4")], depth=5), "text depth": record([pv(1, "e2e4")], depth="20"), "bad lines": record([pv(1, "e2e5")]), "good": record([pv(1, "e2e4")])}
    return judge(spark, texts).select("id", "reason")


@expects("id VARCHAR, reason VARCHAR, evaluations_rejected INTEGER", ("bound", "quality", 1), ("no lines", "quality", 1), ("negative effort", "quality", 1), ("too deep", "quality", 1), ("text effort", "quality", 1), ("one of two", "kept", 1), ("no effort", "kept", 0))
def f2_snapshot_gate(spark):
    good = {"depth": 20, "pvs": [pv(1, "e2e4")]}
    texts = {"bound": pairs(good | {"lowerbound": True}), "no lines": pairs(good | {"pvs": []}), "negative effort": pairs(good | {"knodes": -1}), "too deep": pairs(good | {"depth": 70_000}), "text effort": pairs(good | {"knodes": "9"}), "one of two": pairs(good, good | {"upperbound": True}), "no effort": pairs(good)}
    return counted(judge(spark, texts), "evaluations_rejected")


BAD_LINES = {"both": {"cp": 1, "mate": 2}, "neither": {}, "true": {"cp": True}, "text": {"cp": "30"}, "fraction": {"cp": 30.0}, "mate zero": {"mate": 0}, "bound": {"cp": 1, "lowerbound": True}, "illegal": {"cp": 1, "line": "e2e5"}, "illegal reply": {"cp": 1, "line": "e2e4 e7e3"}, "no line": {"cp": 1, "line": None}}


@expects("id VARCHAR, lines_rejected INTEGER, scores VARCHAR", *[(k, 1, "1") for k in BAD_LINES], ("infinite", 1, "3"))
def f3_line_gate(spark):
    texts = {k: record([pv(1, "d2d4"), {"line": "e2e4", **bad}]) for k, bad in BAD_LINES.items()}
    texts["infinite"] = '{"fen": "%s", "evals": [{"depth": 20, "pvs": [{"cp": 3, "line": "e2e4"}, {"cp": Infinity, "line": "d2d4"}]}]}' % START
    found = judge(spark, texts)
    return counted(found, "lines_rejected").join(found.select("id", F.array_join("policy_scores", ",").alias("scores")), "id").drop("reason")


@expects("id VARCHAR, reason VARCHAR, lines_rejected INTEGER, evaluations_rejected INTEGER", *[(k, "quality", 1, 1) for k in BAD_LINES])
def f4_first_line(spark):
    texts = {k: record([{"line": "e2e4", **bad}, pv(1, "d2d4")]) for k, bad in BAD_LINES.items()}
    return counted(judge(spark, texts), "lines_rejected", "evaluations_rejected")


@expects("id VARCHAR, reason VARCHAR, lines_repeated INTEGER, evaluations_rejected INTEGER, lines_rejected INTEGER", ("same", "kept", 1, 0, 0), ("clash", "quality", 1, 1, 1), ("twice", "kept", 2, 0, 0))
def f5_repeated_lines(spark):
    texts = {"same": record([pv(30, "e2e4"), pv(30, "e2e4"), pv(20, "d2d4")]), "clash": record([pv(30, "e2e4"), pv(1, "a1a1"), pv(31, "e2e4"), pv(1, "a1a1")]), "twice": record([pv(30, "e2e4")] * 3)}
    return counted(judge(spark, texts), "lines_repeated", "evaluations_rejected", "lines_rejected")


@expects("reason VARCHAR, n BIGINT", ("kept", 1), ("illegal", 1), ("duplicate", 1), ("result", 1))
def f6_game_gates(spark):
    found = games.judged(_games(spark), games.ratings_frame(spark, [*RATED, ("weak", 3500)]))
    return aggregates.histogram(found, F.col("reason"), "reason")


@expects("case_ VARCHAR, informative BOOLEAN, at_18 VARCHAR, at_20 VARCHAR", ("constant", False, "done", "ValueError"), ("varied", True, "done", "done"))
def f7_clock_planes(spark):
    rows = []
    for case, texts in (("constant", LINES[1:4]), ("varied", LINES)):
        out, _ = _dataset(spark, texts, shard_size=100, validation_fraction=0.0, test_fraction=0.0)
        rows.append((case, evals.clocks_vary(evals.read(spark, out)), _outcome(lambda out=out: evals.check_input_planes(spark, out, 18)), _outcome(lambda out=out: evals.check_input_planes(spark, out, 20))))
    return spark.createDataFrame(rows, "case_ string, informative boolean, at_18 string, at_20 string")


@expects("case_ VARCHAR, outcome VARCHAR", ("defaults", "done"), ("depth", "ValueError"), ("gap", "ValueError"), ("not finite", "ValueError"), ("fractions", "ValueError"), ("search", "ValueError"))
def f8_configurations(spark):
    cases = {"defaults": lambda: EvalConfig(), "depth": lambda: EvalConfig(min_depth=0), "gap": lambda: EvalConfig(max_policy_value_gap=1.5), "not finite": lambda: EvalConfig(max_policy_value_gap=float("nan")), "fractions": lambda: EvalConfig(validation_fraction=0.5, test_fraction=0.5), "search": lambda: search.SearchConfig(root="other")}
    return spark.createDataFrame([(k, _outcome(act)) for k, act in cases.items()], "case_ string, outcome string")


@expects("id INTEGER, ok BOOLEAN", (1, True), (2, False), (3, False), (4, True), (5, True))
def f9_histories(spark):
    after = "rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - 0 1"
    rows = spark.createDataFrame([(1, None, ["e2e4"], after), (2, None, ["e2e5"], None), (3, None, ["e2e4"], START), (4, "startpos", [], "startpos"), (5, BARE, ["e2e4"], None)], "id int, start string, moves array<string>, fen string")
    return rows.select("id", replay.history_ok(F.col("start"), F.col("moves"), F.col("fen")).alias("ok"))


@expects("id VARCHAR, problem VARCHAR", ("good", None), ("none", "no frames"), ("list", "no frames"), ("many", "too many frames"), ("no fen", "frame 1 has no position"), ("json", "not JSON"))
def f10_replays(spark):
    texts = {"good": {"frames": [{"fen": START}] * 512}, "none": {"frames": []}, "list": [1], "many": {"frames": [{"fen": START}] * 513}, "no fen": {"frames": [{"fen": START}, {}]}}
    rows = [(k, json.dumps(v)) for k, v in texts.items()] + [("json", "{")]
    return spark.createDataFrame(rows, "id string, value string").select("id", replay.replay_problem(F.col("value")).alias("problem"))


@expects("path VARCHAR, split VARCHAR, safe BOOLEAN", ("split=train/a.parquet", "train", True), ("split=train/a.parquet", "test", False), ("/split=train/a.parquet", "train", False), ("split=train/../a.parquet", "train", False), ("../a.parquet", "train", False), ("split=other/a.parquet", "other", False), ("split=test/a.txt", "test", False))
def f11_shard_paths(spark):
    rows = [("split=train/a.parquet", "train"), ("split=train/a.parquet", "test"), ("/split=train/a.parquet", "train"), ("split=train/../a.parquet", "train"), ("../a.parquet", "train"), ("split=other/a.parquet", "other"), ("split=test/a.txt", "test")]
    return spark.createDataFrame([(p, s, evals.path_problem(p, s) is None) for p, s in rows], "path string, split string, safe boolean")


@expects("case_ VARCHAR, outcome VARCHAR", ("whole", "done"), ("unlisted", "ValueError"), ("missing", "ValueError"))
def j6_listed_files(spark):
    out, made = _dataset(spark)
    rows = [("whole", _outcome(lambda: evals.check_shards(spark, out, made)))]
    rows.append(("missing", _outcome(lambda: evals.check_shards(spark, out, made | {"shards": [s | {"path": s["path"].replace("part", "no")} for s in made["shards"]]}))))
    Store(spark, out).write("split=train/more.parquet", b"x")
    rows.append(("unlisted", _outcome(lambda: evals.check_shards(spark, out, made))))
    return spark.createDataFrame(rows, "case_ string, outcome string")


@expects("id VARCHAR, value_score INTEGER, scores VARCHAR, value_depth INTEGER, policy_depth INTEGER, value_knodes BIGINT, policy_knodes BIGINT", ("wide disagrees", 25, "25", 30, 30, 2000, 2000), ("wide agrees", 25, "30,20", 30, 28, 2000, 1000), ("value gap", 300, "300", 30, 30, 0, 0), ("first of equals", 1, "1", 20, 20, 0, 0))
def r3_policy_snapshot(spark):
    texts = {"wide disagrees": pairs(DEEP, SHALLOW), "wide agrees": pairs(DEEP, WIDE), "value gap": pairs({"depth": 30, "pvs": [pv(300, "e2e4")]}, {"depth": 28, "pvs": [pv(-300, "e2e4"), pv(-400, "d2d4")]}), "first of equals": pairs({"depth": 20, "pvs": [pv(1, "e2e4")]}, {"depth": 20, "pvs": [pv(2, "d2d4")]})}
    found = judge(spark, texts)
    return found.select("id", F.col("score").cast("int").alias("value_score"), F.array_join("policy_scores", ",").alias("scores"), F.col("depth").alias("value_depth"), "policy_depth", F.col("value_knodes").cast("long"), F.col("policy_knodes").cast("long"))


@expects("id VARCHAR, depth_fallbacks INTEGER, move_disagreements INTEGER, value_disagreements INTEGER, clocks_missing INTEGER", ("shallow", 1, 0, 0, 0), ("move", 0, 1, 0, 0), ("value", 0, 0, 1, 0), ("clocks", 0, 0, 0, 1))
def r4_disagreements(spark):
    four = " ".join(START.split()[:4])
    texts = {"shallow": pairs(DEEP, SHALLOW), "move": pairs(DEEP, SHALLOW | {"depth": 29}), "value": pairs({"depth": 30, "pvs": [pv(300, "e2e4")]}, {"depth": 28, "pvs": [pv(-300, "e2e4"), pv(-400, "d2d4")]}), "clocks": record([pv(1, "e2e4")], fen=four)}
    return counted(judge(spark, texts), "depth_fallbacks", "move_disagreements", "value_disagreements", "clocks_missing").drop("reason")


@expects("name VARCHAR, n BIGINT", ("lines_schema", 1), ("lines_kept", 5), ("lines_rejected", 1), ("duplicates", 1), ("conflicts", 1), ("replacements", 1))
def a3_statistics(spark):
    texts = [*LINES[:-1], record([pv(1, "e1g1"), pv(1, "e1e4")], fen=CASTLES)]
    rows = judged(spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line long, value string"), EvalConfig())
    return spark.createDataFrame(list((evals.statistics(rows) | evals.duplicate_counters(rows)).items()), "name string, n long")


@expects("case_ VARCHAR, errors VARCHAR", ("none", ""), ("overlap", "piece_overlap"), ("two kings", "king_count"), ("side", "side_castling_planes"), ("en passant", "en_passant_plane"), ("back rank", "backrank_pawns"))
def a7_board_errors(spark):
    rows = spark.createDataFrame([(b, bytearray(_broken(b))) for b in BREAKS], "case_ string, board binary")
    return rows.select("case_", F.array_join(F.array_sort(encode.board_errors("board")), ",").alias("errors"))


@expects("id INTEGER, problem VARCHAR", (1, None), (2, "outside"), (3, "repeated"), (4, "none"), (5, "lengths"), (6, "score"), (7, "too many"))
def a8_target_problems(spark):
    rows = [(1, [0, 5], [1, 2]), (2, [9000], [1]), (3, [100, 100], [1, 1]), (4, [], []), (5, [1], [1, 2]), (6, [1], [30000]), (7, [1, 2, 3], [1, 2, 3])]
    rows = spark.createDataFrame(rows, "id int, places array<int>, scores array<int>")
    return rows.select("id", evals.policy_problem(F.col("places"), F.col("scores"), 2).alias("problem"))


def _audit(spark) -> dict:
    out, _ = _dataset(spark)
    return evals.audit(spark, out, legal_samples=0)


@expects("white BIGINT, black BIGINT, half_min INTEGER, half_max INTEGER, full_min INTEGER, full_max INTEGER, gap DOUBLE", (3, 1, 0, 8, 1, 11, 0.0))
def a6_clock_ranges(spark):
    r = _audit(spark)
    return spark.createDataFrame([(r["turns"]["white"], r["turns"]["black"], r["clock_bytes_min"][0], r["clock_bytes_max"][0], r["clock_bytes_min"][1], r["clock_bytes_max"][1], round(r["value_policy_expected_gap_max"], 9))], "white long, black long, half_min int, half_max int, full_min int, full_max int, gap double")


@expects("valid BOOLEAN, whole BOOLEAN, positions BIGINT, errors BIGINT, pieces VARCHAR, candidates VARCHAR, bins VARCHAR", (True, True, 4, 0, "3:1,32:2,6:1", "1:3,2:1", "0,0,0,4,0,0,0"))
def a9_audit_report(spark):
    r = _audit(spark)
    shown = [",".join(f"{k}:{v}" for k, v in sorted(r[name].items())) for name in ("piece_counts", "policy_candidates")]
    return spark.createDataFrame([(r["valid"], r["complete_legal_scan"], r["positions_checked"], r["error_count"], *shown, ",".join(map(str, r["score_bin_counts"])))], "valid boolean, whole boolean, positions long, errors long, pieces string, candidates string, bins string")


@expects("place INTEGER, name VARCHAR, games INTEGER", (0, "Gamma", 6), (1, "Alpha-1", 5))
def r5_strong_archives(spark):
    ratings = games.ratings_frame(spark, [("Alpha-1", 3600), ("Beta", 3400), ("Gamma", 3700), ("Delta", 3500)])
    archives = spark.createDataFrame([("alpha 1", 5, "u", 1.0), ("gamma", 6, "v", None), ("beta", 7, "w", 2.0), ("delta", 8, "x", 2.0)], "name string, games int, url string, size_mb double")
    found = games.strong_archives(ratings, archives, most=2).select("name", "games").collect()
    return spark.createDataFrame([(i, r["name"], r["games"]) for i, r in enumerate(found)], "place int, name string, games int")


@expects("ply INTEGER, board VARCHAR, value FLOAT", (0, "w", 0.0), (1, "b", 0.0), (2, "w", 0.0))
def r9_plies(spark):
    rows = spark.createDataFrame([(START, ["e2e4", "e7e5", "g1f3"], "1/2-1/2")], "start_fen string, moves array<string>, result string")
    return source.plies(rows).select("ply", F.when(F.hex(F.substring("board", 97, 1)) == "FF", "w").otherwise("b").alias("board"), "value")


# Keys, splits, files


@expects("fen VARCHAR, key VARCHAR", (START, "7844ff175e1efc439f674c94ddae9226"), (CLOCKS, "7844ff175e1efc439f674c94ddae9226"))
def p1_position_keys(spark):
    rows = spark.createDataFrame([(START,), (CLOCKS,)], "fen string")
    return rows.select("fen", F.lower(F.hex(encode.key_of(encode.pack_fen("fen")))).alias("key"))


@expects("key VARCHAR, seed INTEGER, units VARCHAR, label VARCHAR", ("a", 0, "9612993560450246145", "validation"), ("a", 1, "9887382726076472554", "validation"), ("b", 0, "9894584163658648123", "validation"), ("b", 1, "14448121122359654989", "train"), ("c", 0, "1247933583203584266", "test"), ("c", 1, "1720336966675017210", "test"), ("d", 0, "13362793682387738006", "train"), ("d", 1, "11768039386214309308", "train"))
def p2_keyed_split(spark):
    def place(key, seed):
        return str(encode.split_fraction(key.encode(), seed)), encode.split_of(key.encode(), 0.3, 0.3, seed)

    return applied(spark, [(k, s) for k in "abcd" for s in (0, 1)], "key string, seed int", place, "units string, label string")


@expects("split VARCHAR, falls BIGINT, repeats BIGINT", ("train", 0, 0), ("validation", 0, 0))
def p3_clustered_shards(spark):
    out, _ = _dataset(spark, shard_size=100)
    rows = evals.read(spark, out).withColumn("file", F.col("_metadata.file_name")).withColumn("row", F.monotonically_increasing_id())
    return ranking.order_violations(rows, ["split"], ["file", "row"], F.hex("position_hash"))


@expects("held INTEGER, kept INTEGER, again BOOLEAN, one_left BOOLEAN", (3, 7, True, True))
def p4_shard_split(spark):
    names = [f"shard-{i}" for i in range(10)]
    kept, held = split.shard_split(names, 0.25, 5)
    rows = [(len(held), len(kept), split.shard_split(names, 0.25, 5) == (kept, held), split.shard_split(names[:1], 0.5, 5) == (names[:1], []))]
    return spark.createDataFrame(rows, "held int, kept int, again boolean, one_left boolean")


@expects("path VARCHAR, bytes BIGINT, sha256 VARCHAR", ("split=train/a.parquet", 3, "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("split=test/b.parquet", 1, "18ac3e7343f016890c510e93f935261169d9e3f565436429830faf0934f4f8e4"))
def p5_checksums(spark):
    return evals.checksums(spark, folder(spark, {"split=train/a.parquet": b"abc", "split=test/b.parquet": b"d", "notes.txt": b"x"}))


@expects("split VARCHAR, rows_ BIGINT, others BIGINT", ("train", 2, 0), ("validation", 2, 0), ("test", 0, 0))
def p7_split_pruning(spark):
    out, _ = _dataset(spark)
    found = None
    for name in evals.SPLITS:
        part = evals.read(spark, out, name).agg(F.count("*").alias("rows_"), F.count_if(F.col("split") != name).alias("others")).select(F.lit(name).alias("split"), "rows_", "others")
        found = part if found is None else found.union(part)
    return found


@expects("key INTEGER, name VARCHAR", (2, "b"))
def u2_left_over(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "key int, name string")
    return lookup.missing(left, spark.createDataFrame([(1,), (3,), (3,)], "key int"), ["key"])


# Targets


@expects("p DOUBLE, bins VARCHAR", (0.5, "881,4119,4119,881"), (0.0, "8176,1748,76,1"), (1.0, "1,76,1748,8176"), (None, None))
def v2_value_bins(spark):
    rows = spark.createDataFrame([(0.5,), (0.0,), (1.0,), (None,)], "p double").withColumn("t", targets.value_targets(F.col("p"), 4))
    return rows.select("p", F.array_join(F.transform("t", lambda x: F.round(x * 10_000).cast("int")), ",").alias("bins"))


@expects("id INTEGER, loss DOUBLE", (1, 1.386294), (2, 0.693147), (3, 0.407606))
def v5_categorical_loss(spark):
    rows = spark.createDataFrame([(1, [0.0] * 4, [0.25] * 4), (2, [5.0, 5.0], [1.0, 0.0]), (3, [1.0, 2.0, 3.0], [0.0, 0.0, 1.0])], "id int, v array<double>, t array<double>")
    return rows.select("id", F.round(shaping.categorical_loss(F.col("v"), F.col("t")), 6).alias("loss"))


@expects("id INTEGER, shares VARCHAR, gathered VARCHAR", (1, "0.49,0.306,0.151,0.047,0.005,0.0,0.0", "9.0,7.0"), (2, "0.0,0.0", "8.0"))
def v8_padding(spark):
    rows = spark.createDataFrame([(1, [30.0, 10.0, -20.0, -70.0, -170.0, None, None], [2, 0, -1]), (2, [None, None], [1, -1, 9])], "id int, scores array<double>, places array<int>")
    shares = F.transform(shaping.policy_targets(F.col("scores")), lambda x: F.round(x, 3).cast("string"))
    found = F.filter(lookup.gather(F.array(F.lit(7.0), F.lit(8.0), F.lit(9.0)), F.col("places")), lambda x: x.isNotNull())
    return rows.select("id", F.array_join(shares, ",").alias("shares"), F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("gathered"))


# Search


def _searched(spark, cases: list[tuple], function: Callable, out: str) -> DataFrame:
    return applied(spark, cases, "fen string, root string, simulations int", function, out)


def _run(fen: str, root: str, simulations: int, batch: int = 4):
    tree = search.Search(search.material_evaluator, search.SearchConfig(simulations=simulations, root=root, batch=batch, candidates=64))
    return (*tree.run(encode.board_of(fen)), tree.counters)


CASES = [(MATE_IN_ONE, root, n) for root in ("puct", "halving", "rescue") for n in (7, 400)]


@expects("fen VARCHAR, root VARCHAR, simulations INTEGER, visits INTEGER, share DOUBLE", *[(*c, c[2], 1.0) for c in CASES])
def m4_search_budget(spark):
    def run(fen, root, n):
        node, policy, _ = _run(fen, root, n)
        return int(node.visits.sum()), round(float(policy.sum()), 9)

    return _searched(spark, CASES, run, "visits int, share double")


@expects("fen VARCHAR, root VARCHAR, simulations INTEGER, best VARCHAR", *[(MATE_IN_ONE, r, 400, "a1a8") for r in ("puct", "halving", "rescue")], ("7k/8/5K2/8/8/8/8/6R1 b - - 0 1", "puct", 40, "h8h7"))
def m5_root_choice(spark):
    def run(fen, root, n):
        node, policy, _ = _run(fen, root, n)
        return node.moves[int(policy.argmax())].uci()

    return _searched(spark, [c for c in CASES if c[2] == 400] + [("7k/8/5K2/8/8/8/8/6R1 b - - 0 1", "puct", 40)], run, "best string")


@expects("case_ VARCHAR, value DOUBLE", ("mated", -1.0), ("stalemate", 0.0), ("fifty moves", 0.0), ("third time", 0.0), ("goes on", None))
def m2_adjudication(spark):
    fens = {"mated": "R5k1/5ppp/8/8/8/8/5PPP/6K1 b - - 1 1", "stalemate": STALE, "fifty moves": BARE.replace("3 9", "100 90"), "third time": BARE, "goes on": BARE}

    def value(case):
        board = Board(fens[case])
        return search.ended(board, search.Counter({board.epd(): 3 if case == "third time" else 2}))

    return applied(spark, [(c,) for c in fens], "case_ string", value, "value double")


@expects("case_ VARCHAR, visits VARCHAR, sums VARCHAR", ("lent", "1,1", "-1,-1"), ("returned", "1,1", "0.5,-0.5"), ("cancelled", "0,0", "0,0"))
def m3_backed_up(spark):
    def run(case):
        nodes = [search.Node(Board().legal_moves()[:1], np.ones(1), 0.0) for _ in range(2)]
        path = [(n, 0) for n in nodes]
        for node, i in path:
            node.visits[i] += 1
            node.sums[i] -= 1
        if case == "returned":
            search.Search.back(path, 0.5)
        elif case == "cancelled":
            search.Search.cancel(path)
        return ",".join(f"{n.visits[0]:g}" for n in nodes), ",".join(f"{n.sums[0]:g}" for n in nodes)

    return applied(spark, [("lent",), ("returned",), ("cancelled",)], "case_ string", run, "visits string, sums string")


@expects("fen VARCHAR, first VARCHAR, longest BOOLEAN", (MATE_IN_ONE, "a1a8", True), (BARE, "e1", True))
def m6_principal_line(spark):
    def run(fen):
        node, _, _ = _run(fen, "puct", 400)
        found = search.principal_line(node)
        return found[0] if fen == MATE_IN_ONE else found[0][:2] if found[0][:2] == "e2" else "e1", 1 <= len(found) <= 12

    return applied(spark, [(MATE_IN_ONE,), (BARE,)], "fen string", run, "first string, longest boolean")


def _first_move():
    return lambda board: board.legal_moves()[0]


def _match(spark, n: int) -> DataFrame:
    return search.run_match(spark, ("a", _first_move), ("b", _first_move), n, opening_plies=4, seed=3, most=12)


@expects("round INTEGER, white VARCHAR, black VARCHAR, plies INTEGER, opening_plies INTEGER, moves INTEGER, termination VARCHAR", (1, "a", "b", 12, 4, 16, "max plies"), (2, "b", "a", 12, 4, 16, "max plies"), (3, "a", "b", 12, 4, 16, "max plies"))
def m8_match_games(spark):
    return _match(spark, 3).select("round", "white", "black", "plies", "opening_plies", F.size("moves").alias("moves"), "termination")


@expects("games BIGINT, draws BIGINT, pairs INTEGER, groups BIGINT, score DOUBLE, superiority DOUBLE", (4, 4, 2, 2, 0.5, 0.5))
def a10_match_report(spark):
    return games.match_report(_match(spark, 4), "a").select("games", "draws", F.col("pairs").cast("int"), "groups", "score", "superiority")


@expects("rank INTEGER, move VARCHAR, led BOOLEAN", (1, "a1a8", True))
def m9_analysis(spark):
    found = search.search_positions(spark.createDataFrame([(MATE_IN_ONE,)], "fen string"), config=search.SearchConfig(simulations=400), lines=1)
    return found.select("rank", "move", ((F.col("share") > 0.5) & (F.col("value") > 0.9) & (F.col("line")[0] == "a1a8")).alias("led"))


@expects("fen VARCHAR, lines BIGINT, whole DOUBLE, falling BOOLEAN", (MATE_IN_ONE, 20, 1.0, True))
def r7_multi_pv(spark):
    found = search.search_positions(spark.createDataFrame([(MATE_IN_ONE,)], "fen string"), config=search.SearchConfig(simulations=400), lines=64)
    shares = F.transform(F.array_sort(F.collect_list(F.struct("rank", "share"))), lambda r: r["share"])
    return found.groupBy("fen").agg(F.count("*").alias("lines"), F.round(F.sum("share"), 9).alias("whole"), (shares == F.reverse(F.array_sort(shares))).alias("falling"))


@expects("fen VARCHAR, shares VARCHAR", (BARE, "1.0"))
def a20_visit_shares(spark):
    found = search.search_positions(spark.createDataFrame([(BARE,)], "fen string"), config=search.SearchConfig(simulations=50), lines=64)
    return found.groupBy("fen").agg(F.round(F.sum("share"), 6).cast("string").alias("shares"))


@expects("fen VARCHAR, root VARCHAR, simulations INTEGER, spent BOOLEAN", *[(*c, True) for c in CASES])
def a18_search_counters(spark):
    """Every simulation ends in one evaluation or one adjudicated leaf; the root is evaluated besides."""
    def run(fen, root, n):
        _, _, counters = _run(fen, root, n, batch=1)
        return counters["evaluated"] + counters["adjudicated"] == n + 1

    return _searched(spark, CASES, run, "spent boolean")


@expects("epd VARCHAR, n BIGINT", ("4k3/8/8/8/8/8/4P3/4K3 w - -", 2), ("4k3/8/8/8/8/8/4P3/3K4 b - -", 1), ("3k4/8/8/8/8/8/4P3/3K4 w - -", 1), ("3k4/8/8/8/8/8/4P3/4K3 b - -", 1))
def a19_history_counts(spark):
    rows = spark.createDataFrame([(1, BARE, ["e1d1", "e8d8", "d1e1", "d8e8"])], "game int, start_fen string, moves array<string>")
    return games.history(rows).groupBy("epd").agg(F.count("*").alias("n"))
