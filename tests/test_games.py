import pytest

from quern.functions.rules import START
from quern.plans import games
from quern.sources import games as source

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

1. d4 d5 1-0

[Event "C"]
[Round "7"]
[Date "2024.01.01"]
[White "Alpha 1"]
[Black "Beta"]
[Result "1-0"]
[BlackElo "3600"]

1. e4 e5 2. Nf3 Nc6 1-0
"""


def test_build(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.pgn").write_text(PGN)
    (raw / "_extracted").mkdir()
    (raw / "_extracted" / "b.pgn").write_text(PGN)
    out = str(tmp_path / "out")
    stats = games.build(spark, str(raw), [("ALPHA  1", 3550)], out)
    assert stats == {"seen": 3, "kept": 1, "rating": 1, "duplicate": 1, "samples": 4}
    rows = spark.read.parquet(out).orderBy("ply").collect()
    assert [r["value"] for r in rows] == [1, -1, 1, -1] and rows[0]["policy"] == 877 and len(rows[0]["board"]) == 146


def test_pages():
    table = "<table><tr><th>Rank<th>Name<th>Elo<th>Games</tr><tr><td>1</td><td>Alpha&nbsp;1</td><td>3'612</td><td>10</td></tr><tr><td>x<td>No<td>12</tr></table>"
    assert games.parse_ratings(table) == [("Alpha 1", 3612)]
    assert games.parse_ratings("<pre>1  Beta 2   3456 x\n</pre>") == [("Beta 2", 3456)]
    page = '<table><tr><th>Engine name<th>Number of games<th>Commented PGN</tr><tr><td>Alpha 1<td>1\'017<td><a href="a.7z">512 KB</a></tr></table><a href="/g/Beta_2.[33].pgn.7z">1.5 GB</a>'
    found = games.parse_archives(page, "http://x/y/", r"(?P<name>.+)\.\[(?P<games>\d+)\]\.pgn\.7z$")
    assert found == [("Alpha 1", 1017, "http://x/y/a.7z", 0.5), ("Beta 2", 33, "http://x/g/Beta_2.[33].pgn.7z", 1536.0)]


def test_strong_archives_and_ratings(spark, tmp_path):
    ratings = games.ratings_frame(spark, [("Alpha-1", 3600), ("Beta", 3400), ("Gamma", 3700)])
    archives = spark.createDataFrame([("alpha 1", 5, "u", 1.0), ("gamma", 6, "v", None)], "name string, games int, url string, size_mb double")
    assert [(r["name"], r["games"]) for r in games.strong_archives(ratings, archives).collect()] == [("Gamma", 6), ("Alpha-1", 5)]
    path = str(tmp_path / "r.json")
    games.save_ratings([("b", 1000), ("A", 1000), ("c", 2000)], path)
    assert games.load_ratings(path) == [("c", 2000), ("A", 1000), ("b", 1000)]


def test_openings(spark):
    book = games.opening_book(spark.createDataFrame([("C50", "Italian Game", "1. e4 e5 2. Nf3 Nc6 3. Bc4"), ("C20", "King's Pawn", "1. e4 e5")], "eco string, name string, pgn string").coalesce(1))
    rows = spark.createDataFrame([(1, START, ["e2e4", "e7e5", "g1f3", "b8c6", "f1c4", "g8f6", "d2d3"]), (2, START, ["d2d4"])], "game int, start_fen string, moves array<string>")
    got = {r["game"]: (r["ply"], r["eco"]) for r in games.classify(rows, book).collect()}
    assert got == {1: (5, "C50"), 2: (None, None)}
    lines = spark.createDataFrame([(START,), ("# no",), ("",), ("rnbqkbnr/pppppppp/8/8/4P3/8/PPPP1PPP/RNBQKBNR b KQkq - id \"x\";",), ("7k/5Q2/6K1/8/8/8/8/8 b - -",), ("junk",)], "value string")
    assert source.opening_positions(lines).count() == 2


def test_match_report(spark):
    row = lambda i, w, b, r, p: (i, w, b, r, p, 1, START, ["e2e4"], 1.0, 2.0)
    df = spark.createDataFrame([row(1, "a", "b", "1-0", 40), row(2, "b", "a", "0-1", 50), row(3, "a", "b", "1/2-1/2", 60), row(4, "b", "a", "1-0", 60)], "round int, white string, black string, result string, plies int, opening_plies int, start_fen string, moves array<string>, white_seconds double, black_seconds double")
    r = games.match_report(df, "a").first()
    assert (r["wins"], r["draws"], r["losses"], r["score"], r["mean_plies"], r["pairs"], r["groups"]) == (2, 1, 1, 0.625, 52.5, 2, 1)
    assert r["own_seconds"] == 6.0 and r["score_low"] == 0.0


def test_pgn_round_trip():
    text = source.pgn(START, ["e2e4", "e7e5", "g1f3"], {"Result": "*"})
    headers, body = next(source.split_games(text))
    assert source.parse_game(headers, body)["moves"] == ["e2e4", "e7e5", "g1f3"]
    assert "SetUp" in source.pgn("4k3/8/8/8/8/8/4P3/4K3 b - - 0 1", ["e8e7"], {"Result": "*"})


@pytest.mark.parametrize("wins", [0, 3])
def test_likelihood(spark, wins):
    from pyspark.sql import functions as F

    from quern.operators.aggregates import elo_of, likelihood_of_superiority

    df = spark.createDataFrame([(wins, wins)], "w long, l long")
    assert df.select(likelihood_of_superiority(F.col("w"), F.col("l"))).first()[0] == 0.5
    assert abs(df.select(elo_of(F.lit(0.75))).first()[0] - 190.85) < 0.01 and df.select(elo_of(F.lit(1.0))).first()[0] == 1000
