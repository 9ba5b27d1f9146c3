"""The games dataset: rated, deduplicated games as one row per position; ratings, archives and openings."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import unquote, urljoin, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as names
from quern.functions.encode import board_of
from quern.functions.rules import Board
from quern.operators import aggregates, dedup, lookup
from quern.operators.stage import cut
from quern.sources import games as source
from quern.sources.lines import whole_files


class _Rows(HTMLParser):
    """Tables as rows of cells, cells as text with the first link in them; and all links."""

    def __init__(self, text: str):
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[tuple[str, str, str | None]]]] = []
        self.links: list[tuple[str, str]] = []
        self.text: list[str] = []
        self.cell: list | None = None
        self.link: list | None = None
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "table":
            self.tables.append([])
        elif tag == "tr":
            if not self.tables:
                self.tables.append([])
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = [tag, [], None]
            self.tables[-1][-1].append(self.cell)
        elif tag == "a" and attrs.get("href"):
            self.link = [attrs["href"], []]
            self.links.append(self.link)
            if self.cell is not None and self.cell[2] is None:
                self.cell[2] = attrs["href"]

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None
        if tag == "a":
            self.link = None

    def handle_data(self, data):
        self.text.append(data)
        for held in (self.cell, self.link):
            if held is not None:
                held[1].append(data.strip())

    @staticmethod
    def said(parts: list[str]) -> str:
        return names.clean(" ".join(p for p in parts if p))


def _int(text: str) -> int | None:
    m = re.search(r"\d[\d']*", names.clean(text))
    return int(m[0].replace("'", "")) if m else None


def _size(text: str) -> float | None:
    m = re.search(r"\d+(?:\.\d+)?", names.clean(text))
    if not m:
        return None
    lower = text.casefold()
    return float(m[0]) * (1024 if "gb" in lower else 1) / (1024 if "gb" not in lower and "kb" in lower else 1)


def parse_ratings(page: str) -> list[tuple[str, int]]:
    """(name, elo) of a rating page's rows, or of its lines where no row is one; the last of a name wins."""
    found: dict[str, tuple[str, int]] = {}
    rows = _Rows(page)
    for row in (r for t in rows.tables for r in t):
        cells = [rows.said(c[1]) for c in row]
        if len(cells) < 3 or cells[0].casefold() in ("rank", "#"):
            continue
        elo = _int(cells[2])
        if _int(cells[0]) is not None and elo is not None and 1000 <= elo <= 5000 and cells[1]:
            found[names.name_key(cells[1])] = (cells[1], elo)
    if not found:
        for line in "\n".join(rows.text).splitlines():
            if m := re.match(r"\s*\d+\s+(.+?)\s+([1-4]\d{3})\b", names.clean(line)):
                found[names.name_key(m[1])] = (m[1], int(m[2]))
    return list(found.values())


def parse_archives(page: str, base: str, pattern: str) -> list[tuple[str, int, str, float | None]]:
    """(name, games, url, megabytes) of an archive page: of its tables, then of links whose file name fits ``pattern`` (groups name and games) for names that no table has."""
    found: dict[str, tuple] = {}
    rows = _Rows(page)
    for table in rows.tables:
        heads = [rows.said(c[1]).casefold() for r in table for c in r if c[0] == "th"]
        if not any(h.startswith("engine") for h in heads) or not any("commented" in h for h in heads):
            continue
        for row in table:
            cells = [c for c in row if c[0] == "td"]
            if len(cells) >= 3 and (name := rows.said(cells[0][1])) and (n := _int(rows.said(cells[1][1]))) is not None and cells[-1][2]:
                found[names.name_key(name)] = (name, n, urljoin(base, cells[-1][2]), _size(rows.said(cells[-1][1])))
    for href, said in rows.links:
        m = re.match(pattern, unquote(urlparse(href).path.rpartition("/")[2]))
        if m:
            name = names.clean(m["name"].replace("_", " "))
            found.setdefault(names.name_key(name), (name, int(m["games"]), urljoin(base, href), _size(rows.said(said))))
    return list(found.values())


def ratings_of(pages: DataFrame) -> DataFrame:
    """S7 over pages (value): name, elo; within a page the last of a name wins."""
    found = F.udf(lambda page: [{"name": n, "elo": e} for n, e in parse_ratings(page or "")], "array<struct<name:string,elo:int>>", useArrow=True)
    return pages.select(F.explode(found("value")).alias("row")).select("row.*")


def archives_of(pages: DataFrame, base: str, pattern: str) -> DataFrame:
    """S8 over pages (value): name, games, url, size_mb."""
    names_ = ("name", "games", "url", "size_mb")
    found = F.udf(lambda page: [dict(zip(names_, r, strict=True)) for r in parse_archives(page or "", base, pattern)], "array<struct<name:string,games:int,url:string,size_mb:double>>", useArrow=True)
    return pages.select(F.explode(found("value")).alias("row")).select("row.*")


def ratings_frame(spark: SparkSession, rows: list[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, elo int").withColumn("key", names.fold_key("name"))


def save_ratings(rows: list[tuple[str, int]], path: str) -> None:
    """Strongest first, then by name without regard to case."""
    ordered = sorted(rows, key=lambda r: (-r[1], r[0].casefold()))
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"ratings": [{"name": n, "elo": e} for n, e in ordered]}, f, ensure_ascii=False, indent=1)


def load_ratings(path: str) -> list[tuple[str, int]]:
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    return [(r["name"], int(r["elo"])) for r in (held["ratings"] if isinstance(held, dict) else held)]


def strong_archives(ratings: DataFrame, archives: DataFrame, least: int = 3500, most: int | None = None) -> DataFrame:
    """Archives of names rated at least ``least``, under the rating's name, strongest first."""
    rated = ratings.where(F.col("elo") >= least).withColumn("match", names.match_key("name"))
    held = archives.withColumn("match", names.match_key("name")).drop("name").withColumn("order", F.monotonically_increasing_id())
    found = lookup.keyed_attributes(rated, held, "match", [F.desc("order")])
    found = found.select("name", "elo", "games", "url", "size_mb").orderBy(F.desc("elo"), names.fold_key("name"))
    return found if most is None else found.limit(most)


def rated(games: DataFrame, ratings: DataFrame) -> DataFrame:
    """Games with white_elo and black_elo: from the list, else from either header that holds a number."""
    small = ratings.select("key", "elo")
    for side in ("White", "Black"):
        name = side.lower()
        header = [names.first_int(F.col("headers")[f"{side}{k}"]).cast("int") for k in ("Elo", "Rating")]
        dim = small.select(F.col("key").alias(f"{name}_key"), F.col("elo").alias(f"{name}_listed"))
        games = games.withColumn("own_key", names.fold_key(F.coalesce(F.col("headers")[side], F.lit(""))))
        games = lookup.left_lookup(games, dim, F.col("own_key") == F.col(f"{name}_key"), F.col(f"{name}_listed"), header, f"{name}_elo").drop("own_key", f"{name}_key", f"{name}_listed")
    return games


def judged(games: DataFrame, ratings: DataFrame, least: int = 3500) -> DataFrame:
    """Games with the first gate that each fails: result, rating, duplicate, illegal, or kept."""
    found = rated(games, ratings).withColumn("result", F.coalesce(F.col("headers")["Result"], F.lit("*")))
    gates = [("result", F.col("result").isin("1-0", "0-1", "1/2-1/2")), ("rating", (F.col("white_elo") >= least) & (F.col("black_elo") >= least))]
    found = cut(found.withColumn("gate", aggregates.first_failed(gates, "passed")))
    identity = [F.coalesce(F.col("headers")[h], F.lit("")).alias(f"id_{h}") for h in ("Date", "White", "Black", "Result")]
    passed = found.where("gate = 'passed'").select("file", "number", *identity, "start_fen", F.array_join("moves", " ").alias("id_moves"))
    first = dedup.first_arrival(passed, [c for c in passed.columns if c not in ("file", "number")], ["file", "number"]).select("file", "number", F.lit(True).alias("is_first"))
    found = found.join(first, ["file", "number"], "left")
    reason = F.when(F.col("gate") != "passed", F.col("gate")).when(F.col("is_first").isNull(), "duplicate").when(F.col("error").isNotNull(), "illegal").otherwise("kept")
    return found.withColumn("reason", reason).drop("gate", "is_first")


def build(spark: SparkSession, raw: str, ratings: list[tuple[str, int]], out: str, least: int = 3500, shard_size: int = 65_536) -> dict[str, int]:
    """K4: write a row for each position of the games below ``raw`` that pass; games by reason, and samples."""
    games = source.read_games(whole_files(spark, raw, "*.pgn"))
    found = cut(judged(games, ratings_frame(spark, ratings), least))
    stats = {r["reason"]: r["n"] for r in aggregates.histogram(found, F.col("reason"), "reason").collect()}
    rows = source.plies(found.where("reason = 'kept'").select("start_fen", "moves", "result"))
    rows.write.option("maxRecordsPerFile", shard_size).mode("errorifexists").parquet(out)
    return stats | {"seen": sum(stats.values()), "samples": spark.read.parquet(out).count()}


def opening_book(rows: DataFrame) -> DataFrame:
    """Epd, eco, name of a book's rows (eco, name, pgn); of rows that lead to one position the last counts."""

    @F.udf("string", useArrow=True)
    def reached(pgn: str):
        try:
            board = Board()
            for san in source.main_line(pgn or ""):
                board.push(board.parse_san(san))
            return board.epd()
        except ValueError:
            return None

    found = rows.withColumn("order", F.monotonically_increasing_id()).withColumn("epd", reached("pgn")).where("epd is not null")
    return found.groupBy("epd").agg(F.max(F.struct("order", "eco", "name")).alias("last")).select("epd", "last.eco", "last.name")


def history(games: DataFrame, key: str = "game") -> DataFrame:
    """A row for each position of a game's history, the start included: ``key``, ply, epd."""

    @F.udf("array<string>", useArrow=True)
    def positions(start: str, moves: list):
        board = board_of(start)
        out = [board.epd()]
        for uci in moves if moves is not None else []:
            board.push(board.parse_uci(uci))
            out.append(board.epd())
        return out

    return games.select(key, F.posexplode(positions("start_fen", "moves")).alias("ply", "epd"))


def classify(games: DataFrame, book: DataFrame, key: str = "game") -> DataFrame:
    """The last named position of each game."""
    return lookup.last_match(history(games, key), book, "epd", key, "ply", ["eco", "name"])


def match_report(games: DataFrame, side: str) -> DataFrame:
    """The summary of a match from ``side``'s view, with pairs of games that swap colours after one opening."""
    first = F.col("white") == side
    points = F.when(F.col("result") == "1/2-1/2", 0.5).when((F.col("result") == "1-0") == first, 1.0).otherwise(0.0)
    opening = F.struct("start_fen", F.slice("moves", 1, F.col("opening_plies")))
    summary = aggregates.match_summary(games, points, F.col("plies"), opening)
    pair = F.floor((F.col("round") - 1) / 2)
    odd, even = games.where("round % 2 = 1"), games.where("round % 2 = 0")
    a, b = odd.select(pair.alias("pair"), *[F.col(c).alias(f"a_{c}") for c in games.columns]), even.select(pair.alias("pair"), *[F.col(c).alias(f"b_{c}") for c in games.columns])
    same = (F.col("a_white") == F.col("b_black")) & (F.col("a_black") == F.col("b_white")) & (F.col("a_start_fen") == F.col("b_start_fen")) & (F.col("a_opening_plies") == F.col("b_opening_plies"))
    same = same & (F.slice("a_moves", 1, F.col("a_opening_plies")) == F.slice("b_moves", 1, F.col("b_opening_plies")))
    pairs = a.join(b, "pair").where(same).count()
    seconds = games.agg(F.sum(F.when(first, F.col("white_seconds")).otherwise(F.col("black_seconds"))).alias("own_seconds"), F.sum(F.when(first, F.col("black_seconds")).otherwise(F.col("white_seconds"))).alias("other_seconds")).first()
    out = summary.withColumns({"pairs": F.lit(pairs), "unpaired": F.col("games") - 2 * pairs, "own_seconds": F.lit(seconds["own_seconds"]), "other_seconds": F.lit(seconds["other_seconds"])})
    return out.withColumn("superiority", aggregates.likelihood_of_superiority(F.col("wins"), F.col("losses")))


