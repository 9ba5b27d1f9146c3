import numpy as np
import pytest

from quern.functions.encode import board_of
from quern.functions.rules import Board
from quern.functions.search import Node, Search, SearchConfig, Tournament, material_evaluator, play, principal_line, random_opening, run_match, search_positions, select
from quern.functions.targets import value_bins

MATE_IN_ONE = "6k1/5ppp/8/8/8/8/5PPP/R5K1 w - - 0 1"


@pytest.mark.parametrize("root", ["puct", "halving", "rescue"])
@pytest.mark.parametrize("batch", [1, 8])
def test_search_spends_its_budget_and_mates(root, batch):
    search = Search(material_evaluator, SearchConfig(simulations=400, root=root, batch=batch, candidates=64))
    node, policy = search.run(board_of(MATE_IN_ONE))
    assert node.visits.sum() == 400 and abs(policy.sum() - 1) < 1e-9
    assert node.moves[int(policy.argmax())].uci() == "a1a8"
    assert len(principal_line(node)) >= 1
    assert np.isfinite(node.sums).all() and (np.abs(node.sums) <= node.visits + 1e-9).all()


def test_first_of_equals_and_unseen_moves():
    node = Node(Board().legal_moves(), np.full(20, 0.05), 0.0)
    assert select(node, 1.5, 0.3) == 0
    node.visits[0], node.sums[0] = 1, -1
    assert select(node, 1.5, 0.3) == 0 and select(node, 1.5, 0.0) == 1


def test_rescue_brings_moves_in():
    node = Node(Board().legal_moves()[:3], np.array([0.6, 0.3, 0.1]), 0.5)
    contest = Tournament(node, 8, SearchConfig(root="rescue", candidates=2))
    contest.plan(8)
    assert list(contest.agenda) == [0, 1] and [e.move for e in contest.inside] == [0, 1]
    node.visits[:2], node.sums[:2] = 1, -1
    contest.plan(6)
    assert contest.rescued == 1 and [e.move for e in contest.inside] == [0, 2] and list(contest.agenda) == [0, 2]


@pytest.mark.parametrize(("value", "rescues"), [(0.8, True), (-0.8, False)])
def test_rescue_only_where_values_fall_short(value, rescues):
    moves = [m for u in ("e2e4", "d2d4", "c2c4") for m in Board().legal_moves() if m.uci() == u]
    node = Node(moves, np.array([0.55, 0.35, 0.1]), value)
    contest, worth, left = Tournament(node, 8, SearchConfig(root="rescue", candidates=2)), [-0.8, -0.6, 0.8], 8
    while left:
        if not contest.agenda:
            contest.plan(left)
        i = contest.agenda.popleft()
        node.visits[i] += 1
        node.sums[i] += worth[i]
        left -= 1
    assert node.visits.sum() == 8 and contest.rescued == int(rescues)
    assert (node.visits[2] > 0) == rescues and (int(contest.policy().argmax()) == 2) == rescues


@pytest.mark.parametrize("budget", [1, 2, 3, 7, 19])
@pytest.mark.parametrize("root", ["halving", "rescue"])
def test_small_and_odd_budgets(budget, root):
    node, policy = Search(material_evaluator, SearchConfig(simulations=budget, root=root, batch=8, candidates=5)).run(Board())
    assert node.visits.sum() == budget and abs(policy.sum() - 1) < 1e-9 and node.visits[int(policy.argmax())] > 0


def test_value_breaks_equal_visits():
    def evaluate(boards):
        out = []
        for b in boards:
            n = len(b.legal_moves())
            priors = np.zeros(n)
            if b.fen() == Board().fen():
                for u, p in (("e2e4", 0.8), ("d2d4", 0.2)):
                    priors[[m.uci() for m in b.legal_moves()].index(u)] = p
                out.append((priors, 0.0))
            else:
                out.append((np.full(n, 1 / n), -0.8 if b.cells[27] else 0.8))
        return out

    node, policy = Search(evaluate, SearchConfig(simulations=2, batch=2, root="halving", candidates=2)).run(Board())
    ucis = [m.uci() for m in node.moves]
    assert node.visits[ucis.index("e2e4")] == node.visits[ucis.index("d2d4")] == 1 and ucis[int(policy.argmax())] == "d2d4" and policy.max() > 0.99


def test_positions_and_games(spark):
    rows = spark.createDataFrame([(MATE_IN_ONE,)], "fen string")
    got = search_positions(rows, config=SearchConfig(simulations=400)).collect()
    assert got[0]["move"] == "a1a8" and got[0]["rank"] == 1 and len(got) == 3
    moves, result, why = play(lambda b: b.legal_moves()[0], lambda b: b.legal_moves()[-1], ("e2e4",), most=30)
    assert moves[0] == "e2e4" and result in ("1-0", "0-1", "1/2-1/2") and why


def test_match_is_paired(spark):
    from quern.plans.games import match_report

    def first():
        return lambda board: board.legal_moves()[0]

    games = run_match(spark, ("a", first), ("b", first), 3, opening_plies=4, seed=3, most=12)
    rows = sorted(games.collect(), key=lambda r: r["round"])
    assert [(r["round"], r["white"], r["black"]) for r in rows] == [(1, "a", "b"), (2, "b", "a"), (3, "a", "b")]
    assert rows[0]["moves"][:4] == rows[1]["moves"][:4] == random_opening(4, 3, 0) and rows[0]["opening_plies"] == 4
    assert all(r["termination"] == "max plies" and r["plies"] == 12 and len(r["moves"]) == 16 for r in rows)
    assert match_report(games, "a").first()["pairs"] == 1
    assert {r["white"] for r in run_match(spark, ("a", first), ("a", first), 2, openings=["4k3/8/8/8/8/8/4P3/4K3 w - - 0 1"], most=2).collect()} == {"a#A", "a#B"}
    fools = iter(["f2f3", "e7e5", "g2g4", "d8h4"])
    step = lambda b: b.parse_uci(next(fools))
    assert play(step, step)[1:] == ("0-1", "checkmate")


def test_value_bins():
    got = value_bins(np.array([0.0, 0.5, 1.0]), 8)
    assert np.allclose(got.sum(axis=1), 1) and got[0].argmax() == 0 and got[2].argmax() == 7
    assert np.allclose(got[1], got[1][::-1])


def test_column_targets(spark):
    from pyspark.sql import functions as F

    from quern.functions.targets import value_targets
    from quern.operators import shaping as V

    df = spark.createDataFrame([(0.5,), (None,)], "p double").select(value_targets(F.col("p"), 4).alias("t"))
    rows = df.collect()
    assert abs(sum(rows[0]["t"]) - 1) < 1e-9 and rows[1]["t"] is None
    one = spark.range(1)
    scores = F.array(*[F.lit(float(x)) for x in (30, 10, -20, -70, -170)])
    got = one.select(V.policy_targets(scores)).first()[0]
    assert np.allclose(got, [0.490055, 0.306413, 0.151378, 0.047124, 0.005031], atol=1e-6)
    assert abs(one.select(V.expected(F.lit(100.0))).first()[0] - 0.591026) < 1e-6
    assert one.select(V.encode_score(F.lit(2.5), F.lit(None).cast("int")), V.encode_score(F.lit(None).cast("double"), F.lit(-3))).first()[:] == (2, -12497)
    assert one.select(V.centipawns(F.lit(0.0))).first()[0] == 0
    padded = one.select(V.old_policy_scores(F.lit(100.0), F.array(F.lit(3), F.lit(5), F.lit(-1)), F.array(F.lit(0.5), F.lit(0.25), F.lit(0.25)))).first()[0]
    assert padded[0] == 100 and abs(padded[1] - (100 + 400 * np.log(0.5))) < 1e-6 and padded[2] == 0


def test_stream_keeps_the_strongest(spark, tmp_path):
    from quern.streaming.dedup import merge_strongest

    merge = merge_strongest(str(tmp_path / "s"), ["k"], ["e"])
    a = spark.createDataFrame([(1, 5, "a"), (2, 1, "b")], "k int, e int, v string")
    b = spark.createDataFrame([(1, 3, "c"), (2, 9, "d")], "k int, e int, v string")
    merge(a, 0)
    merge(b, 1)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "s" / "version=1")).collect()}
    assert got == {(1, 5, "a"), (2, 9, "d")}
