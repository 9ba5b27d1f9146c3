"""Scores, targets and losses as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the score scale, the targets, and the older targets.
MATE, HORIZON, CLAMP, SLOPE = 12000, 500, 11999, 0.00368208
TEMPERATURE, TIE_BREAK, SIGMA = 0.04, 2000.0, 0.75
OLD_VALUE, OLD_WDL, OLD_DRAW, OLD_TEMPERATURE = 400.0, 380.0, 100.0, 1.0


def encode_score(cp: Column, mate: Column) -> Column:
    """One whole number for both kinds of score; half-even rounding, nearer mates beyond farther ones."""
    far = MATE + HORIZON - F.least(F.abs(mate), F.lit(HORIZON - 1))
    return F.when(mate.isNotNull(), F.signum(mate).cast("int") * far).otherwise(F.greatest(F.lit(-CLAMP), F.least(F.lit(CLAMP), F.bround(cp)))).cast("int")


def to_move(score: Column, turn: Column) -> Column:
    """A score for White as one for the side to move."""
    return F.when(turn == "b", -score).otherwise(score)


def expected(score: Column, slope: float = SLOPE) -> Column:
    """The logistic expected score, in the branch that doesn't overflow."""
    small = F.exp(-F.abs(score * slope))
    return F.when(score >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def score_of(value: Column, slope: float = SLOPE) -> Column:
    """The score of an expected score, clamped to finite scores."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), value))
    return F.greatest(F.lit(-float(CLAMP)), F.least(F.lit(float(CLAMP)), F.log(p / (1 - p)) / slope))


def centipawns(value: Column, slope: float = SLOPE) -> Column:
    """A value in [-1, 1] as whole centipawns, rounded half to even."""
    return F.bround(score_of((value + 1) / 2, slope)).cast("int")


def result_value(result: Column, turn: Column) -> Column:
    """1, 0 or -1 for the side to move."""
    white = F.when(result == "1-0", 1.0).when(result == "0-1", -1.0).when(result == "1/2-1/2", 0.0)
    return F.when(turn == "b", -white).otherwise(white) + 0.0


def bar(cp: Column) -> Column:
    """The evaluation bar's share."""
    return 1 / (1 + F.pow(F.lit(10.0), -cp / 400))


def graph(cp: Column) -> Column:
    """The evaluation graph's height."""
    return F.tanh(cp / 350)


def learning_rate(step: Column, total: int, warmup: int, floor: float = 0.05) -> Column:
    """The share of the peak rate: linear up to ``warmup``, a cosine down to ``floor`` after."""
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(max(1, total - warmup)))
    down = floor + (1 - floor) * 0.5 * (1 + F.cos(math.pi * done))
    return F.when(step < warmup, (step + 1) / F.lit(max(1, warmup))).otherwise(down)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def softmax(values: Column) -> Column:
    """Shares of exponentials, from the greatest down; an empty array stays empty."""
    raw = let(F.array_max(values), lambda top: F.transform(values, lambda v: F.exp(v - top)))
    return shares_of(raw)


def shares_of(weights: Column) -> Column:
    """Weights divided by their sum; zeros where the sum is zero."""
    return let(weights, lambda w: let(total(w), lambda t: F.transform(w, lambda x: F.when(t > 0, x / t).otherwise(0.0))))


def policy_targets(scores: Column, temperature: float = TEMPERATURE) -> Column:
    """V1: soft targets of scored moves; null scores, which pad, get nothing."""
    raw = F.transform(scores, lambda s: expected(s) / temperature + s / TIE_BREAK)
    weight = let(raw, lambda r: let(F.array_max(r), lambda top: F.transform(r, lambda v: F.coalesce(F.exp(v - top), F.lit(0.0)))))
    return shares_of(weight)


def erf(x: Column, terms: int = 200) -> Column:
    """The error function by its series of positive terms, x times the products of 2 x x / (2 k + 1); beyond 6 it is 1 in double precision."""
    z = F.greatest(F.lit(-6.0), F.least(F.lit(6.0), x.cast("double")))

    def series(z: Column) -> Column:
        start = F.struct(z.alias("term"), z.alias("sum"))

        def step(acc: Column, k: Column) -> Column:
            term = acc["term"] * 2 * z * z / (2 * k + 1)
            return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(terms)), start, step, lambda acc: acc["sum"]) * F.exp(-z * z) * (2 / math.sqrt(math.pi))

    return let(z, series)


def value_of_bins(shares: Column) -> Column:
    """V3: the value in [-1, 1] of shares over even bins of the expected score."""
    middles = let(shares, lambda s: F.transform(s, lambda p, i: p * (i + 0.5) / F.size(s)))
    return 2 * total(middles) - 1


def log_sum_exp(values: Column) -> Column:
    return let(F.array_max(values), lambda top: top + F.log(total(F.transform(values, lambda v: F.exp(v - top)))))


def cross_entropy(values: Column, places: Column, targets: Column) -> Column:
    """V4: minus the targets' sum of log-softmax at their places; negative places pad."""
    def terms(whole: Column) -> Column:
        return F.zip_with(places, targets, lambda i, t: F.when(i >= 0, t * (F.try_element_at(values, (i + 1).cast("int")) - whole)).otherwise(0.0))

    return -total(let(log_sum_exp(values), terms))


def entropy(shares: Column) -> Column:
    """In nats; nothing is 0 log 0."""
    return -total(F.transform(shares, lambda p: F.when(p > 0, p * F.log(p)).otherwise(0.0)))


def categorical_loss(values: Column, target: Column) -> Column:
    """V5: cross-entropy of a whole target distribution."""
    return -total(let(log_sum_exp(values), lambda whole: F.zip_with(values, target, lambda v, t: t * (v - whole))))


def old_score(win: Column, loss: Column) -> Column:
    """V6: the score behind older win and loss shares; a saturated share is a mate."""
    w = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-7), win.cast("double")))
    inner = F.greatest(F.lit(-float(CLAMP)), F.least(F.lit(float(CLAMP)), OLD_DRAW + OLD_WDL * F.log(w / (1 - w))))
    full = 1.0 - 1e-7
    return F.when(loss >= full, -float(MATE)).when(win >= full, float(MATE)).otherwise(inner)


def old_policy_scores(score: Column, places: Column, shares: Column) -> Column:
    """V6: scores of moves from their older shares, the best at the position's score; negative places pad."""
    safe = F.zip_with(places, shares, lambda i, p: F.when(i >= 0, F.greatest(p.cast("double"), F.lit(1e-300))))
    limit = F.when(F.abs(score) >= MATE, float(MATE + HORIZON)).otherwise(float(CLAMP))

    def scores(top: Column) -> Column:
        return F.transform(safe, lambda p: F.when(p.isNull(), 0.0).otherwise(F.greatest(-limit, F.least(limit, score + OLD_VALUE * OLD_TEMPERATURE * F.log(p / top)))))

    return let(F.coalesce(F.array_max(safe), F.lit(1.0)), scores)


def visit_policy(visits: Column, temperature: float) -> Column:
    """V7: shares of visits to the power 1/T; one-hot on the first greatest for T <= 0."""
    if temperature <= 0:
        best = F.array_position(visits, F.array_max(visits)).cast("int")
        return F.transform(visits, lambda v, i: F.when(i + 1 == best, 1.0).otherwise(0.0))
    return shares_of(let(F.array_max(visits), lambda top: F.transform(visits, lambda v: F.pow(v / top, F.lit(1 / temperature)))))


def puct_scores(priors: Column, visits: Column, sums: Column, c: float = 1.5, fpu: float = 0.3) -> Column:
    """M1: value plus exploration of each move; unvisited ones take the mean value less ``fpu``."""
    rows = F.arrays_zip(priors.alias("p"), visits.alias("n"), sums.alias("w"))

    def score(all_: Column) -> Column:
        n, w = all_["n"], all_["w"]
        unvisited = F.when(n > 0, w / n - fpu).otherwise(-fpu)
        return F.transform(rows, lambda r: F.when(r["n"] > 0, r["w"] / r["n"]).otherwise(unvisited) + c * F.sqrt(n + 1) * r["p"] / (1 + r["n"]))

    return let(F.struct(total(visits).alias("n"), total(sums).alias("w")), score)
