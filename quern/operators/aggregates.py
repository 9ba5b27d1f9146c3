"""Counts, histograms, audits, match statistics and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators import ranking, shaping

#: Edges of the score histogram, Elo clip, z of the bound and its tail probability; fixed values.
SCORE_EDGES = [-12501, -600, -200, -50, 50, 200, 600, 12501]
ELO_CLIP, CONFIDENCE_Z, ALPHA = 1000.0, 1.959964, 0.05


def reason_counts(rows: DataFrame, gates: Sequence[tuple[str, Column]], passed: str = "accepted") -> DataFrame:
    """Rows by the first gate that they fail, in the order of ``gates``."""
    return rows.select(first_failed(gates, passed).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def first_failed(gates: Sequence[tuple[str, Column]], passed: str = "accepted") -> Column:
    """The name of the first gate whose condition isn't true."""
    reason = None
    for name, ok in gates:
        failed = ~F.coalesce(ok, F.lit(False))
        reason = F.when(failed, name) if reason is None else reason.when(failed, name)
    return F.lit(passed) if reason is None else reason.otherwise(passed)


def histogram(rows: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """A4: exact counts per value."""
    return rows.groupBy(value.alias(name)).agg(F.count("*").alias("n"))


def fixed_bins(rows: DataFrame, value: Column, edges: Sequence[float] = SCORE_EDGES) -> DataFrame:
    """A5: counts in half-open bins, the last closed; empty bins stay, values outside and nulls don't count."""
    last = len(edges) - 2
    place = F.when(value == edges[-1], last)
    for i in range(last, -1, -1):
        place = place.when((value >= edges[i]) & (value < edges[i + 1]), i)
    found = rows.select(place.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    bins = rows.sparkSession.range(last + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def elo_of(score: Column) -> Column:
    """The rating difference that a score means, within the clip."""
    s = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), score))
    return F.greatest(F.lit(-ELO_CLIP), F.least(F.lit(ELO_CLIP), -400 * F.log10(1 / s - 1)))


def match_summary(games: DataFrame, points: Column, plies: Column, group: Column, alpha: float = ALPHA) -> DataFrame:
    """Results, score, mean length and a bound on the score over opening groups.

    ``points`` is 1, 0.5 or 0. Games of a group aren't independent, so the radius
    follows the groups' squared weights: a first aggregation by group, then one
    row.
    """
    groups = games.groupBy(group.alias("__group")).agg(
        F.count("*").alias("n"),
        F.count_if(points == 1).alias("wins"),
        F.count_if(points == 0.5).alias("draws"),
        F.count_if(points == 0).alias("losses"),
        F.sum(points).alias("points"),
        F.sum(plies).alias("plies"),
    )
    total = groups.agg(
        F.sum("n").alias("games"),
        F.count("*").alias("groups"),
        F.sum("wins").alias("wins"),
        F.sum("draws").alias("draws"),
        F.sum("losses").alias("losses"),
        (F.sum("points") / F.sum("n")).alias("score"),
        (F.sum("plies") / F.sum("n")).alias("mean_plies"),
        (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("__weight"),
    )
    radius = F.sqrt(F.col("__weight") * F.log(F.lit(2 / alpha)) / 2)
    low, high = F.greatest(F.lit(0.0), F.col("score") - radius), F.least(F.lit(1.0), F.col("score") + radius)
    return total.withColumns({"elo": elo_of(F.col("score")), "score_low": low, "score_high": high, "elo_low": elo_of(low), "elo_high": elo_of(high)}).drop("__weight")


def likelihood_of_superiority(wins: Column, losses: Column) -> Column:
    """The normal estimate that the first side is the better one; a half without decisive games."""
    games = wins + losses
    return F.when(games == 0, 0.5).otherwise((shaping.erf((wins - losses) / F.sqrt(2.0 * F.greatest(games, F.lit(1)))) + 1) / 2)


def phase(ply: Column) -> Column:
    """Early, mid or endgame by ply."""
    return F.when(ply < 20, "early").when(ply < 60, "mid").otherwise("endgame")


def in_top(values: Column, label: Column, k: int) -> Column:
    """Whether fewer than ``k`` values are greater than the label's, or equal and before it."""
    own = F.element_at(values, (label + 1).cast("int"))
    above = F.size(F.filter(F.zip_with(values, F.sequence(F.lit(0), F.size(values) - 1), lambda v, i: (v > own) | ((v == own) & (i < label))), lambda ahead: ahead))
    return above < k


def topk_accuracy(rows: DataFrame, values: Column, label: Column, group: Column) -> DataFrame:
    """Top-1 and top-5 accuracy per phase and, as phase null, over all."""
    marked = rows.select(group.alias("phase"), in_top(values, label, 1).cast("double").alias("one"), in_top(values, label, 5).cast("double").alias("five"))
    return marked.rollup("phase").agg(F.count("*").alias("n"), F.avg("one").alias("top1"), F.avg("five").alias("top5"))


def mean_of_batch_means(rows: DataFrame, batch: Column, value: Column) -> DataFrame:
    """The mean of batches' means, in which a short batch weighs as much as a full one, beside the mean of rows."""
    per = rows.groupBy(batch.alias("__batch")).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), F.count(value).alias("n"))
    return per.agg(F.avg("mean").alias("batch_mean"), (F.sum("total") / F.sum("n")).alias("row_mean"), F.count("*").alias("batches"))


def moving_average(values: Column, most: float = 0.999) -> Column:
    """An exponential mean of a short series whose decay warms up as (1 + t) / (10 + t)."""
    found = folded_average(values, F.lit(0), most)
    return found["b"]


def folded_average(values: Column, before: Column, most: float = 0.999) -> Column:
    """What a stretch of a series, with so many values ``before`` it, makes of a mean m: a * m + b."""
    start = F.struct(before.cast("long").alias("t"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))

    def fold(acc: Column, x: Column) -> Column:
        t = acc["t"] + 1
        decay = F.when(t == 1, 0.0).otherwise(F.least(F.lit(most), (1.0 + t) / (10.0 + t)))
        return F.struct(t.alias("t"), (acc["a"] * decay).alias("a"), (acc["b"] * decay + (1 - decay) * x.cast("double")).alias("b"))

    return F.aggregate(values, start, fold)


def moving_averages(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "mean", most: float = 0.999) -> DataFrame:
    """A17 for series of any length: keys and the mean after the last value.

    A series lies in consecutive parts; each part is folded to a line in the mean
    before it, and a key's lines, one for each part, are applied in turn.
    """
    placed = ranking.runs(rows.select(*keys, *order, value), keys, order)
    parts = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda r: r[value]).alias("__values"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = parts.withColumn("__before", before).withColumn("__line", folded_average(F.col("__values"), F.col("__before"), most))
    held = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__part", F.col("__line.a").alias("a"), F.col("__line.b").alias("b")))).alias("__lines"))
    return held.select(*keys, F.aggregate("__lines", F.lit(0.0), lambda m, line: m * line["a"] + line["b"]).alias(name))
