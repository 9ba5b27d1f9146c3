"""Near-duplicate vectors by counting collisions of sorted one-dimensional projections.

Vectors that lie close together stand for one another first. A vector takes as its
leader the least vector it hears of within half the threshold's angle, over some
rounds in which it meets those that share the signs of some projections with it.
Whatever has one leader is within the threshold of each other, so such pairs are
counted and never spelled out; a group of copies of any size is one row.

Each of many lists then sorts these classes by a random projection, within cells
told by the signs of a few others; the number of signs follows the number of
vectors, so that a cell holds some tens of unrelated vectors at any size. A class
spans the places of its members in a list and cell, and collides there with those
whose span comes within a window of its own. The collisions of each pair of
classes are counted over all lists, and pairs with ``least`` of them are verified
in double precision: by their leaders' angle and their radii where that settles
all of their members, else member by member.

The number of lists is calibrated for recall: a pair at the threshold collides in
a list with a probability that follows from its angle, the signs and the window,
and there are as many lists as make ``least`` collisions probable enough.

Equal vectors are one node with a multiplicity, so copies cost a row each. Null,
zero and non-finite vectors link with nothing. Vectors of different lengths do
not link. Rows that repeat an id count as vectors of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import components, cut, discard, partitions, prepare, released

COSINE, RECALL, LEAST, CELL = 0.9, 0.995, 2, 16
#: Half the width of a window, in standard deviations of a threshold pair's difference.
WINDOW = 2.0
#: Pairs that a task holds before it passes them on.
BLOCK = 200_000
#: Rounds in which vectors look for a leader, and signs beyond those that tell all vectors apart.
ROUNDS, MORE_SIGNS = 6, 3
#: Angles nearer to a bound than this are settled member by member.
MARGIN = 1e-6


def calibrate(n: int, cosine: float = COSINE, recall: float = RECALL, least: int = LEAST, cell: int = CELL) -> tuple[int, int, float]:
    """(signs, lists, half a window) for ``n`` vectors."""
    signs = max(1, math.ceil(math.log2(max(2, n / cell))))
    same = 1 - math.acos(cosine) / math.pi
    p = same**signs * math.erf(WINDOW / math.sqrt(2))
    lists, miss = least, 1.0
    while miss > 1 - recall:
        lists += 1
        miss = sum(math.comb(lists, k) * p**k * (1 - p) ** (lists - k) for k in range(least))
    return signs, lists, WINDOW * math.sqrt(2 - 2 * cosine)


def distinct_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(vec_id, key of each row; rep, times, unit of each distinct usable vector). A key is a 128-bit hash."""
    prepare(vectors.sparkSession)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = v.isNotNull() & (F.size(v) > 0) & ~bad & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b"))))
    rows = cut(rows.select("vec_id", F.col("key.a").alias("a"), F.col("key.b").alias("b"), F.when(F.col("key").isNotNull(), v).alias("v")), "vectors")
    nodes = rows.where("a is not null").groupBy("a", "b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"), F.first("v").alias("v"))
    top = F.array_max(F.transform("v", F.abs))
    scaled = F.transform("v", lambda x: x / F.col("top"))
    norm = F.sqrt(F.aggregate("s", F.lit(0.0), lambda s, x: s + x * x))
    nodes = nodes.withColumn("top", top).withColumn("s", scaled).withColumn("norm", norm)
    nodes = nodes.select("a", "b", "rep", "times", F.transform("s", lambda x: x / F.col("norm")).alias("unit"))
    return rows.select("vec_id", "a", "b"), cut(nodes, "nodes")


def _dot(u, w):
    @F.pandas_udf("double")
    def dot(u: pd.Series, w: pd.Series) -> pd.Series:
        return pd.Series([float(a @ b) if len(a) == len(b) else -1.0 for a, b in zip(u, w, strict=True)], dtype="float64")

    return dot(u, w)


def leaders(nodes: DataFrame, cosine: float = COSINE, seed: int = 11) -> DataFrame:
    """rep, leader, angle, times, unit of every node: the least node it met within half the threshold's angle, itself included; written once."""
    signs = max(1, math.ceil(math.log2(max(2, nodes.count())))) + MORE_SIGNS
    reach = math.cos(math.acos(cosine) / 2 - MARGIN)
    made: dict[int, np.ndarray] = {}

    @F.pandas_udf("array<long>")
    def marks(units: pd.Series) -> pd.Series:
        weights, out = 1 << np.arange(signs, dtype=np.int64), []
        for unit in units:
            size = len(unit)
            if size not in made:
                made[size] = np.random.default_rng([seed, size]).standard_normal((size, ROUNDS * signs))
            out.append(((unit @ made[size]).reshape(ROUNDS, signs) > 0) @ weights + (size << 40))
        return pd.Series(out)

    units = nodes.select("rep", "unit")
    places = cut(nodes.select("rep", marks("unit").alias("marks")), "marks")
    held = places.select("rep", F.col("rep").alias("leader"), F.lit(1.0).alias("cosine"))
    old: list[DataFrame] = []
    for r in range(ROUNDS):
        here = cut(held.join(places.select("rep", F.element_at("marks", r + 1).alias("mark")), "rep"), "here")
        heard = cut(here.groupBy("mark").agg(F.min("leader").alias("heard"), F.count("*").alias("n")).where("n > 1").select("mark", "heard"), "heard")
        asked = here.join(heard, "mark").where("heard < leader").select("rep", "heard")
        tested = asked.join(units.select("rep", F.col("unit").alias("u")), "rep").join(units.select(F.col("rep").alias("heard"), F.col("unit").alias("w")), "heard")
        taken = cut(tested.select("rep", "heard", _dot("u", "w").alias("near")).where(F.col("near") >= reach), "taken")
        held = cut(here.drop("mark").join(taken, "rep", "left").select("rep", F.coalesce("heard", "leader").alias("leader"), F.coalesce("near", "cosine").alias("cosine")), "leaders")
        discard(here, heard, taken, *old)
        old = [held]
    angle = F.when(F.col("rep") == F.col("leader"), 0.0).otherwise(F.acos(F.least(F.lit(1.0), F.col("cosine"))))
    out = cut(held.withColumn("angle", angle).drop("cosine").join(nodes.select("rep", "times", "unit"), "rep"), "members")
    discard(places, *old)
    return out


def candidates(members: DataFrame, cosine: float = COSINE, seed: int = 7) -> DataFrame:
    """src < dst: pairs of leaders whose classes collide often enough."""
    signs, lists, half = calibrate(members.count(), cosine)
    made: dict[int, np.ndarray] = {}

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = 1 << np.arange(signs, dtype=np.int64)
        for frame in frames:
            for size, group in frame.groupby(frame["unit"].map(len)):
                if size not in made:
                    made[size] = np.random.default_rng([seed, size]).standard_normal((size, lists * (signs + 1)))
                values = (np.stack(group["unit"].to_numpy()) @ made[size]).reshape(len(group), lists, signs + 1)
                cell = (values[:, :, 1:] > 0) @ weights
                yield pd.DataFrame({"list": np.tile(np.arange(lists), len(group)) + (int(size) << 16), "cell": cell.ravel(), "place": values[:, :, 0].ravel(), "leader": np.repeat(group["leader"].to_numpy(np.int64), lists)})

    def collide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            rows = frame if held is None else pd.concat([held, frame], ignore_index=True)
            yield from _windows(rows, half, 0 if held is None else len(held))
            # Of the last cell, what later rows may still reach is carried on.
            last = rows.iloc[-1] if len(rows) else None
            held = None if last is None else rows[(rows["list"] == last["list"]) & (rows["cell"] == last["cell"]) & (rows["high"] + half >= last["low"])]

    n = partitions(members.sparkSession)
    placed = members.select("leader", "unit").mapInPandas(released(project), "list int, cell long, place double, leader long")
    spans = placed.groupBy("list", "cell", "leader").agg(F.min("place").alias("low"), F.max("place").alias("high"))
    spans = spans.repartition(n, "list", "cell").sortWithinPartitions("list", "cell", "low", "leader")
    met = spans.select("list", "cell", "low", "high", "leader").mapInPandas(released(collide), "src long, dst long")
    return met.groupBy("src", "dst").agg(F.count("*").alias("met")).where(F.col("met") >= LEAST).select("src", "dst")


def _windows(rows: pd.DataFrame, half: float, known: int) -> Iterator[pd.DataFrame]:
    """The pairs of sorted spans that share a list, a cell and a window, less those of the first ``known`` rows with one another."""
    if not len(rows):
        return
    group = rows.groupby(["list", "cell"], sort=False).ngroup().to_numpy()
    low, high, leader = rows["low"].to_numpy(), rows["high"].to_numpy(), rows["leader"].to_numpy()
    # Cells lie so far apart on one axis that no window spans two.
    apart = group * (2 * half + 4 * max(np.abs(low).max(), np.abs(high).max()) + 1)
    end = np.searchsorted(low + apart, high + apart + half, side="right")
    first = np.maximum(np.arange(len(low)) + 1, known)
    reach = np.maximum(end - first, 0)
    total, begin = np.cumsum(reach), 0
    while begin < len(low):
        done = int(total[begin - 1]) if begin else 0
        stop = max(begin + 1, int(np.searchsorted(total, done + BLOCK, "right")))
        count = reach[begin:stop]
        left = np.repeat(np.arange(begin, stop), count)
        right = np.repeat(first[begin:stop], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        a, b = leader[left], leader[right]
        if len(a):
            yield pd.DataFrame({"src": np.minimum(a, b), "dst": np.maximum(a, b)})
        begin = stop


def links(members: DataFrame, cosine: float = COSINE) -> tuple[DataFrame, DataFrame]:
    """(src, dst: pairs of leaders whose classes link as a whole; src, dst: links of members of other pairs, each once); written."""
    pairs = cut(candidates(members, cosine), "candidates")
    classes = cut(members.groupBy("leader").agg(F.max("angle").alias("radius"), F.count("*").alias("size")), "classes")
    unit = members.select("rep", "unit")
    both = pairs.join(unit.select(F.col("rep").alias("src"), F.col("unit").alias("u")), "src").join(unit.select(F.col("rep").alias("dst"), F.col("unit").alias("w")), "dst")
    near = both.select("src", "dst", _dot("u", "w").alias("cosine"))
    for side in ("src", "dst"):
        near = near.join(classes.select(F.col("leader").alias(side), F.col("radius").alias(f"{side}_radius"), F.col("size").alias(f"{side}_size")), side)
    angle, spare, most = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine"))), F.col("src_radius") + F.col("dst_radius"), math.acos(cosine)
    alone = spare == 0
    whole = F.when(alone, F.col("cosine") >= cosine).otherwise(angle + spare <= most - MARGIN)
    part = ~alone & (angle + spare > most - MARGIN) & (angle - spare <= most + MARGIN)
    near = cut(near.select("src", "dst", whole.alias("whole"), part.alias("part")).where("whole or part"), "near")
    of = members.select("rep", "leader", "unit")
    rows = near.where("part").join(of.select(F.col("leader").alias("src"), F.col("rep").alias("x"), F.col("unit").alias("u")), "src").join(of.select(F.col("leader").alias("dst"), F.col("rep").alias("y"), F.col("unit").alias("w")), "dst")
    single = cut(rows.select("x", "y", _dot("u", "w").alias("cosine")).where(F.col("cosine") >= cosine).select(F.col("x").alias("src"), F.col("y").alias("dst")), "links")
    whole = cut(near.where("whole").select("src", "dst"), "whole")
    discard(pairs, classes, near)
    return whole, single


def _both(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").union(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows, nodes = distinct_vectors(vectors, id_col, vector_col)
    members = leaders(nodes, cosine)
    whole, single = links(members, cosine)
    own = members.select("rep", "leader", "times")
    classes = cut(own.groupBy("leader").agg(F.sum("times").alias("n"), F.min("rep").alias("least")), "classes")
    beside = _both(whole).join(classes.select(F.col("leader").alias("dst"), "n"), "dst").groupBy(F.col("src").alias("leader")).agg(F.sum("n").alias("beside"))
    others = _both(single).join(own.select(F.col("rep").alias("dst"), "times"), "dst").groupBy(F.col("src").alias("rep")).agg(F.sum("times").alias("others"))
    star = own.join(classes, "leader").select(F.col("rep").alias("src"), F.col("least").alias("dst"))
    least = classes.select("leader", "least")
    bridge = whole.join(least.select(F.col("leader").alias("src"), F.col("least").alias("s")), "src").join(least.select(F.col("leader").alias("dst"), F.col("least").alias("d")), "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    group = components(star.union(bridge).union(single)).withColumnRenamed("node", "rep")
    found = nodes.select("a", "b", "rep").join(own, "rep").join(classes.select("leader", "n"), "leader").join(cut(beside, "beside"), "leader", "left").join(cut(others, "others"), "rep", "left").join(group, "rep", "left")
    n_links = F.col("n") - 1 + F.coalesce("beside", F.lit(0)) + F.coalesce("others", F.lit(0))
    found = cut(found.select("a", "b", n_links.alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "classes")
    discard(members, whole, single, classes)
    linked = rows.where("a is not null").join(found, ["a", "b"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("a is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
