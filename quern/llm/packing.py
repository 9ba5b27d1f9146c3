"""Best-fit packing of documents into fixed-length sequences by linear grouping.

Only lengths matter to a packing, and there are no more of them than the sequence
has tokens. So the plan is made from the histogram of lengths: of large pieces
by linear grouping (groups of equal cardinality, rounded up to their largest
member, a linear program over the configurations of these few sizes, actual
pieces in place of rounded ones), of the rest by best fit. The plan is a list of
runs: so many pieces of one length go to successive sequences at one offset.
Its size depends on the sequence length alone, so it is shipped to every task;
a piece finds its place from its rank among the pieces of its length. The ranks
come from counts per block of input, so neither a frequent length nor a frequent
source meets in one task.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, larger, prepare, released
from quern.llm.tokens import encoder
from quern.llm.words import spread

#: Groups of large pieces, the least share of a sequence that counts as large, and rounds of column generation without gain after which it ends.
GROUPS, LARGE, PATIENCE = 320, 0.4, 1000


def configurations(sizes: list[int], demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """A vertex of the configuration program: (how often each size, times), by column generation.

    Columns are exchanged until no configuration pays, or until PATIENCE of them
    in a row have not lowered the number of sequences, as at a degenerate vertex.
    """
    k = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    weight = np.array(sizes)
    reach = np.arange(capacity + 1)[None, :] - weight[:, None]
    ok = reach >= 0
    reach = np.where(ok, reach, 0)
    depth = capacity // min(sizes)
    fewest, idle = np.inf, 0
    while idle < PATIENCE:
        price = np.linalg.solve(basis.T, np.ones(k))
        best, picks = np.zeros(capacity + 1), []
        for _ in range(depth):
            worth = np.where(ok, best[reach] + price[:, None], -1.0)
            pick = worth.argmax(axis=0)
            better = worth[pick, np.arange(capacity + 1)]
            pick = np.where(better > best + 1e-12, pick, -1)
            best = np.maximum(best, better)
            picks.append(pick)
        if best[capacity] <= 1 + 1e-9:
            break
        column, left = np.zeros(k), capacity
        for pick in reversed(picks):
            if pick[left] >= 0:
                column[pick[left]] += 1
                left -= sizes[pick[left]]
        amount, way = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratio = np.where(way > 1e-9, np.maximum(amount, 0) / np.where(way > 1e-9, way, 1), np.inf)
        total = float(amount.sum())
        fewest, idle = (total, 0) if total < fewest - 1e-7 * max(1.0, total) else (fewest, idle + 1)
        basis[:, int(ratio.argmin())] = column
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, i].astype(int), float(amount[i])) for i in range(k)]


class Plan:
    """Runs (length, first rank, count, first sequence, offset) for a histogram of lengths."""

    def __init__(self, histogram: dict[int, int], capacity: int, groups: int = GROUPS, large: float = LARGE):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.left = dict(histogram)
        self.rank = dict.fromkeys(histogram, 0)
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}
        if n := self.left.pop(capacity, 0):
            self._take(capacity, n, self._new(n), 0, given=True)
        self._large(groups, max(1, int(large * capacity)))
        for length in sorted(self.left, reverse=True):
            self._best_fit(length, self.left[length])

    def _new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _take(self, length: int, n: int, first: int, offset: int, given: bool = False) -> None:
        self.runs.append((length, self.rank[length], n, first, offset))
        self.rank[length] += n
        if not given:
            self.left[length] -= n

    def _leave(self, gap: int, first: int, n: int) -> None:
        if gap > 0 and n:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((first, n))

    def _large(self, groups: int, least: int) -> None:
        lengths = sorted((x for x, n in self.left.items() if x > least and n), reverse=True)
        total = sum(self.left[x] for x in lengths)
        if not total:
            return
        per = -(-total // groups)
        grouped: list[list[list[int]]] = [[]]
        room = per
        for x in lengths:
            n = self.left[x]
            while n:
                if not room:
                    grouped.append([])
                    room = per
                put = min(n, room)
                grouped[-1].append([x, put])
                n, room = n - put, room - put
        merged: dict[int, list[list[int]]] = {}
        for g in grouped:
            merged.setdefault(g[0][0], []).extend(g)
        sizes = list(merged)
        stock = [merged[s][::-1] for s in sizes]
        demand = np.array([sum(n for _, n in g) for g in stock], dtype=float)
        for config, times in configurations(sizes, demand, self.capacity):
            times = int(times + 1e-6)
            if times > 0:
                self._substitute([g for g, n in enumerate(config) for _ in range(n)], stock, times)

    def _substitute(self, slots: list[int], stock: list[list[list[int]]], times: int) -> None:
        """Fill ``times`` sequences of one configuration with the longest actual pieces left of each group."""
        columns = []
        for g in slots:
            need, column = times, []
            while need and stock[g]:
                x, n = stock[g][-1]
                put = min(n, need)
                column.append((x, put))
                need -= put
                if put == n:
                    stock[g].pop()
                else:
                    stock[g][-1][1] -= put
            if need:
                column.append((0, need))
            columns.append(column)
        first = self._new(times)
        at = [[0, 0] for _ in columns]
        done = 0
        while done < times:
            here = [c[i][0] for c, (i, _) in zip(columns, at, strict=True)]
            n = min(c[i][1] - used for c, (i, used) in zip(columns, at, strict=True))
            offset = 0
            for x in here:
                if x:
                    self._take(x, n, first + done, offset)
                    offset += x
            self._leave(self.capacity - offset, first + done, n)
            for c, a in zip(columns, at, strict=True):
                a[1] += n
                if a[1] == c[a[0]][1]:
                    a[0], a[1] = a[0] + 1, 0
            done += n

    def _best_fit(self, length: int, n: int) -> None:
        while n:
            i = bisect_left(self.gaps, length)
            if i == len(self.gaps):
                per = self.capacity // length
                self._leave(self.capacity, self._new(-(-n // per)), -(-n // per))
                continue
            gap = self.gaps[i]
            first, bins = self.open[gap].pop()
            if not self.open[gap]:
                del self.open[gap]
                self.gaps.pop(i)
            offset, per = self.capacity - gap, gap // length
            whole = min(bins, n // per)
            for k in range(per if whole else 0):
                self._take(length, whole, first, offset + k * length)
            self._leave(gap - per * length, first, whole)
            n -= whole * per
            first, bins = first + whole, bins - whole
            if bins and n < per:
                for k in range(n):
                    self._take(length, 1, first, offset + k * length)
                if n:
                    self._leave(gap - n * length, first, 1)
                    first, bins, n = first + 1, bins - 1, 0
                self._leave(gap, first, bins)

    def lookup(self):
        """A function from arrays of lengths and ranks to arrays of sequences and offsets."""
        runs = np.array(sorted(self.runs), dtype=np.int64).reshape(-1, 5)
        keys = (runs[:, 0] << 48) + runs[:, 1]

        def place(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            run = runs[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            return run[:, 3] + rank - run[:, 1], run[:, 4]

        return place


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: all full but the first."""
    first = (n - 1) % capacity + 1
    return [first] + [capacity] * ((n - first) // capacity)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 2, digest=None, with_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, digest, block, local_rank and, if asked for, ids (little-endian binary); written once.

    ``digest`` maps an array of ids to a whole number.
    """
    prepare(docs.sparkSession)
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("digest", pa.int64()), ("block", pa.int32()), ("local_rank", pa.int64())]
    schema = pa.schema([*fields, ("ids", pa.binary())] if with_ids else fields)

    def cut_up(coder, batch: pa.RecordBatch, block: int, seen: np.ndarray) -> pa.RecordBatch:
        """The pieces of a batch; ``seen`` counts those of each length so far."""
        ids, ends = coder.arrays(batch.column(1))
        ids = np.insert(ids, ends, end_id)
        ends = ends + np.arange(1, len(ends) + 1)
        total = np.diff(np.concatenate([[0], ends]))
        head = (total - 1) % capacity + 1
        count = (total - head) // capacity + 1
        piece = spread(np.zeros(len(count)), count)
        length = np.where(piece == 0, np.repeat(head, count), capacity)
        start = np.where(piece == 0, 0, np.repeat(head, count) + (piece - 1) * capacity)
        at = np.repeat(ends - total, count) + start
        order = np.argsort(length, kind="stable")
        sizes = length[order]
        first = np.concatenate([[True], sizes[1:] != sizes[:-1]])
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) + seen[sizes]
        seen += np.bincount(length, minlength=capacity + 1)
        parts = [ids[a:b] for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
        columns = [batch.column(0).take(pa.array(np.repeat(np.arange(len(count)), count))), piece, start, length, [digest(x) for x in parts] if digest else [None] * len(parts), np.full(len(parts), block), rank]
        if with_ids:
            columns.append([x.tobytes() for x in parts])
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        with encoder(tokenizer_path) as coder:
            yield from (cut_up(coder, batch, block, seen) for batch in larger(batches))

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = "doc_id long, piece int, start long, length long, digest long, block int, local_rank long"
    return cut(docs.mapInArrow(released(split), kinds + ", ids binary" * with_ids), "pieces")


def place(parts: DataFrame, capacity: int) -> tuple[DataFrame, Plan]:
    """``parts`` without ids, with sequence_id and offset; and the plan. What reaches the driver is a count for each length."""
    counts = cut(parts.groupBy("block", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(histogram, capacity)
    find = plan.lookup()
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("block", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))

    @F.pandas_udf("sequence_id long, offset long")
    def where(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = find(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = parts.drop("ids").join(base, ["block", "length"]).withColumn("at", where("length", F.col("base") + F.col("local_rank")))
    return placed.select("doc_id", "piece", "start", "length", "digest", "at.sequence_id", "at.offset"), plan


def sequences(parts: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences; no more than one sequence meets in a group."""
    held = placed.join(parts.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    rows = held.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("rows"))
    return rows.select("sequence_id", F.aggregate("rows", F.lit(b""), lambda a, r: F.concat(a, r["ids"])).alias("ids"))
