"""Benchmark decontamination by suffix arrays over shards of the training texts.

The documents are cut into shards of about ``SHARD_WORDS`` words. A shard holds its
vocabulary, its words as numbers of that, and its suffixes sorted by their first
``DEPTH`` words; shards are written once and serve any benchmark. A benchmark is
cut into blocks of bounded size, written as files that tasks read, so neither its
texts nor anything else that grows passes through the driver. Every test suffix is
searched for by bisection in every shard: the training suffixes that share its
first ``width`` words lie together, those that also share the word before are
within a longer match, and the others are compared on to the longest verbatim
match. Nothing is shuffled but what a caller joins, and a passage that many
documents hold costs only its occurrences, looked at ``PAIRS`` at a time.

Words are maximal runs of ASCII letters and digits and of all characters from
U+0080 on, with A-Z lowered, and are told apart by 64-bit codes. A window is
``width`` consecutive words of an item, or a whole item of fewer. Null and empty
texts have no words. Repeated rows are judged alike; items that repeat each count.
Items without an id are searched for as well and together are one item, null. A
document or item beyond the size of a shard or block is one of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, discard, filesystem, prepare, put_file, released, remove, work_dir
from quern.llm.words import LETTERS, coded, spread

#: Words of a window, and by how many a shard's suffixes are sorted.
WIDTH, DEPTH = 10, 16
#: Words of a shard and of a block of the benchmark, and pairs of a test and a training suffix looked at together.
SHARD_WORDS, BLOCK_WORDS, PAIRS = 1 << 18, 1 << 20, 1 << 20
FOUND = "n_words long, n_hit long, items array<string>, matches array<struct<item:string,doc_start:int,item_start:int,length:int>>, hits array<int>"
_MATCH = pa.struct([("item", pa.string()), ("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())])
_ROW = pa.schema([("id", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", pa.list_(_MATCH)), ("hits", pa.list_(pa.int32()))])
_SHARD = pa.schema([("ids", pa.list_(pa.string())), ("a", pa.binary()), ("b", pa.binary()), ("sizes", pa.binary()), ("vocabulary", pa.binary()), ("words", pa.binary()), ("suffixes", pa.binary())])


def _order(name: str | None) -> tuple[bool, str]:
    """Items without a name come first."""
    return name is not None, name or ""


class SuffixArray:
    """The suffixes of ``codes`` that begin with a positive number, sorted up to ``depth`` numbers."""

    def __init__(self, codes: np.ndarray, depth: int):
        n = len(codes)
        self.codes = np.concatenate([codes, np.zeros(depth + 1, codes.dtype)]).astype(np.int64)
        order = np.flatnonzero(codes)
        span = int(codes.max(initial=0)) + 1
        step = max(1, 62 // max(1, span.bit_length()))
        keys = np.zeros(len(order), np.int64)
        for k in range(min(step, depth)):
            keys = keys * span + self.codes[order + k]
        h = min(step, depth)
        sort = np.argsort(keys, kind="stable")
        order, keys = order[sort], keys[sort]
        first = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(order)]
        rank = np.zeros(n + depth + 1, np.int64)
        start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        rank[order] = start + 1
        while h < depth:
            size = np.diff(np.append(np.flatnonzero(first), len(order)))
            tied = np.repeat(size > 1, size)
            tied &= self.codes[np.minimum(order + h - 1, n + depth)] > 0
            at = np.flatnonzero(tied)
            if not len(at):
                break
            group, further = start[at], rank[np.minimum(order[at] + h, n + depth)]
            sort = np.lexsort((further, group))
            order[at] = order[at][sort]
            group, further = group[sort], further[sort]
            fresh = np.concatenate([[True], (group[1:] != group[:-1]) | (further[1:] != further[:-1])])
            first[at] |= fresh
            start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
            rank[order[at]] = start[at] + 1
            h *= 2
        self.order = order

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each row of ``patterns``."""
        found = []
        for high in (False, True):
            lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.order))
            while (going := lo < hi).any():
                mid = (lo + hi) >> 1
                at = self.order[np.minimum(mid, len(self.order) - 1)]
                there = self.codes[at[:, None] + np.arange(patterns.shape[1])]
                differ = there != patterns
                place = differ.argmax(axis=1)
                rows = np.arange(len(patterns))
                less = differ[rows, place] & (there[rows, place] < patterns[rows, place])
                if high:
                    less |= ~differ[rows, place]
                lo = np.where(going & less, mid + 1, lo)
                hi = np.where(going & ~less, mid, hi)
            found.append(lo)
        return found[0], found[1]


class Shard:
    """Texts of a shard: ``words`` are numbers from 1 of the sorted ``vocabulary``, a 0 after each text; ``suffixes`` are places of words, sorted."""

    def __init__(self, sizes: np.ndarray, vocabulary: np.ndarray, words: np.ndarray, suffixes: np.ndarray):
        self.sizes, self.vocabulary = sizes, vocabulary
        self.starts = np.cumsum(sizes + 1) - sizes - 1
        self.array = SuffixArray.__new__(SuffixArray)
        self.array.codes = np.concatenate([words, np.zeros(DEPTH + 1, np.int64)])
        self.array.order = suffixes

    @classmethod
    def of(cls, codes: np.ndarray, ends: np.ndarray) -> Shard:
        sizes = np.diff(np.concatenate([[0], ends]))
        vocabulary, number = np.unique(codes, return_inverse=True)
        words = np.zeros(len(codes) + len(ends), np.int64)
        words[np.arange(len(codes)) + np.repeat(np.arange(len(ends)), sizes)] = number + 1
        return cls(sizes, vocabulary, words, SuffixArray(words, DEPTH).order)

    def numbers(self, codes: np.ndarray) -> np.ndarray:
        """The shard's numbers of words given by code; 0 for those it hasn't."""
        if not len(self.vocabulary):
            return np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, codes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == codes, at + 1, 0)


class Block:
    """Items of a benchmark: their words' codes one after another, where each ends, and their names."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray, names: list[str | None]):
        self.codes, self.ends, self.names = codes, ends, names
        self.begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)

    def suffixes(self, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, starts, items) of the windows: of ``width`` words, then of each lesser number that is a whole item."""
        sizes = self.ends - self.begins
        count = np.maximum(sizes - width + 1, 0)
        yield width, spread(self.begins, count), np.repeat(np.arange(len(sizes)), count)
        for n in np.unique(sizes[(sizes > 0) & (sizes < width)]).tolist():
            items = np.flatnonzero(sizes == n)
            yield n, self.begins[items], items

    def to_bytes(self) -> bytes:
        sink = pa.BufferOutputStream()
        row = pa.record_batch({"codes": [self.codes.astype("<u8").tobytes()], "ends": [self.ends.astype("<i8").tobytes()], "names": pa.array([self.names], pa.list_(pa.string()))})
        with pa.ipc.new_stream(sink, row.schema) as out:
            out.write_batch(row)
        return sink.getvalue().to_pybytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Block:
        row = pa.ipc.open_stream(data).read_all().to_pylist()[0]
        return cls(np.frombuffer(row["codes"], "<u8"), np.frombuffer(row["ends"], "<i8"), row["names"])


def matches(shard: Shard, block: Block, width: int = WIDTH) -> np.ndarray:
    """Rows (text, item, first word in the text, first word in the item, words) of the longest verbatim matches that hold a window."""
    test, words = shard.numbers(block.codes), shard.array.codes
    gaps = np.concatenate([[0], np.cumsum(test == 0)])
    out = [np.zeros((0, 5), np.int64)]
    for n, starts, items in block.suffixes(width):
        there = gaps[starts + n] == gaps[starts]
        starts, items = starts[there], items[there]
        if not len(starts) or not len(shard.array.order):
            continue
        low, high = shard.array.find(test[starts[:, None] + np.arange(n)])
        total = np.cumsum(high - low)
        begin = 0
        while begin < len(starts):
            done = int(total[begin - 1]) if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, done + PAIRS, "right")))
            count = (high - low)[begin:end]
            for first in range(0, max(1, int(count.max(initial=0))), PAIRS):
                # A suffix of more occurrences than that is taken in parts.
                some = np.clip(count - first, 0, PAIRS)
                i = np.repeat(starts[begin:end], some)
                item = np.repeat(items[begin:end], some)
                p = shard.array.order[spread(low[begin:end] + first, some)]
                if n == width:
                    inner = (i > block.begins[item]) & (p > 0)
                    before = np.where(inner, test[i - 1], 0)
                    new = (before == 0) | (before != words[p - 1])
                    i, item, p = i[new], item[new], p[new]
                length = np.full(len(i), n)
                going = np.arange(len(i)) if n == width else np.zeros(0, np.int64)
                while len(going):
                    step = np.arange(DEPTH)
                    at = i[going, None] + length[going, None] + step
                    inside = at < block.ends[item[going]][:, None]
                    own = np.where(inside, test[np.minimum(at, len(test) - 1)], 0)
                    there = words[np.minimum(p[going, None] + length[going, None] + step, len(words) - 1)]
                    same = (own > 0) & (own == there)
                    run = np.where(same.all(axis=1), DEPTH, same.argmin(axis=1))
                    length[going] += run
                    going = going[run == DEPTH]
                text = np.searchsorted(shard.starts, p, side="right") - 1
                out.append(np.column_stack([text, item, p - shard.starts[text], i - block.begins[item], length]))
            begin = end
    return np.concatenate(out)


def found_in(shard: Shard, blocks: Iterator[Block], width: int = WIDTH) -> list[tuple]:
    """(n_words, n_hit, items, matches, hits) of each text of a shard."""
    edge = np.zeros(int((shard.sizes + 1).sum()) + 1, np.int64)
    of: dict[int, list[tuple]] = {}
    for block in blocks:
        rows = matches(shard, block, width)
        at = shard.starts[rows[:, 0]] + rows[:, 2]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + rows[:, 4], -1)
        for text, item, start, place, n in rows.tolist():
            of.setdefault(text, []).append((block.names[item], start, place, n))
    hit = np.cumsum(edge) > 0
    out = []
    for text, (at, size) in enumerate(zip(shard.starts.tolist(), shard.sizes.tolist(), strict=True)):
        own = of.get(text, [])
        spots = np.flatnonzero(hit[at : at + size]).tolist() if own else []
        out.append((size, len(spots), sorted({m[0] for m in own}, key=_order), sorted(own, key=lambda m: (_order(m[0]), m[1:])), spots))
    return out


def _keyed(docs: DataFrame, id_col: str | None, text_col: str) -> tuple:
    """Two hashes that tell rows apart by id and text."""
    own = [F.col(id_col).cast("string")] if id_col else []
    text = F.col(text_col).cast("string")
    return F.xxhash64(*own, text), F.xxhash64(F.lit(1), *own, text)


def index(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text") -> DataFrame:
    """The written shards of ``docs``: a row each, with the ids and keys of their texts."""
    prepare(docs.sparkSession)
    a, b = _keyed(docs, id_col, text_col)
    rows = docs.select((F.col(id_col) if id_col else F.lit(None)).cast("string").alias("id"), a.alias("a"), b.alias("b"), F.col(text_col).cast("string").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def close() -> pa.RecordBatch:
            ids, a, b, codes, sizes = zip(*held, strict=True)
            made = Shard.of(np.concatenate(codes), np.cumsum(np.concatenate(sizes)))
            arrays = [np.concatenate(a), np.concatenate(b), made.sizes, made.vocabulary, made.array.codes[: -DEPTH - 1].astype("<i4"), made.array.order.astype("<i4")]
            return pa.RecordBatch.from_arrays([pa.array([sum(ids, [])], pa.list_(pa.string())), *[pa.array([x.tobytes()], pa.binary()) for x in arrays]], schema=_SHARD)

        size = 0
        for batch in batches:
            codes, ends = coded(batch.column(3), LETTERS)
            names, a, b = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            begin = done = 0
            while begin < len(names):
                stop = max(begin + 1, int(np.searchsorted(ends, done + SHARD_WORDS - size, "right")))
                end = int(ends[stop - 1])
                held.append((names[begin:stop], a[begin:stop], b[begin:stop], codes[done:end], np.diff(np.concatenate([[done], ends[begin:stop]]))))
                size += end - done
                begin, done = stop, end
                if size >= SHARD_WORDS or begin < len(names):
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    return cut(rows.mapInArrow(released(build), "ids array<string>, a binary, b binary, sizes binary, vocabulary binary, words binary, suffixes binary"), "suffixes")


def write_blocks(benchmark: DataFrame, folder: str, id_col: str = "item_id", text_col: str = "text") -> list[str]:
    """Write a benchmark's items as files of bounded size; their paths, one for each ``BLOCK_WORDS`` words or so."""
    prepare(benchmark.sparkSession)
    rows = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        names: list[str | None] = []
        codes: list[np.ndarray] = []
        sizes: list[int] = []

        def close() -> pa.RecordBatch:
            path = f"{folder}/block-{part:05d}-{number:05d}"
            put_file(path, [Block(np.concatenate(codes), np.cumsum(sizes), list(names)).to_bytes()])
            for held in (names, codes, sizes):
                held.clear()
            return pa.RecordBatch.from_pydict({"path": [path]})

        for batch in batches:
            own, ends = coded(batch.column(1), LETTERS)
            begin = 0
            for name, end in zip(batch.column(0).to_pylist(), ends.tolist(), strict=True):
                names.append(name)
                codes.append(own[begin:end])
                sizes.append(end - begin)
                begin = end
                if sum(sizes) >= BLOCK_WORDS:
                    yield close()
                    number += 1
        if names:
            yield close()

    parts = 1 + int(chars) // (6 * BLOCK_WORDS)
    made = cut(rows.repartition(parts).mapInArrow(released(write), "path string"), "blocks")
    paths = sorted(r["path"] for r in made.collect())
    discard(made)
    return paths


def search(shards: DataFrame, benchmark: DataFrame, width: int = WIDTH, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, a, b (the keys), n_words, n_hit, items, matches and hits of every text of the shards; written once.

    A match is a longest verbatim run of words shared with an item: its item,
    first word in the document and in the item, and length; hits are the positions
    of all document words inside any occurrence of a window.
    """
    if width > DEPTH:
        raise ValueError(f"windows have at most {DEPTH} words")
    spark = shards.sparkSession
    prepare(spark)
    folder = work_dir(spark, "benchmark")
    paths = write_blocks(benchmark, folder, item_col, item_text_col)

    def blocks() -> Iterator[Block]:
        for path in paths:
            files, place = filesystem(path)
            with files.open_input_stream(place) as handle:
                yield Block.from_bytes(handle.read())

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = list(blocks()) if len(paths) == 1 else None
        for batch in batches:
            for row in batch.to_pylist():
                kept = {k: np.frombuffer(row[k], t) for k, t in (("a", "<i8"), ("b", "<i8"), ("sizes", "<i8"), ("vocabulary", "<u8"), ("words", "<i4"), ("suffixes", "<i4"))}
                shard = Shard(kept["sizes"], kept["vocabulary"], kept["words"].astype(np.int64), kept["suffixes"].astype(np.int64))
                found = found_in(shard, only if only is not None else blocks(), width)
                for at in range(0, len(found), 2000):
                    n, hit, items, runs, hits = zip(*found[at : at + 2000], strict=True)
                    runs = [[dict(zip(("item", "doc_start", "item_start", "length"), m, strict=True)) for m in own] for own in runs]
                    columns = [row["ids"][at : at + 2000], kept["a"][at : at + 2000], kept["b"][at : at + 2000], n, hit, items, runs, hits]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ROW, strict=True)], schema=_ROW)

    out = cut(shards.mapInArrow(released(look), f"id string, a long, b long, {FOUND}"), "found")
    remove(spark, folder)
    return out


def annotate(docs: DataFrame, benchmark: DataFrame, name: str = "found", width: int = WIDTH, id_col: str | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with one more column, a struct of n_words, n_hit, items, matches and hits, as of ``search``."""
    shards = index(docs, id_col, text_col)
    found = search(shards, benchmark, width, item_col, item_text_col)
    discard(shards)
    keys = [f"{name}_{k}" for k in "ab"]
    fields = [c for c in found.columns if c not in ("id", "a", "b")]
    found = found.groupBy("a", "b").agg(F.first(F.struct(*fields)).alias(name))
    found = found.select(*[F.col(k).alias(x) for k, x in zip("ab", keys, strict=True)], name)
    a, b = _keyed(docs, id_col, text_col)
    return docs.withColumn(keys[0], a).withColumn(keys[1], b).join(found, keys, "left").select(*docs.columns, name)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window occurs."""
    shards = index(docs, None, text_col)
    found = search(shards, benchmark, width, item_col, item_text_col)
    keys = ["_".join([k, *docs.columns]) for k in "ab"]
    hit = cut(found.where("n_hit > 0").select(*[F.col(k).alias(x) for k, x in zip("ab", keys, strict=True)]).distinct(), "affected")
    discard(shards, found)
    a, b = _keyed(docs, None, text_col)
    return docs.withColumn(keys[0], a).withColumn(keys[1], b).join(hit, keys, "left_anti").select(*docs.columns)
