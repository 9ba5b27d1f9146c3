"""Binary token shards with Elias-Fano document boundaries.

A shard file holds, for documents in ascending id order, one concatenated array
of token ids (16 bits where the vocabulary allows, else 32) and two Elias-Fano
sequences: the document ids, and where each document ends in the array. A
sequence of n values up to u takes about n * (2 + log2(u / n)) bits, and its
select directory finds any one of them without a table of 64-bit offsets.

Layout, all integers little-endian::

    8 bytes   magic b"QTOKENS1"
    4 bytes   length h of the header
    h bytes   JSON header: docs, ids, id_bytes, base, null_ids, sections
    sections  document ids, ends (Elias-Fano each), then the id array

Documents with a null id come first and are counted in ``null_ids``; a null
text is an empty one, of which only the end id is stored. Repeated ids are kept.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import cut, filesystem, larger, partitions, prepare, put_file, released, work_dir
from quern.llm.tokens import encoder

MAGIC = b"QTOKENS1"
#: One set bit in so many has its place in the select directory; bytes of ids at which a shard is written.
STEP, TARGET = 256, 64 << 20


class EliasFano:
    """A non-decreasing sequence of non-negative integers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.int64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, ((top + 1) // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if width:
            shifts = np.arange(width, dtype=np.int64)
            low = np.packbits(((values[:, None] >> shifts) & 1).astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> width) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, low, np.packbits(bits, bitorder="little"), ones[::STEP].astype("<u8" if n and ones[-1] >> 32 else "<u4"))

    def _low(self, i: int) -> int:
        value = 0
        for k in range(self.low_bits):
            bit = i * self.low_bits + k
            value |= int(self.low[bit >> 3] >> (bit & 7) & 1) << k
        return value

    def __getitem__(self, i: int) -> int:
        """The i-th value, by select from the nearest place in the directory."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.places[i // STEP]), i % STEP
        byte = at >> 3
        word = int(self.high[byte]) & (0xFF << (at & 7))
        while (count := word.bit_count()) <= left:
            left -= count
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = byte * 8 + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | self._low(i)

    def decode(self) -> np.ndarray:
        """All values at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
            for k in range(self.low_bits):
                out |= bits[:, k].astype(np.int64) << k
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.places), self.places.itemsize], "<u8")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.places.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, a, b, c, size = np.frombuffer(data, "<u8", 6).tolist()
        raw = np.frombuffer(data, np.uint8, offset=48)
        return cls(n, width, raw[:a], raw[a : a + b], raw[a + b : a + b + c * size].view(f"<u{size}"))


def shard_parts(doc_ids: list[int | None], lengths: list[int], codes: list[np.ndarray], id_bytes: int) -> list[bytes]:
    """The file of documents of these ids, which ascend with nulls first, and so many token ids; ``codes`` holds all of them in arrays of any size."""
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    ids = EliasFano.of(np.array(known, dtype=np.int64) - base).to_bytes()
    ends = np.cumsum(lengths, dtype=np.int64)
    places = EliasFano.of(ends).to_bytes()
    header = {"docs": len(lengths), "ids": int(ends[-1]) if lengths else 0, "id_bytes": id_bytes, "base": base, "null_ids": len(doc_ids) - len(known), "sections": [len(ids), len(places)]}
    head = json.dumps(header).encode()
    return [MAGIC, len(head).to_bytes(4, "little"), head, ids, places, *[c.tobytes() for c in codes]]


class Shard:
    """A shard file read through its boundaries; ``read`` fetches bytes of the file."""

    def __init__(self, read, size: int):
        first = read(0, min(size, 1 << 16))
        if first[:8] != MAGIC:
            raise ValueError("not a token shard")
        h = int.from_bytes(first[8:12], "little")
        head = first[12 : 12 + h]
        self.header = json.loads(head)
        a, b = self.header["sections"]
        at = 12 + h
        body = first[at : at + a + b] if at + a + b <= len(first) else read(at, a + b)
        self.ids, self.ends = EliasFano.from_bytes(body[:a]), EliasFano.from_bytes(body[a:])
        self.start, self.read = at + a + b, read

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document, by two selects and one read."""
        size = self.header["id_bytes"]
        begin, end = (self.ends[i - 1] if i else 0), self.ends[i]
        return np.frombuffer(self.read(self.start + begin * size, (end - begin) * size), f"<u{size}")

    def documents(self, block: int = 8 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start, ids) of every document, reading the array in blocks."""
        size, base, nulls = self.header["id_bytes"], self.header["base"], self.header["null_ids"]
        keys = [None] * nulls + (self.ids.decode() + base).tolist()
        ends = self.ends.decode().tolist()
        i = begin = 0
        while i < len(ends):
            j = i + 1
            while j < len(ends) and (ends[j] - begin) * size <= block:
                j += 1
            data = np.frombuffer(self.read(self.start + begin * size, (ends[j - 1] - begin) * size), f"<u{size}")
            at = begin
            for k in range(i, j):
                yield keys[k], at, data[at - begin : ends[k] - begin]
                at = ends[k]
            i, begin = j, at


def open_shard(uri: str) -> tuple[Shard, object]:
    files, path = filesystem(uri)
    handle = files.open_input_file(path)

    def read(at: int, n: int) -> bytes:
        handle.seek(at)
        return handle.read(n)

    return Shard(read, handle.size()), handle


def write_shards(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text", target: int = TARGET) -> DataFrame:
    """Encode and write every document; the manifest: shard, path, docs, ids, bytes.

    Documents are dealt by ranges of their id and a hash of their text, and of a
    number for rows that are the same, so neither a frequent value nor copies meet
    in one task and only numbers are sampled for the ranges. A task writes a shard
    whenever its ids have reached ``target`` bytes and holds no more than that; a
    longer document is a shard of its own. Documents with one id follow the hash.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = shards or partitions(spark)
    dealt = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    dealt = dealt.withColumn("hash", F.xxhash64("text")).withColumn("copy", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("doc_id"), F.asc("hash"), F.asc("copy")]
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        with encoder(tokenizer_path) as coder:
            yield from _write(coder, larger(batches), part)

    def _write(coder, batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        width, number, size = coder.dtype.itemsize, 0, 0
        keys: list[int | None] = []
        codes: list[np.ndarray] = []
        lengths: list[int] = []

        def close() -> pa.RecordBatch:
            path = f"{folder}/shard-{part:06d}-{number:05d}.qtok"
            size = put_file(path, shard_parts(keys, lengths, codes, width))
            out = {"shard": [part << 20 | number], "path": [path], "docs": [len(keys)], "ids": [sum(lengths)], "bytes": [size]}
            for held in (keys, codes, lengths):
                held.clear()
            return pa.RecordBatch.from_pydict(out, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            ids, ends = coder.arrays(batch.column(1))
            ids = np.insert(ids, ends, end_id)
            ends = ends + np.arange(1, len(ends) + 1)
            begin, done = 0, 0
            names = batch.column(0).to_pylist()
            while begin < len(names):
                stop = max(begin + 1, int(np.searchsorted(ends, done + (target - size) // width, "right")))
                end = int(ends[stop - 1])
                keys += names[begin:stop]
                lengths += np.diff(np.concatenate([[done], ends[begin:stop]])).tolist()
                codes.append(ids[done:end])
                size += (end - done) * width
                begin, done = stop, end
                if size >= target or begin < len(names):
                    yield close()
                    number, size = number + 1, 0
        if keys:
            yield close()

    return cut(dealt.mapInArrow(released(write), "shard long, path string, docs long, ids long, bytes long"), "tokens-manifest")


def read_shards(manifest: DataFrame, row=None, schema: str = "ids array<long>") -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and what ``row`` makes of the ids.

    ``row`` maps an array of ids to the values of ``schema``; by default the ids
    themselves. Only the manifest, a row a shard, is summed in one place.
    """
    row = row or (lambda ids: (ids.tolist(),))
    before = F.coalesce(F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = cut(manifest.withColumn("before", before).select("path", "before"), "tokens-files")
    names = [x.split()[0] for x in schema.split(", ")]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"], frame["before"], strict=True):
                shard, handle = open_shard(path)
                rows = []
                with handle:
                    for doc, at, ids in shard.documents():
                        rows.append((doc, int(start) + at, len(ids), *row(ids)))
                        if len(rows) == 5000:
                            yield _frame(rows, names)
                            rows = []
                if rows:
                    yield _frame(rows, names)

    n = partitions(manifest.sparkSession)
    return files.repartition(n).mapInPandas(released(read), f"doc_id long, start long, n_tokens long, {schema}")


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", *names])
    return out.astype({"doc_id": "Int64"})


def crc32(ids: np.ndarray) -> tuple[int]:
    """The unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return (zlib.crc32(ids.astype("<u4").tobytes()),)


def new_folder(spark) -> str:
    return work_dir(spark, "tokens")
