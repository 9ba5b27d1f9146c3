"""WARC archives with payload revisits and a two-level capture index.

Every page becomes one record, compressed as a gzip member of its own. Of pages
with one payload of at least 100 bytes, the least page_id is a response and the
others are revisits that name it and hold no payload. Rows that repeat a page_id
and its payload are responses alike.

The index has two levels. Captures are sorted by their URL key, in which the
host is reversed, and written as compressed blocks of lines; a sparse directory
holds the first key and place of each block. A lookup searches the directory by
bisection, reads the few blocks that can hold its key by ranges, and then reads
the records by ranges.

Null html is an empty payload; a null url has an empty key and is recorded as
``urn:quern:none``; white space and controls in a url are percent-encoded.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut, filesystem, partitions, prepare, put_file, released, work_dir

SHORTEST = 100
#: Bytes of an archive file, lines of an index block, bytes between two ranges that are read as one.
FILE_BYTES, BLOCK_LINES, JOIN_GAP = 128 << 20, 1000, 1 << 16
_URL = re.compile(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)(:\d*)?([^#]*)", re.S)
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_SPACE = uuid.UUID("6f0f2f52-5a76-4c53-9d0e-3a1df0a1b7aa")
_ENTRY = "key string, page_id long, file string, at long, size long"


def url_key(url: str | None) -> str:
    """The sort key of a URL: host labels reversed, then path and query."""
    if not url:
        return ""
    m = _URL.match(url.strip())
    if not m:
        return _UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", url.strip())
    host = ",".join(reversed(m[1].lower().rstrip(".").split(".")))
    port = "" if m[2] in (None, ":", ":80", ":443") else m[2]
    return _UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", f"{host}{port}){m[3] or '/'}")


def _name(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page))}>"


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    safe = _UNSAFE.sub(lambda c: f"%{ord(c[0]):02X}", url) if url else "urn:quern:none"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


@dataclass
class Capture:
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload: bytes | None
    payload_bytes: int
    payload_digest: str


def parse(data: bytes) -> Capture:
    """A record from its gzip member; a response's digest is computed from its payload and must be the recorded one."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    whole = fields["WARC-Type"] == "response"
    if whole and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    page, refers = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page")
    url = fields["WARC-Target-URI"]
    return Capture(None if page is None else int(page), None if url == "urn:quern:none" else url, fields["WARC-Type"], None if refers is None else int(refers), payload if whole else None, size, digest)


def write_archives(pages: DataFrame, folder: str, shortest: int = SHORTEST) -> DataFrame:
    """Write a record for every row of ``pages`` (page_id, url, html); the captures: key, page_id, file, at, size."""
    prepare(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("long_enough", F.octet_length("payload") >= shortest)
    groups = rows.where("long_enough").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1").select("digest", "first"), "revisited")
    typed = rows.join(groups, "digest", "left")
    typed = typed.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("long_enough"), F.col("first")).alias("refers_to"))

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, number, size = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        captures: list[tuple] = []

        def close() -> pd.DataFrame:
            put_file(captures[0][2], held)
            return pd.DataFrame(captures, columns=["key", "page_id", "file", "at", "size"]).astype({"page_id": "Int64"})

        for frame in frames:
            for page, url, payload, digest, refers in zip(frame["page_id"], frame["url"], frame["payload"], frame["digest"], frame["refers_to"], strict=True):
                page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                data = record(page, url, bytes(payload), digest, refers)
                held.append(data)
                captures.append((url_key(url), page, f"{folder}/part-{part:06d}-{number:04d}.warc.gz", size, len(data)))
                size += len(data)
                if size >= FILE_BYTES:
                    yield close()
                    held, captures, size, number = [], [], 0, number + 1
        if captures:
            yield close()

    return cut(typed.mapInPandas(released(write), _ENTRY), "captures")


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Write the sorted captures as compressed blocks; the directory: part, first (key), path, at, size."""
    n = partitions(captures.sparkSession)
    order = [F.col("key").asc(), F.asc_nulls_first("page_id"), F.col("file").asc(), F.col("at").asc()]

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        path = f"{folder}/index-{part:06d}.gz"
        blocks: list[bytes] = []
        rows: list[tuple] = []
        pending: list[str] = []
        at = 0

        def close() -> None:
            nonlocal at, pending
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = packer.compress("\n".join(pending).encode()) + packer.flush()
            rows.append((part, pending[0].partition(" ")[0], path, at, len(data)))
            blocks.append(data)
            at, pending = at + len(data), []

        for frame in frames:
            for key, page, file, place, size in zip(*(frame[c] for c in ("key", "page_id", "file", "at", "size")), strict=True):
                pending.append(f"{key} " + json.dumps([None if pd.isna(page) else int(page), file, int(place), int(size)]))
                if len(pending) == lines:
                    close()
        if pending:
            close()
        if rows:
            put_file(path, blocks)
            yield pd.DataFrame(rows, columns=["part", "first", "path", "at", "size"])

    sorted_captures = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)
    return cut(sorted_captures.mapInPandas(released(write), "part int, first string, path string, at long, size long"), "directory")


def _ranges(uri: str, wanted: list[tuple[int, int]]) -> Iterator[bytes]:
    """The bytes of each (at, size) of a file, in ascending order; near ranges are fetched together."""
    files, path = filesystem(uri)
    with files.open_input_file(path) as handle:
        i = 0
        while i < len(wanted):
            j, (begin, size) = i, wanted[i]
            end = begin + size
            while j + 1 < len(wanted) and wanted[j + 1][0] - end <= JOIN_GAP and wanted[j + 1][0] + wanted[j + 1][1] - begin <= 8 << 20:
                j += 1
                end = max(end, wanted[j][0] + wanted[j][1])
            handle.seek(begin)
            data = handle.read(end - begin)
            for at, n in wanted[i : j + 1]:
                yield data[at - begin : at - begin + n]
            i = j + 1


def _lines(block: bytes) -> Iterator[tuple]:
    for line in zlib.decompress(block, 31).decode().split("\n"):
        key, _, rest = line.partition(" ")
        yield (key, *json.loads(rest))


def find(directory: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of the urls of ``urls``, each once: key, page_id, file, at, size.

    The first keys of the index's parts, one for each file of it, send every
    distinct key to the parts that may hold it. There a task bisects the part's
    directory and reads by ranges the blocks that may hold a key asked for, each
    once, since keys come in order.
    """
    spark = directory.sparkSession
    prepare(spark)
    parts = sorted((r["first"], r["part"]) for r in directory.groupBy("part").agg(F.min("first").alias("first")).collect())
    firsts, numbers = [p[0] for p in parts], [p[1] for p in parts]

    @F.pandas_udf("struct<key:string,parts:array<int>>")
    def placed(urls: pd.Series) -> pd.DataFrame:
        keys = [url_key(u) for u in urls]
        return pd.DataFrame({"key": keys, "parts": [numbers[max(0, bisect_left(firsts, k) - 1) : bisect_right(firsts, k)] for k in keys]})

    asked = urls.select(placed(F.col(url_col).cast("string")).alias("at")).select("at.key", "at.parts").distinct().select(F.explode("parts").alias("part"), F.col("key").alias("first"))
    nothing = {"path": "string", "at": "long", "size": "long"}
    rows = directory.select("part", "first", *nothing, F.lit(0).alias("asked")).union(asked.select("part", "first", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()], F.lit(1)))
    rows = rows.repartition(partitions(spark), "part").sortWithinPartitions("part", "asked", "first", "at")

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, first, blocks, at, lines = None, [], [], -1, []
        for frame in frames:
            out = []
            for number, key, path, place, size, question in zip(*(frame[c] for c in ("part", "first", "path", "at", "size", "asked")), strict=True):
                if number != part:
                    part, first, blocks, at, lines = number, [], [], -1, []
                if not question:
                    first.append(key)
                    blocks.append((path, int(place), int(size)))
                    continue
                for k in range(max(0, bisect_left(first, key) - 1), bisect_right(first, key)):
                    if k != at:
                        path, place, size = blocks[k]
                        at, lines = k, list(_lines(next(_ranges(path, [(place, size)]))))
                    keys = [x[0] for x in lines]
                    out += lines[bisect_left(keys, key) : bisect_right(keys, key)]
            yield pd.DataFrame(out, columns=["key", "page_id", "file", "at", "size"]).astype({"page_id": "Int64"})

    return rows.mapInPandas(released(look), _ENTRY)


def read_records(captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest and payload (null in revisits)."""
    n = partitions(captures.sparkSession)
    dealt = captures.withColumn("chunk", F.shiftright("at", 22)).repartition(n, "file", "chunk").sortWithinPartitions("file", "at")
    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, group in frame.groupby("file", sort=False):
                found = [parse(x) for x in _ranges(file, list(zip(group["at"].tolist(), group["size"].tolist(), strict=True)))]
                out = pd.DataFrame([[getattr(c, k) for k in names] for c in found], columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                if with_payload:
                    out["payload"] = [c.payload for c in found]
                yield out

    return dealt.mapInPandas(released(read), "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * with_payload)


def lookup(directory: DataFrame, url: str) -> list[Capture]:
    """The captures of one URL, in order of their pages."""
    rows = find(directory, directory.sparkSession.createDataFrame([(url,)], "url string")).collect()
    return [parse(next(_ranges(r["file"], [(r["at"], r["size"])]))) for r in sorted(rows, key=lambda r: (r["page_id"] is not None, r["page_id"], r["file"], r["at"]))]


def new_folder(spark) -> str:
    return work_dir(spark, "warc")
