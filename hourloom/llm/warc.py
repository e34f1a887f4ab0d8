"""WARC archives of pages with a two-level capture index: compressed blocks of sorted keys under a sparse directory."""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hourloom.llm.common import ascii_lower, map_batches, map_partition, new_folder, stage

BLOCK_LINES = 512
#: Archives are closed at about this size.
ARCHIVE_BYTES = 256 << 20
_NAME = "urn:hourloom:page"
_FOOTER = "<QQ"

ENTRY = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)
SHARD = T.StructType([T.StructField("first", T.StringType()), T.StructField("last", T.StringType()), T.StructField("shard", T.StringType())])
BLOCK = T.StructType([T.StructField("shard", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
RECORD = T.StructType(
    [
        T.StructField("page", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


@dataclass(frozen=True)
class Archive:
    """``shards`` has a row per index file: first and last key, and path."""

    folder: str
    shards: DataFrame
    id_type: T.DataType


def with_key(rows: DataFrame) -> DataFrame:
    """Adds ``key``: the labels of the host of ``_hl_url`` from the right, then the rest, so that a site sorts together.

    A null url, or one without ``://``, has no host.
    """
    found = F.regexp_extract("_hl_url", r"^(?s:.*?)://([^/?#]*)", 1)
    after = F.regexp_extract("_hl_url", r"^(?s:.*?)://[^/?#]*((?s:.*))$", 1)
    labels = F.array_join(F.reverse(F.split(ascii_lower(F.regexp_replace(found, r":[0-9]*$", "")), r"\.")), ",")
    key = F.when(F.instr("_hl_url", "://") > 0, F.concat(labels, F.lit(")"), after)).otherwise(F.concat(F.lit(")"), F.coalesce("_hl_url", F.lit(""))))
    return rows.withColumn("key", F.coalesce(key, F.lit(")")))


def write_archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> Archive:
    """Write one record per page and the index over them.

    Of pages with equal payloads of ``least_bytes`` bytes or more, the one with the smallest id is a response and the
    others are revisits of it; rows that repeat that id and payload are responses too, and a null id is larger than any.
    A null payload is empty.  Every task writes its own archives under new names and returns where records lie, so a
    task that is run again leaves no wrong entry.  The folder must be one that pyarrow can open.
    """
    folder = new_folder(pages.sparkSession, "warc")
    rows = pages.select(F.col(id_col).alias("_hl_id"), F.col(url_col).alias("_hl_url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html"))
    shared = rows.filter(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("_hl_id").alias("least"), F.count(F.lit(1)).alias("n"))
    shared = shared.filter("n > 1 and least is not null").select("sha", "size", "least")
    rows = rows.join(shared, ["sha", "size"], "left")
    revisit = F.coalesce(F.col("least").isNotNull() & ~F.col("_hl_id").eqNullSafe(F.col("least")), F.lit(False))
    rows = rows.withColumns({"refers": F.when(revisit, F.col("least")).cast("string"), "page": F.col("_hl_id").cast("string")})
    body = F.when(revisit, F.lit(None)).otherwise(F.col("html"))
    records = with_key(rows).select("key", "page", F.col("_hl_url").alias("url"), "refers", "sha", "size", body.alias("body"))
    entries = stage(map_partition(records, _archiver(folder), ENTRY), "captures")
    ordered = entries.repartitionByRange("key", "page", "path", "offset").sortWithinPartitions("key", "page", "path", "offset")
    shards = stage(map_partition(ordered, _indexer(folder), SHARD), "shards")
    return Archive(folder, shards, pages.schema[id_col].dataType)


def read_archive(archive: Archive) -> DataFrame:
    """Every record, by way of the index: directories, then blocks, then the ranges they name."""

    def blocks(batch: dict) -> Iterator[dict]:
        for shard in batch["shard"]:
            places = _directory(shard)
            yield {"shard": [shard] * len(places), "offset": [p[1] for p in places], "length": [p[2] for p in places]}

    def records(batches: Iterator[dict]) -> Iterator[dict]:
        files = _Files()
        for batch in batches:
            for shard, offset, length in zip(batch["shard"], batch["offset"], batch["length"]):
                lines = _block(files, shard, offset, length)
                yield _columns([_record(files, *line[2:]) for line in sorted(lines, key=lambda x: x[2:4])])

    places = stage(map_batches(archive.shards.select("shard"), blocks, BLOCK), "blocks")
    return _typed(map_partition(places.repartition("shard", "offset"), records, RECORD), archive)


def look_up(archive: Archive, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The records whose url has the same key as one of ``urls`` (distinct keys; null urls find pages without url).

    Keys go to the shards whose range holds them; there the directory and then one or more blocks are searched by
    bisection, and only the ranges of matching records are read.  The list of shards, one per index partition, is small.
    """
    rows = urls.select(F.col(url_col).cast("string").alias("_hl_url"))
    keys = with_key(rows).select("key").distinct()
    wanted = keys.join(F.broadcast(archive.shards), F.col("key").between(F.col("first"), F.col("last")))

    def search(batches: Iterator[dict]) -> Iterator[dict]:
        files, known = _Files(), {}
        for batch in batches:
            for key, shard in zip(batch["key"], batch["shard"]):
                if shard not in known:
                    known = {shard: _directory(shard)}
                firsts = [p[0] for p in known[shard]]
                found = []
                for _, offset, length in known[shard][max(0, bisect_left(firsts, key) - 1) : bisect_right(firsts, key)]:
                    lines = _block(files, shard, offset, length)
                    names = [line[0] for line in lines]
                    found += lines[bisect_left(names, key) : bisect_right(names, key)]
                yield _columns([_record(files, *line[2:]) for line in found])

    searched = wanted.select("key", "shard").repartition("shard").sortWithinPartitions("shard", "key")
    return _typed(map_partition(searched, search, RECORD), archive)


def _typed(records: DataFrame, archive: Archive) -> DataFrame:
    kind = archive.id_type
    return records.withColumns({"page": F.col("page").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def _columns(records: list[tuple]) -> dict:
    return {name: [r[i] for r in records] for i, name in enumerate(RECORD.names)}


class _Files:
    """Open files by path, for range reads; the one read last stays open."""

    def __init__(self):
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            if self.file is not None:
                self.file.close()
            system, inner = _system(path)
            self.path, self.file = path, system.open_input_file(inner)
        return self.file.read_at(length, offset)

    def size(self, path: str) -> int:
        self.read(path, 0, 0)
        return self.file.size()


def _system(path: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class _Writer:
    def __init__(self, folder: str, name: str):
        self.path = f"{folder}/{name}-{uuid.uuid4().hex}"
        system, inner = _system(self.path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.file, self.at = system.open_output_stream(inner, compression=None), 0

    def add(self, data: bytes) -> tuple[int, int]:
        at = self.at
        self.file.write(data)
        self.at += len(data)
        return at, len(data)


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _archiver(folder: str):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        writer = None
        for batch in batches:
            places = []
            for row in zip(*[batch[c] for c in ("page", "url", "refers", "sha", "size", "body")]):
                if writer is None or writer.at > ARCHIVE_BYTES:
                    if writer is not None:
                        writer.file.close()
                    writer = _Writer(f"{folder}/archives", "pages.warc.gz")
                places.append((writer.path, *writer.add(_gzip(_entry(*row)))))
            yield {"key": batch["key"], "page": batch["page"], "path": [p[0] for p in places], "offset": [p[1] for p in places], "length": [p[2] for p in places]}
        if writer is not None:
            writer.file.close()

    return run


def _name(page: str | None) -> str:
    return f"<{_NAME}>" if page is None else f"<{_NAME}:{quote(page, safe='')}>"


def _page(name: str) -> str | None:
    return None if name == f"<{_NAME}>" else unquote(name[len(_NAME) + 2 : -1])


def _entry(page, url, refers, sha, size, body) -> bytes:
    """One record; a revisit has the HTTP head alone, with the length of the payload it stands for."""
    digest = base64.b32encode(bytes.fromhex(sha)).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head if refers is not None else head + body.encode("utf-8", "surrogatepass")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}", f"WARC-Record-ID: {_name(page)}"]
    lines += ["WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines += [f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%~')}", f"X-Source-Url: {json.dumps(url)}"]
    if refers is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _record(files: _Files, path: str, offset: int, length: int) -> tuple:
    """One record by a range read; a response's payload is checked against its digest."""
    raw = zlib.decompress(files.read(path, offset, length), 31)
    top, _, block = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in top.decode().split("\r\n")[1:])
    block = block[: int(headers["Content-Length"])]
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record at {offset} of {path}")
    refers = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
    url = json.loads(headers["X-Source-Url"]) if "X-Source-Url" in headers else None
    return _page(headers["WARC-Record-ID"]), url, kind, refers, size, digest, payload if kind == "response" else None


def _indexer(folder: str):
    def run(batches: Iterator[dict]) -> Iterator[dict]:
        lines, directory, writer, last = [], [], None, None
        rows = (row for b in batches for row in zip(*[b[f.name] for f in ENTRY]))

        def close() -> None:
            directory.append((lines[0][0], *writer.add(zlib.compress("\n".join(map(json.dumps, lines)).encode()))))
            lines.clear()

        for row in rows:
            writer = writer or _Writer(f"{folder}/index", "captures.idx")
            lines.append(row)
            last = row[0]
            if len(lines) >= BLOCK_LINES:
                close()
        if writer is not None:
            if lines:
                close()
            writer.add(struct.pack(_FOOTER, *writer.add(zlib.compress("\n".join(map(json.dumps, directory)).encode()))))
            writer.file.close()
            yield {"first": [directory[0][0]], "last": [last], "shard": [writer.path]}

    return run


def _directory(shard: str) -> list[list]:
    """The first key, offset and length of each block of an index file."""
    files = _Files()
    size = files.size(shard)
    offset, length = struct.unpack(_FOOTER, files.read(shard, size - 16, 16))
    return _block(files, shard, offset, length)


def _block(files: _Files, shard: str, offset: int, length: int) -> list[list]:
    return [json.loads(line) for line in zlib.decompress(files.read(shard, offset, length)).decode().split("\n")]
