"""Web archives with a two-level capture index.

Records are WARC 1.1, one gzip member each. Of captures with equal payloads the least
page id is the response, the others revisit it. The index is sorted by reversed-host
URL key and cut into compressed blocks; a sparse directory keeps each block's first key
and place. A lookup searches the directory, then the block, then reads one range of an
archive. Reading everything goes the same way: blocks give the ranges, which are dealt
out by archive and read in order.

Tasks write files under unique names and return what they wrote; only files named in
the tables that Spark commits count, so a repeated task does no harm.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mergetide.llm.common import file_system, new_folder, staged
from mergetide.llm.token_counts import by_bytes

BLOCK_LINES = 2000
# What a task takes: blocks to write, bytes of archives to read. Entries are small and say nothing about the pages.
TASK_BLOCKS, TASK_BYTES, LEAST_ROWS = 10, 1 << 24, 1000
_DIRECTORY = "first_key string, file string, offset long, length long, n long, bytes long"
_ENTRY = "key string, page_id long, url string, file string, offset long, length long"
_READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


@dataclass(frozen=True)
class Archive:
    """A committed archive: its folder and the directory of its index blocks."""

    folder: str
    directory: DataFrame


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: the host's labels reversed, so that a domain's captures stand together."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/").lower()
    return key + (f"?{parts.query.lower()}" if parts.query else "")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None, date: str) -> bytes:
    head = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", date),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
    ]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    block = _HTTP % len(payload)
    if first is None:
        block += payload
    else:
        head.append(("WARC-Refers-To", f"<urn:page:{first}>"))
        head.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record's gzip member."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write_archives(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
) -> Archive:
    """Archives of all pages and their index. Payloads of ``least_bytes`` or more are written once.

    A null html is an empty payload, a null url has the empty key. Rows that repeat the
    response's page id are responses too; a row without page id revisits only what has one.
    An empty table gives an archive without files.
    """
    folder = new_folder(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "utf-8")
    named = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    repeats = (
        named.where(F.octet_length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "first")
    )
    # Written first: few payloads repeat, and only the real size tells whether the table can be broadcast.
    joined = named.join(staged(repeats), "digest", "left")
    first = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, at, name = None, 0, f"{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for part in by_bytes(batch, 2):
                if stream is None:
                    system, path = file_system(folder)
                    system.create_dir(path, recursive=True)
                    stream = system.open_output_stream(f"{path}/{name}", compression=None)
                rows = []
                for i, u, data, digest, origin in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    packer = zlib.compressobj(6, wbits=31)
                    base32 = base64.b32encode(bytes.fromhex(digest)).decode()
                    member = packer.compress(_record(i, u, data, base32, origin, date)) + packer.flush()
                    stream.write(member)
                    rows.append((url_key(u), i, u, name, at, len(member)))
                    at += len(member)
                yield _batch(rows, ("key", "page_id", "url", "file", "offset", "length"), _ENTRY)
        if stream is not None:
            stream.close()

    entries = staged(joined.select("page_id", "url", "payload", "digest", first).mapInArrow(write, _ENTRY))
    order = ["key", "page_id", "file", "offset"]
    tasks = 1 + entries.count() // (TASK_BLOCKS * BLOCK_LINES)
    directory = entries.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_write_index(folder), _DIRECTORY)
    return Archive(folder, staged(directory))


def _write_index(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: list[str] = []
        stream, at, name, rows, first, size = None, 0, f"{uuid.uuid4().hex}.idx", [], "", 0

        def flush() -> None:
            nonlocal stream, at, lines, size
            if stream is None:
                system, path = file_system(folder)
                system.create_dir(path, recursive=True)
                stream = system.open_output_stream(f"{path}/{name}", compression=None)
            block = zlib.compress("\n".join(lines).encode())
            stream.write(block)
            rows.append((first, name, at, len(block), len(lines), size))
            at += len(block)
            lines, size = [], 0

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not lines:
                    first = row[0]
                lines.append(json.dumps(row))
                size += row[5]
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if stream is not None:
            stream.close()
            yield _batch(rows, ("first_key", "file", "offset", "length", "n", "bytes"), _DIRECTORY)

    return run


def _block(system, path: str, file: str, offset: int, length: int) -> list[list]:
    with system.open_input_file(f"{path}/{file}") as f:
        f.seek(offset)
        return [json.loads(line) for line in zlib.decompress(f.read(length)).decode().split("\n")]


def index_entries(archive: Archive) -> DataFrame:
    """Every entry of the index (key, page_id, url, file, offset, length), block by block."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for place in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                yield _batch(_block(system, path, *place), ("key", "page_id", "url", "file", "offset", "length"), _ENTRY)

    blocks = archive.directory.select("file", "offset", "length")
    return blocks.repartition(max(1, min(blocks.count(), 10_000))).mapInArrow(read, _ENTRY)


def read_archives(archive: Archive) -> DataFrame:
    """Every capture, found by the index and read by ranges, with its payload (null for revisits)."""
    folder = archive.folder

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        file, name = None, None
        for batch in batches:
            rows, size = [], 0
            for entry_url, entry_file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if name != entry_file:
                    if file is not None:
                        file.close()
                    file, name = system.open_input_file(f"{path}/{entry_file}"), entry_file
                file.seek(offset)
                rows.append(_capture(*parse_record(file.read(length)), entry_url))
                size += len(rows[-1][-1] or b"")
                if size > 1 << 23:
                    yield _batch(rows, _READ_NAMES, _READ)
                    rows, size = [], 0
            yield _batch(rows, _READ_NAMES, _READ)
        if file is not None:
            file.close()

    # A few ranges of one archive to a task, in order, so that archives are read forward; as many tasks as there are
    # bytes in the archives for, or cores if those would be idle.
    n, size = archive.directory.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    cores = archive.directory.sparkSession.sparkContext.defaultParallelism
    tasks = max(1 + size // TASK_BYTES, min(cores, n // LEAST_ROWS))
    ranges = index_entries(archive).select("url", "file", "offset", "length")
    dealt = ranges.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(read, _READ)


_READ_NAMES = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")


def _page(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def _capture(fields: dict[str, str], payload: bytes, url: str | None) -> tuple:
    kind = fields["WARC-Type"]
    return (
        _page(fields["WARC-Record-ID"]),
        url,
        int(fields["X-Payload-Length"]),
        fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        kind,
        _page(fields.get("WARC-Refers-To")),
        payload if kind == "response" else None,
    )


class Lookup:
    """Captures of single URLs: the directory, as small as one row for ``BLOCK_LINES`` captures, is held sorted."""

    def __init__(self, archive: Archive):
        self.system, self.path = file_system(archive.folder)
        rows = archive.directory.orderBy("first_key", "file", "offset").collect()
        self.keys, self.places = [r.first_key for r in rows], [(r.file, r.offset, r.length) for r in rows]

    def captures(self, url: str) -> Iterator[tuple[dict[str, str], bytes]]:
        key = url_key(url)
        for place in self.places[max(0, bisect.bisect_left(self.keys, key) - 1) : bisect.bisect_right(self.keys, key)]:
            block = _block(self.system, self.path, *place)
            for entry in block[bisect.bisect_left(block, key, key=lambda e: e[0]) :]:
                if entry[0] != key:
                    break
                with self.system.open_input_file(f"{self.path}/{entry[3]}") as file:
                    file.seek(entry[4])
                    yield parse_record(file.read(entry[5]))


_TYPES = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _batch(rows: list, names: tuple[str, ...], schema: str) -> pa.RecordBatch:
    types = [_TYPES[c.split()[1]] for c in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types, strict=True)], list(names))
