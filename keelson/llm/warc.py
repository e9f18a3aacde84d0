"""WARC archives with a two-level capture index.

Writing: every page becomes one record, a gzip member of its own, in the archive file of its task; the task returns an index line
(reversed-host key, page id, file, offset, length) per record.  Of pages with equal payloads of at least ``REVISIT_BYTES``
the one with the largest id is the response, the others are revisits without payload.

Index: the lines are sorted by key and id over all tasks and cut into blocks, each compressed and appended to an index file.  The
directory holds the first key and the place of each block.  Blocks grow with the archive, so the directory never has more
than ``MAX_DIRECTORY`` entries and can travel with the tasks.

Reading: a key is looked up by binary search in the directory, one range read of its block, and binary search in the
block; the record then is another range read.  Lookups run sorted by key, reads sorted by file and offset.

Files are opened through Arrow's file systems (local or mounted folders, S3, GCS, HDFS) in the shared
folder.  A task that is run again writes a new file; only lines of the run that Spark accepted reach the
index, so leftovers of lost executors are never read.

Defined results for odd input: a null html is an empty payload, a null url has the empty key, a null id sorts before all others and
is returned as null; if rows repeat the largest id of their payload, all these rows are responses;
equal rows give equal records, each in its place; other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left
from collections import OrderedDict
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.staging import input_tasks, scratch_path, stage
from .common import arrow_map

REVISIT_BYTES = 1000
BLOCK_LINES = 2048
MAX_DIRECTORY = 1 << 17
#: Records side by side in a file are fetched by one range read of at most this many bytes.
READ_BYTES = 4 << 20
NO_ID = -(1 << 63)
GZIP_LEVEL = 4
LINE = "surt string, page_id long, file string, offset long, length long"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def surt_key(url: Column) -> Column:
    """``com,example,www)/path?query``: the host's labels reversed and lower-cased, scheme and fragment dropped."""
    rest = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.when(rest == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), tail))


def with_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, html, surt, digest (hex SHA-1), n_bytes, response_id (null: this page is a response)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), surt_key(F.col("url")).alias("surt"), F.sha1(html.cast("binary")).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    groups = rows.where(F.col("n_bytes") >= REVISIT_BYTES).groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1 AND top IS NOT NULL")
    groups = stage(groups.select("d", "top"), "payload-groups")  # written by itself, so that the join can split a common payload over tasks
    joined = rows.join(groups, F.col("digest") == F.col("d"), "left")
    is_revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "html", "surt", "digest", "n_bytes", F.when(is_revisit, F.col("top")).alias("response_id"))


def record_uri(page_id: int | None) -> str:
    return "<urn:x-capture:none>" if page_id is None else f"<urn:x-capture:{page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, response_id: int | None) -> bytes:
    """One WARC record: headers, an HTTP header, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http if response_id is not None else http + payload
    target = "" if url is None else f"WARC-Target-URI: {' '.join(url.split())}\r\n"
    kind = "response"
    extra = ""
    if response_id is not None:
        kind = "revisit"
        extra = f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: {record_uri(response_id)}\r\n"
    head = (
        f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {record_uri(page_id)}\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n{target}{extra}"
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
    )
    return head.encode() + block + b"\r\n\r\n"


@dataclass(frozen=True)
class Capture:
    page_id: int | None
    payload_bytes: int
    payload_digest: str
    record_type: str
    refers_to: int | None
    payload: bytes


def _uri_id(uri: str) -> int | None:
    value = uri.removeprefix("<urn:x-capture:").removesuffix(">")
    return None if value == "none" else int(value)


def parse_record(member: bytes) -> Capture:
    """The record in one gzip member; a response's length and digest are taken from its payload and compared with the headers."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    refers = _uri_id(fields["WARC-Refers-To"]) if kind == "revisit" else None
    return Capture(_uri_id(fields["WARC-Record-ID"]), size, digest, kind, refers, payload)


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write_records(folder: str):
    def run(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        name, at, out = f"{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for b in batches:
                lines = []
                for r in b.to_pylist():
                    member = gzip_member(record_bytes(r["page_id"], r["url"], r["html"].encode(), r["digest"], r["n_bytes"], r["response_id"]))
                    out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
                    out.write(member)
                    lines.append((r["surt"], r["page_id"], name, at, len(member)))
                    at += len(member)
                yield _line_batch(lines)
        finally:
            if out:
                out.close()

    return run


_LINE_SCHEMA = pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _line_batch(lines: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*lines, strict=True)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINE_SCHEMA, strict=True)], schema=_LINE_SCHEMA)


def _key(surt: str, page_id: int | None) -> tuple[str, int]:
    return surt, NO_ID if page_id is None else page_id


def _pack_block(lines: list[tuple]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _LINE_SCHEMA) as w:
        w.write_batch(_line_batch(lines))
    return zlib.compress(sink.getvalue(), 6)


def _unpack_block(data: bytes) -> list[tuple]:
    table = pa.ipc.open_stream(zlib.decompress(data)).read_all()
    return list(zip(*(c.to_pylist() for c in table.columns), strict=True))


def _write_blocks(folder: str, block_lines: int):
    def run(batches):
        fs, top = file_system(folder)
        fs.create_dir(top, recursive=True)
        name, at, held, out = f"{uuid.uuid4().hex}.idx", 0, [], None
        rows: list[tuple] = []

        def flush(lines):
            nonlocal at, out
            data = _pack_block(lines)
            out = out or fs.open_output_stream(f"{top}/{name}", compression=None)
            out.write(data)
            rows.append((lines[0][0], lines[0][1], name, at, len(data)))
            at += len(data)

        try:
            for b in batches:
                held += zip(*(c.to_pylist() for c in b.columns), strict=True)
                while len(held) >= block_lines:
                    flush(held[:block_lines])
                    held = held[block_lines:]
            if held:
                flush(held)
        finally:
            if out:
                out.close()
        yield _line_batch(rows)

    return run


class Directory:
    """Sparse block directory: the first key of each block, in order, and where the block is."""

    def __init__(self, rows: list[tuple]) -> None:
        rows = sorted(rows, key=lambda r: _key(r[0], r[1]))
        self.firsts = [_key(r[0], r[1]) for r in rows]
        self.places = [tuple(r[2:]) for r in rows]

    def blocks(self, key: tuple[str, int]) -> range:
        """Blocks that can hold ``key``: the last one that starts before it, and those that start with it."""
        first = max(bisect_left(self.firsts, key) - 1, 0)
        last = first
        while last < len(self.firsts) and self.firsts[last] <= key:
            last += 1
        return range(first, last)


class BlockReader:
    """Range reads of index blocks, the last few kept."""

    def __init__(self, folder: str, directory: Directory, keep: int = 8) -> None:
        self.fs, self.top = file_system(folder)
        self.directory, self.keep = directory, keep
        self.blocks: OrderedDict[int, tuple[list, list]] = OrderedDict()

    def block(self, i: int) -> tuple[list, list]:
        if i not in self.blocks:
            name, offset, length = self.directory.places[i]
            with self.fs.open_input_file(f"{self.top}/{name}") as f:
                lines = _unpack_block(f.read_at(length, offset))
            self.blocks[i] = ([_key(x[0], x[1]) for x in lines], lines)
            if len(self.blocks) > self.keep:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end(i)
        return self.blocks[i]

    def find(self, key: tuple[str, int]) -> list[tuple]:
        out = []
        for i in self.directory.blocks(key):
            keys, lines = self.block(i)
            j = bisect_left(keys, key)
            while j < len(keys) and keys[j] == key:
                out.append(lines[j])
                j += 1
        return out


class Archive:
    """Archives and index in one shared folder."""

    def __init__(self, spark: SparkSession, folder: str, directory: Directory) -> None:
        self.spark, self.folder, self.directory = spark, folder, directory

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Index lines of the distinct (surt, page_id) in ``keys``."""
        folder, directory = f"{self.folder}/index", self.directory

        def run(batches):
            reader = BlockReader(folder, directory)
            for b in batches:
                found = [x for s, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in reader.find(_key(s, p))]
                yield _line_batch(found)

        wanted = keys.select("surt", "page_id").distinct()
        n = input_tasks(self.spark)
        return arrow_map(wanted.repartitionByRange(n, "surt", "page_id").sortWithinPartitions("surt", "page_id"), run, LINE)

    def read(self, lines: DataFrame) -> DataFrame:
        """The records that ``lines`` point at: page_id, payload_bytes, payload_digest, record_type, refers_to, payload."""
        folder = f"{self.folder}/warc"
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

        def run(batches):
            fs, top = file_system(folder)
            for b in batches:
                rows = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
                done = 0
                while done < len(rows):
                    name, start, _ = rows[done]
                    # Records side by side: one range read, one batch.
                    upto, end = done, start
                    while upto < len(rows) and rows[upto][0] == name and rows[upto][1] == end and (end + rows[upto][2] - start <= READ_BYTES or upto == done):
                        end += rows[upto][2]
                        upto += 1
                    with fs.open_input_file(f"{top}/{name}") as f:
                        data = f.read_at(end - start, start)
                    found = [parse_record(data[o - start : o - start + n]) for _, o, n in rows[done:upto]]
                    yield pa.RecordBatch.from_arrays([pa.array([getattr(c, x.name) for c in found], x.type) for x in schema], schema=schema)
                    done = upto

        # A hot file is dealt out by stretches of its bytes.
        dealt = lines.select("file", "offset", "length").repartition(input_tasks(self.spark), F.col("file"), F.floor(F.col("offset") / (16 << 20))).sortWithinPartitions("file", "offset")
        return arrow_map(dealt, run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def write_archive(pages: DataFrame, block_lines: int = BLOCK_LINES) -> Archive:
    """Write all ``pages`` (page_id, url, html) as WARC records and index them."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    lines = stage(arrow_map(with_revisits(pages), _write_records(f"{folder}/warc"), LINE), "warc-lines")
    n = lines.count()
    block_lines = max(block_lines, -(-2 * n // MAX_DIRECTORY))
    tasks = max(1, min(input_tasks(spark), -(-n // block_lines)))
    ordered = lines.repartitionByRange(tasks, "surt", "page_id").sortWithinPartitions("surt", "page_id")
    blocks = arrow_map(ordered, _write_blocks(f"{folder}/index", block_lines), LINE)
    return Archive(spark, folder, Directory([tuple(r) for r in blocks.collect()]))  # at most MAX_DIRECTORY rows
