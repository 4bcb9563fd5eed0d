"""WARC records in ZIP packages (operator 13): written by tasks, read back by byte ranges, nothing extracted.

A package is a ZIP file with stored members:

    archive/data.warc.gz   WARC/1.1 records, each a gzip member of its own
    indexes/index.cdxj     a line a record: key, time, JSON with offset and length in the archive

Writing: of rows with equal payloads of ``LEAST`` bytes or more (equal by
SHA-256) that with the largest id is a ``response`` and the others are
``revisit`` records that refer to it; they hold the head of the answer, with the
full length, and the digest.  Groups are counted in the tasks before their
shuffle, and payloads stay where they lie: only a digest a group meets the rows
(``attach``).  Each task writes packages of its own, under names that no other
attempt uses, and what a finished task wrote is listed in a table, so repeated,
lost or speculative tasks leave no record twice.

Reading, two steps.  A task takes a package, reads the end, the central directory
(ZIP64 too) and the index members, and gives ranges of about ``RANGE`` bytes with
the place of each record in them.  Ranges are dealt over the cluster by number,
so one large package is read by many tasks, and a task reads just its ranges.
Archives that no index lists are one range and are walked record by record, in
constant memory.  A member that the package itself compresses has no ranges: that
is an error.

Defined results: null and empty payloads are responses of 0 bytes; a row with null
id can only refer, unless all of its group have none, and then all are responses;
rows that repeat the largest id of a group and its payload are all responses;
null urls are left out, and control characters of urls and ids are written as %XX;
very long payloads are whole records; other columns are ignored; an empty table
writes no package and reads back empty.  A record that cannot be read, or whose payload
does not give its digest, comes back with the reason in ``damage``.
``folder`` is one that pyarrow opens, as the shared folder of a cluster is.
"""

from __future__ import annotations

import base64
import hashlib
import json
import posixpath
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.llm import zip_directory
from mudline.llm.batches import by_bytes
from mudline.llm.shared import attach, new_dir, written, written_at

LEAST = 1000
FILE_BYTES = 1 << 30
FILE_RECORDS = 200_000
RANGE = 4 << 20
TASK_BYTES = 64 << 20
ROWS = 1000
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:row:"
RECORD = "record_id string, record_type string, url string, payload_bytes long, payload_digest string, refers_to string, damage string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI; Spark writes local ones with one slash."""
    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def one_line(text: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def head(fields: list[tuple[str, str | None]]) -> bytes:
    return "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode()


def record(row_id: str | None, url: str | None, payload: bytes, digest: bytes, refers_to: str | None, revisit: bool, date: str) -> bytes:
    """One WARC record; a revisit holds the head of the answer alone."""
    block = b"HTTP/1.1 200 OK\r\n" + head([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]) + b"\r\n" + (b"" if revisit else payload)
    urn = lambda i: f"<{ID}{'' if i is None else '=' + quote(i, safe='')}>"
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(row_id)), ("WARC-Date", date), ("WARC-Target-URI", None if url is None else one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"), ("WARC-Refers-To", urn(refers_to) if revisit else None), ("WARC-Profile", PROFILE if revisit else None),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    return b"WARC/1.1\r\n" + head(fields) + b"\r\n" + block + b"\r\n\r\n"


class Package:
    """One package while it is written."""

    def __init__(self, folder: str, name: str):
        self.where, root = opened(folder)
        self.where.create_dir(root, recursive=True)
        self.path, self.uri = posixpath.join(root, name), posixpath.join(folder, name)
        self.out = self.where.open_output_stream(self.path)
        self.zip, self.lines, self.n = zip_directory.StoredWriter(self.out), [], 0
        self.zip.begin("archive/data.warc.gz")

    def add(self, content: bytes, url: str | None, kind: str, date: str) -> None:
        packed = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = packed.compress(content) + packed.flush()
        entry = json.dumps({"url": url, "type": kind, "offset": self.zip.size, "length": len(data), "filename": "data.warc.gz"})
        self.lines.append(f"{one_line(url or '-')} {re.sub('[^0-9]', '', date)} {entry}\n")
        self.zip.write(data)

    def close(self) -> tuple[str, int, int]:
        self.zip.end()
        self.zip.begin("indexes/index.cdxj")
        for at in range(0, len(self.lines), ROWS):
            self.zip.write("".join(self.lines[at : at + ROWS]).encode())
        self.zip.end()
        self.zip.close()
        self.out.close()
        return self.uri, self.zip.at, len(self.lines)


def decided(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least: int = LEAST, few: int | None = None) -> DataFrame:
    """``id``, ``url``, ``payload`` and ``refers_to`` (of revisits), ids as text."""
    payload = F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b""))
    own = F.when(F.octet_length("payload") >= least, F.sha2("payload", 256))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("same", own)
    groups = rows.filter("same IS NOT NULL").groupBy("same").agg(F.count("*").alias("n"), F.max("id").alias("last")).filter("n > 1")
    found = attach(rows, written(groups, "copies"), "same", **({} if few is None else {"few": few}))
    other = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    return found.select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(other, F.col("last").cast("string")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = DATE, file_bytes: int = FILE_BYTES, file_records: int = FILE_RECORDS, least: int = LEAST, few: int | None = None) -> DataFrame:
    """Write a record for each row of ``pages`` into packages in ``folder``; runs at once.

    Returns the written table of packages: ``path``, ``bytes``, ``records``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, partition = None, TaskContext.get().partitionId()
        for b in by_bytes(batches, "payload"):
            for row_id, url, payload, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if package is None:
                    package = Package(folder, f"part-{partition:06d}-{uuid.uuid4().hex}.wacz")
                revisit = refers_to is not None
                package.add(record(row_id, url, payload, hashlib.sha1(payload).digest(), refers_to, revisit, date), url, "revisit" if revisit else "response", date)
                if package.zip.at >= file_bytes or len(package.lines) >= file_records:
                    yield listed(package)
                    package = None
        if package is not None:
            yield listed(package)

    def listed(package: Package) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(("path", "bytes", "records"), package.close(), strict=True))])

    rows = decided(pages, id_col, url_col, payload_col, least, few)
    return written_at(rows.mapInArrow(run, "path string, bytes long, records long"), new_dir(pages.sparkSession, "packages"))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and ``bytes`` of the packages in a folder, by Spark's own listing; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.wacz").load(folder).select("path", F.col("length").alias("bytes"))


def index_entries(f, start: int, size: int) -> Iterator[tuple[str, int, int]]:
    """File name, offset and length of each line of an index member, read piece by piece; other lines are passed over."""
    held, at = b"", start
    while at < start + size or held:
        f.seek(at)
        piece = f.read(min(zip_directory.PIECE, start + size - at))
        at += len(piece)
        *lines, held = (held + piece + (b"" if at < start + size else b"\n")).split(b"\n")
        for line in lines:
            brace = line.find(b"{")
            if brace >= 0:
                entry = json.loads(line[brace:])
                yield posixpath.basename(entry["filename"]), int(entry["offset"]), int(entry["length"])
        if at >= start + size:
            return


def ranges(f, length: int, size: int = RANGE) -> Iterator[tuple[int, list[int] | None, list[int]]]:
    """Ranges of a package: where an archive's bytes begin, and where records lie in it with their lengths (None and the archive's length: walk it)."""
    indexes, found = [], {}
    for m in zip_directory.members(f, length):
        name, kind = posixpath.basename(m.name), posixpath.splitext(m.name)[1]
        if kind == ".cdxj" or m.name.endswith((".warc", ".warc.gz")):
            if m.method or m.size != m.stored_size:
                raise ValueError(f"{m.name} is compressed by the package: it has no ranges")
            if kind == ".cdxj":
                indexes.append(m)
            else:
                found[name] = m
    starts, known, held = {n: zip_directory.content_start(f, m) for n, m in found.items()}, set(), {}
    for m in indexes:
        for name, offset, wide in index_entries(f, zip_directory.content_start(f, m), m.size):
            if name not in found:
                raise ValueError(f"the index names {name}, which the package lacks")
            known.add(name)
            offsets, lengths = held.setdefault(name, ([], []))
            offsets.append(offset)
            lengths.append(wide)
            if sum(lengths) >= size or len(lengths) >= ROWS:
                yield (starts[name], *held.pop(name))
    for name, (offsets, lengths) in held.items():
        yield starts[name], offsets, lengths
    for name, m in found.items():
        if name not in known and m.size:
            yield starts[name], None, [m.size]


def walk(f, start: int, size: int) -> Iterator[bytes]:
    """Records of an archive without index, one after the other."""
    at, held = start, b""

    def more(n: int = 1 << 16) -> bytes:
        nonlocal at
        f.seek(at)
        piece = f.read(min(n, start + size - at))
        at += len(piece)
        return piece

    while held or at < start + size:
        held = held or more()
        if held[:2] == b"\x1f\x8b":
            unpack, out = zlib.decompressobj(31), []
            while not unpack.eof:
                if not held and not (held := more()):
                    raise ValueError("an archive that ends inside a record")
                out.append(unpack.decompress(held))
                held = unpack.unused_data
            yield b"".join(out)
            continue
        while b"\r\n\r\n" not in held and (piece := more()):
            held += piece
        top = held.find(b"\r\n\r\n")
        if top < 0:
            if held.strip():
                raise ValueError("an archive that ends inside a record's head")
            return
        wide = top + 4 + int(dict(lines(held[:top]))["content-length"]) + 4
        parts, have = [held], len(held)
        while have < wide and (piece := more(max(wide - have, 1 << 16))):
            parts.append(piece)
            have += len(piece)
        held = b"".join(parts)
        yield held[:wide]
        held = held[wide:]


def lines(block: bytes) -> list[tuple[str, str]]:
    out = []
    for line in block.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if colon:
            out.append((name.strip().lower(), value.strip()))
    return out


def parsed(content: bytes) -> tuple[tuple, bytes | None]:
    """A record's columns (as ``RECORD``) and payload; other kinds of records give their type and no payload."""
    if not content.startswith(b"WARC/1."):
        raise ValueError("no WARC record here")
    top = content.find(b"\r\n\r\n")
    fields = dict(lines(content[:top]))
    block = content[top + 4 : top + 4 + int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("a record that ends too soon")
    own, refers_to = (None if i is None else unquote(i) for i in (urn(fields.get("warc-record-id")), urn(fields.get("warc-refers-to"))))
    kind, url = fields["warc-type"], fields.get("warc-target-uri")
    if kind not in ("response", "revisit"):
        return (own, kind, url, None, None, refers_to, None), None
    split = block.find(b"\r\n\r\n")
    answer, payload = dict(lines(block[:split])), block[split + 4 :]
    said = hex_digest(fields.get("warc-payload-digest"))
    if kind == "revisit":
        wide = answer.get("content-length")
        return (own, kind, url, None if wide is None else int(wide), said, refers_to, None), None
    digest = hashlib.sha1(payload).hexdigest()
    return (own, kind, url, len(payload), digest, None, "payload and digest differ" if said not in (None, digest) else None), payload


def urn(value: str | None) -> str | None:
    """The row id in a record id; a record of another writer keeps its whole id."""
    if value is None:
        return None
    inner = value.strip("<>")
    if not inner.startswith(ID):
        return inner
    return inner[len(ID) + 1 :] if inner.startswith(f"{ID}=") else None


def hex_digest(said: str | None) -> str | None:
    kind, _, value = (said or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return base64.b32decode(value.upper()).hex() if len(value) == 32 else value.lower()


def contents(f, start: int, offsets: list[int] | None, lengths: list[int]) -> Iterator[bytes | ValueError]:
    """The records of one range; what cannot be read is given as its error."""
    if offsets is None:
        try:
            yield from walk(f, start, lengths[0])
        except (ValueError, KeyError, zlib.error) as e:
            yield ValueError(str(e))
        return
    # records side by side are read at once
    order = sorted(range(len(offsets)), key=offsets.__getitem__)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and offsets[order[to]] == offsets[order[to - 1]] + lengths[order[to - 1]]:
            to += 1
        first = offsets[order[at]]
        f.seek(start + first)
        data = f.read(offsets[order[to - 1]] + lengths[order[to - 1]] - first)
        for i in order[at:to]:
            raw = data[offsets[i] - first : offsets[i] - first + lengths[i]]
            try:
                yield zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
            except zlib.error as e:
                yield ValueError(str(e))
        at = to


def read_archives(packages: DataFrame, payload: bool = True, task_bytes: int = TASK_BYTES, range_bytes: int = RANGE) -> DataFrame:
    """All records of ``packages`` (``path`` and ``bytes``): the columns of ``RECORD``, and ``payload`` of responses as bytes if asked for."""
    spark = packages.sparkSession
    total = packages.agg(F.sum("bytes")).first()[0]
    schema = RECORD + (", payload binary" if payload else "")
    names = [part.split()[0] for part in schema.split(", ")]
    if not total:
        return spark.createDataFrame([], schema)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = opened(path)
                with where.open_input_file(name) as f:
                    for start, offsets, lengths in ranges(f, f.size(), range_bytes):
                        yield pa.RecordBatch.from_pydict({"path": [path], "start": [start], "offsets": pa.array([offsets], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for path, start, offsets, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                where, name = opened(path)
                with where.open_input_file(name) as f:
                    for content in contents(f, start, offsets, lengths):
                        row = read_one(content)
                        held.append(row)
                        size += len(row[-1] or b"") if payload else 0
                        if size >= range_bytes or len(held) >= ROWS:
                            yield out(held)
                            held, size = [], 0
            if held:
                yield out(held)

    def read_one(content: bytes | ValueError) -> tuple:
        try:
            if isinstance(content, ValueError):
                raise content
            columns, body = parsed(content)
        except (ValueError, KeyError) as e:
            columns, body = (None, None, None, None, None, None, f"{type(e).__name__}: {e}"), None
        return (*columns, body) if payload else columns

    def out(held: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=False)], names)

    tasks = max(-(-total // task_bytes), spark.sparkContext.defaultParallelism)
    found = packages.select("path").repartition(tasks).mapInArrow(locate, "path string, start long, offsets array<long>, lengths array<long>")
    return found.repartition(tasks).mapInArrow(fetch, schema)
