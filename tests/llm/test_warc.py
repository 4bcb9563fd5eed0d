"""Packages against the standard library's ZIP and gzip, and archives written by other hands; records of every page once."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mudline.llm import queries, shared, warc_archive, zip_directory

SCHEMA = "page_id long, url string, html string, payload string, same string, id string"


def package(parts, full=zip_directory.FULL32):
    out = io.BytesIO()
    z = zip_directory.StoredWriter(out, full)
    for name, content in parts:
        z.begin(name)
        z.write(content[: len(content) // 2])
        z.write(content[len(content) // 2 :])
        z.end()
    z.close()
    return out.getvalue()


@pytest.mark.parametrize("full", [zip_directory.FULL32, 5])
def test_written_packages_are_zip_files(full):
    parts = [("archive/data.warc.gz", b"abc" * 1000), ("indexes/index.cdxj", b""), ("naïve.txt", "ü".encode())]
    data = package(parts, full)
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and [(i.filename, z.read(i)) for i in z.infolist()] == parts
    for before in (b"", b"#!/bin/sh\nexit\n" * 9):
        f = io.BytesIO(before + data)
        got = list(zip_directory.members(f, len(before) + len(data)))
        assert [m.name for m in got] == [n for n, _ in parts]
        for m, (_, content) in zip(got, parts, strict=True):
            start = zip_directory.content_start(f, m)
            assert f.getvalue()[start : start + m.size] == content


def test_reads_packages_of_the_standard_library_with_comment_zip64_and_many_members():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.comment = zip_directory.END + b" a comment that looks like an end" * 9
        for i in range(66_000):
            z.writestr(f"m{i}", str(i))
    f = out.getvalue()
    got = list(zip_directory.members(io.BytesIO(f), len(f)))
    assert len(got) == 66_000 and got[65_999].name == "m65999"
    start = zip_directory.content_start(io.BytesIO(f), got[65_999])
    assert f[start : start + 5] == b"65999"
    # a size beyond 32 bits, in the directory alone
    extra = struct.pack("<HHQQQ", 1, 24, 1 << 40, 1 << 40, 1 << 41)
    assert zip_directory.wide(b"\x09\x00\x02\x00xx" + extra, zip_directory.FULL32, zip_directory.FULL32, zip_directory.FULL32) == [1 << 40, 1 << 40, 1 << 41]


@pytest.mark.parametrize("broken", [b"", b"PK", b"x" * 100, package([("a", b"b")])[:-1], package([("a", b"b")])[40:]])
def test_broken_packages_are_errors(broken):
    with pytest.raises(ValueError, match="ZIP|local header"):
        for m in zip_directory.members(io.BytesIO(broken), len(broken)):
            zip_directory.content_start(io.BytesIO(broken), m)


def pages():
    long, longer = "ä" * 500, "long text " * 40_000
    return [
        (1, "http://a/1", long, "p", "s", "i"), (2, "http://a/2", long, "p", "s", "i"), (3, None, long, "p", "s", "i"), (3, "http://again", long, "p", "s", "i"), (4, "http://a b\r\nc", "x" * 999, "p", "s", "i"),
        (5, "http://a/5", "x" * 999, "p", "s", "i"), (6, "", "", "p", "s", "i"), (7, "u", None, "p", "s", "i"), (None, "u", long, "p", "s", "i"), (None, "u", "y" * 2000, "p", "s", "i"), (8, "u", longer, "p", "s", "i"),
        (-9, "u", longer, "p", "s", "i"), (10, "u", "\r\n\r\nWARC/1.1\r\n" * 100, "p", "s", "i"),
    ]


def wanted(rows):
    last = {}
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        if len(raw) >= 1000:
            last[raw] = max((x for x in (last.get(raw), i) if x is not None), default=None)
    out = Counter()
    for i, _, html, *_ in rows:
        raw = (html or "").encode()
        top = last.get(raw)
        revisit = top is not None and i != top
        out[(i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", top if revisit else None)] += 1
    return out


@pytest.mark.parametrize("few", [None, 0])
def test_records_of_odd_pages(spark, tmp_path, few):
    rows = pages()
    listed = warc_archive.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(2), str(tmp_path), file_records=3, few=few)
    assert listed.agg(F.sum("records")).first()[0] == len(rows) and listed.count() >= 5
    got = warc_archive.read_archives(listed, range_bytes=500).collect()
    found = Counter((None if r.record_id is None else int(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, None if r.refers_to is None else int(r.refers_to)) for r in got)
    assert found == wanted(rows) and not any(r.damage for r in got)
    payloads = {hashlib.sha1((h or "").encode()).hexdigest(): (h or "").encode() for _, _, h, *_ in rows}
    assert all(r.payload is None if r.record_type == "revisit" else bytes(r.payload) == payloads[r.payload_digest] for r in got)
    assert {r.url for r in got} >= {None, "http://a%20b%0D%0Ac", "http://a/1"}
    again = warc_archive.read_archives(warc_archive.archives(spark, str(tmp_path)), payload=False)
    assert again.count() == len(rows) and "payload" not in again.columns


def test_empty_table(spark, tmp_path):
    listed = warc_archive.write_archives(spark.createDataFrame([], SCHEMA), str(tmp_path))
    assert listed.count() == 0 and warc_archive.read_archives(listed).count() == 0


def foreign(kind, body, extra=""):
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{len(body)}>\r\n{extra}WARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def read(spark, path, **more):
    return warc_archive.read_archives(spark.createDataFrame([(str(path), path.stat().st_size)], "path string, bytes long"), **more).collect()


@pytest.mark.parametrize("name", ["archive/x.warc.gz", "archive/x.warc"])
def test_archives_without_index_are_walked(spark, tmp_path, name):
    bodies = [b"one", b"two\r\n\r\nWARC/1.0" * 9000, b"", bytes(range(256)) * 700]
    records = [foreign("response", b) for b in bodies] + [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"]
    data = b"".join(gzip.compress(r) if name.endswith("gz") else r for r in records)
    path = tmp_path / "p.wacz"
    path.write_bytes(package([(name, data), ("pages/pages.jsonl", b"{}")]))
    got = read(spark, path)
    assert [bytes(r.payload) for r in got if r.record_type == "response"] == bodies
    assert [r.record_type for r in got][-1] == "warcinfo" and got[0].record_id == "urn:uuid:3"


def test_index_in_any_order_and_damage(spark, tmp_path):
    good, bad = foreign("response", b"fine"), foreign("response", b"fine").replace(b"\r\n\r\nfine", b"\r\n\r\nf!ne")
    parts = [gzip.compress(good), gzip.compress(bad), b"\x1f\x8bnonsense", good[:-10], b"hello"]
    ends = [sum(map(len, parts[: i + 1])) for i in range(len(parts))]
    lines = [json.dumps({"offset": e - len(p), "length": len(p), "filename": "d/x.warc.gz"}) for p, e in zip(parts, ends, strict=True)]
    index = "!meta x\n" + "\n".join(f"k{i} 2020 {line}" for i, line in reversed(list(enumerate(lines))))
    path = tmp_path / "p.wacz"
    path.write_bytes(package([("archive/x.warc.gz", b"".join(parts)), ("indexes/index.cdxj", index.encode())]))
    for size in (1, 1 << 20):
        got = read(spark, path, range_bytes=size)
        assert Counter(r.damage is None for r in got) == {True: 1, False: 4}
        assert sum("differ" in (r.damage or "") for r in got) == 1


def test_members_that_the_package_compresses_are_errors(spark, tmp_path):
    path = tmp_path / "p.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/x.warc", foreign("response", b"a" * 5000))
    with pytest.raises(Exception, match="compressed by the package"):
        read(spark, path)


def test_query_over_copies(spark, tmp_path):
    rows = [(i, f"u{i}", "copy " * 300 if i % 3 else f"own {i} " * (i % 400), "", "", "") for i in range(600)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in queries.op13_warc_packages(spark, str(tmp_path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
    assert got == wanted(rows)


@pytest.mark.parametrize("few", [0, 3, 100])
def test_attach_by_any_way(spark, tmp_path, few):
    rows = spark.createDataFrame([(f"k{i % 7}" if i % 5 else None, i) for i in range(500)] + [("hot", i) for i in range(500, 900)], "key string, i long")
    groups = rows.filter("key IS NOT NULL AND key <> 'k6'").groupBy("key").agg(F.count("*").alias("n"), F.max("i").alias("last"))
    groups.write.parquet(f"{tmp_path}/groups")
    got = sorted(tuple(r) for r in shared.attach(rows, spark.read.parquet(f"{tmp_path}/groups"), "key", few).select("i", F.coalesce("key", F.lit("")), "n", "last").na.fill(-1).collect())
    assert got == sorted(tuple(r) for r in rows.join(groups, "key", "left").select("i", F.coalesce("key", F.lit("")), "n", "last").na.fill(-1).collect())
