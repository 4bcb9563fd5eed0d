"""Token ids in word-aligned binary files (operator 3): Simple-8b with escapes and block offsets.

A file is little-endian and self-contained:

    magic ``S8BTOK1\\n``, then u64: documents, ids, table size, blocks, words, escapes, partition, ids before in the partition
    i64 doc_id[documents], u8 doc_id is null[documents], u64 count[documents]
    u32 table[table size]     ids of the file, most frequent first; the words hold places in this table
    u64 first_word[blocks+1]  where each block of ``BLOCK`` ids begins, so that blocks can be decoded alone or all at once
    u64 word[words]           4 bits of selector, 60 bits of places (lowest bits first)
    u64 escape[escapes]       values over 60 bits; a word with selector 15 holds its number here

Files are written in ascending doc_id order (null ids first): the documents are
range-partitioned, sorted inside partitions, and each task writes whole files
under names that depend on the partition only, first under a temporary name and
then renamed, so a repeated or speculative task leaves the same files.

Defined results: null and empty texts hold the end id only; rows that repeat an id
stand side by side, in order of their texts' hashes, and each keeps its place,
however many are equal; a
very long text is one row, in one file; ids that are no integers are an error;
other columns are ignored; an empty table writes no files and reads back empty.
``folder`` is one that pyarrow opens, as the shared folder of a cluster is.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mudline.llm import bpe
from mudline.llm.batches import by_bytes, gather_spans
from mudline.llm.shared import tasks_for

MAGIC = b"S8BTOK1\n"
BLOCK = 256
IDS_PER_FILE = 8_000_000
#: Ids in a word and bits of each, by selector 0 to 14; 15 is the escape.
COUNTS = np.array([120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 15


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned value needs (exact over all 64 bits)."""
    high = values >> np.uint64(32)
    low = np.frexp((values & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]
    return (np.where(high > 0, np.frexp(high.astype(np.float64))[1] + 32, low) if high.any() else low).astype(np.int8)


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of each block (and the end), escapes, of u64 values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.uint64), np.zeros(0, np.uint64)
    # past a block's end everything fits
    need = np.zeros((blocks, BLOCK + int(COUNTS[0])), np.int8)
    flat = np.zeros(blocks * BLOCK, np.int8)
    flat[:n] = widths(values)
    need[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    # widest id of the 1, 2, 4 ... ids from each place on; two such spans make any other length
    spans = {1: need}
    for size in (2, 4, 8, 16, 32, 64):
        half = spans[size // 2]
        spans[size] = np.maximum(half[:, : -(size // 2)], half[:, size // 2 :])
    # the densest selector whose next ids all fit
    choice = np.full((blocks, BLOCK), ESCAPE, np.int8)
    for s in range(ESCAPE - 1, -1, -1):
        size = 1 << (int(COUNTS[s]).bit_length() - 1)
        shift = int(COUNTS[s]) - size
        widest = np.maximum(spans[size][:, :BLOCK], spans[size][:, shift : shift + BLOCK])
        np.putmask(choice, widest <= BITS[s], np.int8(s))
    at, live, picked = np.zeros(blocks, np.int64), np.arange(blocks), []
    sizes = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
    while live.size:
        s = choice[live, at[live]]
        picked.append(np.stack([live, at[live], s.astype(np.int64)]))
        at[live] += COUNTS[s]
        live = live[at[live] < sizes[live]]
    row, col, sel = np.concatenate(picked, axis=1)
    order = np.lexsort((col, row))
    row, col, sel = row[order], col[order], sel[order]
    padded = np.zeros(blocks * BLOCK + int(COUNTS[0]), np.uint64)
    padded[:n] = values
    begin = row * BLOCK + col
    stop = np.minimum((row + 1) * BLOCK, n)
    words = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        if BITS[s] == 0:
            continue
        at_s = np.flatnonzero(sel == s)
        if s == ESCAPE:
            words[at_s] |= np.arange(len(at_s), dtype=np.uint64)
            continue
        for k in range(COUNTS[s]):
            place = begin[at_s] + k
            words[at_s] |= np.where(place < stop[at_s], padded[place], np.uint64(0)) << np.uint64(k * BITS[s])
    escapes = values[begin[sel == ESCAPE]]
    return words, np.searchsorted(row, np.arange(blocks + 1)).astype(np.uint64), escapes


def unpack(words: np.ndarray, first_word: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The values of ``pack``; all blocks at once, no loop over words."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[sel]
    block = np.repeat(np.arange(len(first_word) - 1), np.diff(first_word.astype(np.int64)))
    before = np.cumsum(counts) - counts
    begin = block * BLOCK + before - before[first_word[:-1].astype(np.int64)][block] if len(words) else before
    out = np.zeros(n, np.uint64)
    stop = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(sel):
        if BITS[s] == 0:
            continue
        at = np.flatnonzero(sel == s)
        if s == ESCAPE:
            out[begin[at]] = escapes[(words[at] & np.uint64((1 << 60) - 1)).astype(np.int64)]
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        for k in range(COUNTS[s]):
            place = begin[at] + k
            inside = place < stop[at]
            out[place[inside]] = (words[at[inside]] >> np.uint64(k * BITS[s])) & mask
    return out


def to_file(doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray, partition: int, before: int) -> bytes:
    """One file's bytes."""
    seen = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    table = np.argsort(-seen, kind="stable")[: int((seen > 0).sum())].astype(np.uint32)
    place = np.zeros(len(seen), np.uint64)
    place[table] = np.arange(len(table), dtype=np.uint64)
    words, first, escapes = pack(place[ids] if len(ids) else np.zeros(0, np.uint64))
    head = np.array([len(doc_ids), len(ids), len(table), len(first) - 1, len(words), len(escapes), partition, before], "<u8")
    parts = (head, doc_ids.astype("<i8"), nulls.astype("u1"), counts.astype("<u8"), table.astype("<u4"), first.astype("<u8"), words.astype("<u8"), escapes.astype("<u8"))
    return MAGIC + b"".join(p.tobytes() for p in parts)


def from_file(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int, int]:
    """doc ids, nulls, counts, ids, partition and ids before in the partition."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    head = np.frombuffer(content, "<u8", 8, 8).astype(np.int64)
    docs, n, size, blocks, n_words, n_escapes, partition, before = head.tolist()
    at, got = 72, []
    for kind, length in (("<i8", docs), ("u1", docs), ("<u8", docs), ("<u4", size), ("<u8", blocks + 1), ("<u8", n_words), ("<u8", n_escapes)):
        got.append(np.frombuffer(content, kind, length, at))
        at += np.dtype(kind).itemsize * length
    doc_ids, nulls, counts, table, first, words, escapes = got
    places = unpack(words, first, escapes, n)
    return doc_ids, nulls.astype(bool), counts.astype(np.int64), table[places.astype(np.int64)] if n else np.zeros(0, np.uint32), partition, before


def put(folder: str, name: str, content: bytes) -> None:
    """Write a file whole: under a temporary name first, then renamed."""
    where, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    where.create_dir(root, recursive=True)
    temporary = posixpath.join(root, f"_{name}.{uuid.uuid4().hex}")
    with where.open_output_stream(temporary) as out:
        out.write(content)
    where.move(temporary, posixpath.join(root, name))


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int | None = 1, ids_per_file: int = IDS_PER_FILE) -> DataFrame:
    """Encode ``docs`` and write their ids to ``folder``; runs at once.

    Returns one row per partition: ``partition``, ``files``, ``n_ids``.
    """
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, partition = bpe.load(path), TaskContext.get().partitionId()
        held: list[tuple] = []
        size = before = files = 0

        def flush() -> None:
            nonlocal held, size, before, files
            content = to_file(*(np.concatenate(x) for x in zip(*held, strict=True)), partition, before)
            put(folder, f"part-{partition:06d}-{files:06d}.s8b", content)
            held, size, before, files = [], 0, before + size, files + 1

        for b in by_bytes(batches, "text"):
            ids, counts = model.encode_texts(b.column(1))
            if end_id is not None:
                ids, counts = with_end(ids, counts, end_id)
            held.append((b.column(0).fill_null(0).to_numpy(zero_copy_only=False), b.column(0).is_null().to_numpy(zero_copy_only=False), counts, ids))
            size += len(ids)
            if size >= ids_per_file:
                flush()
        if held:
            flush()
        yield pa.RecordBatch.from_pydict({"partition": [partition], "files": [files], "n_ids": [before]})

    if docs.schema[id_col].dataType.simpleString() not in ("bigint", "int", "smallint", "tinyint"):
        raise ValueError("token files hold integer ids")
    # by the text's hash too, so that an id that many texts share is dealt to many tasks, and by a number, so that equal rows are
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("place"), F.monotonically_increasing_id().alias("repeat"))
    ordered = rows.repartitionByRange(tasks_for(docs), "id", "place", "repeat").sortWithinPartitions("id", "place").select("id", "text")
    totals = ordered.mapInArrow(run, "partition long, files long, n_ids long").collect()
    return docs.sparkSession.createDataFrame([tuple(r) for r in totals], "partition long, files long, n_ids long")


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each document."""
    out = np.full(len(ids) + len(counts), end_id, ids.dtype)
    out[gather_spans(np.cumsum(counts + 1) - counts - 1, counts)] = ids
    return out, counts + 1


def read_token_files(spark: SparkSession, folder: str, totals: DataFrame, as_bytes: bool = False) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens`` and ``ids`` from files.

    ``totals`` is what the writer returned: a row for each partition, which is
    all that the driver holds.  ``as_bytes``: ids as little-endian unsigned
    32-bit integers instead of an array.
    """
    rows = sorted((r.partition, r.n_ids) for r in totals.collect())
    starts, at = {}, 0
    for partition, n in rows:
        starts[partition], at = at, at + n
    kind = "binary" if as_bytes else "array<long>"
    if not at:
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, ids {kind}")
    bases = spark.sparkContext.broadcast(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                doc_ids, nulls, counts, ids, partition, before = from_file(content.as_buffer().to_pybytes())
                ends = np.cumsum(counts)
                firsts = ends - counts
                for a in range(0, len(doc_ids), 2000):
                    z = min(a + 2000, len(doc_ids))
                    part = ids[firsts[a] : ends[z - 1]]
                    marks = np.append(firsts[a:z] - firsts[a], ends[z - 1] - firsts[a])
                    if as_bytes:
                        held = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer((marks * 4).astype(np.int32)), pa.py_buffer(part.astype("<u4").tobytes())])
                    else:
                        held = pa.ListArray.from_arrays(pa.array(marks.astype(np.int32)), pa.array(part.astype(np.int64)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[a:z], mask=nulls[a:z]), pa.array(bases.value[partition] + before + firsts[a:z]), pa.array(counts[a:z]), held], ["doc_id", "start", "n_tokens", "ids"]
                    )

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.s8b").load(folder).select("content")
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, ids {kind}")
