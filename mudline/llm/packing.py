"""Packing documents into training windows by Karmarkar-Karp differencing (operator 7).

Documents are encoded where they lie.  Full windows are cut off first; what is
left of a document is cut into pieces of at most ``PIECE`` ids, or ``LEVELLER``
ids where the document's count is a multiple of ``LEVEL_EVERY``: a few small
pieces let differencing level the windows.  Only the piece table (no ids) is shuffled: pieces are dealt by a hash of their place into
groups of about ``GROUP_WINDOWS`` windows.  In a group, partial partitions with
the widest imbalances are merged with opposing order, largest sum against
smallest, until one partition is left, which gives near-equal windows.  The
window count starts at the least possible and rises whenever a window exceeds
the capacity.

Defined results: null and empty texts are one piece that holds the end id;
repeated rows each get pieces of their own; partitions that differ by the same are
merged in order of their pieces, so a group packs alike each time; a very long text
is cut into pieces of one window at most; other columns are ignored, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mudline.llm import bpe
from mudline.llm.batches import by_bytes
from mudline.llm.shared import written
from mudline.llm.token_files import with_end

WINDOW = 2048
PIECE = 512
LEVELLER = 64
LEVEL_EVERY = 16
GROUP_WINDOWS = 192


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into ``k`` sets of near-equal sums: largest differencing method.

    A partial partition keeps only its sums above its smallest one, in falling
    order; places that are not listed stand for that smallest sum.
    """
    heap = [(-size, i, 0, [(size, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    stamp = len(sizes)
    while len(heap) > 1:
        _, _, base_a, a = heapq.heappop(heap)
        _, _, base_b, b = heapq.heappop(heap)
        # the largest of one side meet the places of the other's smallest
        over = len(a) + len(b) - k
        if over <= 0:
            merged = a + b
        else:
            head, tail = a[: len(a) - over], a[len(a) - over :]
            keep, meet = b[: len(b) - over], b[len(b) - over :]
            merged = head + keep + [(x + y, (p, q)) for (x, p), (y, q) in zip(tail, reversed(meet), strict=True)]
        merged.sort(key=lambda e: -e[0])
        low = merged[-1][0] if len(merged) == k else 0
        if low:
            merged = [(x - low, p) for x, p in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == k else 0)
        stamp += 1
        heapq.heappush(heap, (-spread, stamp, base_a + base_b + low, merged))
    sets = []
    for _, node in heap[0][3] if heap else []:
        items, stack = [], [node]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                items.append(x)
        sets.append(sorted(items))
    return sets


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Sets of items within ``capacity``; as few windows as differencing reaches."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in s) <= capacity for s in sets):
            return sets
        k += max(1, k // 100)


def pieces_of(counts: np.ndarray, window: int, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of each piece of documents with ``counts`` ids."""
    full, rest = np.divmod(counts, window)
    piece = np.where(counts % LEVEL_EVERY == 0, min(LEVELLER, piece), piece)
    small = -(-rest // piece)
    n = full + small
    row = np.repeat(np.arange(len(counts)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    is_full = k < full[row]
    j = k - full[row]
    # near-equal small pieces rather than a full one and a crumb
    size, more = np.divmod(rest, np.maximum(small, 1))
    start = np.where(is_full, k * window, full[row] * window + j * size[row] + np.minimum(j, more[row]))
    return row, start, np.where(is_full, window, size[row] + (j < more[row]))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, window: int = WINDOW, piece: int = PIECE, end_id: int = 1, group_windows: int = GROUP_WINDOWS) -> DataFrame:
    """A row per piece: ``id_col``, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = path or bpe.default_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe.load(path)
        for b in by_bytes(batches, "text"):
            ids, counts = with_end(*model.encode_texts(b.column(1)), end_id)
            row, start, length = pieces_of(counts, window, piece)
            raw = memoryview(ids.astype("<u4").tobytes())
            first = (np.cumsum(counts) - counts)[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip(first.tolist(), (first + length).tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[row])], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "place"], ascending=[False, True], ignore_index=True)
        whole = int((pdf.length == window).sum())
        number, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        number[:whole] = np.arange(whole)
        sizes = pdf.length.to_numpy()[whole:]
        for w, items in enumerate(windows(sizes.tolist(), window)):
            at = np.array(items)
            number[whole + at] = whole + w
            offset[whole + at] = np.cumsum(sizes[at]) - sizes[at]
        return pd.DataFrame({"id": pdf.id, "start": pdf.start, "length": pdf.length, "ids_crc32": pdf.ids_crc32, "doc_tokens": pdf.doc_tokens, "sequence_id": pdf.piece_group * (1 << 32) + number, "offset": offset})

    kind = docs.schema[id_col].dataType.simpleString()
    table = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    cut_docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, table)
    # the row's place makes repeated rows fall into different groups; writing the table fixes it
    pieces = written(cut_docs.withColumn("place", F.monotonically_increasing_id()), "pieces")
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (window * group_windows)))
    dealt = pieces.withColumn("piece_group", F.pmod(F.xxhash64("place"), F.lit(groups)))
    return dealt.groupBy("piece_group").applyInPandas(fill, f"{table}, sequence_id long, offset long").withColumnRenamed("id", id_col)
