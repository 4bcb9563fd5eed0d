"""Vector codes by Elkan's Lloyd rounds (operator 12): exact product codebooks in whole numbers.

A vector is cut into ``parts`` equal pieces; each piece position has a codebook
of ``entries``.  Every vector keeps, for each part, its entry, an upper bound of
the distance to it, and a lower bound of the distance to *every* entry.  A round
moves the bounds by how far entries moved (an upper one by its own entry's move,
a lower one by its entry's), then an entry is looked at only where neither

    upper < lower bound of that entry, nor
    upper < half the way from the own entry to that entry

holds *strictly*; the upper bound is first made exact.  What is left is decided by
exact squared distances in 64-bit whole numbers, ties to the lower index, so no
tie is pruned and no rounding decides.

Bounds are stored rounded outwards, upper ones as 4-byte and lower ones as 2-byte
floats, in one binary each: 2 bytes x entries x parts a row (2 KB for 16 x 64)
in the shared folder between rounds, which is what Elkan's method costs.  The
table of a round is removed when the next is written, and the last assignment
writes none.  A task sums its pieces by part and entry before anything is
shuffled; the driver holds the codebooks and their sums.

Defined results: null vectors and those with null or non-finite components take no
part, nor do those of another length than the commonest that ``parts`` divides
(ties: the shorter); rows with null id are coded but seed nothing; rows that
repeat an id or a vector each count, and seed in order of (id, vector); fewer rows
than ``entries`` seed fewer entries; other columns are ignored, whatever their
names; an empty table gives an empty one.  Components of 2**19 and more are an
error, as their distances would not fit the result's type.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mudline.llm.int_vectors import EPS, SCALE, above, all_squared, below, integer_rows, matrix, means, sound, squared
from mudline.llm.shared import discard, new_dir, written_at

#: Rows that a task works on at a time: their bounds are what it holds.
ROWS = 2048
STATE = "v array<int>, codes binary, upper binary, lower binary, measured long"


def rounded_up(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        y = x.astype(np.float32)
    return np.where(y.astype(np.float64) < x, np.nextafter(y, np.float32(np.inf)), y)


def rounded_down(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, 0, float(np.finfo(np.float16).max))
    y = x.astype(np.float16)
    return np.where(y.astype(np.float64) > x, np.nextafter(y, np.float16(0)), y)


class Codebook:
    """The entries of one part, half the ways between them, and how far the last round moved each."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.c = entries
        self.half = below(all_squared(entries, entries)) / 2
        np.fill_diagonal(self.half, np.inf)
        self.near = self.half.min(1)
        self.move = above(squared(entries, before)) if before is not None else np.zeros(len(entries))

    def everywhere(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries, upper bounds and lower bounds of pieces that have none yet."""
        d = all_squared(x, self.c)
        code = d.argmin(1)
        return code, above(d[np.arange(len(x)), code]), below(d)

    def step(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Shifts the bounds and assigns anew, all in place; returns how many entries each piece measured."""
        upper[:] = (upper + self.move[code]) * (1 + EPS)
        lower[:] = np.maximum(lower - self.move - EPS * (lower + self.move), 0)
        measured = np.zeros(len(x), np.int64)
        rows = np.flatnonzero(~(upper < self.near[code]))
        open_ = self.candidates(rows, code, upper, lower)
        rows = rows[open_.any(1)]
        if not rows.size:
            return measured
        own, exact = code[rows], squared(x[rows], self.c[code[rows]])
        measured[rows] += 1
        upper[rows], lower[rows, own] = above(exact), below(exact)
        open_ = self.candidates(rows, code, upper, lower)
        at, entry = np.nonzero(open_)  # by row, entries ascending
        if not at.size:
            return measured
        d = squared(x[rows[at]], self.c[entry])
        lower[rows[at], entry] = below(d)
        measured[rows] += open_.sum(1)
        begin = np.flatnonzero(np.append(True, np.diff(at) != 0))
        least = np.minimum.reduceat(d, begin)
        ties = np.where(d == np.repeat(least, np.diff(np.append(begin, len(at)))), entry, len(self.c))
        winner, who = np.minimum.reduceat(ties, begin), at[begin]
        wins = (least < exact[who]) | ((least == exact[who]) & (winner < own[who]))
        code[rows[who[wins]]], upper[rows[who[wins]]] = winner[wins], above(least[wins])
        return measured

    def candidates(self, rows: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Entries that no strict inequality rules out; never the own one, whose half way counts as infinite."""
        u = upper[rows, None]
        return ~(u < lower[rows]) & ~(u < self.half[code[rows]])


def as_binary(x: np.ndarray) -> pa.Array:
    """Rows of ``x`` as one binary each."""
    wide = x.itemsize * int(np.prod(x.shape[1:]))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def from_binary(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def coded(state: DataFrame, books: list[Codebook], first: bool, last: bool) -> DataFrame:
    """One assignment; ``first``: rows carry no bounds yet; ``last``: codes and errors instead of bounds."""
    row_type = state.schema["row"].dataType.simpleString()
    parts, entries, wide = len(books), len(books[0].c), books[0].c.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            x = matrix(b.column("v"), parts * wide).reshape(-1, parts, wide)
            if first:
                found = [book.everywhere(x[:, p]) for p, book in enumerate(books)]
                code, upper, lower = (np.stack(f, axis=1) for f in zip(*found, strict=True))
                measured = np.full(len(x), parts * entries, np.int64)
            else:
                code = from_binary(b.column("codes"), "u1", parts).astype(np.int64)
                upper = from_binary(b.column("upper"), "<f4", parts).astype(np.float64)
                lower = from_binary(b.column("lower"), "<f2", parts, entries).astype(np.float64)
                measured = np.array(b.column("measured"))
                for p, book in enumerate(books):
                    measured = measured + book.step(x[:, p], code[:, p], upper[:, p], lower[:, p])
            if last:
                error = sum(squared(x[:, p], book.c[code[:, p]]) for p, book in enumerate(books))
                yield pa.RecordBatch.from_arrays([b.column("row"), as_binary(code.astype("u1")), pa.array(error), pa.array(measured)], ["row", "codes", "error", "measured"])
            else:
                columns = [b.column("row"), b.column("v"), as_binary(code.astype("u1")), as_binary(rounded_up(upper).astype("<f4")), as_binary(rounded_down(lower).astype("<f2")), pa.array(measured)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "v", "codes", "upper", "lower", "measured"])

    return state.mapInArrow(run, f"row {row_type}, " + ("codes binary, error long, measured long" if last else STATE))


def summed(state: DataFrame, parts: int, entries: int, wide: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and counts of the pieces of each part and entry; a task sends a row for each at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, wide), np.int64), np.zeros(parts * entries, np.int64)
        for b in small(batches):
            x = matrix(b.column("v"), parts * wide).reshape(-1, wide)
            slot = (from_binary(b.column("codes"), "u1", parts).astype(np.int64) + np.arange(parts) * entries).ravel()
            order = np.argsort(slot, kind="stable")
            there, begin = np.unique(slot[order], return_index=True)
            if len(there):
                total[there] += np.add.reduceat(x[order], begin, axis=0)
            count += np.bincount(slot, minlength=parts * entries)
        there = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(count[there]), pa.array(total[there].tolist(), pa.list_(pa.int64()))], ["slot", "n", "total"])

    sums = state.select("v", "codes").mapInArrow(run, "slot int, n long, total array<long>")
    rows = sums.groupBy("slot").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(wide)]).alias("total")).collect()
    total, count = np.zeros((parts * entries, wide), np.int64), np.zeros(parts * entries, np.int64)
    for r in rows:
        total[r.slot], count[r.slot] = r.total, r.n
    return total.reshape(parts, entries, wide), count.reshape(parts, entries)


def common_length(rows: DataFrame, vector_col: str, parts: int) -> int | None:
    """The commonest length of sound vectors that ``parts`` divides; of equally common ones the shortest."""
    n = F.size(F.col(f"`{vector_col}`"))
    lengths = rows.filter(sound(vector_col) & (n > 0) & (n % parts == 0)).groupBy(n.alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return lengths[0].n if lengths else None


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", parts: int = 16, entries: int = 64, rounds: int = 2, keep: tuple[str, ...] = ()) -> tuple[DataFrame, np.ndarray]:
    """``rows`` coded: ``row`` (``id_col`` and the columns ``keep``), ``codes`` (a byte a part), ``error`` (squared) and ``measured``, and the codebooks (parts, entries, components)."""
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte: at most 256 entries")
    spark = rows.sparkSession
    kept = list(dict.fromkeys([id_col, *keep]))
    dim = common_length(rows, vector_col, parts)
    vectors = integer_rows(rows, kept, vector_col, dim or parts)
    seed = F.col(f"row.`{id_col}`")
    seeds = vectors.filter(seed.isNotNull()).orderBy(seed, "v").limit(entries).select("v").collect() if dim else []
    if not seeds:
        none = vectors.limit(0).select("row", F.lit(b"").alias("codes"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("measured"))
        return none, np.zeros((parts, 0, 0), np.int64)
    books = np.array([r.v for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2)
    before, state, old = None, vectors, None
    for n in range(rounds):
        path = new_dir(spark, "elkan")
        state = written_at(coded(state, codebooks(books, before), n == 0, last=False), path)
        if old:
            discard(spark, old)
        before, old = books, path
        books = means(*summed(state, *books.shape), books)
    return coded(state, codebooks(books, before), rounds == 0, last=True), books


def codebooks(books: np.ndarray, before: np.ndarray | None) -> list[Codebook]:
    return [Codebook(book, None if before is None else before[p]) for p, book in enumerate(books)]


def restored(codes: Column, books: np.ndarray) -> Column:
    """The vectors that ``codes`` stand for: the middle of each component's cell."""
    middles = F.lit(((books + 0.5) / SCALE).tolist())
    parts = F.sequence(F.lit(1), F.lit(len(books)))
    entry = lambda p: F.conv(F.hex(F.substring(codes, p, F.lit(1))), 16, 10).cast("int") + 1
    return F.flatten(F.transform(parts, lambda p: F.element_at(F.element_at(middles, p), entry(p))))


def digest(books: np.ndarray) -> str:
    """The sha256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
