"""SimHash near-duplicates by the generalised pigeonhole principle (operator 6).

Fingerprints come from word shingles, hashed with XXH64.  Equal fingerprints
collapse to one row first, so a large group of copies costs one row.  Over the
distinct ones:

1. Bits are put into ``PARTS`` partitions, correlated bits together, from the
   bit-by-bit counts of all fingerprints.
2. Unequal thresholds t (-1: not probed) are allotted to the partitions by
   dynamic programming, with sum of (t + 1) = distance + 1, at the least
   estimated count of candidates and probe keys.  By the general pigeonhole
   principle two fingerprints within the distance are within t in one partition.
3. A partition with threshold t is probed with its value under every mask that
   leaves out t bits.  Fingerprints that share mask and value are candidates and
   are verified on all 64 bits.
4. A bucket over its limit of fingerprints is not compared pair by pair: its
   members agree under the mask, so the bits left are split again and each
   member probes the finer masks, until buckets are small.  This is exact: with
   9 bits left a bucket holds 512 distinct fingerprints at most.

A bucket yields links that span its linked groups, not all its pairs.

Defined results: texts without a word (null, empty, white space) have
fingerprint zero and are linked with each other; repeated rows share a
component; rows without id get the component of their fingerprint; a bit that half
of the hashes set, a tie, is 0; very long texts are hashed whole, one at a time
where they are longer than a batch; other columns are ignored, whatever their
names; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mudline.llm.batches import by_bytes
from mudline.llm.components import connected_components
from mudline.llm.shared import written

SHINGLE = 3
DISTANCE = 2
PARTS = 3
BUCKET = 512
SEED = 42
#: Bits left open from which a hot bucket's masks leave out ``distance`` of them rather than split them again.
OPEN_BITS = 20
#: Near copies for deduplication: shingles of five words, similar to 0.8 or more.
STAGE_SHINGLE = 5


def majority(hashes: bytes, width: int) -> bytes:
    """Bits set in over half of the hashes of ``width`` bytes each."""
    raw = np.frombuffer(hashes, np.uint8).reshape(-1, width)
    ones = np.zeros(8 * width, np.int64)
    for part in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[part : part + (1 << 16)], axis=1).sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(raw)).tobytes()


def shingles(words: list[bytes], n: int) -> list[bytes]:
    """Runs of ``n`` words joined by spaces, repeats included; all words where there are fewer."""
    joined = b" ".join(words)
    if len(words) <= n:
        return [joined]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return [joined[a:z] for a, z in zip((ends - sizes)[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """Eight bytes, highest bit first, of a text's word shingles; zero without a word."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_digest
    return majority(b"".join([digest(s, SEED) for s in shingles(words, shingle)]), 8) if words else bytes(8)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id_col`` and ``fp`` (the fingerprint as a signed long) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            raw = b"".join(fingerprint(t, shingle) for t in b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {kind}, fp long").withColumnRenamed("id", id_col)


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how often bits i and j are both set: 64 x 64 sums, added up in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((64, 64))
        for b in batches:
            bits = np.unpackbits(b.column(0).to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            n += len(bits)
            both += bits.T @ bits
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, 4096)), pa.array(np.concatenate([[n], both.ravel()]))], ["place", "n"])

    out = np.zeros(4097)
    for r in fps.select("fp").mapInArrow(run, "place long, n double").groupBy("place").agg(F.sum("n").alias("n")).collect():
        out[r.place + 1] = r.n
    return int(out[0]), out[1:].reshape(64, 64)


def group_bits(n: int, both: np.ndarray, parts: int = PARTS) -> list[list[int]]:
    """Bits (0: highest) in partitions of near-equal width, correlated ones together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    link = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(link, 0)
    left, out = list(range(64)), []
    for k in range(parts):
        width = len(left) // (parts - k)
        group = [max(left, key=lambda b: link[b, left].sum())]
        left.remove(group[0])
        while len(group) < width:
            best = max(left, key=lambda b: link[b, group].mean())
            group.append(best)
            left.remove(best)
        out.append(sorted(group))
    return out


def allot(costs: list[list[float]], distance: int = DISTANCE) -> list[int]:
    """Thresholds t_i >= -1 with sum (t_i + 1) = distance + 1 of least total cost; costs[i][t + 1]."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for part in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, picked) in best.items():
            for t1 in range(distance + 2 - used):
                entry = (cost + part[t1], [*picked, t1 - 1])
                if used + t1 not in step or entry[0] < step[used + t1][0]:
                    step[used + t1] = entry
        best = step
    return best[distance + 1][1]


def as_long(bits: list[int]) -> int:
    value = sum(1 << (63 - b) for b in bits)
    return value - (1 << 64) if value >= 1 << 63 else value


def plan_masks(fps: DataFrame, distance: int = DISTANCE, parts: int = PARTS) -> list[int]:
    """The masks that every fingerprint probes."""
    n, both = bit_counts(fps)
    groups = group_bits(n, both, parts)
    p = np.diag(both) / max(n, 1)
    same = p * p + (1 - p) * (1 - p)
    costs = []
    for g in groups:
        equal = fps.groupBy(F.col("fp").bitwiseAND(F.lit(as_long(g)))).count().agg(F.sum(F.col("count").cast("double") * F.col("count"))).first()[0] or 0.0
        row = [0.0]
        for t in range(distance + 1):
            # leaving bits out raises the chance that the others agree, bit by bit
            wider = sum(math.prod(1 / same[b] for b in out) for out in itertools.combinations(g, t))
            row.append(equal * wider + 4.0 * n * math.comb(len(g), t))
        costs.append(row)
    masks = []
    for g, t in zip(groups, allot(costs, distance), strict=True):
        if t >= 0:
            masks += [as_long([b for b in g if b not in out]) for out in itertools.combinations(g, t)]
    return masks


def finer(mask: int, distance: int = DISTANCE) -> list[int]:
    """Masks that split the bits outside ``mask`` into distance + 1 parts; few bits: those that leave out ``distance`` of them."""
    free = [b for b in range(64) if not (mask >> (63 - b)) & 1]
    if len(free) <= OPEN_BITS:
        return [mask | as_long([b for b in free if b not in out]) for out in itertools.combinations(free, min(distance, len(free)))]
    return [m for k in range(distance + 1) if (m := mask | as_long(free[k :: distance + 1])) != mask]


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def span_links(rows: np.ndarray, group: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``group`` (sorted): enough to connect what lies within the distance.

    Columns of ``rows``: node, fp.
    """
    n = len(rows)
    node, fp = (np.ascontiguousarray(rows[:, k]) for k in range(2))
    end = np.searchsorted(group, group, side="right")
    found_a, found_b, at, d = [], [], np.arange(n), 1
    while True:
        at = at[at + d < end[at]]
        if not at.size:
            break
        near = at[differ(fp[at], fp[at + d]) <= distance]
        found_a.append(near)
        found_b.append(near + d)
        d += 1
    if not found_a:
        return node[:0], node[:0]
    a, b = np.concatenate(found_a), np.concatenate(found_b)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    some = np.flatnonzero(label != np.arange(n))
    return node[some], node[label[some]]


def probe(keys: DataFrame, distance: int) -> DataFrame:
    """Links among nodes that share mask and value; a bucket is the most that a task holds at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(rows: np.ndarray) -> pa.RecordBatch:
            change = np.concatenate([[0], np.cumsum((rows[1:, 0] != rows[:-1, 0]) | (rows[1:, 1] != rows[:-1, 1]))]) if len(rows) else np.zeros(0, np.int64)
            a, b = span_links(rows[:, 2:], change, distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            rows = np.concatenate([*held, rows])
            last = np.flatnonzero((rows[:, 0] != rows[-1, 0]) | (rows[:, 1] != rows[-1, 1]))
            cut = last[-1] + 1 if last.size else 0
            held = [rows[cut:]]
            if cut:
                yield links(rows[:cut])
        if held:
            yield links(np.concatenate(held))

    # by node too: a bucket's links lead to its smallest nodes, which are the same in most buckets of a group
    dealt = keys.repartition("mask", "value").sortWithinPartitions("mask", "value", "node")
    return dealt.select("mask", "value", "node", "fp").mapInArrow(run, "a long, b long")


def keys_of(rows: DataFrame, masks: Column) -> DataFrame:
    return rows.select(F.explode(masks).alias("mask"), "node", "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("value"), "node", "fp")


def near_links(nodes: DataFrame, distance: int = DISTANCE, parts: int = PARTS, bucket: int = BUCKET) -> DataFrame:
    """Links (``a``, ``b``) that connect all ``nodes`` (node, fp) within the distance."""
    masks = plan_masks(nodes, distance, parts)
    keys = keys_of(nodes, F.array(*[F.lit(m).cast("long") for m in masks]))
    found = None
    while True:
        hot = written(keys.groupBy("mask", "value").count().filter(F.col("count") > bucket).select("mask", "value"), "hot")
        # masks, not buckets: 3 at first, at most 27 before the last round
        hot_masks = [r.mask for r in hot.select("mask").distinct().collect()]
        links = probe(keys.join(hot, ["mask", "value"], "left_anti") if hot_masks else keys, distance)
        links = written(links.distinct(), "links")
        found = links if found is None else found.unionByName(links)
        if not hot_masks:
            return found
        split = F.create_map(*[x for m in hot_masks for x in (F.lit(m).cast("long"), F.array(*[F.lit(f).cast("long") for f in finer(m, distance)]))])
        keys = written(keys_of(keys.join(hot, ["mask", "value"], "left_semi").select(split[F.col("mask")].alias("masks"), "node", "fp"), F.col("masks")).distinct(), "keys")


def labelled(nodes: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and ``component_id`` (the smallest ``first_id`` reachable) of each node."""
    named = nodes.join(labels, "node", "left").select(*keys, "first_id", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    return written(named.join(smallest, "label").select(*keys, "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE) -> DataFrame:
    """``id_col``, ``fingerprint`` (16 hex digits) and ``component_id`` (smallest id reachable) of each row."""
    prints = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first_id")).withColumn("node", F.col("fp")), "nodes")
    components = labelled(nodes, connected_components(near_links(nodes.select("node", "fp"), distance)), ["fp"])
    return prints.join(components, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near copies: see ``near_copies``, which shares this module's shingles."""
    from mudline.llm import near_copies

    return near_copies.deduplicate(docs, id_col, text_col, shingle)
