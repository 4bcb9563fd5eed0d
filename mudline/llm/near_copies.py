"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Rows with equal sets collapse to one node, with the SimHash fingerprint of its
   set: nodes of equal fingerprints, and of fingerprints that the pigeonhole probes
   of ``simhash`` link, are candidates and are verified by exact Jaccard.
2. For copies whose fingerprints lie further apart (about ten bits at 0.8) a node has ``BANDS`` independent fingerprints, each of ``ROWS`` minima of its
   hashed shingles.  Nodes that share one are candidates: a pair at similarity J
   shares none with probability (1 - J ** ROWS) ** BANDS, 0.23 % at 0.8, wherever
   the edits lie.  A bucket is never cut.
3. Within a bucket, pairs pass on if their sketches (one byte of each minimum)
   agree in ``SKETCH`` places.  At 0.8 the places that agree are binomial, 96 of
   120 on average, and 0.2 % of pairs fall below.
4. What passes is verified by exact Jaccard in joins with the shingle sets.

A bucket first yields the pairs around pivots, as many as its rows at most, so a
large group of copies is linked without its square.  Buckets over ``BLOCK`` rows
are dealt to several tasks, and a pivot of the whole bucket goes to each.  Then
the groups of a bucket that are still apart are compared: the rows outside its
largest group, in blocks, with all its rows, in blocks.  These rows carry their
shingle sets (of over ``CARRIED`` hashes the smallest ones, for an estimate), so
unlike pairs stay in the task, and groups that a pair joins are not compared
again.  A task holds two blocks at most, whatever the size of a bucket.

Defined results: texts without a word (null, empty, white space) are one group;
rows that repeat an id or a text are told apart by id and text; an empty table
gives an empty one; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mudline.llm.batches import by_bytes
from mudline.llm.components import connected_components
from mudline.llm.shared import written
from mudline.llm.simhash import SEED, STAGE_SHINGLE, majority, near_links, shingles

BANDS = 20
ROWS = 6
SKETCH = 83
#: Rows of a bucket that one task takes at once, and the hashes of a set that they carry there.
BLOCK = 1024
CARRIED = 2048
#: What an estimate from ``CARRIED`` smallest hashes may lack: over four of its deviations.
SLACK = 0.04
#: Jaccard of 4 / 5 or more.
SIMILAR = (4, 5)
PAIRS = 1 << 16


def shingle_set(text: str | None, shingle: int = STAGE_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's word shingles, sorted; none without a word."""
    words = (text or "").encode().lower().split()
    digest = xxhash.xxh64_digest
    return np.unique(np.frombuffer(b"".join([digest(s, SEED) for s in shingles(words, shingle)]), ">u8").astype(np.uint64)) if words else np.zeros(0, np.uint64)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(hashes.tobytes(), SEED) if len(hashes) else bytes(16)


def salts() -> tuple[np.ndarray, np.ndarray]:
    both = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * ROWS, 1), np.uint64)
    return both[0], both[1] | np.uint64(1)


def minima(hashes: np.ndarray, salt: np.ndarray, factor: np.ndarray) -> np.ndarray:
    """The least value of the set under each of BANDS x ROWS orders."""
    out = np.full(len(salt), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, ((hashes[at : at + 1024] ^ salt) * factor).min(1), out=out)
    return out


def band_keys(least: np.ndarray) -> list[int]:
    raw, width = least.tobytes(), 8 * ROWS
    return [xxhash.xxh64_intdigest(raw[k * width : (k + 1) * width], k) for k in range(BANDS)]


def set_prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``id``, ``mark`` (of the text), ``c1`` and ``c2`` (of the whole set), ``keys``, ``sketch`` and ``fp`` (the set's SimHash fingerprint) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt, factor = salts()
        for b in by_bytes(batches, "text"):
            digests, keys, sketches, prints = [], [], [], []
            for t in b.column(2).to_pylist():
                hashes = shingle_set(t, shingle)
                digests.append(set_digest(hashes))
                least = minima(hashes, salt, factor) if len(hashes) else np.zeros(0, np.uint64)
                keys.append(np.array(band_keys(least) if len(least) else [], np.uint64).view(np.int64))
                sketches.append((least >> np.uint64(40)).astype(np.uint8).tobytes())
                prints.append(majority(hashes.astype(">u8").tobytes(), 8) if len(hashes) else bytes(8))
            raw = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(raw[:, k])) for k in range(2)), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))], ["id", "mark", "c1", "c2", "keys", "sketch", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), mark_of(F.col(f"`{text_col}`")).alias("mark"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, mark string, c1 long, c2 long, keys array<long>, sketch binary, fp long")


def mark_of(text: Column) -> Column:
    """A digest of the text itself, to tell rows of one id apart."""
    return F.md5(text.cast("binary"))


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """``c1``, ``c2`` and ``hashes`` of each row of ``text``; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            sets = [shingle_set(t, shingle) for t in b.column(0).to_pylist()]
            raw = np.frombuffer(b"".join(map(set_digest, sets)), ">i8").astype(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(raw[:, k])) for k in range(2)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["c1", "c2", "hashes"])

    return texts.select("text").mapInArrow(run, "c1 long, c2 long, hashes array<long>")


def around_pivots(sketch: np.ndarray, label: np.ndarray, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of different labels with like sketches: each row with one pivot at most."""
    left = order
    while len(left) > 1:
        pivot, rest = left[0], left[1:]
        like = (sketch[rest] == sketch[pivot]).sum(1) >= SKETCH
        near = rest[like]
        near = near[label[near] != label[pivot]]
        if near.size:
            yield np.full(len(near), pivot), near
        left = rest[~like]


def shared_part(x: np.ndarray, y: np.ndarray, sizes: tuple[int, int]) -> tuple[float, bool]:
    """Jaccard of two sets from their smallest hashes, and whether it is exact."""
    if max(sizes) <= CARRIED:
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both / max(len(x) + len(y) - both, 1), True
    least = np.union1d(x, y)[:CARRIED]
    return len(np.intersect1d(np.intersect1d(x, y, assume_unique=True), least, assume_unique=True)) / max(len(least), 1), False


def across(sketch: np.ndarray, label: np.ndarray, side: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places of similar pairs of different labels, between side 0 and side 1, or within side 2; labels that such a pair joins count as one."""
    label = np.unique(label, return_inverse=True)[1]
    ones, twos = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
    limit = SIMILAR[0] / SIMILAR[1]
    for at, rest in [*((x, ones) for x in np.flatnonzero(side == 0)), *((x, twos[k + 1 :]) for k, x in enumerate(twos))]:
        rest = rest[label[rest] != label[at]]
        for other in rest[(sketch[rest] == sketch[at]).sum(1) >= SKETCH].tolist():
            if label[other] == label[at]:
                continue
            share, exact = shared_part(sets[at], sets[other], (sizes[at], sizes[other]))
            if share >= limit - (1e-12 if exact else SLACK):
                yield int(at), other
                if exact:
                    label[label == label[other]] = label[at]


def pairs_in_groups(rows: DataFrame, by: list[str], every: bool) -> DataFrame:
    """Pairs (``a`` < ``b``) within each group of ``by``: around pivots (side 0 first), or across sides by the sets that rows carry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held: list[pa.RecordBatch] = []

        def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            group, node, label, side = (rows.column(k).to_numpy() for k in range(4))
            sketch = np.frombuffer(b"".join(rows.column(4).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
            cuts = np.flatnonzero(np.diff(group, prepend=group[:1] - 1, append=group[-1:] - 1))
            size = 0
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if z - a < 2:
                    continue
                if every:
                    part = rows.slice(a, z - a)
                    sets = [np.asarray(x.as_py(), np.int64).view(np.uint64) for x in part.column(5)]
                    near = ((np.array([x]), np.array([y])) for x, y in across(sketch[a:z], label[a:z], side[a:z], sets, part.column(6).to_numpy()))
                else:
                    near = around_pivots(sketch[a:z], label[a:z], np.lexsort((node[a:z].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15), side[a:z])))
                for x, y in near:
                    found.append((node[a + x], node[a + y]))
                    size += len(x)
                    if size >= PAIRS or len(found) >= 4096:
                        yield flush()
                        size = 0
            if found:
                yield flush()

        def flush() -> pa.RecordBatch:
            x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(0).to_numpy()
            if held and held[-1].column(0)[-1].as_py() != group[0]:
                yield from pairs(pa.Table.from_batches(held))
                held = []
            cut = int(np.searchsorted(group, group[-1]))
            if cut:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    dealt = rows.withColumn("group", F.xxhash64(*by)).repartition("group").sortWithinPartitions("group")
    carried = ["carried", "size"] if every else []
    return dealt.select("group", "node", "label", F.col("side").cast("int").alias("side"), "sketch", *carried).mapInArrow(run, "a long, b long").filter("a <> b").distinct()


def blocks_of(n: Column) -> Column:
    return F.ceil(n / BLOCK).cast("int")


def block(node: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(node, F.lit("block")), blocks).cast("int")


def upto(n: Column) -> Column:
    """0 to n - 1; none for 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def fingerprint_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs (``a`` < ``b``) of ``nodes`` (node, fp): each node with the first of its SimHash fingerprint, and the firsts of fingerprints that lie near."""
    firsts = written(nodes.groupBy("fp").agg(F.min("node").alias("node")), "fingerprints")
    near = near_links(firsts.select(F.col("fp").alias("node"), "fp"))
    end = lambda name: firsts.select(F.col("fp").alias(name), F.col("node").alias(f"{name}_node"))
    linked = near.join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("x"), F.col("b_node").alias("y"))
    equal = nodes.select("fp", F.col("node").alias("x")).join(firsts.select("fp", F.col("node").alias("y")), "fp").select("x", "y")
    return linked.unionByName(equal).filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def around_candidates(members: DataFrame) -> DataFrame:
    """Pairs around pivots of each bucket; buckets over ``BLOCK`` rows in blocks, each with one pivot of the whole bucket."""
    lead = F.min_by(F.struct("node", "label", "sketch"), F.xxhash64("node", F.lit("lead"))).alias("lead")
    sized = members.groupBy("key").agg(blocks_of(F.count("*")).alias("blocks"), lead).filter("blocks > 1")
    first = sized.select("key", F.explode(upto(F.col("blocks"))).alias("block"), "lead.*").withColumn("side", F.lit(0))
    rows = members.join(sized.select("key", "blocks"), "key", "left").withColumn("block", F.coalesce(block(F.col("node"), F.col("blocks")), F.lit(0)))
    return pairs_in_groups(rows.select("key", "block", "node", "label", "sketch", F.lit(1).alias("side")).unionByName(first), ["key", "block"], every=False)


def all_candidates(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Similar pairs of different labels in each bucket: rows outside its largest group among each other and with that group, block by block.

    Enough pairs to join the labels that exact ones join; pairs by estimate are all there.
    """
    per_label = members.groupBy("key", "label").count()
    apart = per_label.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.max("count").alias("n_main"), F.sum("count").alias("n")).filter("n > n_main")
    sized = apart.select("key", "main", blocks_of(F.col("n_main")).alias("mains"), blocks_of(F.col("n") - F.col("n_main")).alias("others"))
    rows = members.join(sized, "key").withColumn("other", F.col("label") != F.col("main"))
    mine = block(F.col("node"), F.when(F.col("other"), F.col("others")).otherwise(F.col("mains")))
    rows = rows.withColumn("mine", mine)
    spot = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    me, zero, one, two = F.col("mine"), F.lit(0), F.lit(1), F.lit(2)
    with_main = F.transform(upto(F.col("mains")), lambda j: spot("main", F.col("mine"), j, zero))
    from_main = F.transform(upto(F.col("others")), lambda i: spot("main", i, F.col("mine"), one))
    among = F.transform(upto(F.col("others")), lambda j: spot("other", F.least(me, j), F.greatest(me, j), F.when(me == j, two).when(me < j, zero).otherwise(one)))
    spots = F.when(F.col("other"), F.concat(with_main, among)).otherwise(from_main)
    dealt = rows.select("key", "node", "label", "sketch", F.explode(spots).alias("spot")).select("key", "node", "label", "sketch", "spot.*")
    # sets are in order of unsigned hashes, as the smallest of all are
    carried = sets.select("node", F.slice("hashes", 1, CARRIED).alias("carried"), F.size("hashes").cast("long").alias("size"))
    return pairs_in_groups(dealt.join(carried, "node"), ["key", "kind", "i", "j"], every=True)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose sets are similar: exact Jaccard."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    sized = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("total"))
    return sized.filter(SIMILAR[1] * F.col("shared") >= SIMILAR[0] * (F.col("total") - F.col("shared"))).select("a", "b")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE) -> DataFrame:
    """``id``, ``mark``, ``c1``, ``c2`` (of the shingle set), ``component_id`` and ``kept`` of each row: groups linked by similar pairs.

    ``component_id`` is the group's smallest id (null where it has none) and
    ``kept`` its first row (struct of nameless, id, mark).
    """
    prints = written(set_prints(docs, id_col, text_col, shingle), "prints")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "mark")).alias("first")
    nodes = prints.groupBy("c1", "c2").agg(first, F.first("keys").alias("keys"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    nodes = written(nodes.withColumn("node", F.xxhash64("c1", "c2")), "nodes")
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    shared = keyed.groupBy("key").count().filter("count > 1").select("key")
    members = written(keyed.join(shared, "key").join(nodes.select("node", "sketch"), "node"), "members")
    alike = written(fingerprint_candidates(nodes.select("node", "fp")), "alike")
    ends = members.select("node").unionByName(alike.select(F.col("a").alias("node"))).unionByName(alike.select(F.col("b").alias("node")))
    wanted = written(nodes.join(ends.distinct(), "node", "left_semi").select("node", "c1", "c2", "first.id", "first.mark"), "wanted")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).withColumn("mark", mark_of(F.col("text")))
    same = rows["id"].eqNullSafe(wanted["id"]) & (rows["mark"] == wanted["mark"])
    texts = rows.join(wanted.select("id", "mark").hint("merge"), same, "left_semi").select("text")
    sets = written(shingle_sets(texts, shingle).join(wanted.select("node", "c1", "c2"), ["c1", "c2"]).select("node", "hashes").dropDuplicates(["node"]), "sets")

    one = F.col("node").alias("label")
    around = written(around_candidates(members.select("key", "node", "sketch", one)).unionByName(alike).distinct(), "pairs")
    links = written(verified(around, sets), "links")
    labels = connected_components(links)
    named = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"), "sketch")
    more = written(verified(all_candidates(named, sets), sets), "links")
    if not more.isEmpty():
        labels = connected_components(links.unionByName(more))
    grouped = nodes.join(labels, "node", "left").select("c1", "c2", "first", F.coalesce("label", "node").alias("label"))
    firsts = grouped.groupBy("label").agg(F.min("first").alias("kept"))
    components = written(grouped.join(firsts, "label").select("c1", "c2", "kept", F.col("kept.id").alias("component_id")), "components")
    return prints.select("id", "mark", "c1", "c2").join(components, ["c1", "c2"])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = STAGE_SHINGLE) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id, then the smallest digest of its text.

    Rows without an id come last in their group.  Of rows that repeat this id and
    text the one with the smallest hash of all its columns stays.  The kept rows
    grow with the data, so their join is a shuffle join at every size.
    """
    groups = similar_documents(docs, id_col, text_col, shingle)
    is_first = F.col("kept.id").eqNullSafe(F.col("id")) & F.col("kept.mark").eqNullSafe(F.col("mark"))
    first = written(groups.filter(is_first).groupBy("id", "mark").agg(F.count("*").alias("n")).select(F.col("id").alias("kept id"), F.col("mark").alias("kept mark"), "n"), "kept")
    same = lambda keys: docs[id_col].eqNullSafe(keys["kept id"]) & mark_of(docs[text_col]).eqNullSafe(keys["kept mark"])
    single, several = first.filter("n = 1"), first.filter("n > 1")
    kept = docs.join(single.hint("merge"), same(single), "left_semi")
    if several.isEmpty():
        return kept
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    again = docs.join(several.hint("merge"), same(several), "left_semi").groupBy(F.col(f"`{id_col}`").alias("its id"), mark_of(F.col(f"`{text_col}`")).alias("its mark"))
    one_each = again.agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.xxhash64(*plain)).alias("row")).select("row.*")
    return kept.unionByName(one_each)
