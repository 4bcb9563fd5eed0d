"""Wells of a task in lock step: rows come by their place in the well, so that one batched step takes one packet of each well.

A kernel here has ``schema``, ``reads``, ``start(slots)`` and ``step(state,
columns)`` over the first n slots.  Only rows that ``when`` picks take a step; the
others pass with nulls.  Rows are dealt by well, ``WELLS`` or so to a task, and
sorted by (steps so far, steps of the whole well downwards, well): at each step
the wells that still run are a prefix of the slots, so no state is moved, and a
task holds the states of its wells and one step's rows, however long wells are.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Wells whose states a task holds, on average.
WELLS = 128


def dealt(rows: DataFrame, when: Column, key: str, order: tuple[str, ...], wells: int = WELLS, since: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``_steps`` so far and ``_all`` of the well, in the order of lock step; with ``_since``, a state, in the row of a well's first step.

    The number of tasks follows the number of wells, counted approximately.
    """
    ordered = Window.partitionBy(key).orderBy(*order)
    taken = F.coalesce(when, F.lit(False)).cast("int")
    counted = rows.withColumns({"_takes": taken, "_steps": F.sum(taken).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum(taken).over(Window.partitionBy(key))})
    counted = counted.withColumn("_first", F.when((F.col("_steps") == 1) & (F.col("_takes") == 1), F.col(key)))
    if since is None:
        counted = counted.withColumn("_since", F.lit(None).cast("binary"))
    else:
        # only the row of the first step meets its well's state
        counted = counted.join(since.select(F.col(key).alias("_first"), F.col("state").alias("_since")), "_first", "left")
    counted = counted.drop("_first")
    many = rows.agg(F.approx_count_distinct(key)).first()[0]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-many // wells))
    return counted.repartition(tasks, key).sortWithinPartitions("_steps", F.desc("_all"), key, F.desc("_takes"), *order)


def apply(rows: DataFrame, kernel, when: Column, key: str = "well_id", order: tuple[str, ...] = ("ts", "seq"), keep: tuple[str, ...] = (), states: bool = False, since: DataFrame | None = None) -> DataFrame:
    """``rows`` (key, order, ``keep`` and what the kernel reads) with what the kernel adds; null where ``when`` does not hold.

    ``states``: a column ``state`` too, the kernel's state of the well as bytes, in
    the row of its last step.  ``since``: such states (key and ``state``) from which
    wells go on; the others begin.
    """
    columns = list(dict.fromkeys([key, *order, *keep, *kernel.reads]))
    picked = rows.select(*columns, F.coalesce(when, F.lit(False)).alias("_when"))
    kept = [f for f in picked.schema if f.name != "_when"]
    adds = kernel.schema + (", state binary" if states else "")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), adds])
    names = added(rows, adds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(kernel, key, columns, names, states)
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            steps = b.column("_steps").to_numpy()
            # the last step may go on in the next batch
            cut = int(np.searchsorted(steps, steps[-1], side="left"))
            if cut:
                yield walk.through([*held, b.slice(0, cut)])
                held = []
            held.append(b.slice(cut))
        if held:
            yield walk.through(held)

    return dealt(picked, F.col("_when"), key, order, since=since).drop("_when").mapInArrow(run, schema)


def added(rows: DataFrame, schema: str) -> list[tuple[str, pa.DataType]]:
    """Names and Arrow types of a schema."""
    from pyspark.sql.pandas.types import to_arrow_type

    return [(f.name, to_arrow_type(f.dataType)) for f in rows.sparkSession.createDataFrame([], schema).schema]


class Walk:
    """The slots of one task: a step for each place in the wells."""

    def __init__(self, kernel, key: str, columns: list[str], names: list[tuple[str, pa.DataType]], states: bool = False):
        self.kernel, self.key, self.columns, self.names, self.states = kernel, key, columns, names, states
        self.wells: np.ndarray | None = None
        self.state = None

    def through(self, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        """Whole steps, their rows in order."""
        t = pa.Table.from_batches(batches).combine_chunks()
        takes, steps, whole = (t[c].to_numpy() for c in ("_takes", "_steps", "_all"))
        at = np.flatnonzero(takes)
        # what the kernel adds, a row for each step taken
        out: dict[str, list] = {name: [] for name, _ in self.names}
        inputs = {c: t[c].to_numpy()[at] for c in self.kernel.reads}
        wells = t[self.key].to_numpy()[at]
        bounds = np.flatnonzero(np.append(True, np.diff(steps[at]) != 0)).tolist() + [len(at)] if len(at) else []
        for a, z in zip(bounds[:-1], bounds[1:], strict=True):
            if self.wells is None:
                held = [t["_since"][int(i)].as_py() for i in at[a:z]]
                self.wells, self.state = wells[a:z], stacked(self.kernel.start(), [None if h is None else from_bytes(h) for h in held])
            if not np.array_equal(self.wells[: z - a], wells[a:z]):
                raise RuntimeError("wells are not in step")
            for name, values in self.kernel.step(self.state, {c: v[a:z] for c, v in inputs.items()}).items():
                out[name].extend(values.tolist() if isinstance(values, np.ndarray) else values)
            if self.states:
                out["state"] += [to_bytes(slot_of(self.state, i)) if last else None for i, last in enumerate((steps[at[a:z]] == whole[at[a:z]]).tolist())]
        # rows that take no step are null: the place among the steps taken, or none
        index = pa.array(np.where(takes > 0, np.cumsum(takes) - 1, 0), mask=takes == 0)
        arrays = [pa.array(out[name], kind).take(index) if at.size else pa.nulls(t.num_rows, kind) for name, kind in self.names]
        return pa.RecordBatch.from_arrays([t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0) for c in self.columns] + arrays, [*self.columns, *(n for n, _ in self.names)])


def slot_of(state: Any, i: int) -> Any:
    """The state of one slot, as a state of one slot."""
    if isinstance(state, dict):
        return {k: slot_of(v, i) for k, v in state.items()}
    if isinstance(state, (list, tuple)):
        return [slot_of(v, i) for v in state]
    return state[i : i + 1].copy() if isinstance(state, np.ndarray) else state


def stacked(fresh: Any, states: list[Any]) -> Any:
    """One state of many slots; ``fresh`` stands for those that begin.  Lists (steps kept) may be of other lengths: zeros stand for what a slot lacks."""
    there = [s for s in states if s is not None]
    shape = there[0] if there else fresh
    if isinstance(shape, dict):
        keys = list(dict.fromkeys(k for s in [*there, *([fresh] if fresh is not None else [])] for k in s))
        return {k: stacked(None if fresh is None else fresh.get(k), [None if s is None else s.get(k) for s in states]) for k in keys}
    if isinstance(shape, list):
        return [stacked(None, [s[n] if s is not None and len(s) > n else None for s in states]) for n in range(max(map(len, there), default=0))]
    if isinstance(shape, np.ndarray):
        empty = np.zeros_like(shape) if fresh is None else fresh
        return np.concatenate([empty if s is None else s for s in states])
    return shape


#: Version of stored states.
STATE_VERSION = 2


def to_bytes(state: Any) -> bytes:
    """A state as one compressed archive of arrays, named by their places."""
    flat: dict[str, Any] = {"version": STATE_VERSION}

    def walk(at: str, value: Any) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{at}/{k}", v)
        elif isinstance(value, (list, tuple)):
            flat[f"{at}#"] = len(value)
            for n, v in enumerate(value):
                walk(f"{at}/#{n}", v)
        else:
            flat[at] = value

    walk("", state)
    out = io.BytesIO()
    np.savez_compressed(out, **flat)
    return out.getvalue()


def from_bytes(data: bytes) -> Any:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        if int(held["version"]) != STATE_VERSION:
            raise ValueError("a state of an unknown version")
        root: dict[str, Any] = {}
        for name in held.files:
            if name == "version" or name.endswith("#"):
                continue
            *parts, last = name.strip("/").split("/")
            node = root
            for part in parts:
                node = node.setdefault(part, {})
            value = held[name]
            node[last] = value if value.ndim else value.item()
        lengths = {n[:-1]: int(held[n]) for n in held.files if n.endswith("#")}

    def lists(at: str, node: Any) -> Any:
        if at in lengths:
            return [lists(f"{at}/#{n}", (node or {})[f"#{n}"]) for n in range(lengths[at])]
        if not isinstance(node, dict):
            return node
        inner = {name.rsplit("/", 1)[1] for name in lengths if name.rsplit("/", 1)[0] == at}
        return {k: lists(f"{at}/{k}", node.get(k)) for k in dict.fromkeys([*node, *inner])}

    return lists("", root)
