"""Running values of wells that are too long for one task: chunks of time, their summaries scanned, carried into the chunks.

A plain window puts a well into one task.  Here rows are dealt by (well, chunk of
``span`` seconds) and each chunk is worked on alone; what a chunk does to a running
value is one small row (a sum, the last value that is there, moments, an affine
map); these rows, one a chunk, are scanned in order of each well; and what came
before a chunk is joined back to its rows by (well, chunk), where they lie.  So
one well uses as many tasks as it has chunks, and no task holds more than a
chunk and a well's summaries.  The results are those of the plain window over
(ts, seq); sums and moments of doubles may differ in their last digits, as they
are added in another order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Seconds in a chunk: at a packet a second, as many rows at most.
SPAN = 3600
CHUNK = "_chunk"


def chunked(rows: DataFrame, span: int = SPAN) -> DataFrame:
    return rows.withColumn(CHUNK, F.floor(F.col("ts") / span))


def inside(key: str) -> WindowSpec:
    return Window.partitionBy(key, CHUNK).orderBy("ts", "seq")


def earlier(key: str) -> WindowSpec:
    """The summaries of all chunks before this one."""
    return Window.partitionBy(key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


class Scan:
    """Several running values in one go: ask for them by name, then take them all with ``over``.

    A value is ``before`` (rows before this one) or not (this row too).
    """

    def __init__(self, key: str = "well_id", span: int = SPAN):
        self.key, self.span = key, span
        self.within: dict[str, Column] = {}
        self.summaries: dict[str, Column] = {}
        self.carried: dict[str, Column] = {}
        self.results: dict[str, Column] = {}

    def frame(self, before: bool) -> WindowSpec:
        return inside(self.key).rowsBetween(Window.unboundedPreceding, -1 if before else 0)

    def last(self, name: str, value: Column, where: Column | None = None, before: bool = True) -> Scan:
        """The last value that is not null (where ``where`` holds)."""
        kept = value if where is None else F.when(where, value)
        # wrapped, so that a struct of nulls differs from no value
        self.within[f"_{name}"] = F.last(F.when(kept.isNotNull(), F.struct(kept.alias("x"))), ignorenulls=True).over(self.frame(before))
        self.summaries[f"_{name}_last"] = F.max_by(F.when(kept.isNotNull(), F.struct(kept.alias("x"))), F.when(kept.isNotNull(), F.struct("ts", "seq")))
        self.carried[f"_{name}_carry"] = F.last(f"_{name}_last", ignorenulls=True).over(earlier(self.key))
        self.results[name] = F.coalesce(F.col(f"_{name}"), F.col(f"_{name}_carry"))["x"]
        return self

    def total(self, name: str, value: Column, before: bool = False) -> Scan:
        """The sum so far, 0 where there is nothing."""
        self.within[f"_{name}"] = F.sum(value).over(self.frame(before))
        self.summaries[f"_{name}_sum"] = F.sum(value)
        self.carried[f"_{name}_carry"] = F.sum(f"_{name}_sum").over(earlier(self.key))
        zero = F.lit(0)
        self.results[name] = F.coalesce(F.col(f"_{name}"), zero) + F.coalesce(F.col(f"_{name}_carry"), zero)
        return self

    def count(self, name: str, where: Column | None = None, before: bool = False) -> Scan:
        return self.total(name, F.lit(1).cast("long") if where is None else F.coalesce(where, F.lit(False)).cast("long"), before)

    def moments(self, name: str, value: Column, before: bool = False) -> Scan:
        """``name`` as a struct of n, mean and m2 (squared deviations) so far; chunks are merged around the well's first mean."""
        self.within |= {f"_{name}_{p}": f(value).over(self.frame(before)) for p, f in (("n", F.count), ("mean", F.avg), ("var", F.var_pop))}
        self.summaries |= {f"_{name}_n0": F.count(value), f"_{name}_mean0": F.avg(value), f"_{name}_var0": F.var_pop(value)}
        n, around = F.col(f"_{name}_n0"), F.first(f"_{name}_mean0", ignorenulls=True).over(Window.partitionBy(self.key).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        away = F.col(f"_{name}_mean0") - F.col(f"_{name}_around")
        self.carried |= {
            f"_{name}_around": around, f"_{name}_n1": F.sum(n).over(earlier(self.key)), f"_{name}_s1": F.sum(n * away).over(earlier(self.key)),
            f"_{name}_s2": F.sum(n * (F.col(f"_{name}_var0") + away * away)).over(earlier(self.key)),
        }
        zero = F.lit(0.0)
        n1, n2 = F.coalesce(F.col(f"_{name}_n1"), F.lit(0)), F.col(f"_{name}_n")
        mean1 = F.col(f"_{name}_around") + F.try_divide(F.col(f"_{name}_s1"), n1)
        m1 = F.col(f"_{name}_s2") - F.try_divide(F.col(f"_{name}_s1") * F.col(f"_{name}_s1"), n1)
        mean2, m2 = F.col(f"_{name}_mean"), n2 * F.col(f"_{name}_var")
        gap = mean2 - mean1
        both = (n1 > 0) & (n2 > 0)
        mean = F.when(both, mean1 + gap * n2 / (n1 + n2)).otherwise(F.coalesce(mean2, mean1))
        spread = F.when(both, m1 + m2 + gap * gap * n1 * n2 / (n1 + n2)).otherwise(F.coalesce(m2, m1, zero))
        self.results[name] = F.struct((n1 + n2).alias("n"), mean.alias("mean"), F.greatest(spread, zero).alias("m2"))
        return self

    def over(self, rows: DataFrame) -> DataFrame:
        """``rows`` with all that was asked for."""
        chunks = chunked(rows, self.span)
        # a chunk's rows and its summary come from one shuffle by (key, chunk)
        summary = chunks.groupBy(self.key, CHUNK).agg(*[c.alias(n) for n, c in self.summaries.items()])
        around = {n: c for n, c in self.carried.items() if n.endswith("_around")}
        carried = (summary.withColumns(around) if around else summary).withColumns({n: c for n, c in self.carried.items() if n not in around})
        carry = carried.select(self.key, CHUNK, *self.carried)
        out = chunks.withColumns(self.within).join(carry, [self.key, CHUNK], "left").withColumns(self.results)
        return out.select(*rows.columns, *self.results)


def prefix(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of maps x -> a x + b, one after the other, the map up to each place; by doubling, so in whole arrays."""
    a, b, step = a.copy(), b.copy(), 1
    while step < len(a):
        b[step:] += a[step:] * b[:-step]
        a[step:] *= a[:-step].copy()
        step *= 2
    return a, b


def affine(rows: DataFrame, a: Column, b: Column, name: str, key: str = "well_id", span: int = SPAN, start: float = 0.0) -> DataFrame:
    """``name``: x of the row before times ``a`` plus ``b``, from ``start`` on in each well; both maps must be there in every row.

    First each chunk gives the map of all of it, a row a chunk; these are composed
    per well, which gives what each chunk begins with; then the chunks' rows are
    worked through from there.  Rows of a chunk stream in batches, so a task holds
    a batch.
    """
    columns = rows.columns
    mapped = chunked(rows, span).withColumns({"_a": a.cast("double"), "_b": b.cast("double")})
    key_type = rows.schema[key].dataType.simpleString()

    def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, bool]], np.ndarray, np.ndarray]]:
        """Each batch with its runs of one chunk (and whether a run goes on from the batch before), and the maps since the run's beginning."""
        last = None
        for batch in batches:
            if batch.num_rows:
                keys, chunk = batch.column(key).to_numpy(zero_copy_only=False), batch.column(CHUNK).to_numpy()
                m, n = batch.column("_a").to_numpy().copy(), batch.column("_b").to_numpy().copy()
                begin = [*np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (chunk[1:] != chunk[:-1]))).tolist(), len(keys)]
                runs = [(p, q, p == 0 and last == (keys[0], chunk[0])) for p, q in zip(begin[:-1], begin[1:], strict=True)]
                for p, q, _ in runs:
                    m[p:q], n[p:q] = prefix(m[p:q], n[p:q])
                last = keys[-1], chunk[-1]
                yield batch, runs, m, n

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list | None = None
        for batch, runs, m, n in chunks_of(batches):
            done = []
            for p, q, goes_on in runs:
                if not goes_on:
                    if held:
                        done.append(held)
                    held = [batch.column(key)[p].as_py(), batch.column(CHUNK)[p].as_py(), 1.0, 0.0]
                held[2:] = m[q - 1] * held[2], m[q - 1] * held[3] + n[q - 1]
            yield ends_of(done)
        yield ends_of([held] if held else [])

    def ends_of(done: list) -> pa.RecordBatch:
        k, c, m, n = zip(*done, strict=True) if done else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, key_arrow), pa.array(c, pa.int64()), pa.array(m, pa.float64()), pa.array(n, pa.float64())], [key, CHUNK, "_a", "_b"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        well, x = None, start
        for batch in batches:
            out = []
            for k, m, n in zip(batch.column(key).to_pylist(), batch.column("_a").to_pylist(), batch.column("_b").to_pylist(), strict=True):
                if k != well:
                    well, x = k, start
                out.append(x)
                x = m * x + n
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column(CHUNK), pa.array(out, pa.float64())], [key, CHUNK, "_x"])

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = start
        for batch, runs, m, n in chunks_of(batches):
            begins = batch.column("_x").to_numpy()
            for p, q, goes_on in runs:
                n[p:q] += m[p:q] * (x if goes_on else begins[p])
                x = n[q - 1]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n)], [*columns, name])

    from pyspark.sql.pandas.types import to_arrow_type

    key_arrow = to_arrow_type(rows.schema[key].dataType)
    sorted_ = lambda df: df.repartition(key, CHUNK).sortWithinPartitions(key, CHUNK, "ts", "seq")
    ends = sorted_(mapped.select(key, CHUNK, "ts", "seq", "_a", "_b")).mapInArrow(whole, f"{key} {key_type}, {CHUNK} long, _a double, _b double")
    carry = ends.repartition(key).sortWithinPartitions(key, CHUNK).mapInArrow(across, f"{key} {key_type}, {CHUNK} long, _x double")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), f"{name} double"])
    return sorted_(mapped.join(carry, [key, CHUNK])).mapInArrow(within, schema)


def moving_mean(rows: DataFrame, channel: str, name: str = "ema", fast: float = 0.5, slow: float = 0.1, warm: int = 10, resets: Column | None = None, key: str = "well_id", span: int = SPAN) -> DataFrame:
    """``baseline.moving_baseline`` over long wells: fast for the first ``warm`` rows, then slow; values that aren't positive leave it alone.

    Where ``resets`` holds, the baseline is empty again after the row, as after a
    formation change, and the next rows are the first ones.
    """
    value = F.col(channel).cast("double")
    rises = F.coalesce(value > 0, F.lit(False))
    if resets is None:
        marks = Scan(key, span).count("_place", before=True).last("_met", F.lit(True), where=rises).over(rows)
        place, empty = F.col("_place"), F.col("_met").isNull()
    else:
        # which stretch between resets a row is in, and what came before it there
        again = F.coalesce(resets, F.lit(False))
        first = Scan(key, span).count("_stretch", F.col("_again"), before=True).count("_place", before=True).over(rows.withColumn("_again", again))
        marks = Scan(key, span).last("_begun", F.col("_place") + 1, where=F.col("_again")).last("_met", F.col("_stretch"), where=rises).over(first)
        place = F.col("_place") - F.coalesce(F.col("_begun"), F.lit(0))
        empty = ~F.coalesce(F.col("_met") == F.col("_stretch"), F.lit(False))
    alpha = F.when(place < warm, fast).otherwise(slow)
    a = F.when(empty, 0.0).when(rises, 1 - alpha).otherwise(1.0)
    b = F.when(~rises, 0.0).when(empty, value).otherwise(alpha * value)
    maps = marks.select(*rows.columns, a.alias("_map"), b.alias("_shift"))
    return affine(maps, F.col("_map"), F.col("_shift"), name, key, span).drop("_map", "_shift")
