"""Quality scores from compression (operator 1).

Two zstandard dictionaries are trained, one on good and one on bad labelled
texts.  A text is compressed block by block (``BLOCK`` bytes, so that a text's
own repetition cannot hide what a dictionary explains) with each dictionary.
The difference of the compressed sizes over the text's bytes is calibrated to a
probability by logistic regression on labelled texts that no dictionary saw.

Labelled texts are a sample of about ``2 * SAMPLE`` rows a class, by a hash of
the id, in two halves: each half is measured with dictionaries of the other, so
the calibration sees honest differences, and the final dictionaries take both.
All texts are scored whole.

Defined results: null and empty texts get the calibrated score of a difference
of 0; repeated rows get repeated scores; a document labelled more than once has
its largest label, and of texts that repeat its id it teaches the smallest; very
long texts are scored whole, block by block, and teach spans spread over them
(see ``lesson``); other columns never matter;
an empty table gives an empty one; without labels of both classes every score is
0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mudline.llm.batches import by_bytes
from mudline.llm.sampling import lesson, per_class_sample

BLOCK = 1000
DICTIONARY_BYTES = 112 << 10
SAMPLE = 1500
LEVEL = 3
THRESHOLD = 0.7


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    intercept: float

    def compressors(self) -> tuple[zstandard.ZstdCompressor, zstandard.ZstdCompressor]:
        made = []
        for raw in (self.good, self.bad):
            with_dict = zstandard.ZstdCompressionDict(raw)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=with_dict, write_content_size=False, write_checksum=False, write_dict_id=False))
        return made[0], made[1]

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.intercept, -50, 50)))


def blocks(text: bytes) -> list[bytes]:
    """Near-equal blocks, of ``BLOCK`` bytes at most."""
    n = -(-len(text) // BLOCK)
    return [text[len(text) * i // n : len(text) * (i + 1) // n] for i in range(n)]


def difference(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """(size with the bad dictionary - size with the good one) per byte; 0 for an empty text."""
    raw = (text or "").encode()
    if not raw:
        return 0.0
    parts = blocks(raw)
    return (sum(len(bad.compress(b)) for b in parts) - sum(len(good.compress(b)) for b in parts)) / len(raw)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton's method with a slight ridge."""
    scale = x.std() or 1.0
    z = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        g = z.T @ (weight * (y - p)) - 1e-3 * beta
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or all of the texts as a raw one where they are too few to train."""
    parts = [b for t in texts for b in blocks(t)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)


def fit(texts: list[str], labels: list[int], halves: list[int], counts: dict[int, int]) -> Classifier | None:
    """From sampled texts: dictionaries of each half give the other half's differences, which calibrate; the final dictionaries take both halves.

    Classes weigh as they do in all labelled rows.
    """
    rows = [(t.encode(), y, h) for t, y, h in zip(texts, labels, halves, strict=True) if t]
    x, y = np.zeros(len(rows)), np.array([float(q) for _, q, _ in rows])
    seen = np.zeros(len(rows), bool)
    for half in (0, 1):
        train = {q: [t for t, c, h in rows if c == q and h == half] for q in (0, 1)}
        if train[0] and train[1]:
            good, bad = Classifier(dictionary(train[1]), dictionary(train[0]), 0.0, 0.0).compressors()
            for i, (t, _, h) in enumerate(rows):
                if h != half:
                    x[i], seen[i] = difference(t.decode(), good, bad), True
    if len(set(y[seen])) < 2:
        return None
    x, y = x[seen], y[seen]
    share = {q: counts[q] / max(1, int((y == q).sum())) for q in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    slope, intercept = logistic(x, y, weight * len(y) / weight.sum())
    return Classifier(dictionary([t for t, c, _ in rows if c == 1]), dictionary([t for t, c, _ in rows if c == 0]), slope, intercept)


def learn(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Classifier | None:
    """A classifier from a bounded sample of the labelled rows that ``usable`` (over the label rows) admits."""
    clean = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & usable).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    chosen, counts = per_class_sample(clean, "y", ["id"], 2 * sample)
    if set(counts) != {0, 1}:
        return None
    # at most about 4 * sample rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    halves = rows.withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int"))
    got = halves.groupBy("id", "y", "half").agg(lesson(F.min("text")).alias("text")).orderBy("id").collect()
    return fit([r.text or "" for r in got], [r.y for r in got], [r.half for r in got], counts)


def score(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``score`` and ``predicted`` of each row; no shuffle."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    if model is None:
        out = rows.select("id", F.lit(0.5).alias("score"))
    else:
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            good, bad = shared.value.compressors()
            for b in by_bytes(batches, "text"):
                d = np.array([difference(t, good, bad) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared.value.score(d))], ["id", "score"])

        out = rows.mapInArrow(run, f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
