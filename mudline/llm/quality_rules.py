"""Quality rules with suffix-array repetition (operator 4).

Words are runs without ASCII white space.  For each batch one suffix array over
the words of all its texts is built by prefix doubling in NumPy; ranks never
look past a text's end, so texts cannot mix.  Only suffixes that still share
their rank are sorted again, so ordinary prose costs two or three rounds.  The
stored ranks of each round give the longest common prefix of neighbours; the
suffixes of one LCP interval begin the same maximal repeated substring, and the
union of their spans is the repeated part of the text.

Verdict: a text goes if the base rules fail, if the repeated part holds over
``MAX_COVERED`` of its words or if its longest repeat has over ``MAX_REPEAT``
words.

Defined results: null and empty texts have no words and fail the base rules;
repeated rows give repeated results; a very long text is one batch of its own and
is measured whole; of equal repeats all are covered, the first included;
``longest_repeat`` counts repeats of two words or more; an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mudline.llm.batches import by_bytes, distinct_runs, gather_spans, row_sums, spans_of, text_bytes

MIN_WORDS = 50
MIN_REPEAT = 8
MAX_COVERED = 0.3
MAX_REPEAT = 60
SYMBOLS = b"#*$%&|<>"


def word_table(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of equal words, bounds of each text's words, and the characters of each word."""
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    starts, ends, bounds = spans_of(word, offsets)
    ids, _ = distinct_runs(raw, word, starts, ends)
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return ids, bounds, chars[ends] - chars[starts]


def adjacent_lcp(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of all texts (text by text within equal ranks) and the LCP of each entry with the one before.

    Entries whose first two words are unique are left out: they repeat nothing
    that counts.
    """
    n = len(ids)
    stop = np.repeat(bounds[1:], np.diff(bounds))
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    # round 0: equal words of the same text
    rank = dense(text * (int(ids.max()) + 1 if n else 1) + ids)
    levels, size = [rank], 1
    live = np.flatnonzero(np.bincount(rank, minlength=n)[rank] > 1)
    while live.size:
        far = live + size
        inside = far < stop[live]
        pair = np.where(inside, rank[np.minimum(far, n - 1)] + 1, 0)
        order = np.lexsort((pair, rank[live]))
        r, p, at = rank[live][order], pair[order], live[order]
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
        head = np.concatenate([[True], r[1:] != r[:-1]])
        # ranks stay in order: within an old rank each new group starts at its first place
        place = np.arange(len(at))
        group_at = np.maximum.accumulate(np.where(new, place, 0))
        head_at = np.maximum.accumulate(np.where(head, place, 0))
        rank = rank.copy()
        rank[at] = r + group_at - head_at
        size *= 2
        levels.append(rank)
        sizes = np.diff(np.append(np.flatnonzero(new), len(at)))
        live = at[np.repeat(sizes > 1, sizes)]
    if len(levels) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    twin = np.bincount(levels[1], minlength=n)[levels[1]] > 1
    where = np.flatnonzero(twin)
    sa = where[np.argsort(rank[where], kind="stable")]
    a, b = sa[:-1].copy(), sa[1:].copy()
    lcp = np.zeros(len(sa), np.int64)
    got = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        fits = (a + step <= stop[sa[:-1]]) & (b + step <= stop[sa[1:]]) & (text[sa[:-1]] == text[sa[1:]])
        same = fits.copy()
        same[fits] = levels[k][a[fits]] == levels[k][b[fits]]
        a[same] += step
        b[same] += step
        got[same] += step
    lcp[1:] = got
    return sa, lcp


def dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of keys that leave room for their equals (the place of the first in sorted order)."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    out = np.empty(len(keys), np.int64)
    out[order] = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0)) if len(s) else 0
    return out


def cover(n: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Marks the union of spans over n places."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + lengths, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: words in repeated 3-word windows, words in repeats of ``MIN_REPEAT`` words or more, words of the longest repeat."""
    texts, n = len(bounds) - 1, len(ids)
    if not n:
        return (np.zeros(texts, np.int64),) * 3
    sa, lcp = adjacent_lcp(ids, bounds)
    best = np.maximum(lcp, np.append(lcp[1:], 0)) if len(sa) else lcp
    three = best >= 3
    in_three = cover(n, sa[three], best[three])
    long = best >= MIN_REPEAT
    in_long = cover(n, sa[long], best[long])
    longest = np.zeros(texts, np.int64)
    np.maximum.at(longest, np.searchsorted(bounds, sa, side="right") - 1, best)
    return row_sums(in_three, bounds), row_sums(in_long, bounds), longest


def duplicate_lines(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of each text: lines with a word that equal an earlier line."""
    cut = np.flatnonzero(raw == 10)
    starts = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], cut + 1]))
    starts = starts[starts < len(raw)]
    ends = np.append(starts[1:], len(raw))
    ends = ends - (raw[ends - 1] == 10) if len(starts) else ends
    word = np.concatenate([[0], np.cumsum(~((raw == 32) | ((raw >= 9) & (raw <= 13))))])
    some = word[ends] > word[starts]
    starts, ends = starts[some], ends[some]
    at = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    lines = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(raw[gather_spans(starts, ends - starts)])])
    text = np.searchsorted(offsets, starts, side="right") - 1
    key = text * (len(starts) + 1) + lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return np.bincount(text[again], minlength=len(offsets) - 1)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """All measures of a batch of texts."""
    raw, offsets = text_bytes(column)
    ids, bounds, chars = word_table(raw, offsets)
    n_words = np.diff(bounds)
    symbol = np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    repeat_words, covered, longest = repeats(ids, bounds)
    return {
        "n_words": n_words,
        "word_chars": row_sums(chars, bounds),
        "n_symbols": row_sums(symbol[raw], offsets),
        "n_dup_lines": duplicate_lines(raw, offsets),
        "n_repeat_words": repeat_words,
        "covered_words": covered,
        "longest_repeat": longest,
    }


def annotate(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (default: all) and the measures, ``covered_fraction``, ``base_failed`` and ``kept``, their names after ``prefix``; no shuffle.

    Columns of the input with a result's name give way to it, unless ``prefix``
    sets the results apart.
    """
    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
    made = [*measures, "covered_fraction", "base_failed", "kept"]
    named = {(prefix + m).lower() for m in made}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in named]
    # a text that is kept goes to the task once
    at = keep.index(text_col) if text_col in keep else len(keep)
    text = f"in{at}"
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(keep)], *([F.col(f"`{text_col}`").alias(text)] if at == len(keep) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, text):
            got = measure(b.column(at))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *(pa.array(got[m].astype(np.int64)) for m in measures)], [*(f"in{i}" for i in range(len(keep))), *measures])

    schema = ", ".join([*(f"in{i} {rows.schema[f'in{i}'].dataType.simpleString()}" for i in range(len(keep))), *(f"{m} long" for m in measures)])
    out = rows.mapInArrow(run, schema)
    out = out.withColumn("covered_fraction", F.when(F.col("n_words") > 0, F.col("covered_words") / F.col("n_words")).otherwise(F.lit(0.0)))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("covered_fraction") <= max_covered) & (F.col("longest_repeat") <= max_repeat))
    return out.select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(keep)], *[F.col(m).alias(prefix + m) for m in made])
