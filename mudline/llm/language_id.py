"""Language identification with character language models (operator 5).

For each language an interpolated Kneser-Ney model of character n-grams inside
words is fitted on a bounded sample (``SAMPLE`` texts a language, an equal
number for calibration).  All models share sorted arrays of n-gram hashes; a row
holds every language's log-probability, so one search serves all languages.  A
batch scores each distinct word once.  The language of lowest cross-entropy,
length-normalised over the text's characters, wins.

``score`` is the winner's posterior; log-probabilities are divided by the root of
the text's length and by a temperature fitted on the calibration texts.
``rejected`` is true where no language can be told: no letter, a score under
``MIN_SCORE``, or a cross-entropy over a limit.  The limit is far over what the
calibration texts of the winner show at this length, and at least halfway to what
they show under the nearest other language, so that noisy or partly foreign texts
stay and texts of none of the languages go.

Defined results: null texts and texts without a letter are ``und`` with score 0
and rejected; repeated rows give repeated results and teach once; of languages
with equal cross-entropy the first by name wins; very long texts are scored whole
and teach spans spread over them (see ``lesson``); an empty table gives an empty
one; with no row to learn from every text is ``und``.  Columns of the input with
a result's name give way to it, unless ``prefix`` sets the results apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mudline.llm.batches import by_bytes, distinct_runs, row_sums, spans_of, text_bytes
from mudline.llm.sampling import lesson, per_class_sample

ORDER = 4
SAMPLE = 600
MIN_SCORE = 0.5
SPREADS = 6.0
CACHE_WORDS = 200_000
#: Signs beyond ASCII that are no letters: Latin-1 signs, punctuation, symbols, wide forms (fixed values).
SIGNS = r"[\x{80}-\x{A9}\x{AB}-\x{B4}\x{B6}-\x{B9}\x{BB}-\x{BF}\x{D7}\x{F7}\x{2000}-\x{2BFF}\x{3000}-\x{303F}\x{FF00}-\x{FF0F}]+"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TEMPERATURES = (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 1.0, 1.5, 2.0)


def letter_words(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-cased letter runs as indexes into distinct words, and each text's bounds."""
    plain = pc.replace_substring_regex(pc.fill_null(column, "").cast(pa.large_string()), SIGNS, " ")
    raw, offsets = text_bytes(pc.utf8_lower(plain))
    mask = ((raw >= 97) & (raw <= 122)) | (raw >= 0x80)
    starts, ends, bounds = spans_of(mask, offsets)
    index, distinct = distinct_runs(raw, mask, starts, ends)
    return index, distinct, bounds


def symbols(words: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points + 2 of all words end to end, each with order - 1 starts (0) before and one end (1) after; bounds."""
    raw, offsets = text_bytes(words.cast(pa.large_string()))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64) + 2
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[offsets]
    size = np.diff(lead) + order
    bounds = np.concatenate([[0], np.cumsum(size)])
    out = np.zeros(int(bounds[-1]), np.int64)
    out[bounds[1:] - 1] = 1
    out[np.arange(len(points)) + np.repeat(bounds[:-1] - lead[:-1] + order - 1, np.diff(lead))] = points
    return out, bounds


def hashes(sym: np.ndarray, order: int) -> np.ndarray:
    """Hash of the ``order`` symbols that end at each place (places too near the start: of fewer)."""
    out = np.zeros(len(sym), np.uint64)
    for k in range(order - 1, -1, -1):
        shifted = np.zeros(len(sym), np.uint64)
        shifted[k:] = sym[: len(sym) - k].astype(np.uint64) + np.uint64(1)
        out = (out ^ shifted) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Models:
    """Sorted hash arrays of each order, with a row of log-probabilities or backoff weights per language."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    logp: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: np.ndarray
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None
    halfway: np.ndarray | None = None

    def word_scores(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each word under each language, and its number of symbols."""
        sym, bounds = symbols(words, self.order)
        predicted = np.ones(len(sym), bool)
        for k in range(self.order - 1):
            predicted[bounds[:-1] + k] = False
        at = np.flatnonzero(predicted)
        out = np.zeros((len(at), len(self.languages)), np.float32)
        todo = np.arange(len(at))
        for o in range(self.order, 0, -1):
            keys = hashes(sym, o)[at[todo]]
            found, place = lookup(self.grams[o - 1], keys)
            out[todo[found]] += self.logp[o - 1][place[found]]
            todo = todo[~found]
            if not todo.size:
                break
            if o > 1:
                before = hashes(sym, o - 1)[at[todo] - 1]
                known, place = lookup(self.contexts[o - 2], before)
                out[todo[known]] += self.backoff[o - 2][place[known]]
        out[todo] += self.floor
        sizes = np.diff(bounds) - self.order + 1
        return np.add.reduceat(out, np.cumsum(sizes) - sizes, axis=0, dtype=np.float64) if len(sizes) else np.zeros((0, len(self.languages))), sizes


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    place = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[place] == keys, place


def fit(words: list[bytes], language: np.ndarray, counts: np.ndarray, languages: list[str], order: int = ORDER) -> Models:
    """Interpolated Kneser-Ney models from word counts per language."""
    n_lang = len(languages)
    sym, bounds = symbols(pa.array(words, pa.large_binary()), order)
    lang = np.repeat(language, np.diff(bounds))
    weight = np.repeat(counts, np.diff(bounds)).astype(np.float64)
    predicted = np.ones(len(sym), bool)
    for k in range(order - 1):
        predicted[bounds[:-1] + k] = False
    at = np.flatnonzero(predicted)
    hashed = [hashes(sym, o) for o in range(1, order + 1)]
    grams, tables, suffix, context, initial = [], [], [], [], []
    for o in range(1, order + 1):
        keys, where, inverse = np.unique(hashed[o - 1][at], return_index=True, return_inverse=True)
        c = np.zeros((len(keys), n_lang))
        np.add.at(c, (inverse, lang[at]), weight[at])
        grams.append(keys)
        tables.append(c)
        suffix.append(np.searchsorted(grams[o - 2], hashed[o - 2][at[where]]) if o > 1 else None)
        context.append(hashed[o - 2][at[where] - 1] if o > 1 else np.zeros(len(keys), np.uint64))
        initial.append(sym[at[where] - o + 1] == 0)
    for o in range(1, order):  # lower orders count what they continue; only padding stands before the grams of a word's start
        c = np.zeros_like(tables[o - 1])
        np.add.at(c, suffix[o], (tables[o] > 0).astype(np.float64))
        tables[o - 1] = np.where(initial[o - 1][:, None], tables[o - 1], c)
    uniform = 1.0 / (len(grams[0]) + 1)
    below, logp, contexts, backoff = None, [], [], []
    for o in range(1, order + 1):
        c = tables[o - 1]
        once, twice = (c == 1).sum(0), (c == 2).sum(0)
        d = np.where(once + 2 * twice > 0, np.maximum(once, 0.5) / np.maximum(once + 2 * twice, 1), 0.5)
        ctx, inverse = np.unique(context[o - 1], return_inverse=True)
        total, kinds = np.zeros((len(ctx), n_lang)), np.zeros((len(ctx), n_lang))
        np.add.at(total, inverse, c)
        np.add.at(kinds, inverse, (c > 0).astype(np.float64))
        left = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
        lower = below[suffix[o - 1]] if o > 1 else np.full(c.shape, uniform)
        p = np.where(total[inverse] > 0, np.maximum(c - d, 0) / np.maximum(total[inverse], 1), 0.0) + left[inverse] * lower
        below = p
        logp.append(np.log(p).astype(np.float32))
        if o > 1:
            contexts.append(ctx)
            backoff.append(np.log(left).astype(np.float32))
        else:
            floor = np.log(left[0] * uniform).astype(np.float32)
    return Models(languages, order, grams, logp, contexts, backoff, floor)


def text_scores(models: Models, cache: dict, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each text under each language, and its number of symbols."""
    index, distinct, bounds = letter_words(column)
    if len(cache.setdefault("rows", {})) > CACHE_WORDS or "scores" not in cache:
        cache.update(rows={}, scores=np.zeros((0, len(models.languages))), sizes=np.zeros(0, np.int64))
    listed = distinct.to_pylist()
    get = cache["rows"].get
    rows = np.fromiter((get(w, -1) for w in listed), np.int64, len(listed))
    new = np.flatnonzero(rows < 0)
    if new.size:
        scores, sizes = models.word_scores(distinct.take(pa.array(new)))
        rows[new] = np.arange(len(new)) + len(cache["sizes"])
        cache["rows"].update(zip((listed[i] for i in new.tolist()), rows[new].tolist(), strict=True))
        cache["scores"] = np.concatenate([cache["scores"], scores])
        cache["sizes"] = np.concatenate([cache["sizes"], sizes])
    scores, sizes = cache["scores"][rows], cache["sizes"][rows]
    out = np.stack([row_sums(scores[index, k], bounds) for k in range(scores.shape[1])], axis=1)
    return out, row_sums(sizes[index], bounds)


def evidence(scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How far each language is behind the best, over the root of the length."""
    return np.minimum(scores - scores.max(1, keepdims=True), 0) / np.sqrt(np.maximum(sizes, 1))[:, None]


def decide(models: Models, scores: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Winner, its posterior, its cross-entropy in nats, and rejection."""
    best = scores.argmax(1)
    top = scores.max(1)
    posterior = 1 / np.exp(evidence(scores, sizes) * models.temperature).sum(1)
    entropy = -top / np.maximum(sizes, 1)
    usual = SPREADS * np.sqrt(models.spread[best, 0] ** 2 + models.spread[best, 1] ** 2 / np.maximum(sizes, 1))
    limit = models.mean[best] + np.maximum(usual, models.halfway[best])
    return best, np.where(letters, posterior, 0.0), entropy, ~letters | (posterior < MIN_SCORE) | (entropy > limit)


def calibrate(models: Models, truth: np.ndarray, scores: np.ndarray, sizes: np.ndarray) -> None:
    """Temperature by log-loss; mean and spread of the cross-entropy by language, for long and short texts; half the way to the nearest other language."""
    n = len(models.languages)
    gap = evidence(scores, sizes) if len(scores) else scores
    losses = [float((np.log(np.exp(gap * t).sum(1)) - gap[np.arange(len(truth)), truth] * t).mean()) if len(truth) else 0.0 for t in TEMPERATURES]
    models.temperature = TEMPERATURES[int(np.argmin(losses))]
    models.mean, models.spread, models.halfway = np.full(n, np.inf), np.zeros((n, 2)), np.zeros(n)
    for k in range(n):
        own = (truth == k) & (sizes > 0)
        if own.sum() < 10:
            continue
        entropy = -scores[own, k] / sizes[own]
        long = sizes[own] >= np.median(sizes[own])
        models.mean[k] = entropy[long].mean()
        if n > 1:
            others = -np.delete(scores[own], k, axis=1).max(1) / sizes[own]
            models.halfway[k] = max(0.0, float(np.median(others - entropy)) / 2)
        models.spread[k] = entropy[long].std(), ((entropy[~long] - models.mean[k]) * np.sqrt(sizes[own][~long])).std() if (~long).any() else 0.0


def learn(docs: DataFrame, usable: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Models | None:
    """Models from at most about ``sample`` texts a language to count and as many to calibrate; None without any."""
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chosen, counts = per_class_sample(rows, "lang", ["id", "text"], 2 * sample)
    if not counts:
        return None
    languages = sorted(counts)
    halves = chosen.withColumn("half", F.pmod(F.xxhash64("id", "text", F.lit("half")), F.lit(2)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            langs = np.array(b.column(0).to_pylist(), object)
            index, distinct, bounds = letter_words(b.column(1))
            for lang in sorted(set(langs)):
                seen = np.bincount(index[np.repeat(langs == lang, np.diff(bounds))], minlength=len(distinct))
                some = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), distinct.take(pa.array(some)).cast(pa.binary()), pa.array(seen[some])], ["lang", "word", "n"])

    counted = halves.filter("half = 0").select("lang", lesson(F.col("text")).alias("text")).mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    number = {k: i for i, k in enumerate(languages)}
    models = fit(counted["word"].to_pylist(), np.array([number[x] for x in counted["lang"].to_pylist()], np.int64), counted["n"].to_numpy(), languages) if len(counted) else None
    if models is None:
        return None
    held = scored(halves.filter("half = 1").select("lang", "text"), models, "lang").toArrow()
    scores = np.array(held["scores"].to_pylist(), np.float64).reshape(-1, len(languages))
    calibrate(models, np.array([number[x] for x in held["id"].to_pylist()], np.int64), scores, held["sizes"].to_numpy())
    return models


def scored(rows: DataFrame, models: Models, id_col: str) -> DataFrame:
    """``id``, ``scores`` (one per language) and ``sizes`` of each row's ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in by_bytes(batches, "text"):
            scores, sizes = text_scores(shared.value, cache, b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1, dtype=np.int32) * scores.shape[1]), pa.array(scores.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(sizes)], ["id", "scores", "sizes"])

    return rows.select(F.col(id_col).alias("id"), "text").mapInArrow(run, f"id {rows.schema[id_col].dataType.simpleString()}, scores array<double>, sizes long")


def predict(docs: DataFrame, models: Models | None, text_col: str = "text", keep: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The columns ``keep`` (default: all) with ``lang_pred``, ``score``, ``cross_entropy`` and ``rejected``, their names after ``prefix``; no shuffle."""
    made = ["lang_pred", "score", "cross_entropy", "rejected"]
    named = {(prefix + c).lower() for c in made}
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in named]
    if models is None:
        results = {"lang_pred": F.lit("und"), "score": F.lit(0.0), "cross_entropy": F.lit(0.0), "rejected": F.lit(True)}
        return docs.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(prefix + c) for c, v in results.items()])
    # a text that is kept goes to the task once
    at = keep.index(text_col) if text_col in keep else len(keep)
    text = f"in{at}"
    rows = docs.select(*[F.col(f"`{c}`").alias(f"in{i}") for i, c in enumerate(keep)], *([F.col(f"`{text_col}`").alias(text)] if at == len(keep) else []))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for b in by_bytes(batches, text):
            column = b.column(at)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            best, score, entropy, rejected = decide(shared.value, *text_scores(shared.value, cache, column), letters)
            names = pa.array(shared.value.languages, pa.string()).take(pa.array(best))
            told = pc.if_else(pa.array(letters), names, "und")
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], told, pa.array(score), pa.array(entropy), pa.array(rejected)], [*(f"in{i}" for i in range(len(keep))), *made])

    schema = ", ".join([*(f"in{i} {rows.schema[f'in{i}'].dataType.simpleString()}" for i in range(len(keep))), "lang_pred string, score double, cross_entropy double, rejected boolean"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"in{i}").alias(c) for i, c in enumerate(keep)], *[F.col(c).alias(prefix + c) for c in made])
