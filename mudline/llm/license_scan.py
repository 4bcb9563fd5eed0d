"""License scans with ordered signature rules (operator 10).

A text becomes lower-case words with one space between.  One Aho-Corasick pass
finds the keywords of the rules; only rules of which a keyword occurs run.  Matches
are intervals of words.  A match goes if its interval lies inside that of a
match of higher priority (an equal interval: of an earlier rule), or inside a
sentence that denies a license, which comes before all rules; matches of the
base phrases always stay.

Defined results: null and empty texts have no words and no labels; repeated rows
give repeated results; of equal intervals the earlier rule stays; very long texts
are scanned whole; other columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mudline.llm.batches import by_bytes
from mudline.llm.license_rules import BASE, Rule, build_rules, denials

#: A-Z become a-z; all ASCII but digits and letters becomes a space.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


denied = lru_cache(maxsize=1)(denials)


@lru_cache(maxsize=1)
def compiled() -> tuple[ahocorasick.Automaton, list[Rule]]:
    rules = build_rules()
    by_word: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        for word in r.keywords:
            by_word.setdefault(word, []).append(i)
    machine = ahocorasick.Automaton()
    for word, places in by_word.items():
        machine.add_word(f" {word} ", tuple(places))
    machine.make_automaton()
    return machine, rules


def suppress(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (first, last, rule): those that lie in no match of an earlier rule."""
    kept, left = [], []
    # by start, the longest first: what contains a match comes before it
    for first, last, rule in sorted(found, key=lambda m: (m[0], -m[1], m[2])):
        left = [m for m in left if m[1] >= first]
        if not any(m[1] >= last and m[2] < rule for m in left):
            kept.append((first, last, rule))
        left.append((first, last, rule))
    return kept


def scan(text: str | None) -> tuple[int, list[dict]]:
    """Number of words, and the matches that stay: label, rule, first_word, last_word, strength."""
    words = (text or "").encode().translate(WORD_BYTES).split()
    padded = " " + b" ".join(words).decode("latin-1") + " "
    gaps = np.flatnonzero(np.frombuffer(padded.encode("latin-1"), np.uint8) == 32)
    word_at = lambda place: int(np.searchsorted(gaps, place))  # noqa: E731  spaces before a place
    out = []
    for phrase, label in BASE:
        at = padded.find(f" {phrase} ")
        while at >= 0:
            first = word_at(at)
            out.append({"label": label, "rule": "base", "first_word": first, "last_word": first + phrase.count(" "), "strength": 1.0})
            at = padded.find(f" {phrase} ", at + 1)
    machine, rules = compiled()
    wanted = sorted({i for _, places in machine.iter(padded) for i in places})
    found = []
    for i in wanted:
        for m in rules[i].pattern.finditer(padded):
            first = word_at(m.start()) - 1
            found.append((first, first + m.group().count(" "), i))
    if found:
        for m in denied().finditer(padded):
            first = word_at(m.start()) - 1
            found.append((first, first + m.group().count(" "), -1))
    for first, last, i in suppress(found):
        if i < 0:
            continue
        out.append({"label": rules[i].label, "rule": rules[i].phrasing, "first_word": first, "last_word": last, "strength": rules[i].strength})
    return len(words), out


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_words`` and ``matches`` (array of label, rule, first_word, last_word, strength) of each row; no shuffle."""
    match = pa.struct([("label", pa.string()), ("rule", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("strength", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text"):
            got = [scan(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([m for _, m in got], pa.list_(match))], ["id", "n_words", "matches"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, matches array<struct<label: string, rule: string, first_word: long, last_word: long, strength: double>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
