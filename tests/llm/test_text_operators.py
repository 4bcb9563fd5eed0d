"""Text operators against brute-force versions, over nulls, empty, very long, repeated and awkward texts."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from mudline.llm import bpe, language_id, license_scan, packing, quality_classifier, quality_rules, simhash, token_files

RNG = random.Random(11)
PARTS = ["a ", "b ", "c\n", "é ", "foo ", " ", "\t", "\n", "#", "don't ", "İx ", "12½ ", "<|endoftext|>", "under the MIT license ", "Straße ", "日本 ", "é "]
TEXTS = [None, "", " \n", "one", "x" * 3000, "Ab" * 900 + " tail", "same line\nsame line\nsame line", *("".join(RNG.choice(PARTS) for _ in range(RNG.randint(1, 60))) for _ in range(150)), "dup text here", "dup text here"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "clash", 0.5) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id", None, None, None, None, None), (5, TEXTS[5], "en", "s", 1, "clash", 0.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_bpe_equals_the_library(docs, none):
    library = bpe.load(bpe.default_path()).library
    got = by_id(bpe.encode_decode(docs))
    for i, t in enumerate(TEXTS):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == ids, t
        assert got[i].decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode(docs).count() == docs.count() and bpe.encode(none).count() == 0
    assert by_id(bpe.decode(bpe.encode(docs)))[5].text == got[5].decoded


@pytest.mark.parametrize("alphabet", ["ab", "etaoin", "aé", "!?.", "tion"])
def test_tree_concatenation_is_exact(alphabet):
    model = bpe.load(bpe.default_path())
    rng = random.Random(alphabet)
    words = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (33, 64, 65, 500, 1777)] + [alphabet * 300]
    flat, counts = model.encode_texts(pa.array(words))
    ends = np.cumsum(counts)
    for w, e, n in zip(words, ends, counts, strict=True):
        assert flat[e - n : e].tolist() == model.library.encode(w, add_special_tokens=False).ids


@pytest.mark.parametrize("top", [1, 2, 300, 50_000, 2**31, 2**60, 2**63])
def test_simple8b_round_trip(top):
    rng = np.random.default_rng(top % 97)
    for n in (0, 1, 255, 256, 257, 3000):
        v = rng.integers(0, top, n).astype(np.uint64)
        v[20:200] = 0
        words, first, escapes = token_files.pack(v)
        assert (token_files.unpack(words, first, escapes, n) == v).all()


def test_token_files(spark, docs, none, tmp_path):
    library = bpe.load(bpe.default_path()).library
    totals = token_files.write_token_files(docs, f"file://{tmp_path}/f", ids_per_file=500)
    got = token_files.read_token_files(spark, f"file://{tmp_path}/f", totals).orderBy("start").collect()
    assert len(got) == docs.count() and sum(1 for _ in (tmp_path / "f").glob("*.s8b")) > 3
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        if r.doc_id is not None:
            assert r.ids == [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    empty = token_files.write_token_files(none, f"file://{tmp_path}/g")
    assert token_files.read_token_files(spark, f"file://{tmp_path}/g", empty).count() == 0


def test_packing(docs, none):
    library = bpe.load(bpe.default_path()).library
    got = packing.pack(docs, window=256, piece=64).collect()
    by_doc = Counter()
    for r in got:
        if r.doc_id is not None:
            ids = [*library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, 1]
            assert r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
            by_doc[r.doc_id] += r.length
    for i, t in enumerate(TEXTS):
        assert by_doc[i] == (len(library.encode(t or "", add_special_tokens=False).ids) + 1) * (2 if i == 5 else 1)
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(none).count() == 0


def test_differencing_levels_windows():
    sizes = [RNG.randint(20, 400) for _ in range(400)]
    sets = packing.windows(sizes, 2048)
    assert sorted(i for s in sets for i in s) == list(range(400))
    sums = [sum(sizes[i] for i in s) for s in sets]
    assert max(sums) <= 2048 and sum(sums) / (2048 * len(sets)) > 0.97 and max(sums) - min(sums) < 60
    assert packing.differencing([], 3) == [] and packing.windows([2048, 1], 2048) == [[0], [1]]


def brute_rules(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)

    def marked(k):
        grams = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
        return len({j for i in range(len(w) - k + 1) if grams[tuple(w[i : i + k])] > 1 for j in range(i, i + k)})

    longest = 0
    while longest < len(w) and max(Counter(tuple(w[i : i + longest + 1]) for i in range(len(w) - longest)).values()) > 1:
        longest += 1
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, marked(3), marked(quality_rules.MIN_REPEAT), longest


def test_quality_rules(docs, none):
    got = by_id(quality_rules.annotate(docs))
    for i, t in enumerate(TEXTS):
        r, want = got[i], brute_rules(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.covered_words) == want[:6], t
        assert r.longest_repeat == (want[6] if want[6] > 1 else 0)
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert got[3].score == 0.5 and quality_rules.annotate(none).count() == 0


def test_repetition_goes_and_prose_stays(spark):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(400))
    copied = prose + "\n" + " ".join(prose.split()[:90])
    got = by_id(quality_rules.annotate(spark.createDataFrame([(1, prose), (2, copied)], "doc_id long, text string")))
    assert got[1].kept and not got[2].kept and got[2].longest_repeat == 90


def brute_fingerprint(text, shingle):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(items, linked):
    """Each item with the smallest one that links reach."""
    items = sorted(items)
    parent = {i: i for i in items}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in items:
        for b in items:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in items}


def components(prints, distance):
    return groups_of(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= distance)


def test_simhash(docs, none):
    rows = simhash.near_duplicates(docs).collect()
    prints = {i: brute_fingerprint(t, 3) for i, t in enumerate(TEXTS)}
    want = components(prints, 2)
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    assert simhash.near_duplicates(none).count() == 0


def shingle_sets(text, shingle=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())


def similar(a, b):
    x, y = shingle_sets(a), shingle_sets(b)
    return 5 * len(x & y) >= 4 * len(x | y)


def test_deduplication(docs, none):
    want = groups_of(range(len(TEXTS)), lambda a, b: similar(TEXTS[a], TEXTS[b]))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted(set(want.values()))
    assert simhash.deduplicate(none).count() == 0
    assert {r.text for r in kept.filter("doc_id IS NULL").collect()} == {"no id"}


def test_rows_that_share_an_id_are_told_apart(spark):
    """A repeated id loses no text, and a group that repeated ids span keeps one row."""
    rng = random.Random(8)
    a, b, c = (" ".join(rng.choice("abcdefghij") * rng.randint(1, 9) for _ in range(60)) for _ in range(3))
    kept = lambda rows: sorted(((r.doc_id, r.text) for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(3)).collect()), key=str)
    same_id = kept([(5, a, 1), (5, b, 2), (5, c, 3)])
    order = lambda rows: sorted(rows, key=str)
    assert same_id == order([(5, a), (5, b), (5, c)])
    assert kept([(3, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (7, c, 5)]) == order([(3, a), (5, b), (7, c)])
    assert kept([(3, a, 1), (3, a, 2), (3, a, 1), (None, a, 1)]) == [(3, a)]
    assert kept([(None, a, 1), (None, a, 2), (None, b, 3)]) == order([(None, a), (None, b)])


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    rows = []
    for base in range(40):
        text = [rng.choice(words) for _ in range(rng.randint(80, 400))]
        rows.append((base * 10, " ".join(text)))
        for copy in range(1, 4):
            edited = list(text)
            for place in rng.sample(range(len(text)), max(1, len(text) // 120)):
                edited[place] = rng.choice(words)
            rows.append((base * 10 + copy, " ".join(edited)))
        half = text[: len(text) // 2] + [rng.choice(words) for _ in range(len(text) // 2)]
        rows.append((base * 10 + 5, " ".join(half)))  # half alike: no near copy
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len([i for i in kept if i % 10 in (0, 5)]) == 80
    assert len([i for i in kept if i % 10 in (1, 2, 3)]) <= 1


def test_hot_buckets_lose_no_link(spark):
    """A dense cloud of fingerprints overfills every bucket; finer masks must still find all links."""
    rng = np.random.default_rng(4)
    centre = np.uint64(0x123456789ABCDEF0)
    fps = {int(centre)}
    while len(fps) < 400:
        base = rng.choice(np.array(sorted(fps), np.uint64))
        for bit in rng.choice(64, rng.integers(1, 4), replace=False):
            base ^= np.uint64(1) << np.uint64(bit)
        fps.add(int(base))
    signed = np.array(sorted(fps), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(f, f) for f in signed], "node long, fp long")
    links = simhash.near_links(df, bucket=4)
    labels = {r.node: r.label for r in simhash.connected_components(links).collect()}
    want = components(dict(enumerate(int(np.int64(f).view(np.uint64)) for f in signed)), 2)
    groups = lambda labels: sorted(sorted(g) for g in _groups(labels))
    assert groups({i: labels.get(f, f) for i, f in enumerate(signed)}) == groups(want)


def _groups(labels):
    out = {}
    for k, v in labels.items():
        out.setdefault(v, []).append(k)
    return out.values()


def test_thresholds_by_dynamic_programming():
    assert simhash.allot([[0, 1, 50, 90], [0, 2, 40, 90], [0, 3, 60, 95]]) == [0, 0, 0]
    assert simhash.allot([[0, 1, 2, 90], [0, 2, 40, 90], [0, 900, 960, 995]]) == [1, 0, -1]
    assert simhash.allot([[0, 5, 6, 7], [0, 500, 600, 700], [0, 500, 600, 700]]) == [2, -1, -1]


def test_license_scan(docs, none):
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    texts = [*TEXTS, "See the Apache License, Version 2.0; (cc) by-nc x cc-by-nc. Licensed under the MIT License!", "SPDX-License-Identifier: GPL-3.0", "we commit license plates"]
    for t in texts:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        want = sorted((i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
        n, found = license_scan.scan(t)
        assert n == len(words)
        assert sorted((m["first_word"], m["label"]) for m in found if m["rule"] == "base") == want
    assert {m["label"] for m in license_scan.scan(texts[-2])[1]} == {"gpl-3"}
    assert license_scan.scan(texts[-1])[1] == []
    nested = license_scan.scan("released under the terms of the GNU Lesser General Public License version 2.1")[1]
    assert {m["label"] for m in nested} == {"lgpl-2.1"}
    assert license_scan.detect(docs).count() == docs.count() and license_scan.detect(none).count() == 0
    assert len(license_scan.compiled()[1]) > 200


def prose(words, rng, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def two_languages(spark):
    rng = random.Random(9)
    stems = {"xx": ["the", "tion", "and", "ing", "wh", "er"], "yy": ["der", "ung", "sch", "keit", "ß", "ein"]}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 3))) for _ in range(300)] for k, v in stems.items()}
    rows = [(i, prose(words[lang], rng, rng.randint(1, 80)), lang) for i, lang in enumerate(rng.choice(["xx", "xx", "yy"]) for _ in range(400))]
    return spark.createDataFrame([*rows, (1000, None, "xx"), (1001, "12 !! 34", None), (1002, "", "yy")], "doc_id long, text string, lang string")


def test_language_id(two_languages):
    models = language_id.learn(two_languages, F.col("doc_id") % 3 != 1)
    got = by_id(language_id.predict(two_languages, models))
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"} and all(got[i].rejected and got[i].score == 0 for i in (1000, 1001, 1002))
    held = [r for r in got.values() if r.doc_id < 1000 and r.doc_id % 3 == 1]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97 and np.mean([r.rejected for r in held]) < 0.03
    assert language_id.learn(two_languages.limit(0), F.lit(True)) is None
    assert language_id.predict(two_languages.limit(0), models).count() == 0
    assert {r.lang_pred for r in language_id.predict(two_languages, None).collect()} == {"und"}


def test_texts_of_no_known_language_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = language_id.learn(docs, F.lit(True))
    odd = spark.createDataFrame([(1, "qx7 zzkw jjqx vvkp wqzx " * 20), (2, "привет мир как дела " * 20), (3, "12345")], "doc_id long, text string")
    assert all(r.rejected for r in language_id.predict(odd, models).collect())
    long = language_id.predict(docs.filter("size(split(text, ' ')) >= 50"), models).collect()
    assert len(long) > 100 and sum(r.rejected for r in long) < 0.02 * len(long)


def test_kneser_ney_sums_to_one():
    models = language_id.fit([b"abab", b"ba", b"cab"], np.array([0, 0, 0]), np.array([3, 1, 2]), ["k"], order=3)
    alphabet = [ord(c) + 2 for c in "abc"] + [1]
    for history in ([0, 0], [0, ord("a") + 2], [ord("a") + 2, ord("b") + 2], [ord("c") + 2, ord("c") + 2]):
        total = 0.0
        for c in [*alphabet, ord("z") + 2]:
            sym, logp = np.array([*history, c], np.int64), 0.0
            for o in range(3, 0, -1):
                found, at = language_id.lookup(models.grams[o - 1], language_id.hashes(sym, o)[-1:])
                if found[0]:
                    logp += models.logp[o - 1][at[0], 0]
                    break
                if o > 1:
                    found, at = language_id.lookup(models.contexts[o - 2], language_id.hashes(sym, o - 1)[-2:-1])
                    logp += models.backoff[o - 2][at[0], 0] if found[0] else 0.0
            else:
                logp += models.floor[0]
            total += np.exp(logp)
        assert total == pytest.approx(1, abs=1e-4)


def test_quality_classifier(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice(["the", "ti", "on", "ea", "st", "er"]) for _ in range(rng.randint(1, 3))) for _ in range(400)]
    good = lambda: prose(words, rng, rng.randint(60, 300)).capitalize() + "."
    bad = lambda: " ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in good().upper().split())
    rows = [(i, good() if i % 3 else bad()) for i in range(500)] + [(900, None), (901, ""), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(None, 1), (3, None), (7777, 0)], "doc_id long, quality int")
    model = quality_classifier.learn(docs, labels, F.col("doc_id") % 4 != 2)
    got = by_id(quality_classifier.score(docs, model))
    held = [r for r in got.values() if r.doc_id is not None and r.doc_id < 900 and r.doc_id % 4 == 2]
    assert np.mean([r.predicted == int(r.doc_id % 3 > 0) for r in held]) > 0.95
    assert 0 <= got[900].score == got[901].score <= 1
    assert quality_classifier.learn(docs, labels.limit(0), F.lit(True)) is None
    assert {r.score for r in quality_classifier.score(docs, None).collect()} == {0.5}
    assert quality_classifier.score(docs.limit(0), model).count() == 0


def test_equal_rows_are_dealt_to_many_files(spark, tmp_path):
    """A third of the rows are one row, and another third have neither id nor text."""
    rows = [(5, "one text")] * 400 + [(None, None)] * 400 + [(i, f"text {i}") for i in range(100, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    totals = token_files.write_token_files(docs, str(tmp_path))
    assert max(r.n_ids for r in totals.collect()) < 0.5 * sum(r.n_ids for r in totals.collect())
    got = token_files.read_token_files(spark, str(tmp_path), totals).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [sum(g.n_tokens for g in got[:k]) for k in range(len(got))]
