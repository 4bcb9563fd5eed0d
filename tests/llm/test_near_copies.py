"""Near copies by exact Jaccard, against brute force."""

from __future__ import annotations

import random

import numpy as np

from mudline.llm import near_copies


def test_added_and_replaced_paragraphs(spark):
    """One paragraph added or replaced, similar to 0.65 to 0.95: the pairs of brute-force Jaccard at 0.8, and no others."""
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    rows = []
    for base in range(300):
        n = rng.randint(100, 500)
        text = [rng.choice(words) for _ in range(n)]
        new = [rng.choice(words) for _ in range(max(1, int(n * rng.uniform(0.03, 0.4))))]
        at = rng.randrange(n)
        other = text[:at] + new + text[at + (len(new) // 2 if base % 2 else 0) :]
        rows += [(2 * base, " ".join(text)), (2 * base + 1, " ".join(other))]
    sets = []
    for _, t in rows:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    want = {i for i in range(0, 600, 2) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])}
    got = {r.id for r in near_copies.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).filter("id <> component_id").collect()}
    found = {i - 1 for i in got}
    assert 100 < len(want) < 250 and found <= want
    assert len(found) >= 0.98 * len(want)


def test_stated_miss_rate():
    """Sets similar to exactly 0.8 share a key and agree in sketch in over 99 of 100 cases."""
    rng = np.random.default_rng(3)
    salt, factor = near_copies.salts()
    met = 0
    for _ in range(1000):
        h = rng.integers(0, 1 << 64, 220, np.uint64)
        a, b = (near_copies.minima(x, salt, factor) for x in (h[:198], np.concatenate([h[:176], h[198:]])))
        alike = ((a >> np.uint64(40)).astype(np.uint8) == (b >> np.uint64(40)).astype(np.uint8)).sum() >= near_copies.SKETCH
        met += bool(set(near_copies.band_keys(a)) & set(near_copies.band_keys(b))) and alike
    assert met >= 990


def test_chain_through_one_bucket(spark):
    """A chain of edits whose ends are unlike is one group, whichever rows are pivots."""
    rng = random.Random(2)
    text = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = []
    for i in range(40):
        rows.append((i, " ".join(text)))
        at = 7 * i
        text = text[:at] + [f"w{rng.randrange(10**6)}" for _ in range(20)] + text[at + 20 :]
    got = near_copies.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0}


def test_simhash_fingerprints_are_probed(spark, monkeypatch):
    """Copies of one changed word are found by their SimHash fingerprints alone; without bands nothing else links them, and unlike texts of near fingerprints stay apart."""
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:399], "other"]), " ".join(f"v{i}" for i in range(400)), "", " "]
    monkeypatch.setattr(near_copies, "band_keys", lambda least: [])
    got = {r.id: r.component_id for r in near_copies.similar_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 3}
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 3), (4, 255)], "node long, fp long")
    assert sorted(map(tuple, near_copies.fingerprint_candidates(nodes).collect())) == [(1, 2), (1, 3)]
