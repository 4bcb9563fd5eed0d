"""A very hot bucket of near copies: pairs around pivots stay fewer than its rows, blocks bound a task, and no member is lost."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from mudline.llm import near_copies


def test_hot_bucket_makes_fewer_pairs_than_rows():
    n = 20_000
    rng = np.random.default_rng(5)
    sketch = np.tile(rng.integers(0, 256, near_copies.BANDS * near_copies.ROWS, np.uint8), (n, 1))
    sketch[np.arange(n), rng.integers(0, sketch.shape[1], n)] ^= 1
    got = list(near_copies.around_pivots(sketch, np.arange(n), rng.permutation(n)))
    assert sum(len(a) for a, _ in got) == n - 1


def cloud(spark, n, groups, seed):
    """Members of one bucket whose sketches lie around ``groups`` centres."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 256, (groups, near_copies.BANDS * near_copies.ROWS), np.uint8)
    sketch = centres[np.arange(n) % groups]
    sketch[np.arange(n), rng.integers(0, sketch.shape[1], n)] ^= 1
    rows = [(7, i, i, bytes(s)) for i, s in enumerate(sketch)]
    return spark.createDataFrame(rows, "key long, node long, label long, sketch binary")


def test_hot_bucket_is_dealt_in_blocks(spark, monkeypatch):
    """Pivots reach every block of a bucket, and the pairs of all blocks are those of one."""
    members = cloud(spark, 900, 3, 1)
    monkeypatch.setattr(near_copies, "BLOCK", 50)
    around = near_copies.around_candidates(members).collect()
    assert 3 * 18 <= len(around) < 900 * 3
    # the pivot of the whole bucket is in each block, so its group is linked at once
    ends = {}
    for r in around:
        ends.setdefault(r.a, set()).add(r.b)
        ends.setdefault(r.b, set()).add(r.a)
    assert max(map(len, ends.values())) >= 299 - 18
    # sets as alike as the sketches: 60 shared hashes of each centre and one of its own
    sets = spark.createDataFrame([(i, sorted([*range(1000 * (i % 3), 1000 * (i % 3) + 60), 5000 + i])) for i in range(900)], "node long, hashes array<long>")
    labelled = members.withColumn("label", F.when(F.col("node") % 3 == 0, -1 - F.col("node") % 2).otherwise(F.col("label")))
    label = {r.node: r.label for r in labelled.collect()}

    def groups(pairs):
        parent = {x: x for x in label.values()}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            assert a % 3 == b % 3 and label[a] != label[b]
            parent[find(label[a])] = find(label[b])
        return len({find(x) for x in parent})

    for block in (50, 5000):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        few = [tuple(r) for r in near_copies.all_candidates(labelled, sets).collect()]
        assert groups(few) == 3 and len(few) < 900 * 40


def test_estimate_of_long_sets():
    """Sets over the carried size are judged by their smallest hashes, within the slack."""
    rng = np.random.default_rng(9)
    pool = rng.permutation(np.unique(rng.integers(0, 1 << 64, 60_000, np.uint64)))
    for share in (0.6, 0.8, 0.95):
        n = 20_000
        common = int(2 * n * share / (1 + share))
        x, y = np.sort(pool[:n]), np.sort(np.concatenate([pool[:common], pool[n : 2 * n - common]]))
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        got, exact = near_copies.shared_part(x[: near_copies.CARRIED], y[: near_copies.CARRIED], (len(x), len(y)))
        assert not exact and abs(got - true) < near_copies.SLACK


def test_same_words_in_other_order(spark):
    """Texts of the same words in another order are no near copies, and copies of them are."""
    rng = np.random.default_rng(6)
    words = np.array([f"word{i}x" for i in range(120)])
    rows = []
    for k in range(200):
        text = rng.permutation(words).tolist()
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join([*text, str(k)]))]
    got = near_copies.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.component_id == r.id - r.id % 2 for r in got) and len(got) == 400
