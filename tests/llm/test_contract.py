"""The registered queries over the whole small tables, column by column of their contracts, against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import zstandard
from pyspark.sql import functions as F

from mudline.llm import bpe, language_id, license_scan, quality_classifier, quality_rules, queries, simhash, token_files


@pytest.fixture(scope="module")
def texts(sf_dir):
    t = pq.read_table(f"{sf_dir}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist(), strict=True))


@pytest.fixture(scope="module")
def ids(texts):
    library = bpe.load(bpe.default_path()).library
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}


def rows(spark, sf_dir, name, key="doc_id"):
    got = queries.QUERIES[name](spark, sf_dir).collect()
    return {r[key]: r for r in got}, got


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_op1(spark, sf_dir, texts):
    got, every = rows(spark, sf_dir, "op1_quality_compression")
    assert len(every) == len(texts)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.learn(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), queries.fold("doc_id", 4) != 2)
    tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for i, t in texts.items():
        raw = (t or "").encode()
        n = math.ceil(len(raw) / 1000)
        sizes = [sum(len(c.compress(raw[len(raw) * k // n : len(raw) * (k + 1) // n])) for k in range(n)) for c in tools]
        difference = (sizes[1] - sizes[0]) / len(raw) if raw else 0.0
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * difference + model.intercept))), abs=1e-12)
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i].predicted == int(got[i].score >= 0.7)


def test_op2(spark, sf_dir, texts, ids):
    got, _ = rows(spark, sf_dir, "op2_bpe_tree")
    library = bpe.load(bpe.default_path()).library
    for i in texts:
        decoded = library.decode(ids[i], skip_special_tokens=False)
        want = (len(ids[i]), hashlib.sha256(" ".join(map(str, ids[i])).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want


def test_op3(spark, sf_dir, texts, ids):
    got, _ = rows(spark, sf_dir, "op3_simple8b_files")
    at = 0
    for i in sorted(texts):
        full = [*ids[i], 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(full), crc(full))
        at += len(full)


def test_op4(spark, sf_dir, texts):
    got, _ = rows(spark, sf_dir, "op4_suffix_array_rules")
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated), failed)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words, got[i].base_failed) == want
        assert not (failed and got[i].kept)


def test_op5(spark, sf_dir, texts):
    got, every = rows(spark, sf_dir, "op5_kneser_ney_language")
    assert len(every) == len(texts)
    for i, t in texts.items():
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= got[i].score <= 1
        assert (got[i].lang_pred == "und") == (not any(c.isalpha() for c in t or ""))


def brute_kneser_ney(words, order):
    """log p(symbol | history) of an interpolated model by dictionaries, with raw counts for grams that begin a word."""
    counts = [Counter() for _ in range(order + 1)]
    for word, n in words.items():
        s = ("^",) * (order - 1) + tuple(word) + ("$",)
        for at in range(order - 1, len(s)):
            counts[order][s[at - order + 1 : at + 1]] += n
            for o in range(1, order):
                counts[o][s[at - o + 1 : at + 1]] += n
    kept = {order: dict(counts[order])}
    for o in range(order - 1, 0, -1):
        left = defaultdict(set)
        for g in kept[o + 1]:
            left[g[1:]].add(g[0])
        kept[o] = {g: counts[o][g] if g[0] == "^" else len(left[g]) for g in counts[o]}
    letters = len(kept[1])
    discount = {}
    for o, c in kept.items():
        once, twice = (sum(v == k for v in c.values()) for k in (1, 2))
        discount[o] = max(once, 0.5) / max(once + 2 * twice, 1) if once + 2 * twice else 0.5

    def p(g):
        if not g:
            return 1 / (letters + 1)
        o, history = len(g), g[:-1]
        mine = {h: v for h, v in kept[o].items() if h[:-1] == history}
        total = sum(mine.values())
        if not total:
            return p(g[1:])
        return max(mine.get(g, 0) - discount[o], 0) / total + discount[o] * len(mine) / total * p(g[1:])

    return lambda word: sum(math.log(p(tuple((["^"] * (order - 1) + list(word) + ["$"])[k - order + 1 : k + 1]))) for k in range(order - 1, order + len(word)))


def test_kneser_ney_by_dictionaries():
    words = {"banana": 3, "bandana": 1, "band": 2, "an": 5, "nab": 1, "é": 1}
    models = language_id.fit([w.encode() for w in words], np.zeros(len(words), np.int64), np.array(list(words.values())), ["x"], order=4)
    score = brute_kneser_ney(words, 4)
    asked = ["banana", "ban", "bab", "zz", "a", "ndn", "é", "éz"]
    got, _ = models.word_scores(pa.array([w.encode() for w in asked], pa.large_binary()))
    assert got[:, 0].tolist() == pytest.approx([score(w) for w in asked], abs=1e-3)


def test_op6(spark, sf_dir, texts):
    got, _ = rows(spark, sf_dir, "op6_simhash_pigeonhole")
    prints = {i: int(simhash.fingerprint(t).hex(), 16) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    order = sorted(texts)
    values = np.array([prints[i] for i in order], np.uint64)
    for k, i in enumerate(order):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 2):
            a, b = find(i), find(order[k + 1 + j])
            parent[max(a, b)] = min(a, b)
    assert all((got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", find(i)) for i in texts)


def test_op7(spark, sf_dir, texts, ids):
    _, every = rows(spark, sf_dir, "op7_karmarkar_karp_packing")
    documents, windows = defaultdict(list), defaultdict(list)
    for r in every:
        documents[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i in texts:
        full, at = [*ids[i], 1], 0
        for r in sorted(documents[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(full) and r.ids_crc32 == crc(full[at : at + r.length])
            at += r.length
        assert at == len(full)
    for pieces in windows.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_op9(spark, sf_dir):
    got = queries.QUERIES["op9_hash_prefix_forest"](spark, sf_dir).collect()
    t = pq.read_table(f"{sf_dir}/embeddings.parquet")
    sound = [(i, np.array(v, np.float64)) for i, v in zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist(), strict=True) if v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    asked = [i for i, _ in sound if i % 50 == 0]
    hit = 0
    for q, x in sound:
        if q % 50:
            continue
        scores = sorted((-float(v @ x / math.sqrt((v @ v) * (x @ x))), i) for i, v in sound if i != q)[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(scores) + 1))
        exact = dict(sound)
        assert all(abs(r.score - float(exact[r.vec_id] @ x / math.sqrt((exact[r.vec_id] @ exact[r.vec_id]) * (x @ x)))) < 1e-12 for r in mine)
        hit += len({r.vec_id for r in mine} & {i for _, i in scores})
    assert hit >= 0.9 * 5 * len(asked)


def test_op10(spark, sf_dir, texts):
    got, _ = rows(spark, sf_dir, "op10_license_signatures")
    phrases = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        at = sorted((k, label) for p, label in phrases.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split())
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None)
        base = {label for _, label in at}
        assert r.base_labels == ",".join(sorted(base)) and base <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_texts_over_a_batch(spark, texts):
    """Texts longer than a batch, beside short ones and in rows with clashing columns, give what they give alone."""
    some = [t for t in texts.values() if t]
    long = "\n".join(some * (4_000_000 // sum(map(len, some)) + 1))
    docs = spark.createDataFrame([(1, "short text", "x", 1), (2, long, "y", 2), (3, None, "z", 3), (4, long[:50], "y", 4)], "doc_id long, text string, ids string, n_words int").coalesce(1)
    library = bpe.load(bpe.default_path()).library
    coded = {r.doc_id: r for r in bpe.encode_decode(docs).select("doc_id", F.size("ids").alias("n"), F.hash("ids").alias("h")).collect()}
    assert [coded[i].n for i in (1, 2, 3, 4)] == [len(library.encode(t, add_special_tokens=False).ids) for t in ("short text", long, "", long[:50])]
    rules = {r.doc_id: r for r in quality_rules.annotate(docs, keep=["doc_id"]).collect()}
    assert rules[2].n_words == len(re.findall(r"[^\x20\x09-\x0D]+", long)) and not rules[2].kept and rules[3].n_words == 0
    scans = {r.doc_id: r.n_words for r in license_scan.detect(docs).collect()}
    assert scans[2] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), long)))
    prints = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(docs).collect()}
    assert prints[2] == simhash.fingerprint(long).hex() and prints[3] == "0" * 16
    with pytest.raises(ValueError, match="integer"):
        token_files.write_token_files(docs.withColumn("doc_id", F.lit("a")), "/tmp/none")


def test_samples_never_empty():
    """The share of a class is exact at any size, and repeats count once."""
    from mudline.llm import sampling

    for n in (10, 1_000, 10**10, 10**15):
        share = sampling.bound(600, n) / sampling.RANGE
        assert share == pytest.approx(min(1.0, 600 / n), rel=1e-3) and sampling.bound(600, n) > 0


def test_repeated_and_missing_ids_do_not_fill_a_sample(spark):
    from mudline.llm import sampling

    base = spark.range(5000).selectExpr("id", "CAST(id AS STRING) AS text", "'a' AS lang")
    hot = spark.range(20000).selectExpr("CAST(NULL AS LONG) AS id", "'same' AS text", "'a' AS lang").unionByName(spark.range(20000).selectExpr("7L AS id", "'other' AS text", "'a' AS lang"))
    chosen, counts = sampling.per_class_sample(base.unionByName(hot), "lang", ["id", "text"], 600)
    assert counts == {"a": 45000} and 450 < chosen.count() < 750
