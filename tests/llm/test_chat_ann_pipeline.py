"""Quotation linking, the hash-prefix forest, and the pipeline, each against brute force."""

from __future__ import annotations

import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mudline.llm import ann_forest, chat_threads, queries, quality_rules

CHATS = [
    ("c", 1, "user", "Hello there, world!\nHow are you?"), ("c", 2, "assistant", "On Monday X wrote:\n> hello   THERE world\nFine."), ("c", 3, "user", "> Fine.\n>> Hello there, world\nGood"), ("c", 4, "user", "unrelated"),
    ("c", 5, "user", "> never said\nwhat"), ("d", 1, "user", "> quoted later\nfirst"), ("d", 2, "user", "quoted later"), ("c", 3, "user", "> Fine.\n>> Hello there, world\nGood"), (None, 1, "user", "> Fine."), ("e", None, None, None), ("e", 9, "user", ""),
    ("w", 1, "user", "A first line that the mail client\nwill wrap anew when it is quoted, and more words after it."), ("w", 2, "user", "> A first line that the mail\n> client will wrap anew\n> when it is quoted,\nYes."), ("w", 3, "user", ">> will wrap anew when it is quoted\n> Yes.\nNo."),
    ("w", 3, "user", "> A first line that the mail client\nanother text of the same turn"), ("w", 4, "user", "> No.\nwell"), ("w", 5, "user", "ok\n" * 3), ("w", 6, "user", "> ok\nfine"), ("w", 7, "user", "> ok then if you say so\nhm"),
]


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(*c, "x") for c in CHATS], "conv_id string, turn long, role string, text string, thread_root string")


def test_quotes_link_to_their_origin(chats):
    rows = chat_threads.link_quotes(chats).collect()
    assert len(rows) == len(CHATS)
    got = {(r.conv_id, r.turn): r for r in rows}
    assert [(got["c", t].reply_to, got["c", t].thread_root, got["c", t].depth) for t in range(1, 6)] == [(None, 1, 0), (1, 1, 1), (2, 1, 2), (None, 4, 0), (None, 5, 0)]
    assert got["c", 2].clean_text == "Fine." and got["c", 3].clean_text == "Good"
    assert got["d", 1].reply_to is None and got["e", None].clean_text == ""
    # wrapped anew, nested, and a turn of two texts
    assert got["w", 2].reply_to == 1 and got["w", 4].reply_to == 3 and got["w", 4].thread_root == 1 and got["w", 4].depth == 3
    assert sorted(r.reply_to for r in rows if (r.conv_id, r.turn) == ("w", 3)) == [1, 2]
    assert got["w", 6].reply_to == 5 and got["w", 7].reply_to is None
    assert chat_threads.link_quotes(chats.limit(0)).count() == 0
    assert got["c", 2].formatted == "<|assistant|>\nFine.\n"


def long_chats(n=3000, seed=4):
    """Conversations of messages that quote earlier ones at several levels, wrapped anew, whole or in part."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    rows, said = [], {}
    for k in range(n):
        conv, turn = f"c{rng.randrange(40)}", k
        lines = []
        for other in rng.sample(said.get(conv, []), min(len(said.get(conv, [])), rng.choice([0, 1, 1, 2]))):
            quoted = other.split()
            part = quoted[rng.randrange(2) :][: rng.randint(3, 40)]
            mark = rng.choice(["> ", ">> ", ">>> ", ">"])
            if rng.random() < 0.3:
                lines.append("On Friday someone wrote:")
            width = rng.randint(3, 9)
            lines += [mark + " ".join(part[i : i + width]) for i in range(0, len(part), width)] + ([""] if rng.random() < 0.5 else [])
        own = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 4))) if rng.random() > 0.1 else "ok"
        said.setdefault(conv, []).append(own)
        rows.append((conv, turn, rng.choice(["user", "assistant", None]), "\n".join([*lines, own])))
    return rows


def as_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id VARCHAR, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(c) for c in rows])
    names = ["conv_id", "turn", "role", "reply_to", "thread_root", "depth", "n_quoted", "n_linked", "n_verbatim", "position", "clean_text", "formatted"]
    cur = con.execute(queries.OP8_SQL)
    at = [[d[0] for d in cur.description].index(n) for n in names]
    return names, sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=str)


def test_quotes_as_sql(spark, chats):
    names, want = as_sql(CHATS)
    assert sorted((tuple(r) for r in chat_threads.link_quotes(chats).select(*names).collect()), key=str) == want
    rows = long_chats()
    names, want = as_sql(rows)
    got = chat_threads.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).select(*names).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    assert sum(r.reply_to is not None for r in got) > 1000 and max(r.depth for r in got) > 3


def mail_threads(n=600, seed=9):
    """Mail threads with known parents: mostly the last message is quoted, as clients do it (whole, trimmed, wrapped anew, top or bottom posted, nested), sometimes an older one; shared greetings and signatures."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    rows, parents, said = [], {}, {}
    for k in range(n):
        conv = k % 20
        earlier = said.setdefault(conv, [])
        own = ["Hello all,"] * (rng.random() < 0.4) + [" ".join(rng.choice(words) for _ in range(rng.randint(8, 25))) for _ in range(rng.randint(1, 3))] + ["Best regards"] * (rng.random() < 0.4)
        turn, parent, quoted = len(earlier), None, []
        if earlier and rng.random() < 0.9:
            parent = len(earlier) - 1 if rng.random() < 0.6 else rng.randrange(len(earlier))
            body = [line for line in earlier[parent] if line not in ("Hello all,", "Best regards")]
            if rng.random() < 0.4:  # a part of it
                body = [rng.choice(body)]
            text = " ".join(body).split()
            if rng.random() < 0.3 and len(text) > 14:  # trimmed at its beginning or end
                text = text[rng.randrange(4) : len(text) - rng.randrange(4)]
            width = rng.choice([6, 9, 14])
            quoted = ["On Tue someone wrote:"] * (rng.random() < 0.7) + ["> " + " ".join(text[i : i + width]) for i in range(0, len(text), width)]
            grand = parents.get((conv, parent))
            if grand is not None and rng.random() < 0.5:
                quoted += [">> " + line for line in earlier[grand]]
        earlier.append(own)
        parents[conv, turn] = parent
        rows.append((f"m{conv}", turn, "user", "\n".join(quoted + own if rng.random() < 0.5 else [*own, "", *quoted])))
    return rows, parents


def test_planted_mail_threads(spark):
    rows, parents = mail_threads()
    got = {(int(r.conv_id[1:]), r.turn): r for r in chat_threads.link_quotes(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    planted = [k for k, p in parents.items() if p is not None]
    right = sum(got[k].reply_to == parents[k] for k in planted)
    wrong = [k for k in parents if got[k].reply_to not in (None, parents[k])]
    assert len(planted) > 400 and right >= 0.95 * len(planted) and len(wrong) <= 0.02 * len(parents)
    assert all(got[k].n_verbatim == got[k].n_linked or got[k].n_linked > 1 for k in planted)
    assert not any(">" in r.clean_text or "wrote:" in r.clean_text for r in got.values())
    for conv in range(20):
        # reply order: each message, then its replies by turn, each with its own
        mine = {t: got[conv, t] for c, t in got if c == conv}
        replies = {}
        for t, r in sorted(mine.items()):
            replies.setdefault(r.reply_to, []).append(t)

        def order(t):
            return [t, *(x for y in replies.get(t, []) for x in order(y))]

        for root in replies[None]:
            read = sorted((t for t, r in mine.items() if r.thread_root == root), key=lambda t: mine[t].position)
            assert read == order(root) and [mine[t].position for t in read] == list(range(len(read)))


def test_no_python_in_chat_plans(chats):
    plan = chat_threads.link_quotes(chats)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_forest_recall_and_edges(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:900] = x[100]  # a large group of copies
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(9000, None, "z"), (9050, [0.0] * 24, "z"), (9100, [float("nan")] * 24, "z"), (9150, [1.0, None] * 12, "z"), (9200, [1.0], "z"), (150, x[150].tolist(), "z"), (None, x[0].tolist(), "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string").repartition(3)
    got = ann_forest.search(df, F.col("vec_id") % 50 == 0).collect()
    u = x.astype(np.float64)
    n = np.sqrt((u * u).sum(1))
    hit = total = 0
    for q in range(0, 3000, 50):
        s = (u * u[q]).sum(1) / (n * n[q])
        s[q] = -9
        want = np.lexsort((np.arange(3000), -s))[:5].tolist()
        mine = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)]
        assert len(mine) == 5 and all(abs(v - s[i]) < 1e-12 for i, v in mine)
        if 100 <= q < 900:
            assert [i for i, _ in mine] == [i for i in range(100, 106) if i != q][:5]
        hit, total = hit + len({i for i, _ in mine} & set(want)), total + 5
    assert hit / total >= 0.9 and {r.query_id for r in got} == set(range(0, 3000, 50))
    few = ann_forest.search(df.filter("vec_id IN (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert len(few) == 2
    assert ann_forest.search(df.limit(0), F.lit(True)).count() == 0 and ann_forest.search(df, F.lit(False)).count() == 0


def test_pipeline_stages(spark, sf_dir):
    mine = {"kept": F.lit("mine"), "n_words": F.lit(-7), "Score": F.lit("mine"), "rejected": F.col("doc_id"), "id": F.lit("x"), "mark": F.lit(1), "stage_kept": F.lit("own")}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns(mine)
    rest = docs.columns[2:]
    docs = docs.unionByName(docs.limit(1).selectExpr("CAST(9999 AS BIGINT) AS doc_id", "'123 456' AS text", *rest)).unionByName(docs.limit(1).selectExpr("CAST(9998 AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", *rest))
    rows = {r.doc_id: r for r in docs.collect()}
    untouched = lambda got: all(tuple(r) == tuple(rows[r.doc_id]) for r in got)
    named = corpus_pipeline.language(spark, docs, sf_dir)
    assert named.columns == docs.columns and untouched(named.collect())
    assert named.filter("doc_id IN (9998, 9999)").isEmpty() and named.count() > 0.97 * docs.count()
    clean = corpus_pipeline.quality(spark, named, sf_dir).collect()
    want = {r.doc_id for r in named.select("doc_id", "text").collect() if passes(r.text)}
    assert {r.doc_id for r in clean} == want and untouched(clean)
    left = spark.createDataFrame(clean, docs.schema)
    alone = corpus_pipeline.near_duplicates(spark, left, sf_dir).collect()
    assert untouched(alone) and {r.doc_id for r in alone} == first_of_groups({r.doc_id: r.text for r in clean})
    packed = corpus_pipeline.pack(spark, spark.createDataFrame(alone, docs.schema), sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in alone}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def passes(text):
    """The base rules and the repetition rules by brute force over all pairs of places."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(w) - 1):
        at.setdefault((w[i], w[i + 1]), []).append(i)
    best = [0] * len(w)
    for places in at.values():
        for k, i in enumerate(places):
            for j in places[k + 1 :]:
                n = 2
                while j + n < len(w) and w[i + n] == w[j + n]:
                    n += 1
                best[i], best[j] = max(best[i], n), max(best[j], n)
    covered, three = set(), set()
    for i, n in enumerate(best):
        if n >= quality_rules.MIN_REPEAT:
            covered.update(range(i, i + n))
        if n >= 3:
            three.update(range(i, i + n))
    base = len(w) >= 50 and 100 * len(three) <= 50 * len(w)
    return base and len(covered) <= quality_rules.MAX_COVERED * len(w) and max(best, default=0) <= quality_rules.MAX_REPEAT


def first_of_groups(texts):
    """The smallest id of each group that links of Jaccard 0.8 make."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in sets.items():
        for shingle in s:
            holders.setdefault(shingle, []).append(i)
    tried = set()
    for ids in holders.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                if (a, b) not in tried:
                    tried.add((a, b))
                    if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {find(i) for i in sets}


def test_pipeline_runs(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and len(corpus_pipeline.STAGES) == 4
