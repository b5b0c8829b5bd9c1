"""Operators of retrieval, graphs, texts and sources against brute force and fixed values."""

import math
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieval
from palimpsest.plans import context, graphs, quality, texts
from palimpsest.sources import transcripts
from palimpsest.util import new_path, with_previous


def test_dense_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieval, "VECTOR_BLOCK", 11)
    x = np.random.default_rng(1).normal(size=(60, 8)).round(1)
    x[7] = 0
    x[8] = x[9]
    df = spark.createDataFrame([(i, v.tolist(), "x") for i, v in enumerate(x)], "id int, vec array<double>, query_id string")
    asked = df.where("id < 10").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    got = {}
    for r in retrieval.dense(df.drop("query_id"), asked, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in range(10):
        s = np.floor(unit @ unit[q] * 1e6 + 0.5) / 1e6
        order = sorted((i for i in range(60) if i not in (q, 7)), key=lambda i: (-s[i], i))[:5]
        assert q == 7 and q not in got or [i for _, i in sorted(got[q])] == order
    assert retrieval.dense(df.drop("query_id").limit(0), asked, 5).collect() == []


def test_embedded_texts(spark):
    df = spark.createDataFrame([(1, "alpha beta alpha"), (2, "beta alpha"), (3, None), (4, "")], "id int, text string")
    got = {r.id: np.array(r.vec) for r in retrieval.embedded(df, "id", "text").collect()}
    assert set(got) == {1, 2} and len(got[1]) == retrieval.DIMENSIONS and abs(got[1]).sum() in (1.0, 3.0) and abs(got[2]).sum() in (0.0, 2.0)


def test_previous_of_a_hot_key(spark):
    rows = [("hot", i, i * i) for i in range(300)] + [("b", 1, 5), (None, 1, 7), (None, 2, 8)]
    random.Random(1).shuffle(rows)
    got = {(r.k, r.i): r.before for r in with_previous(spark.createDataFrame(rows, "k string, i int, v int"), "k", ["i"], "v").collect()}
    assert got == {("hot", i): (i - 1) ** 2 if i else None for i in range(300)} | {("b", 1): None, (None, 1): None, (None, 2): 7}


def test_losing_sides():
    """Pairs in order; a pair one side of which is gone is passed over; equal worth drops the second."""
    rows = [("a", "b", 1, 2, 0.5, 0.9), ("a", "c", 1, 3, 0.5, 0.1), ("b", "c", 2, 3, 0.9, 0.9), ("c", "d", 3, 4, 0.2, 0.3)]
    pairs = pd.DataFrame(rows, columns=["a", "b", "place_a", "place_b", "worth_a", "worth_b"])
    assert context.losers(pairs.sample(frac=1, random_state=1)) == ["a", "c"]


@pytest.mark.parametrize(("mode", "bound", "want"), [("absolute", 0.85, {("m", "a"), ("m", "b")}), ("topk", 0.0, {("m", "a"), ("m", "b"), ("m", "c")}), ("adaptive", 0.5, {("m", "a"), ("m", "b")}), ("zscore", 1.0, {("m", "a")})])
def test_link_modes(spark, mode, bound, want):
    pool = spark.createDataFrame([("m", "a", 0.95, 1), ("m", "b", 0.86, 2), ("m", "c", 0.5, 3), ("m", "d", 0.4, 4)], "src string, dst string, s double, rank int")
    got = {(r.src, r.dst) for r in graphs.linked(pool, mode, bound, 3).collect()}
    assert got == want | {(b, a) for a, b in want}


def test_noise(spark):
    said = {"hi": "too short", "[tool_use: x] y z": "tool output", "x" * 2001: "too long", 'File "a.py", line 3 went wrong': "stack trace", "/home/me/notes.txt": "path", "see /very/long/path/to/some/file.txt ok": "path", "key " + "a1" * 20: "hex dump", "def f(x):\n  return x": "code", 'name := fs.String("x")': "code", "user prefers dark mode in the IDE": None}
    df = spark.createDataFrame([(k,) for k in [*said, None]], "t string").select("t", texts.noise(F.col("t")).alias("why"))
    assert {r.t: r.why for r in df.collect()} == said | {None: "empty"}


def test_secrets():
    text = "mail a.b@c.example or a.b@c.example, card 4111 1111 1111 1111, not 4111 1111 1111 1112, key AKIA" + "A" * 16 + " and 10.0.0.1"
    got = [(k, text[a:b]) for k, a, b in texts.secrets_in(text)]
    assert got[:2] == [("EMAIL", "a.b@c.example")] * 2 and ("CREDIT_CARD", "4111 1111 1111 1111") in got and ("AWS_ACCESS_KEY", "AKIA" + "A" * 16) in got and ("IPV4", "10.0.0.1") in got
    assert texts.masked("to x@y.example, z@y.example, x@y.example") == "to [EMAIL_1], [EMAIL_2], [EMAIL_1]" and texts.masked(None) is None and texts.masked("") == ""
    spans = texts.secrets_in("sk-ant-api03-" + "b" * 90)
    assert [k for k, *_ in spans] == ["ANTHROPIC_KEY"]


def test_json_lines_in_splits(spark):
    path = new_path(spark, "test-lines")
    lines = [f'{{"role": "user", "content": "text {i}", "id": "{i}"}}' if i % 3 else "some prose" for i in range(400)]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = transcripts.json_lines(spark, path).orderBy("ordinal").collect()
        assert [(r.ordinal, r.content) for r in got] == list(enumerate(f"text {i}" for i in range(400) if i % 3))
        with pytest.raises(Exception, match="no message"):
            transcripts.json_lines(spark, path, strict=True).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_diverse_order():
    """Each pick has the greatest 0.7 relevance less 0.3 likeness to what was picked, recomputed from scratch."""
    from palimpsest.plans.quality import diverse

    rng = np.random.default_rng(2)
    for _ in range(20):
        v = rng.normal(size=(12, 4))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        s = rng.random(12).round(1)
        got = diverse(s, v, 6, 0.7)
        for i, pick in enumerate(got):
            worth = {j: round(0.7 * s[j] - 0.3 * (max(v[j] @ v[c] for c in got[:i]) if i else 0.0), 12) for j in range(12) if j not in got[:i]}
            assert pick == min(worth, key=lambda j: (-worth[j], j))


def shuffled(spark, action) -> int:
    """Rows that the action shuffles."""

    def written():
        gateway, context = spark.sparkContext._gateway, spark.sparkContext._jsc.sc()
        context.listenerBus().waitUntilEmpty(30_000)
        none = gateway.jvm.java.util.ArrayList()
        stages = context.statusStore().stageList(none, False, False, gateway.new_array(gateway.jvm.double, 0), none)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = written()
    action()
    return written() - before


def test_bm25_shuffles_no_sums(spark):
    """Each query holds a word of every document, so the sums are as many as queries times documents."""
    docs = spark.createDataFrame([(i, f"common w{i} x") for i in range(400)], "doc_id bigint, text string")
    ask = spark.createDataFrame([(f"q{i}", f"common w{i}") for i in range(400)], "query_id string, query string")
    got = []
    assert shuffled(spark, lambda: got.extend(retrieval.bm25(docs, ask, 1).collect())) < 20_000
    assert sorted((r.query_id, r.id) for r in got) == sorted((f"q{i}", i) for i in range(400))


def test_bm25_against_brute_force(spark, monkeypatch):
    """Rows of one identifier, of one length or not, null identifiers and texts, and answers that are not kept; in small blocks."""
    monkeypatch.setattr(retrieval, "DOC_BLOCK", 9)
    monkeypatch.setattr(retrieval, "ASKED_BLOCK", 20)
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice("ab ab cd Ef gh ij kl \u00e9t x9".split()) for _ in range(rng.randrange(9)))
    docs = [(None if rng.random() < 0.02 else rng.randrange(70), None if rng.random() < 0.05 else say()) for _ in range(100)]
    ask = [(f"q{i}", say()) for i in range(12)] + [("none", None), ("lost", "zz")]
    words = lambda x: re.findall(r"\w+", x.lower())
    kept = {i for i in range(70) if i % 3}
    for keep in (None, kept):
        tf = Counter((i, len(words(t)), w) for i, t in docs if t for w in words(t))
        df, sizes = Counter(w for _, _, w in tf), [len(words(t)) for _, t in docs if t and words(t)]
        n, mean = len(sizes), sum(sizes) / len(sizes)
        want = {}
        for q, a in ask:
            score = Counter()
            for (i, size, w), f in tf.items():
                if times := words(a or "").count(w):
                    idf = math.log((n - df[w] + 0.5) / (df[w] + 0.5))
                    score[i] += times * (idf if idf > 0 else 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size / mean))
            best = sorted(((-math.floor(s * 1e6 + 0.5) / 1e6, i is None, i) for i, s in score.items() if keep is None or i in keep), key=lambda x: (x[0], x[1], x[2] or 0))
            want[q] = [(i, -s) for s, _, i in best[:5]]
        frame = spark.createDataFrame([(i,) for i in keep], "id int") if keep else None
        got = {q: [] for q, _ in ask}
        for r in retrieval.bm25(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(ask, "query_id string, query string"), 5, keep=frame).orderBy("rank").collect():
            got[r.query_id].append((r.id, r.score))
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
        assert all(abs(a[1] - b[1]) < 2e-6 for q in want for a, b in zip(got[q], want[q], strict=True))


def test_embedding_shuffles_vectors_only(spark):
    docs = spark.createDataFrame([(i % 190, " ".join(f"w{i + j}" for j in range(60))) for i in range(200)], "id int, text string")
    got = []
    assert shuffled(spark, lambda: got.extend(retrieval.embedded(docs, "id", "text").collect())) < 1_000
    assert len(got) == 190 and all(sum(map(abs, r.vec)) % 2 == 0 for r in got)


def test_own_vector_and_ties_in_dense(spark):
    """Vectors of one identifier are all passed over for its own query; ties with the k-th go by identifier."""
    v = [(1, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0])] + [(i, [2.0, 0.0]) for i in range(600, 10, -1)]
    df = spark.createDataFrame(v, "id int, vec array<double>")
    got = retrieval.dense(df, df.where("id = 2 or id = 1 and vec[1] = 0").selectExpr("id as query_id", "vec as qvec"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(1, 11), (1, 12), (1, 13), (2, 1), (2, 1), (2, 11)]


def test_titles_are_looked_for_without_runs(spark, monkeypatch):
    """No run of characters is shuffled; overlapping, equal, short and long titles are all found, over borders of slices."""
    monkeypatch.setattr(quality, "SLICE", 64)
    rng = random.Random(5)
    docs = [(i, None if i == 7 else "".join(rng.choice("abA \u00e9") for _ in range(rng.randrange(60)))) for i in range(150)]
    asked = [(i, (t := docs[i][1] or "")[(a := rng.randrange(len(t) + 1)) : a + rng.randrange(1, 40)] or "b") for i in range(60)] + [(100, "aa"), (101, "aa"), (102, "nowhere"), (103, None)]
    got = []
    frames = spark.createDataFrame(docs, "id int, text string"), spark.createDataFrame(asked, "query_id int, query string")
    moved = shuffled(spark, lambda: got.extend(quality.holders(*frames).collect()))
    assert sorted((r.query_id, r.id) for r in got) == [(q, i) for q, a in asked if a is not None for i, t in docs if t is not None and a.lower() in t.lower()]
    assert moved < 3_000


def test_modes_are_judged_on_one_search(spark, monkeypatch):
    """The legs are searched once for all modes."""
    from conftest import DATA

    calls, legs = [], context.legs
    monkeypatch.setattr(context, "legs", lambda *a, **k: calls.append(a) or legs(*a, **k))
    context.evl_modes(spark, DATA)
    assert len(calls) == 1
