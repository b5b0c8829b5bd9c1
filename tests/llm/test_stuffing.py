import math
import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest

stuffing = pytest.importorskip("palimpsest.llm.stuffing")
PROSE = ["We agreed to review the summary tree before we touch the cache, because the team asked for it.", "The export failed on the laptop last week, but only when the older schema is involved.", "Can you check why the queue is slow when we use a cold start?"]
SPAM = ["laptop sale laptop used laptop cheap laptop online laptop buy laptop " * 6, "\n".join(f"https://shop{i}.example/solar_lamp" for i in range(30)), " | ".join(["Solar Lamp", "Air Fryer", "Home", "Cart", "Phone Case"] * 8), " • ".join(f"Air Fryer XL NEW {i},99 EUR" for i in range(12)), "tag:lamp, tag:fryer, tag:lamp, tag:case, " * 8]
CLEAN = [" ".join(PROSE), "\n".join(f"https://wiki.example/{i} : this page explains why the team moved the job to the older schema." for i in range(5)), "\n".join(f"{i}\t{i * 7}\t{i / 3:.1f}\thit" for i in range(40)), 'Traceback (most recent call last):\n  File "/srv/queue.py", line 7, in run\n    commit(row)\nValueError: no', "[store]\npage_size = 40\nlog_level = true\nseed = 7\nworkers = 12"]


@pytest.mark.parametrize("text", SPAM)
def test_spam(text):
    spam, rest = stuffing.share_of_spam(text)
    assert spam > rest
    spam, rest = stuffing.share_of_spam(PROSE[0] + "\n" + text.upper())
    assert spam > rest


@pytest.mark.parametrize("text", CLEAN)
def test_clean(text):
    spam, rest = stuffing.share_of_spam(text)
    assert spam <= rest


def test_frame(spark):
    texts = SPAM + CLEAN + [None, "", "  ", "word", SPAM[0], " ".join(PROSE * 400)]
    df = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(texts)], "doc_id bigint, text string, words double")
    assert sorted(r.doc_id for r in stuffing.stuffed(df).collect()) == [*range(len(SPAM)), len(SPAM + CLEAN) + 4]
    assert stuffing.stuffed(df.limit(0)).collect() == []


def by_hand(texts):
    """pairs, mean NPMI, incoherent, overdone and suspicious shares of each distinct text."""
    words = [t.split() for t in dict.fromkeys(texts)]
    own = [Counter(zip(w, w[1:])) for w in words]
    c = sum(own, Counter())
    left, right, total = Counter(), Counter(), sum(c.values())
    for (a, b), n in c.items():
        left[a] += n
        right[b] += n
    npmi = lambda n, p: math.log(n * total / (left[p[0]] * right[p[1]])) / -math.log(n / total)
    normal = 0.75 * sum(n * npmi(n, p) for p, n in c.items()) / total
    out = []
    for o in own:
        n = sum(o.values())
        low = {p for p in o if c[p] == o[p] or npmi(max(c[p] - o[p], 0.5), p) < normal}
        over = {p for p in o if o[p] >= max(2, 0.03 * n)}
        out.append((n, *(round(x / n, 9) for x in (sum(o[p] * npmi(c[p], p) for p in o), *(sum(o[p] for p in s) for s in (low, over, low | over))))))
    return sorted(out)


def statistics(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return sorted((r.pairs, *(round(r[c], 9) for c in ("mean_npmi", "incoherent", "overdone", "suspicious"))) for r in stuffing.statistics(stuffing.distinct_texts(df)).collect())


def test_pairs_by_hand(spark, monkeypatch):
    """Against counts by hand, copies of a text once; the same if all, some or no pairs are broadcast."""
    rng = random.Random(4)
    texts = ["a b", "a b", "a c b"] + [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 40))) for _ in range(40)] + ["a b c " * 30]
    want = by_hand([t.strip() for t in texts])
    assert statistics(spark, [t.strip() for t in texts]) == want
    for known in (20, 0):
        monkeypatch.setattr(stuffing, "KNOWN", known)
        assert statistics(spark, [t.strip() for t in texts]) == want


def test_counts_in_parts(monkeypatch):
    texts = [" ".join(random.Random(i).choices("abcdefghij", k=50)) for i in range(30)]
    count = lambda *cuts: [b.to_pandas() for b in stuffing._count(stuffing._tokenise(pa.RecordBatch.from_pydict({"text": x}) for x in cuts))]
    whole = count(texts)
    monkeypatch.setattr(stuffing, "HELD", 60)
    parts = pd.concat(count(texts[:11], texts[11:]))
    assert len(whole) == 1 and len(parts) > len(whole[0])
    assert parts.groupby("h")["n"].sum().to_dict() == whole[0].set_index("h")["n"].to_dict()


def test_only_suspects_are_looked_at(spark, monkeypatch):
    """Without suspects nothing is found: the rows come through the statistics."""
    df = spark.createDataFrame(list(enumerate(SPAM + CLEAN)), "doc_id bigint, text string")
    monkeypatch.setattr(stuffing, "SUSPECT", 1.01)
    assert stuffing.stuffed(df).collect() == []


def test_a_page_copied_to_a_third_of_all_rows(spark):
    """Copies bring the mean PMI of a page to log 3; the answer must not depend on them, nor on the size of the corpus."""
    prose = [f"{PROSE[i % 3][:-1]} and we looked at note {i}, because number {i} was still open." for i in range(60)]
    page = "\n".join(["review tree", "summary cache", "touch team", "asked export", "laptop failed", "week last", "schema older", "involved queue", "cold slow", "start check"])
    link = "\n".join(["https://a.example/x lamp", "www.b.example case"])
    for spam in (page, link):
        for copies in (1, 30):
            df = spark.createDataFrame(list(enumerate([spam] * copies + prose)), "doc_id bigint, text string")
            assert sorted(r.doc_id for r in stuffing.stuffed(df).collect()) == list(range(copies))
    one = spark.createDataFrame([(1, "https://a.example/x"), (2, "word."), (3, "7 : 9")], "doc_id bigint, text string")
    assert stuffing.stuffed(one).collect() == []
