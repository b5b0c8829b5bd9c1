import random

import pytest

tokens = pytest.importorskip("palimpsest.llm.tokens")


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder("byte_bpe_50k", tokens.TOKENIZERS)


def test_join_is_exact_for_any_cut(enc):
    rng = random.Random(1)
    words = ["alpha", "it's", " ", "  ", "\n", "\r\n", "12345", "...", "要約ツリー", "é", "<|endoftext|>", "x" * 300, " ", "👍🏽", "'ll", "don't ", "\t\t", "a b c d", "end."]
    for _ in range(3000):
        text = "".join(rng.choice(words) + rng.choice(["", " ", " "]) for _ in range(rng.randrange(1, 60)))
        ends = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randrange(0, 6)))) + [len(text)]
        starts = [0, *ends[:-1]]
        parts = [enc.encode_ordinary(text[a:b]) for a, b in zip(starts, ends)]
        assert tokens.join(text, ends, parts, enc) == enc.encode_ordinary(text)


def test_cuts_depend_on_content_only():
    rng = random.Random(2)
    body = " ".join(rng.choice(["tree", "cache", "queue", "index", "daemon"]) + str(rng.randrange(999)) for _ in range(2000))
    a, b = tokens.cuts(body), tokens.cuts("something else in front of it " * 9 + body)
    shift = len("something else in front of it " * 9)
    assert len(a) > 20 and {x + shift for x in a[1:]} <= set(b)


def test_encode_frame(spark, enc):
    texts = [None, "", "hello world", "hello world", " ", "long text " * 3000, "\n\n  code()\n"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, h1 string")
    got = {r.doc_id: list(r.ids) for r in tokens.encode(df).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
