import numpy as np
import pandas as pd
import pytest

pii = pytest.importorskip("palimpsest.llm.pii")
training = pytest.importorskip("palimpsest.llm.pii_training")
CONTEXT = "so far we agreed to review the summary tree because the team asked for it and it took some time to migrate the vector index"
ORDINARY = frozenset(CONTEXT.split()) | {"spoke", "with", "about", "write", "breaks", "call", "after", "six", "moved", "last", "month", "name", "number", "thanks"}


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in training.fresh(rng, 5).items()}
    x, y = rng.integers(0, pii.N_CHARS, (7, 3)), rng.integers(0, len(pii.TAGS), (7, 3))
    _, grads = training.step(w, x, y)
    for name in ("wo", "b", "move", "first", "last", "wh", "wx"):
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        old, h = w[name][at], 1e-2
        w[name][at] = old + h
        up, _ = training.step(w, x, y)
        w[name][at] = old - h
        down, _ = training.step(w, x, y)
        w[name][at] = old
        assert abs((up - down) / (2 * h) - grads[name][at]) < 0.02 + 0.05 * abs(grads[name][at]), name


def test_found_mentions():
    text = f"{CONTEXT}. I spoke with Lovane Treskene about it. Write to lovane.treskene@harbordesk.test if it breaks. Call me on +1 (222) 555-0194 after six. {CONTEXT}"
    found = pii.tag_texts(pii.Tagger.load(), [text, "", CONTEXT], ORDINARY)
    assert [(k, text[a:b]) for k, a, b in found[0]] == [("NAME", "Lovane Treskene"), ("EMAIL", "lovane.treskene@harbordesk.test"), ("PHONE", "+1 (222) 555-0194")]
    assert found[1] == found[2] == []


def test_held_out_accuracy():
    """On rows that training did not see, against the labels of the rules."""
    texts = pd.read_parquet("/root/testdata/sf0.01/raw_messages.parquet", columns=["content"])["content"].dropna().tolist()
    names = training.Names(pd.read_parquet("/root/testdata/sf0.01/people_directory.parquet"))
    for kind, (hit, miss, false) in training.scores(texts, names, training.common(texts), pii.Tagger.load()).items():
        assert hit > 20 and hit / (hit + miss) > 0.93 and hit / (hit + false) > 0.93, kind


def test_windows_cover_long_texts():
    text = ("word " * 300 + "zyxqy ") * 40
    got = pii.everywhere(text)
    assert got[0][0] == 0 and got[-1][1] == len(text) and all(b - a <= pii.WINDOW for a, b in got)
    assert all(b - c >= pii.OVERLAP for (_, b), (c, _) in zip(got, got[1:]))


def test_places_and_ranges_that_no_label_names():
    """Towns, streets, hosts and numbers that training never saw."""
    said = {
        "ADDRESS": ["14 Brackenfold Street, Wexmoor 40213", "Hagelbachstraße 7, 48291 Norderwik", "Calle Pinar Alto, 12, 29871 Ribasela", "33 rue des Merisiers, 61234 Belcourt"],
        "EMAIL": ["torvik.lanum@pebblecrane.example", "j_osk (at) mornwick (dot) test"],
        "PHONE": ["+1 (318) 555-0177", "+49 (0)30 23 125 42"],
    }
    for kind, values in said.items():
        for value in values:
            text = f"so far the review goes on. You can reach me at {value} after six. thanks"
            found = pii.tag_texts(pii.Tagger.load(), [text], ORDINARY)[0]
            assert any(k == kind and text[a:b] in value and b - a >= 0.6 * len(value) for k, a, b in found), (value, [(k, text[a:b]) for k, a, b in found])


def test_frames(spark):
    rows = [("a", "I spoke with Lovane Treskene about it."), ("b", None), ("c", ""), ("d", "  "), ("a", "I spoke with Lovane Treskene about it."), ("e", CONTEXT)]
    df = spark.createDataFrame([(k, t, 1) for k, t in rows], "id string, text string, start_pos int")
    got = pii.find(df.drop("start_pos"), ["id"], ordinary=ORDINARY).collect()
    assert sorted((r.id, r.pii_type, r.start_pos, r.end_pos) for r in got) == [("a", "NAME", 13, 28)] * 2
    out = pii.redact(df, ordinary=ORDINARY).collect()
    assert sorted((r.id, str(r.text)) for r in out) == sorted([("a", "I spoke with [NAME] about it."), ("b", "None"), ("c", ""), ("d", "  "), ("a", "I spoke with [NAME] about it."), ("e", CONTEXT)])
    assert pii.find(df.limit(0), ["id"]).collect() == []


def test_a_text_with_a_name_as_a_third_of_all_rows(spark):
    """Its words are in many rows, but in one text; no stretch is left unread for being made of common words."""
    text = "the review of the queue is assigned to Fendris Winter for now."
    rest = [f"{CONTEXT} this is note {'abcdefghij'[i % 10] * 3}{'klmnopqrst'[i // 10] * 3}" for i in range(80)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([text] * 40 + rest)], "id int, text string")
    got = pii.find(df, ["id"]).where("id < 40").collect()
    at = text.index("Fendris")
    assert sorted((r.id, r.pii_type, r.start_pos, r.end_pos) for r in got) == [(i, "NAME", at, at + 14) for i in range(40)]
    common = frozenset(text.lower().replace(".", "").split())
    assert [(k, text[a:b]) for k, a, b in pii.tag_texts(pii.Tagger.load(), [text], common)[0]] == [("NAME", "Fendris Winter")]
    assert pii._name("asked Fendris Winter", 0, 20, frozenset({"asked", "winter"})) == (6, 20)


def test_left_out_paths_are_all_o():
    tagger, texts = pii.Tagger.load(), pd.read_parquet("/root/testdata/sf0.001/raw_messages.parquet", columns=["content"])["content"].dropna().tolist()[:400]
    x = np.zeros((pii.WINDOW, len(texts)), np.uint8)
    for i, t in enumerate(texts):
        x[: len(t[: pii.WINDOW]), i] = pii.classes(t[: pii.WINDOW])
    assert (tagger.decode(x) == tagger.viterbi(tagger.emissions(x))).all()


def test_emissions_against_training():
    """(T, K, B), from both sides, as the network in training gives them."""
    tagger, x = pii.Tagger.load(), np.random.default_rng(3).integers(0, pii.N_CHARS, (50, 7)).astype(np.uint8)
    one, two = training._forward(tagger.w, 0, x)[3], training._forward(tagger.w, 1, x[::-1])[3][::-1]
    want = np.concatenate([one, two], 2) @ tagger.w["wo"] + tagger.w["b"]
    assert np.allclose(tagger.emissions(x), want.transpose(0, 2, 1), atol=1e-3)


def test_few_windows_need_viterbi():
    """A run of other tags that cannot begin after O leaves a window closed; no window whose best path leaves O is closed."""
    tagger, texts = pii.Tagger.load(), pd.read_parquet("/root/testdata/sf0.001/raw_messages.parquet", columns=["content"])["content"].dropna().tolist()[:400]
    x = np.zeros((pii.WINDOW, len(texts)), np.uint8)
    for i, t in enumerate(texts):
        x[: len(t[: pii.WINDOW]), i] = pii.classes(t[: pii.WINDOW])
    e, rng = tagger.emissions(x), np.random.default_rng(5)
    assert tagger.open(e).sum() < 0.3 * len(texts)
    some = rng.normal(0, 3, (6, len(pii.TAGS), 3000)).astype(np.float32)
    some[:, 0] += rng.uniform(3, 15, 3000).astype(np.float32)
    for each in (e, some, some[:1]):
        left = tagger.viterbi(each).any(0)
        assert tagger.open(each)[left].all() and left.any() and not left.all()
