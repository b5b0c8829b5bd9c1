import pytest
from pyspark.sql import functions as F

conversations = pytest.importorskip("palimpsest.llm.conversations")
mixing = pytest.importorskip("palimpsest.llm.mixing")


def test_rebuild(spark):
    rows = [
        (1, "ok", "e1", " Human ", "hi", 0), (2, "ok", "e2", "AI", "yes", 1), (3, "ok", "e2", "ai", "yes again", 1), (4, "ok", None, "document", "doc", 2), (5, "ok", None, "user", "more", 3), (6, "ok", None, "bot", "done", 4),
        (10, "hole", None, "user", "a", 0), (11, "hole", None, "assistant", "b", 2), (12, "blank", None, "user", "  ", 0), (13, "blank", None, "assistant", "b", 1),
        (14, "role", None, "robot", "a", 0), (15, "role", None, "assistant", "b", 1), (16, "open", None, "user", "a", 0), (17, "open", None, "assistant", "b", 1), (18, "open", None, "user", "c", 2),
        (20, "timed", None, "assistant", "b", None), (21, "timed", None, "user", "a", None), (22, "tie", None, "user", "a", None), (23, "tie", None, "assistant", "b", None), (24, None, None, "user", "a", 0), (25, "late", None, "user", "a", None), (26, "late", None, "assistant", "a", None),
    ]
    df = spark.createDataFrame([(*r, 7) for r in rows], "row_id bigint, conversation_id string, external_id string, role string, content string, ordinal int, n int")
    at = spark.createDataFrame([(20, 9), (21, 5), (22, 5), (23, 5), (25, 1)], "row_id bigint, utc_us bigint")
    got = sorted(tuple(r) for r in conversations.rebuild(df, lambda _: at).collect())
    assert got == [("ok", 0, 1, "user"), ("ok", 1, 2, "assistant"), ("ok", 2, 5, "user"), ("ok", 3, 6, "assistant"), ("timed", 0, 21, "user"), ("timed", 1, 20, "assistant")]
    assert conversations.rebuild(df.limit(0), lambda _: at).collect() == []


def test_sessions(spark):
    rows = [("c", i * 60_000_000 + (i // 10) * 50_000_000_000, i, "user" if i % 2 == 0 else "assistant") for i in range(40)] + [("alone", 5, 100, "user"), (None, 5, 101, "user"), ("c", None, 102, "user")]
    got = conversations.sessions(spark.createDataFrame(rows, "channel string, at bigint, id bigint, role string")).collect()
    assert sorted((r.channel, r.session_no, r.n) for r in got) == [("c", k, 10) for k in range(1, 5)]


def test_mixture(spark):
    docs = spark.createDataFrame([(i, "big" if i < 600 else "small" if i < 640 else "unweighted" if i < 660 else None, 5 + i % 7) for i in range(670)], "doc_id bigint, source string, n_tokens int")
    weights = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 3), ("absent", 0.2, 2), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    mixed = mixing.mix(docs, weights)
    assert {r.source: (round(r.actual_share, 2), r.most_used <= r.max_repeats) for r in mixing.shares(mixed, weights).where("tokens > 0").collect()} == {"big": (0.7, True), "small": (0.3, True)}
    assert mixed.groupBy("doc_id", "copy_no").count().where(F.col("count") > 1).count() == 0
    assert mixing.mix(docs.limit(0), weights).collect() == []


def test_session_turns_with_inferred_roles(spark):
    roles = {"a": [None, "", "user", "who", None, "system", "x", "event", "assistant"], "b": [None, None], "c": ["user", "user"], "d": ["assistant", None]}
    rows = [(c, i * 1_000_000, i, r) for c, of in roles.items() for i, r in enumerate(of)]
    got = conversations.session_turns(spark.createDataFrame(rows, "channel string, at bigint, id bigint, role string"), 60.0).collect()
    by = {c: [(r.turn_no, r.id, r.role) for r in sorted(got, key=lambda r: r.turn_no) if r.channel == c] for c in roles}
    u, a = "user", "assistant"
    assert by["a"] == [(0, 0, u), (1, 1, a), (2, 2, u), (3, 3, a), (4, 4, u), (5, 5, "system"), (6, 6, a), (7, 8, a)]
    assert by["b"] == [(0, 0, u), (1, 1, a)] and by["c"] == by["d"] == []


def test_sessions_take_one_delivery_of_each_message(spark):
    import __spark_entry__
    from conftest import DATA

    turns = __spark_entry__.queries()["p6_sessions"](spark, DATA)
    assert turns.columns == ["channel", "session_no", "turn_no", "delivery_id", "role"]
    assert turns.count() > 0 == turns.join(__spark_entry__.queries()["p4_found"](spark, DATA), "delivery_id").count()


def test_sessions_against_sql(spark):
    from compare import compare
    from conftest import DATA

    registry = pytest.importorskip("palimpsest.llm.registry")
    got, want, same = compare(spark, DATA, registry.queries()["p6_sessions"], registry.oracle_sql()["p6_sessions"])
    assert same, (len(got), len(want), sorted(set(got) ^ set(want), key=repr)[:4])
