import random
from datetime import UTC, datetime
from itertools import product

from conftest import DATA
from pyspark.sql import functions as F

from palimpsest.functions import scoring
from palimpsest.operators import delivery, graph, hierarchy, retrieval, timestamps
from palimpsest.sources import transcripts
from palimpsest.util import new_path, running_totals


def brute_tree(rows):
    par = {}
    for i, p in rows:
        if i is not None:
            good = p if p is not None and p.strip() else None
            par[i] = min((x for x in (par.get(i), good) if x is not None), default=None)
    par = {i: p if p in par else None for i, p in par.items()}
    out = {}
    for i in par:
        way, at = [i], i
        while par[at] is not None and len(way) <= len(par):
            at = par[at]
            way.append(at)
        out[i] = ("", -1) if len(way) > len(par) else (at, len(way) - 1)
    below = dict.fromkeys(par, 0)
    for i in par:
        at = i
        while out[i][1] >= 0 and par[at] is not None:
            at = par[at]
            below[at] += 1
    return {i: (*out[i], below[i] if out[i][1] >= 0 else -1) for i in par}


def test_hierarchy_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(60)]  # a long chain
    rows += [(f"s{i}", "s0" if i else " ") for i in range(40)]  # a star
    rows += [(f"r{i}", f"r{rng.randrange(i)}" if i else "missing") for i in range(80)]
    rows += [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "w"), ("o", "o"), ("p", "o"), (None, "x"), ("x", "y"), ("d", "c5"), ("d", "c9")]
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "id string, parent_id string, path int")
    got = hierarchy.hierarchy(df, with_paths=True).collect()
    want = brute_tree(rows)
    assert {r.id: (r.root_id, r.depth, r.descendants) for r in got} == want and len(got) == len(want)
    assert all(len(r.path) == r.depth + 1 and r.path[-1] == r.id for r in got if r.depth >= 0)
    assert hierarchy.hierarchy(df.limit(0)).collect() == []


def test_hierarchy_with_a_hot_parent(spark, monkeypatch):
    """Parents of many rows go by another join; the result is the same."""
    monkeypatch.setattr(hierarchy, "LEAST", 5)
    monkeypatch.setattr(hierarchy, "HOT", 10)
    rows = [(f"s{i}", "s0" if i else None) for i in range(90)] + [(f"t{i}", f"s{i}") for i in range(30)] + [(f"u{i}", "u0") for i in range(40)] + [("x", "gone"), ("y", "x")]
    got = hierarchy.hierarchy(spark.createDataFrame(rows, "id string, parent_id string"), with_paths=True).collect()
    assert {r.id: (r.root_id, r.depth, r.descendants) for r in got} == brute_tree(rows)


def test_delivery(spark):
    rows = [(1, "c", " m", 5, "a"), (2, "c", "m ", 3, "b"), (3, "c", "m", 3, "c"), (4, "d", "m", 1, "d"), (5, "c", None, 1, "e"), (6, "c", "  ", 1, "f"), (7, "c", "M", 1, "g"), (8, None, "m", None, "h"), (9, None, "m", 2, "i")]
    path = new_path(spark, "test")
    spark.createDataFrame(rows, "delivery_id bigint, conversation_id string, message_id string, received_at int, file string").repartition(3).write.parquet(path)
    df = spark.read.parquet(path)
    assert {r.delivery for r in delivery.surplus(delivery.positions(df)).collect()} == {1, 3, 8}
    for budget in (delivery.VECTOR_BYTES, 1):  # one group of files, and one group a file
        kept = delivery.exactly_once(spark, df, budget)
        assert {r.delivery_id for r in kept.collect()} == {2, 4, 5, 6, 7, 9} and kept.columns == df.columns


def read(text, locale="en_GB", zone=None):
    us, _, cost = timestamps.readings_of(text, locale, zone, {"cet": 60}, 100.0)
    return [u for u, c in zip(us, cost, strict=True) if c == 0]


def test_timestamp_readings():
    base = 1_717_200_000_000_000  # 2024-06-01T00:00Z
    assert read("2024-06-01T00:00:00Z") == read("1717200000") == read("1717200000000") == read("01/06/2024 00:00") == read("06/01/2024 00:00", "en_US") == [base]
    assert read("2024-06-01T02:00:00", zone="Europe/Berlin") == read("2024-06-01 02:00:00+0200") == [base]
    assert read("2024-06-01T00:00:00.1234567Z") == [base + 123_456]
    early, skipped = read("2024-10-27T02:30:00", zone="Europe/Berlin"), read("2024-03-31T02:30:00", zone="Europe/Berlin")
    assert early == read("2024-10-27T00:30:00Z") and skipped == read("2024-03-31T01:30:00Z")
    for bad in (None, "", "  ", "soon", "2024-06-01", "12:30:00", "2024-02-30T00:00:00Z", "2024-13-10 09:00:00", "2024-06-01T25:00:00Z"):
        assert read(bad) == []


def test_viterbi_over_a_hot_source(spark):
    """Ambiguous days are settled by their neighbours, also across partitions."""
    rows = [(f"{i}", "one", i, f"{1 + i % 12:02d}/{1 + (i // 12) % 12:02d}/2024 10:00") for i in range(600)] + [("n", "two", 0, None), ("m", None, 1, "2024-06-01T00:00:00Z")]
    df = spark.createDataFrame(rows, "k string, source string, at int, created_at string").withColumns({"locale": F.lit("de_DE"), "zone": F.lit(None).cast("string")})
    got = timestamps.choose(timestamps.interpret(df, "created_at", "locale", "zone", {}), "source", ["at"]).collect()
    assert len(got) == 601 and all(r.broken == 0 for r in got)
    assert timestamps.choose(timestamps.interpret(df.limit(0), "created_at", "locale", "zone", {}), "source", ["at"]).collect() == []


def chosen(spark, rows, weight, **costs):
    df = spark.createDataFrame(rows, "source string, at int, created_at string").withColumns({"locale": F.lit("de_DE"), "zone": F.lit(None).cast("string")})
    got = timestamps.choose(timestamps.interpret(df, "created_at", "locale", "zone", {}, weight), "source", ["at"], **costs).collect()
    return {(r.source, r.at): datetime.fromtimestamp(r.utc_us / 1e6, UTC).strftime("%m-%d") for r in got}


def test_viterbi_overrules_a_weak_prior(spark):
    """Neighbours that can only be month first make an ambiguous value month first; alone it follows the locale."""
    rows = [("us", 0, "02/13/2024 10:00"), ("us", 1, "03/04/2024 10:00"), ("us", 2, "03/14/2024 10:00"), ("alone", 0, "03/04/2024 10:00"), ("clear", 0, "2024-03-04 10:00")]
    got = chosen(spark, rows, 0.5)
    assert got == {("us", 0): "02-13", ("us", 1): "03-04", ("us", 2): "03-14", ("alone", 0): "04-03", ("clear", 0): "03-04"}
    assert chosen(spark, rows, 100.0)["us", 1] == "04-03"  # a strong prior stands


def test_rules_need_no_sequence(spark):
    """What the rules settle is read value by value; with a prior that always stands the sequence gives the same."""
    from palimpsest.plans import problems

    found = problems.p1_found(spark, DATA)
    assert "InPandas" not in found._jdf.queryExecution().toString()
    a, b, c = problems.created_at(spark, DATA)
    read = timestamps.interpret(a.unionAll(b).unionAll(c), "created_at", "locale", "client_zone", problems.abbreviations(spark, DATA))
    solved = timestamps.choose(read.drop("created_at", "locale", "client_zone"), "source", ["at", "tie"]).where("broken = 0").select(*found.columns)
    assert found.exceptAll(solved).count() == solved.exceptAll(found).count() == 0 < found.count()


def test_viterbi_against_brute_force(spark):
    """The cheapest of all sequences of readings, for each source, whatever the partitions."""
    rng = random.Random(6)
    rows = [(f"s{k}", i, f"{rng.randrange(1, 15):02d}/{rng.randrange(1, 13):02d}/2024 10:00" if rng.random() < 0.7 else f"2024-{rng.randrange(1, 13):02d}-09 10:00") for k in range(12) for i in range(9)]
    weight, switch, back = 0.7, 1.0, 2.0
    got = chosen(spark, rows, weight, switch=switch, back=back)
    for k in range(12):
        options = [list(zip(*timestamps.readings_of(t, "de_DE", None, {}, weight), strict=True)) for s, _, t in rows if s == f"s{k}"]
        price = lambda way: sum(x[2] for x in way) + sum(switch * (a[1] != b[1]) + back * (b[0] < a[0]) for a, b in zip(way, way[1:]))
        least = min(map(price, product(*options)))
        mine = [next(x for x in o if datetime.fromtimestamp(x[0] / 1e6, UTC).strftime("%m-%d") == got[f"s{k}", i]) for i, o in enumerate(options)]
        assert abs(price(mine) - least) < 1e-9


def test_running_totals_of_a_hot_key(spark):
    rows = [("hot", i, 1) for i in range(500)] + [(None, i, 2) for i in range(5)] + [("b", 0, None)]
    got = running_totals(spark.createDataFrame(rows, "k string, i int, v int"), ["k"], ["i"], {"t": F.coalesce("v", F.lit(0))}).collect()
    assert {(r.k, r.i): r.t for r in got} == {("hot", i): i + 1 for i in range(500)} | {(None, i): 2 * i + 2 for i in range(5)} | {("b", 0): 0}


def test_scores(spark):
    rows = [(3, 0.5, 24.0, 1.0, 0, 0.0), (5, 0.9, 48.0, 2.25, 10, 1.0), (1, 0.0, 8760.0, 1.0, 0, 0.0), (4, 0.7, 0.0, 1.0, 5, 0.2)]
    df = spark.createDataFrame(rows, "i int, c double, h double, s double, u int, g double").withColumn("now", F.lit("2024-02-01").cast("timestamp"))
    df = df.withColumn("last", F.expr("timestamp_micros(unix_micros(now) - cast(h * 3600000000 as bigint))"))
    got = [r[0] for r in df.select(scoring.composite(F.col("i"), F.col("c"), scoring.recency(F.col("last"), F.col("s"), F.col("now")), F.col("u"), F.col("g"))).collect()]
    assert got == [0.3302, 0.8417, 0.0015, 0.6575]


def test_pagerank(spark):
    chain = spark.createDataFrame([("A", "B", 1.0), ("B", "C", 1.0), ("C", "D", 1.0), ("D", "E", 1.0), ("E", "E", 1.0), ("A", "B", 0.5), ("A", "X", 0.0)], "src string, dst string, w double")
    got = {r.node: round(r["rank"], 6) for r in graph.pagerank(graph.symmetric(chain), spark.createDataFrame([("A", 1.0)], "node string, p double")).collect()}
    assert got == {"A": 0.577381, "B": 0.309524, "C": 0.083333, "D": 0.023809, "E": 0.005952}
    star = spark.createDataFrame([("S", "X", 1.0), ("S", "Y", 0.5)], "src string, dst string, w double")
    got = {r.node: round(r["rank"], 6) for r in graph.pagerank(graph.symmetric(star), spark.createDataFrame([("S", 0.5), ("Z", 0.5)], "node string, p double")).collect()}
    assert got == {"S": 0.444445, "X": 0.148148, "Y": 0.074074, "Z": 0.333333}


def test_fusion(spark):
    one = spark.createDataFrame([("q", "m1", 1), ("q", "m2", 2), ("q", "m3", 3)], "query_id string, id string, rank int")
    two = spark.createDataFrame([("q", "m2", 1), ("q", "m4", 2)], "query_id string, id string, rank int")
    got = [(r.id, round(r.score, 6)) for r in retrieval.fuse([one, two], 9).orderBy("rank").collect()]
    assert got == [("m2", 0.032522), ("m1", 0.016393), ("m4", 0.016129), ("m3", 0.015873)]


def test_bm25_edges(spark):
    docs = spark.createDataFrame([(1, "Alpha beta beta"), (2, "alpha gamma"), (3, None), (4, ""), (5, "delta"), (6, "delta eps")], "doc_id bigint, text string")
    ask = spark.createDataFrame([("a", "beta zzz"), ("b", "beta beta"), ("c", ""), ("d", None)], "query_id string, query string")
    got = {(r.query_id, r.id): r.score for r in retrieval.bm25(docs, ask, 3).collect()}
    assert set(got) == {("a", 1), ("b", 1)} and abs(got["b", 1] - 2 * got["a", 1]) < 1e-5


def test_upsert_and_json_lines(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, n int")
    new = spark.createDataFrame([(2, "c", 0), (3, "d", 1), (3, "e", 2)], "k int, v string, n int")
    assert {(r.k, r.v) for r in transcripts.upsert(old, new, ["k"], ["n"]).collect()} == {(1, "a"), (2, "c"), (3, "e")}
    (tmp_path / "t.jsonl").write_text('{"role":"user","content":"hi","id":"7"}\nprose\n{"role":"ai"}\n{"role":"ai","content":" "}\n{"role":"ai","content":"yes","timestamp":"now"}\n')
    got = transcripts.json_lines(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.role, r.content, r.created_at, r.external_id) for r in got] == [(0, "user", "hi", None, "7"), (1, "ai", "yes", "now", None)]
    assert transcripts.markdown(spark, str(tmp_path)).first().content.startswith("prose")


def test_holders_of_titles_that_end_inside_a_word(spark):
    from palimpsest.plans import quality

    texts = ["Run the backup script by hand.", "the BACKUP script b", "the backup plan", "a-b", "!!!", "ab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    titles = ["the backup script b", "ackup scri", "A-B", "!!!", "not anywhere at all", "b", "The backup script b"]
    got = quality.holders(docs, spark.createDataFrame(list(enumerate(titles)), "query_id int, query string")).collect()
    assert sorted((r.query_id, r.id) for r in got) == [(q, i) for q, a in enumerate(titles) for i, t in enumerate(texts) if a.lower() in t.lower()]


def test_entity_links_of_all_candidates(spark):
    """Links by sets and members against all pairs of candidates, also of different or no conversations and with one entity."""
    from conftest import DATA

    from palimpsest.plans import quality

    c = [(r.candidate_id, {e for e in r.entities or [] if e is not None}) for r in spark.read.parquet(f"{DATA}/memory_candidates.parquet").select("candidate_id", "entities").collect()]
    want = {(x, y): len(a & b) / len(a | b) for x, a in c for y, b in c if x < y and a & b}
    members = {}
    for r in quality.gra_entity_members(spark, DATA).collect():
        members.setdefault(r.set_id, []).append(r.candidate_id)
    got = [(min(x, y), max(x, y), r.jaccard) for r in quality.gra_entity_links(spark, DATA).collect() for x in members[r.a] for y in members[r.b] if r.a != r.b or x < y]
    assert len(got) == len(want) > 0 and all(abs(want[x, y] - j) < 1e-4 for x, y, j in got)
