"""Queries over the graph of memories, entities and links: building links, paths, subgraphs, conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators import graph, retrieval
from palimpsest.plans.memory import NOW, now
from palimpsest.util import every_50th, table

QUERIES, SQL = {}, {}

#: Links kept for each memory, neighbours looked at, and the bounds of the four modes.
TOP_K, POOL = 5, 50
MODES = {"absolute": 0.85, "topk": 0.0, "adaptive": 0.95, "zscore": 2.0}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_50TH = "try_cast('0x' || right({0}, 4) AS INT) % 50 = 0"

_USABLE = """vecs AS (SELECT memory_id AS id, any_value(embedding) AS e FROM memory_embeddings WHERE memory_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"""
_POOL = f"""{_USABLE}, sims AS (SELECT q.id AS src, v.id AS dst, floor(list_cosine_similarity(q.e::DOUBLE[], v.e::DOUBLE[]) * 1e6 + 0.5) / 1e6::DOUBLE AS s FROM vecs q JOIN vecs v ON q.id <> v.id WHERE {_50TH.format('q.id')}),
pool AS (SELECT src, dst, greatest(0.0, least(1.0, s)) AS s, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY s DESC, dst) AS rank FROM sims) WHERE rank <= {POOL})"""


def vectors(spark, sf_dir) -> DataFrame:
    """id, vec of the memories with a usable vector, each once."""
    v = F.col("embedding")
    good = (F.size(v) == 64) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= 3.4e38)) & F.exists(v, lambda x: x != 0)
    rows = table(spark, sf_dir, "memory_embeddings").where(F.col("memory_id").isNotNull() & F.coalesce(good, F.lit(False)))
    return rows.groupBy(F.col("memory_id").alias("id")).agg(F.first(v).alias("vec"))


def linked(pool: DataFrame, mode: str, bound: float, k: int = TOP_K) -> DataFrame:
    """src, dst, similarity of the links that a mode makes from pools (src, dst, s, rank): at most k for each src, in both directions.

    absolute: s of at least ``bound``; topk: the first k; adaptive: at least the ``bound`` percentile of the pool; zscore: at
    least ``bound`` standard deviations above the pool's mean.
    """
    if mode == "adaptive":
        floor = pool.groupBy("src").agg(F.percentile("s", bound).alias("floor"))
    elif mode == "zscore":
        floor = pool.groupBy("src").agg((F.avg("s") + bound * F.coalesce(F.stddev_samp("s"), F.lit(0.0))).alias("floor"))
    else:
        floor = pool.select("src", F.lit(bound).alias("floor")).distinct()
    one = pool.where(F.col("rank") <= k).join(floor, "src").where((F.col("s") > 0) & (F.col("s") >= F.col("floor") - 1e-9)).select("src", "dst", F.col("s").alias("similarity"))
    return one.unionAll(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "similarity")).distinct()


def _link_query(mode):
    def run(spark, sf_dir):
        v = vectors(spark, sf_dir)
        asked = v.where(every_50th(F.col("id"))).select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
        pool = retrieval.dense(v, asked, POOL).select(F.col("query_id").alias("src"), F.col("id").alias("dst"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("s"), "rank")
        return linked(pool, mode, MODES[mode])

    run.__doc__ = f"Links of the memories of the stated set by the mode {mode}, in both directions."
    return run


_FLOOR = {"absolute": f"SELECT DISTINCT src, {MODES['absolute']}::DOUBLE AS floor FROM pool", "topk": "SELECT DISTINCT src, 0.0::DOUBLE AS floor FROM pool", "adaptive": f"SELECT src, quantile_cont(s, {MODES['adaptive']}) AS floor FROM pool GROUP BY 1", "zscore": f"SELECT src, avg(s) + {MODES['zscore']} * coalesce(stddev_samp(s), 0) AS floor FROM pool GROUP BY 1"}
for _mode in MODES:
    QUERIES[f"gra_link_{_mode}"] = _link_query(_mode)
    SQL[f"gra_link_{_mode}"] = f"WITH {_POOL}, f AS ({_FLOOR[_mode]}), one AS (SELECT p.src, p.dst, p.s AS similarity FROM pool p JOIN f USING (src) WHERE p.rank <= {TOP_K} AND p.s > 0 AND p.s >= f.floor - 1e-9) SELECT * FROM one UNION SELECT dst, src, similarity FROM one"


# -- memories with types: those that candidates were promoted to -----------------------
_TYPED = f"""typed AS (SELECT promoted_memory_id AS id, min(type) AS type, max(importance) AS importance, max(confidence) AS confidence, max(created_at) AS created_at FROM memory_candidates WHERE promoted_memory_id IS NOT NULL GROUP BY 1),
strong AS (SELECT a, b, max(similarity) AS similarity, max_by(reason, (similarity, link_id)) AS reason FROM (SELECT least(source_memory_id, target_memory_id) AS a, greatest(source_memory_id, target_memory_id) AS b, similarity, reason, link_id FROM memory_links WHERE source_memory_id <> target_memory_id AND similarity >= 0 AND similarity <= 1) GROUP BY 1, 2)"""


def typed(spark, sf_dir) -> DataFrame:
    """id, type, importance, confidence, created_at of the memories that candidates were promoted to."""
    c = table(spark, sf_dir, "memory_candidates").where("promoted_memory_id is not null")
    return c.groupBy(F.col("promoted_memory_id").alias("id")).agg(F.min("type").alias("type"), F.max("importance").alias("importance"), F.max("confidence").alias("confidence"), F.max("created_at").alias("created_at"))


def strongest(spark, sf_dir) -> DataFrame:
    """a < b, similarity, reason: the strongest link of each pair, whatever its direction. Similarities off the scale don't count."""
    l = table(spark, sf_dir, "memory_links").where("source_memory_id <> target_memory_id and similarity >= 0 and similarity <= 1")
    pair = [F.least("source_memory_id", "target_memory_id").alias("a"), F.greatest("source_memory_id", "target_memory_id").alias("b")]
    return l.groupBy(*pair).agg(F.max("similarity").alias("similarity"), F.max_by("reason", F.struct("similarity", "link_id")).alias("reason"))


@query("gra_strongest", f"WITH {_TYPED} SELECT a, b, similarity, reason FROM strong")
def gra_strongest(spark, sf_dir):
    return strongest(spark, sf_dir)


def _sided(spark, sf_dir):
    """The strongest link of each pair with what is known of both memories."""
    t = typed(spark, sf_dir)
    side = lambda s: t.select(*(F.col(c).alias(s if c == "id" else f"{c}_{s}") for c in t.columns))
    return strongest(spark, sf_dir).join(side("a"), "a").join(side("b"), "b")


_SIDED = f"{_TYPED}, sided AS (SELECT s.*, x.type AS type_a, y.type AS type_b, x.importance AS importance_a, y.importance AS importance_b, x.created_at AS created_at_a, y.created_at AS created_at_b FROM strong s JOIN typed x ON x.id = s.a JOIN typed y ON y.id = s.b)"


@query("jn_cross_type", f"WITH {_SIDED} SELECT a, b, similarity, type_a, type_b FROM sided WHERE similarity >= 0.85 AND type_a <> type_b ORDER BY similarity DESC, a, b LIMIT 100")
def jn_cross_type(spark, sf_dir):
    """The hundred strongest links between memories of different types, which may contradict each other."""
    return _sided(spark, sf_dir).where("similarity >= 0.85 and type_a <> type_b").select("a", "b", "similarity", "type_a", "type_b").orderBy(F.desc("similarity"), "a", "b").limit(100)


@query("jn_conflicts", f"WITH {_TYPED} SELECT s.a, s.b, s.similarity, x.type AS type_a, y.type AS type_b, coalesce(x.importance, 0) + coalesce(y.importance, 0) AS weight FROM strong s LEFT JOIN typed x ON x.id = s.a LEFT JOIN typed y ON y.id = s.b WHERE s.similarity >= 0.9")
def jn_conflicts(spark, sf_dir):
    """Conflicts with what is known of both sides; a side that is gone stays null."""
    t = typed(spark, sf_dir)
    side = lambda s: t.select(F.col("id").alias(s), F.col("type").alias(f"type_{s}"), F.col("importance").alias(f"i_{s}"))
    c = strongest(spark, sf_dir).where("similarity >= 0.9").join(side("a"), "a", "left").join(side("b"), "b", "left")
    return c.select("a", "b", "similarity", "type_a", "type_b", (F.coalesce("i_a", F.lit(0)) + F.coalesce("i_b", F.lit(0))).alias("weight"))


@query("ded_record_conflicts", """WITH seen AS (SELECT link_id, least(source_memory_id, target_memory_id) AS a, greatest(source_memory_id, target_memory_id) AS b, similarity, reason, created_at FROM memory_links WHERE source_memory_id <> target_memory_id AND similarity >= 0.8 AND similarity <= 1)
SELECT a, b, max_by(similarity, (created_at, link_id)) AS similarity, max_by(reason, (created_at, link_id)) AS reason, CASE WHEN min_by(link_id, (created_at, link_id)) % 3 = 0 THEN 'resolved' ELSE 'pending' END AS status, count(*) AS seen FROM seen WHERE created_at IS NOT NULL GROUP BY 1, 2""")
def ded_record_conflicts(spark, sf_dir):
    """Each pair once: a later report refreshes similarity and reason, the first one's status stays."""
    l = table(spark, sf_dir, "memory_links").where("source_memory_id <> target_memory_id and similarity >= 0.8 and similarity <= 1 and created_at is not null")
    order = F.struct("created_at", "link_id")
    status = F.when(F.min_by("link_id", order) % 3 == 0, "resolved").otherwise("pending")
    pair = [F.least("source_memory_id", "target_memory_id").alias("a"), F.greatest("source_memory_id", "target_memory_id").alias("b")]
    return l.groupBy(*pair).agg(F.max_by("similarity", order).alias("similarity"), F.max_by("reason", order).alias("reason"), status.alias("status"), F.count("*").alias("seen"))


@query("lif_expire", f"WITH {_SIDED}, d AS (SELECT a AS id, b AS neighbour, similarity, type_a AS type, created_at_a AS born, created_at_b AS newer FROM sided WHERE type_a = type_b UNION ALL SELECT b, a, similarity, type_b, created_at_b, created_at_a FROM sided WHERE type_a = type_b) SELECT id, max_by(neighbour, (similarity, neighbour)) AS superseded_by, max(similarity) AS similarity FROM d WHERE type IN ('fact', 'task', 'decision') AND similarity > 0.8 AND born < newer AND born < TIMESTAMP '2026-01-01' GROUP BY 1")
def lif_expire(spark, sf_dir):
    """Facts, tasks and decisions that a newer memory of the same type, very much like them, supersedes."""
    s = _sided(spark, sf_dir).where("type_a = type_b")
    one = s.select(F.col("a").alias("id"), F.col("b").alias("neighbour"), "similarity", F.col("type_a").alias("type"), F.col("created_at_a").alias("at"), F.col("created_at_b").alias("newer"))
    two = s.select(F.col("b").alias("id"), F.col("a").alias("neighbour"), "similarity", F.col("type_b").alias("type"), F.col("created_at_b").alias("at"), F.col("created_at_a").alias("newer"))
    stale = one.unionAll(two).where("type in ('fact', 'task', 'decision') and similarity > 0.8 and at < newer and at < timestamp_ntz'2026-01-01'")
    return stale.groupBy("id").agg(F.max_by("neighbour", F.struct("similarity", "neighbour")).alias("superseded_by"), F.max("similarity").alias("similarity"))


# -- subgraphs, paths, entities ------------------------------------------------------------
@query("gra_induced", """WITH e AS (SELECT least(source_memory_id, target_memory_id) AS a, greatest(source_memory_id, target_memory_id) AS b, max(similarity) AS w FROM memory_links WHERE source_memory_id <> target_memory_id AND similarity > 0 AND similarity <= 1 GROUP BY 1, 2),
top AS (SELECT n FROM (SELECT a AS n FROM e UNION ALL SELECT b FROM e) GROUP BY n ORDER BY count(*) DESC, n LIMIT 200) SELECT a, b, w FROM e WHERE a IN (SELECT n FROM top) AND b IN (SELECT n FROM top)""")
def gra_induced(spark, sf_dir):
    """The links among the 200 memories with the most links."""
    l = table(spark, sf_dir, "memory_links").where("source_memory_id <> target_memory_id and similarity > 0 and similarity <= 1")
    e = l.groupBy(F.least("source_memory_id", "target_memory_id").alias("a"), F.greatest("source_memory_id", "target_memory_id").alias("b")).agg(F.max("similarity").alias("w"))
    top = e.select(F.explode(F.array("a", "b")).alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").limit(200).select("n")  # 200 rows
    return e.join(F.broadcast(top.withColumnRenamed("n", "a")), "a", "left_semi").join(F.broadcast(top.withColumnRenamed("n", "b")), "b", "left_semi").select("a", "b", "w")


@query("gra_paths", """WITH RECURSIVE e AS (SELECT DISTINCT s, d FROM (SELECT source_memory_id AS s, target_memory_id AS d FROM memory_links WHERE similarity >= 0.5 AND similarity <= 1 UNION ALL SELECT target_memory_id, source_memory_id FROM memory_links WHERE similarity >= 0.5 AND similarity <= 1) WHERE s <> d),
w AS (SELECT DISTINCT s AS start, s AS node, 0 AS hops FROM e WHERE """ + _50TH.format("s") + """ UNION SELECT w.start, e.d, w.hops + 1 FROM w JOIN e ON e.s = w.node WHERE w.hops < 3) SELECT start, node, min(hops) AS hops FROM w WHERE start <> node GROUP BY 1, 2""")
def gra_paths(spark, sf_dir):
    """The fewest steps, up to three, from the memories of the stated set to others, along links of 0.5 and more."""
    l = table(spark, sf_dir, "memory_links").where("similarity >= 0.5 and similarity <= 1")
    e = graph.symmetric(l.select(F.col("source_memory_id").alias("src"), F.col("target_memory_id").alias("dst"), F.col("similarity").alias("w")))
    starts = e.where(every_50th(F.col("src"))).select(F.col("src").alias("node")).distinct()
    return graph.neighbours(e, starts, 3)


_MEMBERS = "m AS (SELECT DISTINCT promoted_memory_id AS id, unnest(entities) AS entity FROM memory_candidates WHERE promoted_memory_id IS NOT NULL)"


def members(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "memory_candidates").where("promoted_memory_id is not null")
    return c.select(F.col("promoted_memory_id").alias("id"), F.explode("entities").alias("entity")).distinct().where("entity is not null")


@query("gra_memory_graph", f"""WITH {_MEMBERS}, co AS (SELECT x.entity AS a, y.entity AS b, least(0.95, 0.4 + 0.05 * count(*)) AS w FROM m x JOIN m y ON x.id = y.id AND x.entity < y.entity GROUP BY 1, 2 HAVING count(*) >= 2),
one AS (SELECT 'm:' || id AS s, 'e:' || entity AS d, 1.0::DOUBLE AS w FROM m WHERE entity IS NOT NULL UNION ALL SELECT 'e:' || a, 'e:' || b, w FROM co UNION ALL SELECT 'm:' || source_memory_id, 'm:' || target_memory_id, similarity FROM memory_links WHERE similarity > 0 AND similarity <= 1),
bi AS (SELECT s, d, max(w) AS w FROM (SELECT s, d, w FROM one WHERE s <> d UNION ALL SELECT d, s, w FROM one WHERE s <> d) GROUP BY 1, 2) SELECT s AS src, d AS dst, floor(w / sum(w) OVER (PARTITION BY s) * 1e6 + 0.5) / 1e6::DOUBLE AS p FROM bi""")
def gra_memory_graph(spark, sf_dir):
    """The graph of memories and entities as transitions: memories to their entities, entities said together, linked memories; rows sum to one."""
    m = members(spark, sf_dir)
    tag = lambda kind, c: F.concat(F.lit(kind), F.col(c))
    said = m.select(tag("m:", "id").alias("src"), tag("e:", "entity").alias("dst"), F.lit(1.0).alias("w"))
    co = graph.cooccurrence(m, "id", "entity").select(tag("e:", "a").alias("src"), tag("e:", "b").alias("dst"), F.least(F.lit(0.95), 0.4 + 0.05 * F.col("n")).alias("w"))
    l = table(spark, sf_dir, "memory_links").where("similarity <= 1").select(tag("m:", "source_memory_id").alias("src"), tag("m:", "target_memory_id").alias("dst"), F.col("similarity").alias("w"))
    e = graph.symmetric(said.unionAll(co).unionAll(l))
    return e.join(e.groupBy("src").agg(F.sum("w").alias("all")), "src").select("src", "dst", S.rounded(F.col("w") / F.col("all"), 6).alias("p"))


@query("gra_decision_links", """SELECT a, b, 0.7::DOUBLE AS confidence, count(*) AS n FROM (SELECT DISTINCT c.candidate_id, x.e AS a, y.e AS b FROM memory_candidates c, unnest(c.entities) AS x(e), unnest(c.entities) AS y(e) WHERE c.type = 'decision' AND c.status IN ('accepted', 'pending') AND x.e < y.e) GROUP BY 1, 2""")
def gra_decision_links(spark, sf_dir):
    """Pairs of entities of one decision. A candidate's entities are few, so its pairs are made in its row."""
    c = table(spark, sf_dir, "memory_candidates").where("type = 'decision' and status in ('accepted', 'pending')").select("candidate_id", F.array_sort(F.array_distinct(F.filter("entities", lambda x: x.isNotNull()))).alias("e"))
    pairs = F.flatten(F.transform("e", lambda a, i: F.transform(F.slice("e", i + 2, F.size("e")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return c.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")).select("a", "b", F.lit(0.7).alias("confidence"), "n")


@query("jn_unlinked", "SELECT candidate_id FROM memory_candidates c WHERE NOT EXISTS (SELECT 1 FROM (SELECT unnest(entities) AS e, candidate_id FROM memory_candidates) x WHERE x.candidate_id = c.candidate_id AND x.e IS NOT NULL)")
def jn_unlinked(spark, sf_dir):
    """Candidates without an entity."""
    return table(spark, sf_dir, "memory_candidates").where(F.coalesce(F.size(F.filter("entities", lambda x: x.isNotNull())), F.lit(0)) <= 0).select("candidate_id")


_WORDS = r"'[\p{L}\p{N}]+'"


@query("gra_entity_index", f"""WITH free AS (SELECT candidate_id, regexp_extract_all(lower(content), {_WORDS}) AS w FROM memory_candidates WHERE content IS NOT NULL AND len(list_filter(coalesce(entities, []), lambda x: x IS NOT NULL)) = 0),
grams AS (SELECT DISTINCT candidate_id, g FROM (SELECT candidate_id, unnest(w) AS g FROM free UNION ALL SELECT candidate_id, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM free)),
vocabulary AS (SELECT array_to_string(regexp_extract_all(lower(entity), {_WORDS}), ' ') AS g, min(entity) AS entity FROM (SELECT unnest(entities) AS entity FROM memory_candidates) WHERE entity IS NOT NULL GROUP BY 1) SELECT candidate_id, entity FROM grams JOIN vocabulary USING (g)""")
def gra_entity_index(spark, sf_dir):
    """Entities of candidates without any: the known entities of one or two words that their text names, whole words only."""
    c = table(spark, sf_dir, "memory_candidates")
    free = c.where(F.col("content").isNotNull() & (F.coalesce(F.size(F.filter("entities", lambda x: x.isNotNull())), F.lit(0)) <= 0)).select("candidate_id", retrieval.tokens(F.col("content")).alias("w"))
    two = F.transform(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.size("w")).alias("b")), lambda p: F.concat_ws(" ", p["a"], p["b"]))
    grams = free.select("candidate_id", F.explode(F.array_distinct(F.concat("w", two))).alias("g"))
    vocabulary = c.select(F.explode("entities").alias("entity")).where("entity is not null").groupBy(F.array_join(retrieval.tokens(F.col("entity")), " ").alias("g")).agg(F.min("entity").alias("entity"))
    return grams.join(vocabulary, "g").select("candidate_id", "entity")


@query("gra_nodes", f"WITH {_MEMBERS} SELECT entity, count(*) AS memories, 14 + least(20, count(*)) AS size, CASE WHEN regexp_matches(entity, '[a-z][A-Z]') THEN 'identifier' WHEN contains(entity, ' ') THEN 'phrase' ELSE 'word' END AS kind FROM m WHERE entity IS NOT NULL GROUP BY 1")
def gra_nodes(spark, sf_dir):
    """Entities as nodes: how many memories name them, their size in a drawing, and their make."""
    kind = F.when(F.col("entity").rlike("[a-z][A-Z]"), "identifier").when(F.contains("entity", F.lit(" ")), "phrase").otherwise("word")
    return members(spark, sf_dir).groupBy("entity").agg(F.count("*").alias("memories")).select("entity", "memories", (14 + F.least(F.lit(20), F.col("memories"))).alias("size"), kind.alias("kind"))


@query("jn_projects", "SELECT p.project, count(DISTINCT c.candidate_id) AS memories FROM (SELECT DISTINCT project FROM ingest_events WHERE project IS NOT NULL) p LEFT JOIN (SELECT candidate_id, unnest(entities) AS entity FROM memory_candidates) c ON lower(replace(c.entity, ' ', '')) = lower(replace(p.project, ' ', '')) GROUP BY 1")
def jn_projects(spark, sf_dir):
    """Projects with the number of candidates that name them, also those without."""
    plain = lambda c: F.lower(F.replace(F.col(c), F.lit(" "), F.lit("")))
    p = table(spark, sf_dir, "ingest_events").where("project is not null").select("project").distinct().withColumn("key", plain("project"))
    c = table(spark, sf_dir, "memory_candidates").select("candidate_id", F.explode("entities").alias("entity")).withColumn("key", plain("entity"))
    return p.join(c, "key", "left").groupBy("project").agg(F.count_distinct("candidate_id").alias("memories"))


@query("gra_project_context", f"""WITH {_MEMBERS}, r AS (SELECT x.entity AS project, y.entity AS related, count(*) AS n FROM m x JOIN m y ON x.id = y.id AND x.entity <> y.entity GROUP BY 1, 2)
SELECT project, related, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY n DESC, related) AS rank FROM r) WHERE rank <= 5""")
def gra_project_context(spark, sf_dir):
    """The five entities that are named most often with each entity."""
    m = members(spark, sf_dir)
    r = m.join(m.withColumnRenamed("entity", "related"), "id").where("entity <> related").groupBy(F.col("entity").alias("project"), "related").agg(F.count("*").alias("n"))
    return graph.prune(r, 5, "project", [F.desc("n"), F.asc("related")]).withColumnRenamed("rn", "rank")


@query("gra_link_writer", """SELECT source_memory_id AS src, target_memory_id AS dst, max_by(similarity, (created_at, link_id)) AS similarity, min(created_at) AS since FROM memory_links WHERE source_memory_id <> target_memory_id AND similarity IS NOT NULL AND created_at IS NOT NULL GROUP BY 1, 2""")
def gra_link_writer(spark, sf_dir):
    """Links as a writer leaves them: none to itself, one row a pair and direction, the last similarity."""
    l = table(spark, sf_dir, "memory_links").where("source_memory_id <> target_memory_id and similarity is not null and created_at is not null")
    return l.groupBy(F.col("source_memory_id").alias("src"), F.col("target_memory_id").alias("dst")).agg(F.max_by("similarity", F.struct("created_at", "link_id")).alias("similarity"), F.min("created_at").alias("since"))


@query("gra_link_overview", """WITH g AS (SELECT source_memory_id AS s, count(*)::DOUBLE AS n FROM memory_links WHERE source_memory_id IS NOT NULL GROUP BY 1)
SELECT 'histogram' AS part, least(floor(similarity * 10), 9)::INT AS bucket, count(*)::DOUBLE AS value FROM memory_links WHERE similarity BETWEEN 0 AND 1 GROUP BY 2 UNION ALL SELECT 'links', NULL, count(*)::DOUBLE FROM memory_links UNION ALL SELECT 'sources', NULL, count(*)::DOUBLE FROM g
UNION ALL SELECT 'most', NULL, max(n) FROM g UNION ALL SELECT 'mean', NULL, floor(avg(n) * 1e6 + 0.5) / 1e6::DOUBLE FROM g UNION ALL SELECT 'p95', NULL, floor(quantile_cont(n, 0.95) * 1e6 + 0.5) / 1e6::DOUBLE FROM g""")
def gra_link_overview(spark, sf_dir):
    """Number of links and sources, most, mean and 95th percentile of links a source, and a histogram of similarity."""
    l = table(spark, sf_dir, "memory_links")
    n = l.where("source_memory_id is not null").groupBy("source_memory_id").agg(F.count("*").cast("double").alias("n"))
    row = lambda df, part, value: df.agg(value.cast("double").alias("value")).select(F.lit(part).alias("part"), F.lit(None).cast("int").alias("bucket"), "value")
    bars = l.where("similarity between 0 and 1").groupBy(F.least(F.floor(F.col("similarity") * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").cast("double").alias("value")).select(F.lit("histogram").alias("part"), "bucket", "value")
    return bars.unionAll(row(l, "links", F.count("*"))).unionAll(row(n, "sources", F.count("*"))).unionAll(row(n, "most", F.max("n"))).unionAll(row(n, "mean", S.rounded(F.avg("n"), 6))).unionAll(row(n, "p95", S.rounded(F.percentile("n", 0.95), 6)))


@query("gra_stored_vectors", f"SELECT memory_id, arg_max(model, (created_at, dim)) AS model, max(created_at) AS created_at, count(*) AS versions FROM memory_embeddings WHERE memory_id IS NOT NULL AND created_at IS NOT NULL AND created_at <= TIMESTAMP '{NOW}' GROUP BY 1")
def gra_stored_vectors(spark, sf_dir):
    """Vectors as an upsert leaves them up to now: the last version of each memory."""
    e = table(spark, sf_dir, "memory_embeddings").where(F.col("memory_id").isNotNull() & (F.col("created_at") <= now()))
    return e.groupBy("memory_id").agg(F.max_by("model", F.struct("created_at", "dim")).alias("model"), F.max("created_at").alias("created_at"), F.count("*").alias("versions"))


@query("ret_unindexed", f"WITH {_USABLE} SELECT DISTINCT e.memory_id, e.dim FROM memory_embeddings e WHERE e.memory_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM vecs v WHERE v.id = e.memory_id)")
def ret_unindexed(spark, sf_dir):
    """Memories whose vectors cannot go into the index."""
    return table(spark, sf_dir, "memory_embeddings").where("memory_id is not null").join(vectors(spark, sf_dir), F.col("memory_id") == F.col("id"), "left_anti").select("memory_id", "dim").distinct()
