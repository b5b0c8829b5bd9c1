"""Queries that combine operators: search over summaries and over the graph, reranking, pushes of events, ledgers, exports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators import delivery, graph, hierarchy, retrieval
from palimpsest.plans import memory
from palimpsest.plans.context import _VEC
from palimpsest.plans.graphs import _MEMBERS, _SIDED, _sided, members
from palimpsest.plans.problems import _RANKED, _TREE
from palimpsest.util import running_totals, strip, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


@query("flt_prefix", "SELECT left(candidate_id, 9) AS prefix, CASE WHEN count(*) = 1 THEN min(candidate_id) END AS candidate_id, count(*) AS n FROM memory_candidates GROUP BY 1")
def flt_prefix(spark, sf_dir):
    """What a shortened identifier stands for: one candidate, or null where it is ambiguous."""
    c = table(spark, sf_dir, "memory_candidates").groupBy(F.left("candidate_id", F.lit(9)).alias("prefix")).agg(F.min("candidate_id").alias("one"), F.count("*").alias("n"))
    return c.select("prefix", F.when(F.col("n") == 1, F.col("one")).alias("candidate_id"), "n")


@query("rap_search", _TREE.replace("WITH RECURSIVE pairs", f"WITH RECURSIVE asked AS ({memory._ASK}), nodes AS (SELECT id, min(content) AS content FROM summary_nodes WHERE id IS NOT NULL GROUP BY 1), nv AS ({_VEC.format('id', 'content', 'nodes')}), qv AS ({_VEC.format('query_id', 'query', 'asked')}), pairs") + """
, hits AS (SELECT * FROM (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT q.id AS query_id, n.id, floor(sum(q.v * n.v) / (any_value(q.norm) * any_value(n.norm)) * 1e6 + 0.5) / 1e6::DOUBLE AS score FROM qv q JOIN nv n USING (dim) WHERE q.norm > 0 AND n.norm > 0 GROUP BY 1, 2)) WHERE rank <= 10),
under AS (SELECT unnest(path) AS a, id FROM down WHERE id NOT IN (SELECT par FROM one WHERE par IS NOT NULL)), best AS (SELECT query_id, u.id, max(score) AS score FROM hits h JOIN under u ON u.a = h.id GROUP BY 1, 2)
SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM best) WHERE rank <= 10""")
def rap_search(spark, sf_dir):
    """Search over a tree of summaries: the ten nearest nodes of each query stand for the leaves below them, each with the best score that reaches it."""
    nodes = table(spark, sf_dir, "summary_nodes").where("id is not null").groupBy("id").agg(F.min("content").alias("content"))
    asked = retrieval.embedded(memory._asked(spark, sf_dir), "query_id", "query").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    hits = retrieval.dense(retrieval.embedded(nodes, "id", "content"), asked, 10)
    tree = hierarchy.hierarchy(table(spark, sf_dir, "summary_nodes"), with_paths=True).where("depth >= 0 and descendants = 0")
    under = tree.select(F.col("id").alias("leaf"), F.explode("path").alias("id"))
    best = hits.join(under, "id").groupBy("query_id", F.col("leaf").alias("id")).agg(F.max("score").alias("score"))
    return retrieval.ranked(best, 10)


@query("ret_graph", f"""WITH asked AS ({memory._ASK}), {_MEMBERS}, words AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS w FROM asked), names AS (SELECT DISTINCT entity, unnest(regexp_extract_all(lower(entity), '[\\p{{L}}\\p{{N}}]+')) AS w FROM m WHERE entity IS NOT NULL),
seeds AS (SELECT query_id, entity FROM (SELECT query_id, entity, row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC, entity) AS rank FROM words JOIN names USING (w) WHERE length(w) >= 3 GROUP BY 1, 2) WHERE rank <= 25),
deg AS (SELECT entity, count(*) AS n FROM m GROUP BY 1), sc AS (SELECT query_id, m.id, floor(sum(1.0::DOUBLE / deg.n) * 1e6 + 0.5) / 1e6::DOUBLE AS score FROM seeds JOIN m USING (entity) JOIN deg USING (entity) GROUP BY 1, 2) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc) WHERE rank <= 10""")
def ret_graph(spark, sf_dir):
    """Search over the graph: the entities that share words with a query are its seeds, at most 25; their memories are ranked by the seeds they hold, rare ones weighing more."""
    m = members(spark, sf_dir)
    words = memory._asked(spark, sf_dir).select("query_id", F.explode(F.array_distinct(retrieval.tokens(F.col("query")))).alias("w")).where("length(w) >= 3")
    names = m.select("entity").distinct().select("entity", F.explode(F.array_distinct(retrieval.tokens(F.col("entity")))).alias("w"))
    hits = words.join(names, "w").groupBy("query_id", "entity").agg(F.count("*").alias("shared"))
    seeds = graph.prune(hits, 25, "query_id", [F.desc("shared"), F.asc("entity")]).select("query_id", "entity")
    n = m.groupBy("entity").agg(F.count("*").alias("n"))
    scored = seeds.join(m.join(n, "entity"), "entity").groupBy("query_id", "id").agg(S.rounded(F.sum(1.0 / F.col("n")), 6).alias("score"))
    return retrieval.ranked(scored, 10)


def rerank(found: DataFrame, score: Callable[[DataFrame], Column], top: int, k: int) -> DataFrame:
    """found (query_id, id, rank, ...) with its first ``top`` rows of each query in the order of another score, the rest after them; ``score`` makes the column, from SQL or a pandas UDF."""
    scored = found.withColumn("score", F.when(F.col("rank") <= top, score(found)))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")
    return scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


@query("ret_reranked", f"WITH {memory._BM25}, p AS (SELECT b.query_id, b.id, b.rank, regexp_extract_all(lower(a.query), '[\\p{{L}}\\p{{N}}]+') AS q, regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+') AS t FROM bm b JOIN asked a USING (query_id) JOIN documents d ON d.doc_id = b.id WHERE b.rank <= 50), s AS (SELECT query_id, id, rank, floor(len(list_intersect(q, t)) / len(list_distinct(list_concat(q, t)))::DOUBLE * 1e6 + 0.5) / 1e6::DOUBLE AS score FROM p) SELECT query_id, id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM s) WHERE place <= 10")
def ret_reranked(spark, sf_dir):
    """The fifty best by BM25 in the order of a pairwise score, here the Jaccard likeness of words."""
    docs, asked = table(spark, sf_dir, "documents"), memory._asked(spark, sf_dir)
    best = retrieval.bm25(docs, asked, 50).drop("score").join(asked, "query_id").join(docs.select(F.col("doc_id").alias("id"), "text"), "id")
    q, t = retrieval.tokens(F.col("query")), retrieval.tokens(F.col("text"))
    likeness = lambda _: S.rounded(F.size(F.array_intersect(q, t)) / F.size(F.array_union(q, t)), 6)
    return rerank(best, likeness, 50, 10).select("query_id", "id", "score", "place")


@query("lif_enrich", f"WITH {_SIDED}, d AS (SELECT a AS id, b AS other, similarity, type_a AS t, type_b AS o, created_at_b AS born FROM sided UNION ALL SELECT b, a, similarity, type_b, type_a, created_at_a FROM sided), e AS (SELECT id, other, similarity, row_number() OVER (PARTITION BY id ORDER BY similarity DESC, other) AS rank FROM d WHERE t = o AND o IN ('fact', 'task', 'decision') AND similarity > 0.5 AND born < TIMESTAMP '2026-01-01') SELECT id, other, rank FROM e WHERE rank <= 3")
def lif_enrich(spark, sf_dir):
    """The at most three neighbours of each memory that its coming makes stale: same type, alike, old enough."""
    s = _sided(spark, sf_dir).where("type_a = type_b and type_a in ('fact', 'task', 'decision') and similarity > 0.5")
    both = s.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity", F.col("created_at_b").alias("born")).unionAll(s.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity", F.col("created_at_a").alias("born")))
    old = both.where("born < timestamp_ntz'2026-01-01'")
    return graph.prune(old, 3, "id", [F.desc("similarity"), F.asc("other")]).select("id", "other", F.col("rn").alias("rank"))


@query("snk_push", f"""WITH once AS (SELECT conversation_id, m AS message_id, delivery_id, received_at FROM ({_RANKED}) WHERE m <> '' AND rn = 1 AND conversation_id IS NOT NULL), new AS (SELECT * FROM once o WHERE NOT EXISTS (SELECT 1 FROM raw_messages r WHERE r.row_id % 2 = 0 AND r.conversation_id = o.conversation_id AND r.external_id = o.message_id)),
last AS (SELECT conversation_id, max(ordinal) AS last FROM raw_messages WHERE row_id % 2 = 0 GROUP BY 1) SELECT n.conversation_id, n.message_id, coalesce(l.last, -1) + row_number() OVER (PARTITION BY n.conversation_id ORDER BY n.received_at NULLS FIRST, n.delivery_id) AS ordinal FROM new n LEFT JOIN last l USING (conversation_id)""")
def snk_push(spark, sf_dir):
    """Delivered messages that the import of the even rows doesn't know, appended to their conversations: ordinals go on from the last one, by running counts, so a channel of any size is spread."""
    once = delivery.exactly_once(spark, table(spark, sf_dir, "ingest_events"))
    once = once.where("conversation_id is not null").select("conversation_id", strip(F.col("message_id")).alias("message_id"), "delivery_id", F.coalesce(F.unix_micros(F.col("received_at").cast("timestamp")), F.lit(-(1 << 62))).alias("at")).where("message_id <> ''")
    imported = table(spark, sf_dir, "raw_messages").where("row_id % 2 = 0")
    known = imported.select("conversation_id", F.col("external_id").alias("message_id"))
    new = once.join(known, ["conversation_id", "message_id"], "left_anti")
    counted = running_totals(new, ["conversation_id"], ["at", "delivery_id"], {"no": F.lit(1)}, "push")
    last = imported.groupBy("conversation_id").agg(F.max("ordinal").alias("last"))
    return counted.join(last, "conversation_id", "left").select("conversation_id", "message_id", (F.coalesce("last", F.lit(-1)) + F.col("no")).alias("ordinal"))


@query("agg_ledger", "WITH r AS (SELECT batch_id, min(received_at) AS began, max(received_at) AS ended, count(*) AS n FROM ingest_events WHERE batch_id IS NOT NULL AND received_at IS NOT NULL GROUP BY 1) SELECT batch_id, began, n, ended + INTERVAL 1 HOUR AS next_run FROM r ORDER BY ended DESC, batch_id LIMIT 20")
def agg_ledger(spark, sf_dir):
    """The last twenty batches, and when each one's successor is due."""
    e = table(spark, sf_dir, "ingest_events").where("batch_id is not null and received_at is not null")
    r = e.groupBy("batch_id").agg(F.min("received_at").alias("began"), F.max("received_at").alias("ended"), F.count("*").alias("n"))
    return r.orderBy(F.desc("ended"), "batch_id").limit(20).select("batch_id", "began", "n", F.expr("ended + INTERVAL 1 HOUR").alias("next_run"))


@query("agg_commands", "SELECT project, lower(trim(role)) AS role, count(*) AS n, count(DISTINCT conversation_id) AS conversations, max(received_at) AS last_at FROM ingest_events WHERE project IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2")
def agg_commands(spark, sf_dir):
    """What came for each project, by role."""
    e = table(spark, sf_dir, "ingest_events").where("project is not null")
    return e.groupBy("project", F.lower(F.trim("role")).alias("role")).agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("conversations"), F.max("received_at").alias("last_at")).where("n >= 2")


@query("prv_export", "SELECT 'u_' || sha256(coalesce(user_id, ''))[1:12] AS user_key, conversation_id, source_kind, regexp_replace(source_uri, '//[^/]*', '//host') AS source_uri FROM raw_conversations")
def prv_export(spark, sf_dir):
    """Conversations without what names their owner: users as hashes, hosts left out."""
    user = F.concat(F.lit("u_"), F.left(F.sha2(F.coalesce("user_id", F.lit("")), 256), F.lit(12)))
    uri = F.regexp_replace("source_uri", "//[^/]*", "//host")
    return table(spark, sf_dir, "raw_conversations").select(user.alias("user_key"), "conversation_id", "source_kind", uri.alias("source_uri"))


_ACTION, _CHOICE = "(?i)^ *(todo|next|please|can you|remember|i want to)|i'd like", "(?i)we agreed|we decided|decided"


@query("fn_thread", f"""WITH l AS (SELECT conversation_id, ordinal, row_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS no FROM raw_messages WHERE conversation_id IS NOT NULL AND content IS NOT NULL),
k AS (SELECT conversation_id, CASE WHEN regexp_matches(line, '{_ACTION.replace("'", "''")}') THEN 'action' ELSE 'decision' END AS kind, left(line, 120) AS line, max((coalesce(ordinal, -1), row_id, no)) AS place FROM l WHERE regexp_matches(line, '{_ACTION.replace("'", "''")}') OR regexp_matches(line, '{_CHOICE}') GROUP BY 1, 2, 3)
SELECT conversation_id, kind, line, rank FROM (SELECT conversation_id, kind, line, row_number() OVER (PARTITION BY conversation_id, kind ORDER BY place DESC) AS rank FROM k) WHERE rank <= CASE kind WHEN 'action' THEN 8 ELSE 5 END""")
def fn_thread(spark, sf_dir):
    """The last actions asked for (eight) and decisions told (five) in each conversation, each wording once."""
    m = table(spark, sf_dir, "raw_messages").where("conversation_id is not null and content is not null")
    lines = m.select("conversation_id", F.coalesce("ordinal", F.lit(-1)).alias("o"), "row_id", F.posexplode(F.split("content", "\n")).alias("no", "line"))
    asks, tells = F.col("line").rlike(_ACTION), F.col("line").rlike(_CHOICE)
    k = lines.where(asks | tells).groupBy("conversation_id", F.when(asks, "action").otherwise("decision").alias("kind"), F.left("line", F.lit(120)).alias("line")).agg(F.max(F.struct("o", "row_id", "no")).alias("at"))
    w = Window.partitionBy("conversation_id", "kind").orderBy(F.desc("at"))
    return k.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= F.when(F.col("kind") == "action", 8).otherwise(5)).select("conversation_id", "kind", "line", "rank")


@query("gra_projects", "SELECT conversation_id, CASE WHEN source_uri IS NULL THEN NULL WHEN len(list_filter(p, lambda x: x IN ('projects', 'src', 'code', 'desk'))) > 0 THEN p[list_position(p, list_filter(p, lambda x: x IN ('projects', 'src', 'code', 'desk'))[1]) + 1] ELSE p[len(p)] END AS project FROM (SELECT conversation_id, source_uri, list_filter(string_split(regexp_replace(coalesce(source_uri, ''), '^[a-z_]+:', ''), '/'), lambda x: x <> '') AS p FROM raw_conversations)")
def gra_projects(spark, sf_dir):
    """The project of each conversation by its address: what follows the first folder that holds projects, else the last part."""
    marks = ("projects", "src", "code", "desk")
    parts = F.filter(F.split(F.regexp_replace(F.coalesce("source_uri", F.lit("")), "^[a-z_]+:", ""), "/"), lambda x: x != "")
    c = table(spark, sf_dir, "raw_conversations").select("conversation_id", "source_uri", parts.alias("p"))
    first = F.get(F.filter("p", lambda x: x.isin(*marks)), F.lit(0))
    after = F.try_element_at("p", (F.array_position("p", first) + 1).cast("int"))
    return c.select("conversation_id", F.when(F.col("source_uri").isNotNull(), F.when(first.isNotNull(), after).otherwise(F.try_element_at("p", F.lit(-1)))).alias("project"))
