"""Queries over memories, links, messages and deliveries: filters, joins, aggregates, scores, lifecycle, duplicates, graphs, retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators import graph, retrieval
from palimpsest.util import every_50th, running_totals, table

QUERIES, SQL = {}, {}

#: The clock of the queries, types of memories and visibilities.
NOW = "2024-02-01 00:00:00"
TYPES = ["preference", "fact", "project", "task", "decision", "style", "credential_pointer", "tool_call", "procedural"]
VISIBILITY = ["private", "shared", "org", "public"]
now = lambda: F.lit(NOW).cast("timestamp_ntz")

_ago = lambda n: f"TIMESTAMP_NTZ '{NOW}' - make_interval(0, 0, 0, {n})"


def memories(spark, sf_dir, text=True):
    """Memories made of the documents by arithmetic on their identifiers; the same in the SQL below."""
    d = table(spark, sf_dir, "documents")
    i = "cast(doc_id AS int)"
    return d.selectExpr(
        "doc_id AS id", *(["text AS content"] if text else []), f"element_at(array({', '.join(map(repr, TYPES))}), cast(doc_id % 9 AS int) + 1) AS type",
        "cast(1 + doc_id % 5 AS int) AS importance", "(doc_id % 10) / 10.0D AS confidence", "cast(doc_id % 8 AS int) AS usage_count", "(doc_id % 3) / 2.0D AS user_signal", "1.0D + doc_id % 4 AS strength",
        f"{_ago(f'{i} % 180')} AS created_at", f"CASE WHEN doc_id % 4 <> 0 THEN {_ago(f'{i} % 20')} END AS last_used_at", f"{_ago(f'{i} % 180')} AS valid_from",
        f"CASE WHEN doc_id % 7 = 0 THEN {_ago(f'least({i} % 30, {i} % 180)')} END AS valid_to", f"CASE WHEN doc_id % 11 = 0 THEN {_ago('1')} END AS archived_at",
        "coalesce(source, 'local') AS user_id", f"element_at(array({', '.join(map(repr, VISIBILITY))}), cast(doc_id % 4 AS int) + 1) AS visibility", "lang", "source",
    )


_M = f"""WITH memories AS (
  SELECT doc_id AS id, text AS content, ([{', '.join(map(repr, TYPES))}])[doc_id % 9 + 1] AS type, (1 + doc_id % 5)::INT AS importance, (doc_id % 10) / 10.0::DOUBLE AS confidence, (doc_id % 8)::INT AS usage_count,
    (doc_id % 3) / 2.0::DOUBLE AS user_signal, 1.0::DOUBLE + doc_id % 4 AS strength, TIMESTAMP '{NOW}' - to_days((doc_id % 180)::INT) AS created_at,
    CASE WHEN doc_id % 4 <> 0 THEN TIMESTAMP '{NOW}' - to_days((doc_id % 20)::INT) END AS last_used_at, TIMESTAMP '{NOW}' - to_days((doc_id % 180)::INT) AS valid_from,
    CASE WHEN doc_id % 7 = 0 THEN TIMESTAMP '{NOW}' - to_days(least(doc_id % 30, doc_id % 180)::INT) END AS valid_to, CASE WHEN doc_id % 11 = 0 THEN TIMESTAMP '{NOW}' - to_days(1) END AS archived_at,
    coalesce(source, 'local') AS user_id, ([{', '.join(map(repr, VISIBILITY))}])[doc_id % 4 + 1] AS visibility, lang, source
  FROM documents)
"""
_DAYS = "(epoch_us({0}) - epoch_us({1})) / 86400000000.0::DOUBLE"
_AGE = _DAYS.format(f"TIMESTAMP '{NOW}'", "created_at")
_ROUND = "floor(({0}) * 10000 + 0.5) / 10000.0::DOUBLE"


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_FRESH = "CASE WHEN {0} IS NULL OR {0} >= TIMESTAMP '" + NOW + "' THEN 1.0::DOUBLE ELSE greatest(0.01::DOUBLE, least(1.0::DOUBLE, exp(-" + _DAYS.format(f"TIMESTAMP '{NOW}'", "{0}") + " * 24 / (greatest(1.0, {1}) * 24)))) END"
_SCORE = "0.35::DOUBLE * greatest(0.0, least(1.0, (importance - 1) / 4.0::DOUBLE)) + 0.20::DOUBLE * confidence + 0.15::DOUBLE * ({0}) + 0.15::DOUBLE * CASE WHEN usage_count > 0 THEN 1 - 1 / (1 + usage_count / 5.0::DOUBLE) ELSE 0.0 END + 0.15::DOUBLE * user_signal"


def score(strength):
    last = F.coalesce("last_used_at", "created_at")
    return S.composite(F.col("importance"), F.col("confidence"), S.recency(last, strength, now()), F.col("usage_count"), F.col("user_signal"))


_LAST = "coalesce(last_used_at, created_at)"


# -- filters --------------------------------------------------------------------
@query("flt_live", _M + f"SELECT id, type FROM memories WHERE archived_at IS NULL AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{NOW}')")
def flt_live(spark, sf_dir):
    return memories(spark, sf_dir, False).where(S.live(F.col("valid_to"), F.col("archived_at"), now())).select("id", "type")


@query("flt_as_of", _M + "SELECT id, type FROM memories WHERE valid_from <= TIMESTAMP '2024-01-20' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-20') AND (archived_at IS NULL OR archived_at > TIMESTAMP '2024-01-20')")
def flt_as_of(spark, sf_dir):
    at = F.lit("2024-01-20").cast("timestamp_ntz")
    return memories(spark, sf_dir, False).where(S.as_of(F.col("valid_from"), F.col("valid_to"), F.col("archived_at"), at)).select("id", "type")


@query("flt_scope", _M + "SELECT id FROM memories WHERE user_id IN ('chat_export', 'local') AND visibility IN ('private', 'org')")
def flt_scope(spark, sf_dir):
    return memories(spark, sf_dir, False).where(F.col("user_id").isin("chat_export", "local") & F.col("visibility").isin("private", "org")).select("id")


@query("flt_acl", _M + """, grants AS (SELECT DISTINCT id FROM memories WHERE id % 13 = 0)
SELECT m.id FROM memories m WHERE user_id = 'run_logs' OR visibility IN ('org', 'public') OR (visibility = 'shared' AND EXISTS (SELECT 1 FROM grants g WHERE g.id = m.id))""")
def flt_acl(spark, sf_dir):
    """What one requester may read: own, public, and shared with a grant. The grants are the memories whose number is divisible by 13."""
    m = memories(spark, sf_dir, False)
    grants = m.where("id % 13 = 0").select("id", F.lit(True).alias("granted")).distinct()
    seen = (F.col("user_id") == "run_logs") | F.col("visibility").isin("org", "public") | ((F.col("visibility") == "shared") & F.coalesce("granted", F.lit(False)))
    return m.join(grants, "id", "left").where(seen).select("id")


@query("flt_substring", "SELECT doc_id FROM documents WHERE contains(lower(text), 'vector index')")
def flt_substring(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains(F.lower("text"), F.lit("vector index"))).select("doc_id")


@query("flt_timeline", "SELECT candidate_id, created_at FROM memory_candidates WHERE created_at BETWEEN TIMESTAMP '2024-06-01' AND TIMESTAMP '2024-12-31'")
def flt_timeline(spark, sf_dir):
    return table(spark, sf_dir, "memory_candidates").where("created_at BETWEEN timestamp_ntz'2024-06-01' AND timestamp_ntz'2024-12-31'").select("candidate_id", "created_at")


@query("flt_json_path", "SELECT row_id, json_extract_string(metadata_json, '$.client') AS client FROM raw_messages WHERE json_valid(metadata_json) AND json_extract_string(metadata_json, '$.client') IN ('desk', 'ide')")
def flt_json_path(spark, sf_dir):
    m = table(spark, sf_dir, "raw_messages").select("row_id", F.get_json_object("metadata_json", "$.client").alias("client"))
    return m.where("client in ('desk', 'ide')")


# -- joins and sets ---------------------------------------------------------------
@query("jn_unextracted", "SELECT c.conversation_id FROM raw_conversations c WHERE NOT EXISTS (SELECT 1 FROM memory_candidates m WHERE m.conversation_id = c.conversation_id)")
def jn_unextracted(spark, sf_dir):
    return table(spark, sf_dir, "raw_conversations").join(table(spark, sf_dir, "memory_candidates"), "conversation_id", "left_anti").select("conversation_id")


@query("jn_provenance", """SELECT c.candidate_id, count(DISTINCT m.row_id) AS n_rows, min(m.row_id) AS first_row FROM (SELECT candidate_id, conversation_id, unnest(source_message_ids) AS external_id FROM memory_candidates) c
JOIN raw_messages m ON m.conversation_id = c.conversation_id AND m.external_id = c.external_id GROUP BY c.candidate_id""")
def jn_provenance(spark, sf_dir):
    c = table(spark, sf_dir, "memory_candidates").select("candidate_id", "conversation_id", F.explode("source_message_ids").alias("external_id"))
    m = table(spark, sf_dir, "raw_messages").select("conversation_id", "external_id", "row_id")
    return c.join(m, ["conversation_id", "external_id"]).groupBy("candidate_id").agg(F.count_distinct("row_id").alias("n_rows"), F.min("row_id").alias("first_row"))


@query("jn_hydrated_links", "SELECT l.link_id, a.model AS model_a, b.model AS model_b FROM memory_links l LEFT JOIN (SELECT memory_id, min(model) AS model FROM memory_embeddings GROUP BY 1) a ON l.source_memory_id = a.memory_id LEFT JOIN (SELECT memory_id, min(model) AS model FROM memory_embeddings GROUP BY 1) b ON l.target_memory_id = b.memory_id")
def jn_hydrated_links(spark, sf_dir):
    e = table(spark, sf_dir, "memory_embeddings").groupBy("memory_id").agg(F.min("model").alias("model"))
    side = lambda s: e.select(F.col("memory_id").alias(s), F.col("model").alias(f"model_{s}"))
    l = table(spark, sf_dir, "memory_links").select("link_id", F.col("source_memory_id").alias("a"), F.col("target_memory_id").alias("b"))
    return l.join(side("a"), "a", "left").join(side("b"), "b", "left").select("link_id", "model_a", "model_b")


_DIFF_A = "SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 3"
_DIFF_B = "SELECT doc_id AS id, CASE WHEN doc_id % 6 = 1 THEN md5(text || '!') ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 7"


@query("jn_snapshot_diff", f"SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ({_DIFF_A}) a FULL JOIN ({_DIFF_B}) b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.h IS DISTINCT FROM b.h")
def jn_snapshot_diff(spark, sf_dir):
    """Changes between two states of the documents: one lacks some rows, the other lacks others and has some texts changed."""
    d = table(spark, sf_dir, "documents")
    a = d.where("doc_id % 10 <> 3").select(F.col("doc_id").alias("a"), F.md5("text").alias("ha"))
    b = d.where("doc_id % 10 <> 7").select(F.col("doc_id").alias("b"), F.when(F.col("doc_id") % 6 == 1, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text")).alias("hb"))
    both = a.join(b, F.col("a") == F.col("b"), "full").where("a is null or b is null or not (ha <=> hb)")
    return both.select(F.coalesce("a", "b").alias("id"), F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("changed").alias("change"))


@query("set_linked_ids", "SELECT source_memory_id AS memory_id FROM memory_links UNION SELECT target_memory_id FROM memory_links UNION SELECT memory_id FROM memory_embeddings")
def set_linked_ids(spark, sf_dir):
    l = table(spark, sf_dir, "memory_links")
    ids = l.select(F.col("source_memory_id").alias("memory_id")).unionAll(l.select("target_memory_id")).unionAll(table(spark, sf_dir, "memory_embeddings").select("memory_id"))
    return ids.distinct()


# -- aggregates --------------------------------------------------------------------
@query("agg_tool_calls", "SELECT type, count(*) AS n, count(*) FILTER (value > 50) AS high, floor(avg(value) * 10000 + 0.5) / 10000.0::DOUBLE AS mean_value, max(value) AS most FROM (SELECT event_type AS type, value FROM events) GROUP BY type")
def agg_tool_calls(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), S.rounded(F.avg("value")).alias("mean_value"), F.max("value").alias("most"))


_STATUS = "(['pending', 'processing', 'done', 'failed'])"


@query("agg_queue", f"SELECT s.status, count(e.event_id) AS n, min(e.ts) FILTER (s.status = 'pending') AS oldest FROM (SELECT unnest{_STATUS} AS status) s LEFT JOIN (SELECT event_id, ts, {_STATUS}[event_id % 5 + 1] AS status FROM events WHERE event_id % 5 < 3) e ON e.status = s.status GROUP BY s.status")
def agg_queue(spark, sf_dir):
    """Counts by status, with zeros, and the oldest pending event."""
    names = spark.range(4).select(F.element_at(F.array(*map(F.lit, ["pending", "processing", "done", "failed"])), (F.col("id") + 1).cast("int")).alias("status"))
    e = table(spark, sf_dir, "events").where("event_id % 5 < 3").select("event_id", "ts", F.element_at(F.array(*map(F.lit, ["pending", "processing", "done", "failed"])), (F.col("event_id") % 5 + 1).cast("int")).alias("status"))
    counts = e.groupBy("status").agg(F.count("*").alias("n"), F.min(F.when(F.col("status") == "pending", F.col("ts"))).alias("oldest"))
    return names.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"), "oldest")


@query("agg_link_stats", "SELECT reason, count(*) AS n, count(DISTINCT source_memory_id) AS sources, count(DISTINCT least(floor(similarity * 10), 9)) FILTER (similarity BETWEEN 0 AND 1) AS buckets FROM memory_links GROUP BY reason")
def agg_link_stats(spark, sf_dir):
    l = table(spark, sf_dir, "memory_links")
    return l.groupBy("reason").agg(F.count("*").alias("n"), F.count_distinct("source_memory_id").alias("sources"), F.count_distinct(F.when(F.col("similarity").between(0, 1), F.least(F.floor(F.col("similarity") * 10), F.lit(9)))).alias("buckets"))


@query("agg_links_p95", "SELECT floor(quantile_cont(n, 0.95) * 10000 + 0.5) / 10000.0::DOUBLE AS p95, max(n) AS most FROM (SELECT source_memory_id, count(*)::DOUBLE AS n FROM memory_links GROUP BY 1)")
def agg_links_p95(spark, sf_dir):
    n = table(spark, sf_dir, "memory_links").groupBy("source_memory_id").agg(F.count("*").cast("double").alias("n"))
    return n.agg(S.rounded(F.percentile("n", 0.95)).alias("p95"), F.max("n").alias("most"))


@query("agg_histogram", _M + f"SELECT type, CASE WHEN {_AGE} < 7 THEN '0-7' WHEN {_AGE} < 30 THEN '7-30' WHEN {_AGE} < 90 THEN '30-90' ELSE '90+' END AS age, CASE WHEN usage_count = 0 THEN '0' WHEN usage_count = 1 THEN '1' WHEN usage_count <= 5 THEN '2-5' ELSE '6+' END AS used, count(*) AS n FROM memories GROUP BY ALL")
def agg_histogram(spark, sf_dir):
    age, u = S.days(now(), F.col("created_at")), F.col("usage_count")
    a = F.when(age < 7, "0-7").when(age < 30, "7-30").when(age < 90, "30-90").otherwise("90+")
    return memories(spark, sf_dir, False).groupBy("type", a.alias("age"), F.when(u == 0, "0").when(u == 1, "1").when(u <= 5, "2-5").otherwise("6+").alias("used")).agg(F.count("*").alias("n"))


@query("agg_stale", _M + f"SELECT type, count(*) AS n, count(*) FILTER (usage_count = 0 AND {_AGE} > 30) AS stale FROM memories GROUP BY type")
def agg_stale(spark, sf_dir):
    return memories(spark, sf_dir, False).groupBy("type").agg(F.count("*").alias("n"), F.count_if((F.col("usage_count") == 0) & (S.days(now(), F.col("created_at")) > 30)).alias("stale"))


@query("agg_idle", "SELECT conversation_id, max(imported_at) AS last_at, count(*) AS n FROM raw_messages WHERE conversation_id IS NOT NULL GROUP BY 1 HAVING max(imported_at) <= TIMESTAMP '2025-06-01' AND count(*) >= 2")
def agg_idle(spark, sf_dir):
    g = table(spark, sf_dir, "raw_messages").where("conversation_id is not null").groupBy("conversation_id").agg(F.max("imported_at").alias("last_at"), F.count("*").alias("n"))
    return g.where("last_at <= timestamp_ntz'2025-06-01' and n >= 2")


@query("agg_entities", "SELECT entity, count(DISTINCT candidate_id) AS n, array_to_string(list_sort(list(DISTINCT type)), ',') AS types FROM (SELECT candidate_id, type, unnest(entities) AS entity FROM memory_candidates) GROUP BY entity HAVING count(DISTINCT candidate_id) >= 2")
def agg_entities(spark, sf_dir):
    e = table(spark, sf_dir, "memory_candidates").select("candidate_id", "type", F.explode("entities").alias("entity"))
    return e.groupBy("entity").agg(F.count_distinct("candidate_id").alias("n"), F.array_join(F.sort_array(F.collect_set("type")), ",").alias("types")).where("n >= 2")


@query("agg_centroid", "SELECT label, pos, floor(avg(x) * 10000 + 0.5) / 10000.0::DOUBLE AS mean FROM (SELECT label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, pos")
def agg_centroid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("label", "pos").agg(S.rounded(F.avg(F.col("x").cast("double"))).alias("mean"))


# -- windows and top -----------------------------------------------------------------
@query("win_best_links", "SELECT link_id, source_memory_id AS src, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_memory_id ORDER BY similarity DESC NULLS LAST, link_id) AS rn FROM memory_links) WHERE rn <= 3")
def win_best_links(spark, sf_dir):
    l = table(spark, sf_dir, "memory_links").withColumnRenamed("source_memory_id", "src")
    return graph.prune(l, 3, "src", [F.desc_nulls_last("similarity"), F.asc("link_id")]).select("link_id", "src", "rn")


@query("win_latest_delivery", "SELECT conversation_id, arg_max(delivery_id, (received_at, delivery_id)) AS delivery_id FROM ingest_events GROUP BY conversation_id")
def win_latest_delivery(spark, sf_dir):
    return table(spark, sf_dir, "ingest_events").groupBy("conversation_id").agg(F.max_by("delivery_id", F.struct("received_at", "delivery_id")).alias("delivery_id"))


@query("win_budget", "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(coalesce(n_chars, 0)) OVER (PARTITION BY source ORDER BY doc_id) AS used FROM documents WHERE source IS NOT NULL) WHERE used <= 4000")
def win_budget(spark, sf_dir):
    """The documents of each source, in order, up to 4000 characters."""
    d = table(spark, sf_dir, "documents").where("source is not null").select("source", "doc_id", F.coalesce("n_chars", F.lit(0)).alias("n"))
    return running_totals(d, ["source"], ["doc_id"], {"used": F.col("n")}, "budget").where("used <= 4000").drop("n")


@query("top_pending", "SELECT candidate_id, importance, confidence, created_at FROM memory_candidates WHERE status = 'pending' ORDER BY importance DESC NULLS LAST, confidence DESC NULLS LAST, created_at, candidate_id LIMIT 50")
def top_pending(spark, sf_dir):
    c = table(spark, sf_dir, "memory_candidates").where("status = 'pending'").select("candidate_id", "importance", "confidence", "created_at")
    return c.orderBy(F.desc_nulls_last("importance"), F.desc_nulls_last("confidence"), "created_at", "candidate_id").limit(50)


@query("top_scores", _M + f"SELECT id, {_ROUND.format(_SCORE.format(_FRESH.format(_LAST, '1.0')))} AS score FROM memories ORDER BY score DESC, id LIMIT 20")
def top_scores(spark, sf_dir):
    return memories(spark, sf_dir, False).select("id", score(F.lit(1.0)).alias("score")).orderBy(F.desc("score"), "id").limit(20)


# -- scores and lifecycle ---------------------------------------------------------------
@query("lif_score", _M + f"SELECT id, {_ROUND.format(_SCORE.format(_FRESH.format(_LAST, 'strength')))} AS score, {_ROUND.format(_SCORE.format(_FRESH.format(_LAST, '1.0')))} AS batch_score FROM memories WHERE archived_at IS NULL")
def lif_score(spark, sf_dir):
    return memories(spark, sf_dir, False).where("archived_at is null").select("id", score(F.col("strength")).alias("score"), score(F.lit(1.0)).alias("batch_score"))


_CHANGE = f"""CASE WHEN valid_to < TIMESTAMP '{NOW}' THEN 'expire' WHEN usage_count >= 5 AND importance < 5 AND {_DAYS.format(f"TIMESTAMP '{NOW}'", 'last_used_at')} BETWEEN 0 AND 7 THEN 'promote'
WHEN usage_count = 0 AND importance > 1 AND {_AGE} > 60 THEN 'demote' END"""


@query("lif_maintenance", _M + f"SELECT id, {_CHANGE} AS change FROM memories WHERE archived_at IS NULL AND {_CHANGE} IS NOT NULL")
def lif_maintenance(spark, sf_dir):
    """What one pass of maintenance does to each active memory: it ends, or its importance goes one up or down."""
    used, born = S.days(now(), F.col("last_used_at")), S.days(now(), F.col("created_at"))
    change = F.when(F.col("valid_to") < now(), "expire").when((F.col("usage_count") >= 5) & (F.col("importance") < 5) & used.between(0, 7), "promote").when((F.col("usage_count") == 0) & (F.col("importance") > 1) & (born > 60), "demote")
    return memories(spark, sf_dir, False).where("archived_at is null").select("id", change.alias("change")).where("change is not null")


_S1 = _ROUND.format(_SCORE.format(_FRESH.format(_LAST, "1.0")))


@query("lif_archive", _M + f"""SELECT id, CASE WHEN usage_count = 0 AND {_AGE} > 90 THEN 'never used' WHEN {_S1} < 0.2 AND {_AGE} > 60 THEN 'low score' END AS reason FROM memories
WHERE archived_at IS NULL AND ((usage_count = 0 AND {_AGE} > 90) OR ({_S1} < 0.2 AND {_AGE} > 60))""")
def lif_archive(spark, sf_dir):
    age = S.days(now(), F.col("created_at"))
    reason = F.when((F.col("usage_count") == 0) & (age > 90), "never used").when((score(F.lit(1.0)) < 0.2) & (age > 60), "low score")
    return memories(spark, sf_dir, False).where("archived_at is null").select("id", reason.alias("reason")).where("reason is not null")


@query("lif_low_tenth", _M + f""", s AS (SELECT id, created_at, {_S1} AS score FROM memories WHERE archived_at IS NULL), t AS (SELECT list_sort(list(score))[floor(0.10 * count(*))::INT + 1] AS cut FROM s)
SELECT id, score FROM s, t WHERE score < cut AND {_AGE} >= 30""")
def lif_low_tenth(spark, sf_dir):
    """Active memories of thirty days or more with a score under the element at a tenth of the sorted scores.

    Scores have four places, so the element is found in their histogram (at most 10,001 rows), not by a sort in one task.
    """
    s = memories(spark, sf_dir, False).where("archived_at is null").select("id", "created_at", score(F.lit(1.0)).alias("score"))
    histogram = s.groupBy("score").agg(F.count("*").alias("n"))
    upto = histogram.withColumn("upto", F.sum("n").over(Window.orderBy("score"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    cut = upto.where(F.col("upto") > F.floor(0.10 * F.col("all"))).agg(F.min("score").alias("cut"))
    return s.crossJoin(F.broadcast(cut)).where((F.col("score") < F.col("cut")) & (S.days(now(), F.col("created_at")) >= 30)).select("id", "score")


# -- duplicates ----------------------------------------------------------------------
@query("ded_exact", "SELECT sha256(text) AS content_hash, min(doc_id) AS kept, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def ded_exact(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.min("doc_id").alias("kept"), F.count("*").alias("n")).where("n > 1")


_CANON = r"lower(regexp_replace(regexp_replace(regexp_replace(coalesce(content, ''), 'https?://[^ \n\t]+', '', 'g'), '[ \n\r\t]+', ' ', 'g'), '^[ .,;:!?]+|[ .,;:!?]+$', '', 'g'))"


@query("ded_canonical", f"SELECT md5(canon) AS h, min(candidate_id) AS leader, count(*) AS n FROM (SELECT candidate_id, {_CANON} AS canon FROM memory_candidates) WHERE canon <> '' GROUP BY 1 HAVING count(*) > 1")
def ded_canonical(spark, sf_dir):
    """Candidates that are equal without links, case, white space and punctuation at the ends."""
    c = F.regexp_replace(F.coalesce("content", F.lit("")), r"https?://[^ \n\t]+", "")
    c = F.lower(F.regexp_replace(F.regexp_replace(c, r"[ \n\r\t]+", " "), r"^[ .,;:!?]+|[ .,;:!?]+$", ""))
    d = table(spark, sf_dir, "memory_candidates").select("candidate_id", c.alias("canon")).where("canon <> ''")
    return d.groupBy(F.md5("canon").alias("h")).agg(F.min("candidate_id").alias("leader"), F.count("*").alias("n")).where("n > 1")


@query("ded_consolidate", f"""SELECT candidate_id, CASE WHEN canon = '' THEN 'IGNORE' WHEN first <> candidate_id AND first_type IS NOT DISTINCT FROM type THEN 'UPDATE' WHEN first <> candidate_id THEN 'MERGE' ELSE 'ADD' END AS action FROM (
SELECT candidate_id, type, canon, first_value(candidate_id) OVER w AS first, first_value(type) OVER w AS first_type FROM (SELECT candidate_id, type, created_at, {_CANON} AS canon FROM memory_candidates) WINDOW w AS (PARTITION BY canon ORDER BY created_at NULLS LAST, candidate_id))""")
def ded_consolidate(spark, sf_dir):
    """The decision on each candidate: the first of its canonical text is added, later ones update it or merge into it if their type differs."""
    c = F.regexp_replace(F.coalesce("content", F.lit("")), r"https?://[^ \n\t]+", "")
    c = F.lower(F.regexp_replace(F.regexp_replace(c, r"[ \n\r\t]+", " "), r"^[ .,;:!?]+|[ .,;:!?]+$", ""))
    d = table(spark, sf_dir, "memory_candidates").select("candidate_id", "type", "created_at", c.alias("canon"))
    lead = d.groupBy("canon").agg(F.min(F.struct(F.col("created_at").isNull().alias("late"), "created_at", "candidate_id", "type")).alias("f"))
    action = F.when(F.col("canon") == "", "IGNORE").when(F.col("f.candidate_id") == F.col("candidate_id"), "ADD").when(F.col("f.type").eqNullSafe(F.col("type")), "UPDATE").otherwise("MERGE")
    return d.join(lead, "canon").select("candidate_id", action.alias("action"))


# -- graph -----------------------------------------------------------------------------
_EDGES = """e0 AS (SELECT source_memory_id AS s, target_memory_id AS d, similarity AS w FROM memory_links WHERE similarity > 0 AND similarity <= 1 AND source_memory_id <> target_memory_id),
edges AS (SELECT src, dst, max(w) AS w FROM (SELECT s AS src, d AS dst, w FROM e0 UNION ALL SELECT d, s, w FROM e0) GROUP BY 1, 2)"""


def _edges(spark, sf_dir):
    return graph.symmetric(table(spark, sf_dir, "memory_links").where("similarity > 0 and similarity <= 1").select(F.col("source_memory_id").alias("src"), F.col("target_memory_id").alias("dst"), F.col("similarity").alias("w")))


@query("gra_edges", f"WITH {_EDGES} SELECT src, count(*) AS degree, floor(max(w) * 10000 + 0.5) / 10000.0::DOUBLE AS strongest FROM edges GROUP BY src")
def gra_edges(spark, sf_dir):
    return _edges(spark, sf_dir).groupBy("src").agg(F.count("*").alias("degree"), S.rounded(F.max("w")).alias("strongest"))


@query("gra_cooccurrence", """WITH m AS (SELECT DISTINCT candidate_id AS g, unnest(entities) AS e FROM memory_candidates)
SELECT x.e AS a, y.e AS b, count(*) AS n, floor(least(0.95, 0.4 + 0.05 * count(*)) * 100 + 0.5) / 100::DOUBLE AS confidence FROM m x JOIN m y ON x.g = y.g AND x.e < y.e GROUP BY 1, 2 HAVING count(*) >= 2""")
def gra_cooccurrence(spark, sf_dir):
    m = table(spark, sf_dir, "memory_candidates").select("candidate_id", F.explode("entities").alias("entity"))
    return graph.cooccurrence(m, "candidate_id", "entity")


_50TH = "try_cast('0x' || right({0}, 4) AS INT) % 50 = 0"


@query("gra_neighbours", f"""WITH {_EDGES}, start AS (SELECT DISTINCT src AS node FROM edges WHERE {_50TH.format('src')}), one AS (SELECT DISTINCT node AS start, dst AS node FROM start JOIN edges ON src = node),
two AS (SELECT DISTINCT o.start, e.dst AS node FROM one o JOIN edges e ON e.src = o.node WHERE e.dst <> o.start AND (o.start, e.dst) NOT IN (SELECT (start, node) FROM one)) SELECT start, node, 1 AS hops FROM one UNION ALL SELECT start, node, 2 FROM two""")
def gra_neighbours(spark, sf_dir):
    """What is reachable in two steps from the memories of the stated set."""
    e = _edges(spark, sf_dir)
    return graph.neighbours(e, e.where(every_50th(F.col("src"))).select(F.col("src").alias("node")).distinct(), 2)


def _pagerank_sql(rounds):
    steps = "".join(
        f""", m{k} AS (SELECT node, sum(r) AS r FROM (SELECT t.dst AS node, 0.5 * m.r * t.p AS r FROM {'seeds' if k == 1 else f'm{k - 1}'} m JOIN t ON t.src = m.node UNION ALL
  SELECT s.node, s.r * (0.5 + 0.5 * (SELECT coalesce(sum(r), 0) FROM {'seeds' if k == 1 else f'm{k - 1}'} x WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.src = x.node))) FROM seeds s) GROUP BY node)"""
        for k in range(1, rounds + 1)
    )
    return f"WITH {_EDGES}, t AS MATERIALIZED (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM edges), seeds AS (SELECT src AS node, 1.0::DOUBLE / count(*) OVER () AS r FROM (SELECT DISTINCT src FROM edges WHERE {_50TH.format('src')})){steps.replace(' AS (SELECT node, sum', ' AS MATERIALIZED (SELECT node, sum')} SELECT node, floor(r * 1e6 + 0.5) / 1e6::DOUBLE AS rank FROM m{rounds} WHERE r >= 1e-5"


@query("gra_pagerank", _pagerank_sql(8))
def gra_pagerank(spark, sf_dir):
    """Personalised PageRank from the memories of the stated set, all alike, eight rounds."""
    e = _edges(spark, sf_dir)
    starts = e.where(every_50th(F.col("src"))).select(F.col("src").alias("node")).distinct()
    seeds = starts.crossJoin(F.broadcast(starts.agg((1.0 / F.count("*")).alias("p"))))  # one row
    return graph.pagerank(e, seeds, 8).where("rank >= 1e-5").select("node", (F.floor(F.col("rank") * 1e6 + 0.5) / 1e6).alias("rank"))


# -- retrieval ----------------------------------------------------------------------------
_ASK = f"SELECT conversation_id AS query_id, title AS query FROM raw_conversations WHERE title IS NOT NULL AND {_50TH.format('conversation_id')}"


def bm25_sql(asked, p="", keep="true"):
    """The common table expressions of one BM25 search by the queries of ``asked``: {p}asked to {p}bm (query_id, id, score, rank); ``keep`` is a condition on id."""
    idf = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
    return f"""{p}asked AS ({asked}), {p}w AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL), {p}d AS (SELECT id, w, len(w) AS len FROM {p}w WHERE len(w) > 0),
{p}st AS (SELECT count(*) AS n, avg(len) AS mean_len FROM {p}d), {p}tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len, unnest(w) AS term FROM {p}d) GROUP BY ALL), {p}df AS (SELECT term, count(*) AS df FROM {p}tf GROUP BY 1),
{p}q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {p}asked) GROUP BY ALL),
{p}sc AS (SELECT query_id, id, floor(sum(times * CASE WHEN {idf} > 0 THEN {idf} ELSE 1e-6 END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25 + 0.75::DOUBLE * len / mean_len))) * 1e6 + 0.5) / 1e6::DOUBLE AS score FROM {p}tf JOIN {p}df USING (term) JOIN {p}q USING (term), {p}st WHERE {keep} GROUP BY 1, 2),
{p}bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {p}sc)"""


_BM25 = bm25_sql(_ASK)


def _asked(spark, sf_dir):
    """Queries: the titles of the conversations of the stated set."""
    c = table(spark, sf_dir, "raw_conversations").where(F.col("title").isNotNull() & every_50th(F.col("conversation_id")))
    return c.select(F.col("conversation_id").alias("query_id"), F.col("title").alias("query"))


@query("ret_bm25", f"WITH {_BM25} SELECT query_id, id, score, rank FROM bm WHERE rank <= 10")
def ret_bm25(spark, sf_dir):
    return retrieval.bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 10)


@query("ret_dense", """WITH v AS (SELECT vec_id AS id, embedding AS e FROM embeddings), s AS (SELECT q.id AS query_id, v.id, floor(list_cosine_similarity(q.e::DOUBLE[], v.e::DOUBLE[]) * 1e6 + 0.5) / 1e6::DOUBLE AS score FROM v q JOIN v ON q.id <> v.id WHERE q.id % 50 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def ret_dense(spark, sf_dir):
    """Ten nearest vectors of every vector whose number is divisible by 50."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return retrieval.dense(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), 10)


@query("ret_context", f"""WITH {_BM25}, c AS (SELECT b.query_id, b.id, b.rank, sum(coalesce(n_chars, 0)) OVER (PARTITION BY b.query_id ORDER BY b.rank) AS used FROM bm b JOIN documents d ON d.doc_id = b.id WHERE b.rank <= 15)
SELECT query_id, id, rank, used FROM c WHERE used <= 4000""")
def ret_context(spark, sf_dir):
    """The context of each query: its best documents in order, up to 4000 characters."""
    best = retrieval.bm25(table(spark, sf_dir, "documents"), _asked(spark, sf_dir), 15)
    sizes = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("n_chars", F.lit(0)).alias("n"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return best.join(sizes, "id").withColumn("used", F.sum("n").over(w)).where("used <= 4000").select("query_id", "id", "rank", "used")


# -- summaries -------------------------------------------------------------------------------
@query("rap_levels", "SELECT scope_kind, level, count(DISTINCT id) AS nodes, count(DISTINCT parent_id) AS parents FROM summary_nodes GROUP BY 1, 2")
def rap_levels(spark, sf_dir):
    return table(spark, sf_dir, "summary_nodes").groupBy("scope_kind", "level").agg(F.count_distinct("id").alias("nodes"), F.count_distinct("parent_id").alias("parents"))


# -- sources ---------------------------------------------------------------------------------
@query("src_roles", "SELECT r AS role, count(*) AS n FROM (SELECT CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE lower(trim(role)) END AS r FROM raw_messages) GROUP BY 1")
def src_roles(spark, sf_dir):
    r = F.lower(F.trim("role"))
    return table(spark, sf_dir, "raw_messages").groupBy(F.when(r == "human", "user").when(r.isin("ai", "bot"), "assistant").otherwise(r).alias("role")).agg(F.count("*").alias("n"))


@query("src_export_messages", "SELECT uuid, len(chat_messages) AS n, (SELECT count(*) FROM (SELECT unnest(chat_messages) AS m) WHERE m.text IS NULL AND len(m.content) > 0) AS from_blocks FROM export_conversations WHERE chat_messages IS NOT NULL")
def src_export_messages(spark, sf_dir):
    """Messages of each export, and how many have their text in content blocks only."""
    e = table(spark, sf_dir, "export_conversations").where("chat_messages is not null")
    blocks = F.size(F.filter("chat_messages", lambda m: m["text"].isNull() & (F.coalesce(F.size(m["content"]), F.lit(0)) > 0)))
    return e.select("uuid", F.size("chat_messages").cast("bigint").alias("n"), blocks.cast("bigint").alias("from_blocks"))


@query("snk_candidate_keys", "SELECT sha256(type || '|' || lower(regexp_replace(content, '^[ ]+|[ ]+$', '', 'g'))) AS key, min(candidate_id) AS candidate_id, max(confidence) AS confidence FROM memory_candidates WHERE content IS NOT NULL AND type IS NOT NULL GROUP BY 1")
def snk_candidate_keys(spark, sf_dir):
    """Insert or ignore by a content key, with the largest confidence kept."""
    c = table(spark, sf_dir, "memory_candidates").where("content is not null and type is not null")
    return c.groupBy(F.sha2(F.concat("type", F.lit("|"), F.lower(F.regexp_replace("content", "^[ ]+|[ ]+$", ""))), 256).alias("key")).agg(F.min("candidate_id").alias("candidate_id"), F.max("confidence").alias("confidence"))
