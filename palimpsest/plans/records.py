"""Queries over records: pages and samples, counts, the event queue, imports, patches, shares, decisions on candidates, tool calls, trees of summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators import graph, hierarchy
from palimpsest.plans import memory, texts
from palimpsest.plans.graphs import _TYPED, strongest, typed
from palimpsest.plans.memory import _M, _S1, NOW, now
from palimpsest.plans.problems import _TREE
from palimpsest.sources import transcripts
from palimpsest.util import new_path, running_totals, table

QUERIES, SQL = {}, {}


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


# -- pages, samples, ends ------------------------------------------------------------------
@query("top_page", f"{_M}, s AS (SELECT id, {_S1} AS score, count(*) OVER () AS total FROM memories WHERE archived_at IS NULL) SELECT id, score, total, ceil(total / 25.0)::BIGINT AS pages FROM s ORDER BY score DESC, id LIMIT 25 OFFSET 50")
def top_page(spark, sf_dir):
    """The third page of 25 of the active memories by score, with the number of rows and pages."""
    s = memory.memories(spark, sf_dir, False).where("archived_at is null").select("id", memory.score(F.lit(1.0)).alias("score"))
    total = s.agg(F.count("*").alias("total"))
    return s.orderBy(F.desc("score"), "id").offset(50).limit(25).crossJoin(F.broadcast(total)).withColumn("pages", F.ceil(F.col("total") / 25))  # one row


@query("top_ends", f"{_M}, s AS (SELECT id, {_S1} AS score FROM memories WHERE archived_at IS NULL) SELECT 'best' AS part, * FROM (SELECT * FROM s ORDER BY score DESC, id LIMIT 20) UNION ALL SELECT 'worst', * FROM (SELECT * FROM s ORDER BY score, id LIMIT 20)")
def top_ends(spark, sf_dir):
    """The twenty best and the twenty worst active memories."""
    s = memory.memories(spark, sf_dir, False).where("archived_at is null").select("id", memory.score(F.lit(1.0)).alias("score"))
    end = lambda part, order: s.orderBy(order, "id").limit(20).select(F.lit(part).alias("part"), "id", "score")
    return end("best", F.desc("score")).unionAll(end("worst", F.asc("score")))


@query("top_audit", f"{_M} SELECT id, {_S1} AS score, created_at FROM memories WHERE archived_at IS NULL ORDER BY score, created_at, id LIMIT 50")
def top_audit(spark, sf_dir):
    """The memories that an audit looks at first: lowest score, then oldest."""
    return memory.memories(spark, sf_dir, False).where("archived_at is null").select("id", memory.score(F.lit(1.0)).alias("score"), "created_at").orderBy("score", "created_at", "id").limit(50)


@query("top_sample", "SELECT candidate_id FROM memory_candidates WHERE status = 'rejected' ORDER BY md5('7' || candidate_id), candidate_id LIMIT 30")
def top_sample(spark, sf_dir):
    """Thirty rejected candidates drawn by a seeded hash, the same in every run."""
    return table(spark, sf_dir, "memory_candidates").where("status = 'rejected'").select("candidate_id").orderBy(F.md5(F.concat(F.lit("7"), F.col("candidate_id"))), "candidate_id").limit(30)


# -- counts ---------------------------------------------------------------------------------
@query("agg_dashboard", "SELECT source_kind, json_extract_string(metadata_json, '$.client') AS client, count(*) AS n, count(DISTINCT conversation_id) AS conversations FROM raw_messages GROUP BY 1, 2")
def agg_dashboard(spark, sf_dir):
    m = table(spark, sf_dir, "raw_messages")
    return m.groupBy("source_kind", F.get_json_object("metadata_json", "$.client").alias("client")).agg(F.count("*").alias("n"), F.count_distinct("conversation_id").alias("conversations"))


@query("agg_activity", "SELECT c.source_kind, greatest(max(m.last_at), max(e.last_at)) AS last_at FROM raw_conversations c LEFT JOIN (SELECT conversation_id, max(imported_at) AS last_at FROM raw_messages GROUP BY 1) m USING (conversation_id) LEFT JOIN (SELECT conversation_id, max(received_at) AS last_at FROM ingest_events GROUP BY 1) e USING (conversation_id) GROUP BY 1")
def agg_activity(spark, sf_dir):
    """When anything happened last, by kind of source."""
    last = lambda name, c: table(spark, sf_dir, name).groupBy("conversation_id").agg(F.max(c).alias(f"{name}_at"))
    both = table(spark, sf_dir, "raw_conversations").join(last("raw_messages", "imported_at"), "conversation_id", "left").join(last("ingest_events", "received_at"), "conversation_id", "left")
    return both.groupBy("source_kind").agg(F.greatest(F.max("raw_messages_at"), F.max("ingest_events_at")).alias("last_at"))


@query("agg_nearest_rank", "WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, p, max(value) AS value FROM v, (SELECT unnest([50, 95, 99]) AS p) WHERE rn = greatest(1, ceil(p * n / 100.0)) GROUP BY 1, 2")
def agg_nearest_rank(spark, sf_dir):
    """Percentiles by the nearest rank: elements of the data, not means of two. Ranks are running counts over range partitions."""
    v = table(spark, sf_dir, "events").where("value is not null").select("event_type", "value", "event_id")
    ranked = running_totals(v, ["event_type"], ["value", "event_id"], {"rn": F.lit(1)}, "ranks")
    n = v.groupBy("event_type").agg(F.count("*").alias("n")).withColumn("p", F.explode(F.array(F.lit(50), F.lit(95), F.lit(99))))
    at = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") / 100))
    return ranked.join(n, "event_type").where(F.col("rn") == at).select("event_type", "p", "value")


@query("agg_confusion", "WITH c AS (SELECT importance >= 3 AS said, status = 'accepted' AS truth FROM memory_candidates WHERE importance IS NOT NULL AND status IN ('accepted', 'rejected')) SELECT count(*) AS n, floor(avg((said = truth)::INT) * 1e6 + 0.5) / 1e6::DOUBLE AS accuracy, count(*) FILTER (said AND NOT truth) AS false_positives, count(*) FILTER (NOT said AND truth) AS false_negatives FROM c")
def agg_confusion(spark, sf_dir):
    """How well importance foretells what was accepted."""
    c = table(spark, sf_dir, "memory_candidates").where("importance is not null and status in ('accepted', 'rejected')").select((F.col("importance") >= 3).alias("said"), (F.col("status") == "accepted").alias("truth"))
    return c.agg(F.count("*").alias("n"), S.rounded(F.avg((F.col("said") == F.col("truth")).cast("int")), 6).alias("accuracy"), F.count_if(F.expr("said and not truth")).alias("false_positives"), F.count_if(F.expr("not said and truth")).alias("false_negatives"))


_BLOCKS = "SELECT uuid, m.uuid AS message_id, b.type AS type, b.name AS name, b.text AS text FROM (SELECT uuid, unnest(chat_messages) AS m FROM export_conversations), unnest(m.content) AS u(b)"


@query("agg_tools", f"WITH b AS ({_BLOCKS}) SELECT name, count(*) AS calls, count(DISTINCT uuid) AS conversations, count(DISTINCT message_id) AS messages FROM b WHERE type = 'tool_use' AND name IS NOT NULL GROUP BY 1")
def agg_tools(spark, sf_dir):
    """Calls of each tool in the account exports."""
    m = table(spark, sf_dir, "export_conversations").select("uuid", F.explode("chat_messages").alias("m"))
    b = m.select("uuid", F.col("m.uuid").alias("message_id"), F.explode("m.content").alias("b")).where("b.type = 'tool_use' and b.name is not null")
    return b.groupBy(F.col("b.name").alias("name")).agg(F.count("*").alias("calls"), F.count_distinct("uuid").alias("conversations"), F.count_distinct("message_id").alias("messages"))


_FLAT = "CASE WHEN b.type = 'tool_use' THEN '[tool_use: ' || coalesce(b.name, '?') || ']' WHEN b.text IS NULL THEN NULL WHEN length(b.text) > 500 THEN left(b.text, 500) || '…' ELSE b.text END"


@query("src_flattened", f"SELECT uuid, m.uuid AS message_id, nullif(array_to_string(list_filter(list_transform(m.content, lambda b: {_FLAT}), lambda x: x IS NOT NULL), chr(10)), '') AS content FROM (SELECT uuid, unnest(chat_messages) AS m FROM export_conversations)")
def src_flattened(spark, sf_dir):
    """The blocks of each exported message as one text: calls of tools by name, long texts cut."""
    m = table(spark, sf_dir, "export_conversations").select("uuid", F.explode("chat_messages").alias("m"))
    cut = lambda t: F.when(F.length(t) > 500, F.concat(F.left(t, F.lit(500)), F.lit("…"))).otherwise(t)
    flat = lambda b: F.when(b["type"] == "tool_use", F.concat(F.lit("[tool_use: "), F.coalesce(b["name"], F.lit("?")), F.lit("]"))).otherwise(cut(b["text"]))
    content = F.array_join(F.filter(F.transform("m.content", flat), lambda x: x.isNotNull()), "\n")
    return m.select("uuid", F.col("m.uuid").alias("message_id"), F.when(content != "", content).alias("content"))


_ROLE = "CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE lower(trim(role)) END"


@query("jn_tool_results", f"""WITH m AS (SELECT conversation_id, ordinal, row_id, {_ROLE} AS r FROM raw_messages WHERE conversation_id IS NOT NULL AND ordinal IS NOT NULL), held AS (SELECT conversation_id, ordinal, max(row_id) AS row_id, max_by(r, row_id) AS r FROM m GROUP BY 1, 2)
SELECT t.row_id AS result_row, a.row_id AS call_row FROM held t LEFT JOIN held a ON a.conversation_id = t.conversation_id AND a.ordinal = t.ordinal - 1 AND a.r = 'assistant' WHERE t.r = 'tool'""")
def jn_tool_results(spark, sf_dir):
    """Results of tools with the assistant's message just before them, if there is one; of rows with one ordinal the last counts."""
    m = table(spark, sf_dir, "raw_messages").where("conversation_id is not null and ordinal is not null").select("conversation_id", "ordinal", "row_id", transcripts.role(F.col("role")).alias("r"))
    held = m.groupBy("conversation_id", "ordinal").agg(F.max(F.struct("row_id", "r")).alias("x")).select("conversation_id", "ordinal", "x.row_id", "x.r")
    calls = held.where("r = 'assistant'").select("conversation_id", (F.col("ordinal") + 1).alias("ordinal"), F.col("row_id").alias("call_row"))
    return held.where("r = 'tool'").select("conversation_id", "ordinal", F.col("row_id").alias("result_row")).join(calls, ["conversation_id", "ordinal"], "left").select("result_row", "call_row")


# -- the event queue ---------------------------------------------------------------------------
_QUEUE = "q AS (SELECT delivery_id, type, received_at, CASE WHEN delivery_id % 7 = 0 THEN 'failed' WHEN delivery_id % 7 = 1 THEN 'done' ELSE 'pending' END AS status FROM ingest_events)"


def queue(spark, sf_dir):
    """The deliveries as a queue of events; their status by arithmetic on their number."""
    n = F.col("delivery_id") % 7
    return table(spark, sf_dir, "ingest_events").select("delivery_id", "type", "received_at", F.when(n == 0, "failed").when(n == 1, "done").otherwise("pending").alias("status"))


@query("str_dispatch", f"WITH {_QUEUE} SELECT delivery_id, CASE WHEN type = 'chat_message' AND delivery_id % 50 = 3 THEN 'failed' ELSE 'done' END AS status, CASE type WHEN 'chat_message' THEN 'ingest' WHEN 'domain_event' THEN 'record' ELSE 'none' END AS handler FROM q WHERE status = 'pending'")
def str_dispatch(spark, sf_dir):
    """What one pass over the pending events does: each goes to the handler of its type; unknown types are done; one that fails doesn't stop the rest."""
    handler = F.when(F.col("type") == "chat_message", "ingest").when(F.col("type") == "domain_event", "record").otherwise("none")
    status = F.when((F.col("type") == "chat_message") & (F.col("delivery_id") % 50 == 3), "failed").otherwise("done")
    return queue(spark, sf_dir).where("status = 'pending'").select("delivery_id", status.alias("status"), handler.alias("handler"))


@query("str_requeue", f"WITH {_QUEUE} SELECT delivery_id, CASE WHEN status = 'failed' AND received_at <= TIMESTAMP '2025-06-01' THEN 'pending' ELSE status END AS status FROM q")
def str_requeue(spark, sf_dir):
    """The queue after old failures were put back."""
    again = (F.col("status") == "failed") & (F.col("received_at") <= F.lit("2025-06-01").cast("timestamp_ntz"))
    return queue(spark, sf_dir).select("delivery_id", F.when(again, "pending").otherwise(F.col("status")).alias("status"))


@query("str_newest", f"WITH {_QUEUE} SELECT delivery_id, type, status FROM q WHERE status = 'failed' ORDER BY received_at DESC NULLS LAST, delivery_id DESC LIMIT 40")
def str_newest(spark, sf_dir):
    return queue(spark, sf_dir).where("status = 'failed'").orderBy(F.desc_nulls_last("received_at"), F.desc("delivery_id")).limit(40).select("delivery_id", "type", "status")


@query("str_idle", "WITH m AS (SELECT conversation_id, max(imported_at) AS last_at, count(*) AS n FROM raw_messages WHERE conversation_id IS NOT NULL GROUP BY 1), s AS (SELECT scope_id AS conversation_id, max(created_at) AS summed_at FROM summary_nodes WHERE scope_kind = 'conversation' GROUP BY 1) SELECT m.conversation_id, n FROM m LEFT JOIN s USING (conversation_id) WHERE n >= 3 AND last_at <= TIMESTAMP '2025-12-01' AND (summed_at IS NULL OR summed_at < last_at)")
def str_idle(spark, sf_dir):
    """Conversations that have been quiet and have no summary of what was said last."""
    m = table(spark, sf_dir, "raw_messages").where("conversation_id is not null").groupBy("conversation_id").agg(F.max("imported_at").alias("last_at"), F.count("*").alias("n"))
    s = table(spark, sf_dir, "summary_nodes").where("scope_kind = 'conversation'").groupBy(F.col("scope_id").alias("conversation_id")).agg(F.max("created_at").alias("summed_at"))
    return m.join(s, "conversation_id", "left").where("n >= 3 and last_at <= timestamp_ntz'2025-12-01' and (summed_at is null or summed_at < last_at)").select("conversation_id", "n")


# -- imports, patches, shares --------------------------------------------------------------------
@query("snk_delta", "SELECT conversation_id, count(*) AS added, max(ordinal) AS last_ordinal FROM raw_messages n WHERE conversation_id IS NOT NULL AND row_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM raw_messages o WHERE o.row_id % 2 = 0 AND o.conversation_id = n.conversation_id AND o.external_id = n.external_id) GROUP BY 1")
def snk_delta(spark, sf_dir):
    """What an import of the rows with odd numbers adds to the others, by conversation; conversations without news make no event."""
    m = table(spark, sf_dir, "raw_messages").select("conversation_id", "external_id", "row_id", "ordinal")
    new = m.where("conversation_id is not null and row_id % 2 = 1").join(m.where("row_id % 2 = 0").select("conversation_id", "external_id"), ["conversation_id", "external_id"], "left_anti")
    return new.groupBy("conversation_id").agg(F.count("*").alias("added"), F.max("ordinal").alias("last_ordinal"))


@query("snk_patch", "SELECT row_id, list_sort(list_distinct(list_concat(coalesce(json_keys(metadata_json), []), ['seen', 'origin']))) AS keys, coalesce(json_extract_string(metadata_json, '$.client'), '') AS client FROM raw_messages WHERE metadata_json IS NOT NULL AND json_valid(metadata_json)")
def snk_patch(spark, sf_dir):
    """Metadata with two keys set; what was there stays."""
    m = table(spark, sf_dir, "raw_messages").where("metadata_json is not null").select("row_id", F.from_json("metadata_json", "map<string,string>").alias("old")).where("old is not null")
    patched = F.map_zip_with(F.create_map(F.lit("seen"), F.lit("1"), F.lit("origin"), F.lit("import")), "old", lambda k, a, b: F.coalesce(b, a))
    return m.select("row_id", F.sort_array(F.map_keys(patched)).alias("keys"), F.coalesce(F.try_element_at(patched, F.lit("client")), F.lit("")).alias("client"))


@query("snk_deleted", "SELECT link_id FROM memory_links WHERE source_memory_id NOT IN (SELECT memory_id FROM memory_embeddings WHERE dim <> 64 AND memory_id IS NOT NULL) AND target_memory_id NOT IN (SELECT memory_id FROM memory_embeddings WHERE dim <> 64 AND memory_id IS NOT NULL)")
def snk_deleted(spark, sf_dir):
    """The links that stay when the memories whose stated length isn't 64 are deleted."""
    gone = table(spark, sf_dir, "memory_embeddings").where("dim <> 64 and memory_id is not null").select("memory_id").distinct()
    l = table(spark, sf_dir, "memory_links").where("source_memory_id is not null and target_memory_id is not null")
    return l.join(gone, F.col("source_memory_id") == F.col("memory_id"), "left_anti").join(gone, F.col("target_memory_id") == F.col("memory_id"), "left_anti").select("link_id")


@query("prv_shares", f"{_M}, s AS (SELECT id, 'user_' || lpad((id % 5)::VARCHAR, 4, '0') AS grantee, CASE WHEN id % 6 = 0 THEN 'revoked' ELSE 'read' END AS access FROM memories WHERE visibility = 'shared') SELECT grantee, count(*) FILTER (access = 'read') AS readable, count(*) AS offers FROM s GROUP BY 1")
def prv_shares(spark, sf_dir):
    """Shares by whom they were made for, and how many were not taken back."""
    s = memory.memories(spark, sf_dir, False).where("visibility = 'shared'").select(F.concat(F.lit("user_"), F.lpad((F.col("id") % 5).cast("string"), 4, "0")).alias("grantee"), (F.col("id") % 6 != 0).alias("open"))
    return s.groupBy("grantee").agg(F.count_if("open").alias("readable"), F.count("*").alias("offers"))


@query("lif_forget", f"{_M} SELECT id, coalesce(archived_at, TIMESTAMP '{NOW}') AS archived_at FROM memories WHERE id % 17 = 0")
def lif_forget(spark, sf_dir):
    """Memories put away by their owner; the first time of it stays."""
    return memory.memories(spark, sf_dir, False).where("id % 17 = 0").select("id", F.coalesce("archived_at", now()).alias("archived_at"))


# -- decisions on candidates -----------------------------------------------------------------------
_DECIDED = f"""{_TYPED}, c AS (SELECT candidate_id, type, content, created_at, promoted_memory_id, {memory._CANON} AS canon, {texts.NOISE_SQL.format('content')} AS noise FROM memory_candidates),
lead AS (SELECT canon, min_by(candidate_id, (created_at, candidate_id)) AS leader, min_by(type, (created_at, candidate_id)) AS leader_type FROM c WHERE canon <> '' AND noise IS NULL AND created_at IS NOT NULL GROUP BY 1),
like_ AS (SELECT id, max_by(other, (similarity, other)) AS other, max(similarity) AS similarity FROM (SELECT a AS id, b AS other, similarity FROM strong UNION ALL SELECT b, a, similarity FROM strong) GROUP BY 1),
d AS (SELECT c.candidate_id, l.leader, CASE WHEN canon = '' THEN 'IGNORE' WHEN noise IS NOT NULL THEN 'REJECT' WHEN l.leader <> c.candidate_id AND l.leader_type IS NOT DISTINCT FROM c.type THEN 'UPDATE' WHEN l.leader <> c.candidate_id THEN 'MERGE'
WHEN k.similarity >= 0.85 AND t.created_at < c.created_at AND t.type = c.type THEN 'MERGE' WHEN k.similarity >= 0.85 AND t.created_at < c.created_at THEN 'CONTRADICTION' ELSE 'ADD' END AS action
FROM c LEFT JOIN lead l USING (canon) LEFT JOIN like_ k ON k.id = c.promoted_memory_id LEFT JOIN typed t ON t.id = k.other)"""


def decided(spark, sf_dir):
    """candidate_id, leader, action: nothing to say, noise, said before (of the same or of another type), much like an older memory (of the same or of another type), or new."""
    c = F.regexp_replace(F.coalesce("content", F.lit("")), r"https?://[^ \n\t]+", "")
    canon = F.lower(F.regexp_replace(F.regexp_replace(c, r"[ \n\r\t]+", " "), r"^[ .,;:!?]+|[ .,;:!?]+$", ""))
    rows = table(spark, sf_dir, "memory_candidates").select("candidate_id", "type", "created_at", "promoted_memory_id", canon.alias("canon"), texts.noise(F.col("content")).alias("noise"))
    # Empty texts have no leader, so they are no hot key.
    lead = rows.where("canon <> '' and noise is null and created_at is not null").groupBy("canon").agg(F.min(F.struct("created_at", "candidate_id", "type")).alias("f")).select(F.col("canon").alias("said"), F.col("f.candidate_id").alias("leader"), F.col("f.type").alias("leader_type"))
    s = strongest(spark, sf_dir)
    both = s.select(F.col("a").alias("id"), F.col("b").alias("other"), "similarity").unionAll(s.select(F.col("b").alias("id"), F.col("a").alias("other"), "similarity"))
    like = both.groupBy("id").agg(F.max_by("other", F.struct("similarity", "other")).alias("other"), F.max("similarity").alias("similarity"))
    old = typed(spark, sf_dir).select(F.col("id").alias("other"), F.col("type").alias("old_type"), F.col("created_at").alias("old_at"))
    j = rows.join(lead, (F.col("canon") == F.col("said")) & (F.col("canon") != ""), "left").join(like, F.col("promoted_memory_id") == F.col("id"), "left").join(old, "other", "left")
    before = (F.col("similarity") >= 0.85) & (F.col("old_at") < F.col("created_at"))
    action = (
        F.when(F.col("canon") == "", "IGNORE").when(F.col("noise").isNotNull(), "REJECT").when((F.col("leader") != F.col("candidate_id")) & F.col("leader_type").eqNullSafe(F.col("type")), "UPDATE").when(F.col("leader") != F.col("candidate_id"), "MERGE")
        .when(before & (F.col("old_type") == F.col("type")), "MERGE").when(before, "CONTRADICTION").otherwise("ADD")
    )
    return j.select("candidate_id", "leader", action.alias("action"))


@query("ded_decisions", f"WITH {_DECIDED} SELECT candidate_id, action FROM d")
def ded_decisions(spark, sf_dir):
    return decided(spark, sf_dir).select("candidate_id", "action")


@query("agg_actions", f"WITH {_DECIDED} SELECT action, count(*) AS n FROM d GROUP BY 1")
def agg_actions(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


@query("ded_applied", f"WITH {_DECIDED}, u AS (SELECT leader AS id, count(*) AS times, max(m.importance) AS importance FROM d JOIN memory_candidates m USING (candidate_id) WHERE action IN ('UPDATE', 'MERGE') AND leader IS NOT NULL AND leader <> candidate_id GROUP BY 1) SELECT c.candidate_id AS id, floor(least(1.0, c.confidence + 0.05 * coalesce(u.times, 0)) * 1e6 + 0.5) / 1e6::DOUBLE AS confidence, greatest(c.importance, u.importance) AS importance, coalesce(u.times, 0) AS usage_count FROM d JOIN memory_candidates c USING (candidate_id) LEFT JOIN u ON u.id = c.candidate_id WHERE d.action = 'ADD'")
def ded_applied(spark, sf_dir):
    """The memories that are added, with what later copies do to them: more confidence, the greatest importance, one use each."""
    d = decided(spark, sf_dir)
    c = table(spark, sf_dir, "memory_candidates").select("candidate_id", "confidence", "importance")
    u = d.where("action in ('UPDATE', 'MERGE') and leader is not null and leader <> candidate_id").join(c, "candidate_id").groupBy(F.col("leader").alias("id")).agg(F.count("*").alias("times"), F.max("importance").alias("most"))
    added = d.where("action = 'ADD'").select("candidate_id").join(c, "candidate_id").withColumnRenamed("candidate_id", "id").join(u, "id", "left")
    times = F.coalesce("times", F.lit(0))
    return added.select("id", S.rounded(F.least(F.lit(1.0), F.col("confidence") + 0.05 * times), 6).alias("confidence"), F.greatest("importance", "most").alias("importance"), times.alias("usage_count"))


@query("ded_resolved", f"WITH {_TYPED}, k AS (SELECT a, b, similarity, ('0x' || right(a, 2))::INT % 5 AS way FROM strong WHERE similarity >= 0.9) SELECT a, b, CASE way WHEN 0 THEN 'keep_a' WHEN 1 THEN 'keep_b' WHEN 2 THEN 'keep_both' WHEN 3 THEN 'merge' ELSE 'dismiss' END AS resolution, CASE way WHEN 0 THEN b WHEN 1 THEN a END AS archived, CASE WHEN way = 3 THEN sha256(a || '|' || b)[1:24] END AS merged FROM k")
def ded_resolved(spark, sf_dir):
    """Conflicts settled one way or another; which way follows from the pair's first identifier."""
    k = strongest(spark, sf_dir).where("similarity >= 0.9").withColumn("way", F.conv(F.right("a", F.lit(2)), 16, 10).cast("int") % 5)
    name = F.element_at(F.array(*map(F.lit, ("keep_a", "keep_b", "keep_both", "merge", "dismiss"))), F.col("way") + 1)
    merged = F.when(F.col("way") == 3, F.left(F.sha2(F.concat("a", F.lit("|"), "b"), 256), F.lit(24)))
    return k.select("a", "b", name.alias("resolution"), F.when(F.col("way") == 0, F.col("b")).when(F.col("way") == 1, F.col("a")).alias("archived"), merged.alias("merged"))


@query("jn_reprocess", "SELECT DISTINCT conversation_id FROM memory_candidates WHERE status = 'rejected' AND conversation_id IN (SELECT conversation_id FROM raw_conversations) AND conversation_id NOT IN (SELECT conversation_id FROM memory_candidates WHERE status = 'accepted' AND conversation_id IS NOT NULL)")
def jn_reprocess(spark, sf_dir):
    """Conversations of which only rejected candidates are left to try again."""
    c = table(spark, sf_dir, "memory_candidates")
    known = table(spark, sf_dir, "raw_conversations").select("conversation_id")
    return c.where("status = 'rejected'").select("conversation_id").distinct().join(known, "conversation_id", "left_semi").join(c.where("status = 'accepted'"), "conversation_id", "left_anti")


# -- lists, trees, sources ----------------------------------------------------------------------------
@query("jn_conversation_list", "SELECT c.conversation_id, c.title, coalesce(m.n, 0) AS n, m.last_at FROM raw_conversations c LEFT JOIN (SELECT conversation_id, count(*) AS n, max(imported_at) AS last_at FROM raw_messages GROUP BY 1) m USING (conversation_id) ORDER BY m.last_at DESC NULLS LAST, c.conversation_id LIMIT 100")
def jn_conversation_list(spark, sf_dir):
    m = table(spark, sf_dir, "raw_messages").groupBy("conversation_id").agg(F.count("*").alias("n"), F.max("imported_at").alias("last_at"))
    c = table(spark, sf_dir, "raw_conversations").select("conversation_id", "title").join(m, "conversation_id", "left")
    return c.select("conversation_id", "title", F.coalesce("n", F.lit(0)).alias("n"), "last_at").orderBy(F.desc_nulls_last("last_at"), "conversation_id").limit(100)


@query("win_tasks", "SELECT conversation_id, candidate_id, rank FROM (SELECT conversation_id, candidate_id, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at DESC NULLS LAST, candidate_id) AS rank FROM memory_candidates WHERE type = 'task' AND conversation_id IS NOT NULL) WHERE rank <= 8")
def win_tasks(spark, sf_dir):
    """The eight newest tasks of each conversation."""
    t = table(spark, sf_dir, "memory_candidates").where("type = 'task' and conversation_id is not null").select("conversation_id", "candidate_id", "created_at")
    return graph.prune(t, 8, "conversation_id", [F.desc_nulls_last("created_at"), F.asc("candidate_id")]).select("conversation_id", "candidate_id", F.col("rn").alias("rank"))


@query("rap_deleted", _TREE + ", gone AS (SELECT unnest(path) AS a, id FROM down) SELECT id FROM one WHERE id NOT IN (SELECT g.id FROM gone g JOIN summary_nodes s ON s.id = g.a WHERE s.scope_kind = 'conversation')")
def rap_deleted(spark, sf_dir):
    """The nodes that stay when the summaries of conversations are deleted with all that lies below them."""
    nodes = table(spark, sf_dir, "summary_nodes")
    tree = hierarchy.hierarchy(nodes, with_paths=True).select("id", "path")
    marked = nodes.where("scope_kind = 'conversation' and id is not null").select(F.col("id").alias("a")).distinct()
    gone = tree.select("id", F.explode("path").alias("a")).join(marked, "a", "left_semi").select("id").distinct()
    return tree.select("id").join(gone, "id", "left_anti")


@query("rap_leaves", _TREE + ", leaf AS (SELECT d.id, d.path FROM down d WHERE d.id NOT IN (SELECT par FROM one WHERE par IS NOT NULL)) SELECT a AS id, count(*) AS leaves FROM (SELECT unnest(path[:len(path) - 1]) AS a FROM leaf) GROUP BY 1")
def rap_leaves(spark, sf_dir):
    """How many leaves a hit on a summary stands for."""
    tree = hierarchy.hierarchy(table(spark, sf_dir, "summary_nodes"), with_paths=True).where("depth >= 0 and descendants = 0")
    return tree.select(F.explode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("id")).groupBy("id").agg(F.count("*").alias("leaves"))


@query("src_lines", f"SELECT row_id, {_ROLE} AS role, length(content) AS n_chars FROM raw_messages WHERE role IS NOT NULL AND trim(role) <> '' AND content IS NOT NULL AND trim(content) <> '' AND regexp_matches(content, '[a-zA-Z]')")
def src_lines(spark, sf_dir):
    """Messages written as JSON lines and read again; lines without role or content are no messages. Files are read in splits, not whole."""
    m = table(spark, sf_dir, "raw_messages").where(F.coalesce(F.col("content").rlike("[a-zA-Z]"), F.lit(True)))
    path = new_path(spark, "lines")
    m.select(F.to_json(F.struct("role", "content", F.col("row_id").cast("string").alias("id"))).alias("value")).write.text(path)
    read = transcripts.messages_of(spark.read.text(path))
    return read.select(F.col("external_id").cast("bigint").alias("row_id"), transcripts.role(F.col("role")).alias("role"), F.length("content").alias("n_chars"))


@query("src_node_maps", "SELECT uuid, m.uuid AS node, row_number() OVER (PARTITION BY uuid ORDER BY m.created_at IS NULL, m.created_at, m.uuid) - 1 AS ordinal FROM (SELECT uuid, unnest(chat_messages) AS m FROM export_conversations)")
def src_node_maps(spark, sf_dir):
    """Conversations kept as maps of nodes, in their order: by time as it is written, nodes without one last, then by name. A conversation's map is one row."""
    e = table(spark, sf_dir, "export_conversations").where("chat_messages is not null").select("uuid", F.to_json(F.map_from_entries(F.transform("chat_messages", lambda m: F.struct(m["uuid"], F.struct(m["created_at"].alias("at")))))).alias("mapping"))
    nodes = F.map_entries(F.from_json("mapping", "map<string,struct<at:string>>"))
    order = F.array_sort(F.transform(nodes, lambda n: F.struct(n["value"]["at"].isNull().alias("late"), n["value"]["at"].alias("at"), n["key"].alias("node"))))
    return e.select("uuid", F.posexplode(order).alias("ordinal", "n")).select("uuid", F.col("n.node").alias("node"), F.col("ordinal").cast("bigint").alias("ordinal"))
