"""Queries of the problems of training data and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.llm import conversations, mixing, neighbours, pii, stuffing, tokens
from palimpsest.operators import delivery
from palimpsest.plans import problems
from palimpsest.util import table

QUERIES, SQL = {}, {}


def _instants(spark, sf_dir):
    def of(rows):
        found = problems.instants(spark, sf_dir, problems.created_at(spark, sf_dir, rows)[0])
        return found.select(F.col("record_id").cast("bigint").alias("row_id"), "utc_us")

    return of


def p6_found(spark, sf_dir):
    return conversations.rebuild(table(spark, sf_dir, "raw_messages"), _instants(spark, sf_dir)).select("conversation_id", "turn_no", "row_id")


def p6_sessions(spark, sf_dir):
    """The turns of the sessions of each project of the ingested events, split at calibrated gaps; one delivery of each message."""
    once = delivery.exactly_once(spark, table(spark, sf_dir, "ingest_events"))
    e = once.select(F.coalesce("project", "conversation_id").alias("channel"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("at"), F.col("delivery_id").alias("id"), conversations.role_of(F.col("role")).alias("role"))
    return conversations.session_turns(e).withColumnRenamed("id", "delivery_id")


_IN = lambda names: ", ".join(f"'{n}'" for n in names)
SQL["p6_sessions"] = f"""WITH e AS (SELECT coalesce(project, conversation_id) AS channel, epoch_us(received_at) AS at_us, delivery_id AS id, CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE lower(trim(role)) END AS role
  FROM ({problems._RANKED}) WHERE m = '' OR rn = 1), u AS (SELECT * FROM e WHERE channel IS NOT NULL AND at_us IS NOT NULL),
g AS (SELECT *, (at_us - lag(at_us) OVER (PARTITION BY channel ORDER BY at_us, id)) / 1000000.0::DOUBLE AS gap FROM u), bins AS (SELECT greatest(floor(log2(gap)), 0)::INT AS b, count(*) AS n FROM g WHERE gap > 0 GROUP BY 1),
top AS (SELECT b FROM bins ORDER BY n DESC, b LIMIT 1), cut AS (SELECT greatest(60.0, 1.5 * pow(2, coalesce((SELECT r.b FROM (SELECT unnest(range(0, 64)) AS b) r LEFT JOIN bins USING (b) WHERE r.b > (SELECT b FROM top) AND r.b <= (SELECT max(b) FROM bins) ORDER BY coalesce(n, 0), r.b LIMIT 1), (SELECT max(b) FROM bins)))) AS secs),
s AS (SELECT channel, at_us, id, role, sum(CASE WHEN gap IS NULL OR gap > secs THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY at_us, id) AS session_no FROM g, cut),
f AS (SELECT *, coalesce(role IN ('user', 'assistant'), false) AS talk, NOT coalesce(role IN ({_IN(conversations.ALLOWED)}), false) AS unknown, coalesce(role IN ({_IN(conversations.TURNS)}), false) OR NOT coalesce(role IN ({_IN(conversations.ALLOWED)}), false) AS is_turn FROM s),
c AS (SELECT *, sum((talk OR unknown)::INT) OVER w AS pos, sum(talk::INT) OVER w AS known, sum(is_turn::INT) OVER w AS turn FROM f WINDOW w AS (PARTITION BY channel, session_no ORDER BY at_us, id)),
r AS (SELECT c.channel, c.session_no, c.at_us, c.id, c.turn, CASE WHEN NOT c.unknown THEN c.role WHEN (coalesce(c.pos - k.pos, c.pos - 1) % 2 = 0) = (coalesce(k.role, 'user') = 'user') THEN 'user' ELSE 'assistant' END AS role
  FROM c LEFT JOIN c k ON c.unknown AND k.talk AND k.channel = c.channel AND k.session_no = c.session_no AND k.known = greatest(c.known, 1) WHERE c.is_turn),
ok AS (SELECT channel, session_no FROM r GROUP BY 1, 2 HAVING max((at_us, id)) FILTER (role = 'assistant') > min((at_us, id)) FILTER (role = 'user'))
SELECT r.channel, r.session_no, (r.turn - 1)::INT AS turn_no, r.id AS delivery_id, r.role FROM r JOIN ok USING (channel, session_no)"""


def p7_ids(spark, sf_dir):
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _sizes(spark, sf_dir):
    return tokens.lengths(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def p8_mixture(spark, sf_dir):
    return mixing.mix(_sizes(spark, sf_dir), table(spark, sf_dir, "source_weights")).drop("finish")


def p8_shares(spark, sf_dir):
    weights = table(spark, sf_dir, "source_weights")
    return mixing.shares(mixing.mix(_sizes(spark, sf_dir), weights), weights)


def p2_found(spark, sf_dir):
    rows = table(spark, sf_dir, "memory_embeddings").select(F.col("memory_id").alias("id"), F.col("embedding").alias("vec"))
    return neighbours.pairs(neighbours.nearest(rows))


def _texts(spark, sf_dir):
    """All texts that may mention people: table_name, record_id, text."""
    messages = table(spark, sf_dir, "raw_messages").select(F.lit("raw_messages").alias("table_name"), F.col("row_id").cast("string").alias("record_id"), F.col("content").alias("text"))
    candidates = table(spark, sf_dir, "memory_candidates").select(F.lit("memory_candidates").alias("table_name"), F.col("candidate_id").alias("record_id"), F.col("content").alias("text"))
    exports = table(spark, sf_dir, "export_conversations").select(F.explode(F.transform("chat_messages", lambda m: F.struct(m["uuid"].alias("uuid"), m["text"].alias("text")))).alias("m"))
    exports = exports.select(F.lit("export_conversations").alias("table_name"), F.col("m.uuid").alias("record_id"), F.col("m.text").alias("text"))
    return messages.unionAll(candidates).unionAll(exports)


def p5_found(spark, sf_dir):
    return pii.find(_texts(spark, sf_dir), ["table_name", "record_id"])


def p5_redacted(spark, sf_dir):
    """The texts with placeholders."""
    return pii.redact(_texts(spark, sf_dir))


def p9_found(spark, sf_dir):
    return stuffing.stuffed(table(spark, sf_dir, "documents"))


def p9_statistics(spark, sf_dir):
    """What the pairs of neighbouring words say of each distinct text."""
    return stuffing.statistics(stuffing.distinct_texts(table(spark, sf_dir, "documents")))


QUERIES |= {"p9_statistics": p9_statistics}
QUERIES |= {"p2_found": p2_found, "p5_found": p5_found, "p5_redacted": p5_redacted, "p9_found": p9_found}
QUERIES |= {"p7_ids": p7_ids, "p8_mixture": p8_mixture, "p8_shares": p8_shares}
QUERIES |= {"p6_found": p6_found, "p6_sessions": p6_sessions}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
