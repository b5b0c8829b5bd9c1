"""Queries of the event path and of sources, on the tables that streams and imports would bring."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.sources import transcripts
from palimpsest.streaming import events
from palimpsest.util import new_path, table, with_previous

QUERIES, SQL = {}, {}


def str_windows(spark, sf_dir):
    """Events by hour and kind, through the streaming operator run over all files there are: the windows that the watermark, two hours behind the last event, has closed."""
    like = table(spark, sf_dir, "events")
    folder, out, check = (new_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    like.select("event_id", "ts", "event_type", "value").write.parquet(folder)
    events.drain(events.windowed(events.source(spark, folder, spark.read.parquet(folder), 1_000)), check, out)
    return spark.read.parquet(out).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", S.rounded(F.col("total"), 2).alias("total"))


QUERIES["str_windows"] = str_windows
SQL["str_windows"] = "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, floor(sum(value) * 100 + 0.5) / 100.0::DOUBLE AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


def str_once(spark, sf_dir):
    """Deliveries without repeated identifiers, through a stream; which copy stays depends on the order of arrival, so keys are given."""
    like = table(spark, sf_dir, "ingest_events").select("conversation_id", "message_id", "received_at")
    folder, out, check = (new_path(spark, f"stream-{x}") for x in ("in", "out", "checkpoint"))
    like.where("message_id is not null and received_at is not null").write.parquet(folder)
    events.drain(events.once(events.source(spark, folder, spark.read.parquet(folder), 1_000), ["conversation_id", "message_id"], "received_at", "36500 days"), check, out)
    return spark.read.parquet(out).select("conversation_id", "message_id")


QUERIES["str_once"] = str_once
SQL["str_once"] = "SELECT DISTINCT conversation_id, message_id FROM ingest_events WHERE message_id IS NOT NULL AND received_at IS NOT NULL"


def str_gaps(spark, sf_dir):
    """The longest pause of each user and the events after pauses of an hour or more."""
    e = table(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    gap = with_previous(e, "user_id", ["at", "event_id"], "at", "gaps").withColumn("gap", F.col("at") - F.col("before"))
    return gap.groupBy("user_id").agg(F.max("gap").alias("longest_us"), F.count_if(F.coalesce(F.col("gap"), F.lit(0)) >= 3_600_000_000).alias("resumed"))


QUERIES["str_gaps"] = str_gaps
SQL["str_gaps"] = "SELECT user_id, max(gap) AS longest_us, count(*) FILTER (gap >= 3600000000) AS resumed FROM (SELECT user_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY user_id"


def src_export(spark, sf_dir):
    m = transcripts.export_messages(table(spark, sf_dir, "export_conversations"))
    return m.select("conversation_id", "ordinal", "external_id", "role", F.md5("content").alias("content_hash"))


QUERIES["src_export"] = src_export
SQL["src_export"] = """SELECT conversation_id, ordinal, m.uuid AS external_id, CASE lower(trim(m.sender)) WHEN 'human' THEN 'user' WHEN 'ai' THEN 'assistant' WHEN 'bot' THEN 'assistant' ELSE lower(trim(m.sender)) END AS role,
md5(coalesce(CASE WHEN trim(m.text) <> '' THEN m.text END, nullif(array_to_string(list_transform(list_filter(m.content, lambda b: b.text IS NOT NULL), lambda b: b.text), chr(10)), ''))) AS content_hash
FROM (SELECT uuid AS conversation_id, generate_subscripts(chat_messages, 1) - 1 AS ordinal, unnest(chat_messages) AS m FROM export_conversations)"""


def snk_upsert(spark, sf_dir):
    """The messages of each conversation after all imports: of rows with one external identifier the last imported counts."""
    m = table(spark, sf_dir, "raw_messages").where("conversation_id is not null and external_id is not null").select("conversation_id", "external_id", "row_id", "imported_at", "role")
    old, new = m.where("row_id % 2 = 0"), m.where("row_id % 2 = 1")
    first = transcripts.upsert(old.limit(0), old, ["conversation_id", "external_id"], ["imported_at", "row_id"])
    return transcripts.upsert(first, new, ["conversation_id", "external_id"], ["imported_at", "row_id"])


QUERIES["snk_upsert"] = snk_upsert
SQL["snk_upsert"] = """SELECT conversation_id, external_id, row_id, imported_at, role FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id, external_id ORDER BY row_id % 2 DESC, imported_at DESC NULLS LAST, row_id DESC) AS rn FROM raw_messages
WHERE conversation_id IS NOT NULL AND external_id IS NOT NULL) WHERE rn = 1"""
