"""Sources and sinks: transcripts as JSON lines and text, account exports, keyed upserts, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.util import running_totals

MESSAGE = "role string, content string, created_at string, timestamp string, id string"


def json_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """path, ordinal, role, content, created_at, external_id of transcripts with one JSON message a line.

    Lines that are no JSON object, or have no role or no content, are prose and give no message (with ``strict`` they are
    an error); the ordinal counts the messages of a file from 0 in the order of its lines. Files are read in splits: the
    order is that of the splits and of the rows in each, and ordinals are running counts over range partitions.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")
    if strict:
        whole = F.from_json("value", MESSAGE)
        lines = lines.withColumn("value", F.when((F.trim("value") != "") & (whole["role"].isNull() | whole["content"].isNull()), F.raise_error(F.lit("a line is no message"))).otherwise(F.col("value")))
    counted = running_totals(messages_of(lines), ["path"], ["block", "line"], {"ordinal": F.lit(1)}, "lines")
    return counted.select("path", (F.col("ordinal") - 1).cast("int").alias("ordinal"), "role", "content", "created_at", "external_id")


def messages_of(lines: DataFrame) -> DataFrame:
    """role, content, created_at, external_id, and the other columns, of the lines (value) that are JSON messages; for files of any size, as lines are read in splits."""
    m = F.from_json("value", MESSAGE)
    read = lines.withColumn("m", m).where(F.trim("m.role").isNotNull() & (F.trim("m.role") != "") & (F.trim("m.content") != ""))
    return read.select(*(c for c in lines.columns if c != "value"), "m.role", "m.content", F.coalesce("m.created_at", "m.timestamp").alias("created_at"), F.col("m.id").alias("external_id"))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """path and prose of Markdown files: the lines that are no JSON message, as one document."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.split("value", "\r?\n").alias("lines"))
    prose = F.filter("lines", lambda l: F.from_json(l, MESSAGE)["role"].isNull() | F.from_json(l, MESSAGE)["content"].isNull())
    return lines.select("path", F.trim(F.array_join(prose, "\n")).alias("content")).where("content <> ''")


def export_messages(export: DataFrame) -> DataFrame:
    """conversation_id, ordinal, external_id, role, content of account exports; the text of content blocks where the text is missing."""
    m = export.select(F.col("uuid").alias("conversation_id"), F.posexplode("chat_messages").alias("ordinal", "m"))
    blocks = F.array_join(F.transform(F.filter("m.content", lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n")
    text = F.coalesce(F.when(F.trim("m.text") != "", F.col("m.text")), F.when(blocks != "", blocks))
    return m.select("conversation_id", "ordinal", F.col("m.uuid").alias("external_id"), role(F.col("m.sender")).alias("role"), text.alias("content"))


def role(raw: Column) -> Column:
    name = F.lower(F.trim(raw))
    return F.when(name == "human", "user").when(name.isin("ai", "bot"), "assistant").otherwise(name)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old with new: of the new rows of a key the last in ``order`` counts and replaces the old one; columns as in old. One aggregation, no join."""
    columns = old.columns
    tagged = old.withColumn("__new", F.lit(0)).unionByName(new.select(*columns).withColumn("__new", F.lit(1)))
    rest = [c for c in columns if c not in keys]
    best = tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__new", *order)).alias("__row"))
    return best.select(*(c if c in keys else F.col(f"__row.{c}").alias(c) for c in columns))


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """path, size, modified and SHA-256 of the files below a folder."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return f.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
