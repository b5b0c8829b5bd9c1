"""Messages delivered more than once: one copy of each stays.

Only the identifier, the delivery order and the position (file, row) of a row are shuffled. The winners' positions are
subtracted from all positions, which gives each file's deletion vector; wide payloads are read with those vectors and
never shuffled.

Defined results: a null or blank message identifier is never a copy of anything; a null conversation is a conversation
of its own (one); a null delivery time comes after all others; the smallest delivery identifier breaks ties; an empty
table gives an empty result; further columns of the payload pass through untouched, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.util import blank, materialize, strip

#: Largest broadcast of deletion vectors, in bytes; a larger set is applied file group by file group.
VECTOR_BYTES = 64 << 20
WORD = 62  # bits used of each BIGINT word
#: Bytes that a word takes in a broadcast hash table, at most.
WORD_BYTES = 64


def positions(payload: DataFrame, conversation: str = "conversation_id", message: str = "message_id", received: str = "received_at", delivery: str = "delivery_id") -> DataFrame:
    """The narrow table: identifier, delivery order, file and row of every delivery that has an identifier."""
    return payload.where(~blank(F.col(message))).select(
        F.col(conversation).alias("conversation"), strip(F.col(message)).alias("message"), F.col(received).alias("received"), F.col(delivery).alias("delivery"),
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )


def surplus(narrow: DataFrame) -> DataFrame:
    """Rows of positions() that are not the first delivery of their message.

    Winners come from an aggregation with map-side combining; losers are all positions without the winners'. The second
    join is by position, which is unique, so a message delivered a billion times makes no hot partition.
    """
    order = F.struct(F.col("received").isNull().alias("late"), "received", "delivery", "file", "row")
    winners = narrow.groupBy("conversation", "message").agg(F.min(order).alias("w")).select(F.col("w.file").alias("file"), F.col("w.row").alias("row"))
    return narrow.join(winners, ["file", "row"], "left_anti").select("delivery", "file", "row")


def deletion_vectors(losers: DataFrame) -> DataFrame:
    """The deletion vectors in words: file, word, bits (bit i of word j: row 62 j + i of the file is deleted). Words without deletions are left out."""
    return losers.groupBy("file", F.expr(f"row div {WORD}").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, cast(row % {WORD} as int)))").alias("bits"))


def read_without(spark: SparkSession, payload: DataFrame, vectors: DataFrame, budget: int = VECTOR_BYTES) -> DataFrame:
    """The payload without the rows that the vectors delete; the wide rows are filtered where they are read.

    The vectors are broadcast only if they are at most ``budget`` bytes in all. Beyond that, files are put in groups whose
    vectors fit, and each group is a scan of its own files with its own vectors; no file is read twice. Only the sizes
    per file come to the driver, which lists the files anyway.
    """
    vectors = materialize(vectors, "deletions")
    groups: list[list[int]] = [[]]
    room = budget
    for r in vectors.groupBy("file").agg((F.count("*") * WORD_BYTES).alias("size")).orderBy("file").toLocalIterator():
        if groups[-1] and r.size > room:
            groups.append([])
            room = budget
        groups[-1].append(r.file)
        room -= r.size
    columns = payload.columns

    def apply(rows: DataFrame, part: DataFrame) -> DataFrame:
        own = F.broadcast(part.select(F.col("file").alias("__file"), F.col("word").alias("__word"), F.col("bits").alias("__bits")))
        row = F.col("_metadata.row_index")
        at = rows.withColumns({"__f": F.xxhash64("_metadata.file_path"), "__w": F.expr(f"_metadata.row_index div {WORD}"), "__b": (row % WORD).cast("int")})
        kept = F.call_function("shiftright", F.coalesce("__bits", F.lit(0).cast("bigint")), F.col("__b")).bitwiseAND(F.lit(1)) == 0
        return at.join(own, (F.col("__f") == F.col("__file")) & (F.col("__w") == F.col("__word")), "left").where(kept).select(*columns)

    if len(groups) == 1:
        return apply(payload, vectors)
    paths = {r.f: r.p for r in payload.select(F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.file_path").alias("p")).distinct().toLocalIterator()}
    touched = {f for g in groups for f in g}
    plain = [p for f, p in paths.items() if f not in touched]
    scans = [spark.read.schema(payload.schema).parquet(*plain)] if plain else []
    scans += [apply(spark.read.schema(payload.schema).parquet(*(paths[f] for f in g)), vectors.where(F.col("file").isin(g))) for g in groups]
    return reduce(DataFrame.unionAll, scans)


def exactly_once(spark: SparkSession, payload: DataFrame, budget: int = VECTOR_BYTES, **names: str) -> DataFrame:
    """The payload with one delivery of each message; rows without an identifier all stay. The payload must be a plain scan of Parquet files."""
    return read_without(spark, payload, deletion_vectors(surplus(positions(payload, **names))), budget)
