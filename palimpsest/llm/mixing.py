"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled and queued, small sources several times over; a document's virtual finish time is
the number of tokens of its source up to and with it, divided by the source's weight. All queues are merged by a global
range sort on that time and cut off where the total reaches the budget. Running totals are taken over range partitions,
so a source of a third of all documents is spread over many tasks.

Defined results: documents without source, of a source without weight (null, zero, negative or missing), or without
tokens are not used; a null or negative cap counts as 0; shares are scaled to the sources that can be used; ties in the
finish time go by source, copy and document; without usable documents the mixture is empty. The default budget is the
largest with which every source reaches its share under its cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.util import materialize, running_totals


def plan(sizes: DataFrame, weights: DataFrame, budget: int | None = None) -> DataFrame:
    """Per usable source: source, target_share (scaled), max_repeats, tokens, n_docs, budget, copies needed."""
    wanted = weights.where("source is not null and target_share > 0").groupBy("source").agg(F.max("target_share").alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).alias("max_repeats"))
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n_docs"))
    usable = wanted.where("max_repeats > 0").join(held, "source").where("tokens > 0")
    total = usable.agg(F.sum("weight").alias("all"))
    usable = usable.crossJoin(total).select("source", (F.col("weight") / F.col("all")).alias("target_share"), "max_repeats", "tokens", "n_docs")  # one row: a scalar
    most = usable.agg(F.floor(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).alias("budget")) if budget is None else None
    usable = usable.crossJoin(most) if budget is None else usable.withColumn("budget", F.lit(budget).cast("bigint"))
    return usable.withColumn("copies", F.least("max_repeats", F.ceil(F.col("target_share") * F.col("budget") / F.col("tokens")) + 1))


def mix(docs: DataFrame, weights: DataFrame, budget: int | None = None, seed: int = 7) -> DataFrame:
    """doc_id, source, copy_no (from 0), n_tokens, finish of the documents taken. docs: doc_id (unique), source, n_tokens."""
    sizes = materialize(docs.where("source is not null and n_tokens > 0").select("doc_id", "source", F.col("n_tokens").cast("bigint").alias("n_tokens")), "sizes")
    quota = materialize(plan(sizes, weights, budget), "quota")
    queued = sizes.join(quota.select("source", "target_share", "budget", "copies"), "source")
    queued = queued.withColumn("copy_no", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))).withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "copy_no"))
    ranked = running_totals(queued, ["source"], ["copy_no", "draw", "doc_id"], {"served": F.col("n_tokens")}, "queue")
    timed = ranked.withColumn("finish", F.col("served") / F.col("target_share")).drop("draw", "copies")
    merged = running_totals(timed, [], ["finish", "source", "copy_no", "doc_id"], {"total": F.col("n_tokens")}, "merge")
    return merged.where(F.col("total") <= F.col("budget")).select("doc_id", "source", "copy_no", "n_tokens", "finish")


def shares(mixture: DataFrame, weights: DataFrame) -> DataFrame:
    """source, target_share, max_repeats, n_used, most_used (uses of one document), tokens, actual_share; also of sources that gave nothing."""
    used = mixture.groupBy("source").agg(F.count("*").alias("n_used"), (F.max("copy_no") + 1).alias("most_used"), F.sum("n_tokens").alias("tokens"))
    total = used.agg(F.sum("tokens").alias("all"))
    out = weights.where("source is not null").join(used, "source", "left").crossJoin(total)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("source", "target_share", "max_repeats", zero("n_used"), zero("most_used"), zero("tokens"), F.round(F.coalesce(F.col("tokens") / F.col("all"), F.lit(0.0)), 9).alias("actual_share"))
