"""Graphs as edge tables: links between memories, spreading activation, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.util import materialize


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst, w in both directions; the largest weight of each pair counts, loops and weights of 0 or less are left out."""
    good = edges.where("src is not null and dst is not null and src <> dst and w > 0").select("src", "dst", "w")
    return good.unionAll(good.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.max("w").alias("w"))


def pagerank(edges: DataFrame, seeds: DataFrame, rounds: int = 20, alpha: float = 0.5) -> DataFrame:
    """node, rank after fixed rounds of personalised PageRank from seeds (node, p; p sums to 1). Mass without a way out returns to the seeds.

    Each round is one join on the source and one aggregation with map-side combining, so hubs are summed before the
    shuffle; every fourth round is written down to keep the plan short.
    """
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    step = materialize(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "transitions")
    sources = materialize(step.select(F.col("src").alias("node")).distinct(), "sources")
    seeds = materialize(seeds, "seeds")
    rank = seeds.select("node", F.col("p").alias("rank"))
    for k in range(rounds):
        moved = rank.join(step, rank["node"] == step["src"]).select(F.col("dst").alias("node"), (F.col("rank") * F.col("share") * alpha).alias("rank"))
        stuck = rank.join(sources, "node", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("stuck"))
        back = seeds.crossJoin(F.broadcast(stuck)).select("node", (F.col("p") * ((1 - alpha) + alpha * F.col("stuck"))).alias("rank"))  # stuck: one row
        rank = moved.unionAll(back).groupBy("node").agg(F.sum("rank").alias("rank"))
        if k % 4 == 3:
            rank = materialize(rank, "rank")
    return rank


def neighbours(edges: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """start, node, hops: what is reachable in at most ``depth`` steps, with the fewest steps. One join a level, on new nodes only."""
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hops"))
    front = seen
    for k in range(1, depth + 1):
        reached = front.join(edges, front["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = materialize(reached.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(k)), "front")
        seen = seen.unionAll(front)
    return seen.where("hops > 0")


def cooccurrence(members: DataFrame, group: str, item: str, least: int = 2) -> DataFrame:
    """a < b, n, confidence of items that share at least ``least`` groups; confidence grows by 0.05 from 0.4 and ends at 0.95."""
    one = members.select(F.col(group).alias("g"), F.col(item).alias("a")).where("g is not null and a is not null").distinct()
    two = one.select("g", F.col("a").alias("b"))
    n = one.join(two, "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.withColumn("confidence", F.floor(F.least(F.lit(0.95), 0.4 + 0.05 * F.col("n")) * 100 + 0.5) / 100)


def prune(links: DataFrame, keep: int, key: str = "src", order: list | None = None) -> DataFrame:
    """The best ``keep`` links of each source; Spark limits groups before the shuffle."""
    order = order or [F.desc("similarity"), "link_id"]
    return links.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rn") <= keep)
