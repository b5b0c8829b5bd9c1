"""Parent-child rows to full hierarchies by tree contraction.

Each round rakes all leaves into their parents and compresses unary chains: of every chain, the nodes whose hash is the
largest among parent and child are taken out (no two neighbours, about a third), and the edge of their child gets their
length and weight. Rounds are few: proportional to the logarithm of the longest chain, not to its length. The removals
of each round are written down; undone in reverse they give each node its root, depth, path and number of descendants.
A component with a cycle shrinks to a self-loop that nothing can remove: it and all below it are reported.

Children are summed with map-side combining, never collected. Where children are joined with their parent, parents of more
than one row in HOT and of LEAST children are joined by a broadcast of those parents (at most HOT rows), so a parent of a
third of all rows makes no hot task; rows without a parent take no part in any join on parents.

Defined results: a parent that is null, blank or not an identifier of the table makes a root (depth 0); of repeated
identifiers with different parents the smallest parent counts; null identifiers give no row; a node on a cycle or below
one has root '' and -1 for depth and descendants, and an empty path; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.util import blank, discard, materialize, new_path

HOT, LEAST = 1_000, 10_000
RESULT = "id string, root_id string, depth int, descendants bigint, path array<string>"


def _h(c: str, salt: int):
    return F.xxhash64(F.lit(salt), F.col(c))


def hot_parents(pairs: DataFrame) -> DataFrame | None:
    """The parents (hot) of very many rows, at most HOT; None if there are none."""
    count = materialize(pairs.where("par is not null").groupBy("par").agg(F.count("*").alias("n")).where(F.col("n") > LEAST).select(F.col("par").alias("hot"), "n"), "tree-large")
    if not count.head(1):
        return None
    total = pairs.count()
    return count.where(F.col("n") > total / HOT).select("hot")


def with_parent(rows: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """rows joined with the row of ``right`` (unique in ``key``) of their parent."""
    on = F.col("par") == F.col(key)
    if hot is None:
        return rows.join(right, on)
    hot = F.broadcast(hot)
    cold = rows.join(hot, F.col("par") == F.col("hot"), "left_anti").join(right, on)
    return cold.unionByName(rows.join(hot, F.col("par") == F.col("hot"), "left_semi").join(F.broadcast(right.join(hot, F.col(key) == F.col("hot"), "left_semi")), on))


def parents(rows: DataFrame, node: str = "id", parent: str = "parent_id") -> tuple[DataFrame, DataFrame | None]:
    """One row per identifier: id, par (null for roots, also where the parent is blank or missing from the table); and the hot parents."""
    pairs = rows.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.min(F.when(~blank(F.col(parent)), F.col(parent))).alias("par"))
    pairs = materialize(pairs, "tree-pairs")
    hot = hot_parents(pairs)
    known = pairs.select(F.col("id").alias("known"))
    inner = with_parent(pairs.where("par is not null"), known, "known", hot).select("id", "par")
    return pairs.select("id").join(inner, "id", "left"), hot


def hierarchy(rows: DataFrame, node: str = "id", parent: str = "parent_id", with_paths: bool = False, max_rounds: int = 400) -> DataFrame:
    """id, root_id, depth, descendants and, if asked for, path (root first, the node itself last)."""
    spark = rows.sparkSession
    empty = F.array().cast("array<string>")
    one, hot = parents(rows, node, parent)
    one = materialize(one, "tree-parents")
    kids = one.where("par is not null").groupBy(F.col("par").alias("p")).agg(F.count("*").alias("kids"))
    state = one.join(kids, one["id"] == kids["p"], "left").select(
        "id", "par", F.lit(1).alias("len"), F.lit(1).cast("bigint").alias("cnt"), F.lit(0).cast("bigint").alias("extra"), F.coalesce("kids", F.lit(0)).cast("bigint").alias("kids"), empty.alias("seg")
    )
    state = materialize(state, "tree-0")
    discard(one)
    raked, pressed, done = [], [], []
    for k in range(1, max_rounds):
        leaf = (F.col("kids") == 0) & F.col("par").isNotNull()
        over = F.col("par").isNull() & (F.col("kids") == 0)
        raked.append(state.where(leaf).select("id", "par", "len", "cnt", "seg"))
        done.append(state.where(over).select("id", F.col("id").alias("root_id"), F.lit(0).alias("depth"), "cnt", F.when(F.lit(with_paths), F.array("id")).otherwise(empty).alias("path")))
        below = (
            state.where("par is not null").groupBy(F.col("par").alias("p"))
            .agg(F.sum(F.when(F.col("kids") == 0, F.col("cnt") + F.col("extra")).otherwise(0)).alias("s"), F.count(F.when(F.col("kids") > 0, 1)).alias("k"), F.max(F.when(F.col("kids") > 0, F.col("id"))).alias("child"))
        )
        rest = state.where("kids > 0").join(below, F.col("id") == F.col("p"), "left")
        out = F.col("par").isNotNull() & (F.col("par") != F.col("id")) & (F.col("k") == 1) & (_h("id", k) > _h("par", k)) & (_h("id", k) > _h("child", k)) & (F.col("child") != F.col("id"))
        rest = rest.select("id", "par", "len", (F.col("cnt") + F.col("s")).alias("cnt"), "extra", F.col("k").alias("kids"), "seg", F.coalesce(out, F.lit(False)).alias("out"), "child")
        gone = rest.where("out").select(F.col("child").alias("c"), F.col("id").alias("g_id"), F.col("par").alias("g_par"), F.col("len").alias("g_len"), F.col("cnt").alias("g_cnt"), F.col("extra").alias("g_extra"), F.col("seg").alias("g_seg"))
        seen = Observation()
        moved = rest.where("not out").join(gone, F.col("id") == F.col("c"), "left")
        loop = (F.coalesce("g_par", "par") == F.col("id")) & (F.col("kids") == 1)
        moved = materialize(moved.observe(seen, F.count("*").alias("n"), F.count(F.when(loop, 1)).alias("loops"), F.count("g_id").alias("pressed")), f"tree-{k}")
        pressed.append(
            moved.where("g_id is not null").select(F.col("g_id").alias("id"), F.col("g_par").alias("par"), F.col("g_len").alias("len"), F.col("g_cnt").alias("cnt"), F.col("extra").alias("c_extra"), F.col("id").alias("child"), F.col("g_seg").alias("seg"))
        )
        hit = F.col("g_id").isNotNull()
        path = F.concat("g_seg", F.array("g_id"), "seg") if with_paths else F.col("seg")
        state = moved.select(
            "id", F.when(hit, F.col("g_par")).otherwise(F.col("par")).alias("par"), F.when(hit, F.col("len") + F.col("g_len")).otherwise(F.col("len")).alias("len"), "cnt",
            F.when(hit, F.col("extra") + F.col("g_cnt") + F.col("g_extra")).otherwise(F.col("extra")).alias("extra"), "kids", F.when(hit, path).otherwise(F.col("seg")).alias("seg"),
        )
        if not seen.get["pressed"]:
            pressed[-1] = None
        if seen.get["n"] == seen.get["loops"]:
            break
    else:
        raise RuntimeError(f"the contraction did not end in {max_rounds} rounds")
    core = state.select("id", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), F.lit(-1).cast("bigint").alias("cnt"), empty.alias("path"))
    # Results gather in one folder, a part for each undone round, so that a join over all of them stays one scan.
    folder, parts = new_path(spark, "tree-known"), 0
    first = reduce(DataFrame.unionAll, [core, *done])
    first.write.parquet(f"{folder}/part=0")
    for r, p in zip(reversed(raked), reversed(pressed), strict=True):
        for removed, chain in ((p, True), (r, False)):
            if removed is None:
                continue
            all_known = spark.read.schema(first.schema).parquet(folder)
            up = all_known.select(F.col("id").alias("u_id"), "root_id", F.col("depth").alias("u_depth"), F.col("path").alias("u_path"))
            found = with_parent(removed, up, "u_id", hot)
            total = F.col("cnt")
            if chain:
                down = all_known.select(F.col("id").alias("d_id"), F.col("cnt").alias("d_cnt"))
                found = found.join(down, F.col("child") == F.col("d_id"))
                total = F.col("cnt") + F.col("c_extra") + F.col("d_cnt")
            lost = F.col("root_id") == ""
            way = F.when(lost, empty).otherwise(F.concat("u_path", "seg", F.array("id"))) if with_paths else empty
            parts += 1
            found.select(
                "id", "root_id", F.when(lost, F.lit(-1)).otherwise(F.col("u_depth") + F.col("len")).alias("depth"), F.when(lost, F.lit(-1).cast("bigint")).otherwise(total).alias("cnt"), way.alias("path")
            ).write.parquet(f"{folder}/part={parts}")
    every = spark.read.schema(first.schema).parquet(folder)
    columns = ["id", "root_id", "depth", F.when(F.col("root_id") == "", F.lit(-1)).otherwise(F.col("cnt") - 1).cast("int").alias("descendants")]
    return every.select(*columns, *(["path"] if with_paths else []))


def descendant_pairs(tree: DataFrame) -> DataFrame:
    """All pairs of a node and a node below it, with their distance, from a hierarchy with paths. As many rows as there are such pairs."""
    up = tree.select("id", F.col("depth"), F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("at", "ancestor"))
    return up.select("ancestor", F.col("id").alias("descendant"), (F.col("depth") - F.col("at")).alias("distance"))
