"""Queries that answer: hybrid retrieval, feedback, conflicts among answers and their resolution, standing instructions, reinforcement, judgement by mode."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators import retrieval
from palimpsest.plans import memory
from palimpsest.plans.memory import _M, NOW, bm25_sql, now
from palimpsest.plans.quality import holders
from palimpsest.util import materialize, table

QUERIES, SQL = {}, {}

#: Rows that a leg of a search hands on, and rows of an answer.
LEG, BEST = 20, 10
_LIVE = f"id IN (SELECT id FROM memories WHERE archived_at IS NULL AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{NOW}'))"


def query(name, sql=None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def live(spark, sf_dir) -> DataFrame:
    return memory.memories(spark, sf_dir, False).where(S.live(F.col("valid_to"), F.col("archived_at"), now())).select("id")


def legs(spark, sf_dir, k: int = LEG) -> tuple[DataFrame, DataFrame]:
    """The k best live documents of each query by words and by hashed vectors."""
    docs, asked, keep = table(spark, sf_dir, "documents"), memory._asked(spark, sf_dir), live(spark, sf_dir)
    words = retrieval.bm25(docs, asked, k, keep=keep)
    # Written once, as finding the number of blocks would embed all texts again.
    v = materialize(retrieval.embedded(docs, "doc_id", "text").join(keep, "id", "left_semi"), "vectors")
    q = materialize(retrieval.embedded(asked, "query_id", "query"), "asked-vectors").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec"))
    return words, retrieval.dense(v, q, k)


_VEC = "SELECT id, dim, v, sqrt(sum(v * v) OVER (PARTITION BY id)) AS norm FROM (SELECT id, ('0x' || md5(term)[1:2])::INT % 64 AS dim, sum(CASE WHEN ('0x' || md5(term)[3:3])::INT % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM (SELECT {0} AS id, unnest(regexp_extract_all(lower({1}), '[\\p{{L}}\\p{{N}}]+')) AS term FROM {2}) GROUP BY 1, 2)"
_HYBRID = f"""{_M.strip()}, {bm25_sql(memory._ASK, keep=_LIVE)}, dv AS ({_VEC.format('doc_id', 'text', 'documents')}), qv AS ({_VEC.format('query_id', 'query', 'asked')}),
cs AS (SELECT q.id AS query_id, d.id, floor(sum(q.v * d.v) / (any_value(q.norm) * any_value(d.norm)) * 1e6 + 0.5) / 1e6::DOUBLE AS score FROM qv q JOIN (SELECT * FROM dv WHERE norm > 0 AND {_LIVE}) d USING (dim) WHERE q.norm > 0 GROUP BY 1, 2),
dense AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM cs),
f AS (SELECT query_id, id, floor(coalesce(1.0::DOUBLE / (60 + b.rank), 0) * 1e9 + coalesce(1.0::DOUBLE / (60 + d.rank), 0) * 1e9 + 0.5) / 1e9::DOUBLE AS score, b.rank AS bm25_rank, d.rank AS dense_rank, d.score AS dense_score
  FROM (SELECT * FROM bm WHERE rank <= {LEG}) b FULL JOIN (SELECT * FROM dense WHERE rank <= {LEG}) d USING (query_id, id)),
hy AS (SELECT query_id, id, score, coalesce(dense_score, score) AS similarity, bm25_rank, dense_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, coalesce(bm25_rank, 1000), id) AS rank FROM f)"""


def hybrid(spark, sf_dir, k: int = BEST, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """query_id, id, score, similarity, bm25_rank, dense_rank, rank: both legs fused by reciprocal ranks; similarity is the cosine where the vector leg found the row, else the fused score."""
    words, near = found or legs(spark, sf_dir)
    both = words.select("query_id", "id", F.col("rank").alias("bm25_rank")).join(near.select("query_id", "id", F.col("score").alias("dense_score"), F.col("rank").alias("dense_rank")), ["query_id", "id"], "full")
    part = lambda c: F.coalesce(1.0 / (60 + F.col(c)), F.lit(0.0)) * 1e9
    score = F.floor(part("bm25_rank") + part("dense_rank") + 0.5) / 1e9
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.coalesce("bm25_rank", F.lit(1000)), "id")
    ranked = both.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return ranked.select("query_id", "id", "score", F.coalesce("dense_score", "score").alias("similarity"), "bm25_rank", "dense_rank", "rank")


@query("ret_hybrid", f"{_HYBRID} SELECT query_id, id, score, similarity, bm25_rank, dense_rank, rank FROM hy WHERE rank <= {BEST}")
def ret_hybrid(spark, sf_dir):
    return hybrid(spark, sf_dir)


_SCORED = f"SELECT id, type, {memory._S1} AS score FROM memories"


def answers(spark, sf_dir, k: int = LEG) -> DataFrame:
    """The hybrid answers with their memory's type, text and score, in the order of 0.6 similarity + 0.4 score."""
    m = memory.memories(spark, sf_dir).select("id", "type", "content", memory.score(F.lit(1.0)).alias("worth"))
    found = hybrid(spark, sf_dir, k).join(m, "id").withColumn("combined", S.rounded(0.6 * F.col("similarity") + 0.4 * F.col("worth")))
    w = Window.partitionBy("query_id").orderBy(F.desc("combined"), "rank")
    return found.select("query_id", "id", "type", "content", "similarity", "worth", "combined", F.row_number().over(w).alias("place"))


_ANSWERS = f"{_HYBRID}, sc2 AS ({_SCORED}), an AS (SELECT h.query_id, h.id, s.type, m.content, h.similarity, s.score AS worth, floor((0.6::DOUBLE * h.similarity + 0.4::DOUBLE * s.score) * 10000 + 0.5) / 10000.0::DOUBLE AS combined, h.rank FROM hy h JOIN sc2 s USING (id) JOIN memories m USING (id) WHERE h.rank <= {LEG}), ans AS (SELECT query_id, id, type, content, similarity, worth, combined, row_number() OVER (PARTITION BY query_id ORDER BY combined DESC, rank) AS place FROM an)"


@query("ret_combined", f"{_ANSWERS} SELECT query_id, id, combined, place FROM ans")
def ret_combined(spark, sf_dir):
    return answers(spark, sf_dir).select("query_id", "id", "combined", "place")


#: Words by which one text denies what another says.
NEGATIONS = [" no ", " not ", " never ", " sin ", " nunca ", " doesn't ", " isn't ", " avoid "]


def conflicts(found: DataFrame) -> DataFrame:
    """query_id, a, b, place_a, place_b, similarity: pairs of answers of one type that deny each other (similarity 0.4) or are very much alike (0.7). An answer has at most LEG rows."""
    padded, denies = F.concat(F.lit(" "), F.lower("content"), F.lit(" ")), F.lit(False)
    for n in NEGATIONS:
        denies = denies | F.contains(padded, F.lit(n))
    one = found.select("query_id", "type", F.col("id").alias("a"), F.col("place").alias("place_a"), F.col("similarity").alias("s_a"), F.col("worth").alias("worth_a"), F.coalesce(denies, F.lit(False)).alias("deny_a"))
    two = one.select("query_id", "type", *(F.col(f"{c}a").alias(f"{c}b") for c in ("", "place_", "s_", "worth_", "deny_")))
    pairs = one.join(two, ["query_id", "type"]).where("place_a < place_b").withColumn("similarity", F.least("s_a", "s_b"))
    return pairs.where("similarity >= 0.7 or (deny_a <> deny_b and similarity >= 0.4)").select("query_id", "a", "b", "place_a", "place_b", "similarity", "worth_a", "worth_b")


_DENY = "(" + " OR ".join("contains(' ' || lower(content) || ' ', '" + n.replace("'", "''") + "')" for n in NEGATIONS) + ")"


@query("ret_conflicts", f"{_ANSWERS}, neg AS (SELECT *, {_DENY} AS deny FROM ans) SELECT x.query_id, x.id AS a, y.id AS b, least(x.similarity, y.similarity) AS similarity FROM neg x JOIN neg y ON x.query_id = y.query_id AND x.type = y.type AND x.place < y.place WHERE least(x.similarity, y.similarity) >= 0.7 OR (x.deny <> y.deny AND least(x.similarity, y.similarity) >= 0.4)")
def ret_conflicts(spark, sf_dir):
    return conflicts(answers(spark, sf_dir)).select("query_id", "a", "b", "similarity")


def losers(pairs: pd.DataFrame) -> list:
    """Of conflicting pairs, in their order, the side that goes: the one worth less, else the second; pairs of which one side is gone already are passed over."""
    gone: list = []
    for p in pairs.sort_values(["place_a", "place_b"]).itertuples():
        if p.a not in gone and p.b not in gone:
            gone.append(p.a if p.worth_a < p.worth_b else p.b)
    return gone


def resolved(found: DataFrame) -> DataFrame:
    """The answers without those that lose a conflict. A group is the conflicts of one query, at most LEG * (LEG - 1) / 2 rows."""

    def settle(group: pd.DataFrame) -> pd.DataFrame:
        gone = losers(group)
        return pd.DataFrame({"query_id": [group["query_id"].iat[0]] * len(gone), "id": gone})

    found = materialize(found, "answers")
    gone = conflicts(found).groupBy("query_id").applyInPandas(settle, "query_id string, id bigint")
    return found.join(gone, ["query_id", "id"], "left_anti")


def ret_resolved(spark, sf_dir):
    """What stays of the answers once conflicts are settled."""
    return resolved(answers(spark, sf_dir)).select("query_id", "id", "place")


def ret_assembled(spark, sf_dir):
    """The context of each query: the first fifteen settled answers in order, as lines of type and text, up to 4000 characters."""
    kept = resolved(answers(spark, sf_dir))
    w = Window.partitionBy("query_id").orderBy("place")
    lines = kept.withColumn("line", F.concat(F.lit("["), F.col("type"), F.lit("] "), F.col("content"))).withColumn("no", F.row_number().over(w)).where("no <= 15")
    used = F.sum(F.length("line")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used).where("used <= 4000").groupBy("query_id").agg(F.count("*").alias("n"), (F.max("used") / 4).cast("int").alias("tokens"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("context"))


QUERIES |= {"ret_resolved": ret_resolved, "ret_assembled": ret_assembled}


_WIDER = "SELECT a.query_id, a.query || ' ' || d.text AS query FROM asked a JOIN bm b ON b.query_id = a.query_id AND b.rank = 1 JOIN documents d ON d.doc_id = b.id UNION ALL SELECT query_id, query FROM asked WHERE query_id NOT IN (SELECT query_id FROM bm)"


@query("ret_feedback", f"""WITH {memory._BM25}, {bm25_sql(_WIDER, 'w_')}, l AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS s, 0 AS l, rank AS r FROM bm WHERE rank <= 10 UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank), 1, rank FROM w_bm WHERE rank <= 10),
f AS (SELECT query_id, id, floor(sum(s) * 1e9 + 0.5) / 1e9::DOUBLE AS score, min((l, r)) AS first FROM l GROUP BY 1, 2) SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, id) AS rank FROM f) WHERE rank <= 10""")
def ret_feedback(spark, sf_dir):
    """Pseudo-relevance feedback: a second search with the text of the first one's best document added, fused with the first."""
    docs, asked = table(spark, sf_dir, "documents"), memory._asked(spark, sf_dir)
    first = materialize(retrieval.bm25(docs, asked, BEST), "first-pass")
    text = first.where("rank = 1").join(docs.select(F.col("doc_id").alias("id"), "text"), "id").select("query_id", "text")
    wider = asked.join(text, "query_id", "left").select("query_id", F.concat_ws(" ", "query", "text").alias("query"))
    return retrieval.fuse([first, retrieval.bm25(docs, wider, BEST)], BEST)


@query("ret_standing", f"{_M}, s AS ({_SCORED.replace('FROM memories', ', importance FROM memories')} WHERE type = 'procedural' AND archived_at IS NULL AND (valid_to IS NULL OR valid_to >= TIMESTAMP '{NOW}')) SELECT id, importance, score FROM s ORDER BY importance DESC, score DESC, id LIMIT 20")
def ret_standing(spark, sf_dir):
    """The twenty weightiest live instructions, which go with every context."""
    m = memory.memories(spark, sf_dir, False).where(S.live(F.col("valid_to"), F.col("archived_at"), now()) & (F.col("type") == "procedural"))
    return m.select("id", "importance", memory.score(F.lit(1.0)).alias("score")).orderBy(F.desc("importance"), F.desc("score"), "id").limit(20)


@query("lif_reinforce", f"""{_M.strip()}, {memory._BM25}, hits AS (SELECT id, count(*) AS seen, count(*) FILTER (rank <= 3) AS chosen FROM bm WHERE rank <= 10 GROUP BY 1)
SELECT m.id, floor(least(64, m.strength * pow(1.5, h.seen)) * 1e6 + 0.5) / 1e6::DOUBLE AS strength, m.usage_count + h.chosen AS usage_count, CASE WHEN h.chosen > 0 THEN TIMESTAMP '{NOW}' ELSE m.last_used_at END AS last_used_at FROM memories m JOIN hits h USING (id)""")
def lif_reinforce(spark, sf_dir):
    """What a batch of searches does to the memories it found: each makes them stronger, up to 64, and the first three count as uses."""
    found = retrieval.bm25(table(spark, sf_dir, "documents"), memory._asked(spark, sf_dir), BEST)
    hits = found.groupBy("id").agg(F.count("*").alias("seen"), F.count_if(F.col("rank") <= 3).alias("chosen"))
    m = memory.memories(spark, sf_dir, False).join(hits, "id")
    return m.select("id", S.rounded(F.least(F.lit(64.0), F.col("strength") * F.pow(F.lit(1.5), F.col("seen"))), 6).alias("strength"), (F.col("usage_count") + F.col("chosen")).alias("usage_count"), F.when(F.col("chosen") > 0, now()).otherwise(F.col("last_used_at")).alias("last_used_at"))


@query("lif_feedback", f"{_M} SELECT id, floor(least(1.0, confidence + 0.05) * 1e6 + 0.5) / 1e6::DOUBLE AS confidence, usage_count + 1 AS usage_count, floor(greatest(0.0, least(1.0, user_signal + CASE WHEN id % 2 = 0 THEN 0.2 ELSE -0.2 END)) * 1e6 + 0.5) / 1e6::DOUBLE AS user_signal FROM memories WHERE archived_at IS NULL")
def lif_feedback(spark, sf_dir):
    """Memories after they were confirmed and judged: well if their number is even, else badly."""
    signal = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("user_signal") + F.when(F.col("id") % 2 == 0, 0.2).otherwise(-0.2)))
    return memory.memories(spark, sf_dir, False).where("archived_at is null").select("id", S.rounded(F.least(F.lit(1.0), F.col("confidence") + 0.05), 6).alias("confidence"), (F.col("usage_count") + 1).alias("usage_count"), S.rounded(signal, 6).alias("user_signal"))


_GOLD = "gold AS (SELECT a.query_id, d.doc_id AS id, coalesce(d.lang, '?') AS lang FROM asked a JOIN documents d ON contains(lower(d.text), lower(a.query)) WHERE length(trim(a.query)) > 0)"


@query("evl_modes", f"""{_HYBRID}, {_GOLD}, runs AS (SELECT 'bm25' AS mode, query_id, id, rank FROM bm WHERE rank <= 10 UNION ALL SELECT 'dense', query_id, id, rank FROM dense WHERE rank <= 10 UNION ALL SELECT 'hybrid', query_id, id, rank FROM hy WHERE rank <= 10),
j AS (SELECT m.mode, g.lang, g.query_id, count(*) AS gold, count(r.rank) AS hits, min(r.rank) AS first FROM gold g CROSS JOIN (SELECT unnest(['bm25', 'dense', 'hybrid']) AS mode) m LEFT JOIN runs r ON r.mode = m.mode AND r.query_id = g.query_id AND r.id = g.id GROUP BY 1, 2, 3)
SELECT mode, lang, count(*) AS queries, floor(avg(hits / 10.0::DOUBLE) * 10000 + 0.5) / 10000.0::DOUBLE AS precision_10, floor(avg(hits::DOUBLE / gold) * 10000 + 0.5) / 10000.0::DOUBLE AS recall_10, floor(avg(coalesce(1.0::DOUBLE / first, 0)) * 10000 + 0.5) / 10000.0::DOUBLE AS mrr, floor(quantile_cont(gold::DOUBLE, 0.95) * 10000 + 0.5) / 10000.0::DOUBLE AS gold_p95 FROM j GROUP BY 1, 2""")
def evl_modes(spark, sf_dir):
    """Precision, recall and reciprocal rank of each mode by the language of the documents that hold the whole query."""
    words, near = (materialize(x, "leg") for x in legs(spark, sf_dir))
    mixed = hybrid(spark, sf_dir, found=(words, near))
    runs = words.where("rank <= 10").select(F.lit("bm25").alias("mode"), "query_id", "id", "rank").unionAll(near.where("rank <= 10").select(F.lit("dense"), "query_id", "id", "rank")).unionAll(mixed.select(F.lit("hybrid"), "query_id", "id", "rank"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text", F.coalesce("lang", F.lit("?")).alias("lang"))
    gold = holders(docs, memory._asked(spark, sf_dir).where("length(trim(query)) > 0")).join(docs.select("id", "lang"), "id")
    gold = gold.withColumn("mode", F.explode(F.array(*map(F.lit, ("bm25", "dense", "hybrid")))))
    judged = gold.join(runs, ["mode", "query_id", "id"], "left").groupBy("mode", "lang", "query_id").agg(F.count("*").alias("gold"), F.count("rank").alias("hits"), F.min("rank").alias("first"))
    return judged.groupBy("mode", "lang").agg(
        F.count("*").alias("queries"), S.rounded(F.avg(F.col("hits") / 10.0)).alias("precision_10"), S.rounded(F.avg(F.col("hits") / F.col("gold"))).alias("recall_10"), S.rounded(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"),
        S.rounded(F.percentile(F.col("gold").cast("double"), 0.95)).alias("gold_p95"),
    )
