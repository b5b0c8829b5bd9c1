"""Queries that judge and arrange: retrieval quality, diversity, shared entities, summary terms, secrets, versions, active messages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import scoring as S
from palimpsest.operators import retrieval
from palimpsest.plans import memory
from palimpsest.util import materialize, table

QUERIES, SQL = {}, {}


#: Most texts looked for in one task, and bytes that are looked through at once.
TITLE_BLOCK, SLICE = 1 << 18, 1 << 22
_CODES = np.random.default_rng(8).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTORS = [np.uint64(int(x) | 1) for x in np.random.default_rng(9).integers(1 << 62, 1 << 63, 64, dtype=np.uint64)]


def occurrences(data: np.ndarray, ends: np.ndarray, titles: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a title and a text that holds it; text i is data[ends[i] : ends[i + 1]], in bytes.

    A title of n bytes is its first and its last 2 ** k bytes, 2 ** k <= n < 2 ** (k + 1), which overlap. Their hashes are
    looked up among those of all runs of that length; then the bytes themselves are compared.
    """
    size = np.array([len(x) for x in titles], np.int64)
    got = [np.repeat(np.flatnonzero(size == 0), len(ends) - 1) * (len(ends) - 1) + np.tile(np.arange(len(ends) - 1), int((size == 0).sum()))]
    levels = np.array([len(x).bit_length() - 1 for x in titles], np.int64)

    def hashes(x: np.ndarray, level: int, before: np.ndarray | None = None, at: int = 0) -> np.ndarray:
        h = _CODES[x] if before is None else before
        for k in range(at, level):
            h = h[: -(1 << k)] * _FACTORS[k] + h[1 << k :] if len(h) > 1 << k else h[:0]
        return h

    wanted = {}
    for k in sorted(set(levels[size > 0].tolist())):
        own = np.flatnonzero(levels == k)
        first, last = (np.array([hashes(np.frombuffer(part(titles[i]), np.uint8), k)[0] for i in own], np.uint64) for part in (lambda x: x[: 1 << k], lambda x: x[-(1 << k) :]))
        order = np.argsort(first, kind="stable")
        own, first, last = own[order], first[order], last[order]
        keys, starts, counts = np.unique(first, return_index=True, return_counts=True)
        near = np.zeros(1 << 20, bool)
        near[(keys >> np.uint64(44)).astype(np.int64)] = True
        wanted[k] = own, last, keys, starts, counts, near
    a = 0
    while a < len(ends) - 1:
        b = max(int(np.searchsorted(ends, ends[a] + SLICE, "right")) - 1, a + 1)
        piece, h, at = data[ends[a] : ends[b]], None, 0
        for k, (own, last, keys, starts, counts, near) in wanted.items():
            h, at = hashes(piece, k, h, at), k
            if not len(h):
                break
            where = np.flatnonzero(near[(h >> np.uint64(44)).astype(np.int64)])
            key = np.minimum(np.searchsorted(keys, h[where]), len(keys) - 1)
            good = keys[key] == h[where]
            where, key = where[good], key[good]
            n = counts[key]
            pick = np.repeat(starts[key] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            where = np.repeat(where, n)
            title = own[pick]
            text = np.searchsorted(ends, ends[a] + where, "right") - 1
            tail = where + size[title] - (1 << k)
            good = (ends[a] + where + size[title] <= ends[text + 1]) & (h[np.minimum(tail, len(h) - 1)] == last[pick])
            got.append(np.unique(title[good] * (len(ends) - 1) + text[good]))
        a = b
    pairs = np.concatenate(got).astype(np.int64)
    title, text = pairs // max(len(ends) - 1, 1), pairs % max(len(ends) - 1, 1)
    raw = data.tobytes()
    sure = np.fromiter((raw.find(titles[i], ends[j], ends[j + 1]) >= 0 for i, j in zip(title.tolist(), text.tolist(), strict=True)), bool, len(title))
    return title[sure], text[sure]


def _hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = retrieval.whole(batches)
    if t is None:
        return
    titles, docs = retrieval.column(t, "q").drop_null(), t.filter(pc.is_valid(t["t"]))
    if not len(titles) or not len(docs):
        return
    ids, texts = retrieval.column(docs, "id"), [x.encode() for x in retrieval.column(docs, "t").to_pylist()]
    ends = np.r_[0, np.cumsum([len(x) for x in texts])]
    title, text = occurrences(np.frombuffer(b"".join(texts), np.uint8), ends, [x.encode() for x in titles.to_pylist()])
    order = np.argsort(title, kind="stable")
    counts = np.bincount(title, minlength=len(titles))
    hit = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([titles.take(pa.array(hit)), retrieval.lists(counts[hit], ids.take(pa.array(text[order])))], ["q", "ids"])


def holders(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, id of every document (id, text) that contains a query (query_id, query), case aside; a row for each such row of either.

    Blocks of documents meet blocks of the distinct queries, a pair of blocks a task; neither side is broadcast.
    """
    queries = asked.select("query_id", F.lower("query").alias("q")).where("q is not null")
    titles, texts = queries.select("q").distinct(), docs.select("id", F.lower("text").alias("t")).where("t is not null")
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("chars")).first()
    n, m = max(retrieval.blocks(size.n, retrieval.DOC_BLOCK, spark=docs.sparkSession), -(-size.chars // retrieval.CHAR_BLOCK)), max(-(-titles.count() // TITLE_BLOCK), 1)
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
    left = texts.withColumn("k", every(m)).select((block("id", n) * m + F.col("k")).alias("part"), "id", "t")
    right = titles.withColumn("k", every(n)).select((F.col("k") * m + block("q", m)).alias("part"), "q")
    found = retrieval.stacked([left, right], n * m, "part").mapInArrow(_hold, f"q string, ids array<{docs.schema['id'].dataType.simpleString()}>")
    return queries.join(found, "q").select("query_id", F.explode("ids").alias("id"))


def evl_metrics(spark, sf_dir):
    """Of the queries with gold (documents that hold the whole title): how many have a hit at 1 and in ten, the mean reciprocal rank and the mean recall.

    Gold is every document that contains the title anywhere, also where the title begins or ends inside of a word.
    """
    asked = memory._asked(spark, sf_dir).where("length(trim(query)) > 0")
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("id"), "text")
    gold = holders(docs, asked)
    best = retrieval.bm25(table(spark, sf_dir, "documents"), asked, 10)
    judged = gold.join(best, ["query_id", "id"], "left").groupBy("query_id").agg(F.count("*").alias("gold"), F.count("rank").alias("hits"), F.min("rank").alias("first"))
    return judged.agg(F.count("*").alias("queries"), F.count_if(F.col("first") == 1).alias("hit_1"), F.count("first").alias("hit_10"), S.rounded(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr"), S.rounded(F.avg(F.col("hits") / F.col("gold"))).alias("recall"))


QUERIES["evl_metrics"] = evl_metrics
SQL["evl_metrics"] = f"""WITH {memory._BM25}, gold AS (SELECT a.query_id, d.doc_id AS id FROM asked a JOIN documents d ON contains(lower(d.text), lower(a.query)) WHERE length(trim(a.query)) > 0),
j AS (SELECT g.query_id, count(*) AS gold, count(b.rank) AS hits, min(b.rank) AS first FROM gold g LEFT JOIN (SELECT * FROM bm WHERE rank <= 10) b ON b.query_id = g.query_id AND b.id = g.id GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (first = 1) AS hit_1, count(first) AS hit_10, floor(avg(coalesce(1.0::DOUBLE / first, 0)) * 10000 + 0.5) / 10000.0::DOUBLE AS mrr, floor(avg(hits::DOUBLE / gold) * 10000 + 0.5) / 10000.0::DOUBLE AS recall FROM j"""


def diverse(scores: np.ndarray, vectors: np.ndarray, k: int, weight: float) -> list[int]:
    """Greedy order that gives up some relevance for less likeness to what was chosen; ties go to the earlier."""
    chosen: list[int] = []
    like = np.zeros(len(scores))
    left = list(range(len(scores)))
    while left and len(chosen) < k:
        worth = [weight * scores[i] - (1 - weight) * (like[i] if chosen else 0.0) for i in left]
        best = left[int(np.argmax(np.round(worth, 12)))]
        chosen.append(best)
        left.remove(best)
        cosine = vectors @ vectors[best]
        like = cosine if len(chosen) == 1 else np.maximum(like, cosine)
    return chosen


def ret_mmr(spark, sf_dir):
    """The twenty nearest vectors of each query thinned to ten that differ. A group is one query's twenty candidates."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    near = retrieval.dense(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("qvec")), 20)

    def thin(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        x = np.stack(group["vec"].to_numpy()).astype(float)
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        order = diverse(group["score"].to_numpy(), x, 10, 0.7)
        out = group.iloc[order]
        return pd.DataFrame({"query_id": out["query_id"], "id": out["id"], "position": range(len(out))})

    return near.join(v, "id").groupBy("query_id").applyInPandas(thin, "query_id bigint, id bigint, position int")


QUERIES["ret_mmr"] = ret_mmr


def gra_shared_entities(spark, sf_dir):
    """Candidates of one conversation that share two entities or more, with the Jaccard likeness of their entities.

    The links of all candidates that share an entity are those of gra_entity_links.
    """
    c = table(spark, sf_dir, "memory_candidates").where("conversation_id is not null").select("candidate_id", "conversation_id", F.array_distinct("entities").alias("e")).where("size(e) > 1")
    one = c.select("conversation_id", F.col("candidate_id").alias("a"), F.size("e").alias("na"), F.explode("e").alias("entity"))
    two = one.select("conversation_id", F.col("a").alias("b"), F.col("na").alias("nb"), "entity")
    shared = one.join(two, ["conversation_id", "entity"]).where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n")).where("n >= 2")
    return shared.select("a", "b", S.rounded(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))


QUERIES["gra_shared_entities"] = gra_shared_entities
SQL["gra_shared_entities"] = """WITH c AS (SELECT candidate_id, conversation_id, list_distinct(entities) AS e FROM memory_candidates WHERE conversation_id IS NOT NULL)
SELECT x.candidate_id AS a, y.candidate_id AS b, floor(len(list_intersect(x.e, y.e)) / (len(x.e) + len(y.e) - len(list_intersect(x.e, y.e)))::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE AS jaccard
FROM c x JOIN c y ON x.conversation_id = y.conversation_id AND x.candidate_id < y.candidate_id WHERE len(list_intersect(x.e, y.e)) >= 2"""


def _entity_sets(spark, sf_dir):
    """candidate_id, set_id (hash of the sorted distinct entities), e; candidates without entities have no set."""
    sets = table(spark, sf_dir, "memory_candidates").select("candidate_id", F.array_sort(F.array_distinct(F.filter("entities", lambda x: x.isNotNull()))).alias("e")).where("size(e) > 0")
    return sets.select("candidate_id", F.sha2(F.to_json("e"), 256).alias("set_id"), "e")


#: Shares of an entity's sets that meet one another in tasks of their own.
SALTS = 8


def gra_entity_links(spark, sf_dir):
    """Shared-entity links, whole: the pairs of distinct entity sets that share an entity, with their Jaccard likeness.

    Two candidates are linked if their sets (gra_entity_members) are a pair here, whatever their conversations; a set is
    paired with itself if two candidates or more have it. Candidates with equal sets are one set, so that copies make no
    pairs, and the sets of one entity meet in SALTS times SALTS parts, so that a hot entity is spread over many tasks.
    """
    sets = materialize(_entity_sets(spark, sf_dir).groupBy("set_id", "e").agg(F.count("*").alias("members")), "sets")
    one = sets.select(F.col("set_id").alias("a"), F.size("e").alias("na"), F.explode("e").alias("entity"), F.pmod(F.xxhash64("set_id"), F.lit(SALTS)).alias("i"))
    two = one.select(F.col("a").alias("b"), F.col("na").alias("nb"), "entity", F.col("i").alias("j"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>"))
    met = one.withColumn("j", every).join(two.withColumn("i", every), ["entity", "i", "j"]).where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("n"))
    pairs = met.select("a", "b", S.rounded(F.col("n") / (F.col("na") + F.col("nb") - F.col("n"))).alias("jaccard"))
    return pairs.unionAll(sets.where("members > 1").select(F.col("set_id").alias("a"), F.col("set_id").alias("b"), F.lit(1.0).alias("jaccard")))


def gra_entity_members(spark, sf_dir):
    """The candidates of each entity set of gra_entity_links."""
    return _entity_sets(spark, sf_dir).select("set_id", "candidate_id")


QUERIES |= {"gra_entity_links": gra_entity_links, "gra_entity_members": gra_entity_members}
_SETS = "s AS (SELECT candidate_id, list_sort(list_distinct(list_filter(entities, lambda x: x IS NOT NULL))) AS e FROM memory_candidates), k AS (SELECT candidate_id, sha256(to_json(e)::VARCHAR) AS set_id, e FROM s WHERE len(e) > 0)"
SQL["gra_entity_members"] = f"WITH {_SETS} SELECT set_id, candidate_id FROM k"
SQL["gra_entity_links"] = f"""WITH {_SETS}, d AS (SELECT set_id, e, count(*) AS members FROM k GROUP BY 1, 2), u AS (SELECT set_id, len(e) AS n, unnest(e) AS x FROM d), m AS (SELECT p.set_id AS a, q.set_id AS b, p.n AS na, q.n AS nb, count(*) AS c FROM u p JOIN u q ON p.x = q.x AND p.set_id < q.set_id GROUP BY 1, 2, 3, 4)
SELECT a, b, floor(c / (na + nb - c)::DOUBLE * 10000 + 0.5) / 10000.0::DOUBLE AS jaccard FROM m UNION ALL SELECT set_id, set_id, 1.0::DOUBLE FROM d WHERE members > 1"""


def rap_terms(spark, sf_dir):
    """The three terms that tell each source's documents from the others: frequency by log(1 + documents / documents with the term)."""
    d = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    p = retrieval.postings(d, "doc_id", "text").where("length(term) >= 3")
    total = d.agg(F.count("*").alias("n"))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    tf = p.join(d.select(F.col("doc_id").alias("id"), "source"), "id").groupBy("source", "term").agg(F.sum("tf").alias("tf"))
    weight = tf.join(df, "term").crossJoin(F.broadcast(total)).withColumn("weight", F.floor(F.col("tf") * F.log(1 + F.col("n") / F.col("df")) * 1e4 + 0.5) / 1e4)
    w = Window.partitionBy("source").orderBy(F.desc("weight"), "term")
    return weight.withColumn("rank", F.row_number().over(w)).where("rank <= 3").select("source", "term", "weight", "rank")


QUERIES["rap_terms"] = rap_terms
SQL["rap_terms"] = """WITH d AS (SELECT doc_id, source, text FROM documents WHERE text IS NOT NULL AND source IS NOT NULL), t AS (SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM d),
p AS (SELECT * FROM t WHERE length(term) >= 3), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY 1), w AS (SELECT source, term, floor(count(*) * ln(1 + (SELECT count(*) FROM d) / any_value(df)::DOUBLE) * 1e4 + 0.5) / 1e4::DOUBLE AS weight FROM p JOIN df USING (term) GROUP BY 1, 2)
SELECT * FROM (SELECT source, term, weight, row_number() OVER (PARTITION BY source ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 3"""

#: Forms of secrets and network addresses.
SECRETS = {"ipv4": r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.", "pem": "-----BEGIN [A-Z ]*PRIVATE KEY-----", "long_hex": r"\b[0-9a-f]{32,}\b", "key_value": r"(?i)\b(?:api[_-]?key|token|secret|password)\b *[:=] *[^ \n]{8,}"}


def prv_presence(spark, sf_dir):
    """Which kinds of secrets a message shows."""
    m = table(spark, sf_dir, "raw_messages").where("content is not null")
    return m.select("row_id", *(F.col("content").rlike(p).alias(n) for n, p in SECRETS.items())).where(" or ".join(SECRETS))


QUERIES["prv_presence"] = prv_presence
SQL["prv_presence"] = "SELECT * FROM (SELECT row_id, " + ", ".join(f"regexp_matches(content, '{p}') AS {n}" for n, p in SECRETS.items()) + " FROM raw_messages WHERE content IS NOT NULL) WHERE " + " OR ".join(SECRETS)


def lif_versions(spark, sf_dir):
    """Versions after each identifier divisible by 9 was rewritten: the old row ends now and names its successor, the new one begins now."""
    m = memory.memories(spark, sf_dir, False).where("archived_at is null").select("id", "valid_from", "valid_to")
    again = F.col("id") % 9 == 0
    old = m.select("id", "valid_from", F.when(again, memory.now()).otherwise(F.col("valid_to")).alias("valid_to"), F.when(again, -F.col("id") - 1).alias("superseded_by"))
    new = m.where(again).select((-F.col("id") - 1).alias("id"), memory.now().alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to"), F.lit(None).cast("bigint").alias("superseded_by"))
    return old.unionAll(new)


QUERIES["lif_versions"] = lif_versions
SQL["lif_versions"] = memory._M + f""", m AS (SELECT id, valid_from, valid_to FROM memories WHERE archived_at IS NULL) SELECT id, valid_from, CASE WHEN id % 9 = 0 THEN TIMESTAMP '{memory.NOW}' ELSE valid_to END AS valid_to, CASE WHEN id % 9 = 0 THEN -id - 1 END AS superseded_by FROM m
UNION ALL SELECT -id - 1, TIMESTAMP '{memory.NOW}', NULL, NULL FROM m WHERE id % 9 = 0"""


def snk_active(spark, sf_dir):
    """Messages by conversation and ordinal after a later import: what the import does not bring stays, but is not active."""
    m = table(spark, sf_dir, "raw_messages").where("conversation_id is not null and ordinal is not null")
    last = m.groupBy("conversation_id").agg(F.max("imported_at").alias("last_at"))
    best = m.groupBy("conversation_id", "ordinal").agg(F.max(F.struct("imported_at", "row_id")).alias("r"))
    return best.join(last, "conversation_id").select("conversation_id", "ordinal", F.col("r.row_id").alias("row_id"), (F.col("r.imported_at") == F.col("last_at")).alias("is_active"))


QUERIES["snk_active"] = snk_active
SQL["snk_active"] = """SELECT conversation_id, ordinal, arg_max(row_id, (imported_at, row_id)) AS row_id, max(imported_at) = any_value(last_at) AS is_active FROM (SELECT *, max(imported_at) OVER (PARTITION BY conversation_id) AS last_at FROM raw_messages
WHERE conversation_id IS NOT NULL AND ordinal IS NOT NULL) GROUP BY 1, 2"""
