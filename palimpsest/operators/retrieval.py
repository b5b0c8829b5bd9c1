"""Batches of free-text queries against documents: BM25, exact cosine, reciprocal rank fusion, diversity.

All queries of a batch are answered by one plan: blocks of queries meet blocks of documents or vectors, a pair of blocks
a task, and only the best rows of each query leave a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.util import materialize

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), 1)


def postings(docs: DataFrame, key: str, text: str) -> DataFrame:
    """term, id, tf, len."""
    words = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    return words.select("id", F.size("w").alias("len"), F.explode("w").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


#: Most documents and characters of a block of documents, and most words of the queries that meet it in one task.
DOC_BLOCK, CHAR_BLOCK, ASKED_BLOCK = 32_768, 1 << 25, 1 << 22


def blocks(rows: int, most: int, least: int = 2_048, spark: SparkSession | None = None) -> int:
    """Blocks of at most ``most`` rows each; more of them, down to ``least`` rows, where that keeps all cores busy."""
    cores = (spark or SparkSession.active()).sparkContext.defaultParallelism
    return max(-(-rows // most), min(2 * cores, -(-rows // least)), 1)


def stacked(parts: list[DataFrame], n: int, part: str) -> DataFrame:
    """Tables of different columns as one, in which each number of ``part`` is a partition of its own; missing columns are null."""
    every = parts[0]
    for other in parts[1:]:
        every = every.unionByName(other, allowMissingColumns=True)
    return every.repartitionById(n, F.col(part))


def whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def column(t: pa.Table, name: str) -> pa.Array:
    c = t[name].combine_chunks()
    return c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks else pa.array([], c.type) if isinstance(c, pa.ChunkedArray) else c


def lists(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), values)


def numbered(ids: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each identifier among the distinct ones, which are in order, null last."""
    order = pc.sort_indices(ids, null_placement="at_end")
    s = ids.take(order)
    new = np.ones(len(s), bool)
    if len(s) > 1:
        alike = pc.or_kleene(pc.equal(s[1:], s[:-1]), pc.and_(pc.is_null(s[1:]), pc.is_null(s[:-1])))
        new[1:] = ~alike.fill_null(False).to_numpy(zero_copy_only=False)
    number = np.empty(len(s), np.int64)
    number[order.to_numpy()] = np.cumsum(new) - 1
    return number, s.filter(pa.array(new))


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of documents as postings of the terms asked for, one row a term, and one row (term null) of its documents.

    An entry is an identifier with a length: documents that share both count as one, as they do in the statistics.
    """
    t = whole(batches)
    if t is None:
        return
    vocabulary, kept, keeps, block = column(t, "term").drop_null(), t.filter(pc.is_valid(t["kept"])), t["keeps"][0].as_py(), t["block"][0].as_py()
    docs = t.select(["id", "words"]).filter(pc.is_valid(t["words"]))
    del t
    words = column(docs, "words")
    size = np.diff(words.offsets.to_numpy()).astype(np.int64)
    owner, ids = numbered(column(docs, "id"))
    longest = int(size.max(initial=0)) + 1
    pairs, entry = np.unique(owner * longest + size, return_inverse=True)
    of_entry, lengths, many = pairs // longest, pairs % longest, max(len(pairs), 1)
    code = pc.index_in(words.flatten(), value_set=vocabulary).fill_null(-1).to_numpy()
    del docs, words
    asked = code >= 0
    found = code[asked].astype(np.int64) * many + np.repeat(entry.astype(np.int32), size)[asked]
    del code, asked
    found, tf = np.unique(found, return_counts=True)
    code, at = found // many, found % many
    del found
    df = np.bincount(code, minlength=len(vocabulary))
    if keeps:
        good = pc.is_in(ids, value_set=column(kept, "id").drop_null(), skip_nulls=True).to_numpy(zero_copy_only=False)[of_entry[at]]
        code, at, tf = code[good], at[good], tf[good]
    seen = np.flatnonzero(df)
    counts = np.bincount(code, minlength=len(vocabulary))[seen]
    n = len(seen)
    ints = lambda x: pa.array(x.astype(np.int32))
    none = lambda kind, m: pa.nulls(m, pa.list_(kind))
    names = ["block", "term", "df", "at", "tf", "id", "owner", "len", "n", "total"]
    yield pa.RecordBatch.from_arrays([ints(np.full(n, block)), vocabulary.take(pa.array(seen)), pa.array(df[seen].astype(np.int64)), lists(counts, ints(at)), lists(counts, ints(tf)), none(ids.type, n), none(pa.int32(), n), none(pa.int32(), n), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
    one = lambda x: lists(np.array([len(x)]), x)
    yield pa.RecordBatch.from_arrays([ints(np.array([block])), pa.nulls(1, vocabulary.type), pa.nulls(1, pa.int64()), none(pa.int32(), 1), none(pa.int32(), 1), one(ids), one(ints(of_entry)), one(ints(lengths)), pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])], names)


def best(score: np.ndarray, k: int) -> np.ndarray:
    """The places of the k greatest scores above 0, rounded to six digits, the earlier place first among equals."""
    floor, width = 0.0, len(score) // max(4 * k, 64)
    if width > 4:  # the k-th greatest of the greatest of each strip is a lower bound of the k-th greatest
        tops = score[: width * (len(score) // width)].reshape(-1, width).max(1)
        floor = np.partition(tops, len(tops) - k)[len(tops) - k]
    at = np.flatnonzero(score >= floor - 2e-6) if floor > 2e-6 else np.flatnonzero(score > 0)
    return at[np.lexsort((at, -rounded(score[at])))[:k]]


def rounded(score: np.ndarray) -> np.ndarray:
    return np.floor(score * 1e6 + 0.5) / 1e6


def _score(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best documents of a block for each query that meets it."""
        t = whole(batches)
        if t is None:
            return
        asked, index, docs = t.filter(pc.is_valid(t["words"])), t.filter(pc.is_valid(t["term"])), t.filter(pc.is_valid(t["owner"]))
        del t
        if not len(asked) or not len(index):
            return
        ids, owner, lengths = column(docs, "id").flatten(), column(docs, "owner").flatten().to_numpy(), column(docs, "len").flatten().to_numpy()
        lists_at, terms = column(index, "at"), column(index, "term")
        at, tf, ends = lists_at.flatten().to_numpy(), column(index, "tf").flatten().to_numpy().astype(float), np.r_[0, np.cumsum(np.diff(lists_at.offsets.to_numpy()))]
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[at] / asked["mean_len"][0].as_py()))
        at, many = owner[at].astype(np.int64), len(ids)
        del tf, lists_at, index, docs
        if many < len(owner):  # entries of one document: their parts are added
            pairs, back = np.unique(np.repeat(np.arange(len(terms)), np.diff(ends)) * many + at, return_inverse=True)
            part, at, ends = np.bincount(back, part, len(pairs)), pairs % many, np.r_[0, np.cumsum(np.bincount(pairs // many, minlength=len(terms)))]
        full, each = {}, np.diff(ends)
        for i in np.flatnonzero(each * 8 > many):  # common terms: a value for every document
            full[i] = np.zeros(many)
            full[i][at[ends[i] : ends[i + 1]]] = part[ends[i] : ends[i + 1]]
        rare = each * 8 <= many
        at, part, ends = at[np.repeat(rare, each)], part[np.repeat(rare, each)], np.r_[0, np.cumsum(each * rare)]
        words = column(asked, "words")
        code, weight, stops = pc.index_in(words.flatten(), value_set=terms).fill_null(-1).to_numpy(), column(asked, "weights").flatten().to_numpy(), np.r_[0, np.cumsum(np.diff(words.offsets.to_numpy()))]
        picked, scores, counts = [], [], np.zeros(len(asked), np.int64)
        score, product = np.zeros(many), np.zeros(many)
        for q in range(len(asked)):
            score[:] = 0
            for j in range(stops[q], stops[q + 1]):
                if (i := code[j]) >= 0:
                    if i in full:
                        np.multiply(full[i], weight[j], out=product)
                        np.add(score, product, out=score)
                    else:
                        score[at[ends[i] : ends[i + 1]]] += weight[j] * part[ends[i] : ends[i + 1]]
            top = best(score, k)
            picked.append(top)
            scores.append(rounded(score[top]))
            counts[q] = len(top)
        hit = np.flatnonzero(counts)
        flat = lambda x: np.concatenate(x) if x else np.zeros(0)
        yield pa.RecordBatch.from_arrays([column(asked, "query_id").take(pa.array(hit)), lists(counts[hit], ids.take(pa.array(flat(picked).astype(np.int64)))), lists(counts[hit], pa.array(flat(scores)))], ["query_id", "ids", "scores"])

    return run


def bm25(docs: DataFrame, queries: DataFrame, k: int, key: str = "doc_id", text: str = "text", keep: DataFrame | None = None) -> DataFrame:
    """query_id, id, score, rank of the k best documents of each query (query_id, query). A repeated term counts twice; negative idf is a millionth.

    With ``keep`` (id) only these are answers; the others still count in the statistics.

    Documents are put in blocks by their identifier and each block is indexed once, for the terms asked for. Then every
    query meets every block, and a block gives at most k rows a query; no sum over a term's postings is shuffled.
    """
    spark = docs.sparkSession
    kinds = {"id": docs.schema[key].dataType.simpleString(), "query_id": queries.schema["query_id"].dataType.simpleString()}
    texts = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    size = texts.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    n = max(blocks(size.n, DOC_BLOCK, spark=spark), -(-size.chars // CHAR_BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias("block")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = materialize(asked, "asked")
    parts = [texts.select(block, "id", "text"), asked.select("term").distinct().select(every(n).alias("block"), "term")]
    if keep is not None:
        parts.append(keep.select(F.col("id").cast(kinds["id"])).select(block, "id", F.lit(True).alias("kept")))
    else:
        parts[0] = parts[0].withColumn("kept", F.lit(None).cast("boolean"))
    rows = stacked(parts, n, "block").select("block", "id", "term", "kept", tokens(F.col("text")).alias("words"), F.lit(keep is not None).alias("keeps"))
    index = rows.mapInArrow(_index, f"block int, term string, df bigint, at array<int>, tf array<int>, id array<{kinds['id']}>, owner array<int>, len array<int>, n bigint, total bigint")
    index = materialize(index, "index")
    stats = index.agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean_len"))
    df = index.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = asked.join(df, "term").crossJoin(F.broadcast(stats))  # stats: one row
    weighed = weighed.select("query_id", "term", "mean_len", (F.when(idf > 0, idf).otherwise(1e-6) * F.col("times")).alias("weight"))
    weighed = weighed.groupBy("query_id").agg(F.first("mean_len").alias("mean_len"), F.collect_list(F.struct("term", "weight")).alias("w"))
    m = max(-(-asked.count() // ASKED_BLOCK), 1)
    left = index.withColumn("q", every(m)).select((F.col("block") * m + F.col("q")).alias("part"), "term", "at", "tf", "id", "owner", "len")
    right = weighed.withColumn("block", every(n)).select((F.col("block") * m + F.pmod(F.xxhash64("query_id"), F.lit(m)).cast("int")).alias("part"), "query_id", "mean_len", F.col("w.term").alias("words"), F.col("w.weight").alias("weights"))
    found = stacked([left, right], n * m, "part").mapInArrow(_score(k), f"query_id {kinds['query_id']}, ids array<{kinds['id']}>, scores array<double>")
    return ranked(listed(found), k)


def listed(found: DataFrame) -> DataFrame:
    """query_id, id, score from rows of lists (query_id, ids, scores), shuffled as lists."""
    pairs = found.repartition("query_id").select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x"))
    return pairs.select("query_id", F.col("x.ids").alias("id"), F.col("x.scores").alias("score"))


DIMENSIONS = 64


def _embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        b = b.filter(pc.greater(pc.list_value_length(b["words"]), 0))
        words = b["words"]
        size = np.diff(words.offsets.to_numpy())
        terms = words.flatten().dictionary_encode()
        sums = [hashlib.md5(x.encode()).digest() for x in terms.dictionary.to_pylist()]
        dim, sign = np.array([x[0] % DIMENSIONS for x in sums], np.int64), np.array([1.0 - 2 * (x[1] >> 4 & 1) for x in sums])
        code = terms.indices.to_numpy()
        at = np.repeat(np.arange(b.num_rows), size) * DIMENSIONS + dim[code]
        vec = np.bincount(at, sign[code], b.num_rows * DIMENSIONS)
        yield pa.RecordBatch.from_arrays([b["id"], lists(np.full(b.num_rows, DIMENSIONS), pa.array(vec))], ["id", "vec"])


def embedded(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, vec: texts as sums of signed unit vectors, one a word, by hashes of the words; the same in every engine, no model needed. Texts of one identifier are added."""
    words = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("id"), tokens(F.col(text)).alias("words"))
    each = words.mapInArrow(_embed, f"id {docs.schema[key].dataType.simpleString()}, vec array<double>")
    together = F.aggregate("all", F.array_repeat(F.lit(0.0), DIMENSIONS), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return each.groupBy("id").agg(F.collect_list("vec").alias("all")).select("id", F.when(F.size("all") == 1, F.get("all", F.lit(0))).otherwise(together).alias("vec"))


#: Most queries and vectors that meet in one task.
QUERY_BLOCK, VECTOR_BLOCK = 32_768, 32_768


def _unit(vectors: pa.Array) -> np.ndarray:
    sizes = np.diff(vectors.offsets.to_numpy())
    if vectors.null_count or len(sizes) and sizes.min() != sizes.max():
        raise ValueError("vectors must have one length")
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(vectors), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _meet(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k nearest vectors of a block for each query that meets it, ties with the k-th too."""
        t = whole(batches)
        if t is None:
            return
        bases, asked = t.filter(pc.is_valid(t["vec"])), t.filter(pc.is_valid(t["qvec"]))
        if not len(bases) or not len(asked):
            return
        ids, names, b = column(bases, "id"), column(asked, "query_id"), _unit(column(bases, "vec"))
        same = pc.index_in(names, value_set=ids).fill_null(-1).to_numpy() if names.type == ids.type else np.full(len(names), -1)
        twice = len(set(ids.to_pylist())) < len(ids) if (same >= 0).any() else False
        seen, queries = b.any(1), _unit(column(asked, "qvec"))
        width = len(b) // max(4 * k, 64)
        for at in range(0, len(asked), 128):
            q = queries[at : at + 128]
            score = q @ b.T
            score[:, ~seen] = score[~q.any(1)] = -np.inf
            score[np.isnan(score)] = -np.inf
            own = same[at : at + 128]
            if twice:
                for x in np.flatnonzero(own >= 0):
                    score[x, pc.equal(ids, names[at + int(x)]).fill_null(False).to_numpy(zero_copy_only=False)] = -np.inf
            else:
                score[np.flatnonzero(own >= 0), own[own >= 0]] = -np.inf
            tops = score if width < 5 else score[:, : width * (len(b) // width)].reshape(len(q), -1, width).max(2)
            last = max(tops.shape[1] - k, 0)
            floor = np.partition(tops, last, 1)[:, last]  # at most the k-th greatest
            i, j = np.nonzero((score >= floor[:, None] - 2e-6) & (score > -np.inf))
            s = rounded(score[i, j])
            order = np.lexsort((-s, i))
            i, j, s = i[order], j[order], s[order]
            counts = np.bincount(i, minlength=len(q))
            first = np.r_[0, np.cumsum(counts)[:-1]]
            kth = np.where(counts > k, s[np.minimum(first + k - 1, max(len(s) - 1, 0))] if len(s) else 0.0, -np.inf)
            good = s >= kth[i]
            i, j, s = i[good], j[good], s[good]
            counts = np.bincount(i, minlength=len(q))
            hit = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(at + hit)), lists(counts[hit], ids.take(pa.array(j))), lists(counts[hit], pa.array(s))], ["query_id", "ids", "scores"])

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank of the k nearest vectors (id, vec) to each query (query_id, qvec) by cosine, exactly; the queries are a stated set.

    Blocks of queries meet blocks of vectors, one pair of blocks a task, and each gives at most k rows a query (and ties),
    so neither side is broadcast or held whole. A query never finds the vector of its own identifier; zero vectors find
    nothing and are not found; vectors must have one length.
    """
    spark = vectors.sparkSession
    of_queries, of_vectors = -(-max(queries.count(), 1) // QUERY_BLOCK), blocks(vectors.count(), VECTOR_BLOCK, spark=spark)
    kinds = {f.name: f.dataType.simpleString() for f in [*vectors.schema, *queries.schema]}
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("q", every(of_queries)).select((block("id", of_vectors) * of_queries + F.col("q")).alias("part"), "id", "vec")
    right = queries.withColumn("v", every(of_vectors)).select((F.col("v") * of_queries + block("query_id", of_queries)).alias("part"), "query_id", "qvec")
    found = stacked([left, right], of_vectors * of_queries, "part").mapInArrow(_meet(k), f"query_id {kinds['query_id']}, ids array<{kinds['id']}>, scores array<double>")
    return ranked(listed(found), k)


def ranked(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fuse(lists: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, id, rank): sum of 1 / (c + rank); ties by the earlier list, then the better rank."""
    every = None
    for i, one in enumerate(lists):
        part = one.select("query_id", "id", (1.0 / (c + F.col("rank"))).alias("s"), F.struct(F.lit(i).alias("l"), F.col("rank").alias("r")).alias("first"))
        every = part if every is None else every.unionAll(part)
    total = every.groupBy("query_id", "id").agg((F.floor(F.sum("s") * 1e9 + 0.5) / 1e9).alias("score"), F.min("first").alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first", "id")
    return total.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "id", "score", "rank")
