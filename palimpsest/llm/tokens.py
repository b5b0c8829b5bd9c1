"""Encoding of a corpus with a public tokenizer, each repeated chunk of text once.

Texts are cut at content-defined places: where a rolling hash over the last characters has a given residue, so the same
passage is cut in the same way wherever it stands. Distinct chunks are shuffled and encoded once. Around each joint, text
is encoded again from a true pre-token boundary on the left until the new boundaries agree with the right chunk's own.
From a common boundary on, both read the same text from the same place, so the result is exactly that of encoding the
whole text; where no common boundary turns up, the whole text is one chunk.

A joint's repair needs the text about it only, so it is worked out where the text is read: the ids to put in, and how many
to leave out on either side. After that only hashes, repairs and ids travel, and for ``lengths`` no ids. Chunks that more
than one row in HOT uses (at most HOT chunks, so their keys are broadcast) are met in SALTS parts.

Defined results: null and empty text give the empty list; every row of the input gives one row (also repeated ones);
any Unicode text is encoded, strings that look like special tokens as ordinary text.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.util import materialize

TOKENIZERS = "/opt/tokenizers"
#: Pre-token pattern of the byte-level vocabularies (a fixed value of the format).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WINDOW, MEAN, NEAR = 16, 256, 24
HOT, SALTS = 1_000, 64


@lru_cache(4)
def encoder(name: str, folder: str) -> tiktoken.Encoding:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_PRE = regex.compile(PATTERN)
#: A single space between two characters that are no space: every reading of the text that starts before it begins a pre-token there.
_SAFE = regex.compile(r"(?<=\S) (?=\S)")


def cuts(text: str, mean: int = MEAN) -> list[int]:
    """Content-defined ends of chunks, the last at the end of the text. About ``mean`` characters apart; no chunk is forced.

    A cut moves on to the next single space if one is near, as most such joints need no repair.
    """
    n = len(text)
    if n <= mean:
        return [n] if n else []
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):  # a polynomial over the last WINDOW characters, modulo 2**64
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : n - WINDOW + 1 + k]
    ends = []
    for at in (np.flatnonzero((h >> np.uint64(40)) % np.uint64(mean) == 0) + WINDOW).tolist():
        m = _SAFE.search(text, at, at + NEAR)
        at = m.start() if m else at
        if at < n and (not ends or at > ends[-1]):
            ends.append(at)
    return [*ends, n]


def pieces(text: str, ends: list[int], enc: tiktoken.Encoding) -> list[tuple[int, int, list[int], int, int]]:
    """start, end of each chunk, and how its ids enter the whole: ids before them, ids left out at their start and at their end."""
    out, used, start = [[0, ends[0], [], 0, 0]], 0, 0
    for joint, stop in zip(ends, ends[1:], strict=False):
        if _SAFE.match(text, joint):
            out.append([joint, stop, [], 0, 0])
            used, start = joint, joint
            continue
        # A true boundary left of the joint, inside what comes from the chunk before.
        begin = None
        for m in _SAFE.finditer(text, max(used, start, joint - 4 * NEAR), joint):
            begin = m.start()
        if begin is None and used == 0 == start and joint <= 4 * NEAR:
            begin = 0
        agree = _agree(text, begin, joint, stop) if begin is not None else None
        if agree is None:
            return [(0, len(text), [], 0, 0)]
        out[-1][4] = len(enc.encode_ordinary(text[begin:joint]))
        out.append([joint, stop, enc.encode_ordinary(text[begin:agree]), len(enc.encode_ordinary(text[joint:agree])), 0])
        used, start = agree, joint
    return [tuple(x) for x in out]


def join(text: str, ends: list[int], parts: list[list[int]], enc: tiktoken.Encoding) -> list[int]:
    """ids of the whole text from those of its chunks, repaired at each joint."""
    found = pieces(text, ends, enc)
    if len(found) < len(parts):
        return enc.encode_ordinary(text)
    return [x for (_, _, put, skip, drop), ids in zip(found, parts, strict=True) for x in (*put, *ids[skip : len(ids) - drop])]


def _agree(text: str, begin: int, joint: int, stop: int) -> int | None:
    """First place after the joint, inside the right chunk, that ends a pre-token (not of space) both for the whole text and for the chunk alone."""
    whole, alone = _PRE.finditer(text, begin), _PRE.finditer(text[joint:stop])
    a, b = next(whole).end(), next(alone).end() + joint
    while a < stop and b < stop:
        if a == b and not text[a - 1].isspace() and _edge(text, a):
            return a
        if a <= b:
            a = next(whole).end()
        else:
            b = next(alone).end() + joint
    return None


def _edge(text: str, at: int) -> bool:
    """Whether text up to ``at`` read alone ends its last pre-token as the longer text does."""
    return text[at].isspace()


def _key(chunk: str) -> tuple[int, int]:
    return struct.unpack("<qq", xxhash.xxh3_128_digest(chunk.encode("utf-8", "surrogatepass")))


def _chunks(docs: DataFrame, text: str, name: str, folder: str, mean: int) -> DataFrame:
    """c1, c2, chunk, uses of the chunks of all texts, each once for every batch that is read."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            uses: dict[str, int] = {}
            for t in batch.column(0).to_pylist():
                for a, b, *_ in pieces(t, cuts(t, mean), enc):
                    uses[t[a:b]] = uses.get(t[a:b], 0) + 1
            keys = [_key(c) for c in uses]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(list(uses), pa.string()), pa.array(list(uses.values()), pa.int64())], ["c1", "c2", "chunk", "uses"])

    return docs.select(text).mapInArrow(cut, "c1 bigint, c2 bigint, chunk string, uses bigint")


def _dictionary(docs: DataFrame, text: str, name: str, folder: str, mean: int, whole: bool) -> DataFrame:
    """c1, c2, uses, n (number of ids) and, if ``whole``, ids of each distinct chunk, encoded once."""
    once = _chunks(docs, text, name, folder, mean).groupBy("c1", "c2").agg(F.first("chunk").alias("chunk"), F.sum("uses").alias("uses"))

    def encode_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            ids = [enc.encode_to_numpy(c, disallowed_special=()) for c in batch.column("chunk").to_pylist()]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            columns = [batch.column("c1"), batch.column("c2"), batch.column("uses"), pa.array(sizes)]
            if whole:
                values = np.concatenate([*ids, np.zeros(0, np.uint32)]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values)))
            yield pa.RecordBatch.from_arrays(columns, ["c1", "c2", "uses", "n", "ids"][: len(columns)])

    return once.mapInArrow(encode_batch, "c1 bigint, c2 bigint, uses bigint, n int" + (", ids array<int>" if whole else ""))


def _placed(docs: DataFrame, text: str, name: str, folder: str, mean: int) -> DataFrame:
    """row, pos, c1, c2, put, skip, drop of each chunk of each row, and at pos 0 the row's other columns as ``rest``."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"), (F.struct(*rest) if rest else F.struct(F.lit(0).alias("none"))).alias("rest"))
    kept = rows.schema["rest"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            at, pos, c1, c2, put, skip, drop = [], [], [], [], [], [], []
            for i, t in enumerate(batch.column("text").to_pylist()):
                for p, (a, b, before, first, last) in enumerate(pieces(t, cuts(t, mean), enc)):
                    k = _key(t[a:b])
                    at.append(i), pos.append(p), c1.append(k[0]), c2.append(k[1]), put.append(before or None), skip.append(first), drop.append(last)  # noqa: B018
            rows_of = batch.column("row").take(pa.array(at, pa.int64()))
            rest_of = batch.column("rest").take(pa.array([i if p == 0 else None for i, p in zip(at, pos, strict=True)], pa.int64()))
            ints = [pa.array(x, t) for x, t in ((pos, pa.int32()), (c1, pa.int64()), (c2, pa.int64()), (put, pa.list_(pa.int32())), (skip, pa.int32()), (drop, pa.int32()))]
            yield pa.RecordBatch.from_arrays([rows_of, *ints, rest_of], ["row", "pos", "c1", "c2", "put", "skip", "drop", "rest"])

    return rows.mapInArrow(place, f"row bigint, pos int, c1 bigint, c2 bigint, put array<int>, skip int, drop int, rest {kept}")


def _met(docs: DataFrame, text: str, name: str, folder: str, mean: int, whole: bool) -> DataFrame:
    """The chunks of ``_placed`` with what ``_dictionary`` knows of them."""
    found = materialize(_dictionary(docs, text, name, folder, mean, whole), "chunks")
    placed = _placed(docs, text, name, folder, mean)
    least = (found.agg(F.sum("uses")).first()[0] or 0) / HOT
    hot = found.where(F.col("uses") > max(least, 10_000)).select("c1", "c2")  # at most HOT rows
    if not hot.head(1):
        return placed.join(found, ["c1", "c2"])
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    placed = placed.join(F.broadcast(hot.withColumn("hot", F.lit(True))), ["c1", "c2"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot")
    cold = found.join(F.broadcast(hot), ["c1", "c2"], "left_anti").withColumn("salt", F.lit(0))
    return placed.join(cold.unionByName(found.join(F.broadcast(hot), ["c1", "c2"]).select("*", salts)), ["c1", "c2", "salt"])


def _answer(docs: DataFrame, text: str, out: str, value: Column, empty: Column, met: DataFrame) -> DataFrame:
    """The rows of docs without the text and with ``value`` over their chunks, ``empty`` for null and empty texts."""
    rest = [c for c in docs.columns if c not in (text, out)]
    filled = met.groupBy("row").agg(F.first("rest", ignorenulls=True).alias("rest"), value.alias(out)).select(*(F.col(f"rest.`{c}`").alias(c) for c in rest), out)
    none = docs.where(F.coalesce(F.length(text), F.lit(0)) == 0).select(*rest, empty.alias(out))
    return filled.unionAll(none)


def encode(docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, mean: int = MEAN) -> DataFrame:
    """docs without the text and with ids ARRAY<INT> (in place of a column of that name)."""
    full = docs.where(F.length(text) > 0)
    part = F.concat(F.coalesce("put", F.array().cast("array<int>")), F.slice("ids", F.col("skip") + 1, F.col("n") - F.col("skip") - F.col("drop")))
    value = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", part.alias("part")))), lambda x: x["part"]))
    return _answer(docs, text, "ids", value, F.array().cast("array<int>"), _met(full, text, name, folder, mean, True))


def lengths(docs: DataFrame, text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, mean: int = MEAN) -> DataFrame:
    """docs without the text and with n_tokens BIGINT, the size of what ``encode`` gives; no ids are shuffled."""
    full = docs.where(F.length(text) > 0)
    value = F.sum(F.coalesce(F.array_size("put"), F.lit(0)) + F.col("n") - F.col("skip") - F.col("drop"))
    return _answer(docs, text, "n_tokens", value, F.lit(0).cast("bigint"), _met(full, text, name, folder, mean, False))
