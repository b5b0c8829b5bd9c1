"""Keyword-stuffed and link-list pages: pointwise mutual information of neighbouring words, repeated collocations, then an exact look.

``statistics`` counts all pairs of neighbouring words over the corpus, each distinct text once. In a text, a pair is
incoherent if no other text has it, or if its normalised PMI (without the text's own share of the counts) is under NORMAL
times the mean of the corpus; it is overdone if the text says it again and again. Word salad, lists of unrelated links and
products consist of the first, stuffed keywords of the second. Texts with SUSPECT of their pairs in either are suspects.

``stuffed`` takes an exact look at the form of the suspects, and of no other text: what share of their words stands in
sentences, and what share in keywords, bare links, tags, attributes and offers.

Pairs are counted in numpy before they are shuffled, so a pair that a third of all texts hold is one row of each batch.
The KNOWN commonest pairs (a bound, whatever the corpus) are broadcast and looked up where a text is read; the others are
joined through a shuffle, and as they are rare, no key of that join is hot. Every text is counted and judged whole.

Defined results: null, empty and blank texts, and texts without two words, are never spam; equal texts get the same
answer, and copies don't change the statistics; zero-width characters and case make no difference; an empty table gives
an empty result; every row gives at most one row; other columns are not read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.util import discard, materialize

#: Share of the corpus's mean normalised PMI under which a pair is incoherent; share of such or overdone pairs that makes a suspect.
NORMAL, SUSPECT = 0.75, 0.35
#: A pair is overdone from this many uses and this share of a text's pairs on.
AGAIN, OFTEN = 2, 0.03
#: Pairs that are broadcast (24 bytes each), and pairs that a task holds before it hands counts on.
KNOWN, HELD = 250_000, 2_000_000
#: Parts into which the pairs of one word are split for the join with the count of that word.
SALTS = 16
HIDDEN = re.compile("[\u200b-\u200f\u2060\ufeff\u00ad]")
#: Tokens: runs of letters, numbers (all one token), line ends and signs; links are one token each, all the same.
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|[_\n]")
_HINT = re.compile(r"//|www\.|\.(?:example|test|invalid|com|org|net|info|biz|shop)|\.[a-z]{2}/")
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)

#: Words that hold sentences together, in English, German, Spanish and French.
GLUE = frozenset(
    """the a an and or but is are was were be been it its it's this that these those of to in on at by for with from as than then when we i you they my our your their he she
    who what why how not no nothing don't i've i'd that's they'd can would should could will has have had do did does so if because about before after while until there here which
    der die das den dem des ein eine einen einem einer und oder aber ist sind war waren wird werden es sie er wir ich du ihr mein meine unser unsere dass daß zu im in an auf bei mit von vom für aus nach vor
    nicht kein keine niemand warum wie was wenn denn auch so sich hat haben hatte lieber bitte also noch seit zum zur bis je doch nur über
    el la los las un una unos unas y o pero es son era fue está están ha han lo le se me mi nuestro su sus que de del al en con por para sin no ni nadie quiso como cuando si así antes después desde sobre muy más ya sigue quedó
    le la les un une des du et ou mais est sont était a ont il elle nous vous je on ce cette ces que qui de d' l' en dans sur avec pour par sans pas ne n'a rien personne comme quand si donc avant après depuis mon ma notre sa son reste""".split()
)
_WORDS = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_LINK = re.compile(r"(?:https?://|www\.)\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:(?:example|test|invalid|com|org|net|info|biz|shop)(?:/\S*)?|[a-z]{2}/\S+)(?![\w@])", re.I)
_ATTRIBUTE = re.compile(r"(?:^|[\s,;|])(?:tag:|#[^\W\d_]|\w+=(?!=)|\[[^\]\n]{2,60}\])|[^\W\d_]_[^\W\d_]", re.I)
_OFFER = re.compile(r"★|\d[.,]\d\d ?(?:€|\$|£|eur|usd)|(?:€|\$|£) ?\d|\bsku\b|\b\d(?:\.\d)?/5\b|-\d\d ?%", re.I)
_CODE = re.compile(r"[{}();]\s*$|^\s+\w+\([^)]*\)|^\w*(?:Error|Exception)\b|^\s*(?:def|class|return|import|for|if|File|Traceback)\b.*[:()\"]|^\s*\"[^\"]*\":|^\s*[\w.]+ = \S")
_LOG = re.compile(r"^\s*(?:\d{4}-\d\d-\d\d[ T]\d\d:\d\d|\d+(?:[.,]\d+)?\s*[|;,\t])")
_END = re.compile(r"[.!?…][\"”)]*\s*$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"”)]*\s+|\n+| [•|>›»/*] | :: | - |;\s|\t")


def share_of_spam(text: str) -> tuple[float, float]:
    """Characters of words in spam forms, and in sentences, code, logs, tables and settings."""
    text = HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    linked_text = _HINT.search(text.lower()) is not None
    words = [w.lower() for w in _WORDS.findall(_LINK.sub(" ", text) if linked_text else text)]
    pairs = Counter(zip(words, words[1:], strict=False))
    # Words that a document says far oftener than sentences say any content word.
    often = {w for w, n in Counter(words).items() if w not in GLUE and n >= max(5, 0.05 * len(words))}
    stuffed = {p for p, n in pairs.items() if n >= max(4, 0.03 * len(words)) and not (p[0] in GLUE and p[1] in GLUE)}
    spam = prose = 0.0
    for line in text.split("\n"):
        no_link = not (linked_text and _LINK.search(line))
        if no_link and _LOG.match(line) and sum(c.isdigit() for c in line) > 0.3 * len(line):
            prose += len(line)
            continue
        if no_link and _CODE.search(line) and not _OFFER.search(line):
            prose += len(line)
            continue
        for part in _SPLIT.split(line):
            links = [] if no_link else [m.group() for m in _LINK.finditer(part)]
            plain = _LINK.sub(" ", part) if links else part
            own = [w.lower() for w in _WORDS.findall(plain)]
            size, n = sum(map(len, own)), len(own)
            linked = sum(map(len, links))
            if not n and not links:
                continue
            glue = sum(w in GLUE or (n >= 5 and w.split("'")[0] + "'" in GLUE) for w in own) / max(n, 1)
            content = [w for w in own if w not in GLUE]
            again = 1 - len(set(content)) / max(len(content), 1)
            keyed = sum(w in often for w in own) / max(n, 1)
            twice = sum(p in stuffed for p in zip(own, own[1:], strict=False)) / max(n - 1, 1)
            if len(_ATTRIBUTE.findall(part)) > 0.15 * max(n, 1) or (_OFFER.search(part) and n <= 9 and glue < 0.2) or (links and n < 5 * len(links) and glue < 0.3) or (len(links) > 2 and n < 8 * len(links)):
                spam += size + linked
            elif n >= 5 and glue > 0 and (_END.search(part) or (glue >= 0.15 and len({w for w in own if w in GLUE}) >= 2)):
                if again > 0.2 and (glue < 0.22 or keyed >= 0.4 or twice >= 0.34):
                    spam += size + linked
                else:
                    prose += size + linked
            elif n >= 5 or glue < 0.5:
                spam += size + linked
    return spam, prose


def _enough(text: str) -> bool:
    """Whether there are two words or links."""
    return len(_WORDS.findall(_LINK.sub(" ", text))) + len(_LINK.findall(text)) > 1


class _Names(dict):
    """Number of each token seen by a task, in order; ``hashes`` holds their hashes."""

    def __init__(self) -> None:
        self.hashes: list[int] = []

    def __missing__(self, token: str) -> int:
        self.hashes.append(xxhash.xxh64_intdigest("#" if token[0].isdigit() else token))
        self[token] = len(self)
        return self[token]


def _tokens(text: str) -> list[str]:
    text = HIDDEN.sub("", text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower())
    return _TOKEN.findall(_LINK.sub(" \N{BALLOT BOX} ", text) if _HINT.search(text) else text)


def _tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with w, the hashes of the tokens of each text."""
    names = _Names()
    for batch in batches:
        if len(names) > 1_000_000:  # hashes are the same again, so this only bounds memory
            names = _Names()
        parts = [np.fromiter(map(names.__getitem__, t), np.int64, len(t)) for t in map(_tokens, batch.column("text").to_pylist())]
        values = np.array(names.hashes, np.uint64).view(np.int64)[np.concatenate([*parts, np.zeros(0, np.int64)])]
        ends = np.cumsum([0, *map(len, parts)])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], [*batch.schema.names, "w"])


def _pairs(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash, left and right token of each pair of neighbouring tokens of a batch."""
    ends = column.offsets.to_numpy()
    w = column.values.to_numpy()[ends[0] : ends[-1]]
    own = np.repeat(np.arange(len(column)), np.diff(ends))
    same = own[1:] == own[:-1]
    a, b = w[:-1][same], w[1:][same]
    return own[1:][same], (a.view(np.uint64) * _MIX[0] + b.view(np.uint64) * _MIX[1]).view(np.int64), a, b


def _merged(parts: list[tuple]) -> tuple[np.ndarray, ...]:
    h, a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, first, at = np.unique(h, return_index=True, return_inverse=True)
    return u, a[first], b[first], np.bincount(at, n, len(u)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, a, b, n of the pairs, added up over as many batches as HELD allows."""
    parts, size = [], 0
    out = lambda p: pa.RecordBatch.from_arrays([pa.array(x) for x in p], list("habn"))
    for batch in batches:
        _, h, a, b = _pairs(batch.column("w"))
        parts.append(_merged([(h, a, b, np.ones(len(h)))]))
        size += len(parts[-1][0])
        if size > HELD:
            parts = [_merged(parts)]
            size = len(parts[0][0])
            if size > HELD // 2:  # little was repeated: hand it on
                yield out(parts[0])
                parts, size = [], 0
    if parts:
        yield out(_merged(parts))


def _npmi(c, e, total):
    """Normalised PMI of pairs with count c and product e of the counts of their two words, of total pairs; numpy or columns."""
    log = np.log if isinstance(c, np.ndarray) else F.log
    return log(c * total / e) / -log(c / total)


def pair_counts(texts: DataFrame) -> DataFrame:
    """h, c (uses in distinct texts), e (uses of the left word times those of the right word) of all pairs."""
    pairs = texts.select("w").mapInArrow(_count, "h bigint, a bigint, b bigint, n bigint").groupBy("h").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum("n").alias("c"))
    pairs = materialize(pairs.withColumn("salt", F.pmod("h", F.lit(SALTS)).cast("int")), "pairs")
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    side = lambda s: pairs.groupBy(s).agg(F.sum("c").alias(f"c_{s}")).select("*", every)
    return pairs.join(side("a"), ["a", "salt"]).join(side("b"), ["b", "salt"]).select("h", "c", (F.col("c_a").cast("double") * F.col("c_b")).alias("e"))


def distinct_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """t1, t2 (hashes), text, w (hashes of its tokens) of each distinct text; written once, as every step reads a part of it."""
    once = docs.where(F.length(text) > 0).groupBy(F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")).agg(F.first(text).alias("text"))
    return materialize(once.mapInArrow(_tokenise, "t1 bigint, t2 bigint, text string, w array<bigint>"), "texts")


def statistics(texts: DataFrame) -> DataFrame:
    """t1, t2, pairs, mean_npmi, incoherent, overdone, suspicious (shares of the pairs; the last of either) of distinct texts with a pair."""
    spark = texts.sparkSession
    counts = materialize(pair_counts(texts), "pair-counts")
    total = counts.agg(F.sum("c")).first()[0]
    if not total:
        return spark.createDataFrame([], "t1 bigint, t2 bigint, pairs bigint, mean_npmi double, incoherent double, overdone double, suspicious double")
    normal = NORMAL * counts.agg(F.sum(_npmi(F.col("c"), F.col("e"), F.lit(float(total))) * F.col("c"))).first()[0] / total
    # The commonest pairs, down to a quarter of an octave of counts with which there are at most KNOWN; the histogram has at most 256 rows.
    octave = F.floor(F.log2("c") * 4).cast("int")
    bins, held, least = counts.groupBy(octave.alias("b")).count().orderBy(F.desc("b")).collect(), 0, 1_000
    for r in bins:
        held += r["count"]
        if held > KNOWN:
            break
        least = r.b
    known = counts.where(octave >= least).toPandas().sort_values("h")
    shared = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("h", "c", "e")))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kh, kc, ke = shared.value
        ends, unknown = np.append(kh, 0), len(kh)
        for batch in batches:
            own, h, _, _ = _pairs(batch.column("w"))
            texts_here = batch.num_rows
            u, at = np.unique(h, return_inverse=True)
            place = np.searchsorted(kh, u)
            place[(place == unknown) | (ends[place] != u)] = unknown
            # Distinct pairs of each text, by the number of the pair in this batch.
            key, n = np.unique(own * np.int64(max(len(u), 1)) + at, return_counts=True)
            own, at = key // max(len(u), 1), key % max(len(u), 1)
            size = np.bincount(own, n, texts_here)
            over = n >= np.maximum(AGAIN, OFTEN * size[own])
            here = place[at] < unknown
            c, e, k = kc[place[at[here]]], ke[place[at[here]]], n[here]
            low = (c == k) | (_npmi(np.maximum(c - k, 0.5), e, total) < normal)
            add = lambda who, x: np.bincount(who, x, texts_here)
            sums = [size, add(own[here], _npmi(c.astype(float), e, total) * k), add(own[here], k * low), add(own, n * over), add(own[here], k * (low & ~over[here]))]
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(own[~here], minlength=texts_here))], pa.int32()), pa.array(x)) for x in (u[at[~here]], n[~here], over[~here])]
            columns = [batch.column("t1"), batch.column("t2"), *(pa.array(x.astype(float if i == 1 else np.int64)) for i, x in enumerate(sums)), *lists]
            yield pa.RecordBatch.from_arrays(columns, ["t1", "t2", "pairs", "npmi", "low", "over", "apart", "h", "n", "o"])

    seen = texts.select("t1", "t2", "w").mapInArrow(judge, "t1 bigint, t2 bigint, pairs bigint, npmi double, low bigint, over bigint, apart bigint, h array<bigint>, n array<bigint>, o array<boolean>")
    seen = materialize(seen.where("pairs > 0"), "judged")
    sums = seen.drop("h", "n", "o")
    if len(bins) and bins[-1].b < least:
        rare = seen.where(F.size("h") > 0).select("t1", "t2", F.explode(F.arrays_zip("h", "n", "o")).alias("p")).select("t1", "t2", "p.h", "p.n", "p.o").join(counts.where(octave < least), "h")
        low = F.when((F.col("c") == F.col("n")) | (_npmi(F.greatest(F.col("c") - F.col("n"), F.lit(0.5)), F.col("e"), F.lit(float(total))) < normal), F.col("n")).otherwise(0)
        zero = F.lit(0).cast("bigint")
        rare = rare.select("t1", "t2", zero.alias("pairs"), (_npmi(F.col("c"), F.col("e"), F.lit(float(total))) * F.col("n")).alias("npmi"), low.alias("low"), zero.alias("over"), F.when(F.col("o"), 0).otherwise(low).alias("apart"))
        sums = sums.unionByName(rare).groupBy("t1", "t2").agg(*(F.sum(x).alias(x) for x in ("pairs", "npmi", "low", "over", "apart")))
    share = lambda c, name: (c / F.col("pairs")).alias(name)
    return sums.select("t1", "t2", "pairs", share(F.col("npmi"), "mean_npmi"), share(F.col("low"), "incoherent"), share(F.col("over"), "overdone"), share(F.col("apart") + F.col("over"), "suspicious"))


def _look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spam = np.fromiter((_enough(t) and np.greater(*share_of_spam(t)) for t in batch["text"]), bool, len(batch))
        yield batch.loc[spam, ["t1", "t2"]]


def stuffed(docs: DataFrame, identifier: str = "doc_id", text: str = "text") -> DataFrame:
    """The identifiers of the spam."""
    texts = distinct_texts(docs.select(text), text)
    suspects = materialize(statistics(texts).where(F.col("suspicious") >= SUSPECT).select("t1", "t2"), "suspects")
    # A look in pandas over the joined rows, which Spark cannot move below the join: only suspects are read.
    spam = materialize(texts.drop("w").join(suspects, ["t1", "t2"], "left_semi").mapInPandas(_look, "t1 bigint, t2 bigint"), "spam")
    discard(texts)
    return docs.select(identifier, F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")).join(spam, ["t1", "t2"], "left_semi").select(identifier)
