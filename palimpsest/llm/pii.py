"""Personal data in free text: found by a character-level bidirectional LSTM with CRF transitions, replaced by typed placeholders.

Texts are read whole: overlapping windows cover every character, and the network tags every character of every window.
Where windows overlap, each character takes the tag of the window whose edge is farther away, over the whole text. The
gates of the network are piecewise linear (a clipped line instead of a sigmoid, in training and in use), which is several
times as fast in numpy.
Spans of the tags are then checked: mail addresses, phones and numbers must have their form, and all ends are moved to
word borders. The weights (``pii_model.npz``) come from ``pii_training.py``, in numpy, from labelled spans.

Words are ordinary if at least one distinct text in ORDINARY holds them; they only settle the ends of names and addresses. That set is broadcast: it has at most ORDINARY times the
mean number of words of a text, whatever the corpus.

Defined results: null, empty and blank texts have no mentions; mentions never overlap; positions count code points;
equal texts give equal mentions, one set for each row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.util import materialize

TYPES = ["EMAIL", "PHONE", "ID_NUMBER", "ADDRESS", "NAME"]
TAGS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]
MODEL = Path(__file__).with_name("pii_model.npz")
#: Longest window, overlap of neighbouring windows.
WINDOW, OVERLAP = 320, 64
ORDINARY, LEAST = 500, 20

# -- characters ---------------------------------------------------------------
_FOLD = {"à": "a", "á": "a", "â": "a", "ä": "a", "å": "a", "ã": "a", "ç": "c", "è": "e", "é": "e", "ê": "e", "ë": "e", "í": "i", "ì": "i", "î": "i", "ï": "i", "ñ": "n", "ó": "o", "ò": "o", "ô": "o", "ö": "o", "õ": "o", "ø": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ý": "y", "ß": "s"}
_SIGNS = " \n.,;:!?'\"()[]{}<>@#+-/\\_=*&%$|~^`"
N_CHARS = 4 + 26 + 26 + 1 + len(_SIGNS)


def _char_table() -> np.ndarray:
    """Class of each code point of the basic plane: 0 padding, 1 other letter, 2 other sign, 3 other space, then letters by case, digits, signs."""
    table = np.full(65_536, 2, np.uint8)
    for c in range(65_536):
        ch = chr(c)
        low = ch.lower()
        low = _FOLD.get(low, low)
        if ch in _SIGNS:
            table[c] = 57 + _SIGNS.index(ch)
        elif ch.isdigit():
            table[c] = 56
        elif len(low) == 1 and "a" <= low <= "z":
            table[c] = (30 if ch.isupper() else 4) + ord(low) - 97
        elif ch.isalpha():
            table[c] = 1
        elif ch.isspace():
            table[c] = 3
    return table


@lru_cache(1)
def char_table() -> np.ndarray:
    return _char_table()


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return char_table()[np.minimum(codes, 65_535)]


# -- windows ------------------------------------------------------------------
#: Titles of four languages, which are no part of a name.
TITLES = frozenset("mr mrs ms dr prof herr frau sr sra mme mlle señor señora don doña".split())
_WORD = re.compile(r"[^\W\d_]+")


def everywhere(text: str) -> list[tuple[int, int]]:
    """Overlapping windows over the whole text."""
    starts = range(0, max(len(text) - OVERLAP, 1), WINDOW - OVERLAP)
    return [(a, min(a + WINDOW, len(text))) for a in starts] if text and not text.isspace() else []


# -- network ------------------------------------------------------------------
class Tagger:
    """wx: (2, N_CHARS, 4H) input gates by character; wh: (2, H, 4H); wo: (2H, K); b: (K,); move: (K, K); first, last: (K,)."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = {k: np.asarray(v, np.float32) for k, v in weights.items()}
        self.h = self.w["wh"].shape[1]
        # All four gates are clipped to 0..1 at once: the lines' slope and offset are in these weights.
        self.wx, self.wh = self.w["wx"] * 0.5 + 0.5, self.w["wh"] * np.float32(0.5)

    @classmethod
    @lru_cache(1)
    def load(cls) -> Tagger:
        with np.load(MODEL) as f:
            return cls(dict(f))

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, K, B) of the classes x (T, B), read from both sides; states are used while they are at hand and not kept."""
        t, n = x.shape
        h, k = self.h, len(self.w["b"])
        e, part = np.empty((t, k, n), np.float32), np.empty((k, n), np.float32)
        g, given, a = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32), np.empty((n, h), np.float32)
        take, keep, give, new = (g[:, j * h : (j + 1) * h] for j in range(4))
        half, x = np.float32(0.5), x.astype(np.intp)
        for side in range(2):
            wx, wh, wo = self.wx[side], self.wh[side], np.ascontiguousarray(self.w["wo"][side * h : (side + 1) * h].T)
            # ``cell`` holds half the cell, so that the new value, clipped to 0..1, is only shifted.
            cell, state = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for i in range(t) if side == 0 else range(t - 1, -1, -1):
                np.matmul(state, wh, out=g)
                np.take(wx, x[i], axis=0, out=given, mode="clip")
                np.add(g, given, out=g)
                np.clip(g, 0, 1, out=g)
                np.multiply(cell, keep, out=cell)
                np.subtract(new, half, out=a)
                np.multiply(a, take, out=a)
                np.add(cell, a, out=cell)
                np.abs(cell, out=a)
                np.add(a, half, out=a)
                np.divide(cell, a, out=a)
                np.multiply(give, a, out=state)
                if side == 0:
                    np.matmul(wo, state.T, out=e[i])
                else:
                    np.matmul(wo, state.T, out=part)
                    np.add(e[i], part, out=e[i])
        e += self.w["b"][:, None]
        return e

    def open(self, e: np.ndarray) -> np.ndarray:
        """Whether the best path of each window of e (T, K, B) may leave O.

        Against the path of O throughout, a run of other tags gains at most what its first character can gain with the best
        move from O, and each other one with the best move from another tag, less what the cheapest way out of the run
        costs. Where no run sums up to that, none pays.
        """
        move, first, last = self.w["move"], self.w["first"], self.w["last"]
        enter = np.maximum(move[0, 1:] - move[0, 0], first[1:] - first[0])[:, None]
        stay = (move[1:, 1:].max(0) - move[0, 0])[:, None]
        out = max((move[1:, 0] - move[0, 0]).max(), (last[1:] - last[0]).max())
        n = e.shape[2]
        run, most = np.full(n, -np.inf, np.float32), np.full(n, -np.inf, np.float32)
        gain, best = np.empty((e.shape[1] - 1, n), np.float32), np.empty(n, np.float32)
        for row in e:
            np.add(row[1:], stay, out=gain)
            gain.max(0, out=best)
            np.add(run, best, out=run)
            np.add(row[1:], enter, out=gain)
            gain.max(0, out=best)
            np.maximum(run, best, out=run)
            np.subtract(run, row[0], out=run)
            np.maximum(most, run, out=most)
        return most + out >= -1e-3

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags (T, B) by Viterbi; it is left out for windows whose best path is O throughout."""
        e = self.emissions(x)
        open_ = np.flatnonzero(self.open(e))
        tags = np.zeros((len(e), e.shape[2]), np.int8)
        if len(open_):
            tags[:, open_] = self.viterbi(e[:, :, open_])
        return tags

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (T, B) of e (T, K, B); the way back is read from the scores, so that a step forward is one sum and one maximum."""
        t, k, n = e.shape
        move = self.w["move"]
        best, s = np.empty((t, k, n), np.float32), np.empty((k, k, n), np.float32)
        best[0] = e[0] + self.w["first"][:, None]
        for i in range(1, t):
            np.add(best[i - 1][:, None, :], move[:, :, None], out=s)
            np.max(s, axis=0, out=best[i])
            np.add(best[i], e[i], out=best[i])
        tags = np.empty((t, n), np.int8)
        tags[-1] = (best[-1] + self.w["last"][:, None]).argmax(0)
        for i in range(t - 1, 0, -1):
            tags[i - 1] = (best[i - 1] + move[:, tags[i]]).argmax(0)
        return tags


def tag_texts(tagger: Tagger, texts: list[str], ordinary: frozenset[str], batch: int = 512) -> list[list[tuple[str, int, int]]]:
    """Mentions (type, start, end) of each text."""
    coded, places = [], []
    for i, text in enumerate(texts):
        if found := everywhere(text):
            c = classes(text)
            for a, b in found:
                coded.append(c[a:b])
                places.append((i, a, b))
    order = sorted(range(len(places)), key=lambda j: len(coded[j]))
    tags: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for s in range(0, len(order), batch):
        group = order[s : s + batch]
        x = np.zeros((max(len(coded[j]) for j in group), len(group)), np.uint8)
        for col, j in enumerate(group):
            x[: len(coded[j]), col] = coded[j]
        y = tagger.decode(x)
        for col, j in enumerate(group):
            i, a, b = places[j]
            if not y[: b - a, col].any() and i not in tags:
                continue
            if i not in tags:
                n = len(texts[i])
                tags[i] = (np.zeros(n, np.int8), np.full(n, -1, np.int32))
            whole, depth = tags[i]
            edge = np.minimum(np.arange(1, b - a + 1) + (WINDOW if a == 0 else 0), np.arange(b - a, 0, -1) + (WINDOW if b == len(texts[i]) else 0))
            better = edge > depth[a:b]
            whole[a:b][better] = y[: b - a, col][better]
            depth[a:b][better] = edge[better]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    for i, (whole, _) in tags.items():
        out[i] = settle(texts[i], spans_of(whole), ordinary)
    return out


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    kind = (tags + 1) // 2
    # A mention begins where the type changes or a first tag stands, and ends where the next one begins.
    edge = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (tags[1:] % 2 == 1)]) if len(tags) else np.zeros(0, int)
    ends = np.r_[edge[1:], len(tags)]
    return [(TYPES[k - 1], int(x), int(y)) for x, y, k in zip(edge, ends, kind[edge].tolist(), strict=True) if k]


# -- check of what was found ----------------------------------------------------
_AT, _DOT = r"(?:\s*[\[({]\s*at\s*[\])}]\s*|\s+at\s+|\s*[@＠]\s*)", r"(?:\s*[\[({]\s*dot\s*[\])}]\s*|\s+dot\s+|\.)"
_FORMS = {
    "EMAIL": re.compile(rf"[\w.%+-]+{_AT}[\w-]+(?:{_DOT}[\w-]+)*{_DOT}[^\W\d_]{{2,}}", re.I),
    "PHONE": re.compile(r"(?:\+ ?|\(|(?<![\w+(]))\d(?:[\d\s()./-]{5,22})\d(?!\w)(?:\s*(?:ext\.?|x|extension|durchwahl|poste)\s*\.?\s*\d{1,5})?", re.I),
    "ID_NUMBER": re.compile(r"(?<![\w+])[a-z]{0,2}\d(?:[ .-]?\d){5,14}[a-z]?(?!\w)", re.I),
}


#: Mail addresses that nothing masks, also after the word at; letters apart from their number, before and after it.
_ALSO = {"EMAIL": [re.compile(r"[\w.%+-]+[@＠][\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")], "ID_NUMBER": [re.compile(r"(?<![\w+])[a-z]{2}[ -]\d(?:[ .-]?\d){5,14}(?:[ -]?[a-z])?(?!\w)", re.I), re.compile(r"(?<![\w+])\d(?:[ .-]?\d){5,14}[ -][a-z](?!\w)", re.I)]}


def _fit(kind: str, text: str, a: int, b: int) -> tuple[int, int] | None:
    """The stretch of the type's form that agrees best with what was tagged, if half of either does."""
    best, fit = 0.5, None
    for form in [_FORMS[kind], *_ALSO.get(kind, [])]:
        for m in form.finditer(text, max(0, a - 40), min(len(text), b + 40)):
            shared = min(b, m.end()) - max(a, m.start())
            agree = shared / (max(b, m.end()) - min(a, m.start()))
            if agree > best:
                best, fit = agree, m.span()
    if fit and kind == "ID_NUMBER" and (m := _LETTER.match(text, fit[1])) and re.fullmatch(r"\d{8}", text[fit[0] : fit[1]]):
        fit = fit[0], m.end()  # the check letter of an identity number
    return fit


_LETTER = re.compile(r"[ -]?[A-Z](?!\w)")
_TITLED = re.compile(r"(?<!\w)(?:" + "|".join(sorted(TITLES)) + r")\.? +$", re.I)


def _name(text: str, a: int, b: int, ordinary: frozenset[str]) -> tuple[int, int] | None:
    """A name by its words: titles off, words of ordinary speech off its ends, a missing second word on; None if it is no full name."""
    words = [(m.start() + a, m.end() + a) for m in _WORD.finditer(text[a:b])]
    plain = lambda w: text[w[0] : w[1]].lower()
    while words and plain(words[0]) in TITLES and not (len(plain(words[0])) == 1 and len(words) == 2):
        words.pop(0)
    # A capitalised word stays while the other end is not capitalised: family names can be words of ordinary speech.
    off = lambda w, other: plain(w) in ordinary and not (text[w[0]].isupper() and text[other[0]].islower())
    while len(words) > 2 and off(words[-1], words[0]):
        words.pop()
    while len(words) > 2 and off(words[0], words[-1]):
        words.pop(0)
    if not words:
        return None
    titled = _TITLED.search(text, max(0, words[0][0] - 12), words[0][0]) is not None
    while len(words) > 1 and text[words[0][0]].isupper() and text[words[-1][0]].islower():
        words.pop()  # a word of the sentence: the parts of a name share their case
    if len(words) == 1 and not titled:
        after, before = re.compile(r"(?: {1,2}|, )([^\W\d_]{3,})").match(text, words[0][1]), re.search(r"([^\W\d_]{3,}(?: {1,2}|, )|(?<!\w)[^\W\d_]\. )$", text[: words[0][0]])
        if before and (before[1][1:3] == ". " or _WORD.match(before[1])[0].lower() not in ordinary | TITLES):
            words.insert(0, (before.start(1), before.start(1) + 1))
        elif after and after[1].lower() not in ordinary:
            words.append(after.span(1))
        else:
            return None
    return words[0][0], words[-1][1]


def settle(text: str, spans: list[tuple[str, int, int]], ordinary: frozenset[str]) -> list[tuple[str, int, int]]:
    """Mentions with ends at the borders of words and, where the type has one, of its form; what lacks the form is dropped."""
    out: list[tuple[str, int, int]] = []
    joined: list[tuple[str, int, int]] = []
    for kind, a, b in spans:  # pieces of one mention that a slip of the tags left apart
        if joined and joined[-1][0] == kind and a - joined[-1][2] <= 2 and kind not in ("NAME", "PHONE") and "\n" not in text[joined[-1][2] : a]:
            joined[-1] = (kind, joined[-1][1], b)
        else:
            joined.append((kind, a, b))
    for kind, a, b in joined:
        if kind in _FORMS:
            if not (fit := _fit(kind, text, a, b)):
                continue
            a, b = fit
        else:
            while a > 0 and text[a].isalnum() and text[a - 1].isalnum():
                a -= 1
            while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                b += 1
            while a < b and not (text[a].isalnum() or text[a] == "#"):
                a += 1
            while a < b and not text[b - 1].isalnum():
                b -= 1
            if kind == "NAME":
                if not (fit := _name(text, a, b, ordinary)):
                    continue
                a, b = fit
            else:
                while (cut := text.rfind(" ", a, b)) > a and text[cut + 1 : b].lower() in ordinary and text[b - 1].isalpha() and (text[cut + 1].islower() or not text[cut - 1].isalpha()):
                    b = cut  # a word of the next sentence
                    while not text[b - 1].isalnum():
                        b -= 1
                if re.search(r"(?i)(?:\b(?:izq|dcha|st)|str)$", text[a:b]) and text[b : b + 1] == ".":
                    b += 1
                if b - a < 5 or not any(c.isdigit() for c in text[a:b]):
                    continue
        if out and a < out[-1][2]:
            if b - a > out[-1][2] - out[-1][1]:
                out[-1] = (kind, a, b)
            continue
        out.append((kind, a, b))
    return out


# -- Spark --------------------------------------------------------------------
def ordinary_words(texts: DataFrame, text: str = "text") -> frozenset[str]:
    """Words that at least one distinct text in ORDINARY holds, and at least LEAST of them; copies of a text count once."""
    texts = materialize(texts.where(F.col(text).isNotNull()).select(text).distinct().select(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)([\p{L}]{3,40})"), 1)).alias("words")), "words")
    words = texts.select(F.explode("words").alias("w"))
    total = texts.count()
    return frozenset(r.w for r in words.groupBy("w").count().where(F.col("count") >= max(LEAST, total / ORDINARY)).select("w").toLocalIterator())


def find(texts: DataFrame, keys: list[str], text: str = "text", ordinary: frozenset[str] | None = None) -> DataFrame:
    """The keys with pii_type, start_pos, end_pos: one row per mention."""
    spark = texts.sparkSession
    ordinary = ordinary_words(texts, text) if ordinary is None else ordinary
    shared = spark.sparkContext.broadcast(ordinary)
    fields = {f.name: f.dataType.simpleString() for f in texts.schema}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys) + ", pii_type string, start_pos int, end_pos int"

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.load()
        for batch in batches:
            found = tag_texts(tagger, batch[text].tolist(), shared.value)
            at = np.repeat(np.arange(len(batch)), [len(f) for f in found])
            rows = pd.DataFrame([m for f in found for m in f], columns=["pii_type", "start_pos", "end_pos"])
            yield pd.concat([batch[keys].iloc[at].reset_index(drop=True), rows], axis=1)

    return texts.where(F.length(text) > 0).select(*keys, text).mapInPandas(tag, schema)


def redact(texts: DataFrame, text: str = "text", ordinary: frozenset[str] | None = None) -> DataFrame:
    """texts with every mention in the text replaced by its type in brackets; null stays null."""
    ordinary = ordinary_words(texts, text) if ordinary is None else ordinary
    shared = texts.sparkSession.sparkContext.broadcast(ordinary)

    @F.pandas_udf("string")
    def replaced(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tagger = Tagger.load()
        for batch in batches:
            plain = [t or "" for t in batch]
            out = []
            for original, t, found in zip(batch, plain, tag_texts(tagger, plain, shared.value), strict=True):
                for kind, a, b in reversed(found):
                    t = f"{t[:a]}[{kind}]{t[b:]}"
                out.append(None if original is None else t)
            yield pd.Series(out, dtype=object)

    return texts.withColumn(text, replaced(text))
