"""Training of the tagger of personal data, in numpy: python -m palimpsest.llm.pii_training SF_DIR

Labels come from rules over at most ROWS messages (a documented bound): the people of the directory and names of the
same make, number ranges kept for examples, and the streets and towns of the product's texts. Copies with other names,
streets, towns, hosts, digits and case are added, so that the network learns contexts and make rather than a list.
"""

from __future__ import annotations

import re
import sys
import time

import numpy as np
import pandas as pd

from palimpsest.llm import pii

ROWS, HIDDEN, EPOCHS, BATCH, SEED = 30_000, 40, 8, 40, 11
#: Share of the windows of texts without a mention that training takes.
PLAIN = 0.35

#: Streets and towns that the texts name.
TOWNS = "Kellbrook|Saltmere|Tresham|Pine Hollow|North Arden|Lower Fenn|Quarrydale|Eastmoor|Greyford|Unterhagen|Oberfelde?|Wiesloh|Bad Torfau|Valbrume|Montcendre|Saint-Orval|Puerto Calmo|Navaserena|Villasombra"
GERMAN = r"Dohlenkampstra(?:ß|ss)e|Dohlenkampstr\.|Krümmelbachweg|Reiherhorststr(?:\.|a(?:ß|ss)e)|Untere Mühlbreite|Am Alten Torfstich|Moorwiesenallee|Lerchenfeldgasse"
FRENCH = r"(?:rue|impasse|place|chemin|avenue|av\.|bd|boulevard) (?:des Hérons|des Cendres|du Tilleul|du Lavoir Neuf|du Vieux Moulin|de la Tourbière)"
SPANISH = r"(?:Calle|C/|Avda\.|Avenida|Plaza|Paseo|Camino)(?: del?)?(?: las?| los)? (?:Alondra|Molino Seco|Olivar Viejo|Abeto|Garzas)"
_ADDRESS = re.compile(
    rf"(?:{GERMAN}) \d{{1,3}}(?: ?[a-z]\b)?(?:, \d{{5}} (?:{TOWNS}))?"
    rf"|\d{{1,3}}(?: bis| ter)?,? (?:{FRENCH})(?:(?:,| -) \d{{5}} (?:{TOWNS}))?"
    rf"|(?:{SPANISH}),? (?:nº )?\d{{1,3}}(?:, (?:\dº \w|bajo izq\.))?(?:, \d{{5}} (?:{TOWNS}))?"
    rf"|(?<![\w.])\d{{1,3}} (?:[A-Z][\w']+ ){{1,3}}(?:Street|St\b\.?|Road|Rd\b|Avenue|Ave\b|Lane|Blvd|Court)(?:(?:,? (?:Apt|Unit|Flat) \w+)| #\w+)?(?:,? (?:{TOWNS}),?(?: ZZ)? \d{{5}})?",
    re.I,
)
_EMAIL = re.compile(r"[\w.%+-]+(?:\s?[@＠]\s?|\s?[\[(]at[\])]\s?| at )[\w-]+(?:(?:\.|\s?[\[(]dot[\])]\s?| dot )[\w-]+)*?(?:\.|\s?[\[(]dot[\])]\s?| dot )(?:example|test|invalid)\b", re.I)
#: Number ranges that are kept for examples.
_PHONE = re.compile(
    r"(?<![\w+])(?:(?:\+?1[ .-]?)?\(?\d{3}\)?[ .-]?555[ .-]?01\d\d|(?:\+44 ?|0044 ?)?(?:\(0\) ?)?0?7700[ -]?900[ -]?\d{3}|(?:(?:\+49|0049) ?(?:\(0\) ?)?30|\(?030\)?)[ /.-]?23 ?12 ?5[ -]?\d[ \d]?\d\d?(?!\d)|(?:(?:\+33|0033) ?(?:\(0\) ?)?|0)1(?:[ .-]?\d\d){4}|(?:(?:\+34|0034) ?)?600(?:[ .-]?\d{3}){2})(?!\d)(?:(?:,? ext\.?| x) ?\d{1,4})?"
)
_ID = re.compile(
    r"(?<![\w+])(?:9\d\d[- ]?\d\d[- ]?\d{4}|QQ[- ]?\d\d[- ]?\d\d[- ]?\d\d[- ]?C|X0\d{7}|L0\d{6,7}X|0\d ?\d{3} ?\d{3} ?\d{3}|[12][ -]?\d\d[ -]?\d\d[ -]?99[ -]?\d{3}[ -]?\d{3}[ -]?\d\d|00\d{6}[ -]?[A-Z])(?!\w)", re.I
)
_TITLE = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Sra?|Mme|Mlle|Señora?|Don|Doña)"


class Names:
    """Given and family names of the directory, and others made of the same parts."""

    def __init__(self, people: pd.DataFrame) -> None:
        self.given, self.family = ({str(w) for w in people[c].dropna()} for c in ("given_name", "family_name"))
        self.starts, self.given_ends = self._parts(self.given)
        self.bodies, self.family_ends = self._parts(self.family)
        made = lambda a, b: "(?:" + "|".join(sorted(map(re.escape, a), key=len, reverse=True)) + ")(?:" + "|".join(sorted(map(re.escape, b), key=len, reverse=True)) + ")"
        whole = lambda s: "|".join(sorted(map(re.escape, s), key=len, reverse=True))
        g, f = f"(?:{whole(self.given)}|{made(self.starts, self.given_ends)})", f"(?:{whole(self.family)}|{made(self.bodies, self.family_ends)})"
        self.pattern = re.compile(rf"(?<!\w)(?:{g}[ ]{{1,2}}{f}|{f}, {g}|[^\W\d_]\. {f})(?!\w)", re.I)
        self.titled = re.compile(rf"(?<!\w){_TITLE}\.? (?:Dr\. )?({g}[ ]{{1,2}}{f}|{f})(?!\w)", re.I)

    @staticmethod
    def _parts(names: set[str]) -> tuple[set[str], set[str]]:
        """Beginnings and ends that at least eight names share."""
        heads: dict[str, set[str]] = {}
        for n in names:
            for k in range(2, len(n) - 1):
                heads.setdefault(n[:k].lower(), set()).add(n[k:].lower())
        ends: dict[str, set[str]] = {}
        for h, tails in heads.items():
            if len(tails) >= 5:
                for t in tails:
                    ends.setdefault(t, set()).add(h)
        good = {t for t, h in ends.items() if len(h) >= 5}
        return {h for h, t in heads.items() if len(t & good) >= 5}, good

    def invent(self, rng: np.random.Generator) -> tuple[str, str]:
        """A name that is in no list: parts of the directory's names, or syllables at random."""
        pick = lambda s: sorted(s)[rng.integers(len(s))]
        if rng.random() < 0.6:
            return (pick(self.starts) + pick(self.given_ends)).title(), (pick(self.bodies) + pick(self.family_ends)).title()
        syllable = lambda: pick(set("bdfghjklmnprstvwz") | {"br", "tr", "st", "kl", "sch", "th"}) + pick(set("aeiou") | {"ei", "au", "ie", "ö", "á"}) + pick({"", "n", "r", "l", "s", "m", "ck"})
        return ("".join(syllable() for _ in range(rng.integers(1, 4)))).title(), ("".join(syllable() for _ in range(rng.integers(1, 4)))).title()


def label(text: str, names: Names) -> list[tuple[str, int, int]]:
    spans: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if b > a and not any(a < y and x < b for _, x, y in spans):
            spans.append((kind, a, b))

    for m in _EMAIL.finditer(text):
        add("EMAIL", *m.span())
    for m in _ADDRESS.finditer(text):
        add("ADDRESS", *m.span())
    for m in _PHONE.finditer(text):
        if not re.search(r"(?i)(?:row|of) $", text[max(0, m.start() - 4) : m.start()]):
            add("PHONE", *m.span())
    for m in _ID.finditer(text):
        if not re.search(r"(?i)(?:row |of |order |run |#)$", text[max(0, m.start() - 6) : m.start()]):
            add("ID_NUMBER", *m.span())
    for m in names.titled.finditer(text):
        add("NAME", *m.span(1))
    for m in names.pattern.finditer(text):
        add("NAME", *m.span())
    return sorted(spans, key=lambda s: s[1])


#: Words of addresses and hosts that are of their form, not of one place.
KINDS = frozenset("street avenue court impasse place chemin boulevard calle avenida plaza paseo camino unit flat".split())
HOSTS = frozenset("example invalid".split())


def vary(text: str, spans: list, names: Names, rng: np.random.Generator) -> tuple[str, list]:
    """The text with other names and numbers in its mentions, and sometimes in another case."""
    out, at, moved = "", 0, []
    for kind, a, b in spans:
        out += text[at:a]
        old = new = text[a:b]
        if kind == "NAME" and rng.random() < 0.6:
            g, f = names.invent(rng)
            if ", " in old:
                new = f"{f}, {g}"
            elif re.match(r"[^\W\d_]\. ", old):
                new = f"{old[0]}. {f}"
            elif " " in old:
                new = re.sub(r"\S+( +)\S+", lambda m: g + m[1] + f, old)
            else:
                new = f
            new = new.upper() if old.isupper() else new.lower() if old.islower() else new
        elif kind == "ADDRESS" and rng.random() < 0.7:
            # Words of streets and towns give way to invented ones; kinds of street, units and numbers stay.
            new = re.sub(r"[^\W\d_]{5,}", lambda m: m[0] if m[0].lower() in KINDS else names.invent(rng)[1] + (m[0][-4:] if re.search(r"(?i)(?:asse|str|allee|weg)$", m[0]) else ""), old)
            new = re.sub(r"\d", lambda m: str(rng.integers(1, 10)), new)
            new = new.upper() if old.isupper() else new.lower() if old.islower() else new
        elif kind == "EMAIL" and rng.random() < 0.5:
            new = re.sub(r"[^\W\d_]{5,}", lambda m: m[0] if m[0].lower() in HOSTS else names.invent(rng)[1].lower() + names.invent(rng)[0].lower(), old)
        elif kind in ("PHONE", "ID_NUMBER"):
            new = re.sub(r"\d", lambda m: str(rng.integers(10)), old)
        moved.append((kind, len(out), len(out) + len(new)))
        out += new
        at = b
    out += text[at:]
    case = rng.random()
    changed = out.upper() if case < 0.05 else out.lower() if case < 0.15 else out
    return (changed, moved) if len(changed) == len(out) else (out, moved)


def examples(texts: list[str], names: Names, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for text in texts:
        spans = label(text, names)
        versions = [(text, spans)] + [vary(text, spans, names, rng) for _ in range(2 if spans else 0)]
        for t, s in versions:
            y = np.zeros(len(t), np.int8)
            for kind, a, b in s:
                k = 1 + 2 * pii.TYPES.index(kind)
                y[a], y[a + 1 : b] = k, k + 1
            c = pii.classes(t)
            out += [(c[a:b], y[a:b]) for a, b in pii.everywhere(t) if spans or rng.random() < PLAIN]
    return out


def fresh(rng: np.random.Generator, hidden: int) -> dict[str, np.ndarray]:
    k = len(pii.TAGS)
    w = {
        "wx": rng.normal(0, 0.3, (2, pii.N_CHARS, 4 * hidden)), "wh": rng.normal(0, 0.5 / np.sqrt(hidden), (2, hidden, 4 * hidden)), "wo": rng.normal(0, 0.3 / np.sqrt(hidden), (2 * hidden, k)),
        "b": np.zeros(k), "move": rng.normal(0, 0.05, (k, k)), "first": np.zeros(k), "last": np.zeros(k),
    }
    w["wx"][:, :, hidden : 2 * hidden] += 1.0  # remember, at first
    return {n: v.astype(np.float32) for n, v in w.items()}


def _forward(w: dict, side: int, x: np.ndarray) -> tuple:
    t, n = x.shape
    h = w["wh"].shape[1]
    state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    gates, cells, tanhs, states = (np.empty((t, n, m), np.float32) for m in (4 * h, h, h, h))
    for i in range(t):
        g = w["wx"][side][x[i]] + state @ w["wh"][side]
        g[:, : 3 * h] = g[:, : 3 * h] * 0.5 + 0.5
        np.clip(g[:, : 3 * h], 0, 1, out=g[:, : 3 * h])
        np.clip(g[:, 3 * h :], -1, 1, out=g[:, 3 * h :])
        cell = g[:, h : 2 * h] * cell + g[:, :h] * g[:, 3 * h :]
        tc = cell / (1 + np.abs(cell))
        state = g[:, 2 * h : 3 * h] * tc
        gates[i], cells[i], tanhs[i], states[i] = g, cell, tc, state
    return gates, cells, tanhs, states


def _backward(w: dict, side: int, x: np.ndarray, saved: tuple, d_out: np.ndarray, grads: dict) -> None:
    gates, cells, tanhs, states = saved
    t, n = x.shape
    h = w["wh"].shape[1]
    dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
    wt = w["wh"][side].T.copy()
    dz = np.empty_like(gates)
    for i in range(t - 1, -1, -1):
        g, tc = gates[i], tanhs[i]
        dh = dh + d_out[i]
        dc = dc + dh * g[:, 2 * h : 3 * h] * (1 - np.abs(tc)) ** 2
        before = cells[i - 1] if i else np.zeros_like(dc)
        z = dz[i]
        z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :] = dc * g[:, 3 * h :], dc * before, dh * tc, dc * g[:, :h]
        s = g[:, : 3 * h]
        z[:, : 3 * h] *= np.float32(0.5) * ((s > 0) & (s < 1))
        z[:, 3 * h :] *= np.abs(g[:, 3 * h :]) < 1
        dh = z @ wt
        dc = dc * g[:, h : 2 * h]
    flat = dz.reshape(t * n, -1)
    order = np.argsort(x.ravel(), kind="stable")
    kinds, starts = np.unique(x.ravel()[order], return_index=True)
    grads["wx"][side][kinds] += np.add.reduceat(flat[order], starts, axis=0)
    grads["wh"][side] += states[:-1].reshape(-1, h).T @ dz[1:].reshape((t - 1) * n, -1)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis, keepdims=True)
    return (m + np.log(np.exp(a - m).sum(axis, keepdims=True))).squeeze(axis)


def step(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Negative log-likelihood of the tags y (T, B) and its gradients."""
    t, n = x.shape
    h, k = w["wh"].shape[1], len(w["b"])
    grads = {name: np.zeros_like(v) for name, v in w.items()}
    one, two = _forward(w, 0, x), _forward(w, 1, x[::-1])
    both = np.concatenate([one[3], two[3][::-1]], 2)
    e = both @ w["wo"] + w["b"]
    alpha, beta = np.empty((t, n, k), np.float32), np.empty((t, n, k), np.float32)
    alpha[0], beta[-1] = e[0] + w["first"], w["last"]
    for i in range(1, t):
        alpha[i] = _lse(alpha[i - 1][:, :, None] + w["move"], 1) + e[i]
    for i in range(t - 2, -1, -1):
        beta[i] = _lse(w["move"][None] + (e[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _lse(alpha[-1] + w["last"], 1)
    rows = np.arange(n)
    gold = e[np.arange(t)[:, None], rows, y].sum(0) + w["move"][y[:-1], y[1:]].sum(0) + w["first"][y[0]] + w["last"][y[-1]]
    d = np.exp(alpha + beta - z[None, :, None])
    grads["first"], grads["last"] = d[0].sum(0), d[-1].sum(0)
    np.subtract.at(grads["first"], y[0], 1)
    np.subtract.at(grads["last"], y[-1], 1)
    for i in range(1, t):
        grads["move"] += np.exp(alpha[i - 1][:, :, None] + w["move"] + (e[i] + beta[i])[:, None, :] - z[:, None, None]).sum(0)
    np.subtract.at(grads["move"], (y[:-1].ravel(), y[1:].ravel()), 1)
    d[np.arange(t)[:, None], rows, y] -= 1
    d = d.astype(np.float32)
    grads["wo"], grads["b"] = both.reshape(t * n, -1).T @ d.reshape(t * n, -1), d.sum((0, 1))
    back = d @ w["wo"].T
    _backward(w, 0, x, one, back[:, :, :h], grads)
    _backward(w, 1, x[::-1], two, back[::-1, :, h:], grads)
    return float((z - gold).mean()), {name: (g / n).astype(np.float32) for name, g in grads.items()}


def fit(data: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, hidden: int = HIDDEN, rate: float = 8e-3, seed: int = SEED, log=print) -> dict[str, np.ndarray]:
    """Weights by Adam on batches of windows of like length."""
    rng = np.random.default_rng(seed)
    w = fresh(rng, hidden)
    m, v = ({n: np.zeros_like(a) for n, a in w.items()} for _ in range(2))
    order = np.argsort([len(c) for c, _ in data], kind="stable")
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    count, total = 0, epochs * len(batches)
    for epoch in range(epochs):
        began, losses = time.time(), []
        for b in rng.permutation(len(batches)):
            group = [data[j] for j in batches[b]]
            size = max(len(c) for c, _ in group)
            x, y = np.zeros((size, len(group)), np.uint8), np.zeros((size, len(group)), np.int64)
            for i, (c, t) in enumerate(group):
                x[: len(c), i], y[: len(c), i] = c, t
            loss, grads = step(w, x, y)
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            scale = min(1.0, 5.0 / max(norm, 1e-9))
            count += 1
            now = rate * min(1.0, count / 50) * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * count / total)))
            for name, g in grads.items():
                g = g * scale
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                w[name] -= (now * (m[name] / (1 - 0.9**count)) / (np.sqrt(v[name] / (1 - 0.999**count)) + 1e-8)).astype(np.float32)
        log(f"epoch {epoch}: loss {np.mean(losses):.4f}, {time.time() - began:.0f} s", flush=True)
    return w


def scores(texts: list[str], names: Names, ordinary: frozenset[str], tagger: pii.Tagger) -> dict[str, tuple[int, int, int]]:
    """Hits, misses and false mentions of each type, against the labels of the rules."""
    out = {k: [0, 0, 0] for k in pii.TYPES}
    for text, found in zip(texts, pii.tag_texts(tagger, texts, ordinary), strict=True):
        want, got = set(label(text, names)), set(found)
        for kind, *_ in want & got:
            out[kind][0] += 1
        for kind, *_ in want - got:
            out[kind][1] += 1
        for kind, *_ in got - want:
            out[kind][2] += 1
    return {k: tuple(v) for k, v in out.items()}


def common(texts: list[str]) -> frozenset[str]:
    """Ordinary words of a list of texts, as pii.ordinary_words finds them of a table."""
    df: dict[str, int] = {}
    for t in texts:
        for w in set(re.findall(r"[^\W\d_]{3,40}", t.lower())):
            df[w] = df.get(w, 0) + 1
    return frozenset(w for w, n in df.items() if n >= max(pii.LEAST, len(texts) / pii.ORDINARY))


def main(sf_dir: str, rows: int = ROWS, epochs: int = EPOCHS) -> None:
    rng = np.random.default_rng(SEED)
    texts = pd.read_parquet(f"{sf_dir}/raw_messages.parquet", columns=["content"])["content"].dropna().tolist()
    ordinary = common(texts)
    texts = [texts[i] for i in rng.permutation(len(texts))]
    held, texts = texts[rows : rows + 20_000], texts[:rows]
    names = Names(pd.read_parquet(f"{sf_dir}/people_directory.parquet"))
    data = examples(texts, names, rng)
    print(len(texts), "rows,", len(data), "windows,", sum(len(c) for c, _ in data), "characters;", len(ordinary), "ordinary words", flush=True)
    w = fit(data, epochs)
    np.savez(pii.MODEL, **{k: v.astype(np.float16 if k in ("wx", "wh", "wo") else np.float32) for k, v in w.items()})
    pii.Tagger.load.cache_clear()
    print("held out (hits, misses, false):", scores(held, names, ordinary, pii.Tagger.load()))


if __name__ == "__main__":
    main(sys.argv[1], *(int(a) for a in sys.argv[2:]))
