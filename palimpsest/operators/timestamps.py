"""Mixed timestamp formats and zones, normalised to one UTC instant.

Two steps. ``interpret`` writes every valid reading of a value as an array: month or day
first, the earlier or the later of two instants that a clock showed twice. A reading that goes against what is known
(the locale's order of day and month, the earlier instant) has a cost. ``choose`` finds, for the records of each source
in their order, the cheapest sequence of readings (Viterbi), where a change of format and a step back in time cost. Each
reading has its own format: two readings of one value differ in the order of day and month. What is known (the locale's
order) is a prior: with a small ``rule_weight`` the neighbours of a value can overrule it, with a large one they cannot;
where the rules are to stand in any case, ``ruled`` takes their reading and no sequence is solved.
Only sources with a value of several readings are put in order and solved; in all others there is nothing to choose.

The order of a source is cut at partition borders, so a source of a third of all rows is spread over many tasks. A
piece at a border is solved for each reading of its first and last record; a table of one row per piece and border then
tells which applies. So the result is that of one long Viterbi run, at any size.

Defined results: null, blank, words, a date or a time alone, and dates or times that do not exist have no reading and
give no row; unknown zone letters give no reading; a null or unknown IANA zone counts as UTC; a null locale is day
first; ties in the cost go to the reading listed first; repeated rows each give a row.
"""

from __future__ import annotations

import re
import zoneinfo
from collections.abc import Iterator
from datetime import date, datetime, timedelta
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.util import materialize

#: Month names and abbreviations in English, German, Spanish and French.
MONTHS = {
    1: "january jan januar jän enero ene janvier janv",
    2: "february feb februar febrero février févr fév fevrier fevr",
    3: "march mar märz mär maerz mrz marzo mars",
    4: "april apr abril abr avril avr",
    5: "may mai mayo",
    6: "june jun juni junio juin",
    7: "july jul juli julio juillet juil",
    8: "august aug agosto ago août aout",
    9: "september sep sept septiembre setiembre septembre",
    10: "october oct oktober okt octubre octobre",
    11: "november nov noviembre novembre",
    12: "december dec dezember dez diciembre dic décembre déc decembre",
}
MONTH = {name: m for m, names in MONTHS.items() for name in names.split()}
_TIME = r"(?P<h>\d{1,2})[:h](?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?"
_TZ = r"(?: ?(?P<half>[ap]m)| uhr)?(?: ?(?P<z>z|(?!am|pm)[a-z]{2,5})?(?: ?(?P<sign>[+-])(?P<oh>\d{2})(?::?(?P<om>\d{2}))?)?)(?:\[[^\]]+\]| \(.*\))?"
_AT = r",?(?: (?:à|a las|um|at))? "
#: Kinds of format, of a value in lower case with single spaces. The first that fits counts.
SHAPES = {
    "iso": rf"(?P<y>\d{{4}})([-/.])(?P<m>\d{{1,2}})\2(?P<d>\d{{1,2}})[t ]{_TIME}{_TZ}",
    "epoch": r"(?P<e>\d{9,13}|\d{15,19})(?:\.(?P<f>\d+))?",
    "compact": rf"(?P<y>\d{{4}})(?P<m>\d\d)(?P<d>\d\d)[t ]?(?P<h>\d\d)(?P<mi>\d\d)(?P<s>\d\d)(?:[.,](?P<f>\d+))?{_TZ}",
    "num": rf"(?P<n1>\d{{1,2}})([-/.])(?P<n2>\d{{1,2}})\2(?P<y>\d{{4}}|\d{{2}}){_AT}{_TIME}{_TZ}",
    "names": rf"(?:[^\W\d]+\.?,? )?(?P<d>\d{{1,2}})(?:\.|er|st|nd|rd|th)?(?: de)? (?P<M>[^\W\d]{{3,}})\.?(?: de)? (?P<y>\d{{4}}){_AT}{_TIME}{_TZ}",
    "month_first": rf"(?:[^\W\d]+\.?,? )?(?P<M>[^\W\d]{{3,}})\.? (?P<d>\d{{1,2}})(?:st|nd|rd|th)?,? (?P<y>\d{{4}}){_AT}{_TIME}{_TZ}",
    "ctime": rf"[^\W\d]+ (?P<M>[^\W\d]{{3,}}) (?P<d>\d{{1,2}}) {_TIME} (?P<z>[a-z]{{1,5}}) (?P<y>\d{{4}})",
    "week": rf"(?P<y>\d{{4}})-?w(?P<w>\d\d)-?(?P<wd>\d)[t ]{_TIME}{_TZ}",
    "ordinal": rf"(?P<y>\d{{4}})-(?P<o>\d{{3}})[t ]{_TIME}{_TZ}",
    "wrapped": r"/date\((?P<e>-?\d+)(?:[+-]\d{4})?\)/",
}
_SHAPES = [(k, re.compile(shape).fullmatch) for k, shape in SHAPES.items()]
_SPACES, _HALF = re.compile(r"[\s\x1c-\x1f]+"), re.compile(r" ?\b([ap])\.?m\b\.?|(?<=\d)([ap])\.?m\b\.?")
_EPOCH = datetime(1970, 1, 1)
#: Letters that mean UTC wherever the product gives them no meaning of its own.
UTC = {"z": 0, "utc": 0, "gmt": 0}


@lru_cache(4096)
def _zone(name: str | None) -> zoneinfo.ZoneInfo | None:
    try:
        return zoneinfo.ZoneInfo(name) if name and name != "UTC" else None
    except (zoneinfo.ZoneInfoNotFoundError, ValueError, OSError):
        return None


def _micros(t: datetime) -> int:
    d = t - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def readings_of(text: str | None, locale: str | None, zone: str | None, abbreviations: dict[str, int], rule_weight: float) -> tuple[list[int], list[int], list[float]]:
    """All readings of one value: instants, formats (kind, order of day and month, with or without zone, half days), costs."""
    none = ([], [], [])
    if not text:
        return none
    s = _SPACES.sub(" ", text.lower()).strip()
    if "m" in s[-4:]:
        s = _HALF.sub(lambda x: f" {x[1] or x[2]}m", s)
    for shape, (kind, match) in enumerate(_SHAPES):
        if m := match(s):
            break
    else:
        return none
    g = m.groupdict()
    if "e" in g:
        n, fraction = int(g["e"]), (g.get("f") or "")[:6].ljust(6, "0")
        if kind == "wrapped":
            return [n * 1000], [8 * shape], [0.0]
        size = len(g["e"])
        us = n * 1_000_000 + int(fraction) if size <= 11 else n * 1000 + int(fraction) // 1000 if size <= 13 else n if size <= 16 else n // 1000
        return [us], [8 * shape], [0.0]
    h = int(g["h"])
    if g.get("half"):
        if not 1 <= h <= 12:
            return none
        h = h % 12 + 12 * (g["half"] == "pm")
    clock = (h, int(g["mi"]), int(g["s"] or 0), int((g["f"] or "")[:6].ljust(6, "0")))
    year = int(g["y"]) + 2000 * (len(g["y"]) == 2)
    if kind == "num":
        a, b = int(g["n1"]), int(g["n2"])
        days = [(a, b), (b, a)] if locale == "en_US" else [(b, a), (a, b)]
        days = days[: 1 + (a != b)]
    elif "M" in g:
        if not (month := MONTH.get(g["M"])):
            return none
        days = [(month, int(g["d"]))]
    elif "w" in g or "o" in g:
        try:
            day = date.fromisocalendar(year, int(g["w"]), int(g["wd"])) if "w" in g else date(year, 1, 1) + timedelta(int(g["o"]) - 1)
        except ValueError:
            return none
        if "o" in g and (day.year != year or g["o"] == "000"):
            return none
        year, days = day.year, [(day.month, day.day)]
    else:
        days = [(int(g["m"]), int(g["d"]))]
    if g.get("sign"):
        offset = (int(g["oh"]) * 60 + int(g["om"] or 0)) * (-1 if g["sign"] == "-" else 1)
    elif g.get("z"):
        offset = abbreviations.get(g["z"], UTC.get(g["z"]))
        if offset is None:
            return none
    else:
        offset = None
    us, formats, costs = [], [], []
    for k, (month, day) in enumerate(days):
        month_first = kind == "num" and (month, day) == (int(g["n1"]), int(g["n2"]))
        try:
            local = datetime(year, month, day, *clock)
        except ValueError:
            continue
        at = _micros(local)
        if offset is not None:
            found = [at - offset * 60_000_000]
        elif (z := _zone(zone)) is None:
            found = [at]
        else:
            first, second = (at - x.days * 86_400_000_000 - x.seconds * 1_000_000 for x in (z.utcoffset(local), z.utcoffset(local.replace(fold=1))))
            found = [first, second] if second > first else [first]
        us += found
        formats += [8 * shape + 4 * month_first + 2 * (offset is not None) + bool(g.get("half"))] * len(found)
        costs += [rule_weight * (k > 0 or j > 0) for j in range(len(found))]
    return us, formats, costs


def interpret(values: DataFrame, text: str, locale: str, zone: str, abbreviations: dict[str, int], rule_weight: float = 100.0) -> DataFrame:
    """values with us ARRAY<BIGINT>, fmt ARRAY<INT> (format) and cost ARRAY<DOUBLE>: all readings; empty arrays where there are none.

    ``abbreviations`` (minutes by letters) is a small fixed table. A reading against the locale's order or of the later of
    two instants costs ``rule_weight``.
    """
    letters = {a.lower(): m for a, m in abbreviations.items()}

    @F.pandas_udf("us array<bigint>, fmt array<int>, cost array<double>")
    def read(texts: pd.Series, locales: pd.Series, zones: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([readings_of(t, a, z, letters, rule_weight) for t, a, z in zip(texts, locales, zones, strict=True)], columns=["us", "fmt", "cost"])

    return values.withColumn("__r", read(text, locale, zone)).select(*values.columns, "__r.us", "__r.fmt", "__r.cost")


def ruled(readings: DataFrame) -> DataFrame:
    """readings (with us, fmt and cost of ``interpret``) with utc_us: the reading that no rule speaks against, which is the first; rows without one are left out."""
    keep = [c for c in readings.columns if c not in ("us", "fmt", "cost")]
    return readings.where(F.coalesce(F.get("cost", F.lit(0)) == 0, F.lit(False))).select(*keep, F.get("us", F.lit(0)).alias("utc_us"))


def _steps(us: list, fmt: list, cost: list, switch: float, back: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cheapest costs from each reading of the first record to each of the last, and for each record the reading on that path (first x last)."""
    n = len(us)
    total = np.full((len(us[0]), len(us[0])), np.inf)
    np.fill_diagonal(total, cost[0])
    back_to = []
    for i in range(1, n):
        move = switch * (np.asarray(fmt[i])[None, :] != np.asarray(fmt[i - 1])[:, None]) + back * (np.asarray(us[i])[None, :] < np.asarray(us[i - 1])[:, None])
        all_ = total[:, :, None] + move[None]
        back_to.append(all_.argmin(1))
        total = all_.min(1) + np.asarray(cost[i])[None, :]
    path = [np.tile(np.arange(total.shape[1]), (total.shape[0], 1))]
    rows = np.arange(total.shape[0])[:, None]
    for b in reversed(back_to):
        path.append(b[rows, path[-1]])
    return total, path[::-1]


def _solve(group: pd.DataFrame, edge: bool, switch: float, back: float) -> tuple[np.ndarray, list, dict | None]:
    """Choices of a run of records of one source. At an edge: choices by reading of the first and last record, and the piece."""
    us, fmt, cost = group["us"].to_numpy(), group["fmt"].to_numpy(), group["cost"].to_numpy()
    n = len(us)
    many = np.fromiter((len(x) > 1 for x in us), bool, n)
    choice, options = np.zeros(n, int), [None] * n
    first, last, left, right = 0, n, None, None
    if edge and not many.all():
        single = np.flatnonzero(~many)
        left, right = _steps(list(us[: single[0] + 1]), list(fmt[: single[0] + 1]), list(cost[: single[0] + 1]), switch, back), _steps(list(us[single[-1] :]), list(fmt[single[-1] :]), list(cost[single[-1] :]), switch, back)
        first, last = single[0], single[-1] + 1
    if edge:
        if left is None:
            total, path = _steps(list(us), list(fmt), list(cost), switch, back)
            options = [p.ravel().tolist() for p in path]
        else:
            a, b = len(us[0]), len(us[-1])
            total = left[0][:, :1] + right[0][:1, :]
            for i in range(first):
                options[i] = np.repeat(left[1][i][:, 0], b).tolist()
            for j, p in enumerate(right[1]):
                if last - 1 + j > first or last - 1 + j >= last:
                    options[last - 1 + j] = np.tile(p[0], a).tolist()
        piece = {"us0": list(map(int, us[0])), "us1": list(map(int, us[-1])), "fmt0": list(map(int, fmt[0])), "fmt1": list(map(int, fmt[-1])), "m": total.ravel().tolist()}
        if left is None:
            return choice, options, piece
    else:
        piece = None
    i = first
    while i < last:
        if not many[i]:
            i += 1
            continue
        j = i
        while j < last and many[j]:
            j += 1
        lo, hi = max(i - 1, first), min(j + 1, last)
        total, path = _steps(list(us[lo:hi]), list(fmt[lo:hi]), list(cost[lo:hi]), switch, back)
        a, b = np.unravel_index(total.argmin(), total.shape)
        for x in range(lo, hi):
            choice[x] = path[x - lo][a, b]
        i = j
    return choice, options, piece


def choose(readings: DataFrame, source: str, order: list[str], switch: float = 1.0, back: float = 2.0) -> DataFrame:
    """readings (with us, fmt and cost of ``interpret``) with utc_us and broken (cost of the reading chosen; above 0 it goes against a rule).

    Only records with a reading stay. ``order`` must be unique within a source, its columns not nested.
    """
    spark = readings.sparkSession
    keep = [c for c in readings.columns if c not in ("us", "fmt", "cost")]
    # Written once, as finding the borders of the ranges and the open sources would read all values again.
    rows = materialize(readings.where(F.size("us") > 0).withColumn("__source", F.coalesce(F.col(source).cast("string"), F.lit(""))), "values")
    unclear = materialize(rows.where(F.size("us") > 1).select(F.col("__source").alias("__open")).distinct(), "open-sources")
    flagged = rows.join(unclear, F.col("__source") == F.col("__open"), "left")
    settled = flagged.where("__open is null").select(*keep, F.get("us", F.lit(0)).alias("utc_us"), F.get("cost", F.lit(0)).alias("broken"))
    spread = flagged.where("__open is not null").drop("__open").repartitionByRange("__source", *order).sortWithinPartitions("__source", *order).withColumn("part", F.spark_partition_id())
    fields = {f.name: f.dataType.simpleString() for f in spread.schema}
    schema = ", ".join(f"`{c}` {fields[c]}" for c in keep) + ", `__source` string, part int, us array<bigint>, cost array<double>, choice int, options array<int>, piece struct<us0:array<bigint>,us1:array<bigint>,fmt0:array<int>,fmt1:array<int>,m:array<double>>"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [b for b in batches if len(b)]
        if not whole:
            return
        data = pd.concat(whole, ignore_index=True)
        sources = data["__source"].to_numpy()
        starts = np.r_[0, np.flatnonzero(sources[1:] != sources[:-1]) + 1]
        ends = np.r_[starts[1:], len(data)]
        many = np.fromiter((len(x) > 1 for x in data["us"]), bool, len(data))
        seen = np.r_[0, np.cumsum(many)]
        choice, options, pieces = np.zeros(len(data), np.int32), [None] * len(data), [None] * len(data)
        for a, b in zip(starts, ends, strict=True):
            edge = a == 0 or b == len(data)
            if not edge and seen[a] == seen[b]:
                continue
            choice[a:b], options[a:b], pieces[a] = _solve(data.iloc[a:b], edge, switch, back)
        out = data.drop(columns=["fmt"])
        yield out.assign(choice=choice, options=options, piece=pieces)

    solved = materialize(spread.select(*keep, "__source", "part", "us", "fmt", "cost").mapInPandas(solve, schema), "readings")
    pieces = solved.where("piece is not null").select("__source", "part", "piece.*")

    def stitch(key, group: pd.DataFrame) -> pd.DataFrame:
        """The cheapest way through the pieces of one source: at most one row per partition."""
        group = group.sort_values("part")
        g = group.to_dict("records")
        total, came = None, []
        for i, x in enumerate(g):
            m = np.asarray(x["m"], float).reshape(len(x["us0"]), len(x["us1"]))
            if i == 0:
                enter = np.zeros(len(x["us0"]))
                came.append(None)
            else:
                move = switch * (np.asarray(x["fmt0"])[None, :] != np.asarray(g[i - 1]["fmt1"])[:, None]) + back * (np.asarray(x["us0"])[None, :] < np.asarray(g[i - 1]["us1"])[:, None])
                step = total[:, None] + move
                came.append(step.argmin(0))
                enter = step.min(0)
            through = enter[:, None] + m
            came[-1] = (came[-1], through.argmin(0))
            total = through.min(0)
        at, picks = int(total.argmin()), []
        for i in range(len(g) - 1, -1, -1):
            enter = int(came[i][1][at])
            picks.append((g[i]["__source"], g[i]["part"], enter * len(g[i]["us1"]) + at))
            at = int(came[i][0][enter]) if i else 0
        return pd.DataFrame(picks, columns=["s", "p", "pick"])

    picks = pieces.groupBy("__source").applyInPandas(stitch, "s string, p int, pick int")
    joined = solved.join(picks, (F.col("__source") == F.col("s")) & (F.col("part") == F.col("p")), "left")
    index = F.when(F.col("options").isNotNull(), F.get("options", F.col("pick"))).otherwise(F.col("choice"))
    solved_now = joined.withColumn("__i", index).select(*keep, F.get("us", F.col("__i")).alias("utc_us"), F.get("cost", F.col("__i")).alias("broken"))
    return settled.unionAll(solved_now)
