"""Rebuilding conversations from message rows.

``rebuild`` assembles the rows of each conversation into turns and keeps sound conversations only; ``sessions`` splits
channels without conversation identifiers at calibrated gaps of inactivity first. Both number rows by running totals
over range partitions, so a channel of a third of all rows is spread over many tasks and is never collected.

Defined results: rows with the same conversation and the same non-null external identifier are one message, held by
the lowest row identifier; null conversations give no turns; blank content (also no-break spaces only), unknown, null or
blank roles, holes or clashes in the ordinals, equal or missing instants, and dialogues that do not begin with user and
end with assistant drop the whole conversation; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.util import blank, materialize, running_totals, strip

#: Role names by spelling, roles that may occur, and roles that are turns.
ALIASES = {"human": "user", "ai": "assistant", "bot": "assistant"}
ALLOWED = ["user", "assistant", "system", "tool", "document", "event"]
TURNS = ["user", "assistant", "system", "tool"]


def role_of(raw: Column) -> Column:
    name = F.lower(strip(raw))
    for alias, role in ALIASES.items():
        name = F.when(name == alias, role).otherwise(name)
    return name


def messages(rows: DataFrame) -> DataFrame:
    """One narrow row per message: conversation_id, row_id, role, sound, ordinal."""
    narrow = rows.where(F.col("conversation_id").isNotNull()).select(
        "conversation_id", "external_id", F.when(F.col("external_id").isNull(), F.col("row_id")).alias("own"), "row_id", role_of(F.col("role")).alias("role"), (~blank(F.col("content"))).alias("filled"), "ordinal"
    )
    narrow = narrow.select("conversation_id", "external_id", "own", F.struct("row_id", F.when(F.col("role").isin(ALLOWED), F.col("role")).alias("role"), "filled", "ordinal").alias("m"))
    held = narrow.groupBy("conversation_id", "external_id", "own").agg(F.min("m").alias("m"))
    return held.select("conversation_id", "m.row_id", "m.role", (F.col("m.filled") & F.col("m.role").isNotNull()).alias("sound"), "m.ordinal")


def rebuild(rows: DataFrame, instants_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """conversation_id, turn_no, row_id, role of the turns of the sound conversations.

    ``instants_of`` takes the rows of conversations without ordinals and returns row_id, utc_us of those that have an instant.
    """
    held = materialize(messages(rows), "messages")
    numbers = held.groupBy("conversation_id").agg(
        F.count("*").alias("n"), F.count(F.when(~F.col("sound"), 1)).alias("unsound"), F.count("ordinal").alias("numbered"), F.min("ordinal").alias("low"), F.max("ordinal").alias("high")
    )
    may = materialize(numbers.where("unsound = 0 and (numbered = 0 or (numbered = n and low = 0 and high = n - 1))").select("conversation_id", "n", F.col("numbered") == 0), "candidates")
    may = may.toDF("conversation_id", "n", "timed")
    kept = held.join(may, "conversation_id")
    timed = may.where("timed").select("conversation_id")
    at = instants_of(rows.join(timed, "conversation_id", "left_semi"))
    by_time = kept.where("timed").join(at, "row_id", "left")
    columns = ["conversation_id", "n", "timed", "row_id", "role"]
    keyed = kept.where("not timed").select(*columns, F.col("ordinal").cast("bigint").alias("key")).unionAll(by_time.select(*columns, F.col("utc_us").alias("key")))
    turn, talk = F.col("role").isin(TURNS), F.col("role").isin("user", "assistant")
    counted = running_totals(keyed, ["conversation_id"], ["key", "row_id"], {"pos": F.lit(1), "turn": turn.cast("int")}, "turns")
    counted = materialize(counted, "turns")
    # Equal keys show as a key that is not the position (ordinals) or as fewer distinct instants than messages.
    whole = counted.groupBy("conversation_id").agg(
        F.first("n").alias("n"), F.bool_or("timed").alias("timed"), F.count("key").alias("keys"), F.bool_and((F.col("pos") - 1 == F.col("key")) | F.col("timed")).alias("in_order"),
        F.count_distinct(F.when(F.col("timed"), F.col("key"))).alias("instants"), F.min(F.when(talk, F.struct("pos", "role"))).alias("first"), F.max(F.when(talk, F.struct("pos", "role"))).alias("last"),
    )
    sound = whole.where("keys = n and in_order and (not timed or instants = n) and first.role = 'user' and last.role = 'assistant'").select("conversation_id")
    return counted.where(turn).join(sound, "conversation_id", "left_semi").select("conversation_id", (F.col("turn") - 1).cast("int").alias("turn_no"), "row_id", "role")


def _gaps(events: DataFrame) -> DataFrame:
    """channel, at, id, gap (seconds since the row before in the channel), part; a channel may lie in many partitions."""
    spread = materialize(events.repartitionByRange("channel", "at", "id").withColumn("part", F.spark_partition_id()), "channel")
    before = F.lag("at").over(Window.partitionBy("channel", "part").orderBy("at", "id"))
    ends = spread.groupBy("channel", "part").agg(F.max("at").alias("end"))
    ends = ends.select(F.col("channel").alias("c"), F.col("part").alias("p"), F.lag("end").over(Window.partitionBy("channel").orderBy("part")).alias("end_before"))
    rows = spread.withColumn("before", before).join(ends, (F.col("channel") == F.col("c")) & (F.col("part") == F.col("p")))
    return rows.select("channel", "at", "id", "role", ((F.col("at") - F.coalesce("before", "end_before")) / 1_000_000).alias("gap"))


def calibrated_gap(gaps: DataFrame, least: float = 60.0) -> float:
    """Seconds of inactivity that end a session: the sparsest octave between the commonest gap and the longest ones.

    The histogram has one row per power of two, at most 64. Without gaps the answer is ``least``.
    """
    bins = gaps.where("gap > 0").groupBy(F.greatest(F.floor(F.log2("gap")), F.lit(0)).cast("int").alias("b")).count().collect()
    count = {r.b: r["count"] for r in bins}
    if not count:
        return least
    top, last = max(count, key=lambda b: (count[b], -b)), max(count)
    valley = min(range(top + 1, last + 1), key=lambda b: (count.get(b, 0), b), default=last)
    return max(least, float(2**valley) * 1.5)


def _numbered(events: DataFrame, gap: float | None) -> DataFrame:
    """channel, at, id, role, begins, session_no of the rows with channel and time."""
    usable = events.where("channel is not null and at is not null").select("channel", "at", "id", "role")
    gaps = materialize(_gaps(usable), "gaps")
    gap = calibrated_gap(gaps) if gap is None else gap
    begins = F.coalesce((F.col("gap") > gap), F.lit(True)).cast("int")
    return running_totals(gaps.select("channel", "at", "id", "role", begins.alias("begins")), ["channel"], ["at", "id"], {"session_no": F.col("begins")}, "sessions")


def session_turns(events: DataFrame, gap: float | None = None) -> DataFrame:
    """channel, session_no, turn_no, id, role: the turns of the sessions with reciprocal replies, in order; session_no as in the channel, turn_no from 0.

    events as for sessions(), each message once. A role that is missing or unknown is inferred: user and assistant take
    turns from the last known one in the session on, else back from the first known one, else from user on.
    """
    key = ["channel", "session_no"]
    talk = F.coalesce(F.col("role").isin("user", "assistant"), F.lit(False))
    unknown = ~F.coalesce(F.col("role").isin(ALLOWED), F.lit(False))
    turn = unknown | F.coalesce(F.col("role").isin(TURNS), F.lit(False))
    numbered = _numbered(events, gap).select(*key, "at", "id", "role", talk.alias("talk"), unknown.alias("unknown"), turn.alias("is_turn"))
    counted = running_totals(numbered, key, ["at", "id"], {"pos": (F.col("talk") | F.col("unknown")).cast("int"), "known": F.col("talk").cast("int"), "turn": F.col("is_turn").cast("int")}, "session-turns")
    counted = materialize(counted.where("is_turn"), "session-turns")
    near = counted.where("talk").select(*key, F.col("known").alias("near"), F.col("pos").alias("near_pos"), F.col("role").alias("near_role"))
    unknowns = counted.where("unknown").withColumn("near", F.greatest("known", F.lit(1))).join(near, [*key, "near"], "left")
    as_near = (F.coalesce(F.col("pos") - F.col("near_pos"), F.col("pos") - 1) % 2) == 0
    role = F.when(as_near == (F.coalesce("near_role", F.lit("user")) == "user"), "user").otherwise("assistant")
    columns = [*key, "at", "turn", "id"]
    turns = materialize(counted.where("not unknown").select(*columns, "role").unionAll(unknowns.select(*columns, role.alias("role"))), "turns")
    replied = turns.groupBy(*key).agg(F.min(F.when(F.col("role") == "user", F.struct("at", "id"))).alias("asked"), F.max(F.when(F.col("role") == "assistant", F.struct("at", "id"))).alias("answered")).where("answered > asked").select(*key)
    return turns.join(replied, key, "left_semi").select(*key, (F.col("turn") - 1).cast("int").alias("turn_no"), "id", "role")


def sessions(events: DataFrame, gap: float | None = None) -> DataFrame:
    """channel, session_no, n, n_user, n_assistant, start_us, end_us of the sessions with reciprocal replies.

    events: channel, at (micros), id (unique), role. Rows without channel or time belong to no session. A session counts if the user spoke and an assistant answered later.
    """
    out = _numbered(events, gap).groupBy("channel", "session_no").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("role") == "user", 1)).alias("n_user"), F.count(F.when(F.col("role") == "assistant", 1)).alias("n_assistant"),
        F.min(F.when(F.col("role") == "user", F.col("at"))).alias("asked"), F.max(F.when(F.col("role") == "assistant", F.col("at"))).alias("answered"),
        F.min("at").alias("start_us"), F.max("at").alias("end_us"),
    )
    return out.where("n_user > 0 and n_assistant > 0 and answered >= asked").select("channel", "session_no", "n", "n_user", "n_assistant", "start_us", "end_us")
