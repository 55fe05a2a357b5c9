"""Attributes as known at event time, through dyadic time nodes.

A half-open validity interval of days splits into at most two aligned power-of-two blocks per level. An event day lies
in exactly one block per level, so "the interval holds the day" becomes an equi-join on (entity, level, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.dates import session_day, written_day
from marginalia.functions.links import target_set
from marginalia.operators.state import latest
from marginalia.operators.versions import entity_log, entity_members, entity_names, entity_states
from marginalia.session import materialize

#: Levels of the time tree: days 0 to 2^16 - 1 since 1970-01-01, up to the year 2149. Days outside share the first or the last
#: block; they are compared as they are.
LEVELS = 16
END_OF_TIME = 1 << LEVELS


def day_number(day: Column) -> Column:
    """Days since 1970-01-01, below 0 before it; null for null."""
    return F.datediff(day, F.lit("1970-01-01").cast("date"))


def clamped(number: Column) -> Column:
    """A day number within the tree; null for null (``least`` and ``greatest`` alone would skip it)."""
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0)), F.lit(END_OF_TIME - 1)))


def interval_nodes(start: Column, end: Column) -> Column:
    """The disjoint blocks ``(level, block)`` that make up ``[start, end)``; empty where it is empty or an end is null."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("int")
        lo, hi = F.ceil(start / size).cast("int"), F.floor(end / size).cast("int")
        left = F.when((lo < hi) & (lo % 2 == 1), F.struct(level.alias("level"), lo.alias("block")))
        right = F.when((lo < hi) & (hi % 2 == 1), F.struct(level.alias("level"), (hi - 1).alias("block")))
        return F.filter(F.array(left, right), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def enclosing_nodes(day: Column) -> Column:
    """The block of every level that holds ``day``, a day within the tree."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.struct(k.alias("level"), F.floor(day / F.pow(F.lit(2), k)).cast("int").alias("block")))


def as_of(events: DataFrame, intervals: DataFrame, key: str, rank: list[str], payload: list[str]) -> DataFrame:
    """``key, day`` of ``events`` with ``payload`` of the best interval that holds the day.

    ``events(key, day)``, ``intervals(key, start, end, rank..., payload...)``, days as numbers, intervals half-open and within
    the tree. Best is
    the greatest ``rank`` (compared in order, ``rank[0]`` may not exceed the event's day), which must tell intervals apart.
    Events are first reduced to distinct (key, day) and intervals to the best per (block, rank[0]): a hot key contributes
    no more than its calendar, however many rows it has. Events without a valid interval give no row.
    """
    points = events.where(F.col(key).isNotNull() & F.col("day").isNotNull()).select(key, "day").distinct()
    spots = points.select(key, "day", F.explode(enclosing_nodes(clamped(F.col("day")))).alias("n")).select(key, "day", "n.level", "n.block")
    blocks = intervals.select(key, *{*rank, *payload}, F.explode(interval_nodes(F.col("start"), F.col("end"))).alias("n")).select("*", "n.level", "n.block")
    best = F.max(F.struct(*rank, *[c for c in payload if c not in rank])).alias("best")
    reduced = blocks.groupBy(key, "level", "block", F.col(rank[0]).alias("__r")).agg(best)
    # sizes are estimated before the explosion into blocks: never let that estimate choose a broadcast
    held = spots.hint("merge").join(reduced, [key, "level", "block"]).where(F.col("__r") <= F.col("day"))
    chosen = held.groupBy(key, "day").agg(F.max("best").alias("best"))
    return chosen.select(key, "day", *[F.col("best")[c].alias(c) for c in payload])


def known_intervals(log: DataFrame) -> DataFrame:
    """``src, note_id, start, end``: the days each row was its note's latest, and ``valid_from`` as a day number.

    Rows of one day collapse to the day's last before the window, so a hot note is bounded by its days.
    """
    daily = latest(log.withColumn("start", clamped(day_number(F.to_date("seen_at")))), ["src", "note_id", "start"], "seen_at", ["name", "valid_from"])
    until = F.lead("start").over(Window.partitionBy("src", "note_id").orderBy("start"))
    return daily.select("src", "note_id", "name", "start", F.coalesce(until, F.lit(END_OF_TIME)).alias("end"), day_number(written_day(F.col("valid_from"))).alias("valid"))


def session_entity_versions(notes: DataFrame, seeds: DataFrame) -> DataFrame:
    """``note_id, entity, version``: for each session and each entity it touches, the version valid and known on its day.

    Sessions are taken by their latest row; deleted ones and ones whose ``date`` names no day give nothing. A version
    counts from the day its row was seen, so what became known later is never used; of those known the greatest
    ``valid_from`` not after the day wins, then the greater name.
    """
    log = materialize(entity_log(notes, seeds), "entities")
    members = materialize(entity_members(entity_states(log)).select("src", "note_id", "name", "valid_from", "component"), "members")
    named = materialize(entity_names(members), "named")
    of_note = members.join(named, "component").select("src", "note_id", "name", "entity", "component")
    sessions = latest(notes.where(F.col("name").startswith("session-")), ["note_id"], "seen_at", ["name", "date", "touches", "deleted"])
    dated = sessions.where(~F.coalesce("deleted", F.lit(False))).select("note_id", session_day(F.col("date"), F.col("name")).alias("d"), F.explode(target_set(F.col("touches"))).alias("name"))
    touched = dated.where("d is not null").select("note_id", day_number(F.col("d")).alias("day"), "name")
    cases = materialize(touched.join(of_note.select("name", "entity", "component").distinct(), "name").select("note_id", "day", "entity", "component").distinct(), "cases")
    intervals = known_intervals(log).where("valid is not null").join(of_note.select("src", "note_id", "component"), ["src", "note_id"])
    found = as_of(cases, intervals, "component", ["valid", "name"], ["name"])
    return cases.join(found, ["component", "day"]).select("note_id", "entity", F.col("name").alias("version")).distinct()
