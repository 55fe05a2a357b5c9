"""Supersession chains: what was current, and what was current as of a day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dates import written_day
from marginalia.functions.links import link_target
from marginalia.session import materialize, materialize_with, release

#: The kinds of notes that describe an entity.
ENTITY_KINDS = ["entity", "project", "person", "stakeholder", "research-project", "agent"]


def resolve(notes: DataFrame, starts: DataFrame, as_of: Column | None = None) -> DataFrame:
    """``start, current, chain, hops``: follow ``superseded_by`` from each name of ``starts(name)``.

    ``notes`` has one row per ``name`` with ``superseded_by`` and ``valid_from``. The walk stops at a note without a
    successor, at a name seen before (a cycle), at a name no note has (it ends the chain but is never current) and, with
    ``as_of``, before the first note valid only later. ``current`` is the last note reached, null if the first one is
    missing or valid only later. A null start gives no row.

    Paths double: a note's path is lengthened by the path of the note it leads to, so a chain of n notes takes log2 n
    rounds of one equi-join, each over the notes whose path is not complete. A cycle is cut where it meets itself.
    """
    late = (F.col("since") > as_of) if as_of is not None else F.lit(False)
    step = notes.where("name is not null").select(F.col("name").alias("at"), link_target(F.col("superseded_by")).alias("next"), written_day(F.col("valid_from")).alias("since"))
    step = materialize(step.select("at", "next", F.coalesce(late, F.lit(False)).alias("late")), "steps")
    ahead = step.select(F.col("at").alias("next"), F.col("late").alias("next_late"))
    first = step.where("not late").join(ahead, "next", "left")
    goes = F.col("next").isNotNull() & (F.col("next") != F.col("at"))
    lost = goes & F.col("next_late").isNull()
    path = F.when(lost, F.array("at", "next")).otherwise(F.array("at"))
    onward = F.when(goes & ~F.col("next_late"), F.col("next"))
    paths = materialize(first.select("at", path.alias("path"), lost.alias("lost"), onward.alias("to")), "paths")
    while True:
        more = paths.select(F.col("at").alias("to"), F.col("path").alias("tail"), F.col("lost").alias("tail_lost"), F.col("to").alias("tail_to"))
        meets = F.array_position(F.transform("tail", lambda x: F.array_contains("path", x)), True)
        grown = paths.where("to is not null").join(more, "to").withColumn("meets", meets)
        whole = F.col("meets") == 0
        kept = F.when(whole, F.col("tail")).otherwise(F.slice("tail", F.lit(1), (F.col("meets") - 1).cast("int")))
        longer = grown.select("at", F.concat("path", kept).alias("path"), (whole & F.col("tail_lost")).alias("lost"), F.when(whole, F.col("tail_to")).alias("to"))
        step_, sums = materialize_with(paths.where("to is null").unionByName(longer), "paths", going=F.count_if(F.col("to").isNotNull()))
        release(paths)
        paths = step_
        if not sums["going"]:
            break
    reached = paths.select("at", "path", F.element_at("path", F.when(F.col("lost"), -2).otherwise(-1)).alias("current"))
    begun = starts.select(F.col("name").alias("start")).where("start is not null").distinct()
    found = begun.join(step.select(F.col("at").alias("start"), "late"), "start", "left").join(reached.withColumnRenamed("at", "start"), "start", "left")
    none = F.when(F.col("late"), F.array().cast("array<string>")).otherwise(F.array("start"))
    out = materialize(found.select("start", "current", F.coalesce("path", none).alias("chain")), "resolved")
    release(step)
    release(paths)
    return out.withColumn("hops", F.greatest(F.size("chain") - 1, F.lit(0)))


def current_entities(notes: DataFrame) -> DataFrame:
    """Notes of an entity kind without a successor."""
    kind = F.col("metadata")["type"]
    return notes.where(kind.isin(ENTITY_KINDS) & (F.coalesce("superseded_by", F.lit("")) == ""))


def resolved_seeds(seeds: DataFrame, resolution: DataFrame) -> DataFrame:
    """``name, hopped``: each distinct current version of the seeds, and whether any seed had to move to it."""
    joined = seeds.join(resolution, seeds["name"] == resolution["start"], "left").select(F.coalesce("current", "name").alias("now"), "name")
    return joined.withColumn("hopped", F.col("now") != F.col("name")).groupBy("now").agg(F.max("hopped").alias("hopped")).withColumnRenamed("now", "name")
