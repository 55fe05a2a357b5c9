"""Entities and their versions over linked notes: supersession components, ordered by the day each became valid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.dates import written_day
from marginalia.functions.links import link_target
from marginalia.operators.components import connected_components
from marginalia.operators.history import merkle_changes
from marginalia.session import materialize

_KEYS = ["src", "note_id"]
_ATTRIBUTES = ["name", "valid_from", "superseded_by", "deleted"]


def entity_log(notes: DataFrame, seeds: DataFrame) -> DataFrame:
    """The rows of all ``entity-`` notes; ``src`` keeps the two tables' ids apart."""
    cols = ["note_id", *_ATTRIBUTES, "seen_at"]
    rows = notes.select(F.lit(0).alias("src"), *cols).unionByName(seeds.select(F.lit(1).alias("src"), *cols))
    return rows.where(F.col("name").startswith("entity-"))


def entity_history(log: DataFrame) -> DataFrame:
    """Every version of each entity note's attributes; see :func:`merkle_changes`."""
    return merkle_changes(log, _KEYS, _ATTRIBUTES, "seen_at")


def entity_states(log: DataFrame) -> DataFrame:
    """Current state of each entity note: the open versions of its history."""
    return materialize(entity_history(log).where("open").select(*_KEYS, *_ATTRIBUTES, "seen_at"), "states")


def entity_members(states: DataFrame) -> DataFrame:
    """``states`` plus ``component``. Notes joined by ``superseded_by``, in either direction, share a component.

    A link goes through a node for the name it targets, so notes that share a targeted name cost one edge each. Targets
    no entity note has are dangling and join nothing.
    """
    note = F.concat_ws(":", F.col("src"), F.col("note_id"))
    rows = states.withColumn("node", note).withColumn("target", link_target(F.col("superseded_by")))
    links = rows.where("target is not null").select(F.col("node").alias("a"), F.concat(F.lit("@"), "target").alias("b"))
    hubs = rows.select(F.col("node").alias("a"), F.concat(F.lit("@"), "name").alias("b"))
    targeted = hubs.join(links.select("b").distinct(), "b", "left_semi")
    known = links.join(hubs.select("b").distinct(), "b", "left_semi")
    edges = materialize(targeted.select("a", "b").unionByName(known.select("a", "b")), "links")
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node")))
    parts = connected_components(nodes, edges)
    joined = rows.join(parts, "node", "left")
    return joined.select(*states.columns, F.coalesce("component", "node").alias("component"))


def entity_names(members: DataFrame) -> DataFrame:
    """``component, entity`` for components of at least two dated versions; named after the earliest (then the smaller name)."""
    dated = members.select("component", "name", written_day(F.col("valid_from")).alias("day")).where("day is not null")
    groups = dated.groupBy("component").agg(F.count("*").alias("n"), F.min(F.struct("day", "name")).alias("first"))
    return groups.where("n >= 2").select("component", F.col("first.name").alias("entity"))


def entity_versions(members: DataFrame) -> DataFrame:
    """``entity, version, valid_from, valid_to`` (days as text, '' for the open end).

    The day each version ends is the day of the next one by (day, name). The order is found in two windows, one within a
    month of a component and one over its months, so no window sees more than a month of one entity or its calendar.
    """
    dated = members.select("component", F.col("name").alias("version"), written_day(F.col("valid_from")).alias("day")).where("day is not null")
    dated = dated.join(entity_names(members), "component").withColumn("month", F.trunc("day", "month"))
    months = dated.groupBy("component", "month").agg(F.min("day").alias("first_day"))
    later = months.withColumn("later", F.lead("first_day").over(Window.partitionBy("component").orderBy("month")))
    within = F.lead("day").over(Window.partitionBy("component", "month").orderBy("day", "version"))
    rows = dated.withColumn("next", within).join(later.drop("first_day"), ["component", "month"])
    text = F.date_format(F.coalesce("next", "later"), "yyyy-MM-dd")
    return rows.select("entity", "version", F.date_format("day", "yyyy-MM-dd").alias("valid_from"), F.coalesce(text, F.lit("")).alias("valid_to")).distinct()
