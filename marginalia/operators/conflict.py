"""Write-time conflicts (D14, I5-I7): what a new note contradicts or repeats, and what to do with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import comparable, same_root

# Similarity thresholds of related notes, duplicates and repeats.
RELATED, DUPLICATE, REPEAT = 0.35, 0.75, 0.95


def differing_keys(a: Column, b: Column) -> Column:
    """Keys both frontmatters have with different values, sorted. ``a``, ``b`` are :func:`comparable` maps."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.array_sort(F.filter(shared, lambda k: a[k] != b[k]))


def prefilter(candidates: DataFrame) -> DataFrame:
    """Adds ``conflicting_keys`` and ``flag`` to ``candidates(new_id, rel_path, score, new_meta, old_meta)``."""
    empty = F.create_map().cast("map<string,string>")
    keys = differing_keys(comparable(F.coalesce("new_meta", empty)), comparable(F.coalesce("old_meta", empty)))
    flag = F.when((F.size(keys) > 0) & (F.col("score") >= RELATED), "hard_conflict").when(F.col("score") >= DUPLICATE, "likely_duplicate").otherwise("unrelated")
    return candidates.withColumn("conflicting_keys", keys).withColumn("flag", flag)


def propose(findings: DataFrame) -> DataFrame:
    """``new_id, verdict, target_path`` from all findings of each new note.

    NOOP for a repeat (a likely duplicate of at least :data:`REPEAT`) if nothing conflicts, ADD if neither a conflict nor
    a duplicate is found, else UPDATE of the most similar conflict, else of the most similar duplicate; ties by path.
    """
    order = F.struct(-F.col("score"), "rel_path")

    def first(flag: str) -> Column:
        return F.min_by(F.when(F.col("flag") == flag, F.col("rel_path")), F.when(F.col("flag") == flag, order))

    g = findings.groupBy("new_id").agg(
        first("hard_conflict").alias("hard"),
        first("likely_duplicate").alias("dup"),
        F.max(F.when(F.col("flag") == "likely_duplicate", F.col("score"))).alias("dup_score"),
    )
    verdict = F.when(F.col("hard").isNull() & (F.col("dup_score") >= REPEAT), "NOOP").when(F.col("hard").isNull() & F.col("dup").isNull(), "ADD").otherwise("UPDATE")
    target = F.when(verdict == "ADD", None).otherwise(F.coalesce("hard", "dup"))
    return g.select("new_id", verdict.alias("verdict"), target.alias("target_path"))


def conflict_summary(findings: DataFrame) -> DataFrame:
    """``new_id, summary``: conflicts as "path on key, key; ..." in order of similarity."""
    line = F.concat("rel_path", F.lit(" on "), F.array_join("conflicting_keys", ", "))
    hard = findings.where("flag = 'hard_conflict'").groupBy("new_id").agg(F.array_sort(F.collect_list(F.struct(-F.col("score"), line.alias("line")))).alias("l"))
    return hard.select("new_id", F.array_join(F.transform("l", lambda x: x["line"]), "; ").alias("summary"))


def classify(candidates: DataFrame) -> DataFrame:
    """The heuristic verdict per ``new_id`` from ``(new_id, new_name, rel_path, name, score, superseded_by)``.

    In order: a candidate of the same name is updated (or what superseded it); a superseded best candidate is to be
    deleted; a best score of at least .75 with a shared name root, or of at least .55, is an update; else an addition.
    """
    order = F.struct(-F.col("score"), "rel_path")
    same = F.col("name") == F.col("new_name")
    successor = F.nullif("superseded_by", F.lit(""))
    g = candidates.groupBy("new_id", "new_name").agg(
        F.min_by(F.when(same, F.coalesce(successor, "rel_path")), F.when(same, order)).alias("named"),
        F.min_by(F.struct("rel_path", "name", "score", successor.alias("gone")), order).alias("top"),
    )
    top = F.col("top")
    verdict = (
        F.when(F.col("named").isNotNull(), "UPDATE").when(top["gone"].isNotNull(), "DELETE")
        .when((top["score"] >= 0.75) & same_root(F.col("new_name"), top["name"]), "UPDATE").when(top["score"] >= 0.55, "UPDATE").otherwise("ADD")
    )
    target = F.when(F.col("named").isNotNull(), F.col("named")).when(verdict != "ADD", top["rel_path"])
    return g.select("new_id", verdict.alias("verdict"), target.alias("target_path"))
