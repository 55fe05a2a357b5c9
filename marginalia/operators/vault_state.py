"""The vault's current notes from its scan log, and one note per name."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.state import latest

_COLUMNS = ["rel_path", "name", "metadata", "content", "raw_text", "touches", "valid_from", "valid_until", "superseded_by", "supersedes", "date", "deleted"]


def current_notes(log: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Latest row of each note that is not deleted. Ask only for the columns needed: the rest is never shuffled."""
    cols = [*dict.fromkeys([*(columns or _COLUMNS), "deleted"])]
    state = latest(log, ["note_id"], "seen_at", cols)
    kept = state.where(~F.coalesce("deleted", F.lit(False)))
    return kept if columns is None or "deleted" in columns else kept.drop("deleted")


def by_name(notes: DataFrame) -> DataFrame:
    """One note per name: of duplicates the greatest ``rel_path`` wins everywhere."""
    rest = [c for c in notes.columns if c != "name"]
    best = notes.where("name is not null").groupBy("name").agg(F.max_by(F.struct(*rest), "rel_path").alias("r"))
    return best.select("name", *[F.col("r")[c].alias(c) for c in rest])


def duplicate_names(notes: DataFrame) -> DataFrame:
    """Names that several notes share: ``name, n, kept``."""
    return notes.groupBy("name").agg(F.count("*").alias("n"), F.max("rel_path").alias("kept")).where("n > 1")
