"""Small tables in the shape of the vault's, with extra columns whose names clash with inner ones."""

from __future__ import annotations

from datetime import datetime, timedelta

NOTE = """note_id long, rel_path string, name string, metadata map<string,string>, content string, raw_text string, touches array<string>,
valid_from string, valid_until string, superseded_by string, supersedes string, date string, deleted boolean, seen_at timestamp_ntz,
key string, r int, h long, day string, start string"""


def note(i, name, at, **k):
    seen = datetime(2025, 1, 1) + timedelta(days=at) if at is not None else None
    row = {"note_id": i, "name": name, "rel_path": k.get("rel_path", f"entities/{name}.md"), "metadata": k.get("metadata", {}), "deleted": k.get("deleted", False), "seen_at": seen}
    for c in ("content", "raw_text", "touches", "valid_from", "valid_until", "superseded_by", "supersedes", "date"):
        row[c] = k.get(c)
    return row | {"key": "x", "r": 1, "h": 2, "day": None, "start": "y"}


def table(spark, rows):
    cols = [c.split()[0] for c in NOTE.replace("\n", " ").split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], NOTE)


def dirty_vault(spark):
    """(notes, seeds, the rows of both)."""
    a = [
        note(1, "entity-A", 0, valid_from="2025-01-01", superseded_by=None, content="see [[entity-B|b]] and [[gone#x]] [[ ]] [[later]]"),
        note(1, "entity-A", 9, valid_from="01.01.2025", superseded_by="[[entity-A-v2#top]]", content="see [[entity-B]] [[gone]] [[later]] [[dead]]"),
        note(1, "entity-A", 9, valid_from="01.01.2025", superseded_by="[[entity-A-v2#top]]", content="see [[entity-B]] [[gone]] [[later]] [[dead]]"),
        note(2, "entity-A-v2", 8, valid_from="February 3, 2025", touches=[None, "", "entity-A", "[[nobody]]", "[[nobody]]"]),
        note(3, "entity-B", 1, valid_from="2025-13-40", superseded_by="entity-B"),
        note(4, "later", 30, content=None, raw_text=None, metadata=None),
        note(5, "dead", 2, content="x"),
        note(5, "dead", 5, deleted=True),
        note(6, "session-2025-02-10-x", 41, rel_path="sessions/session-2025-02-10-x.md", touches=["[[entity-A]]", None], metadata={"type": "session"}),
        note(7, "session-2025-02-20-y", 51, rel_path="sessions/session-2025-02-20-y.md", date="no day", touches=["[[entity-A]]"]),
        note(8, "session-2025-02-21-z", 52, rel_path="sessions/session-2025-02-21-z.md", date="2025/03/01", touches=["[[entity-A-v2]]", "[[seed-x]]", "[[entity-S]]"]),
        note(9, "entity-A-v3", 100, valid_from="2025-02-15", superseded_by="missing"),
        note(9, "entity-A-v3", 101, valid_from="20250215", superseded_by="[[entity-A-v2]]"),
        note(10, None, 3, content="[[gone]]", rel_path="wiki/none.md"),
        note(11, "long", 4, content="word " * 200_000 + "[[gone]]", rel_path="wiki/long.md"),
    ]
    s = [
        note(1, "entity-S", -300, valid_from="2024-03-05", superseded_by="entity-S-v2"),
        note(2, "entity-S-v2", -200, valid_from="2024-06-01T10:00:00"),
    ]
    return table(spark, a), table(spark, s), a, s


def tuples(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
