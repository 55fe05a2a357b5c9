"""Health of a vault (I20, I21, I24, E8, E9): checks as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dates import session_day
from marginalia.functions.text import in_directory
from marginalia.operators.graph import isolates, link_edges
from marginalia.operators.vault_state import by_name

# Share of isolates, and least share of entities with full dates, that draw a warning.
ISOLATES, COVERAGE = 50, 60


def kind_counts(notes: DataFrame) -> DataFrame:
    """One row: notes by kind, entities with all of status, valid_from and a valid_until key, faults of shape."""
    path = F.col("rel_path")
    entity, session, signal = (in_directory(path, x) for x in ("entities", "sessions", "LearningLayer"))
    m = F.col("metadata")
    full = entity & (F.coalesce(m["status"], F.lit("")) != "") & (F.coalesce("valid_from", F.lit("")) != "") & (F.array_contains(F.map_keys(m), "valid_until") | F.col("valid_until").isNotNull())
    shaped = (F.coalesce(m["type"] == "session", F.lit(False)) | F.col("name").rlike(r"^session-\d{4}-\d{2}-\d{2}")) & ~session
    dated = session & session_day(F.col("date"), F.col("name")).isNotNull()
    return notes.agg(
        F.count("*").alias("notes"), F.count_if(entity).alias("entities"), F.count_if(session & ~entity).alias("sessions"),
        F.count_if(signal & ~session & ~entity).alias("signals"), F.count_if(~entity & ~session & ~signal).alias("other"),
        F.count_if(full).alias("full_dates"), F.count_if(shaped).alias("misplaced_sessions"), F.count_if(dated).alias("scannable_sessions"),
        F.count_if(m.isNull()).alias("faults"),
    )


def layout(notes: DataFrame) -> DataFrame:
    """One row ``layout``: flat (the known folders at the root), nested, mixed or none."""
    known = "(entities|sessions|LearningLayer)/"
    g = notes.agg(F.max(F.col("rel_path").rlike(f"^{known}")).alias("root"), F.max(F.col("rel_path").rlike(f"^.+/{known}")).alias("deep"))
    root, deep = F.coalesce("root", F.lit(False)), F.coalesce("deep", F.lit(False))
    return g.select(F.when(root & deep, "mixed").when(root, "flat").when(deep, "nested").otherwise("none").alias("layout"))


def checks(notes: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """``name, status, message`` for counts, frontmatter, sessions, graph, dates and interrupted batches."""
    one = by_name(notes).select("name")
    edges = link_edges(notes, self_loops=True)
    lonely = isolates(one, edges).agg(F.count("*").alias("isolates"))
    wide = kind_counts(notes).crossJoin(lonely).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(one.agg(F.count("*").alias("nodes"))).crossJoin(layout(notes))  # five rows of one
    share = F.when(F.col("nodes") > 0, 100 * F.col("isolates") / F.col("nodes")).otherwise(0.0)
    dated = F.when(F.col("entities") > 0, 100 * F.col("full_dates") / F.col("entities"))

    def check(name: str, state: Column | str, *message: Column | str) -> Column:
        state = F.lit(state) if isinstance(state, str) else state
        return F.struct(F.lit(name).alias("name"), state.alias("status"), F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in message]).alias("message"))

    c = F.col
    rows = F.array(
        check("layout", F.when(c("layout").isin("mixed", "none"), "warn").otherwise("pass"), c("layout")),
        check("counts", "pass", c("notes"), " notes: ", c("entities"), " entities, ", c("sessions"), " sessions, ", c("signals"), " signals, ", c("other"), " other"),
        check("frontmatter", F.when(c("faults") > 0, "warn").otherwise("pass"), c("faults"), " faults"),
        check("sessions", F.when(c("misplaced_sessions") > 0, "warn").when(c("scannable_sessions") == 0, "info").otherwise("pass"), c("scannable_sessions"), " dated, ", c("misplaced_sessions"), " outside sessions/"),
        check("graph", F.when((c("edges") == 0) & (c("nodes") > 0), "fail").when((share > ISOLATES) & (c("nodes") > 10), "warn").otherwise("pass"), c("nodes"), " nodes, ", c("edges"), " edges, ", c("isolates"), " isolates"),
        check("dates", F.when(dated.isNull(), "info").when(dated < COVERAGE, "warn").otherwise("pass"), c("full_dates"), " of ", c("entities"), " entities"),
    )
    out = wide.select(F.explode(rows).alias("r")).select("r.*")
    if stale is not None:
        s = stale.agg(F.count("*").alias("n"), F.count_if(~F.col("all_patched")).alias("partial"))
        state = F.when(F.col("partial") > 0, "fail").when(F.col("n") > 0, "warn").otherwise("pass")
        out = out.unionByName(s.select(check("batches", state, F.col("n"), " pending, ", F.col("partial"), " partial").alias("r")).select("r.*"))
    return out


def lint(faults: DataFrame) -> DataFrame:
    """``rel_path, kind, line, column, hint`` of each fault."""
    line = F.regexp_extract("error", r"line (\d+)", 1)
    column = F.regexp_extract("error", r"column (\d+)", 1)
    hint = F.when(F.col("error").contains("mapping values are not allowed"), "quote the value: it holds a colon").when(F.col("kind") == "read", "the file cannot be read as UTF-8").otherwise("check the frontmatter")
    return faults.select("rel_path", "kind", line.try_cast("int").alias("line"), column.try_cast("int").alias("column"), hint.alias("hint"))
