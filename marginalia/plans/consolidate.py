"""Consolidation of recent sessions into their entities (I8, I9), and what a nightly brief gathers (I16)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.dates import note_day, session_day
from marginalia.functions.links import target_set
from marginalia.functions.text import bucket, bullet_lines, headline, in_directory, section_bullets, with_section
from marginalia.operators.graph import link_pairs
from marginalia.operators.temporal import resolve
from marginalia.sources.connectors import Model
from marginalia.sources.stores import Patch

# The section kept up to date, days a report looks back, days and notes a brief looks at.
SECTION, WINDOW, LOOK_BACK, SALIENT, THREADS = "## Recent activity", 14, 3, 6, 20
# Words of the titles under which open threads stand.
OPEN = ["open thread", "recent activity"]


def recent_sessions(notes: DataFrame, today: Column, days: int = WINDOW) -> DataFrame:
    """Notes under ``sessions/`` of the last ``days`` days (later ones too), with their ``day``."""
    dated = notes.where(in_directory(F.col("rel_path"), "sessions")).withColumn("day", session_day(F.col("date"), F.col("name")))
    return dated.where(F.col("day") >= F.date_sub(today, days))


def touched_entities(notes: DataFrame, sessions: DataFrame) -> DataFrame:
    """``entity, day, session, content``: what the sessions link, moved on to current versions; sessions and signals
    are no entities, unknown names are dropped, a session counts once per entity."""
    linked = link_pairs(sessions).select(F.col("src").alias("session"), F.col("dst").alias("name"))
    touched = sessions.select(F.col("name").alias("session"), F.explode(target_set(F.col("touches"))).alias("name"))
    named = linked.unionByName(touched).where(~F.col("name").rlike("^(session-|signals-)") & (F.col("name") != "")).distinct()
    known = named.join(notes.select("name").distinct(), "name", "left_semi")
    now = resolve(notes, known.select("name")).where("current is not null").select(F.col("start").alias("name"), "current")
    pairs = known.join(now, "name").select("session", F.col("current").alias("entity")).distinct()
    pairs = pairs.where(~F.col("entity").rlike("^(session-|signals-)"))
    return pairs.join(sessions.select(F.col("name").alias("session"), "day", "content"), "session")


def activity_blocks(touched: DataFrame) -> DataFrame:
    """``entity, n_sessions, block``: one line per session, newest first."""
    line = F.concat(F.lit("- "), F.date_format("day", "yyyy-MM-dd"), F.lit(" — [["), "session", F.lit("]] — "), headline(F.col("content")))
    rows = touched.groupBy("entity").agg(F.count("*").alias("n_sessions"), F.sort_array(F.collect_list(F.struct("day", "session", line.alias("line"))), asc=False).alias("l"))
    return rows.select("entity", "n_sessions", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


def patches(notes: DataFrame, blocks: DataFrame) -> list[Patch]:
    """The changed files; one row per touched entity reaches the driver, which writes them anyway."""
    joined = notes.join(blocks.withColumnRenamed("entity", "name"), "name").select("rel_path", "raw_text", with_section(F.col("raw_text"), SECTION, F.col("block")).alias("after"), "block")
    return [Patch(r["rel_path"], r["raw_text"], r["after"], block=r["block"]) for r in joined.where("raw_text <> after").orderBy("rel_path").toLocalIterator()]


def signal_files(notes: DataFrame) -> DataFrame:
    """C9."""
    return notes.where(in_directory(F.col("rel_path"), "LearningLayer") & (F.col("metadata")["type"] == "learning-signals"))


def signal_lines(notes: DataFrame) -> DataFrame:
    """``rel_path, pos, line`` of every bullet of every signal file."""
    return signal_files(notes).select("rel_path", F.posexplode(bullet_lines(F.col("content"))).alias("pos", "line"))


def bucketed(lines: DataFrame) -> DataFrame:
    """``bucket, rel_path, pos, line``: every signal with its bucket; a report orders them by file and line."""
    return lines.select(bucket(F.col("line")).alias("bucket"), "rel_path", "pos", "line")


def reflection(lines: DataFrame) -> DataFrame:
    """``bucket, n``: signals by bucket, counted before they shuffle."""
    return bucketed(lines).groupBy("bucket").agg(F.count("*").alias("n"))


def domain_signals(lines: DataFrame, domain: str, most: int = 12) -> DataFrame:
    """The newest signal lines about a domain: tagged ``#d``, linked ``[[d``, or holding it as a whole word."""
    import re

    d = re.escape(domain.lower())
    about = F.lower("line").rlike(rf"#{d}(?![\w-])|\[\[{d}|(?<![\w-]){d}(?![\w-])")
    return lines.where(about).orderBy(F.desc("rel_path"), "pos").limit(most)


def brief_evidence(notes: DataFrame, salience: DataFrame, today: Column, days: int = LOOK_BACK, titles: Sequence[str] = OPEN) -> tuple[DataFrame, DataFrame, DataFrame]:
    """I16: (recent signal files, top salient notes, their open threads): what a nightly brief is written from."""
    since = F.date_format(F.date_sub(today, days), "yyyy-MM-dd")
    recent = signal_files(notes).where(note_day(F.col("valid_from"), F.col("date"), F.col("name")) >= since).select("rel_path", "name", "content")
    top = salience.orderBy(F.desc("recall_count"), "note_name").limit(SALIENT)
    threads = notes.join(top, notes["name"] == top["note_name"]).select("name", F.posexplode(section_bullets(F.col("content"), titles)).alias("pos", "thread"))
    return recent, top, threads.orderBy("name", "pos").limit(THREADS)


def newest_per_entity(touched: DataFrame) -> DataFrame:
    """The latest session of each entity, without gathering its others."""
    order = Window.partitionBy("entity").orderBy(F.desc("day"), F.desc("session"))
    return touched.withColumn("r", F.row_number().over(order)).where("r = 1").select("entity", "day", "session")


def reflect(lines: DataFrame, model: Model | None = None) -> str:
    """What the signals say, bucket by bucket; with a model, its themes. All lines of the learning layer pass through."""
    rows = [(r["bucket"], r["line"]) for r in bucketed(lines).orderBy("bucket", "rel_path", "pos").toLocalIterator()]
    if model and rows:
        return model("Name three to five themes in these observations, as short headings with bullets and nothing else.\n" + "\n".join(x for _, x in rows)).strip()
    out: list[str] = []
    for name, line in rows:
        out += ([] if f"### {name}" in out else [f"### {name}"]) + [line]
    return "\n".join(out) or "(no signals)"


def report(sessions: DataFrame, planned: Sequence[Patch], touched: DataFrame, lines: DataFrame, stamp: str, days: int = WINDOW, model: Model | None = None) -> str:
    """The consolidation report of a window: reflection, then each entity's patch with the sessions it rests on."""
    by_entity: dict[str, list[str]] = {}
    for r in touched.select("entity", "session").orderBy("entity", "session").toLocalIterator():
        by_entity.setdefault(r["entity"], []).append(r["session"])
    files = lines.select("rel_path").distinct().count()
    out = [f"# Consolidation {stamp}", "", f"- the last {days} days: {sessions.count()} sessions, {len(planned)} patches, {files} signal files", f"- reflection: {'a model' if model else 'by keywords'}", "", "## Reflection", reflect(lines, model), "", "## Patches"]
    for p in planned:
        name = p.rel_path.rsplit("/", 1)[-1].removesuffix(".md")
        out += [f"### {p.rel_path}", "from " + ", ".join(f"[[{x}]]" for x in by_entity.get(name, [])), "```markdown", p.block or "", "```"]
    return "\n".join(out if planned else [*out, "(none)"]) + "\n"
