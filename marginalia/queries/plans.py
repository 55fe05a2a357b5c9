"""Queries of the composite verbs, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.links import target_set
from marginalia.functions.text import BUCKETS, NAME_STOP_WORDS
from marginalia.operators import bookkeeping, graph
from marginalia.operators.vault_state import by_name, current_notes
from marginalia.plans import bench, build, consolidate, doctor, gate, migrate, recall, scores
from marginalia.queries.general import _TARGET, _day
from marginalia.queries.tables import table, vault_log
from marginalia.queries.vault import RULES, TODAY, WINDOW
from marginalia.queries.vault_sql import LINKS, LIVE, PROPOSED, SEEN, _in, candidates, ranks
from marginalia.session import materialize, swept

#: Where the open threads of these vaults stand.
OPEN_TITLES = ["open point", "next step"]
_EVERYTHING = ["rel_path", "name", "metadata", "content", "raw_text", "touches", "valid_from", "valid_until", "superseded_by", "date"]
MIGRATION = [
    migrate.Rule("sessions", "**/sessions/*.md", "sessions", "session", "date_prefixed"),
    migrate.Rule("entities", "**/entities/*.md", "entities", None, "entity_prefix"),
    migrate.Rule("root sessions", "sessions/**/*.md", "sessions", "session", "date_prefixed"),
    migrate.Rule("signals", "LearningLayer/*.md", "LearningLayer", "learning-signals", "rename:signals-{stem}-old.md"),
    migrate.Rule("archive", "_archive/**/*.md", None, None, "preserve_name"),
    migrate.Rule("wiki", "wiki/**/*.md", "wiki", "wiki", "preserve_subpath"),
    migrate.Rule("rest", "**/*.md", "_archive/unmatched", None, "preserve_subpath"),
]


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return current_notes(vault_log(spark, d), _EVERYTHING)


def kind_counts(spark: SparkSession, d: str) -> DataFrame:
    return doctor.kind_counts(_notes(spark, d))


def vault_layout(spark: SparkSession, d: str) -> DataFrame:
    return doctor.layout(_notes(spark, d))


def doctor_checks(spark: SparkSession, d: str) -> DataFrame:
    return doctor.checks(_notes(spark, d))


def session_window(spark: SparkSession, d: str) -> DataFrame:
    found = consolidate.recent_sessions(_notes(spark, d), F.lit(TODAY).cast("date"), WINDOW)
    return found.select("rel_path", F.date_format("day", "yyyy-MM-dd").alias("day"))


def _touched(spark: SparkSession, d: str) -> DataFrame:
    notes = by_name(_notes(spark, d))
    return consolidate.touched_entities(notes, consolidate.recent_sessions(notes, F.lit(TODAY).cast("date"), WINDOW))


def touched_entities(spark: SparkSession, d: str) -> DataFrame:
    return _touched(spark, d).select("entity", "session", F.date_format("day", "yyyy-MM-dd").alias("day"))


def consolidation_blocks(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.activity_blocks(_touched(spark, d))


def newest_sessions(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.newest_per_entity(_touched(spark, d)).select("entity", "session")


def signal_lines(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.signal_lines(_notes(spark, d)).select("rel_path", F.col("pos").cast("bigint").alias("pos"), "line")


def reflect_buckets(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.reflection(consolidate.signal_lines(_notes(spark, d))).select("bucket", "n")


def domain_signals(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.domain_signals(consolidate.signal_lines(_notes(spark, d)), "report").select("rel_path", F.col("pos").cast("bigint").alias("pos"), "line")


def _brief(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    salience = bookkeeping.salience(bookkeeping.retrievals(table(spark, d, "retrieval_log")))
    return consolidate.brief_evidence(by_name(_notes(spark, d)), salience, F.lit(TODAY).cast("date"), WINDOW, OPEN_TITLES)


def brief_threads(spark: SparkSession, d: str) -> DataFrame:
    """The open threads of the most salient notes; in these vaults they stand under "Open points" and "Next steps"."""
    return _brief(spark, d)[2].select("name", F.col("pos").cast("bigint").alias("pos"), "thread")


def brief_signals(spark: SparkSession, d: str) -> DataFrame:
    return _brief(spark, d)[0].select("rel_path", "name")


def _probes(notes: DataFrame) -> DataFrame:
    """A probe per entity: what sessions touch most is asked for by its name's words; signals files are asked for nothing
    that exists, and must be abstained from."""
    notes = notes.where(F.col("name").rlike("^(entity-|signals-)"))
    asks = F.col("name").startswith("entity-")
    query = F.when(asks, F.concat(F.lit("where is "), F.regexp_replace("name", "-", " "), F.lit(" kept"))).otherwise(F.concat(F.lit("zz"), F.substring(F.sha2("name", 256), 1, 12)))
    gold = F.when(asks, F.array("name")).otherwise(F.array().cast("array<string>"))
    return notes.select(F.col("name").alias("id"), F.when(asks, "single-hop").otherwise("abstention").alias("category"), query.alias("query"), gold.alias("gold"))


def _hits(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    log = vault_log(spark, d).withColumn("body", F.xxhash64("raw_text"))  # texts are read twice and never shuffled
    row = F.struct("note_id", "seen_at", "body").alias("row")
    with swept(spark):
        notes = materialize(by_name(current_notes(log, ["rel_path", "name", "body"])).select("name", row), "notes")
        probes = _probes(notes)
        return probes, materialize(scores.keyword_hits(probes, notes, texts=log.select(row, "raw_text")), "hits")


def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)[1].select("id", "name", "score", F.col("rank").cast("bigint").alias("rank"))


def retrieval_scores(spark: SparkSession, d: str) -> DataFrame:
    s = scores.summary(scores.judge(*_hits(spark, d)))
    return s.select("category", "n", *[F.round(c, 6).alias(c) for c in ("hit_rate", "recall", "mrr", "pass_rate", "false_abstain")])


def walk_scores(spark: SparkSession, d: str) -> DataFrame:
    """What the boot walk finds for the entity of every note whose id is divisible by 100, and for the starter notes' entities."""
    log = vault_log(spark, d).withColumn("links", graph.links())  # links are read where notes are scanned; bodies are never shuffled
    notes = materialize(current_notes(log, ["rel_path", "name", "superseded_by", "valid_from", "links"]), "notes")
    one = materialize(by_name(notes.drop("links")), "named")
    probes = one.where(F.col("name").startswith("entity-") & ((F.col("note_id") % 100 == 0) | (F.col("note_id") < 0)))
    probes = materialize(probes.select(F.col("name").alias("id"), F.concat(F.lit("where is "), F.regexp_replace("name", "-", " "), F.lit(" kept")).alias("query")), "probes")
    return bench.walk_hits(probes, one, graph.link_edges(notes, self_loops=True))[0].select("id", "name", F.round("score", 9).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def unknown_gold(spark: SparkSession, d: str) -> DataFrame:
    """A probe per session that asks for what the session touches: the names among it that no note has."""
    notes = by_name(_notes(spark, d))
    probes = notes.where(F.col("name").startswith("session-")).select(F.col("name").alias("id"), target_set(F.col("touches")).alias("gold"))
    return scores.unknown_gold(probes, notes)


def migration_plan(spark: SparkSession, d: str) -> DataFrame:
    return migrate.plan(_notes(spark, d), MIGRATION, F.lit(TODAY).cast("date"))


def migration_counts(spark: SparkSession, d: str) -> DataFrame:
    return migrate.counts(migration_plan(spark, d)).select("rule", "action", "n")


def write_advice(spark: SparkSession, d: str) -> DataFrame:
    """Advice on every note the gate applies to that was written on the report's day or later, against all notes."""
    notes = materialize(_notes(spark, d).select("note_id", "rel_path", "name", "raw_text", "metadata", "content", "seen_at"), "notes")
    written = notes.where(F.col("seen_at") >= F.lit(TODAY).cast("timestamp_ntz")).select(F.col("note_id").alias("new_id"), "rel_path", "name", "raw_text", "metadata")
    return gate.advise(written, notes)


def boot_ranking(spark: SparkSession, d: str) -> DataFrame:
    notes = materialize(_notes(spark, d), "notes")
    hits = recall.boot(by_name(notes), graph.link_edges(notes, self_loops=True), "what did the client and the site crew tell the agent").hits
    return hits.select("name", F.round("score", 9).alias("score"))


def recall_fused(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid recall for the oldest usable chunk's vector, lane operational, over the nodes and lane-cut edges of an index."""
    nodes, edges = build.graph_tables(_notes(spark, d), RULES)
    laned = nodes.select(F.col("name").alias("note_name"), "lane", "rel_path")
    texts = table(spark, d, "chunks").select("id", "note_name", "section").distinct()
    vectors = table(spark, d, "vec_chunks").where("size(embedding) = 64").distinct()
    chunks = texts.join(vectors, "id").join(laned, "note_name")
    q = [float(x) for x in vectors.where(~F.exists("embedding", lambda x: F.isnan(x)) & F.exists("embedding", lambda x: x != 0)).orderBy("id").first()["embedding"]]
    found = recall.recall(nodes, edges, chunks, "handover of the vendor quote", q, "operational", RULES)
    return found.hits.select("name", F.round("score", 6).alias("score"), F.round("dense_sim", 6).alias("dense_sim"), "superseded", "best_section")


QUERIES = {
    f.__name__: f
    for f in (
        kind_counts, vault_layout, doctor_checks, session_window, touched_entities, consolidation_blocks, newest_sessions, signal_lines,
        reflect_buckets, domain_signals, brief_threads, brief_signals, keyword_hits, retrieval_scores, walk_scores, unknown_gold, migration_plan, migration_counts,
        write_advice, boot_ranking, recall_fused,
    )
}

_DIR = "contains('/' || rel_path, '/{0}/')"
_SESSION_DAY = f"CASE WHEN date IS NOT NULL THEN {_day('date')} ELSE try_strptime(nullif(regexp_extract(name, '^session-(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d')::DATE END"
_KINDS = f"""
flags AS (SELECT *, {_DIR.format('entities')} AS e, {_DIR.format('sessions')} AS s, {_DIR.format('LearningLayer')} AS l, {_SESSION_DAY} AS day FROM live),
kinds AS (SELECT count(*) AS notes, count(*) FILTER (e) AS entities, count(*) FILTER (s AND NOT e) AS sessions, count(*) FILTER (l AND NOT s AND NOT e) AS signals,
  count(*) FILTER (NOT e AND NOT s AND NOT l) AS other,
  count(*) FILTER (e AND coalesce(metadata['status'], '') <> '' AND coalesce(valid_from, '') <> '' AND (list_contains(map_keys(metadata), 'valid_until') OR valid_until IS NOT NULL)) AS full_dates,
  count(*) FILTER (NOT s AND (coalesce(metadata['type'] = 'session', false) OR regexp_matches(name, '^session-\\d{{4}}-\\d{{2}}-\\d{{2}}'))) AS misplaced_sessions,
  count(*) FILTER (s AND day IS NOT NULL) AS scannable_sessions, count(*) FILTER (metadata IS NULL) AS faults FROM flags)
"""
_LAYOUT = """
sides AS (SELECT coalesce(bool_or(regexp_matches(rel_path, '^(entities|sessions|LearningLayer)/')), false) AS r, coalesce(bool_or(regexp_matches(rel_path, '^.+/(entities|sessions|LearningLayer)/')), false) AS d FROM live),
shape AS (SELECT CASE WHEN r AND d THEN 'mixed' WHEN r THEN 'flat' WHEN d THEN 'nested' ELSE 'none' END AS layout FROM sides)
"""
_TOUCHED = LINKS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
recent AS (SELECT name AS session, content, touches, {_SESSION_DAY} AS day FROM named WHERE {_DIR.format('sessions')} AND {_SESSION_DAY} >= DATE '{TODAY}' - {WINDOW}),
said AS (SELECT session, dst AS name FROM links JOIN recent ON src = session UNION SELECT session, {_TARGET.format('t')} FROM (SELECT session, unnest(touches) AS t FROM recent)),
known AS (SELECT session, s.name FROM said s JOIN named n ON n.name = s.name WHERE NOT regexp_matches(s.name, '^(session-|signals-)')),
step AS (SELECT name AS node, {_TARGET.format('superseded_by')} AS next FROM named),
walk(start, node, path) AS (SELECT DISTINCT name, name, [name] FROM known
  UNION ALL SELECT w.start, n.node, list_append(w.path, n.node) FROM walk w JOIN step s ON s.node = w.node JOIN step n ON n.node = s.next WHERE NOT list_contains(w.path, n.node)),
final AS (SELECT start, arg_max(node, len(path)) AS entity FROM walk GROUP BY start),
touched AS (SELECT DISTINCT f.entity, k.session FROM known k JOIN final f ON f.start = k.name WHERE NOT regexp_matches(f.entity, '^(session-|signals-)')),
dated AS (SELECT entity, session, r.day, r.content FROM touched JOIN recent r USING (session)),
lines AS (SELECT entity, session, day, '- ' || strftime(day, '%Y-%m-%d') || ' — [[' || session || ']] — ' ||
  CASE WHEN regexp_extract(coalesce(content, ''), '(?m)^#+[ \\t]*([^\\n]+)', 1) <> '' THEN trim(regexp_extract(content, '(?m)^#+[ \\t]*([^\\n]+)', 1)) ELSE substr(regexp_replace(coalesce(content, ''), '^\\s+', ''), 1, 80) END AS line FROM dated)
"""
_SIGNALS = LIVE + f""",
files AS (SELECT rel_path, string_split(coalesce(content, ''), chr(10)) AS a FROM live WHERE {_DIR.format('LearningLayer')} AND metadata['type'] = 'learning-signals'),
flat AS (SELECT rel_path, regexp_replace(unnest(a), '^\\s+|\\s+$', '', 'g') AS line, generate_subscripts(a, 1) AS i FROM files),
sig AS (SELECT rel_path, line, row_number() OVER (PARTITION BY rel_path ORDER BY i) - 1 AS pos FROM flat WHERE starts_with(line, '- '))
"""
_PROBES = LIVE + """,
probes AS (SELECT name AS id, CASE WHEN starts_with(name, 'entity-') THEN 'single-hop' ELSE 'abstention' END AS category,
  CASE WHEN starts_with(name, 'entity-') THEN 'where is ' || replace(name, '-', ' ') || ' kept' ELSE 'zz' || substr(sha256(name), 1, 12) END AS query
  FROM named WHERE starts_with(name, 'entity-') OR starts_with(name, 'signals-')),
""" + f"""
asked AS (SELECT DISTINCT id, w AS word FROM (SELECT id, unnest(regexp_extract_all(lower(query), '[a-z0-9]{{3,}}')) AS w FROM probes) WHERE w NOT IN {_in(NAME_STOP_WORDS)}),
held AS (SELECT DISTINCT name, unnest(regexp_extract_all(lower(raw_text), '[a-z0-9]+')) AS word FROM named),
points AS (SELECT a.id, h.name, 1.0 AS p FROM asked a JOIN held h USING (word) UNION ALL SELECT a.id, n.name, 0.5 FROM asked a JOIN named n ON contains(lower(n.name), a.word)),
hits AS (SELECT id, name, sum(p)::DOUBLE AS score, row_number() OVER (PARTITION BY id ORDER BY sum(p) DESC, name) AS rank FROM points GROUP BY id, name QUALIFY rank <= 8)
"""

_BOOT = LINKS + f""",
asked AS (SELECT name FROM (SELECT name, regexp_replace(lower(name), '^entity-', '') AS base FROM named WHERE NOT regexp_matches(lower(name), '^(session-|signals-)'))
  WHERE list_has_any(list_append(list_filter(regexp_split_to_array(base, '[-_\\s/]+'), lambda x: length(x) >= 3 AND x NOT IN {_in(NAME_STOP_WORDS)}), base), ['what', 'did', 'the', 'client', 'and', 'site', 'crew', 'tell', 'agent'])),
step AS (SELECT name AS node, {_TARGET.format('superseded_by')} AS next FROM named),
walk(start, node, path) AS (SELECT name, name, [name] FROM asked
  UNION ALL SELECT w.start, n.node, list_append(w.path, n.node) FROM walk w JOIN step s ON s.node = w.node JOIN step n ON n.node = s.next WHERE NOT list_contains(w.path, n.node)),
ends AS (SELECT start, arg_max(node, len(path)) AS node FROM walk GROUP BY start)
"""


def _slugged(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(regexp_replace({x}, '\\.md$', '', 'i'), '[^a-zA-Z0-9\\s_-]', '', 'g'), '[\\s_]+', '-', 'g')"
    return f"coalesce(nullif(regexp_replace(lower(trim({bare}, '-')), '-+', '-', 'g'), ''), 'untitled')"


_MIGRATED = LIVE + f""",
files AS (SELECT *, split_part(rel_path, '/', -1) AS file, regexp_replace(split_part(rel_path, '/', -1), '\\.[^.]*$', '') AS stem,
  list_filter(list_transform(string_split(rel_path, '/')[2:], lambda p: {_slugged('p')}), lambda p: p <> '') AS inside,
  CASE WHEN regexp_matches(rel_path, '^([^/]+/)*sessions/[^/]*\\.md$') THEN 'sessions' WHEN regexp_matches(rel_path, '^([^/]+/)*entities/[^/]*\\.md$') THEN 'entities'
    WHEN regexp_matches(rel_path, '^sessions/([^/]+/)*[^/]*\\.md$') THEN 'root sessions' WHEN regexp_matches(rel_path, '^LearningLayer/[^/]*\\.md$') THEN 'signals'
    WHEN regexp_matches(rel_path, '^_archive/([^/]+/)*[^/]*\\.md$') THEN 'archive' WHEN regexp_matches(rel_path, '^wiki/([^/]+/)*[^/]*\\.md$') THEN 'wiki'
    WHEN regexp_matches(rel_path, '^([^/]+/)*[^/]*\\.md$') THEN 'rest' END AS rule,
  coalesce(nullif(regexp_extract(coalesce(metadata['date'], ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), ''), nullif(regexp_extract(coalesce(metadata['created'], ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), ''),
    nullif(regexp_extract(coalesce(metadata['valid_from'], ''), '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), ''), nullif(regexp_extract(split_part(rel_path, '/', -1), '\\d{{4}}-\\d{{2}}-\\d{{2}}'), ''), '{TODAY}') AS day,
  coalesce(metadata['type'] = 'stub', false) OR coalesce(metadata['source'] = 'auto-heal', false)
    OR (contains(substr(coalesce(content, ''), 1, 400), 'auto-generated because') AND contains(substr(coalesce(content, ''), 1, 400), 'did not exist')) AS stub FROM live),
acted AS (SELECT *, CASE WHEN contains(file, chr(92)) THEN 'skip' WHEN rule IS NULL THEN 'unmatched' WHEN stub THEN 'stub' WHEN rule = 'archive' THEN 'drop' ELSE 'write' END AS action FROM files),
planned AS (SELECT rel_path, rule, action, CASE WHEN action = 'write' THEN CASE
    WHEN rule IN ('sessions', 'root sessions') THEN 'sessions/' || day || '-' || {_slugged('stem')} || '.md'
    WHEN rule = 'entities' THEN 'entities/entity-' || CASE WHEN len(inside) > 0 THEN array_to_string(inside, '-') ELSE {_slugged('stem')} END || '.md'
    WHEN rule = 'signals' THEN 'LearningLayer/signals-' || stem || '-old.md'
    WHEN rule = 'wiki' THEN 'wiki/' || CASE WHEN len(inside) > 0 THEN array_to_string(inside, '/') ELSE {_slugged('stem')} END || '.md'
    ELSE '_archive/unmatched/' || CASE WHEN len(inside) > 0 THEN array_to_string(inside, '/') ELSE {_slugged('stem')} END || '.md' END END AS target,
  coalesce(CASE WHEN rule IN ('sessions', 'root sessions') THEN 'session' WHEN rule = 'signals' THEN 'learning-signals' WHEN rule = 'wiki' THEN 'wiki' END, metadata['type'], 'wiki') AS kind,
  day AS valid_from, 'vault:' || rel_path AS origin FROM acted)
"""

SQL = {
    "kind_counts": LIVE + "," + _KINDS + "SELECT * FROM kinds",
    "vault_layout": LIVE + "," + _LAYOUT + "SELECT layout FROM shape",
    "doctor_checks": LINKS + "," + _KINDS + "," + _LAYOUT + """,
c AS (SELECT *, (SELECT count(*) FROM named) AS nodes, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM named WHERE name NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)) AS lonely FROM kinds, shape)
SELECT 'layout' AS name, CASE WHEN layout IN ('mixed', 'none') THEN 'warn' ELSE 'pass' END AS status, layout AS message FROM c
UNION ALL SELECT 'counts', 'pass', notes || ' notes: ' || entities || ' entities, ' || sessions || ' sessions, ' || signals || ' signals, ' || other || ' other' FROM c
UNION ALL SELECT 'frontmatter', CASE WHEN faults > 0 THEN 'warn' ELSE 'pass' END, faults || ' faults' FROM c
UNION ALL SELECT 'sessions', CASE WHEN misplaced_sessions > 0 THEN 'warn' WHEN scannable_sessions = 0 THEN 'info' ELSE 'pass' END, scannable_sessions || ' dated, ' || misplaced_sessions || ' outside sessions/' FROM c
UNION ALL SELECT 'graph', CASE WHEN edge_count = 0 AND nodes > 0 THEN 'fail' WHEN 100.0 * lonely / nodes > 50 AND nodes > 10 THEN 'warn' ELSE 'pass' END, nodes || ' nodes, ' || edge_count || ' edges, ' || lonely || ' isolates' FROM c
UNION ALL SELECT 'dates', CASE WHEN entities = 0 THEN 'info' WHEN 100.0 * full_dates / entities < 60 THEN 'warn' ELSE 'pass' END, full_dates || ' of ' || entities || ' entities' FROM c""",
    "session_window": LIVE + f"SELECT rel_path, strftime({_SESSION_DAY}, '%Y-%m-%d') AS day FROM live WHERE {_DIR.format('sessions')} AND {_SESSION_DAY} >= DATE '{TODAY}' - {WINDOW}",
    "touched_entities": _TOUCHED + "SELECT entity, session, strftime(day, '%Y-%m-%d') AS day FROM dated",
    "consolidation_blocks": _TOUCHED + "SELECT entity, count(*) AS n_sessions, string_agg(line, chr(10) ORDER BY day DESC, session DESC) AS block FROM lines GROUP BY entity",
    "newest_sessions": _TOUCHED + "SELECT entity, arg_max(session, (day, session)) AS session FROM dated GROUP BY entity",
    "signal_lines": _SIGNALS + "SELECT rel_path, pos, line FROM sig",
    "reflect_buckets": _SIGNALS + "SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(line), '{'|'.join(w)}') THEN '{b}'" for b, w in BUCKETS.items()) + " ELSE 'other' END AS bucket, count(*) AS n FROM sig GROUP BY 1",
    "domain_signals": _SIGNALS + r"SELECT rel_path, pos, line FROM sig WHERE regexp_matches(lower(line), '#report([^\w-]|$)|\[\[report|(^|[^\w-])report([^\w-]|$)') ORDER BY rel_path DESC, pos LIMIT 12",
    "brief_threads": SEEN + "," + LIVE.strip().replace("WITH ", "", 1) + r""",
six AS (SELECT note_name AS name FROM sal ORDER BY recall_count DESC, note_name LIMIT 6),
parts AS (SELECT name, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM (SELECT name, regexp_split_to_array(regexp_replace(chr(10) || coalesce(content, ''), '\n(#{1,6}[ \t])', chr(1) || '\1', 'g'), chr(1)) AS a FROM named JOIN six USING (name))),
rows AS (SELECT name, i, unnest(b) AS line, generate_subscripts(b, 1) AS j FROM (SELECT name, i, string_split(p, chr(10))[2:] AS b FROM parts WHERE regexp_matches(lower(regexp_extract(p, '^#{1,6}[ \t]+([^\n]*)', 1)), 'open point|next step'))),
kept AS (SELECT name, row_number() OVER (PARTITION BY name ORDER BY i, j) - 1 AS pos, trim(regexp_replace(regexp_replace(line, '^\s+|\s+$', '', 'g'), '^- ', '')) AS thread FROM rows WHERE regexp_matches(line, '^\s*- '))
SELECT name, pos, thread FROM kept ORDER BY name, pos LIMIT 20""",
    "brief_signals": LIVE + f"""SELECT rel_path, name FROM named WHERE {_DIR.format('LearningLayer')} AND metadata['type'] = 'learning-signals'
AND coalesce(nullif(substr(valid_from, 1, 10), ''), nullif(substr(date, 1, 10), ''), regexp_extract(name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)) >= strftime(DATE '{TODAY}' - {WINDOW}, '%Y-%m-%d')""".replace("\\\\d", "\\d"),
    "keyword_hits": _PROBES + "SELECT id, name, score, rank FROM hits",
    "retrieval_scores": _PROBES + """, j AS (
  SELECT p.category, coalesce((SELECT max(score) < 2 FROM hits h WHERE h.id = p.id), true) AS abstained, (SELECT min(rank) FROM hits h WHERE h.id = p.id AND h.name = p.id AND p.category = 'single-hop') AS first FROM probes p),
f AS (SELECT category, abstained, first IS NOT NULL AS hit, CASE WHEN first IS NOT NULL THEN 1.0 ELSE 0.0 END AS recall, coalesce(1.0 / first, 0.0) AS rr, CASE WHEN category = 'abstention' THEN abstained ELSE first IS NOT NULL END AS passed FROM j),
a AS (SELECT * FROM f UNION ALL SELECT * REPLACE ('overall' AS category) FROM f WHERE category <> 'abstention')
SELECT category, count(*) AS n, round(avg(hit::INT), 6) AS hit_rate, round(avg(recall)::DOUBLE, 6) AS recall, round(avg(rr)::DOUBLE, 6) AS mrr, round(avg(passed::INT), 6) AS pass_rate, round(avg(abstained::INT), 6) AS false_abstain FROM a GROUP BY category""",
    "unknown_gold": LIVE + f""", gold AS (SELECT DISTINCT name AS id, {_TARGET.format("t")} AS name FROM (SELECT name, unnest(touches) AS t FROM named WHERE starts_with(name, 'session-')))
SELECT id, name FROM gold WHERE name IS NOT NULL AND name NOT IN (SELECT name FROM named)""",
    "write_advice": candidates("SELECT note_id, concat_ws(' ', raw_text, name) AS t FROM written").replace("live AS (", "live AS MATERIALIZED (", 1).replace("words AS (", f"""written AS (SELECT * FROM live WHERE seen_at >= TIMESTAMP '{TODAY}'
  AND (regexp_matches(split_part(rel_path, '/', -1), '^entity-.*\\.md$') OR ({_DIR.format('LearningLayer')} AND ends_with(rel_path, '.md')))),
words AS (""", 1) + "," + PROPOSED + """SELECT note_id::VARCHAR AS new_id, coalesce(verdict, 'ADD') AS verdict, target_path, summary
FROM written LEFT JOIN proposed p ON p.new_id = note_id LEFT JOIN summed s ON s.new_id = note_id""",
    "boot_ranking": ranks("SELECT DISTINCT f.node AS name FROM ends f", _BOOT) + """SELECT name, round(rank, 9) AS score FROM ranked JOIN named USING (name)
WHERE coalesce(superseded_by, '') = '' AND rank > 0 ORDER BY round(rank, 12) DESC, rel_path LIMIT 8""",
    "walk_scores": LINKS.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
bases AS (SELECT name, regexp_replace(lower(name), '^entity-', '') AS base FROM named WHERE NOT regexp_matches(lower(name), '^(session-|signals-)')),
keys AS (SELECT DISTINCT name, trim(regexp_replace(key, '[^a-z0-9'']+', ' ', 'g')) AS key FROM (
  SELECT name, base AS key FROM bases UNION ALL
  SELECT name, unnest(list_filter(regexp_split_to_array(base, '[-_\\s/]+'), lambda x: length(x) >= 3 AND x NOT IN {_in(NAME_STOP_WORDS)})) FROM bases)),
probes AS (SELECT name AS id, 'where is ' || replace(name, '-', ' ') || ' kept' AS query FROM named WHERE starts_with(name, 'entity-') AND (note_id % 100 = 0 OR note_id < 0)),
said AS (SELECT DISTINCT id, name FROM probes JOIN keys ON key <> '' AND contains(' ' || trim(regexp_replace(lower(query), '[^a-z0-9'']+', ' ', 'g')) || ' ', ' ' || key || ' ')),
step AS (SELECT name AS node, {_TARGET.format('superseded_by')} AS next FROM named),
walk(start, node, path) AS (SELECT DISTINCT name, name, [name] FROM said
  UNION ALL SELECT w.start, n.node, list_append(w.path, n.node) FROM walk w JOIN step s ON s.node = w.node JOIN step n ON n.node = s.next WHERE NOT list_contains(w.path, n.node)),
ends AS (SELECT start, arg_max(node, len(path)) AS node FROM walk GROUP BY start),
seeds AS (SELECT DISTINCT id, node AS name FROM said JOIN ends ON start = said.name),
ways AS MATERIALIZED (SELECT src, dst, 0.85::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM edges WHERE src IN (SELECT name FROM named)),
flow(k, id, name, y) AS (SELECT 0, id, name, 1.0::DOUBLE / count(*) OVER (PARTITION BY id) FROM seeds
  UNION ALL SELECT f.k + 1, f.id, w.dst, sum(f.y * w.share) FROM flow f JOIN ways w ON w.src = f.name
  WHERE f.k % 4 <> 0 OR f.k = 0 OR (SELECT sum(y) FROM flow) >= 1e-6 * (SELECT count(*) FROM named) GROUP BY f.k + 1, f.id, w.dst),
ranked AS (SELECT id, name, sum(y) / sum(sum(y)) OVER (PARTITION BY id) AS rank FROM flow GROUP BY id, name)
SELECT id, name, round(rank, 9) AS score, row_number() OVER (PARTITION BY id ORDER BY round(rank, 12) DESC, rel_path) AS rank
FROM ranked JOIN named USING (name) WHERE coalesce(superseded_by, '') = '' QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(rank, 12) DESC, rel_path) <= 8""",
    "migration_plan": _MIGRATED + "SELECT rel_path, rule, action, target, kind, valid_from, origin FROM planned",
    "migration_counts": _MIGRATED + "SELECT rule, action, count(*) AS n FROM planned GROUP BY rule, action",
}
