"""Queries of the general training-data problems: orphan references (2), histories (4) and as-of attributes (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import asof, orphans, versions
from marginalia.queries.tables import table


def _vault(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "notes"), table(spark, d, "seed_notes")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_references(*_vault(spark, d)).select("note_id", "ref_field", "target", "state")


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(*_vault(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    members = versions.entity_members(versions.entity_states(versions.entity_log(*_vault(spark, d))))
    return versions.entity_versions(members)


def p4_history(spark: SparkSession, d: str) -> DataFrame:
    """Attribute history of every ``entity-`` note: each change in the log, from the time it was seen to that of the next."""
    log = versions.entity_log(*_vault(spark, d))
    h = versions.entity_history(log)
    return h.select("src", "note_id", "name", "valid_from", "superseded_by", "deleted", F.col("seen_at").cast("string").alias("from_seen"), F.col("until").cast("string").alias("to_seen"), F.col("open").alias("is_open"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return asof.session_entity_versions(*_vault(spark, d))


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p4_found, p4_history, p5_found)}

_LINK = r"\[\[([^\]|#]+?)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
_TARGET = f"nullif(coalesce(nullif(trim(regexp_extract({{0}}, '{_LINK}', 1)), ''), regexp_replace({{0}}, '^\\s+|\\s+$', '', 'g')), '')"

_ORPHANS = f"""
WITH rows AS (
  SELECT 0 AS src, note_id, name, touches, content, coalesce(deleted, false) AS deleted, seen_at FROM notes
  UNION ALL SELECT 1, note_id, name, NULL, NULL, coalesce(deleted, false), seen_at FROM seed_notes),
state AS (SELECT src, note_id, max(seen_at) AS last_seen, max_by(deleted, seen_at) AS gone FROM rows GROUP BY src, note_id),
named AS (
  SELECT r.name, min(r.seen_at) AS born, bool_or(NOT s.gone) AS live
  FROM rows r JOIN state s USING (src, note_id) WHERE r.name IS NOT NULL GROUP BY r.name),
raw AS (
  SELECT note_id, seen_at, 'touches' AS ref_field, {_TARGET.format("t")} AS target
  FROM (SELECT note_id, seen_at, unnest(touches) AS t FROM rows WHERE src = 0)
  UNION ALL
  SELECT note_id, seen_at, 'content', nullif(trim(t), '')
  FROM (SELECT note_id, seen_at, unnest(regexp_extract_all(content, '{_LINK}', 1)) AS t FROM rows WHERE src = 0)),
refs AS (
  SELECT note_id, ref_field, target, min(seen_at) AS first_seen, max(seen_at) AS ref_seen
  FROM raw WHERE target IS NOT NULL GROUP BY ALL),
found AS (
  SELECT r.note_id, r.ref_field, r.target, r.first_seen,
    CASE WHEN n.name IS NULL THEN 'missing' WHEN NOT n.live THEN 'deleted' WHEN n.born > r.first_seen THEN 'late' END AS state
  FROM refs r JOIN state s ON s.src = 0 AND s.note_id = r.note_id AND s.last_seen = r.ref_seen AND NOT s.gone
  LEFT JOIN named n ON n.name = r.target)
"""


def _day(x: str) -> str:
    s = f"regexp_replace({x}, '^[\\s''\"]+|[\\s''\"]+$', '', 'g')"
    formats = [(r"^\d{4}-\d{1,2}-\d{1,2}", "%Y-%m-%d"), (r"^\d{4}/\d{1,2}/\d{1,2}", "%Y/%m/%d"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "%d.%m.%Y"), (r"^\d{8}$", "%Y%m%d"), (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "%d %b %Y"), (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "%B %d, %Y")]
    return "coalesce(" + ", ".join(f"CAST(try_strptime(nullif(regexp_extract({s}, '{p}'), ''), '{f}') AS DATE)" for p, f in formats) + ")"


_ENTITIES = f"""
WITH RECURSIVE log AS (
  SELECT 'n' || note_id AS k, name, valid_from, superseded_by, seen_at FROM notes WHERE name LIKE 'entity-%'
  UNION ALL SELECT 's' || note_id, name, valid_from, superseded_by, seen_at FROM seed_notes WHERE name LIKE 'entity-%'),
state AS (SELECT k, max_by(name, seen_at) AS name, arg_max_null(valid_from, seen_at) AS valid_from, arg_max_null(superseded_by, seen_at) AS superseded_by FROM log GROUP BY k),
links AS (SELECT a.k AS a, b.k AS b FROM state a JOIN state b ON b.name = {_TARGET.format("a.superseded_by")}),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT k, k FROM state UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
parts AS (SELECT a AS k, min(b) AS component FROM reach GROUP BY a),
dated AS (SELECT component, name, {_day("valid_from")} AS day FROM state JOIN parts USING (k)),
groups AS (SELECT component, arg_min(name, (day, name)) AS entity FROM dated WHERE day IS NOT NULL GROUP BY component HAVING count(*) >= 2)
"""

SQL = {
    "p2_found": _ORPHANS + "SELECT note_id, ref_field, target, state FROM found WHERE state IS NOT NULL",
    "p2_counts": _ORPHANS + "SELECT ref_field, strftime(first_seen, '%Y-%m') AS month, state, count(*) AS n_refs, count(DISTINCT target) AS n_targets FROM found WHERE state IS NOT NULL GROUP BY ALL",
    "p4_found": _ENTITIES + """SELECT DISTINCT entity, name AS version, strftime(day, '%Y-%m-%d') AS valid_from,
  coalesce(strftime(lead(day) OVER (PARTITION BY component ORDER BY day, name), '%Y-%m-%d'), '') AS valid_to
FROM dated JOIN groups USING (component) WHERE day IS NOT NULL""",
    "p4_history": """
WITH log AS (
  SELECT 0 AS src, note_id, name, valid_from, superseded_by, deleted, seen_at FROM notes WHERE starts_with(name, 'entity-')
  UNION SELECT 1, note_id, name, valid_from, superseded_by, deleted, seen_at FROM seed_notes WHERE starts_with(name, 'entity-')),
state AS (SELECT *, {'a': name, 'b': valid_from, 'c': superseded_by, 'd': deleted} AS s FROM log WHERE seen_at IS NOT NULL),
old AS (SELECT *, lag(s) OVER w AS was, row_number() OVER w AS i FROM state WINDOW w AS (PARTITION BY src, note_id ORDER BY seen_at)),
new AS (SELECT *, lead(seen_at) OVER (PARTITION BY src, note_id ORDER BY seen_at) AS until FROM old WHERE i = 1 OR was IS DISTINCT FROM s)
SELECT src, note_id, name, valid_from, superseded_by, deleted, seen_at::VARCHAR AS from_seen, until::VARCHAR AS to_seen, until IS NULL AS is_open FROM new""",
    "p5_found": _ENTITIES + f""",
session AS (SELECT note_id, max_by(name, seen_at) AS name, arg_max_null(date, seen_at) AS date, arg_max_null(touches, seen_at) AS touches, max_by(coalesce(deleted, false), seen_at) AS gone
  FROM notes WHERE name LIKE 'session-%' GROUP BY note_id),
dates AS (SELECT note_id, unnest(touches) AS t, CASE WHEN date IS NULL THEN try_strptime(substr(name, 9, 10), '%Y-%m-%d')::DATE ELSE {_day("date")} END AS day FROM session WHERE NOT gone),
touched AS (SELECT DISTINCT d.note_id, d.day, p.component FROM dates d JOIN state s ON s.name = {_TARGET.format("d.t")} JOIN parts p USING (k) WHERE d.day IS NOT NULL),
known AS (
  SELECT t.note_id, t.component, t.day, l.k, max_by(l.name, l.seen_at) AS name, arg_max_null(l.valid_from, l.seen_at) AS valid_from
  FROM touched t JOIN parts p USING (component) JOIN log l ON l.k = p.k AND l.seen_at < t.day + INTERVAL 1 DAY GROUP BY ALL)
SELECT note_id, entity, arg_max(name, ({_day("valid_from")}, name)) AS version
FROM known JOIN groups USING (component) WHERE {_day("valid_from")} <= day GROUP BY note_id, entity""",
}
