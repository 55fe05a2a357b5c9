"""SQL of the vault queries, written for DuckDB independently of the operators."""

from __future__ import annotations

import unicodedata

from marginalia.functions.fold import COLONS, LOOK_ALIKES, ZERO_WIDTH
from marginalia.functions.text import MARK, NAME_STOP_WORDS, ROLE_WORDS, STOP_WORDS, TAG_WORDS, VOLATILE_KEYS
from marginalia.queries.general import _TARGET, _day

LINK = r"\[\[([^\]|#]+?)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"


def folded(x: str) -> str:
    """Folding in SQL: letters below U+3000 that turn into one letter or none by ``translate``, the others one by one."""
    single: dict[str, str] = dict.fromkeys(ZERO_WIDTH, "") | dict.fromkeys(COLONS, ":")
    several: dict[str, str] = {}
    for c in map(chr, range(0x80, 0x3000)):
        if c not in single and unicodedata.category(c) != "Cn":
            plain = "".join(LOOK_ALIKES.get(p, ":" if p in COLONS else p) for p in unicodedata.normalize("NFKD", c) if unicodedata.combining(p) == 0)
            if plain != c:
                (single if len(plain) < 2 else several)[c] = plain
    kept = [c for c, p in single.items() if p]
    gone = [c for c, p in single.items() if not p]
    out = f"translate({x}, '{''.join(kept + gone)}', '{''.join(single[c] for c in kept).replace(chr(39), chr(39) * 2)}')"
    return out if not several else "replace(" * len(several) + out + "".join(f", '{c}', '{p.replace(chr(39), chr(39) * 2)}')" for c, p in several.items())


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


VAULT = "vault AS (SELECT * FROM notes UNION ALL BY NAME SELECT * REPLACE (-note_id AS note_id) FROM seed_notes)"
LIVE = f"""
WITH {VAULT},
cur AS (SELECT * FROM (SELECT DISTINCT ON (note_id, seen_at) * FROM vault) QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY seen_at DESC) = 1),
live AS (SELECT * FROM cur WHERE NOT coalesce(deleted, false)),
named AS (SELECT * FROM live WHERE name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY rel_path DESC) = 1)
"""
LINKS = LIVE + f""",
strings AS (
  SELECT name AS src, content AS t FROM live UNION ALL SELECT name, unnest(map_values(metadata)) FROM live UNION ALL SELECT name, unnest(touches) FROM live),
links AS (SELECT src, trim(unnest(regexp_extract_all(t, '{LINK}', 1))) AS dst FROM strings),
counted AS (SELECT l.src, l.dst, count(*) AS n FROM links l JOIN named n ON n.name = l.dst WHERE l.src IS NOT NULL GROUP BY ALL),
edges AS (SELECT src, dst FROM counted)
"""
_WORD = r"(^|[^a-z0-9]){0}([^a-z0-9]|$)"


def _count(term: str) -> str:
    # separators are doubled so that neighbouring occurrences do not share one
    return f"len(regexp_extract_all(regexp_replace(lower(coalesce(raw_text, '')), '([^a-z0-9])', '\\1\\1', 'g'), '(^|[^a-z0-9]){term.replace(' ', '  ')}([^a-z0-9]|$)'))"


_THESIS, _COMMON = ["probe set", "link graph", "abstention floor"], ["vendor quote", "invoice batch", "storage budget"]
LANES = f""",
laned AS (SELECT name, rel_path, CASE
  WHEN rel_path = 'BOOT.md' OR split_part(rel_path, '/', -1) = 'BOOT.md' THEN 'neutral'
  WHEN regexp_matches(lower(split_part(rel_path, '/', -1)), 'thesis|index-') THEN 'thesis'
  WHEN regexp_matches(lower(split_part(rel_path, '/', -1)), 'client-') THEN 'operational'
  WHEN starts_with(rel_path, 'HomeVault/sessions/') OR starts_with(rel_path, 'wiki/') THEN 'neutral'
  WHEN starts_with(rel_path, 'HomeVault/') THEN 'operational'
  WHEN starts_with(rel_path, 'LearningLayer/') THEN CASE WHEN {" + ".join(map(_count, _THESIS))} > {" + ".join(map(_count, _COMMON))} THEN 'thesis' ELSE 'operational' END
  ELSE 'operational' END AS lane FROM named)
"""


def ranks(seeds: str | None, before: str = LINKS) -> str:
    """A table ``ranked(name, rank)``; ``seeds`` is a query of names, all of one weight."""
    p = f"SELECT name, 1.0::DOUBLE / count(*) OVER () AS y FROM ({seeds or 'SELECT name FROM named'}) AS s"
    return before.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
ways AS MATERIALIZED (SELECT src, dst, 0.85::DOUBLE / count(*) OVER (PARTITION BY src) AS share FROM edges WHERE src IN (SELECT name FROM named)),
flow(k, name, y) AS (SELECT 0, name, y FROM ({p}) AS p
  UNION ALL SELECT f.k + 1, w.dst, sum(f.y * w.share) FROM flow f JOIN ways w ON w.src = f.name
  WHERE f.k % 4 <> 0 OR f.k = 0 OR (SELECT sum(y) FROM flow) >= 1e-6 * (SELECT count(*) FROM named) GROUP BY f.k + 1, w.dst),
ranked AS (SELECT n.name, coalesce(sum(y), 0) / (SELECT sum(y) FROM flow) AS rank FROM named n LEFT JOIN flow f ON f.name = n.name GROUP BY n.name)
"""


def _chain(as_of: str | None) -> str:
    late = f"coalesce(since > DATE '{as_of}', false)" if as_of else "false"
    hops = "" if as_of else ", greatest(len(chain) - 1, 0)::INTEGER AS hops"
    return LIVE.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
step AS (SELECT name AS at, {_TARGET.format("superseded_by")} AS next, {_day("valid_from")} AS since FROM named),
walk(start, current, chain, next, go) AS (
  SELECT s.at, CASE WHEN {late} THEN NULL ELSE s.at END, CASE WHEN {late} THEN []::VARCHAR[] ELSE [s.at] END, s.next,
    NOT {late} AND s.next IS NOT NULL AND s.next <> s.at
  FROM step s WHERE s.at LIKE 'entity-%'
  UNION ALL
  SELECT w.start, CASE WHEN s.at IS NULL OR {late} THEN w.current ELSE s.at END,
    CASE WHEN s.at IS NOT NULL AND {late} THEN w.chain ELSE list_append(w.chain, w.next) END, s.next,
    s.at IS NOT NULL AND NOT {late} AND s.next IS NOT NULL AND NOT list_contains(list_append(w.chain, w.next), s.next)
  FROM walk w LEFT JOIN step s ON s.at = w.next WHERE w.go)
SELECT start, current, array_to_string(chain, ' > ') AS chain{hops} FROM walk WHERE NOT go"""


def _terms(source: str, key: str, text: str, asked: str = "SELECT * FROM weights WHERE key % 100 = 0") -> str:
    return f"""
words AS (SELECT {key} AS key, lower(unnest(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9''_-]+'))) AS term FROM {source}),
counts AS (SELECT key, term, count(*) AS tf FROM words WHERE length(term) >= 3 AND term NOT IN {_in(STOP_WORDS)} GROUP BY key, term),
idf AS (SELECT term, count(*) AS df, ln(((SELECT count(*) FROM {source}) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM counts GROUP BY term),
raw AS (SELECT key, term, (1 + ln(tf)) * idf AS w FROM counts JOIN idf USING (term)),
weights AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM raw),
scores AS (SELECT q.key AS query, x.key AS key, sum(q.w * x.w) AS score FROM ({asked}) q JOIN weights x USING (term) WHERE q.key <> x.key GROUP BY ALL),
top AS (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS rank FROM scores WHERE score > 0 QUALIFY rank <= 5)
"""


_VOLATILE = _in(VOLATILE_KEYS)
META = f"""
pairs AS (SELECT note_id, replace(replace(lower(trim(e.key)), '-', '_'), ' ', '_') AS k, lower(trim(e.value)) AS v
  FROM (SELECT note_id, unnest(map_entries(metadata)) AS e FROM live) WHERE e.value IS NOT NULL),
meta AS (SELECT note_id, k, max(v) AS v FROM pairs WHERE k NOT IN {_VOLATILE} GROUP BY ALL)"""


def candidates(asked: str | None = None) -> str:
    """``found`` and ``flagged``: the five notes most like each note asked for. ``asked`` is a query of ``note_id, t``: texts asked
    with, the weights of whose terms are the index's."""
    if asked is None:
        terms = _terms("live", "note_id", "concat_ws(' ', content, name)")
    else:
        terms = _terms("live", "note_id", "concat_ws(' ', content, name)", f"""
SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM (
  SELECT key, term, (1 + ln(count(*))) * any_value(idf) AS w FROM (SELECT note_id AS key, lower(unnest(regexp_extract_all(t, '[A-Za-z][A-Za-z0-9''_-]+'))) AS term FROM ({asked})) JOIN idf USING (term) GROUP BY ALL)""")
    return LIVE + "," + terms + "," + META + """,
found AS (
  SELECT t.query AS new_id, o.rel_path, o.name, n.name AS new_name, nullif(o.superseded_by, '') AS gone, round(t.score, 9) AS score,
    coalesce((SELECT string_agg(a.k, ',' ORDER BY a.k) FROM meta a JOIN meta b ON a.k = b.k WHERE a.note_id = t.query AND b.note_id = t.key AND a.v <> b.v), '') AS conflicting_keys
  FROM top t JOIN live o ON o.note_id = t.key JOIN live n ON n.note_id = t.query),
flagged AS (SELECT *, CASE WHEN conflicting_keys <> '' AND score >= 0.35 THEN 'hard_conflict' WHEN score >= 0.75 THEN 'likely_duplicate' ELSE 'unrelated' END AS flag FROM found)
"""


_CANDIDATES = candidates()
PROPOSED = """
g AS (
  SELECT new_id, arg_min(rel_path, (-score, rel_path)) FILTER (flag = 'hard_conflict') AS hard, arg_min(rel_path, (-score, rel_path)) FILTER (flag = 'likely_duplicate') AS dup,
    max(score) FILTER (flag = 'likely_duplicate') AS s FROM flagged GROUP BY new_id),
proposed AS (SELECT new_id, CASE WHEN hard IS NULL AND s >= 0.95 THEN 'NOOP' WHEN hard IS NULL AND dup IS NULL THEN 'ADD' ELSE 'UPDATE' END AS verdict, coalesce(hard, dup) AS target_path FROM g),
summed AS (SELECT new_id, string_agg(rel_path || ' on ' || replace(conflicting_keys, ',', ', '), '; ' ORDER BY score DESC, rel_path) AS summary
  FROM flagged WHERE flag = 'hard_conflict' GROUP BY new_id)
"""

SEEN = r"""
WITH once AS (SELECT id, arg_min(results, (ts, session)) AS results, min(ts) AS ts FROM retrieval_log GROUP BY id),
flat AS (
  SELECT id, ts, pos, regexp_replace(regexp_replace(CASE WHEN m <> '' THEN m ELSE trim(x) END, '^.*/', ''), '\.md$', '') AS name
  FROM (SELECT id, ts, x, pos, trim(regexp_extract(x, '\[\[([^\]|#]+?)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1)) AS m
        FROM (SELECT id, ts, unnest(CAST(results AS JSON)::VARCHAR[]) AS x, generate_subscripts(CAST(results AS JSON)::VARCHAR[], 1) AS pos
              FROM once WHERE json_valid(results) AND json_type(results) = 'ARRAY'))),
names AS (SELECT id, ts, name, min(pos) AS pos FROM flat WHERE name <> '' GROUP BY ALL),
sal AS (SELECT name AS note_name, count(*) AS recall_count, strftime(max(ts), '%Y-%m-%d') AS last_recalled FROM names GROUP BY name),
tops AS (SELECT id, name FROM names QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 5),
co AS (SELECT x.name AS a, y.name AS b, count(*) AS count FROM tops x JOIN tops y ON x.id = y.id AND x.name < y.name GROUP BY ALL)
"""
_QVEC = "(SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)"
_SIM = f"coalesce(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_QVEC} AS DOUBLE[])), 0)"
_CUT = "2025-12-31 00:00:00"
MANIFEST = f"""
WITH {VAULT},
cur AS (SELECT * FROM vault QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY seen_at DESC) = 1),
past AS (SELECT * FROM vault WHERE seen_at <= TIMESTAMP '{_CUT}' QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY seen_at DESC) = 1),
new AS (SELECT rel_path, substr(sha256(coalesce(raw_text, '')), 1, 16) AS h FROM cur WHERE NOT coalesce(deleted, false)),
old AS (SELECT rel_path, substr(sha256(coalesce(raw_text, '')), 1, 16) AS h FROM past WHERE NOT coalesce(deleted, false)),
diff AS (SELECT coalesce(o.rel_path, n.rel_path) AS rel_path, CASE WHEN o.rel_path IS NULL THEN 'added' WHEN n.rel_path IS NULL THEN 'removed' WHEN o.h <> n.h THEN 'changed' END AS change
  FROM old o FULL JOIN new n ON o.rel_path = n.rel_path)
"""

SQL = {
    "content_hash": "SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents",
    "link_extract": LINKS + "SELECT src, dst, count(*) AS n FROM links GROUP BY src, dst",
    "edge_build": LINKS + "SELECT src, dst, n FROM counted",
    "isolates": LINKS + "SELECT name FROM named WHERE name NOT IN (SELECT src FROM edges UNION SELECT dst FROM edges)",
    "lane_assignment": LIVE + LANES + "SELECT name, rel_path, lane FROM laned",
    "lane_edges": LINKS + LANES + """SELECT src, dst, n FROM counted JOIN laned a ON a.name = src JOIN laned b ON b.name = dst
WHERE src <> dst AND (a.lane = b.lane OR a.lane = 'neutral' OR b.lane = 'neutral') AND a.rel_path <> 'wiki/index.md' AND b.rel_path <> 'wiki/index.md'""",
    "lane_visible": LIVE + LANES + """SELECT name, lane IN ('thesis', 'neutral') AND rel_path NOT IN ('BOOT.md', 'wiki/index.md') AS seen,
  NOT contains('/' || rel_path, '/_archive/') AND rel_path NOT IN ('BOOT.md', 'wiki/index.md') AS embeddable FROM laned""",
    "bridge_detect": LIVE + f"""SELECT rel_path FROM live WHERE regexp_matches(lower(raw_text), '{_WORD.format("(greenhouse schedule|pump log)")}')
AND regexp_matches(lower(raw_text), '{_WORD.format("(role charter|radio sheet)")}') AND rel_path NOT IN ('BOOT.md', 'wiki/index.md')""",
    "pagerank": ranks(None) + "SELECT name, round(rank, 9) AS rank FROM ranked",
    "ppr_seeded": ranks("SELECT name FROM named WHERE starts_with(name, 'signals-')") + "SELECT name, round(rank, 9) AS rank FROM ranked",
    "resolve_current": _chain(None),
    "resolve_as_of": _chain("2025-06-30"),
    "current_entities": LIVE + """SELECT name, metadata['type'] AS type FROM named
WHERE metadata['type'] IN ('entity', 'project', 'person', 'stakeholder', 'research-project', 'agent') AND coalesce(superseded_by, '') = ''""",
    "tfidf_idf": "WITH" + _terms("documents", "doc_id", "text") + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "tfidf_knn": "WITH" + _terms("documents", "doc_id", "text") + "SELECT query AS doc_id, key AS other, round(score, 6) AS score, rank FROM top",
    "conflict_prefilter": _CANDIDATES + "SELECT new_id, rel_path, round(score, 6) AS score, flag, conflicting_keys FROM flagged",
    "propose_write": _CANDIDATES + "," + PROPOSED + "SELECT * FROM proposed",
    "conflict_summary": _CANDIDATES + "," + PROPOSED + "SELECT * FROM summed",
    "classify_write": _CANDIDATES + r""", g AS (
  SELECT new_id, any_value(new_name) AS new_name, arg_min(coalesce(gone, rel_path), (-score, rel_path)) FILTER (name = new_name) AS named,
    arg_min(rel_path, (-score, rel_path)) AS path, arg_min(name, (-score, rel_path)) AS tname, max(score) AS s, arg_min_null(gone, (-score, rel_path)) AS gone
  FROM found GROUP BY new_id),
r AS (SELECT *, regexp_replace(new_name, '-v\d.*$', '') AS x, regexp_replace(tname, '-v\d.*$', '') AS y FROM g),
v AS (SELECT *, CASE WHEN named IS NOT NULL THEN 'UPDATE' WHEN gone IS NOT NULL THEN 'DELETE'
  WHEN s >= 0.75 AND (x = y OR starts_with(x, y) OR starts_with(y, x)) THEN 'UPDATE' WHEN s >= 0.55 THEN 'UPDATE' ELSE 'ADD' END AS verdict FROM r)
SELECT new_id, verdict, CASE WHEN named IS NOT NULL THEN named WHEN verdict <> 'ADD' THEN path END AS target_path FROM v""",
    "dense_topk": f"SELECT vec_id AS id, round({_SIM}, 6) AS sim FROM embeddings ORDER BY {_SIM} DESC, vec_id LIMIT 24",
    "dense_topk_lane": f"""SELECT vec_id AS id, CASE label % 3 WHEN 0 THEN 'thesis' ELSE 'neutral' END AS lane, round({_SIM}, 6) AS sim
FROM embeddings WHERE label % 3 <> 1 ORDER BY {_SIM} DESC, vec_id LIMIT 24""",
    "dense_batch": """SELECT q.vec_id AS query, e.vec_id AS id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS sim
FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0
QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) DESC, e.vec_id) <= 10""",
    "max_per_note": f"""WITH s AS (SELECT CAST(label AS VARCHAR) AS note_name, vec_id, round({_SIM}, 9) AS sim FROM embeddings)
SELECT note_name, round(max(sim), 6) AS dense_sim, CAST(arg_max(vec_id, (sim, -vec_id)) AS VARCHAR) AS best_section FROM s GROUP BY note_name""",
    "seed_weights": f"""WITH s AS (SELECT CAST(label AS VARCHAR) AS name, max(round({_SIM}, 9)) AS sim FROM embeddings GROUP BY label)
SELECT name, round(sim * sim, 6) AS weight FROM (SELECT * FROM s ORDER BY sim DESC, name LIMIT 8) WHERE sim > 0""",
    "salience": SEEN + "SELECT * FROM sal",
    "salience_top": SEEN + "SELECT * FROM sal ORDER BY recall_count DESC, note_name LIMIT 15",
    "co_retrieval": SEEN + "SELECT * FROM co",
    "log_stats": SEEN + "SELECT (SELECT count(*) FROM once) AS n_logged, (SELECT count(*) FROM sal) AS n_notes, (SELECT count(*) FROM co) AS n_pairs",
    "link_proposals": SEEN + "," + LINKS.replace("WITH ", "", 1).lstrip() + "SELECT a, b, count FROM co WHERE count >= 3 AND NOT EXISTS (SELECT 1 FROM edges WHERE (src = a AND dst = b) OR (src = b AND dst = a))",
    "stale_flags": SEEN + "," + LIVE.replace("WITH ", "", 1).lstrip() + """,
aged AS (SELECT name, substr(valid_from, 1, 10) AS vf, try_strptime(nullif(regexp_extract(substr(valid_from, 1, 10), '^\\d{4}-\\d{2}-\\d{2}$'), ''), '%Y-%m-%d')::DATE AS day FROM named WHERE coalesce(valid_until, '') = '')
SELECT note_name, recall_count, vf AS valid_from, date_diff('day', day, DATE '2026-06-30') AS age FROM sal JOIN aged ON name = note_name WHERE date_diff('day', day, DATE '2026-06-30') > 90""".replace("\\\\d", "\\d"),
    "manifest_diff": MANIFEST + "SELECT * FROM diff WHERE change IS NOT NULL",
    "index_work": MANIFEST + "SELECT rel_path, change IN ('changed', 'removed') AS drop, change IN ('added', 'changed') AS build FROM diff WHERE change IS NOT NULL",
    "vault_rev": MANIFEST + """SELECT split_part(rel_path, '/', 1) AS folder,
  substr(sha256(string_agg(g, '' ORDER BY b)), 1, 12) AS rev
FROM (SELECT split_part(rel_path, '/', 1) AS rel_path, substr(sha256(rel_path), 1, 3) AS b, sha256(string_agg(rel_path || chr(0) || h || chr(0), '' ORDER BY rel_path)) AS g FROM new GROUP BY ALL) GROUP BY 1""",
    "intent_state": MANIFEST + """SELECT split_part(coalesce(o.rel_path, n.rel_path), '/', 1) AS intent_id, coalesce(o.rel_path, n.rel_path) AS rel_path,
  CASE WHEN n.rel_path IS NULL THEN 'missing' ELSE 'patched' END AS state FROM old o FULL JOIN new n ON o.rel_path = n.rel_path""",
    "fault_scan": LIVE + "SELECT rel_path, 'parse' AS kind FROM live WHERE metadata IS NULL",
    "duplicate_name": LIVE + "SELECT name, count(*) AS n, max(rel_path) AS kept FROM live GROUP BY name HAVING count(*) > 1",
    "folder_counts": LIVE + "SELECT CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) ELSE '(root)' END AS folder, count(*) AS n FROM live GROUP BY 1",
    "excerpts": r"""WITH f AS (SELECT doc_id, replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE regexp_replace(substr(t, 1, 119), '\s+$', '') || '…' END AS excerpt FROM f""",
    "slugs": LIVE + r""", s AS (SELECT note_id, regexp_replace(regexp_replace(regexp_replace(replace(rel_path, '/', ' '), '\.md$', '', 'i'), '[^a-zA-Z0-9\s_-]', '', 'g'), '[\s_]+', '-', 'g') AS s FROM live)
SELECT note_id, coalesce(nullif(regexp_replace(lower(trim(s, '-')), '-+', '-', 'g'), ''), 'untitled') AS slug FROM s""",
    "date_coerce": LIVE + f"""SELECT note_id,
  strftime(try_strptime(nullif(regexp_extract(valid_from, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$'), ''), '%Y-%m-%d'), '%Y-%m-%d') AS iso,
  strftime({_day("valid_from")}, '%Y-%m-%d') AS written,
  strftime(CASE WHEN date IS NOT NULL THEN {_day("date")} ELSE try_strptime(nullif(regexp_extract(name, '^session-(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), ''), '%Y-%m-%d')::DATE END, '%Y-%m-%d') AS session,
  coalesce(nullif(substr(valid_from, 1, 10), ''), nullif(substr(date, 1, 10), ''), regexp_extract(name, '(\\d{{4}}-\\d{{2}}-\\d{{2}})', 1)) AS note FROM live""",
    "fm_normalize": LIVE + f""", pairs AS (SELECT note_id, replace(replace(lower(trim(e.key)), '-', '_'), ' ', '_') AS k, lower(trim(e.value)) AS v
  FROM (SELECT note_id, unnest(map_entries(metadata)) AS e FROM live) WHERE e.value IS NOT NULL),
meta AS (SELECT note_id, k, max(v) AS v FROM pairs WHERE k NOT IN {_VOLATILE} GROUP BY ALL)
SELECT l.note_id, coalesce((SELECT string_agg(k || '=' || v, ';' ORDER BY k) FROM meta m WHERE m.note_id = l.note_id), '') AS normal FROM live l WHERE metadata IS NOT NULL""",
    "entity_keys": LIVE + rf""", b AS (SELECT name, regexp_replace(lower(name), '^entity-', '') AS base FROM named WHERE NOT regexp_matches(lower(name), '^(session-|signals-)'))
SELECT DISTINCT name, key FROM (SELECT name, base AS key FROM b UNION ALL SELECT name, unnest(regexp_split_to_array(base, '[-_\s/]+')) FROM b)
JOIN b USING (name) WHERE key = base OR (length(key) >= 3 AND key NOT IN {_in(NAME_STOP_WORDS)})""",
    "note_chunks": LIVE + r""",
parts AS (SELECT name, rel_path, metadata, regexp_split_to_array(regexp_replace(chr(10) || coalesce(content, ''), '\n(#{2,3}\s)', chr(1) || '\1', 'g'), chr(1)) AS a FROM live),
flat AS (SELECT name, rel_path, unnest(a) AS p, generate_subscripts(a, 1) AS i FROM parts),
secs AS (
  SELECT name, rel_path, i, CASE WHEN i = 1 THEN '_head' ELSE trim(regexp_extract(p, '^#{2,3}\s+([^\n]*)', 1), ' ') END AS section,
    regexp_replace(CASE WHEN i = 1 THEN p ELSE regexp_replace(p, '^#{2,3}\s+[^\n]*', '') END, '^\s+|\s+$', '', 'g') AS body FROM flat
  UNION ALL SELECT name, rel_path, 1000000, '_frontmatter',
    coalesce((SELECT string_agg(e.key || ': ' || e.value, chr(10) ORDER BY e.key) FROM (SELECT unnest(map_entries(metadata)) AS e) WHERE e.value IS NOT NULL), '') FROM live),
kept AS (SELECT *, row_number() OVER (PARTITION BY rel_path ORDER BY i) - 1 AS pos FROM secs WHERE body <> ''),
packed AS (SELECT *, list_reduce(list_transform(string_split(body, chr(10) || chr(10)), lambda p: [p]),
  lambda l, p: CASE WHEN length(l[-1]) + 2 + length(p[1]) <= 2000 THEN list_append(l[:-2], l[-1] || chr(10) || chr(10) || p[1]) ELSE list_concat(l, p) END) AS l FROM kept),
cut AS (SELECT *, flatten(list_transform(l, lambda p: list_transform(range(0, greatest(ceil(length(p) / 2000.0)::BIGINT, 1)), lambda k: substr(p, k * 2000 + 1, 2000)))) AS c FROM packed),
pieces AS (SELECT name, rel_path, section, pos, unnest(c) AS piece, generate_subscripts(c, 1) - 1 AS part FROM cut)
SELECT name, rel_path, section, pos, part, name || ' — ' || section || chr(10) || piece AS text FROM pieces""",
    "note_sections": LIVE + r""", p AS (SELECT note_id, regexp_split_to_array(regexp_replace(chr(10) || coalesce(content, ''), '\n(#{1,6}[ \t])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM live),
s AS (SELECT note_id, unnest(parts) AS p, generate_subscripts(parts, 1) - 1 AS pos FROM p)
SELECT note_id, pos, regexp_extract(p, '^#{1,6}[ \t]+([^\n]*)', 1) AS title, length(regexp_replace(p, '^#{1,6}[ \t]+[^\n]*\n?', '')) AS n_chars FROM s""",
    "stub_notes": LIVE + """SELECT note_id, coalesce(metadata['type'] = 'stub', false) OR coalesce(metadata['source'] = 'auto-heal', false)
  OR (contains(substr(coalesce(content, ''), 1, 400), 'auto-generated because') AND contains(substr(coalesce(content, ''), 1, 400), 'did not exist')) AS stub FROM live""",
    "look_alikes": f"SELECT doc_id, substr(sha256({folded('text')}), 1, 16) AS hash FROM documents",
    "neutralize": LIVE + rf""", lines AS (SELECT note_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS pos
  FROM (SELECT note_id, list_filter(string_split(coalesce(raw_text, ''), chr(10)), lambda x: regexp_matches(x, '^\s*- |^[\w-]+:')) AS a FROM live WHERE starts_with(name, 'session-')))
SELECT note_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace({folded('line')}, '[\r\n]+', ' ', 'g'), '\s+$', ''), '(^|[^\w-])({'|'.join(ROLE_WORDS)})[\s*_`~]*:', '\1{MARK} \2 ', 'gi'),
  '(^|[^\w-])({'|'.join(TAG_WORDS)})[\s*_`~]*:', '\1{MARK} \2 ', 'gi') AS safe FROM lines""",
}
