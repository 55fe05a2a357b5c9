"""Queries of the problems tagged llm, over whole tables and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import cooccur, knn, langid, mix, neardup, pack, split
from marginalia.llm.tokens import with_tokens


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Three-word runs, 60 %: a pair at the threshold shares one of 48 bands of 4 minima with probability 0.9987, at 65 % with 0.99991.
#: Bands of 3 minima nominate ten times as many pairs.
VAULT = neardup.Scheme(words=3, threshold=0.6, rows=4, bands=48)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return knn.similar_pairs(_table(spark, d, "vec_chunks"), "id", "embedding", k=5, min_cosine=0.9)


def p1_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar chunks, whatever their cosine, of every chunk whose id is divisible by 100, among all."""
    return knn.nearest(_table(spark, d, "vec_chunks"), "id", "embedding", k=10, every=100)


def _alike(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = neardup.vault_texts(_table(spark, d, "notes"), _table(spark, d, "chunks"))
    return neardup.near_duplicates(docs, VAULT)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.expand_pairs(*_alike(spark, d))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.duplicate_groups(*_alike(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split.split_oversized(_table(spark, d, "chunks"), "id", "text", "section")
    return pieces.groupBy("id").agg(F.max(F.col("forced").cast("long")).alias("forced_cut"))


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(_table(spark, d, "chunks"), "id", "text", "section")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.frequent_pairs(cooccur.baskets(_table(spark, d, "retrieval_log"))).select("a", "b")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with how far above chance it is, beside the store's own counters."""
    pairs = cooccur.together(cooccur.baskets(_table(spark, d, "retrieval_log")))
    stored = cooccur.stored_counts(_table(spark, d, "cooccur")).withColumnRenamed("count", "stored")
    return pairs.join(stored, ["a", "b"], "left")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    return cooccur.pair_counts(cooccur.baskets(_table(spark, d, "retrieval_log"))).select("a", "b", "count", "n_a", "n_b", "n")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    sized = with_tokens(_table(spark, d, "documents").select("doc_id", "text"))
    return pack.fill_containers(sized, "doc_id", "tokens")


def p8_fillings(spark: SparkSession, d: str) -> DataFrame:
    return pack.container_report(p8_containers(spark, d))


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    sized = with_tokens(_table(spark, d, "documents").select("doc_id", "source", "text"))
    return mix.mix(sized, _table(spark, d, "mix_targets"))[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    sized = with_tokens(_table(spark, d, "documents").select("doc_id", "source", "text"))
    return mix.mix_report(*mix.mix(sized, _table(spark, d, "mix_targets")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    found = langid.documents(docs, langid.fit(docs))
    return found.where("wrong").select("doc_id", F.explode("languages").alias("lang"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return langid.documents(docs, langid.fit(docs))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return langid.segments(docs, langid.fit(docs))


QUERIES = {f.__name__: f for f in (p1_found, p1_nearest, p3_found, p3_groups, p6_found, p6_pieces, p7_found, p7_pairs, p7_counts, p8_containers, p8_fillings, p9_copies, p9_report, p10_found, p10_documents, p10_segments)}

_NAMES = r"""
WITH once AS (
  SELECT id, arg_min(results, (ts, results)) AS results FROM retrieval_log GROUP BY id),
named AS (
  SELECT id, pos, regexp_replace(regexp_replace(CASE WHEN m <> '' THEN m ELSE trim(x) END, '^.*/', ''), '\.md$', '') AS name
  FROM (SELECT id, x, pos, trim(regexp_extract(x, '\[\[([^\]|#]+?)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]', 1)) AS m
        FROM (SELECT id, unnest(CAST(results AS JSON)::VARCHAR[]) AS x, generate_subscripts(CAST(results AS JSON)::VARCHAR[], 1) AS pos
              FROM once WHERE json_valid(results) AND json_type(results) = 'ARRAY'))),
firsts AS (SELECT id, name, min(pos) AS pos FROM named WHERE name <> '' GROUP BY id, name),
items AS (SELECT id, name FROM firsts QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos) <= 5),
single AS (SELECT name, count(*) AS c FROM items GROUP BY name),
total AS (SELECT count(DISTINCT id) AS n FROM items),
pairs AS (
  SELECT x.name AS a, y.name AS b, count(*) AS count FROM items x JOIN items y ON x.id = y.id AND x.name < y.name GROUP BY ALL),
wide AS (
  SELECT a, b, count, sa.c AS n_a, sb.c AS n_b, n FROM pairs JOIN single sa ON sa.name = a JOIN single sb ON sb.name = b, total)
"""

_ALIKE = r"""
WITH state AS (
  SELECT 'notes' AS tbl, note_id AS id, arg_max_null(content, seen_at) AS text, max_by(coalesce(deleted, false), seen_at) AS gone FROM notes GROUP BY note_id
  UNION ALL SELECT 'chunks', id, min(text), false FROM chunks GROUP BY id),
words AS (SELECT tbl, id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM state WHERE NOT gone),
runs AS (SELECT tbl, id, unnest(list_distinct(list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])))) AS r FROM words WHERE len(w) >= 3),
sizes AS (SELECT tbl, id, count(*) AS n FROM runs GROUP BY ALL),
common AS (SELECT x.tbl, x.id AS a, y.id AS b, count(*) AS c FROM runs x JOIN runs y ON x.tbl = y.tbl AND x.r = y.r AND x.id < y.id GROUP BY ALL),
alike AS (SELECT c.tbl, a, b FROM common c JOIN sizes s ON s.tbl = c.tbl AND s.id = a JOIN sizes t ON t.tbl = c.tbl AND t.id = b
  WHERE c * 10 >= 6 * (s.n + t.n - c))
"""

SQL = {
    "p1_found": """
WITH v AS (
  SELECT id, min(embedding) AS e FROM vec_chunks
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY id),
d AS (SELECT id, CAST(e AS DOUBLE[]) AS e FROM v),
pairs AS (SELECT x.id AS q, y.id AS o, list_cosine_similarity(x.e, y.e) AS c FROM d x JOIN d y ON x.id <> y.id),
best AS (SELECT q, o FROM pairs WHERE c >= 0.9 QUALIFY row_number() OVER (PARTITION BY q ORDER BY c DESC, o) <= 5)
SELECT DISTINCT least(q, o) AS id_a, greatest(q, o) AS id_b FROM best""",
    "p3_found": _ALIKE + "SELECT tbl, a AS id_a, b AS id_b FROM alike",
    "p3_groups": _ALIKE.replace("WITH state", "WITH RECURSIVE state", 1) + """,
sets AS (SELECT tbl, id, md5(string_agg(r, '|' ORDER BY r)) AS h FROM runs GROUP BY ALL),
classes AS (SELECT tbl, id, min(id) OVER (PARTITION BY tbl, h) AS rep FROM sets),
links AS (SELECT x.tbl, x.a, x.b FROM alike x JOIN classes p ON p.tbl = x.tbl AND p.id = x.a JOIN classes q ON q.tbl = x.tbl AND q.id = x.b WHERE p.rep = x.a AND q.rep = x.b),
both_ways AS (SELECT tbl, a, b FROM links UNION ALL SELECT tbl, b, a FROM links),
reach(tbl, a, b) AS (SELECT tbl, a, b FROM both_ways UNION SELECT r.tbl, r.a, e.b FROM reach r JOIN both_ways e ON e.tbl = r.tbl AND e.a = r.b),
parts AS (SELECT tbl, a AS id, min(b) AS g FROM reach GROUP BY ALL),
degree AS (SELECT tbl, a AS id, count(*) AS n FROM both_ways GROUP BY ALL)
SELECT c.tbl, c.id, c.rep AS class_id, least(c.rep, coalesce(p.g, c.rep)) AS group_id, coalesce(d.n, 0) AS links
FROM classes c LEFT JOIN parts p ON p.tbl = c.tbl AND p.id = c.rep LEFT JOIN degree d ON d.tbl = c.tbl AND d.id = c.rep""",
    "p6_found": r"""SELECT id, CAST(max(CASE WHEN regexp_replace(text, '[^ \t\r\n]{1000}[^ \t\r\n]{1000}[^ \t\r\n]', '', '') <> text THEN 1 ELSE 0 END) AS BIGINT) AS forced_cut
FROM (SELECT DISTINCT id, text FROM chunks) WHERE length(text) > 2000 GROUP BY id""",
    "p7_found": _NAMES + "SELECT a, b FROM wide WHERE count >= 5 AND count * n >= 8 * n_a * n_b",
    "p7_counts": _NAMES + "SELECT * FROM wide",
}
