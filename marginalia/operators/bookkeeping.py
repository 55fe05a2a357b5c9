"""What the retrieval log says (E5, E6, F6, F7, D11-D13): salience, co-retrieval, proposals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dates import iso_day
from marginalia.functions.links import link_target

# Names of a result that count for pairs, least count of a proposal, days until a note is stale, top notes.
TOP, PROPOSE, STALE_DAYS, SALIENT = 5, 3, 90, 15


def result_names(results: Column) -> Column:
    """Names in a JSON array of results, distinct, in order; paths, brackets and ``.md`` taken off. Anything else is empty."""
    parsed = F.try_variant_get(F.try_parse_json(F.nullif(F.trim(results), F.lit(""))), "$", "array<string>")
    bare = F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.regexp_replace(link_target(x), r"^.*/", ""), r"\.md$", ""))
    return F.array_distinct(F.filter(bare, lambda x: x.isNotNull() & (x != "")))


def retrievals(log: DataFrame) -> DataFrame:
    """``id, ts, session, names``: each logged id once (its earliest row), names read."""
    rows = log.select("id", F.struct("ts", "session", result_names(F.col("results")).alias("names")).alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.ts", "r.session", "r.names")


def salience(seen: DataFrame) -> DataFrame:
    """E5: ``note_name, recall_count, last_recalled`` (the day)."""
    flat = seen.select("ts", F.explode("names").alias("note_name"))
    return flat.groupBy("note_name").agg(F.count("*").alias("recall_count"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_recalled"))


def co_retrieval(seen: DataFrame, top: int = TOP) -> DataFrame:
    """E5: ``a, b, count`` over the first ``top`` names of each retrieval (at most ten pairs a row for five)."""
    first = F.slice("names", 1, top)
    pairs = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, top), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    return seen.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("count"))


def top_salient(counts: DataFrame, n: int = SALIENT) -> DataFrame:
    """F6."""
    return counts.orderBy(F.desc("recall_count"), "note_name").limit(n)


def link_proposals(pairs: DataFrame, edges: DataFrame, least: int = PROPOSE) -> DataFrame:
    """Pairs retrieved together ``least`` times or more that are linked neither way."""
    linked = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return pairs.where(F.col("count") >= least).join(linked, ["a", "b"], "left_anti")


def stale_notes(salient: DataFrame, notes: DataFrame, today: Column, days: int = STALE_DAYS) -> DataFrame:
    """Salient notes whose ISO ``valid_from`` is more than ``days`` old and that have no ``valid_until``."""
    since = iso_day(F.substring("valid_from", 1, 10))
    open_ = F.coalesce("valid_until", F.lit("")) == ""
    known = notes.where(open_).select(F.col("name").alias("note_name"), F.date_format(since, "yyyy-MM-dd").alias("valid_from"), F.datediff(today, since).alias("age"))
    return salient.join(known.where(F.col("age") > days), "note_name").select("note_name", "recall_count", "valid_from", F.col("age").cast("long").alias("age"))


def log_stats(log: DataFrame) -> DataFrame:
    """``n_logged, n_notes, n_pairs``."""
    seen = retrievals(log)
    return seen.agg(F.count("*").alias("n_logged")).crossJoin(salience(seen).agg(F.count("*").alias("n_notes"))).crossJoin(co_retrieval(seen).agg(F.count("*").alias("n_pairs")))  # three rows of one
