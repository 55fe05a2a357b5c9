"""Queries of the text, link, graph, temporal, lane, conflict and log operators over the vault's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions import chunks as chunking
from marginalia.functions import dates, text
from marginalia.functions.fold import fold
from marginalia.operators import bookkeeping, conflict, graph, index, lanes, temporal, tfidf, vector
from marginalia.operators.vault_state import by_name, current_notes, duplicate_names
from marginalia.queries.tables import table, vault_log
from marginalia.session import materialize

#: The days and limits the report queries use.
TODAY, WINDOW, AS_OF, CUT = "2026-06-30", 120, "2025-06-30", "2025-12-31 00:00:00"
RULES = lanes.LaneRules(
    files={"neutral": ["BOOT.md"], "thesis": []},
    globs={"thesis": ["*thesis*", "*index-*"], "operational": ["*client-*"]},
    prefixes={"operational": ["HomeVault/"], "neutral": ["wiki/", "HomeVault/sessions/"]},
    vocab_prefix="LearningLayer/",
    vocab={"thesis": ["probe set", "link graph", "abstention floor"], "operational": ["vendor quote", "invoice batch", "storage budget"]},
    hubs=["BOOT.md"],
    quarantined=["wiki/index.md"],
    bridge=(["greenhouse schedule", "pump log"], ["role charter", "radio sheet"]),
)


def notes_of(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return current_notes(vault_log(spark, d), list(columns))


def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.digest(F.col("text")).alias("hash"))


def link_extract(spark: SparkSession, d: str) -> DataFrame:
    pairs = graph.link_pairs(notes_of(spark, d, "name", "metadata", "touches", "content"))
    return pairs.groupBy("src", "dst").agg(F.count("*").alias("n"))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    notes = notes_of(spark, d, "rel_path", "name", "metadata", "touches", "content")
    return by_name(notes).select("name", "rel_path"), graph.link_edges(notes, self_loops=True)


def edge_build(spark: SparkSession, d: str) -> DataFrame:
    """The graph of the boot walk, with the links each edge stands for."""
    return _graph(spark, d)[1]


def isolates(spark: SparkSession, d: str) -> DataFrame:
    return graph.isolates(*_graph(spark, d))


def _lanes(spark: SparkSession, d: str) -> DataFrame:
    notes = by_name(notes_of(spark, d, "rel_path", "name", "raw_text"))
    return notes.select("name", "rel_path", lanes.lane_of(F.col("rel_path"), F.col("raw_text"), RULES).alias("lane"))


def lane_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _lanes(spark, d)


def lane_edges(spark: SparkSession, d: str) -> DataFrame:
    """The graph a retrieval may walk: no edge between two lanes, nothing quarantined, no note linked to itself."""
    kept = _lanes(spark, d).where(~F.col("rel_path").isin(list(RULES.quarantined)))
    return graph.cut_lanes(_graph(spark, d)[1].where("src <> dst"), kept)


def lane_visible(spark: SparkSession, d: str) -> DataFrame:
    rows = _lanes(spark, d)
    return rows.select("name", lanes.visible(F.col("lane"), F.col("rel_path"), "thesis", RULES).alias("seen"), lanes.eligible(F.col("rel_path"), RULES).alias("embeddable"))


def bridge_detect(spark: SparkSession, d: str) -> DataFrame:
    return lanes.bridges(notes_of(spark, d, "rel_path", "raw_text"), RULES)


def pagerank(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return graph.pagerank(nodes, edges).select("name", F.round("rank", 9).alias("rank"))


def ppr_seeded(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    seeds = nodes.where(F.col("name").startswith("signals-")).select("name", F.lit(1.0).alias("weight"))
    return graph.pagerank(nodes, edges, seeds).select("name", F.round("rank", 9).alias("rank"))


def spectral(spark: SparkSession, d: str) -> DataFrame:
    return graph.spectral(*_graph(spark, d))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return by_name(notes_of(spark, d, "rel_path", "name", "valid_from", "superseded_by", "metadata"))


def resolve_current(spark: SparkSession, d: str) -> DataFrame:
    notes = _entities(spark, d)
    return temporal.resolve(notes, notes.where(F.col("name").startswith("entity-")).select("name")).select("start", "current", F.array_join("chain", " > ").alias("chain"), "hops")


def resolve_as_of(spark: SparkSession, d: str) -> DataFrame:
    notes = _entities(spark, d)
    starts = notes.where(F.col("name").startswith("entity-")).select("name")
    return temporal.resolve(notes, starts, F.lit(AS_OF).cast("date")).select("start", "current", F.array_join("chain", " > ").alias("chain"))


def current_entities(spark: SparkSession, d: str) -> DataFrame:
    return temporal.current_entities(_entities(spark, d)).select("name", F.col("metadata")["type"].alias("type"))


def _terms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select("doc_id", "text")
    counts = materialize(tfidf.term_counts(docs, "doc_id", "text"), "counts")
    return counts, tfidf.idf(counts, docs.count())


def tfidf_idf(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d)[1].select("term", "df", F.round("idf", 6).alias("idf"))


def tfidf_knn(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar documents of every document whose id is divisible by 100, among all."""
    w = materialize(tfidf.weights(*_terms(spark, d)), "weights")
    top = tfidf.most_similar(w, w.where(F.col("key") % 100 == 0), 5)
    return top.select(F.col("query").alias("doc_id"), F.col("key").alias("other"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    notes = materialize(notes_of(spark, d, "rel_path", "name", "content", "metadata", "superseded_by"), "notes")
    docs = notes.select("note_id", F.concat_ws(" ", "content", "name").alias("text"))
    counts = materialize(tfidf.term_counts(docs, "note_id", "text"), "counts")
    w = materialize(tfidf.weights(counts, tfidf.idf(counts, docs.count())), "weights")
    top = tfidf.most_similar(w, w.where(F.col("key") % 100 == 0), 5).select(F.col("query").alias("new_id"), F.col("key").alias("note_id"), F.round("score", 9).alias("score"))
    new = notes.select(F.col("note_id").alias("new_id"), F.col("name").alias("new_name"), F.col("metadata").alias("new_meta"))
    old = notes.select("note_id", "rel_path", "name", "superseded_by", F.col("metadata").alias("old_meta"))
    return top.join(new, "new_id").join(old, "note_id")


def conflict_prefilter(spark: SparkSession, d: str) -> DataFrame:
    found = conflict.prefilter(_candidates(spark, d))
    return found.select("new_id", "rel_path", F.round("score", 6).alias("score"), "flag", F.array_join("conflicting_keys", ",").alias("conflicting_keys"))


def propose_write(spark: SparkSession, d: str) -> DataFrame:
    return conflict.propose(conflict.prefilter(_candidates(spark, d)))


def classify_write(spark: SparkSession, d: str) -> DataFrame:
    return conflict.classify(_candidates(spark, d))


def conflict_summary(spark: SparkSession, d: str) -> DataFrame:
    return conflict.conflict_summary(conflict.prefilter(_candidates(spark, d)))


def _query_vector(emb: DataFrame) -> list[float]:
    """The vector of smallest id: one row."""
    return list(emb.orderBy("vec_id").select("embedding").first()[0])


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    lane = F.when(F.col("label") % 3 == 0, "thesis").when(F.col("label") % 3 == 1, "operational").otherwise("neutral")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", lane.alias("lane"))


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    q = _query_vector(table(spark, d, "embeddings"))
    return vector.dense_top(_labelled(spark, d), q).select("id", F.round("sim", 6).alias("sim"))


def dense_topk_lane(spark: SparkSession, d: str) -> DataFrame:
    q = _query_vector(table(spark, d, "embeddings"))
    return vector.dense_top(_labelled(spark, d), q, lane="thesis").select("id", "lane", F.round("sim", 6).alias("sim"))


def dense_batch(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest vectors for every vector whose id is divisible by 100, among all."""
    emb = _labelled(spark, d)
    queries = emb.where(F.col("id") % 100 == 0).select(F.col("id").alias("query"), F.col("embedding").alias("vector"))
    return vector.dense_batch(emb, queries, 10).select("query", "id", F.round("sim", 6).alias("sim"))


def max_per_note(spark: SparkSession, d: str) -> DataFrame:
    q = _query_vector(table(spark, d, "embeddings"))
    rows = _labelled(spark, d).select("id", "embedding", F.col("label").cast("string").alias("note_name"), "lane", F.col("id").cast("string").alias("section"))
    best = vector.best_per_note(rows.withColumn("sim", F.round(graph.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q])), 9)))
    return best.select("note_name", F.round("dense_sim", 6).alias("dense_sim"), "best_section")


def seed_weights(spark: SparkSession, d: str) -> DataFrame:
    q = _query_vector(table(spark, d, "embeddings"))
    rows = _labelled(spark, d).select("id", F.col("label").cast("string").alias("note_name"), F.lit("s").alias("section"), F.round(graph.cosine(F.col("embedding"), F.array(*[F.lit(x) for x in q])), 9).alias("sim"))
    return vector.seed_weights(vector.best_per_note(rows)).select("name", F.round("weight", 6).alias("weight"))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.retrievals(table(spark, d, "retrieval_log"))


def salience(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.salience(_seen(spark, d))


def salience_top(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.top_salient(bookkeeping.salience(_seen(spark, d)))


def co_retrieval(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.co_retrieval(_seen(spark, d))


def log_stats(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.log_stats(table(spark, d, "retrieval_log"))


def link_proposals(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.link_proposals(bookkeeping.co_retrieval(_seen(spark, d)), _graph(spark, d)[1])


def stale_flags(spark: SparkSession, d: str) -> DataFrame:
    notes = by_name(notes_of(spark, d, "rel_path", "name", "valid_from", "valid_until"))
    return bookkeeping.stale_notes(bookkeeping.salience(_seen(spark, d)), notes, F.lit(TODAY).cast("date"))


def _as_of_cut(spark: SparkSession, d: str) -> DataFrame:
    return current_notes(vault_log(spark, d).where(F.col("seen_at") <= F.lit(CUT).cast("timestamp_ntz")), ["rel_path", "raw_text"])


def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """The vault's files now against a manifest of an earlier scan."""
    return index.manifest_diff(index.source_map(_as_of_cut(spark, d)), index.source_map(notes_of(spark, d, "rel_path", "raw_text")))


def index_work(spark: SparkSession, d: str) -> DataFrame:
    return index.index_work(index.source_map(_as_of_cut(spark, d)), index.source_map(notes_of(spark, d, "rel_path", "raw_text")))


def vault_rev(spark: SparkSession, d: str) -> DataFrame:
    sources = index.source_map(notes_of(spark, d, "rel_path", "raw_text"))
    return index.revision(sources, [F.substring_index("rel_path", "/", 1).alias("folder")])


def intent_state(spark: SparkSession, d: str) -> DataFrame:
    """A batch per folder that was to bring every file from its state at the earlier scan to the one now."""
    before = index.source_map(_as_of_cut(spark, d)).withColumnRenamed("hash", "pre_hash")
    after = index.source_map(notes_of(spark, d, "rel_path", "raw_text"))
    t = before.join(after.withColumnRenamed("hash", "post_hash"), "rel_path", "full_outer")
    return index.target_states(t.select(F.substring_index("rel_path", "/", 1).alias("intent_id"), "rel_path", "pre_hash", "post_hash"), after)


def fault_scan(spark: SparkSession, d: str) -> DataFrame:
    """Notes whose frontmatter does not parse."""
    return notes_of(spark, d, "rel_path", "metadata").where("metadata is null").select("rel_path", F.lit("parse").alias("kind"))


def duplicate_name(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_names(notes_of(spark, d, "rel_path", "name"))


def folder_counts(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("rel_path")
    folder = F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("(root)")
    return notes_of(spark, d, "rel_path").groupBy(folder.alias("folder")).agg(F.count("*").alias("n"))


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.excerpt(F.col("text"), 120).alias("excerpt"))


def slugs(spark: SparkSession, d: str) -> DataFrame:
    return notes_of(spark, d, "rel_path").select("note_id", text.slug(F.regexp_replace("rel_path", "/", " ")).alias("slug"))


def date_coerce(spark: SparkSession, d: str) -> DataFrame:
    n = notes_of(spark, d, "name", "date", "valid_from")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return n.select(
        "note_id",
        day(dates.iso_day(F.col("valid_from"))).alias("iso"),
        day(dates.written_day(F.col("valid_from"))).alias("written"),
        day(dates.session_day(F.col("date"), F.col("name"))).alias("session"),
        dates.note_day(F.col("valid_from"), F.col("date"), F.col("name")).alias("note"),
    )


def fm_normalize(spark: SparkSession, d: str) -> DataFrame:
    m = text.comparable(F.col("metadata"))
    pairs = F.array_sort(F.map_entries(m))
    flat = F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return notes_of(spark, d, "metadata").where("metadata is not null").select("note_id", flat.alias("normal"))


def entity_keys(spark: SparkSession, d: str) -> DataFrame:
    return by_name(notes_of(spark, d, "rel_path", "name")).select("name", F.explode(text.entity_keys(F.col("name"))).alias("key"))


def note_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = chunking.chunk_notes(notes_of(spark, d, "name", "rel_path", "content", "metadata"))
    return rows.withColumns({c: F.col(c).cast("bigint") for c in ("pos", "part")})


def note_sections(spark: SparkSession, d: str) -> DataFrame:
    rows = notes_of(spark, d, "content").select("note_id", F.posexplode(text.sections(F.col("content"))).alias("pos", "s"))
    return rows.select("note_id", F.col("pos").cast("bigint").alias("pos"), F.col("s.title").alias("title"), F.length("s.body").cast("bigint").alias("n_chars"))


def stub_notes(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("metadata")
    return notes_of(spark, d, "rel_path", "metadata", "content").select("note_id", text.is_stub(m["type"], m["source"], F.col("content")).alias("stub"))


def look_alikes(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text with accents and look-alike letters folded away, hashed."""
    return table(spark, d, "documents").select("doc_id", text.digest(fold(F.col("text"))).alias("hash"))


def neutralize(spark: SparkSession, d: str) -> DataFrame:
    """Every bullet and every ``key: value`` line of a session's text made safe to quote as reference material."""
    lines = F.filter(F.split(F.coalesce("raw_text", F.lit("")), "\n"), lambda x: x.rlike(r"^\s*- |^[\w-]+:"))
    rows = notes_of(spark, d, "name", "raw_text").where(F.col("name").startswith("session-")).select("note_id", F.posexplode(lines).alias("pos", "line"))
    return rows.select("note_id", F.col("pos").cast("bigint").alias("pos"), text.neutralize(fold(F.col("line"))).alias("safe"))


QUERIES = {
    f.__name__: f
    for f in (
        content_hash, link_extract, edge_build, isolates, lane_assignment, lane_edges, lane_visible, bridge_detect, pagerank, ppr_seeded,
        spectral, resolve_current, resolve_as_of, current_entities, tfidf_idf, tfidf_knn, conflict_prefilter, propose_write, classify_write,
        conflict_summary, dense_topk, dense_topk_lane, dense_batch, max_per_note, seed_weights, salience, salience_top, co_retrieval, log_stats,
        link_proposals, stale_flags, manifest_diff, index_work, vault_rev, intent_state, fault_scan, duplicate_name, folder_counts, excerpts,
        slugs, date_coerce, fm_normalize, entity_keys, note_chunks, note_sections, stub_notes, look_alikes, neutralize,
    )
}
