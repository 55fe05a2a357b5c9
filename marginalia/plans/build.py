"""Building and checking the derived index."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.functions.chunks import chunk_notes
from marginalia.operators.graph import cut_lanes, link_edges, spectral
from marginalia.operators.index import index_work, manifest_diff, source_map
from marginalia.operators.lanes import LaneRules, bridges, eligible, lane_of
from marginalia.operators.vault_state import by_name
from marginalia.session import materialize
from marginalia.sources import stores
from marginalia.sources.connectors import Embedder, embed_column

BUILDER = 1


class BridgeError(RuntimeError):
    """Notes join two vocabularies that must stay apart; nothing was written."""


def graph_tables(notes: DataFrame, rules: LaneRules, dims: int = 16) -> tuple[DataFrame, DataFrame]:
    """(``name, rel_path, type, superseded, lane, spectral``, ``src, dst``), quarantined notes taken out first."""
    kept = notes.where(~F.col("rel_path").isin(list(rules.quarantined))) if rules.quarantined else notes
    one = by_name(kept)
    nodes = one.select("name", "rel_path", F.coalesce(F.col("metadata")["type"], F.lit("note")).alias("type"), (F.coalesce("superseded_by", F.lit("")) != "").alias("superseded"), lane_of(F.col("rel_path"), F.col("raw_text"), rules).alias("lane"))
    nodes = materialize(nodes, "nodes")
    edges = materialize(cut_lanes(link_edges(kept), nodes), "edges")
    return nodes.join(spectral(nodes, edges, dims), "name", "left"), edges


def chunk_table(notes: DataFrame, rules: LaneRules, embedder: Embedder) -> DataFrame:
    """Embedded chunks of eligible notes with the hash of their file. Lanes are joined when reading, so a new lane map
    never meets old lanes."""
    fit = notes.where(eligible(F.col("rel_path"), rules))
    pieces = chunk_notes(fit).join(source_map(fit), "rel_path")
    keyed = pieces.select(F.xxhash64("rel_path", "section", "pos", "part").alias("id"), F.col("name").alias("note_name"), "rel_path", "section", "text", "hash")
    return embed_column(keyed, embedder)


def rebuild(spark: SparkSession, notes: DataFrame, folder: Path, rules: LaneRules, embedder: Embedder, vault_id: str) -> dict:
    """One snapshot feeds all parts; bridges stop the build before anything is written; chunks of unchanged files are
    kept, unless the lane map, embedder or builder changed."""
    snapshot = materialize(notes, "vault")
    found = [r["rel_path"] for r in bridges(snapshot, rules).orderBy("rel_path").limit(20).collect()]
    if found:
        raise BridgeError(", ".join(found))
    old = stores.read_manifest(folder)
    same = old is not None and (old["builder"], old["embedder"], old["lanes"]) == (BUILDER, embedder.name, stores.lane_hash(rules))
    sources = materialize(source_map(snapshot, list(rules.quarantined)), "sources")
    if same and (folder / "chunks").is_dir():
        work = materialize(index_work(stores.read_table(spark, folder, "sources"), sources), "work")
        kept = stores.read_table(spark, folder, "chunks").join(work.where("drop").select("rel_path"), "rel_path", "left_anti")
        fresh = chunk_table(snapshot.join(work.where("build").select("rel_path"), "rel_path", "left_semi"), rules, embedder)
        chunks = kept.unionByName(fresh.select(kept.columns))
    else:
        chunks = chunk_table(snapshot, rules, embedder)
    chunks = materialize(chunks, "chunks")  # before the table it was partly read from is replaced
    nodes, edges = graph_tables(snapshot, rules)
    for name, df in (("chunks", chunks), ("nodes", nodes), ("edges", edges), ("sources", sources)):
        stores.write_table(df, folder, name)
    manifest = {"builder": BUILDER, "embedder": embedder.name, "dims": embedder.dims, "lanes": stores.lane_hash(rules), "vault": vault_id, "notes": snapshot.count(), "chunks": chunks.count()}
    stores.write_manifest(folder, manifest)
    return manifest


@dataclass
class Status:
    """L2.9: whether the index may be trusted, and why not."""

    state: str
    reasons: list[str]

    def to_text(self) -> str:
        return "\n".join([self.state, *[f"- {r}" for r in self.reasons[:10]]])


def status(spark: SparkSession, notes: DataFrame, folder: Path, rules: LaneRules) -> Status:
    """ABSENT, FRESH or STALE; reasons in order: builder, lane map, then files."""
    manifest = stores.read_manifest(folder)
    if manifest is None:
        return Status("ABSENT", [])
    if manifest.get("builder") != BUILDER:
        return Status("STALE", ["another builder"])
    if manifest.get("lanes") != stores.lane_hash(rules):
        return Status("STALE", ["the lane map changed"])
    diff = manifest_diff(stores.read_table(spark, folder, "sources"), source_map(notes, list(rules.quarantined)))
    rows = diff.orderBy("rel_path").limit(11).collect()
    return Status("STALE" if rows else "FRESH", [f"{r['rel_path']}: {r['change']}" for r in rows])


def open_index(spark: SparkSession, folder: Path, rules: LaneRules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, chunks with their lane); refuses an absent index and one built under another lane map."""
    manifest = stores.read_manifest(folder)
    if manifest is None:
        raise stores.IndexMissing(str(folder))
    if manifest.get("lanes") != stores.lane_hash(rules):
        raise stores.LaneConfigStale("rebuild the index: the lane map changed")
    nodes = stores.read_table(spark, folder, "nodes")
    chunks = stores.read_table(spark, folder, "chunks").join(nodes.select(F.col("name").alias("note_name"), "lane"), "note_name")
    return nodes, stores.read_table(spark, folder, "edges"), chunks
