"""Retrieval verbs (I2-I4): boot by graph, hybrid recall, and the explicit fallback."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import entity_keys
from marginalia.operators.graph import cosine, pagerank
from marginalia.operators.lanes import LaneRules, visible
from marginalia.operators.temporal import resolve, resolved_seeds
from marginalia.operators.vector import best_per_note, dense_top, seed_weights
from marginalia.session import materialize

# Fusion weights, chunks fetched, seeds kept, results, damping, and the similarity below which a recall abstains.
W_DENSE, W_RANK, W_SPECTRAL, FETCH, SEEDS, RESULTS, ALPHA, FLOOR = 1.0, 0.15, 0.05, 24, 8, 8, 0.85, 0.64


@dataclass
class Recall:
    """Hits (``name, rel_path, score, dense_sim, ppr_score, superseded, best_section``, best first) and how they were found.
    An abstained recall still has its hits."""

    hits: DataFrame
    abstained: bool
    degraded: bool = False
    max_dense: float | None = None
    seeds: list[str] = field(default_factory=list)
    hops: list[tuple[str, str]] = field(default_factory=list)
    note: str = ""

    def to_text(self) -> str:
        """B33."""
        lines = ["(abstained: nothing is similar enough)"] if self.abstained else []
        lines += [f"(degraded: {self.note})"] if self.degraded else []
        lines += [f"({a} is superseded by {b})" for a, b in self.hops]
        for i, h in enumerate(self.hits.collect(), 1):
            lines.append(f"{i}. [[{h['name']}]] {h['score']:.3f}" + (" (superseded)" if h["superseded"] else "") + (f" — {h['best_section']}" if h["best_section"] else ""))
        return "\n".join(lines) or "(nothing)"


def mentioned(names: DataFrame, query: str) -> DataFrame:
    """Names one of whose keys, however long, stands in the query as whole words. The query is one literal, so the match
    is a test in the scan; keys of other separators are compared after turning them to blanks."""
    import re

    words = F.lit(f" {' '.join(re.findall(r"[^\W_]+(?:'[^\W_]+)?", query.lower()))} ")
    plain = F.transform(entity_keys(F.col("name")), lambda k: F.trim(F.regexp_replace(k, r"[^\p{L}\p{N}']+", " ")))
    return names.where(F.exists(plain, lambda k: (k != "") & F.contains(words, F.concat(F.lit(" "), k, F.lit(" ")))))


def boot(notes: DataFrame, edges: DataFrame, query: str, top: int = 8, alpha: float = ALPHA, **ranking) -> Recall:
    """Rank notes by a walk that restarts at the current versions of the entities the query mentions; without any,
    by plain PageRank, abstaining. Superseded notes are not shown. ``notes`` has one row per name."""
    named = materialize(mentioned(notes.select("name"), query), "named")
    now = resolve(notes, named)
    moved = resolved_seeds(named, now)
    seeds = sorted(r["name"] for r in moved.collect())  # the entities one query names
    hops = [(r["start"], r["current"]) for r in now.where("current <> start").orderBy("start").collect()]
    ranks = pagerank(notes, edges, moved.select("name", F.lit(1.0).alias("weight")) if seeds else None, alpha, **ranking)
    superseded = F.coalesce("superseded_by", F.lit("")) != ""
    hits = notes.join(ranks, "name").where(~superseded & (F.col("rank") > 0)).orderBy(F.desc(F.round("rank", 12)), "rel_path").limit(top)
    shaped = hits.select("name", "rel_path", F.col("rank").alias("score"), F.lit(None).cast("double").alias("dense_sim"), F.col("rank").alias("ppr_score"), F.lit(False).alias("superseded"), F.lit(None).cast("string").alias("best_section"))
    return Recall(shaped, not seeds, seeds=seeds, hops=hops)


def fuse(dense: DataFrame, ranks: DataFrame, nodes: DataFrame, anchor: Sequence[float] | None) -> DataFrame:
    """``name, score, ...`` over notes that are dense candidates or have rank: the weighted sum of similarity (not
    below 0), rank relative to the greatest, and nearness of the graph embedding to the strongest seed's."""
    most = ranks.agg(F.max("rank")).scalar()
    near = cosine(F.col("spectral"), F.array(*[F.lit(float(x)) for x in anchor])) if anchor is not None else F.lit(0.0)
    both = nodes.join(ranks, "name", "left").join(dense.withColumnRenamed("note_name", "name"), "name", "left")
    both = both.where(F.col("dense_sim").isNotNull() | (F.col("rank") > 0))
    relative = F.when(F.lit(most) > 0, F.coalesce("rank", F.lit(0.0)) / most).otherwise(0.0)
    score = W_DENSE * F.greatest(F.coalesce("dense_sim", F.lit(0.0)), F.lit(0.0)) + W_RANK * relative + W_SPECTRAL * near
    return both.withColumn("score", score)


def recall(nodes: DataFrame, edges: DataFrame, chunks: DataFrame, query: str, vector: Sequence[float], lane: str, rules: LaneRules, k: int = RESULTS, m: int = FETCH, floor: float = FLOOR, include_superseded: bool = True, **ranking) -> Recall:
    """I3. ``nodes(name, rel_path, lane, superseded, spectral)``, ``edges(src, dst)``, ``chunks(id, note_name, section,
    rel_path, lane, embedding)``.

    The lane filter stands at every seam: chunks before they are scored, seeds and edges before the walk, results before
    they are ranked. The recall abstains if the best visible similarity is below ``floor``.
    """
    seen = visible(F.col("lane"), F.col("rel_path"), lane, rules)
    allowed = materialize(nodes.where(seen).select("name", "rel_path", "lane", "superseded", "spectral"), "allowed")  # asked for at every seam
    hits = dense_top(chunks.where(seen), vector, m, lane)
    best = best_per_note(hits).join(allowed.select(F.col("name").alias("note_name")), "note_name", "left_semi")
    best = best.sparkSession.createDataFrame(best.collect(), best.schema)  # at most m rows
    dense_seeds = seed_weights(best, SEEDS)
    rows = dense_seeds.collect()
    top = max((r["weight"] for r in rows), default=1.0)
    named = mentioned(allowed.select("name"), query).withColumn("weight", F.lit(max(top, 1e-9)))
    seeds = dense_seeds.unionByName(named).groupBy("name").agg(F.max("weight").alias("weight"))
    inside = edges.join(allowed.select(F.col("name").alias("src")), "src", "left_semi").join(allowed.select(F.col("name").alias("dst")), "dst", "left_semi")
    seeds = materialize(seeds, "seeds")
    names = sorted(r["name"] for r in seeds.collect())  # the entities one query names and the nearest notes
    ranks = pagerank(allowed, inside, seeds if names else None, ALPHA, **ranking)
    strongest = max(rows, key=lambda r: (r["weight"], r["name"]), default=None)
    anchor = allowed.where(F.col("name") == strongest["name"]).select("spectral").first() if strongest else None
    fused = fuse(best, ranks, allowed, anchor[0] if anchor else None)
    kept = fused if include_superseded else fused.where(~F.col("superseded"))
    ordered = kept.orderBy(F.desc(F.round("score", 9)), "name").limit(k)
    out = ordered.select("name", "rel_path", "score", "dense_sim", F.col("rank").alias("ppr_score"), "superseded", "best_section")
    most = best.agg(F.max("dense_sim")).first()[0]
    return Recall(out, most is None or most < floor, max_dense=most, seeds=names)


def degraded(notes: DataFrame, edges: DataFrame, query: str, lane: Column | str, rules: LaneRules, why: str, k: int = RESULTS, **ranking) -> Recall:
    """The boot walk over the notes a lane may see, said to be degraded; used where the index or embedder is away."""
    allowed = notes.where(visible(F.col("lane"), F.col("rel_path"), lane, rules))
    out = boot(allowed, edges, query, k, **ranking)
    out.degraded, out.note = True, why
    return out
