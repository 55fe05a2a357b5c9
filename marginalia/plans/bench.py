"""Measuring retrievers on probes (I19, L2.1-L2.3): the boot walk, the keyword floor and hybrid recall."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import entity_keys
from marginalia.operators.graph import best_walked, link_edges, pagerank, walks
from marginalia.operators.temporal import resolve
from marginalia.operators.vault_state import by_name
from marginalia.plans import scores
from marginalia.plans.recall import Recall
from marginalia.session import materialize

_HITS = "id string, name string, score double, rank int"


def mentions(probes: DataFrame, names: DataFrame) -> DataFrame:
    """D7 for many queries: ``id, name`` of the names one of whose keys stands in the query as whole words. Keys and the
    queries' runs of words, as long as the longest key, meet on equality."""
    word = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)?"
    plain = F.transform(entity_keys(F.col("name")), lambda k: F.trim(F.regexp_replace(k, r"[^\p{L}\p{N}']+", " ")))
    keys = names.select("name", F.explode(F.array_distinct(plain)).alias("run")).where("run <> ''")
    longest = keys.agg(F.max(F.size(F.split("run", " ")))).first()[0] or 0
    w = F.regexp_extract_all(F.lower("query"), F.lit(f"({word})"), F.lit(1))

    def runs(words):
        at = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
        return F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.lit(max(longest, 1))), lambda n: F.when(i + n - 1 <= F.size(words), F.array_join(F.slice(words, i, n), " ")))))

    asked = probes.select("id", w.alias("w")).select("id", F.explode(F.array_distinct(runs(F.col("w")))).alias("run")).where("run is not null")
    return asked.join(keys, "run").select("id", "name").distinct()


def walk_hits(probes: DataFrame, notes: DataFrame, edges: DataFrame, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """L2.1: (``id, name, score, rank``, ``id`` of the probes abstained from): the boot walk for every probe at once.

    Walks restart at the current versions of what a query mentions; one that mentions nothing gets the notes of greatest plain
    PageRank and is abstained from. Superseded notes are not shown; lanes are not looked at. ``notes`` has one row per name.
    """
    named = materialize(mentions(probes, notes.select("name")), "mentions")
    now = resolve(notes, named.select("name")).where("current is not null").select(F.col("start").alias("name"), "current")
    seeds = materialize(named.join(now, "name").select("id", F.col("current").alias("name"), F.lit(1.0).alias("weight")).distinct(), "seeds")
    shown = notes.where(F.coalesce("superseded_by", F.lit("")) == "").select("name", "rel_path")
    order = Window.partitionBy("id").orderBy(F.desc(F.round("rank", 12)), "rel_path")
    # the graph is carried to every walk if it is small enough, else all walks meet it a round at a time
    flagged = notes.select("name", "rel_path", (F.coalesce("superseded_by", F.lit("")) == "").alias("shown"))
    ranks = best_walked(flagged, edges, seeds, k)
    ranks = walks(notes, edges, seeds) if ranks is None else ranks
    warm = ranks.join(shown, "name").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
    cold = materialize(probes.select("id").join(seeds.select("id").distinct(), "id", "left_anti"), "cold")
    cols = ["id", "name", F.col("rank").alias("score"), F.col("r").cast("int").alias("rank")]
    hits = warm.select(*cols)
    if cold.limit(1).count():
        best = pagerank(notes, edges).join(shown, "name").where("rank > 0").orderBy(F.desc(F.round("rank", 12)), "rel_path").limit(k)
        listed = best.withColumn("r", F.row_number().over(Window.orderBy(F.desc(F.round("rank", 12)), "rel_path")))  # k rows
        hits = hits.unionByName(cold.crossJoin(F.broadcast(listed)).select(*cols))  # k rows to each probe
    return materialize(hits, "hits"), cold


def recalled_hits(probes: DataFrame, recall: Callable[[str, str, int], Recall], k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Hits of hybrid recall, one call per probe: a probe set is a file written by hand. A degraded recall is refused: its
    figures would be another retriever's."""
    rows, silent = [], []
    for p in probes.select("id", "query", "lane").toLocalIterator():
        found = recall(p["query"], p["lane"], k)
        if found.degraded:
            raise RuntimeError(f"recall is degraded ({found.note}); hybrid figures would be another retriever's")
        rows += [(p["id"], h["name"], float(h["score"]), i) for i, h in enumerate(found.hits.collect(), 1)]
        silent += [(p["id"],)] if found.abstained else []
    spark = probes.sparkSession
    return spark.createDataFrame(rows, _HITS), spark.createDataFrame(silent, "id string")


@dataclass
class BenchReport:
    """L2.3: judged probes (see :func:`scores.judge`) with what was retrieved for each."""

    retriever: str
    k: int
    notes: int
    judged: DataFrame

    def to_markdown(self) -> str:
        rows = {r["category"]: r for r in scores.summary(self.judged).collect()}
        lines = [f"### `{self.retriever}`, {self.k} results, {self.notes} notes", "", "| category | n | hits | recall | rank |", "|---|---|---|---|---|"]
        for name in sorted(c for c in rows if c != "overall"):
            r = rows[name]
            shown = f"{r['pass_rate']:.2f} abstained | — | —" if name == "abstention" else f"{r['hit_rate']:.2f} | {r['recall']:.2f} | {r['mrr']:.2f}"
            lines.append(f"| {name} | {r['n']} | {shown} |")
        if (all_ := rows.get("overall")) is not None and all_["n"]:
            lines.append(f"| all that can be answered | {all_['n']} | {all_['hit_rate']:.2f} | {all_['recall']:.2f} | {all_['mrr']:.2f} |")
            lines += ["", f"abstained from {all_['false_abstain']:.2f} of them"]
        return "\n".join(lines)

    def failures(self) -> list[str]:
        """Probes that did not pass, with the first five notes they got."""
        rows = self.judged.where("not passed").orderBy("category", "id").toLocalIterator()
        return [f"[{r['category']}] {r['id']}: {r['query']!r} got {list(r['got'] or [])[:5]}, wanted {list(r['gold'])}" + (", abstained" if r["abstained"] else "") for r in rows]


def run_bench(probes: DataFrame, notes: DataFrame, retriever: str, k: int = 8, recall: Callable[[str, str, int], Recall] | None = None) -> BenchReport:
    """I19 with ``retriever`` ``walk``, ``keyword`` or ``hybrid`` (which needs ``recall(query, lane, k)``); gold names no note has
    are refused before anything is scored. ``notes`` may hold several notes of a name."""
    one = materialize(by_name(notes), "notes")
    missing = scores.unknown_gold(probes, one).orderBy("id", "name").limit(20).collect()
    if missing:
        raise ValueError("no such note: " + ", ".join(f"{r['id']}: {r['name']}" for r in missing))
    if retriever == "keyword":
        hits, silent = materialize(scores.keyword_hits(probes, one, k).select("id", "name", "score", "rank"), "hits"), None
    elif retriever == "walk":
        hits, silent = walk_hits(probes, one, link_edges(notes, self_loops=True), k)
    elif retriever == "hybrid":
        if recall is None:
            raise ValueError("hybrid recall needs an index")
        hits, silent = recalled_hits(probes, recall, k)
    else:
        raise ValueError(f"no retriever {retriever!r}")
    got = hits.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "name"))), lambda x: x["name"]).alias("got"))  # k names
    judged = scores.judge(probes, hits, silent).join(probes.select("id", "query", "gold"), "id").join(got, "id", "left")
    return BenchReport(retriever, k, notes.count(), materialize(judged, "judged"))
