"""Command line (L): ``python -m marginalia.cli VAULT VERB ...``. The vault may also be named by ``$MARGINALIA_VAULT``."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import date, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import bookkeeping, graph, index, temporal
from marginalia.operators.lanes import LaneRules
from marginalia.operators.vault_state import by_name
from marginalia.plans import bench, build, consolidate, doctor, dream, migrate, recall
from marginalia.session import local_session
from marginalia.sources import stores
from marginalia.sources.connectors import Embedder, HashEmbedder, HttpEmbedder, HttpModel
from marginalia.sources.vault import read_vault, split_faults, typed_notes
from marginalia.sources.verbs import Vault


def load(spark: SparkSession, root: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(notes, faults) of a vault."""
    notes, faults = split_faults(read_vault(spark, root, "FAILFAST" if strict else "PERMISSIVE"))
    return typed_notes(notes), faults


def embedder() -> Embedder:
    url = os.environ.get("MARGINALIA_EMBEDDER")
    return HttpEmbedder(url, os.environ.get("MARGINALIA_MODEL", "default")) if url else HashEmbedder()


def ask(spark: SparkSession, vault: Vault, query: str, lane: str, rules: LaneRules, k: int = 8, log: bool = True, session: str | None = None) -> recall.Recall:
    """Hybrid recall through the index, or the said-to-be-degraded walk where there is none or no embedder; a stale lane map
    is an error. Retrievals are logged with the query's hash only, never in read-only mode, and a log that fails is ignored."""
    folder = stores.index_folder(vault)
    try:
        nodes, edges, chunks = build.open_index(spark, folder, rules)
        vector = embedder().embed([query])[0]
    except (stores.IndexMissing, RuntimeError) as e:
        if isinstance(e, stores.LaneConfigStale):
            raise
        notes, _ = load(spark, str(vault.root))
        one = by_name(notes).withColumn("lane", lane_column(rules))
        return recall.degraded(one, graph.link_edges(notes, self_loops=True), query, lane, rules, str(e), k)
    found = recall.recall(nodes, edges, chunks, query, vector, lane, rules, k)
    if log and not os.environ.get("MARGINALIA_READONLY"):
        try:
            names = [r["name"] for r in found.hits.collect()]
            row = [(stores.file_hash(f"{datetime.now()}{query}"), datetime.now(), session or os.environ.get("MARGINALIA_SESSION"), "recall", stores.file_hash(query)[:12], str(names).replace("'", '"'))]
            stores.append_log(spark.createDataFrame(row, "id string, ts timestamp_ntz, session string, verb string, query string, results string"), folder)
        except Exception:  # noqa: BLE001 - telemetry never breaks a read
            found.note = "not logged"
    return found


def lane_column(rules: LaneRules):
    from marginalia.operators.lanes import lane_of

    return lane_of(F.col("rel_path"), F.col("raw_text"), rules)


VERBS = ["info", "doctor", "lint", "recall", "boot", "current", "rebuild", "status", "clear", "stats", "propose", "consolidate", "view", "bench", "dream", "migrate", "serve"]


def model() -> HttpModel | None:
    """The chat model named by ``$MARGINALIA_CHAT``, if any."""
    url = os.environ.get("MARGINALIA_CHAT")
    return HttpModel(url, os.environ.get("MARGINALIA_CHAT_MODEL", "default")) if url else None


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("marginalia")
    p.add_argument("vault", nargs="?", default=os.environ.get("MARGINALIA_VAULT"))
    p.add_argument("verb", choices=VERBS)
    p.add_argument("words", nargs="*")
    p.add_argument("--lane", default="operational")
    p.add_argument("--lanes", help="lane map file")
    p.add_argument("--apply", action="store_true")
    p.add_argument("--days", type=int, default=120)
    p.add_argument("--as-of", type=date.fromisoformat, help="day for current")
    p.add_argument("--retriever", default="hybrid", choices=["hybrid", "walk", "keyword"])
    p.add_argument("--to", help="bench: report to append to; migrate: the new folder")
    a = p.parse_args(argv)
    vault, rules = Vault(a.vault), stores.lane_rules(a.lanes) if a.lanes else LaneRules()
    if a.verb == "view":
        print(vault.view(" ".join(a.words)))
        return 0
    folder = stores.index_folder(vault)
    if a.verb == "clear":
        stores.clear_index(folder, a.apply)
        return 0
    spark = local_session()
    if a.verb == "recall":
        print(ask(spark, vault, " ".join(a.words), a.lane, rules).to_text())
        return 0
    if a.verb == "serve":
        from marginalia.tools import serve, tools

        serve(tools(spark, vault, rules), sys.stdin, sys.stdout)
        return 0
    notes, faults = load(spark, a.vault, strict=a.verb == "rebuild")
    if a.verb == "info":
        notes.groupBy(F.substring_index("rel_path", "/", 1).alias("folder")).count().orderBy("folder").show(100, False)
    elif a.verb == "doctor":
        rows = doctor.checks(notes, index.stale_intents(stores.read_intents(spark, folder), index.source_map(notes), F.current_timestamp())).collect()
        print("\n".join(f"{r['status']:5} {r['name']}: {r['message']}" for r in rows))
        return sum(r["status"] == "fail" for r in rows)
    elif a.verb == "lint":
        rows = doctor.lint(faults).orderBy("rel_path").collect()
        print("\n".join(f"{r['rel_path']}:{r['line'] or '-'}: {r['hint']}" for r in rows) or "no faults")
        return len(rows)
    elif a.verb == "rebuild":
        print(build.rebuild(spark, notes, folder, rules, embedder(), stores.vault_id(vault)))
    elif a.verb == "status":
        print(build.status(spark, notes, folder, rules).to_text())
    elif a.verb in ("stats", "propose"):
        log = stores.read_table(spark, folder, stores.LOG)
        if a.verb == "stats":
            bookkeeping.log_stats(log).show()
        else:
            print(proposal(spark, notes, log, folder))
    elif a.verb == "consolidate":
        one = by_name(notes)
        sessions = consolidate.recent_sessions(one, F.current_date(), a.days)
        touched = consolidate.touched_entities(one, sessions)
        planned = consolidate.patches(one, consolidate.activity_blocks(touched))
        print("\n".join(x.rel_path for x in planned) or "nothing to do")
        stamp = f"{datetime.now():%Y%m%d-%H%M%S}"
        text = consolidate.report(sessions, planned, touched, consolidate.signal_lines(notes), stamp, a.days, model())
        if a.apply and planned:
            stores.apply_patches(vault, folder, planned, stamp, text)
        elif a.apply:
            vault.write_text(f"_archive/consolidation-{stamp}.md", text)
    elif a.verb == "boot":
        print(recall.boot(by_name(notes), graph.link_edges(notes, self_loops=True), " ".join(a.words)).to_text())
    elif a.verb == "current":
        named = spark.createDataFrame([(w if w.startswith("entity-") else f"entity-{w[:1].upper()}{w[1:]}",) for w in a.words], "name string")
        rows = temporal.resolve(by_name(notes), named, F.lit(a.as_of.isoformat()).cast("date") if a.as_of else None).orderBy("start").collect()
        print("\n".join(f"{' > '.join(r['chain'])}: {r['current'] or 'none'}" for r in rows))
        return sum(r["current"] is None for r in rows)
    elif a.verb == "bench":
        asked = lambda query, lane, k: ask(spark, vault, query, lane, rules, k, log=False)
        found = bench.run_bench(stores.probes(spark, a.words[0]), notes, a.retriever, recall=asked)
        text = f"{found.to_markdown()}\n\n" + "\n".join(f"- {x}" for x in found.failures())
        print(text)
        if a.to:
            stores.append_report(Path(a.to), text)
    elif a.verb == "dream":
        answer = model()
        if answer is None:
            raise stores.DreamError("name a model: $MARGINALIA_CHAT")
        log = stores.read_table(spark, folder, stores.LOG)
        print(dream.dream(vault, folder, by_name(notes), bookkeeping.salience(bookkeeping.retrievals(log)), date.today(), answer).rel_path)
    elif a.verb == "migrate":
        planned = migrate.plan(notes, migration_rules(a.words[0]), F.current_date(), vault.root.name)
        print(migrate.report(planned))
        if a.apply:
            print(migrate.write(notes, planned, a.to))
    return 0


def migration_rules(path: str) -> list[migrate.Rule]:
    """Rules from a YAML list of ``name, pattern, folder, kind, naming``."""
    import yaml

    return [migrate.Rule(r["name"], r["pattern"], r.get("folder"), r.get("kind"), r.get("naming", "preserve_name")) for r in yaml.safe_load(Path(path).read_text(encoding="utf-8"))]


def proposal(spark: SparkSession, notes: DataFrame, log: DataFrame, folder) -> str:
    """The proposal report; only ever written beside the index."""
    seen = bookkeeping.retrievals(log)
    n = log.count()
    top = bookkeeping.top_salient(bookkeeping.salience(seen))
    links = bookkeeping.link_proposals(bookkeeping.co_retrieval(seen), graph.link_edges(notes)).orderBy(F.desc("count"), "a", "b").toLocalIterator()
    stale = bookkeeping.stale_notes(top, by_name(notes), F.current_date()).orderBy("note_name").collect()
    lines = ["# Proposals", f"{n} retrievals logged." + (" Thin evidence." if n < 10 else ""), "## Links", *[f"- [[{r['a']}]] and [[{r['b']}]]: together {r['count']} times" for r in links], "## Stale", *[f"- {r['note_name']}: valid from {r['valid_from']}" for r in stale], "## Salience", *[f"- {r['note_name']}: {r['recall_count']}" for r in top.collect()]]
    text = "\n".join(lines) + "\n"
    stores.write_report(folder, "proposals", str(date.today()), text)
    return text


if __name__ == "__main__":
    raise SystemExit(main())
