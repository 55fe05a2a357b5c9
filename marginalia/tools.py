"""The verbs as tools for an agent (L): name, callable, and whether it writes. Writing tools are absent in read-only mode."""

from __future__ import annotations

import json
import os
from collections.abc import Callable, Iterable, Mapping
from typing import TextIO

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from marginalia.cli import ask, load
from marginalia.operators.lanes import LaneRules
from marginalia.operators.vault_state import by_name
from marginalia.plans import gate, hydrate
from marginalia.sources.vault import inside
from marginalia.sources.verbs import Vault


def _on(name: str) -> bool:
    return os.environ.get(name, "").strip().lower() in ("1", "true", "yes", "on")


def advice(spark: SparkSession, vault: Vault, rel: str) -> str:
    """Advice on a note just written, against the vault as it is now; any failure gives none."""
    try:
        path = vault.rel(inside(vault.root, rel))
        notes, _ = load(spark, str(vault.root))
        new = notes.where(F.col("rel_path") == path).withColumn("new_id", F.lit(1).cast("long"))
        rows = gate.advise(new, notes).collect()
    except Exception:  # noqa: BLE001 - the gate is advisory and fails open
        return ""
    return "".join(f"\nadvice: {r['verdict']} {r['target_path']}" + (f" ({r['summary']})" if r["summary"] else "") for r in rows if r["verdict"] != "ADD")


def tools(spark: SparkSession, vault: Vault, rules: LaneRules | None = None, readonly: bool | None = None, write_gate: bool | None = None) -> Mapping[str, Callable[..., str]]:
    """The tool table; ``readonly`` and ``write_gate`` default to ``$MARGINALIA_READONLY`` and ``$MARGINALIA_WRITE_GATE``."""
    rules = rules or LaneRules()
    readonly = _on("MARGINALIA_READONLY") if readonly is None else readonly
    write_gate = _on("MARGINALIA_WRITE_GATE") if write_gate is None else write_gate

    def bundle(entity: str, domain: str | None = None) -> str:
        folders = [f for f in os.environ.get("MARGINALIA_PERSONAS", "").split(os.pathsep) if f]
        return hydrate.hydrate(by_name(load(spark, str(vault.root))[0]), entity, domain, folders=folders).to_text()

    def recalled(query: str, lane: str = "operational", k: int = 8) -> str:
        return ask(spark, vault, query, lane, rules, k, log=not readonly).to_text()

    table: dict[str, Callable[..., str]] = {"view": vault.view, "hydrate": bundle, "recall": recalled}
    if readonly:
        return table

    def gated(write: Callable[..., str]) -> Callable[..., str]:
        def run(rel: str, *args) -> str:
            return write(rel, *args) + (advice(spark, vault, rel) if write_gate else "")

        return run

    return table | {"create": gated(vault.create), "str_replace": gated(vault.str_replace), "insert": gated(vault.insert), "delete": vault.delete}


def serve(table: Mapping[str, Callable[..., str]], lines: Iterable[str], out: TextIO) -> None:
    """A tool server over a pair of streams: a JSON-RPC request a line in, an answer a line out. ``tools/list`` names the tools,
    ``tools/call`` runs one (``name, arguments``); a tool that fails is an answer with its error, not the server's end."""
    for line in filter(None, map(str.strip, lines)):
        answer: dict = {"jsonrpc": "2.0", "id": None}
        try:
            request = json.loads(line)
            answer["id"], params = request.get("id"), request.get("params") or {}
            if request["method"] == "tools/list":
                answer["result"] = {"tools": [{"name": n, "description": (f.__doc__ or "").strip()} for n, f in sorted(table.items())]}
            elif request["method"] == "tools/call":
                given = params.get("arguments") or {}
                run = table[params["name"]]
                text = run(**given) if isinstance(given, dict) else run(*given)
                answer["result"] = {"content": [{"type": "text", "text": text}]}
            else:
                answer["error"] = {"code": -32601, "message": f"no method {request['method']}"}
        except Exception as e:  # noqa: BLE001 - the server outlives a request
            answer["error"] = {"code": -32000, "message": f"{type(e).__name__}: {e}"}
        if answer["id"] is not None or "error" in answer:
            out.write(json.dumps(answer) + "\n")
            out.flush()
