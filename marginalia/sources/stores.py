"""Files beside the vault (A16-A28, A31, A32, A34): the index folder, manifest, intents, lane and probe files, reports.

The index is a cache outside the vault: deleting it costs a rebuild and nothing else. Tables in it are Parquet.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import uuid
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from marginalia.operators.lanes import LaneRules
from marginalia.sources.remote import RemotePath
from marginalia.sources.verbs import Vault

#: Tables of the index that are derived from the vault, and the one that is not.
DERIVED, LOG = ("chunks", "nodes", "edges", "spectral", "sources", "manifest.json"), "retrieval_log"
INTENT_SCHEMA = "intent_id string, status string, created_at string, completed_at string, targets array<struct<rel_path:string,pre_hash:string,post_hash:string,backup_rel_path:string>>"


class IndexMissing(RuntimeError):
    """There is no index; a read never makes one."""


class LaneConfigStale(RuntimeError):
    """The index was built under another lane map; it must not be read."""


def vault_id(vault: Vault) -> str:
    """B13."""
    return hashlib.sha256(str(vault.root).encode()).hexdigest()[:16]


def index_folder(vault: Vault, base: str | None = None) -> Path | RemotePath:
    """A vault's own folder under ``base``, ``$MARGINALIA_INDEX``, or a folder of the session's ``spark.checkpoint.dir``; a
    session on one machine without that setting may use the user's cache. URIs go through Spark's file systems. Never inside
    the vault."""
    spark = SparkSession.getActiveSession()
    shared = spark.conf.get("spark.checkpoint.dir", None) if spark else None
    chosen = base or os.environ.get("MARGINALIA_INDEX") or (f"{shared.rstrip('/')}/marginalia-index" if shared else None)
    if chosen is None and spark is not None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("name a folder all executors share: $MARGINALIA_INDEX or spark.checkpoint.dir")
    if chosen and "://" in str(chosen) and not str(chosen).startswith("file://"):
        return RemotePath(str(chosen)) / vault_id(vault)
    root = Path(str(chosen or Path.home() / ".cache" / "marginalia").removeprefix("file://")).expanduser().resolve()
    folder = root / vault_id(vault)
    if folder == vault.root or vault.root in folder.parents:
        raise ValueError("the index must lie outside the vault")
    return folder


def clear_index(folder: Path, everything: bool = False) -> None:
    """Delete what is derived; the log too if asked."""
    for name in (*DERIVED, *([LOG] if everything else [])):
        target = folder / name
        if isinstance(target, RemotePath):
            target.remove()
        elif target.is_dir():
            shutil.rmtree(target)
        elif target.exists():
            target.unlink()


def write_manifest(folder: Path, manifest: Mapping) -> None:
    """Sorted keys and no clock, so equal vaults give equal bytes."""
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=1) + "\n", encoding="utf-8")


def read_manifest(folder: Path) -> dict | None:
    try:
        return json.loads((folder / "manifest.json").read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return None


def write_table(df: DataFrame, folder: Path, name: str) -> None:
    """A derived table, replaced whole."""
    df.write.mode("overwrite").parquet(str(folder / name))


def read_table(spark: SparkSession, folder: Path, name: str) -> DataFrame:
    if not (folder / name).is_dir():
        raise IndexMissing(f"no {name} in {folder}")
    return spark.read.parquet(str(folder / name))


def append_log(df: DataFrame, folder: Path) -> None:
    """The retrieval log only ever grows."""
    df.write.mode("append").parquet(str(folder / LOG))


def file_hash(text: str | None) -> str:
    return hashlib.sha256((text or "").encode()).hexdigest()[:16]


def begin_intent(folder: Path, targets: Sequence[Mapping[str, str]]) -> Path:
    """One pending record per batch, written before any file is touched."""
    name = uuid.uuid4().hex[:12]
    path = folder / "intents" / f"{name}.json"
    path.parent.mkdir(parents=True, exist_ok=True)
    record = {"intent_id": name, "status": "pending", "created_at": datetime.now(UTC).isoformat(), "completed_at": None, "targets": list(targets)}
    path.write_text(json.dumps(record, sort_keys=True), encoding="utf-8")
    return path


def complete_intent(path: Path) -> None:
    record = json.loads(path.read_text(encoding="utf-8"))
    record |= {"status": "completed", "completed_at": datetime.now(UTC).isoformat()}
    path.write_text(json.dumps(record, sort_keys=True), encoding="utf-8")


def read_intents(spark: SparkSession, folder: Path) -> DataFrame:
    """All records. Files that are no record are left out, with a warning that names them."""
    if not (folder / "intents").is_dir():
        return spark.createDataFrame([], INTENT_SCHEMA)
    rows = spark.read.schema(INTENT_SCHEMA).json(str(folder / "intents"), multiLine=True)
    broken = [r[0] for r in rows.where("intent_id is null").select("_metadata.file_name").distinct().collect()]
    if broken:
        warnings.warn(f"no intent record: {', '.join(sorted(broken))}", stacklevel=2)
    return rows.where("intent_id is not null")


def lane_rules(path: str) -> LaneRules:
    """Lane rules from a YAML file with the keys ``default_lane, lanes, dense_excluded_files, quarantined_files,
    bridge_vocab, learninglayer``; unknown lanes and a default that is no lane are refused."""
    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8")) or {}
    lanes = raw.get("lanes") or {}
    shared, bridge = raw.get("learninglayer") or {}, raw.get("bridge_vocab") or {}

    def part(key: str) -> dict[str, list[str]]:
        return {lane: list(rules.get(key) or []) for lane, rules in lanes.items()}

    return LaneRules(
        lanes=tuple(lanes) or ("thesis", "operational", "neutral"), default=raw.get("default_lane", "operational"),
        files=part("explicit_files"), globs=part("filename_globs"), prefixes=part("dir_prefixes"),
        vocab_prefix=shared.get("dir_prefix"), vocab=shared.get("vocab") or {},
        hubs=tuple(raw.get("dense_excluded_files") or ()), quarantined=tuple(raw.get("quarantined_files") or ()),
        bridge=(tuple(bridge.get("pseudonym_vocab") or ()), tuple(bridge.get("realname_vocab") or ())),
    )


def lane_hash(rules: LaneRules) -> str:
    return file_hash(json.dumps(rules.__dict__, sort_keys=True, default=list))


#: The categories of probes.
CATEGORIES = ["single-hop", "associative", "temporal", "knowledge-update", "abstention"]


def probes(spark: SparkSession, path: str, lanes: Sequence[str] = ("thesis", "operational", "neutral")) -> DataFrame:
    """``id, category, query, gold, lane`` from a YAML list; repeated ids, unknown categories or lanes, and a gold
    list that is empty but for abstention (or the reverse) are refused. ``ops`` is short for ``operational``."""
    import yaml

    rows, seen = [], set()
    for p in yaml.safe_load(Path(path).read_text(encoding="utf-8")) or []:
        lane = {"ops": "operational"}.get(p.get("lane") or "operational", p.get("lane") or "operational")
        gold = list(p.get("gold") or [])
        if p["id"] in seen:
            raise ValueError(f"repeated probe {p['id']}")
        if p["category"] not in CATEGORIES or lane not in lanes:
            raise ValueError(f"probe {p['id']}: unknown category or lane")
        if (p["category"] == "abstention") == bool(gold):
            raise ValueError(f"probe {p['id']}: gold must be empty for abstention and only there")
        seen.add(p["id"])
        rows.append((p["id"], p["category"], p["query"], gold, lane))
    return spark.createDataFrame(rows, "id string, category string, query string, gold array<string>, lane string")


class HydrationError(RuntimeError):
    """A bundle cannot be put together."""


class DreamError(RuntimeError):
    """A brief cannot be written."""


def read_persona(name: str, *folders: str) -> str:
    """A persona's text from the first folder that has it; the name must be one plain token."""
    if not re.fullmatch(r"[a-z0-9_-]+", name):
        raise HydrationError(f"not a persona name: {name!r}")
    for folder in folders:
        for path in (Path(folder) / name / "SOUL.md", Path(folder) / f"{name}.md"):
            if path.is_file():
                return path.read_text(encoding="utf-8")
    raise HydrationError(f"no persona {name}")


@dataclass
class Patch:
    """One planned change of a file."""

    rel_path: str
    before: str | None
    after: str
    backup: str | None = field(default=None)
    block: str | None = field(default=None)


def apply_patches(vault: Vault, folder: Path, patches: Sequence[Patch], stamp: str, report: str | None = None) -> Path:
    """A journalled batch: record, backups, writes, completion, and the report beside the backups. A run that dies leaves the record pending, with the
    hashes that tell which files it reached. Files changed since they were read stop the batch before anything is written."""
    for p in patches:
        now = vault.read_text(p.rel_path) if vault.exists(p.rel_path) else None
        if now != p.before:
            raise RuntimeError(f"{p.rel_path} changed since it was read")
        p.backup = f"_archive/{Path(p.rel_path).stem}-{stamp}.md" if p.before is not None else None
    targets = [{"rel_path": p.rel_path, "pre_hash": file_hash(p.before), "post_hash": file_hash(p.after), "backup_rel_path": p.backup} for p in patches]
    intent = begin_intent(folder, targets)
    for p in patches:
        if p.backup:
            vault.write_text(p.backup, p.before or "")
    for p in patches:
        vault.write_text(p.rel_path, p.after)
    complete_intent(intent)
    if report is not None:
        vault.write_text(f"_archive/consolidation-{stamp}.md", report)
    return intent


def write_report(folder: Path, kind: str, day: str, text: str) -> Path:
    """A report beside the index, one per kind and day."""
    path = folder / kind / f"{kind.rstrip('s')}-{day}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def append_report(path: Path, text: str) -> None:
    """Add a section to a report, after what is there."""
    path.parent.mkdir(parents=True, exist_ok=True)
    before = path.read_text(encoding="utf-8").rstrip("\n") + "\n\n" if path.exists() else ""
    path.write_text(before + text.rstrip("\n") + "\n", encoding="utf-8")


def sample_note(vault: Vault, rel: str = "sessions/session-2026-01-05-sample.md") -> str:
    """A small valid note to try things on."""
    return vault.create(rel, "---\ntype: session\ndate: 2026-01-05\ntouches:\n  - '[[entity-Sample]]'\n---\n# Sample session\n\n- decided: keep the sample short\n")
