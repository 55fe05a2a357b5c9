"""The nightly brief (I16, A24, L2.13): evidence, a prompt, a model's bullets held to a contract, one note written."""

from __future__ import annotations

import os
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.plans.consolidate import LOOK_BACK, THREADS, brief_evidence
from marginalia.sources.connectors import Model, answer_bullets
from marginalia.sources.stores import DreamError
from marginalia.sources.verbs import Vault

#: Characters of a signal file that a prompt quotes, and bullets a brief holds.
QUOTED, BULLETS = 1_500, 6
CONTRACT = (
    "Write what will need attention tomorrow and why, from the evidence below and nothing else.\n"
    "Answer with three to six lines. Every line begins with '- ' and has at most thirty words.\n"
    "No headings, no introduction, no quotes of the evidence, no questions, no address to the reader.\n"
)


@dataclass
class Dream:
    rel_path: str
    signals: int
    threads: int
    bullets: list[str]


def brief_folder(vault: Vault) -> str:
    """``$MARGINALIA_BRIEFS``, else a folder ``briefs`` at the root or one level down, else ``briefs``."""
    named = os.environ.get("MARGINALIA_BRIEFS", "").strip("/")
    if named:
        return named
    if (vault.root / "briefs").is_dir():
        return "briefs"
    below = sorted(p.parent.name for p in vault.root.glob("*/briefs") if p.is_dir())
    return f"{below[0]}/briefs" if below else "briefs"


def prompt(signals: list, threads: list) -> str:
    """The contract and the evidence: ``signals(name, content)`` and ``threads(name, thread)``."""
    lines = [CONTRACT, f"Signals of the last {LOOK_BACK} days"]
    for s in signals:
        lines += [f"[{s['name']}]", (s["content"] or "").strip()[:QUOTED]]
    lines.append("Open threads of the notes recalled most")
    lines += [f"- ({t['name']}) {t['thread']}" for t in threads[:THREADS]]
    if not signals and not threads:
        lines.append("- nothing happened; say so in one line")
    return "\n".join(lines)


def dream(vault: Vault, folder: Path, notes: DataFrame, salience: DataFrame, day: date, model: Model, write: bool = True) -> Dream:
    """One brief, written through the vault's own verbs; nothing else in the vault is touched.

    ``notes`` has one row per name. An answer without a bullet of its own is asked for once more, then DreamError and no
    brief. The prompt lies beside the index while the model is asked and is always deleted. Evidence is bounded: the signal
    files of three days, six notes, twenty threads.
    """
    recent, top, open_ = brief_evidence(notes, salience, F.lit(day.isoformat()).cast("date"))
    signals, best, threads = recent.orderBy("rel_path").collect(), top.collect(), open_.collect()
    scratch = folder / "scratch" / f"dream-{day.isoformat()}.md"
    scratch.parent.mkdir(parents=True, exist_ok=True)
    try:
        asked = prompt(signals, threads)
        scratch.write_text(asked, encoding="utf-8")
        bullets = answer_bullets(model(asked), asked, BULLETS)
        if not bullets:
            bullets = answer_bullets(model("The last answer broke the rules: it had no line of its own that begins with '- '.\n" + asked), asked, BULLETS)
        if not bullets:
            raise DreamError("the model gave no bullets of its own, twice")
    finally:
        if scratch.exists():
            scratch.unlink()
    rel = f"{brief_folder(vault)}/brief-{day.isoformat()}.md"
    text = [
        "---", "type: morning-brief", f"date: '{day.isoformat()}'", "status: current", "---", "", f"# Morning brief {day.isoformat()}", "", "## Anticipations", *bullets, "", "## Evidence",
        "- signals: " + (", ".join(f"[[{s['name']}]]" for s in signals) or "none"),
        "- recalled most: " + (", ".join(f"[[{r['note_name']}]] ({r['recall_count']})" for r in best) or "none"),
    ]
    if write:
        vault.write_text(rel, "\n".join(text) + "\n")
    return Dream(rel, len(signals), len(threads), bullets)
