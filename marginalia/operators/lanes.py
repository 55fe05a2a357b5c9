"""Retrieval lanes (C2-C5): which partition a note belongs to, and what must never be retrieved."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import count_terms, has_term, in_directory


@dataclass(frozen=True)
class LaneRules:
    """One lane map. ``lanes`` gives the lanes in order of precedence; ``vocab`` the terms of the two lanes a shared
    folder (``vocab_prefix``) is divided between, the first winning only with strictly more of its terms."""

    lanes: Sequence[str] = ("thesis", "operational", "neutral")
    default: str = "operational"
    files: Mapping[str, Sequence[str]] = field(default_factory=dict)
    globs: Mapping[str, Sequence[str]] = field(default_factory=dict)
    prefixes: Mapping[str, Sequence[str]] = field(default_factory=dict)
    vocab_prefix: str | None = None
    vocab: Mapping[str, Sequence[str]] = field(default_factory=dict)
    hubs: Sequence[str] = ()
    quarantined: Sequence[str] = ()
    bridge: tuple[Sequence[str], Sequence[str]] = ((), ())

    def __post_init__(self):
        if self.default not in self.lanes:
            raise ValueError(f"default lane {self.default!r} is not a lane")
        for name in (*self.files, *self.globs, *self.prefixes):
            if name not in self.lanes:
                raise ValueError(f"unknown lane {name!r}")

    @property
    def hidden(self) -> list[str]:
        """What is never retrieved: hubs and quarantined files."""
        return sorted({*self.hubs, *self.quarantined})


def _first(pairs: Sequence[tuple[Column, str]]) -> Column:
    out = None
    for test, lane in pairs:
        out = F.when(test, lane) if out is None else out.when(test, lane)
    return out if out is not None else F.lit(None).cast("string")


def lane_of(rel_path: Column, raw_text: Column, rules: LaneRules) -> Column:
    """Explicit path, explicit file name, name pattern (without regard to case), longest folder prefix, vocabulary of
    the shared folder, default; within a step the order of ``rules.lanes`` decides. Rules are configuration: a bounded
    set of literals, so the lane is one expression in the scan's stage."""
    base = F.substring_index(rel_path, "/", -1)
    by_path = _first([(rel_path.isin(list(rules.files.get(x, ()))), x) for x in rules.lanes if rules.files.get(x)])
    by_file = _first([(base.isin([p.rsplit("/", 1)[-1] for p in rules.files.get(x, ())]), x) for x in rules.lanes if rules.files.get(x)])
    by_glob = _first([(F.lower(base).rlike("|".join(_glob(g.lower()) for g in rules.globs[x])), x) for x in rules.lanes if rules.globs.get(x)])
    folders = sorted(((p, i, x) for i, x in enumerate(rules.lanes) for p in rules.prefixes.get(x, ())), key=lambda t: (-len(t[0]), t[1]))
    by_folder = _first([(rel_path.startswith(p), x) for p, _, x in folders])
    shared = F.lit(None).cast("string")
    if rules.vocab_prefix and len(rules.vocab) >= 2:
        special, common = list(rules.vocab)[:2]
        text = F.lower(F.coalesce(raw_text, F.lit("")))
        more = count_terms(text, rules.vocab[special]) > count_terms(text, rules.vocab[common])
        shared = F.when(rel_path.startswith(rules.vocab_prefix), F.when(more, special).otherwise(common))
    return F.coalesce(by_path, by_file, by_glob, by_folder, shared, F.lit(rules.default))




def _glob(pattern: str) -> str:
    """A file-name pattern (``*``, ``?``) as an anchored regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def eligible(rel_path: Column, rules: LaneRules) -> Column:
    """C4: may be embedded: not archived, not hidden."""
    hidden = rel_path.isin(rules.hidden) if rules.hidden else F.lit(False)
    return ~in_directory(rel_path, "_archive") & ~hidden


def visible(lane: Column, rel_path: Column, wanted: str, rules: LaneRules) -> Column:
    """Retrievable for a lane; unknown lanes and paths are invisible (the filter fails closed)."""
    hidden = rel_path.isin(rules.hidden) if rules.hidden else F.lit(False)
    return F.coalesce(lane.isin(wanted, "neutral") & ~hidden, F.lit(False))


def bridges(notes: DataFrame, rules: LaneRules) -> DataFrame:
    """``rel_path`` of notes with terms of both vocabularies that no rule names; any such note must stop a build.
    Either vocabulary empty turns the test off."""
    left, right = rules.bridge
    if not left or not right:
        return notes.select("rel_path").limit(0)
    text = F.lower(F.coalesce("raw_text", F.lit("")))
    ruled = sorted({p for v in rules.files.values() for p in v} | set(rules.quarantined))
    test = _any(text, left) & _any(text, right)
    if ruled:
        test = test & ~F.col("rel_path").isin(ruled)
    return notes.where(test).select("rel_path")


def _any(text: Column, terms: Sequence[str]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | has_term(text, t)
    return out
