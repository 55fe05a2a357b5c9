"""Plain Python versions of the general problems' definitions, for comparison on small tables."""

from __future__ import annotations

import re
from collections import defaultdict
from datetime import date, datetime, timedelta

LINK = re.compile(r"\[\[([^\]|#]+?)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]")
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def target(value):
    if value is None:
        return None
    m = LINK.search(value)
    return ((m.group(1) if m else value).strip()) or None


def day(value):
    if value is None:
        return None
    s = value.strip().strip("'\"").strip()
    for pattern, order in (
        (r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})(?:[T ].*)?", "ymd"),
        (r"(\d{4})(\d\d)(\d\d)", "ymd"),
        (r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "dmy"),
        (r"(\d{1,2}) ([A-Za-z]{3,}) (\d{4})", "dmy"),
        (r"([A-Za-z]{3,}) (\d{1,2}), (\d{4})", "mdy"),
    ):
        m = re.fullmatch(pattern, s)
        if m:
            part = dict(zip(order, m.groups(), strict=True))
            month = part["m"] if part["m"].isdigit() else str(MONTHS.index(part["m"][:3].lower()) + 1) if part["m"][:3].lower() in MONTHS else "0"
            try:
                return date(int(part["y"]), int(month), int(part["d"]))
            except ValueError:
                return None
    return None


def last(rows):
    state = {}
    for r in rows:
        if r["note_id"] not in state or r["seen_at"] >= state[r["note_id"]]["seen_at"]:
            state[r["note_id"]] = r
    return state


def refs(row):
    out = {("touches", target(x)) for x in row["touches"] or []}
    out |= {("content", m.strip()) for m in LINK.findall(row["content"] or "")}
    return {(f, t) for f, t in out if t}


def orphans(notes, seeds):
    born, alive = {}, defaultdict(bool)
    for rows in (notes, seeds):
        for r in rows:
            born[r["name"]] = min(born.get(r["name"], r["seen_at"]), r["seen_at"])
        state = last(rows)
        for r in rows:
            alive[r["name"]] |= not state[r["note_id"]]["deleted"]
    first = {}
    for r in notes:
        for f, t in refs(r):
            k = (r["note_id"], f, t)
            first[k] = min(first.get(k, r["seen_at"]), r["seen_at"])
    out = set()
    for i, r in last(notes).items():
        if r["deleted"]:
            continue
        for f, t in refs(r):
            state = "missing" if t not in born else "deleted" if not alive[t] else "late" if born[t] > first[i, f, t] else None
            if state:
                out.add((i, f, t, state))
    return out


def entities(notes, seeds):
    """Entity notes as (src, id) with their rows, and the components of the latest rows."""
    rows = defaultdict(list)
    for src, table in ((0, notes), (1, seeds)):
        for r in table:
            if r["name"] and r["name"].startswith("entity-"):
                rows[src, r["note_id"]].append(r)
    state = {k: max(v, key=lambda r: r["seen_at"]) for k, v in rows.items()}
    by_name = defaultdict(list)
    for k, r in state.items():
        by_name[r["name"]].append(k)
    up = {k: k for k in state}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for k, r in state.items():
        t = target(r["superseded_by"])
        for other in by_name.get(t, []):
            up[root(k)] = root(other)
    groups = defaultdict(list)
    for k in state:
        groups[root(k)].append(k)
    return rows, state, list(groups.values())


def versions(notes, seeds):
    _, state, groups = entities(notes, seeds)
    out = set()
    for g in groups:
        v = sorted((day(state[k]["valid_from"]), state[k]["name"]) for k in g if day(state[k]["valid_from"]))
        if len(v) > 1:
            ends = [str(d) for d, _ in v[1:]] + [""]
            out |= {(v[0][1], n, str(d), e) for (d, n), e in zip(v, ends, strict=True)}
    return out


def as_known(notes, seeds):
    rows, state, groups = entities(notes, seeds)
    of_name = defaultdict(set)
    named = []
    for g in groups:
        v = sorted((day(state[k]["valid_from"]), state[k]["name"]) for k in g if day(state[k]["valid_from"]))
        if len(v) > 1:
            named.append((v[0][1], g))
            for k in g:
                of_name[state[k]["name"]].add(len(named) - 1)
    out = set()
    for i, r in last(notes).items():
        if r["deleted"] or not r["name"].startswith("session-"):
            continue
        d = day(r["date"]) if r["date"] is not None else day(r["name"][8:18])
        if not d:
            continue
        end = datetime(d.year, d.month, d.day) + timedelta(days=1)
        for e in {e for x in r["touches"] or [] if target(x) for e in of_name.get(target(x), ())}:
            best = None
            for k in named[e][1]:
                seen = [x for x in rows[k] if x["seen_at"] < end]
                if seen:
                    x = max(seen, key=lambda y: y["seen_at"])
                    v = day(x["valid_from"])
                    if v and v <= d:
                        best = max(best or (v, x["name"]), (v, x["name"]))
            if best:
                out.add((i, named[e][0], best[1]))
    return out
