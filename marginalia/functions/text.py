"""String, hash and frontmatter expressions (B1, B9-B13, B16-B18, B20-B29). All of them stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern and stop words of the term index.
TOKEN = r"[A-Za-z][A-Za-z0-9'_-]+"
STOP_WORDS = (
    "the a an and or to of in on at is are was were be been being have has had do does did for with as by this that "
    "these those it its from but not no yes if so we you he she they them his her their our us i my"
).split()
# Words that name no entity.
NAME_STOP_WORDS = "the and for you are with from this that have has was were but not all any out office project coverage".split()
# Frontmatter keys that may differ without contradiction.
VOLATILE_KEYS = "date created updated modified version valid_from valid_until superseded_by supersedes type tags aliases".split()
# Role words and frontmatter tags that may not open a line of reference material, and the mark put before them.
ROLE_WORDS = "system assistant user developer tool".split()
TAG_WORDS = "role reports_to model status parent_project red_line red_lines guardrail guardrails charter identity known_issues".split()
MARK = "⟦neutralized⟧"
# Keywords of the reflection buckets, in order; the first bucket with a keyword in the text takes it.
BUCKETS = {
    "communication": ["communication", "phrasing", "reply", "tone"],
    "working preferences": ["prefer", "preference", "wants", "likes", "expects"],
    "failure modes": ["fail", "bug", "broken", "stale", "error"],
}


def digest(text: Column, length: int = 16) -> Column:
    """The first hex digits of a text's SHA-256; null for null."""
    return F.substring(F.sha2(text, 256), 1, length)


def tokens(text: Column) -> Column:
    """Index terms of a text, in order, repeats kept; null text has none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({TOKEN})"), F.lit(1))
    lowered = F.transform(found, lambda t: F.lower(t))
    return F.filter(lowered, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def entity_keys(name: Column) -> Column:
    """What a query may call a note: its name without ``entity-``, and that name's parts of three letters or more
    that are no stop words. Sessions and signals have no keys."""
    base = F.regexp_replace(F.lower(name), "^entity-", "")
    parts = F.filter(F.split(base, r"[-_\s/]+"), lambda t: (F.length(t) >= 3) & ~t.isin(NAME_STOP_WORDS))
    keys = F.array_distinct(F.concat(F.array(base), parts))
    return F.when(F.lower(name).rlike("^(session-|signals-)"), F.array().cast("array<string>")).otherwise(keys)


def excerpt(text: Column, length: int) -> Column:
    """One line of at most ``length`` characters, with an ellipsis where something is cut."""
    flat = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "\n", " ")
    short = F.concat(F.regexp_replace(F.substring(flat, 1, length - 1), r"\s+$", ""), F.lit("…"))
    return F.when(F.length(flat) <= length, flat).otherwise(short)


def normal_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(key)), "[- ]", "_")


def comparable(metadata: Column) -> Column:
    """Frontmatter for comparison: normalised keys and values, without volatile keys and nulls. Of keys that become
    equal the greatest value stays. A list in text form (JSON) compares without regard to order."""
    pairs = F.transform(F.map_entries(metadata), lambda e: F.struct(normal_key(e["key"]).alias("k"), _normal_value(e["value"]).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda e: e["v"].isNotNull() & ~e["k"].isin(VOLATILE_KEYS)))
    keys = F.array_distinct(F.transform(kept, lambda e: e["k"]))
    values = F.transform(keys, lambda k: F.array_max(F.transform(F.filter(kept, lambda e: e["k"] == k), lambda e: e["v"])))
    return F.map_from_arrays(keys, values)


def _normal_value(value: Column) -> Column:
    plain = F.lower(F.trim(value))
    items = F.from_json(plain, "array<string>")
    listed = F.array_join(F.array_sort(F.transform(items, lambda x: F.trim(x))), ",")
    return F.when(plain.rlike(r"^\[.*\]$") & items.isNotNull(), listed).otherwise(plain)


def same_root(a: Column, b: Column) -> Column:
    """Names that are equal, or one the start of the other, once a version suffix ``-v1...`` is taken off."""
    x, y = (F.regexp_replace(c, r"-v\d.*$", "") for c in (a, b))
    return (x == y) | x.startswith(y) | y.startswith(x)


def neutralize(text: Column) -> Column:
    """B20, on text already folded by :func:`marginalia.functions.fold.fold`: role words and frontmatter tags before a
    colon, anywhere but inside a longer word, are marked and lose their colon."""
    one_line = F.regexp_replace(F.regexp_replace(text, "[\r\n]+", " "), r"\s+$", "")
    for words in (ROLE_WORDS, TAG_WORDS):
        one_line = F.regexp_replace(one_line, rf"(?i)(?<![\w-])({'|'.join(words)})[\s*_`~]*:", MARK + " $1 ")
    return one_line


def bullet_lines(text: Column, prefix: str = "- ") -> Column:
    """The trimmed lines that open with a bullet."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.filter(lines, lambda x: x.startswith(prefix))


def sections(text: Column) -> Column:
    """Heading sections of a body as ``(title, body)``; what stands before the first heading has the title ''."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), r"\n(?=#{1,6}[ \t])")
    return F.transform(parts, lambda p: F.struct(
        F.regexp_extract(p, r"^#{1,6}[ \t]+([^\n]*)", 1).alias("title"),
        F.regexp_replace(p, r"^#{1,6}[ \t]+[^\n]*\n?", "").alias("body"),
    ))


def section_bullets(text: Column, titles: Sequence[str], item: str = r"^- ") -> Column:
    """List items under the sections whose title holds one of ``titles`` (lower case), markers taken off."""
    wanted = F.filter(sections(text), lambda s: F.lower(s["title"]).rlike("|".join(re.escape(t) for t in titles)))
    lines = F.flatten(F.transform(wanted, lambda s: F.split(s["body"], "\n")))
    items = F.filter(F.transform(lines, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.rlike(item))
    return F.transform(items, lambda x: F.trim(F.regexp_replace(x, item, "")))


def distilled(text: Column, titles: Sequence[str]) -> Column:
    """The first-level title and the sections whose title holds one of ``titles``, joined by blank lines."""
    title = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^# ([^\n]*)", 1)
    kept = F.filter(sections(text), lambda s: F.lower(s["title"]).rlike("|".join(re.escape(t) for t in titles)))
    parts = F.transform(kept, lambda s: F.concat(F.lit("## "), s["title"], F.lit("\n"), F.regexp_replace(s["body"], r"\s+$", "")))
    return F.array_join(F.concat(F.filter(F.array(title), lambda t: t != ""), parts), "\n\n")


def entity_name(word: Column) -> Column:
    """``quill`` as ``entity-Quill``; a name that has the prefix stays."""
    bare = F.trim(word)
    return F.when(bare.startswith("entity-"), bare).otherwise(F.concat(F.lit("entity-"), F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 20)))


def headline(text: Column) -> Column:
    """The first heading's text, else the first 80 characters of the trimmed body."""
    first = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?m)^#+[ \t]*([^\n]+)", 1)
    return F.when(first != "", F.trim(first)).otherwise(F.substring(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+", ""), 1, 80))


def bucket(text: Column) -> Column:
    """The reflection bucket of a signal."""
    low = F.lower(text)
    out = F.lit("other")
    for name, words in reversed(BUCKETS.items()):
        out = F.when(low.rlike("|".join(words)), F.lit(name)).otherwise(out)
    return out


def slug(name: Column) -> Column:
    """Lower-case file slug of a name."""
    s = F.regexp_replace(name, r"(?i)\.md$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^a-zA-Z0-9\s_-]", ""), r"[\s_]+", "-")
    s = F.regexp_replace(F.lower(F.regexp_replace(s, "^-+|-+$", "")), "-+", "-")
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def is_stub(kind: Column, source: Column, body: Column) -> Column:
    """Placeholder notes: by type, by source, or by the sentence generated ones open with (first 400 characters)."""
    head = F.substring(F.coalesce(body, F.lit("")), 1, 400)
    said = head.contains("auto-generated because") & head.contains("did not exist")
    return F.coalesce(kind == "stub", F.lit(False)) | F.coalesce(source == "auto-heal", F.lit(False)) | said


def glob_regex(pattern: str) -> str:
    """A glob as an anchored regular expression: ``**/`` any directories or none, ``*`` and ``?`` within one."""
    out, rest = [], pattern
    tokens_ = {"**/": "(?:[^/]+/)*", "*": "[^/]*", "?": "[^/]"}
    while rest:
        mark = next((t for t in tokens_ if rest.startswith(t)), None)
        out.append(tokens_[mark] if mark else re.escape(rest[0]))
        rest = rest[len(mark) if mark else 1 :]
    return "^" + "".join(out) + "$"


def has_term(text: Column, term: str) -> Column:
    """A vocabulary term as a whole word (edges: not a letter a-z or digit) of lower-cased text."""
    return text.rlike(rf"(?<![a-z0-9]){re.escape(term.lower())}(?![a-z0-9])")


def count_terms(text: Column, terms: Sequence[str]) -> Column:
    """Occurrences of the terms as whole words in lower-cased text, added up."""
    out = F.lit(0)
    for t in terms:
        out = out + F.regexp_count(text, F.lit(rf"(?<![a-z0-9]){re.escape(t.lower())}(?![a-z0-9])"))
    return out


def in_directory(rel_path: Column, name: str) -> Column:
    """A path has a directory of that name anywhere."""
    return F.concat(F.lit("/"), rel_path).contains(f"/{name}/")


def with_section(text: Column, heading: str, block: Column) -> Column:
    """The body with its first section ``heading`` replaced by ``block`` (taken literally), or with it appended."""
    pattern = rf"(?s)\n?{re.escape(heading)}[ \t]*\n.*?(?=\n## |\z)"
    body = F.coalesce(text, F.lit(""))
    start = F.regexp_instr(body, F.lit(pattern))
    found = F.regexp_substr(body, F.lit(pattern))
    lead = F.when(found.startswith("\n"), F.lit("\n")).otherwise(F.lit(""))
    before, after = F.substring(body, F.lit(1), start - 1), F.substring(body, start + F.length(found), F.length(body))
    new = F.concat(F.lit(heading + "\n"), block)
    return F.when(start > 0, F.concat(before, lead, new, after)).otherwise(F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit("\n\n"), new, F.lit("\n")))
