"""Wikilink expressions (B2, B4): ``[[target#anchor|alias]]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: the wikilink grammar.
WIKILINK = r"\[\[([^\]|#]+?)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"


def wikilinks(text: Column) -> Column:
    """Every link target of a text in order, trimmed, duplicates kept; null text gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WIKILINK), F.lit(1))
    return F.transform(found, lambda x: F.trim(x))


def link_target(value: Column) -> Column:
    """The target named by one frontmatter value: a bracketed link's target, else the trimmed value; blank is null."""
    inner = F.trim(F.regexp_extract(value, WIKILINK, 1))
    plain = F.regexp_replace(value, r"^\s+|\s+$", "")
    return F.nullif(F.when(inner != "", inner).otherwise(plain), F.lit(""))


def target_set(values: Column) -> Column:
    """Distinct targets of an array of references; null and blank entries name nothing."""
    named = F.transform(F.coalesce(values, F.array().cast("array<string>")), link_target)
    return F.array_distinct(F.filter(named, lambda x: x.isNotNull()))


def content_targets(text: Column) -> Column:
    """Distinct non-blank link targets of a body."""
    return F.array_distinct(F.filter(wikilinks(text), lambda x: x != ""))
