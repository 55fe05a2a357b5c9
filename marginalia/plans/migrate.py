"""Migration of foreign vaults by ordered rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.dates import migration_day
from marginalia.functions.text import glob_regex, is_stub, slug


@dataclass(frozen=True)
class Rule:
    """Files that match ``pattern`` go to ``folder`` (None: dropped) as ``kind`` (None: their own), named by ``naming``:
    preserve_name, date_prefixed, entity_prefix, preserve_subpath or ``rename:<template with {stem}>``."""

    name: str
    pattern: str
    folder: str | None
    kind: str | None
    naming: str


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def new_name(rule: Rule, path: Column, day: Column) -> Column:
    """The file name a rule gives."""
    inner = F.filter(F.transform(F.slice(F.split(path, "/"), 2, 1 << 20), lambda p: slug(p)), lambda p: p != "")
    if rule.naming == "preserve_name":
        return F.concat(slug(_stem(path)), F.lit(".md"))
    if rule.naming == "date_prefixed":
        return F.concat(day, F.lit("-"), slug(_stem(path)), F.lit(".md"))
    if rule.naming == "entity_prefix":
        return F.concat(F.lit("entity-"), F.when(F.size(inner) > 0, F.array_join(inner, "-")).otherwise(slug(_stem(path))), F.lit(".md"))
    if rule.naming == "preserve_subpath":
        return F.concat(F.when(F.size(inner) > 0, F.array_join(inner, "/")).otherwise(slug(_stem(path))), F.lit(".md"))
    if rule.naming.startswith("rename:"):
        before, _, after = rule.naming[7:].partition("{stem}")
        return F.concat(F.lit(before), _stem(path), F.lit(after)) if "{stem}" in rule.naming else F.lit(before)
    raise ValueError(f"unknown naming {rule.naming!r}")


def plan(files: DataFrame, rules: Sequence[Rule], today: Column, label: str = "vault") -> DataFrame:
    """``rel_path, rule, action, target, kind, valid_from, origin``: what becomes of each file; the first rule that matches
    decides. Actions: skip (backslash names), unmatched, stub, drop, write. ``files`` has ``rel_path, metadata, content``."""
    path = F.col("rel_path")
    m = F.col("metadata")
    which = F.coalesce(*[F.when(path.rlike(glob_regex(r.pattern)), F.lit(i)) for i, r in enumerate(rules)], F.lit(-1))
    day = migration_day(m["date"], m["created"], m["valid_from"], F.substring_index(path, "/", -1), F.date_format(today, "yyyy-MM-dd"))

    def by_rule(f) -> Column:
        out = F.lit(None).cast("string")
        for i, r in enumerate(rules):
            out = F.when(F.col("which") == i, f(r)).otherwise(out)
        return out

    rows = files.withColumn("which", which).withColumn("valid_from", day)
    dropped = F.col("which").isin([i for i, r in enumerate(rules) if r.folder is None] or [-2])
    action = (
        F.when(F.substring_index(path, "/", -1).contains("\\"), "skip").when(F.col("which") < 0, "unmatched")
        .when(is_stub(m["type"], m["source"], F.col("content")), "stub").when(dropped, "drop").otherwise("write")
    )
    target = by_rule(lambda r: F.concat(F.lit(f"{r.folder}/" if r.folder else ""), new_name(r, path, F.col("valid_from"))) if r.folder is not None else F.lit(None).cast("string"))
    kind = F.coalesce(by_rule(lambda r: F.lit(r.kind)), m["type"], F.lit("wiki"))
    return rows.select("rel_path", by_rule(lambda r: F.lit(r.name)).alias("rule"), action.alias("action"), F.when(action == "write", target).alias("target"), kind.alias("kind"), "valid_from", F.concat(F.lit(label + ":"), path).alias("origin"))


def counts(planned: DataFrame, samples: int = 10) -> DataFrame:
    """``rule, action, n, samples`` with the first paths of each."""
    from pyspark.sql import Window

    order = Window.partitionBy("rule", "action").orderBy("rel_path")
    top = planned.withColumn("r", F.row_number().over(order)).where(F.col("r") <= samples)
    n = planned.groupBy("rule", "action").agg(F.count("*").alias("n"))
    listed = top.groupBy("rule", "action").agg(F.array_join(F.sort_array(F.collect_list("rel_path")), ",").alias("samples"))
    return n.alias("a").join(listed.alias("b"), F.col("a.rule").eqNullSafe(F.col("b.rule")) & (F.col("a.action") == F.col("b.action"))).select("a.rule", "a.action", "n", "samples")


def write(files: DataFrame, planned: DataFrame, root: str) -> dict[str, int]:
    """The planned files as notes under a new folder; ``rule: number`` of what was written.

    Frontmatter is rewritten: name, type, the day, an open end, ``current``, where it came from, and tags and source if there
    were any; bodies stay as they are. A folder that exists and is not empty is refused, and so are two files for one target,
    before anything is written. Files pass through the driver one at a time.
    """
    import yaml

    from marginalia.sources.verbs import Vault

    folder = Path(root)
    if folder.exists() and any(folder.iterdir()):
        raise FileExistsError(f"{root} is not empty")
    chosen = planned.where("action = 'write'")
    clash = chosen.groupBy("target").agg(F.count("*").alias("n"), F.min("rel_path").alias("one"), F.max("rel_path").alias("other")).where("n > 1").orderBy("target").limit(20).collect()
    if clash:
        raise ValueError("one target for several files: " + "; ".join(f"{r['target']} from {r['one']}, {r['other']}" for r in clash))
    folder.mkdir(parents=True, exist_ok=True)
    vault, written = Vault(root), {}
    for r in chosen.join(files.select("rel_path", "metadata", "content"), "rel_path").toLocalIterator(prefetchPartitions=True):
        meta = r["metadata"] or {}
        front = {"name": Path(r["target"]).stem, "type": r["kind"], "valid_from": r["valid_from"], "valid_until": None, "status": "current", "origin_path": r["origin"]}
        front |= {k: meta[old] for k, old in (("tags", "tags"), ("origin_source", "source")) if meta.get(old)}
        vault.write_text(r["target"], f"---\n{yaml.safe_dump(front, sort_keys=False, allow_unicode=True)}---\n{r['content'] or ''}\n")
        written[r["rule"]] = written.get(r["rule"], 0) + 1
    return written


def report(planned: DataFrame) -> str:
    """L2.19: counts per rule and action, with the first paths of each."""
    rows = counts(planned).orderBy("action", "rule").collect()  # a row per rule and action
    return "\n".join(f"{r['action']:9} {r['rule'] or '(no rule)'}: {r['n']}" + "".join(f"\n    {x}" for x in (r["samples"] or "").split(",") if r["action"] in ("unmatched", "skip")) for r in rows)
