"""History of changing entity attributes, by Merkle comparison of the snapshots of a change log.

The log is cut into periods. A snapshot is every key's history up to a cut; keys fall into buckets by hash, the leaves of a
tree of fixed fan-out whose depth grows with the keys. A node's hash combines those of the histories below it without
regard to order, so a cut's hash is the one of the cut before, changed by what its period brought: hashes are kept for
the nodes a period touched, never for every key at every cut. Neighbouring snapshots are compared from the root down;
only the children of branches that differ are looked at, and only the log rows of leaves that differ are read for the
row diff, whose changes are appended as new versions. Rows that repeat the state before change no hash and are never read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.state import latest
from marginalia.session import materialize, release

#: Children of a tree node, keys of a leaf on average, and days between two cuts.
FANOUT, LEAF, DAYS = 16, 16, 7


def tree_depth(keys: int) -> int:
    """Levels below the root, so that a leaf has about :data:`LEAF` keys."""
    return max(1, math.ceil(math.log(max(keys, 1) / LEAF, FANOUT))) if keys > LEAF else 1


def _marked(log: DataFrame, keys: Sequence[str], columns: Sequence[str], seen: str, days: int, depth: int) -> DataFrame:
    """The rows with a time, with their cut, leaf and the hash of their attributes. Hashes skip nulls, so where these stand is
    hashed too."""
    nulls = F.array(*[F.col(c).isNull() for c in columns])
    return log.where(F.col(seen).isNotNull()).select(
        *keys, *columns, seen,
        F.floor(F.datediff(F.to_date(seen), F.lit("1970-01-01").cast("date")) / days).cast("int").alias("__cut"),
        F.pmod(F.xxhash64(*keys), F.lit(FANOUT**depth)).alias("__leaf"),
        F.xxhash64(*columns, nulls).alias("__h"),
    )


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def period_states(marked: DataFrame, keys: Sequence[str], seen: str) -> DataFrame:
    """``keys, __cut, __leaf, __opening, d0, d1``: per key and period with a row, the state's hash before the period (null
    if there is none) and two hashes of what the period brought, 0 where that is nothing. One combined aggregation; the
    window sees one row per key and period."""
    order = F.struct(F.col(seen), F.col("__h"))
    per = marked.groupBy(*keys, "__cut").agg(F.first("__leaf").alias("__leaf"), F.min("__h").alias("lo"), F.max("__h").alias("hi"), F.max_by("__h", order).alias("last"))
    per = per.withColumn("__opening", F.lag("last").over(Window.partitionBy(*keys).orderBy("__cut")))
    still = (F.col("lo") == F.col("__opening")) & (F.col("hi") == F.col("__opening"))
    brought = [F.xxhash64(F.lit(i), *keys, "__cut", "lo", "hi", "last") for i in range(2)]
    return per.select(*keys, "__cut", "__leaf", "__opening", *[F.when(F.coalesce(still, F.lit(False)), F.lit(0).cast("long")).otherwise(x).alias(f"d{i}") for i, x in enumerate(brought)])


def merkle_levels(periods: DataFrame, depth: int) -> list[DataFrame]:
    """Levels ``__cut, node, h0, h1``, root first: a node's hashes at each cut that touched it. Every level is made from the
    one below; the window sees a node's cuts."""
    change = periods.select("__cut", F.col("__leaf").alias("node"), "d0", "d1")
    levels = []
    for level in range(depth, -1, -1):
        change = change.groupBy("__cut", "node").agg(*[F.bit_xor(d).alias(d) for d in ("d0", "d1")])
        run = Window.partitionBy("node").orderBy("__cut").rowsBetween(Window.unboundedPreceding, 0)
        levels.insert(0, change.select("__cut", "node", *[F.bit_xor(f"d{i}").over(run).alias(f"h{i}") for i in range(2)]))
        if level:
            change = change.withColumn("node", F.floor(F.col("node") / FANOUT).cast("long"))
    return levels


def changed_leaves(levels: Sequence[DataFrame]) -> DataFrame:
    """``__cut, __leaf`` of the leaves that differ from the cut before, found by descending differing branches only."""
    branch = None
    for level in levels:
        before = Window.partitionBy("node").orderBy("__cut")
        old = [F.coalesce(F.lag(h).over(before), F.lit(0).cast("long")).alias(f"was_{h}") for h in ("h0", "h1")]
        differ = level.select("__cut", "node", "h0", "h1", *old).where("h0 <> was_h0 or h1 <> was_h1").select("__cut", "node")
        if branch is not None:
            up = F.floor(F.col("node") / FANOUT).cast("long").alias("up")
            differ = differ.select("__cut", "node", up).join(branch, ["__cut", "up"], "left_semi").select("__cut", "node")
        branch = differ.select("__cut", F.col("node").alias("up"))
    return differ.withColumnRenamed("node", "__leaf")


def merkle_changes(log: DataFrame, keys: Sequence[str], columns: Sequence[str], seen: str, days: int = DAYS) -> DataFrame:
    """Every version of every key, however short: ``keys, columns, seen, until, open``.

    A version starts at the ``seen`` of the first row that differs from the key's row before and ends at that of the next
    one that does (``until`` null and ``open`` true for the last). Rows that repeat the state before start none. Of rows of
    one key and time the one that :func:`latest` takes counts; rows with a null time are left out; nulls in attributes
    are values; an empty log gives no rows.

    No window sees more than one key's rows between two cuts, or its cuts.
    """
    depth = tree_depth(log.agg(F.approx_count_distinct(F.xxhash64(*keys))).first()[0])
    marked = _marked(log, keys, columns, seen, days, depth)
    periods = materialize(period_states(marked, keys, seen), "periods")
    changed = materialize(changed_leaves(merkle_levels(periods, depth)), "changed")
    read = marked.join(changed, ["__cut", "__leaf"], "left_semi")
    events = latest(read.withColumn("__at", F.col(seen)), [*keys, "__cut", "__at"], seen, [*columns, "__h"]).drop("__at")
    opened = events.alias("e").join(periods.alias("p"), _same("e", "p", [*keys, "__cut"])).select(*[F.col(f"e.{c}").alias(c) for c in events.columns], F.col("p.__opening").alias("__opening"))
    w = Window.partitionBy(*keys, "__cut").orderBy(seen)
    stepped = opened.withColumn("__old", F.coalesce(F.lag("__h").over(w), F.col("__opening")))
    new = stepped.where(~F.col("__old").eqNullSafe(F.col("__h"))).drop("__old", "__opening")
    changes = materialize(new.withColumn("__next", F.lead(seen).over(w)), "changes")
    release(changed)
    release(periods)
    first = changes.groupBy(*keys, "__cut").agg(F.min(seen).alias("__first"))
    later = first.withColumn("__later", F.lead("__first").over(Window.partitionBy(*keys).orderBy("__cut")))
    until = F.coalesce(F.col("c.__next"), F.col("l.__later"))
    return changes.alias("c").join(later.alias("l"), _same("c", "l", [*keys, "__cut"])).select(
        *[F.col(f"c.{c}").alias(c) for c in [*keys, *columns, seen]],
        until.alias("until"),
        until.isNull().alias("open"),
    )
