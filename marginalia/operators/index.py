"""Freshness of the derived index (D9, D10, E10, I14) and the state of interrupted batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import digest


def source_map(notes: DataFrame, quarantined: list[str] | None = None) -> DataFrame:
    """``rel_path, hash`` of every note that is not quarantined."""
    rows = notes.where(~F.col("rel_path").isin(quarantined)) if quarantined else notes
    return rows.select("rel_path", digest(F.coalesce("raw_text", F.lit(""))).alias("hash"))


def manifest_diff(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """``rel_path, change`` (added, changed or removed) between two source maps, compared null-safely."""
    both = recorded.withColumnRenamed("hash", "old").withColumn("was", F.lit(True)).join(live.withColumnRenamed("hash", "new").withColumn("is", F.lit(True)), "rel_path", "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select("rel_path", change.alias("change")).where("change is not null")


def index_work(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """``rel_path, drop, build``: whose chunks are dropped (changed or removed) and built (added or changed)."""
    d = manifest_diff(recorded, live)
    return d.select("rel_path", F.col("change").isin("changed", "removed").alias("drop"), F.col("change").isin("added", "changed").alias("build"))


def revision(sources: DataFrame, group: list[Column] | None = None, length: int = 12) -> DataFrame:
    """The first hex digits of a hash of all paths with their hashes, per group; the order of rows does not matter.

    Two levels: the pairs ``rel NUL hash NUL`` of a bucket (the first three hex digits of the path's SHA-256) are hashed in
    order of path, then the at most 4,096 buckets' digests in order of bucket. No task gathers more than a bucket.
    """
    names = [f"g{i}" for i in range(len(group or []))]
    line = F.concat("rel_path", F.lit("\0"), "hash", F.lit("\0"))
    rows = sources.select(*[c.alias(n) for c, n in zip(group or [], names, strict=True)], F.substring(F.sha2("rel_path", 256), 1, 3).alias("b"), F.struct("rel_path", line.alias("line")).alias("l"))

    def digest_of(rows: Column, part: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(rows)), lambda x: x[part]), ""), 256)

    buckets = rows.groupBy(*names, "b").agg(digest_of(F.col("l"), "line").alias("h"))
    out = buckets.groupBy(*names).agg(F.substring(digest_of(F.struct("b", "h"), "h"), 1, length).alias("rev"))
    titles = sources.select(*(group or [])).columns
    return out.select(*[F.col(n).alias(t) for n, t in zip(names, titles, strict=True)], "rev")


def intent_states(intents: DataFrame, live: DataFrame) -> DataFrame:
    """``intent_id, rel_path, state`` of each target of a batch; see :func:`target_states`."""
    return target_states(intents.select("intent_id", F.explode("targets").alias("t")).select("intent_id", "t.*"), live)


def target_states(targets: DataFrame, live: DataFrame) -> DataFrame:
    """``intent_id, rel_path, state`` of ``targets(intent_id, rel_path, pre_hash, post_hash)``: ``missing`` (no such file now),
    ``patched`` (has the hash after), ``unpatched`` (has the hash before) or ``diverged``. A target whose hashes are equal is
    patched."""
    joined = targets.join(live.withColumnRenamed("hash", "now"), "rel_path", "left")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("post_hash"), "patched").when(F.col("now") == F.col("pre_hash"), "unpatched").otherwise("diverged")
    return joined.select("intent_id", "rel_path", state.alias("state"))


def stale_intents(intents: DataFrame, live: DataFrame, now: Column, seconds: int = 300) -> DataFrame:
    """Pending batches of at least that age, or with an unreadable time, with how far they came: ``intent_id,
    n_targets, n_patched, all_patched`` (a batch without targets is not all patched)."""
    at = F.col("created_at").try_cast("timestamp")
    old = intents.where((F.col("status") == "pending") & (at.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(at) >= seconds)))
    states = intent_states(old, live).groupBy("intent_id").agg(F.count("*").alias("n_targets"), F.count_if(F.col("state") == "patched").alias("n_patched"))
    out = old.select("intent_id").join(states, "intent_id", "left").fillna(0, ["n_targets", "n_patched"])
    return out.withColumn("all_patched", (F.col("n_targets") > 0) & (F.col("n_targets") == F.col("n_patched")))
