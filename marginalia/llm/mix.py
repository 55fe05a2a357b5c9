"""Mixing sources to target shares by systematic sampling."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import materialize

#: Documents of one source and size that one window orders, on average, and the most rows that are broadcast.
BLOCK, SMALL = 20_000, 100_000


def source_key(source: Column) -> Column:
    """One spelling per source: lower case, trimmed, ``_`` as ``-``; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_replace(source, r"^\s+|\s+$", "")), "_", "-"), F.lit(""))


def mix_plan(sized: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """One row per target source: ``source, target_share, max_repeats, docs, tokens, expected`` (copies per document).

    Without ``total`` the mix is as large as it can be with every source that has tokens in its exact proportion to the
    others; a source without any cannot be met and is left at 0. With ``total`` tokens, a source too small for its share
    is repeated ``max_repeats`` times and falls short. Repeated target rows of a source: the first by (share, repeats).
    """
    t = targets.where("target_share > 0 and max_repeats > 0").groupBy(source_key(F.col("source")).alias("source"))
    t = t.agg(F.min(F.struct("target_share", "max_repeats")).alias("t")).select("source", "t.*")
    have = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    plan = t.join(have, "source", "left").fillna(0, ["docs", "tokens"])
    reach = F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))
    size = F.lit(total) if total is not None else F.lit(plan.agg(F.min(reach)).scalar())
    wanted = F.when(F.col("tokens") > 0, F.least(F.col("target_share") * size / F.col("tokens"), F.col("max_repeats").cast("double")))
    return plan.withColumn("expected", F.coalesce(wanted, F.lit(0.0)))


def size_copies(sized: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``source, tokens, n, copies``: of each size in tokens, how many documents a source has and how many copies it emits.

    Documents of a source stand in order of size; expected copies are summed along it, one random offset per source is
    added, and a copy is emitted per whole number crossed. What the tokens drawn then lack or have too much is made up from
    the largest size that fits down, so a source misses its tokens by less than its smallest documents allow. Rows are
    sizes, not documents: a source has no more of them than its largest document has tokens.
    """
    kinds = sized.join(plan.select("source"), "source", "left_semi").groupBy("source", "tokens").agg(F.count("*").alias("n"))
    through = F.sum("n").over(Window.partitionBy("source").orderBy("tokens"))
    u = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    placed = kinds.withColumn("through", through).join(plan.select("source", "expected", "max_repeats"), "source")
    crossed = F.floor(F.col("expected") * F.col("through") + u) - F.floor(F.col("expected") * (F.col("through") - F.col("n")) + u)
    drawn = placed.withColumn("copies", F.least(crossed, F.col("n") * F.col("max_repeats")))
    return drawn.groupBy("source").applyInPandas(_made_up, "source string, tokens long, n long, copies long")


def _made_up(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("tokens", ascending=False, ignore_index=True)
    size, n, copies = (rows[c].to_numpy(dtype="int64") for c in ("tokens", "n", "copies"))
    most = n * int(rows["max_repeats"].iloc[0]) if len(rows) else n
    lack = round(float(rows["expected"].iloc[0]) * int((size * n).sum())) - int((size * copies).sum())
    sign = 1 if lack > 0 else -1
    copies, spare, last = copies.copy(), (most - copies) if lack > 0 else copies.copy(), None
    for i in range(len(size)):
        if size[i] > 0 and spare[i] > 0:
            k = min(int(spare[i]), abs(lack) // int(size[i]))
            copies[i] += sign * k
            lack -= sign * k * int(size[i])
            last = i if spare[i] > k else last
    if last is not None and 2 * abs(lack) > size[last]:
        copies[last] += sign
    return pd.DataFrame({"source": rows["source"], "tokens": size, "n": n, "copies": copies})


def systematic_copies(sized: DataFrame, plan: DataFrame, seed: int = 7) -> DataFrame:
    """``doc_id, source, tokens, copies`` of every document that is emitted at least once.

    The copies of a size (:func:`size_copies`) go to its documents by the same rule: documents in order of a hash, expected
    copies summed along it, one copy per whole number crossed. A size that many documents share is ordered in blocks, whose
    running numbers come from the blocks' counts.
    """
    wanted = materialize(size_copies(sized, plan, seed).where("copies > 0"), "sizes")
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    block = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.ceil(F.col("n") / BLOCK))
    rows = sized.join(wanted, ["source", "tokens"]).withColumn("block", block)
    counts = rows.groupBy("source", "tokens", "block").agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy("source", "tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("source", "tokens", "block", F.coalesce(before, F.lit(0)).alias("before"))
    at = F.row_number().over(Window.partitionBy("source", "tokens", "block").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")) - 1
    placed = rows.withColumn("at", at).join(offsets, ["source", "tokens", "block"]).withColumn("i", F.col("before") + F.col("at"))
    crossed = F.expr("((i + 1) * copies) div n - (i * copies) div n")
    return placed.select("doc_id", "source", "tokens", crossed.alias("copies")).where("copies > 0")


def mix(docs: DataFrame, targets: DataFrame, total: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies per document, plan). ``docs(doc_id, source, tokens)``; documents of no target source are left out, documents
    without tokens are drawn like others and add nothing. A document id that repeats counts as often as it is given."""
    sized = materialize(docs.select("doc_id", source_key(F.col("source")).alias("source"), "tokens"), "sized")
    plan = materialize(mix_plan(sized, targets, total), "plan")
    return systematic_copies(sized, plan), plan


def mix_report(copies: DataFrame, plan: DataFrame) -> DataFrame:
    """Per target source: what it has, the copies drawn, the share of all drawn tokens it reached, the share it could aim at
    (its target among the sources that have tokens), and by what part it missed that (null where it aimed at none)."""
    drawn = copies.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("tokens")).alias("drawn_tokens"), F.max("copies").alias("most_repeats"))
    joined = materialize(plan.join(drawn, "source", "left").fillna(0, ["copies", "drawn_tokens", "most_repeats"]), "drawn")
    all_tokens = joined.agg(F.sum("drawn_tokens")).scalar()
    met = joined.agg(F.sum(F.when(F.col("tokens") > 0, F.col("target_share")))).scalar()
    share = F.when(F.lit(all_tokens) > 0, F.col("drawn_tokens") / all_tokens).otherwise(0.0)
    aim = F.when(F.col("tokens") > 0, F.col("target_share") / met).otherwise(0.0)
    return joined.select(
        "source", "target_share", "max_repeats", "docs", "tokens", "expected", "copies", "most_repeats", "drawn_tokens", share.alias("share"), aim.alias("aim"),
        F.when(aim > 0, share / aim - 1).alias("missed_by"),
    )
