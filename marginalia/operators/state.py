"""State of a change log: the latest row of each key, without a per-key sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: Sequence[str], seen: str, columns: Sequence[str]) -> DataFrame:
    """The row of greatest ``seen`` per key, as one map-side combined aggregation (a hot key costs no sort).

    Exact repeats of a row count once. Rows of equal ``seen`` that differ are ordered by a hash of their columns, so
    the choice does not depend on the order of arrival. Rows with a null ``seen`` come before all others. Column names
    that clash with the helper's are safe: everything travels in one struct.
    """
    payload = F.struct(*[F.col(c) for c in columns])
    order = F.struct(F.col(seen), _row_hash(log, columns))
    best = F.max_by(payload, order)
    out = log.groupBy(*keys).agg(best.alias("__row"), F.max(seen).alias("__seen"))
    return out.select(*keys, *[F.col("__row")[c].alias(c) for c in columns], F.col("__seen").alias(seen))


def _row_hash(df: DataFrame, columns: Sequence[str]) -> Column:
    kinds = dict(df.dtypes)
    parts = [F.to_json(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c) for c in columns]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")
