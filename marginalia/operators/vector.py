"""Dense retrieval (F2, F3, G7, E4) over an exact scan, filtered before it ranks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.operators.graph import cosine


def dense_top(chunks: DataFrame, query: Sequence[float], m: int = 24, lane: str | None = None) -> DataFrame:
    """The ``m`` chunks nearest to one query vector, with ``sim``; ties by id.

    ``chunks(id, ..., lane, embedding)``. With ``lane`` only that lane's and neutral chunks are scored, so the result is
    exact for the lane. Vectors of another length than the query's, nulls among them, are skipped.
    """
    rows = chunks if lane is None else chunks.where(F.col("lane").isin(lane, "neutral"))
    q = F.array(*[F.lit(float(x)) for x in query])
    usable = rows.where(F.size("embedding") == len(query)).where(~F.exists("embedding", lambda x: x.isNull() | F.isnan(x)))
    scored = usable.withColumn("sim", cosine(F.col("embedding"), q)).drop("embedding")
    return scored.orderBy(F.desc("sim"), "id").limit(m)


#: Vectors, and queries, that one task multiplies.
CHUNK_BLOCK, QUERY_BLOCK = 50_000, 10_000


def dense_batch(chunks: DataFrame, queries: DataFrame, m: int = 24) -> DataFrame:
    """``query, id, sim, rank``: the ``m`` nearest of ``chunks(id, embedding)`` for each of ``queries(query, vector)``, exactly; ties
    by id. Vectors with a null or NaN are skipped; only those of a query's length are compared, norms of 0 give 0.

    A block of chunks meets a block of queries in one task, as a matrix product; a task returns ``m`` rows per query, so
    the last ranking sees ``m`` rows per block. The queries are repeated per block of chunks.
    """
    def usable(v: str) -> Column:
        return (F.size(v) > 0) & ~F.exists(F.coalesce(v, F.array().cast("array<double>")), lambda x: x.isNull() | F.isnan(x))

    x = chunks.select("id", F.col("embedding").cast("array<double>").alias("v")).where(usable("v"))
    q = queries.select("query", F.col("vector").cast("array<double>").alias("v")).where(usable("v"))
    n_x, n_q = (max(1, -(-t.count() // size)) for t, size in ((x, CHUNK_BLOCK), (q, QUERY_BLOCK)))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = x.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(n_x)).cast("int").alias("xb"), every(n_q).alias("qb"))
    right = q.select("query", "v", F.pmod(F.xxhash64("query"), F.lit(n_q)).cast("int").alias("qb"), every(n_x).alias("xb"))

    def multiply(xs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dims, group in xs.groupby(xs["v"].map(len)):
            asked = qs[qs["v"].map(len) == dims]
            if len(asked):
                a, b = (_unit(np.stack(t["v"].to_numpy())) for t in (group, asked))
                ids, names = group["id"].to_numpy(), asked["query"].to_numpy()
                for lo in range(0, len(b), 256):
                    sims = np.round(b[lo : lo + 256] @ a.T, 12)
                    # all that tie with the m-th stay, so that ids decide
                    edge = np.partition(sims, -m, axis=1)[:, -m] if sims.shape[1] > m else np.full(len(sims), -np.inf)
                    row, col = np.nonzero(sims >= edge[:, None])
                    out.append(pd.DataFrame({"query": names[lo + row], "id": ids[col], "sim": sims[row, col]}))
        found = pd.concat(out) if out else pd.DataFrame({"query": [], "id": [], "sim": []})
        found = found.sort_values(["query", "sim", "id"], ascending=[True, False, True])
        return found.groupby("query").head(m)

    kinds = dict(left.dtypes) | dict(right.dtypes)
    pairs = left.groupBy("xb", "qb").cogroup(right.groupBy("xb", "qb")).applyInPandas(multiply, f"query {kinds['query']}, id {kinds['id']}, sim double")
    order = Window.partitionBy("query").orderBy(F.desc("sim"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= m)


def _unit(v: np.ndarray) -> np.ndarray:
    norms = np.sqrt((v * v).sum(1, keepdims=True))
    return np.where(norms > 0, v / np.where(norms > 0, norms, 1), 0.0)


def best_per_note(hits: DataFrame) -> DataFrame:
    """``note_name, dense_sim, best_section``: the best chunk of each note; ties by the smaller id."""
    order = F.struct("sim", -F.col("id"))
    return hits.groupBy("note_name").agg(F.max("sim").alias("dense_sim"), F.max_by("section", order).alias("best_section"))


def seed_weights(best: DataFrame, top: int = 8) -> DataFrame:
    """``name, weight``: the ``top`` notes by similarity, weighted by its square, if it is positive."""
    return best.orderBy(F.desc("dense_sim"), "note_name").limit(top).where("dense_sim > 0").select(F.col("note_name").alias("name"), (F.col("dense_sim") * F.col("dense_sim")).alias("weight"))
