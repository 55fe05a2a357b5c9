"""Term index (E1-E3, F1): weights ``(1 + ln tf) * (ln((N + 1) / (df + 1)) + 1)``, unit length per document."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import tokens


def term_counts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf``; the tokens never leave the scan's stage uncounted."""
    return docs.select(F.col(key).alias("key"), F.explode(tokens(F.col(text))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def idf(counts: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf``; documents without a term count in ``n_docs``."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    return df.withColumn("idf", F.log((F.lit(n_docs) + 1.0) / (F.col("df") + 1.0)) + 1.0)


#: Weights of the index, and of the queries, that one task holds.
INDEX_BLOCK, QUERY_BLOCK = 1_000_000, 500_000


def weights(counts: DataFrame, terms: DataFrame) -> DataFrame:
    """``key, term, w`` of unit length; terms the index does not know are dropped. ``counts`` is read twice: pass a table that
    is kept."""
    raw = counts.join(terms.select("term", "idf"), "term").withColumn("w", (1.0 + F.log("tf")) * F.col("idf"))
    norms = raw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norms, "key").select("key", "term", (F.col("w") / F.col("norm")).alias("w"))


def most_similar(index: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query, key, score, rank``: up to ``k`` documents of positive score per query, itself excluded; ties by key.

    ``index`` and ``queries`` are weight tables over the same terms, both read twice. A block of documents meets a block of queries
    in one task, over the documents of each term; a task gives ``k`` rows per query, so no pair of a query and a document is
    ever a row, and a term that most documents hold is spread over their blocks. Terms travel as 64-bit hashes. The queries
    are repeated per block of documents.
    """
    n_x, n_q = (max(1, -(-t.count() // size)) for t, size in ((index, INDEX_BLOCK), (queries, QUERY_BLOCK)))

    def table(t: DataFrame, own: str, other: str, n_own: int, n_other: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("key"), F.lit(n_own)).cast("int").alias(own)
        # new names, since both tables may come from one
        return t.select(F.col("key").alias("key"), F.xxhash64("term").alias("t"), F.col("w").alias("w"), mine, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other))

    kind = dict(index.dtypes)["key"]
    left, right = table(index, "xb", "qb", n_x, n_q), table(queries.withColumn("key", F.col("key").cast(kind)), "qb", "xb", n_q, n_x)
    pairs = left.groupBy("xb", "qb").cogroup(right.groupBy("xb", "qb")).applyInPandas(lambda x, q: _scored(x, q, k), f"query {kind}, key {kind}, score double")
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "key")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scored(x: pd.DataFrame, q: pd.DataFrame, k: int) -> pd.DataFrame:
    """The ``k`` best documents of ``x(key, t, w)`` for each query of ``q(key, t, w)``."""
    asked = np.unique(q["t"].to_numpy())
    x = x[np.isin(x["t"].to_numpy(), asked)]
    if not len(x):
        return pd.DataFrame({"query": q["key"].iloc[:0], "key": q["key"].iloc[:0], "score": np.zeros(0)})
    keys, doc = np.unique(x["key"].to_numpy(), return_inverse=True)  # in order, so that ties go by number
    by_term = np.argsort(x["t"].to_numpy(), kind="stable")
    t, doc, w = x["t"].to_numpy()[by_term], doc[by_term], x["w"].to_numpy()[by_term]
    q = q.sort_values(["key", "t"], kind="stable")
    lo, hi = np.searchsorted(t, q["t"], "left"), np.searchsorted(t, q["t"], "right")
    names, weight = q["key"].to_numpy(), q["w"].to_numpy()
    starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    found = []
    for a, b in zip(starts, np.r_[starts[1:], len(q)], strict=True):
        score = np.zeros(len(keys))
        for i in range(a, b):
            score[doc[lo[i] : hi[i]]] += weight[i] * w[lo[i] : hi[i]]  # a document holds a term once
        own = np.searchsorted(keys, names[a])
        if own < len(keys) and keys[own] == names[a]:
            score[own] = 0
        ranked = np.round(score, 9)
        edge = np.partition(ranked, -k)[-k] if len(keys) > k else -1.0
        best = np.flatnonzero((ranked >= edge) & (score > 0))
        best = best[np.argsort(-ranked[best], kind="stable")][:k]
        found.append((np.repeat(names[a : a + 1], len(best)), keys[best], score[best]))
    query, key, score = (np.concatenate(c) for c in zip(*found, strict=True))
    return pd.DataFrame({"query": query, "key": key, "score": score})
