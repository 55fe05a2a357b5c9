"""Items that appear together: exact pair counts against a bipartite configuration null.

Baskets are cut to their first ``top`` items where the log's statement says so, which bounds the pairs per basket; a hot item
costs no more than its own occurrences. Under the null, item i is in basket b with probability ``x_i y_b / (1 + x_i y_b)``, where the factors make
every item's frequency and every basket's size right on average. Items of equal frequency and baskets of equal size
share a factor, so the fit works on the histogram of frequencies. The number of common baskets of a pair is then
Poisson-binomial; its upper tail is the pair's p-value, and the Benjamini-Hochberg procedure over all possible pairs
gives its false-discovery rate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.links import link_target
from marginalia.session import materialize

#: Items of a basket that count, by default.
TOP = 5
#: Tail probability under the null above which a pair is not looked at as one that stands out.
SURPRISE = 0.05
#: Steps of -log10 p in which false-discovery rates are computed (rounded to the less surprising side).
GRID = 100


def plain_names(results: Column) -> Column:
    """The notes named by a JSON array of results, in order: brackets, a path and ``.md`` are taken off; null, blank and
    repeated names are dropped. Anything but a complete JSON array is null."""
    parsed = F.try_variant_get(F.try_parse_json(F.nullif(F.trim(results), F.lit(""))), "$", "array<string>")
    bare = F.transform(parsed, lambda x: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(link_target(x), r"^.*/", ""), r"\.md$", "")), F.lit("")))
    return F.array_distinct(F.filter(bare, lambda x: x.isNotNull()))


def baskets(log: DataFrame, key: str = "id", results: str = "results", order: str = "ts", top: int | None = TOP) -> DataFrame:
    """``key, items``: each key once (redeliveries: the earliest row, then the smaller items), its first ``top`` names, or all
    of them. Baskets without a name are left out. Whole baskets have as many pairs as half the square of their size."""
    names = plain_names(F.col(results))
    rows = log.select(key, F.col(order).alias("o"), (names if top is None else F.slice(names, 1, top)).alias("items"))
    once = rows.groupBy(key).agg(F.min(F.struct("o", "items")).alias("r"))
    return once.select(key, F.col("r.items").alias("items")).where(F.size("items") > 0)


def _pairs(items: Column) -> Column:
    def with_later(x: Column, i: Column) -> Column:
        return F.transform(F.slice(items, i + 2, F.size(items)), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))

    return F.flatten(F.transform(items, with_later))


def pair_counts(groups: DataFrame) -> DataFrame:
    """``a, b, count, n_a, n_b, n`` over all baskets, a < b; ``n`` is the number of baskets."""
    total = groups.agg(F.count("*").alias("n"))
    single = groups.select(F.explode("items").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    pairs = groups.select(F.explode(_pairs(F.col("items"))).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("count"))
    with_a = pairs.join(single.select(F.col("x").alias("a"), F.col("c").alias("n_a")), "a")
    return with_a.join(single.select(F.col("x").alias("b"), F.col("c").alias("n_b")), "b").select("a", "b", "count", "n_a", "n_b", F.lit(total.scalar()).alias("n"))


def fit_null(degrees: np.ndarray, items: np.ndarray, sizes: np.ndarray, n_baskets: np.ndarray, rounds: int = 5000, tol: float = 1e-9) -> np.ndarray:
    """Probabilities ``p[d, k]`` that an item of ``degrees[d]`` is in a basket of ``sizes[k]``.

    ``items[d]`` items have that degree and ``n_baskets[k]`` baskets that size. Fixed-point rounds until degrees and
    sizes are met to ``tol``, relatively, or the rounds are used up.
    """
    edges = float((degrees * items).sum())
    x, y = degrees / math.sqrt(edges), sizes / math.sqrt(edges)
    for _ in range(rounds):
        x = degrees / (n_baskets * y / (1 + np.outer(x, y))).sum(1)
        y = sizes / (items[:, None] * x[:, None] / (1 + np.outer(x, y))).sum(0)
        p = np.outer(x, y)
        p /= 1 + p
        if max(np.abs((p * n_baskets).sum(1) / degrees - 1).max(), np.abs((p * items[:, None]).sum(0) / sizes - 1).max()) < tol:
            break
    return p


def log10_tail(count: np.ndarray, q: np.ndarray, n_baskets: np.ndarray) -> np.ndarray:
    """log10 of P(X >= count) for sums of binomials: X = sum over k of Bin(n_baskets[k], q[:, k]).

    Counts up to 60 with all q below a tenth are summed exactly from the generating function, from the count upwards,
    so small tails keep their precision; the rest use the saddlepoint approximation of Lugannani and Rice above the mean,
    and the normal one with a half taken off up to the mean.
    """
    q = np.clip(q, 1e-300, 1 - 1e-12)
    out = np.zeros(len(count))
    mean = q @ n_baskets
    exact = (count <= 60) & (q.max(1) < 0.1) & (mean < 200)
    if exact.any():
        r = q[exact] / (1 - q[exact])
        c, top = count[exact], int(count[exact].max())
        power, moments = np.ones_like(r), []
        for m in range(1, 25):
            power = power * r
            moments.append((power @ n_baskets) * (1 if m % 2 else -1))
        steps = top + 40 + int(6 * math.sqrt(mean[exact].max() + 1) + mean[exact].max())
        terms = [np.ones(len(c))]
        tail = np.where(c == 0, 1.0, 0.0)
        scale = np.log1p(-q[exact]) @ n_baskets
        for j in range(steps):
            nxt = sum(moments[i] * terms[-1 - i] for i in range(min(j + 1, 24))) / (j + 1)
            terms.append(np.maximum(nxt, 0))
            terms = terms[-24:]
            tail += np.where(j + 1 >= c, terms[-1], 0)
        with np.errstate(divide="ignore"):
            out[exact] = np.minimum(0, (np.log(tail) + scale) / math.log(10))
    below = ~exact & (count <= mean)
    if below.any():
        spread = np.sqrt(np.maximum((q[below] * (1 - q[below])) @ n_baskets, 1e-300))
        z = (count[below] - 0.5 - mean[below]) / spread / math.sqrt(2)
        out[below] = [math.log10(0.5 * math.erfc(x)) for x in z]
    rest = ~exact & (count > mean)
    if rest.any():
        qq, c = q[rest], count[rest].astype(float) - 0.5
        t = np.log(c / mean[rest])
        for _ in range(60):
            e = qq * np.exp(t)[:, None]
            f = e / (1 - qq + e)
            k1, k2 = f @ n_baskets, (f * (1 - f)) @ n_baskets
            t = np.clip(t - np.clip((k1 - c) / np.maximum(k2, 1e-300), -1, 1), 1e-9, 700)
        e = qq * np.exp(t)[:, None]
        f = e / (1 - qq + e)
        k0, k2 = np.log1p(qq * np.expm1(t)[:, None]) @ n_baskets, (f * (1 - f)) @ n_baskets
        w = np.sqrt(np.maximum(2 * (t * c - k0), 1e-18))
        u = 2 * np.sinh(t / 2) * np.sqrt(k2)
        # tail = Phi(-w) + phi(w) (1/u - 1/w); for large w written with the Mills ratio so that it does not vanish
        mills = np.where(w < 5, np.array([0.5 * math.erfc(x / math.sqrt(2)) * math.sqrt(2 * math.pi) * math.exp(min(x * x / 2, 700)) if x < 5 else 0.0 for x in w]), 1 / w - 1 / w**3 + 3 / w**5 - 15 / w**7)
        factor = np.maximum(mills + 1 / u - 1 / w, 1e-300)
        out[rest] = np.minimum(0, (-w * w / 2 + np.log(factor) - 0.5 * math.log(2 * math.pi)) / math.log(10))
    return out


def together(groups: DataFrame) -> DataFrame:
    """``a, b, count, n_a, n_b, n, expected, lift, log10_p, fdr`` of every pair that occurs.

    ``expected`` is the mean under the fitted null, ``lift`` is ``count * n / (n_a * n_b)``, ``fdr`` the least rate at
    which the pair is still called surprising among all pairs of items. Empty input gives no rows. Only histograms reach
    the driver: of the items' frequencies, which differ in at most the root of twice all occurrences, of the baskets' sizes,
    and of the tails.
    """
    groups = materialize(groups, "baskets")
    counts = materialize(pair_counts(groups), "pairs")
    single = groups.select(F.explode("items").alias("x")).groupBy("x").agg(F.count("*").alias("c"))
    histogram = single.groupBy("c").agg(F.count("*").alias("n")).toPandas().sort_values("c")
    by_size = groups.groupBy(F.size("items").alias("k")).agg(F.count("*").alias("n")).toPandas().sort_values("k")
    degrees, items = histogram["c"].to_numpy(float), histogram["n"].to_numpy(float)
    sizes, n_baskets = by_size["k"].to_numpy(float), by_size["n"].to_numpy(float)
    p = fit_null(degrees, items, sizes, n_baskets) if len(degrees) else np.zeros((0, 0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            q = p[np.searchsorted(degrees, b["n_a"])] * p[np.searchsorted(degrees, b["n_b"])]
            yield b.assign(expected=q @ n_baskets, log10_p=log10_tail(b["count"].to_numpy(), q, n_baskets))

    # the score depends on the two frequencies and the count alone
    kinds = counts.groupBy("n_a", "n_b", "count").agg(F.count("*").alias("pairs"))
    scored = materialize(kinds.mapInPandas(score, "n_a long, n_b long, count long, pairs long, expected double, log10_p double"), "scores")
    grid = F.least(F.floor(-F.col("log10_p") * GRID), F.lit(400 * GRID)).cast("int")
    hist = scored.groupBy(grid.alias("g")).agg(F.sum("pairs").alias("n")).toPandas().sort_values("g", ascending=False)
    possible = items.sum() * (items.sum() - 1) / 2
    rate = np.log10(possible) - hist["g"].to_numpy() / GRID - np.log10(hist["n"].cumsum().to_numpy(float)) if len(hist) else np.zeros(0)
    best = np.minimum.accumulate(rate[::-1])[::-1]
    steps, values = hist["g"].to_numpy(), np.minimum(1, 10 ** np.minimum(best, 0))
    table = groups.sparkSession.createDataFrame(pd.DataFrame({"g": steps.astype("int32"), "fdr": values}), "g int, fdr double")
    rated = scored.withColumn("g", grid).join(F.broadcast(table), "g").drop("g", "pairs")  # at most 400 * GRID + 1 rows
    lift = F.col("count") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return counts.join(rated, ["n_a", "n_b", "count"]).select("a", "b", "count", "n_a", "n_b", "n", "expected", lift.alias("lift"), "log10_p", "fdr")


def frequent_pairs(groups: DataFrame, least: int = 5, lift: int = 8) -> DataFrame:
    """Pairs that stand out under the null (:data:`SURPRISE`) and then, by exact check, have at least ``least`` common baskets
    and ``count * n >= lift * n_a * n_b``, in whole numbers. The check alone implies a far smaller tail: five common baskets
    where 0.625 are expected have one of 0.0005, and the null expects three times more at the most for baskets of five."""
    wide = together(groups).where(F.col("log10_p") <= math.log10(SURPRISE))
    big = {c: F.col(c).cast("decimal(19,0)") for c in ("count", "n", "n_a", "n_b")}
    return wide.where((F.col("count") >= least) & (big["count"] * big["n"] >= F.lit(lift).cast("decimal(3,0)") * big["n_a"] * big["n_b"])).select("a", "b", "count", "expected", "log10_p", "fdr")


def stored_counts(store: DataFrame) -> DataFrame:
    """The store's own counters added up: exact repeats of a row once, null counts as 0, pairs put in order, self-pairs and null names left out."""
    rows = store.select("writer", "a", "b", "count").distinct().where("a is not null and b is not null and a <> b")
    return rows.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))
