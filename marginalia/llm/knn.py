"""Most similar vectors for every vector: inverted lists scanned with adaptive dimension tests.

Vectors are normalised and rotated by a random orthogonal matrix, so any prefix of a difference's coordinates is a fair
sample of all of them. Within a probed list the columns are read in blocks; after each block, a hypothesis test drops
the candidates whose partial distance is already too large for the query's current bound, and only the rest go on.
Lists near each other form regions; a query travels once to each region that holds a list it probes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.session import materialize

#: Vectors the index is fitted on at most, vectors of a list and of a region on average, lists a query probes at most (None: as
#: many as :data:`RECALL` asks for).
SAMPLE, LIST, REGION, PROBES = 40_000, 300, 50_000, None
#: Share of the true neighbours of sampled queries whose lists a query without a cosine floor looks into, and those queries.
RECALL, MEASURED = 0.99, 1_000
#: Distances closer than this are one to 32-bit floats: the smaller id goes first until exact cosines are known.
NOISE = 1e-6
#: Candidates kept beyond k until the exact cosines are known, which are rounded to 12 places so that scaled copies tie.
SPARE = 4
#: Queries, and vectors, of a region that one task takes at most, about.
CROWD = 100_000
#: Significance of the abandon test: a true neighbour is dropped when its partial distance strays this far from its share.
EPSILON, SIGMAS = 2.1, 3.0
#: Columns after which a test is made.
BLOCKS = (12, 28, 44, 64)


def usable(vectors: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """``id, v, h1, h2`` of the rows with a key and a vector of ``dims`` finite numbers that are not all zero; a null key,
    null vector or null entry is unusable. ``h1, h2`` tell vectors apart without carrying them along."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = (F.size(v) == dims) & ~bad & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull()).where(good)
    return rows.select(F.col(key).alias("id"), v.alias("v"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2"))


def representatives(rows: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """(``id, h1, h2``: each key once, with the vector of least hash where it has several; ``rep, ids, h1, h2``: distinct
    vectors with their ``keep`` smallest ids).

    Only hashes travel, and ranks are limited before the shuffle, so a vector that a third of the rows share costs a few
    rows per task.
    """
    chosen = rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2")
    members = materialize(chosen, "members")
    ranked = members.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= keep)
    reps = ranked.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "h1", "h2")
    return members, materialize(reps, "reps")


def _unit(v: pd.Series | np.ndarray) -> np.ndarray:
    x = np.array(v, dtype=np.float64) if isinstance(v, np.ndarray) else np.stack([np.asarray(y, dtype=np.float64) for y in v])
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        label = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        order = np.argsort(label, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(label[order]) > 0])
        sums = np.add.reduceat(x[order], first, axis=0)
        norm = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = c.copy()
        c[label[order][first]] = sums / np.where(norm > 0, norm, 1)
    return c


class Index:
    """Rotation, list centres and regions; small and bounded, so it travels with the tasks."""

    def __init__(self, sample: np.ndarray, n: int, seed: int = 11):
        dims = sample.shape[1]
        rng = np.random.default_rng(seed)
        q, r = np.linalg.qr(rng.standard_normal((dims, dims)))
        self.rotation = (q * np.sign(np.diag(r))).astype(np.float32)
        x = (sample @ self.rotation).astype(np.float32)
        lists = int(np.clip(n // LIST, 1, max(1, min(8192, len(x) // 8))))
        self.centres = _kmeans(x, lists, seed).astype(np.float32)
        regions = int(np.clip(n // REGION, 1, max(1, lists // 4)))
        heads = _kmeans(self.centres, regions, seed + 1)
        self.region = (self.centres @ heads.T).argmax(1).astype(np.int32)
        self._across: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_across": None}  # worked out again where it is used

    def needed(self, x: np.ndarray, k: int) -> int:
        """How many lists hold :data:`RECALL` of the ``k`` nearest of some of the (rotated) vectors among all of them, found by
        brute force. Neighbours are further apart in a sample than among all vectors, so the answer is on the safe side."""
        lists = np.concatenate([(x[i : i + 4096] @ self.centres.T).argmax(1) for i in range(0, len(x), 4096)])
        ranks = []
        step = max(1, len(x) // MEASURED)
        for at in range(0, len(x), step * 200):
            own = np.arange(at, min(at + step * 200, len(x)), step)
            sims = x[own] @ x.T
            sims[np.arange(len(own)), own] = -2
            near = np.argpartition(-sims, min(k, sims.shape[1] - 1), axis=1)[:, :k]
            row, place, _ = self.probes(x[own], 9.0, len(self.centres), ordered=True)
            order = np.empty((len(own), len(self.centres)), np.int32)
            order[row, place] = np.tile(np.arange(len(self.centres)), len(own))
            ranks.append(order[np.arange(len(own))[:, None], lists[near]].ravel())
        return int(np.quantile(np.concatenate(ranks), RECALL, method="higher")) + 1

    def probes(self, x: np.ndarray, reach: float, most: int, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, list, home) of every list a row must look into: its own, and those whose border is within ``reach``
        (a distance between unit vectors), the nearest ``most`` at the most; in that order if ``ordered``."""
        rows, lists, homes = [], [], np.empty(len(x), np.int32)
        if self._across is None:
            self._across = 2 - 2 * (self.centres @ self.centres.T)
        across = self._across
        for at in range(0, len(x), 2048):
            part = x[at : at + 2048]
            d = np.maximum(0, (part * part).sum(1)[:, None] + 1 - 2 * part @ self.centres.T)
            home = d.argmin(1)
            homes[at : at + 2048] = home
            near = np.take_along_axis(d, home[:, None], 1)
            gap = (d - near) / (2 * np.sqrt(np.maximum(across[home], 1e-12)))
            gap[np.arange(len(part)), home] = -1
            k = min(most, gap.shape[1])
            cols = np.argsort(gap, axis=1)[:, :k] if ordered else np.argpartition(gap, k - 1, axis=1)[:, :k]
            ok = np.take_along_axis(gap, cols, 1) <= reach
            r, c = np.nonzero(ok)
            rows.append(r + at)
            lists.append(cols[r, c])
        return np.concatenate(rows), np.concatenate(lists).astype(np.int32), homes


def fit_index(rows: DataFrame, n: int, asking: int, reach: float, probes: int | None, k: int, sample: int = SAMPLE) -> Index:
    """Fit on at most ``sample`` vectors, those of the smallest key hashes; every vector is indexed afterwards. The same
    vectors tell how many lists must be probed (where ``probes`` leaves it open and no border does), how many rows each
    region will hold and how many of ``asking`` queries it will get."""
    share = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000_007))
    chosen = rows.where(share <= int(min(1.0, 1.05 * sample / max(n, 1)) * 1_000_000_007)).select("v", share.alias("s"), "id")
    x = _unit(chosen.orderBy("s", "id", "h1", "h2").limit(sample).toPandas()["v"])
    index = Index(x, n)
    turned = x.astype(np.float32) @ index.rotation
    index.most = probes or (index.needed(turned, k) if reach > 4 else len(index.centres))
    row, lists, home = index.probes(turned, reach, index.most)
    regions = int(index.region.max()) + 1
    asked = np.unique(np.stack([row, index.region[lists]]), axis=1)[1]
    expected = ((asked, asking), (index.region[home], n))
    index.blocks = [np.maximum(1, np.ceil(np.bincount(c, minlength=regions) * 1.2 * total / len(x) / CROWD)).astype(int) for c, total in expected]
    return index


def _scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, eps: float, own: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, squared distance) within each query's ``bound``, by adaptive dimension scan.

    The first block is a matrix product over all pairs; later blocks see only the pairs that passed the tests before.
    A pair is abandoned after m of D columns if its partial distance exceeds ``bound * m / D * (1 + eps / sqrt(m))^2``.
    """
    dims = q.shape[1]
    steps = [b for b in BLOCKS if b < dims] + [dims]
    m = steps[0]
    a, b = q[:, :m], x[:, :m]
    part = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    limit = bound * (m / dims) * (1 + eps / np.sqrt(m)) ** 2 if m < dims else bound
    i, j = np.nonzero(part <= limit[:, None])
    other = own[0][i] != own[1][j]
    i, j = i[other], j[other]
    dist = np.maximum(part[i, j], 0)
    for lo, hi in zip(steps, steps[1:], strict=False):
        if not len(i):
            break
        gap = q[i, lo:hi] - x[j, lo:hi]
        dist = dist + np.einsum("ij,ij->i", gap, gap)
        limit = bound[i] * (hi / dims) * (1 + eps / np.sqrt(hi)) ** 2 if hi < dims else bound[i] * (1 + 1e-5) + 1e-7
        stay = dist <= limit
        i, j, dist = i[stay], j[stay], dist[stay]
    return i, j, dist


def _best(i: np.ndarray, j: np.ndarray, d: np.ndarray, rank: np.ndarray, k: int, exact: bool = False) -> np.ndarray:
    """Positions of each query's ``k`` nearest by (distance, rank); distances that are not ``exact`` tie within :data:`NOISE`."""
    order = np.lexsort((rank, d if exact else np.floor(d / NOISE), i))
    s = i[order]
    start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, int)
    at = np.arange(len(s)) - np.repeat(start, np.diff(np.r_[start, len(s)]))
    return order[at < k]


def _copies(rows: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number of the copy) of rows repeated so many times."""
    return np.repeat(rows, times), np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)


def neighbours(reps: DataFrame, index: Index, k: int, min_cosine: float | None, asks: Column, exact: bool = False) -> DataFrame:
    """``rep, other, cosine``: up to ``k`` nearest other vectors of each vector of ``reps(rep, v)`` for which ``asks`` holds.

    With ``min_cosine`` only nearer ones count, and a list is probed only where the border to it may be crossed within
    that distance (:func:`_limits`); without it the ``index.most`` nearest lists are. ``exact`` probes every list and abandons
    nothing: brute force in the same blocks, to measure the rest by.
    """
    radius, reach = _limits(min_cosine, len(index.rotation))
    eps, most = (float("inf"), len(index.centres)) if exact else (EPSILON, index.most)
    reach = 9.0 if exact else reach
    kind = dict(reps.dtypes)["rep"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row per (vector, region, block): the lists it probes there, and its home list if that lies there."""
        regions = int(index.region.max()) + 1
        for b in batches:
            if not b.num_rows:
                continue
            # the vectors travel as they were given: 32-bit floats stay exact, and the task rotates them again
            given = b.column("v").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = _unit(given).astype(np.float32) @ index.rotation
            raw = np.ascontiguousarray(given, dtype=np.float32)
            ask, salt = (b.column(c).to_numpy(zero_copy_only=False) for c in ("q", "s"))
            row, lists, home = index.probes(x, reach, most)
            keep = ask[row]
            row, lists = row[keep], lists[keep]
            key = row.astype(np.int64) * regions + index.region[lists]
            order = np.argsort(key, kind="stable")
            key, lists = key[order], lists[order]
            asked, first = np.unique(key, return_index=True)
            length = np.diff(np.r_[first, len(key)])
            every = np.union1d(asked, np.arange(b.num_rows, dtype=np.int64) * regions + index.region[home])
            at = np.searchsorted(asked, every)
            hit = at < len(asked)
            hit[hit] = asked[at[hit]] == every[hit]
            # a list of every (vector, region): where it begins among the probed lists, and how long it is
            begin, size = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
            begin[hit], size[hit] = first[at[hit]], length[at[hit]]
            i, g = every // regions, every % regions
            lives = np.where(index.region[home[i]] == g, home[i], -1)
            qs, xs = index.blocks[0][g], index.blocks[1][g]
            whole = np.flatnonzero((qs == 1) & (xs == 1))
            queries = np.flatnonzero(((qs > 1) | (xs > 1)) & (size > 0))
            data = np.flatnonzero(((qs > 1) | (xs > 1)) & (lives >= 0))
            zero = np.zeros(len(whole), np.int64)
            q_at, q_copy = _copies(queries, xs[queries])
            d_at, d_copy = _copies(data, qs[data])
            pick = np.r_[whole, q_at, d_at]
            block_a = np.r_[zero, salt[i[q_at]] % qs[q_at], d_copy]
            block_b = np.r_[zero, q_copy, salt[i[d_at]] // 1024 % xs[d_at]]
            own = np.r_[lives[whole], np.full(len(q_at), -1), lives[d_at]]
            held = np.r_[size[whole], size[q_at], np.zeros(len(d_at), np.int64)]
            offsets = np.r_[0, np.cumsum(held)]
            flat = lists[np.repeat(begin[pick] - offsets[:-1], held) + np.arange(offsets[-1])]
            for lo in range(0, len(pick), 20_000):
                part = slice(lo, lo + 20_000)
                who = i[pick[part]]
                n, width = len(who), raw.shape[1] * 4
                bytes_ = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(raw[who].tobytes())])
                ends = offsets[lo : lo + n + 1]
                probed = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(flat[ends[0] : ends[-1]], pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(g[pick[part]], pa.int32()), pa.array(block_a[part], pa.int32()), pa.array(block_b[part], pa.int32()), b.column("rep").take(pa.array(who)), bytes_, probed, pa.array(own[part], pa.int32())],
                    ["region", "a", "b", "rep", "x", "lists", "home"],
                )

    salt = F.pmod(F.xxhash64("rep", F.lit("block")), F.lit(1 << 30))
    source = reps.select("rep", "v", asks.alias("q"), salt.alias("s"))
    tasks = source.mapInArrow(place, f"region int, a int, b int, rep {kind}, x binary, lists array<int>, home int")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        given = np.frombuffer(b"".join(pdf["x"]), dtype=np.float32).reshape(len(pdf), -1).astype(np.float64)
        given /= np.abs(given).max(1, keepdims=True)
        given /= np.sqrt((given * given).sum(1, keepdims=True))
        x = given.astype(np.float32) @ index.rotation
        rep = pdf["rep"].to_numpy()
        home = pdf["home"].to_numpy()
        counts = pdf["lists"].map(len).to_numpy()
        asked = np.concatenate([np.asarray(v, dtype=np.int32) for v in pdf["lists"]]) if counts.sum() else np.zeros(0, np.int32)
        asker = np.repeat(np.arange(len(pdf)), counts)
        first = home[asker] != asked  # home lists first: they tighten the bounds soonest
        order = np.lexsort((asker, asked))
        asked, asker, first = asked[order], asker[order], first[order]
        data = np.argsort(home, kind="stable")
        sorted_home = home[data]
        bound = np.full(len(pdf), radius, np.float32)
        hits: list[tuple] = []
        for later in (False, True):
            turn = first == later
            ask, who = asked[turn], asker[turn]
            for c in np.unique(ask):
                qs = who[np.searchsorted(ask, c) : np.searchsorted(ask, c, "right")]
                xs = data[np.searchsorted(sorted_home, c) : np.searchsorted(sorted_home, c, "right")]
                for lo in range(0, len(qs), 1024) if len(xs) else ():
                    part = qs[lo : lo + 1024]
                    for at in range(0, len(xs), 8192):
                        piece = xs[at : at + 8192]
                        i, j, d = _scan(x[part], x[piece], bound[part], eps, (rep[part], rep[piece]))
                        if not len(i):
                            continue
                        best = _best(i, j, d, rep[piece[j]], k + SPARE)
                        i, j, d = i[best], j[best], d[best]
                        hits.append((part[i], piece[j], d))
                        full = np.bincount(i, minlength=len(part)) >= k + SPARE
                        if full.any():
                            far = np.zeros(len(part), np.float32)
                            np.maximum.at(far, i, d)
                            bound[part[full]] = np.minimum(bound[part[full]], far[full] + NOISE)
        if not hits:
            return pd.DataFrame({"rep": rep[:0], "other": rep[:0], "cosine": np.zeros(0)})
        i, j, d = (np.concatenate(h) for h in zip(*hits, strict=True))
        best = _best(i, j, d, rep[j], k + SPARE)
        i, j = i[best], j[best]
        cosine = np.round(np.einsum("ij,ij->i", given[i], given[j]), 12)
        best = _best(i, j, -cosine, rep[j], k, exact=True)
        i, j, cosine = i[best], j[best], cosine[best]
        return pd.DataFrame({"rep": rep[i], "other": rep[j], "cosine": cosine})

    found = tasks.groupBy("region", "a", "b").applyInPandas(search, f"rep {kind}, other {kind}, cosine double")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")))
    best = ranked.where(F.col("r") <= k).drop("r")
    return best if min_cosine is None else best.where(F.col("cosine") >= min_cosine)


def _limits(min_cosine: float | None, dims: int) -> tuple[float, float]:
    """(largest squared distance, furthest list border) of unit vectors that still count.

    The part of a step of length r that points at a border has a deviation of ``r / sqrt(dims)``; a border further than
    :data:`SIGMAS` of them is not crossed, by the same kind of test that abandons candidates.
    """
    return (2 - 2 * min_cosine, float(SIGMAS * np.sqrt((2 - 2 * min_cosine) / dims))) if min_cosine is not None else (4.0, 9.0)


def nearest(vectors: DataFrame, key: str, vector: str, k: int, dims: int = 64, min_cosine: float | None = None, every: int = 1, probes: int | None = PROBES, exact: bool = False) -> DataFrame:
    """``id, neighbour, cosine``: the ``k`` most similar other ids of every id (or of those divisible by ``every``).

    Greater cosine first, then the smaller id. Equal vectors are searched once: their ids are each other's nearest, and
    stand for one another in other results. Unusable vectors (see :func:`usable`) take no part; other columns are ignored.
    """
    rows = usable(vectors, key, vector, dims)
    members, reps = representatives(rows, k + 1)
    asking = members.where(F.col("id") % every == 0)
    of = asking.join(reps, ["h1", "h2"]).select("id", "rep", F.col("ids").alias("own"))
    n = reps.count()
    if not n:
        return of.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("cosine"))
    total = members.count()
    index = fit_index(rows, total, total if every == 1 else asking.count(), 9.0 if exact else _limits(min_cosine, dims)[1], probes, k)
    asked = reps.select("rep", "h1", "h2", F.lit(True).alias("asked")) if every == 1 else reps.join(asking.select("h1", "h2").distinct().withColumn("y", F.lit(True)), ["h1", "h2"], "left").select("rep", "h1", "h2", F.coalesce("y", F.lit(False)).alias("asked"))
    # the hashes stay in the grouping, so that the join's partitioning serves it and vectors are shuffled once
    distinct = rows.join(asked.withColumnRenamed("rep", "id"), ["id", "h1", "h2"]).groupBy("id", "h1", "h2", "asked").agg(F.min("v").alias("v")).select(F.col("id").alias("rep"), "asked", "v")
    found = materialize(neighbours(distinct, index, k, min_cosine, F.col("asked"), exact), "found")
    with_ids = found.join(reps.select(F.col("rep").alias("other"), "ids"), "other")
    one = F.transform(F.slice("ids", 1, k), lambda i: F.struct((-F.col("cosine")).alias("far"), i.alias("i")))
    near = with_ids.groupBy("rep").agg(F.slice(F.sort_array(F.flatten(F.collect_list(one))), 1, k).alias("near"))
    own = F.transform(F.filter("own", lambda i: i != F.col("id")), lambda i: F.struct(F.lit(-1.0).alias("far"), i.alias("i")))
    joined = of.join(near, "rep", "left")
    top = F.slice(F.sort_array(F.concat(own, F.coalesce("near", F.array().cast("array<struct<far:double,i:bigint>>")))), 1, k)
    return joined.select("id", F.explode(top).alias("n")).select("id", F.col("n.i").alias("neighbour"), (-F.col("n.far")).alias("cosine"))


def similar_pairs(vectors: DataFrame, key: str, vector: str, k: int = 5, dims: int = 64, min_cosine: float = 0.9) -> DataFrame:
    """``id_a, id_b`` (smaller first, each once) of cosine at least ``min_cosine`` where one is among the other's ``k`` nearest."""
    near = nearest(vectors, key, vector, k, dims, min_cosine)
    return near.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
