"""The link graph (D1, D2, C18, E9), PageRank (G1-G3), and the spectral embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.links import wikilinks
from marginalia.operators.components import connected_components
from marginalia.operators.vault_state import by_name
from marginalia.session import materialize, materialize_with, release


def links() -> Column:
    """B2: the targets of every link in a note's body or in a frontmatter value, repeats kept."""
    front = F.flatten(F.transform(F.map_values(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), wikilinks))
    touched = F.flatten(F.transform(F.coalesce("touches", F.array().cast("array<string>")), wikilinks))
    return F.concat(wikilinks(F.col("content")), front, touched)


def link_pairs(notes: DataFrame) -> DataFrame:
    """B2: ``src, dst`` of every link of a note, repeats kept; a note's ``links``, if it has that column, are taken as they are."""
    found = F.col("links") if "links" in notes.columns else links()
    return notes.select(F.col("name").alias("src"), F.explode(found).alias("dst"))


def link_edges(notes: DataFrame, self_loops: bool = False) -> DataFrame:
    """``src, dst, n``: edges between names that exist, with the number of links each stands for; dangling targets are
    dropped. The boot graph keeps notes that link themselves, the artifact's does not."""
    nodes = by_name(notes.select("name", "rel_path")).select(F.col("name").alias("dst"))
    pairs = link_pairs(notes).where("src is not null and dst <> ''")
    counted = (pairs if self_loops else pairs.where("src <> dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))
    return counted.join(nodes, "dst", "left_semi").select("src", "dst", "n")


def cut_lanes(edges: DataFrame, lanes: DataFrame) -> DataFrame:
    """Edges whose ends (``lanes(name, lane)``) share a lane or of which one is neutral; others are dropped."""
    a, b = lanes.select(F.col("name").alias("src"), F.col("lane").alias("la")), lanes.select(F.col("name").alias("dst"), F.col("lane").alias("lb"))
    both = edges.join(a, "src").join(b, "dst")
    return both.where((F.col("la") == F.col("lb")) | (F.col("la") == "neutral") | (F.col("lb") == "neutral")).select(*edges.columns)


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("name"))
    return nodes.select("name").distinct().join(ends, "name", "left_anti")


def pagerank(nodes: DataFrame, edges: DataFrame, seeds: DataFrame | None = None, alpha: float = 0.85, tol: float = 1e-6, max_iterations: int = 1_000) -> DataFrame:
    """``name, rank``: personalised PageRank over distinct directed edges; ranks add up to 1.

    ``seeds(name, weight)`` sets where the walk restarts (weights are normalised; unknown seeds and weights not above 0
    are ignored); without any it restarts anywhere. Mass at nodes without a way out goes where the walk restarts, so the
    ranks are in proportion to what walks that end there leave behind: the sum over all lengths of ``(alpha P^T)^k p``.
    A round carries the mass still under way one link on, one join and one aggregation; a hub's in-edges combine before
    the shuffle. It ends when less than ``tol`` per node is under way, looked at every :data:`ROUNDS` rounds, whose result
    is written to the shared folder (RuntimeError after ``max_iterations`` rounds): lineage does not grow, and lost
    executors cost a few rounds.
    """
    nodes = nodes.select("name").where("name is not null").distinct()
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    start = nodes.select("name", F.lit(1.0 / n).alias("y"))
    if seeds is not None:
        wanted = seeds.groupBy("name").agg(F.max("weight").alias("w")).where("w > 0").join(nodes, "name", "left_semi")
        total = wanted.agg(F.sum("w")).first()[0]
        if total:
            start = wanted.select("name", (F.col("w") / total).alias("y"))
    left, total = _left_behind(nodes, edges, start, [], alpha, n * tol, max_iterations)
    return materialize(nodes.join(left.select("name", (F.col("y") / total).alias("rank")), "name", "left").fillna(0.0, ["rank"]), "ranks")


def walks(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, alpha: float = 0.85, tol: float = 1e-6, max_iterations: int = 1_000) -> DataFrame:
    """``id, name, rank``: a personalised PageRank for every ``id`` of ``seeds(id, name, weight)`` at once, nodes of rank 0 left out.

    As :func:`pagerank` for each id by itself, but all walks take a step together and stop together, when all of them have
    less than ``tol`` per node under way. Ids none of whose seeds is known have no rows. A round holds as many rows as the
    walks have met nodes.
    """
    nodes = nodes.select("name").where("name is not null").distinct()
    known = seeds.groupBy("id", "name").agg(F.max("weight").alias("w")).where("w > 0").join(nodes, "name", "left_semi")
    start = known.join(known.groupBy("id").agg(F.sum("w").alias("all")), "id").select("id", "name", (F.col("w") / F.col("all")).alias("y"))
    left, _ = _left_behind(nodes, edges, start, ["id"], alpha, nodes.count() * tol, max_iterations)
    left = materialize(left, "walks")
    return left.join(left.groupBy("id").agg(F.sum("y").alias("all")), "id").select("id", "name", (F.col("y") / F.col("all")).alias("rank"))


#: Edges and nodes up to which a graph is taken along to every task (some 20 bytes each).
CARRIED = 8_000_000


def best_walked(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, k: int, alpha: float = 0.85, tol: float = 1e-6) -> DataFrame | None:
    """``id, name, rank`` of :func:`walks` for the ``k`` shown nodes of greatest rank of each id, and those that rounding to 12
    digits may make equal to the last; equal ones go by ``rel_path``. ``nodes(name, rel_path, shown)`` has one row per name.
    None if the graph has more than :data:`CARRIED` edges or nodes.

    Walks don't meet, so every id is walked by itself, in one task, on a graph carried to all of them: nothing is shuffled
    from round to round. All stop in the same round, the first multiple of :data:`ROUNDS` after which all of them together have
    less than ``tol`` per node under way; a first pass tells which.
    """
    numbered = materialize(nodes.where("name is not null").orderBy("rel_path", "name").withColumn("num", F.monotonically_increasing_id()), "numbered")
    number = numbered.select("name", "num")
    ways = edges.select("src", "dst").distinct().join(number.withColumnsRenamed({"name": "src", "num": "s"}), "src").join(number.withColumnsRenamed({"name": "dst", "num": "d"}), "dst")
    ways = materialize(ways.select("s", "d"), "ways")
    if max(ways.count(), n := numbered.count()) > CARRIED:
        return None
    at = numbered.select("num", "shown").toArrow().sort_by("num")
    nums, shown = at["num"].to_numpy(), at["shown"].to_numpy()
    pairs = ways.toArrow()
    src, dst = (np.searchsorted(nums, pairs[c].to_numpy()).astype(np.int32) for c in ("s", "d"))
    dst = dst[np.lexsort((dst, src))]
    deg = np.bincount(src, minlength=n)
    begin = np.concatenate([[0], np.cumsum(deg)[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    known = seeds.groupBy("id", "name").agg(F.max("weight").alias("w")).where("w > 0").join(number, "name").select("id", "num", "w")
    known = materialize(known, "known")

    def walk(t: pa.Table, rounds: int) -> tuple[np.ndarray, list[float]]:
        w = t["w"].to_numpy()
        order = np.argsort(nums_ := t["num"].to_numpy())
        here, y = np.searchsorted(nums, nums_[order]), (w / w.sum())[order]
        left, under_way = np.zeros(len(nums)), []
        left[here] += y
        for i in range(1, rounds + 1):
            d = deg[here]
            first = np.cumsum(d) - d
            to = dst[np.repeat(begin[here] - first, d) + np.arange(d.sum())]
            moved = np.repeat(y * alpha / np.maximum(d, 1), d)
            if 20 * len(to) > len(nums):
                sums = np.bincount(to, moved, len(nums))
                here = np.flatnonzero(sums)
                y = sums[here]
            else:
                here, back = np.unique(to, return_inverse=True)
                y = np.bincount(back, moved, len(here))
            left[here] += y
            if i % ROUNDS == 0:
                under_way.append(float(y.sum()))
        return left, under_way

    def under_way(t: pa.Table) -> pa.Table:
        return pa.table({"left": pa.array([walk(t, most)[1]], pa.list_(pa.float64()))})

    def best(t: pa.Table) -> pa.Table:
        left, _ = walk(t, stop)
        rank = left / left.sum()
        found = np.flatnonzero((rank > 0) & shown)
        if len(found) > k:
            least = np.partition(rank[found], len(found) - k)[len(found) - k]
            found = found[rank[found] >= least - 2e-12]
        found = found[np.lexsort((found, -rank[found]))]
        new = np.flatnonzero(np.diff(rank[found], prepend=np.inf))
        found = found[np.arange(len(found)) - np.repeat(new, np.diff(np.append(new, len(found)))) < k]  # k of each value will do
        return pa.table({"id": pa.array([t["id"][0].as_py()] * len(found), pa.string()), "num": pa.array(nums[found], pa.int64()), "rank": rank[found]})

    least, most, stop = n * tol, ROUNDS, ROUNDS
    walkers = known.select("id").distinct().count()
    while walkers and walkers * alpha**most >= least:
        most += ROUNDS
    if walkers:
        sums = known.groupBy("id").applyInArrow(under_way, "left array<double>").select(F.posexplode("left")).groupBy("pos").agg(F.sum("col").alias("v")).collect()  # a row to four rounds
        stop = ROUNDS * (1 + min(r["pos"] for r in sums if r["v"] < least))
    found = known.groupBy("id").applyInArrow(best, "id string, num long, rank double")
    return materialize(found.join(number, "num").select("id", "name", "rank"), "walked")


#: Rounds of a walk that one job takes.
ROUNDS = 4


def _left_behind(nodes: DataFrame, edges: DataFrame, start: DataFrame, keys: list[str], alpha: float, least: float, most: int) -> tuple[DataFrame, float]:
    """(``keys, name, y``: the mass walks from ``start(keys, name, y)`` leave at each node, the sum of it all).

    A row holds what is under way at a node (``y``) and what has passed it (``x``). Every node has a step to itself that only
    adds the one to the other, so a round reads its rows once.
    """
    known = edges.select("src", "dst").distinct().join(nodes.select(F.col("name").alias("src")), "src", "left_semi").join(nodes.select(F.col("name").alias("dst")), "dst", "left_semi")
    known = materialize(known, "edges")
    degree = known.groupBy("src").agg(F.count("*").alias("deg"))
    ways = known.join(degree, "src").select("src", "dst", (F.lit(alpha) / F.col("deg")).alias("share"))
    stay = nodes.select(F.col("name").alias("src"), F.col("name").alias("dst"), F.lit(None).cast("double").alias("share"))
    steps = materialize(ways.unionByName(stay), "steps")
    release(known)
    state = materialize(start.select(*keys, "name", "y", F.lit(0.0).alias("x")), "mass")
    for _ in range(0, most, ROUNDS):
        ahead = state
        for _ in range(ROUNDS):
            met = steps.join(ahead.withColumnRenamed("name", "src"), "src")
            moved = F.when(F.col("share").isNotNull(), F.col("y") * F.col("share")).otherwise(0.0)
            passed = F.when(F.col("share").isNull(), F.col("x") + F.col("y")).otherwise(0.0)
            ahead = met.groupBy(*keys, F.col("dst").alias("name")).agg(F.sum(moved).alias("y"), F.sum(passed).alias("x"))
        ahead, sums = materialize_with(ahead, "mass", under_way=F.sum("y"), all=F.sum(F.col("x") + F.col("y")))
        release(state)
        state = ahead
        if (sums["under_way"] or 0.0) < least:
            break
    else:
        raise RuntimeError(f"ranks did not settle within {most} rounds")
    release(steps)
    return state.select(*keys, "name", (F.col("x") + F.col("y")).alias("y")), sums["all"] or 1.0


def spectral(nodes: DataFrame, edges: DataFrame, dims: int = 16, exact_nodes: int = 2_000, rounds: int = 1_000, seed: int = 1, tol: float = 1e-6) -> DataFrame:
    """``name, spectral``: eigenvectors 1 to ``dims`` of the undirected graph's normalised Laplacian.

    The eigenvalue 0 has one vector per component, an isolate being one: the component's root degrees at unit length (1
    for an isolate). They come first, by size of the component and then by its smallest name; the first of all is left
    out. Signs are fixed by the largest component, values rounded to 6 places, missing dimensions 0. The other vectors
    are solved densely on the driver up to ``exact_nodes`` nodes; above it, by filtered block iteration, until every
    vector's residual is at most ``tol`` (RuntimeError after ``rounds`` multiplications). There only Gram matrices reach
    the driver. Vectors of one repeated eigenvalue other than 0 are any basis. A graph without edges has all zeros.
    """
    nodes = nodes.select("name").where("name is not null").distinct()
    both = edges.where("src <> dst").select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    both = both.join(nodes.select(F.col("name").alias("src")), "src", "left_semi").join(nodes.select(F.col("name").alias("dst")), "dst", "left_semi")
    n = nodes.count()
    d = min(dims, n - 2)
    zeros = F.array(*[F.lit(0.0)] * dims)
    if d <= 0 or not both.limit(1).count():
        return nodes.withColumn("spectral", zeros)
    if n > exact_nodes:
        return _filtered_iteration(nodes, both, d, dims, rounds, seed, tol)
    names = sorted(r["name"] for r in nodes.collect())  # bounded by exact_nodes
    at = {x: i for i, x in enumerate(names)}
    a = np.zeros((n, n))
    for r in both.collect():  # at most exact_nodes squared
        a[at[r["src"]], at[r["dst"]]] = 1
    deg = a.sum(1)
    inv = np.where(deg > 0, 1 / np.sqrt(np.maximum(deg, 1)), 0)
    lap = np.diag((deg > 0).astype(float)) - inv[:, None] * a * inv[None, :]
    parts = _parts(a)
    flat = np.zeros((n, len(parts)))
    for j, part in enumerate(parts):
        flat[part, j] = np.sqrt(deg[part] / deg[part].sum()) if len(part) > 1 else 1
    _, vec = np.linalg.eigh(lap)
    v = np.hstack([flat, vec[:, len(parts) :]])[:, 1 : d + 1]
    v = np.round(v * np.sign(v[np.round(np.abs(v), 9).argmax(0), np.arange(d)]), 6) + 0.0
    rows = [(x, [*map(float, v[i]), *[0.0] * (dims - d)]) for i, x in enumerate(names)]
    return nodes.sparkSession.createDataFrame(rows, "name string, spectral array<double>")


def _parts(a: np.ndarray) -> list[list[int]]:
    """The components of an adjacency matrix, the largest first, then that of the smallest index."""
    left, parts = set(range(len(a))), []
    while left:
        part, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i not in part:
                part.add(i)
                todo += map(int, np.flatnonzero(a[i]))
        left -= part
        parts.append(sorted(part))
    return sorted(parts, key=lambda x: (-len(x), x[0]))


#: Multiplications in one filter of the block iteration.
FILTER = 12


def _filtered_iteration(nodes: DataFrame, both: DataFrame, d: int, dims: int, rounds: int, seed: int, tol: float) -> DataFrame:
    """The vectors of 0 by components; the others, if any are wanted, by :func:`_settled`."""
    edges = materialize(both, "edges")
    deg = edges.groupBy(F.col("src").alias("name")).agg(F.count("*").alias("deg"))
    labels = connected_components(nodes.select(F.col("name").alias("node")), edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    base = materialize(labels.withColumnRenamed("node", "name").join(deg, "name", "left").fillna(0, ["deg"]), "base")
    sizes = materialize(base.groupBy("component").agg(F.count("*").alias("n"), F.sum("deg").alias("volume")), "sizes")
    top = sizes.orderBy(F.desc("n"), "component").limit(d + 1).collect()
    known = base.sparkSession.createDataFrame([(r["component"], j, float(r["volume"])) for j, r in enumerate(top)], "component string, part int, volume double")
    base = base.join(F.broadcast(known), "component", "left").select("name", "deg", "part", F.when(F.col("volume") > 0, F.sqrt(F.col("deg") / F.col("volume"))).otherwise(1.0).alias("unit"))
    base = materialize(base, "base")
    want = d - (len(top) - 1)  # above 0 only if every component is in ``top``
    flat = [F.round(F.when(F.col("part") == j, F.col("unit")).otherwise(0.0), 6) for j in range(1, len(top))]
    if want > 0:
        spread = base.where("deg > 0")
        x, found = _settled(spread, edges, len(top), want, spread.count() - sum(r["volume"] > 0 for r in top), rounds, seed, tol)
        tops = x.agg(*[F.min_by(F.col("v")[i], F.struct(-F.round(F.abs(F.col("v")[i]), 9), "name")).alias(f"t{i}") for i in range(found)]).first() if found else {}
        base = base.join(x.select("name", "v"), "name", "left")
        flat += [F.round(F.coalesce(F.col("v")[i], F.lit(0.0)) * (1.0 if tops[f"t{i}"] >= 0 else -1.0), 6) + 0.0 for i in range(found)]
    flat += [F.lit(0.0)] * (dims - len(flat))
    return base.select("name", F.array(*flat).alias("spectral"))


def _settled(base: DataFrame, edges: DataFrame, parts: int, want: int, room: int, rounds: int, seed: int, tol: float) -> tuple[DataFrame, int]:
    """``name, v``: the leading eigenvectors of the scaled adjacency besides those of the components, and their number.

    Block iteration with a Chebyshev filter over the interval below the block's least Ritz value; the components' vectors
    (``part, unit``) are taken out in every Rayleigh-Ritz step. A round is one join and one aggregation.
    """
    want = min(want, room)
    if want <= 0:
        return base.select("name", F.array().cast("array<double>").alias("v")), 0
    k = min(room, max(2 * want, want + 8))
    noise = F.array(*[F.pmod(F.xxhash64("name", F.lit(seed + i)), F.lit(2_000_001)) / F.lit(1_000_000.0) - 1 for i in range(k)])
    x = materialize(base.select("name", "deg", "part", "unit", F.array().cast("array<double>").alias("p"), noise.alias("q")), "x")
    used = 0
    while True:
        x, used = _multiplied(x, edges, k, lambda s, p, q: s), used + 1
        g = _gram(x, k, parts)
        vu, wu = g[:k, 2 * k :], g[k : 2 * k, 2 * k :]
        vv, vw, ww = g[:k, :k] - vu @ vu.T, g[:k, k : 2 * k] - vu @ wu.T, g[k : 2 * k, k : 2 * k] - wu @ wu.T
        vw = (vw + vw.T) / 2
        scale = 1 / np.sqrt(np.maximum(np.diag(vv), 1e-300))
        w, y = np.linalg.eigh(scale[:, None] * vv * scale[None, :])
        good = w > w.max() * 1e-12
        white = scale[:, None] * y[:, good] / np.sqrt(w[good])
        theta, y = np.linalg.eigh(white.T @ vw @ white)
        theta, y = theta[::-1], (white @ y)[:, ::-1]
        rest = [float(np.sqrt(max(c @ (ww - 2 * t * vw + t * t * vv) @ c, 0.0))) for t, c in zip(theta[:want], y.T[:want], strict=True)]
        done = len(theta) >= want and max(rest) <= tol
        low = float(theta[-1])
        centre, half = (low - 1) / 2, max((1 + low) / 2, 1e-6)
        k = len(theta)
        x = _rotated(x, vu, wu, y, 0.0 if done else centre, 1.0 if done else half)
        if done:
            return x.select("name", F.col("p").alias("v")), want
        if used + FILTER > rounds:
            raise RuntimeError(f"the embedding did not settle within {rounds} rounds: residual {max(rest):.1e}")
        for _ in range(FILTER - 1):
            x, used = _multiplied(x, edges, k, lambda s, p, q: (s - centre * q) * (2 / half) - p), used + 1  # noqa: B023


def _multiplied(x: DataFrame, edges: DataFrame, k: int, step: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``p, q`` become ``q, step(A q, p, q)``."""
    root = 1 / F.sqrt(F.col("deg"))
    sent = x.select(F.col("name").alias("src"), F.transform("q", lambda v: v * root).alias("y"))
    sums = edges.join(sent, "src").groupBy(F.col("dst").alias("name")).agg(*[F.sum(F.col("y")[i]).alias(f"s{i}") for i in range(k)])
    fresh = F.array(*[step(F.col(f"s{i}") * root, F.col("p")[i], F.col("q")[i]) for i in range(k)])
    out = materialize(x.join(sums, "name").select("name", "deg", "part", "unit", F.col("q").alias("p"), fresh.alias("q")), "x")
    release(x)
    return out


def _block(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _gram(x: DataFrame, k: int, parts: int) -> np.ndarray:
    """The products of all pairs of columns of ``p``, ``q`` and the components' vectors."""
    width = 2 * k + parts

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for b in batches:
            if b.num_rows:
                units = np.zeros((b.num_rows, parts))
                units[np.arange(b.num_rows), b.column("part").to_numpy(zero_copy_only=False)] = b.column("unit").to_numpy(zero_copy_only=False)
                s = np.hstack([_block(b, "p"), _block(b, "q"), units])
                total += s.T @ s
        yield pa.RecordBatch.from_pydict({"g": [total.ravel().tolist()]})

    sums = x.select("p", "q", "part", "unit").mapInArrow(products, "g array<double>").select(F.posexplode("g")).groupBy("pos").agg(F.sum("col").alias("v"))
    out = np.zeros(width * width)
    for r in sums.collect():  # the square of some eighty columns
        out[r["pos"]] = r["v"]
    return out.reshape(width, width)


def _rotated(x: DataFrame, vu: np.ndarray, wu: np.ndarray, y: np.ndarray, centre: float, half: float) -> DataFrame:
    """``p`` without the components' vectors in the Ritz basis ``y``, and ``q``, its image, shifted and scaled."""

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                part, unit = (b.column(c).to_numpy(zero_copy_only=False) for c in ("part", "unit"))
                v, w = ((_block(b, c) - unit[:, None] * m.T[part]) @ y for c, m in (("p", vu), ("q", wu)))
                kept = {c: b.column(c) for c in ("name", "deg", "part", "unit")}
                yield pa.RecordBatch.from_pydict(kept | {"p": pa.array(list(v), pa.list_(pa.float64())), "q": pa.array(list((w - centre * v) / half), pa.list_(pa.float64()))})

    out = materialize(x.mapInArrow(turn, x.schema), "x")
    release(x)
    return out


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays in double precision; 0 where a norm is 0."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm > 0, dot(x, y) / norm).otherwise(0.0)
