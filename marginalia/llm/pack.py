"""Filling fixed-capacity containers by bin completion, in independent groups of items.

Items are spread over groups by a hash of their key; each group is packed by branch and bound. A node takes the largest
item left and tries the undominated ways to fill the rest of its container, least waste first; it is cut off when the
waste so far leaves no room for fewer containers than the incumbent, which starts as the best-fit solution.

One filling dominates another if the other's items can be grouped so that each group fits under an item of the first:
whatever the rest of a solution with the other looks like, those groups can change places with the items over them.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.session import materialize

#: Items in a group, on average, and steps a group's search may take before it keeps its incumbent.
GROUP, NODES = 4_000, 300_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items in each container."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), in order
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(room, (free - sizes[i], b))
    return bins


def least_containers(sizes: list[int], capacity: int) -> int:
    """Lower bound: the total, and items over half the capacity, which never share, with those of at least a size that
    cannot join the large ones (the L2 bound over the sizes that occur)."""
    s = sorted(sizes)
    prefix = [0]
    for x in s:
        prefix.append(prefix[-1] + x)
    best = -(-prefix[-1] // capacity)
    half = bisect_right(s, capacity // 2)
    for alpha in {0, *(x for x in s[:half])}:
        full = bisect_right(s, capacity - alpha)
        low = bisect_left(s, alpha)
        middle, small = prefix[full] - prefix[half], prefix[half] - prefix[low]
        spare = (full - half) * capacity - middle
        best = max(best, len(s) - half + max(0, -(-(small - spare) // capacity)))
    return best


def _under(items: tuple[int, ...], over: tuple[int, ...]) -> bool:
    """Whether ``items`` (largest first) can be grouped under ``over``; best fit decides, so a yes is certain, a no is not."""
    room = sorted(over)
    for x in items:
        at = bisect_left(room, x)
        if at == len(room):
            return False
        insort(room, room.pop(at) - x)
    return True


def _fillings(counts: dict[int, int], order: list[int], room: int, waste: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated sets of sizes that leave at most ``waste`` of ``room`` free, least waste first, then largest sizes first.
    Made on demand; every size looked at and every set compared draws on ``budget``.

    ``order`` holds the sizes left, ascending. ``sums[i]`` has a bit for every total the first ``i`` sizes can make, so no
    branch is entered that does not end in a set.
    """
    order = order[: bisect_right(order, room)]
    sums, mask = [1], (1 << (room + 1)) - 1
    for x in order:
        made, part = sums[-1], sums[-1]
        for _ in range(min(counts[x], room // x)):
            part = (part << x) & mask
            made |= part
        sums.append(made)
    kept: list[tuple[int, ...]] = []
    for total in range(room, max(room - waste, 0) - 1, -1):
        if not sums[-1] >> total & 1:
            continue
        stack = [((), total, len(order))]
        while stack and budget[0] > 0:
            chosen, left, at = stack.pop()
            budget[0] -= 1
            if not left:
                budget[0] -= len(kept)
                if not any(_under(chosen, k) for k in kept):
                    kept.append(chosen)
                    yield chosen
                continue
            x = order[at - 1]
            if sums[at - 1] >> left & 1:
                stack.append((chosen, left, at - 1))
            for n in range(1, min(counts[x], left // x) + 1):
                if sums[at - 1] >> (left - n * x) & 1:
                    stack.append((chosen + (x,) * n, left - n * x, at - 1))


def pack(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Containers as lists of item indices; no item may exceed the capacity. Optimal where the lower bound is met (mostly at
    once) or the search ends within ``nodes`` steps, otherwise the best solution seen."""
    best = best_fit(sizes, capacity)
    bound = least_containers(sizes, capacity)
    if len(best) <= bound:
        return best
    total = sum(sizes)
    by_size: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        by_size.setdefault(s, []).append(i)
    counts = {s: len(v) for s, v in by_size.items()}
    budget = [nodes]
    # depth-first with an explicit stack: one frame per container, holding the fillings still to try
    chosen: list[tuple[int, ...]] = []
    frames: list[tuple] = []

    def allowed() -> int:
        return (len(best) - 1) * capacity - total

    def open_frame(spent: int) -> None:
        order = sorted(s for s, n in counts.items() if n and s)
        if not order:
            frames.append((0, iter(()), spent))
            return
        big = order[-1]
        left = dict(counts)
        left[big] -= 1
        rest = [s for s in order if left[s]]
        frames.append((big, _fillings(left, rest, capacity - big, max(0, allowed() - spent), budget), spent))

    open_frame(0)
    while frames:
        big, options, spent = frames[-1]
        done = big == 0
        if done:
            rest = {s: list(v) for s, v in by_size.items()}
            best = [[rest[s].pop() for s in f] for f in chosen]
            for i in by_size.get(0, []):
                best[0].append(i)
            if len(best) <= bound:
                return best
        option = None if done else next(options, None)
        if option is not None:
            fill = (big, *option)
            waste = capacity - sum(fill)
            if spent + waste > allowed():
                continue
            for s in fill:
                counts[s] -= 1
            chosen.append(fill)
            open_frame(spent + waste)
            continue
        frames.pop()
        if frames:
            for s in chosen.pop():
                counts[s] += 1
        if budget[0] <= 0:
            break
    return best


def fill_containers(sized: DataFrame, key: str, tokens: str, capacity: int = 2048, group: int = GROUP, nodes: int = NODES) -> DataFrame:
    """``container, key, part, start, tokens``: where each part of each item went.

    Only an item over the capacity is split: into full containers of its own and one rest that is packed like others.
    Items without a key or size are left out; items of size 0 join a container (one of their own if nothing else is
    there). A key that repeats counts as often as it is given. Groups are even whatever the keys, being hashed by item.
    """
    rows = sized.where(F.col(key).isNotNull() & (F.col(tokens) >= 0)).select(F.col(key).alias("key"), F.col(tokens).cast("long").alias("size"))
    full = F.floor(F.col("size") / capacity).cast("int")
    rest = F.col("size") - full * capacity
    own = rows.where(full > 0).select("key", "size", F.explode(F.sequence(F.lit(0), full - 1)).alias("part"))
    whole = own.select(
        F.concat(F.lit("w-"), F.col("key").cast("string"), F.lit("-"), "part", F.lit("-"), F.row_number().over(_same()).cast("string")).alias("container"),
        "key", "part", (F.col("part").cast("long") * capacity).alias("start"), F.lit(capacity).cast("long").alias("tokens"),
    )
    items = materialize(rows.where((rest > 0) | (full == 0)).select("key", full.alias("part"), (full.cast("long") * capacity).alias("start"), rest.alias("tokens")), "items")
    groups = max(1, round(items.count() / group))
    spread = items.withColumn("g", F.pmod(F.xxhash64("key", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "key", "part"], ascending=[False, True, True], ignore_index=True)
        slot = [""] * len(pdf)
        for b, members in enumerate(pack(pdf["tokens"].tolist(), capacity, nodes)):
            for i in members:
                slot[i] = f"g-{pdf['g'].iat[0]}-{b}"
        return pdf.assign(container=slot)[["container", "key", "part", "start", "tokens"]]

    kind = dict(rows.dtypes)["key"]
    packed = spread.groupBy("g").applyInPandas(run, f"container string, key {kind}, part int, start long, tokens long")
    return whole.unionByName(packed).withColumnRenamed("key", key)


def _same():
    from pyspark.sql import Window

    return Window.partitionBy("key", "part").orderBy("size")


def container_report(filled: DataFrame, capacity: int = 2048) -> DataFrame:
    """``container, n_parts, filled, free`` of every container."""
    return filled.groupBy("container").agg(F.count("*").alias("n_parts"), F.sum("tokens").alias("filled")).withColumn("free", F.lit(capacity) - F.col("filled"))
