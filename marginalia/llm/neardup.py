"""Near-duplicate texts with small edits, by b-bit MinHash.

Texts with the same set of word runs are one class and are searched once, through the class's smallest key. MinHash
minima give band keys, which nominate pairs; the low :data:`BITS` bits of every minimum are kept as a packed signature,
whose matching positions give a similarity corrected for chance agreement; pairs that survive are checked exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.components import connected_components
from marginalia.operators.orphans import bloom_size, bloom_words, might_contain
from marginalia.operators.state import latest
from marginalia.session import materialize

#: Bits kept of each minimum; standard deviations below the threshold at which an estimate is still checked exactly.
BITS, SLACK = 2, 4.0
#: A band key of more texts than this is not paired in place but compared block by block, HOT texts to a block.
HOT = 512
_WORD = re.compile(r"[^\W_]+")
_MASK = (1 << 64) - 1


class Scheme:
    """Shingle length, threshold and the banding for it: ``rows`` minima to a band, ``bands`` bands."""

    def __init__(self, words: int = 5, threshold: float = 0.8, rows: int = 5, bands: int = 20, seed: int = 5):
        self.words, self.threshold, self.rows, self.bands = words, threshold, rows, bands
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 31, rows * bands, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, rows * bands, dtype=np.uint32)

    @property
    def floor(self) -> float:
        """The least estimate that goes on to the exact check."""
        c = 2.0**-BITS
        p = c + (1 - c) * self.threshold
        return self.threshold - SLACK * float(np.sqrt(p * (1 - p) / len(self.a))) / (1 - c)

    def recall(self, similarity: float) -> float:
        """Chance that a pair of this similarity shares a band."""
        return 1 - (1 - similarity**self.rows) ** self.bands


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text."""
    return _WORD.findall((text or "").lower())


def runs(text: str | None, n: int) -> set[tuple[str, ...]]:
    w = words(text)
    return set(zip(*(w[i:] for i in range(n)), strict=False))


class _Hashes(dict):
    """64-bit hashes of words, kept between batches up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pack(minima: np.ndarray) -> np.ndarray:
    """Low bits of the minima (text, function) as bytes, all of a bit's plane together."""
    planes = [np.packbits((minima >> np.uint32(i)) & np.uint32(1), axis=1) for i in range(BITS)]
    return np.concatenate(planes, axis=1)


def estimate(x: np.ndarray, y: np.ndarray, functions: int) -> np.ndarray:
    """Similarity from packed signatures (rows of bytes): a position matches if all its bits do, and the chance rate
    ``2^-BITS`` of unequal minima is taken out."""
    width = x.shape[-1] // BITS
    differ = np.zeros(np.broadcast(x, y).shape[:-1] + (width,), np.uint8)
    for i in range(BITS):
        differ |= x[..., i * width : (i + 1) * width] ^ y[..., i * width : (i + 1) * width]
    c = 2.0**-BITS
    return ((functions - np.bitwise_count(differ).sum(-1, dtype=np.int32)) / functions - c) / (1 - c)


def _signatures(texts: list[str | None], scheme: Scheme, hashes: _Hashes):
    """Of the texts with at least one run: (position, runs, class hashes, packed signatures, band keys)."""
    codes = [list(map(hashes.__getitem__, words(t))) for t in texts]
    size = np.array([len(c) - scheme.words + 1 for c in codes])
    at = np.flatnonzero(size > 0)
    if not len(at):
        return at, None, None, None, None
    flat = np.fromiter((h for i in at for h in codes[i]), np.uint64)
    length = size[at] + scheme.words - 1
    start = np.r_[0, np.cumsum(length)[:-1]]
    doc = np.repeat(np.arange(len(at)), size[at])
    inner = np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(size[at])[:-1]], size[at])
    first = np.repeat(start, size[at]) + inner
    h = np.zeros(len(doc), np.uint64)
    for i in range(scheme.words):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + flat[first + i])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]
    h, doc = h[new], doc[new]
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    count = np.diff(np.r_[begin, len(doc)])
    c1, c2 = np.add.reduceat(_mix(h), begin), np.bitwise_xor.reduceat(_mix(h + np.uint64(77)), begin)
    x = (h >> np.uint64(32)).astype(np.uint32)
    minima = np.empty((len(at), len(scheme.a)), np.uint32)
    for k, (a, b) in enumerate(zip(scheme.a, scheme.b, strict=True)):
        minima[:, k] = np.minimum.reduceat(x * a + b, begin)
    grouped = minima.reshape(len(at), scheme.bands, scheme.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(scheme.bands, dtype=np.uint64), (len(at), scheme.bands))
    for i in range(scheme.rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + grouped[:, :, i])
    return at, count, (c1, c2), _pack(minima), key


def signatures(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """``tbl, id, seen, gone, n, c1, c2, sig, bands`` of every row of ``docs(tbl, id, seen, gone, text)``; texts too short
    for one run (nulls and empty ones too) have no signature but keep their row, so that they can supersede others."""
    head = ["tbl", "id", "seen", "gone"]
    names = [*head, "n", "c1", "c2", "sig", "bands"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                b = whole.slice(lo, 2000)
                at, n, c, sig, key = _signatures(b.column(4).to_pylist(), scheme, hashes)
                size = np.zeros(b.num_rows, np.int32)
                c1, c2 = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
                packed: list[bytes | None] = [None] * b.num_rows
                counts = np.zeros(b.num_rows, np.int32)
                flat = np.zeros(0, np.int64)
                if len(at):
                    size[at], c1[at], c2[at] = n, c[0].view(np.int64), c[1].view(np.int64)
                    counts[at] = scheme.bands
                    flat = np.ascontiguousarray(key).reshape(-1).view(np.int64)
                    for i, s in zip(at, sig, strict=True):
                        packed[i] = s.tobytes()
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                columns = [*b.columns[:4], pa.array(size), pa.array(c1), pa.array(c2), pa.array(packed, pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(columns, names)

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in head) + ", n int, c1 long, c2 long, sig binary, bands array<long>"
    return docs.select(*head, "text").mapInArrow(run, schema)


def _bucket_pairs(keyed: DataFrame) -> DataFrame:
    """``tbl, a, b`` (a < b) of texts that share a band key, each key's texts being sorted together in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        tables: list[str] = []
        code: dict[str, int] = {}

        def emit(t: np.ndarray, k: np.ndarray, i: np.ndarray) -> pa.RecordBatch:
            start = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
            size = np.diff(np.r_[start, len(k)])
            out = []
            for n in np.unique(size[size > 1]):
                rows = start[size == n][:, None] + np.arange(n)
                x, y = np.triu_indices(n, 1)
                members = np.sort(i[rows], axis=1)
                out.append((np.repeat(t[rows[:, 0]], len(x)), members[:, x].ravel(), members[:, y].ravel()))
            tt, a, b = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
            other = a != b
            names = pa.array(np.array(tables, dtype=object)[tt[other]] if len(tables) else [], pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(a[other], pa.int64()), pa.array(b[other], pa.int64())], ["tbl", "a", "b"])

        for batch in batches:
            for name in batch.column(0).unique().to_pylist():
                if name not in code:
                    code[name] = len(tables)
                    tables.append(name)
            t = np.array([code[x] for x in batch.column(0).to_pylist()])
            rows = np.stack([t, batch.column(1).to_numpy(), batch.column(2).to_numpy()])
            if not rows.shape[1]:
                continue
            held.append(rows)
            rows = np.concatenate(held, axis=1)
            changes = np.flatnonzero((rows[1, 1:] != rows[1, :-1]) | (rows[0, 1:] != rows[0, :-1]))
            if not len(changes):
                continue
            cut = changes[-1] + 1
            yield emit(*rows[:, :cut])
            held = [rows[:, cut:]]
        if held:
            yield emit(*np.concatenate(held, axis=1))

    spread = keyed.repartition("key", "tbl").sortWithinPartitions("tbl", "key")
    return spread.select("tbl", "key", "id").mapInArrow(run, "tbl string, a long, b long")


def _block_pairs(hot: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs of hot band keys whose estimate passes: each key's texts are cut into blocks, and every two blocks meet in
    one task of at most about two :data:`HOT` texts; nothing is left out."""
    sizes = hot.groupBy("tbl", "key").agg(F.ceil(F.count("*") / HOT).cast("int").alias("nb"))
    rows = hot.join(sizes, ["tbl", "key"]).withColumn("blk", F.pmod(F.xxhash64("id"), F.col("nb")).cast("int"))
    meets = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tasks = meets.select("tbl", "key", F.least("blk", "o").alias("x"), F.greatest("blk", "o").alias("y"), "blk", "id", "sig")

    def run(pdf):
        left = pdf[pdf["blk"] == pdf["x"].iat[0]]
        right = pdf[pdf["blk"] == pdf["y"].iat[0]]
        s = [np.frombuffer(b"".join(p["sig"]), np.uint8).reshape(len(p), -1) for p in (left, right)]
        a, b = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(a) or not len(b):
            return pdf[["tbl", "id"]].assign(b=0).head(0).set_axis(["tbl", "a", "b"], axis=1)
        found = [(np.full(m.sum(), a[i]), b[m]) for i in range(len(a)) if (m := (estimate(s[0][i], s[1], len(scheme.a)) >= scheme.floor) & (b != a[i])).any()]
        p, q = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (a[:0], a[:0])
        out = pdf[["tbl"]].head(1).reindex(np.zeros(len(p), int) + pdf.index[0])
        return out.assign(a=np.minimum(p, q), b=np.maximum(p, q)).drop_duplicates()

    return tasks.groupBy("tbl", "key", "x", "y").applyInPandas(run, "tbl string, a long, b long")


def classes(docs: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(``tbl, id, seen, n, c1, c2, sig, bands, rep`` of each text's state, the same of the representatives alone).

    The state of a key is its row of greatest ``seen``; states that are ``gone`` or have no run take no part.
    """
    sigs = materialize(signatures(docs, scheme), "signatures")
    state = latest(sigs, ["tbl", "id"], "seen", ["gone", "n", "c1", "c2", "sig", "bands"])
    state = materialize(state.where(~F.coalesce("gone", F.lit(False)) & (F.col("n") > 0)), "state")
    light = state.groupBy("tbl", "c1", "c2", "n").agg(F.min("id").alias("rep"))
    members = state.select("tbl", "id", "c1", "c2", "n").join(light, ["tbl", "c1", "c2", "n"]).select("tbl", "id", "rep")
    reps = state.join(light.select("tbl", F.col("rep").alias("id")), ["tbl", "id"], "left_semi")
    return members, reps


def candidate_pairs(reps: DataFrame, scheme: Scheme) -> DataFrame:
    """``tbl, a, b`` of representatives that share a band and whose estimate passes the scheme's floor.

    Band keys that a sample of the texts shows to be crowded are compared block by block; the sample only chooses the way.
    """
    keyed = reps.select("tbl", "id", "sig", F.explode("bands").alias("key"))
    seen = keyed.where(F.pmod(F.xxhash64("id"), F.lit(16)) == 0).groupBy("tbl", "key").agg(F.count("*").alias("c"))
    hot_keys = materialize(seen.where(F.col("c") * 16 > HOT).select("tbl", "key"), "hot")
    crowded = hot_keys.limit(1).count() > 0
    calm = keyed.join(hot_keys, ["tbl", "key"], "left_anti") if crowded else keyed
    pairs = _bucket_pairs(calm.select("tbl", "key", "id"))
    sig = reps.select("tbl", "id", "sig")
    found = pairs.distinct().join(sig.select("tbl", F.col("id").alias("a"), F.col("sig").alias("sa")), ["tbl", "a"])
    found = found.join(sig.select("tbl", F.col("id").alias("b"), F.col("sig").alias("sb")), ["tbl", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (3, 4))
            keep = pa.array(estimate(x, y, len(scheme.a)) >= scheme.floor)
            yield b.select(["tbl", "a", "b"]).filter(keep)

    passed = found.select("tbl", "a", "b", "sa", "sb").mapInArrow(run, "tbl string, a long, b long")
    if crowded:
        hot = keyed.join(hot_keys, ["tbl", "key"], "left_semi")
        passed = passed.unionByName(_block_pairs(hot, scheme)).distinct()
    return passed


def exact_pairs(pairs: DataFrame, docs: DataFrame, reps: DataFrame, scheme: Scheme) -> DataFrame:
    """``tbl, a, b, similarity`` of the pairs that reach the threshold on their whole texts.

    Only texts in a pair are read on: a Bloom filter of their keys, of bounded size, thins the scan before the join.
    """
    ends = pairs.select("tbl", F.explode(F.array("a", "b")).alias("id")).distinct()
    ends = materialize(ends.join(reps.select("tbl", "id", "seen"), ["tbl", "id"]), "ends")
    keyed = ends.withColumn("k", F.concat_ws(":", "tbl", "id"))
    bits = bloom_size(keyed.count())
    texts = docs.select("tbl", "id", "seen", "text")
    if bits:
        texts = texts.where(might_contain(bloom_words(keyed, "k", bits).scalar(), F.concat_ws(":", "tbl", "id"), bits))
    wanted = ends.withColumnRenamed("seen", "state_seen")
    held = texts.join(wanted, ["tbl", "id"]).where(F.col("seen").eqNullSafe(F.col("state_seen"))).groupBy("tbl", "id").agg(F.min("text").alias("text"))
    held = materialize(held, "texts")
    second = pairs.join(held.select("tbl", F.col("id").alias("b"), F.col("text").alias("tb")), ["tbl", "b"])
    both = second.join(held.select("tbl", F.col("id").alias("a"), F.col("text").alias("ta")), ["tbl", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[tuple, set] = ((), set())
        for batch in batches:
            similar = []
            for t, a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if last[0] != (t, a):
                    last = ((t, a), runs(x, scheme.words))
                other = runs(y, scheme.words)
                common = len(last[1] & other)
                every = len(last[1]) + len(other) - common
                # whole numbers, so that a pair exactly at the threshold counts
                similar.append(common / every if every and common * 1000 >= round(scheme.threshold * 1000) * every else None)
            s = pa.array(similar, pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], s], ["tbl", "a", "b", "similarity"]).filter(s.is_valid())

    return both.select("tbl", "a", "b", "ta", "tb").mapInArrow(run, "tbl string, a long, b long, similarity double")


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None) -> tuple[DataFrame, DataFrame]:
    """(``tbl, a, b, similarity`` between class representatives, ``tbl, id, rep``: every text's class).

    ``docs(tbl, id, seen, gone, text)`` may hold several rows of a key; the latest counts. Pairs stay within a ``tbl``.
    """
    scheme = scheme or Scheme()
    members, reps = classes(docs, scheme)
    members = materialize(members, "members")
    reps = materialize(reps, "reps")
    pairs = materialize(candidate_pairs(reps, scheme), "pairs")
    return materialize(exact_pairs(pairs, docs, reps, scheme), "links"), members


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """``tbl, id_a, id_b`` of all alike texts: classes spelled out, each pair once, smaller key first."""
    a = members.select("tbl", F.col("rep").alias("a"), F.col("id").alias("x"))
    b = members.select("tbl", F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.join(a, ["tbl", "a"]).join(b, ["tbl", "b"]).select("tbl", "x", "y")
    copied = members.where(F.col("id") != F.col("rep")).select("tbl", "rep").distinct()
    within = members.join(copied, ["tbl", "rep"], "left_semi")
    same = within.select("tbl", "rep", F.col("id").alias("x")).join(within.select("tbl", "rep", F.col("id").alias("y")), ["tbl", "rep"]).where("x < y")
    every = across.unionByName(same.select("tbl", "x", "y"))
    return every.select("tbl", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """``tbl, id, class_id, group_id, links``: each text's class of equal texts, its group of texts joined by links over
    any number of steps (the smallest key), and how many classes its own is linked with."""
    # zeros before the keys, so that the smallest text is the smallest key
    node = lambda c: F.concat("tbl", F.lit(":"), F.format_string("%020d", c))
    edges = links.select(node("a").alias("a"), node("b").alias("b"))
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"))
    parts = connected_components(ends, edges)
    degree = ends.groupBy("node").agg(F.count("*").alias("links"))
    group = F.coalesce(F.substring_index("component", ":", -1).cast("long"), F.col("rep"))
    return members.withColumn("node", node("rep")).join(parts, "node", "left").join(degree, "node", "left").select(
        "tbl", "id", F.col("rep").alias("class_id"), group.alias("group_id"), F.coalesce("links", F.lit(0).cast("long")).alias("links")
    )


def vault_texts(notes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Notes and chunks in one form; chunks have no time, their equal keys are settled by content."""
    n = notes.select(F.lit("notes").alias("tbl"), F.col("note_id").alias("id"), "seen_at", F.coalesce("deleted", F.lit(False)).alias("gone"), F.col("content").alias("text"))
    c = chunks.select(F.lit("chunks").alias("tbl"), "id", F.lit(None).cast(dict(notes.dtypes)["seen_at"]).alias("seen_at"), F.lit(False).alias("gone"), "text")
    return n.unionByName(c).withColumnRenamed("seen_at", "seen").where("id is not null")
