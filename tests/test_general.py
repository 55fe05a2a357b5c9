"""Orphan references, histories and as-of attributes against their plain definitions, and in awkward shapes."""

import duckdb
import pytest
from pyspark.sql import functions as F

from marginalia.operators import asof, components, history, orphans, versions
from tests import brute
from tests.vaults import dirty_vault, table, tuples

D = "/root/testdata/sf0.001"
COLUMNS = ["note_id", "name", "content", "touches", "valid_from", "superseded_by", "date", "deleted", "seen_at"]


def _rows(name):
    return [dict(zip(COLUMNS, r, strict=True)) for r in duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM '{D}/{name}.parquet'").fetchall()]


@pytest.fixture(scope="module")
def real(spark):
    read = lambda t: spark.read.parquet(f"{D}/{t}.parquet")
    return read("notes"), read("seed_notes"), _rows("notes"), _rows("seed_notes")


@pytest.fixture(scope="module")
def dirty(spark):
    notes, seeds, a, s = dirty_vault(spark)
    return notes, seeds, [r for r in a if r["name"] is not None], s


@pytest.mark.parametrize("which", ["real", "dirty"])
def test_orphans(request, which):
    notes, seeds, a, s = request.getfixturevalue(which)
    got = set(tuples(orphans.orphan_references(notes, seeds), "note_id", "ref_field", "target", "state"))
    if which == "dirty":
        assert (10, "content", "gone", "missing") in got  # a note without a name still refers
        got.discard((10, "content", "gone", "missing"))
    assert got == brute.orphans(a, s)


@pytest.mark.parametrize("which", ["real", "dirty"])
def test_versions(request, which):
    notes, seeds, a, s = request.getfixturevalue(which)
    members = versions.entity_members(versions.entity_states(versions.entity_log(notes, seeds)))
    got = tuples(versions.entity_versions(members), "entity", "version", "valid_from", "valid_to")
    assert set(got) == brute.versions(a, s) and len(got) == len(set(got))


@pytest.mark.parametrize("which", ["real", "dirty"])
def test_as_known(request, which):
    notes, seeds, a, s = request.getfixturevalue(which)
    got = tuples(asof.session_entity_versions(notes, seeds), "note_id", "entity", "version")
    assert set(got) == brute.as_known(a, s) and len(got) == len(set(got))


def test_empty_tables(spark):
    none = table(spark, [])
    assert orphans.orphan_references(none, none).count() == 0
    assert versions.entity_versions(versions.entity_members(versions.entity_states(versions.entity_log(none, none)))).count() == 0
    assert asof.session_entity_versions(none, none).count() == 0


def test_bloom_has_no_false_negative_and_few_positives(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    refs = spark.range(40_000).select(F.col("id").cast("string").alias("t"))
    definite, positive = orphans.split_references(refs, "t", keys, "k")
    assert definite.where(F.col("t").cast("long") < 20_000).count() == 0
    assert positive.count() < 20_000 + 1_000
    assert orphans.bloom_size(10**9) == 0


def test_changed_leaves_are_few(spark):
    log = spark.range(5_000).select("id", (F.col("id") * 2).alias("v"), F.lit("2025-01-01").cast("timestamp_ntz").alias("t"))
    again = log.where("id % 2 = 0").withColumn("t", F.lit("2025-02-01").cast("timestamp_ntz"))  # the same state once more
    log = log.unionByName(again).unionByName(spark.createDataFrame([(7, 1)], "id long, v long").withColumn("t", F.lit("2025-03-01").cast("timestamp_ntz")))
    depth = history.tree_depth(5_000)
    marked = history._marked(log, ["id"], ["v"], "t", 7, depth)
    levels = history.merkle_levels(history.period_states(marked, ["id"], "t"), depth)
    changed = history.changed_leaves(levels)
    cuts = dict(tuples(changed.groupBy("__cut").agg(F.count("*").alias("n")), "__cut", "n"))
    assert depth == 3 and len(levels) == 4 and levels[0].count() == 3
    assert list(cuts.values())[1:] == [1] and len(cuts) == 2  # nothing of February differs, one leaf of March does
    read = marked.join(changed, ["__cut", "__leaf"], "left_semi").count()
    assert read == 5_001 and history.tree_depth(10**9) > history.tree_depth(10**6) > 1


def test_every_change_comes_out_between_cuts(spark):
    rows = [
        (1, "a", None, "2025-01-03"), (1, "b", None, "2025-02-03"), (1, "b", None, "2025-02-09"), (1, "a", None, "2025-03-01"),  # undone before the first cut
        (2, "x", "no", "2025-01-05"), (2, "x", "yes", "2025-08-01"), (2, "x", "no", "2025-08-02"),  # gone and back between two cuts
        (3, "q", None, "2025-01-01"), (3, None, "q", "2025-09-01"), (3, None, "q", "2026-03-01"), (4, "late", None, "2026-02-02"), (5, "n", None, None),
    ]
    log = spark.createDataFrame([*rows, *rows[:3]], "k int, v string, u string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    h = history.merkle_changes(log, ["k"], ["v", "u"], "t", 180)
    got = h.select("k", "v", "u", F.col("t").cast("date").cast("string").alias("f"), F.col("until").cast("date").cast("string").alias("e"), "open").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [
        (1, "a", None, "2025-01-03", "2025-02-03", False), (1, "b", None, "2025-02-03", "2025-03-01", False), (1, "a", None, "2025-03-01", None, True),
        (2, "x", "no", "2025-01-05", "2025-08-01", False), (2, "x", "yes", "2025-08-01", "2025-08-02", False), (2, "x", "no", "2025-08-02", None, True),
        (3, "q", None, "2025-01-01", "2025-09-01", False), (3, None, "q", "2025-09-01", None, True), (4, "late", None, "2026-02-02", None, True),
    ]))
    assert history.merkle_changes(log.limit(0), ["k"], ["v", "u"], "t").columns == h.columns


def test_p4_history_against_replay(spark, real):
    _, _, a, s = real
    want, logs = [], {}
    for src, rows in ((0, a), (1, s)):
        for r in rows:
            if (r["name"] or "").startswith("entity-"):
                logs.setdefault((src, r["note_id"]), []).append((r["seen_at"], (r["name"], r["valid_from"], r["superseded_by"], r["deleted"])))
    for key, seen in logs.items():
        seen.sort(key=lambda x: x[0])
        new = [x for i, x in enumerate(seen) if not i or x[1] != seen[i - 1][1]]
        want += [(*key, *v, at, new[i + 1][0] if i + 1 < len(new) else None) for i, (at, v) in enumerate(new)]
    h = history.merkle_changes(versions.entity_log(*real[:2]), ["src", "note_id"], ["name", "valid_from", "superseded_by", "deleted"], "seen_at")
    got = [tuple(r)[:-1] for r in h.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) > len(logs)


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]
    star = [("hub", f"s{i}") for i in range(200)]
    edges = spark.createDataFrame([*chain, *star, ("x", "x"), ("x", None), ("hub", "s1")], "a string, b string")
    nodes = spark.createDataFrame([(x,) for x in sorted({n for e in chain + star for n in e} | {"x", "y"})], "node string")
    got = dict(tuples(components.connected_components(nodes, edges), "node", "component"))
    assert {got[n] for e in chain for n in e} == {"000"} and {got[n] for e in star for n in e} == {"hub"}
    assert got["x"] == "x" and got["y"] == "y"


def test_dyadic_nodes_hold_exactly_the_interval(spark):
    spans = [(0, 1), (3, 11), (5, 5), (7, 6), (0, asof.END_OF_TIME), (100, 164), (65535, 65536)]
    df = spark.createDataFrame(spans, "s int, e int").select("s", "e", asof.interval_nodes(F.col("s"), F.col("e")).alias("n"))
    for r in df.collect():
        days = sorted(d for k, b in r["n"] for d in range(b << k, (b + 1) << k))
        assert days == list(range(r["s"], r["e"]))
        assert len(r["n"]) <= 2 * asof.LEVELS


def test_as_of_precedence_and_hot_key(spark):
    events = spark.range(3_000).select(F.lit("hot").alias("k"), (F.col("id") % 50).cast("int").alias("day"))
    rows = [("hot", s, asof.END_OF_TIME, s, n) for s in range(0, 50, 5) for n in ("a", "b")] + [("hot", 60, 70, 10, "late"), ("cold", 0, 9, 0, "c")]
    intervals = spark.createDataFrame(rows, "k string, start int, end int, valid int, name string")
    got = tuples(asof.as_of(events, intervals, "k", ["valid", "name"], ["valid", "name"]), "day", "valid", "name")
    assert got == [(d, d - d % 5, "b") for d in range(50)]


def test_days_outside_the_tree_are_compared_as_they_are(spark):
    events = spark.createDataFrame([("k", -400), ("k", -10), ("k", 70_000), ("k", 5)], "k string, day int")
    rows = [("k", 0, asof.END_OF_TIME, v, n) for v, n in ((-500, "z"), (-100, "a"), (-9, "b"), (69_000, "late"), (80_000, "never"))]
    intervals = spark.createDataFrame(rows, "k string, start int, end int, valid int, name string")
    assert tuples(asof.as_of(events, intervals, "k", ["valid", "name"], ["name"]), "day", "name") == [(-400, "z"), (-10, "a"), (5, "b"), (70_000, "late")]
