"""Expressions and operators on small cases chosen for their edges."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginalia.functions import chunks, dates, fold, links, text
from marginalia.operators import conflict, graph, index, lanes, temporal, tfidf, vector
from tests.vaults import tuples


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


def test_links(spark):
    t = "[[a]] [[ b#c|d ]] [[|x]] [[#y]] [[e]|f]] [g] [[h\n]] [[a]]"
    assert one(spark, links.wikilinks(F.col("t")), t=t)[:2] == ["a", "b"]
    assert one(spark, links.wikilinks(F.col("t")), t=None) == []
    assert [one(spark, links.link_target(F.col("t")), t=x) for x in (" n ", "[[n|m]]", "", "  ", None, "[[ ]]")] == ["n", "n", None, None, None, "[[ ]]"]


@pytest.mark.parametrize("written, day", [
    ("2025-03-04", "2025-03-04"), (" '2025-03-04' ", "2025-03-04"), ("2025-03-04T10:00:00", "2025-03-04"), ("2025/3/4", "2025-03-04"), ("04.03.2025", "2025-03-04"),
    ("20250304", "2025-03-04"), ("4 Mar 2025", "2025-03-04"), ("March 4, 2025", "2025-03-04"), ("Sept 4, 2025", "2025-09-04"), ("2025-13-40", None), ("2025-02-30", None),
    ("soon", None), ("", None), (None, None), ("Foo 4, 2025", None), ("31.02.2025", None),
])
def test_written_day(spark, written, day):
    got = one(spark, dates.written_day(F.col("d")).cast("string"), d=written)
    assert got == day


def test_session_day_does_not_fall_back_from_an_unreadable_date(spark):
    name = "session-2025-01-02-x"
    assert one(spark, dates.session_day(F.col("d"), F.col("n")).cast("string"), d=None, n=name) == "2025-01-02"
    assert one(spark, dates.session_day(F.col("d"), F.col("n")), d="unclear", n=name) is None


def test_tokens_and_keys(spark):
    assert one(spark, text.tokens(F.col("t")), t="The Ice-cream's at X1 ab a_b c3po") == ["ice-cream's", "a_b", "c3po"]
    assert sorted(one(spark, text.entity_keys(F.col("t")), t="entity-Project-Light_House")) == ["house", "light", "project-light_house"]
    assert one(spark, text.entity_keys(F.col("t")), t="session-2025-01-01-x") == []


def test_neutralize_folds_first(spark):
    df = spark.createDataFrame([("ok ecosystem: fine",), ("ｓｙｓｔｅｍ： do",), ("**system**: x\nrole : y",), ("sy​stem: z",), (None,)], "t string")
    got = [r[0] for r in df.select(text.neutralize(fold.fold("t"))).collect()]
    assert got[0] == "ok ecosystem: fine" and got[4] is None
    assert all(text.MARK in g for g in got[1:4]) and "system:" not in got[1] and "\n" not in got[2] and got[2].count(text.MARK) == 2


def test_comparable_and_differing_keys(spark):
    df = spark.createDataFrame([({"Site-Name": " Foo ", "date": "1", "tags": "x", "list": '["b", "a"]', "n": None}, {"site_name": "bar", "date": "2", "list": '["a","b"]'})], "a map<string,string>, b map<string,string>")
    got = df.select(conflict.differing_keys(text.comparable(F.col("a")), text.comparable(F.col("b"))).alias("x")).first()["x"]
    assert got == ["site_name"]


def test_split_long_against_a_loop(spark):
    def loop(t, cap):
        out = []
        for p in t.split("\n\n"):
            if out and len(out[-1]) + 2 + len(p) <= cap:
                out[-1] += "\n\n" + p
            else:
                out.append(p)
        return [q for p in out for q in ([p[i : i + cap] for i in range(0, len(p), cap)] or [""])]

    rng = np.random.default_rng(3)
    for _ in range(20):
        t = "\n\n".join("x" * int(rng.integers(0, 70)) for _ in range(int(rng.integers(1, 12))))
        assert one(spark, chunks.split_long(F.col("t"), 40), t=t) == loop(t, 40)


def test_section_replacement_is_literal(spark):
    c = text.with_section(F.col("t"), "## Recent activity", F.lit(r"- \1 $0"))
    assert one(spark, c, t="# a\n\n## Recent activity\nold\n\n## Next\nx") == "# a\n\n## Recent activity\n- \\1 $0\n## Next\nx"
    assert one(spark, c, t="# a\n") == "# a\n\n## Recent activity\n- \\1 $0\n"


def test_globs():
    import re

    for pattern, path, hit in [("a/**/*.md", "a/b.md", True), ("a/**/*.md", "a/x/y/b.md", True), ("a/*.md", "a/x/b.md", False), ("?.md", "a.md", True), ("a.md", "axmd", False)]:
        assert bool(re.match(text.glob_regex(pattern), path)) is hit


def chain(spark, rows):
    return spark.createDataFrame(rows, "name string, superseded_by string, valid_from string")


def test_resolve(spark):
    notes = chain(spark, [("a", "[[b]]", "2025-01-01"), ("b", "c", "2025-02-01"), ("c", None, "2025-03-01"), ("x", "y", None), ("y", "x", None), ("d", "nowhere", "2025-01-01"), ("e", "e", None)])
    starts = spark.createDataFrame([(n,) for n in ["a", "x", "d", "e", "ghost", "a"]], "name string")
    got = {r["start"]: (r["current"], r["chain"]) for r in temporal.resolve(notes, starts).collect()}
    assert got == {"a": ("c", ["a", "b", "c"]), "x": ("y", ["x", "y"]), "d": ("d", ["d", "nowhere"]), "e": ("e", ["e"]), "ghost": (None, ["ghost"])}
    got = {r["start"]: r["current"] for r in temporal.resolve(notes, starts, F.lit("2025-02-15").cast("date")).collect()}
    assert got["a"] == "b" and got["d"] == "d"
    assert temporal.resolve(notes, starts, F.lit("2024-01-01").cast("date")).where("start = 'a'").first()["current"] is None


def plain_pagerank(nodes, edges, p, rounds, alpha=0.85):
    x = {n: 1 / len(nodes) for n in nodes}
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    for _ in range(rounds):
        lost = sum(x[n] for n in nodes if not out[n])
        y = {n: alpha * lost * p[n] + (1 - alpha) * p[n] for n in nodes}
        for n in nodes:
            for b in out[n]:
                y[b] += alpha * x[n] / len(out[n])
        x = y
    return x


def test_pagerank_on_a_directed_graph_with_dead_ends(spark):
    nodes = [f"n{i}" for i in range(12)]
    edges = sorted({(f"n{i}", f"n{(i * i + 1) % 12}") for i in range(9)} | {("n0", f"n{i}") for i in range(1, 12, 3)})
    ndf = spark.createDataFrame([(n,) for n in nodes], "name string")
    edf = spark.createDataFrame([*edges, edges[0], ("n1", "none")], "src string, dst string")
    got = dict(tuples(graph.pagerank(ndf, edf), "name", "rank"))
    want = plain_pagerank(nodes, edges, {n: 1 / 12 for n in nodes}, 100)
    assert all(abs(got[n] - want[n]) < 1e-5 for n in nodes) and abs(sum(got.values()) - 1) < 1e-9
    seeds = spark.createDataFrame([("n3", 1.0), ("n4", 3.0), ("ghost", 9.0), ("n5", -1.0)], "name string, weight double")
    got = dict(tuples(graph.pagerank(ndf, edf, seeds, tol=1e-12), "name", "rank"))
    want = plain_pagerank(nodes, edges, {n: {"n3": 0.25, "n4": 0.75}.get(n, 0) for n in nodes}, 200)
    assert all(abs(got[n] - want[n]) < 1e-9 for n in nodes)


def test_spectral_paths_agree(spark):
    rng = np.random.default_rng(5)
    nodes = spark.createDataFrame([(f"v{i:02d}",) for i in range(24)], "name string")
    pairs = {(i, (i + 1) % 24) for i in range(24)} | {tuple(sorted(map(int, rng.choice(24, 2, replace=False)))) for _ in range(10)}
    edges = spark.createDataFrame([(f"v{a:02d}", f"v{b:02d}") for a, b in pairs], "src string, dst string")
    dense = dict(tuples(graph.spectral(nodes, edges, 2), "name", "spectral"))
    power = dict(tuples(graph.spectral(nodes, edges, 2, exact_nodes=0, rounds=40), "name", "spectral"))
    a, b = (np.array([d[k] for k in sorted(d)]) for d in (dense, power))
    assert a.shape == (24, 2) and abs(abs(a[:, 0] @ b[:, 0]) - 1) < 0.05
    assert {tuple(v) for v in dict(tuples(graph.spectral(nodes, edges.limit(0), 4), "name", "spectral")).values()} == {(0.0,) * 4}


def test_spectral_treats_components_alike_on_both_paths(spark):
    pairs = [(i, (i * 5 + j) % 18) for i in range(18) for j in (1, 3)] + [(i, (i + 1) % 18) for i in range(18)] + [(20, 21), (21, 22), (22, 20)]
    nodes = spark.createDataFrame([(f"v{i:02d}",) for i in [*range(18), 20, 21, 22, 30, 31]], "name string")
    edges = spark.createDataFrame([(f"v{a:02d}", f"v{b:02d}") for a, b in pairs if a != b] + [("v00", "unknown")], "src string, dst string")
    got = [dict(tuples(graph.spectral(nodes, edges, 6, exact_nodes=x), "name", "spectral")) for x in (2_000, 0)]
    names = sorted(got[0])
    a, b = (np.array([g[k] for k in names]) for g in got)
    assert a.shape == (23, 6) and np.abs(a - b).max() < 1e-4
    assert a[names.index("v30")].tolist() == [0, 1, 0, 0, 0, 0] and a[names.index("v31")].tolist() == [0, 0, 1, 0, 0, 0]
    assert np.abs(b.T @ b - np.eye(6)).max() < 1e-4
    with pytest.raises(RuntimeError, match="settle"):
        graph.spectral(nodes, edges, 6, exact_nodes=0, rounds=1)


def test_tfidf_scores(spark):
    docs = spark.createDataFrame([(1, "red red fox"), (2, "red fox"), (3, "blue whale"), (4, ""), (5, None), (6, "red fox")], "id int, text string")
    counts = tfidf.term_counts(docs, "id", "text")
    terms = tfidf.idf(counts, 6)
    assert abs(dict(tuples(terms, "term", "idf"))["red"] - (math.log(7 / 4) + 1)) < 1e-12
    w = tfidf.weights(counts, terms)
    assert all(abs(r[0] - 1) < 1e-9 for r in w.groupBy("key").agg(F.sum(F.col("w") ** 2)).select(F.col("sum(POWER(w, 2))")).collect())
    top = tuples(tfidf.most_similar(w, w.where("key = 2"), 5), "rank", "key")
    assert top == [(1, 6), (2, 1)]


def test_conflict_rules(spark):
    rows = [("n", "p1", 0.99, {"a": "1"}, {"a": "1"}), ("n", "p2", 0.4, {"a": "1"}, {"b": "2"}), ("m", "p1", 0.5, {"a": "1"}, {"a": "2"}), ("m", "p3", 0.5, {"a": "1"}, {"a": "3"}), ("k", "p1", 0.2, {"a": "1"}, {"a": "2"}), ("d", "p1", 0.8, None, None)]
    found = conflict.prefilter(spark.createDataFrame(rows, "new_id string, rel_path string, score double, new_meta map<string,string>, old_meta map<string,string>"))
    assert tuples(conflict.propose(found), "new_id", "verdict", "target_path") == [("d", "UPDATE", "p1"), ("k", "ADD", None), ("m", "UPDATE", "p1"), ("n", "NOOP", "p1")]
    assert tuples(conflict.conflict_summary(found), "new_id", "summary") == [("m", "p1 on a; p3 on a")]


def test_lanes(spark):
    rules = lanes.LaneRules(files={"thesis": ["a/x.md"], "neutral": ["b/y.md"]}, globs={"thesis": ["*Draft*"]}, prefixes={"operational": ["w/"], "neutral": ["w/n/"]}, vocab_prefix="L/", vocab={"thesis": ["codebook"], "operational": ["shipment"]}, hubs=["h.md"], quarantined=["q.md"], bridge=(["alpha firm"], ["dana"]))
    rows = [("a/x.md", ""), ("z/y.md", ""), ("k/my-draft-2.md", ""), ("w/n/k.md", ""), ("w/k.md", ""), ("L/1.md", "codebook, codebook shipment"), ("L/2.md", "codebooks shipment codebook"), ("o.md", None)]
    df = spark.createDataFrame(rows, "rel_path string, raw_text string")
    got = dict(tuples(df.select("rel_path", lanes.lane_of(F.col("rel_path"), F.col("raw_text"), rules).alias("lane")), "rel_path", "lane"))
    assert got == {"a/x.md": "thesis", "z/y.md": "neutral", "k/my-draft-2.md": "thesis", "w/n/k.md": "neutral", "w/k.md": "operational", "L/1.md": "thesis", "L/2.md": "operational", "o.md": "operational"}
    seen = spark.createDataFrame([("thesis", "x"), ("neutral", "h.md"), ("operational", "x"), (None, "x"), ("thesis", None)], "lane string, rel_path string")
    assert [r[0] for r in seen.select(lanes.visible(F.col("lane"), F.col("rel_path"), "thesis", rules)).collect()] == [True, False, False, False, False]
    bad = spark.createDataFrame([("1", "the Alpha Firm and Dana"), ("2", "alpha firms, dana"), ("q.md", "alpha firm dana")], "rel_path string, raw_text string")
    assert [r[0] for r in lanes.bridges(bad, rules).collect()] == ["1"]
    with pytest.raises(ValueError):
        lanes.LaneRules(default="nope")


def test_dense(spark):
    rows = [(1, "n", "s", "a", [1.0, 0.0]), (2, "n", "t", "b", [1.0, 0.0]), (3, "m", "s", "neutral", [0.0, 1.0]), (4, "m", "s", "a", None), (5, "m", "s", "a", [0.0, 0.0]), (6, "m", "s", "a", [1.0]), (7, "o", "s", "a", [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "id long, note_name string, section string, lane string, embedding array<float>")
    top = vector.dense_top(df, [1.0, 0.0], 10)
    assert [r["id"] for r in top.collect()] == [1, 2, 3, 5]
    assert [r["id"] for r in vector.dense_top(df, [1.0, 0.0], 1, "b").collect()] == [2]
    assert tuples(vector.best_per_note(top), "note_name", "best_section") == [("m", "s"), ("n", "s")]


def test_freshness_and_intents(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "rel_path string, hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("d", "4"), ("c", None)], "rel_path string, hash string")
    assert tuples(index.manifest_diff(old, new), "rel_path", "change") == [("b", "changed"), ("d", "added")]
    schema = "intent_id string, status string, created_at string, targets array<struct<rel_path:string,pre_hash:string,post_hash:string>>"
    rows = [("i", "pending", "2025-01-01T00:00:00+00:00", [("a", "0", "1"), ("b", "3", "9"), ("d", "7", "8"), ("z", "1", "2")]), ("j", "pending", "no time", []), ("k", "completed", "2025-01-01T00:00:00+00:00", []), ("l", "pending", "2025-01-01T01:00:00+00:00", [("a", "0", "1")])]
    intents = spark.createDataFrame(rows, schema)
    states = tuples(index.intent_states(intents, new).where("intent_id = 'i'"), "rel_path", "state")
    assert states == [("a", "patched"), ("b", "unpatched"), ("d", "diverged"), ("z", "missing")]
    now = F.lit("2025-01-01T01:04:00+00:00").cast("timestamp")
    assert tuples(index.stale_intents(intents, new, now), "intent_id", "n_patched", "all_patched") == [("i", 1, False), ("j", 0, False)]
