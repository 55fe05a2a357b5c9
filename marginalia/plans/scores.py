"""Measuring retrieval on probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.text import NAME_STOP_WORDS
from marginalia.operators.orphans import parent_test
from marginalia.session import materialize

#: Fixed value: the least keyword score that is evidence.
CONFIDENT = 2.0


def unknown_gold(probes: DataFrame, notes: DataFrame) -> DataFrame:
    """Gold names no note has; must be empty before anything is scored."""
    return probes.select("id", F.explode("gold").alias("name")).join(notes.select("name"), "name", "left_anti")


#: Meetings of probes and notes over one word from which on the word is scored once per set of such words, not per probe.
CROWD = 20_000


def keyword_hits(probes: DataFrame, notes: DataFrame, k: int = 8, texts: DataFrame | None = None) -> DataFrame:
    """``id, name, score, rank``: a point per distinct query word that stands in the text as a whole word, half a
    point more if the name holds it. Texts are turned into words once and meet the queries on equal words; words no query
    asks for are dropped where texts are read. See :func:`_best` for words that many probes ask for and many notes hold.

    ``notes`` has ``name, raw_text``. Or ``notes(name, row)`` and ``texts(row, raw_text)``: a note's text is that of the rows
    of equal ``row`` (a struct may hold nulls), other rows count for nothing. Then texts may be a whole log: none is shuffled.
    """
    word = F.regexp_extract_all(F.lower("query"), F.lit("([a-z0-9]{3,})"), F.lit(1))
    asked = probes.select("id", F.explode(F.array_distinct(word)).alias("word")).where(~F.col("word").isin(NAME_STOP_WORDS)).distinct()
    asked = materialize(asked, "asked")
    wanted = materialize(asked.select("word").distinct().withColumn("w", F.monotonically_increasing_id()), "wanted")
    is_wanted = parent_test(wanted, "word")
    key = "name" if texts is None else "row"
    names = notes.select(*dict.fromkeys(("name", key))).distinct().orderBy("name").withColumn("n", F.monotonically_increasing_id())
    names = materialize(names, "names")  # in order of name
    words = F.array_distinct(F.regexp_extract_all(F.lower("raw_text"), F.lit("([a-z0-9]+)"), F.lit(1)))
    held = (notes if texts is None else texts).select(key, F.explode(words).alias("word")).where(is_wanted(F.col("word")))
    # a word is part of a name if it is a substring of one of its runs; the substrings of a name are few, and join on equality
    runs = F.regexp_extract_all(F.lower("name"), F.lit("([a-z0-9]{3,})"), F.lit(1))
    longest = F.lit(max(wanted.agg(F.max(F.length("word"))).first()[0] or 0, 3))
    inner = F.transform(runs, lambda r: F.flatten(F.transform(F.sequence(F.lit(3), F.least(F.length(r), longest)), lambda n: F.transform(F.sequence(F.lit(1), F.length(r) - n + 1), lambda i: F.substring(r, i, n)))))
    parts = names.select("n", F.explode(F.array_distinct(F.flatten(inner))).alias("word")).where(is_wanted(F.col("word")))
    either = held.join(names, key).select("n", "word", F.lit(True).alias("in_text")).unionByName(parts.withColumn("in_text", F.lit(False)))
    p = F.max(F.when(F.col("in_text"), 1.0).otherwise(0.0)) + F.max(F.when(F.col("in_text"), 0.0).otherwise(0.5))
    points = either.groupBy("n", "word").agg(p.alias("p")).join(wanted, "word").select("w", "n", "p")
    points = materialize(points, "points")
    best = _best(asked.join(wanted, "word").select(F.col("id").alias("q"), "w"), points, k, CROWD)
    return best.join(names, "n").select(F.col("q").alias("id"), "name", "score", "rank")


def _best(asked: DataFrame, points: DataFrame, k: int, crowd: int) -> DataFrame:
    """``q, n, score, rank``: the ``k`` notes of most points for each query of ``asked(q, w)``, ties in order of ``n``;
    ``points(w, n, p)`` has what the word ``w`` is worth in note ``n``. Both have a row once.

    Words of more than ``crowd`` meetings would pair nearly all queries and notes. Queries are told apart by which such words
    they ask for, and the best notes of each set are found in the same way, with a higher limit. A note that has none of a
    query's other words only counts if it is among the set's best ``k``: what keeps it out of those is at least as good
    for the query. For the same reason a note that has one must reach the points of the set's last, all that its other words
    can add included; what it has of the crowded words travels with each of its postings, so that nothing else is paired
    at length. Nothing is left out.
    """
    order = Window.partitionBy("q").orderBy(F.desc("score"), "n")

    def first(scored: DataFrame) -> DataFrame:
        return materialize(scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")

    met = points.groupBy("w").agg(F.count("*").alias("n_notes"), F.max("p").alias("most")).join(asked.groupBy("w").agg(F.count("*").alias("n_asked")), "w")
    met = materialize(met.select("w", "most", (F.col("n_notes") * F.col("n_asked")).alias("meetings")), "met")
    least, greatest = met.agg(F.min("meetings"), F.max("meetings")).first()
    crowd = max(crowd, least or 0)  # some word is taken out each time
    if (greatest or 0) <= crowd:
        return first(asked.join(points, "w").groupBy("q", "n").agg(F.sum("p").alias("score")))

    crowded, others = met.where(F.col("meetings") > crowd).select("w"), met.where(F.col("meetings") <= crowd).select("w", "most")
    per = asked.join(crowded, "w").groupBy("q").agg(F.sort_array(F.collect_list("w")).alias("ws"))  # a query's own words
    per = materialize(per, "per")
    sets = materialize(per.select("ws").distinct().withColumn("kind", F.monotonically_increasing_id()), "sets")
    common = materialize(points.join(crowded, "w"), "common")
    best = _best(sets.select(F.col("kind").alias("q"), F.explode("ws").alias("w")), common, k, 10 * crowd)
    reach = best.groupBy(F.col("q").alias("kind")).agg(F.when(F.count("*") == k, F.min("score")).alias("reach"))
    kinds = materialize(per.join(sets.join(reach, "kind", "left"), "ws"), "kinds")

    more = F.map_from_entries(F.collect_list(F.struct("w", "p"))).alias("more")
    posted = points.join(others.select("w"), "w").join(common.groupBy("n").agg(more), "n", "left")
    rest = asked.join(others, "w")
    rest = rest.join(rest.groupBy("q").agg(F.sum("most").alias("all")), "q").join(kinds, "q", "left").select("q", "w", "ws", "reach", (F.col("all") - F.col("most")).alias("add"))
    has = F.coalesce(F.aggregate("ws", F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at("more", w), F.lit(0.0))), F.lit(0.0))
    pairs = rest.join(posted, "w").select("q", "n", "p", has.alias("has"), "reach", "add").where(F.coalesce(F.col("p") + F.col("has") + F.col("add") >= F.col("reach"), F.lit(True)))
    known = pairs.groupBy("q", "n").agg((F.sum("p") + F.max("has")).alias("score"))
    shared = kinds.select("q", "kind").join(best.select(F.col("q").alias("kind"), "n", "score"), "kind").select("q", "n", "score")
    return first(known.unionByName(shared).groupBy("q", "n").agg(F.max("score").alias("score")))


def judge(probes: DataFrame, hits: DataFrame, abstained: DataFrame | None = None) -> DataFrame:
    """``id, category, n_retrieved, abstained, hit, recall, rr, passed`` per probe from ``hits(id, name, score,
    rank)``. ``abstained(id)`` names the probes the retriever abstained from; without it those without a hit of
    :data:`CONFIDENT` are. An abstention probe passes if it is abstained from, others on any hit. ``hits`` is read twice: pass
    a table that is kept."""
    got = hits.groupBy("id").agg(F.count("*").alias("n_retrieved"), F.max("score").alias("best"))
    gold = probes.select("id", F.explode("gold").alias("name")).distinct()
    found = gold.join(hits, ["id", "name"]).groupBy("id").agg(F.count("*").alias("n_found"), F.min("rank").alias("first"))
    rows = probes.join(got, "id", "left").join(found, "id", "left")
    if abstained is None:
        silent = F.coalesce(F.col("best") < CONFIDENT, F.lit(True))
    else:
        rows = rows.join(abstained.select("id").distinct().withColumn("silent", F.lit(True)), "id", "left")
        silent = F.coalesce("silent", F.lit(False))
    n_gold = F.size(F.array_distinct("gold"))
    hit = F.coalesce(F.col("n_found") > 0, F.lit(False))
    passed = F.when(F.col("category") == "abstention", silent).otherwise(hit)
    return rows.select(
        "id", "category", F.coalesce("n_retrieved", F.lit(0)).cast("bigint").alias("n_retrieved"), silent.alias("abstained"), hit.alias("hit"),
        F.when(n_gold > 0, F.coalesce("n_found", F.lit(0)) / n_gold).otherwise(0.0).alias("recall"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"), passed.alias("passed"),
    )


def summary(judged: DataFrame) -> DataFrame:
    """Per category and overall: ``category, n, hit_rate, recall, mrr, pass_rate, false_abstain``; the overall row leaves
    abstention probes out. One aggregation, in which a probe counts for its category and for the whole."""
    whole = F.when(F.col("category") != "abstention", F.array("category", F.lit("overall"))).otherwise(F.array("category"))
    return judged.withColumn("category", F.explode(whole)).groupBy("category").agg(
        F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("hit_rate"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"),
        F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg(F.col("abstained").cast("double")).alias("false_abstain"),
    )
