"""The advisory write gate (I23, C16): what a new note would contradict or repeat. It never blocks and never fails a write."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import in_directory
from marginalia.operators import conflict, tfidf
from marginalia.session import materialize
from marginalia.sources.connectors import Model, first_json


def applies(rel_path: Column) -> Column:
    """Entity notes anywhere, and notes of the learning layer."""
    return F.substring_index(rel_path, "/", -1).rlike(r"^entity-.*\.md$") | (in_directory(rel_path, "LearningLayer") & rel_path.endswith(".md"))


CLASSIFY = """A note is about to be written to a vault. Decide what to do with it: ADD it, UPDATE a note, DELETE a note that it replaces,
or NOOP where nothing is new. Answer with one JSON object {"verdict": ..., "target_path": ..., "rationale": ...} and nothing else.

New note: %s
%s

Notes like it (path, similarity, frontmatter):
%s
"""
VERDICTS = ("ADD", "UPDATE", "DELETE", "NOOP")


def consult(findings: DataFrame, written: DataFrame, model: Model, most: int = 4_000) -> DataFrame:
    """``new_id, verdict, target_path, rationale, asked`` from ``findings`` (see :func:`conflict.prefilter`) and
    ``written(new_id, name, raw_text)``.

    The model is only asked where the prefilter found a conflict or a duplicate that is no plain repeat; the others keep the
    prefilter's verdict. It is called on the executors, once a note, with the first ``most`` characters of the text (the
    prompt's size, as the contract has it). An answer that is no verdict leaves the prefilter's, and says so.
    """
    plain = conflict.propose(findings)
    shown = F.struct((-F.col("score")).alias("far"), "rel_path", F.to_json(F.coalesce("old_meta", F.create_map().cast("map<string,string>"))).alias("meta"))
    like = findings.groupBy("new_id").agg(F.sort_array(F.collect_list(shown)).alias("like"))  # a note has few findings
    text = written.select(F.col("new_id").cast("string").alias("new_id"), "name", F.substring("raw_text", 1, most).alias("text"))
    rows = plain.join(like, "new_id").join(text, "new_id").join(conflict.conflict_summary(findings), "new_id", "left")

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for r in pdf.itertuples():
                verdict, target, why, asked = r.verdict, r.target_path, "by the prefilter", False
                if verdict == "UPDATE":
                    answer = first_json(model(CLASSIFY % (r.name, r.text, "\n".join(f"- {x['rel_path']} {-x['far']:.3f} {x['meta']}" for x in r.like)))) or {}
                    asked, why = True, "the model gave no verdict"
                    if answer.get("verdict") in VERDICTS:
                        verdict, target, why = answer["verdict"], answer.get("target_path"), str(answer.get("rationale") or "")
                    why = f"{why} ({r.summary})" if r.summary else why
                out.append((r.new_id, verdict, target, why, asked))
            yield pd.DataFrame(out, columns=["new_id", "verdict", "target_path", "rationale", "asked"])

    return rows.mapInPandas(ask, "new_id string, verdict string, target_path string, rationale string, asked boolean")


def advise(written: DataFrame, notes: DataFrame, k: int = 5) -> DataFrame:
    """``new_id, verdict, target_path, summary`` for ``written(new_id, rel_path, name, raw_text, metadata)`` against ``notes
    (rel_path, name, content, metadata)``, many at a time: one term join serves them all. A note is not compared with itself."""
    new = written.where(applies(F.col("rel_path")))
    docs = notes.select("rel_path", F.concat_ws(" ", "content", "name").alias("text"))
    counts = materialize(tfidf.term_counts(docs, "rel_path", "text"), "counts")
    terms = tfidf.idf(counts, docs.count())
    asked = materialize(tfidf.term_counts(new.select("rel_path", F.concat_ws(" ", "raw_text", "name").alias("text")), "rel_path", "text"), "asked")
    q = materialize(tfidf.weights(asked, terms), "queries")
    top = tfidf.most_similar(materialize(tfidf.weights(counts, terms), "weights"), q, k)
    pairs = top.select(F.col("query").alias("own"), F.col("key").alias("rel_path"), "score")
    old = notes.select("rel_path", F.col("metadata").alias("old_meta"))
    mine = new.select(F.col("new_id").cast("string").alias("new_id"), F.col("rel_path").alias("own"), F.col("metadata").alias("new_meta"))
    found = materialize(conflict.prefilter(pairs.join(mine, "own").join(old, "rel_path")), "found")
    verdicts = conflict.propose(found).join(conflict.conflict_summary(found), "new_id", "left")
    return mine.select("new_id").join(verdicts, "new_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("ADD")))
