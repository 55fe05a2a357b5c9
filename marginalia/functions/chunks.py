"""Retrieval chunks of notes (B14, B15): sections of levels two and three, packed by paragraph to a size cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: most characters of a chunk.
CAP = 2000


def split_long(text: Column, cap: int = CAP, separator: str = "\n\n") -> Column:
    """Paragraphs packed greedily into parts of at most ``cap`` characters; a longer paragraph is cut every ``cap``."""
    gap = len(separator)

    def add(parts: Column, para: Column) -> Column:
        last = F.element_at(parts, -1)
        joined = F.concat(last, F.lit(separator), para)
        fits = (F.size(parts) > 0) & (F.length(last) + gap + F.length(para) <= cap)
        grown = F.concat(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(joined))
        return F.when(fits, grown).otherwise(F.concat(parts, F.array(para)))

    packed = F.aggregate(F.split(F.coalesce(text, F.lit("")), separator), F.array().cast("array<string>"), add)
    cut = F.transform(packed, lambda p: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(p) / cap).cast("int") - 1, F.lit(0))), lambda i: F.substring(p, i * cap + 1, F.lit(cap))))
    return F.flatten(cut)


def chunk_notes(notes: DataFrame, cap: int = CAP) -> DataFrame:
    """``name, rel_path, section, part, text`` of every note: the head before the first ``##``/``###`` heading (section
    ``_head``), one chunk or more per such section, and scalar frontmatter as ``_frontmatter``, keys sorted. Each text
    opens with ``name — section``. Blank sections give none; null bodies give only frontmatter."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce("content", F.lit(""))), r"\n(?=#{2,3}\s)")
    body = F.transform(parts, lambda p, i: F.struct(
        F.when(i == 0, F.lit("_head")).otherwise(F.trim(F.regexp_extract(p, r"^#{2,3}\s+([^\n]*)", 1))).alias("section"),
        F.regexp_replace(F.when(i == 0, p).otherwise(F.regexp_replace(p, r"^#{2,3}\s+[^\n]*", "")), r"^\s+|\s+$", "").alias("body"),
    ))
    entries = F.array_sort(F.filter(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: e["value"].isNotNull()))
    lines = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    front = F.array(F.struct(F.lit("_frontmatter").alias("section"), lines.alias("body")))
    every = F.filter(F.concat(body, front), lambda s: s["body"] != "")
    rows = notes.select("name", "rel_path", F.posexplode(every).alias("pos", "s")).select("name", "rel_path", "pos", F.col("s.section").alias("section"), F.posexplode(split_long(F.col("s.body"), cap)).alias("part", "piece"))
    return rows.select("name", "rel_path", "section", "pos", "part", F.concat("name", F.lit(" — "), "section", F.lit("\n"), "piece").alias("text"))
