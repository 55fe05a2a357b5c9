"""The retrieval log as a stream (J): salience and co-retrieval per window of time, late rows included up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.operators.bookkeeping import TOP, result_names


def _once(log: DataFrame, late: str) -> DataFrame:
    """Redelivered ids count once within the watermark."""
    return log.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["id"])


def salience_stream(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``window, note_name, recall_count`` of a streaming log with ``id, ts, results``."""
    flat = _once(log, late).select("ts", F.explode(result_names(F.col("results"))).alias("note_name"))
    return flat.groupBy(F.window("ts", window).alias("window"), "note_name").agg(F.count("*").alias("recall_count"))


def co_retrieval_stream(log: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """``window, a, b, count`` of a streaming log."""
    first = F.slice(result_names(F.col("results")), 1, TOP)
    pairs = F.flatten(F.transform(first, lambda x, i: F.transform(F.slice(first, i + 2, TOP), lambda y: F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")))))
    flat = _once(log, late).select("ts", F.explode(pairs).alias("p"))
    return flat.groupBy(F.window("ts", window).alias("window"), "p.a", "p.b").agg(F.count("*").alias("count"))
