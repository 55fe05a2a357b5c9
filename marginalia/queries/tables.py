"""Readers of the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vault_log(spark: SparkSession, folder: str) -> DataFrame:
    """The scan logs of the vault and of its starter notes as one; the latter's ids are negated, so that they stay apart."""
    return table(spark, folder, "notes").unionByName(table(spark, folder, "seed_notes").withColumn("note_id", -F.col("note_id")))
