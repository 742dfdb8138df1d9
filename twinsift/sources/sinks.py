"""Sinks: match lists, state tables and versioned snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_matches(matches: DataFrame, path: str) -> None:
    """Match list ``needle, match, index, score, position, count`` as CSV with a header."""
    matches.select("needle", "match", "index", "score", "position", "count").write.option("header", "true").csv(path)


def print_selection(df: DataFrame, path: str) -> None:
    """One line of text per row, its columns separated by tabs."""
    line = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
    df.select(line.alias("value")).write.text(path)


def append_state(table: DataFrame, path: str) -> None:
    table.write.mode("append").parquet(path)


def write_snapshot(table: DataFrame, root: str) -> str:
    """Writes a new version beside the old ones, then appends a pointer to it; readers see whole versions only."""
    spark, version = table.sparkSession, uuid.uuid4().hex
    table.write.parquet(f"{root}/versions/{version}")
    pointer = spark.sql("SELECT current_timestamp() AS at").select("at", F.lit(version).alias("version"))
    pointer.coalesce(1).write.mode("append").parquet(f"{root}/pointers")
    return version


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The version that the last pointer names."""
    last = spark.read.parquet(f"{root}/pointers").agg(F.max_by("version", F.struct("at", "version"))).first()[0]
    return spark.read.parquet(f"{root}/versions/{last}")
