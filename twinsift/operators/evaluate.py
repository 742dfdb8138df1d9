"""Accuracy of searches against labelled matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``(src, dst, rank, results)`` of expected matches in ranked ``found(src, dst, pos)``; rank is null if missed."""
    n = found.groupBy("src").agg(F.count(F.lit(1)).alias("results"))
    hit = found.groupBy("src", "dst").agg(F.min("pos").alias("rank"))
    return expected.join(hit, ["src", "dst"], "left").join(n, "src", "left").select("src", "dst", "rank", F.coalesce("results", F.lit(0)).alias("results"))


def accuracy(ranked: DataFrame) -> DataFrame:
    """One row: ``pairs, hits, accuracy`` in per cent."""
    hit = F.col("rank").isNotNull()
    return ranked.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(hit).alias("hits"), (F.avg(hit.cast("int")) * 100).alias("accuracy"))


def by_algorithm(ranked: DataFrame) -> DataFrame:
    """Hits, misses, and mean, least and largest score and rank of ``ranked(algo, rank, score)`` by algorithm."""
    hit = F.col("rank").isNotNull()
    return ranked.groupBy("algo").agg(
        F.count_if(hit).alias("hits"),
        F.count_if(~hit).alias("misses"),
        *(f(c).alias(f"{n}_{c}") for c in ("score", "rank") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))),
    )


def frames(expected: DataFrame, found: DataFrame) -> DataFrame:
    """``(needle, status, error)`` of ``expected(needle, media_id, frame)`` in ``found(needle, media_id, pos, dst_in)``.

    The status is first, later, wrong (only others found) or none; the error is the distance in frames.
    """
    right = expected.join(found.select("needle", "media_id", "pos", "dst_in"), ["needle", "media_id"], "left")
    any_ = found.select("needle").distinct().withColumn("some", F.lit(True))
    status = F.when(F.col("pos") == 1, "first").when(F.col("pos") > 1, "later").when(F.col("some"), "wrong").otherwise("none")
    return right.join(any_, "needle", "left").select("needle", status.alias("status"), F.abs(F.col("dst_in") - F.col("frame")).cast("double").alias("error"))


def frame_summary(judged: DataFrame) -> DataFrame:
    return judged.groupBy("status").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("error").alias("mean_error"),
        F.min("error").alias("min_error"),
        F.max("error").alias("max_error"),
        F.percentile("error", 0.5).alias("median_error"),
    )
