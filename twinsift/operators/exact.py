"""Exact duplicates by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicates(media: DataFrame) -> DataFrame:
    """``(md5, id, path, pos, first_path)`` of items whose digest occurs more than once, members by path."""
    many = media.where("md5 <> ''").groupBy("md5").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("first_path")).where("n > 1")
    order = Window.partitionBy("md5").orderBy("path", "id")
    return media.join(many.drop("n"), "md5").select("md5", "id", "path", (F.row_number().over(order) - 1).alias("pos"), "first_path")


def duplicates_in(media: DataFrame, ids: DataFrame) -> DataFrame:
    """Duplicates among a set of items."""
    return duplicates(media.join(ids, "id", "left_semi"))


def counts_by_type(media: DataFrame) -> DataFrame:
    return media.groupBy("type").agg(F.count(F.lit(1)).alias("n"))
