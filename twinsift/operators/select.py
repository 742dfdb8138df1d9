"""Selections of catalog rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.operators.sorting import number_rows


def catalog_scan(media: DataFrame) -> DataFrame:
    """All rows that have a path."""
    return media.where("path <> ''")


def with_sql(spark: SparkSession, media: DataFrame, sql: str, view: str = "media") -> DataFrame:
    """Runs a user's SQL over the catalog as a view."""
    media.createOrReplaceTempView(view)
    return spark.sql(sql)


def glob_to_like(glob: str, directory: bool = False) -> str:
    """``*`` and ``?`` as LIKE wildcards (escapable by a backslash); a star is added at the end."""
    glob = glob + "/" if directory and not glob.endswith("/") else glob
    glob = glob if glob.endswith("*") else glob + "*"
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and glob[i + 1 : i + 2] in ("*", "?"):
            out, i = out + glob[i + 1], i + 2
            continue
        out += {"*": "%", "?": "_", "%": "\\%", "_": "\\_"}.get(c, c)
        i += 1
    return out


def by_glob(media: DataFrame, glob: str, directory: bool = False) -> DataFrame:
    return media.where(F.col("path").like(glob_to_like(glob, directory)))


def by_regex(media: DataFrame, pattern: str) -> DataFrame:
    re.compile(pattern)
    return media.where(F.col("path").rlike(pattern))


def by_ids(media: DataFrame, ids: DataFrame) -> DataFrame:
    return media.join(ids.select("id").distinct(), "id", "left_semi")


def existing_like(media: DataFrame, pattern: str) -> DataFrame:
    """One row ``(found)``: whether the catalog has a path that fits a ``like`` pattern; the scan ends with the first."""
    hit = media.where(F.col("path").like(pattern)).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("found"))


def existing(paths: DataFrame, media: DataFrame) -> DataFrame:
    """Paths that the catalog has."""
    return paths.join(media.select("path"), "path", "left_semi")


def errors(index_errors: DataFrame) -> DataFrame:
    """Paths with an error other than that their type is not supported."""
    return index_errors.where("error <> 'unsupported'").select("path").distinct()


def append(first: DataFrame, second: DataFrame) -> DataFrame:
    """Bag union of two selections; the second follows the first and ``pos`` is written anew."""
    rows = first.withColumn("_part", F.lit(0)).unionByName(second.withColumn("_part", F.lit(1)))
    rows = rows.withColumnRenamed("pos", "_old")
    return number_rows(rows, [F.col("_part"), F.col("_old")]).drop("_part", "_old")
