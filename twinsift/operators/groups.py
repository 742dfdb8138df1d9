"""Operators on grouped results: long tables ``(group_id, pos, media_id, ...)`` whose needle has ``pos`` 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.expr import at_least
from twinsift.operators.components import connected_components
from twinsift.stash import Stash

GROUP = "group_id"
#: Bits of the match flags.
EXACT, BIGGER, BIGGER_FILE, LESS_COMPRESSED, WEED = 1, 2, 4, 8, 16


def needle_of(value: str | Column, group: str = GROUP) -> Column:
    return F.first_value(value).over(Window.partitionBy(group).orderBy("pos"))


def in_order(group: str = GROUP) -> Window:
    return Window.partitionBy(group).orderBy("pos")


def common_prefix(df: DataFrame, group: str = GROUP, path: str = "path") -> DataFrame:
    """``(group, prefix)``: the longest common path of a group, cut at a slash.

    The smallest and the largest path share a prefix if and only if all do.
    """
    ends = df.groupBy(group).agg(F.min(path).alias("a"), F.max(path).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    n = F.least(F.size(a), F.size(b)) - 1
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))
    head = F.array_join(F.slice(a, 1, F.array_max(same)), "/")
    return ends.select(group, F.when(n > 0, head).otherwise("").alias("prefix"))


def average_aspect(df: DataFrame, group: str = GROUP) -> DataFrame:
    mean = F.avg(F.when(F.col("height") > 0, F.col("width") / F.col("height")))
    return df.groupBy(group).agg(F.when(F.coalesce(mean, F.lit(0.0)) == 0, F.lit(2 / 3)).otherwise(mean).alias("aspect"))


def group_by(df: DataFrame, key: Column, label: str) -> DataFrame:
    """Adds ``group_key``, the text ``label == value`` (null is empty), and the place inside the group."""
    value = F.coalesce(key.cast("string"), F.lit(""))
    keyed = df.withColumn("group_key", F.concat(F.lit(f"{label} == "), value))
    return keyed.withColumn("pos", F.row_number().over(Window.partitionBy("group_key").orderBy("path")) - 1)


def by_path_prefix(df: DataFrame, prefix: str, accept: bool = True) -> DataFrame:
    """Matches under a path (or not under it); the needle stays."""
    under = F.col("path").startswith(prefix)
    return at_least(df.where((F.col("pos") == 0) | (under if accept else ~under)), GROUP, 2)


def not_beside_needle(df: DataFrame, parent: Column) -> DataFrame:
    """Drops matches in the needle's own directory or archive."""
    rows = df.withColumn("_p", parent)
    rows = rows.withColumn("_np", needle_of("_p"))
    return at_least(rows.where((F.col("pos") == 0) | (F.col("_p") != F.col("_np"))).drop("_p", "_np"), GROUP, 2)


def drop_negative(df: DataFrame, negative: DataFrame) -> DataFrame:
    """Drops matches whose digest and the needle's are listed in either order."""
    pairs = negative.select(F.least("md5_a", "md5_b").alias("_lo"), F.greatest("md5_a", "md5_b").alias("_hi")).distinct()
    rows = df.withColumn("_n", needle_of("md5"))
    rows = rows.withColumn("_lo", F.least("md5", "_n")).withColumn("_hi", F.greatest("md5", "_n"))
    needles, matches = rows.where("pos = 0"), rows.where("pos > 0").join(pairs.hint("merge"), ["_lo", "_hi"], "left_anti")
    kept = needles.unionByName(matches.select(needles.columns)).drop("_n", "_lo", "_hi")
    return at_least(kept, GROUP, 2)


def dedupe(df: DataFrame) -> DataFrame:
    """Of groups with the same members that with the smallest needle path stays."""
    sets = df.groupBy(GROUP).agg(F.array_sort(F.collect_list("path")).alias("members"), F.min_by("path", "pos").alias("needle_path"))
    first = sets.groupBy("members").agg(F.min(F.struct("needle_path", GROUP)).alias("x"))
    return df.join(first.select(F.col(f"x.{GROUP}").alias(GROUP)).hint("merge"), GROUP, "left_semi")


def merge_edges(df: DataFrame) -> DataFrame:
    """``(a, b)``: of every row whose item is a needle of some group, its group and the smallest group that holds the item."""
    held = df.groupBy("media_id").agg(F.min(GROUP).alias("b"), F.max((F.col("pos") == 0).cast("int")).alias("needle")).where("needle = 1")
    return df.select("media_id", F.col(GROUP).alias("a")).join(held.select("media_id", "b"), "media_id").select("a", "b")


def merge(df: DataFrame) -> DataFrame:
    """Groups whose needle is a member of another join it; ``(group_id, media_id)`` of the unions, each once.

    Each item that is a needle anywhere ties the groups that hold it to the smallest of them, so the graph of groups has
    an edge for a row at most, however many groups share an item. Its components do not depend on any order. The
    merged group has the smallest id.
    """
    stash = Stash(df.sparkSession)
    roots = stash.put(connected_components(merge_edges(df), stash), "groups").withColumnRenamed("node", GROUP)
    return df.join(roots, GROUP).select(F.col("component").alias(GROUP), "media_id").distinct()


def expand(df: DataFrame) -> DataFrame:
    """``(needle, media_id)`` pairs of each group."""
    return df.withColumn("needle", needle_of("media_id")).where("pos > 0").select("needle", "media_id")


def needle_range(df: DataFrame) -> DataFrame:
    """The needle takes the range of the first match."""
    first = F.first_value("range").over(in_order().rowsBetween(1, 1))
    return df.withColumn("range", F.when(F.col("pos") == 0, first).otherwise(F.col("range")))


def head(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(in_order())).where(F.col("_r") <= n).drop("_r")


def tail(df: DataFrame, n: int) -> DataFrame:
    order = Window.partitionBy(GROUP).orderBy(F.desc("pos"))
    return df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def chop(df: DataFrame) -> DataFrame:
    """All but the first of each group."""
    return df.withColumn("_r", F.row_number().over(in_order())).where(F.col("_r") > 1).drop("_r")


def first_sibling(df: DataFrame, directory: Column) -> DataFrame:
    """First item of each directory in each group."""
    rows = df.withColumn("_d", directory)
    order = Window.partitionBy(GROUP, "_d").orderBy("pos")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_d")


def pages(df: DataFrame, size: int = 12) -> DataFrame:
    return df.withColumn("page", F.floor((F.row_number().over(in_order()) - 1) / size).cast("long"))


def folder_pages(df: DataFrame, directory: Column, size: int = 12) -> DataFrame:
    """Pages of a selection that also break where the directory changes; videos stand alone."""
    rows = df.withColumn("_d", F.when(F.col("type") == 2, F.col("path")).otherwise(directory))
    order = Window.partitionBy("_d").orderBy("pos")
    rows = rows.withColumn("page", F.floor((F.row_number().over(order) - 1) / size).cast("long"))
    return rows.withColumnRenamed("_d", "folder")


def folders(df: DataFrame, prefix: DataFrame, directory: Column) -> DataFrame:
    """``(group_id, folder, n)``: items by directory below the group's common path; a video counts by its own path."""
    rows = df.join(prefix, GROUP)
    where = F.when(F.col("type") == 2, F.col("path")).otherwise(directory)
    cut = F.when((F.col("prefix") != "") & where.startswith(F.concat("prefix", F.lit("/"))), F.expr("substr(_w, length(prefix) + 2)")).otherwise(F.col("_w"))
    return rows.withColumn("_w", where).withColumn("folder", cut).groupBy(GROUP, "folder").agg(F.count(F.lit(1)).alias("n"))


def directory_pairs(df: DataFrame, directory: Column) -> DataFrame:
    """``(group_id, pair)``: groups in exactly two directories by that pair; lone pairs and all others ``*unpaired*``."""
    sets = df.groupBy(GROUP).agg(F.array_sort(F.collect_set(directory)).alias("d"))
    key = sets.withColumn("pair", F.when(F.size("d") == 2, F.array_join("d", " + ")))
    n = F.count(F.lit(1)).over(Window.partitionBy("pair"))
    return key.withColumn("n", n).select(GROUP, F.when(F.col("pair").isNotNull() & (F.col("n") > 1), F.col("pair")).otherwise("*unpaired*").alias("pair"))


def same_contents(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(group_id, same)``: whether the groups of equal id in two results hold the same paths."""
    left = a.groupBy(GROUP).agg(F.array_sort(F.collect_list("path")).alias("x"))
    right = b.groupBy(GROUP).agg(F.array_sort(F.collect_list("path")).alias("y"))
    return left.join(right, GROUP, "full").select(GROUP, F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("same"))


def match_flags(df: DataFrame, compression: Column) -> DataFrame:
    """Adds ``match_flags`` relative to the needle: same digest, larger, larger file, less compressed."""
    rows = df.withColumn("_c", compression)
    area, first = F.col("width") * F.col("height"), lambda x: needle_of(x)
    flags = (
        F.when(F.col("md5") == first("md5"), EXACT).otherwise(0)
        + F.when(area > first(area), BIGGER).otherwise(0)
        + F.when(F.col("file_size") > first("file_size"), BIGGER_FILE).otherwise(0)
        + F.when(F.col("_c") < first("_c"), LESS_COMPRESSED).otherwise(0)
    )
    return rows.withColumn("match_flags", F.when(F.col("pos") == 0, 0).otherwise(flags)).drop("_c")


def relative_label(value: Column, reverse: bool = False, percent: bool = False) -> Column:
    """less, more or same than the needle; with ``percent`` a change that rounds to 0 % is same."""
    needle = needle_of(value)
    gap = value - needle
    if percent:
        gap = F.when(needle != 0, F.floor(F.abs(gap) * 100 / needle) * F.signum(gap)).otherwise(gap)
    up, down = ("less", "more") if reverse else ("more", "less")
    return F.when(gap > 0, up).when(gap < 0, down).otherwise("same")


def match_class(flags: Column, score: Column) -> Column:
    """weed or unmatched below a score of 0, else exact or the number of ways in which a match is better."""
    better = F.bit_count(flags.bitwiseAND(BIGGER | BIGGER_FILE | LESS_COMPRESSED))
    return (
        F.when((score < 0) & (flags.bitwiseAND(WEED) != 0), "weed")
        .when(score < 0, "unmatched")
        .when(flags.bitwiseAND(EXACT) != 0, "exact")
        .otherwise(F.concat(F.lit("better"), better.cast("string")))
    )


def index_of(df: DataFrame, path: Column) -> DataFrame:
    """``(group_id, idx)``: position of a path in each group, -1 if it is not there."""
    at = F.min(F.when(F.col("path") == path, F.col("pos")))
    return df.groupBy(GROUP).agg(F.coalesce(at, F.lit(-1)).alias("idx"))


def remove_directory(df: DataFrame, directory: Column, away: str) -> DataFrame:
    """Drops all items of a directory from every group, and groups left with less than two."""
    return at_least(df.where(directory != away), GROUP, 2)


def view_filter(df: DataFrame, least_side: int = 0, path: str | None = None, show: str = "any") -> DataFrame:
    """Rows of a viewer table: longest side, path pattern, and whether they match or are larger or smaller."""
    rows = df.where(F.greatest("width", "height") >= least_side)
    if path:
        rows = rows.where(F.col("path").rlike(path))
    flags = F.col("match_flags")
    keep = {
        "any": F.lit(True),
        "none": F.col("score") < 0,
        "match": F.col("score") >= 0,
        "bigger": (F.col("score") >= 0) & (flags.bitwiseAND(BIGGER) != 0),
        "smaller": (F.col("score") >= 0) & (flags.bitwiseAND(BIGGER) == 0),
    }
    return rows.where(keep[show])
