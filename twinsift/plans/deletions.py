"""Plans of deletions and replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.props import complete_base_name, container, dir_path, suffix
from twinsift.operators.exact import duplicates
from twinsift.operators.state import weed_list


def duplicates_in(media: DataFrame, directory: str) -> DataFrame:
    """``(md5, id, path)``: one item under ``directory`` of each group of exact duplicates, the first by path."""
    under = duplicates(media).where(F.col("path").startswith(directory.rstrip("/") + "/"))
    first = Window.partitionBy("md5").orderBy("path", "id")
    return under.withColumn("r", F.row_number().over(first)).where("r = 1").select("md5", "id", "path")


def weeds(media: DataFrame, weed_table: DataFrame) -> DataFrame:
    return weed_list(media, weed_table)


def selection(items: DataFrame) -> DataFrame:
    """``(path, n)``: files to delete for a selection; members of an archive stand for it once."""
    return items.groupBy(container().alias("path")).agg(F.count(F.lit(1)).alias("n"))


def guard(marked: DataFrame, groups: DataFrame, locks: DataFrame) -> DataFrame:
    """``(group_id, media_id)`` that may be deleted: never a whole group, nothing in a locked folder."""
    rows = groups.join(marked.select("group_id", "media_id", F.lit(1).alias("m")), ["group_id", "media_id"], "left")
    all_ = Window.partitionBy("group_id")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(all_)).withColumn("k", F.sum(F.coalesce("m", F.lit(0))).over(all_))
    free = rows.where("m = 1 and k < n").withColumn("dir_path", dir_path())
    return free.join(locks, "dir_path", "left_anti").select("group_id", "media_id")


def replace(pairs: DataFrame) -> DataFrame:
    """``(keep_path, new_path)`` of ``pairs(keep_path, gone_path)``: the keeper takes the other's place with its own suffix."""
    kept, gone = F.col("keep_path"), F.col("gone_path")
    folder = dir_path(gone)
    name = F.concat(complete_base_name(gone), F.when(suffix(kept) != "", F.concat(F.lit("."), suffix(kept))).otherwise(""))
    return pairs.select("keep_path", F.when(folder != "", F.concat(folder, F.lit("/"), name)).otherwise(name).alias("new_path"))
