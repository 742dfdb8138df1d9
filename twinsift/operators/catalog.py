"""Scan planning and catalog maintenance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.props import container, dir_path, is_archived, suffix
from twinsift.operators.sorting import number_rows

# Suffixes by kind (images: also what Spark's image source and common viewers read).
IMAGES = ["jpg", "jpeg", "jfif", "png", "bmp", "gif", "tif", "tiff", "webp"]
VIDEOS = ["mp4", "wmv", "asf", "flv", "mpg", "mpeg", "mov", "vob", "ogv", "rm", "ram", "webm", "f4v", "m4v", "avi", "qt", "mkv", "ts", "mts", "m2t"]
ARCHIVES = ["zip", "cbz", "epub", "ods", "odt", "odp", "docx", "xlsx", "pptx", "xps"]
#: Bits of the algorithms, and what each type supports (types 1 image, 2 video, 3 audio).
DCT, FDCT, ORB, COLOUR, VIDEO = 1, 2, 4, 8, 16
SUPPORTED = {1: DCT | FDCT | ORB | COLOUR, 2: VIDEO, 3: 0}


def type_flag(kind: Column) -> Column:
    return F.pow(F.lit(2), kind - 1).cast("int")


def glob_to_regex(pattern: str) -> str:
    """A glob as a regular expression; ``:`` in front marks one that is a regular expression already."""
    if pattern.startswith(":"):
        return pattern[1:]
    special = {"*": ".*", "?": "."}
    return "".join(special.get(c, re.escape(c)) for c in pattern)


def path_passes(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Must match an include pattern, if there are any, and no exclude pattern; matches are unanchored."""

    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | path.rlike(glob_to_regex(p))
        return out

    wanted = any_of(include) if include else F.lit(True)
    return wanted & ~any_of(exclude)


def classify(path: Column, length: Column, passes: Column, least: int = 1024) -> Column:
    """notype, unsupported, small, filtered, image, video or archive."""
    ext = F.lower(suffix(path))
    kind = F.when(ext.isin(IMAGES), "image").when(ext.isin(VIDEOS), "video").when(ext.isin(ARCHIVES), "archive")
    return (
        F.when(ext == "", "notype")
        .when(kind.isNull(), "unsupported")
        .when(length < least, "small")
        .when(~passes, "filtered")
        .otherwise(kind)
    )


def diff(expected: DataFrame, seen: DataFrame, since: Column, passes: Column) -> DataFrame:
    """``(path, status)``: unchanged, modified, new or removed; expected paths that do not pass are left out."""
    e = expected.select("path", F.lit(True).alias("known"))
    s = seen.select("path", "modified", F.lit(True).alias("there"))
    status = (
        F.when(F.col("known").isNull(), "new")
        .when(F.col("there").isNull(), "removed")
        .when(F.col("modified") < since, "unchanged")
        .otherwise("modified")
    )
    return e.join(s, "path", "full").where(passes).select("path", status.alias("status"))


def archive_skip(members: DataFrame, archives: DataFrame, since: Column) -> DataFrame:
    """``(path, archive, unchanged)``: members of archives last changed before ``since`` need not be opened."""
    rows = members.where(is_archived()).withColumn("archive", dir_path())
    times = archives.select(F.col("path").alias("archive"), F.col("modified").alias("changed"))
    return rows.join(times, "archive", "left").select("path", "archive", F.coalesce(F.col("changed") < since, F.lit(False)).alias("unchanged"))


def supported(kind: Column) -> Column:
    out = F.lit(0)
    for k, mask in SUPPORTED.items():
        out = F.when(kind == k, mask).otherwise(out)
    return out


def algo_sync(items: DataFrame, requested: int) -> DataFrame:
    """``(id, keep, new_algos)`` of ``items(id, type, algos)``: kept if all requested and supported features exist."""
    need = F.lit(requested).bitwiseAND(supported(F.col("type")))
    keep = F.col("algos").bitwiseAND(requested) == need
    return items.select("id", keep.alias("keep"), F.col("algos").bitwiseOR(need).alias("new_algos"))


def indexed_items(media: DataFrame, tables: dict[int, DataFrame]) -> DataFrame:
    """``(id, algos)``: which feature tables, by algorithm bit, have rows of each item; colours of videos do not count."""
    flags = None
    for bit, table in tables.items():
        own = table.select(F.col("media_id").alias("id"), F.lit(bit).alias("bit")).distinct()
        flags = own if flags is None else flags.unionByName(own)
    rows = media.select("id", "type").join(flags, "id", "left")
    real = F.when((F.col("bit") == COLOUR) & (F.col("type") == 2), 0).otherwise(F.coalesce("bit", F.lit(0)))
    dct = F.when(F.coalesce("phash", F.lit(0)) != 0, DCT).otherwise(0) if "phash" in media.columns else F.lit(0)
    if "phash" in media.columns:
        rows = rows.join(media.select("id", dct.alias("dct")), "id")
    else:
        rows = rows.withColumn("dct", dct)
    return rows.groupBy("id").agg(F.bit_or(real.bitwiseOR(F.col("dct"))).alias("algos"))


def orphans(media: DataFrame, table: DataFrame) -> DataFrame:
    """Feature ids without a catalog row."""
    return table.select("media_id").distinct().join(media.select(F.col("id").alias("media_id")), "media_id", "left_anti")


def missing_algos(items: DataFrame, requested: int) -> DataFrame:
    """``(id, indexed)`` of ``items(id, type, algos)``: whether all requested features that the type supports exist."""
    need = F.lit(requested).bitwiseAND(supported(F.col("type")))
    return items.where(need != 0).select("id", (F.col("algos").bitwiseAND(need) == need).alias("indexed"))


def append_ids(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """New rows of a batch, once per path, with the ids that follow the catalog's largest in path order."""
    top = catalog.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    fresh = batch.groupBy("path").agg(*(F.min_by(c, F.struct(*[x for x in batch.columns if x != "path"])).alias(c) for c in batch.columns if c != "path"))
    fresh = fresh.join(catalog.select("path"), "path", "left_anti")
    return number_rows(fresh, [F.col("path")], "id", top + 1)


def remove_ids(tables: dict[str, DataFrame], ids: DataFrame, key: dict[str, str]) -> dict[str, DataFrame]:
    """Every table without the given ids (column ``id``); id 0 is refused, that is, never removed."""
    real = ids.where("id <> 0").select("id").distinct()
    return {n: t.join(real.withColumnRenamed("id", key.get(n, "media_id")), key.get(n, "media_id"), "left_anti") for n, t in tables.items()}


def verify_md5(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """One row: ``ok, changed, missing, ok_bytes`` of stored digests against recomputed ``(path, md5, length)``."""
    rows = stored.select("path", "md5").join(computed.select("path", F.col("md5").alias("now"), "length"), "path", "left")
    same = F.coalesce(F.col("md5") == F.col("now"), F.lit(False))
    return rows.agg(
        F.count_if(same).alias("ok"),
        F.count_if(F.col("now").isNotNull() & ~same).alias("changed"),
        F.count_if(F.col("now").isNull()).alias("missing"),
        F.coalesce(F.sum(F.when(same, F.col("length"))), F.lit(0)).alias("ok_bytes"),
    )


def update_md5(catalog: DataFrame, changes: DataFrame) -> DataFrame:
    """Catalog with the digests of ``changes(id, md5)`` laid over."""
    new = changes.groupBy("id").agg(F.max("md5").alias("_md5"))
    return catalog.join(new, "id", "left").withColumn("md5", F.coalesce("_md5", "md5")).drop("_md5")


def frames_invalid(media: DataFrame, frames: DataFrame) -> DataFrame:
    """``(id, reason)`` of videos without frames, or whose frame table is wrong.

    ``nth``, the place of a row in its video's list, counts from 0 without gaps; frame numbers rise with it, and every
    place has a frame and a hash. Without ``nth`` the order is that of the numbers, and only equal ones are found.
    """
    videos = media.where("type = 2").select("id")
    listed = "nth" in frames.columns
    order = Window.partitionBy("media_id").orderBy("nth" if listed else "frame")
    rows = frames.withColumn("before", F.lag("frame").over(order))
    bad = F.col("hash").isNull() | F.col("frame").isNull() | (F.col("frame") < 0) | (F.col("frame") <= F.col("before"))
    if listed:
        bad = bad | (F.col("nth") != F.coalesce(F.lag("nth").over(order) + 1, F.lit(0)))
    bad = rows.withColumn("bad", bad).where("bad")
    empty = videos.join(frames.select(F.col("media_id").alias("id")), "id", "left_anti").select("id", F.lit("empty").alias("reason"))
    wrong = videos.join(bad.select(F.col("media_id").alias("id")).distinct(), "id").select("id", F.lit("order").alias("reason"))
    return empty.unionByName(wrong)


def archive_counts(listing: DataFrame) -> DataFrame:
    """Adds ``archive_count``, members by archive, -1 outside archives."""
    n = F.count(F.lit(1)).over(Window.partitionBy(container()))
    return listing.withColumn("archive_count", F.when(is_archived(), n).otherwise(F.lit(-1)))
