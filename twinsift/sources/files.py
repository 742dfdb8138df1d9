"""Directories, archives and images as DataFrames."""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsift.functions.props import suffix
from twinsift.operators.catalog import ARCHIVES, IMAGES
from twinsift.stash import Stash, partitions

MEMBER_SCHEMA = "path string, archive string, member string, modified timestamp, length long, content binary"


def scan(spark: SparkSession, folder: str, recursive: bool = True, content: bool = False, skip: str = "_index") -> DataFrame:
    """``(path, length, modified[, content])`` of the files under a folder, without our own index directory.

    Columns that are not asked for are not read: a listing without ``content`` opens no file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    files = files.where(~F.col("path").contains(f"/{skip}/"))
    cols = ["path", "length", F.col("modificationTime").alias("modified")]
    return files.select(*cols, *(["content"] if content else []))


def wanted_member(name: str) -> bool:
    """Images only; no directories, dot files or resource forks."""
    base = name.rsplit("/", 1)[-1]
    return bool(base) and not base.startswith(".") and "__MACOSX" not in name and base.rsplit(".", 1)[-1].lower() in IMAGES


def _members(path: str, data: bytes, content: bool) -> Iterator[dict]:
    try:
        archive = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    with archive:
        for info in archive.infolist():
            if not info.is_dir() and wanted_member(info.filename):
                yield {
                    "path": f"{path}:{info.filename}",
                    "archive": path,
                    "member": info.filename,
                    "modified": pd.Timestamp(*info.date_time),
                    "length": info.file_size,
                    "content": archive.read(info) if content else None,
                }


def members(files: DataFrame, content: bool = False) -> DataFrame:
    """Members of the archives among ``files(path, content)``, whose bytes Spark has read; damaged archives have none.

    A task holds an archive and one member at a time. :func:`split_members` reads large archives by seeks instead.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "archive", "member", "modified", "length", "content"]
        for frame in frames:
            for path, data in zip(frame["path"], frame["content"]):
                for row in _members(path, data, content):
                    yield pd.DataFrame([row], columns=columns).astype({"modified": "datetime64[us]"})

    archives = files.where(F.lower(suffix(F.col("path"))).isin(ARCHIVES)).select("path", "content")
    return archives.mapInPandas(run, MEMBER_SCHEMA)


def _opened(path: str) -> zipfile.ZipFile | None:
    """An archive of any store that Arrow opens, of which only what is asked for is read; ``None`` if it is damaged."""
    if path.startswith("file:/"):  # Spark writes file:/place, unescaped
        store, place = pyarrow.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    else:
        store, place = pyarrow.fs.FileSystem.from_uri(path)
    try:
        return zipfile.ZipFile(store.open_input_file(place))
    except (zipfile.BadZipFile, pyarrow.lib.ArrowInvalid):  # the latter where a file is too short to look for a directory
        return None


def split_members(files: DataFrame, content: bool = False, size: int = 64 << 20) -> DataFrame:
    """Like :func:`members`, of ``files(path)``: tasks list the archives' directories, others read ranges of members by seeks.

    Members in the order of their place in the archive are cut into ranges of about ``size`` packed bytes, so a large
    archive is many tasks' work, and a task holds one member at a time. A damaged member has null content.
    """
    columns = ["path", "archive", "member", "modified", "length", "place", "packed"]

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["path"]:
                if (archive := _opened(path)) is not None:
                    with archive:
                        rows = [
                            (f"{path}:{i.filename}", path, i.filename, pd.Timestamp(*i.date_time), i.file_size, i.header_offset, i.compress_size)
                            for i in archive.infolist()
                            if not i.is_dir() and wanted_member(i.filename)
                        ]
                    if rows:
                        yield pd.DataFrame(rows, columns=columns).astype({"modified": "datetime64[us]"})

    archives = files.where(F.lower(suffix(F.col("path"))).isin(ARCHIVES)).select("path")
    schema = "path string, archive string, member string, modified timestamp, length long, place long, packed long"
    found = archives.mapInPandas(listed, schema)
    if not content:
        return found.select(*columns[:5], F.lit(None).cast("binary").alias("content"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, archive = None, None
        for frame in frames:
            for row in frame.to_dict("records"):
                if row["archive"] != path:
                    if archive is not None:
                        archive.close()
                    path, archive = row["archive"], _opened(row["archive"])
                try:
                    data = archive.read(row["member"])
                except (zipfile.BadZipFile, zlib.error, EOFError):
                    data = None
                out = pd.DataFrame([{**{c: row[c] for c in columns[:5]}, "content": data}])
                yield out.astype({"modified": "datetime64[us]"})

    spark = files.sparkSession
    found = Stash(spark).put(found.withColumn("range", F.floor(F.col("place") / size)), "members")
    ranges = found.select("archive", "range").distinct().count()
    dealt = found.repartition(max(1, min(ranges, 64 * partitions(spark))), "archive", "range").sortWithinPartitions("archive", "place")
    return dealt.select(*columns[:5]).mapInPandas(read, MEMBER_SCHEMA)


def image_files(spark: SparkSession, folder: str, content: bool = True) -> DataFrame:
    """Images of a folder and of its archives in one table, for an ad-hoc search without a catalog."""
    loose = scan(spark, folder, content=True).where(F.lower(suffix(F.col("path"))).isin(IMAGES))
    loose = loose.select("path", F.lit("").alias("archive"), F.lit("").alias("member"), "modified", "length", "content")
    out = loose.unionByName(split_members(scan(spark, folder), content))
    return out if content else out.drop("content")


def pixels(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, width, height, channels, data)``: decoded images; bytes are blue, green, red by row."""
    images = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(folder)
    return images.select(F.col("image.origin").alias("path"), F.col("image.width").alias("width"), F.col("image.height").alias("height"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def register_members(spark: SparkSession, name: str = "archive_members") -> None:
    """Registers a SQL table function ``archive_members(path, content)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="path string, member string, length long")
    class Members:
        def eval(self, path: str, content: bytes):
            for r in _members(path, bytes(content), False):
                yield r["path"], r["member"], r["length"]

    spark.udtf.register(name, Members)
