"""Intermediate tables in the shared folder of the session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Stash:
    """Writes intermediate results as Parquet under the shared folder that ``spark.checkpoint.dir`` names.

    A written table cuts lineage and survives the loss of any executor. A folder of our own is taken only
    where a local session names none. Results may still read the tables, so they stay until :meth:`clear`.
    """

    made_by: dict[str, list[Stash]] = {}

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + tempfile.mkdtemp(prefix="twinsift-")
            spark.conf.set("spark.checkpoint.dir", root)
        self.root = f"{root.rstrip('/')}/twinsift-{uuid.uuid4().hex}"
        self.made = 0
        self.made_by.setdefault(spark.sparkContext.applicationId, []).append(self)

    def path(self, tag: str) -> str:
        self.made += 1
        return f"{self.root}/{self.made:03d}-{tag}"

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        path = self.path(tag)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stash_path = path
        return out

    @classmethod
    def clear(cls, spark: SparkSession) -> None:
        """Deletes all tables of this application's stashes; call it when no earlier result is read any more."""
        for stash in cls.made_by.pop(spark.sparkContext.applicationId, []):
            path = spark._jvm.org.apache.hadoop.fs.Path(stash.root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this stash that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.stash_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
