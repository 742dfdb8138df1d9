"""Orders that are carried as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.stash import Stash, partitions


def natural_key(text: Column, width: int = 20) -> Column:
    """Text that sorts digit runs as numbers; an approximation by code points, without a fraction rule."""
    runs = F.regexp_extract_all(text, F.lit(r"(\d+|\D+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.lpad(F.regexp_replace(r, "^0+(?=.)", ""), width, "0")).otherwise(r)), "")


def order_columns(keys: list[str]) -> list[Column]:
    """``^name`` is descending; nulls come first when ascending and last when descending."""
    return [F.col(k[1:]).desc_nulls_last() if k.startswith("^") else F.col(k).asc_nulls_first() for k in keys]


def number_rows(df: DataFrame, order: list[Column], name: str = "pos", start: int = 0) -> DataFrame:
    """Consecutive numbers in a global order without gathering all rows in one task.

    Rows are range-partitioned, written, counted by partition, and numbered inside it; only the counts, one
    row per partition, are added up in one place.
    """
    stash, n = Stash(df.sparkSession), partitions(df.sparkSession)
    ranged = df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id())
    ranged = stash.put(ranged, "ranged")
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    out = ranged.withColumn("_nth", nth).join(F.broadcast(sizes), "_p")
    return out.withColumn(name, (F.col("_base") + F.col("_nth") - 1 + start).cast("long")).drop("_p", "_nth", "_base")


def sort_selection(df: DataFrame, keys: list[str]) -> DataFrame:
    """Stable sort of a selection by several keys; ``pos`` is written anew."""
    rows = df.withColumnRenamed("pos", "_old")
    return number_rows(rows, [*order_columns(keys), F.col("_old")]).drop("_old")


def sort_groups(df: DataFrame, keys: list[str], group: str = "group_id") -> DataFrame:
    """Stable sort inside each group."""
    rows = df.withColumnRenamed("pos", "_old")
    order = Window.partitionBy(group).orderBy(*order_columns(keys), F.col("_old"))
    return rows.withColumn("pos", F.row_number().over(order) - 1).drop("_old")


def sort_result(df: DataFrame, keys: list[str], group: str = "group_id") -> DataFrame:
    """``(group, nth)``: groups in the order of their first items."""
    first = df.where("pos = 0")
    return number_rows(first, [*order_columns(keys), F.col(group)], "nth").select(group, "nth")


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[np.ndarray]:
    """Sorted rows of whole numbers, as arrays by column that end where a group does; the first ``keys`` columns name it.

    For a task that reads group after group: a group may go on over many batches, and only one is held.
    """
    held: list[np.ndarray] = []
    for batch in batches:
        now = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        before = held[-1][:keys, -1:] if held else now[:keys, :1]
        new = np.flatnonzero((now[:keys] != np.concatenate([before, now[:keys, :-1]], 1)).any(0))
        if len(new):
            yield np.concatenate([*held, now[:, : new[-1]]], 1)
            held, now = [], now[:, new[-1] :]
        held.append(now)
    if held:
        yield np.concatenate(held, 1)
