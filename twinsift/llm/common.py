"""Shared helpers: byte-level word splitting and iteration over sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of the word class ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z are lower-cased; every other byte
#: becomes a space. Bytes of non-ASCII characters are all >= 0x80, so the class can be applied to UTF-8 bytes.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def alnum_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text; null has none."""
    return text.translate(ALNUM).split() if text else []


def space_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text; null has none."""
    return text.lower().split() if text else []


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Cuts batches into short ones, so that Python copies of long texts stay few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Groups a stream that is sorted by ``keys`` into tables of whole key groups of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held)
        last = np.ones(table.num_rows, bool)
        for k in keys:
            v = table.column(k).to_numpy()
            last &= v == v[-1]
        cut = table.num_rows - int(last[::-1].argmin() if not last.all() else table.num_rows)
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut).combine_chunks()
        held, n = rest.to_batches(), rest.num_rows
    if held:
        yield pa.Table.from_batches(held)


def run_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key group begins, with the row count at the end."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def union_labels(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """Smallest row number reachable from each of ``n`` rows by links ``(a, b)``, by hooking and jumping."""
    labels = np.arange(n) if labels is None else labels
    while len(a):
        la, lb = labels[a], labels[b]
        open_ = la != lb
        if not open_.any():
            break
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def join_classes(rows: DataFrame, classes: DataFrame, key: str, copies: str, least: int = 1000) -> DataFrame:
    """Inner join of rows with one written row per key, whose ``copies`` says how many rows have it.

    Keys with more than ``least`` copies and a thousandth of all rows are a thousand at most: they are sent to the
    rows, so that a mass of copies is never moved to one task. All other keys are small and meet by a shuffle.
    """
    n = classes.agg(F.coalesce(F.sum(copies), F.lit(0))).first()[0]
    most = max(least, n // 1000)
    hot = F.broadcast(classes.where(F.col(copies) > most).drop(copies))
    cold = classes.where(F.col(copies) <= most).drop(copies).hint("merge")
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))
