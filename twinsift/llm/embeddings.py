"""Near-duplicate vectors by Euclidean p-stable hashing with exact cosine checks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import join_classes, key_runs, run_starts, slices, union_labels
from twinsift.operators.components import connected_components
from twinsift.stash import Stash, partitions

#: Vectors of one bucket that a task compares with those of another part of it.
BLOCK = 1024


def same_cell(distance: float, width: float) -> float:
    """Probability that two points at ``distance`` share a cell of a quantised Gaussian projection."""
    r = width / distance
    density = 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))
    return math.erf(r / math.sqrt(2)) - density


def plan(rows: int, cosine: float, miss: float, load: float = 8.0) -> tuple[int, int, float]:
    """Projections per table, tables, and width of a cell, for ``rows`` unit vectors.

    A table has so many projections that a vector shares its bucket with about ``load`` unrelated ones (at a right
    angle); there are so many tables that a pair at the threshold is missed by all with probability ``miss`` at
    most. Closer pairs are missed less. Of some widths the one with the fewest tables is taken.
    """
    best = None
    for width in (1.5, 2.0, 2.5, 3.0, 3.5, 4.0):
        near = same_cell(max(math.sqrt(2 - 2 * cosine), 1e-6), width)
        far = same_cell(math.sqrt(2), width)
        k = max(2, math.ceil(math.log(max(rows / load, 64)) / -math.log(far)))
        tables = max(1, math.ceil(math.log(miss) / math.log1p(-(near**k))))
        if best is None or (tables, k) < (best[1], best[0]):
            best = k, tables, width
    return best


def sketch_errors(cosine: float) -> int:
    """Bits of 64 random signs in which a pair at the threshold differs at most, up to five standard deviations."""
    p = math.acos(min(1.0, cosine)) / math.pi
    return min(64, math.ceil(64 * p + 5 * math.sqrt(64 * p * (1 - p))))


@cache
def projections(dim: int, k: int, tables: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gaussian directions, offsets and mixing factors, the same in every task."""
    rng = np.random.default_rng([seed, dim])
    directions = rng.standard_normal((dim, tables * k)) / width
    return directions, rng.random(tables * k), rng.integers(1, 2**63, (tables, k), dtype=np.uint64) | np.uint64(1)


@cache
def signs(dim: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim, 1]).standard_normal((dim, 64))


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """Signs of 64 random projections as one number."""
    return np.packbits(unit @ signs(unit.shape[1], seed) > 0, axis=1, bitorder="little").view(np.int64)[:, 0]


def bucket_keys(unit: np.ndarray, k: int, tables: int, width: float, seed: int) -> np.ndarray:
    """32-bit bucket of each unit vector in each table."""
    directions, offsets, factors = projections(unit.shape[1], k, tables, width, seed)
    cells = np.floor(unit @ directions + offsets).astype(np.int64).view(np.uint64)
    mixed = (cells.reshape(len(unit), tables, k) * factors).sum(2, dtype=np.uint64)
    return (mixed >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _read(vectors: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """``(vec_id, vec binary)``: bytes of usable vectors in their own precision, null for all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            out = []
            for vec_id, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.array([] if v is None or None in v or vec_id is None else v, kind) + 0
                out.append(x.tobytes() if len(x) and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["vec_id", "vec"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, "vec_id long, vec binary")


def near_duplicates(vectors: DataFrame, cosine: float = 0.95, miss: float = 0.005, load: float = 8.0, seed: int = 11, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row ``(vec_id, n_links, component_id, kept)`` per row of ``vectors``.

    Two vectors of equal length are linked if their cosine in double precision is at least ``cosine``; the
    component is the smallest id reachable, and ``kept`` says whether that is the row's own. Equal vectors are
    one class, which is hashed once and counted as often as it occurs. Bucket keys are dealt out with a sketch of
    64 signs instead of the vector; only vectors whose sketch is near another's in a bucket are joined with theirs (a
    pair at the threshold is lost here with probability 1e-6). They are compared exactly by blocks; a bucket of more
    than ``block`` vectors is cut into parts whose pairs go to separate tasks. A pair counts in the first table in
    which it meets, so each link counts once. Tasks return counts and a spanning forest, never pairs.

    Vectors that are null or zero or hold nulls or non-finite numbers, and rows without an id, link with
    nothing: no links, their own id as component. Repeated rows count as vectors of their own; extra columns
    are ignored; no rows give no rows.
    """
    spark = vectors.sparkSession
    stash = Stash(spark)
    kind = "f4" if vectors.schema[vec_col].dataType.elementType.simpleString() == "float" else "f8"
    rows = stash.put(_read(vectors, id_col, vec_col, kind), "vectors")
    usable = rows.where("vec is not null").withColumn("digest", F.sha2("vec", 256))
    classes = usable.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("vec").alias("vec"))
    # two classes may share their smallest id only if ids repeat; the row number tells them apart
    classes = stash.put(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    n = classes.count()
    k, tables, width = plan(n, cosine, miss, load)
    errors = sketch_errors(cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            raw, out, sketch = batch.column(0).to_pylist(), [b""] * batch.num_rows, np.zeros(batch.num_rows, np.int64)
            for size in {len(r) for r in raw}:
                own = [i for i, r in enumerate(raw) if len(r) == size]
                unit = _units([raw[i] for i in own], kind)
                sketch[own] = sketches(unit, seed)
                for i, row in zip(own, bucket_keys(unit, k, tables, width, seed)):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary()), pa.array(sketch)], ["vec", "cls", "copies", "keys", "sketch"])

    full = stash.put(classes.select("vec", "cls", "copies").mapInArrow(hashed, "vec binary, cls long, copies long, keys binary, sketch long"), "hashed")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int32).reshape(-1, tables)
            for t in range(tables):
                out = [pa.array(np.full(len(keys), t, np.int32)), pa.array(keys[:, t]), batch.column(2), batch.column(0), batch.column(3)]
                yield pa.RecordBatch.from_arrays(out, ["t", "key", "size", "cls", "sketch"])

    narrow = full.select("cls", "keys", F.length("vec").alias("size"), "sketch").mapInArrow(spread, "t int, key int, size int, cls long, sketch long")
    large = narrow.groupBy("t", "key", "size").count().where(F.col("count") > block)
    large = stash.put(large.select("t", "key", "size", F.ceil(F.col("count") / block).cast("int").alias("parts")), "large")
    placed = narrow.join(F.broadcast(large) if large.count() <= 100_000 else large, ["t", "key", "size"], "left")
    parts = F.coalesce("parts", F.lit(1))
    placed = placed.withColumn("r", F.pmod(F.xxhash64("cls"), parts).cast("int"))
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    names = ["t", "key", "size", "x", "y"]
    placed = placed.select("t", "key", "size", F.least("r", "q").alias("x"), F.greatest("r", "q").alias("y"), "r", "cls", "sketch")

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, names, 20_000):
            starts, s = run_starts(table, names), table.column("sketch").to_numpy().view(np.uint64)
            x, y, r = (table.column(c).to_numpy() for c in ("x", "y", "r"))
            keep = np.zeros(len(s), bool)
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if hi - lo < 2:
                    continue
                own, first = s[lo:hi], r[lo:hi] == x[lo]
                near = np.bitwise_count(own[:, None] ^ own[None, :]) <= errors
                near &= first[:, None] != first[None, :] if x[lo] != y[lo] else ~np.eye(hi - lo, dtype=bool)
                keep[lo:hi] = near.any(1)
            yield from table.filter(pa.array(keep)).drop_columns("sketch").to_batches()

    dealt = placed.repartition(partitions(spark), *names).sortWithinPartitions(*names)
    kept = dealt.mapInArrow(promising, "t int, key int, size int, x int, y int, r int, cls long")
    entries = kept.join(full.select("cls", "copies", "vec", "keys"), "cls").select(*names, "r", "cls", "copies", "vec", "keys")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, names, 4 * block):
            starts = run_starts(table, names)
            t, x, y, r, cls, copies = (table.column(c).to_numpy() for c in ("t", "x", "y", "r", "cls", "copies"))
            raw, keys = table.column("vec").to_pylist(), table.column("keys").to_pylist()
            found = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if hi - lo < 2:
                    continue
                unit = _units(raw[lo:hi], kind)
                own = np.frombuffer(b"".join(keys[lo:hi]), np.int32).reshape(hi - lo, tables)[:, : t[lo]]
                side = np.flatnonzero(r[lo:hi] == x[lo])
                other = np.flatnonzero(r[lo:hi] != x[lo]) if x[lo] != y[lo] else side
                if not len(side) or not len(other):
                    continue
                dots = unit[side] @ unit[other].T
                i, j = np.nonzero(dots >= cosine)
                i, j = side[i], other[j]
                if x[lo] == y[lo]:
                    i, j = i[i < j], j[i < j]
                for at in range(0, len(i), 200_000):
                    a, b = i[at : at + 200_000], j[at : at + 200_000]
                    new = ~(own[a] == own[b]).any(1)
                    if new.any():
                        found.append((lo + a[new], lo + b[new]))
            if not found:
                continue
            a, b = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
            links = np.bincount(a, copies[b], len(cls)) + np.bincount(b, copies[a], len(cls))
            labels = union_labels(len(cls), a, b)
            some = np.flatnonzero(links)
            out = [pa.array(cls[some]), pa.array(cls[labels[some]]), pa.array(links[some].astype(np.int64))]
            yield pa.RecordBatch.from_arrays(out, ["a", "b", "links"])

    dealt = entries.repartition(partitions(spark), *names).sortWithinPartitions(*names)
    met = stash.put(dealt.mapInArrow(link, "a long, b long, links long"), "links")
    groups = stash.put(connected_components(met.select("a", "b"), stash), "groups")
    counts = met.groupBy("a").agg(F.sum("links").alias("links"))
    known = classes.select("cls", "digest", "rep", "copies").join(counts, F.col("cls") == F.col("a"), "left").join(groups, F.col("cls") == F.col("node"), "left")
    known = stash.put(known.select("digest", "rep", "copies", F.col("copies") - 1 + F.coalesce("links", F.lit(0)), F.coalesce("component", "cls")).toDF("digest", "rep", "copies", "n_links", "root"), "known")
    best = known.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = stash.put(known.join(best, "root").select("digest", "n_links", "component_id", "copies"), "judged")
    out = rows.withColumn("digest", F.sha2("vec", 256)).select("vec_id", "digest")
    lone = out.where("digest is null").select("vec_id", F.lit(None).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component_id"))
    out = join_classes(out, known, "digest", "copies").select("vec_id", "n_links", "component_id").unionByName(lone)
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
