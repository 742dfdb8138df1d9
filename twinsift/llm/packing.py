"""Best-fit decreasing packing of token pieces into sequences of fixed capacity."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.bpe import encoder
from twinsift.llm.common import slices
from twinsift.stash import Stash, partitions

END = b"\x00\x00\x00\x00"
RANK_BITS = 48


def pieces(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded pieces ``(doc_id, piece, start, length, ids_crc32[, ids])`` of at most ``capacity`` tokens.

    A document is its ids followed by id 0; a null text is empty. A longer one is cut into full pieces, of
    which only the first may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in slices(batches, 256):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = code.encode(text) + END
                total, at = len(data) // 4, 0
                end = total % capacity or capacity
                for n in range(-(-total // capacity)):
                    part = data[4 * at : 4 * end]
                    row.append(i)
                    piece.append(n)
                    start.append(at)
                    length.append(end - at)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(part)
                    at, end = end, end + capacity
            out = [batch.column(0).take(pa.array(row, pa.int64()))]
            out += [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            out += [pa.array(ids, pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


class OpenBins:
    """Segment tree over remaining capacities 0..capacity: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.width)
        self.bins: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def _set(self, room: int, on: bool) -> None:
        i = room + self.width
        self.any[i] = on
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] or self.any[2 * i + 1]

    def add(self, room: int, first: int, last: int) -> None:
        """Bins ``first`` to ``last - 1`` each have ``room`` left."""
        if room and last > first:
            self.bins[room].append((first, last))
            self._set(room, True)

    def tightest(self, need: int) -> int | None:
        """Smallest remaining capacity of at least ``need`` that an open bin has, in logarithmic time."""
        i = need + self.width
        while not self.any[i]:
            while i & 1:
                i //= 2
            if i < 1:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if self.any[2 * i] else 2 * i + 1
        return i - self.width

    def take(self, room: int) -> tuple[int, int]:
        got = self.bins[room].pop()
        if not self.bins[room]:
            self._set(room, False)
        return got


def best_fit_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over a length histogram: ``(length, from_rank, to_rank, bin, per_bin, offset)``.

    Equal lengths follow each other, so after a piece of length s enters the tightest bin, that bin stays the
    tightest until it has no room for s: a run of equal bins takes ``room // s`` pieces each. The piece of rank
    r of a row goes to ``bin + (r - from_rank) // per_bin`` at ``offset + (r - from_rank) % per_bin * length``.
    The plan's size depends on the capacity only, however many pieces there are.
    """
    bins, made, plan = OpenBins(capacity), 0, []
    for s in sorted(counts, reverse=True):
        left, rank = counts[s], 0
        while left:
            room = bins.tightest(s)
            if room is None:
                room = capacity
                first, last = made, made + -(-left // (capacity // s))
                made = last
            else:
                first, last = bins.take(room)
            per = room // s
            full = min(last - first, left // per)
            if full:
                plan.append((s, rank, rank + full * per, first, per, capacity - room))
                bins.add(room - per * s, first, first + full)
                first, rank, left = first + full, rank + full * per, left - full * per
            if left and first < last:
                plan.append((s, rank, rank + left, first, per, capacity - room))
                bins.add(room - left * s, first, first + 1)
                first, rank, left = first + 1, rank + left, 0
            bins.add(room, first, last)
    return plan


def pack(found: DataFrame, stash: Stash, capacity: int = 2048) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces.

    Only the length histogram, of at most ``capacity`` rows, reaches the driver. Pieces get their rank among
    those of equal length from a count per (bucket, length) and a row number inside it; the bucket is a hash
    of the piece, so a length that many pieces share is spread over all tasks.
    """
    spark = stash.spark
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = sorted(best_fit_plan(counts, capacity))
    keys = np.array([(p[0] << RANK_BITS) + p[1] for p in plan], np.int64)
    table = np.array(plan, np.int64).reshape(-1, 6)
    buckets = max(16, min(4096, partitions(spark)))
    rows = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    per = rows.groupBy("bucket", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("bucket", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = rows.withColumn("nth", F.row_number().over(inside)).join(per, ["bucket", "length"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("nth") - 1).drop("bucket", "base", "nth")
    names = found.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << RANK_BITS) + rank, "right") - 1]
            nth = rank - row[:, 1]
            more = [pa.array(row[:, 3] + nth // row[:, 4]), pa.array(row[:, 5] + nth % row[:, 4] * length)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *more], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Packs all rows of ``docs`` into sequences of at most ``capacity`` tokens; one row per piece.

    Columns: those of :func:`pieces`, ``sequence_id`` and ``offset`` (gapless from 0 in each sequence). Null and
    empty texts are one piece that holds id 0; repeated rows and null ids are packed like any other; extra
    columns are ignored; no rows give no rows.
    """
    stash = Stash(docs.sparkSession)
    return pack(stash.put(pieces(docs, capacity, tokenizer, keep_ids, id_col, text_col), "pieces"), stash, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, n_tokens, ids binary)`` of pieces packed with ``keep_ids``; a sequence is of bounded size.

    Null document ids and extra columns change nothing; no pieces give no rows.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), whole.alias("ids"))
