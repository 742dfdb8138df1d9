"""One document of each group of texts that share four fifths of their five-word shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from twinsift.llm.common import as_bytes, join_classes, key_runs, run_starts, slices, space_words
from twinsift.llm.simhash import fold, shingle_hashes, trie_links
from twinsift.operators.components import connected_components
from twinsift.stash import Stash, partitions

#: Words of a shingle; a pair is near from a Jaccard similarity of NEAR[0] / NEAR[1].
SIZE, NEAR = 5, (4, 5)
#: Bands and minima of a band: a pair at 0.8 is in no common bucket with probability (1 - 0.8 ** 5) ** 20 = 0.04 %.
BANDS, MINIMA = 20, 5
#: Bands that are compared first, together with the links of the trie join.
FIRST = 2
#: Distinct shingle sets, and shingles, of one part of a bucket; a task compares two parts at most.
BLOCK, SHINGLES = 2048, 1_000_000
#: Dealt bucket entries that are sent to the tasks that read texts.
SENT = 500_000
_DRAW = np.random.default_rng(42).integers(0, 2**64, (2, BANDS * MINIMA, 1), np.uint64)
FACTORS, SHIFTS = _DRAW[0] | np.uint64(1), _DRAW[1]


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct shingle hashes of a text in order; null and wordless texts have none."""
    return np.unique(np.array(shingle_hashes(space_words(text), SIZE), np.uint64))


def band_keys(found: np.ndarray) -> list[int]:
    """Bucket of each band of a shingle set: a hash of the band's minima; none for the empty set."""
    if not len(found):
        return []
    mins = np.min([(found[at : at + 2048] * FACTORS + SHIFTS).min(axis=1) for at in range(0, len(found), 2048)], axis=0)
    rows = mins.reshape(BANDS, MINIMA)
    return np.array([xxhash.xxh64_intdigest(rows[i].tobytes(), i) for i in range(BANDS)], np.uint64).view(np.int64).tolist()


def near_links(flat: np.ndarray, at: np.ndarray) -> list[tuple[int, int]]:
    """Links that join just the sets which near pairs join; set i is ``flat[at[i]:at[i + 1]]``, in order, never empty.

    Each set that is reached is compared with all that are not yet, so a group costs few comparisons a set.
    """
    sizes = np.diff(at)
    out: list[tuple[int, int]] = []
    rest = np.arange(len(sizes))
    while len(rest) > 1:
        queue, rest = [int(rest[0])], rest[1:]
        others = None
        while queue and len(rest):
            if others is None:
                starts = np.cumsum(sizes[rest]) - sizes[rest]
                others = flat[np.arange(sizes[rest].sum()) + np.repeat(at[rest] - starts, sizes[rest])]
            p = queue.pop()
            own = flat[at[p] : at[p + 1]]
            same = own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others
            common = np.add.reduceat(same.astype(np.int64), starts)
            near = common * NEAR[1] >= (sizes[p] + sizes[rest] - common) * NEAR[0]
            if near.any():
                found = rest[near].tolist()
                out += [(p, i) for i in found]
                queue += found
                rest, others = rest[~near], None
    return out


def parts_of(sets: Column, shingles: Column, block: int) -> Column:
    return F.greatest(F.ceil(sets / block), F.ceil(shingles / SHINGLES)).cast("int")


def first_buckets(entries: DataFrame, stash: Stash, block: int = BLOCK) -> DataFrame:
    """``(key, c, parts)`` of the buckets of ``entries(key, _fp, _n)`` with several sets; of buckets of the same sets one stays.

    A bucket of more than ``block`` sets or SHINGLES shingles has several parts.
    """
    digests = [F.bit_xor(F.xxhash64("_fp", F.lit(i))).alias(f"d{i}") for i in range(2)]
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("_n").alias("s"), *digests).where("c > 1")
    sizes = sizes.groupBy("c", "s", "d0", "d1").agg(F.min("key").alias("key"))
    return stash.put(sizes.select("key", "c", parts_of(F.col("c"), F.col("s"), block).alias("parts")), "buckets")


def deal_twice(entries: DataFrame, buckets: DataFrame, stash: Stash) -> DataFrame:
    """``(key, x, y, _fp, _row)``: each set of a cut bucket in two parts by two hashes, so that parts overlap at random.

    A group of near copies so becomes one, however many parts it fills, and its sets are sent twice only.
    """
    part = lambda i: F.struct(F.pmod(F.xxhash64("_fp", F.lit(i)), F.col("parts")).cast("int").alias("x"), F.lit(i).alias("y"))
    spots = F.when(F.col("parts") == 1, F.array(part(0))).otherwise(F.array(part(0), part(1)))
    rows = join_classes(entries.select("key", "_fp", "_row"), buckets, "key", "c").withColumn("spot", F.explode(spots))
    return stash.put(rows.select("key", "spot.x", "spot.y", "_fp", "_row"), "entries")


def open_buckets(entries: DataFrame, stash: Stash, block: int = BLOCK) -> DataFrame:
    """``(key, c, main, po, pm)`` of the buckets of ``entries(key, _fp, _n, _root)`` that still hold several groups.

    ``main`` is the group with most sets. Its sets are linked already and fill ``pm`` parts; all other sets fill ``po``.
    A bucket that needs no cut has ``pm`` 0.
    """
    digests = [F.bit_xor(F.xxhash64("_fp", F.lit(i))).alias(f"d{i}") for i in range(2)]
    per = entries.groupBy("key", "_root").agg(F.count(F.lit(1)).alias("c"), F.sum("_n").alias("s"), *digests)
    sums = [F.sum("c").alias("c"), F.sum("s").alias("s"), *(F.bit_xor(d).alias(d) for d in ("d0", "d1"))]
    whole = per.groupBy("key").agg(*sums, F.count(F.lit(1)).alias("roots"), F.max(F.struct("c", "_root", "s")).alias("m"))
    whole = whole.where("roots > 1").groupBy("c", "s", "d0", "d1").agg(F.min("key").alias("key"), F.min("m").alias("m"))
    one = parts_of(F.col("c"), F.col("s"), block) == 1
    others = parts_of(F.col("c") - F.col("m.c"), F.col("s") - F.col("m.s"), block)
    pm = F.when(one, 0).otherwise(parts_of(F.col("m.c"), F.col("m.s"), block))
    return stash.put(whole.select("key", "c", F.col("m._root").alias("main"), F.when(one, 1).otherwise(others).alias("po"), pm.alias("pm")), "buckets")


def deal_open(entries: DataFrame, buckets: DataFrame, stash: Stash) -> DataFrame:
    """``(key, x, y, _fp, _row)``: each pair of parts of a bucket meets, but for two parts of its main group."""
    rows = join_classes(entries.select("key", "_fp", "_row", "_root"), buckets, "key", "c")
    main = (F.col("_root") == F.col("main")) & (F.col("pm") > 0)
    at = F.xxhash64("_fp")
    own = F.when(main, F.col("po") + F.pmod(at, F.greatest("pm", F.lit(1)))).otherwise(F.pmod(at, F.col("po"))).cast("int")
    last = F.when(main, F.col("po")).otherwise(F.col("po") + F.col("pm")) - 1
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
    return stash.put(rows.select("key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "_fp", "_row"), "entries")


def bucket_links(entries: DataFrame, texts: DataFrame, stash: Stash) -> DataFrame:
    """Links ``(a, b)`` that join the near sets of each ``(key, x, y)`` of ``entries``, checked exactly.

    Only the sets of ``entries`` are made again from ``texts(_row, _fp, _text)`` and sent there.
    """
    spark = stash.spark

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [shingle_set(t).tobytes() for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["_fp", "found"])

    small = entries.count() <= SENT  # beyond it the texts, and then the sets, are shuffled once each
    sent = F.broadcast if small else lambda df: df
    own = texts.join(sent(entries.select("_row").distinct()), "_row", "left_semi")
    found = own.select("_fp", "_text").mapInArrow(sets, "_fp long, found binary")
    keys = ["key", "x", "y"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(slices(batches, 256), keys, 512):
            starts = run_starts(table, keys)
            fps = table.column("_fp").to_numpy()
            a, b = [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if hi - lo < 2:
                    continue
                own = [np.frombuffer(x, np.uint64) for x in table.column("found").slice(lo, hi - lo).to_pylist()]
                for i, j in near_links(np.concatenate(own), np.cumsum([0, *map(len, own)])):
                    a.append(fps[lo + i])
                    b.append(fps[lo + j])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = found.join(sent(entries.drop("_row")), "_fp").select(*keys, "_fp", "found")
    dealt = dealt.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return stash.put(dealt.mapInArrow(link, "a long, b long"), "links")


def groups(marked: DataFrame, stash: Stash, block: int = BLOCK) -> DataFrame:
    """``(_fp, _root)``: groups of near sets of ``marked(_fp, _sim, _keys, _n, _row, _text)``; lone sets are left out.

    First come the sets whose SimHash fingerprints the trie join links, and FIRST bands; most near copies meet there.
    Then only those buckets are compared in full, of the other bands and of the cut ones before, that still hold sets
    of different groups. So the sets of a group are sent few times, and yet no pair that shares any band is lost.
    """
    classes = stash.put(marked.where("_n > 0").select("_fp", "_sim", "_keys", "_n", "_row").dropDuplicates(["_fp"]), "classes")
    tries = connected_components(stash.put(trie_links(classes.select(F.col("_sim").alias("fp")).distinct(), stash), "tries"), stash)
    tries = tries.select(F.col("node").alias("_sim"), F.xxhash64("component").alias("key"))

    def first(rows: DataFrame) -> DataFrame:
        return rows.join(tries, "_sim").select("key", *names).unionByName(bands(rows, 1, FIRST))

    def bands(rows: DataFrame, at: int, n: int) -> DataFrame:
        return rows.select(F.explode(F.slice("_keys", at, n)).alias("key"), *names)

    names = ["_fp", "_n", "_row"]
    buckets = first_buckets(first(classes), stash, block)
    links = bucket_links(deal_twice(first(classes), buckets, stash), marked, stash)
    roots = connected_components(links, stash).select(F.col("node").alias("_fp"), F.col("component").alias("_root"))
    names.append("_root")
    rooted = stash.put(classes.join(roots, "_fp", "left").withColumn("_root", F.coalesce("_root", "_fp")), "rooted")
    cut = first(rooted).join(buckets.where("parts > 1").select("key"), "key", "left_semi")
    entries = bands(rooted, FIRST + 1, BANDS).unionByName(cut)
    more = bucket_links(deal_open(entries, open_buckets(entries, stash, block), stash), marked, stash)
    roots = connected_components(links.unionByName(more), stash)
    return stash.put(roots.select(F.col("node").alias("_fp"), F.col("component").alias("_root")), "roots")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of ``docs`` for each group of near copies, with all its columns.

    Texts are linked from a Jaccard similarity of 0.8 of their sets of five-word shingles (lower-cased words; a
    shorter text is one shingle). Candidates are texts that the SimHash trie join links (4 of 64 bits) and, as those
    miss most pairs near 0.8, texts that share a band of minima; every link is checked exactly. The row with the
    smallest id stays, null ids last, then by the hash of its text. Rows are told apart by themselves, so null
    and repeated ids follow the same rule. Null and wordless texts are one group. The caller's columns go by numbers
    meanwhile, so any names are free; an empty table stays empty.
    """
    stash = Stash(docs.sparkSession)
    at = docs.columns.index(text_col)
    given = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text, row_id = F.col(f"c{at}"), F.col(f"c{docs.columns.index(id_col)}")
    names = [*given.columns, "_fp", "_sim", "_n", "_keys"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [shingle_set(t) for t in as_bytes(batch.column(at))]
            fps = np.array([xxhash.xxh64_intdigest(x.tobytes(), 42) for x in found], np.uint64).view(np.int64)
            sizes = np.array([len(x) for x in found], np.int64)
            sims = fold(np.concatenate(found), sizes).view(np.int64) if found else np.zeros(0, np.int64)
            more = [pa.array(fps), pa.array(sims), pa.array(sizes), pa.array([band_keys(x) for x in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names)

    schema = StructType([*given.schema.fields]).add("_fp", "long").add("_sim", "long").add("_n", "long").add("_keys", ArrayType(LongType()))
    marked = stash.put(given.mapInArrow(mark, schema).withColumn("_row", F.monotonically_increasing_id()), "marked")
    roots = groups(marked.withColumn("_text", text), stash, block)
    order = F.struct(row_id.isNull(), row_id.alias("id"), F.xxhash64(text), F.col("_row"))
    rows = marked.select("_fp", "_row", order.alias("_order")).join(roots, "_fp", "left")
    best = rows.groupBy(F.coalesce("_root", "_fp").alias("_root")).agg(F.min("_order").getField("_row").alias("_row"))
    return marked.join(best.select("_row"), "_row", "left_semi").select(*given.columns).toDF(*docs.columns)
