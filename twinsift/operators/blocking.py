"""Hamming joins by blocks of bits."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.operators.sorting import number_rows, whole_groups
from twinsift.stash import Stash, partitions

#: A copy of a row costs about as much as this many comparisons (both measured on half a million hashes).
COPY_COST = 6
#: Copies of a row at most; more prefixes than this never pay.
MAX_COPIES = 500
#: Needles that are sent to every task without blocks of bits, and rows that a broadcast join may build.
FEW, SENT = 1000, 300_000
#: Rows of one key on one side that a task meets at most; larger keys are dealt to a grid of parts.
HOT = 2048
#: Copies of rows of one side that a task of a join by keys sorts, about.
ENTRIES = 1_000_000
#: Pairs of a join by sampled bits that a task compares, about.
PAIRS = 20_000_000
#: Hashes of a part of :func:`nearest_hashes`, about.
PART = 16_384

#: Of :func:`nearest_in_tables`: pairs of a task, about; pairs compared at a time, in the cache; comparisons that a copy of a row
#: costs; and pairs of a bucket, on average, from which on arrays pay.
TASK_PAIRS, CELLS, ARRAY_COPY, ARRAY_PAIRS = 500_000_000, 1 << 18, 500, 100


def distance(left: list[Column], right: list[Column]) -> Column:
    out = F.lit(0)
    for a, b in zip(left, right):
        out = out + F.bit_count(a.bitwiseXOR(b))
    return out


def hash_bits(words: int, radix: int = 0) -> list[int]:
    """Bits that blocks are made of: a single word leaves out its unused bit 0, and bits that a radix key has taken."""
    return list(range(1 + radix, 64)) if words == 1 else list(range(64 * words))


def block_cost(left: int, right: int, errors: int, bits: int, blocks: int | None = None, room: float = 1.0) -> float:
    """Comparisons, and copies of rows in their measure, of a join by so many blocks (or by the cheapest number)."""
    if blocks is None:
        blocks = choose_blocks(left, right, errors, bits, room)
    return comb(blocks, errors) * (COPY_COST * (left + right) + room * left * right / 2 ** (bits * (blocks - errors) // blocks))


def choose_blocks(left: int, right: int, errors: int, bits: int, room: float = 1.0) -> int:
    """Number of blocks for two sides of so many rows; ``room`` is the share of pairs that another key leaves.

    Hashes within ``errors`` bits agree on some ``m - errors`` of ``m`` blocks. More blocks give longer keys, so
    fewer pairs are compared, and more copies of each row: the cheapest sum is taken. As the rows grow the keys
    do, and the pairs compared stay far below the square of the rows.
    """
    able = [m for m in range(errors + 1, bits + 1) if m == errors + 1 or comb(m, errors) <= MAX_COPIES]
    return min(able, key=lambda m: block_cost(left, right, errors, bits, m, room))


def block_masks(bits: list[int], blocks: int, words: int) -> list[list[int]]:
    """Masks by word of consecutive blocks of bits, as signed 64-bit numbers."""
    cuts = [len(bits) * i // blocks for i in range(blocks + 1)]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        masks = [0] * words
        for bit in bits[a:b]:
            masks[bit // 64] |= 1 << bit % 64
        out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def _keys(words: list[Column], masks: list[list[int]], errors: int) -> Column:
    """One struct per choice of ``len(masks) - errors`` blocks: its bit set ``c`` and the values in it."""
    out = []
    for choice in combinations(range(len(masks)), len(masks) - errors):
        united = [reduce(int.__or__, (masks[i][w] for i in choice)) for w in range(len(words))]
        parts = [w.bitwiseAND(F.lit(m).cast("long")) for w, m in zip(words, united) if m]
        key = parts[0] if len(parts) == 1 else F.xxhash64(*parts)
        out.append(F.struct(key.alias("key"), F.lit(sum(1 << i for i in choice)).cast("long").alias("c")))
    return F.array(*out)


def _agreed(diffs: list[Column], masks: list[list[int]]) -> Column:
    """Bit set of the blocks in which two hashes agree."""
    out = F.lit(0).cast("long")
    for i, block in enumerate(masks):
        parts = [d.bitwiseAND(F.lit(m).cast("long")) for d, m in zip(diffs, block) if m]
        out = out.bitwiseOR(F.when(reduce(Column.bitwiseOR, parts) == 0, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def _is_first(agreed: Column, c: Column) -> Column:
    """Whether a choice of blocks is the first among those that agree: no other of them lies below its highest."""
    more = agreed.bitwiseXOR(c)
    return (more == 0) | (more.bitwiseAND(F.negate(more)) > c)


def _hot_keys(sides: list[tuple[DataFrame, DataFrame, Column]], by: list[str], rows: int, stash: Stash) -> DataFrame | None:
    """``(_key, _c, by.., _pl, _pr)``: keys with more than HOT rows on a side, and their parts; ``None`` if there can be none.

    Each side is ``(rows, entries, values of blocks)``, of ``rows`` rows at most. No key has more rows than any of its
    blocks has, so counts of blocks, by some hash buckets of their values, tell most inputs that no key needs to be counted.
    """
    buckets = max(1 << 16, 8 * rows // HOT)
    for own, _, values in sides:
        single = own.select(F.posexplode(values).alias("i", "v"), *by).groupBy("i", F.pmod("v", F.lit(buckets)).alias("v"), *by).count()
        if (single.agg(F.max("count")).first()[0] or 0) > HOT:
            break
    else:
        return None
    counted = [e.select("_key", "_c", *by, F.lit(1 - i).alias("l"), F.lit(i).alias("r")) for i, (_, e, _) in enumerate(sides)]
    sizes = counted[0].unionByName(counted[1]).groupBy("_key", "_c", *by).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    parts = [F.ceil(F.col(n) / HOT).cast("int").alias(f"_p{n}") for n in "lr"]
    return stash.put(sizes.where(f"l > 0 and r > 0 and greatest(l, r) > {HOT}").select("_key", "_c", *by, *parts), "hot_keys")


def _deal(entries: DataFrame, hot: DataFrame, keys: list[str], words: list[str], own: str, other: str) -> DataFrame:
    """Numbers the part of each entry of a hot key on its own side, and copies it to all parts of the other."""
    rows = entries.hint("merge").join(hot, keys, "left")  # what is sent is chosen by counts, see :func:`_by_keys`
    parts = [F.coalesce(p, F.lit(1)) for p in (own, other)]
    rows = rows.withColumn(own[1:], F.pmod(F.xxhash64(*words), parts[0]).cast("int"))
    return rows.withColumn(other[1:], F.explode(F.sequence(F.lit(0), parts[1] - 1))).drop(own, other)


def _meet(left: DataFrame, right: DataFrame, sizes: tuple[int, int], threshold: int, lw: list[str], rw: list[str], stash: Stash, radix: int = 0, extra: Column | None = None) -> DataFrame:
    """Pairs of rows of two written tables by keys of blocks; ``extra`` is a further condition on a pair."""
    errors = threshold - 1
    bits = hash_bits(len(lw), radix)
    masks = block_masks(bits, choose_blocks(*sizes, errors, len(bits), 2.0**-radix), len(lw))
    own, theirs = [F.col(w) for w in lw], [F.col(w) for w in rw]
    by = ["_radix"] if radix else []

    def bucketed(df: DataFrame, words: list[Column]) -> DataFrame:
        return df.withColumn("_radix", radix_key(words[0], radix)) if radix else df

    def spread(df: DataFrame, words: list[Column]) -> DataFrame:
        return df.select("*", F.inline(_keys(words, masks, errors)).alias("_key", "_c"))

    def singles(words: list[Column]) -> Column:
        return F.array(*(F.xxhash64(*(w.bitwiseAND(F.lit(m).cast("long")) for w, m in zip(words, block))) for block in masks))

    keys = ["_key", "_c", *by]
    rows = bucketed(left, own), bucketed(right, theirs)
    a, b = spread(rows[0], own), spread(rows[1], theirs)
    few = sizes[0] * comb(len(masks), errors) <= SENT
    copies = comb(len(masks), errors)
    a, b, on = _by_keys((rows[0], a, singles(own)), (rows[1], b, singles(theirs)), keys, lw, rw, max(sizes), copies, few, stash)
    near = distance(own, theirs) < threshold
    if extra is not None:
        near = extra & near
    diffs = [x.bitwiseXOR(y) for x, y in zip(own, theirs)]
    first = _is_first(_agreed(diffs, masks), F.col("_c"))
    met = a.join(b, on).where(near & first)
    return met.select(*left.columns, *right.columns, distance(own, theirs).alias("distance"))


def _by_keys(left: tuple, right: tuple, keys: list[str], lw: list[str], rw: list[str], rows: int, copies: int, few: bool, stash: Stash, pairs: int = 0) -> tuple[DataFrame, DataFrame, Column]:
    """Entries of both sides, ``(rows, entries, values of blocks)`` each, with the condition on which they meet.

    A few on the left are sent; else keys of more than HOT rows are dealt to a grid of parts. A row has ``copies`` entries:
    where the session's shuffle partitions would hold more than ENTRIES of them, there are more tasks, not larger ones.
    Where ``pairs``, the pairs that meet, are more than PAIRS, tasks follow their number too: entries of few bytes, which Spark
    would put into few tasks, may make any number of pairs.
    """
    (_, a, _), (_, b, _) = left, right
    if few:
        a = F.broadcast(a)
    else:
        hot = _hot_keys([left, right], keys[2:], rows, stash)
        n = 0 if hot is None else hot.count()
        if n:
            hot = F.broadcast(hot) if n <= SENT // 5 else hot
            a, b = _deal(a, hot, keys, lw, "_pl", "_pr"), _deal(b, hot, keys, rw, "_pr", "_pl")
            keys = [*keys, "pl", "pr"]
        tasks = max(-(-rows * copies // ENTRIES), -(-pairs // PAIRS))
        if pairs > PAIRS or tasks > partitions(a.sparkSession):
            tasks = max(tasks, partitions(a.sparkSession))
            a, b = a.repartition(tasks, *keys), b.repartition(tasks, *keys)
        b = b.hint("merge")  # last, as a join drops it: by the size of its files Spark would send a side, but each row has many copies
    b = b.withColumnsRenamed({k: f"{k}_" for k in keys})
    return a, b, reduce(Column.__and__, (F.col(k) == F.col(f"{k}_") for k in keys))


def sampled_masks(bits: int, tables: int, of: int, seed: int = 7) -> list[list[int]]:
    """Masks by word, as signed 64-bit numbers, of ``tables`` random choices of ``bits`` of ``of`` bits."""
    rng = random.Random(seed)
    return [block_masks(sorted(rng.sample(range(of), bits)), 1, -(-of // 64))[0] for _ in range(tables)]


def sample_plan(rows: int, errors: int, of: int, miss: float, load: float = 8.0) -> tuple[int, int]:
    """Bits of a table and tables: a hash shares its bucket with about ``load`` random ones of ``rows``, and a pair that
    differs in ``errors`` bits is in no common bucket with probability ``miss`` at most."""
    bits = max(4, min(48, math.ceil(math.log2(max(rows / load, 2)))))
    share = math.comb(of - errors, bits) / math.comb(of, bits)
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-share)))


def sampled_join(
    left: DataFrame, right: DataFrame, threshold: int, left_words: list[str], right_words: list[str], miss: float = 0.02, plan: tuple[int, int] | None = None
) -> DataFrame:
    """Like :func:`hamming_join`, but a pair at the threshold is lost with probability ``miss``; closer ones less.

    Each of some tables looks at few random bits, by far fewer copies of a row than exact blocks need over wide hashes.
    A pair is taken at the first table in which it meets. ``plan`` gives bits and tables; otherwise :func:`sample_plan`
    takes them from the row counts. Null hashes meet nothing; hot buckets are dealt to parts as in the exact join.
    """
    stash, of = Stash(left.sparkSession), 64 * len(left_words)
    rows = stash.put(left.dropna(subset=left_words), "left"), stash.put(right.dropna(subset=right_words), "right")
    sizes = rows[0].count(), rows[1].count()
    masks = sampled_masks(*(plan or sample_plan(max(sizes), min(threshold - 1, of - 48), of, miss)), of)
    words = [F.col(w) for w in left_words], [F.col(w) for w in right_words]

    def keys(of_words: list[Column]) -> list[Column]:
        return [F.xxhash64(*(w.bitwiseAND(F.lit(m).cast("long")) for w, m in zip(of_words, mask) if m)) for mask in masks]

    def side(i: int) -> tuple:
        entries = F.array(*(F.struct(k.alias("key"), F.lit(t).cast("long").alias("c")) for t, k in enumerate(keys(words[i]))))
        return rows[i], rows[i].select("*", F.inline(entries).alias("_key", "_c")), F.array(*keys(words[i]))

    few = sizes[0] * len(masks) <= SENT
    pairs = 0 if few else _pairs_of([side(i)[1] for i in (0, 1)])
    a, b, on = _by_keys(side(0), side(1), ["_key", "_c"], left_words, right_words, max(sizes), len(masks), few, stash, pairs)
    diffs = [x.bitwiseXOR(y) for x, y in zip(*words)]
    same = [reduce(Column.bitwiseOR, (d.bitwiseAND(F.lit(m).cast("long")) for d, m in zip(diffs, mask) if m)) == 0 for mask in masks]
    first = reduce(lambda later, t: F.when(same[t], F.lit(t)).otherwise(later), reversed(range(len(masks))), F.lit(-1))
    met = a.join(b, on).where((distance(*words) < threshold) & (first == F.col("_c")))
    return met.select(*left.columns, *right.columns, distance(*words).alias("distance"))


def _pairs_of(entries: list[DataFrame]) -> int:
    """Pairs of entries of two sides, ``(_key, _c)``, with equal keys."""
    both = reduce(DataFrame.unionByName, (e.select("_key", "_c", F.lit(1 - i).alias("l"), F.lit(i).alias("r")) for i, e in enumerate(entries)))
    sizes = both.groupBy("_key", "_c").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return int(sizes.agg(F.sum(F.col("l").cast("double") * F.col("r"))).first()[0] or 0)


def hamming_join(left: DataFrame, right: DataFrame, threshold: int, left_words: list[str], right_words: list[str], radix: int = 0) -> DataFrame:
    """Rows of both sides, whose column names must differ, with ``distance < threshold``, at any threshold up to the bits.

    Up to FEW rows on the left are sent to every task, and the right side is read once where it lies. Beyond that
    hashes within a budget of bits agree on some blocks of bits, and these are the keys of a hash join that loses no
    pair (see :func:`choose_blocks`). A pair that agrees on more blocks is taken at the first choice of them, which
    needs no second shuffle. Where comparing all is cheaper than keys, the left rows are sent in blocks, one after the other.

    With ``radix`` only hashes that are equal in so many bits above the unused one are compared (approximate); the
    bits are a further key. Null hashes meet nothing; repeated rows are pairs of their own.
    """
    own, theirs = [F.col(w) for w in left_words], [F.col(w) for w in right_words]
    near = distance(own, theirs) < threshold
    same = radix_key(own[0], radix) == radix_key(theirs[0], radix) if radix else F.lit(True)
    if threshold < 1:
        return left.join(right, F.lit(False)).withColumn("distance", F.lit(0))
    if left.limit(FEW + 1).count() <= FEW:
        return right.join(F.broadcast(left), near & same).select(*left.columns, *right.columns, distance(own, theirs).alias("distance"))
    stash = Stash(left.sparkSession)
    a, b = stash.put(left.dropna(subset=left_words), "left"), stash.put(right.dropna(subset=right_words), "right")
    sizes, bits = (a.count(), b.count()), len(hash_bits(len(left_words), radix))
    if threshold > bits or (not radix and block_cost(*sizes, threshold - 1, bits) > sizes[0] * sizes[1]):
        return scan_blocks(a, b, threshold, left_words, right_words, same)
    return _meet(a, b, sizes, threshold, left_words, right_words, stash, radix)


def hamming_pairs(rows: DataFrame, threshold: int, word: str, id_col: str, radix: int = 0) -> DataFrame:
    """``(id_a, id_b, distance)`` with ``id_a < id_b`` of near rows of one table; hashes and ids are written once.

    By keys of blocks of bits, or by :func:`tiled_pairs` where that compares less: few rows, or wide thresholds, up to
    those that all pairs are below. Ids must be distinct; null hashes meet nothing.
    """
    stash = Stash(rows.sparkSession)
    if threshold < 1:
        return rows.sparkSession.createDataFrame([], f"id_a {rows.schema[id_col].dataType.simpleString()}, id_b {rows.schema[id_col].dataType.simpleString()}, distance int")
    own = stash.put(rows.where(F.col(word).isNotNull()).select(F.col(id_col).alias("id"), F.col(word).alias("h")), "hashes")
    n = own.count()
    if tiles_pay(n, threshold, radix):
        return tiled_pairs(own, threshold, radix, stash)
    found = _meet(own.toDF("id_a", "ha"), own.toDF("id_b", "hb"), (n, n), threshold, ["ha"], ["hb"], stash, radix, F.col("id_a") < F.col("id_b"))
    return found.select("id_a", "id_b", "distance")


def tiles_pay(rows: int, threshold: int, radix: int = 0) -> bool:
    """Whether comparing each pair of a radix bucket once costs less than keys of blocks, which find wide pairs repeatedly."""
    bits = len(hash_bits(1, radix))
    if threshold > bits:
        return True
    bucket = rows * 2.0**-radix
    tiles = rows * bucket / 2 + COPY_COST * rows * (1 + bucket / HOT)
    return tiles < block_cost(rows, rows, threshold - 1, bits, room=2.0**-radix)


def tiled_pairs(rows: DataFrame, threshold: int, radix: int, stash: Stash) -> DataFrame:
    """:func:`hamming_pairs` of a written table ``(id, h)`` by a triangle of tiles in each radix bucket.

    A bucket is cut by a hash of the id into parts of about HOT rows, part ``p`` goes to the left of the tiles ``(p, y)``,
    ``y >= p``, and to the right of ``(x, p)``, ``x <= p``. So every pair of a bucket meets in one tile, in one task
    of bounded size, and tasks are as many as tiles.
    """
    bucket = radix_key(F.col("h"), radix) if radix else F.lit(0).cast("long")
    own = rows.select("id", "h", bucket.alias("_b"))
    parts = F.broadcast(own.groupBy("_b").agg(F.ceil(F.count(F.lit(1)) / HOT).cast("int").alias("_n")))  # 2 ** radix rows at most
    own = own.join(parts, "_b").withColumn("_p", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    left = own.select("_b", F.col("_p").alias("_x"), F.explode(F.sequence("_p", F.col("_n") - 1)).alias("_y"), F.col("id").alias("ia"), F.col("h").alias("ha"))
    right = own.select("_b", F.explode(F.sequence(F.lit(0), "_p")).alias("_x"), F.col("_p").alias("_y"), F.col("id").alias("ib"), F.col("h").alias("hb"))
    near = distance([F.col("ha")], [F.col("hb")])
    once = (F.col("_x") < F.col("_y")) | (F.col("ia") < F.col("ib"))
    met = left.join(right.hint("merge"), ["_b", "_x", "_y"]).where((near < threshold) & once)
    return met.select(F.least("ia", "ib").alias("id_a"), F.greatest("ia", "ib").alias("id_b"), near.alias("distance"))


def in_blocks(rows: DataFrame, most: int, stash: Stash) -> list[DataFrame]:
    """Cuts rows into written blocks of at most ``most``, by a number within partitions and the partitions' counts."""
    dealt = stash.put(rows.withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "rows")
    at, starts = 0, []
    for r in dealt.groupBy("_part").count().orderBy("_part").collect():
        starts.append((r["_part"], at))
        at += r["count"]
    first = rows.sparkSession.createDataFrame(starts, "_part int, _first long")
    block = F.floor((F.col("_first") + F.col("_nth")) / most).cast("int")
    dealt = stash.put(dealt.join(F.broadcast(first), "_part").withColumn("_block", block).drop("_part", "_nth", "_first"), "blocks")
    return [dealt.where(F.col("_block") == i).drop("_block") for i in range(-(-at // most))]


def scan_blocks(needles: DataFrame, haystack: DataFrame, threshold: int, needle_words: list[str], words: list[str], also: Column | None = None, most: int = 100_000) -> DataFrame:
    """Rows with ``distance < threshold`` by comparing all, for any number of needles.

    Needles are sent to the tasks in blocks of at most ``most`` rows, one after the other; the haystack is read once
    for each and never shuffled.
    """
    d = distance([F.col(w) for w in needle_words], [F.col(w) for w in words])
    cols = [*needles.columns, *haystack.columns]
    scan = lambda part: haystack.join(F.broadcast(part), d < threshold if also is None else also & (d < threshold)).select(*cols, d.alias("distance"))
    if needles.limit(most + 1).count() <= most:
        return scan(needles)
    stash = Stash(needles.sparkSession)
    return reduce(DataFrame.unionByName, (stash.put(scan(part), "found") for part in in_blocks(needles, most, stash)))


def nearest_hashes(needles: DataFrame, rows: DataFrame, threshold: int, stash: Stash) -> DataFrame:
    """``(h, id, distance)``: of the distinct hashes ``needles(h)`` the nearest of ``rows(id, g)`` below the threshold.

    Ties take the smallest id. Equal hashes are joined. The others, for which wide thresholds leave no block of bits to agree
    on, are cut into parts of about PART hashes on both sides, and each pair of parts is a row of two arrays that a task
    compares in its cache. So only the nearest of a hash and part is handed on, not a row for every pair, and a task holds
    a few parts however many there are. Pairs still grow with the square of the hashes.
    """
    own = stash.put(needles.where("h is not null").join(rows.withColumnRenamed("g", "h").groupBy("h").agg(F.min("id").alias("id")).hint("merge"), "h", "left"), "asked")
    equal, left = own.where("id is not null").select("h", "id", F.lit(0).alias("distance")), own.where("id is null").select("h")
    if threshold < 2:
        return equal.where(F.lit(threshold == 1))
    hay = stash.put(rows.where("g is not null").groupBy("g").agg(F.min("id").alias("id")), "hay")
    parts = [max(1, -(-side.count() // PART)) for side in (left, hay)]
    kind = hay.schema["id"].dataType.simpleString()

    def packed(side: DataFrame, word: str, n: int, own: str, other: str, m: int) -> DataFrame:
        dealt = side.withColumn(own, F.pmod(F.xxhash64(word), F.lit(n)).cast("int")).groupBy(own)
        return dealt.agg(*(F.collect_list(c).alias(f"{c}s") for c in side.columns)).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asked, hashes, ids = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("hs", "gs", "ids"))
                order = np.argsort(ids)  # the first of equally near ones has the smallest id
                at, nth, least = nearest_of(asked.view(np.uint64), hashes[order].view(np.uint64), threshold)
                columns = [pa.array(asked[at]), pa.array(ids[order][nth], batch.schema.field("ids").type.value_type), pa.array(least, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["h", "id", "distance"])

    tiles = packed(left, "h", parts[0], "x", "y", parts[1]).join(packed(hay.select("id", "g"), "g", parts[1], "y", "x", parts[0]).hint("merge"), ["x", "y"])
    met = tiles.repartition(parts[0] * parts[1], "x", "y").select("hs", "gs", "ids").mapInArrow(run, f"h long, id {kind}, distance int")
    best = met.groupBy("h").agg(F.min(F.struct("distance", "id")).alias("x")).select("h", "x.id", "x.distance")
    return equal.unionByName(best)


def nearest_of(asked: np.ndarray, hashes: np.ndarray, threshold: int, rows: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the hashes that have one below the threshold, and the place and distance of the first nearest one."""
    places, nths, leasts = [], [], []
    diffs = np.empty((rows, len(hashes)), np.uint64)
    for at in range(0, len(asked) if len(hashes) else 0, rows):
        some = asked[at : at + rows]
        d = np.bitwise_count(np.bitwise_xor(some[:, None], hashes, out=diffs[: len(some)]))
        least = d.min(1)
        near = np.nonzero(least < threshold)[0]
        if len(near):
            places.append(at + near)
            nths.append(d[near].argmin(1))
            leasts.append(least[near])
    join = lambda arrays: np.concatenate(arrays).astype(np.int64) if arrays else np.zeros(0, np.int64)
    return join(places), join(nths), join(leasts)


def nearest_in_tables(
    asked: DataFrame, rows: DataFrame, threshold: int, best: int, own: list[str], words: list[str], plan: tuple[int, int] | None, stash: Stash
) -> DataFrame | None:
    """``(own.., words.., _first, distance)``: the ``best`` nearest of distinct hashes ``rows(words.., _first)`` below the threshold for
    each of the distinct hashes ``asked(own..)``; ties go by ``_first``, a struct. ``None`` where a plain join costs less.

    The pairs are those of :func:`hamming_join`, or with a ``plan`` of bits and tables those of :func:`sampled_join`: hashes that agree on
    a table's bits are in one of its buckets. Wide thresholds leave few bits for a key, so that a bucket holds many hashes;
    tasks compare it as arrays in their cache and hand on the best of each hash only, not the pairs. A hash that is on both sides
    is one entry. A bucket of more than PART hashes is dealt to a grid of parts.
    """
    of = 64 * len(words)
    sizes = asked.count(), rows.count()
    if sizes[0] * sizes[1] <= PAIRS or not 0 < threshold <= of // 2:
        return None
    if plan:
        tables = sampled_masks(*plan, of)
    else:
        bits, errors = hash_bits(len(words)), threshold - 1
        able = [m for m in range(errors + 1, len(bits) + 1) if m == errors + 1 or comb(m, errors) <= MAX_COPIES]
        cost = lambda m: comb(m, errors) * (ARRAY_COPY * sum(sizes) + sizes[0] * sizes[1] / 2 ** (len(bits) * (m - errors) // m))
        blocks = block_masks(bits, min(able, key=cost), len(words))
        tables = [[reduce(int.__or__, x) for x in zip(*choice)] for choice in combinations(blocks, len(blocks) - errors)]

    roles = asked.toDF(*words).select(*words, F.lit(1).alias("_role"), F.lit(None).cast(rows.schema["_first"].dataType).alias("_first"))
    hashes = roles.unionByName(rows.select(*words, F.lit(2).alias("_role"), "_first")).groupBy(*words).agg(F.sum("_role").alias("_role"), F.max("_first").alias("_first"))
    hashes = stash.put(number_rows(hashes, [F.col("_first"), *(F.col(w) for w in words)], "_id"), "hashes")  # so ids are in the order of ties
    key = lambda t: F.xxhash64(*(F.col(w).bitwiseAND(F.lit(m).cast("long")) for w, m in zip(words, t) if m))
    at = F.array(*(F.struct(F.lit(i).cast("long").alias("t"), key(t).alias("key")) for i, t in enumerate(tables)))
    entries = hashes.select(F.inline(at), "_id", F.col("_role").cast("long").alias("_role"), *words)
    counts = entries.groupBy("t", "key").agg(F.sum(F.col("_role").bitwiseAND(1)).alias("l"), F.sum(F.shiftright("_role", 1)).alias("r"))
    product = F.col("l").cast("double") * F.col("r")
    pairs, buckets, largest = counts.where("l > 0 and r > 0").agg(F.sum(product), F.count(F.lit(1)), F.max(F.greatest("l", "r"))).first()
    if not buckets or pairs < ARRAY_PAIRS * buckets:
        return None
    entries = entries.withColumns({"x": F.lit(0).cast("long"), "y": F.lit(0).cast("long")})
    if largest > PART:
        hot = F.broadcast(counts.where(f"greatest(l, r) > {PART}").select("t", "key", F.ceil(F.greatest("l", "r") / PART).alias("n")))  # entries / PART at most
        dealt = entries.join(hot, ["t", "key"], "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn("p", F.pmod(F.xxhash64("_id"), F.col("n")))
        both = F.array(F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("_role")))
        grid = F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
        left = F.transform(grid, lambda i: F.struct(F.col("p").alias("x"), i.alias("y"), F.col("_role").bitwiseAND(1).alias("_role")))
        right = F.transform(grid, lambda i: F.struct(i.alias("x"), F.col("p").alias("y"), F.col("_role").bitwiseAND(2).alias("_role")))
        dealt = dealt.withColumn("_tiles", F.when(F.col("n") == 1, both).otherwise(F.concat(left, right))).drop("_role")
        entries = dealt.select("t", "key", "_id", *words, F.inline("_tiles")).where("_role > 0")

    masks = np.array(tables, np.int64).view(np.uint64).reshape(len(tables), len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for groups in whole_groups(batches, 4):
            new = np.flatnonzero((groups[:4, 1:] != groups[:4, :-1]).any(0)) + 1
            for i, j in zip([0, *new], [*new, groups.shape[1]]):
                ids, role, values = groups[4, i:j], groups[5, i:j], groups[6:, i:j].view(np.uint64)
                left, right = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
                if len(left) and len(right):
                    for a, b, d in best_of_bucket(values[:, left], values[:, right], threshold, best, masks, groups[0, i]):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[left[a]]), pa.array(ids[right[b]]), pa.array(d, pa.int32())], ["_asked", "_id", "distance"])

    where = ["t", "key", "x", "y"]
    tasks = max(partitions(stash.spark), -(-sum(sizes) * len(tables) // ENTRIES), -(-int(pairs) // TASK_PAIRS))
    dealt = entries.repartition(tasks, *where).sortWithinPartitions(*where, "_id").select(*where, "_id", "_role", *words)
    met = dealt.mapInArrow(run, "_asked long, _id long, distance int")
    nth = F.row_number().over(Window.partitionBy("_asked").orderBy("distance", "_id"))
    found = stash.put(met.withColumn("_nth", nth).where(F.col("_nth") <= best).drop("_nth"), "met")
    found = found.join(hashes.select("_id", *words, "_first").hint("merge"), "_id").drop("_id")
    return found.join(hashes.select(F.col("_id").alias("_asked"), *(F.col(w).alias(o) for o, w in zip(own, words))).hint("merge"), "_asked").select(*own, *words, "_first", "distance")


def best_of_bucket(asked: np.ndarray, hay: np.ndarray, threshold: int, best: int, masks: np.ndarray, table: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places in two arrays of hashes, a row for each word, and distances: the ``best`` nearest of each asked hash below the threshold.

    Equally near ones go by place. A pair counts at the first of the tables, by their masks, on whose bits it agrees.
    """
    some = [np.bitwise_count(a[:64, None] ^ h[:64]) < threshold for a, h in zip(asked, hay)]
    by = sorted(range(len(asked)), key=lambda w: some[w].sum())  # the words that tell most come first
    step = max(1, CELLS // hay.shape[1])
    for at in range(0, asked.shape[1], step):
        part = asked[:, at : at + step]
        total = reduce(np.add, (np.bitwise_count(part[w][:, None] ^ hay[w]) for w in by[:2]))
        flat = np.flatnonzero(total < threshold)
        i, j = np.divmod(flat, hay.shape[1])
        d = total.ravel()[flat].astype(np.int32)
        for w in by[2:]:
            d += np.bitwise_count(part[w][i] ^ hay[w][j])
            near = d < threshold
            i, j, d = i[near], j[near], d[near]
        if len(i) > best * part.shape[1]:  # distances beyond the best need no sort
            most = (np.bincount(i * threshold + d, minlength=part.shape[1] * threshold).reshape(-1, threshold).cumsum(1) < best).sum(1)
            near = d <= most[i]
            i, j, d = i[near], j[near], d[near]
        if len(i):
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            starts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            kept = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i)))) < best
            i, j, d = i[kept], j[kept], d[kept]
            diffs = part[:, i] ^ hay[:, j]  # the best of all are the best of each of their buckets, so the first can be told after
            for t in (table, *range(table)):
                agree = ((diffs & masks[t][:, None]) == 0).all(0) == (t == table)
                i, j, d, diffs = i[agree], j[agree], d[agree], diffs[:, agree]
            yield at + i, j, d


def radix_key(word: Column, bits: int = 10) -> Column:
    """Bucket of a hash: its bits above the unused lowest one."""
    return F.shiftrightunsigned(word, 1).bitwiseAND((1 << bits) - 1)


def radix_stats(hashes: DataFrame, word: str = "phash", bits: int = 10) -> DataFrame:
    """One row on how evenly a radix spreads hashes: buckets in use and empty, min, max, mean and deviation."""
    sizes = hashes.groupBy(radix_key(F.col(word), bits).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.count(F.lit(1)).alias("used"),
        (F.lit(1 << bits) - F.count(F.lit(1))).alias("empty"),
        F.min("n").alias("min_n"),
        F.max("n").alias("max_n"),
        F.avg("n").alias("mean_n"),
        F.stddev_pop("n").alias("sigma_n"),
    )
