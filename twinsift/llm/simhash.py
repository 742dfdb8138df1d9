"""Near-duplicate texts by SimHash fingerprints and a self-join of binary tries."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import as_bytes, join_classes, key_runs, run_starts, slices, space_words, union_labels
from twinsift.operators.components import connected_components
from twinsift.stash import Stash, partitions

BITS = 64
LANES = np.uint64(0x0101010101010101)
#: Distinct fingerprints of one trie that a single task compares with those of another.
BLOCK = 2048
#: Node pairs that are held at a time while tries are walked.
FRONTIER = 400_000
#: Below this many leaf pairs a node pair is compared directly.
LEAF = 24


def shingle_hashes(words: list[bytes], size: int = 4, seed: int = 42) -> list[int]:
    """XXH64 of each run of ``size`` words joined by a space; a shorter text is one shingle, none gives none."""
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < size:
        return [digest(joined, seed)]
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    return [digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())]


def fold(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: bit i is set if it is set in over half of a run's hashes.

    Eight byte lanes are summed at once, over chunks of at most 255 hashes, so that no lane overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    has = np.flatnonzero(counts)
    if not len(has):
        return out
    n = counts[has]
    chunks = -(-n // 255)
    owner = np.repeat(np.arange(len(has)), chunks)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    at = (np.cumsum(n) - n)[owner] + 255 * nth
    first_chunk = np.cumsum(chunks) - chunks
    bits = np.zeros((len(has), BITS), bool)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, at)
        per = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_chunk, axis=0)
        bits[:, shift::8] = 2 * per > n[:, None]
    out[has] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """One row ``(doc_id, fp long)`` per row of ``docs``; null and wordless texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            parts = [np.array(shingle_hashes(space_words(t), size), np.uint64) for t in as_bytes(batch.column(1))]
            fps = fold(np.concatenate(parts), np.array([len(p) for p in parts])) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def tables_for(rows: int, errors: int) -> tuple[list[list[int]], list[int]]:
    """Bit blocks, and which of them form the common prefix of each trie.

    With ``m`` blocks any pair within ``errors`` bits agrees on some ``m - errors`` blocks, so the tries over
    all such choices of prefix together lose no pair. ``m`` follows from the number of rows so that a prefix
    is shared by a few hundred random fingerprints at most.
    """
    for m in range(errors + 1, errors + 5):
        prefix = BITS * (m - errors) // m
        if rows / 2**prefix <= 256:
            break
    cuts = [BITS * i // m for i in range(m + 1)]
    blocks = [list(range(cuts[i], cuts[i + 1])) for i in range(m)]
    return blocks, [sum(1 << i for i in c) for c in combinations(range(m), m - errors)]


def rotated(fps: np.ndarray, blocks: list[list[int]], mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix key and remaining bits (right-aligned) of fingerprints for one choice of prefix blocks."""
    key, rest = np.zeros(len(fps), np.uint64), np.zeros(len(fps), np.uint64)
    for i, bits in enumerate(blocks):
        part = (fps >> np.uint64(bits[0])) & np.uint64((1 << len(bits)) - 1)
        if mask >> i & 1:
            key = key << np.uint64(len(bits)) | part
        else:
            rest = rest << np.uint64(len(bits)) | part
    return key, rest


def walk(rest: np.ndarray, roots: tuple[np.ndarray, ...], depth: int, errors: int) -> np.ndarray:
    """Labels of rows linked within ``errors`` bits, by walking pairs of trie nodes together.

    ``rest`` is sorted inside each root range, so a trie node is a range of rows and the ones of its next
    bit are its upper part. A pair of nodes carries the bits in which its paths differ and is dropped when
    they exceed the budget. Pairs wait on a stack in pieces, so memory stays bounded however dense a trie is.
    """
    labels = np.arange(len(rest))
    ones = {}
    stack = [(depth - 1, *roots, np.zeros(len(roots[0]), np.int64))]
    while stack:
        bit, al, ah, bl, bh, e = stack.pop()
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(bit, *(x[half:] for x in (al, ah, bl, bh, e))), (bit, *(x[:half] for x in (al, ah, bl, bh, e)))]
            continue
        pairs = (ah - al) * (bh - bl)
        leaf = (pairs <= LEAF) | (bit < 0)
        if leaf.any():
            a0, nb, b0, size = al[leaf], (bh - bl)[leaf], bl[leaf], pairs[leaf]
            for at in range(0, len(size), max(1, FRONTIER // LEAF)):
                cut = slice(at, at + max(1, FRONTIER // LEAF))
                k = np.arange(size[cut].sum()) - np.repeat(np.cumsum(size[cut]) - size[cut], size[cut])
                w = np.repeat(nb[cut], size[cut])
                i, j = np.repeat(a0[cut], size[cut]) + k // w, np.repeat(b0[cut], size[cut]) + k % w
                near = (i != j) & (labels[i] != labels[j])
                i, j = i[near], j[near]
                near = np.bitwise_count(rest[i] ^ rest[j]) <= errors
                labels = union_labels(len(rest), i[near], j[near], labels)
        inner = ~leaf
        if bit < 0 or not inner.any():
            continue
        al, ah, bl, bh, e = (x[inner] for x in (al, ah, bl, bh, e))
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum(rest >> np.uint64(bit) & np.uint64(1)).astype(np.int64)])
        c = ones[bit]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        other = al != bl
        kids = [
            (al, am, bl, bm, e),
            (am, ah, bm, bh, e),
            (al, am, bm, bh, e + 1),
            tuple(x[other] for x in (am, ah, bl, bm, e + 1)),
        ]
        al, ah, bl, bh, e = (np.concatenate(x) for x in zip(*kids))
        keep = (ah > al) & (bh > bl) & (e <= errors)
        if keep.any():
            stack.append((bit - 1, *(x[keep] for x in (al, ah, bl, bh, e))))
    return labels


def trie_links(fps: DataFrame, stash: Stash, errors: int = 4, block: int = BLOCK) -> DataFrame:
    """Spanning links ``(a, b)`` of the distinct fingerprints ``fps(fp)`` that differ in at most ``errors`` bits.

    Every fingerprint goes to one trie per choice of prefix blocks. A trie of more than ``block`` leaves is cut
    into parts, and pairs of parts are walked by separate tasks, so no task holds more than ``2 * block`` of
    one trie. Each task returns a spanning forest of what it linked, never the pairs themselves.
    """
    spark = stash.spark
    rows = fps.count()
    blocks, masks = tables_for(rows, errors)
    depths = [sum(len(b) for i, b in enumerate(blocks) if not m >> i & 1) for m in masks]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy().view(np.uint64)
            for t, m in enumerate(masks):
                key, _ = rotated(f, blocks, m)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(f), t, np.int32)), pa.array(key.view(np.int64)), pa.array(f.view(np.int64))],
                    ["t", "key", "fp"],
                )

    entries = fps.select("fp").mapInArrow(spread, "t int, key long, fp long")
    hot = stash.put(entries.groupBy("t", "key").count().where(F.col("count") > block), "hot")
    n_hot = hot.count()
    hot = hot.withColumn("parts", F.ceil(F.col("count") / block).cast("int")).drop("count")
    if n_hot <= 100_000:
        hot = F.broadcast(hot)
    entries = entries.join(hot, ["t", "key"], "left")
    parts = F.coalesce("parts", F.lit(1))
    entries = entries.withColumn("r", F.pmod(F.xxhash64("fp"), parts).cast("int"))
    entries = entries.withColumn("q", F.explode(F.sequence(F.lit(0), parts - 1)))
    entries = entries.select("t", "key", F.least("r", "q").alias("x"), F.greatest("r", "q").alias("y"), "r", "fp")
    keys = ["t", "key", "x", "y"]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, keys, 50_000):
            starts = run_starts(table, keys)
            size = np.diff(starts)
            group = np.repeat(np.arange(len(size)), size)
            t, x, y, r = (table.column(k).to_numpy() for k in ("t", "x", "y", "r"))
            f = table.column("fp").to_numpy().view(np.uint64)
            for number in np.unique(t):
                own = np.flatnonzero((t == number) & (size[group] > 1))
                if not len(own):
                    continue
                _, rest = rotated(f[own], blocks, masks[number])
                second = (r[own] != x[own]).astype(np.int64)
                order = np.lexsort((rest, second, group[own]))
                own, rest, second = own[order], rest[order], second[order]
                g = group[own]
                lo = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                hi = np.append(lo[1:], len(g))
                cross = x[own[lo]] != y[own[lo]]
                mid = hi - np.add.reduceat(second, lo)
                full = ~cross | ((mid > lo) & (mid < hi))
                lo, hi, mid, cross = lo[full], hi[full], mid[full], cross[full]
                roots = (lo, np.where(cross, mid, hi), np.where(cross, mid, lo), hi)
                labels = walk(rest, roots, depths[number], errors)
                linked = np.flatnonzero(labels != np.arange(len(labels)))
                signed = f[own].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[labels[linked]])], ["a", "b"])

    dealt = entries.repartition(partitions(spark), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, errors: int = 4, size: int = 4, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row ``(doc_id, fingerprint, component_id)`` per row of ``docs``.

    Rows whose fingerprints differ in at most ``errors`` bits are linked; the component is the smallest id
    reachable. Equal fingerprints are collapsed before the join, so copies cost nothing there. Null and
    wordless texts share fingerprint zero; a null id never becomes a component unless no other id is in it;
    repeated rows come back as often as given; extra columns are ignored; no rows give no rows.
    """
    stash = Stash(docs.sparkSession)
    found = stash.put(fingerprints(docs, id_col, text_col, size), "fingerprints")
    classes = stash.put(found.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "classes")
    links = stash.put(trie_links(classes, stash, errors, block), "links")
    members = connected_components(links, stash).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    members = stash.put(members, "members")
    linked = members.join(classes, "fp")
    best = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    best = stash.put(members.join(best, "root").select("fp", "component_id"), "best")
    per_class = classes.join(best, "fp", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"), "copies")
    per_class = stash.put(per_class, "per_class")
    return join_classes(found, per_class, "fp", "copies").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
