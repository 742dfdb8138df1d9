import random

import numpy as np
import pytest
import xxhash

from pyspark.sql import functions as F

from tests.llm.fixtures import closure, corpus, frame
from twinsift.llm.common import join_classes
from twinsift.llm import simhash as s
from twinsift.llm.common import space_words
from twinsift.stash import Stash


def fingerprint(text, size=4):
    w = space_words(text.encode()) if text else []
    grams = [b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, errors=4):
    f = [fingerprint(r[1]) for r in rows]
    roots = closure(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= errors])
    best = {}
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            best[r] = min(best.get(r, 10**9), rows[i][0])
    return sorted(((rows[i][0], f"{f[i]:016x}", best.get(roots[i])) for i in range(len(rows))), key=str)


def test_against_brute_force(spark):
    got = s.near_duplicates(frame(spark)).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(corpus())


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = s.near_duplicates(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("block", [2048, 3])
@pytest.mark.parametrize("errors", [0, 1, 4])
def test_tries_find_all_links(spark, block, errors):
    rng = random.Random(errors)
    fps = {rng.getrandbits(64) for _ in range(40)} | {0}
    for f in list(fps):
        for _ in range(5):
            for bit in rng.sample(range(64), rng.randint(1, 6)):
                f ^= 1 << bit
            fps.add(f)
    fps |= {1 << i for i in range(20)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in s.trie_links(df, Stash(spark), errors, block).collect()]
    assert all((a ^ b).bit_count() for a, b in links)
    at = {f: i for i, f in enumerate(fps)}
    want = closure(len(fps), [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= errors])
    assert closure(len(fps), [(at[a], at[b]) for a, b in links]) == want


def test_more_blocks_lose_nothing():
    for rows in (10, 10**7, 10**10):
        blocks, masks = s.tables_for(rows, 4)
        assert sorted(b for x in blocks for b in x) == list(range(64))
        rng = np.random.default_rng(rows)
        for _ in range(200):
            a = rng.integers(0, 2**63, dtype=np.uint64)
            b = a
            for bit in rng.choice(64, 4, replace=False):
                b ^= np.uint64(1) << np.uint64(bit)
            assert any(s.rotated(np.array([a]), blocks, m)[0] == s.rotated(np.array([b]), blocks, m)[0] for m in masks)


def test_folding_many_hashes():
    rng = np.random.default_rng(1)
    counts = np.array([0, 1, 254, 255, 256, 1000, 0, 3])
    h = rng.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    at = np.cumsum(counts) - counts
    want = [sum(1 << b for b in range(64) if 2 * int((h[a : a + n] >> np.uint64(b) & np.uint64(1)).sum()) > n) for a, n in zip(at, counts)]
    assert s.fold(h, counts).tolist() == want


def test_frequent_fingerprints_are_sent(spark):
    rows = corpus()
    found = s.fingerprints(frame(spark))
    classes = found.groupBy("fp").count().withColumn("n", F.lit(1))
    whole = sorted(map(str, found.join(classes, "fp").select("doc_id", "fp", "n").collect()))
    for least in (0, 3, 1000):
        got = join_classes(found, classes, "fp", "count", least)
        assert sorted(map(str, got.select("doc_id", "fp", "n").collect())) == whole
    assert len(whole) == len(rows) and s.near_duplicates(frame(spark, [])).count() == 0
