import random

import numpy as np
import pytest

from tests.llm.fixtures import closure
from twinsift.llm import embeddings as e

SCHEMA = "vec_id long, embedding array<float>, n_links string"


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for i in range(80):
        rows.append((i, rng.standard_normal(16).tolist()))
    for k in range(3):
        base = rng.standard_normal(16)
        rows += [(100 + 50 * k + j, (base + 0.03 * j * rng.standard_normal(16)).tolist()) for j in range(20)]
    same = rng.standard_normal(16).tolist()
    rows += [(300 + j, same) for j in range(12)] + [(320, [2 * x for x in same]), (321, [-x for x in same])]
    rows += [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + same[1:]), (404, [float("inf")] + same[1:])]
    rows += [(405, [None] + same[1:]), (406, same[:8]), (407, same[:8]), (None, same), (300, same)]
    return [(i, v, "x") for i, v in rows]


def brute(rows, cosine):
    ok = [i is not None and v is not None and len(v) > 0 and None not in v and bool(np.isfinite(np.array(v, float)).all()) and any(v) for i, v, _ in rows]
    f = [np.array(v, np.float32).astype(float) if k else None for k, (_, v, _) in zip(ok, rows)]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if ok[a] and ok[b] and len(f[a]) == len(f[b]) and f[a] @ f[b] / np.linalg.norm(f[a]) / np.linalg.norm(f[b]) >= cosine]
    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    roots = closure(len(rows), links)
    best = {}
    for i, r in enumerate(roots):
        if rows[i][0] is not None:
            best[r] = min(best.get(r, 10**9), rows[i][0])
    comp = [best.get(r) if rows[i][0] is not None else None for i, r in enumerate(roots)]
    return sorted(((rows[i][0], n[i], comp[i], comp[i] is not None and comp[i] == rows[i][0]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("block", [1024, 4])
def test_against_brute_force(spark, block):
    rows = vectors()
    random.Random(1).shuffle(rows)
    got = e.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.95, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 0.95)


def test_empty_and_unusable(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None), (2, [0.0], None)]
    assert sorted(tuple(r) for r in e.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_at_the_threshold():
    """Pairs at a cosine of exactly the threshold, the hardest ones, share a bucket of some table."""
    k, tables, width = e.plan(100_000, 0.95, 0.005)
    assert e.plan(10**9, 0.95, 0.005)[1] < 250
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o = rng.standard_normal((2000, 64))
    o -= (o * a).sum(1, keepdims=True) * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * o
    met = (e.bucket_keys(a, k, tables, width, 11) == e.bucket_keys(b, k, tables, width, 11)).any(1)
    apart = np.bitwise_count((e.sketches(a, 11) ^ e.sketches(b, 11)).view(np.uint64))
    assert met.mean() > 0.98 and (apart <= e.sketch_errors(0.95)).all()
    strange = np.bitwise_count((e.sketches(a, 11) ^ e.sketches(o, 11)).view(np.uint64))
    assert (strange > e.sketch_errors(0.95)).mean() > 0.99
