import math

import numpy as np
import pytest

from tests.conftest import DATA
from twinsift.llm import whitening as w

SCHEMA = "vec_id long, embedding array<float>, n int, x string, component int"


def plain(vectors):
    """Components, variances, share and whitened rows of each usable (id, vector), by a full eigenvalue solver."""
    usable = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in usable}), float)
    centred = x - x.mean(0)
    values, basis = np.linalg.eigh(centred.T @ centred / len(x))
    return usable, x, values[::-1], basis[:, ::-1]


def check(rows, vectors, components=4):
    usable, x, values, basis = plain(vectors)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    by = {}
    for r in rows:
        by.setdefault((r.vec_id, r.component), []).append(r)
    m = min(components, x.shape[1])
    assert len(rows) == len(usable) * m
    for k in range(m):
        pairs = [(by[(i, k + 1)], float((np.array(v) - x.mean(0)) @ basis[:, k] / math.sqrt(values[k]))) for i, v in usable]
        sign = np.sign(sum(rs[0].whitened * want for rs, want in pairs))
        for rs, want in pairs:
            assert all(abs(sign * r.whitened - want) < 1e-8 for r in rs)
    for i, v in usable:
        for k in range(m):
            for r in by[(i, k + 1)]:
                exact = sum((n * int(a) - s) ** 2 for a, s in zip(v, sums))
                assert r.n == n and r.deviation == (exact if exact < 2**63 else None)
                assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9) and r.identity_error < 1e-9


def test_against_a_full_solver(spark):
    rng = np.random.default_rng(4)
    mix = rng.standard_normal((40, 40)) * np.linspace(2, 1, 40)
    rows = [(i, (0.2 * rng.standard_normal(40) @ mix).tolist()) for i in range(500)]
    rows += [(i, rows[7][1]) for i in range(600, 760)]  # a mass of copies
    rows += [(0, rows[0][1]), (None, rows[1][1]), (901, None), (902, [1.0, None] * 20), (903, [float("nan")] + [0.0] * 39), (904, [float("inf")] * 40), (905, [])]
    frame = spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA).repartition(5)
    got = w.whiten(frame).collect()
    check(got, rows)


def test_given_table(spark):
    frame = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    check(w.whiten(frame).collect(), [(r.vec_id, r.embedding) for r in frame.collect()])


def test_few_dimensions_and_no_variance(spark):
    def run(rows):
        return w.whiten(spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA)).collect()

    rows = [(1, [0.5, 0.25]), (2, [-0.5, 0.75]), (3, [0.1, -1.0])]
    check(run(rows), rows)
    same = run([(1, [0.5, 0.25, 0.0]), (2, [0.5, 0.25, 0.0])])
    assert len(same) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1 for r in same)
    line = run([(i, [0.1 * i, 0.0, 0.0]) for i in range(5)])
    assert {r.component for r in line if r.whitened is not None} == {1} and all(r.identity_error < 1e-12 for r in line)
    mixed = run([(1, [0.5, 0.25]), (2, [-0.5, 0.75]), (3, [1.0]), (4, [0.0, 0.5])])
    assert {r.vec_id for r in mixed} == {1, 2, 4}
    assert run([]) == [] and run([(1, None)]) == []


def test_large_entries_stay_exact(spark):
    rows = [(i, [30.0 * (i + 1), float(-100 * i * i)]) for i in range(300)]
    check(w.whiten(spark.createDataFrame([(i, v, 1, "c", 2) for i, v in rows], SCHEMA)).collect(), rows)
    huge = w.whiten(spark.createDataFrame([(1, [1e12, 0.0], 1, "c", 2), (2, [0.0, 1e12], 1, "c", 2)], SCHEMA)).collect()
    assert all(r.deviation is None for r in huge)


@pytest.mark.parametrize(
    "values",
    [[5.0] + [1.0] * 60 + [0.5] * 39, [1e8, 1e4, 10, 2] + [1.0] * 96, [1.0] * 50 + [0.0] * 50, list(np.linspace(2, 1, 100)), [1.0] * 100, [3.0, 2.0] + [0.0] * 98],
)
def test_leading_pairs_of_difficult_spectra(values):
    turn = np.linalg.qr(np.random.default_rng(0).standard_normal((100, 100)))[0]
    matrix = turn @ np.diag(values) @ turn.T
    basis, found, residual = w.leading_pairs(lambda q: matrix @ q, 100, 4)
    assert np.allclose(found, values[:4], rtol=1e-12, atol=1e-9 * values[0]) and residual < 1e-9 * values[0]
    assert np.allclose(basis.T @ basis, np.eye(4), atol=1e-12)
