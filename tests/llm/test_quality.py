import random

import numpy as np
import pytest

from tests.llm.fixtures import corpus, frame
from twinsift.llm import quality as q

LABELS = "doc_id long, quality int, toxic int"


def test_gradient_matches_differences():
    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 6, 30)
    at = np.concatenate([[0], np.cumsum(lengths)])
    flat, grades = rng.integers(0, 8, at[-1]), rng.integers(0, 4, 30)
    w, cuts = rng.standard_normal(8), np.array([-1.0, 0.2, 1.5])
    out = q.loss_gradient(w, cuts, grades, at, flat)
    x = np.concatenate([w, cuts])
    for i in range(len(x)):
        hi, lo = x.copy(), x.copy()
        hi[i] += 1e-5
        lo[i] -= 1e-5
        f = lambda z: q.loss_gradient(z[:8], z[8:], grades, at, flat)[0]
        assert abs((f(hi) - f(lo)) / 2e-5 - out[1 + i]) < 1e-4


def test_learns_held_out_grades(spark):
    rng = random.Random(4)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        text, grade = [rng.choice(plain) for _ in range(rng.randint(20, 60))], i % 3
        if grade == 0:
            text.insert(5, rng.choice(["vile", "nasty"]))
        if grade == 1:
            text = [t + "!!" for t in text]
        rows.append((i, " ".join(text), "en", 1, "x"))
        labels.append((i, int(grade != 1), int(grade == 0)))
    docs, rated = frame(spark, rows), q.graded(spark.createDataFrame(labels, LABELS))
    model = q.fit(docs, rated.where("doc_id % 4 <> 0"))
    assert list(model.cuts) == sorted(model.cuts)
    held = [r for r in q.select(docs, model).collect() if r["doc_id"] % 4 == 0]
    assert np.mean([r["kept"] == (r["doc_id"] % 3 == 2) for r in held]) > 0.97
    by = [np.mean([r["expected_grade"] for r in held if r["doc_id"] % 3 == g]) for g in range(3)]
    assert by == sorted(by)
    kept = q.keep_good(docs, model)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in q.select(docs, model).collect() if r["kept"]}


def test_given_labels_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = q.graded(spark.read.parquet(f"{folder}/labels.parquet"))
    model = q.fit(docs, rated.where("doc_id % 4 <> 3"))
    held = q.select(docs, model).join(rated, "doc_id").where("doc_id % 4 = 3").collect()
    clean = [r["kept"] for r in held if r["grade"] == 2]
    bad = [not r["kept"] for r in held if r["grade"] < 2]
    assert np.mean(clean) > 0.97 and np.mean(bad) > 0.85


@pytest.mark.parametrize("labels", [[], [(1, None, None)], [(9999, 1, 0)], [(1, 1, 0), (1, 1, 0), (2, 0, 0), (None, 1, 0)]])
def test_odd_inputs(spark, labels):
    docs = frame(spark)
    model = q.fit(docs, q.graded(spark.createDataFrame(labels, LABELS)))
    got = q.select(docs, model)
    assert got.count() == len(corpus()) and got.where("expected_grade is null or tail_probability is null").count() == 0
    assert q.select(frame(spark, []), model).count() == 0


def test_nothing_learnt_keeps_all(spark):
    model = q.fit(frame(spark), q.graded(spark.createDataFrame([], LABELS)))
    assert q.keep_good(frame(spark), model).count() == len(corpus())


@pytest.mark.parametrize("other", [None, 1, 10**6])
def test_unusable_ratings_take_no_slots(spark, other):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" vile" if i % 2 else ""), "en", 1, "x") for i in range(80)]
    labels = [(i, 1, i % 2) for i in range(80)]
    docs = frame(spark, rows)
    many = [(other if other in (None, 1) else other + k, 1, 1) for k in range(2000)]
    model = q.fit(docs, q.graded(spark.createDataFrame(labels + many, LABELS)), max_rated=80)
    assert {r["doc_id"] for r in q.select(docs, model).collect() if r["kept"]} == {i for i in range(80) if i % 2 == 0}


def test_fit_against_an_independent_optimum(spark):
    """The same model by Newton's method on a dense table, with differences for derivatives and scales counted one by one."""
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(240):
        level = rng.random()
        text = [rng.choice(["sun", "tree", "river", "stone", "bird", "cloud"]) for _ in range(rng.randint(6, 12))]
        text += [w for w, p in (("scum", 0.9 - level), ("spam", 0.9 - abs(level - 0.4) * 2), ("fine", level)) if rng.random() < p]
        rng.shuffle(text)
        grade = 0 if level < 0.3 else 1 if level < 0.6 else 2
        rows.append((i, " ".join(text), "en", 1, "x"))
        labels.append((i, int(grade == 2), int(grade == 0)))
    docs = frame(spark, rows)
    model = q.fit(docs, q.graded(spark.createDataFrame(labels, LABELS)))

    grades = [0 if toxic else 1 + good for _, good, toxic in labels]
    sets = [{q.bucket(w) for w in q.text_features(r[1].encode())} for r in rows]
    names = sorted(set().union(*sets))
    x = np.array([[float(b in s) for b in names] for s in sets])
    total, scale = x.sum(), []
    for j in range(len(names)):
        told = 1e-3
        for k in (1, 2):
            p = sum(x[i].sum() for i in range(len(rows)) if grades[i] >= k) / total
            n, have = x[:, j].sum(), sum(x[i, j] for i in range(len(rows)) if grades[i] >= k)
            told = max(told, max(abs(have - n * p) - 0.5, 0) ** 2 / max(n * p * (1 - p), 1e-9) / 15)
        scale.append(min(told, 1))
    x = x * np.array(scale)

    def loss(z):
        score, below = x @ z[:-2], [np.zeros(len(rows)), None, None, np.ones(len(rows))]
        below[1], below[2] = (1 / (1 + np.exp(score - c)) for c in z[-2:])
        chance = [below[g + 1][i] - below[g][i] for i, g in enumerate(grades)]
        return -np.log(np.maximum(chance, 1e-300)).sum() + 0.05 * (z[:-2] ** 2).sum()

    z, d = np.concatenate([np.zeros(len(names)), [-0.7, 0.7]]), len(names) + 2
    eye, h = np.eye(d), 1e-4
    for _ in range(8):
        up, down = np.array([loss(z + h * e) for e in eye]), np.array([loss(z - h * e) for e in eye])
        here, hess = loss(z), np.zeros((d, d))
        for a in range(d):
            hess[a, a] = (up[a] - 2 * here + down[a]) / h**2
            for b in range(a):
                both = loss(z + h * (eye[a] + eye[b])) - up[a] - up[b] + here
                less = loss(z - h * (eye[a] + eye[b])) - down[a] - down[b] + here
                hess[a, b] = hess[b, a] = (both + less) / 2 / h**2
        step, t = np.linalg.solve(hess + 1e-6 * eye, (up - down) / (2 * h)), 1.0
        while not loss(z - t * step) <= here and t > 1e-4:
            t /= 2
        z = z - t * step
    fitted = np.concatenate([model.weights[names] / np.array(scale), model.cuts])
    assert loss(z) <= loss(fitted) + 1e-6 and loss(fitted) < loss(z) + 0.01 * abs(loss(z)), (loss(z), loss(fitted))
    wanted = 1 / (1 + np.exp(z[-1] - x @ z[:-2]))
    got = {r["doc_id"]: r for r in q.select(docs, model).collect()}
    assert max(abs(got[i]["tail_probability"] - wanted[i]) for i in range(240)) < 0.05
    assert all(got[i]["kept"] == (wanted[i] >= 0.5) for i in range(240) if abs(wanted[i] - 0.5) > 0.05)
