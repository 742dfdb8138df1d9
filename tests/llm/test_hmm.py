import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm.fixtures import corpus, frame
from twinsift.llm import hmm
from twinsift.llm.common import space_words


def learnt(i):
    return i is None or zlib.crc32(str(i).encode()) % 7 != 2


def base(rows):
    counts = Counter()
    for r in rows:
        if learnt(r[0]):
            counts.update([*space_words(r[1].encode() if r[1] else None), b""])
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in rows:
        w = [*space_words(r[1].encode() if r[1] else None), b""]
        out.append((r[0], not learnt(r[0]), len(w), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)))
    return out


@pytest.mark.parametrize("head", [hmm.HEAD, 30])
def test_base_and_lengths(spark, head):
    rows = corpus()
    got = hmm.score_texts(frame(spark), head=head, rounds=1).collect()
    key = lambda t: (str(t[0]), *t[1:5], round(t[5], 4))
    got_rows = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=key)
    for a, b in zip(got_rows, sorted(base(rows), key=key)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))
    assert len(got) == len(rows) and all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert hmm.score_texts(frame(spark, []), head=head, rounds=1).count() == 0


def closed_form(rows, head, classes, prior=50.0):
    """Scores of a model of one state, whose likelihood is a product of smoothed shares."""
    train, n = Counter(), Counter()
    for r in rows:
        words = [*space_words(r[1].encode() if r[1] else None), b""]
        n.update(words)
        if learnt(r[0]):
            train.update(words)
    order = sorted((w for w in train if w), key=lambda w: (-train[w], w))
    sizes = Counter(math.floor(math.log2(train[w]) * 32) for w in order)
    room, least = head - 1, None
    for step in sorted(sizes, reverse=True):
        room -= sizes[step]
        if room < 0:
            break
        least = step
    own = {w for w in order if least is not None and math.floor(math.log2(train[w]) * 32) >= least} | {b""}
    share = Counter({k: 1 for k in range(classes)})
    for w in train:
        if w not in own:
            share[zlib.crc32(w) % classes] += train[w] + 1
    total = sum(train[w] + 1 for w in own) + sum(share.values())
    unit = lambda w: w if w in own else zlib.crc32(w) % classes
    seen = Counter()
    for w, c in train.items():
        seen[unit(w)] += c
    part = lambda u: (seen[u] + prior * ((train[u] + 1) if isinstance(u, bytes) else share[u]) / total) / (sum(train.values()) + prior)
    word = lambda w: math.log10(part(unit(w))) + (0 if w in own else math.log10((train[w] + 1) / share[unit(w)]))
    return [sum(word(w) for w in [*space_words(r[1].encode() if r[1] else None), b""]) for r in rows]


@pytest.mark.parametrize("head,classes", [(1000, 16), (30, 16), (1, 3), (40, 70_000)])
def test_scores_of_one_state_are_closed(spark, head, classes):
    rows = corpus()
    got = sorted((str(r["doc_id"]), round(r["score"], 6)) for r in hmm.score_texts(frame(spark), states=1, rounds=1, head=head, classes=classes).collect())
    want = sorted((str(r[0]), round(x, 6)) for r, x in zip(rows, closed_form(rows, head, classes)))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-5 for a, b in zip(got, want)) and len(got) == len(want)


def test_held_out_texts_change_no_other_score(spark):
    rows = corpus()
    at = next(i for i, r in enumerate(rows) if not learnt(r[0]))
    other = [*rows]
    other[at] = (rows[at][0], "zzz " * 500 + rows[0][1], *rows[at][2:])
    scores = lambda x: sorted((str(r["doc_id"]), round(r["score"], 6)) for r in hmm.score_texts(frame(spark, x), head=20, rounds=2).collect() if r["doc_id"] != rows[at][0])
    assert scores(rows) == scores(other)


def small_model(states=3, words=5, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    return hmm.Model(norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((words, states)), 0))


def path_sums(m, text):
    """Likelihood and expected counts by summing over all state sequences."""
    counts, steps, starts, total = np.zeros_like(m.emit), np.zeros_like(m.step), np.zeros_like(m.start), 0.0
    for path in itertools.product(range(len(m.start)), repeat=len(text)):
        p = m.start[path[0]] * m.emit[text[0], path[0]]
        for t in range(1, len(text)):
            p *= m.step[path[t - 1], path[t]] * m.emit[text[t], path[t]]
        total += p
        starts[path[0]] += p
        for t, s in enumerate(path):
            counts[text[t], s] += p
            if t:
                steps[path[t - 1], s] += p
    return total, counts / total, steps / total, starts / total


def test_recursions_against_all_paths():
    m = small_model()
    texts = [np.array(t, np.uint16) for t in ([0], [1, 2, 3, 4, 0], [2, 2], [4, 1, 0, 3], [3])]
    want = [path_sums(m, t) for t in texts]
    assert np.allclose(hmm.log_likelihood(m, texts), [math.log10(x[0]) for x in want])
    counts, steps, starts = np.zeros_like(m.emit), np.zeros_like(m.step), np.zeros_like(m.start)
    hmm.expect(m, texts, counts, steps, starts)
    for out, i in ((counts, 1), (steps, 2), (starts, 3)):
        assert np.allclose(out, sum(x[i] for x in want))


def test_small_blocks_agree(monkeypatch):
    m = small_model(4, 50, 3)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 50, n).astype(np.uint16) for n in rng.integers(1, 90, 60)]

    def all_of():
        counts, steps, starts = np.zeros_like(m.emit), np.zeros_like(m.step), np.zeros_like(m.start)
        hmm.expect(m, texts, counts, steps, starts)
        return hmm.log_likelihood(m, texts), counts, steps, starts

    whole = all_of()
    assert np.isclose(whole[1].sum(), sum(map(len, texts))) and np.isclose(whole[3].sum(), len(texts))
    for size in (1, 7, 100):
        monkeypatch.setattr(hmm, "BLOCK_TOKENS", size)
        assert all(np.allclose(a, b) for a, b in zip(whole, all_of()))


def test_rounds_raise_the_likelihood_and_beat_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sums = []
    for rounds in (1, 3):
        got = hmm.score_texts(docs, rounds=rounds).toPandas()
        sums.append(got.groupby("held_out")[["base_score", "score"]].sum())
    assert sums[1]["score"][False] > sums[0]["score"][False]
    assert (sums[1]["score"] > sums[1]["base_score"]).all()


