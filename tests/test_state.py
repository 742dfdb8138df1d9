"""Remembered deletions against a plain version, and long chains of candidates in few rounds."""

import random

import pytest

from twinsift.operators import state
from twinsift.stash import Stash

MEDIA, PAIRS = "id long, md5 string, type int", "weed_md5 string, orig_md5 string"


def plain(candidates, weeds, types):
    had, out = dict(weeds), []
    listed = set(had)
    got = {}
    for w, o in sorted(set(candidates)):
        if w not in types or o not in types:
            reason = "missing"
        elif w == o:
            reason = "same"
        elif types[w] != types[o]:
            reason = "type"
        elif w in had:
            reason = "changed" if had[w] != o else None
        elif w in got:
            reason = "changed"
        elif o in listed or o in got:
            reason = "original is a weed"
        else:
            reason = None
            got[w] = o
        out.append((w, o, reason))
    return sorted(out, key=str)


def run(spark, candidates, weeds, types):
    media = spark.createDataFrame([(i, m, t) for i, (m, t) in enumerate(types.items())], MEDIA)
    got = state.add_weeds(spark.createDataFrame(candidates, PAIRS), spark.createDataFrame(weeds, PAIRS), media)
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("seed, n, most", [(1, 12, 30), (2, 40, 60), (3, 40, 300), (4, 6, 36)])
def test_as_one_after_the_other(spark, seed, n, most):
    r = random.Random(seed)
    names = [f"m{i:02d}" for i in range(n)]
    types = {m: 1 if r.random() < 0.95 else 2 for m in names[:-1]}
    candidates = [(r.choice(names), r.choice(names)) for _ in range(most)]
    candidates += candidates[:3]
    weeds = list({r.choice(names): r.choice(names) for _ in range(n // 12)}.items())
    assert run(spark, candidates, weeds, types) == plain(candidates, weeds, types)


def test_no_candidates(spark):
    assert run(spark, [], [("a", "b")], {"a": 1, "b": 1}) == []


def test_chain_of_ten_thousand(spark, monkeypatch):
    tables = []
    put = Stash.put
    monkeypatch.setattr(Stash, "put", lambda self, df, tag: tables.append(tag) or put(self, df, tag))
    names = [f"m{i:05d}" for i in range(10_001)]
    candidates = list(zip(names[1:], names))
    got = run(spark, candidates, [], dict.fromkeys(names, 1))
    assert tables.count("terms") <= 20
    assert got == plain(candidates, [], dict.fromkeys(names, 1))
