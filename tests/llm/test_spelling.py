import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest

from tests.llm.fixtures import corpus, frame
from twinsift.llm import spelling as s
from twinsift.stash import Stash


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def plain(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = sorted({c for w in words for c in w})
    near = {w: edits(w, letters) & words.keys() for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def texts(seed=1, docs=150):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀß") for _ in range(rng.randint(5, 9))) for _ in range(120)] + ["x" * 3000, "x" * 3001, "x" * 2999 + "y"]
    base += [rng.choice(sorted(edits(rng.choice(base), "abé"))) for _ in range(300)]
    weights = [1 / (1 + i % 60) for i in range(len(base))]
    say = lambda: " ".join(w.title() if rng.random() < 0.2 else w for w in rng.choices(base, weights, k=rng.randint(0, 80)))
    return [(i, say(), "en", 1, "x") for i in range(docs)]


@pytest.mark.parametrize("rows", [texts(), texts(2) + corpus()], ids=["variants", "odd"])
def test_against_single_edits(spark, rows):
    got = s.variants(frame(spark, rows))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] not in (None, w[2]) for w in want)


def test_small_blocks_and_many_groups_lose_no_pair(spark, monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(5, 7))) for _ in range(900)})
    table = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, n long")
    want = sorted((w, v, words.index(v)) for w in words for v in edits(w, "abcd") & set(words))
    for block, finer in ((4, 3.0), (16, 1.5), (2000, 3.0)):
        monkeypatch.setattr(s, "FINER", finer)
        assert sorted(map(tuple, s.near_words(table, Stash(spark), block).collect())) == want


def test_chains_of_forms(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)] + [("a", "w7"), ("b", "c")], "word string, form string")
    got = {r.word: r.root for r in s.roots(forms, Stash(spark)).collect()}
    assert got == {**{f"w{i}": "w40" for i in range(40)}, "a": "w40", "b": "c"}


def test_pairs_of_two_blocks():
    i, j = s.near_in_blocks(["abcde", "abdce", "zzzzz"], ["abcdez", "abcdde", "zabcde", "abdcez"])
    assert set(zip(i.tolist(), j.tolist())) == {(0, 0), (0, 1), (0, 2), (1, 3)}
    i, j = s.near_in_blocks(["listen", "silent", "listem"], None)
    assert list(zip(i, j)) == [(0, 2)]  # anagrams are at distance 0, yet not near


def test_empty_table(spark):
    assert s.variants(frame(spark, [])).count() == 0


def test_letters_of_many_small_blocks_are_counted_once(monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdé") for _ in range(5)) for _ in range(300)})
    longer = sorted({"".join(rng.choice("abcdé") for _ in range(6)) for _ in range(300)})
    rows = [(words[:90], None), (words[90:], longer[:100]), (words[:40], words[40:90]), ([], longer[:3]), (["x" * 2500], ["x" * 2501]), (words[:30], longer)]
    kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64())]))
    block = lambda ws: None if ws is None else [{"word": w, "n": 2 * i} for i, w in enumerate(ws)]
    batch = pa.RecordBatch.from_arrays([pa.array([block(r[k]) for r in rows], kind) for k in (0, 1)], ["ws", "other_ws"])
    made, init = [], s._Spelled.__init__
    monkeypatch.setattr(s._Spelled, "__init__", lambda self, ws: (made.append(len(ws)), init(self, ws))[1])
    letters, want = "abcdéx", []
    for a, b in rows:
        for w in a:
            for v in edits(w, letters) & set(a if b is None else b):
                want.append((w, v, 2 * (a if b is None else b).index(v)))
                if b is not None:
                    want.append((v, w, 2 * a.index(w)))
    for part in (batch, batch.slice(1, 5)):
        got = s.near_of_rows(part).to_pydict()
        if part is batch:
            assert sorted(zip(got["word"], got["near"], got["near_n"])) == sorted(want) and len(want) > 200
    assert len(made) == 2 and s.near_of_rows(batch.slice(3, 1)) is None
