import hashlib
import random

import pytest

from tests.llm.fixtures import corpus, frame
from tests.oracle import connect, same
from twinsift.llm import decontaminate as d
from twinsift.llm import queries
from twinsift.llm.common import alnum_words


def brute(rows, items, span=10):
    windows = {}
    for item, text in items:
        w = alnum_words(text.encode()) if text else []
        n = min(span, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for r in rows:
        w = alnum_words(r[1].encode()) if r[1] else []
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                for item in windows.get(tuple(w[i : i + n]), ()):
                    hit.update(range(i, i + n))
                    found.add(str(item))
        names = sorted(found)
        out.append((r[0], len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def items():
    rows = corpus()
    cut = lambda t, a, n: " ".join(t.split()[a : a + n])
    long = next(r[1] for r in rows if r[0] == 200)
    return [
        (1, cut(long, 500, 25).upper()),
        (2, cut(long, 5990, 30)),
        (3, cut(rows[0][1], 0, 10)),
        (10, cut(rows[2][1], 1, 3)),
        (11, "one"),
        (12, None),
        (13, ""),
        (14, cut(rows[62][1], 3, 10)),
        (15, cut(rows[62][1], 3, 9) + " other words that are not there at all"),
        (3, cut(rows[0][1], 0, 10)),
        (16, "a b " * 12),
    ]


@pytest.mark.parametrize("send", [1 << 20, 0])
def test_against_brute_force(spark, send):
    rows = corpus() + [(400, "x a b a b a b a b a b a b y", "en", 1, "x")]
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = d.contamination(frame(spark, rows), bench, send_bytes=send).drop("item_ids").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items())


@pytest.mark.parametrize("send", [1 << 20, 0])
def test_empty_tables_and_dropping(spark, send):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    none = d.contamination(frame(spark), bench.limit(0), send_bytes=send)
    assert none.where("contaminated or n_items > 0").count() == 0 and none.count() == len(corpus())
    assert d.contamination(frame(spark, []), bench, send_bytes=send).count() == 0
    kept = d.drop_contaminated(frame(spark), bench, send_bytes=send)
    assert kept.columns == frame(spark).columns
    clean = [r for r in brute(corpus(), items()) if not r[5]]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in clean)


@pytest.mark.parametrize("send,part", [(1 << 20, 10_000), (0, 10_000), (0, 1)])
def test_items_without_an_id_are_found(spark, monkeypatch, send, part):
    monkeypatch.setattr(d, "PART", part)
    rows = corpus()
    cut = lambda text, at, n: " ".join(text.split()[at : at + n])
    items_ = [(None, cut(rows[0][1], 0, 3)), (5, cut(rows[1][1], 0, 3)), (None, "one")]
    bench = spark.createDataFrame(items_, "item_id long, text string")
    got = d.contamination(frame(spark, rows), bench, send_bytes=send).collect()
    by = {r["doc_id"]: (r["n_hit"] > 0, r["contaminated"], r["n_items"], r["item_ids"]) for r in got}
    assert by[0] == (True, True, 0, []) and by[1] == (True, True, 1, ["5"]) and by[305] == (True, True, 0, [])
    kept = {r["doc_id"] for r in d.drop_contaminated(frame(spark, rows), bench, send_bytes=send).collect()}
    assert not kept & {0, 1, 305}


@pytest.mark.parametrize("size", [1, 200])
def test_items_of_a_text_are_met_in_blocks(spark, monkeypatch, size):
    monkeypatch.setattr(d, "BLOCK_BYTES", size)
    base = corpus()[60][1].split()
    own = [(i, " ".join(base[at : at + n])) for i, (at, n) in enumerate((a, w) for a in range(0, 45, 3) for w in (4, 12, 15))]
    bench = spark.createDataFrame(own, "item_id long, text string")
    got = {r["doc_id"]: r for r in d.contamination(frame(spark), bench, send_bytes=0).collect()}
    want = {r["doc_id"]: r for r in d.contamination(frame(spark), bench).collect()}
    assert got == want and got[100]["n_items"] == len(own)


def test_winnowing_guarantee():
    rng = random.Random(1)
    import numpy as np

    for _ in range(50):
        h = np.array([rng.getrandbits(3) for _ in range(60)], np.uint64)  # many ties
        at = d.winnow(h, 6)
        assert all(any(i <= p < i + 6 for p in at) for i in range(len(h) - 5))
        for i in range(len(h) - 5):
            low = h[i : i + 6].min()
            assert max(j for j in range(i, i + 6) if h[j] == low) in at


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    same(queries.QUERIES["op1_decontamination"](spark, folder), queries.SQL["op1_decontamination"], connect(folder))
