import random
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.fixtures import closure, corpus, frame
from tests.llm.test_simhash import fingerprint
from twinsift.llm import nearcopies as n


def shingles(text):
    w = text.lower().split() if text else []
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or len(a & b) * 5 >= len(a | b) * 4


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    return closure(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if near(sets[i], sets[j])])


def edited(groups, copies, seed=5):
    """Texts with words replaced apart, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(150, 300))]
        for c in range(copies):
            text = list(base)
            for at in rng.sample(range(len(text)), rng.randint(0, 5)):
                text[at] = f"x{rng.randrange(10**6)}"
            rows.append((100 * g + c, " ".join(text), "en", 1, "x"))
    return rows


def ids_of_groups(rows):
    best = {}
    for root, r in zip(brute(rows), rows):
        best[root] = min(best.get(root, (True, 0)), (r[0] is None, r[0] or 0))
    return sorted(best.values())


def test_stage_links_what_four_bits_miss(spark):
    rows = edited(30, 4)
    pairs = [(a, b) for a in rows for b in rows if a[0] < b[0] and near(shingles(a[1]), shingles(b[1]))]
    far = [p for p in pairs if (fingerprint(p[0][1]) ^ fingerprint(p[1][1])).bit_count() > 4]
    assert len(far) > len(pairs) / 2
    kept = corpus_pipeline.drop_near_duplicates(spark, frame(spark, rows), "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for _, i in ids_of_groups(rows)]


@pytest.mark.parametrize("block", [2048, 3])
def test_one_of_each_group(spark, block):
    rows = corpus() + [(400 + i, *r[1:]) for i, r in enumerate(edited(2, 20, 6))]
    kept = n.keep_one(frame(spark, rows), block=block)
    assert kept.columns == frame(spark).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == ids_of_groups(rows)
    assert n.keep_one(frame(spark, [])).count() == 0


def test_a_large_group_is_sent_few_times(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"v{i}" for i in range(300)]
    texts = [" ".join(base[: 4 * k] + [f"x{rng.randrange(10**9)}"] + base[4 * k :]) for k in range(1, 73)] * 3
    rows = [(i, t + f" y{i}", "en", 1, "x") for i, t in enumerate(texts)]
    sent = []
    plain = n.bucket_links

    def counted(entries, *more):
        sent.append(entries.count())
        return plain(entries, *more)

    monkeypatch.setattr(n, "bucket_links", counted)
    kept = n.keep_one(frame(spark, rows), block=8)
    assert [r["doc_id"] for r in kept.collect()] == [0]
    assert sent[0] <= 2 * 3 * len(rows) and sent[1] == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_open_buckets_compare_all_but_their_main_group(spark, parts):
    stash = n.Stash(spark)
    groups = {1: 12, 2: 4, 3: 3, 4: 1}
    flat = [(r, 100 * r + i) for r, k in groups.items() for i in range(k)]
    entries = spark.createDataFrame([(7, fp, 5, fp, r) for r, fp in flat], "key long, _fp long, _n long, _row long, _root long")
    dealt = n.deal_open(entries, n.open_buckets(entries, stash, 20 if parts == 1 else 3), stash).collect()
    tasks = {}
    for r in dealt:
        tasks.setdefault((r["x"], r["y"]), set()).add(r["_fp"])
    met = {(a, b) for t in tasks.values() for a in t for b in t}
    root = {fp: r for r, fp in flat}
    assert all((a, b) in met for a in root for b in root if root[a] != root[b])
    assert (len(tasks) == 1) == (parts == 1)
    assert parts == 1 or max(map(len, tasks.values())) < len(flat)


def test_null_and_repeated_ids_follow_the_rule(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(None, a), (None, a + " end"), (7, a), (8, b), (8, b + " end"), (8, "quite another text of the same id"), (None, "alone and without an id here")]
    kept = n.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, 7, 8, 8]
    assert len({brute(rows)[rows.index(tuple(r))] for r in kept}) == 4


def test_links_join_what_pairs_join():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**64, 40, np.uint64)) for _ in range(5)]
    sets = [np.unique(np.append(rng.choice(b, rng.integers(34, 41), False), rng.integers(0, 2**64, rng.integers(0, 5), np.uint64))) for b in base for _ in range(12)]
    links = n.near_links(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
    as_sets = [set(x.tolist()) for x in sets]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if near(as_sets[i], as_sets[j])]
    assert closure(len(sets), links) == closure(len(sets), pairs) and len(links) < len(sets)


def test_working_columns_do_not_clash(spark):
    schema = "doc_id long, text string, _n int, _row long, _fp string, c0 string, key string"
    rows = [(i, f"one two three four five six {i % 3}", i, 100 + i, f"f{i}", f"c{i}", "k") for i in range(6)]
    kept = n.keep_one(spark.createDataFrame(rows, schema))
    assert kept.columns == [c.split()[0] for c in schema.split(", ")]
    assert sorted(map(tuple, kept.collect())) == rows[:3]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_given_documents_against_all_pairs(spark, sf):
    """Every pair of texts with a common shingle is compared, so this is the recall of the stage: it must be whole."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    holders, links, pairs = {}, [], 0
    for i, (_, own) in enumerate(rows):
        for j, shared in Counter(j for s in own for j in holders.get(s, ())).items():
            if shared * 5 >= (len(own) + len(rows[j][1]) - shared) * 4:
                links.append((i, j))
                pairs += own != rows[j][1]
        for s in own:
            holders.setdefault(s, []).append(i)
    links += [(i, j) for i, j in zip([i for i, r in enumerate(rows) if not r[1]], [i for i, r in enumerate(rows) if not r[1]][1:])]
    first = closure(len(rows), links)
    kept = sorted(r["doc_id"] for r in n.keep_one(docs).select("doc_id").collect())
    assert kept == [rows[i][0] for i, root in enumerate(first) if i == root]
    assert len(kept) < len(rows) and (sf == "sf0.001" or pairs)
