import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift import catalog_queries as q
from twinsift import tables
from twinsift.operators import blocking, similar
from twinsift.operators.blocking import block_cost, choose_blocks, hamming_join, hamming_pairs, radix_key, scan_blocks
from twinsift.operators.components import connected_components
from twinsift.stash import Stash


@pytest.fixture(scope="module")
def hashes(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    rows = [0, 0]
    for b in base:
        rows.append(b)
        for n in (1, 2, 4, 5, 6):
            x = b
            for bit in rng.sample(range(64), n):
                x ^= 1 << bit
            rows.append(x)
    rows += rows[5:12]
    signed = [(i + 1, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(rows)]
    return signed, spark.createDataFrame(signed, "id long, phash long").cache()


def brute(rows, t):
    return {(i, j) for i, a in rows for j, b in rows if i < j and ((a ^ b) & (2**64 - 1)).bit_count() < t}


def signed_pairs(df, t, **more):
    return [tuple(r) for r in hamming_pairs(df, t, "phash", "id", **more).select("id_a", "id_b").collect()]


@pytest.mark.parametrize("t", range(21))
def test_blocks_find_what_brute_force_finds(hashes, t):
    rows, df = hashes
    got = signed_pairs(df, t)
    assert len(got) == len(set(got))
    assert set(got) == brute(rows, t)


@pytest.mark.parametrize("t", [1, 3, 5, 9])
@pytest.mark.parametrize("sent", [0, 10**6])
def test_two_sides_by_blocks(hashes, monkeypatch, t, sent):
    rows, df = hashes
    monkeypatch.setattr(blocking, "FEW", 0)
    monkeypatch.setattr(blocking, "SENT", sent)
    got = [tuple(r) for r in hamming_join(df.where("id <= 100").toDF("ia", "ha"), df.toDF("ib", "hb"), t, ["ha"], ["hb"]).select("ia", "ib").collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(i, j) for i, a in rows[:100] for j, b in rows if ((a ^ b) & (2**64 - 1)).bit_count() < t}


@pytest.mark.parametrize("hot", [1, 3])
def test_hot_keys_are_dealt_to_parts(hashes, monkeypatch, hot):
    rows, df = hashes
    monkeypatch.setattr(blocking, "HOT", hot)
    monkeypatch.setattr(blocking, "SENT", 0)
    got = signed_pairs(df, 5)
    assert len(got) == len(set(got)) and set(got) == brute(rows, 5)


def test_blocks_are_a_hash_join(spark, hashes, monkeypatch):
    monkeypatch.setattr(blocking, "SENT", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = hamming_pairs(hashes[1], 5, "phash", "id")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_few_needles_leave_the_haystack_where_it_is(hashes):
    plan = hamming_join(hashes[1].where("id <= 5").toDF("ia", "ha"), hashes[1].toDF("ib", "hb"), 3, ["ha"], ["hb"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and "hashpartitioning" not in plan


def test_comparisons_grow_less_than_the_square():
    cost = [block_cost(n, n, 4, 63) / n for n in (10**5, 10**6, 10**7, 10**8, 10**9)]
    assert all(b < 4 * a for a, b in zip(cost, cost[1:]))
    assert [choose_blocks(n, n, 4, 63) for n in (10**3, 500_000)] == [5, 6]
    assert choose_blocks(10**9, 10**9, 4, 63) > 6


def test_widest_thresholds(hashes):
    rows, df = hashes
    for t in (64, 65):
        got = signed_pairs(df, t)
        assert len(got) == len(set(got)) and set(got) == brute(rows, t)
    needles = hashes[1].where("id <= 5").toDF("needle", "nh")
    got = hamming_join(needles, hashes[1], 65, ["nh"], ["phash"]).count()
    assert got == 5 * len(hashes[0])


@pytest.mark.parametrize("most", [1, 10, 10**6])
def test_any_number_of_needles_is_scanned(hashes, most):
    rows, df = hashes
    few = rows[:25] + rows[:3]
    needles = df.sparkSession.createDataFrame(few, "needle long, nh long").repartition(3)
    got = scan_blocks(needles, df, 20, ["nh"], ["phash"], most=most).select("needle", "id", "distance").collect()
    near = [(i, j, ((a ^ b) & (2**64 - 1)).bit_count()) for i, a in few for j, b in rows]
    assert sorted(map(tuple, got)) == sorted(x for x in near if x[2] < 20)


def test_wide_search_of_more_than_a_few_needles(hashes, monkeypatch):
    rows, df = hashes
    monkeypatch.setattr(blocking, "FEW", 3)
    got = similar.search(df.where("id <= 25").toDF("needle", "hash"), df, 20).count()
    assert got == sum(((a ^ b) & (2**64 - 1)).bit_count() < 20 for i, a in rows if i <= 25 and a for _, b in rows if b)


def test_radix_compares_buckets_only(hashes):
    rows, df = hashes
    same = df.select("id", radix_key(F.col("phash"), 4).alias("k")).collect()
    bucket = {r["id"]: r["k"] for r in same}
    assert set(signed_pairs(df, 6, radix=4)) == {(i, j) for i, j in brute(rows, 6) if bucket[i] == bucket[j]}


def test_palettes_in_blocks_of_needles(spark):
    shade = lambda x: {"l": float(x), "u": 0.0, "v": 0.0, "w": 1.0}
    rows = [(i, n, [shade(i + k) for k in range(n)]) for i in range(12) for n in [i % 5]]
    c = spark.createDataFrame(rows, "media_id int, num_colors int, colors array<struct<l:double,u:double,v:double,w:double>>")
    whole = sorted(map(tuple, similar.colour_search(c, c).collect()))
    assert whole == sorted(map(tuple, similar.colour_search(c, c, most=3).collect()))
    assert {(a, b) for a, b, _ in whole} == {(a, b) for a in range(12) for b in range(12) if a % 5 and b % 5 and abs(a % 5 - b % 5) <= 2}


def test_classes_and_counts(hashes):
    rows, df = hashes
    classes = similar.hash_classes(df)
    counts = {r["id"]: r["n_links"] for r in similar.link_counts(df, classes, similar.class_links(classes, 5)).collect()}
    real = [(i, h) for i, h in rows if h]
    pairs = brute(real, 5)
    assert counts == {i: sum(i in p for p in pairs) for i, _ in real}


def test_links_and_members_hold_every_pair(spark, hashes, monkeypatch):
    """Each pair of items below the threshold, copies of a hash among them, follows from the rows of ``sim_dct``."""
    rows, df = hashes
    copies = [(i + 100_000, h) for i, h in rows[::3]] + [(i + 200_000, h) for i, h in rows[::9]] + [(300_000, 0), (300_001, None)]
    df = df.unionByName(spark.createDataFrame(copies, df.schema))
    monkeypatch.setattr(q.T, "media_hashed", lambda *_: df)
    got = [tuple(r) for r in q.QUERIES["sim_dct"](spark, "").collect()]
    real = [(i, h) for i, h in rows + copies if h]
    members = {i: {i} for i, _ in real}
    for a, b, distance in got:
        if not distance:
            members[a].add(b)
    pairs = {(min(a, b), max(a, b)) for own in members.values() for a in own for b in own if a != b}
    pairs |= {(min(x, y), max(x, y)) for a, b, distance in got if distance for x in members[a] for y in members[b]}
    assert pairs == brute(real, 5)
    first = {h: min(i for i, g in real if g == h) for h in {h for _, h in real}}
    assert sum(not d for _, _, d in got) == len(real) - len(first) and len(got) == len(set(got))


def test_best_matches_equal_full_ranking(hashes):
    rows, df = hashes
    classes = similar.hash_classes(df)
    got = {(r["needle"], r["pos"]): r["media_id"] for r in similar.best_matches(df, similar.class_links(classes, 7), classes, 3).collect()}
    real = [(i, h) for i, h in rows if h]
    for i, a in real:
        near = sorted((((a ^ b) & (2**64 - 1)).bit_count(), j) for j, b in real if j != i and ((a ^ b) & (2**64 - 1)).bit_count() < 7)[:3]
        assert [got.get((i, k + 1)) for k in range(len(near))] == [j for _, j in near]
        assert (i, len(near) + 1) not in got


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (102, 101), (7, 7), (500, 500)] + [(1000, i) for i in range(1001, 1200)]
    edges = spark.createDataFrame(chain + [(None, 3), (3, None)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Stash(spark)).collect()}
    want = {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 102: 100, 500: 500, **{i: 1000 for i in range(1000, 1200)}}
    assert got == want
    assert connected_components(edges.limit(0), Stash(spark)).count() == 0


def test_hubs_by_broadcast(spark, monkeypatch):
    from twinsift.operators import components

    monkeypatch.setattr(components, "HUB_ROWS", 10)
    monkeypatch.setattr(components, "HUB_SHARE", 10**9)
    edges = spark.createDataFrame([(5, i) for i in range(6, 90)] + [(89, 200), (300, 301)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Stash(spark)).collect()}
    assert got == {**{i: 5 for i in range(5, 90)}, 200: 5, 300: 300, 301: 300}


@pytest.mark.parametrize("most", [10_000, 20])
def test_chains_hold_copies_and_join_their_parts(spark, hashes, most):
    rows, df = hashes
    media = df.withColumn("path", F.format_string("p%05d", "id"))
    first = {}
    for i, h in rows:
        first.setdefault(h, i)
    reps = sorted(i for h, i in first.items() if h)
    links = spark.createDataFrame([(reps[0], i) for i in reps[1:]], "rep_a long, rep_b long")
    got = similar.sort_similar(media, links, most=most).collect()
    assert sorted(r["id"] for r in got) == [i for i, _ in rows]
    by, value = {r["id"]: r for r in got}, dict(rows)
    for i, h in rows:
        if h:
            assert by[i][1:4] == by[first[h]][1:4]  # beside its equals
    order = [i for i, _ in sorted(((r["id"], (r["part"], r["nth"])) for r in got if value[r["id"]] and r["copy"] == 0), key=lambda x: x[1])]
    parts = {r["part"] for r in got if value[r["id"]]}
    assert sorted(order) == reps and len(parts) == -(-len(reps) // most)
    if most > len(reps):
        chain, rest = [reps[0]], reps[1:]
        near = lambda i: min(((value[i] ^ value[j]) & (2**64 - 1)).bit_count() for j in chain[-5:])
        while rest:
            chain.append(rest.pop(min(range(len(rest)), key=lambda k: (near(rest[k]), k))))
        assert order == chain


def test_unknown_pairs_are_scored_and_kept(spark):
    pairs = spark.createDataFrame([(1, 2, "a", "b"), (1, 3, "a", "c"), (2, 3, "b", "c"), (4, 1, "d", "a")], "needle long, media_id long, md5_n string, md5_m string")
    scores = spark.createDataFrame([("b", "a", 3)], "md5_a string, md5_b string, score int")
    hashes = spark.createDataFrame([("a", 0), ("b", 255), ("c", 7)], "md5 string, hash long")
    scorer = similar.hash_scorer(hashes)
    assert sorted(map(tuple, similar.new_scores(pairs, scores, scorer).collect())) == [("a", "c", 3), ("a", "d", similar.INFINITE), ("b", "c", 5)]
    assert sorted(tuple(r)[:2] for r in similar.verify_pairs(pairs, scores, 5, scorer).collect()) == [(1, 2), (1, 3)]
    assert [tuple(r)[:2] for r in similar.verify_pairs(pairs, scores, 5).collect()] == [(1, 2)]


@pytest.mark.parametrize("hot, radix", [(7, 0), (50, 0), (2048, 0), (3, 3), (2048, 3)])
def test_tiles_meet_each_pair_once(spark, hashes, monkeypatch, hot, radix):
    monkeypatch.setattr(blocking, "HOT", hot)
    rows, df = hashes
    stash = Stash(spark)
    own = stash.put(df.toDF("id", "h"), "own")
    for t in (1, 22):
        got = [tuple(r) for r in blocking.tiled_pairs(own, t, radix, stash).select("id_a", "id_b").collect()]
        want = {(i, j) for i, j in brute(rows, t)}
        if radix:
            by = dict(rows)
            want = {(i, j) for i, j in want if not (by[i] ^ by[j]) & ((1 << radix) - 1 << 1)}
        assert len(got) == len(set(got)) and set(got) == want


def test_tiles_where_keys_compare_more():
    assert blocking.tiles_pay(500_000, 30) and blocking.tiles_pay(500_000, 22, 4) and blocking.tiles_pay(10, 64)
    assert not blocking.tiles_pay(500_000, 5) and not blocking.tiles_pay(10**8, 9) and not blocking.tiles_pay(10**9, 5, 10)


@pytest.mark.parametrize("hot, dealt", [(50, False), (1, True)])
def test_entries_of_counted_keys_are_not_sent(spark, monkeypatch, hot, dealt):
    rng = random.Random(3)
    rows = [rng.getrandbits(52) << 11 for _ in range(100)]  # one block is the same in all
    rows = list(enumerate(rows + [x ^ 3 << rng.randrange(11, 60) for x in rows[:50]]))
    for name, value in (("HOT", hot), ("SENT", 500), ("COPY_COST", 0), ("MAX_COPIES", 15)):
        monkeypatch.setattr(blocking, name, value)
    found = hamming_pairs(spark.createDataFrame(rows, "id long, phash long"), 5, "phash", "id")
    assert {(r.id_a, r.id_b) for r in found.collect()} == brute(rows, 5)
    last = next(x for x in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x)
    assert "SortMergeJoin" in last and ("pl#" in last) == dealt


def test_small_groups_have_their_order_from_spark(spark):
    rows = spark.range(20_000).selectExpr("id div 2 as component", "0 as part", "id as rep", "id as h", "lpad(string(20000 - id), 5, '0') as path")
    began = time.time()
    got = {r.rep: r.nth for r in similar._chains(rows, 5).select("rep", "nth").collect()}
    assert got == {i: 1 - i % 2 for i in range(20_000)}
    assert time.time() - began < 15  # a call to Python for each of 10,000 groups takes longer


def test_near_chain_is_greedy():
    hashes = np.random.default_rng(2).integers(0, 1 << 12, 300).astype(np.uint64)
    chain, free = [0], set(range(1, 300))
    while free:
        chain.append(min(free, key=lambda j: (min(int(hashes[i] ^ hashes[j]).bit_count() for i in chain[-5:]), j)))
        free.remove(chain[-1])
    assert similar.near_chain(hashes).tolist() == chain


def test_a_large_group_is_one_chain(spark, hashes):
    """Parts are numbers of places only: the chain over them is the one without parts, also where a group is many batches of rows."""
    media = hashes[1].withColumn("path", F.format_string("p%05d", "id"))
    reps = sorted(r.id for r in similar.hash_classes(media).select(F.col("rep").alias("id")).collect())
    links = spark.createDataFrame([(reps[0], i) for i in reps[1:]], "rep_a long, rep_b long")
    whole, cut = ({r.id: r for r in similar.sort_similar(media, links, most=most).collect()} for most in (10_000, 20))
    assert {i: (20 * r.part + r.nth, r.copy) for i, r in cut.items()} == {i: (r.nth, r.copy) for i, r in whole.items()}
    rows = [(i, int(h)) for i, h in enumerate(np.random.default_rng(4).integers(1, 1 << 40, 10_500))]
    media = spark.createDataFrame(rows, "id long, phash long").withColumn("path", F.format_string("p%05d", "id"))
    links = media.where("id > 0").select(F.lit(0).cast("long").alias("rep_a"), F.col("id").alias("rep_b"))
    got = sorted(similar.sort_similar(media, links).collect(), key=lambda r: (r.part, r.nth))
    assert [r.id for r in got] == similar.near_chain(np.array([h for _, h in rows], np.uint64)).tolist()
    assert [10_000 * r.part + r.nth for r in got] == list(range(10_500))


def test_tasks_of_a_join_grow_in_number_with_the_copies_of_rows(spark, monkeypatch):
    rng = random.Random(6)
    rows = [rng.getrandbits(63) << 1 for _ in range(100)]
    rows = [(i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(rows + [x ^ 3 << rng.randrange(1, 60) for x in rows[:50]])]
    for name, value in (("SENT", 500), ("COPY_COST", 0), ("MAX_COPIES", 15), ("ENTRIES", 200)):
        monkeypatch.setattr(blocking, name, value)
    found = hamming_pairs(spark.createDataFrame(rows, "id long, phash long"), 5, "phash", "id")
    assert {(r.id_a, r.id_b) for r in found.collect()} == brute(rows, 5)
    assert found.rdd.getNumPartitions() > 4


def test_hashes_of_all_texts_are_not_sent(spark):
    plan = tables.media_hashed(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("part", [40, 10_000])
def test_nearest_by_parts_equals_the_best_row_of_a_search(spark, hashes, monkeypatch, part):
    """A row for each needle, not for each pair, whatever the parts; ties take the smallest id, and copies of hashes count."""
    monkeypatch.setattr(blocking, "PART", part)
    media = hashes[1].select("id", F.when(F.col("id") % 9 == 0, F.lit(0)).otherwise(F.col("phash")).cast("long").alias("phash"))
    media = media.unionByName(media.where("id % 5 = 1").select((F.col("id") + 100_000).alias("id"), F.col("phash").bitwiseXOR(F.lit(6).cast("long")).alias("phash")))
    needles = media.where("id % 2 = 0").select(F.col("id").alias("needle"), F.col("phash").alias("hash"))
    for t in (1, 5, 24):
        best: dict = {}
        for needle, other, score in similar.search(needles, media.where("id % 2 = 1"), t).collect():
            best[needle] = min(best.get(needle, (score, other)), (score, other))
        found = similar.search_nearest(needles, media.where("id % 2 = 1"), t).collect()
        assert len(found) == len(best) > 0
        assert {r["needle"]: (r["score"], r["media_id"]) for r in found} == best


def test_nearest_of_takes_the_first_of_the_nearest():
    asked, hashes = np.array([1 << 63, 7, 0], np.uint64), np.array([7, (1 << 63) | 1, (1 << 63) | 2, 5, 3], np.uint64)
    at, nth, least = blocking.nearest_of(asked, hashes, 2, rows=2)
    assert at.tolist() == [0, 1] and nth.tolist() == [1, 0] and least.tolist() == [1, 0]
    assert [len(x) for x in blocking.nearest_of(asked, hashes[:0], 2)] == [0, 0, 0]
