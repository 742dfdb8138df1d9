import random

import pytest
from pyspark.sql import functions as F

from twinsift.operators import blocking, groups, similar
from twinsift.plans import moves
from twinsift.stash import Stash


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def apart(a, b):
    return sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(a, b))


@pytest.mark.parametrize("few", [0, 1000])
def test_a_mass_of_equal_features_makes_few_rows(spark, monkeypatch, few):
    monkeypatch.setattr(similar, "FEW", few)
    rows = spark.range(20_000).select(F.expr("id div 50").alias("media_id"), F.expr("id % 50").alias("feat_no"), F.lit(7).cast("long").alias("hash"))
    needles = rows.select(F.col("media_id").alias("needle"), "feat_no", F.col("hash").alias("own"))
    found = similar.nearest(needles.withColumnRenamed("feat_no", "no"), rows, 5, 10, ["own"], ["hash"], ["media_id", "feat_no"])
    assert found.count() == 200_000
    assert {tuple(r) for r in found.select("media_id", "feat_no", "distance").distinct().collect()} == {(0, i, 0) for i in range(10)}
    assert similar.feature_votes(rows, rows).count() == 400  # all votes go to the first item


@pytest.mark.parametrize("words, sample, few", [(1, None, 0), (1, None, 1000), (4, None, 0), (4, (4, 120), 0)])
def test_nearest_against_brute_force(spark, monkeypatch, words, sample, few):
    monkeypatch.setattr(similar, "FEW", few)
    rng = random.Random(words)
    base = [tuple(rng.getrandbits(63) for _ in range(words)) for _ in range(12)]
    rows = []
    for i in range(220):
        h = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            h[rng.randrange(words)] ^= 1 << rng.randrange(1, 63)
        rows.append((i // 5, i % 5, *h))
    rows.append((99, 0, *([None] * words)))
    names = [f"d{w}" for w in range(words)]
    table = spark.createDataFrame(rows, "media_id long, no long, " + ", ".join(f"{n} long" for n in names))
    needles = table.select(F.col("media_id").alias("needle"), F.col("no").alias("nn"), *(F.col(n).alias(f"n{n}") for n in names))
    got = similar.nearest(needles, table, 4, 3, [f"n{n}" for n in names], names, ["media_id", "no"], sample)
    want = []
    for n in rows[:-1]:
        near = sorted((apart(n[2:], m[2:]), m[0], m[1]) for m in rows[:-1] if apart(n[2:], m[2:]) < 4)[:3]
        want += [(n[0], n[1], m, k, d) for d, m, k in near]
    assert sorted(map(tuple, got.select("needle", "nn", "media_id", "no", "distance").collect())) == sorted(want)


@pytest.mark.parametrize("words, sample, part, cells", [(1, None, 16_384, 1 << 18), (1, None, 7, 64), (4, None, 30, 64), (4, (4, 120), 16_384, 64), (4, (4, 120), 7, 1 << 18)])
def test_nearest_by_arrays_of_buckets(spark, monkeypatch, words, sample, part, cells):
    """The same rows as by comparing all, whatever the parts of a bucket; ties go by the order, and asked hashes need not be rows."""
    for name, value in (("PAIRS", 0), ("ARRAY_PAIRS", 0), ("PART", part), ("CELLS", cells)):
        monkeypatch.setattr(blocking, name, value)
    monkeypatch.setattr(similar, "FEW", 0)
    monkeypatch.setattr(similar, "hamming_join", None)  # no pair is to be joined as rows
    monkeypatch.setattr(similar, "sampled_join", None)
    rng = random.Random(words)
    base = [tuple(rng.getrandbits(64) & ~1 for _ in range(words)) for _ in range(9)]
    rows = []
    for i in range(260):
        h = list(rng.choice(base))
        for _ in range(rng.randint(0, 3)):
            h[rng.randrange(words)] ^= 1 << rng.randrange(1, 64)
        rows.append((rng.randrange(50), i, *map(signed, h)))
    names = [f"d{w}" for w in range(words)]
    table = spark.createDataFrame(rows, "media_id long, no long, " + ", ".join(f"{n} long" for n in names))
    asked = [r for r in rows if r[1] % 3] + [(500 + i, i, *map(signed, (b[0] ^ 6, *b[1:]))) for i, b in enumerate(base)]
    needles = spark.createDataFrame(asked, "needle long, nn long, " + ", ".join(f"n{n} long" for n in names))
    got = similar.nearest(needles, table.where("no % 5 <> 0"), 4, 3, [f"n{n}" for n in names], names, ["media_id", "no"], sample)
    want = []
    for n in asked:
        near = sorted((apart(n[2:], m[2:]), m[0], m[1]) for m in rows if m[1] % 5 and apart(n[2:], m[2:]) < 4)[:3]
        want += [(n[0], n[1], m, k, d) for d, m, k in near]
    assert sorted(map(tuple, got.select("needle", "nn", "media_id", "no", "distance").collect())) == sorted(want)


@pytest.mark.parametrize("sample", [None, (12, 24)])
def test_wide_thresholds_on_large_buckets_make_no_row_for_a_pair(spark, monkeypatch, sample):
    """Hashes that lie close together: all pairs of them are below the threshold, of which tasks hand on the best only."""
    monkeypatch.setattr(blocking, "PAIRS", 0)
    rows = spark.range(1024).select(F.col("id").alias("d0"), *(F.lit(7).cast("long").alias(f"d{w}") for w in (1, 2, 3)), F.struct(F.expr("1024 - id").alias("media_id")).alias("_first"))
    asked = rows.select(*(F.col(f"d{w}").alias(f"n{w}") for w in range(4)))
    found = blocking.nearest_in_tables(asked, rows, 25, 10, [f"n{w}" for w in range(4)], [f"d{w}" for w in range(4)], sample, Stash(spark))
    assert sum(r[0] for r in found.groupBy("n0").count().select("count").collect()) == 10 * 1024
    flips = lambda n: sorted([(0, 1024 - n)] + [(1, 1024 - (n ^ 1 << i)) for i in range(10)])[:10]
    if sample is None:
        got = sorted((r.n0, r.distance, r._first.media_id) for r in found.collect())
        assert got == sorted((n, *x) for n in range(1024) for x in flips(n))


def test_few_pairs_and_small_buckets_stay_with_the_join(spark, monkeypatch):
    rows = spark.range(400).select(F.xxhash64("id").alias("d0"), F.struct("id").alias("_first"))
    search = lambda: blocking.nearest_in_tables(rows.select(F.col("d0").alias("n0")), rows, 3, 10, ["n0"], ["d0"], None, Stash(spark))
    assert search() is None
    monkeypatch.setattr(blocking, "PAIRS", 0)
    assert search() is None
    monkeypatch.setattr(blocking, "ARRAY_PAIRS", 0)
    assert search().count() >= 400


def test_sampled_tables_keep_their_recall(spark):
    rng = random.Random(9)
    base = [[rng.getrandbits(64) for _ in range(4)] for _ in range(1500)]
    rows = [(i, *map(signed, h)) for i, h in enumerate(base)]
    for i, h in enumerate(base):
        h = list(h)
        for bit in rng.sample(range(256), 24):
            h[bit // 64] ^= 1 << bit % 64
        rows.append((10_000 + i, *map(signed, h)))
    table = spark.createDataFrame(rows, "id long, d0 long, d1 long, d2 long, d3 long")
    left = table.where("id < 10000").toDF("n", *(f"n{w}" for w in range(4)))
    words = [f"d{w}" for w in range(4)]
    assert blocking.sample_plan(3000, 24, 256, 0.02) < (12, 20) and blocking.sample_plan(10**9, 24, 256, 0.02)[1] < 100
    got = [tuple(r) for r in blocking.sampled_join(left, table.where("id >= 10000"), 25, [f"n{w}" for w in range(4)], words).select("n", "id", "distance").collect()]
    assert len(got) == len(set(got))
    planted = {(i, 10_000 + i, 24) for i in range(1500)}
    assert not set(got) - planted and len(set(got) & planted) > 0.95 * len(planted)
    few = blocking.sampled_join(left, table.where("id >= 10000"), 25, [f"n{w}" for w in range(4)], words, plan=(200, 1))
    assert few.count() < 10  # hardly a pair agrees on 200 bits


def test_tasks_of_sampled_tables_follow_the_pairs(spark, monkeypatch):
    """Entries of few bytes make many pairs: their tasks are not merged by bytes, and grow in number with the pairs."""
    monkeypatch.setattr(blocking, "SENT", 0)
    rows = spark.range(800).select("id", F.xxhash64("id").alias("a"), F.xxhash64("id", F.lit(1)).alias("b"))
    plain = dict(left_words=["na", "nb"], right_words=["a", "b"], plan=(3, 30))
    want = blocking.sampled_join(rows.toDF("n", "na", "nb"), rows, 45, **plain)
    monkeypatch.setattr(blocking, "PAIRS", 100_000)
    got = blocking.sampled_join(rows.toDF("n", "na", "nb"), rows, 45, **plain)
    assert got.rdd.getNumPartitions() > 4 >= want.rdd.getNumPartitions()
    assert sorted(map(tuple, got.select("n", "id", "distance").collect())) == sorted(map(tuple, want.select("n", "id", "distance").collect()))


@pytest.mark.parametrize("hot", [2, 2048])
def test_hot_buckets_of_sampled_tables(spark, monkeypatch, hot):
    monkeypatch.setattr(blocking, "HOT", hot)
    monkeypatch.setattr(blocking, "SENT", 0)
    rows = spark.createDataFrame([(i, 5, 1 << i % 7) for i in range(40)], "id long, a long, b long")
    got = blocking.sampled_join(rows.toDF("n", "na", "nb"), rows, 3, ["na", "nb"], ["a", "b"], plan=(6, 30)).select("n", "id")
    got = [tuple(r) for r in got.collect()]
    assert len(got) == len(set(got)) == 1600


@pytest.mark.parametrize("block", [4, 2000])
def test_nearest_palettes(spark, block):
    rng = random.Random(block)
    tone = lambda: {"l": rng.uniform(0, 100), "u": rng.uniform(-100, 170), "v": rng.uniform(-130, 100), "w": 1.0}
    rows = [(i, c := [tone() for _ in range(rng.randint(0, 7))], len(c)) for i in range(400)]
    rows = [(i, c, n) for i, c, n in rows] + [(500 + i, rows[i][1], rows[i][2]) for i in range(30)]  # ties
    table = spark.createDataFrame(rows, "media_id long, colors array<struct<l:double,u:double,v:double,w:double>>, num_colors int").repartition(4)
    needles = table.where("media_id % 40 = 0")
    for filter_self in (True, False):
        got = similar.colour_nearest(needles, table, 4, 2, filter_self, block)
        want = similar.top_matches(similar.colour_search(needles, table), 4, filter_self)
        pick = lambda df: sorted(map(tuple, df.select("needle", "media_id", "score", "pos").collect()))
        assert pick(got) == pick(want) and got.count() > 30
    assert similar.colour_nearest(needles.where("num_colors < 0"), table, 4).count() == 0


def test_merge_has_an_edge_for_a_row_at_most(spark):
    rows = [(g, p, 0 if p == 0 else g + p) for g in range(1, 60) for p in range(3)]  # all needles are item 0
    rows += [(100, 0, 3000), (100, 1, 3001), (101, 0, 3001), (101, 1, 3002), (102, 0, 4000)]
    table = spark.createDataFrame(rows, "group_id long, pos int, media_id long")
    assert groups.merge_edges(table).count() <= len(rows)
    got = groups.merge(table)
    want = {(1, 0)} | {(1, g + p) for g in range(1, 60) for p in (1, 2)} | {(100, m) for m in (3000, 3001, 3002)} | {(102, 4000)}
    assert sorted(map(tuple, got.select("group_id", "media_id").collect())) == sorted(want)


def plain_videos(needles, frames, threshold, least, percent):
    """Video matches frame by frame."""
    out, videos = [], {}
    for v, f, h in frames:
        if 5 <= (h & (2**64 - 1)).bit_count() <= 59:
            videos.setdefault(v, []).append((f, h))
    for needle in sorted({v for v, _, _ in needles}):
        own = sorted((f, h) for v, f, h in needles if v == needle)
        for video, hay in videos.items():
            if video == needle:
                continue
            met = []
            for src, h in own:
                near = [(apart([h], [x]), f) for f, x in hay if apart([h], [x]) < threshold and (x ^ h) & 2046 == 0]
                if near:
                    met.append((src, min(near)[1]))
            num = len(met)
            close = sum(abs(d - (met[i - 1][1] if i else 0)) < 15 for i, (_, d) in enumerate(met))
            if num >= least and close * 100 // num >= percent:
                (a, x), (b, y) = met[0], met[-1]
                out.append((needle, video, 100 - close * 100 // num, a, x, max(b - a, y - x), num, close * 100 // num))
    return sorted(out)


def test_runs_of_frames_against_single_frames(spark):
    rng = random.Random(4)
    hashes = [rng.getrandbits(62) << 1 for _ in range(12)]
    frames = []
    for v in range(6):
        f = 0
        for _ in range(14):
            h = rng.choice(hashes) ^ (rng.getrandbits(1) << 40)
            for _ in range(rng.randint(1, 6)):
                f += rng.randint(1, 4)
                frames.append((v, f, h))
    table = spark.createDataFrame(frames, "media_id long, frame int, hash long")
    cols = ["needle", "media_id", "score", "src_in", "dst_in", "len", "num", "near_percent"]
    got = similar.video_search(table, table, 4, least=5, percent=30).select(*cols)
    want = plain_videos(frames, frames, 4, 5, 30)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10


def test_still_videos(spark):
    table = spark.range(20_000).select(F.expr("id div 10000").alias("media_id"), F.expr("int(id % 10000)").alias("frame"), F.lit(0x0F0F0F0F0F).cast("long").alias("hash"))
    assert similar.frame_runs(table).count() == 2
    got = similar.video_search(table, table).collect()
    assert sorted((r.needle, r.media_id, r.num, r.score) for r in got) == [(0, 1, 10_000, 0), (1, 0, 10_000, 0)]


def test_the_first_of_several_takes_the_name(spark):
    rows = [(1, "a/x1.t", 3), (2, "a/x2.t", 1), (3, "a/x3.t", 2), (4, "b/x4.t", 0), (5, "a/new.t", 9)]
    items = spark.createDataFrame(rows, "id long, path string, pos long")
    got = {r.id: r.status for r in moves.rename_plan(items.where("id < 5"), items.where("id < 5"), "new", r"x\d").collect()}
    assert got == {1: "collision", 2: "ok", 3: "collision", 4: "ok"}
    got = {r.id: r.status for r in moves.rename_plan(items.where("id < 5"), items, "new", r"x\d").collect()}
    assert got == {1: "exists", 2: "exists", 3: "exists", 4: "ok"}
    with pytest.raises(Exception, match="slash"):
        moves.rename_plan(items, items, "n/w", r"x\d").collect()


def test_only_short_needles_are_searched_again(spark):
    rows = spark.createDataFrame([(1, 0, 64), (2, 0, 64), (3, 0, 65), (4, 0, 64 + 7), (5, 0, 0xFFFFF << 20)], "media_id long, feat_no long, hash long")
    got = similar.widened(rows.withColumnRenamed("media_id", "needle"), "fdct", rows, 1, 5, 1)
    by = {}
    for r in got.collect():
        by.setdefault(r.needle, []).append((r.threshold, r.media_id))
    assert {n: sorted(v) for n, v in by.items()} == {
        1: [(1, 1), (1, 2)], 2: [(1, 1), (1, 2)], 3: [(2, 1), (2, 2), (2, 3)], 4: [(3, 3), (3, 4)], 5: [(5, 5)],
    }


def test_cascade_finds_only_the_nearest_palettes(spark):
    rows = [(i, 3, [(float(i), float(j), 0.0, 1.0) for j in range(3)]) for i in range(1, 41)]
    colours = spark.createDataFrame(rows, "media_id long, num_colors int, colors array<struct<l:double,u:double,v:double,w:double>>")
    media = spark.createDataFrame([(i, 0) for i in range(1, 41)], "id long, phash long")
    features = spark.createDataFrame([], "media_id long, feat_no int, hash long")
    descriptors = spark.createDataFrame([], "media_id long, desc_no int, d0 long, d1 long, d2 long, d3 long")
    stages = similar.all_algorithms(media, features, descriptors, colours, 2)
    needles = spark.createDataFrame([(i,) for i in range(1, 41)], "needle long")
    assert stages[-1][1](needles).count() == 80
    got = {(r.needle, r.media_id, r.score, r.pos, r.stage) for r in similar.cascade(needles, stages).where("needle = 7").collect()}
    assert got == {(7, 6, 4, 1, "color"), (7, 8, 4, 2, "color")}


def test_palettes_of_one_file_are_scored_by_all_tasks(spark):
    rng = random.Random(5)
    rows = [(i, k := rng.randint(1, 7), [(rng.uniform(0, 100), rng.uniform(-100, 170), rng.uniform(-130, 100), 1.0) for _ in range(k)]) for i in range(300)]
    table = spark.createDataFrame(rows, "media_id long, num_colors int, colors array<struct<l:double,u:double,v:double,w:double>>").coalesce(1)
    needles = table.where("media_id % 50 = 0")

    def score(a, b):
        large, small = (a, b) if len(a) >= len(b) else (b, a)
        return int(1 + sum(min(((x[0] - y[0]) ** 2 + (x[1] - y[1]) ** 2 + (x[2] - y[2]) ** 2) ** 0.5 for y in small) for x in large))

    want = sorted((i, j, score(a, b)) for i, m, a in rows if i % 50 == 0 for j, n, b in rows if abs(m - n) <= 2)
    found = similar.colour_search(needles, table)
    assert sorted(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() >= 4  # one before, however many palettes
