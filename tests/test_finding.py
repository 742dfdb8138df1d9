import pytest

from twinsift.operators import similar
from twinsift.operators.finding import matches, similar_groups
from twinsift.params import SearchParams

ROWS = [
    (1, 1, "a/1.jpg", "m1", 0b111110), (2, 1, "a/2.jpg", "m2", 0b111100), (3, 1, "b/3.jpg", "m3", 0b111010),
    (4, 2, "b/4.mp4", "m4", 0b111110), (5, 1, "c/5.jpg", "m5", (1 << 60) - 2), (6, 1, "c/6.jpg", "m6", 0), (7, 1, "c/7.jpg", "m7", None),
]


@pytest.fixture(scope="module")
def media(spark):
    return spark.createDataFrame(ROWS, "id long, type int, path string, md5 string, phash long")


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["group_id"], r["pos"])):
        out.setdefault(r["group_id"], []).append(r["media_id"])
    return out


def test_filters_in_order(spark, media):
    assert listed(similar_groups(SearchParams(fg=False), media)) == {1: [1, 2, 3], 2: [2, 1, 3], 3: [3, 1, 2]}
    assert listed(similar_groups(SearchParams(), media)) == {1: [1, 2, 3]}
    assert listed(similar_groups(SearchParams(types=3), media)) == {1: [1, 4, 2, 3]}
    assert listed(similar_groups(SearchParams(fp=True, fg=False), media)) == {1: [1, 3], 2: [2, 3], 3: [3, 1, 2]}
    assert listed(similar_groups(SearchParams(mn=2, fp=True), media)) == {3: [3, 1, 2]}
    assert listed(similar_groups(SearchParams(path="b/", in_path=True, fg=False), media)) == {1: [1, 3], 2: [2, 3]}
    assert listed(similar_groups(SearchParams(path="b/", fg=False), media)) == {1: [1, 2], 2: [2, 1], 3: [3, 1, 2]}
    negative = spark.createDataFrame([("m3", "m1")], "md5_a string, md5_b string")
    weeds = spark.createDataFrame([("m2",), ("m2",)], "weed_md5 string")
    found = similar_groups(SearchParams(neg=True, fg=False), media, negative=negative, weeds=weeds)
    assert listed(found) == {1: [1, 2], 2: [2, 1, 3], 3: [3, 2]}
    assert {(r["media_id"], r["weed"]) for r in found.collect()} == {(1, False), (2, True), (3, False)}


def test_merge_expand_and_needles(spark, media):
    merged = similar_groups(SearchParams(mg=True), media).collect()
    assert sorted((r["group_id"], r["media_id"]) for r in merged) == [(1, 1), (1, 2), (1, 3)]
    pairs = similar_groups(SearchParams(eg=True), media).collect()
    assert sorted((r["needle"], r["media_id"]) for r in pairs) == [(1, 2), (1, 3)]
    one = spark.createDataFrame([(3,)], "needle long")
    assert listed(similar_groups(SearchParams(), media, one)) == {3: [3, 1, 2]}
    assert listed(similar_groups(SearchParams(dht=1, mt=4), media, one)) == {3: [3, 1]}  # at threshold 2 one item besides itself is found
    assert similar_groups(SearchParams(), media.limit(0)).count() == 0


def test_other_algorithms_take_their_data(spark, media):
    patches = spark.createDataFrame([(1, 0, 62), (2, 0, 62), (2, 1, 1 << 50), (3, 0, 62)], "media_id long, feat_no int, hash long")
    got = listed(similar_groups(SearchParams(alg="fdct", fg=False), media, data=patches))
    assert set(got) == {1, 2, 3} and all(len(v) == 3 and v[0] == k for k, v in got.items())
    with pytest.raises(ValueError):
        matches(SearchParams(alg="orb"), media)


def test_thresholds_and_the_needle_itself(spark, media):
    patches = spark.createDataFrame([(1, 0, 62), (2, 0, 63), (3, 0, 62 + 64 + 128), (5, 0, 1 << 50)], "media_id long, feat_no int, hash long")
    pick = lambda df: sorted((r["needle"], r["media_id"]) for r in df.collect())
    assert pick(matches(SearchParams(alg="fdct", dht=1), media, data=patches)) == []
    assert pick(matches(SearchParams(alg="fdct", dht=1, mt=3), media, data=patches)) == [(1, 2), (2, 1), (3, 1)]
    with_self = pick(matches(SearchParams(dht=1, fs=False), media))
    assert with_self == [(1, 1), (1, 4), (2, 2), (3, 3), (4, 1), (4, 4), (5, 5)]
    tone = lambda l: [{"l": l, "u": 0.0, "v": 0.0, "w": 1.0}]
    palettes = spark.createDataFrame([(i, tone(float(i)), 1) for i in range(1, 6)], "media_id long, colors array<struct<l:double,u:double,v:double,w:double>>, num_colors int")
    assert pick(matches(SearchParams(alg="color", mm=1), media, data=palettes)) == [(1, 2), (2, 1), (3, 2), (4, 3), (5, 4)]


def test_reflections_of_the_needle(spark, media):
    flips = [(1, "none", 0b111110), (1, "h", (1 << 60) - 2), (1, "v", 0b111010), (2, "h", 0), (2, "v", None), (9, "h", 0b111110)]
    mirrored = spark.createDataFrame(flips, "needle long, flip string, hash long")
    pick = lambda p, **k: {(r["needle"], r["media_id"]): r["score"] for r in matches(p, media, mirrored=mirrored, **k).collect()}
    one = spark.createDataFrame([(1,)], "needle long")
    plain = pick(SearchParams(fs=False, mm=9), needles=one)
    assert plain == {(1, 1): 0, (1, 4): 0, (1, 2): 1, (1, 3): 1}
    assert pick(SearchParams(fs=False, mm=9, refl="h"), needles=one) == {**plain, (1, 5): 0}
    assert pick(SearchParams(fs=False, mm=9, refl="v"), needles=one) == {**plain, (1, 3): 0}
    assert pick(SearchParams(fs=False, mm=9, refl=7))[(1, 5)] == 0
    for bad in (SearchParams(refl=1, alg="orb"), SearchParams(refl="x"), SearchParams(refl=8)):
        with pytest.raises(ValueError):
            pick(bad)


def test_matches_are_verified(spark, media):
    hashes = spark.createDataFrame([("m1", 0), ("m2", 0b111), ("m3", 0b11111111)], "md5 string, hash long")
    scorer = similar.hash_scorer(hashes)
    assert listed(similar_groups(SearchParams(tm=True, fg=False), media, scorer=scorer)) == {1: [1, 2], 2: [2, 1, 3], 3: [3, 2]}
    assert listed(similar_groups(SearchParams(tm=True, tdht=4, fg=False), media, scorer=scorer)) == {1: [1, 2], 2: [2, 1]}
    known = spark.createDataFrame([("m3", "m1", 2)], "md5_a string, md5_b string, score int")
    assert listed(similar_groups(SearchParams(tm=True, fg=False), media, scores=known)) == {1: [1, 3], 3: [3, 1]}
    assert listed(similar_groups(SearchParams(tm=True, tdht=4, fg=False), media, scores=known, scorer=scorer)) == {1: [1, 3, 2], 2: [2, 1], 3: [3, 1]}
    with pytest.raises(ValueError):
        similar_groups(SearchParams(tm=True), media)


def test_existence_by_pattern(media):
    from twinsift.operators.select import existing_like

    assert [existing_like(media, p).first()["found"] for p in ("a/%", "%/7.jpg", "z%", "a/_")] == [True, True, False, False]
