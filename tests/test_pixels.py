import hashlib
import io
import os
import random
import struct
import time
import zipfile
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from twinsift import catalog_queries as q
from twinsift import tables
from twinsift.sources import features, files, sinks
from twinsift.streaming import ingest


def png(image: np.ndarray) -> bytes:
    """8-bit RGB image as a PNG file."""
    h, w = image.shape[:2]
    raw = b"".join(b"\0" + image[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pattern(seed: int, h: int = 120, w: int = 160) -> np.ndarray:
    """A smooth random colour pattern."""
    rng = np.random.default_rng(seed)
    small = rng.random((6, 8, 3)) * 255
    out = np.stack([np.kron(small[:, :, c], np.ones((20, 20))) for c in range(3)], 2)
    out = np.stack([features.resize(features.mean_blur(out[:, :, c], 15), h, w) for c in range(3)], 2)
    return np.clip(out, 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("images")
    for i in range(10):
        for h, w in ((120, 160), (60, 80), (200, 260)):
            (root / f"p{i}_{h}.png").write_bytes(png(pattern(i, h, w)))
    boxed = np.zeros((160, 160, 3), np.uint8)
    boxed[24:136, 5:155] = pattern(0, 112, 150)
    (root / "boxed.png").write_bytes(png(boxed))
    (root / "flat.png").write_bytes(png(np.full((50, 50, 3), 90, np.uint8)))
    (root / "broken.png").write_bytes(b"\x89PNG broken")
    os.makedirs(root / "_index")
    (root / "_index" / "x.png").write_bytes(png(pattern(1)))
    with zipfile.ZipFile(root / "set.zip", "w") as z:
        z.writestr("in/a.png", png(pattern(3)))
        z.writestr("in/.hidden.png", b"x")
        z.writestr("__MACOSX/in/a.png", b"x")
        z.writestr("notes.txt", b"x")
        z.mkdir("dir.png")
    (root / "bad.zip").write_bytes(b"PK not a zip")
    (root / "j.jpg").write_bytes(b"\xff\xd8head one\xff\xdapixels\xff\xd9")
    (root / "k.jpg").write_bytes(b"\xff\xd8other head\xff\xdapixels\xff\xd9")
    (root / "t.jpg").write_bytes(b"\xff\xd8no scan here")
    return str(root)


def bits(a: int, b: int) -> int:
    return ((a ^ b) & (2**64 - 1)).bit_count()


def test_hashes_of_scaled_images(spark, folder):
    rows = {os.path.basename(r["path"]): r for r in features.image_hashes(files.pixels(spark, folder)).collect()}
    assert "broken.png" not in rows
    for i in range(10):
        own = rows[f"p{i}_120.png"]["phash"]
        assert own & 1 == 0
        assert all(bits(own, rows[f"p{i}_{h}.png"]["phash"]) < 10 for h in (60, 200))
        others = [bits(own, rows[f"p{j}_120.png"]["phash"]) for j in range(10) if j != i]
        assert min(others) > 12
    assert rows["flat.png"]["phash"] != 0


def test_crop_and_mirrors(spark, folder):
    cropped = {os.path.basename(r["path"]): r["phash"] for r in features.image_hashes(files.pixels(spark, folder), crop=True).collect()}
    plain = {os.path.basename(r["path"]): r["phash"] for r in features.image_hashes(files.pixels(spark, folder)).collect()}
    assert bits(cropped["boxed.png"], plain["p0_120.png"]) < 12 < bits(plain["boxed.png"], plain["p0_120.png"]) + 6
    flips = {(os.path.basename(r["path"]), r["flip"]): r["hash"] for r in features.mirrored_hashes(files.pixels(spark, folder)).collect()}
    turned = features.dct_hash(np.ascontiguousarray(features.gray(pattern(2)[:, ::-1, ::-1].copy())))
    assert bits(flips["p2_120.png", "h"], turned) <= 2 and flips["p2_120.png", "none"] == plain["p2_120.png"]


def test_patches_palettes_and_column_form(spark, folder):
    pixels = files.pixels(spark, folder).where("path like '%p%_200.png'")
    assert {r["feat_no"] for r in features.patch_hashes(pixels).collect()} == set(range(4 + 9 + 16))
    twice = [features.palettes(pixels).orderBy("path").collect() for _ in range(2)]
    assert twice[0] == twice[1] and all(0 < r["num_colors"] <= 32 == 32 and len(r["colors"]) == r["num_colors"] for r in twice[0])
    assert all([c["w"] for c in r["colors"]] == sorted((c["w"] for c in r["colors"]), reverse=True) for r in twice[0])
    one = pixels.select("path", features.dct_hash_udf("height", "width", "channels", "data").alias("h"))
    whole = {r["path"]: r["phash"] for r in features.image_hashes(pixels).collect()}
    assert {r["path"]: r["h"] for r in one.collect()} == whole


def test_listing_members_and_digests(spark, folder):
    listing = files.scan(spark, folder)
    assert "binaryFile" not in str(listing.columns) and listing.where("path like '%_index%'").count() == 0
    everything = files.scan(spark, folder, content=True)
    found = files.members(everything, content=True).collect()
    assert [(r["member"], bytes(r["content"])) for r in found] == [("in/a.png", png(pattern(3)))]
    assert files.image_files(spark, folder, content=False).count() == 30 + 3 + 3 + 1
    md5 = {os.path.basename(r["path"]): r for r in features.digests(everything).collect()}
    assert md5["j.jpg"]["md5"] == md5["k.jpg"]["md5"] == hashlib.md5(b"\xff\xdapixels\xff\xd9").hexdigest()
    assert md5["t.jpg"]["error"] == "truncated" and md5["p1_60.png"]["md5"] == hashlib.md5(png(pattern(1, 60, 80))).hexdigest()
    files.register_members(spark)
    everything.where("path like '%.zip'").createOrReplaceTempView("zips")
    rows = spark.sql("SELECT m.member FROM zips, LATERAL archive_members(path, content) m").collect()
    assert [r["member"] for r in rows] == ["in/a.png"]


def test_members_are_read_by_ranges(spark, tmp_path):
    import zipfile

    rng = random.Random(1)
    bodies = {f"d/{i}.png": rng.randbytes(300) for i in range(1500)}
    with zipfile.ZipFile(tmp_path / "big.zip", "w") as z:
        for name, body in bodies.items():
            z.writestr(name, body)
        z.writestr("__MACOSX/x.png", b"no")
    with zipfile.ZipFile(tmp_path / "small.zip", "w") as z:
        z.writestr("a.png", b"whole")
        z.writestr("b.png", b"spoilt" * 50)
    data = (tmp_path / "small.zip").read_bytes()
    (tmp_path / "small.zip").write_bytes(data.replace(b"spoilt" * 50, b"spoilT" * 50))
    (tmp_path / "not.zip").write_bytes(b"no archive")
    listed = files.scan(spark, f"file://{tmp_path}")
    got = files.split_members(listed, content=True, size=20_000)
    assert got.rdd.getNumPartitions() > 1
    rows = {(os.path.basename(r["archive"]), r["member"]): r["content"] and bytes(r["content"]) for r in got.collect()}
    assert rows == {**{("big.zip", n): b for n, b in bodies.items()}, ("small.zip", "a.png"): b"whole", ("small.zip", "b.png"): None}
    by_task = got.groupBy(F.spark_partition_id()).count().collect()
    assert len(by_task) > 5 and max(r["count"] for r in by_task) < 1000
    plain = files.members(files.scan(spark, f"file://{tmp_path}", content=True)).select("path", "length")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, files.split_members(listed).select("path", "length").collect()))


def frames_of(seed: int, n: int = 60):
    rng = random.Random(seed)
    h, out = rng.getrandbits(64), []
    for i in range(n):
        if rng.random() < 0.2:
            h = rng.getrandbits(64)
        out.append((seed, i, h - (1 << 64) if h >> 63 else h))
    return out


def plain_compress(rows, threshold=8):
    kept, window = [rows[0]], []
    for r in rows[1:]:
        if all(bits(r[2], w) < threshold for w in window):
            pass
        else:
            kept.append(r)
            window = []
        window.append(r[2])
    return kept if kept[-1] == rows[-1] else [*kept, rows[-1]]


def test_frame_compression(spark):
    rows = frames_of(1) + frames_of(2) + frames_of(3, 1) + frames_of(4, 2)
    df = spark.createDataFrame(rows, "media_id long, frame int, hash long")
    got = sorted(tuple(r) for r in features.compress_frames(df).collect())
    assert got == sorted(r for s, n in ((1, 60), (2, 60), (3, 1), (4, 2)) for r in plain_compress(frames_of(s, n)))
    assert (4, 1) in {r[:2] for r in got}  # kept as the last frame only
    half = features.compress_frames(df.where("frame < 30"))
    more = features.compress_frames(df, kept_until=features.last_kept(half))
    assert more.agg(F.min("frame")).first()[0] >= 1 and more.where("media_id = 1 and frame < 30").count() == 0


def test_snapshots_and_match_lists(spark, tmp_path):
    root = f"file://{tmp_path}/snap"
    sinks.write_snapshot(spark.range(3), root)
    time.sleep(0.01)
    sinks.write_snapshot(spark.range(5), root)
    assert sinks.read_snapshot(spark, root).count() == 5
    m = spark.createDataFrame([("a", "b", 0, 3, 1, 2)], "needle string, match string, index int, score int, position int, count int")
    sinks.write_matches(m, f"file://{tmp_path}/m")
    assert spark.read.option("header", "true").csv(f"file://{tmp_path}/m").columns == m.columns
    sinks.print_selection(m, f"file://{tmp_path}/t")
    assert spark.read.text(f"file://{tmp_path}/t").first()[0] == "a\tb\t0\t3\t1\t2"
    for _ in range(2):
        sinks.append_state(m, f"file://{tmp_path}/s")
    assert spark.read.parquet(f"file://{tmp_path}/s").count() == 2


def test_ingest_and_arrivals(spark, tmp_path):
    src, cat = tmp_path / "src", f"file://{tmp_path}/catalog"
    src.mkdir()
    make = lambda b: b.select("path", F.md5("content").alias("md5"), F.lit(1).alias("type"))
    for n in range(2):
        for i in range(3):
            (src / f"f{n}{i}.png").write_bytes(png(pattern(10 * n + i, 40, 40)))
        ingest.ingest(ingest.watch_files(spark, f"file://{src}", "*.png"), cat, f"file://{tmp_path}/c1", make).awaitTermination()
    rows = spark.read.parquet(cat).orderBy("id").collect()
    assert [r["id"] for r in rows] == [1, 2, 3, 4, 5, 6] and len({r["path"] for r in rows}) == 6

    catalog = spark.createDataFrame([(1, "a", 7), (2, "b", 1 << 40)], "id long, md5 string, phash long")
    weeds = spark.createDataFrame([("x", "a"), ("y", "gone")], "weed_md5 string, orig_md5 string")
    spark.createDataFrame([(10, 3, "x"), (11, 1 << 50 | 1 << 51 | (2**20 - 1) << 5, "y")], "needle long, hash long, md5 string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("needle long, hash long, md5 string").parquet(f"file://{tmp_path}/in")
    ingest.match_arrivals(stream, catalog, weeds, f"file://{tmp_path}/out", f"file://{tmp_path}/c2").awaitTermination()
    got = sorted((tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").select("needle", "is_weed", "media_id", "score").collect()), key=str)
    assert got == [(10, True, 1, 1), (10, True, 2, 3), (11, False, None, None)]


def test_frame_stream_equals_batch(spark, tmp_path):
    rows = [(*r, i == 59) for s in (1, 2) for i, r in enumerate(frames_of(s))]
    schema = "media_id long, frame int, hash long, last boolean"
    for part in range(3):
        own = [r for r in rows if r[1] // 20 == part]
        spark.createDataFrame(own, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = ingest.compress_stream(stream).writeStream.format("memory").queryName("kept").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM kept").collect())
    assert got == sorted(r for s in (1, 2) for r in plain_compress(frames_of(s)))


def test_payload_of_pictures_with_thumbnails(spark):
    app = lambda n, body: bytes([0xFF, 0xE0 + n]) + (len(body) + 2).to_bytes(2, "big") + body
    scan = b"\xff\xda\x00\x04scan data\xff\xd9"
    thumb = lambda x: b"Exif" + x + b"\xff\xd8\xff\xda thumb \xff\xd9"
    whole = lambda x: b"\xff\xd8" + app(0, b"JFIF") + app(1, thumb(x)) + app(15, b"z") + scan
    rows = [("a.jpg", whole(b"1")), ("b.bin", whole(b"22")), ("c.jpg", whole(b"1")[:-2]), ("d.jpg", b"no picture"), ("e", None), ("f.jpg", b"\xff\xd8 no scan \xff\xd9")]
    got = {r["path"]: (r["md5"], r["error"]) for r in features.digests(spark.createDataFrame(rows, "path string, content binary")).collect()}
    md5 = lambda d: __import__("hashlib").md5(d).hexdigest()
    assert got["a.jpg"] == got["b.bin"] == (md5(scan), None)
    assert got["c.jpg"] == (md5(scan[:-2]), "truncated") and got["d.jpg"] == (md5(b"no picture"), None)
    assert got["e"] == (None, None) and got["f.jpg"] == (md5(rows[5][1]), None)


def test_borders_by_runs_from_both_ends():
    image = np.full((100, 120, 1), 200, np.uint8)
    image[:15] = image[-15:] = 0
    image[5:10, 50:70] = 255  # a subtitle in the border
    image[40:60, :, 0] = np.arange(120) % 90 + 100
    image[50, 1:119] = 0  # a dark stripe inside that does not reach the ends
    image[0, 0] = 0
    assert features.crop_borders(image).shape == (70, 120, 1)


def test_patches_of_given_rectangles(spark):
    data = bytes(np.random.default_rng(2).integers(0, 255, 64 * 80, np.uint8))
    pixels = spark.createDataFrame([("a", 80, 64, 1, data), ("b", 80, 64, 1, data)], "path string, width int, height int, channels int, data binary")
    boxes = spark.createDataFrame([("a", 0, 0, 32, 32), ("a", 40, 30, 33, 33), ("a", 60, 0, 32, 32), ("a", 0, 0, 30, 32)], "path string, x int, y int, w int, h int")
    got = sorted(tuple(r) for r in features.patch_hashes(pixels, boxes).collect())
    g = np.frombuffer(data, np.uint8).reshape(64, 80).astype(float)
    assert got == [("a", 0, features.dct_hash(g[:32, :32])), ("a", 1, features.dct_hash(g[30:63, 40:73]))]
    assert {r["path"] for r in features.patch_hashes(pixels).collect()} == {"a", "b"}


def plain_quality(image):
    """The score by loops over pixels."""
    h, w = image.shape[:2]
    g = [[float(sum(image[y, x, :3].tolist())) for x in range(w // 10, min(w, w - w // 10 + 1))] for y in range(h // 10, min(h, h - h // 10 + 1))]

    def edges(rows):
        n, m = len(rows), len(rows[0])
        gap = [[abs(r[x + 1] - r[x - 1]) if 0 < x < m - 1 else 0.0 for x in range(m)] for r in rows]
        mean = sum(map(sum, gap)) / ((n - 1) * (m - 1))
        gap = [[v if v > mean else 0 for v in r] for r in gap]
        found = {(y, x) for y in range(n) for x in range(1, m - 1) if gap[y][x] > max(gap[y][x - 1], gap[y][x + 1])}
        long = 0
        for x in range(m):
            run = 0
            for y in range(1, n - 1):
                if (y, x) in found:
                    run += 1
                else:
                    long += run > 1
                    run = 0
        return found, long

    (across, a), (down, b) = edges(g), edges([list(c) for c in zip(*g)])
    n = sum((y, x) in across or (x, y) in down for y in range(1, len(g) - 1) for x in range(1, len(g[0]) - 1))
    return int(100 * n / ((len(g) - 2) * (len(g[0]) - 2)) + 100 * (a + b) / n) if n else 0


@pytest.mark.parametrize("size", [(3, 3, 1), (20, 31, 3), (64, 48, 3), (9, 40, 4)])
def test_quality_against_loops(size):
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, size).astype(np.uint8)
    steps = np.repeat(np.repeat(rng.integers(0, 256, size), 4, 0), 3, 1)[: size[0], : size[1]].astype(np.uint8)
    for image in (noise, steps, np.full(size, 9, np.uint8)):
        assert features.quality_score(image) == plain_quality(image)


def test_palette_places_each_colour_for_all_its_pixels():
    image = np.zeros((40, 40, 3), np.uint8)
    image[:, :30], image[:, 30:] = (10, 20, 200), (200, 30, 10)
    found = features.palette(image, colours=1)
    y, x = (np.arange(40)[:, None] + 0.5) / 20 - 1, (np.arange(40)[None, :] + 0.5) / 20 - 1
    inside = np.sqrt(x**2 + y**2) <= 0.9
    want = features.luv(image[:, :, ::-1][inside].astype(float)).mean(0)
    assert np.allclose(found[0][:3], want)


def test_pictures_are_dealt_to_many_tasks(spark):
    assert tables.pixels(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= 4


def test_average_hash_of_a_cell_equal_to_the_mean(spark, tmp_path):
    levels = [189, 156, 166, 173, 168, 132, 147, 200, 138, 156, 139, 162, 147, 133, 135, 210, 193, 141, 174, 177, 164, 166, 151, 187, 162, 129, 152, 126, 159, 127, 203, 183]
    levels += [231, 192, 149, 153, 169, 148, 176, 196, 164, 158, 178, 180, 159, 163, 185, 163, 160, 158, 161, 128, 217, 167, 171, 156, 123, 146, 122, 137, 165, 205, 158, 173]
    gray = [114 * x + 587 * levels[(i + 21) % 64] + 299 * levels[(i + 42) % 64] for i, x in enumerate(levels)]
    assert any(64 * x == sum(gray) for x in gray)
    want = sum(1 << i for i, x in enumerate(gray) if 64 * x > sum(gray))
    spark.createDataFrame([(1, [(x - 63.5) / 192 - 0.5 for x in levels])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    for rows in (q.average_hash(spark, str(tmp_path)).collect(), duck.execute(q.SQL["average_hash"]).fetchall()):
        assert [(r[0], r[1] % (1 << 64)) for r in rows] == [("vec1.png", want)]
