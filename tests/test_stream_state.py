"""Frames with state: a first state from stored frames, ends by silence, batches in between."""

import random
from datetime import datetime, timedelta

import pytest

from twinsift.sources.features import FrameWindow, compress_frames, last_kept
from twinsift.stash import Stash
from twinsift.streaming.ingest import follow_videos

START = datetime(2024, 1, 1)
SCHEMA = "media_id long, frame int, hash long, ts timestamp"


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def follow(spark, batches, stored=None):
    stash = Stash(spark)
    folder, out = stash.path("frames"), stash.path("kept")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder).withWatermark("ts", "0 seconds")
    run = follow_videos(stream, 20, 60, stored).writeStream.format("parquet").option("path", out).option("checkpointLocation", stash.path("state"))
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, spark.read.schema("media_id long, frame int, hash long").parquet(out).collect()))


def video(seed, media, first=0, n=60):
    r = random.Random(seed)
    value, rows = r.getrandbits(63), []
    for i in range(first, first + n):
        if r.random() < 0.2:
            value = r.getrandbits(63) - r.choice([0, 2**63 - 1])
        rows.append((media, i, value ^ r.getrandbits(3), START + timedelta(seconds=i)))
    return rows


def test_stream_equals_batch_and_resumes(rocks):
    old = [r for m in (1, 2) for r in video(m, m)]
    new = [r for m in (1, 2, 3) for r in video(10 + m, m, 60)]
    stored = compress_frames(rocks.createDataFrame(old, SCHEMA), 20)
    want = compress_frames(rocks.createDataFrame(old + new, SCHEMA), 20, last_kept(stored))
    end = [(9, 0, 5, START + timedelta(seconds=1000))]
    batches = [[r for r in old + new if r[1] % 120 < 90], [r for r in new if r[1] >= 90], end]
    got = follow(rocks, batches, last_kept(stored))
    assert [r for r in got if r[0] != 9] == sorted(map(tuple, want.collect()))
    assert [r for r in got if r[0] == 9] == [(9, 0, 5)]


def test_silent_videos_end(rocks):
    still = [(1, i, 7, START + timedelta(seconds=i)) for i in range(5)]
    other = [(2, 0, 9, START + timedelta(seconds=500)), (None, 1, 1, START)]
    again = [(1, 0, 7, START + timedelta(seconds=600)), (1, 1, 7, START + timedelta(seconds=601))]
    end = [(3, 0, 1, START + timedelta(seconds=630))]
    assert follow(rocks, [still]) == [(1, 0, 7)]
    assert follow(rocks, [still, other]) == [(1, 0, 7), (1, 4, 7), (2, 0, 9)]
    assert follow(rocks, [still, other, again, end]) == [(1, 0, 7), (1, 0, 7), (1, 4, 7), (2, 0, 9), (3, 0, 1)]


def test_still_scene_is_one_hash():
    own = FrameWindow(8)
    assert [own.keep(5) for _ in range(3)] == [True, False, False]
    assert own.window == [5]
