import pytest

from tests.oracle import connect, same
from twinsift import catalog_queries as q
from twinsift import tables
from twinsift.sources import features

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_same_rows_as_sql(spark, duck, name):
    same(q.QUERIES[name](spark, FOLDER), q.SQL[name], duck)


NO_SQL = {"sort_similar", "image_hashes", "mirrored_hashes", "patch_hashes", "palettes", "frame_compress", "frame_resume", "stream_frames", "stream_resume"}


def test_every_query_without_sql_is_known():
    assert set(q.QUERIES) - set(q.SQL) == NO_SQL


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_without_sql_is_repeatable(spark, name):
    a, b = (sorted(map(str, q.QUERIES[name](spark, FOLDER).collect())) for _ in range(2))
    assert a == b and a


def test_chains_hold_every_item_once(spark):
    got = q.QUERIES["sort_similar"](spark, FOLDER).collect()
    assert sorted(r["id"] for r in got) == list(range(1, 201))
    assert len({(r["component"], r["part"], r["nth"], r["copy"]) for r in got}) == len(got)


def test_stream_equals_batch(spark):
    a = q.QUERIES["frame_compress"](spark, FOLDER).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, q.QUERIES["stream_frames"](spark, FOLDER).collect()))


def test_resumed_stream_equals_resumed_batch(spark):
    batch = q.QUERIES["frame_resume"](spark, FOLDER).collect()
    first = features.compress_frames(tables.frames(spark, FOLDER).where("frame < 60"), 30).collect()
    stream = q.QUERIES["stream_resume"](spark, FOLDER).collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, first + stream)) and stream
