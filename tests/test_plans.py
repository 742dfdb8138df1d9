"""Plans that must hold at any size: hash joins for similarity, pushed filters and pruned columns for scans."""

import pytest

from twinsift import catalog_queries as q
from twinsift import tables
from twinsift.operators import blocking

FOLDER = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(blocking, "FEW", 0)
    monkeypatch.setattr(blocking, "SENT", 0)
    monkeypatch.setattr(blocking, "COPY_COST", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["sim_dct", "sim_dct_members", "topk", "sim_to", "sim_in", "sim_fdct", "sim_orb", "sim_frame", "sim_video", "radix_join", "sim_reflect", "sim_grabs", "align_pairs", "grp_negative"])
def test_similarity_is_a_hash_join(spark, no_broadcast, name):
    text = plan(q.QUERIES[name](spark, FOLDER))
    assert "SortMergeJoin" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_scans_read_what_they_need(spark):
    text = plan(tables.media(spark, FOLDER).where("width > 100").select("id", "width"))
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text and "PushedFilters: [" in text and "n_chars" in text.split("PushedFilters")[1]
    text = plan(q.QUERIES["count_by_type"](spark, FOLDER))
    assert "ReadSchema: struct<doc_id:bigint>" in text


@pytest.mark.parametrize("name", ["sim_dct", "sim_dct_members", "similar_groups", "topk"])
def test_no_table_of_items_is_sent(spark, monkeypatch, name):
    """At the default threshold of joins, tables that hold a row for every item or class must not pass through the driver."""
    monkeypatch.setattr(blocking, "FEW", 0)
    monkeypatch.setattr(blocking, "SENT", 0)
    monkeypatch.setattr(blocking, "tiles_pay", lambda *_: False)
    df = q.QUERIES[name](spark, FOLDER)
    df.collect()
    text = plan(df)
    assert "isFinalPlan=true" in text and "SortMergeJoin" in text and "BroadcastExchange" not in text


@pytest.mark.parametrize("name", ["catalog_scan", "flt_cmp", "fn_mid", "scan_diff", "dups_md5", "grp_dedupe", "match_flags", "weed_flag", "sort_groups"])
def test_catalog_work_stays_in_the_jvm(spark, name):
    text = plan(q.QUERIES[name](spark, FOLDER))
    assert "Python" not in text and "Arrow" not in text and "Pandas" not in text
