"""Numbered renames against a plain walk, and the jobs that they take."""

import random

import pytest

from twinsift.plans import moves


def plain_walk(items, taken, template, digits):
    """Targets by a loop over the rows: a target that exists takes no number."""
    n, out = 1, {}
    for i, path, stem in items:
        folder, name = path.rsplit("/", 1)
        ext = name.rsplit(".", 1)[1]
        new = f"{folder}/{template.replace('#1', stem)}.{ext}".replace("%n", str(n).zfill(digits))
        out[i] = (new, "unchanged" if new == path else "exists" if new in taken else "ok")
        n += new == path or new not in taken
    return out


@pytest.mark.parametrize(("template", "block"), [("#1_%n", 15), ("x%n-#1", 1000), ("#1%n#1-%n", 15)])
def test_numbers_against_a_plain_walk(spark, monkeypatch, template, block):
    rng = random.Random(f"{template}{block}")
    walked = moves._numbered
    monkeypatch.setattr(moves, "_numbered", lambda *a: walked(*a, block=block))
    for _ in range(1):
        stems = ["a", "b", "12", "03"]
        used = [f"d/{template.replace('#1', rng.choice(stems)).replace('%n', str(rng.randint(1, 25)).zfill(2))}.x" for _ in range(30)]
        paths = sorted({*used, *(f"d/{rng.choice(stems)}q{k}.x" for k in range(12))}, key=lambda _: rng.random())
        rows = [(k, p, p[2:].split(".")[0].split("q")[0].split("_")[0]) for k, p in enumerate(paths) if rng.random() < 0.8][:40]
        media = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "id long, path string")
        items = spark.createDataFrame([(k, p, k) for k, p, _ in rows], "id long, path string, pos long")
        got = {r.id: (r.new_path, r.status) for r in moves.rename_plan(items, media, template, r"([^q_]*).*").collect()}
        want = plain_walk(rows, set(paths), template, len(str(len(rows))))
        assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
        assert all(got[k][1] in (v[1], "collision") for k, v in want.items())


def test_jobs_do_not_grow_with_taken_targets(spark):
    """10,000 taken targets, each a stretch of its own, take the jobs of 10."""
    jobs = []
    tracker = spark.sparkContext.statusTracker()
    for n in (10, 10_000):
        group = f"renames-{n}"
        spark.sparkContext.setJobGroup(group, group)
        digits = len(str(2 * n))
        items = spark.range(2 * n).selectExpr("id", "concat('d/s', id, '.x') AS path", "id AS pos")
        # item 2k stands in the way of number k + 1
        other = spark.range(n).selectExpr(f"concat('d/s', 2 * id, '_', lpad(id + 1, {digits}, '0'), '.x') AS path")
        got = moves.rename_plan(items, items.select("path").unionByName(other), "#1_%n", "(.*)")
        assert {(r.status, r["count"]) for r in got.groupBy("status").count().collect()} == {("exists", n), ("ok", n)}
        jobs.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 10


def test_nothing_to_rename(spark):
    items = spark.createDataFrame([], "id long, path string, pos long")
    assert moves.rename_plan(items, items.select("path"), "%n").count() == 0
    odd = spark.createDataFrame([(1, None, 1), (2, "d/a", 2), (3, "z.zip:a.x", 3)], "id long, path string, pos long")
    assert {r.status for r in moves.rename_plan(odd, odd.select("path"), "%n").collect() if r.id > 1} == {"skipped"}
