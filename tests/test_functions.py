import pytest
from pyspark.sql import functions as F

from twinsift.functions import expr, props, scalar


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "path, archive, name, suffix, base, folder",
    [
        ("a/b/c.tar.gz", "", "c.tar.gz", "gz", "c.tar", "a/b"),
        ("a/x.zip:in/p.png", "a/x.zip", "p.png", "png", "p", "a/x.zip"),
        ("a/x.zip:y.ZIP:p.png", "a/x.zip:y.ZIP", "p.png", "png", "p", "a/x.zip:y.ZIP"),
        ("a/x.Zip:p", "", "x.Zip:p", "Zip:p", "x", "a"),
        ("plain", "", "plain", "", "plain", ""),
        ("/top.jpg", "", "top.jpg", "jpg", "top", ""),
    ],
)
def test_paths(spark, path, archive, name, suffix, base, folder):
    df = spark.createDataFrame([(path,)], "path string")
    got = df.select(*(props.expression(e) for e in ("archive", "name", "suffix", "completeBaseName", "dirPath"))).first()
    assert tuple(got) == (archive, name, suffix, base, folder)


@pytest.mark.parametrize(
    "text, value, want",
    [
        (">5&&<10", 7, True),
        (">5&&<10", 12, False),
        ("<0&&>3||==7", 7, False),  # false && ends at once
        ("==7||>100&&<0", 7, True),  # true || ends at once
        (">9||<8&&!=3", 7, True),
        ("7", 7, True),
        ("~7", 17, True),
        ("!7", 17, False),
        (":^1[0-9]$", 17, True),
        ("%null", None, True),
        ("!%null", None, False),
        ("%empty", None, True),
        (">5", None, False),
    ],
)
def test_filter_expressions(spark, text, value, want):
    df = spark.createDataFrame([(value,)], "width int")
    assert (df.where(expr.predicate(df, "width", text)).count() == 1) is want


def test_filter_errors(spark):
    df = spark.createDataFrame([(1, "x")], "width int, path string")
    with pytest.raises(ValueError):
        expr.predicate(df, "width", ">abc")
    with pytest.raises(ValueError):
        expr.predicate(df, "nothing", "1")
    with pytest.raises(ValueError):
        expr.predicate(df, "width", "%needle")
    with pytest.raises(ValueError):
        expr.predicate(df, "path", "%<4", "width")
    with pytest.raises(ValueError):
        props.expression("name#nothing")


@pytest.mark.parametrize(
    "chain, value, want",
    [
        (["title"], "hELLO wORLD", "Hello world"),
        (["mid,1,2"], "abcdef", "bc"),
        (["mid,4,-1"], "abcdef", "ef"),
        (["trim"], "\t a b \n", "a b"),
        (["pad,4"], "42", "0042"),
        (["pad,1"], "42", "42"),
        (["camelsplit", "join,_"], "fooBarBaz", "foo_Bar_Baz"),
        (["split,[;:]", "peek,-1"], "a;b:c", "c"),
        (["split,[", "join,+"], "a[b[c", "a+b+c"),
        (["split,(", "peek,0"], "x(y)", "x"),
        (["split, ", "pop", "shift", "push,z", "join,+"], "a b c d", "b+c+z"),
        (["split, ", "foreach,upper|mid:0:1", "join,"], "ab cd", "AC"),
        (["toint"], "x", 0),
        (["tobool"], "yes?", False),
        (["exifdate", "date,yyyy-MM-dd"], "2020:03:04 05:06:07", "2020-03-04"),
        (["exifdate", "date,yyyy"], "none", ""),
    ],
)
def test_scalar_functions(spark, chain, value, want):
    assert one(spark, scalar.apply_chain(F.col("s"), chain), s=value) == want


def test_hash_literal():
    assert scalar.hash_literal("dct:ff") == 255
    assert scalar.hash_literal("dct:ffffffffffffffff") == -1
    for bad in ("ff", "dct:", "dct:xyz", "dct:1ffffffffffffffff"):
        with pytest.raises(ValueError):
            scalar.hash_literal(bad)


def test_luv_round_trip(spark):
    for axis, value in (("l", 50.0), ("u", -100.0), ("v", 100.0)):
        back = one(spark, scalar.luv_unpack(scalar.luv_pack(F.lit(value), axis), axis))
        assert abs(back - value) < 0.01
    assert one(spark, scalar.luv_pack(F.lit(1000.0), "l")) == 65535


def test_archive_paths(spark):
    yes = ["file.zip", "/path/file.zip", "./file.zip", ".zip", "file.ZIP", "file.cbz", "file.CBZ", "/path/.zip/.zip"]
    no = ["file.zipp", "file.zi", "file.", "file", ".file", "..", "", "file.ZiP", "/path/zips/file.txt", "/path/zips/.zip.txt", "/path/.zip/file.txt", "/path/file.zip:member.zip", "/path/file.zip:zips/member.txt"]
    df = spark.createDataFrame([(p,) for p in yes + no], "path string")
    got = {r["path"]: (r["a"], r["m"]) for r in df.select("path", props.is_archive().alias("a"), props.is_archived().alias("m")).collect()}
    assert [p for p in yes + no if got[p][0]] == yes
    assert [p for p in yes + no if got[p][1]] == no[-2:]


def test_hours_and_metadata_names(spark):
    from twinsift.functions import props, scalar

    assert scalar.date_pattern("hh:mm") == "HH:mm" and scalar.date_pattern("hh:mm ap") == "hh:mm a"
    row = spark.sql("SELECT map('Exif.Photo.Lens', 'x') AS meta")
    assert row.select(props.expression("exif#photo.Lens")).first()[0] == row.select(props.expression("exif#Photo.Lens")).first()[0] == "x"


def test_batch_of_weeds_is_taken_in_order(spark):
    from twinsift.operators.state import add_weeds

    media = spark.createDataFrame([(x, 1) for x in "abcdefg"], "md5 string, type int")
    weeds = spark.createDataFrame([("g", "a")], "weed_md5 string, orig_md5 string")
    cand = [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a"), ("d", "e"), ("e", "f"), ("f", "d"), ("e", "g"), ("g", "a")]
    got = {tuple(r)[:2]: r["reason"] for r in add_weeds(spark.createDataFrame(cand, "weed_md5 string, orig_md5 string"), weeds, media).collect()}
    taken, want = {"g": "a"}, {}
    for w, o in sorted(cand):
        want[w, o] = "changed" if taken.get(w, o) != o else "original is a weed" if o in taken and w not in taken else None
        if want[w, o] is None:
            taken[w] = o
    assert got == want and None in want.values() and "changed" in want.values()


def test_numbers_are_not_used_up(spark):
    from twinsift.plans.moves import rename_plan

    def plan(taken, names="abcd", template="n%n"):
        rows = [(i, f"d/{n}.x", i) for i, n in enumerate(names)]
        media = rows + [(90 + i, t, 0) for i, t in enumerate(taken)]
        df = lambda r: spark.createDataFrame(r, "id long, path string, pos long")
        return [(r["new_path"], r["status"]) for r in sorted(rename_plan(df(rows), df(media), template, "(.*)").collect(), key=lambda r: r["id"])]

    assert plan([]) == [(f"d/n{i}.x", "ok") for i in (1, 2, 3, 4)]
    assert plan(["d/n2.x"]) == [("d/n1.x", "ok")] + [("d/n2.x", "exists")] * 3
    assert plan(["d/b1.x", "d/b2.x", "d/d2.x"], template="#1%n") == [("d/a1.x", "ok"), ("d/b2.x", "exists"), ("d/c2.x", "ok"), ("d/d3.x", "ok")]


def test_frame_tables(spark):
    from twinsift.operators.catalog import frames_invalid

    rows = [(1, 0, 0, 5), (1, 3, 1, 5), (2, 0, 0, 5), (2, 4, 1, 5), (2, 2, 2, 5), (3, 0, 0, 5), (3, 2, 2, 5), (4, 0, 0, None), (6, 0, 1, 5)]
    frames = spark.createDataFrame(rows, "media_id long, frame int, nth int, hash long")
    media = spark.createDataFrame([(i, 2) for i in range(1, 7)], "id long, type int")
    assert sorted(map(tuple, frames_invalid(media, frames).collect())) == [(2, "order"), (3, "order"), (4, "order"), (5, "empty"), (6, "order")]
