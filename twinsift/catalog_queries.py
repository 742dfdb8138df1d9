"""Queries over the catalog operators, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift import tables as T
from twinsift.functions import expr as X
from twinsift.functions import props as P
from twinsift.functions import scalar as S
from twinsift.operators import catalog as C
from twinsift.operators import evaluate as V
from twinsift.operators import exact, select, similar, sorting, state
from twinsift.operators import groups as G
from twinsift.operators.blocking import hamming_pairs, radix_stats, sampled_masks
from twinsift.operators.finding import similar_groups as find_groups
from twinsift.params import SearchParams
from twinsift.plans import deletions, moves
from twinsift.sources import features
from twinsift.stash import Stash
from twinsift.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, using: str = "", name: str | None = None):
    """Registers a query, and its SQL after the table expressions that it uses (``, more AS (...)`` goes on with them)."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ctes = [T.SQL[u] for u in using.split()]
            SQL[key] = ("WITH RECURSIVE " + ", ".join(ctes) if ctes else "") + ("" if sql.startswith(",") else " ") + sql
        return f

    return add


# Sources and catalog --------------------------------------------------------------------------------------


@query("SELECT id, type, path, width, height, md5 FROM media WHERE path <> ''", "media")
def catalog_scan(spark, d):
    return select.catalog_scan(T.media(spark, d)).select("id", "type", "path", "width", "height", "md5")


@query("SELECT type, count(*) AS n, CAST(sum(width) AS BIGINT) AS total FROM media WHERE height > 3 GROUP BY type", "media")
def select_sql(spark, d):
    sql = "SELECT type, count(*) AS n, sum(width) AS total FROM catalog_media WHERE height > 3 GROUP BY type"
    return select.with_sql(spark, T.media(spark, d), sql, "catalog_media")


@query("SELECT event_id + 1 AS id, coalesce(json_extract_string(props, '$.Page'), json_extract_string(props, '$.page'), json_extract_string(props, '$.ref'), json_extract_string(props, '$.k')) AS tag FROM events")
def meta_first_tag(spark, d):
    return T.events_meta(spark, d).select("id", P.first_tag(F.col("meta"), "page", "ref", "k").alias("tag"))


@query(r"SELECT id, (regexp_matches(path, 'src1.*/en/') OR regexp_matches(path, '/f.')) AND NOT regexp_matches(path, 'doc[0-9]*7\.txt') AS passes FROM media", "media")
def scan_patterns(spark, d):
    ok = C.path_passes(F.col("path"), ["src1*/en/", "/f?"], [r":doc[0-9]*7\.txt"])
    return T.media(spark, d).select("id", ok.alias("passes"))


@query(r"""SELECT id, CASE WHEN s = '' THEN 'notype' WHEN s NOT IN ('png', 'zip') THEN 'unsupported' WHEN length < 2000 THEN 'small'
  WHEN contains(path, '/de/') THEN 'filtered' WHEN s = 'png' THEN 'image' ELSE 'archive' END AS status
FROM (SELECT *, lower(regexp_extract(regexp_extract(CASE WHEN contains(path, '.zip:') THEN regexp_extract(path, '\.zip:(.*)$', 1) ELSE path END, '[^/]*$'), '\.([^.]*)$', 1)) AS s FROM web_media)""", "web_media")
def scan_classify(spark, d):
    m = T.web_media(spark, d)
    return m.select("id", C.classify(F.col("path"), F.col("length"), ~F.col("path").contains("/de/"), 2000).alias("status"))


def _seen(spark: SparkSession, d: str) -> DataFrame:
    m = T.media(spark, d).where("id % 11 <> 0")
    shifted = F.when(F.col("id") % 7 == 0, F.expr("modified + interval 10 years")).otherwise(F.col("modified"))
    new = m.where("id % 13 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "modified")
    return m.select("path", shifted.alias("modified")).unionByName(new)


_SEEN = """seen AS (
  SELECT path, CASE WHEN id % 7 = 0 THEN modified + INTERVAL 10 YEAR ELSE modified END AS modified FROM media WHERE id % 11 <> 0
  UNION ALL SELECT path || '.new', modified FROM media WHERE id % 11 <> 0 AND id % 13 = 0)"""


@query(f""", {_SEEN} SELECT path, CASE WHEN e.p IS NULL THEN 'new' WHEN s.path IS NULL THEN 'removed' WHEN s.modified < TIMESTAMP '2030-01-01' THEN 'unchanged' ELSE 'modified' END AS status
FROM (SELECT path, path AS p FROM media) e FULL JOIN seen s USING (path) WHERE NOT contains(path, '/es/')""", "media")
def scan_diff(spark, d):
    since = F.lit("2030-01-01").cast("timestamp")
    return C.diff(T.media(spark, d), _seen(spark, d), since, ~F.col("path").contains("/es/"))


@query(r"SELECT path, archive, length(archive) % 2 = 0 AS unchanged FROM (SELECT path, regexp_extract(path, '^(.*\.zip):', 1) AS archive FROM web_media WHERE contains(path, '.zip:'))", "web_media")
def scan_archive_skip(spark, d):
    m = T.web_media(spark, d)
    times = m.where(P.is_archived()).select(P.archive().alias("path")).distinct()
    times = times.withColumn("modified", F.when(F.length("path") % 2 == 0, F.lit("2020-01-01")).otherwise(F.lit("2025-01-01")).cast("timestamp"))
    return C.archive_skip(m, times, F.lit("2024-01-01").cast("timestamp"))


@query("""SELECT id, (a & 19) = (19 & s) AS keep, CAST(a | (19 & s) AS INTEGER) AS new_algos FROM (
  SELECT id, CAST(id % 32 AS INTEGER) AS a, CASE type WHEN 1 THEN 15 WHEN 2 THEN 16 ELSE 0 END AS s FROM media)""", "media")
def algo_sync(spark, d):
    items = T.media(spark, d).select("id", "type", (F.col("id") % 32).cast("int").alias("algos"))
    return C.algo_sync(items, C.DCT | C.FDCT | C.VIDEO)


def _catalog_of_vectors(spark, d) -> DataFrame:
    return T.media_vec(spark, d).select("id", (1 + F.col("id") % 2).cast("int").alias("type"), "path", "phash")


@query("""SELECT m.id, CAST(CASE WHEN phash <> 0 THEN 1 ELSE 0 END | CASE WHEN f.media_id IS NOT NULL THEN 2 ELSE 0 END | CASE WHEN c.media_id IS NOT NULL AND m.id % 2 = 0 THEN 8 ELSE 0 END AS INTEGER) AS algos
FROM media_vec m LEFT JOIN (SELECT DISTINCT media_id FROM features) f ON f.media_id = m.id LEFT JOIN (SELECT DISTINCT media_id FROM colours WHERE num_colors > 3) c ON c.media_id = m.id""", "features colours")
def indexed_items(spark, d):
    colours = T.colours(spark, d).where("num_colors > 3")
    return C.indexed_items(_catalog_of_vectors(spark, d), {C.FDCT: T.features(spark, d), C.COLOUR: colours}).select("id", F.col("algos").cast("int").alias("algos"))


@query("SELECT DISTINCT media_id FROM features WHERE media_id NOT IN (SELECT id FROM media_vec WHERE id % 3 <> 0)", "features")
def orphans(spark, d):
    return C.orphans(T.media_vec(spark, d).where("id % 3 <> 0"), T.features(spark, d))


@query("""SELECT id, (a & n) = n AS indexed FROM (SELECT id, CAST(id % 32 AS INTEGER) AS a, 17 & CASE type WHEN 1 THEN 15 WHEN 2 THEN 16 ELSE 0 END AS n FROM media) WHERE n <> 0""", "media")
def missing_algo(spark, d):
    items = T.media(spark, d).select("id", "type", (F.col("id") % 32).cast("int").alias("algos"))
    return C.missing_algos(items, C.DCT | C.VIDEO)


@query(""", seen_new AS (SELECT DISTINCT path || '.new' AS path FROM media WHERE id % 13 = 0)
SELECT path, (SELECT max(id) FROM media) + row_number() OVER (ORDER BY path) AS id FROM seen_new""", "media")
def append_ids(spark, d):
    m = T.media(spark, d)
    new = m.where("id % 13 = 0").select(F.concat("path", F.lit(".new")).alias("path"), "type")
    batch = new.unionByName(new).unionByName(m.where("id % 17 = 0").select("path", "type"))
    return C.append_ids(m, batch).select("path", "id")


@query("""SELECT 'media' AS tab, count(*) AS n FROM media_vec WHERE id % 4 <> 0 UNION ALL SELECT 'features', count(*) FROM features WHERE media_id % 4 <> 0""", "features")
def remove_ids(spark, d):
    m = T.media_vec(spark, d)
    ids = m.select("id").where("id % 4 = 0").unionByName(T.features(spark, d).select(F.col("media_id").alias("id")).where("id % 4 = 0"))
    out = C.remove_ids({"media": m, "features": T.features(spark, d)}, ids, {"media": "id"})
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tab"), "n") for n, t in out.items()]
    return counts[0].unionByName(counts[1])


@query("""SELECT id, path, 'moved/x' || substr(path, 5) AS new_path, false AS conflict FROM media WHERE starts_with(path, 'src1/')""", "media")
def move_prefix(spark, d):
    return moves.move_prefix(T.media(spark, d), "src1", "moved/x")


@query(r""", r AS (SELECT id, path, regexp_extract(b, '^doc(\d)(\d*)$', 1) AS a, regexp_extract(b, '^doc(\d)(\d*)$', 2) AS c, regexp_extract(path, '^(.*)/', 1) AS f, row_number() OVER (ORDER BY id) AS nth
  FROM (SELECT *, regexp_extract(path, '([^/]*)\.txt$', 1) AS b FROM media))
SELECT id, path, f || '/' || c || '-' || a || '_' || lpad(CAST(nth AS VARCHAR), CAST(length(CAST((SELECT count(*) FROM media) AS VARCHAR)) AS INTEGER), '0') || '.txt' AS new_path, 'ok' AS status FROM r""", "media")
def rename_plan(spark, d):
    items = T.media(spark, d).withColumn("pos", F.col("id"))
    return moves.rename_plan(items, T.media(spark, d), "#2-#1_%n", r"doc(\d)(\d*)")


@query(r""", r AS (SELECT id, path, regexp_extract(path, '^(.*)/', 1) || '/' || regexp_replace(b, 'doc[0-9]', 'doc') || '.txt' AS q FROM (SELECT *, regexp_extract(path, '([^/]*)\.txt$', 1) AS b FROM media))
SELECT r.id, r.path, q AS new_path, CASE WHEN m.path IS NOT NULL THEN 'exists' WHEN row_number() OVER (PARTITION BY q ORDER BY r.id) > 1 THEN 'collision' ELSE 'ok' END AS status FROM r LEFT JOIN media m ON m.path = q""", "media")
def rename_collisions(spark, d):
    items = T.media(spark, d).withColumn("pos", F.col("id"))
    return moves.rename_plan(items, T.media(spark, d), "doc#1", r"doc\d(\d*)")


@query(r""", f AS (SELECT DISTINCT CASE WHEN contains(path, '.zip:') THEN regexp_extract(path, '^(.*\.zip):', 1) ELSE path END AS path FROM web_media
), t AS (SELECT path, 'new/' || regexp_extract(path, '[^/]*$') AS new_path FROM f)
SELECT path, new_path, count(*) OVER (PARTITION BY new_path) > 1 AS conflict FROM t""", "web_media")
def move_plan(spark, d):
    m = T.web_media(spark, d)
    return moves.move_to(m, m, "new")


@query("""SELECT id, CASE WHEN n = 0 THEN 'empty' ELSE 'order' END AS reason FROM (SELECT v.id, count(f.media_id) AS n, bool_or(frame <= before OR nth <> coalesce(place + 1, 0)) AS bad FROM (SELECT DISTINCT media_id AS id FROM frames UNION SELECT 999) v
  LEFT JOIN (SELECT *, lag(frame) OVER (PARTITION BY media_id ORDER BY nth) AS before, lag(nth) OVER (PARTITION BY media_id ORDER BY nth) AS place FROM (
    SELECT media_id, CASE WHEN media_id % 7 = 2 AND nth = 4 THEN 0 ELSE frame END AS frame, nth FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY frame) - 1 AS nth FROM frames) WHERE media_id % 7 <> 3 OR nth <> 6)) f ON f.media_id = v.id GROUP BY v.id) WHERE n = 0 OR bad""", "frames")
def frames_invalid(spark, d):
    f = T.frames(spark, d)
    videos = f.select(F.col("media_id").alias("id")).distinct().unionByName(spark.createDataFrame([(999,)], "id long")).withColumn("type", F.lit(2))
    rows = f.withColumn("nth", F.row_number().over(Window.partitionBy("media_id").orderBy("frame")) - 1)
    rows = rows.withColumn("frame", F.when(F.expr("media_id % 7 = 2 and nth = 4"), 0).otherwise(F.col("frame")))
    return C.frames_invalid(videos, rows.where("media_id % 7 <> 3 or nth <> 6"))


@query("""SELECT CAST(count_if(id % 5 > 1) AS BIGINT) AS ok, CAST(count_if(id % 5 = 0) AS BIGINT) AS changed, CAST(count_if(id % 5 = 1) AS BIGINT) AS missing, CAST(sum(CASE WHEN id % 5 > 1 THEN file_size ELSE 0 END) AS BIGINT) AS ok_bytes FROM media""", "media")
def verify_md5(spark, d):
    m = T.media(spark, d)
    now = m.where("id % 5 <> 1").select("path", F.when(F.col("id") % 5 == 0, F.lit("x")).otherwise(F.col("md5")).alias("md5"), F.col("file_size").alias("length"))
    return C.verify_md5(m, now)


@query("SELECT id, path, CASE WHEN id % 10 = 0 THEN md5(md5) ELSE md5 END AS md5 FROM media", "media")
def update_md5(spark, d):
    m = T.media(spark, d)
    changes = m.where("id % 10 = 0").select("id", F.md5(F.col("md5").cast("binary")).alias("md5"))
    return C.update_md5(m, changes).select("id", "path", "md5")


@query("SELECT type, count(*) AS n FROM media GROUP BY type", "media")
def count_by_type(spark, d):
    return exact.counts_by_type(T.media(spark, d))


@query("SELECT doc_id + 1 AS id, md5(text) AS md5 FROM documents")
def content_md5(spark, d):
    files = T.table(spark, d, "documents").select((F.col("doc_id") + 1).cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return features.digests(files).select(F.col("path").cast("long").alias("id"), "md5")


@query("SELECT id, CASE WHEN file_size > 0 THEN CAST(width AS DOUBLE) * height * 3 / file_size ELSE 1.0 END AS ratio, width * height AS resolution, greatest(width, height) AS res, CAST(width AS DOUBLE) / height AS aspect FROM media", "media")
def derived_cols(spark, d):
    e = P.expression
    return T.media(spark, d).select("id", e("compressionRatio").alias("ratio"), e("resolution").alias("resolution"), e("res").alias("res"), e("aspectRatio").alias("aspect"))


@query("SELECT id, NOT (bit_count(phash) BETWEEN 28 AND 36) AS low FROM media_vec", "media_vec")
def low_detail(spark, d):
    return T.media_vec(spark, d).select("id", similar.low_detail(F.col("phash"), 28).alias("low"))


@query("""SELECT media_id, frame FROM (SELECT *, max(frame) OVER (PARTITION BY media_id) AS last FROM frames) WHERE (frame >= 40 AND frame <= last - 40) OR last // 2 <= 40""", "frames")
def vtrim(spark, d):
    return similar.trim_frames(T.frames(spark, d), 40, always=False).select("media_id", "frame")


# Properties -----------------------------------------------------------------------------------------------


@query("SELECT id, id <> 0 AS valid, md5, type, width, height FROM media", "media")
def props_basic(spark, d):
    return T.media(spark, d).select("id", P.expression("isValid").alias("valid"), "md5", "type", "width", "height")


@query(r"""SELECT id, n AS name, regexp_extract(n, '\.([^.]*)$', 1) AS suffix, regexp_replace(n, '\.[^.]*$', '') AS base, CASE WHEN contains(path, '.zip:') THEN regexp_extract(path, '^(.*\.zip):', 1) ELSE regexp_extract(path, '^(.*)/[^/]*$', 1) END AS dir,
  path AS rel FROM (SELECT *, regexp_extract(CASE WHEN contains(path, '.zip:') THEN regexp_extract(path, '\.zip:(.*)$', 1) ELSE path END, '[^/]*$') AS n FROM web_media)""", "web_media")
def props_path(spark, d):
    e = P.expression
    rel = P.rel_path(F.concat(F.lit("/root/index/"), "path"), "/root/index")
    return T.web_media(spark, d).select("id", e("name").alias("name"), e("suffix").alias("suffix"), e("completeBaseName").alias("base"), e("dirPath").alias("dir"), rel.alias("rel"))


@query(r"SELECT id, contains(path, '.zip:') AS archived, regexp_extract(path, '^(.*\.zip):', 1) AS archive, regexp_extract(path, '^.*\.zip:(.*)$', 1) AS member FROM web_media", "web_media")
def props_archive(spark, d):
    return T.web_media(spark, d).select("id", P.is_archived().alias("archived"), P.archive().alias("archive"), P.member().alias("member"))


@query(r"SELECT id, CASE WHEN contains(path, '.zip:') THEN count(*) OVER (PARTITION BY CASE WHEN contains(path, '.zip:') THEN regexp_extract(path, '^(.*\.zip):', 1) ELSE path END) ELSE -1 END AS archive_count FROM web_media", "web_media")
def archive_count(spark, d):
    return C.archive_counts(T.web_media(spark, d)).select("id", "archive_count")


@query("SELECT id, strftime(modified, '%Y-%m-%d %H:%M') AS t, year(modified) AS y FROM media", "media")
def props_time(spark, d):
    return T.media(spark, d).select("id", P.expression("modified#date,yyyy-MM-dd HH:mm").alias("t"), P.expression("modified#year").alias("y"))


# Scalar functions -----------------------------------------------------------------------------------------


def _on_part(name: str, column: Callable[[], Column], sql: str) -> None:
    def run(spark, d):
        return T.table(spark, d, "part").select("p_partkey", column().alias("v"))

    query(f"SELECT p_partkey, {sql} AS v FROM part", name=name)(run)


def _on_orders(name: str, column: Callable[[], Column], sql: str) -> None:
    def run(spark, d):
        return T.table(spark, d, "orders").select("o_orderkey", column().alias("v"))

    query(f"SELECT o_orderkey, {sql} AS v FROM orders", name=name)(run)


_f = S.apply_chain
_on_part("fn_mid", lambda: _f(F.col("p_name"), ["mid,2,4"]), "substr(p_name, 3, 4)")
_on_part("fn_mid_rest", lambda: _f(F.col("p_name"), ["mid,3,-1"]), "substr(p_name, 4)")
_on_part("fn_trim", lambda: _f(F.concat(F.lit(" \t"), "p_name", F.lit("\n ")), ["trim"]), "p_name")
_on_part("fn_case", lambda: F.concat(_f(F.col("p_name"), ["upper"]), _f(F.col("p_name"), ["lower"])), "upper(p_name) || lower(p_name)")
_on_part("fn_title", lambda: _f(F.col("p_name"), ["title"]), "upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2))")
_on_part("fn_pad", lambda: _f(F.col("p_size"), ["pad,6"]), "lpad(CAST(p_size AS VARCHAR), 6, '0')")
_on_part("fn_split", lambda: F.size(_f(F.col("p_name"), ["split,[ #]"])), "CAST(len(regexp_split_to_array(p_name, '[ #]')) AS INTEGER)")
_on_part("fn_join", lambda: _f(F.col("p_name"), ["split,[ #]", "join,+"]), "array_to_string(regexp_split_to_array(p_name, '[ #]'), '+')")
_on_part("fn_camelsplit", lambda: _f(F.concat(_f(F.col("p_type"), ["title"]), _f(F.col("p_name"), ["mid,0,3", "title"])), ["camelsplit", "join,_"]), "upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || '_' || upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2, 2))")
_on_part("fn_list", lambda: _f(F.col("p_name"), ["split,[ #]", "push,z", "shift", "push,y", "pop", "join,-"]), "array_to_string(list_append(regexp_split_to_array(p_name, '[ #]')[2:], 'z'), '-')")
_on_part("fn_peek", lambda: F.concat(_f(F.col("p_name"), ["split,[ #]", "peek,0"]), F.lit("|"), _f(F.col("p_name"), ["split,[ #]", "peek,-1"])), "regexp_split_to_array(p_name, '[ #]')[1] || '|' || regexp_split_to_array(p_name, '[ #]')[-1]")
_on_part("fn_foreach", lambda: _f(F.col("p_name"), ["split,[ #]", "foreach,upper|mid:0:2", "join,"]), "array_to_string(list_transform(regexp_split_to_array(p_name, '[ #]'), lambda x: substr(upper(x), 1, 2)), '')")
_on_part("fn_add", lambda: _f(F.col("p_size"), ["add,5"]), "CAST(p_size AS BIGINT) + 5")
_on_orders("fn_date", lambda: _f(F.col("o_orderdate"), ["date,yyyy/MM/dd"]), "strftime(o_orderdate, '%Y/%m/%d')")
_on_orders("fn_date_parts", lambda: _f(F.col("o_orderdate"), ["year"]) * 10000 + _f(F.col("o_orderdate"), ["month"]) * 100 + _f(F.col("o_orderdate"), ["day"]), "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS INTEGER)")
_on_orders("fn_cast", lambda: _f(F.substr("o_orderpriority", F.lit(1), F.lit(1)), ["toint"]) + _f(F.col("o_orderpriority"), ["toint"]), "CAST(o_orderpriority[1:1] AS INTEGER)")
_on_orders("fn_exifdate", lambda: _f(F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss"), ["exifdate", "date,yyyyMMddHHmmss"]), "strftime(o_orderdate, '%Y%m%d%H%M%S')")


@query("SELECT a.id AS id, bit_count(xor(a.phash, b.phash)) AS dist FROM media_vec a JOIN media_vec b ON b.id = a.id + 1", "media_vec")
def hamming(spark, d):
    m = T.media_vec(spark, d)
    b = m.select((F.col("id") - 1).alias("id"), F.col("phash").alias("other"))
    return m.join(b, "id").select("id", S.hamming(F.col("phash"), F.col("other")).cast("int").alias("dist"))


@query("SELECT id, bit_count(xor(phash, -81985529216486896)) AS dist FROM media_vec", "media_vec")
def hash_literal(spark, d):
    return T.media_vec(spark, d).select("id", S.hamming(F.col("phash"), F.lit(S.hash_literal("dct:fedcba9876543210"))).cast("int").alias("dist"))


_AXES = {"l": (0, 100), "u": (-134, 354), "v": (-140, 262)}


def _codec_sql() -> str:
    pack = lambda a, lo, span: f"CAST(least(greatest(floor((c.{a} - ({lo})) / {span} * 65535), 0), 65535) AS INTEGER) AS {a}"
    back = lambda a, lo, span: f"{a}, round({a} / CAST(65535 AS DOUBLE) * {span} + ({lo}), 6) AS back_{a}"
    return f"""SELECT media_id, i, {', '.join(back(a, *x) for a, x in _AXES.items())} FROM (SELECT media_id, i, {', '.join(pack(a, *x) for a, x in _AXES.items())}
  FROM (SELECT media_id, unnest(range(1, num_colors + 1)) AS i, unnest(colors) AS c FROM colours))"""


@query(_codec_sql(), "colours")
def luv_codec(spark, d):
    c = T.colours(spark, d).select("media_id", F.posexplode("colors").alias("i", "c"))
    packed = c.select("media_id", (F.col("i") + 1).cast("long").alias("i"), *(S.luv_pack(F.col(f"c.{a}"), a).alias(a) for a in _AXES))
    return packed.select("*", *(F.round(S.luv_unpack(F.col(a), a), 6).alias(f"back_{a}") for a in _AXES))


# Filters --------------------------------------------------------------------------------------------------


def _filter(name: str, prop: str, text: str, sql: str) -> None:
    def run(spark, d):
        m = T.media(spark, d)
        return m.where(X.predicate(m, prop, text)).select("id", "path", "width")

    query(f"SELECT id, path, width FROM media WHERE {sql}", "media", name)(run)


_filter("flt_cmp", "width", ">=1000", "width >= 1000")
_filter("flt_eq_default", "height", "3", "height = 3")
_filter("flt_contains", "path", "~/en/", "contains(path, '/en/')")
_filter("flt_not_contains", "path", "!/en/", "NOT contains(path, '/en/')")
_filter("flt_regex", "name", r":doc\d*5\.", r"regexp_matches(path, 'doc[0-9]*5\.')")
_filter("flt_func", "name#mid,3,1#toint", ">4", "CAST(regexp_extract(path, 'doc(.)', 1) AS INTEGER) > 4")
_filter("flt_bool", "width", ">500&&<2000||==3", "width > 500 AND (width < 2000 OR width = 3)")


@query("SELECT event_id + 1 AS id, k IS NULL AS missing FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '' ELSE json_extract_string(props, '$.k') END AS k FROM events) WHERE k IS NULL OR k = ''")
def flt_null(spark, d):
    value = F.when(F.col("id") % 3 == 1, F.lit(None)).when(F.col("id") % 3 == 2, "").otherwise(F.col("meta")["k"])
    e = T.events_meta(spark, d).withColumn("k", value)
    return e.where(X.predicate(e, F.col("k"), "%empty")).select("id", X.predicate(e, F.col("k"), "%null").alias("missing"))


@query("SELECT g.group_id, g.pos, g.width FROM groups g JOIN (SELECT group_id, arg_min(width, pos) AS w FROM groups GROUP BY group_id) n USING (group_id) WHERE g.width <= n.w", "groups")
def flt_needle(spark, d):
    g = T.groups(spark, d)
    return g.withColumn("keep", X.predicate(g, "width", "<=%needle", "group_id")).where("keep").select("group_id", "pos", "width")


@query("SELECT g.group_id, g.pos, g.width FROM groups g JOIN (SELECT group_id, arg_min(width, pos) AS w FROM groups GROUP BY group_id) n USING (group_id) WHERE abs(g.width - n.w) < 50", "groups")
def flt_needle_diff(spark, d):
    g = T.groups(spark, d)
    return g.withColumn("keep", X.predicate(g, "width", "%<50", "group_id")).where("keep").select("group_id", "pos", "width")


@query("SELECT id FROM media WHERE (width > 3000 OR contains(path, '/de/')) AND NOT (height = 2 OR height = 5)", "media")
def flt_with(spark, d):
    m = X.with_any(T.media(spark, d), [("width", ">3000"), ("path", "~/de/")])
    return X.with_any(m, [("height", "2"), ("height", "5")], invert=True).select("id")


@query("SELECT group_id, pos, media_id FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM groups WHERE pos = 0 OR score < 6) WHERE n > 1", "groups")
def flt_groups(spark, d):
    return X.with_any(T.groups(spark, d), [("score", "<6")], group="group_id").select("group_id", "pos", "media_id")


def _flags_sql() -> str:
    return """fl AS (SELECT g.*, CASE WHEN g.pos = 0 THEN 0 ELSE CASE WHEN g.md5 = n.md5 THEN 1 ELSE 0 END + CASE WHEN g.width * g.height > n.width * n.height THEN 2 ELSE 0 END + CASE WHEN g.file_size > n.file_size THEN 4 ELSE 0 END
  + CASE WHEN CAST(g.width AS DOUBLE) * g.height * 3 / g.file_size < CAST(n.width AS DOUBLE) * n.height * 3 / n.file_size THEN 8 ELSE 0 END END AS match_flags FROM groups g JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS r FROM groups) WHERE r = 1) n USING (group_id))"""


def _flagged(spark, d) -> DataFrame:
    return G.match_flags(T.groups(spark, d), P.compression_ratio())


@query(f", {_flags_sql()} SELECT group_id, pos FROM fl WHERE greatest(width, height) >= 20 AND regexp_matches(path, 't[0-5]') AND score >= 0 AND (match_flags & 2) <> 0", "groups")
def flt_view(spark, d):
    return G.view_filter(_flagged(spark, d), 20, "t[0-5]", "bigger").select("group_id", "pos")


# Selections -----------------------------------------------------------------------------------------------


@query("SELECT id, path FROM media WHERE type = 2 OR id = 5 OR path = 'src1/en/doc1.txt'", "media")
def sel_basic(spark, d):
    return T.media(spark, d).where("type = 2 or id = 5 or path = 'src1/en/doc1.txt'").select("id", "path")


@query(r"SELECT id, path FROM media WHERE path LIKE 'src_/%n/doc%' ESCAPE '\'", "media")
def sel_glob(spark, d):
    return select.by_glob(T.media(spark, d), "src?/*n/doc").select("id", "path")


@query("SELECT id, path FROM media WHERE regexp_matches(path, '/(fr|es)/doc[0-9]+3')", "media")
def sel_regex(spark, d):
    return select.by_regex(T.media(spark, d), "/(fr|es)/doc[0-9]+3").select("id", "path")


@query("SELECT m.id, m.path, row_number() OVER (ORDER BY m.path) - 1 AS pos FROM media m WHERE md5 IN (SELECT md5 FROM media WHERE id % 9 = 0)", "media")
def sel_md5(spark, d):
    m = T.media(spark, d)
    rows = m.join(m.where("id % 9 = 0").select("md5"), "md5", "left_semi").select("id", "path")
    return sorting.number_rows(rows, [F.col("path")])


@query("SELECT path FROM media WHERE id % 2 = 0", "media")
def exists_path(spark, d):
    m = T.media(spark, d)
    asked = m.where("id % 2 = 0").select("path").unionByName(m.select(F.concat("path", F.lit("?")).alias("path")))
    return select.existing(asked, m)


@query("SELECT DISTINCT path FROM media WHERE id % 6 = 1", "media")
def sel_errors(spark, d):
    m = T.media(spark, d)
    found = m.where("id % 2 = 1").select("path", F.when(F.col("id") % 6 == 1, "load").otherwise("unsupported").alias("error"))
    return select.errors(found.unionByName(found))


@query("""SELECT id, row_number() OVER (ORDER BY part, p) - 1 AS pos FROM (SELECT id, 0 AS part, id AS p FROM media WHERE id % 3 = 0 UNION ALL SELECT id, 1, -id FROM media WHERE id % 2 = 0)""", "media")
def sel_result(spark, d):
    m = T.media(spark, d)
    a = m.where("id % 3 = 0").select("id", F.col("id").alias("pos"))
    return select.append(a, m.where("id % 2 = 0").select("id", (-F.col("id")).alias("pos")))


@query("SELECT id, path FROM media WHERE id IN (SELECT o_orderkey FROM orders)", "media")
def sel_ids(spark, d):
    return select.by_ids(T.media(spark, d), T.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))).select("id", "path")


# Exact duplicates and aggregates --------------------------------------------------------------------------


@query("""SELECT md5, id, path, row_number() OVER (PARTITION BY md5 ORDER BY path, id) - 1 AS pos, min(path) OVER (PARTITION BY md5) AS first_path
FROM (SELECT *, count(*) OVER (PARTITION BY md5) AS n FROM media) WHERE n > 1""", "media")
def dups_md5(spark, d):
    return exact.duplicates(T.media(spark, d))


@query("""SELECT md5, id, path, row_number() OVER (PARTITION BY md5 ORDER BY path, id) - 1 AS pos, min(path) OVER (PARTITION BY md5) AS first_path
FROM (SELECT *, count(*) OVER (PARTITION BY md5) AS n FROM media WHERE id % 3 <> 0) WHERE n > 1""", "media")
def dups_in(spark, d):
    m = T.media(spark, d)
    return exact.duplicates_in(m, m.where("id % 3 <> 0").select("id"))


@query("""SELECT id, group_key, row_number() OVER (PARTITION BY group_key ORDER BY path) - 1 AS pos FROM (SELECT id, path, 'dirPath == ' || regexp_extract(path, '^(.*)/[^/]*$', 1) AS group_key FROM media)""", "media")
def group_by_prop(spark, d):
    return G.group_by(T.media(spark, d), P.expression("dirPath"), "dirPath").select("id", "group_key", "pos")


def _by_type(df: DataFrame) -> DataFrame:
    return df.withColumn("group_id", F.col("id") % 40)


@query(r""", g AS (SELECT id % 40 AS group_id, string_split(path, '/') AS p FROM web_media), k AS (SELECT group_id, min(len(p)) - 1 AS n FROM g GROUP BY group_id
), c AS (SELECT group_id, i, count(DISTINCT array_to_string(p[1:i], '/')) AS u, any_value(array_to_string(p[1:i], '/')) AS h FROM g JOIN (SELECT group_id, unnest(range(0, n + 1)) AS i FROM k) USING (group_id) GROUP BY group_id, i)
SELECT group_id, coalesce(arg_max(CASE WHEN i = 0 THEN '' ELSE h END, i), '') AS prefix FROM c WHERE i = 0 OR u = 1 GROUP BY group_id""", "web_media")
def common_prefix(spark, d):
    return G.common_prefix(_by_type(T.web_media(spark, d)))


@query("SELECT group_id, coalesce(nullif(avg(CAST(width AS DOUBLE) / height), 0), CAST(2 AS DOUBLE) / 3) AS aspect FROM groups GROUP BY group_id", "groups")
def avg_aspect(spark, d):
    return G.average_aspect(T.groups(spark, d))


@query("""SELECT count(*) AS used, 16 - count(*) AS empty, min(n) AS min_n, max(n) AS max_n, avg(n) AS mean_n, stddev_pop(n) AS sigma_n FROM (SELECT (phash >> 1) & 15 AS b, count(*) AS n FROM media_vec GROUP BY b)""", "media_vec")
def radix_stats_(spark, d):
    return radix_stats(T.media_vec(spark, d), bits=4)


QUERIES["radix_stats"], SQL["radix_stats"] = QUERIES.pop("radix_stats_"), SQL.pop("radix_stats_")

# Similarity -----------------------------------------------------------------------------------------------

_CLASSES = "cl AS (SELECT phash, min(id) AS rep, count(*) AS copies FROM mediah WHERE phash <> 0 GROUP BY phash)"
_LINKS = f"{_CLASSES}, li AS (SELECT a.rep AS rep_a, b.rep AS rep_b, bit_count(xor(a.phash, b.phash)) AS distance FROM cl a JOIN cl b ON a.rep < b.rep AND bit_count(xor(a.phash, b.phash)) < 5)"


@query(f""", {_LINKS} SELECT rep_a, rep_b, CAST(distance AS INTEGER) AS distance FROM li
UNION ALL SELECT c.rep, m.id, 0 FROM mediah m JOIN cl c USING (phash) WHERE m.id <> c.rep""", "mediah")
def sim_dct(spark, d):
    return similar.linked_items(T.media_hashed(spark, d), 5)


@query(f""", {_LINKS} SELECT m.id, c.rep, CAST(c.copies - 1 + coalesce((SELECT sum(o.copies) FROM li JOIN cl o ON o.rep = CASE WHEN li.rep_a = c.rep THEN li.rep_b ELSE li.rep_a END WHERE li.rep_a = c.rep OR li.rep_b = c.rep), 0) AS BIGINT) AS n_links
FROM mediah m JOIN cl c USING (phash)""", "mediah")
def sim_dct_members(spark, d):
    m = T.media_hashed(spark, d)
    classes = similar.hash_classes(m)
    return similar.link_counts(m, classes, similar.class_links(classes, 5))


@query("""SELECT n.id AS needle, m.id AS media_id, CAST(bit_count(xor(n.phash, m.phash)) AS INTEGER) AS score FROM media_vec n JOIN media_vec m ON n.id % 50 = 0 AND n.phash <> 0 AND m.phash <> 0 AND bit_count(xor(n.phash, m.phash)) < 20""", "media_vec")
def sim_dct_wide(spark, d):
    m = T.media_vec(spark, d)
    needles = m.where("id % 50 = 0").select(F.col("id").alias("needle"), F.col("phash").alias("hash"))
    return similar.search(needles, m, 20)


@query("""SELECT n.id AS needle, m.id AS media_id, CAST(bit_count(xor(n.phash, m.phash)) AS INTEGER) AS score FROM mediah n JOIN mediah m ON n.id % 50 = 0 AND n.phash <> 0 AND m.phash <> 0 AND bit_count(xor(n.phash, m.phash)) < 6""", "mediah")
def sim_to(spark, d):
    m = T.media_hashed(spark, d)
    return similar.search(m.where("id % 50 = 0").select(F.col("id").alias("needle"), F.col("phash").alias("hash")), m, 6)


@query(""", cl AS (SELECT phash, min(id) AS rep FROM mediah WHERE phash <> 0 AND id % 2 = 0 GROUP BY phash)
SELECT a.rep AS rep_a, b.rep AS rep_b, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance FROM cl a JOIN cl b ON a.rep < b.rep AND bit_count(xor(a.phash, b.phash)) < 5""", "mediah")
def sim_in(spark, d):
    m = T.media_hashed(spark, d)
    return similar.within(m, m.where("id % 2 = 0").select("id"), 5)


_TOPK = """SELECT needle, media_id, CAST(score AS INTEGER) AS score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score, media_id) AS pos FROM (
  SELECT a.id AS needle, b.id AS media_id, bit_count(xor(a.phash, b.phash)) AS score FROM mediah a JOIN mediah b ON a.id <> b.id AND a.phash <> 0 AND b.phash <> 0 AND bit_count(xor(a.phash, b.phash)) < 5)) WHERE pos <= 5"""


@query(_TOPK, "mediah")
def topk(spark, d):
    m = T.media_hashed(spark, d)
    classes = similar.hash_classes(m)
    return similar.best_matches(m, similar.class_links(classes, 5), classes, 5)


@query("""SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS distance FROM media_vec a JOIN media_vec b ON a.id < b.id AND (a.phash >> 1) & 15 = (b.phash >> 1) & 15 AND bit_count(xor(a.phash, b.phash)) < 22""", "media_vec")
def radix_join_(spark, d):
    m = T.media_vec(spark, d)
    return hamming_pairs(m, 22, "phash", "id", radix=4)


QUERIES["radix_join"], SQL["radix_join"] = QUERIES.pop("radix_join_"), SQL.pop("radix_join_")


@query(""", f AS (SELECT n.id AS needle, m.id AS media_id, bit_count(xor(n.phash, m.phash)) AS score FROM mediah n JOIN mediah m ON n.id % 20 = 0 AND n.phash <> 0 AND m.phash <> 0 AND bit_count(xor(n.phash, m.phash)) < 9
), r AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score, media_id) AS r FROM f), k AS (SELECT needle, greatest(3, least(9, score + 1)) AS own FROM r WHERE r = 3)
SELECT f.needle, media_id, CAST(score AS INTEGER) AS score FROM f LEFT JOIN k USING (needle) WHERE score < coalesce(own, 9)""", "mediah")
def adaptive_thresh(spark, d):
    m = T.media_hashed(spark, d)
    return similar.adaptive(m.where("id % 20 = 0").select(F.col("id").alias("needle"), F.col("phash").alias("hash")), m, 3, 9, least=2)


def _features_sql(threshold: int = 5) -> str:
    return f"""WITH p AS (SELECT n.media_id AS needle, n.feat_no AS nn, m.media_id, m.feat_no, bit_count(xor(n.hash, m.hash)) AS d FROM features n JOIN features m ON bit_count(xor(n.hash, m.hash)) < {threshold}
), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY needle, nn ORDER BY d, media_id, feat_no) AS r FROM p) WHERE r <= 10
), v AS (SELECT needle, media_id, count(*) AS votes, CAST(sum(d) AS BIGINT) AS dist_sum FROM k GROUP BY needle, media_id
), o AS (SELECT *, max(CASE WHEN needle <> media_id THEN votes END) OVER (PARTITION BY needle) AS m FROM v)
SELECT needle, media_id, votes, dist_sum, CAST(CASE WHEN needle = media_id THEN -1 WHEN m = 1 THEN 10 * dist_sum // votes ELSE m - votes END AS BIGINT) AS score FROM o"""


def _adaptive_sql(by_threshold: list[str], least: int) -> str:
    """The rows of the first search that gives a needle more than ``least``, else of the last."""
    found = " UNION ALL ".join(f"SELECT needle, media_id, score, {i} AS t FROM ({sql})" for i, sql in enumerate(by_threshold))
    last = len(by_threshold) - 1
    return f""", af AS MATERIALIZED ({found}), ac AS (SELECT needle, t, count(*) AS n FROM af GROUP BY needle, t
), ao AS (SELECT needle, coalesce(min(CASE WHEN n > {least} THEN t END), {last}) AS t FROM ac GROUP BY needle)
SELECT needle, media_id, CAST(score AS BIGINT) AS score FROM af JOIN ao USING (needle, t)"""


_VOTES = f", found AS ({_features_sql()}) SELECT * FROM found"


@query(_VOTES, "features")
def sim_fdct(spark, d):
    f = T.features(spark, d)
    return similar.feature_votes(f, f, 5)


def _orb_sql(threshold: int = 25, also: str = "true") -> str:
    return f"""WITH p AS (SELECT n.media_id AS needle, n.desc_no AS nn, m.media_id, m.desc_no, CAST(bit_count(xor(n.d0, m.d0)) AS INTEGER) + bit_count(xor(n.d1, m.d1)) + bit_count(xor(n.d2, m.d2)) + bit_count(xor(n.d3, m.d3)) AS d FROM descriptors n CROSS JOIN descriptors m WHERE {also}
), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY needle, nn ORDER BY d, media_id, desc_no) AS r FROM p WHERE d < {threshold}) WHERE r <= 10
), v AS (SELECT needle, media_id, count(*) AS votes, list_sort(list(d)) AS l FROM k GROUP BY needle, media_id)
SELECT needle, media_id, votes, CAST((CASE WHEN votes % 2 = 1 THEN l[votes // 2 + 1] ELSE (l[votes // 2] + l[votes // 2 + 1]) // 2 END) * 1000 // votes AS BIGINT) AS score FROM v"""


_ORB = f", found AS ({_orb_sql()}) SELECT * FROM found"


@query(_ORB, "descriptors")
def sim_orb(spark, d):
    x = T.descriptors(spark, d)
    return similar.descriptor_votes(x, x, 25)


@query(_adaptive_sql([_features_sql(t) for t in range(2, 6)], 2), "features")
def adaptive_fdct(spark, d):
    f = T.features(spark, d)
    return similar.widened(f.withColumnRenamed("media_id", "needle"), "fdct", f, 2, 5, 2).select("needle", "media_id", "score")


@query(_adaptive_sql([_orb_sql(t) for t in (5, 10, 15)], 3), "descriptors")
def adaptive_orb(spark, d):
    x = T.descriptors(spark, d)
    return similar.widened(x.withColumnRenamed("media_id", "needle"), "orb", x, 5, 15, 3).select("needle", "media_id", "score")


_SAMPLED = sampled_masks(12, 24, 256)
_AGREE = " OR ".join("(" + " AND ".join(f"xor(n.d{w}, m.d{w}) & ({m}) = 0" for w, m in enumerate(masks) if m) + ")" for masks in _SAMPLED)


@query(f", found AS ({_orb_sql(25, _AGREE)}) SELECT * FROM found", "descriptors")
def sim_orb_sampled(spark, d):
    x = T.descriptors(spark, d)
    return similar.descriptor_votes(x, x, 25, sample=(12, 24))


_GAP = "sqrt(pow(a.l - b.l, 2) + pow(a.u - b.u, 2) + pow(a.v - b.v, 2))"


def _palettes_sql(needles: str) -> str:
    return f"""SELECT needle, media_id, CAST(floor(1 + list_sum(list_transform(g, lambda a: list_min(list_transform(s, lambda b: {_GAP}))))) AS BIGINT) AS score FROM (
  SELECT n.media_id AS needle, m.media_id, CASE WHEN n.num_colors >= m.num_colors THEN n.colors ELSE m.colors END AS g, CASE WHEN n.num_colors >= m.num_colors THEN m.colors ELSE n.colors END AS s
  FROM colours n JOIN colours m ON {needles} AND abs(n.num_colors - m.num_colors) <= 2)"""


@query(_palettes_sql("n.media_id % 50 = 0"), "colours")
def sim_color(spark, d):
    c = T.colours(spark, d)
    return similar.colour_search(c.where("media_id % 50 = 0"), c)


@query(f"""SELECT needle, media_id, score, CAST(row_number() OVER (PARTITION BY needle ORDER BY score, media_id) AS INTEGER) AS pos
FROM ({_palettes_sql("n.media_id % 50 = 0")}) WHERE needle <> media_id QUALIFY pos <= 5""", "colours")
def sim_color_top(spark, d):
    c = T.colours(spark, d)
    return similar.colour_nearest(c.where("media_id % 50 = 0"), c, 5)


_HAY = "hay AS (SELECT media_id AS video_id, frame AS dst, hash AS dh FROM frames WHERE bit_count(hash) BETWEEN 5 AND 59)"


_GRAB = f"""SELECT needle, video_id AS media_id, CAST(x.d AS INTEGER) AS score, 0 AS src_in, x.dst AS dst_in, 1 AS len FROM (
  SELECT n.id AS needle, video_id, min({{'d': bit_count(xor(n.phash, dh)), 'dst': dst}}) AS x FROM media_vec n JOIN hay ON n.id % 5 = 0 AND (n.phash >> 1) & 15 = (dh >> 1) & 15 AND bit_count(xor(n.phash, dh)) < 5 GROUP BY n.id, video_id)"""


@query(f", {_HAY} {_GRAB}", "frames")
def sim_frame(spark, d):
    needles = T.media_vec(spark, d).where("id % 5 = 0").select(F.col("id").alias("needle"), F.col("phash").alias("hash"))
    out = similar.frame_search(needles, T.frames(spark, d), 5, bits=4)
    return out.withColumn("score", F.col("score").cast("int"))


@query(f""", {_HAY}, g AS (SELECT media_id AS needle, hash, frame AS spot FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY frame) - 1 AS k, count(*) OVER (PARTITION BY media_id) AS n FROM frames)
  WHERE list_contains(list_transform(range(1, 10), lambda i: (n * i) // 10), k))
SELECT needle, video_id AS media_id, CAST(x.d AS INTEGER) AS score, src_in, x.dst AS dst_in, 1 AS len FROM (SELECT needle, spot AS src_in, video_id, min({{'d': bit_count(xor(hash, dh)), 'dst': dst}}) AS x
  FROM g JOIN hay ON (hash >> 1) & 1023 = (dh >> 1) & 1023 AND bit_count(xor(hash, dh)) < 5 GROUP BY needle, spot, video_id)""", "frames")
def sim_grabs(spark, d):
    f = T.frames(spark, d)
    out = similar.frame_search(similar.grab_needles(f), f, 5)
    return out.withColumn("score", F.col("score").cast("int"))


def _video_sql(threshold: int = 5, least: int = 20) -> str:
    return f"""WITH {_HAY}, b AS (SELECT media_id AS needle, video_id, frame AS src, min({{'d': bit_count(xor(hash, dh)), 'dst': dst}}).dst AS dst FROM frames JOIN hay ON media_id <> video_id AND (hash >> 1) & 1023 = (dh >> 1) & 1023 AND bit_count(xor(hash, dh)) < {threshold} GROUP BY media_id, video_id, frame
), s AS (SELECT *, CASE WHEN abs(dst - coalesce(lag(dst) OVER (PARTITION BY needle, video_id ORDER BY src), 0)) < 15 THEN 1 ELSE 0 END AS near FROM b
), r AS (SELECT needle, video_id, count(*) AS num, CAST(sum(near) * 100 // count(*) AS BIGINT) AS np, min(src) AS a, arg_min(dst, src) AS ad, max(src) AS z, arg_max(dst, src) AS zd FROM s GROUP BY needle, video_id)
SELECT needle, video_id AS media_id, 100 - np AS score, a AS src_in, ad AS dst_in, greatest(z - a, zd - ad) AS len, num, np AS near_percent FROM r WHERE num >= {least} AND np >= 60"""


_VIDEO = f", found AS ({_video_sql()}) SELECT * FROM found"


@query(_VIDEO, "frames")
def sim_video(spark, d):
    f = T.frames(spark, d)
    return similar.video_search(f, f, 5, least=20)


@query(_adaptive_sql([_video_sql(t, 5) for t in range(1, 4)], 1), "frames")
def adaptive_video(spark, d):
    f = T.frames(spark, d)
    return similar.widened(f.withColumnRenamed("media_id", "needle"), "video", f, 1, 3, 1, least_frames=5).select("needle", "media_id", "score")


@query(f""", v AS (SELECT * FROM ({_VIDEO.removeprefix(', ').replace('hay AS', 'WITH hay AS', 1)})), o AS (SELECT needle, media_id, unnest(range(-30, 30)) AS o, src_in, dst_in FROM v
), m AS (SELECT v.needle, v.media_id, o, count(*) AS n, sum(bit_count(xor(a.hash, b.hash))) AS t FROM (SELECT o.*, i FROM o, unnest(range(0, 5)) x(i)) v JOIN frames a ON a.media_id = v.needle AND a.frame = src_in + 3 * i JOIN frames b ON b.media_id = v.media_id AND b.frame = dst_in + 3 * o + 3 * i GROUP BY ALL)
SELECT needle, media_id, CAST(min({{'t': t, 'o': o}}).o AS INTEGER) AS "offset", CAST(min({{'t': t, 'o': o}}).t AS DOUBLE) / 5 AS mean_distance FROM m WHERE n = 5 GROUP BY needle, media_id""", "frames")
def align_pairs(spark, d):
    f = T.frames(spark, d).withColumn("frame", (F.col("frame") / 3).cast("int"))
    pairs = sim_video(spark, d).select("needle", "media_id", (F.col("src_in") / 3).cast("int").alias("src_in"), (F.col("dst_in") / 3).cast("int").alias("dst_in"))
    return similar.align(pairs, f)


@query("""SELECT needle, flip, media_id, CAST(score AS INTEGER) AS score FROM (SELECT n.id AS needle, f.flip, m.id AS media_id, bit_count(xor(xor(n.phash, f.mask), m.phash)) AS score FROM mediah n, (VALUES ('none', 0), ('h', 3), ('v', 12)) f(flip, mask), mediah m
  WHERE n.id % 25 = 0 AND n.phash <> 0 AND xor(n.phash, f.mask) <> 0 AND m.phash <> 0) WHERE score < 5""", "mediah")
def sim_reflect(spark, d):
    m = T.media_hashed(spark, d)
    flips = F.explode(F.map_from_arrays(F.array(F.lit("none"), F.lit("h"), F.lit("v")), F.array(F.lit(0), F.lit(3), F.lit(12)))).alias("flip", "mask")
    needles = m.where("id % 25 = 0 and phash <> 0").select(F.col("id").alias("needle"), "phash", flips)
    needles = needles.select("needle", "flip", F.col("phash").bitwiseXOR(F.col("mask").cast("long")).alias("hash"))
    return similar.reflected(needles, m, 5)


_STAGES = (
    (
        "dct",
        "SELECT n.id AS needle, m.id AS media_id, CAST(bit_count(xor(n.phash, m.phash)) AS BIGINT) AS score FROM media_vec n JOIN media_vec m ON n.phash <> 0 AND m.phash <> 0 AND bit_count(xor(n.phash, m.phash)) < 12",
    ),
    ("fdct", "SELECT needle, media_id, score FROM fv WHERE score < 1000"),
    ("orb", "SELECT needle, media_id, score FROM ov WHERE score < 1000"),
    ("color", "SELECT needle, media_id, score FROM cv"),
)


def _cascade_sql() -> str:
    parts, before = [], "SELECT CAST(NULL AS BIGINT) AS needle"
    for name, found in _STAGES:
        parts.append(f"s_{name} AS (SELECT needle, media_id, score, pos, '{name}' AS stage FROM (SELECT *, CAST(row_number() OVER (PARTITION BY needle ORDER BY score, media_id) AS INTEGER) AS pos FROM ({found}) WHERE needle <> media_id AND needle IN (SELECT id FROM media_vec WHERE id % 50 < 2) AND needle NOT IN (SELECT needle FROM ({before}) WHERE needle IS NOT NULL)) WHERE pos <= 2)")
        before += f" UNION ALL SELECT needle FROM s_{name}"
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT * FROM s_{n}" for n, _ in _STAGES)


@query(
    f", fv AS (WITH {_VOTES.removeprefix(', ')}), ov AS (WITH {_ORB.removeprefix(', ')}), cv AS ({_palettes_sql('n.media_id % 50 < 2')}), {_cascade_sql()}",
    "features descriptors colours",
)
def sim_cascade(spark, d):
    m = T.media_vec(spark, d)
    needles = m.where("id % 50 < 2").select(F.col("id").alias("needle"))
    return similar.cascade(needles, similar.all_algorithms(m, T.features(spark, d), T.descriptors(spark, d), T.colours(spark, d), 2))


_NEXT = """, h AS (SELECT id, phash FROM mediah), a AS (SELECT id AS z, phash AS ah, row_number() OVER (ORDER BY id) - 1 AS nth FROM h WHERE id % 2 = 1
), f AS (SELECT b.id, a.z, row_number() OVER (PARTITION BY b.id ORDER BY bit_count(xor(b.phash, a.ah)), a.z) AS r FROM h b JOIN a ON b.id % 2 = 0 AND b.phash <> 0 AND a.ah <> 0 AND bit_count(xor(b.phash, a.ah)) < 12
), n AS (SELECT f.id, f.z, coalesce(bit_count(xor(b.phash, p.ah)), 65) AS x, coalesce(bit_count(xor(b.phash, q.ah)), 65) AS y FROM f JOIN h b ON b.id = f.id JOIN a ON a.z = f.z LEFT JOIN a p ON p.nth = a.nth - 1 LEFT JOIN a q ON q.nth = a.nth + 1 WHERE r = 1)
SELECT z AS id, CAST(z AS BIGINT) AS p, 0 AS side, CAST(0 AS BIGINT) AS q FROM a
UNION ALL SELECT h.id, CAST(coalesce(n.z, (SELECT max(z) + 1 FROM a)) AS BIGINT), CASE WHEN x < y THEN -1 ELSE 1 END, CAST(h.id AS BIGINT) FROM h LEFT JOIN n ON n.id = h.id WHERE h.id % 2 = 0"""


@query(_NEXT, "mediah")
def merge_sorted(spark, d):
    m = Stash(spark).put(T.media_hashed(spark, d), "media")
    a, b = (m.where(f"id % 2 = {k}").select("id", F.col("id").alias("pos")) for k in (1, 0))
    needles = m.where("id % 2 = 0").select(F.col("id").alias("needle"), F.col("phash").alias("hash"))
    found = similar.search_nearest(needles, m.where("id % 2 = 1"), 12)
    return similar.merge_sorted(a, b, similar.beside(a, found, m.select("id", "phash")))


_DIR = "regexp_extract({}.path, '^(.*)/', 1)"


@query(f""", {_LINKS}, tk AS ({_TOPK}), g0 AS (SELECT needle AS group_id, needle AS media_id, 0 AS pos, 0 AS score FROM (SELECT DISTINCT needle FROM tk) UNION ALL SELECT needle, media_id, pos, score FROM tk
), g1 AS (SELECT g0.*, m.path, m.md5, n.md5 AS nm, {_DIR.format('m')} AS p, {_DIR.format('n')} AS np, n.path AS first_path FROM g0 JOIN media m ON m.id = media_id JOIN media n ON n.id = group_id
), ng AS (SELECT DISTINCT least(a.md5, b.md5) AS lo, greatest(a.md5, b.md5) AS hi FROM li JOIN media a ON a.id = rep_a JOIN media b ON b.id = rep_b WHERE (rep_a + rep_b) % 3 = 0
), g2 AS (SELECT * FROM g1 WHERE pos = 0 OR (p <> np AND NOT EXISTS (SELECT 1 FROM ng WHERE lo = least(md5, nm) AND hi = greatest(md5, nm)))
), g3 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM g2) WHERE n > 1
), s AS (SELECT group_id, first_path, list_sort(list(path)) AS members FROM g3 GROUP BY group_id, first_path), k AS (SELECT arg_min(group_id, first_path) AS group_id FROM s GROUP BY members)
SELECT group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1 AS INTEGER) AS pos, media_id, CAST(score AS BIGINT) AS score, md5 IN (SELECT md5 FROM media WHERE id % 11 = 0) AS weed FROM g3 JOIN k USING (group_id)""", "mediah")
def similar_groups(spark, d):
    m = Stash(spark).put(T.media_hashed(spark, d), "media")
    pairs = similar.class_links(similar.hash_classes(m), 5).where((F.col("rep_a") + F.col("rep_b")) % 3 == 0)
    digests = [m.select(F.col("id").alias(f"rep_{x}"), F.col("md5").alias(f"md5_{x}")).hint("merge") for x in "ab"]
    negative = pairs.join(digests[0], "rep_a").join(digests[1], "rep_b").select("md5_a", "md5_b")
    params = SearchParams(neg=True, fp=True, types=3)
    return find_groups(params, m, negative=negative, weeds=m.where("id % 11 = 0").select(F.col("md5").alias("weed_md5"))).drop("path", "md5")


@query()
def sort_similar(spark, d):
    m = T.media_hashed(spark, d)
    return similar.sort_similar(m, similar.class_links(similar.hash_classes(m), 5))


@query(f""", {_LINKS} SELECT needle, media_id, least(x, y) AS md5_a, greatest(x, y) AS md5_b, score FROM (SELECT rep_a AS needle, rep_b AS media_id, a.md5 AS x, b.md5 AS y, CAST(distance AS INTEGER) AS score FROM li JOIN media a ON a.id = rep_a JOIN media b ON b.id = rep_b WHERE (rep_a + rep_b) % 3 <> 0) WHERE score < 4""", "mediah")
def verify_pairs(spark, d):
    """Distances of the pairs' hashes, but for a third of the pairs, which are remembered as not to be scored."""
    m = Stash(spark).put(T.media_hashed(spark, d), "media")
    pairs = similar.class_links(similar.hash_classes(m), 5).select(F.col("rep_a").alias("needle"), F.col("rep_b").alias("media_id"))
    pairs = pairs.join(m.select(F.col("id").alias("needle"), F.col("md5").alias("md5_n")), "needle").join(m.select(F.col("id").alias("media_id"), F.col("md5").alias("md5_m")), "media_id")
    pairs = Stash(spark).put(pairs, "pairs")
    scores = pairs.where("(needle + media_id) % 3 = 0").select(F.col("md5_m").alias("md5_a"), F.col("md5_n").alias("md5_b"), F.lit(similar.INFINITE).alias("score"))
    return similar.verify_pairs(pairs, scores, 4, similar.hash_scorer(m.select("md5", F.col("phash").alias("hash"))))


# Groups ---------------------------------------------------------------------------------------------------


@query("SELECT group_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM groups) WHERE n > 4", "groups")
def grp_min(spark, d):
    return X.at_least(T.groups(spark, d), "group_id", 5).select("group_id", "pos")


@query("SELECT group_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM groups WHERE pos = 0 OR starts_with(path, 'user/')) WHERE n > 1", "groups")
def grp_path(spark, d):
    return G.by_path_prefix(T.groups(spark, d), "user/").select("group_id", "pos")


_NEEDLE = "ne AS (SELECT group_id, arg_min(path, pos) AS np, arg_min(md5, pos) AS nm, arg_min(width, pos) AS nw, arg_min(height, pos) AS nh, arg_min(file_size, pos) AS nf, arg_min(media_id, pos) AS nid FROM groups GROUP BY group_id)"


@query(f", {_NEEDLE} SELECT group_id, pos FROM (SELECT g.*, count(*) OVER (PARTITION BY group_id) AS n FROM groups g JOIN ne USING (group_id) WHERE pos = 0 OR regexp_extract(path, '^(.*)/', 1) <> regexp_extract(np, '^(.*)/', 1)) WHERE n > 1", "groups")
def grp_parent(spark, d):
    return G.not_beside_needle(T.groups(spark, d), P.dir_path()).select("group_id", "pos")


@query(f""", {_NEEDLE}, neg AS (SELECT DISTINCT nm AS a, md5 AS b FROM groups JOIN ne USING (group_id) WHERE media_id % 3 = 0 AND pos > 0)
SELECT group_id, pos FROM (SELECT g.*, count(*) OVER (PARTITION BY group_id) AS n FROM groups g JOIN ne USING (group_id) WHERE pos = 0 OR NOT EXISTS (SELECT 1 FROM neg WHERE (a = nm AND b = md5) OR (a = md5 AND b = nm))) WHERE n > 1""", "groups")
def grp_negative(spark, d):
    g = T.groups(spark, d)
    neg = g.withColumn("nm", G.needle_of("md5")).where("media_id % 3 = 0 and pos > 0").select(F.col("md5").alias("md5_a"), F.col("nm").alias("md5_b"))
    return G.drop_negative(g, neg).select("group_id", "pos")


@query(""", m AS (SELECT group_id, list_sort(list(path)) AS l, arg_min(path, pos) AS np FROM groups GROUP BY group_id), k AS (SELECT min({'p': np, 'g': group_id}).g AS group_id FROM m GROUP BY l)
SELECT group_id, pos FROM groups WHERE group_id IN (SELECT group_id FROM k)""", "groups")
def grp_dedupe(spark, d):
    return G.dedupe(T.groups(spark, d)).select("group_id", "pos")


@query(f""", g2 AS (SELECT * FROM groups), e AS (SELECT DISTINCT a.group_id AS a, b.group_id AS b FROM g2 a JOIN g2 b ON b.pos = 0 AND a.media_id = b.media_id
), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS g, b AS s FROM l UNION SELECT r.g, l.b FROM r JOIN l ON l.a = r.s), c AS (SELECT g, min(s) AS root FROM r GROUP BY g)
SELECT DISTINCT root AS group_id, media_id FROM g2 JOIN c ON c.g = group_id""", "groups")
def grp_merge(spark, d):
    return G.merge(T.groups(spark, d))


@query(f", {_NEEDLE} SELECT nid AS needle, media_id FROM groups JOIN ne USING (group_id) WHERE pos > 0", "groups")
def grp_expand(spark, d):
    return G.expand(T.groups(spark, d))


@query("""SELECT group_id, pos, CASE WHEN pos = 0 THEN lead(s) OVER w ELSE s END AS src_in FROM (SELECT group_id, pos, score AS s FROM groups) WINDOW w AS (PARTITION BY group_id ORDER BY pos)""", "groups")
def grp_range(spark, d):
    g = T.groups(spark, d).withColumn("range", F.struct(F.col("score").alias("src_in"), F.col("score").alias("dst_in"), F.lit(1).alias("len")))
    return G.needle_range(g).select("group_id", "pos", F.col("range.src_in").alias("src_in"))


@query("""SELECT what, group_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS a, row_number() OVER (PARTITION BY group_id ORDER BY pos DESC) AS z FROM groups)
JOIN (VALUES ('head'), ('tail'), ('chop')) t(what) ON (what = 'head' AND a <= 2) OR (what = 'tail' AND z <= 2) OR (what = 'chop' AND a > 1)""", "groups")
def grp_head_tail(spark, d):
    g = T.groups(spark, d)
    parts = [f.select(F.lit(n).alias("what"), "group_id", "pos") for n, f in (("head", G.head(g, 2)), ("tail", G.tail(g, 2)), ("chop", G.chop(g)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT group_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY group_id, regexp_extract(path, '^(.*)/', 1) ORDER BY pos) AS r FROM groups) WHERE r = 1", "groups")
def grp_sibling(spark, d):
    return G.first_sibling(T.groups(spark, d), P.dir_path()).select("group_id", "pos")


@query("SELECT group_id, pos, (row_number() OVER (PARTITION BY group_id ORDER BY pos) - 1) // 3 AS page FROM groups", "groups")
def pages(spark, d):
    return G.pages(T.groups(spark, d), 3).select("group_id", "pos", "page")


@query("""SELECT id, folder, (row_number() OVER (PARTITION BY folder ORDER BY id) - 1) // 12 AS page FROM (SELECT id, CASE WHEN type = 2 THEN path ELSE regexp_extract(path, '^(.*)/', 1) END AS folder FROM media)""", "media")
def folder_pages(spark, d):
    return G.folder_pages(T.media(spark, d).withColumn("pos", F.col("id")), P.dir_path()).select("id", "folder", "page")


@query("""SELECT group_id, folder, count(*) AS n FROM (SELECT s AS group_id, substr(CASE WHEN type = 2 THEN path ELSE regexp_extract(path, '^(.*)/', 1) END, length(s) + 2) AS folder FROM (SELECT *, split_part(path, '/', 1) AS s FROM media)) GROUP BY group_id, folder""", "media")
def folders(spark, d):
    g = T.media(spark, d).withColumn("group_id", F.substring_index("path", "/", 1))
    prefix = g.select("group_id").distinct().withColumn("prefix", F.col("group_id"))
    return G.folders(g, prefix, P.dir_path())


@query("""SELECT group_id, CASE WHEN pair IS NOT NULL AND count(*) OVER (PARTITION BY pair) > 1 THEN pair ELSE '*unpaired*' END AS pair FROM (SELECT group_id, CASE WHEN len(d) = 2 THEN d[1] || ' + ' || d[2] END AS pair FROM (
  SELECT group_id, list_sort(list(DISTINCT regexp_extract(path, '^(.*)/', 1))) AS d FROM groups GROUP BY group_id))""", "groups")
def dir_pairs(spark, d):
    return G.directory_pairs(T.groups(spark, d), P.dir_path())


@query("""SELECT a.group_id, a.l = b.l AS same FROM (SELECT group_id, list_sort(list(path)) AS l FROM groups GROUP BY group_id) a JOIN (SELECT group_id, list_sort(list(CASE WHEN media_id % 7 = 0 THEN path || 'x' ELSE path END)) AS l FROM groups GROUP BY group_id) b USING (group_id)""", "groups")
def grp_equal(spark, d):
    g = T.groups(spark, d)
    return G.same_contents(g, g.withColumn("path", F.when(F.col("media_id") % 7 == 0, F.concat("path", F.lit("x"))).otherwise(F.col("path"))))


@query(f", {_flags_sql()} SELECT group_id, pos, CAST(match_flags AS INTEGER) AS match_flags FROM fl", "groups")
def match_flags(spark, d):
    return _flagged(spark, d).select("group_id", "pos", "match_flags")


@query(f""", {_NEEDLE} SELECT group_id, pos, CASE WHEN width > nw THEN 'more' WHEN width < nw THEN 'less' ELSE 'same' END AS w, CASE WHEN floor(abs(file_size - nf) * 100 / CAST(nf AS DOUBLE)) = 0 THEN 'same' WHEN file_size > nf THEN 'more' ELSE 'less' END AS s,
  CASE WHEN height > nh THEN 'less' WHEN height < nh THEN 'more' ELSE 'same' END AS h FROM groups JOIN ne USING (group_id) WHERE nf > 0""", "groups")
def rel_labels(spark, d):
    g = T.groups(spark, d)
    out = g.select("group_id", "pos", G.relative_label(F.col("width")).alias("w"), G.relative_label(F.col("file_size"), percent=True).alias("s"), G.relative_label(F.col("height"), reverse=True).alias("h"), G.needle_of("file_size").alias("nf"))
    return out.where("nf > 0").drop("nf")


@query(f", {_flags_sql()} SELECT group_id, pos, CASE WHEN score - 2 < 0 THEN CASE WHEN pos % 2 = 1 THEN 'weed' ELSE 'unmatched' END WHEN (match_flags & 1) <> 0 THEN 'exact' ELSE 'better' || bit_count(match_flags & 14) END AS class FROM fl", "groups")
def match_class(spark, d):
    return _flagged(spark, d).select("group_id", "pos", G.match_class(F.col("match_flags") + F.col("pos") % 2 * G.WEED, F.col("score") - 2).alias("class"))


@query("SELECT group_id, coalesce(min(CASE WHEN path = 'user/d1/t3.png' THEN pos END), -1) AS idx FROM groups GROUP BY group_id", "groups")
def grp_index(spark, d):
    return G.index_of(T.groups(spark, d), F.lit("user/d1/t3.png"))


@query("SELECT group_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY group_id) AS n FROM groups WHERE regexp_extract(path, '^(.*)/', 1) <> 'user/d1') WHERE n > 1", "groups")
def grp_remove_dir(spark, d):
    return G.remove_directory(T.groups(spark, d), P.dir_path(), "user/d1").select("group_id", "pos")


# Sorts ----------------------------------------------------------------------------------------------------


@query("SELECT id, row_number() OVER (ORDER BY height ASC, width DESC, id) - 1 AS pos FROM media", "media")
def sort_multi(spark, d):
    return sorting.sort_selection(T.media(spark, d).withColumn("pos", F.col("id")), ["height", "^width"]).select("id", "pos")


@query("SELECT group_id, media_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, p) - 1 AS pos FROM (SELECT *, pos AS p FROM groups)", "groups")
def sort_groups(spark, d):
    return sorting.sort_groups(T.groups(spark, d), ["^score"]).select("group_id", "media_id", "pos")


@query("SELECT group_id, row_number() OVER (ORDER BY path, group_id) - 1 AS nth FROM groups WHERE pos = 0", "groups")
def sort_result(spark, d):
    return sorting.sort_result(T.groups(spark, d), ["path"])


@query(r"SELECT id, array_to_string(list_transform(regexp_extract_all(path, '[0-9]+|[^0-9]+'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN lpad(regexp_replace(r, '^0+(.)', '\1'), 20, '0') ELSE r END), '') AS key FROM media", "media")
def sort_natural(spark, d):
    return T.media(spark, d).select("id", sorting.natural_key(F.col("path")).alias("key"))


# State and plans ------------------------------------------------------------------------------------------


@query("SELECT m.id, w.weed_md5 IS NOT NULL AS is_weed FROM media m LEFT JOIN (SELECT DISTINCT weed_md5 FROM weeds WHERE orig_md5 IN (SELECT md5 FROM media)) w ON w.weed_md5 = m.md5", "media weeds")
def weed_flag(spark, d):
    return state.weed_flag(T.media(spark, d), T.weeds(spark, d))


@query(""", o AS (SELECT md5, min({'p': path, 'i': id}).i AS orig_id FROM media GROUP BY md5) SELECT m.id AS weed_id, orig_id FROM weeds JOIN o ON o.md5 = orig_md5 JOIN media m ON m.md5 = weed_md5""", "media weeds")
def weeds_list(spark, d):
    return state.weed_list(T.media(spark, d), T.weeds(spark, d))


@query("SELECT weed_md5, orig_md5 FROM weeds WHERE weed_md5 NOT IN (SELECT md5 FROM media WHERE id % 2 = 0)", "media weeds")
def weed_forget(spark, d):
    return state.forget_weeds(T.weeds(spark, d), T.media(spark, d).where("id % 2 = 0").select("md5"))


@query("SELECT weed_md5, orig_md5 FROM weeds WHERE orig_md5 NOT IN (SELECT md5 FROM media)", "media weeds")
def weed_broken(spark, d):
    return state.broken_weeds(T.media(spark, d), T.weeds(spark, d))


_CAND = """k AS (SELECT md5, min(type) AS kind FROM media GROUP BY md5), ca AS (SELECT DISTINCT a.md5 AS weed_md5, CASE WHEN a.id % 9 = 0 THEN 'gone' WHEN a.id % 8 = 0 THEN a.md5 ELSE b.md5 END AS orig_md5 FROM media a JOIN media b ON b.id = a.id + 1 WHERE a.id % 2 = 0 OR a.id % 5 = 0)"""


@query(f""", {_CAND}, ju AS (SELECT ca.weed_md5, ca.orig_md5, h.orig_md5 IS NOT NULL AS known, CASE WHEN wk.kind IS NULL OR ok.kind IS NULL THEN 'missing' WHEN ca.weed_md5 = ca.orig_md5 THEN 'same' WHEN wk.kind <> ok.kind THEN 'type' WHEN h.orig_md5 IS NOT NULL AND h.orig_md5 <> ca.orig_md5 THEN 'changed' END AS reason, o.weed_md5 IS NOT NULL AS listed FROM ca LEFT JOIN k wk ON wk.md5 = ca.weed_md5 LEFT JOIN k ok ON ok.md5 = ca.orig_md5 LEFT JOIN weeds h ON h.weed_md5 = ca.weed_md5 LEFT JOIN weeds o ON o.weed_md5 = ca.orig_md5
), nu AS (SELECT weed_md5 AS w, orig_md5 AS o, listed, row_number() OVER (ORDER BY weed_md5, orig_md5) AS n FROM ju WHERE reason IS NULL AND NOT known
), st AS (SELECT CAST(0 AS BIGINT) AS n, CAST('' AS VARCHAR) AS w, CAST('' AS VARCHAR) AS o, CAST(NULL AS VARCHAR) AS reason, CAST(MAP([], []) AS MAP(VARCHAR, VARCHAR)) AS got
  UNION ALL SELECT n, w, o, reason, CASE WHEN reason IS NULL THEN map_concat(got, MAP([w], [o])) ELSE got END FROM (
    SELECT nu.n, nu.w, nu.o, CASE WHEN map_contains(got, nu.w) THEN 'changed' WHEN listed OR map_contains(got, nu.o) THEN 'original is a weed' END AS reason, got FROM st JOIN nu ON nu.n = st.n + 1))
SELECT weed_md5, orig_md5, reason FROM ju WHERE reason IS NOT NULL OR known UNION ALL SELECT w, o, reason FROM st WHERE n > 0""", "media weeds")
def weed_add(spark, d):
    m = T.media(spark, d)
    b = m.select((F.col("id") - 1).alias("id"), F.col("md5").alias("next"))
    orig = F.when(F.col("id") % 9 == 0, "gone").when(F.col("id") % 8 == 0, F.col("md5")).otherwise(F.col("next"))
    c = m.join(b, "id").where("id % 2 = 0 or id % 5 = 0").select(F.col("md5").alias("weed_md5"), orig.alias("orig_md5"))
    return state.add_weeds(c, T.weeds(spark, d), m)


@query("""SELECT DISTINCT least(a.md5, b.md5) AS md5_a, greatest(a.md5, b.md5) AS md5_b FROM media a JOIN media b ON b.id = a.id + 1 AND a.md5 <> b.md5
WHERE NOT EXISTS (SELECT 1 FROM weeds WHERE least(weed_md5, orig_md5) = least(a.md5, b.md5) AND greatest(weed_md5, orig_md5) = greatest(a.md5, b.md5))""", "media weeds")
def neg_add(spark, d):
    m = T.media(spark, d)
    b = m.select((F.col("id") - 1).alias("id"), F.col("md5").alias("md5_b"))
    pairs = m.join(b, "id").select(F.col("md5").alias("md5_a"), "md5_b")
    return state.add_negative(pairs.unionByName(pairs), T.weeds(spark, d).select(F.col("orig_md5").alias("md5_a"), F.col("weed_md5").alias("md5_b")))


@query("SELECT DISTINCT b.md5 AS weed_md5, a.md5 AS orig_md5 FROM media a JOIN media b ON b.id = a.id + 2 AND a.md5 <> b.md5 WHERE a.id % 3 = 0", "media")
def weed_from_pairs(spark, d):
    m = T.media(spark, d)
    dec = m.where("id % 3 = 0").select(F.col("id").alias("group_id"), F.col("id").alias("keep_id"), (F.col("id") + 2).alias("delete_id"))
    return state.weeds_from_pairs(dec, m)


_DUPS = "du AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY md5) AS n FROM media) WHERE n > 1)"


@query(f", {_DUPS} SELECT md5, id, path FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY path, id) AS r FROM du WHERE starts_with(path, 'src1/')) WHERE r = 1", "media")
def plan_dups_in(spark, d):
    return deletions.duplicates_in(T.media(spark, d), "src1")


@query(""", o AS (SELECT md5, min({'p': path, 'i': id}).i AS orig_id FROM media GROUP BY md5) SELECT m.id AS weed_id, orig_id FROM weeds JOIN o ON o.md5 = orig_md5 JOIN media m ON m.md5 = weed_md5""", "media weeds")
def plan_weeds(spark, d):
    return deletions.weeds(T.media(spark, d), T.weeds(spark, d))


@query(r"SELECT CASE WHEN contains(path, '.zip:') THEN regexp_extract(path, '^(.*\.zip):', 1) ELSE path END AS path, count(*) AS n FROM web_media GROUP BY 1", "web_media")
def plan_nuke(spark, d):
    return deletions.selection(T.web_media(spark, d))


@query(""", ma AS (SELECT *, CASE WHEN media_id % 2 = 0 OR group_id % 4 = 0 THEN 1 ELSE 0 END AS m FROM groups)
SELECT group_id, media_id FROM (SELECT *, sum(m) OVER (PARTITION BY group_id) AS k, count(*) OVER (PARTITION BY group_id) AS n FROM ma) WHERE m = 1 AND k < n AND regexp_extract(path, '^(.*)/', 1) <> 'user/d1'""", "groups")
def plan_guard(spark, d):
    g = T.groups(spark, d)
    marked = g.where("media_id % 2 = 0 or group_id % 4 = 0").select("group_id", "media_id").distinct()
    return deletions.guard(marked, g, spark.createDataFrame([("user/d1",)], "dir_path string"))


@query(r"SELECT a.path AS keep_path, regexp_extract(b.path, '^(.*)/', 1) || '/' || regexp_extract(b.path, '([^/]*)\.txt$', 1) || '.jpg' AS new_path FROM (SELECT id, path || '.jpg' AS path FROM media) a JOIN media b ON b.id = a.id + 1", "media")
def plan_replace(spark, d):
    m = T.media(spark, d)
    keep = m.select((F.col("id") + 1).alias("id"), F.concat("path", F.lit(".jpg")).alias("keep_path"))
    return deletions.replace(m.select("id", F.col("path").alias("gone_path")).join(keep, "id"))


# Evaluation -----------------------------------------------------------------------------------------------

_RANKED = f""", t AS ({_TOPK}), ex AS (SELECT a.id AS src, b.id AS dst FROM media a JOIN media b ON a.md5 = b.md5 AND b.id = (SELECT min(c.id) FROM media c WHERE c.md5 = a.md5) AND a.id > b.id)"""


def _expected(m: DataFrame) -> DataFrame:
    first = m.groupBy("md5").agg(F.min("id").alias("dst"))
    return m.join(first, "md5").where("id > dst").select(F.col("id").alias("src"), "dst")


@query(f"{_RANKED} SELECT src, dst, pos AS rank, (SELECT count(*) FROM t WHERE needle = src) AS results FROM ex LEFT JOIN t ON needle = src AND media_id = dst", "mediah")
def eval_pairs(spark, d):
    found = topk(spark, d).select(F.col("needle").alias("src"), F.col("media_id").alias("dst"), "pos")
    return V.pairs(_expected(T.media(spark, d)), found)


_FEATURE_RANKS = f"""fv AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score, media_id) AS pos FROM ({_features_sql()}) WHERE needle <> media_id
), fi AS (SELECT DISTINCT media_id FROM features), fx AS (SELECT b.media_id AS src, a.media_id AS dst FROM fi a JOIN fi b ON b.media_id = a.media_id + 100)"""


@query(f"""{_RANKED}, {_FEATURE_RANKS}, r AS (SELECT 'dct' AS algo, pos AS rank, score FROM ex LEFT JOIN t ON needle = src AND media_id = dst UNION ALL SELECT 'fdct', pos, score FROM fx LEFT JOIN fv ON needle = src AND media_id = dst)
SELECT algo, CAST(count_if(rank IS NOT NULL) AS BIGINT) AS hits, CAST(count_if(rank IS NULL) AS BIGINT) AS misses, avg(score) AS mean_score, min(score) AS min_score, max(score) AS max_score, avg(rank) AS mean_rank, min(rank) AS min_rank, max(rank) AS max_rank FROM r GROUP BY algo""", "mediah features")
def eval_search(spark, d):
    """Copies of texts by their hashes, copies of items by votes of their features."""
    found = topk(spark, d).select(F.col("needle").alias("src"), F.col("media_id").alias("dst"), F.col("pos").cast("long").alias("rank"), F.col("score").cast("long").alias("score"))
    rows = _expected(T.media(spark, d)).join(found, ["src", "dst"], "left").withColumn("algo", F.lit("dct"))
    f = T.features(spark, d)
    items = f.select("media_id").distinct()
    copies = items.select(F.col("media_id").alias("src"), (F.col("media_id") - 100).alias("dst")).join(items.withColumnRenamed("media_id", "dst"), "dst", "left_semi")
    rank = F.row_number().over(Window.partitionBy("needle").orderBy("score", "media_id")).cast("long")
    votes = similar.feature_votes(f, f, 5).where("needle <> media_id").select(F.col("needle").alias("src"), F.col("media_id").alias("dst"), rank.alias("rank"), "score")
    return V.by_algorithm(rows.unionByName(copies.join(votes, ["src", "dst"], "left").withColumn("algo", F.lit("fdct"))))


@query(f"""{_RANKED} SELECT count(*) AS pairs, CAST(count_if(pos IS NOT NULL) AS BIGINT) AS hits, avg(CASE WHEN pos IS NULL THEN 0 ELSE 1 END) * 100 AS accuracy FROM ex LEFT JOIN t ON needle = src AND media_id = dst""", "mediah")
def eval_accuracy(spark, d):
    return V.accuracy(eval_pairs(spark, d))


@query(f""", {_HAY}, fo AS (SELECT *, row_number() OVER (PARTITION BY needle ORDER BY score, media_id) AS pos FROM ({_GRAB})), va AS (SELECT DISTINCT needle FROM fo
), nu AS (SELECT id, media_id, row_number() OVER (PARTITION BY media_id ORDER BY id) AS n FROM (SELECT *, {T.owner("label", "(id - 1)")} AS media_id FROM media_vec)
), fe AS (SELECT id AS needle, CASE WHEN n BETWEEN 5 AND 40 THEN media_id + 100 WHEN n % 7 = 0 THEN media_id + 50 ELSE media_id END AS media_id, CASE WHEN n BETWEEN 5 AND 40 THEN 3 * n - 9 ELSE 3 * n END AS frame FROM nu WHERE id % 5 = 0
), fj AS (SELECT CASE WHEN pos = 1 THEN 'first' WHEN pos > 1 THEN 'later' WHEN va.needle IS NOT NULL THEN 'wrong' ELSE 'none' END AS status, CAST(abs(dst_in - frame) AS DOUBLE) AS e FROM fe LEFT JOIN fo ON fo.needle = fe.needle AND fo.media_id = fe.media_id LEFT JOIN va ON va.needle = fe.needle)
SELECT status, count(*) AS n, avg(e) AS mean_error, min(e) AS min_error, max(e) AS max_error, quantile_cont(e, 0.5) AS median_error FROM fj GROUP BY status""", "frames")
def eval_frames(spark, d):
    """Where :func:`sim_frame` finds its needles: in the clip if it holds them, else in the video, some in a video that is not there."""
    found = sim_frame(spark, d)
    found = found.withColumn("pos", F.row_number().over(Window.partitionBy("needle").orderBy("score", "media_id")))
    rows = T.media_vec(spark, d).withColumn("media_id", F.expr(T.owner("label", "(id - 1)")))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("media_id").orderBy("id"))).where("id % 5 = 0")
    clip, gone = F.col("n").between(5, 40), F.col("n") % 7 == 0
    video = F.when(clip, F.col("media_id") + 100).when(gone, F.col("media_id") + 50).otherwise(F.col("media_id"))
    expected = rows.select(F.col("id").alias("needle"), video.alias("media_id"), F.when(clip, 3 * F.col("n") - 9).otherwise(3 * F.col("n")).alias("frame"))
    return V.frame_summary(V.frames(expected, found))


# Feature jobs and streams ---------------------------------------------------------------------------------

_AHASH = " + ".join(f"CASE WHEN 64 * v[{i + 1}] > m THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(63))


@query(f"SELECT path, CAST({_AHASH} - CASE WHEN 64 * v[64] > m THEN {1 << 63}::HUGEINT ELSE 0 END AS BIGINT) AS ahash FROM (SELECT path, v, list_sum(v) AS m FROM levels)", "levels")
def average_hash(spark, d):
    """Average hashes of colour pictures with their borders cut off."""
    return features.image_hashes(T.pixels(spark, d), crop=True).select("path", "ahash")


@query()
def image_hashes(spark, d):
    return features.image_hashes(T.pixels(spark, d), crop=True)


@query()
def mirrored_hashes(spark, d):
    return features.mirrored_hashes(T.pixels(spark, d))


@query()
def patch_hashes(spark, d):
    return features.patch_hashes(T.pixels(spark, d))


@query()
def palettes(spark, d):
    out = features.palettes(T.pixels(spark, d))
    return out.select("path", "num_colors", F.transform("colors", lambda c: F.round(c["l"], 3)).alias("lightness"))


@query()
def frame_compress(spark, d):
    return features.compress_frames(T.frames(spark, d), 30)


@query()
def frame_resume(spark, d):
    f = T.frames(spark, d)
    first = features.compress_frames(f.where("frame < 60"), 30)
    return first.unionByName(features.compress_frames(f, 30, features.last_kept(first)))


@query()
def stream_frames(spark, d):
    """The same frames as :func:`frame_compress`, by a stream with state."""
    stash = Stash(spark)
    last = F.col("frame") == F.max("frame").over(Window.partitionBy("media_id"))
    source = stash.put(T.frames(spark, d).withColumn("last", last), "frames")
    stream = spark.readStream.schema(source.schema).parquet(source.stash_path)
    out = stash.path("kept")
    kept = ingest.compress_stream(stream, 30).writeStream.format("parquet").option("path", out).option("checkpointLocation", stash.path("state"))
    kept.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("media_id long, frame int, hash long").parquet(out)


@query()
def stream_resume(spark, d):
    """The later frames of :func:`frame_resume`, by a stream that starts from the stored ones and ends videos by silence."""
    stash = Stash(spark)
    f = T.frames(spark, d)
    first = stash.put(features.last_kept(features.compress_frames(f.where("frame < 60"), 30)), "stored")
    at = F.timestamp_seconds(F.col("frame"))
    later = f.where("frame >= 60").select("media_id", "frame", "hash", at.alias("ts"))
    end = f.agg(F.max("frame").alias("m")).select(F.lit(-1).cast("long").alias("media_id"), F.lit(0).alias("frame"), F.lit(0).cast("long").alias("hash"), F.timestamp_seconds(F.col("m") + 1000).alias("ts"))
    source = stash.put(later.unionByName(end), "frames")
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(source.schema).parquet(source.stash_path).withWatermark("ts", "0 seconds")
        out = stash.path("kept")
        kept = ingest.follow_videos(stream, 30, 60, first).writeStream.format("parquet").option("path", out).option("checkpointLocation", stash.path("state"))
        kept.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.schema("media_id long, frame int, hash long").parquet(out).where("media_id >= 0")


@query(""", n AS (SELECT id AS needle, phash AS hash, md5 FROM mediah WHERE id % 50 = 0), live AS (SELECT DISTINCT weed_md5 FROM weeds WHERE orig_md5 IN (SELECT md5 FROM media)
), f AS (SELECT n.needle, m.id AS media_id, CAST(bit_count(xor(hash, m.phash)) AS INTEGER) AS score FROM n JOIN mediah m ON hash <> 0 AND m.phash <> 0 AND bit_count(xor(hash, m.phash)) < 5)
SELECT n.needle, n.md5 IN (SELECT weed_md5 FROM live) AS is_weed, media_id, score FROM n LEFT JOIN f USING (needle)""", "mediah weeds")
def stream_arrivals(spark, d):
    stash = Stash(spark)
    m = stash.put(T.media_hashed(spark, d), "media")
    source = stash.put(m.where("id % 50 = 0").select(F.col("id").alias("needle"), F.col("phash").alias("hash"), "md5"), "arrivals")
    stream = spark.readStream.schema(source.schema).parquet(source.stash_path)
    out = stash.path("matched")
    ingest.match_arrivals(stream, m, stash.put(T.weeds(spark, d), "weeds"), out, stash.path("state")).awaitTermination()
    rows = spark.read.schema("needle long, is_weed boolean, media_id long, score int").parquet(out)
    return rows.select("needle", "is_weed", "media_id", "score")


@query(""", b AS (SELECT path, type FROM media) SELECT path, type, row_number() OVER (ORDER BY path) AS id FROM b""", "media")
def stream_ingest(spark, d):
    stash = Stash(spark)
    source = stash.put(T.media(spark, d).select("path", "type"), "files")
    stream = spark.readStream.schema(source.schema).parquet(source.stash_path)
    out = stash.path("catalog")
    ingest.ingest(stream, out, stash.path("state"), lambda batch: batch).awaitTermination()
    return spark.read.parquet(out).select("path", "type", "id")
