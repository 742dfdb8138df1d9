"""The shapes that operators work on, derived from the given tables.

Each function reads whole tables. ``SQL`` has the same definitions as common table expressions of DuckDB.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinsift.stash import Stash, partitions

SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog rows from ``documents``; types alternate between image and video."""
    d = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(
        (F.col("doc_id") + 1).alias("id"),
        (1 + F.col("doc_id") % 2).cast("int").alias("type"),
        path.alias("path"),
        F.col("n_chars").cast("int").alias("width"),
        (1 + F.col("doc_id") % 7).cast("int").alias("height"),
        F.md5(F.col("text").cast("binary")).alias("md5"),
        F.col("n_chars").alias("file_size"),
        F.expr("timestamp_seconds(1704067200 + doc_id * 3600)").alias("modified"),
    )


SQL["media"] = """media AS (
  SELECT doc_id + 1 AS id, CAST(1 + doc_id % 2 AS INTEGER) AS type, source || '/' || lang || '/doc' || doc_id || '.txt' AS path,
    CAST(n_chars AS INTEGER) AS width, CAST(1 + doc_id % 7 AS INTEGER) AS height, md5(text) AS md5, n_chars AS file_size,
    TIMESTAMP '2024-01-01' + to_seconds(doc_id * 3600) AS modified
  FROM documents)"""


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, phash)``: bit i of 60 is set if more of a text's distinct words have it set in their md5 than not.

    Written to the stash, so that joins do not compute it again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        shifts = np.arange(60, dtype=np.uint64)
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                words = set(re.findall("[a-z]+", (text or "").lower()))
                for w in words:
                    if w not in known:
                        if len(known) > 300_000:
                            known.clear()
                        known[w] = int(hashlib.md5(w.encode()).hexdigest()[:15], 16)
                x = np.array([known[w] if w in known else int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in words], np.uint64)
                bits = 2 * ((x[:, None] >> shifts) & np.uint64(1)).sum(0) > len(x)
                out.append(int((bits.astype(np.uint64) << shifts).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int64())], ["id", "phash"])

    d = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1).alias("id"), "text")
    return Stash(spark).put(d.mapInArrow(run, "id long, phash long"), "text_hashes")


_BITS = " + ".join(f"CASE WHEN 2 * sum((x >> {i}) & 1) > count(x) THEN {1 << i} ELSE 0 END" for i in range(60))
SQL["hashes"] = f"""words AS (
  SELECT DISTINCT doc_id + 1 AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents
), wx AS (
  SELECT id, CAST('0x' || md5(w)[1:15] AS BIGINT) AS x FROM words
), hashes AS (
  SELECT d.doc_id + 1 AS id, coalesce(h.phash, 0) AS phash FROM documents d LEFT JOIN (SELECT id, CAST({_BITS} AS BIGINT) AS phash FROM wx GROUP BY id) h ON h.id = d.doc_id + 1)"""


def media_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(spark, sf_dir).join(text_hashes(spark, sf_dir).hint("merge"), "id")  # small as files, yet a row for every text


SQL["mediah"] = f"{SQL['media']}, {SQL['hashes']}, mediah AS (SELECT m.*, h.phash FROM media m JOIN hashes h USING (id))"


def media_vec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, label, path, phash)`` from ``embeddings``: bit i is the sign of component i, bit 0 is unused."""
    bits = F.expr("aggregate(sequence(1, 63), 0L, (a, i) -> a | if(embedding[i] > 0, shiftleft(1L, i), 0L))")
    path = F.concat(F.lit("label"), F.col("label").cast("string"), F.lit("/vec"), F.col("vec_id").cast("string"), F.lit(".bin"))
    rows = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("id"), F.col("label").cast("long").alias("label"), path.alias("path"), bits.alias("phash"))
    return Stash(spark).put(rows, "media_vec")


_SIGN = " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(1, 63))
SQL["media_vec"] = f"""media_vec AS (
  SELECT vec_id + 1 AS id, CAST(label AS BIGINT) AS label, 'label' || label || '/vec' || vec_id || '.bin' AS path,
    CAST({_SIGN} - CASE WHEN embedding[64] > 0 THEN {1 << 63}::HUGEINT ELSE 0 END AS BIGINT) AS phash FROM embeddings)"""


def owner(label: str, number: str) -> str:
    """Item that a vector belongs to: one for each label and 2000 consecutive numbers, so items grow in number, not in size."""
    return f"CAST({label} + 1 + 1000 * floor({number} / 2000e0) AS BIGINT)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(media_id, frame, hash)``: a video per :func:`owner`, and a clip of each with shifted frames and flipped bits."""
    base = media_vec(spark, sf_dir).withColumn("media_id", F.expr(owner("label", "(id - 1)")))
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy("id"))
    rows = base.select("media_id", nth.alias("n"), F.col("phash").alias("hash"))
    whole = rows.select("media_id", (3 * F.col("n")).alias("frame"), "hash")
    flipped = F.when(F.col("n") % 4 == 0, F.col("hash").bitwiseXOR(F.lit(1 << 40))).otherwise(F.col("hash"))
    clip = rows.where("n between 5 and 40").select((F.col("media_id") + 100).alias("media_id"), (3 * F.col("n") - 9).alias("frame"), flipped.alias("hash"))
    return Stash(spark).put(whole.unionByName(clip), "frames")


SQL["frames"] = f"""{SQL['media_vec']}, fr AS (
  SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY id) AS n, phash AS hash FROM (SELECT *, {owner("label", "(id - 1)")} AS media_id FROM media_vec)
), frames AS (
  SELECT media_id, CAST(3 * n AS INTEGER) AS frame, hash FROM fr
  UNION ALL SELECT media_id + 100, CAST(3 * n - 9 AS INTEGER), CASE WHEN n % 4 = 0 THEN xor(hash, {1 << 40}) ELSE hash END FROM fr WHERE n BETWEEN 5 AND 40)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(media_id, feat_no, hash)``: patch hashes per :func:`owner`, and a copy of each item with some bits flipped."""
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy("id"))
    base = media_vec(spark, sf_dir).withColumn("media_id", F.expr(owner("label", "(id - 1)")))
    base = base.select("media_id", nth.alias("feat_no"), F.col("phash").alias("hash"))
    flip = F.expr("hash ^ shiftleft(1L, int(1 + feat_no % 60)) ^ if(feat_no % 3 = 0, shiftleft(1L, int(1 + feat_no % 7)), 0L)")
    copy = base.where("feat_no % 2 = 0").select((F.col("media_id") + 100).alias("media_id"), "feat_no", flip.alias("hash"))
    return Stash(spark).put(base.unionByName(copy), "features")


SQL["features"] = f"""{SQL['media_vec']}, fb AS (
  SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY id) AS feat_no, phash AS hash FROM (SELECT *, {owner("label", "(id - 1)")} AS media_id FROM media_vec)
), features AS (
  SELECT media_id, feat_no, hash FROM fb
  UNION ALL SELECT media_id + 100, feat_no, xor(xor(hash, CAST(1 AS BIGINT) << CAST(1 + feat_no % 60 AS BIGINT)),
    CASE WHEN feat_no % 3 = 0 THEN CAST(1 AS BIGINT) << CAST(1 + feat_no % 7 AS BIGINT) ELSE 0 END) FROM fb WHERE feat_no % 2 = 0)"""


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(media_id, desc_no, d0..d3)``: sign bits of vectors moved by 0, -0.05 and 0.05 and of their steps; with a copy."""
    def word(test: str) -> str:
        return f"aggregate(sequence(1, 62), 0L, (a, i) -> a | if({test}, shiftleft(1L, i), 0L))"

    tests = ["embedding[i] > 0", "embedding[i] > 0.05D", "embedding[i] > -0.05D", "embedding[i + 1] > embedding[i]"]
    nth = F.row_number().over(Window.partitionBy("media_id").orderBy("vec_id"))
    base = table(spark, sf_dir, "embeddings").withColumn("media_id", F.expr(owner("label", "vec_id")))
    base = base.select("media_id", nth.alias("desc_no"), *(F.expr(word(t)).alias(f"d{i}") for i, t in enumerate(tests)))
    copy = base.where("desc_no % 2 = 0").select((F.col("media_id") + 100).alias("media_id"), "desc_no", F.expr("d0 ^ 6L").alias("d0"), F.expr("d1 ^ shiftleft(1L, int(1 + desc_no % 60))").alias("d1"), "d2", "d3")
    return Stash(spark).put(base.unionByName(copy), "descriptors")


def _word(test: str) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {test.format(i=i + 1, j=i + 2)} THEN {1 << i}::HUGEINT ELSE 0 END" for i in range(1, 63)) + " AS BIGINT)"


SQL["descriptors"] = f"""db AS (
  SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY vec_id) AS desc_no, {_word('embedding[{i}] > 0')} AS d0,
    {_word('embedding[{i}] > CAST(0.05 AS DOUBLE)')} AS d1, {_word('embedding[{i}] > CAST(-0.05 AS DOUBLE)')} AS d2, {_word('embedding[{j}] > embedding[{i}]')} AS d3 FROM (SELECT *, {owner("label", "vec_id")} AS media_id FROM embeddings)
), descriptors AS (
  SELECT * FROM db UNION ALL SELECT media_id + 100, desc_no, xor(d0, 6), xor(d1, CAST(1 AS BIGINT) << CAST(1 + desc_no % 60 AS BIGINT)), d2, d3 FROM db WHERE desc_no % 2 = 0)"""


def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(media_id, num_colors, colors)``: palettes of 3 to 7 colours from consecutive components."""
    item = "named_struct('l', 50D + 50D * embedding[3 * k], 'u', 177D * embedding[3 * k + 1], 'v', 131D * embedding[3 * k + 2], 'w', 1D)"
    n = F.expr("int(3 + vec_id % 5)")
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).alias("media_id"), n.alias("num_colors"), F.expr(f"transform(sequence(0, int(2 + vec_id % 5)), k -> {item})").alias("colors"))


SQL["colours"] = """colours AS (
  SELECT vec_id + 1 AS media_id, CAST(3 + vec_id % 5 AS INTEGER) AS num_colors, list_transform(range(0, 3 + vec_id % 5), lambda k:
    {'l': CAST(50 AS DOUBLE) + CAST(50 AS DOUBLE) * embedding[3 * k + 1], 'u': CAST(177 AS DOUBLE) * embedding[3 * k + 2], 'v': CAST(131 AS DOUBLE) * embedding[3 * k + 3]}) AS colors FROM embeddings)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped rows from ``conversations``: turns are positions, the first is the needle."""
    c = table(spark, sf_dir, "conversations")
    path = F.concat("role", F.lit("/d"), (F.col("conv_id") % 3).cast("string"), F.lit("/t"), (F.length("text") % 10).cast("string"), F.lit(".png"))
    return c.select(
        F.col("conv_id").alias("group_id"),
        F.col("turn").cast("int").alias("pos"),
        (F.col("conv_id") % 50 * 10 + F.length("text") % 10).alias("media_id"),
        (1 + F.col("turn") % 2).cast("int").alias("type"),
        path.alias("path"),
        F.length("text").cast("int").alias("width"),
        (1 + F.col("turn") % 3).cast("int").alias("height"),
        F.octet_length("text").cast("long").alias("file_size"),
        F.md5(F.substring("text", 1, 4).cast("binary")).alias("md5"),
        (F.length("text") % 12).cast("int").alias("score"),
    )


SQL["groups"] = """groups AS (
  SELECT conv_id AS group_id, CAST(turn AS INTEGER) AS pos, conv_id % 50 * 10 + length(text) % 10 AS media_id, CAST(1 + turn % 2 AS INTEGER) AS type,
    role || '/d' || (conv_id % 3) || '/t' || (length(text) % 10) || '.png' AS path, CAST(length(text) AS INTEGER) AS width,
    CAST(1 + turn % 3 AS INTEGER) AS height, CAST(strlen(text) AS BIGINT) AS file_size, md5(text[1:4]) AS md5, CAST(length(text) % 12 AS INTEGER) AS score
  FROM conversations)"""


def web_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from page URLs; every seventh stands for an archive member."""
    plain = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    path = F.when(F.col("page_id") % 7 == 0, F.regexp_replace(plain, r"^([^/]*)/", "$1/set.zip:in/")).otherwise(plain)
    path = F.concat(path, F.when(F.col("page_id") % 5 == 0, ".tar.gz").when(F.col("page_id") % 5 == 1, ".PNG").otherwise(""))
    return table(spark, sf_dir, "pages").select((F.col("page_id") + 1).alias("id"), (1 + F.col("page_id") % 2).cast("int").alias("type"), path.alias("path"), F.octet_length("html").cast("long").alias("length"), F.expr("timestamp_seconds(1704067200 + page_id * 3600)").alias("modified"))


SQL["web_media"] = r"""web_media AS (
  SELECT id, type, CASE WHEN (id - 1) % 7 = 0 THEN regexp_replace(p, '^([^/]*)/', '\1/set.zip:in/') ELSE p END ||
    CASE WHEN (id - 1) % 5 = 0 THEN '.tar.gz' WHEN (id - 1) % 5 = 1 THEN '.PNG' ELSE '' END AS path, length, modified
  FROM (SELECT page_id + 1 AS id, CAST(1 + page_id % 2 AS INTEGER) AS type, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p,
    CAST(strlen(html) AS BIGINT) AS length, TIMESTAMP '2024-01-01' + to_seconds(page_id * 3600) AS modified FROM pages))"""


def events_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, type, modified, meta)`` from ``events``: the JSON properties as a map."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") + 1).alias("id"), "event_type", F.col("ts").alias("modified"), F.from_json("props", "map<string,string>").alias("meta"), "value", "props")


def weeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(weed_md5, orig_md5)``: of items with one length in a source the later is a weed of the first; some broken."""
    m = media(spark, sf_dir)
    first = F.first_value("md5").over(Window.partitionBy("width", "height").orderBy("id"))
    rows = m.select("id", "md5", first.alias("orig")).where("md5 <> orig and id % 3 = 0")
    rows = rows.groupBy(F.col("md5").alias("weed_md5")).agg(F.min("orig").alias("orig_md5"))
    return rows.select("weed_md5", F.when(F.col("weed_md5") < "2", F.md5(F.col("orig_md5").cast("binary"))).otherwise(F.col("orig_md5")).alias("orig_md5"))


SQL["weeds"] = """weeds AS (
  SELECT weed_md5, CASE WHEN weed_md5 < '2' THEN md5(orig) ELSE orig END AS orig_md5 FROM (
    SELECT md5 AS weed_md5, min(orig) AS orig FROM (SELECT id, md5, first_value(md5) OVER (PARTITION BY width, height ORDER BY id) AS orig FROM media)
    WHERE md5 <> orig AND id % 3 = 0 GROUP BY md5))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path, width, height, channels, data)``: each vector as a colour picture of 128 by 152 pixels.

    Its 64 components are fields of 16 by 16 pixels; the three channels hold the components of a field and those 21 and 42
    further on. Above and below are black bars of 12 lines. A picture is over 200 times as large as its vector, so the vectors
    are dealt to all tasks before.
    """
    level = "lpad(hex(cast(64 + greatest(0D, least(191D, floor((cast(x as double) + 0.5D) * 192D))) as int)), 2, '0')"
    field = "repeat(concat(v[8 * y + x], v[(8 * y + x + 21) % 64], v[(8 * y + x + 42) % 64]), 16)"
    lines = f"transform(sequence(0, 7), y -> repeat(array_join(transform(sequence(0, 7), x -> {field}), ''), 16))"
    bar = F.lit("000000" * (128 * 12))
    path = F.concat(F.lit("vec"), F.col("vec_id").cast("string"), F.lit(".png"))
    dealt = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition(max(partitions(spark), spark.sparkContext.defaultParallelism))
    rows = dealt.select(path.alias("path"), F.expr(f"transform(embedding, x -> {level})").alias("v"))
    data = F.unhex(F.concat(bar, F.array_join(F.expr(lines), ""), bar))
    return rows.select("path", F.lit(128).alias("width"), F.lit(152).alias("height"), F.lit(3).alias("channels"), data.alias("data"))


SQL["levels"] = """levels AS (
  SELECT path, list_transform(range(0, 64), lambda i: 114 * l[i + 1] + 587 * l[(i + 21) % 64 + 1] + 299 * l[(i + 42) % 64 + 1]) AS v
  FROM (SELECT 'vec' || vec_id || '.png' AS path, list_transform(embedding, lambda x: 64 + CAST(greatest(0, least(191, floor((CAST(x AS DOUBLE) + 0.5) * 192))) AS BIGINT)) AS l FROM embeddings))"""
