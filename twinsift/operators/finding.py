"""One call from search parameters to groups: search, best matches, group filters, merged or expanded groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.expr import at_least
from twinsift.operators import groups, similar
from twinsift.params import SearchParams
from twinsift.stash import Stash


def matches(params: SearchParams, media: DataFrame, needles: DataFrame | None = None, data: DataFrame | None = None, mirrored: DataFrame | None = None) -> DataFrame:
    """``(needle, media_id, score, pos)``: the ``mm`` best matches by the parameters' algorithm.

    ``needles(needle)`` names the items to search for, all of ``media`` without it. ``data`` holds the features,
    descriptors, palettes or frames of the items, which the ``dct`` algorithm does not need. With ``refl`` the hashes
    ``mirrored(needle, flip, hash)`` of the asked reflections are searched for too (``dct`` only), and a match
    takes the best of its scores; flips other than those asked for and null or zero hashes meet nothing.
    """
    flips = params.flips()
    if flips and (params.alg != "dct" or mirrored is None):
        raise ValueError("reflections need the dct algorithm and the mirrored hashes")
    if params.alg == "dct":
        if needles is None and not params.mt and params.fs and not flips:
            classes = similar.hash_classes(media)
            return similar.best_matches(media, similar.class_links(classes, params.dht), classes, params.mm)
        own = media.select(F.col("id").alias("needle"), F.col("phash").alias("hash"))
        own = own if needles is None else own.join(needles, "needle", "left_semi")
        if params.mt:
            found = similar.adaptive(own, media, params.dht, params.mt, params.mn)
        else:
            found = similar.search(own, media, params.dht)
        if flips:
            more = mirrored.where(F.col("flip").isin(flips)).select("needle", "flip", "hash").join(own.select("needle"), "needle", "left_semi")
            more = similar.reflected(more, media, params.dht).select("needle", "media_id", "score")
            found = found.select("needle", "media_id", "score").unionByName(more).groupBy("needle", "media_id").agg(F.min("score").alias("score"))
        return similar.top_matches(found, params.mm, params.fs)
    if data is None:
        raise ValueError(f"{params.alg} needs the items' data")
    own = data if needles is None else data.join(needles.withColumnRenamed("needle", "media_id"), "media_id", "left_semi")
    if params.alg == "color":
        return similar.colour_nearest(own, data, params.mm, filter_self=params.fs)
    first = params.odt if params.alg == "orb" else params.dht
    videos = {"edge": params.vtrim, "least_frames": params.vfm, "percent": params.vfn, "bits": params.vradix} if params.alg == "video" else {}
    last = max(first, params.mt or first)
    found = similar.widened(own.withColumnRenamed("media_id", "needle"), params.alg, data, first, last, params.mn, **videos)
    return similar.top_matches(found.select("needle", "media_id", "score"), params.mm, params.fs)


def _verified(best: DataFrame, media: DataFrame, threshold: int, scores: DataFrame | None, scorer: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    """Matches that pass the verification, with its scores and in their order; those without a digest do not pass."""
    if scores is None and scorer is None:
        raise ValueError("verification needs scores or a scorer")
    if scores is None:
        scores = media.sparkSession.createDataFrame([], "md5_a string, md5_b string, score int")
    best = Stash(media.sparkSession).put(best, "matches")
    digests = media.select("id", "md5")
    pairs = best.join(digests.toDF("needle", "md5_n"), "needle").join(digests.toDF("media_id", "md5_m"), "media_id")
    passed = similar.verify_pairs(pairs, scores, threshold, scorer).select("needle", "media_id", "score")
    place = F.row_number().over(Window.partitionBy("needle").orderBy("score", "pos"))
    return passed.join(best.drop("score"), ["needle", "media_id"]).withColumn("pos", place)


def similar_groups(
    params: SearchParams,
    media: DataFrame,
    needles: DataFrame | None = None,
    data: DataFrame | None = None,
    negative: DataFrame | None = None,
    weeds: DataFrame | None = None,
    mirrored: DataFrame | None = None,
    scores: DataFrame | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``(group_id, pos, media_id, score, path, md5, weed)``: a group per needle, itself at ``pos`` 0, then its matches.

    ``media(id, type, path, md5, phash)`` is cut to the result types first. With ``tm`` matches must pass
    :func:`similar.verify_pairs` below ``tdht``, by known ``scores(md5_a, md5_b, score)``, a ``scorer`` or both. Then follow, each if it is asked for: rejected
    pairs ``negative(md5_a, md5_b)`` go; ``weed`` marks the digests of ``weeds(weed_md5)``; matches outside (or inside)
    ``path`` go, and those in the needle's directory; groups of fewer than ``mn`` matches go; of groups with the same
    members one stays. With ``mg`` the result is that of :func:`groups.merge`, with ``eg`` of :func:`groups.expand`.
    """
    usable = media.where(F.col("type").bitwiseAND(F.lit(params.result_types())) != 0)
    best = matches(params, usable, needles, data, mirrored)
    if params.tm:
        best = _verified(best, usable, params.tdht, scores, scorer)
    rows = best.select(F.col("needle").alias("group_id"), "media_id", F.col("score").cast("long").alias("score"), "pos")
    heads = rows.select("group_id", F.col("group_id").alias("media_id"), F.lit(0).cast("long").alias("score"), F.lit(0).alias("pos")).distinct()
    rows = heads.unionByName(rows).join(usable.select(F.col("id").alias("media_id"), "path", "md5").hint("merge"), "media_id")  # a row for every item, see best_matches
    if params.neg and negative is not None:
        rows = groups.drop_negative(rows, negative)
    marked = F.lit(False)
    if weeds is not None:
        rows = rows.join(weeds.select(F.col("weed_md5").alias("md5"), F.lit(True).alias("_weed")).distinct().hint("merge"), "md5", "left")
        marked = F.coalesce("_weed", F.lit(False))
    rows = rows.withColumn("weed", marked)
    if params.path:
        rows = groups.by_path_prefix(rows, params.path, params.in_path)
    if params.fp:
        rows = groups.not_beside_needle(rows, F.regexp_extract("path", "^(.*)/", 1))
    rows = at_least(rows, "group_id", params.mn + 1)
    if params.fg:
        rows = groups.dedupe(rows)
    if params.mg:
        return groups.merge(rows)
    if params.eg:
        return groups.expand(rows)
    nth = F.row_number().over(groups.in_order()) - 1
    return rows.select("group_id", nth.alias("pos"), "media_id", "score", "path", "md5", "weed")
