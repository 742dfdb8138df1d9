"""Remembered deletions (weeds) and rejected matches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.functions.props import is_archived
from twinsift.stash import Stash


def add_weeds(candidates: DataFrame, weeds: DataFrame, media: DataFrame) -> DataFrame:
    """``(weed_md5, orig_md5, reason)`` of the distinct candidates; ``reason`` is null for accepted ones.

    Both digests must be in the catalog, differ and be of one type; a weed keeps its original; an original is
    not itself a weed. Candidates are taken in the order of both digests, and each meets what was accepted before it.
    """
    kinds = media.where("md5 <> ''").groupBy("md5").agg(F.min("type").alias("kind"))
    c = candidates.select("weed_md5", "orig_md5").distinct()
    c = c.join(kinds.select(F.col("md5").alias("weed_md5"), F.col("kind").alias("wk")), "weed_md5", "left")
    c = c.join(kinds.select(F.col("md5").alias("orig_md5"), F.col("kind").alias("ok")), "orig_md5", "left")
    c = c.join(weeds.select("weed_md5", F.col("orig_md5").alias("had")), "weed_md5", "left")
    c = c.join(weeds.select(F.col("weed_md5").alias("orig_md5"), F.lit(True).alias("bad")), "orig_md5", "left")
    reason = (
        F.when(F.col("wk").isNull() | F.col("ok").isNull(), "missing")
        .when(F.col("weed_md5") == F.col("orig_md5"), "same")
        .when(F.col("wk") != F.col("ok"), "type")
        .when(F.col("had").isNotNull() & (F.col("had") != F.col("orig_md5")), "changed")
    )
    stash = Stash(candidates.sparkSession)
    judged = stash.put(c.select("weed_md5", "orig_md5", reason.alias("reason"), F.col("had").isNotNull().alias("known"), F.coalesce("bad", F.lit(False)).alias("listed")), "judged")
    open_ = judged.where("reason is null and not known").select("weed_md5", "orig_md5", "listed")
    return judged.where("reason is not null or known").drop("known", "listed").unionByName(_settle(open_, stash))


def _settle(open_: DataFrame, stash: Stash) -> DataFrame:
    """Decides candidates that depend on each other only, as if one after the other.

    A weed gets in by its first original that is no weed itself, so only originals that come before it as weeds matter:
    it gets in if one of them does not. Such terms ``(weed, target, flip)`` are decided by pointer jumping: a term on a
    weed with one term of its own takes over that one's target, so each round halves what is left of a chain. Rounds are the
    logarithm of the longest chain, times the depth of weeds that hang on several others at once.
    """
    c = open_.select("weed_md5", "orig_md5", "listed")
    weeds = c.select(F.col("weed_md5").alias("orig_md5"), F.lit(True).alias("waits")).distinct()
    waits = F.coalesce("waits", F.lit(False)) & (F.col("orig_md5") < F.col("weed_md5"))
    rows = stash.put(c.join(weeds, "orig_md5", "left").select("weed_md5", "orig_md5", "listed", waits.alias("waits")), "candidates")
    terms = rows.select(
        F.col("weed_md5").alias("weed"),
        F.when(F.col("waits") & ~F.col("listed"), F.col("orig_md5")).alias("target"),
        F.when(F.col("waits") & ~F.col("listed"), True).alias("flip"),
        F.when(~F.col("waits") | F.col("listed"), ~F.col("listed")).alias("value"),
    )
    terms = stash.put(_reduce(terms), "terms")
    while terms.where("target is not null").limit(1).count():
        one = terms.groupBy(F.col("weed").alias("target")).agg(F.count(F.lit(1)).alias("n"), *(F.first(x).alias(f"to_{x}") for x in ("target", "flip", "value")))
        met = terms.where("target is not null").join(one.where("n = 1"), "target", "left")
        jump = F.col("to_target").isNotNull()
        met = met.select(
            "weed",
            F.when(jump, F.col("to_target")).when(F.col("to_value").isNull(), F.col("target")).alias("target"),
            F.when(jump, F.col("flip") != F.col("to_flip")).when(F.col("to_value").isNull(), F.col("flip")).alias("flip"),
            (F.col("to_value") != F.col("flip")).alias("value"),
        )
        last, terms = terms, stash.put(_reduce(met.unionByName(terms.where("target is null"))), "terms")
        stash.drop(last)
    got_in = terms.select(F.col("weed").alias("orig_md5"), F.col("value").alias("gone"))
    judged = rows.join(got_in, "orig_md5", "left").withColumn("bad", F.col("listed") | (F.col("waits") & F.coalesce("gone", F.lit(False))))
    first = judged.where("not bad").groupBy("weed_md5").agg(F.min("orig_md5").alias("first"))
    reason = F.when(F.col("orig_md5") > F.col("first"), "changed").when(F.col("bad"), "original is a weed")
    return judged.join(first, "weed_md5", "left").select("weed_md5", "orig_md5", reason.alias("reason"))


def _reduce(terms: DataFrame) -> DataFrame:
    """One row ``(weed, null, null, value)`` for each decided weed, the distinct open terms for all others.

    A weed is in if a term is true or two are opposite; it is out if all its terms are false.
    """
    pairs = terms.groupBy("weed", "target").agg(F.min("flip").alias("flip"), F.max("flip").alias("most"), F.max("value").alias("value"))
    true = F.coalesce("value", F.lit(False)) | (F.col("target").isNotNull() & (F.col("flip") != F.col("most")))
    state = pairs.groupBy("weed").agg(F.max(true).alias("true"), F.count("target").alias("left"))
    state = state.withColumn("decided", F.when(F.col("true"), True).when(F.col("left") == 0, False))
    none = F.lit(None)
    done = state.where("decided is not null").select("weed", none.cast("string").alias("target"), none.cast("boolean").alias("flip"), F.col("decided").alias("value"))
    going = pairs.where("target is not null").join(state.where("decided is null").select("weed"), "weed", "left_semi")
    return done.unionByName(going.select("weed", "target", "flip", none.cast("boolean").alias("value")))


def weed_flag(media: DataFrame, weeds: DataFrame) -> DataFrame:
    """``(id, is_weed)``: the digest is a weed whose original is in the catalog."""
    present = media.select(F.col("md5").alias("orig_md5")).distinct()
    live = weeds.join(present, "orig_md5", "left_semi").select(F.col("weed_md5").alias("md5"), F.lit(True).alias("w")).distinct()
    return media.join(live, "md5", "left").select("id", F.coalesce("w", F.lit(False)).alias("is_weed"))


def weed_list(media: DataFrame, weeds: DataFrame) -> DataFrame:
    """``(weed_id, orig_id)``: items that are weeds, each with the item of smallest path that has the original's digest."""
    first = media.groupBy(F.col("md5").alias("orig_md5")).agg(F.min_by("id", F.struct("path", "id")).alias("orig_id"))
    return weeds.join(first, "orig_md5").join(media.select(F.col("md5").alias("weed_md5"), F.col("id").alias("weed_id")), "weed_md5").select("weed_id", "orig_id")


def forget_weeds(weeds: DataFrame, digests: DataFrame) -> DataFrame:
    return weeds.join(digests.select(F.col("md5").alias("weed_md5")), "weed_md5", "left_anti")


def broken_weeds(media: DataFrame, weeds: DataFrame) -> DataFrame:
    """Weeds whose original is no longer in the catalog."""
    return weeds.join(media.select(F.col("md5").alias("orig_md5")), "orig_md5", "left_anti")


def add_negative(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """New rejected pairs ``(md5_a, md5_b)`` in one order, without empty, equal or known ones."""
    order = lambda df: df.select(F.least("md5_a", "md5_b").alias("md5_a"), F.greatest("md5_a", "md5_b").alias("md5_b"))
    fresh = order(pairs.where("md5_a <> '' and md5_b <> '' and md5_a <> md5_b")).distinct()
    return fresh.join(order(known), ["md5_a", "md5_b"], "left_anti")


def weeds_from_pairs(decisions: DataFrame, media: DataFrame) -> DataFrame:
    """Weed candidates of reviewed pairs ``(group_id, keep_id, delete_id)``; groups of two without archive members."""
    lone = decisions.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.first("keep_id").alias("keep_id"), F.first("delete_id").alias("delete_id")).where("n = 1")
    files = media.where(~is_archived()).select("id", "md5")
    keep = files.select(F.col("id").alias("keep_id"), F.col("md5").alias("orig_md5"))
    gone = files.select(F.col("id").alias("delete_id"), F.col("md5").alias("weed_md5"))
    return lone.join(keep, "keep_id").join(gone, "delete_id").where("weed_md5 <> orig_md5").select("weed_md5", "orig_md5").distinct()
