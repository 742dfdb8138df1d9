"""Plans of moves and renames."""

from __future__ import annotations

import re
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinsift.functions.props import complete_base_name, container, dir_path, expression, is_archived, suffix
from twinsift.functions.scalar import apply_chain
from twinsift.operators.sorting import number_rows
from twinsift.stash import Stash


def move_prefix(media: DataFrame, old: str, new: str) -> DataFrame:
    """``(id, path, new_path, conflict)`` of items under a directory or archive that moves; members follow."""
    under = F.col("path").startswith(old + "/") | F.col("path").startswith(old + ":")
    moved = media.where(under).select("id", "path", F.concat(F.lit(new), F.substr("path", F.lit(len(old) + 1))).alias("new_path"))
    there = media.where(~under).select(F.col("path").alias("new_path"), F.lit(True).alias("taken"))
    return moved.join(there, "new_path", "left").select("id", "path", "new_path", F.coalesce("taken", F.lit(False)).alias("conflict"))


def move_to(items: DataFrame, media: DataFrame, directory: str) -> DataFrame:
    """``(path, new_path, conflict)``: files keep their names under ``directory``; archives move once."""
    files = items.select(container().alias("path")).distinct()
    target = F.concat(F.lit(directory.rstrip("/") + "/"), F.substring_index("path", "/", -1))
    rows = files.select("path", target.alias("new_path"))
    same = F.count(F.lit(1)).over(Window.partitionBy("new_path"))
    there = media.select(container().alias("new_path"), F.lit(True).alias("taken")).distinct()
    rows = rows.withColumn("n", same).join(there, "new_path", "left")
    return rows.select("path", "new_path", (F.coalesce("taken", F.lit(False)) | (F.col("n") > 1)).alias("conflict"))


def _fill(template: str, base: Column, pattern: str | None) -> Column:
    """A new base name: ``#n`` captures, ``{arg:func}`` and ``{prop#func}``, ``%n`` for a later number."""
    parts: list[Column] = []
    for piece in re.split(r"(#\d|\{[^}]*\})", template):
        if re.fullmatch(r"#\d", piece):
            parts.append(F.regexp_extract(base, pattern or "(.*)", int(piece[1])))
        elif piece.startswith("{") and ":" in piece:
            arg, func = piece[1:-1].split(":", 1)
            value = F.regexp_extract(base, pattern or "(.*)", int(arg[1])) if re.fullmatch(r"#\d", arg) else F.lit(arg)
            parts.append(apply_chain(value, func.split("#")).cast("string"))
        elif piece.startswith("{"):
            parts.append(expression(piece[1:-1]).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _taken_numbers(rows: DataFrame, there: DataFrame, digits: int) -> DataFrame:
    """``(plain, path, t)``: the numbers with which a target of ``rows`` is a path that exists, by hash joins.

    Every stretch of ``digits`` digits of a path may be a number, and so may the first and the last of two equal ones;
    what stands before the first and after the last is the key.
    """
    digit = f"substr(path, i, {digits})"
    paths = there.where(F.length("path") >= digits).withColumn("at", F.expr(f"filter(sequence(1, length(path) - {digits} + 1), i -> {digit} rlike '^[0-9]+$')"))
    both = f"filter(at, j -> j = i or (j >= i + {digits} and substr(path, j, {digits}) = {digit}))"
    spots = paths.select("path", F.inline(F.expr(f"flatten(transform(at, i -> transform({both}, j -> struct(i as i, j as j))))")))
    spots = spots.select("path", F.expr("substr(path, 1, i - 1)").alias("before"), F.expr(f"substr(path, j + {digits})").alias("after"), (F.col("j") > F.col("i")).alias("many"), F.expr(digit).alias("number"))
    shapes = rows.select("plain").distinct()
    shapes = shapes.select("plain", F.substring_index("plain", "%n", 1).alias("before"), F.substring_index("plain", "%n", -1).alias("after"), (F.size(F.split("plain", "%n")) > 2).alias("many"))
    met = shapes.join(spots, ["before", "after", "many"]).where(F.replace("plain", F.lit("%n"), F.col("number")) == F.col("path"))
    return met.select("plain", "path", F.col("number").cast("long").alias("t"))


def _numbered(rows: DataFrame, there: DataFrame, digits: int, stash: Stash, block: int = 200_000) -> DataFrame:
    """Adds ``new_path`` with a number for ``%n``; a row whose target exists takes none, and the next tries it again.

    The number of row i is i + 1 less the rows refused before it, so only refused rows have to be found. Rows whose
    target never exists with any number cannot be refused. The others are walked in order by blocks of ``block`` rows,
    one after the other, each in a task that holds the taken numbers its rows can reach; blocks without such rows
    are left out. The jobs follow from the number of blocks, not from the taken targets. One sum over each block then
    numbers all rows.
    """
    there = there.select(F.col("new_path").alias("path"))
    going = stash.put(number_rows(rows.where(~F.col("skip")), [F.col("pos"), F.col("id")], "i").withColumn("block", F.floor(F.col("i") / block)), "going")
    taken = stash.put(_taken_numbers(going, there, digits), "taken")
    at_risk = going.select("block", "i", "path", "plain").join(taken.select("plain").distinct(), "plain", "left_semi")
    at_risk = at_risk.join(taken.withColumnRenamed("t", "own"), ["plain", "path"], "left").select("block", "i", "plain", "own")
    at_risk = stash.put(at_risk.repartitionByRange("i").sortWithinPartitions("i"), "at_risk")
    refused, lost, found = 0, {}, None
    for (b,) in sorted(at_risk.select("block").distinct().collect()):
        least = b * block + 1 - refused
        part = at_risk.where(F.col("block") == b)
        near = taken.where(F.col("t").between(least, least + block)).join(part.select("plain"), "plain", "left_semi")
        near = near.select(F.lit(b).alias("block"), "plain", "t")
        out = part.groupBy("block").cogroup(near.groupBy("block")).applyInPandas(_walk(refused), "block long, i long")
        out = stash.put(out, "refused")
        found = out if found is None else found.unionByName(out)
        lost[b] = out.count()
        refused += lost[b]
    nth = going.withColumn("nth", F.col("i") + 1)
    if refused:
        blocks = range(max(lost) + 1)
        bases = list(zip(blocks, accumulate((lost.get(b, 0) for b in blocks), initial=0)))
        bases.append((len(blocks), refused))
        bases = going.sparkSession.createDataFrame(bases, "base_block long, base long")
        same = F.least(F.col("block"), F.lit(len(blocks))) == F.col("base_block")
        before = F.sum("gone").over(Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, -1))
        nth = nth.join(found.select("i", F.lit(1).alias("gone")), "i", "left").join(F.broadcast(bases), same)
        nth = nth.withColumn("nth", F.col("nth") - F.col("base") - F.coalesce(before, F.lit(0)))
    path = F.replace("plain", F.lit("%n"), F.lpad(F.col("nth").cast("string"), digits, F.lit("0")))
    skipped = rows.where("skip").withColumn("new_path", F.lit(None).cast("string"))
    return skipped.unionByName(nth.withColumn("new_path", path).select(*rows.columns, "new_path"))


def _walk(refused: int):
    """Finds the refused rows of a block, of which ``refused`` rows were refused before it."""

    def walk(rows: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        taken = set(zip(near["plain"], near["t"]))
        rows = rows.sort_values("i")
        gone, out = refused, []
        for i, plain, own in zip(rows["i"].tolist(), rows["plain"], rows["own"].fillna(-1).tolist()):
            n = i + 1 - gone
            if n != own and (plain, n) in taken:
                gone += 1
                out.append(i)
        return pd.DataFrame({"block": rows["block"].iloc[0] if len(rows) else 0, "i": out}, columns=["block", "i"]).astype("int64")

    return walk


def rename_plan(items: DataFrame, media: DataFrame, template: str, pattern: str | None = None, find: str | None = None) -> DataFrame:
    """``(id, path, new_path, status)``: a preview of renames in the order of ``pos``; nothing is touched.

    With ``find`` the text is replaced by the template in the base name, else the template gives the whole base
    name from the pattern's captures. The suffix stays. Archive members, names without suffix and names
    that the pattern does not fit are skipped. Targets that exist are refused; of several items with one target the first
    takes it and the others are refused. Refused items take no number from the ``%n`` sequence. A new name with a
    ``/`` is an error when the row is read.
    """
    base = complete_base_name()
    if find is not None:
        filled, fits = F.replace(base, F.lit(find), F.lit(template)), base.contains(find)
    else:
        filled, fits = _fill(template, base, pattern), base.rlike(f"^(?:{pattern})$") if pattern else F.lit(True)
    folder = F.when(dir_path() != "", F.concat(dir_path(), F.lit("/"))).otherwise("")
    skip = is_archived() | (suffix() == "") | ~fits
    rows = items.select("id", "path", "pos", skip.alias("skip"), filled.alias("stem"), folder.alias("folder"), suffix().alias("ext"))
    numbered = "%n" in template
    plain = F.concat("folder", "stem", F.lit("."), "ext")
    bad = F.raise_error(F.concat(F.lit("a new name has a slash: "), "stem"))
    rows = rows.withColumn("plain", F.when(~F.col("skip"), F.when(F.locate("/", F.col("stem")) > 0, bad).otherwise(plain)))
    there = media.select(F.col("path").alias("new_path"), F.lit(True).alias("taken")).distinct()
    if not numbered:
        rows = rows.withColumn("new_path", F.col("plain"))
    else:
        rows = _numbered(rows, there, len(str(items.count())), Stash(media.sparkSession))
    first = rows.where("new_path is not null").groupBy("new_path").agg(F.min(F.struct("pos", "id")).alias("first"))
    rows = rows.join(first, "new_path", "left").join(there, "new_path", "left")
    status = F.when(F.col("skip"), "skipped").when(F.col("path") == F.col("new_path"), "unchanged")
    status = status.when(F.col("taken"), "exists").when(F.struct("pos", "id") != F.col("first"), "collision").otherwise("ok")
    return rows.select("id", "path", F.when(~F.col("skip"), F.col("new_path")).alias("new_path"), status.alias("status"))
