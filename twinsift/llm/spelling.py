"""Spelling variants: words of a corpus that one edit takes into another, found by blocked Gram matrices.

One edit changes at most two letter counts by one, so the count vectors of near words have a squared distance of 1
(one letter more) or 2 (one letter for another). Words are laid out in cells of equal length and equal counts of a few
groups of letters. Only cells that one edit can lead to meet: those of the same and of the next length. Cells are cut
into blocks of bounded size, a task multiplies the count matrices of two blocks, and pairs at most two apart are
verified letter by letter.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import slices
from twinsift.stash import Stash

#: Class of the characters that words are made of.
LETTERS = r"[A-Za-zÀ-ÿ]"
#: Words of a block, about, and different words a task counts before it hands them on.
BLOCK, COUNTED = 512, 200_000
#: Rows of two blocks that a task holds as arrays at a time.
ROWS = 32
#: Words for which one more group of letters pays, as a power: cells get smaller by about this factor with each group.
FINER, MOST_GROUPS = 3.0, 12
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def count_words(
    docs: DataFrame, least_length: int = 5, id_col: str = "doc_id", text_col: str = "text", letters: str = LETTERS, typo_every: int = 97
) -> DataFrame:
    """``(word, n)`` of all documents: maximal runs of ``letters`` in whole texts, A-Z in lower case, of ``least_length`` at least.

    Where ``typo_every`` divides the crc32 of ``<id>:<run>``, the run loses a letter first (0: never). A null id is
    written as no characters; null texts have no words; repeated rows count each time. Tasks count before they send.
    """
    runs = re.compile(f"{letters}{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])
            n.clear()
            return out

        for batch in slices(batches, 256):
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for word, times in Counter(runs.findall(text or "")).items():
                    word = word.translate(_LOWER)
                    if typo_every and (h := zlib.crc32(f"{doc}:{word}".encode())) % typo_every == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    n[word] += times
                if len(n) >= COUNTED:
                    yield flush()
        if n:
            yield flush()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """Letters of the words in so many groups that are about equally frequent; at most one letter of an alphabet each."""
    letters = F.explode(F.array_distinct(F.split("word", "")))
    found = words.select(letters.alias("c")).where(F.col("c") != "").groupBy("c").count().orderBy(F.desc("count"), "c").limit(1000).collect()
    out, load = [""] * groups, [0] * groups
    for r in found:
        k = load.index(min(load))
        out[k] += r.c
        load[k] += r["count"]
    return out


def _counts(groups: list[str]) -> Column:
    """Length, then the number of letters of each group but the last, which the others leave."""
    size = F.length("word")
    inside = [size - F.length(F.translate("word", g, "")) for g in groups[:-1]]
    return F.array(size.cast("int"), *(c.cast("int") for c in inside))


def _beside(groups: int) -> list[list[int]]:
    """Steps from a cell to those that one edit leads to: each pair of different cells is met from one of them only."""
    unit = [[int(i == k) for k in range(groups)] for i in range(groups)]
    steps = [[0] * groups]
    steps += [[0, *(a - b for a, b in zip(unit[i], unit[j]))][: groups] for i in range(groups) for j in range(i)]
    return steps + [[1, *unit[i]][: groups] for i in range(groups)]


class _Spelled:
    """Words of any lengths as codes of their letters, one after the other, with their letter counts and squared norms."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.sizes) - self.sizes
        alphabet = np.flatnonzero(np.bincount(self.codes))
        place = np.zeros(alphabet[-1] + 1 if len(alphabet) else 1, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        kind = np.float32 if self.sizes.max(initial=0) < 2000 else np.float64  # products stay whole numbers
        flat = np.repeat(np.arange(len(words)) * len(alphabet), self.sizes) + place[self.codes]
        self.counts = np.bincount(flat, minlength=len(words) * len(alphabet)).reshape(len(words), -1).astype(kind)
        self.norms = (self.counts * self.counts).sum(1)

    def letters(self, rows: np.ndarray, size: int) -> np.ndarray:
        return self.codes[self.starts[rows][:, None] + np.arange(size)]

    def near(self, a: slice, b: slice) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are one edit apart, of two blocks of words of one length each, ``b`` not the shorter; or of one with itself.

        Gram matrices of the letter counts give squared distances. A pair of equal lengths is kept at 2, one of
        adjacent lengths at 1, then compared letter by letter.
        """
        if a.start == a.stop or b.start == b.stop:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m, n = int(self.sizes[a.start]), int(self.sizes[b.start])
        apart = self.counts[a] @ self.counts[b].T
        apart *= -2
        apart += self.norms[a, None]
        apart += self.norms[b]
        at = np.flatnonzero(apart == (2 if m == n else 1))
        i, j = at // apart.shape[1] + a.start, at % apart.shape[1] + b.start
        if a == b:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return i, j
        keep = []
        step = max(1, 4_000_000 // n)
        for at in range(0, len(i), step):
            u, v = self.letters(i[at : at + step], m), self.letters(j[at : at + step], n)
            if m == n:
                keep.append((u != v).sum(1) == 1)
            else:
                before = np.logical_and.accumulate(u == v[:, :-1], 1).sum(1)
                after = np.logical_and.accumulate((u == v[:, 1:])[:, ::-1], 1).sum(1)
                keep.append(before + after >= m)
        good = np.concatenate(keep)
        return i[good], j[good]


def near_in_blocks(a: list[str], b: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs that are one edit apart, of words of one length each, ``b`` not the shorter; ``None``: inside ``a``."""
    left = slice(0, len(a))
    i, j = _Spelled(a + (b or [])).near(left, left if b is None else slice(len(a), len(a) + len(b)))
    return i, j if b is None else j - len(a)


def near_of_rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """``(word, near, near_n)``, both ways, of rows of two blocks ``(word, n)`` each, the second null for one with itself.

    Letters of all words of the batch are counted at once; a row then costs few array operations, as most blocks are small.
    """
    sides = [c.flatten() for c in batch.columns]
    words, n = (pa.concat_arrays([pc.struct_field(x, k) for x in sides]) for k in ("word", "n"))
    sizes = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in batch.columns]
    ends = np.cumsum(np.concatenate(sizes)).tolist()
    blocks = [slice(start, end) for start, end in zip([0, *ends], ends)]
    own = batch.column(1).is_null().to_pylist()
    spelled = _Spelled(words.to_pylist())
    found = [spelled.near(a, a if alone else b) for a, b, alone in zip(blocks, blocks[batch.num_rows :], own)]
    i, j = (np.concatenate(x) for x in zip(*found))
    if not len(i):
        return None
    u, v = pa.array(np.concatenate([i, j])), pa.array(np.concatenate([j, i]))
    return pa.RecordBatch.from_arrays([words.take(u), words.take(v), n.take(v)], ["word", "near", "near_n"])


def near_words(words: DataFrame, stash: Stash | None = None, block: int = BLOCK) -> DataFrame:
    """``(word, near, near_n)``, both ways, of all pairs of ``words`` ``(word, n)`` that are one edit apart.

    Words must be distinct; null and empty ones have no near words. The number of letter groups follows the number
    of words, so that a word meets about as many others however many there are. A cell of over ``block`` words is cut
    into blocks by a hash; every two blocks that must meet are rows of their own, so no task holds a cell.
    """
    stash = stash or Stash(words.sparkSession)
    words = words.where(F.length("word") > 0)
    rows = words.count()
    groups = max(2, min(MOST_GROUPS, 2 + math.ceil(math.log(max(1.0, rows / (16 * block)), FINER))))
    laid = stash.put(words.select("word", "n", _counts(letter_groups(words, groups)).alias("cell")), "cells")
    cells = laid.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    cells = stash.put(cells, "cell_parts")
    cut = F.broadcast(cells.where("parts > 1"))  # a row for over `block` words
    part = F.pmod(F.xxhash64("word"), F.coalesce("parts", F.lit(1)))
    blocks = laid.join(cut, "cell", "left").select("cell", part.cast("int").alias("part"), F.struct("word", "n").alias("w"))
    blocks = stash.put(blocks.groupBy("cell", "part").agg(F.collect_list("w").alias("ws")), "blocks")

    steps = F.array(*(F.array(*map(F.lit, s)) for s in _beside(groups)))
    to = cells.select("cell", "parts", F.explode(steps).alias("step"))
    to = to.withColumn("other", F.zip_with("cell", "step", lambda c, s: c + s))
    other = cells.select(F.col("cell").alias("other"), F.col("parts").alias("other_parts"))
    met = to.join(other, "other").select("cell", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "other_parts")
    met = met.select("cell", "other", "part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)).alias("other_part"))
    met = met.where((F.col("cell") != F.col("other")) | (F.col("part") <= F.col("other_part")))
    second = blocks.select(F.col("cell").alias("other"), F.col("part").alias("other_part"), F.col("ws").alias("other_ws"))
    met = met.join(blocks, ["cell", "part"]).join(second, ["other", "other_part"])
    same = (F.col("cell") == F.col("other")) & (F.col("part") == F.col("other_part"))
    met = met.select("ws", F.when(~same, F.col("other_ws")).alias("other_ws"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            out = near_of_rows(batch) if batch.num_rows else None
            if out is not None:
                yield out

    return met.mapInArrow(run, "word string, near string, near_n long")


def roots(forms: DataFrame, stash: Stash) -> DataFrame:
    """``(word, root)`` of the words with a form: forms are followed to the last by doubling the steps.

    A form is at least twice as frequent as its word, so chains end and are short; rounds are their logarithm.
    """
    ahead = stash.put(forms.select("word", F.col("form").alias("root")), "ahead")
    while True:
        beyond = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        both = ahead.join(beyond, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        both = stash.put(both, "ahead")
        ahead = both.drop("moved")
        if both.where("moved").isEmpty():
            return ahead


def variants(
    docs: DataFrame,
    least_length: int = 5,
    least_count: int = 3,
    times: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    typo_every: int = 97,
) -> DataFrame:
    """Words of a corpus with their near words, forms and roots.

    Columns ``word, form, root, n, n_near, form_n``: words of ``least_length`` letters and ``least_count``
    occurrences, one row each. ``form`` is the most frequent near word (ties: the first in code-point order) if it is
    ``times`` times as frequent, else null; ``root`` follows forms to the last and is the word itself without a form.
    Null and empty texts have no words, an empty table gives no rows, other columns are not read.
    """
    stash = Stash(docs.sparkSession)
    words = stash.put(count_words(docs, least_length, id_col, text_col, typo_every=typo_every).where(F.col("n") >= least_count), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near")))
    near = near_words(words, stash).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    found = words.join(near, "word", "left")
    fits = -F.col("best.m") >= times * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.m")).alias("form_n")
    )
    found = stash.put(found, "found")
    last = roots(found.where(F.col("form").isNotNull()), stash)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
