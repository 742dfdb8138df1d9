"""Ordinal cumulative-link regression on graded ratings of texts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import alnum_words, as_bytes, slices
from twinsift.stash import Stash

#: Features are hashed into a fixed space of 2 ** BUCKET_BITS weights; those that share one share its weight.
BUCKET_BITS = 17
UPPER = bytes(range(65, 91))
#: Keeps runs of ASCII punctuation, everything else becomes a space.
PUNCTUATION = bytes(b if 33 <= b <= 126 and not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122) else 32 for b in range(256))
#: Tasks that share the bounded sample of ratings; each sends back one number for every weight.
TASKS = 4
#: Words whose weight a worker keeps at most.
REMEMBER = 400_000


def _share(name: bytes, part: int, whole: int) -> bytes:
    """A share as a word, in steps of halves: none, up to 1/64, ..., up to 1/2, more."""
    return b"%b %d" % (name, 0 if not part else max(1, 8 - int(np.log2(whole / part))) if whole else 0)


def text_features(text: bytes | None) -> set[bytes]:
    """Distinct words and punctuation runs of a whole text, with shares of its form as further words."""
    if not text:
        return {b"empty 0"}
    words, marks = alnum_words(text), text.translate(PUNCTUATION).split()
    lines = text.split(b"\n")
    found = set(words)
    shares = [
        _share(b"upper", len(text) - len(text.translate(None, UPPER)), len(text)),
        _share(b"again", len(words) - len(found), len(words)),
        _share(b"lines", len(lines) - len(set(lines)), len(lines)),
        _share(b"marks", sum(map(len, marks)), len(text)),
        b"size %d" % len(words).bit_length(),
    ]
    for mark in set(marks):
        found.add(mark)
        shares.append(_share(b"mark " + mark[:8], marks.count(mark), max(len(words), len(marks))))
    found.update(shares)
    return found


@dataclass(frozen=True)
class OrdinalModel:
    """``P(grade >= k) = 1 / (1 + exp(cuts[k - 1] - score))`` with one score per text and ascending cuts."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """Column k - 1 is the probability of grade k or more."""
        return 0.5 * (1 + np.tanh(0.5 * (scores[:, None] - self.cuts[None, :])))


def bucket(word: bytes) -> int:
    return zlib.crc32(word) & ((1 << BUCKET_BITS) - 1)


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` from 0/1 labels: 0 toxic, 1 of low quality, 2 good."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select("doc_id", grade.alias("grade"))


def _featurize(rated: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = [sorted({bucket(w) for w in text_features(t)}) for t in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "feats"])

    return rated.select("grade", "text").mapInArrow(run, "grade int, feats array<int>")


def loss_gradient(weights: np.ndarray, cuts: np.ndarray, grades: np.ndarray, at: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """Loss, gradient by weight and gradient by cut of some rows; row i has features ``flat[at[i]:at[i + 1]]``."""
    sums = np.concatenate([[0.0], np.cumsum(weights[flat])])
    score = sums[at[1:]] - sums[at[:-1]]
    edges = np.concatenate([[-np.inf], cuts, [np.inf]])
    hi, lo = edges[grades + 1] - score, edges[grades] - score
    sig = lambda z: 0.5 * (1 + np.tanh(0.5 * z))
    s_hi, s_lo = sig(hi), sig(lo)
    p = np.maximum(s_hi - s_lo, 1e-12)
    d_hi, d_lo = s_hi * (1 - s_hi) / p, s_lo * (1 - s_lo) / p
    by_score = d_hi - d_lo
    by_weight = np.bincount(flat, np.repeat(by_score, np.diff(at)), len(weights))
    by_cut = np.bincount(grades, -d_hi, len(cuts) + 1)[:-1] + np.bincount(grades, d_lo, len(cuts) + 1)[1:]
    return np.concatenate([[-np.log(p).sum()], by_weight, by_cut])


def minimise(f, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with halving steps; ``f`` gives value and gradient."""
    value, grad = f(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            alphas.append(a)
            q -= a * y
        q *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(grad))
        for (s, y), a in zip(past, reversed(alphas)):
            q += s * (a - y @ q / (y @ s))
        step = 1.0
        while True:
            new, new_grad = f(x - step * q)
            if new <= value - 1e-4 * step * (q @ grad) or step < 1e-3:
                break
            step /= 2
        if new >= value:
            break
        s, y = -step * q, new_grad - grad
        x, small = x + s, value - new < 1e-5 * abs(value)
        value, grad = new, new_grad
        if s @ y > 1e-12:
            past = [*past, (s, y)][-memory:]
        if small:
            break
    return x


def _smallest(ratings: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of their id.

    Rows whose hash is too large to be among them are dropped first, so that few rows meet in the last sort.
    """
    n = ratings.count()
    share = min(1.0, 1.1 * most / max(n, 1) + 100 / max(n, 1))
    hashed = ratings.withColumn("h", F.pmod(F.xxhash64("rated_id"), F.lit(1 << 32)))
    few = hashed.where(F.col("h") < int(share * (1 << 32)) + 1)
    return few.orderBy("h", "rated_id", "grade").limit(most).drop("h")


def worth(counts: np.ndarray, told: float) -> np.ndarray:
    """How much each feature tells grades apart, from ``counts(grade, bucket)``: 0 to 1.

    It is the largest chi-square statistic, with Yates's correction, over the cuts between grades, in parts of ``told``.
    """
    n, total = counts.sum(0), counts.sum()
    best = np.zeros(counts.shape[1])
    for k in range(1, len(counts)):
        p = counts[k:].sum() / total
        gap = np.maximum(np.abs(counts[k:].sum(0) - n * p) - 0.5, 0)
        best = np.maximum(best, gap**2 / np.maximum(n * p * (1 - p), 1e-9))
    return np.clip(best / told, 1e-3, 1)


def fit(docs: DataFrame, ratings: DataFrame, grades: int = 3, max_rated: int = 20_000, penalty: float = 0.1, told: float = 15.0, steps: int = 30, id_col: str = "doc_id", text_col: str = "text") -> OrdinalModel:
    """Fits shared weights and ordered cuts on ``ratings(doc_id, grade)``, grades 0 to ``grades - 1``.

    At most ``max_rated`` distinct ratings of documents are used, those with the smallest hash of their id; they are
    sent to the tasks that read ``docs``, so texts are not shuffled. Every feature of these texts has a weight, which
    is scaled by what the feature tells (see :func:`worth`), so that the penalty falls on those that tell little. Counts, loss and gradient are summed over partitions in one job each; only sums, as long as the weights, reach the driver.
    Ratings without a grade in range, without an id or without a document are left out before the draw; repeated
    rows of ``docs`` count each time, its extra columns are ignored; with no ratings at all the model gives every
    text the top grade.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    some = ratings.where(F.col("grade").between(0, grades - 1)).select(F.col("doc_id").alias("rated_id"), F.col("grade").cast("int"))
    rows = docs.select(F.col(id_col).alias("rated_id"), F.col(text_col).alias("text"))
    some = some.where("rated_id is not null").distinct().join(rows.select("rated_id"), "rated_id", "left_semi")
    some = stash.put(_smallest(stash.put(some, "usable"), max_rated), "ratings")
    features = stash.put(_featurize(rows.join(F.broadcast(some), "rated_id")), "features")
    counts = {r["grade"]: r["count"] for r in features.groupBy("grade").count().collect()}
    total = sum(counts.values())
    n = 1 << BUCKET_BITS
    if not total:
        return OrdinalModel(np.zeros(n), np.full(grades - 1, -50.0))
    above = [sum(x for g, x in counts.items() if g >= k) / total for k in range(1, grades)]

    def summed(x: np.ndarray | None) -> np.ndarray:
        """Loss and gradient at ``x``, or without one the occurrences of features by grade."""
        sent = spark.sparkContext.broadcast(x)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            x = sent.value
            out = np.zeros(1 + len(x) if x is not None else grades * n)
            for batch in batches:
                rated, sizes, flat = batch.column(0).to_numpy(), batch.column(1).value_lengths().to_numpy(zero_copy_only=False), batch.column(1).flatten().to_numpy()
                if x is None:
                    out += np.bincount(np.repeat(rated, sizes).astype(np.int64) * n + flat, minlength=grades * n)
                else:
                    out += loss_gradient(x[:n], x[n:], rated, np.concatenate([[0], np.cumsum(sizes)]), flat)
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float32).tobytes()])], ["sums"])

        few = features.coalesce(TASKS).mapInArrow(run, "sums binary")
        out = sum(np.frombuffer(r["sums"], np.float32).astype(float) for r in few.collect())
        sent.destroy()
        return out

    scale = worth(summed(None).reshape(grades, n), told)

    def cuts_of(free: np.ndarray) -> np.ndarray:
        return np.concatenate([free[:1], free[0] + np.cumsum(np.exp(free[1:]))])

    def objective(x: np.ndarray) -> tuple[float, np.ndarray]:
        free = x[n:]
        out = summed(np.concatenate([scale * x[:n], cuts_of(free)]))
        by_cut = out[1 + n :]
        by_free = np.concatenate([[by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * np.exp(free[1:])])
        value = out[0] + 0.5 * penalty * (x[:n] @ x[:n])
        return value, np.concatenate([scale * out[1 : 1 + n] + penalty * x[:n], by_free])

    shares = np.clip(1 - np.array(above), 1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log(shares / (1 - shares)) + 1e-3 * np.arange(grades - 1))
    free = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    x = minimise(objective, np.concatenate([np.zeros(n), free]), steps)
    return OrdinalModel(scale * x[:n], cuts_of(x[n:]))


class Scorer:
    """Scores of texts in one task: the sum of the weights of a text's distinct feature buckets."""

    def __init__(self, model: OrdinalModel):
        self.weights = model.weights
        self.known: dict[bytes, tuple[int, float]] = {}

    def _look(self, word: bytes) -> tuple[int, float]:
        b = bucket(word)
        got = (b, float(self.weights[b]))
        if len(self.known) < REMEMBER:
            self.known[word] = got
        return got

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        known, look = self.known, self._look
        return np.array([sum(dict(known.get(w) or look(w) for w in text_features(t)).values()) for t in texts], float)


def score(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score, expected_grade, tails array<double>)`` per row of ``docs``.

    ``tails[k - 1]`` is the probability of grade k or more. Null and empty texts have one feature of their
    own; repeated rows and null ids are scored like any other; no rows give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, 256):
            scores = scorer.scores(as_bytes(batch.column(1)))
            tails = model.tails(scores)
            out = [batch.column(0), pa.array(scores), pa.array(tails.sum(1)), pa.array(tails.tolist(), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "expected_grade", "tails"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double, expected_grade double, tails array<double>")


def select(docs: DataFrame, model: OrdinalModel, least_grade: int = 2, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, expected_grade, tail_probability, kept)``: kept if grade ``least_grade`` or more is likely.

    One row per row of ``docs``, repeated ones included; null and empty texts are judged by the weight of having no words,
    ids may be null, a tail of just ``least_tail`` is kept, extra columns are ignored, and no rows give no rows.
    """
    tail = F.element_at("tails", least_grade)
    return score(docs, model, id_col, text_col).select(
        "doc_id", "expected_grade", tail.alias("tail_probability"), (tail >= least_tail).alias("kept")
    )


def keep_good(docs: DataFrame, model: OrdinalModel, least_grade: int = 2, least_tail: float = 0.5, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` that :func:`select` would keep, with all their columns; rows are judged where they are read.

    Any column names are free, as nothing is added; repeated rows stay or go together, and an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in slices(batches, 256):
            tails = model.tails(scorer.scores(as_bytes(batch.column(at))))
            yield batch.filter(pa.array(tails[:, least_grade - 1] >= least_tail))

    return docs.mapInArrow(run, docs.schema)
