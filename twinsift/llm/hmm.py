"""Text scores of a hidden Markov language model trained by distributed Baum-Welch."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import as_bytes, slices, space_words
from twinsift.stash import Stash, partitions

END = b""
#: Words with an emission of their own, if the caller does not say, and classes of all other words.
HEAD, CLASSES = 60_000, 4096
STATES = 8
SIGNATURE = 8
#: Distinct words that a task counts before it passes them on.
COUNTED = 200_000
#: Tokens whose forward and backward values are held at a time.
BLOCK_TOKENS = 250_000
#: Texts that are sorted by length together.
TEXTS = 10_000
CHUNK = 1024


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # (word, or class of other words, by state)


def in_training(doc_id, folds: int = 7, fold: int = 2):
    """Whether a document is learnt from: crc32 of its id as text is not ``fold`` modulo ``folds``; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds != fold, F.lit(True))


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, train, n)``: occurrences in training texts and in all; the end of a text is the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train: Counter[bytes] = Counter()
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = list(train.keys() | held.keys())
            out = [[w.decode() for w in words], [train[w] for w in words], [train[w] + held[w] for w in words]]
            train.clear()
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["word", "train", "n"])

        for batch in slices(batches, 256):
            for learnt, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                into = train if learnt else held
                into.update(space_words(text))
                into[END] += 1
            if len(train) + len(held) > COUNTED:
                yield flush()
        yield flush()

    parts = rows.select("learnt", "text").mapInArrow(run, "word string, train long, n long")
    return parts.groupBy("word").agg(F.sum("train").alias("train"), F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int, by: str) -> list:
    """The most frequent words by the column ``by``, ``most`` rows at most; never the end of a text, or words without any.

    A histogram of counts in steps of a 32nd power of two, a few thousand rows for any corpus, gives the count
    from which words still fit; words of one step stay together. So the driver gets no more than these rows.
    """
    words = counts.where(f"word <> '' and {by} > 0").withColumn("step", F.floor(F.log2(by) * 32).cast("int"))
    sizes = sorted(((r["step"], r["count"]) for r in words.groupBy("step").count().collect()), reverse=True)
    least, room = None, most
    for at, size in sizes:
        room -= size
        if room < 0:
            break
        least = at
    top = [] if least is None else words.where(F.col("step") >= least).drop("step").collect()
    return sorted(top, key=lambda r: (-r[by], r["word"]))


def class_of(word: bytes, classes: int) -> int:
    """Class of a word without an emission of its own; the same as Spark's crc32."""
    return zlib.crc32(word) % classes


def code_type(size: int) -> type:
    return np.uint16 if size <= 1 << 16 else np.uint32


def encode(rows: DataFrame, numbers: Broadcast, known: Broadcast, head: int, classes: int) -> DataFrame:
    """``(doc_id, learnt, n_tokens, codes binary, tail array<string>, f_known, f_log)`` per text.

    Codes are the numbers of head words, and ``head`` and more for the classes of others. Those others are listed in
    ``tail``, but for frequent ones: ``known`` has their training counts, and they are summed here.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    code = code_type(head + classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, counts = numbers.value.get, known.value
        for batch in slices(batches, 256):
            out: list[list] = [[] for _ in range(5)]
            for text in as_bytes(batch.column(2)):
                words = space_words(text) + [END]
                own = [get(w, -1) for w in words]
                others = [w for w, c in zip(words, own) if c < 0]
                if others:
                    own = [head + class_of(w, classes) if c < 0 else c for w, c in zip(words, own)]
                frequent = [counts[w] for w in others if w in counts]
                columns = len(own), np.array(own, code).tobytes(), [w for w in others if w not in counts], sum(c > 0 for c in frequent), float(sum(np.log10(c + 1) for c in frequent))
                for into, x in zip(out, columns):
                    into.append(x)
            tail = pa.array(out[2], pa.list_(pa.binary())).cast(pa.list_(pa.string()))
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), tail, pa.array(out[3], pa.int64()), pa.array(out[4], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], ["doc_id", "learnt", "n_tokens", "codes", "tail", "f_known", "f_log"])

    return rows.select("doc_id", "learnt", "text").mapInArrow(run, f"doc_id {kind}, learnt boolean, n_tokens long, codes binary, tail array<string>, f_known long, f_log double")


def blocks(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cuts texts, by falling length, into ``(row numbers, codes by time and row, rows still going by time)``."""
    order = np.argsort([-len(t) for t in texts], kind="stable")
    at = 0
    while at < len(order):
        longest = len(texts[order[at]])
        own = order[at : at + max(1, BLOCK_TOKENS // longest)]
        at += len(own)
        lengths = np.array([len(texts[i]) for i in own])
        codes = np.zeros((longest, len(own)), texts[own[0]].dtype)
        for j, i in enumerate(own):
            codes[: lengths[j], j] = texts[i]
        going = np.searchsorted(-lengths, -np.arange(longest), "left")
        yield own, codes, going


def forward(model: Model, codes: np.ndarray, going: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scaled forward values, scales and emissions; the scales' logarithms sum to the likelihood.

    Values are laid out by time, state and text, so that array operations run along the texts. ``before`` has
    the values that precede the first time, if the texts began earlier.
    """
    seen = np.empty((len(codes), len(model.start), codes.shape[1]))
    for j, column in enumerate(np.ascontiguousarray(model.emit.T)):
        seen[:, j] = column[codes]
    alpha, scale, turned = np.zeros_like(seen), np.ones(codes.shape), np.ascontiguousarray(model.step.T)
    for t, n in enumerate(going.tolist()):
        a, c = alpha[t, :, :n], scale[t, :n]
        into = model.start[:, None] if before is None else turned @ before[:, :n]
        np.multiply(into, seen[t, :, :n], out=a)
        a.sum(0, out=c)
        a /= c
        before = a
    return alpha, scale, seen


def spans(codes: np.ndarray) -> list[slice]:
    """Cuts the times of a block so that a span holds about ``BLOCK_TOKENS`` tokens at most; long texts have many."""
    size = max(1, 2 * BLOCK_TOKENS // codes.shape[1])
    return [slice(at, at + size) for at in range(0, len(codes), size)]


def log_likelihood(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Base-10 log probability of each text."""
    out = np.zeros(len(texts))
    for which, codes, going in blocks(texts):
        before = None
        for span in spans(codes):
            alpha, scale, _ = forward(model, codes[span], going[span], before)
            out[which] += np.log10(scale).sum(0)
            before = alpha[-1]
    return out


def expect(model: Model, texts: list[np.ndarray], counts: np.ndarray, steps: np.ndarray, starts: np.ndarray) -> None:
    """Adds the expected emissions, transitions and starts of some texts (forward and backward recursion).

    Of a text that is longer than a span only the forward values at the spans' ends are kept; those inside are
    computed again on the way back, so memory does not grow with the text.
    """
    for _, codes, going in blocks(texts):
        cuts, before, ends = spans(codes), None, []
        for span in cuts:
            ends.append(before)
            done = forward(model, codes[span], going[span], before)
            before = done[0][-1].copy()
        beta = np.ones((len(model.start), codes.shape[1]))
        for span, before in zip(reversed(cuts), reversed(ends)):
            own, left = codes[span], going[span]
            alpha, scale, seen = done if done is not None else forward(model, own, left, before)
            done = None
            seen /= scale[:, None, :]
            gamma = np.zeros_like(seen)
            for t in range(len(own) - 1, -1, -1):
                n = int(left[t])
                np.multiply(alpha[t, :, :n], beta[:, :n], out=gamma[t, :, :n])
                v = seen[t, :, :n] * beta[:, :n]
                last = alpha[t - 1] if t else before
                if last is not None:
                    steps += model.step * (last[:, :n] @ v.T)
                beta[:, :n] = model.step @ v
            if before is None:
                starts += gamma[0].sum(1)
            there = np.arange(own.shape[1])[None, :] < left[:, None]
            flat = own[there]
            for j in range(gamma.shape[1]):
                counts[:, j] += np.bincount(flat, gamma[:, j][there], len(counts))


def _texts(batch: pa.RecordBatch, size: int) -> list[np.ndarray]:
    return [np.frombuffer(b, code_type(size)) for b in batch.column("codes").to_pylist()]


def _summed(found: DataFrame, run, size: int) -> np.ndarray:
    """Sum over tasks of an array of ``size`` numbers that ``run(batches)`` returns, added up in chunks by Spark in one job."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = run(batches)
        at = range(0, size, CHUNK * STATES)
        own = [(i, out[a : a + CHUNK * STATES]) for i, a in enumerate(at)]
        own = [(i, x.tobytes()) for i, x in own if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())], ["chunk", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(data)
                sums[i] = sums[i] + x if i in sums else x
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["chunk", "data"])

    parts = found.mapInArrow(emit, "chunk int, data binary").repartition(partitions(found.sparkSession), "chunk")
    out = np.zeros(size)
    for r in parts.mapInArrow(add, "chunk int, data binary").collect():
        x = np.frombuffer(r["data"])
        out[r["chunk"] * CHUNK * STATES :][: len(x)] += x
    return out


def context_clusters(learnt: DataFrame, unigram: np.ndarray, states: int) -> np.ndarray:
    """A first state for every word: words that occur in like texts, over all training texts, come together.

    A text's signature is the mean of fixed random vectors of its words; a word's is the mean over its
    occurrences. Words are clustered by k-means on a table whose size is that of the head.
    """
    size = len(unigram)
    vectors = np.random.default_rng(7).standard_normal((size, SIGNATURE))
    vectors -= unigram @ vectors

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        sums = np.zeros((size, SIGNATURE))
        for batch in slices(batches, 256):
            texts = _texts(batch, size)
            if not texts:
                continue
            flat, lengths = np.concatenate(texts), np.array([len(t) for t in texts])
            docs = np.add.reduceat(vectors[flat], np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]
            for j in range(SIGNATURE):
                sums[:, j] += np.bincount(flat, np.repeat(docs[:, j], lengths), size)
        return sums.ravel()

    sums = _summed(learnt.select("codes"), run, size * SIGNATURE).reshape(size, SIGNATURE)
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    points = sums / np.maximum(norm, 1e-12)
    weight = np.sqrt(unigram)
    centres = points[[int(np.argmax(unigram))]]
    while len(centres) < states:
        far = 1 - (points @ centres.T).max(1)
        centres = np.vstack([centres, points[np.argmax(far * weight)]])
    for _ in range(25):
        near = np.argmax(points @ centres.T, axis=1)
        new = np.stack([(points * weight[:, None])[near == s].sum(0) for s in range(states)])
        centres = new / np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
    return np.argmax(points @ centres.T, axis=1)


def train(learnt: DataFrame, unigram: np.ndarray, states: int = STATES, rounds: int = 3, prior: float = 50.0) -> Model:
    """Baum-Welch over all rows of ``learnt(codes)``: each round sums expected counts over partitions.

    Emissions are smoothed towards ``unigram`` by ``prior`` counts, so that no word has probability 0.
    """
    size, spark = len(unigram), learnt.sparkSession
    near = context_clusters(learnt, unigram, states)
    emit = np.full((size, states), 0.3 / states)
    emit[np.arange(size), near] += 0.7
    emit *= unigram[:, None]
    model = Model(np.full(states, 1 / states), 0.5 * np.eye(states) + 0.5 / states, emit / emit.sum(0))
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> np.ndarray:
            counts, steps, starts = np.zeros((size, states)), np.zeros((states, states)), np.zeros(states)
            for batch in slices(batches, TEXTS):
                expect(sent.value, _texts(batch, size), counts, steps, starts)
            return np.concatenate([counts.ravel(), steps.ravel(), starts])

        out = _summed(learnt.select("codes"), run, (size + states + 1) * states)
        counts, rest = out[: size * states].reshape(size, states), out[size * states :].reshape(states + 1, states)
        emit = (counts + prior * unigram[:, None]) / (counts.sum(0) + prior)
        model = Model((rest[-1] + 1) / (rest[-1] + 1).sum(), (rest[:-1] + 1) / (rest[:-1] + 1).sum(1, keepdims=True), emit)
    return model


def score_texts(docs: DataFrame, states: int = STATES, rounds: int = 3, head: int = HEAD, classes: int = CLASSES, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base-10 log probabilities of whole texts under smoothed word counts and a hidden Markov model.

    One row ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``docs``. Texts
    whose id's crc32 is ``fold`` modulo ``folds`` are held out: nothing is learnt from them. The ``head`` most frequent
    words of the training texts, any number that fits a task's memory with ``states`` numbers each, have emissions of
    their own; all others belong to ``classes`` by a hash, each with emissions of its own. A class is divided among its
    words by their training counts plus one, with one more share for unseen words. Counts of these words grow with
    the corpus and are joined by word. The most frequent of them, by all texts, are sent instead, so no key is large.

    A null text is empty, one end token; a null id is learnt from; repeated rows count each time; extra
    columns are ignored; no rows give no rows.
    """
    stash, spark = Stash(docs.sparkSession), docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), in_training(F.col(id_col), folds, fold).alias("learnt"), F.col(text_col).alias("text"))
    counts = stash.put(word_counts(rows), "counts")
    n, v = counts.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count_if(F.col("train") > 0)).first()
    ends = counts.where("word = ''").agg(F.coalesce(F.sum("train"), F.lit(0))).first()[0]
    top = head_words(counts, head - 1, "train")
    numbers = {END: 0} | {r["word"].encode(): i for i, r in enumerate(top, 1)}
    frequent = {r["word"].encode(): r["train"] for r in head_words(counts, max(head, HEAD), "n") if r["word"].encode() not in numbers}
    in_head = F.broadcast(spark.createDataFrame([("",)] + [(r["word"],) for r in top], "word string"))
    tail_counts = stash.put(counts.where("train > 0").join(in_head, "word", "left_anti").select("word", "train"), "tail_counts")
    by_class = tail_counts.groupBy((F.crc32(F.col("word").cast("binary")) % classes).alias("k")).agg(F.sum(F.col("train") + 1).alias("t"))
    shares = np.ones(classes)
    for r in by_class.collect():
        shares[r["k"]] += r["t"]
    total, rare, size = n + v + 1, len(numbers), len(numbers) + classes
    c = np.array([ends] + [r["train"] for r in top], float)
    unigram = np.concatenate([c + 1, shares])
    unigram = unigram / unigram.sum()
    coded = encode(rows, spark.sparkContext.broadcast(numbers), spark.sparkContext.broadcast(frequent), rare, classes)
    coded = stash.put(coded.withColumn("row", F.monotonically_increasing_id()), "coded")
    model = train(coded.where("learnt"), unigram, states, rounds)
    own_log = np.concatenate([np.log10(c + 1), np.zeros(classes)])
    share_log = np.concatenate([np.zeros(rare), np.log10(shares)])
    sent = spark.sparkContext.broadcast((model, own_log, share_log, np.append(c, np.zeros(classes)) > 0))
    kind = docs.schema[id_col].dataType.simpleString()
    plain = ["row", "doc_id", "learnt", "n_tokens", "f_known", "f_log"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, logs, share, known = sent.value
        for batch in slices(batches, TEXTS):
            texts = _texts(batch, size)
            likely = log_likelihood(own, texts) - np.array([share[t].sum() for t in texts])
            base = [float(logs[t].sum()) for t in texts]
            seen = [int(known[t].sum()) for t in texts]
            made = [pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(likely, pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in plain), *made], [*plain, "known", "base", "likely"])

    schema = f"row long, doc_id {kind}, learnt boolean, n_tokens long, f_known long, f_log double, known long, base double, likely double"
    scored = coded.select(*plain, "codes").mapInArrow(run, schema)
    tails = coded.select("row", F.explode("tail").alias("word")).join(tail_counts, "word", "left")
    more = tails.groupBy("row").agg(
        F.count_if(F.col("train") > 0).alias("t_known"),
        F.sum(F.log10(F.coalesce("train", F.lit(0)) + 1)).alias("t_log"),
    )
    logs = F.coalesce("t_log", F.lit(0.0)) + F.col("f_log")
    return scored.join(more, "row", "left").select(
        "doc_id",
        (~F.col("learnt")).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.col("f_known") + F.coalesce("t_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * float(np.log10(total))).alias("base_score"),
        (F.col("likely") + logs).alias("score"),
    )
