"""Benchmark decontamination by winnowed k-gram fingerprints."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsift.llm.common import alnum_words, as_bytes, slices
from twinsift.stash import Stash

#: A benchmark of up to this many bytes of text is sent whole to every task; a larger one is joined.
SEND_BYTES = 32 << 20
#: Candidate positions that are extended at a time.
CANDIDATES = 500_000
#: Texts of one gram that a task joins with its items.
PART = 10_000
#: Bytes of item text that a text is held against at a time.
BLOCK_BYTES = 4 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hash of each run of ``k`` ids."""
    m = max(0, len(ids) - k + 1)
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h = (h ^ ids[j : j + m]) * MIX
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of every ``window`` consecutive hashes, each once."""
    m = len(h) - window + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    low, at = h[:m].copy(), np.zeros(m, np.int8)
    for j in range(1, window):
        new = h[j : j + m]
        less = new <= low
        np.copyto(low, new, where=less)
        at[less] = j
    picked = np.arange(m) + at
    keep = np.append(True, picked[1:] != picked[:-1])  # rightmost minima never move back
    return picked[keep]


class Index:
    """Winnowed fingerprints of benchmark items, with the items' words for extension."""

    def __init__(self, items: list[tuple[object, bytes | None]], span: int = 10):
        self.span, self.names = span, []
        self.vocabulary: dict[bytes, int] = {}
        ids, owner, lengths = [0], [-1], []
        for name, text in items:
            words = alnum_words(text)
            if not words:
                continue
            ids += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [0]
            owner += [len(self.names)] * len(words) + [-1]
            self.names.append(name)
            lengths.append(len(words))
        self.ids, self.owner = np.array(ids, np.uint64), np.array(owner, np.int64)
        lengths = np.array(lengths, np.int64)
        self.classes = []
        for n in sorted({min(span, int(x)) for x in lengths}):
            k = (n + 1) // 2
            h = gram_hashes(self.ids, k)
            at = winnow(h, n - k + 1)
            own = self.owner[at]
            at = at[(own >= 0) & (np.minimum(lengths, span)[own] == n) & (self.owner[at + k - 1] == own)]
            order = np.argsort(h[at], kind="stable")
            self.classes.append((n, k, h[at][order], at[order]))

    def hits(self, texts: list[bytes | None]) -> list[tuple[int, int, list, list]]:
        """``(n_words, n_hit, names of items found, runs [first, end) of hit words)`` of each text."""
        get = self.vocabulary.get
        coded = [[get(w, 0) for w in alnum_words(t)] for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        pad = self.span
        starts = np.cumsum(sizes + pad) - sizes
        doc = np.zeros(int(starts[-1] + sizes[-1] + pad) if len(texts) else pad, np.uint64)
        for s, c in zip(starts.tolist(), coded):
            doc[s : s + len(c)] = c
        edges = np.zeros(len(doc) + 1, np.int64)
        pairs: list[np.ndarray] = []
        for n, k, fps, where in self.classes:
            h = gram_hashes(doc, k)
            at = winnow(h, n - k + 1)
            at = at[(doc[at] > 0) & (doc[at + k - 1] > 0)]
            lo, hi = np.searchsorted(fps, h[at], "left"), np.searchsorted(fps, h[at], "right")
            at, lo, many = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            ends = np.cumsum(many)
            first = 0
            while first < len(many):
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + CANDIDATES, "right")))
                w = many[first:last]
                nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
                p, q = np.repeat(at[first:last], w), where[np.repeat(lo[first:last], w) + nth]
                first = last
                ok = np.ones(len(p), bool)
                for j in range(k):
                    ok &= doc[p + j] == self.ids[q + j]
                p, q = p[ok], q[ok]
                left, right = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
                for side, step, base in ((left, -1, 0), (right, 1, k - 1)):
                    alive = np.ones(len(p), bool)
                    for j in range(1, n - k + 1):
                        a = np.clip(p + base + step * j, 0, len(doc) - 1)
                        b = np.clip(q + base + step * j, 0, len(self.ids) - 1)
                        alive &= (doc[a] == self.ids[b]) & (doc[a] > 0)
                        side += alive
                ok = left + k + right >= n
                p, q, left, right = p[ok], q[ok], left[ok], right[ok]
                np.add.at(edges, p - left, 1)
                np.add.at(edges, p + k + right, -1)
                text = np.searchsorted(starts, p, "right") - 1
                pairs.append(np.unique(text * len(self.names) + self.owner[q]))
        inside = np.cumsum(edges)[:-1] > 0
        hit = np.concatenate([[0], np.cumsum(inside)])
        n_hit = hit[starts + sizes] - hit[starts] if len(texts) else []
        found: list[list] = [[] for _ in texts]
        for x in np.unique(np.concatenate(pairs)).tolist() if pairs else []:
            found[x // len(self.names)].append(self.names[x % len(self.names)])
        runs: list[list] = [[] for _ in texts]
        turns = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        for first, end in zip(turns[::2].tolist(), turns[1::2].tolist()):
            text = int(np.searchsorted(starts, first, "right")) - 1
            runs[text].append([first - int(starts[text]), end - int(starts[text])])
        return list(zip(sizes.tolist(), map(int, n_hit), found, runs))


def _digest(rows: list[tuple[int, int, list, list]]) -> list[pa.Array]:
    names = [sorted({str(x) for x in r[2] if x is not None}) for r in rows]
    return [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([r[1] for r in rows], pa.int64()),
        pa.array([len(x) for x in names], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else EMPTY_SHA for x in names]),
        pa.array([r[1] > 0 for r in rows]),
        pa.array(names, pa.list_(pa.string())),
    ]


FOUND = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"]
BLANK = {
    "n_words": lambda: F.lit(0),
    "n_hit": lambda: F.lit(0),
    "n_items": lambda: F.lit(0),
    "items_sha256": lambda: F.lit(EMPTY_SHA),
    "contaminated": lambda: F.lit(False),
    "item_ids": lambda: F.array().cast("array<string>"),
}
FOUND_SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>"


def _items(benchmark: DataFrame, send_bytes: int):
    """The usable items, and a broadcast of them if their text is of at most ``send_bytes``, else ``None``."""
    items = benchmark.select("item_id", "text").where("text is not null")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if size > send_bytes:
        return items, None
    return items, benchmark.sparkSession.sparkContext.broadcast([(r[0], r[1].encode()) for r in items.distinct().collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = 10, send_bytes: int = SEND_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds benchmark passages of ``span`` words in whole texts; one row per row of ``docs``.

    Columns: ``doc_id`` and those of ``FOUND``. An item of fewer words, but not none, is one passage. For
    passages of n words the smallest hash of every n - k + 1 consecutive k-grams is kept, k = (n + 1) // 2, on
    both sides: a shared passage fills one such window, so both sides keep the same gram in it. Grams that
    meet are extended word by word, so reported passages are exact.

    The benchmark goes whole to the tasks only up to ``send_bytes`` of text, which is checked first; a larger
    one is joined by fingerprint. Null and wordless texts have no words and no hits; items without an id are found like
    any other, but have no name to be counted or listed by; repeated ids, repeated rows and extra columns change nothing; an empty benchmark hits nothing; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    items, sent = _items(benchmark, send_bytes)
    if sent is None:
        texts = rows.withColumn("key", F.sha2("text", 256))
        out = texts.select("doc_id", "key").join(_judged(texts, items, span, Stash(docs.sparkSession)), "key", "left")
        return out.select("doc_id", *(F.coalesce(c, BLANK[c]()).alias(c) for c in FOUND))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value, span)
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), *_digest(index.hits(as_bytes(batch.column(1))))], ["doc_id", *FOUND])

    return rows.mapInArrow(run, f"doc_id {kind}, {FOUND_SCHEMA}")


def _keep_grams(spans: list[int], span: int, whole: bool):
    """Task function: ``(key, fp)`` of the winnowed grams of each text, for each passage length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            keys, fps = [], []
            for key, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = alnum_words(text)
                ids = np.array([int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in words], np.uint64)
                for n in spans:
                    if len(words) < n or (whole and n != min(span, len(words))):
                        continue
                    k = (n + 1) // 2
                    h = gram_hashes(ids, k)
                    own = np.unique(h[winnow(h, n - k + 1)] ^ np.uint64(n))
                    fps.append(own)
                    keys += [key] * len(own)
            if keys:
                fp = np.concatenate(fps).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(fp)], ["key", "fp"])

    return run


def _judged(texts: DataFrame, items: DataFrame, span: int, stash: Stash) -> DataFrame:
    """``(key, FOUND...)`` per distinct text of ``texts(key, text)`` for a benchmark of any size.

    Fingerprints are joined, then each text meets its candidates; copies are judged once.
    """
    items = items.distinct().withColumn("item_key", F.monotonically_increasing_id())
    items = stash.put(items, "items")
    once = stash.put(texts.where("text is not null").dropDuplicates(["key"]).select("key", "text"), "texts")

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            found = {min(span, len(alnum_words(t))) for t in as_bytes(batch.column(0))}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.int32())], ["n"])

    spans = sorted(r["n"] for r in items.select("text").mapInArrow(spans_of, "n int").where("n > 0").distinct().collect())
    theirs = items.select(F.col("item_key").alias("key"), "text").mapInArrow(_keep_grams(spans, span, True), "key long, fp long")
    theirs = stash.put(theirs.select(F.col("key").alias("item_key"), "fp").distinct(), "item_grams")
    ours = once.mapInArrow(_keep_grams(spans, span, False), "key string, fp long")
    # A gram may be in any number of texts: it is dealt to parts by text, and its items are copied to each of them.
    ours = stash.put(ours.join(theirs.select("fp").distinct(), "fp", "left_semi"), "grams")
    parts = ours.groupBy("fp").count().select("fp", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    theirs = theirs.join(parts, "fp").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = parts.where("parts > 1")
    many = F.broadcast(many) if many.count() <= 100_000 else many
    ours = ours.join(many, "fp", "left").withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int"))
    met = ours.select("key", "fp", "part").join(theirs.select("fp", "part", "item_key"), ["fp", "part"]).select("key", "item_key").distinct()
    # A text may meet any number of items: it is judged against blocks of them, each of a bounded size.
    met = stash.put(met.join(items.select("item_key", F.octet_length("text").alias("size")), "item_key"), "met")
    blocks = met.groupBy("key").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("blocks"))
    met = met.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("item_key"), F.greatest("blocks", F.lit(1))).cast("int"))
    listed = met.select("key", "block", "item_key").join(items, "item_key")
    listed = listed.groupBy("key", "block").agg(F.collect_list(F.struct("item_id", F.col("text").alias("item"))).alias("items"))
    full = once.join(listed, "key", "left").select("key", "text", "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            out = []
            for text, items in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                out += Index([(x["item_id"], x["item"].encode()) for x in items or []], span).hits([text])
            names = [sorted({str(x) for x in r[2] if x is not None}) for r in out]
            columns = [pa.array([r[0] for r in out], pa.int64()), pa.array([r[3] for r in out], pa.list_(pa.list_(pa.int64()))), pa.array(names, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "n_words", "runs", "names"])

    found = full.mapInArrow(run, "key string, n_words long, runs array<array<long>>, names array<string>")
    return stash.put(_together(found), "judged")


def _together(found: DataFrame) -> DataFrame:
    """``(key, FOUND...)`` of the runs of hit words ``[first, end)`` and the item names that several blocks of items gave."""
    both = found.groupBy("key").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("names")).alias("names"))
    names = F.array_sort(F.array_distinct("names"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))

    def cover(have: Column, run: Column) -> Column:
        fresh = F.greatest(F.lit(0).cast("long"), run[1] - F.greatest(run[0], have["end"]))
        return F.struct((have["n"] + fresh).alias("n"), F.greatest(have["end"], run[1]).alias("end"))

    n_hit = F.aggregate(F.array_sort("runs"), start, cover, lambda have: have["n"])
    rows = both.select("key", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), names.alias("item_ids"))
    return rows.select("key", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "item_ids")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, span: int = 10, send_bytes: int = SEND_BYTES, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` whose text holds no benchmark passage (see :func:`contamination`), with all their columns."""
    items, sent = _items(benchmark, send_bytes)
    if sent is None:
        texts = docs.select(F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("text"))
        bad = _judged(texts, items, span, Stash(docs.sparkSession)).where("contaminated").select(F.col("key").alias("bad_key"))
        return docs.join(bad, F.sha2(docs[text_col], 256) == bad["bad_key"], "left_anti")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value, span)
        for batch in slices(batches, 256):
            yield batch.filter(pa.array([r[1] == 0 for r in index.hits(as_bytes(batch.column(at)))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
