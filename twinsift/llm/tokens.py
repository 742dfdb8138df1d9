"""Exact token-length histograms with suffix sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinsift.llm.bpe import encoder
from twinsift.llm.common import slices
from twinsift.stash import Stash

#: Distinct lengths of one block, about.
SPAN = 256


def token_lengths(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` per row of ``docs``: ids of the whole text, no special tokens; null is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in slices(batches, 256):
            n = [len(code.encode(t)) // 4 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long")


def length_histogram(lengths: DataFrame, col: str = "n_tokens", span: int = SPAN) -> DataFrame:
    """One row per distinct length, with suffix sums that answer every context limit.

    Columns: ``n_tokens, n_docs, docs_longer`` (documents of more tokens), ``tokens_longer`` (their tokens),
    ``docs_total, tokens_total, truncated_total`` (tokens left when every document is cut at this length) and
    ``share_at_most`` (part of the documents with at most this length). Lengths are dealt by order to blocks of
    about ``span`` distinct ones and summed by block first; only block sums meet in one place, at most a few
    thousand rows as a block is never less than a thousandth of the distinct lengths.
    Null lengths are not counted; no rows give no rows.
    """
    L = F.col("n_tokens")
    stash = Stash(lengths.sparkSession)
    hist = lengths.select(F.col(col).cast("long").alias("n_tokens")).where(L.isNotNull())
    hist = stash.put(hist.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")), "lengths")
    parts = max(1, min(1000, -(-hist.count() // span)))
    hist = hist.repartitionByRange(parts, "n_tokens").withColumn("block", F.spark_partition_id()).withColumn("tokens", L * F.col("n_docs"))
    hist = stash.put(hist, "blocks")
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = hist.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d"),
        F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t"),
        F.sum("d").over(everything).alias("docs_total"),
        F.sum("t").over(everything).alias("tokens_total"),
    )
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = hist.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        (F.coalesce(F.sum("n_docs").over(inside), F.lit(0)) + F.col("d")).alias("docs_longer"),
        (F.coalesce(F.sum("tokens").over(inside), F.lit(0)) + F.col("t")).alias("tokens_longer"),
        "docs_total",
        "tokens_total",
    )
    cut = F.col("tokens_total") - F.col("tokens_longer") + L * F.col("docs_longer")
    share = (F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")
    return out.withColumn("truncated_total", cut).withColumn("share_at_most", share)


def token_histogram(docs: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """:func:`length_histogram` of the encoded lengths of whole texts; repeated rows count each time."""
    return length_histogram(token_lengths(docs, tokenizer, id_col, text_col))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """One row: tokens left when every document is cut at ``limit``, from one histogram row.

    Documents of no tokens count as such; a document of just ``limit`` tokens is not cut; an empty histogram gives nulls.
    """
    inside = F.when(F.col("n_tokens") <= limit, F.col("n_tokens"))
    sums = histogram.agg(
        F.max_by(F.struct("docs_longer", "tokens_longer"), inside).alias("x"),
        F.max("tokens_total").alias("t"),
        F.max("docs_total").alias("d"),
    )
    longer = F.coalesce(F.col("x.docs_longer"), F.col("d"))
    kept = F.col("t") - F.coalesce(F.col("x.tokens_longer"), F.col("t")) + limit * longer
    return sums.select(F.lit(limit).alias("max_tokens"), kept.alias("tokens"), longer.alias("docs_cut"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """One row: the smallest length that at least the part ``q`` of the documents does not exceed.

    An empty histogram, or a ``q`` above 1, gives a null length; extra columns are ignored.
    """
    return histogram.where(F.col("share_at_most") >= q).agg(F.lit(q).alias("q"), F.min("n_tokens").alias("n_tokens"))
