"""A corpus pipeline: quality selection, near-duplicate removal, decontamination and packing of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinsift.llm import decontaminate, nearcopies, packing, quality
from twinsift.stash import Stash


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier, fitted on the labels' grades, expects to be good.

    Null and empty texts are judged like any other, repeated rows stay or go together, all columns stay as they are, and
    an empty table or one without ratings loses nothing.
    """
    labels = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more.

    The SimHash trie join links close fingerprints; bands of minima add the pairs that it misses near 0.8.
    Null and wordless texts are one group; the smallest id stays, null ids last; all columns stay as they are, whatever their
    names; an empty table stays empty.
    """
    return nearcopies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage.

    Null and empty texts hold none and stay, and so does everything where the benchmark is empty; repeated rows stay or go
    together; all columns stay as they are; an empty table stays empty.
    """
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences of at most 2048 tokens.

    Null and empty texts are one piece that holds id 0, repeated rows and null ids are packed like any other, extra columns
    are ignored, and no rows give no rows.
    """
    return packing.pack_documents(docs, 2048)


STAGES = [
    ("quality classifier", select_quality),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("best-fit packing", pack),
]

#: Hashes, learnt weights and tokenisation are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``; each result but the last is written and read again."""
    stash = Stash(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash.put(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
