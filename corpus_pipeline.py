"""A corpus pipeline: language, exact copies, near copies, source mix, packed sequences."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from timberline.llm import exact, langid, minhash, mixing, packing
from timberline.llm.common import written

#: Rows that go to a Python worker at once. Five stages share executors, and both sides hold such a batch.
ARROW_ROWS = 2_000
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small batches for the Python work of a stage, all of which is done and written within; then as it was."""
    before = spark.conf.get(BATCH, None)
    spark.conf.set(BATCH, str(ARROW_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells, as they are.

    Null and empty texts, and others without a letter, go; repeated rows go or stay together; without a labelled row
    all go, for no language is known. An empty table stays empty. Only doc_id, text and lang are read.
    """
    with small_batches(spark):
        decisions = written(langid.decided(docs, langid.fit(docs)), "accepted")
    return exact.kept_documents(docs, decisions)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space, null and empty ones being a group.

    That of the most code points, then of the smallest doc_id, null last; also where rows repeat a doc_id. An empty
    table stays empty. Only doc_id and text are read.
    """
    return exact.kept_documents(docs, exact.decided(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, by shingles of five words (the query of this operator has four, as its
    contract says): that of the smallest doc_id, null last.

    Rows are compared by their texts, also where they repeat a doc_id; those without a word all stay. An empty table
    stays empty. Only doc_id and text are read.
    """
    with small_batches(spark):
        decisions = written(minhash.decided(docs, width=5), "near")
    return exact.kept_documents(docs, decisions)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last of a source as far, as the mix takes them.

    Rows without a word go; a null source is one of its own; equal rows are taken as often as planned for them
    together. An empty table stays empty. Only doc_id, text and source are read.
    """
    return mixing.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences.

    Null and empty texts are a piece of one id; every row, also a repeated one or one without an id, is packed. An
    empty table gives no rows. Only doc_id and text are read.
    """
    with small_batches(spark):
        return packing.packed(docs)


STAGES = [
    ("language ID", language),
    ("exact dedup", exact_copies),
    ("MinHash near-dedup", near_copies),
    ("mixing to target weights", source_mix),
    ("best-fit packing", sequences),
]

#: SQL cannot express the first stage and the last; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"stage-{at}")
    return docs
