"""The training-data pipeline: documents in, packed sequences out.

Five stages, each over all that the one before it kept. A stage takes (spark, docs, folder); its result
is written as Parquet and read again as the next one's documents. All but the last return the columns
of documents. No SQL expresses them as a whole: hashing, learning and tokenising have none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm.decontaminate import contamination
from holdfast.llm.near_dedup import one_of_each
from holdfast.llm.packing import packed
from holdfast.llm.pii import redacted
from holdfast.llm.toxicity import fit, toxicity, training_rows
from holdfast.scale import durable

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
TOXIC = 0.7
TOKENIZER = "word_bpe_49k.json"
# Rows of whole texts that a Python task gets at a time.
ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Whole texts travel with their rows here, so the session's Arrow batches are made this short, if longer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(ROWS if now <= 0 else min(now, ROWS)))


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that score below TOXIC, by a model learnt from the labelled ones outside the held-out fold."""
    small_batches(spark)
    model = fit(training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    scored = toxicity(docs, model, keep=docs.columns)
    return scored.filter(F.col("score") < TOXIC).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest id."""
    small_batches(spark)
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any window of ten words of a benchmark item."""
    small_batches(spark)
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    found = contamination(docs, benchmark, keep=docs.columns)
    return found.filter(F.col("n_hit") == 0).select(*docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data replaced by its kind, ``n_chars`` that of the new text."""
    small_batches(spark)
    return redacted(docs, keep=docs.columns).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    small_batches(spark)
    import public_tokenizers
    return packed(docs, public_tokenizers.path(TOKENIZER), keep=["doc_id"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated),
    ("pii", redact_personal), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The stages one after another over the documents of ``folder``."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, folder))
    return STAGES[-1][1](spark, docs, folder)


PIPELINE = {"pipeline": run}
