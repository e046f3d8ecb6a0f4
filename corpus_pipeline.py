"""The corpus pipeline: from raw documents to packed token ids, stage by stage."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from geoloom.cluster import collected, delete_path, drop_written, written
from geoloom.llm import decontaminate, mixing, quality, simhash, tokens
from geoloom.llm.queries import learned_labels


#: Rows that pass between Spark and a Python worker at a time: texts may be long, and memory should not be.
ROWS_AT_A_TIME, BATCH = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


#: Pieces of words that a worker of the last stage remembers: few, as workers are used again by later jobs, beside heaps that have grown.
REMEMBERED = 100_000

#: Tables that the stage before wrote for itself. Its result is written before the next one begins, and then they go.
_left: list[str] = []


def bounded(stage, last: bool = False):
    """The stage, run with small Arrow batches, after what the stage before left has been deleted; the last leaves its result.

    The session's own setting is put back. A stage whose result would still have to go through Python is written before that.
    """

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _left:
            delete_path(spark, _left.pop())
        before = spark.conf.get(BATCH)
        spark.conf.set(BATCH, ROWS_AT_A_TIME)
        try:
            with collected() as paths:
                return stage(spark, docs, sf_dir)
        finally:
            _left.extend(paths[: -1 if last else None])
            spark.conf.set(BATCH, before)

    run.__name__, run.__doc__ = stage.__name__, stage.__doc__
    return run


@bounded
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels that aren't held out, doesn't reject."""
    model = quality.train(docs, learned_labels(spark, sf_dir))
    return written(quality.kept(docs, model), "good_quality")


@bounded
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links: fingerprints within two bits, or shingle sets similar to 0.8."""
    return simhash.keep_first(docs, similar=0.8)


@bounded
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@bounded
def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, whole."""
    return mixing.mixed_documents(docs)


@partial(bounded, last=True)
def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the packed files of token ids."""
    return written(tokens.packed(docs, remembered=REMEMBERED), "token_output")


STAGES = [("good_quality", good_quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixture", mixture), ("token_output", token_output)]

#: The classifier and the fingerprints have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over what the one before kept."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(STAGES) - 1
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < last:
            docs = written(docs, name)
        drop_written(before)  # nothing reads it now: the last stage's result is a table of its own
    return docs
