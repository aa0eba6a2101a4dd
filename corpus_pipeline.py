"""A training-corpus pipeline of five stages over the ``documents`` table; counts as part of ``packetlake.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet in the cluster's shared folder and rereads as the next
stage's docs. All but the last return the columns of documents:

1. quality: documents that the additive model scores under 0.7 go.
2. near_duplicates: of documents linked by 75 % of their five-word shingles the
   one with the smallest id stays.
3. decontaminate: documents that hold ten words in a row of a benchmark item go.
4. pii: personal data is replaced by its kind in brackets.
5. pieces: the texts as SentencePiece ids (doc_id, n_bytes, n_pieces, ids_sha256, round_trip, ids).

All stages run in the same executors and Python workers, and none of them gets
back what an earlier one left with the allocators. So a stage sets the session's
limit for the batches between the JVM and the workers to BATCH_BYTES; Spark's own
limit is 10,000 rows of any length, which both sides hold several times.

Odd rows: null and empty texts are scored as empty ones by the first stage,
which rejects them; where they reach a later stage they link with nothing, hold
no benchmark words and no personal data, and have no ids. Rows with a null id
are no duplicates of others. Repeated rows are one document of near_duplicates.
Columns of any name stay as they are through the first four stages; empty tables
stay empty.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from packetlake.llm import decontaminate, jaccard, pii, quality, sentence_pieces
from packetlake.llm.durable import saved
from packetlake.llm.queries import table, tokenizer

#: Bytes of a batch that goes to a Python worker: two slices of ``llm.batches``.
BATCH_BYTES = 4 << 20


def in_small_batches(stage):
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))  # stays: the stage runs when it is written
        return stage(spark, docs, sf_dir)

    return run


@in_small_batches
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


@in_small_batches
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@in_small_batches
def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@in_small_batches
def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask(docs)


@in_small_batches
def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_digest(docs, tokenizer("piece_bpe_32k.model"), with_ids=True)


STAGES = [("quality", good), ("near_duplicates", near_duplicates), ("decontaminate", clean_of_benchmark), ("pii", masked), ("pieces", pieces)]

#: SQL can't express the learned stages; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
