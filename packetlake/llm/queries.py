"""The registered queries of this subpackage: one ``opN_<name>`` for each operator, and ``pipeline``.

Each is a thin call of its operator with production parameters over the whole table.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_text, jaccard, katz, neighbours, pii, quality, repeats, sentence_pieces, token_counts


def tokenizer(name: str) -> str:
    """A vocabulary file: under $PACKETLAKE_TOKENIZERS, or else where the installed package keeps it."""
    if root := os.environ.get("PACKETLAKE_TOKENIZERS"):
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode_digest(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scores(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_decontaminate, op3_repeats, op4_neighbours, op5_html_text, op6_jaccard, op7_token_counts, op8_sentence_pieces, op9_quality, op10_katz)}
ORACLES: dict[str, str] = {"op2_decontaminate": decontaminate.ORACLE, "op3_repeats": repeats.ORACLE, "op6_jaccard": jaccard.ORACLE}
