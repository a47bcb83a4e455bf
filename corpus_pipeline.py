"""From documents to token ids: toxicity, boilerplate lines, near copies, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, jaccard_join, line_dedup, mixing, toxicity
from tidemark.llm.common import materialize, table

# Near copies: five words and a similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from all labels. The columns it adds replace none of the documents' own."""
    own = {name: f"__own_{name}" for name in ("score", "predicted") if name in docs.columns}
    scored = toxicity.score(docs.withColumnsRenamed(own), table(spark, sf_dir, "labels"))
    kept = scored.where("predicted = 0").drop("score", "predicted")
    return kept.withColumnsRenamed({held: name for name, held in own.items()}).select(docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand in too large a share of their source's texts. Copies of a text count
    as one here, so that they keep their lines and the next stage one of them."""
    cut = line_dedup.drop_boilerplate(docs, "source", "text", distinct=True)
    return cut.withColumn("n_chars", F.when(F.col("__dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group of near copies."""
    return jaccard_join.one_of_each(docs, WORDS, PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document of the mix, with digests of the ids and of what they decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode_texts(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN, with_ids=True)
    return coded.drop("text")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("jaccard_join", one_of_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]
# A trained classifier, a graph search and a sampling design are beyond SQL; tests hold brute force against them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
