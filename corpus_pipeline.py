"""From raw documents to token digests in five stages, each over all that the one before kept.

Every stage is ``f(spark, docs, sf_dir) -> DataFrame``; its result is written as Parquet and
read again as the next stage's ``docs``. All but the last return the columns of documents.

Defined results for odd input: an empty table passes through as an empty one; NULL and empty
texts are scored by the share of good labels, are equal texts to each other, near none, never
contaminated, and encode to no ids; a row with a NULL id goes where its very text has a row with
an id or is contaminated, and is never a near duplicate; rows of one id are one document to the
near-duplicate stage, and are judged by their own texts by the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curbline.llm import byte_bpe, classifier, decontamination, exact_dedup, jaccard_join
from curbline.llm.common import fresh, stored, table, token_pattern, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones vote good."""
    labels = table(spark, sf_dir, "labels")
    model = classifier.fit(docs, labels.where(~classifier.held_out(F.col("doc_id"))))
    vote = fresh(docs, "vote")
    return classifier.score(docs, model, name=vote).where(F.col(vote) >= 0.5).drop(vote)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest id."""
    return jaccard_join.deduplicate(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document left."""
    return byte_bpe.digests(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), token_pattern())


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("benchmark decontamination", clean),
    ("byte-level BPE", tokens),
]

#: Votes among vectors are not SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
