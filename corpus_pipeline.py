"""From documents to packed sequences: toxic documents go, then exact copies, then near copies; the rest is packed."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from orbita.llm import op4_exact_dedup, op5_bestfit_packing, op6_toxicity, op10_jaccard_join
from orbita.llm.common import compact, saved, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the classifier, learnt from the labels of these documents, predicts to be toxic."""
    compact(spark)
    return op6_toxicity.keep_clean(docs, op6_toxicity.fit(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    compact(spark)
    return op4_exact_dedup.drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links connect the one with the least doc_id stays."""
    compact(spark)
    return op10_jaccard_join.keep_one(docs)


def bestfit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in sequences."""
    compact(spark)
    return op5_bestfit_packing.packed_documents(docs, public_tokenizers.path(op5_bestfit_packing.VOCABULARY))


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("jaccard_join", jaccard_join), ("bestfit_packing", bestfit_packing)]

#: A trained classifier decides what is packed, so no SQL gives run()'s rows; tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
