"""A pipeline over the documents table: reject, deduplicate, mask and pack.

Each stage reads what the one before wrote; all but the last return the columns of documents, and pass on further ones,
whatever their names. Null texts count as empty in every stage and stay null until they are packed; rows that repeat an id
stay or go together; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm.catalog import table, tokenizer_path
from recollect.llm.exact_dedup import drop_exact_copies
from recollect.llm.jaccard import drop_near_copies
from recollect.llm.packing import pack
from recollect.llm.quality import keep_good, train
from recollect.llm.secret_scan import mask_secrets
from recollect.llm.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; it is trained on labelled ones that are not held out. Without
    labels of both classes all documents share one score."""
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space the longest stays, of equally long ones that with the smallest id."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays; texts without words have none."""
    return drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked, and n_chars follows; every document stays, null and empty ones as they are."""
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences for training, a row per piece of a document; a null or empty text is its end id alone."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_duplicates", near), ("secrets", secrets), ("packing", packing)]

#: Training a classifier and tokenising are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
