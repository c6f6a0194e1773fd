"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame.

Stages but the last return the columns of documents.  run() writes each and
reads it again before the next, in the folder of spark.checkpoint.dir, and
deletes it once its successor is written; the last stays for the caller.

Every stage takes an empty table to an empty one, and columns beyond those of
documents pass through whatever their names, until the last stage, which gives
its own.  Rows with equal doc_id stay rows of their own, but count as one
document where lines or texts are compared.  A null lang or source is a value
like another; what a null or empty text does is said at each stage.
"""
from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import bpe, langid, linededup, mixing, neardup
from lodestrata.llm.common import shared_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters, null and empty texts among them, and those whose language stays unclear."""
    return langid.accept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document of smaller id holds, and documents that lose all; texts that came null or empty and rows with a null doc_id stay."""
    return linededup.dedup_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near duplicates: five-word shingles, similarity 0.8.

    Texts without words are one group; rows with a null doc_id stay."""
    return neardup.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix of sources; a row for each pass over a document.  Texts without words are never drawn."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the mix."""
    return bpe.tokenize(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [("language ID", language), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixture), ("byte BPE", encode)]

#: A learned stage and a pseudorandom draw have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    top = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
        if k:
            old = spark._jvm.org.apache.hadoop.fs.Path(f"{top}/{k - 1}")
            old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return docs
