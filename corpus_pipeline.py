"""A corpus pipeline of the llm operators: each stage's rows are written as Parquet and read again by the next.

The folder is a fresh one under the session's spark.checkpoint.dir (shared by driver and executors); only where that is unset in a
local session, as in tests, a temporary one is made.

Every stage keeps all columns, whatever their names; an empty table gives an empty one; repeated rows go the same way, except that
near_duplicates keeps one row of an id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tilewright.llm import langid, leaks, neardup, pieces, secrets
from tilewright.llm.common import table
from tilewright.llm.queries import piece_model
from tilewright.operators.graph import shared_folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null texts, no letter) go. Learns from the documents it gets; where none is labelled, texts
    with a letter stay."""
    return langid.keep_known(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more). Empty and null texts have
    no copies; rows with a null id stay."""
    return neardup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go, or all words of a shorter one. Null and empty texts, and all
    documents under an empty benchmark, stay."""
    return leaks.clean(docs, table(spark, sf_dir, "benchmark"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are replaced by the secrets' kinds and n_chars follows. Null and empty texts stay as they are."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256. A null text is encoded as an empty one."""
    return pieces.encode_documents(docs, piece_model())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secret", secret), ("encode", encode)]

#: Language and encoding can't be written in SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the whole documents table."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
