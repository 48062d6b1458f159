"""Documents to packed training sequences in five stages; each stage reads what the one before has kept.

All stages return the columns of ``documents`` but the last, which returns the pieces of the packed
sequences with their ids. Stages follow the defined results of their operators for nulls, empty and repeated rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import language, minhash, mixing, packing, secrets
from maskwright.llm.common import fold, packed, unpacked
from maskwright.session import ensure_checkpoint_dir


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has letters and is not too far from every learned language."""
    rows = packed(docs, "doc_id", "text", "lang")
    model = language.fit(rows.where(fold("doc_id", 5) != 0))
    return unpacked(language.predict(rows.select("row", "text"), model).where("NOT __rejected"))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: the one with the smallest id."""
    return minhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every piece with its place in a sequence."""
    return packing.pack(docs, with_ids=True)


STAGES = [
    ("language", keep_known_language),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: The trained language model, MinHash and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written as Parquet to the shared folder and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
