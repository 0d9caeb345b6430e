"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

All but the last return the columns of ``documents``. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from homeround.llm import decontaminate, language, near_copies, packing, pii
from homeround.llm.common import table, written
from homeround.llm.queries import tokenizer


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else docs


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those whose language the network cannot tell, go."""
    network = language.fit(docs, "lang", language.fold("doc_id") != 2)
    return language.keep_determined(docs, network)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (80 % or more of the five-word runs are common) the document of smallest id stays."""
    return near_copies.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that are mostly such passages go."""
    return _sized(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return _sized(pii.redact(docs, pii.fit(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 2,048."""
    return packing.pack(docs, tokenizer(), 2048)


STAGES = [
    ("language", known_language),
    ("near-copies", one_of_near_copies),
    ("benchmarks", without_benchmarks),
    ("personal-data", without_personal_data),
    ("packing", packed),
]

#: The stages hold a trained network, a trained field and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
