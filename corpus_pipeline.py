"""The training-data pipeline: documents in, token files out.

Each stage works on all that the stage before it kept; between stages the documents are a table in the shared folder.
SQL can express neither MinHash pruning nor tokenizing, so ORACLE_SQL is None and tests compare run() with a plain
reimplementation on small inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm.common import settle, table
from sparkloom.llm.decontaminate import without_leaks
from sparkloom.llm.mixing import REPEATS, mix, training_order
from sparkloom.llm.near_duplicates import one_of_each
from sparkloom.llm.quality_rules import clean_documents
from sparkloom.llm.token_output import token_digest


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, cut to their good lines."""
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id from each group of near duplicates."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, and documents of small sources again, up to the repetition limit."""
    return mix(docs, repeats=REPEATS)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read back from the token files, which hold the documents in the order in which
    mixing drew them: epoch by epoch, so that no copy lies beside its original."""
    return token_digest(spark, *training_order(docs))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token output", token_output),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from the documents table through all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
