"""From documents to packed sequences: quality, line dedup, near-dedup, packing.

Every stage but the last returns the columns of its input and no others, whatever their names (those
beginning with ``_qc_``, ``_ld_`` or ``_nd_`` are reserved). Null and empty texts, null ids, very long
texts, ties and repeated rows have the results that the operators' docstrings state; an empty table
gives no rows at each stage. Stages are written in the shared folder, so a lost executor costs tasks only.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.llm.common import table, written
from brambling.llm.linededup import cut_lines
from brambling.llm.neardup import drop_near_duplicates
from brambling.llm.packing import pack_documents
from brambling.llm.quality import scored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; one without text follows its path, and repeated rows are judged one by one."""
    return scored(docs, table(spark, sf_dir, "labels")).filter("_qc_keep").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the later copies of repeated runs of lines; its text may become empty, a null one stays."""
    cut = cut_lines(docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col("_ld_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates: that of least id; equal blank texts are a group, null texts all stay."""
    return drop_near_duplicates(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences; one without text is a piece of one id."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("line dedup", line_dedup_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("best-fit packing", packing_stage),
]

#: The fitted classifier and the packing plan can't be written as SQL; tests/llm/test_whole.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
