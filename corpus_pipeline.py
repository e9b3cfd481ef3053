"""The corpus pipeline: five stages over documents, each written and read again by the next.

toxicity drops documents, lines drops boilerplate lines, near_duplicates keeps one
document of each group, pii replaces personal data, packing makes sequences. All but
the last return the columns of documents; n_chars follows the text where it changes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeworks.llm import lines, packing, pii, simhash, toxicity
from plumeworks.llm.common import checkpoint_folder, table
from plumeworks.llm.queries import BYTE_BPE

#: SQL has no Kneser-Ney models, XXH64, belief propagation or tokenizers.
ORACLE_SQL = None


def _counted(after: DataFrame, columns: list[str]) -> DataFrame:
    n = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")
    return (after.withColumn("n_chars", n) if "n_chars" in columns else after).select(*[f"`{c}`" for c in columns])


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. Labels of documents that are not in docs are not learned from; null and empty texts have features of zero, repeated rows go or stay alike, and without labels all stay; an empty table stays empty."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source; null texts stay null, repeated rows are each kept, an empty table stays empty."""
    return _counted(lines.drop_lines(docs), docs.columns)


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id. Fingerprints are of five-word shingles. Null and empty texts are one group, of repeated rows one stays, an empty table stays empty."""
    return simhash.drop_near_duplicates(docs, words=5)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null, repeated rows are each kept, an empty table stays empty."""
    return _counted(pii.redact_documents(docs, pii.train(docs)), docs.columns)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents; a null or empty text is one piece, repeated rows are packed each on its own, an empty table gives none."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [("toxicity", stage_toxicity), ("lines", stage_lines), ("near_duplicates", stage_near_duplicates), ("pii", stage_pii), ("packing", stage_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each result is a Parquet table in the shared folder."""
    docs, top = table(spark, sf_dir, "documents"), f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}-{name}")
        docs = spark.read.parquet(f"{top}/{k}-{name}")
    return docs
