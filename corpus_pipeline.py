"""A training corpus in five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir). All but the last return the columns of ``docs``; run() writes
each result to the shared folder and hands the reread table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm import common, line_quality, line_runs, near_dup, packing, qgram_decontam
from paceforge.session import stage


def _measured(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``; n_chars follows the text."""
    columns = [F.length("text").cast(kind).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c, kind in docs.dtypes]
    return out.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and keep enough words, without their host's frequent lines.

    Null and empty texts fail the rules. Repeated rows are judged alike and all stay.
    """
    return _measured(line_quality.remove_frequent_lines(docs), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later copies of line runs; n_chars follows the text.

    Every row stays, null texts as they are; a document that repeats another as a whole has an empty text.
    """
    return _measured(line_runs.remove_repeated_lines(docs, counts=None), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, and one row of each document.

    A document is a doc_id with its text: other texts of a repeated doc_id, and texts without one, are
    documents of their own and come after all others in their group. Empty texts have no duplicates.
    """
    key = common.unused(docs, "key")
    rows = common.with_text_ids(docs, key)
    verdicts = near_dup.near_duplicates(rows.select(F.col(f"`{key}`").alias("doc_id"), "text"))
    dropped = verdicts.filter("NOT kept").select(F.col("doc_id").alias(key)).distinct()
    return common.once_each(rows.join(dropped, key, "left_anti"), key).select(*[F.col(f"`{c}`") for c in docs.columns])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Rows leave by doc_id and text, so a passage in one text says nothing of others with its doc_id, or none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = common.unused(docs, "key")
    rows = common.with_text_ids(docs, key)
    found = qgram_decontam.find_leaks(rows.select(F.col(f"`{key}`").alias("doc_id"), "text"), benchmark)
    leaks = found.select(F.col("doc_id").alias(key)).distinct()
    return rows.join(leaks, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in bins, one row each; documents without words have a row without a bin.

    Rows without a source or doc_id are packed like others; repeated rows are pieces of their own.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: Packing places pieces one after another, which SQL can't express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
