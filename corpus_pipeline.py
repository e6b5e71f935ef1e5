"""A corpus pipeline of five stages over `documents`.

Rejects low quality, then toxic documents, keeps one document of each group of near-duplicates, drops documents that
hold benchmark passages, and packs what is left into training bins. Every stage works on all rows that the stage
before it kept, judges each row by its whole text, and all but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontam, packing, quality, simhash, toxicity
from pairloom.llm.common import drop, saved_at, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. It learns from the labelled rows of the table `documents`.

    Null and empty texts are judged by the bias alone; null ids, repeated rows and further columns stay as they are.
    """
    return quality.keep_good(docs, quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic. The sentences' scores are learnt from the labelled rows of the table `documents`.

    Null and empty texts are clean; null ids, repeated rows and further columns stay as they are.
    """
    return toxicity.keep_clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, its smallest doc_id.

    Null and empty texts are one group. Of rows that repeat the id one stays; a group without ids keeps one row.
    """
    return simhash.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs.

    Null and empty texts stay, and so does everything if the benchmark is empty; null ids and repeated rows too.
    """
    return decontam.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every token of the documents left, in bins: doc_id, piece, first, n_tokens, bin_id. An empty text is a piece of no tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The classifiers and the packing have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again before the next; what a stage has read is deleted then.

    Empty tables pass through all stages and give no rows.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, at = saved_at(stage(spark, docs, sf_dir), name)
        if before:
            drop(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
