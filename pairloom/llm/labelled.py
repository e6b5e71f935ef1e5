"""Bounded, reproducible samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import long_id


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int) -> DataFrame:
    """(label, text) of at most `most` labelled documents outside the held-out fold, half of them from each class if there are enough.

    The rows are those of the smallest hashes of doc_id, so the same tables give the same sample. Rows with a null
    id or label are left out; of labels that repeat an id the smallest counts. Only ids (at most `most`) are
    broadcast; texts are whole. Ids that are no whole numbers raise.
    """
    known = (
        labels.select(long_id(labels), F.col(label).cast("int").alias("label"))
        .where(f"doc_id is not null and label in (0, 1) and {folds} > 0")
        .where(crc_mod("doc_id", folds) != held)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
        .withColumn("h", F.xxhash64("doc_id"))
    )
    parts = [known.where(f"label = {y}").orderBy("h", "doc_id").limit(most // 2) for y in (0, 1)]
    ids = parts[0].unionByName(parts[1]).select("doc_id", "label")
    texts = docs.select(long_id(docs), "text")
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
