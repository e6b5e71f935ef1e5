"""The queries opN_<name> over whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import decontam, idstore, licences, packing, pages, quality, simhash, tokens, toxicity, vectors
from pairloom.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of `documents`.

    Null texts are empty (0 bytes, 0 tokens); null ids and repeated rows stay, an empty table gives no rows,
    other columns are not read.
    """
    return tokens.count_tokens(table(spark, sf_dir, "documents"), limit=2048)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every row of `pages`.

    A null or empty html has an empty text; null ids and urls and repeated rows stay, an empty table gives no
    rows, other columns are not read.
    """
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of `documents`.

    Null and empty texts have no words and no label; null ids and repeated rows stay, an empty table gives no
    rows, other columns are not read.
    """
    return licences.report(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, first, n_tokens, bin_id: every token of `documents` in one piece, every piece in one bin.

    Null texts are empty, an empty text is a piece of no tokens; null ids and repeated rows stay, a null source
    conflicts with nothing, an empty table gives no pieces.
    """
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `embeddings`.

    Rows whose id, label or vector can't link (null, zero, null or non-finite components) are alone; repeated
    ids are vectors of their own, an empty table gives no rows.
    """
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of `documents`.

    Null and empty texts score by the bias alone; a null id has held_out null, repeated rows score alike, an
    empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of `documents`, read back from the written files by its key.

    Null texts have the end id alone; rows without id come first, rows that repeat one lie next to each other,
    each with its own key; an empty table gives no rows.
    """
    return idstore.encode_store_read(spark, table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near of every row of `documents`.

    Null texts have no words; null ids and repeated rows stay, items without id or text have no window, an empty
    table gives no rows.
    """
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, offending of every row of `documents`.

    Null and empty texts score 0; a null id has held_out null, repeated rows score alike, an empty table gives
    no rows.
    """
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of `documents`.

    Null and empty texts have fingerprint zero; null ids count as larger than any other, repeated rows stay, an
    empty table gives no rows.
    """
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_main_text": op2_main_text,
    "op3_licences": op3_licences,
    "op4_packing": op4_packing,
    "op5_vectors": op5_vectors,
    "op6_quality": op6_quality,
    "op7_token_ids": op7_token_ids,
    "op8_decontamination": op8_decontamination,
    "op9_toxicity": op9_toxicity,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {"op5_vectors": vectors.ORACLE, "op8_decontamination": decontam.ORACLE}
