"""Chooses the settings of the toxicity model: python -m pairloom.llm.choose_toxicity FOLDER

Reads the tables `documents` and `labels` of the folder. Rows of the held-out fold are filtered out before any label is
looked at; of the learnable rows a third validates and the others train. The settings with the fewest errors in the
validation rows win, of equal ones those with the smallest log loss.
"""

from __future__ import annotations

import itertools
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import labelled, toxicity
from pairloom.llm.common import saved, table

GRID = [toxicity.Settings(prefixes, alpha, l1) for prefixes, alpha, l1 in itertools.product(((), (5,), (3, 4, 5), (4, 5, 6), (3, 4, 5, 6)), (0.3, 1.0), (0.3, 1.0))]
CUT = 0.3


def learnable(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels to train with, labels to validate with): no row of the held-out fold is in either."""
    rows = labels.where(labelled.crc_mod("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    third = F.pmod(F.xxhash64("doc_id", F.lit(77)), F.lit(3))
    rows = saved(rows.where("doc_id is not null and toxic in (0, 1)").select("doc_id", "toxic", third.alias("third")), "learnable")
    return rows.where("third <> 0"), rows.where("third = 0")


def choose(docs: DataFrame, labels: DataFrame, grid: list[toxicity.Settings] | None = None) -> list[tuple[int, float, int, toxicity.Settings]]:
    """(errors, log loss, rows, settings) on the validation rows, the best settings first."""
    train, check = learnable(docs, labels)
    known = saved(docs.join(check, "doc_id").select("doc_id", "text", "toxic"), "validation")
    out = []
    for settings in grid or GRID:
        model = toxicity.fit(docs, train, settings=settings)
        scored = toxicity.score(known, model, CUT).join(check, "doc_id")
        p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
        loss = -F.log(F.when(F.col("toxic") == 1, p).otherwise(1 - p))
        r = scored.agg(F.sum((F.col("predicted") != F.col("toxic")).cast("int")), F.avg(loss), F.count(F.lit(1))).first()
        out.append((r[0], r[1], r[2], settings))
    return sorted(out, key=lambda x: x[:2])


if __name__ == "__main__":
    session = SparkSession.builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    for errors, loss, rows, settings in choose(table(session, sys.argv[1], "documents"), table(session, sys.argv[1], "labels")):
        print(f"{errors} errors in {rows} rows, log loss {loss:.5f}: {settings}")
