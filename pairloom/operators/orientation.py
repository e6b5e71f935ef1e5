"""Strand orientation of label pairs from the counts of stranded labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import numerics
from pairloom.functions.storage import ship

DIRECTIONAL = ("1-2", "2-1", "convergent", "divergent")
SIMPLE = ("same", "opposite")


def _split(rules: DataFrame) -> DataFrame:
    part = lambda c, i: F.regexp_extract(c, r"^(.*)\(([^()]*)\)$", i)
    return rules.select(part("name1", 1).alias("a"), part("name1", 2).alias("sa"), part("name2", 1).alias("b"), part("name2", 2).alias("sb"), F.col("n12").cast("long").alias("n"))


def orientation(rules: DataFrame, directional: bool = False, p_values: bool = True) -> DataFrame:
    """One row per pair of labels: counts and shares of each scenario, their standard deviation, chi-square statistic and p-value.

    Rules are of labels name(strand). Undirected ones are first cut to one row per two stranded labels and sorted into
    same and opposite; directed ones into both orders on the strand, convergent and divergent. Strands other than +
    and - belong to no scenario. With p-values the rows are in their order, the smallest first.
    """
    r = _split(rules)
    if not directional:
        whole = lambda x, s: F.concat(x, F.lit("("), s, F.lit(")"))
        one, two = whole(F.col("a"), F.col("sa")), whole(F.col("b"), F.col("sb"))
        # one row of A(+)-B(-) and B(-)-A(+); both hold the same count
        r = r.groupBy(F.least(one, two).alias("_x"), F.greatest(one, two).alias("_y")).agg(F.min(F.struct("a", "sa", "b", "sb", "n")).alias("r")).select("r.*")
    swap = F.col("a") > F.col("b")
    r = r.select(F.least("a", "b").alias("name1"), F.greatest("a", "b").alias("name2"), F.when(swap, F.col("sb")).otherwise(F.col("sa")).alias("s1"), F.when(swap, F.col("sa")).otherwise(F.col("sb")).alias("s2"), swap.alias("swap"), "n")
    key = F.concat(F.when(F.col("swap"), "b").otherwise("a"), "s1", "s2")
    self_ = F.col("name1") == F.col("name2")
    if directional:
        sets = {"1-2": (["a++", "b--"], ["a++", "a--"]), "2-1": (["b++", "a--"], ["a++", "a--"]), "convergent": (["a+-", "b-+"], ["a+-"]), "divergent": (["a-+", "b+-"], ["a-+"])}
    else:
        sets = {"same": (["a++", "b++", "a--", "b--"], ["a++", "a--"]), "opposite": (["a+-", "b+-", "a-+", "b-+"], ["a+-", "a-+"])}
    names = list(sets)
    sums = [F.sum(F.when((self_ & key.isin(alike)) | (~self_ & key.isin(apart)), F.col("n")).otherwise(0)).alias(k) for k, (apart, alike) in sets.items()]
    wide = r.groupBy("name1", "name2").agg(*sums)
    q = lambda k: F.col(f"`{k}`")
    total = sum((q(k) for k in names[1:]), q(names[0]))
    n = len(names)
    out = wide.withColumn("total", total).where("total > 0")
    share = {k: q(k) / F.col("total") for k in names}
    mean = F.lit(1.0 / n)
    out = out.select("name1", "name2", "total", *[q(k) for k in names], *[x.alias(f"{k}_share") for k, x in share.items()], F.sqrt(sum(((x - mean) * (x - mean) for x in share.values()), F.lit(0.0)) / (n - 1)).alias("std"), (sum(((q(k) - F.col("total") / n) * (q(k) - F.col("total") / n) for k in names), F.lit(0.0)) / (F.col("total") / n)).alias("chi2"))
    if not p_values:
        return out

    ship(rules.sparkSession)

    @F.pandas_udf("double")
    def p(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: numerics.uniform_p(c))

    # each combination of counts is tested once
    counts = out.select(*[q(k) for k in names]).distinct().withColumn("pvalue", p(F.array(*[q(k) for k in names])))
    return out.join(counts, names).orderBy("pvalue", F.desc("total"), "name1", "name2")
