"""Comparison of rules tables of several samples."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pairloom.functions.storage import checkpointed
from pairloom.schema import need, one_of

PAIR = ["name1", "name2"]


def combine(samples: dict[str, DataFrame], measure: str = "cosine", join: str = "inner", fill: float = 0.0) -> DataFrame:
    """One row per pair with column <sample>_<measure> for each sample.

    inner keeps pairs that all samples have, of labels that all samples have; outer keeps all, with `fill` for gaps.
    """
    one_of(join, ("inner", "outer"), "join")
    parts = []
    for name, rules in samples.items():
        need(rules, *PAIR, measure)
        # a row for each pair of labels, used several times
        parts.append(checkpointed(rules.select(*PAIR, F.col(measure).alias(f"{name}_{measure}"))))
    if join == "inner":
        labels = [p.select(F.col("name1").alias("l")).union(p.select("name2")).distinct() for p in parts]
        shared = reduce(lambda a, b: a.join(b, "l", "left_semi"), labels)
        parts = [p.join(shared.select(F.col("l").alias("name1")), "name1", "left_semi").join(shared.select(F.col("l").alias("name2")), "name2", "left_semi") for p in parts]
        return reduce(lambda a, b: a.join(b, PAIR), parts)
    out = reduce(lambda a, b: a.join(b, PAIR, "full"), parts)
    return out.na.fill(fill, [c for c in out.columns if c not in PAIR])


def value_columns(table: DataFrame, measure: str = "cosine") -> list[str]:
    return [c for c in table.columns if c.endswith(f"_{measure}")]


def normalize(table: DataFrame, measure: str = "cosine") -> DataFrame:
    """Quantile normalisation: every sample takes the same distribution, the mean over samples at each rank.

    Ties take the mean of what their ranks would; 0 stays 0 and null stays null. Ranks are of the rules table, one
    window for each sample.
    """
    cols = value_columns(table, measure)
    long = table.select(*PAIR, F.explode(F.array(*[F.struct(F.lit(c).alias("sample"), F.col(f"`{c}`").alias("v")) for c in cols])).alias("x")).select(*PAIR, "x.*").where("v is not null")
    ranked = long.withColumn("k", F.row_number().over(W.partitionBy("sample").orderBy("v", *PAIR)))
    means = ranked.groupBy("k").agg(F.avg("v").alias("m"))
    tied = ranked.join(means, "k").withColumn("q", F.avg("m").over(W.partitionBy("sample", "v")))
    back = tied.groupBy(*PAIR).pivot("sample", cols).agg(F.first(F.when(F.col("v") == 0, 0.0).otherwise(F.col("q"))))
    return table.drop(*cols).join(back, PAIR, "left").select(*table.columns)


def fold_change(a: Column, b: Column, pseudo: float = 0.01) -> Column:
    """log2 of the ratio of two values, each with `pseudo` added; null where the ratio isn't positive."""
    ratio = (a + pseudo) / F.when(b + pseudo != 0, b + pseudo)
    return F.when(ratio > 0, F.log2(ratio))


def contrasts(table: DataFrame, measure: str = "cosine") -> list[tuple[str, str]]:
    """Every two samples, in order of their columns."""
    return list(combinations([c.removesuffix(f"_{measure}") for c in value_columns(table, measure)], 2))


def fold_changes(table: DataFrame, measure: str = "cosine", pseudo: float = 0.01) -> DataFrame:
    """With a column <a>/<b>_<measure>_log2fc for every two samples, in ascending order of the first."""
    two = contrasts(table, measure)
    out = table.select("*", *[fold_change(F.col(f"`{a}_{measure}`"), F.col(f"`{b}_{measure}`"), pseudo).alias(f"{a}/{b}_{measure}_log2fc") for a, b in two])
    return out.orderBy(F.col(f"`{two[0][0]}/{two[0][1]}_{measure}_log2fc`").asc_nulls_last(), *PAIR) if two else out


def select(table: DataFrame, contrast: tuple[str, str] | None = None, measure: str = "cosine", bounds: tuple[float, float] | None = None, least_mean: float | None = None, percent: float = 0.05) -> DataFrame:
    """Rules whose fold change lies at or beyond the bounds and whose mean over both samples is large enough.

    Bounds that aren't given come from distributions fitted to the rules whose mean is above 0.
    """
    a, b = contrast or contrasts(table, measure)[0]
    fc = F.col(f"`{a}/{b}_{measure}_log2fc`")
    mean = (F.col(f"`{a}_{measure}`") + F.col(f"`{b}_{measure}`")) / 2
    if bounds is None or least_mean is None:
        from pairloom.functions.thresholds import threshold

        fitted = table.select(fc.alias("fc"), mean.alias("mean")).where("mean > 0")
        bounds = bounds or threshold(fitted, "fc", percent)
        least_mean = threshold(fitted, "mean", percent)[1] if least_mean is None else least_mean
    return table.where(((fc <= bounds[0]) | (fc >= bounds[1])) & (mean >= least_mean))


def correlation(table: DataFrame, measure: str = "cosine", method: str = "pearson") -> DataFrame:
    """(sample1, sample2, r) of every two samples, themselves included."""
    one_of(method, ("pearson", "spearman"), "method")
    cols = value_columns(table, measure)
    t = table
    if method == "spearman":
        for c in cols:
            w = W.partitionBy(F.lit(0)).orderBy(f"`{c}`")
            same = W.partitionBy(f"`{c}`")
            t = t.withColumn("_r", F.row_number().over(w)).withColumn(c, F.avg("_r").over(same).cast(T.DoubleType())).drop("_r")
    row = t.agg(*[F.corr(f"`{a}`", f"`{b}`").alias(f"{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols)])
    out = [F.struct(F.lit(a.removesuffix(f"_{measure}")).alias("sample1"), F.lit(b.removesuffix(f"_{measure}")).alias("sample2"), F.col(f"{i}_{j}").alias("r")) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return row.select(F.explode(F.array(*out)).alias("x")).select("x.*")
