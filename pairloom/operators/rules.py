"""Scored label pairs: market-basket measures, selection and integration of other tables.

A rules table has name1, name2, pair, n12 (occurrences of the pair), n1 and n2 (of the labels), and measures. Its
order is not stored: operators that depend on it take the measure to order by, ties go by name1, then name2.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.operators.pairs import pair_counts, single_counts
from pairloom.functions.storage import numbered
from pairloom.schema import Window, need, one_of, pair_name

N_BASKETS = 1_000_000


def _measures(n_baskets: float) -> dict[str, Column]:
    n12, n1, n2 = (F.col(c).cast("double") for c in ("n12", "n1", "n2"))
    s12, s1, s2 = n12 / n_baskets, n1 / n_baskets, n2 / n_baskets
    return {
        "support": s12,
        "cosine": n12 / F.sqrt(n1 * n2),
        "confidence": n12 / n1,
        "lift": n12 / n1 / s2,
        "jaccard": s12 / F.when(s1 + s2 - s12 != 0, s1 + s2 - s12),
    }


MEASURES = ("support", "cosine", "confidence", "lift", "jaccard")


def ordering(measure: str = "cosine") -> list[Column]:
    return [F.col(measure).desc_nulls_last(), F.col("name1"), F.col("name2")]


def market_basket(singles: DataFrame, pairs: DataFrame, measures=("cosine",), keep_zero: bool = False, n_baskets: float = N_BASKETS, zscores: DataFrame | None = None) -> DataFrame:
    """The rules of single counts (name, n) and pair counts (name1, name2, n).

    With keep_zero every two labels have a rule: the label table, one row per label, is crossed with itself, which is
    the size of what is asked for. Shares are of n_baskets, not of the number of sites.
    """
    chosen = [measures] if isinstance(measures, str) else list(measures)
    for m in chosen:
        one_of(m, MEASURES, "measure")
    one = singles.select(F.col("name").alias("name1"), F.col("n").alias("n1"))
    two = singles.select(F.col("name").alias("name2"), F.col("n").alias("n2"))
    counted = pairs.select("name1", "name2", F.col("n").alias("n12"))
    if keep_zero:
        full = one.crossJoin(two).join(counted, ["name1", "name2"], "left").withColumn("n12", F.coalesce("n12", F.lit(0)))
    else:
        full = counted.join(one, "name1").join(two, "name2").where("n12 > 0")
    exprs = _measures(n_baskets)
    out = full.select("name1", "name2", pair_name().alias("pair"), "n12", "n1", "n2", *[exprs[m].alias(m) for m in chosen])
    return out.join(zscores.select("name1", "name2", "zscore"), ["name1", "name2"], "left") if zscores is not None else out


def rules_of(sites: DataFrame, window: Window, measures=("cosine",), **more) -> DataFrame:
    """Count and score in one go."""
    return market_basket(single_counts(sites, window.stranded), pair_counts(sites, window), measures, **more)


def label_table(rules: DataFrame) -> DataFrame:
    """(name, n1, n2) of the labels that stand on both sides of some rule."""
    a = rules.select(F.col("name1").alias("name"), "n1").distinct()
    return a.join(rules.select(F.col("name2").alias("name"), "n2").distinct(), "name")


def simplify(rules: DataFrame, measure: str = "cosine") -> DataFrame:
    """Of A-B and B-A the first in the table's order; a label with itself stays."""
    w = W.partitionBy(F.least("name1", "name2"), F.greatest("name1", "name2")).orderBy(*ordering(measure))
    return rules.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(rules: DataFrame, measure: str = "cosine") -> DataFrame:
    """The rules with their place in the order, from 1, as column rank; no rule passes through one task."""
    return numbered(rules, ordering(measure), "_place").withColumn("rank", (F.col("_place") + 1).cast("int")).drop("_place")


def top(rules: DataFrame, n: int, measure: str = "cosine") -> DataFrame:
    """The first n rules."""
    return rules.orderBy(*ordering(measure)).limit(n)


def with_labels(rules: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Rules whose labels are among `names`: both (inner), either (outer), the first (left) or the second (right)."""
    one_of(how, ("inner", "outer", "left", "right"), "how")
    a, b = F.col("name1").isin(names), F.col("name2").isin(names)
    return rules.where({"inner": a & b, "outer": a | b, "left": a, "right": b}[how])


def named(rules: DataFrame, pairs: list[str]) -> DataFrame:
    """The rules with these pair names, with their place in the list; a name that no rule has is an error."""
    wanted = rules.sparkSession.createDataFrame(list(enumerate(pairs)), "place int, pair string")
    missing = [r.pair for r in wanted.join(rules, "pair", "left_anti").collect()]
    if missing:
        raise KeyError(f"no such rules: {', '.join(missing)}")
    return rules.join(F.broadcast(wanted), "pair")


def significant(rules: DataFrame, x: str = "cosine", y: str = "zscore", x_threshold: float | None = None, y_threshold: float | None = None, percent: float = 0.05) -> DataFrame:
    """Rules that reach both thresholds. One that isn't given is the upper `percent` quantile of a distribution fitted to the column."""
    from pairloom.functions.thresholds import threshold

    need(rules, x, y)
    if rules.where(F.abs(F.col(x)).isin(float("inf")) | F.abs(F.col(y)).isin(float("inf"))).limit(1).count():
        warnings.warn("some values are infinite and are left out of fits", stacklevel=2)
    tx = threshold(rules, x, percent)[1] if x_threshold is None else x_threshold
    ty = threshold(rules, y, percent)[1] if y_threshold is None else y_threshold
    return rules.where((F.col(x) >= tx) & (F.col(y) >= ty))


def integrate(rules: DataFrame, table: DataFrame, merge: str = "pair", col1: str = "name1", col2: str = "name2", prefix: str = "") -> DataFrame:
    """Left-join a table by pair, or by its first or second label. Columns that rules have already get a suffix."""
    one_of(merge, ("pair", "name1", "name2"), "merge")
    keys = {"pair": {col1: "name1", col2: "name2"}, "name1": {col1: "name1"}, "name2": {col2: "name2"}}[merge]
    need(table, *keys)
    t = table.dropDuplicates()
    named = []
    for c in t.columns:
        if c in keys:
            named.append(F.col(c).alias(keys[c]))
        else:
            n = f"{prefix}{c}"
            named.append(F.col(c).alias(f"{n}_y" if n in rules.columns else n))
    return rules.join(t.select(*named), list(keys.values()), "left")


def restrict_sites(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """Sites whose label (and strand, if rules are of stranded labels) stands in some rule."""
    names = rules.select(F.col("name1").alias("n")).union(rules.select("name2")).distinct()
    split = names.select(F.regexp_extract("n", r"^(.+)\(([+-.])\)$", 1).alias("name"), F.regexp_extract("n", r"^(.+)\(([+-.])\)$", 2).alias("strand"), "n")
    by_strand = split.where("name <> ''").select("name", "strand")
    plain = split.where("name = ''").select(F.col("n").alias("name"))
    return sites.join(plain, "name", "left_semi").select(*sites.columns).unionByName(sites.join(plain, "name", "left_anti").join(by_strand, ["name", "strand"], "left_semi").select(*sites.columns))
