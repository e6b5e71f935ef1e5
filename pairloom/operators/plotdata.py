"""The tables behind the figures: what to draw, without drawing it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.rules import ordering


def bubble(rules: DataFrame, by: str = "cosine", n: int = 20) -> DataFrame:
    return rules.orderBy(*ordering(by)).limit(n)


def heatmap(rules: DataFrame, by: str = "cosine", n: int = 20) -> DataFrame:
    """(name1, name2, value): every two of the labels in the first n rules, 0 where they have no rule."""
    first = rules.orderBy(*ordering(by)).limit(n)
    a, b = first.select("name1").distinct(), first.select("name2").distinct()
    return a.crossJoin(F.broadcast(b)).join(rules.select("name1", "name2", F.col(by).alias("value")), ["name1", "name2"], "left").na.fill(0.0, ["value"])


def scatter(rules: DataFrame, x: str, y: str, least_x: float, least_y: float) -> DataFrame:
    """Finite points with a flag for those at or above both thresholds."""
    inf = float("inf")
    return rules.where((F.abs(x) < inf) & (F.abs(y) < inf)).select("pair", F.col(x).alias("x"), F.col(y).alias("y"), ((F.col(x) >= least_x) & (F.col(y) >= least_y)).alias("selected"))


def term_bubble(enriched: DataFrame, aspect: str, n: int = 20) -> DataFrame:
    out = enriched.where(F.col("aspect") == aspect).withColumn("minus_log_fdr", -F.log(F.greatest("fdr", F.lit(1e-300))))
    return out.orderBy("fdr", F.desc("count"), "term").limit(n)


def scaled(table: DataFrame, column: str, out: str = "size", lo: float = 1.0, hi: float = 10.0) -> DataFrame:
    """With `column` laid between lo and hi as sizes of nodes or edges."""
    ends = table.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    share = (F.col(column) - F.col("_lo")) / F.when(F.col("_hi") > F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return table.join(F.broadcast(ends)).withColumn(out, lo + F.coalesce(share, F.lit(0.0)) * (hi - lo)).drop("_lo", "_hi")


def genome_view(sites: DataFrame, contig: str | None = None, start: int | None = None, end: int | None = None, n: int = 100) -> DataFrame:
    """Sites inside the window; without one the first n of the first contig."""
    if contig is not None:
        s = sites.where(F.col("contig") == contig)
        return s.where((F.col("start") >= start) & (F.col("end") <= end)) if start is not None else s.orderBy("start", "end", "site_id").limit(n)
    first = sites.agg(F.min("contig").alias("contig"))
    return sites.join(F.broadcast(first), "contig", "left_semi").select(*sites.columns).orderBy("start", "end", "site_id").limit(n)


def extremes(table: DataFrame, column: str, n: int = 10) -> DataFrame:
    """The n rows with the smallest and the n with the largest values."""
    c = F.col(f"`{column}`")
    low = table.where(c.isNotNull()).orderBy(c, "name1", "name2").limit(n).withColumn("end", F.lit("low"))
    high = table.where(c.isNotNull()).orderBy(c.desc(), "name1", "name2").limit(n).withColumn("end", F.lit("high"))
    return low.unionByName(high)


def one_signal(signal: DataFrame, name1: str, name2: str) -> DataFrame:
    return signal.where((F.col("name1") == name1) & (F.col("name2") == name2)).select("distance", "value")


def shares(oriented: DataFrame) -> DataFrame:
    """(pair, scenario, share) of an orientation table."""
    cols = [c for c in oriented.columns if c.endswith("_share")]
    return oriented.select(F.concat_ws("-", "name1", "name2").alias("pair"), F.explode(F.array(*[F.struct(F.lit(c.removesuffix("_share")).alias("scenario"), F.col(f"`{c}`").alias("share")) for c in cols])).alias("x")).select("pair", "x.*")

