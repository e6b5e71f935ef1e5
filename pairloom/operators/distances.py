"""Preferred distances of label pairs.

Signals are long tables (name1, name2, distance, value), every distance of the window present for every pair. A
pair's signal is as long as the window, so grouping by pair is bounded however many sites there are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.functions import numerics
from pairloom.functions.storage import checkpointed, ship
from pairloom.operators.pairs import window_pairs
from pairloom.schema import Window, one_of

PAIR = ["name1", "name2"]
#: Rules whose labels are sent to all executors, to leave out sites that have none of them.
MOST_BROADCAST = 1_000_000


def count_distances(sites: DataFrame, rules: DataFrame, window: Window, percentage: bool = False, percentage_bins: int = 100) -> DataFrame:
    """How often the labels of each rule occur at each distance; 0 where they don't.

    Unless directional a pair counts for both orders, so a label with itself counts twice. Distances aren't clamped.
    With `percentage` distances are shares of the longer site, in bins; those beyond the last bin don't count.
    """
    rules = checkpointed(rules.select(*PAIR).distinct())
    # sites of other labels never reach the result
    labels = rules.select(F.col("name1").alias("_label")).union(rules.select("name2")).distinct()
    name = F.format_string("%s(%s)", "name", "strand") if window.stranded else F.col("name")
    p = window_pairs(sites.join(F.broadcast(labels), name == F.col("_label"), "left_semi") if rules.count() <= MOST_BROADCAST else sites, window, columns=("name", "strand") if window.stranded else ("name",))
    d = F.col("distance")
    last = window.max_dist
    if percentage:
        size = lambda s: F.col(f"{s}.end") - F.col(f"{s}.start")
        longer = F.greatest(size("a"), size("b"))
        share = F.when(d < 0, longer + d).otherwise(d) * percentage_bins / F.when(longer > 0, longer)
        d, last = F.when(share >= 0, F.floor(share)).otherwise(F.ceil(share)), percentage_bins
    hits = p.select(F.col("a.name").alias("name1"), F.col("b.name").alias("name2"), d.cast("int").alias("distance"))
    if percentage:
        hits = hits.where(F.col("distance").between(0, percentage_bins))
    counted = hits.groupBy(*PAIR, "distance").agg(F.count(F.lit(1)).alias("n"))
    if not window.directional:
        there, back = F.struct(*PAIR), F.struct(F.col("name2").alias("name1"), F.col("name1").alias("name2"))
        both = counted.select(F.explode(F.array(there, back)).alias("x"), "distance", "n")
        counted = both.groupBy("x.name1", "x.name2", "distance").agg(F.sum("n").alias("n"))
    first = 0 if percentage else window.min_dist
    grid = rules.select(*PAIR, F.explode(F.sequence(F.lit(first), F.lit(last))).alias("distance"))
    return grid.join(counted, [*PAIR, "distance"], "left").select(*PAIR, "distance", F.coalesce("n", F.lit(0)).cast("double").alias("value"))


def _pair() -> W:
    return W.partitionBy(*PAIR)


def scale(signal: DataFrame, how: str = "min-max") -> DataFrame:
    """Each pair's values between 0 and 1, or as shares of their sum; 0 where that is undefined."""
    one_of(how, ("min-max", "fraction"), "how")
    v = F.col("value")
    if how == "min-max":
        lo, hi = F.min(v).over(_pair()), F.max(v).over(_pair())
        x = (v - lo) / F.when(hi - lo != 0, hi - lo)
    else:
        total = F.sum(v).over(_pair())
        x = v / F.when(total != 0, total)
    return signal.withColumn("value", F.coalesce(x, F.lit(0.0)))


def halves(size: int) -> tuple[int, int]:
    """Places to the left and to the right that a window of this size takes in."""
    return (size - 1) // 2, size // 2


def smooth(signal: DataFrame, size: int = 3, reduce: bool = True) -> DataFrame:
    """The mean over a window of places, cut off at the borders; `reduce` drops the places whose window was cut off."""
    left, right = halves(size)
    w = _pair().orderBy("distance")
    out = signal.withColumn("value", F.avg("value").over(w.rowsBetween(-left, right)))
    if not reduce:
        return out
    lo, hi = F.min("distance").over(_pair()), F.max("distance").over(_pair())
    return out.withColumn("_lo", lo + left).withColumn("_hi", hi - right).where(F.col("distance").between(F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


def correct_background(signal: DataFrame, frac: float = 0.66, keep: bool = False) -> DataFrame:
    """Values less a smooth curve through them; with `keep` the curve stays as column background."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("distance")
        return p.assign(background=numerics.lowess(p.value.to_numpy(), frac))

    ship(signal.sparkSession)
    out = signal.groupBy(*PAIR).applyInPandas(work, "name1 string, name2 string, distance int, value double, background double")
    out = out.withColumn("value", F.col("value") - F.col("background"))
    return out if keep else out.drop("background")


def zscores(signal: DataFrame) -> DataFrame:
    """Each pair's values in standard deviations from their mean; 0 where there is no deviation."""
    mean, std = F.avg("value").over(_pair()), F.stddev_pop("value").over(_pair())
    return signal.withColumn("value", F.coalesce((F.col("value") - mean) / F.when(std > 0, std), F.lit(0.0)))


def find_peaks(signal: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(name1, name2, distance, height, prominence, threshold) of every peak of every pair."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("distance")
        found = numerics.find_peaks(p.value.to_numpy(), threshold)
        d = p.distance.to_numpy()
        n1, n2 = p.name1.iloc[0], p.name2.iloc[0]
        return pd.DataFrame([(n1, n2, int(d[i]), h, pr, threshold) for i, h, pr in found], columns=["name1", "name2", "distance", "height", "prominence", "threshold"])

    ship(signal.sparkSession)
    return signal.groupBy(*PAIR).applyInPandas(work, "name1 string, name2 string, distance int, height double, prominence double, threshold double")


def analyze(counts: DataFrame, signal: DataFrame, method: str = "zscore", threshold: float = 2.0, min_count: int = 1, smooth_window: int = 1) -> DataFrame:
    """Peaks of the signal with the raw counts at and around them.

    total counts a pair over the distances of the signal; pairs below min_count are left out. near counts it within
    the smoothing window of the peak, `window` names its ends. The most prominent peaks come first.
    """
    one_of(method, ("zscore", "flat"), "method")
    left, right = halves(smooth_window)
    ends = signal.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"))
    inside = counts.join(F.broadcast(ends)).where(F.col("distance").between(F.col("lo"), F.col("hi"))).drop("lo", "hi")
    totals = inside.groupBy(*PAIR).agg(F.sum("value").alias("total")).where(F.col("total") >= min_count)
    chosen = signal.join(totals.select(*PAIR), PAIR, "left_semi")
    peaks = find_peaks(zscores(chosen) if method == "zscore" else chosen, threshold)
    spans = peaks.join(F.broadcast(ends)).withColumn("lo", F.greatest(F.col("distance") - left, F.col("lo"))).withColumn("hi", F.least(F.col("distance") + right, F.col("hi")))
    raw = inside.select(*PAIR, F.col("distance").alias("at"), "value")
    near = spans.join(raw, PAIR).where(F.col("at").between(F.col("lo"), F.col("hi")))
    near = near.groupBy(*PAIR, "distance", "height", "prominence", "threshold", "lo", "hi").agg(F.sum("value").alias("near"))
    return near.join(totals, PAIR).select(
        *PAIR, "distance", "height", "prominence", "threshold", "total", "near", (F.col("near") / F.when(F.col("total") != 0, F.col("total")) * 100).alias("percent"), F.format_string("[%d;%d]", "lo", "hi").alias("window")
    ).orderBy(F.desc("prominence"), *PAIR, "distance")


def noise(signal: DataFrame, peaks: DataFrame, method: str = "median", height_multiplier: float = 0.75) -> DataFrame:
    """(name1, name2, noisiness) of the pairs with peaks: what their signal is like without them."""
    one_of(method, ("median", "min_max"), "method")

    def work(s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if s.empty or p.empty:
            return pd.DataFrame(columns=["name1", "name2", "noisiness"])
        s = s.sort_values("distance")
        first = int(s.distance.iloc[0])
        order = p.sort_values(["prominence", "distance"], ascending=[False, True])
        return pd.DataFrame([(s.name1.iloc[0], s.name2.iloc[0], numerics.cut_noise(s.value.to_numpy(), [int(d) - first for d in order.distance], method, height_multiplier))], columns=["name1", "name2", "noisiness"])

    ship(signal.sparkSession)
    return signal.groupBy(*PAIR).cogroup(peaks.groupBy(*PAIR)).applyInPandas(work, "name1 string, name2 string, noisiness double")


def dense_rank(table: DataFrame, column: str, ascending: bool = False) -> DataFrame:
    """(column, rank): the distinct values, ranked."""
    w = W.orderBy(F.col(column).asc() if ascending else F.col(column).desc())
    return table.select(column).where(F.col(column).isNotNull()).distinct().withColumn(f"rank_{column}", F.dense_rank().over(w))


def rank(peaks: DataFrame, by=("percent", "height", "noisiness"), mean: bool = True) -> DataFrame:
    """Peaks with a dense rank for each column, 1 the best (the largest; of noisiness the smallest), and their mean.

    Ranks are of distinct values, so only these pass through one place.
    """
    out = peaks
    for c in by:
        out = out.join(dense_rank(peaks, c, ascending=c == "noisiness"), c, "left")
    names = [f"rank_{c}" for c in by]
    out = out.select(*peaks.columns, *names)
    return out.withColumn("mean_rank", sum((F.col(n) for n in names), F.lit(0)) / len(names)) if mean else out


def mean_distance(signal: DataFrame) -> DataFrame:
    total = F.sum("value")
    return signal.groupBy(*PAIR).agg((F.sum(F.col("value") * F.col("distance")) / F.when(total != 0, total)).alias("mean_distance"))


def max_distance(signal: DataFrame) -> DataFrame:
    """The distance with the largest value, the first of equals."""
    best = F.max(F.struct(F.col("value").alias("v"), (-F.col("distance")).alias("d")))
    return signal.groupBy(*PAIR).agg((-best["d"]).alias("max_distance"))


def hubs(peaks: DataFrame) -> DataFrame:
    """How many second labels each first label has a peak with."""
    return peaks.groupBy("name1").agg(F.countDistinct("name2").alias("partners"))


def count_peaks(rules: DataFrame, peaks: DataFrame) -> DataFrame:
    n = peaks.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"))
    return rules.select(*PAIR).distinct().join(n, PAIR, "left").select(*PAIR, F.coalesce("n", F.lit(0)).alias("n_peaks"))


def classify(rules: DataFrame, peaks: DataFrame) -> DataFrame:
    """Rules with a column that tells whether they have a peak."""
    n = peaks.select(*PAIR).distinct().withColumn("_p", F.lit(True))
    return rules.join(n, PAIR, "left").withColumn("is_peaking", F.coalesce("_p", F.lit(False))).drop("_p")


def periodicity(signal: DataFrame, by_amplitude: bool = False) -> DataFrame:
    """(name1, name2, period, amplitude) of each pair's signal."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        a, b = numerics.periodicity(p.sort_values("distance").value.to_numpy(), by_amplitude)
        return pd.DataFrame([(p.name1.iloc[0], p.name2.iloc[0], a, b)], columns=["name1", "name2", "period", "amplitude"])

    ship(signal.sparkSession)
    return signal.groupBy(*PAIR).applyInPandas(work, "name1 string, name2 string, period double, amplitude double")


def autocorrelation(signal: DataFrame) -> DataFrame:
    """(name1, name2, lag, value): the autocorrelation of each pair's signal at each lag."""

    def work(p: pd.DataFrame) -> pd.DataFrame:
        a = numerics.autocorrelation(p.sort_values("distance").value.to_numpy())
        return pd.DataFrame({"name1": p.name1.iloc[0], "name2": p.name2.iloc[0], "lag": np.arange(1, len(a) + 1, dtype=np.int32), "value": a})

    ship(signal.sparkSession)
    return signal.groupBy(*PAIR).applyInPandas(work, "name1 string, name2 string, lag int, value double")


def collapse_negative(signal: DataFrame, how: str = "max") -> DataFrame:
    """Distances below zero as one, -1."""
    f = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum}[one_of(how, ("max", "min", "mean", "sum"), "how")]
    return signal.groupBy(*PAIR, F.when(F.col("distance") < 0, -1).otherwise(F.col("distance")).alias("distance")).agg(f("value").alias("value"))


def wide(signal: DataFrame, first: int, last: int) -> DataFrame:
    """One column for each distance."""
    return signal.groupBy(*PAIR).pivot("distance", list(range(first, last + 1))).agg(F.first("value"))


def preferred(sites: DataFrame, rules: DataFrame, window: Window, threshold: float = 2.0, smooth_window: int = 3, how: str = "min-max", correction: bool = True) -> DataFrame:
    """Count, scale, smooth, correct for the background and find peaks, in one go."""
    counts = count_distances(sites, rules, window)
    signal = smooth(scale(counts, how), smooth_window)
    if correction:
        signal = correct_background(signal)
    return analyze(counts, signal, "zscore", threshold, smooth_window=smooth_window)
