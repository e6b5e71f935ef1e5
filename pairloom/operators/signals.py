"""Signals around pair occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.schema import one_of


def windows(pairs: DataFrame, flank: int | tuple[int, int] = 100, align: str = "center") -> DataFrame:
    """Pairs with pair_id, window_start, window_end, flip and where their sites lie in the window.

    The window reaches out from the middle of the gap, the end of the first site or the start of the second. A pair
    whose first label sorts before its second is turned round: sites change places and the window runs backwards.
    """
    one_of(align, ("center", "left", "right"), "align")
    left, right = flank if isinstance(flank, tuple) else (flank, flank)
    flip = F.col("site1_name") < F.col("site2_name")
    half = F.floor(F.col("distance") / 2)
    anchor = {
        "center": F.when(flip, F.col("site2_start") - half).otherwise(F.col("site1_end") + half),
        "left": F.when(flip, F.col("site2_start")).otherwise(F.col("site1_end")),
        "right": F.when(flip, F.col("site1_end")).otherwise(F.col("site2_start")),
    }[align]
    p = pairs.withColumn("flip", flip).withColumn("_anchor", anchor)
    p = p.withColumn("window_start", F.when(F.col("flip"), F.col("_anchor") - right).otherwise(F.col("_anchor") - left)).withColumn("window_end", F.when(F.col("flip"), F.col("_anchor") + left).otherwise(F.col("_anchor") + right))
    # turned round, places count down from the window's end, and each site takes the other's part
    for n, other in ((1, 2), (2, 1)):
        for c, far in (("start", "end"), ("end", "start")):
            p = p.withColumn(f"site{n}_rel_{c}", F.when(F.col("flip"), F.col("window_end") - F.col(f"site{other}_{far}")).otherwise(F.col(f"site{n}_{c}") - F.col("window_start")))
    key = F.xxhash64("site1_contig", "site1_start", "site1_end", "site1_name", "site2_start", "site2_end", "site2_name", *([c for c in ("site1_site_id", "site2_site_id") if c in pairs.columns]))
    return p.withColumn("pair_id", key).drop("_anchor")


def window_values(framed: DataFrame, signal: DataFrame, width: int = 4096) -> DataFrame:
    """(pair_id, position, value): the signal (contig, start, end, value) at each place of each window; 0 where there is none."""
    w = framed.select("pair_id", F.col("site1_contig").alias("contig"), "window_start", "window_end", "flip")
    w = w.withColumn("bin", F.explode(F.sequence(F.floor(F.col("window_start") / width), F.floor((F.col("window_end") - 1) / width))))
    s = signal.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))))
    lo = F.greatest("window_start", "start", F.col("bin") * width)
    hi = F.least("window_end", "end", (F.col("bin") + 1) * width)
    j = w.join(s, ["contig", "bin"]).withColumn("_lo", lo).withColumn("_hi", hi).where("_hi > _lo")
    j = j.select("pair_id", "window_start", "window_end", "flip", "value", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("at"))
    hit = j.select("pair_id", F.when(F.col("flip"), F.col("window_end") - 1 - F.col("at")).otherwise(F.col("at") - F.col("window_start")).alias("position"), "value")
    hit = hit.groupBy("pair_id", "position").agg(F.max("value").alias("value"))
    grid = framed.select("pair_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("window_end") - F.col("window_start") - 1)).alias("position")).distinct()
    return grid.join(hit, ["pair_id", "position"], "left").select("pair_id", "position", F.coalesce("value", F.lit(0.0)).alias("value"))


def log_scores(values: DataFrame) -> DataFrame:
    """Values as the logarithm of one more than their size, with their sign."""
    return values.withColumn("value", F.signum("value") * F.log1p(F.abs("value")))


def track(values: DataFrame, framed: DataFrame, distances: list[int] | None = None) -> DataFrame:
    """(position, value): the mean signal over the windows of pairs, of certain distances if these are given."""
    chosen = framed if distances is None else framed.where(F.col("distance").isin(distances))
    return values.join(chosen.select("pair_id").distinct(), "pair_id", "left_semi").groupBy("position").agg(F.avg("value").alias("value"))


def animation(values: DataFrame, framed: DataFrame, size: int, step: int) -> DataFrame:
    """(frame, position, value): the mean signal of each group of `size` pairs, in order of distance, a group every `step` pairs."""
    order = [F.col("distance"), F.col("site1_rel_start"), F.col("pair_id")]
    ranked = framed.select("pair_id", "distance", "site1_rel_start").distinct()
    from pairloom.functions.storage import numbered

    ranked = numbered(ranked, order, "place")
    first = F.greatest(F.lit(0), F.ceil((F.col("place") - size + 1) / step))
    last = F.floor(F.col("place") / step)
    frames = ranked.where(first <= last).select("pair_id", F.explode(F.sequence(first, last)).alias("frame"))
    return values.join(frames, "pair_id").groupBy("frame", "position").agg(F.avg("value").alias("value"))


def lines(pairs: DataFrame, x: str, y: str) -> DataFrame:
    """(x, y, n): the mean of y at each x over both sites of the pairs; x and y name columns without site1_ or site2_, or of the pair."""
    get = lambda c, n: F.col(f"site{n}_{c}" if f"site{n}_{c}" in pairs.columns else c)
    long = pairs.select(F.explode(F.array(*[F.struct(get(x, n).alias("x"), get(y, n).cast("double").alias("y")) for n in (1, 2)])).alias("p")).select("p.*")
    return long.groupBy("x").agg(F.avg("y").alias("y"), F.count("y").alias("n"))


def distances_by_orientation(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("orientation", "distance").agg(F.count(F.lit(1)).alias("n"))


def in_order(framed: DataFrame) -> DataFrame:
    """Pairs with their place by distance, then by where their first site lies; one window over all pairs would not scale, so places run within a distance."""
    return framed.withColumn("place", F.row_number().over(W.partitionBy("distance").orderBy("site1_rel_start", "pair_id")))
