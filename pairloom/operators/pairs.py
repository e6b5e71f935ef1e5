"""Windowed self-join of intervals: which sites lie within a distance of each other.

Of two sites the earlier is the one that sorts first by (start, end, site_id), by midpoint first if distances run
between centres. Instead of a sweep, the join is an equality of (contig, bin): the later site stands in one bin, that
of its position; the earlier is repeated for each bin its reach covers, two as a rule. The exact condition is part of
the join, and adaptive execution splits bins that are crowded. No row numbers are needed, so no contig is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.schema import Window, need, stranded_names

#: Share of sites whose length a bin allows for; longer sites are repeated in more bins, at no loss.
LENGTH_QUANTILE = 0.95
#: Rows whose lengths are looked at for that.
LOOK_AT = 10_000


def middle(start: str | Column = "start", end: str | Column = "end") -> Column:
    """The whole-number midpoint, rounded towards zero."""
    total = (F.col(start) if isinstance(start, str) else start) + (F.col(end) if isinstance(end, str) else end)
    return F.when(total >= 0, F.floor(total / 2)).otherwise(F.ceil(total / 2)).cast("long")


def distance(anchor: str, a: str = "a", b: str = "b") -> Column:
    """Distance from the earlier site a to the later site b."""
    if anchor == "inner":
        return F.col(f"{b}.start") - F.col(f"{a}.end")
    if anchor == "outer":
        return F.col(f"{b}.end") - F.col(f"{a}.start")
    return F.col(f"{b}.mid") - F.col(f"{a}.mid")


def overlap_ok(window: Window, a: str = "a", b: str = "b") -> Column:
    """Whether the shared part of the shorter site is within bounds; a site without length always passes."""
    shared = F.greatest(F.least(F.col(f"{a}.end"), F.col(f"{b}.end")) - F.greatest(F.col(f"{a}.start"), F.col(f"{b}.start")), F.lit(0))
    short = F.least(F.col(f"{a}.end") - F.col(f"{a}.start"), F.col(f"{b}.end") - F.col(f"{b}.start"))
    share = shared / F.when(short != 0, short)
    return share.isNull() | share.between(float(window.min_overlap), float(window.max_overlap))


def before(window: Window, a: str = "a", b: str = "b") -> Column:
    """Whether a sorts before b."""
    keys = (["mid"] if window.anchor == "center" else []) + ["start", "end", "site_id"]
    out = F.lit(False)
    for k in reversed(keys):
        out = (F.col(f"{a}.{k}") < F.col(f"{b}.{k}")) | ((F.col(f"{a}.{k}") == F.col(f"{b}.{k}")) & out)
    return out


def bin_width(sites: DataFrame, window: Window) -> int:
    """A width at which most sites reach into two bins. Any width gives the same pairs, so the lengths of the first rows at hand will do."""
    if window.width is not None:
        return window.width
    if window.anchor == "center":
        return max(1, window.max_dist + 1)
    lengths = sorted(r[0] for r in sites.select(F.col("end") - F.col("start")).limit(LOOK_AT).collect() if r[0] is not None)
    typical = lengths[int((len(lengths) - 1) * LENGTH_QUANTILE)] if lengths else 0
    return max(1, window.max_dist + 1 + max(0, typical))


def window_pairs(sites: DataFrame, window: Window, clamp: bool = False, width: int | None = None, extra: tuple[str, ...] = (), also: Column | None = None, columns: tuple[str, ...] = ("contig", "name", "score", "strand")) -> DataFrame:
    """Pairs (a, b, distance), a before b, structs of their sites; with `clamp` distances below zero count as zero.

    `extra` names further columns that must be equal in both, `columns` what the structs hold besides site_id, start
    and end: only that is shuffled. Rows with a null contig, start or end pair with nothing.
    """
    need(sites, "site_id", "contig", "start", "end", "name")
    s = sites.where("contig is not null and start is not null and end is not null")
    if window.stranded:
        s = stranded_names(s)
    center = window.anchor == "center"
    keep = ["site_id", "start", "end", *[c for c in columns if c in sites.columns], *[c for c in extra if c not in (*columns, "contig")]]
    s = s.select(*dict.fromkeys([*keep, "contig"]), *([middle().alias("mid")] if center else []))
    keep += ["mid"] if center else []
    w = F.lit(width or bin_width(sites, window))
    at = F.col("mid") if center else F.col("start")
    reach = (F.col("mid") if center else F.greatest("start", "end")) + max(0, window.max_dist)
    left = s.select(F.struct(*keep).alias("a"), F.col("contig").alias("c"), *[F.col(x).alias(f"x_{x}") for x in extra], F.explode(F.sequence(F.floor(at / w), F.floor(reach / w))).alias("bin"))
    right = s.select(F.struct(*keep).alias("b"), F.col("contig").alias("c"), *[F.col(x).alias(f"x_{x}") for x in extra], F.floor(at / w).alias("bin"))
    d = distance(window.anchor)
    d = F.greatest(d, F.lit(0)) if clamp else d
    on = before(window) & d.between(window.min_dist, window.max_dist) & overlap_ok(window)
    if also is not None:
        on = on & also
    # Spark estimates the repeated and widened rows by the file they come from, and would broadcast millions of them
    joined = left.join(right.hint("merge"), ["c", "bin", *[f"x_{x}" for x in extra]]).where(on)
    return joined.select("a", "b", d.alias("distance"), *[F.col(f"x_{x}").alias(x) for x in extra])


def single_counts(sites: DataFrame, stranded: bool = False) -> DataFrame:
    """(name, n): how often each label occurs."""
    return (stranded_names(sites) if stranded else sites).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def directed_counts(sites: DataFrame, window: Window, extra: tuple[str, ...] = ()) -> DataFrame:
    """(name1, name2, n): pairs with name1 the earlier.

    With `binarize` an earlier site counts at most once with each label, and only if the last site of that label in
    reach isn't beyond the first site of its own label.
    """
    p = window_pairs(sites, window, clamp=True, extra=extra, columns=("name",)).select(F.col("a.name").alias("name1"), F.col("b.name").alias("name2"), F.col("a.site_id").alias("i"), F.struct(*(["b.mid"] if window.anchor == "center" else []), "b.start", "b.end", "b.site_id").alias("j"), *extra)
    if not window.binarize:
        return p.groupBy(*extra, "name1", "name2").agg(F.count(F.lit(1)).alias("n"))
    per = p.groupBy(*extra, "i", "name1", "name2").agg(F.max("j").alias("last"), F.min("j").alias("first"))
    # one row per earlier site: at most as many entries as there are labels
    of = per.groupBy(*extra, "i", "name1").agg(F.collect_list(F.struct("name2", "last")).alias("to"), F.min(F.when(F.col("name1") == F.col("name2"), F.col("first"))).alias("own"))
    flat = of.select(*extra, "name1", "own", F.explode("to").alias("t"))
    ok = F.col("own").isNull() | (F.col("t.last") <= F.col("own"))
    return flat.where(ok).groupBy(*extra, "name1", F.col("t.name2").alias("name2")).agg(F.count(F.lit(1)).alias("n"))


def symmetric(counts: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Both orders of every pair, each with the sum of the two; a label with itself keeps its count."""
    there, back = F.struct("name1", "name2"), F.struct(F.col("name2").alias("name1"), F.col("name1").alias("name2"))
    # repeated in place, so that what made the counts runs once
    both = counts.select(*extra, F.explode(F.when(F.col("name1") != F.col("name2"), F.array(there, back)).otherwise(F.array(there))).alias("x"), "n")
    return both.groupBy(*extra, F.col("x.name1").alias("name1"), F.col("x.name2").alias("name2")).agg(F.sum("n").alias("n"))


def pair_counts(sites: DataFrame, window: Window) -> DataFrame:
    """(name1, name2, n) under the window's settings: directed, or else symmetric."""
    c = directed_counts(sites, window)
    return c if window.directional else symmetric(c)


def occurrences(sites: DataFrame, window: Window, name1: str | None = None, name2: str | None = None, strand1: str | None = None, strand2: str | None = None) -> DataFrame:
    """Each pair's two sites, flat, with distance and orientation; the two labels may stand in either order.

    Distances aren't clamped, so overlapping sites need min_dist below zero.
    """
    # only sites of these labels can be in a pair
    p = window_pairs(sites if name1 is None or name2 is None else sites.where(F.col("name").isin(name1, name2)), window)
    if name1 is not None and name2 is not None:
        one = (F.col("a.name") == name1) & (F.col("b.name") == name2)
        two = (F.col("a.name") == name2) & (F.col("b.name") == name1)
        p = p.where(one | two)
    if strand1 is not None or strand2 is not None:
        # strands are asked for by label; a label with itself takes them in order
        first = (F.col("a.name") == name1) if name1 != name2 else F.lit(True)
        sa, sb = F.when(first, F.lit(strand1)).otherwise(F.lit(strand2)), F.when(first, F.lit(strand2)).otherwise(F.lit(strand1))
        p = p.where(F.coalesce(F.col("a.strand") == sa, F.lit(True)) & F.coalesce(F.col("b.strand") == sb, F.lit(True)))
    cols = ("contig", "start", "end", "name", "score", "strand", "site_id")
    have = set(sites.columns)
    flat = [F.col(f"{side}.{c}").alias(f"site{n}_{c}") for n, side in ((1, "a"), (2, "b")) for c in cols if c in have]
    out = p.select(*flat, "distance")
    return out.withColumn("orientation", orientation_of(F.col("site1_strand"), F.col("site2_strand"))) if "strand" in have else out


def orientation_of(s1: Column, s2: Column, simple: bool = False) -> Column:
    """How two neighbouring sites point: the order of the pair on their strand, convergent or divergent; with one of them unstranded away or towards."""
    plus1, minus1, plus2, minus2 = s1 == "+", s1 == "-", s2 == "+", s2 == "-"
    if simple:
        return F.when((plus1 | minus1) & (plus2 | minus2), F.when(s1 == s2, "same").otherwise("opposite")).otherwise("NA")
    return (
        F.when(plus1 & plus2, "1-2")
        .when(minus1 & minus2, "2-1")
        .when(plus1 & minus2, "convergent")
        .when(minus1 & plus2, "divergent")
        .when(plus2 | minus1, "away")
        .when(minus2 | plus1, "towards")
        .otherwise("NA")
    )
