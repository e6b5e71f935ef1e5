"""Operators on sites: subsets, flags, overlaps between and within tables."""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.functions.storage import ship
from pairloom.schema import need, one_of

ORDER = ("start", "end", "site_id")


def names_of(sites: DataFrame) -> DataFrame:
    """(name): the labels, each once."""
    return sites.select("name").where("name is not null").distinct()


def subset_names(sites: DataFrame, names: list[str]) -> DataFrame:
    """Sites with one of these labels; labels that no site has are warned of, and it is an error if that holds for all."""
    have = {r.name for r in names_of(sites).where(F.col("name").isin(names)).collect()}
    if not have:
        raise ValueError("no site has any of these names")
    if missing := sorted(set(names) - have):
        warnings.warn(f"no site is named {', '.join(missing)}", stacklevel=2)
    return sites.where(F.col("name").isin(names))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The sites of both tables, repeats included."""
    return a.unionByName(b)


def widen(sites: DataFrame, by: int) -> DataFrame:
    """Sites longer by so many places on either side, but not before 0."""
    return sites.withColumn("start", F.greatest(F.col("start") - by, F.lit(0))).withColumn("end", F.col("end") + by)


def bins(start: Column, end: Column, width: int) -> Column:
    """The bins that [start, end) has a place in."""
    return F.sequence(F.floor(start / width), F.floor(F.greatest(start, end - 1) / width))


def overlaps(sites: DataFrame, regions: DataFrame, width: int | None = None) -> DataFrame:
    """(site_id, region columns r_start, r_end): every site with every region it overlaps, once.

    An equality join of bins: both sides are repeated for each bin they cover, and a pair is taken at the first bin
    that both have. The width follows the typical length; any width gives the same pairs.
    """
    need(sites, "site_id", "contig", "start", "end")
    need(regions, "contig", "start", "end")
    if width is None:
        a = sites.agg(F.percentile_approx(F.col("end") - F.col("start"), 0.5, 100)).first()[0] or 1
        b = regions.agg(F.percentile_approx(F.col("end") - F.col("start"), 0.5, 100)).first()[0] or 1
        width = max(1, int(a), int(b))
    s = sites.select("site_id", "contig", "start", "end", F.explode(bins(F.col("start"), F.col("end"), width)).alias("bin"))
    r = regions.select("contig", F.col("start").alias("r_start"), F.col("end").alias("r_end"), *[F.col(c).alias(f"r_{c}") for c in regions.columns if c not in ("contig", "start", "end")])
    r = r.withColumn("bin", F.explode(bins(F.col("r_start"), F.col("r_end"), width)))
    on = (F.col("end") > F.col("r_start")) & (F.col("start") < F.col("r_end")) & (F.col("bin") == F.greatest(F.floor(F.col("start") / width), F.floor(F.col("r_start") / width)))
    return s.join(r, ["contig", "bin"]).where(on).drop("bin")


def subset_regions(sites: DataFrame, regions: DataFrame) -> DataFrame:
    """Sites that overlap some region."""
    hit = overlaps(sites, regions.select("contig", "start", "end").distinct()).select("site_id").distinct()
    return sites.join(hit, "site_id", "left_semi").select(*sites.columns)


def flag_regions(sites: DataFrame, regions: DataFrame, flag: str = "overlap") -> DataFrame:
    """Sites with a column that tells whether they overlap some region."""
    hit = overlaps(sites, regions.select("contig", "start", "end").distinct()).select("site_id").distinct().withColumn("_hit", F.lit(True))
    return sites.join(hit, "site_id", "left").select(*sites.columns, F.coalesce("_hit", F.lit(False)).alias(flag))


def running_max(df: DataFrame, keys: list[str], by: str, order: list[str], value: Column, out: str, chunk: int = 1 << 20, inclusive: bool = False) -> DataFrame:
    """Adds the largest `value` so far in the order of each key (without the row itself unless `inclusive`).

    A key may hold a large share of all rows, so it is cut into chunks by the column `by`, which comes first in the
    order: the largest value of each chunk is carried over the (few) chunks, and inside a chunk the order is walked.
    """
    d = df.withColumn("_chunk", F.floor(F.col(by) / chunk)).withColumn("_value", value)
    per = d.groupBy(*keys, "_chunk").agg(F.max("_value").alias("_top"))
    carried = per.withColumn("_carry", F.max("_top").over(W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    inside = W.partitionBy(*keys, "_chunk").orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    both = d.withColumn("_in", F.max("_value").over(inside)).join(carried, [*keys, "_chunk"])
    return both.withColumn(out, F.greatest("_in", "_carry")).drop("_chunk", "_value", "_in", "_carry")


def islands(sites: DataFrame, per_name: bool = True, chunk: int = 1 << 20) -> DataFrame:
    """Sites with a column island: the site_id of the first site of their chain of overlaps (of one label, or of any)."""
    keys = ["contig", "name"] if per_name else ["contig"]
    reach = running_max(sites, keys, "start", list(ORDER), F.col("end"), "_reach", chunk)
    first = reach.withColumn("_head", F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.struct(*ORDER)))
    headed = running_max(first, keys, "start", list(ORDER), F.col("_head"), "_of", chunk, inclusive=True)
    return headed.withColumn("island", F.col("_of.site_id")).drop("_reach", "_head", "_of")


def merge_overlaps(sites: DataFrame, per_name: bool = True, chunk: int = 1 << 20) -> DataFrame:
    """Chains of overlapping sites become one site: from the first start to the last end, the rest as of the first site. Touching sites stay apart."""
    rest = [c for c in sites.columns if c not in ("contig", "start", "end")]
    key = F.struct(*ORDER)
    g = islands(sites, per_name, chunk).groupBy("contig", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), *[F.min_by(c, key).alias(c) for c in rest])
    return g.select(*sites.columns)


def keep_best(sites: DataFrame, per_name: bool = True, chunk: int = 1 << 20) -> DataFrame:
    """Walks along the sites and keeps of a site and the last kept one that it overlaps that with the higher score, the later one of equals.

    Chains of overlaps don't touch each other, so each is walked on its own, row by row in order: one site is held of
    a chain, however long it is. A null score is never higher.
    """
    rows = islands(sites, per_name, chunk)
    order = ["contig", "island", *ORDER]
    laid = rows.repartition("contig", "island").sortWithinPartitions(*order).select(*sites.columns, "island")
    at = {c: laid.columns.index(c) for c in ("contig", "island", "start", "end", "score")}

    def walk(batches):
        held = last = None  # the row that is kept so far, as a batch of one, and its (contig, island, end, score)
        for b in batches:
            cols = {c: b.column(i).to_pylist() for c, i in at.items()}
            chosen, row = [], -1  # the row kept so far, if it is one of this batch
            for i, (contig, island, start, end, score) in enumerate(zip(*cols.values(), strict=True)):
                if last is not None and last[:2] == (contig, island) and start < last[2]:
                    if score is None or last[3] is None or not score >= last[3]:
                        continue
                elif row >= 0:
                    chosen.append(row)
                elif held is not None:
                    yield held
                held, row, last = None, i, (contig, island, end, score)
            if chosen:
                yield b.take(pa.array(chosen))
            if row >= 0:
                held = b.slice(row, 1)
        if held is not None:
            yield held

    ship(sites.sparkSession)
    return laid.mapInArrow(walk, laid.schema).drop("island")


def resolve_overlaps(sites: DataFrame, how: str = "merge", per_name: bool = True) -> DataFrame:
    one_of(how, ("merge", "highest_score"), "how")
    return merge_overlaps(sites, per_name) if how == "merge" else keep_best(sites, per_name)


def label_overlap(sites: DataFrame) -> DataFrame:
    """(name1, name2, shared): the share of the places of the rarer label that lie in overlaps with the other."""
    ids = sites.withColumnRenamed("site_id", "i")
    o = overlaps(ids.withColumn("site_id", F.col("i")).drop("i"), sites.select("contig", "start", "end", "name", "site_id"))
    o = o.join(sites.select("site_id", "name"), "site_id").where("name < r_name")
    shared = o.groupBy("name", "r_name").agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("both"))
    size = sites.groupBy("name").agg(F.sum(F.col("end") - F.col("start")).alias("size"))
    return (
        shared.join(size, "name")
        .join(size.select(F.col("name").alias("r_name"), F.col("size").alias("r_size")), "r_name")
        .select(F.col("name").alias("name1"), F.col("r_name").alias("name2"), (F.col("both") / F.least("size", "r_size")).alias("shared"))
    )


def cluster_labels(shares: DataFrame, names: list[str], threshold: float = 0.5) -> dict[str, str]:
    """New label of each label: those whose average overlap stays above the threshold become one, named A/B/C.

    Average-linkage clustering of the label table, which is small whatever the number of sites.
    """
    at = {n: i for i, n in enumerate(sorted(names))}
    sim = np.zeros((len(at), len(at)))
    for r in shares.where(F.col("shared") > 0).collect():
        sim[at[r.name1], at[r.name2]] = sim[at[r.name2], at[r.name1]] = r.shared
    groups = [[n] for n in sorted(names)]
    while len(groups) > 1:
        best = max(((np.mean([[sim[at[x], at[y]] for x in groups[i]] for y in groups[j]]), -i, -j) for i in range(len(groups)) for j in range(i + 1, len(groups))), default=(0, 0, 0))
        if best[0] < threshold or best[0] == 0:
            break
        i, j = -best[1], -best[2]
        groups[i] += groups.pop(j)
    return {n: "/".join(sorted(g)) for g in groups for n in g}


def cluster_sites(sites: DataFrame, threshold: float = 0.5, merge: bool = True) -> DataFrame:
    """Labels that mostly overlap become one, and their overlapping sites are merged."""
    names = [r.name for r in names_of(sites).collect()]
    new = cluster_labels(label_overlap(sites), names, threshold)
    table = sites.sparkSession.createDataFrame(sorted(new.items()), "name string, new string")
    out = sites.join(F.broadcast(table), "name").withColumn("name", F.col("new")).select(*sites.columns)
    return merge_overlaps(out) if merge else out
