"""Annotation of regions with nearby features, and enrichment of terms among genes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.functions import numerics
from pairloom.functions.storage import checkpointed, ship
from pairloom.schema import need, one_of


def annotate(regions: DataFrame, features: DataFrame, feature: str | None = "gene", anchor: str = "start", upstream: int = 10_000, downstream: int = 1_000, best: bool = True, keep_all: bool = True) -> DataFrame:
    """Regions (site_id, contig, start, end) with the features whose anchor point is near their middle.

    The distance is that of the region's middle from the feature's start, centre or end, counted along the feature's
    strand: negative upstream. A range join over bins, of which a feature's reach covers few. `best` keeps the nearest
    feature (ties: the smaller f_id), `keep_all` also regions without any.
    """
    one_of(anchor, ("start", "center", "end"), "anchor")
    need(features, "f_id", "contig", "start", "end", "strand")
    f = features if feature is None or "feature" not in features.columns else features.where(F.col("feature") == feature)
    minus = F.col("strand") == "-"
    point = {"start": F.when(minus, F.col("end")).otherwise(F.col("start")), "end": F.when(minus, F.col("start")).otherwise(F.col("end")), "center": F.floor((F.col("start") + F.col("end")) / 2)}[anchor]
    width = max(1, upstream + downstream)
    extra = [c for c in features.columns if c not in ("contig", "start", "end", "strand")]
    f = f.select("contig", F.col("start").alias("f_start"), F.col("end").alias("f_end"), F.col("strand").alias("f_strand"), *extra, point.cast("long").alias("f_point"))
    back, ahead = F.when(F.col("f_strand") == "-", downstream).otherwise(upstream), F.when(F.col("f_strand") == "-", upstream).otherwise(downstream)
    f = f.withColumn("bin", F.explode(F.sequence(F.floor((F.col("f_point") - back) / width), F.floor((F.col("f_point") + ahead) / width))))
    r = regions.withColumn("_mid", F.floor((F.col("start") + F.col("end")) / 2)).withColumn("bin", F.floor(F.col("_mid") / width))
    along = F.col("_mid") - F.col("f_point")
    j = r.join(f, ["contig", "bin"]).withColumn("distance", F.when(F.col("f_strand") == "-", -along).otherwise(along)).where(F.col("distance").between(-upstream, downstream))
    j = j.drop("_mid", "bin", "f_point")
    if best:
        j = j.withColumn("_n", F.row_number().over(W.partitionBy("site_id").orderBy(F.abs("distance"), "f_id"))).where("_n = 1").drop("_n")
    if not keep_all:
        return j
    new = [c for c in j.columns if c not in regions.columns]
    return regions.join(j.select("site_id", *new), "site_id", "left").select(*regions.columns, *new)


def annotated_genes(annotated: DataFrame, attribute: str = "gene_name") -> DataFrame:
    """(gene): what the regions were annotated with, each once."""
    return annotated.select(F.col(attribute).alias("gene")).where("gene is not null").distinct()


def match_column(genes: DataFrame, table: DataFrame) -> str:
    """The column of an id table that holds most of the genes; the first of equals."""
    g = genes.select(F.col("gene").cast("string").alias("_g")).distinct()
    cols = table.columns
    long = table.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)])).alias("x")).select("x.*").distinct()
    hits = long.join(g, long.v == g._g, "left_semi").groupBy("i").count().orderBy(F.desc("count"), "i").first()
    if hits is None:
        raise ValueError("no column holds any of the genes")
    return cols[hits.i]


def matched(genes: DataFrame, table: DataFrame, to: str) -> DataFrame:
    """(gene): the genes, given under whichever of the table's names, under the name of its column `to`. Unknown ones are left out."""
    by = match_column(genes, table)
    g = genes.select(F.col("gene").cast("string").alias("_g")).distinct()
    return table.where(F.col(to).isNotNull()).join(g, F.col(by).cast("string") == F.col("_g"), "left_semi").select(F.col(to).cast("string").alias("gene")).distinct()


def closure(parents: DataFrame, rounds: int = 64) -> DataFrame:
    """(term, ancestor) of every term with all its ancestors, itself included, from (term, parent)."""
    base = parents.select("term", "parent").distinct()
    terms = base.select("term").union(base.select("parent")).distinct()
    known = checkpointed(terms.select("term", F.col("term").alias("ancestor")).union(base).distinct())
    n = known.count()
    for _ in range(rounds):
        # doubling: the ancestors of ancestors
        two = known.select("term", F.col("ancestor").alias("mid")).join(known.select(F.col("term").alias("mid"), "ancestor"), "mid").select("term", "ancestor")
        known = checkpointed(known.union(two).distinct())
        if (m := known.count()) == n:
            break
        n = m
    return known


def enrichment(genes: DataFrame, gene_terms: DataFrame, terms: DataFrame, background: DataFrame | None = None, parents: DataFrame | None = None, min_depth: int = 0) -> DataFrame:
    """Which terms the genes have more or less often than the background.

    `gene_terms` is (gene, term), `terms` is (term, aspect, depth, description). With `parents` (term, parent) a gene has all
    ancestors of its terms. Per aspect: Fisher's exact test of two sides and Benjamini-Hochberg's correction. In an
    aspect without any gene of the study every term has p 1.
    """
    owned = gene_terms.select("gene", "term").distinct()
    if parents is not None:
        up = closure(parents)
        owned = owned.join(up, "term", "left").select("gene", F.coalesce("ancestor", "term").alias("term")).distinct()
    owned = owned.join(terms.select("term", "aspect"), "term")
    if background is not None:
        owned = owned.join(background.select("gene").distinct(), "gene", "left_semi")
    study = genes.select("gene").distinct().withColumn("_in", F.lit(1))
    flagged = owned.join(study, "gene", "left").withColumn("_in", F.coalesce("_in", F.lit(0)))
    sizes = flagged.groupBy("aspect").agg(F.countDistinct("gene").alias("total"), F.countDistinct(F.when(F.col("_in") == 1, F.col("gene"))).alias("drawn"))
    per = flagged.groupBy("aspect", "term").agg(F.count(F.lit(1)).alias("good"), F.sum("_in").alias("count"))

    ship(genes.sparkSession)

    @F.pandas_udf("double")
    def fisher(k: pd.Series, drawn: pd.Series, good: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([numerics.hypergeometric_two_sided(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, drawn, good, total, strict=True)])

    tested = per.join(sizes, "aspect").withColumn("p", fisher("count", "drawn", "good", "total"))
    # p-values that differ in their last digits only are ties
    tie = F.round("p", 12)
    rank = F.row_number().over(W.partitionBy("aspect").orderBy(tie, "term"))
    m = F.count(F.lit(1)).over(W.partitionBy("aspect"))
    tested = tested.withColumn("_q", F.col("p") * m / rank)
    fdr = F.least(F.lit(1.0), F.min("_q").over(W.partitionBy("aspect").orderBy(tie.desc(), F.desc("term")).rowsBetween(W.unboundedPreceding, 0)))
    # multiplied out, since an aspect may have no gene of the study
    more = F.col("count") * F.col("total") > F.col("good") * F.col("drawn")
    out = tested.withColumn("fdr", fdr).withColumn("direction", F.when(more, "increased").otherwise("decreased")).drop("_q").join(terms.drop("aspect"), "term", "left")
    return out.where(F.coalesce("depth", F.lit(0)) >= min_depth)
