"""Sites, regions and features derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.schema import Window

DAY = Window(max_dist=86_400)
HOUR = Window(max_dist=3_600)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sites(spark: SparkSession, sf_dir: str, contigs: int | None = None) -> DataFrame:
    """Events as sites: the user is the contig (or one of a few), the second the place."""
    e = table(spark, sf_dir, "events")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    contig = F.col("user_id") if contigs is None else F.col("user_id") % contigs
    return e.select(
        F.col("event_id").alias("site_id"), contig.cast("string").alias("contig"), start.alias("start"), (start + 1 + F.col("event_id") % 60).alias("end"),
        F.col("event_type").alias("name"), F.col("value").cast("double").alias("score"), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-").alias("strand"),
    )


def half(spark: SparkSession, sf_dir: str, odd: int) -> DataFrame:
    """The sites of one of two samples: events whose id divided by 4 is even or odd."""
    return sites(spark, sf_dir).where(F.floor(F.col("site_id") / 4) % 2 == odd)


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as sites of 25 labels: the supplier is the contig, the day of shipping the place."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))")
    return li.join(part, "l_partkey").select((F.col("l_orderkey") * 16 + F.col("l_linenumber")).alias("site_id"), F.col("l_suppkey").cast("string").alias("contig"), day.alias("start"), (day + 1).alias("end"), F.col("p_brand").alias("name"), F.col("l_quantity").cast("double").alias("score"), F.lit("+").alias("strand"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-hour spans that begin a quarter of an hour after each event."""
    return sites(spark, sf_dir).select("site_id", "contig", (F.col("start") + 900).alias("start"), (F.col("start") + 2700).alias("end"), "name")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as features with a strand."""
    s = sites(spark, sf_dir).where("name = 'purchase'")
    return s.select(F.col("site_id").alias("f_id"), "contig", F.col("start"), (F.col("end") + 600).alias("end"), "strand", F.lit("gene").alias("feature"), F.concat(F.lit("g"), F.col("site_id") % 50).alias("gene_name"))


def baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, item): the brands of each order."""
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return li.join(part, "l_partkey").select(F.col("l_orderkey").alias("basket"), F.col("p_brand").alias("item")).distinct()


def genome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(contig, seq): each user's events in order, spelt in four letters."""
    s = sites(spark, sf_dir).select("contig", F.struct("start", "site_id", F.translate(F.substring("name", 1, 1), "cepsv", "ACGTA").alias("base")).alias("x"))
    return s.groupBy("contig").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["base"]), "").alias("seq"))


def hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(term, parent): nations below regions below the world."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("term"), F.col("r_name").alias("parent")).union(r.select("r_name", F.lit("WORLD")))


#: The same as DuckDB common table expressions; start and end are st and en.
SITES = """s as (select event_id as site_id, cast(user_id as varchar) as contig, epoch_us(ts) // 1000000 as st, epoch_us(ts) // 1000000 + 1 + event_id % 60 as en,
  event_type as name, cast(value as double) as score, case when event_id % 2 = 0 then '+' else '-' end as strand from events)"""
STRANDED = SITES.replace("event_type as name", "event_type || case when event_id % 2 = 0 then '(+)' else '(-)' end as name")
ITEMS = """s as (select l_orderkey * 16 + l_linenumber as site_id, cast(l_suppkey as varchar) as contig, epoch_us(l_shipdate) // 86400000000 as st, epoch_us(l_shipdate) // 86400000000 + 1 as en,
  p_brand as name, cast(l_quantity as double) as score, '+' as strand from lineitem join part on l_partkey = p_partkey)"""
REGIONS = "r as (select site_id, contig, st + 900 as st, st + 2700 as en, name from s)"


def pairs_sql(w: Window, clamp: bool = True, src: str = "s", out: str = "p", where: str = "") -> str:
    """A CTE of all pairs of `src`: i, j, n1, n2, d and both sites' columns."""
    mid = lambda x: f"(({x}.st + {x}.en) // 2)"
    d = {"inner": "b.st - a.en", "outer": "b.en - a.st", "center": f"{mid('b')} - {mid('a')}"}[w.anchor]
    d = f"greatest({d}, 0)" if clamp else f"({d})"
    key = (lambda x: f"({mid(x)}, {x}.st, {x}.en, {x}.site_id)") if w.anchor == "center" else (lambda x: f"({x}.st, {x}.en, {x}.site_id)")
    share = "(greatest(least(a.en, b.en) - greatest(a.st, b.st), 0)::double / nullif(least(a.en - a.st, b.en - b.st), 0))"
    return f"""{out} as (select a.site_id as i, b.site_id as j, a.name as n1, b.name as n2, {d} as d, a.contig, a.st as ast, a.en as aen, a.strand as astr, b.st as bst, b.en as ben, b.strand as bstr,
  {key('a')} as ka, {key('b')} as kb from {src} a join {src} b on a.contig = b.contig and {key('a')} < {key('b')}
  where {d} between {w.min_dist} and {w.max_dist} and coalesce({share} between {float(w.min_overlap)} and {float(w.max_overlap)}, true) {where})"""


def counts_sql(w: Window, src: str = "s", out: str = "c") -> str:
    """CTEs up to `out` (name1, name2, n): the pair counts under the window's settings."""
    if w.binarize:
        directed = f"""{out}g as (select i, n1, n2, max(kb) as last, min(kb) as first from p{out} group by i, n1, n2),
f{out} as (select i, min(first) as own from {out}g where n1 = n2 group by i),
d{out} as (select n1, n2, count(*) as n from {out}g left join f{out} using (i) where own is null or last <= own group by n1, n2)"""
    else:
        directed = f"d{out} as (select n1, n2, count(*) as n from p{out} group by n1, n2)"
    whole = f"{out} as (select n1 as name1, n2 as name2, n from d{out})" if w.directional else f"{out} as (select name1, name2, sum(n)::bigint as n from (select n1 as name1, n2 as name2, n from d{out} union all select n2, n1, n from d{out} where n1 <> n2) group by name1, name2)"
    return f"{pairs_sql(w, True, src, f'p{out}')}, {directed}, {whole}"


def rules_sql(w: Window, src: str = "s", out: str = "r", n_baskets: int = 1_000_000) -> str:
    """CTEs up to `out`: the rules with all measures."""
    return f"""{counts_sql(w, src, f'c{out}')}, n{out} as (select name, count(*) as n from {src} group by name),
{out} as (select c.name1, c.name2, c.name1 || '-' || c.name2 as pair, c.n as n12, a.n as n1, b.n as n2, c.n / {n_baskets}::double as support, c.n / sqrt(a.n::double * b.n) as cosine,
  c.n / a.n::double as confidence, c.n / a.n::double / (b.n / {n_baskets}::double) as lift, c.n / nullif(a.n + b.n - c.n, 0)::double as jaccard
  from c{out} c join n{out} a on c.name1 = a.name join n{out} b on c.name2 = b.name)"""
