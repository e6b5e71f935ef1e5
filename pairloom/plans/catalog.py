"""Every registered query with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.storage import checkpointed, shared_folder
from pairloom.operators import annotation, background, differential, distances, motifs, network, orientation, pairs, plotdata, rules, signals
from pairloom.operators import sites as S
from pairloom.plans import inputs as I
from pairloom.plans import oracles as O
from pairloom.plans.oracles import hist_sql
from pairloom.schema import Window, stranded_names
from pairloom.sources import files

FLAGSHIP = "rule_cosine"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def rounded(df: DataFrame, *cols: str, to: int = 9) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(f"`{c}`"), to))
    return df


def doubles_rounded(df: DataFrame, to: int = 6) -> DataFrame:
    return rounded(df, *[c for c, kind in df.dtypes if kind == "double"], to=to)


# sites

register("site_scan", f"with {I.SITES} select site_id, contig, st as start, en as \"end\", name, score, strand from s")(lambda spark, d: I.sites(spark, d))
register("site_labels", f"with {I.SITES} select distinct name from s")(lambda spark, d: S.names_of(I.sites(spark, d)))
register("site_single_counts", f"with {I.SITES} select name, count(*) as n from s group by name")(lambda spark, d: pairs.single_counts(I.sites(spark, d)))
register("site_stranded_labels", f"with {I.STRANDED} select name, count(*) as n from s group by name")(lambda spark, d: pairs.single_counts(I.sites(spark, d), stranded=True))
register("site_subset_names", f"with {I.SITES} select site_id, name from s where name in ('click', 'purchase')")(lambda spark, d: S.subset_names(I.sites(spark, d), ["click", "purchase"]).select("site_id", "name"))
register("site_subset_regions", f"with {I.SITES}, {I.REGIONS} select site_id, name from s where exists (select 1 from r where r.contig = s.contig and s.en > r.st and s.st < r.en)")(
    lambda spark, d: S.subset_regions(I.sites(spark, d), I.regions(spark, d)).select("site_id", "name")
)
register("site_flag_regions", f"with {I.SITES}, {I.REGIONS} select site_id, exists (select 1 from r where r.contig = s.contig and s.en > r.st and s.st < r.en) as overlap from s")(
    lambda spark, d: S.flag_regions(I.sites(spark, d), I.regions(spark, d)).select("site_id", "overlap")
)
register("site_union", f"with {I.SITES} select contig, name, count(*) as n from (select contig, name from s union all select contig, 'wide' from s) group by contig, name")(
    lambda spark, d: S.union(I.sites(spark, d), S.widen(I.sites(spark, d), 50).withColumn("name", F.lit("wide"))).groupBy("contig", "name").agg(F.count(F.lit(1)).alias("n"))
)
register("site_widen", f"with {I.SITES} select site_id, greatest(st - 50, 0) as start, en + 50 as \"end\" from s")(lambda spark, d: S.widen(I.sites(spark, d), 50).select("site_id", "start", "end"))


def merged_sql(key: str) -> str:
    return f"""with {I.SITES}, w as (select site_id, contig, st, st + 3600 as en, name, score, strand from s),
m as (select *, max(en) over (partition by {key} order by st, en, site_id rows between unbounded preceding and 1 preceding) as pe from w),
g as (select *, sum(case when pe is null or st >= pe then 1 else 0 end) over (partition by {key} order by st, en, site_id) as g from m)
select contig, min(st) as start, max(en) as "end", arg_min(name, (st, en, site_id)) as name, arg_min(score, (st, en, site_id)) as score from g group by {key}, g"""


def _long_sites(spark: SparkSession, d: str) -> DataFrame:
    return I.sites(spark, d).withColumn("end", F.col("start") + 3600)


register("site_merge_overlaps", merged_sql("contig, name"))(lambda spark, d: S.merge_overlaps(_long_sites(spark, d)).select("contig", "start", "end", "name", "score"))
register("site_merge_any_name", merged_sql("contig"))(lambda spark, d: S.merge_overlaps(_long_sites(spark, d), per_name=False).select("contig", "start", "end", "name", "score"))
_BEST = """with recursive {sites}, w as (select site_id, contig, st, st + 3600 as en, name, score, row_number() over (partition by contig, name order by st, en, site_id) as k from s),
walk as (select contig, name, k, site_id as kept, st as kst, en as ken, score as ksc from w where k = 1
 union all select n.contig, n.name, n.k, case when n.st >= ken or n.score >= ksc then n.site_id else kept end, case when n.st >= ken or n.score >= ksc then n.st else kst end,
 case when n.st >= ken or n.score >= ksc then n.en else ken end, case when n.st >= ken or n.score >= ksc then n.score else ksc end from walk join w n on n.contig = walk.contig and n.name = walk.name and n.k = walk.k + 1),
l as (select *, lead(kept) over (partition by contig, name order by k) as nk, lead(kst) over (partition by contig, name order by k) as nst from walk)
select kept as site_id from l where nk is null or (nk <> kept and nst >= ken)"""
register("site_keep_best", _BEST.format(sites=I.SITES))(lambda spark, d: S.keep_best(_long_sites(spark, d)).select("site_id"))
register("site_keep_best_any", _BEST.format(sites=I.SITES).replace("contig, name", "contig").replace("n.contig = walk.contig and n.name = walk.name", "n.contig = walk.contig").replace("select contig, k,", "select contig, name, k,").replace("select n.contig, n.name", "select n.contig, n.name"))(lambda spark, d: S.keep_best(_long_sites(spark, d), per_name=False).select("site_id"))
register(
    "site_label_overlap",
    f"""with {I.SITES}, o as (select a.name as n1, b.name as n2, sum(least(a.en, b.en) - greatest(a.st, b.st)) as shared_len from s a join s b on a.contig = b.contig and a.name < b.name and a.en > b.st and a.st < b.en group by 1, 2),
z as (select name, sum(en - st) as size from s group by name) select n1 as name1, n2 as name2, round(shared_len / least(x.size, y.size)::double, 9) as shared from o join z x on x.name = n1 join z y on y.name = n2""",
)(lambda spark, d: rounded(S.label_overlap(I.sites(spark, d)), "shared"))
register("site_cluster_labels")(lambda spark, d: S.cluster_sites(I.sites(spark, d, contigs=4), threshold=0.00001).groupBy("name").agg(F.count(F.lit(1)).alias("n")))
register("site_bed_lines", f"with {I.SITES} select contig || chr(9) || st || chr(9) || en || chr(9) || name || chr(9) || strand as value from s")(lambda spark, d: files.bed_lines(I.sites(spark, d).withColumn("score", F.lit(None).cast("double"))))

# files: each is written from the tables into a folder that driver and executors share, and read back


def _written(spark: SparkSession, lines: DataFrame, name: str) -> str:
    """A folder of text files with these lines (column value)."""
    at = f"{shared_folder(spark, 'files')}/{name}"
    lines.write.text(at)
    return at


def _lines(df: DataFrame, *cols) -> DataFrame:
    return df.select(F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]).alias("value"))


_AS_READ = "select contig, st as start, en as \"end\", name, score, strand from s"
register("file_bed", f"with {I.SITES} {_AS_READ}")(lambda spark, d: files.read_bed(spark, _written(spark, files.bed_lines(I.sites(spark, d)).unionByName(spark.createDataFrame([("# a comment",), ("track name=x",), ("",)], "value string")), "bed")).drop("site_id"))
register("file_footprints", f"with {I.SITES} select contig, st as start, en as \"end\", name, score, strand from s where site_id % 2 = 0")(lambda spark, d: _footprints(spark, d))


def _footprints(spark: SparkSession, d: str) -> DataFrame:
    """A file for each label and strand, of which one strand is the condition that is read."""
    at = shared_folder(spark, "footprints")
    for r in S.names_of(I.sites(spark, d)).collect():
        for strand, condition in (("+", "plus"), ("-", "minus")):
            rows = I.sites(spark, d).where((F.col("name") == r.name) & (F.col("strand") == strand))
            files.write_text_file(files.bed_lines(rows), f"{at}/{r.name}/beds/{r.name}_{condition}_bound.bed")
    return files.read_footprints(spark, at, "plus").drop("site_id")


def _attributes() -> Column:
    """GTF attributes: quoted, without quotes, and one name twice."""
    return F.concat(F.lit('gene_id "'), F.col("gene_name"), F.lit('"; gene_version '), F.col("f_id").cast("string"), F.lit('; tag "basic"; tag "second"; gene_name "n '), F.col("gene_name"), F.lit('";'))
register("file_gtf", f"with {I.SITES} select contig, 'gene' as feature, st as start, en + 600 as \"end\", strand, 'g' || (site_id % 50) as gene_id, 'n g' || (site_id % 50) as gene_name, cast(site_id as varchar) as gene_version, 'basic' as tag from s where name = 'purchase'")(
    lambda spark, d: files.read_gtf(spark, _written(spark, _lines(I.features(spark, d), "contig", F.lit("pairloom"), "feature", (F.col("start") + 1).cast("string"), "end", F.lit("."), "strand", F.lit("."), _attributes()), "gtf"), ("gene_id", "gene_name", "gene_version", "tag")).drop("f_id", "attributes")
)
register("file_fasta", f"with {I.SITES} select contig, string_agg(case name[1] when 'c' then 'A' when 'e' then 'C' when 'p' then 'G' when 's' then 'T' else 'A' end, '' order by st, site_id) as seq from s group by contig")(
    lambda spark, d: files.read_fasta(spark, _written(spark, I.genome(spark, d).select(F.concat(F.lit(">"), "contig", F.lit(" a user\n"), F.regexp_replace("seq", "(.{7})", "$1\n")).alias("value")), "fasta"))
)
register("file_signal", "select cast(user_id as varchar) as contig, epoch_us(ts) // 1000000 as start, epoch_us(ts) // 1000000 + 1 as \"end\", cast(value as double) as value from events")(
    lambda spark, d: files.read_signal(spark, _written(spark, _lines(I.sites(spark, d), "contig", "start", (F.col("start") + 1).cast("string"), "score"), "bedgraph"))
)
register("file_table", "select n_name as name1, n_nationkey::int as k, length(n_name) / 2.0::double as half from nation")(
    lambda spark, d: files.read_table(spark, _written(spark, spark.createDataFrame([("name1\tk\thalf",)], "value string").unionByName(_lines(I.table(spark, d, "nation"), "n_name", "n_nationkey", (F.length("n_name") / 2).cast("string"))).coalesce(1), "table"))
)


def _ontology(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The nations below the regions below the world as an OBO file, with stanzas that are no terms, and an obsolete term."""
    parents = I.hierarchy(spark, d)
    terms = parents.groupBy("term").agg(F.collect_list("parent").alias("up")).unionByName(spark.createDataFrame([("WORLD", [])], "term string, up array<string>"))
    one = F.concat(F.lit("[Term]\nid: "), "term", F.lit("\nname: name of "), "term", F.lit("\nnamespace: places"), F.array_join(F.transform("up", lambda x: F.concat(F.lit("\nis_a: "), F.regexp_replace(x, " ", "_"), F.lit(" ! parent"))), ""), F.lit("\n"))
    named = terms.withColumn("term", F.regexp_replace("term", " ", "_"))
    text = named.select(one.alias("value")).unionByName(spark.createDataFrame([("[Term]\nid: GONE\nname: gone\nnamespace: places\nis_obsolete: true\n",), ("[Typedef]\nid: regulates\nname: regulates\nis_a: WORLD\nis_obsolete: true\n",)], "value string"))
    return files.read_obo(spark, _written(spark, text, "obo"))


_PLACES = "h as (select replace(n_name, ' ', '_') as term, replace(r_name, ' ', '_') as parent, 2 as depth from nation join region on n_regionkey = r_regionkey union select replace(r_name, ' ', '_'), 'WORLD', 1 from region union select 'WORLD', null, 0)"
register("file_ontology", f"with {_PLACES} select distinct term, 'places' as aspect, depth, 'name of ' || replace(term, '_', ' ') as description from h")(lambda spark, d: _ontology(spark, d)[0].withColumn("description", F.regexp_replace("description", "_", " ")))
register("file_ontology_parents", f"with {_PLACES} select distinct term, parent from h where parent is not null")(lambda spark, d: _ontology(spark, d)[1])


def _saved(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_folder(spark, 'saved')}/s"
    files.save(at, {"rules": _rules(spark, d)}, I.DAY)
    tables, window = files.load(spark, at)
    return tables["rules"].select("pair", "n12", F.lit(window.max_dist).alias("max_dist"), F.lit(window.anchor).alias("anchor"))


register("file_saved", f"with {I.SITES}, {I.rules_sql(I.DAY)} select pair, n12, 86400 as max_dist, 'inner' as anchor from r")(_saved)


def _peaks_file(spark: SparkSession, d: str) -> DataFrame:
    """Peaks as a delimited file with a header, read back."""
    at = f"{shared_folder(spark, 'peaks')}/t"
    files.write_table(doubles_rounded(_peaks(spark, d)).select("name1", "name2", "distance", "prominence", "window"), at)
    return files.read_table(spark, at)


register("file_peaks", f"{O.peaks_ctes(Window(max_dist=100), 1.5)} select name1, name2, distance, round(prominence, 6) as prominence, '[' || lo || ';' || hi || ']' as \"window\" from pk")(_peaks_file)


# counts

_COUNT = {
    "count_inner": I.DAY,
    "count_outer": I.DAY.but(anchor="outer"),
    "count_center": I.DAY.but(anchor="center"),
    "count_directional": I.DAY.but(directional=True),
    "count_binarized": I.DAY.but(binarize=True),
    "count_binarized_center": I.DAY.but(binarize=True, anchor="center", directional=True),
    "count_min_distance": I.DAY.but(min_dist=3600),
    "count_overlap": Window(min_dist=0, max_dist=600, max_overlap=1),
    "count_part_overlap": Window(min_dist=0, max_dist=600, min_overlap=0.1, max_overlap=0.9),
}
for _name, _w in _COUNT.items():
    register(_name, f"with {I.SITES}, {I.counts_sql(_w)} select name1, name2, n from c")(lambda spark, d, w=_w: pairs.pair_counts(I.sites(spark, d), w))
register("count_stranded", f"with {I.STRANDED}, {I.counts_sql(I.DAY)} select name1, name2, n from c")(lambda spark, d: pairs.pair_counts(I.sites(spark, d), I.DAY.but(stranded=True)))
register("count_few_contigs", f"with {I.SITES.replace('cast(user_id as varchar)', 'cast(user_id % 8 as varchar)')}, {I.counts_sql(Window(max_dist=600))} select name1, name2, n from c")(lambda spark, d: pairs.pair_counts(I.sites(spark, d, contigs=8), Window(max_dist=600)))
_WEEK = Window(max_dist=7)
register("count_items", f"with {I.ITEMS}, {I.counts_sql(_WEEK)} select name1, name2, n from c")(lambda spark, d: pairs.pair_counts(I.items(spark, d), _WEEK))

# rules


def _rules(spark: SparkSession, d: str, w: Window = I.DAY, measures=rules.MEASURES) -> DataFrame:
    return rules.rules_of(I.sites(spark, d), w, measures)


def _all(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_rules(spark, d), *rules.MEASURES)


def all_sql(tail: str, w: Window = I.DAY) -> str:
    return f"with {I.SITES}, {I.rules_sql(w)} {tail}"


_COLS = "name1, name2, pair, n12, n1, n2"
register("rule_cosine", all_sql(f"select {_COLS}, round(cosine, 9) as cosine from r"))(lambda spark, d: rounded(_rules(spark, d, measures=("cosine",)), "cosine"))
register("rule_measures", all_sql(f"select {_COLS}, round(support, 9) as support, round(cosine, 9) as cosine, round(confidence, 9) as confidence, round(lift, 5) as lift, round(jaccard, 9) as jaccard from r"))(lambda spark, d: rounded(rounded(_rules(spark, d), "support", "cosine", "confidence", "jaccard"), "lift", to=5))
_RARE = Window(max_dist=5)
register("rule_keep_zero", f"with {I.SITES}, {I.counts_sql(_RARE)}, z as (select name, count(*) as n from s group by name) select a.name as name1, b.name as name2, a.name || '-' || b.name as pair, coalesce(c.n, 0) as n12, a.n as n1, b.n as n2, round(coalesce(c.n, 0) / sqrt(a.n::double * b.n), 9) as cosine from z a cross join z b left join c on c.name1 = a.name and c.name2 = b.name")(
    lambda spark, d: rounded(rules.rules_of(I.sites(spark, d), _RARE, keep_zero=True), "cosine")
)
register("rule_items", f"with {I.ITEMS}, {I.rules_sql(_WEEK)} select {_COLS}, round(cosine, 9) as cosine from r")(lambda spark, d: rounded(rules.rules_of(I.items(spark, d), _WEEK), "cosine"))
register("rule_ranked", all_sql("select row_number() over (order by round(r.cosine, 9) desc, name1, name2)::int as rank, pair, round(cosine, 9) as cosine from r"))(lambda spark, d: rules.ranked(rounded(_rules(spark, d, measures=("cosine",)), "cosine")).select("rank", "pair", "cosine"))
register("rule_label_table", all_sql("select a.name1 as name, a.n1, b.n2 from (select distinct name1, n1 from r) a join (select distinct name2, n2 from r) b on a.name1 = b.name2"))(lambda spark, d: rules.label_table(_rules(spark, d)))
register("rule_simplify", all_sql(f"select {_COLS}, round(cosine, 9) as cosine from (select *, row_number() over (partition by least(name1, name2), greatest(name1, name2) order by cosine desc, name1, name2) as k from r) where k = 1"))(lambda spark, d: rounded(rules.simplify(_rules(spark, d, measures=("cosine",))), "cosine"))
register("rule_top", all_sql(f"select {_COLS}, round(cosine, 9) as cosine from r order by r.cosine desc, name1, name2 limit 7"))(lambda spark, d: rounded(rules.top(_rules(spark, d, measures=("cosine",)), 7), "cosine"))
for _how, _cond in (("inner", "name1 in ('click', 'view') and name2 in ('click', 'view')"), ("outer", "name1 in ('click', 'view') or name2 in ('click', 'view')"), ("left", "name1 in ('click', 'view')"), ("right", "name2 in ('click', 'view')")):
    register(f"rule_labels_{_how}", all_sql(f"select pair, n12 from r where {_cond}"))(lambda spark, d, how=_how: rules.with_labels(_rules(spark, d), ["click", "view"], how).select("pair", "n12"))
register("rule_named", all_sql("select pair, n12, 0 as place from r where pair = 'view-click' union all select pair, n12, 1 from r where pair = 'click-error'"))(lambda spark, d: rules.named(_rules(spark, d), ["view-click", "click-error"]).select("pair", "n12", "place"))
register("rule_thresholds", all_sql("select pair, round(cosine, 9) as cosine from r where cosine >= 0.2 and confidence >= 0.1"))(lambda spark, d: rounded(rules.significant(_rules(spark, d), "cosine", "confidence", 0.2, 0.1).select("pair", "cosine"), "cosine"))
register("rule_auto_thresholds")(lambda spark, d: rules.significant(rules.rules_of(I.items(spark, d), _WEEK, ("cosine", "confidence")), "cosine", "confidence"))


def _numbers(spark: SparkSession, d: str) -> DataFrame:
    return I.sites(spark, d).groupBy("name").agg(F.avg("score").alias("mean_score"), F.count(F.lit(1)).alias("n1"))


register("rule_integrate_label", all_sql("select pair, n12, round(m, 6) as x_mean_score, k as x_n1 from r left join (select name, avg(score) as m, count(*) as k from s group by name) t on t.name = r.name1"))(
    lambda spark, d: rounded(rules.integrate(_rules(spark, d), _numbers(spark, d), "name1", col1="name", prefix="x_").select("pair", "n12", "x_mean_score", "x_n1"), "x_mean_score", to=6)
)
register("rule_integrate_pair", f"with {I.SITES}, {I.rules_sql(I.DAY)}, {I.rules_sql(I.HOUR, out='q')} select r.pair, r.n12, h.n12 as n12_y from r left join q h on h.name1 = r.name1 and h.name2 = r.name2")(
    lambda spark, d: rules.integrate(_rules(spark, d), _rules(spark, d, I.HOUR).select("name1", "name2", "n12")).select("pair", "n12", "n12_y")
)
register("rule_restrict_sites", all_sql("select site_id, name from s where name in (select name1 from t union select name2 from t)").replace(" select site_id, name from s where", ", t as (select * from r order by cosine desc, name1, name2 limit 2) select site_id, name from s where"))(
    lambda spark, d: rules.restrict_sites(I.sites(spark, d), rules.top(_rules(spark, d), 2)).select("site_id", "name")
)
_STRANDED_TOP = f"with {I.STRANDED}, {I.rules_sql(I.DAY)}, t as (select * from r order by cosine desc, name1, name2 limit 2) select site_id, name from s where name in (select name1 from t union select name2 from t)"
register("rule_restrict_stranded", _STRANDED_TOP)(lambda spark, d: stranded_names(rules.restrict_sites(I.sites(spark, d), rules.top(rules.rules_of(I.sites(spark, d), I.DAY.but(stranded=True)), 2))).select("site_id", "name"))
register(
    "rule_baskets",
    """with b as (select distinct l_orderkey as basket, p_brand as item from lineitem join part on l_partkey = p_partkey), n as (select item, count(*) as n from b group by item), t as (select count(distinct basket) as t from b),
c as (select x.item as name1, y.item as name2, count(*) as n12 from b x join b y on x.basket = y.basket and x.item <> y.item group by 1, 2)
select name1, name2, name1 || '-' || name2 as pair, n12, p.n as n1, q.n as n2, round(n12 / t::double, 9) as support, round(n12 / p.n::double / (q.n / t::double), 6) as lift from c join n p on p.item = name1 join n q on q.item = name2, t""",
)(lambda spark, d: _baskets(I.baskets(spark, d)))


def _baskets(b: DataFrame) -> DataFrame:
    """Classic baskets: the labels of a basket are neighbours if they share it."""
    total = b.select("basket").distinct().count()
    counts = b.alias("x").join(b.alias("y"), (F.col("x.basket") == F.col("y.basket")) & (F.col("x.item") != F.col("y.item"))).groupBy(F.col("x.item").alias("name1"), F.col("y.item").alias("name2")).agg(F.count(F.lit(1)).alias("n"))
    singles = b.groupBy(F.col("item").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(rounded(rules.market_basket(singles, counts, ("support", "lift"), n_baskets=total), "support"), "lift", to=6)


# background

_BACK = Window(max_dist=3600)
register("background_zscore")(lambda spark, d: background.zscores(pairs.pair_counts(I.sites(spark, d), _BACK), background.background_counts(I.sites(spark, d), _BACK), background.SHUFFLES))
register("background_exact")(lambda spark, d: background.zscores(pairs.pair_counts(I.sites(spark, d), _BACK), background.background_counts(I.sites(spark, d), _BACK, exact=True), background.SHUFFLES))

# occurrences

_OCC = Window(max_dist=3600)
_ORIENT = "case when astr = '+' and bstr = '+' then '1-2' when astr = '-' and bstr = '-' then '2-1' when astr = '+' then 'convergent' else 'divergent' end"
register("pair_locations", f"with {I.SITES}, {I.pairs_sql(_OCC, clamp=False)} select i as site1_site_id, j as site2_site_id, d as distance, {_ORIENT} as orientation from p where (n1, n2) in (('click', 'view'), ('view', 'click'))")(
    lambda spark, d: pairs.occurrences(I.sites(spark, d), _OCC, "click", "view").select("site1_site_id", "site2_site_id", "distance", "orientation")
)
register("pair_locations_strand", f"with {I.SITES}, {I.pairs_sql(_OCC, clamp=False)} select i as site1_site_id, j as site2_site_id, d as distance from p where (n1, n2) in (('click', 'view'), ('view', 'click')) and case when n1 = 'click' then astr else bstr end = '+' and case when n1 = 'click' then bstr else astr end = '-'")(
    lambda spark, d: pairs.occurrences(I.sites(spark, d), _OCC, "click", "view", "+", "-").select("site1_site_id", "site2_site_id", "distance")
)
register("pair_distances_by_orientation", f"with {I.SITES}, {I.pairs_sql(_OCC, clamp=False)} select {_ORIENT} as orientation, d as distance, count(*) as n from p group by 1, 2")(lambda spark, d: signals.distances_by_orientation(pairs.occurrences(I.sites(spark, d), _OCC)))
register("pair_bed_lines", f"with {I.SITES}, {I.pairs_sql(_OCC, clamp=False)} select contig || chr(9) || least(ast, bst) || chr(9) || greatest(aen, ben) || chr(9) || n1 || '-' || n2 || chr(9) || d || chr(9) || '.' as value from p")(
    lambda spark, d: files.pair_lines(pairs.occurrences(I.sites(spark, d), _OCC), merge=True)
)
register("pair_two_lines", f"with {I.SITES}, {I.pairs_sql(_OCC, clamp=False)} select unnest([concat_ws(chr(9), contig, ast, aen, n1, '.', astr), concat_ws(chr(9), contig, bst, ben, n2, '.', bstr)]) as value from p")(lambda spark, d: files.pair_lines(pairs.occurrences(I.sites(spark, d), _OCC)))
register("pair_bedpe_lines", f"with {I.SITES}, {I.pairs_sql(_OCC, clamp=False)} select concat_ws(chr(9), contig, ast, aen, contig, bst, ben, n1 || '-' || n2, d, astr, bstr) as value from p")(lambda spark, d: files.pair_lines(pairs.occurrences(I.sites(spark, d), _OCC), "bedpe"))
register("pair_lines", f"with {I.SITES}, {I.pairs_sql(_OCC, clamp=False)}, l as (select d as x, sa.score as y from p join s sa on sa.site_id = i union all select d, sb.score from p join s sb on sb.site_id = j) select x, round(avg(y), 6) as y, count(y) as n from l group by x")(
    lambda spark, d: rounded(signals.lines(pairs.occurrences(I.sites(spark, d), _OCC), "distance", "score"), "y", to=6)
)


def _framed(spark: SparkSession, d: str) -> DataFrame:
    return signals.windows(pairs.occurrences(I.sites(spark, d), Window(max_dist=900), "click", "view"), 60)


def _signal(spark: SparkSession, d: str) -> DataFrame:
    return I.sites(spark, d).groupBy("contig", "start").agg(F.max("end").alias("end"), F.max("score").alias("value"))


_NEAR = Window(max_dist=900)
register("signal_windows", f"{O.windows_ctes(_NEAR, 60)} select i as site1_site_id, j as site2_site_id, ws as window_start, we as window_end, r1 as site1_rel_start, r2 as site2_rel_start, flip from fr")(
    lambda spark, d: _framed(spark, d).select("site1_site_id", "site2_site_id", "window_start", "window_end", "site1_rel_start", "site2_rel_start", "flip")
)
register("signal_track", O.track_sql(_NEAR, 60))(lambda spark, d: rounded(signals.track(signals.log_scores(signals.window_values(_framed(spark, d), _signal(spark, d))), _framed(spark, d)), "value", to=6))
register("signal_animation")(lambda spark, d: signals.animation(signals.window_values(_framed(spark, d), _signal(spark, d)), _framed(spark, d), 50, 25))

# orientation

_OW = I.DAY.but(stranded=True)
_UNDIRECTED = f"""with {I.STRANDED}, {I.counts_sql(I.DAY)}, u as (select distinct least(name1, name2) as x, greatest(name1, name2) as y, n from c),
v as (select split_part(x, '(', 1) as a, split_part(y, '(', 1) as b, substr(split_part(x, '(', 2), 1, 1) as sa, substr(split_part(y, '(', 2), 1, 1) as sb, n from u),
w as (select a as name1, b as name2, sum(case when sa = sb then n else 0 end)::bigint as same, sum(case when sa <> sb then n else 0 end)::bigint as opposite from v group by a, b)
select name1, name2, same + opposite as total, same, opposite, round(same / (same + opposite)::double, 9) as same_share, round(opposite / (same + opposite)::double, 9) as opposite_share,
 round(sqrt(2 * (same / (same + opposite)::double - 0.5) ** 2), 9) as std, round((same - opposite) ** 2 / (same + opposite)::double, 6) as chi2 from w where same + opposite > 0"""
register("orient_undirected", _UNDIRECTED)(lambda spark, d: rounded(rounded(orientation.orientation(rules.rules_of(I.sites(spark, d), _OW), p_values=False), "same_share", "opposite_share", "std"), "chi2", to=6))
_DIRECTED = f"""with {I.STRANDED}, {I.counts_sql(I.DAY.but(directional=True))},
v as (select split_part(name1, '(', 1) as a, split_part(name2, '(', 1) as b, substr(split_part(name1, '(', 2), 1, 1) as sa, substr(split_part(name2, '(', 2), 1, 1) as sb, n from c),
w as (select least(a, b) as name1, greatest(a, b) as name2,
 sum(case when (a <= b and sa = '+' and sb = '+') or (a >= b and sa = '-' and sb = '-') then n else 0 end)::bigint as k1, sum(case when (a >= b and sa = '+' and sb = '+') or (a <= b and sa = '-' and sb = '-') then n else 0 end)::bigint as k2,
 sum(case when (a < b and sa = '+' and sb = '-') or (a > b and sa = '+' and sb = '-') or (a = b and sa = '+' and sb = '-') then n else 0 end)::bigint as k3,
 sum(case when sa = '-' and sb = '+' then n else 0 end)::bigint as k4 from v group by 1, 2)
select name1, name2, k1 + k2 + k3 + k4 as total, k1 as "1-2", k2 as "2-1", k3 as convergent, k4 as divergent from w where k1 + k2 + k3 + k4 > 0"""
register("orient_directed", _DIRECTED.replace("(a <= b and sa = '+' and sb = '+') or (a >= b and sa = '-' and sb = '-')", "(a < b and sa = '+' and sb = '+') or (a > b and sa = '-' and sb = '-') or (a = b and sa = sb)").replace("(a >= b and sa = '+' and sb = '+') or (a <= b and sa = '-' and sb = '-')", "(a > b and sa = '+' and sb = '+') or (a < b and sa = '-' and sb = '-') or (a = b and sa = sb)"))(
    lambda spark, d: orientation.orientation(rules.rules_of(I.sites(spark, d), _OW.but(directional=True)), directional=True, p_values=False).select("name1", "name2", "total", "`1-2`", "`2-1`", "convergent", "divergent")
)
register("orient_pvalues")(lambda spark, d: orientation.orientation(rules.rules_of(I.sites(spark, d), _OW)))

# distances

_DW = Window(max_dist=100)


def _every(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All labels, crossed with themselves."""
    s = I.items(spark, d)
    return s, S.names_of(s).withColumnRenamed("name", "name1").crossJoin(S.names_of(s).withColumnRenamed("name", "name2"))


def _hist(spark: SparkSession, d: str, w: Window = _DW, of=_every, **more) -> DataFrame:
    return distances.count_distances(*of(spark, d), w, **more)


register("dist_histogram", hist_sql(_DW))(lambda spark, d: _hist(spark, d))
register("dist_histogram_directional", hist_sql(_DW.but(directional=True)))(lambda spark, d: _hist(spark, d, _DW.but(directional=True)))
_NEG = Window(min_dist=-20, max_dist=20, max_overlap=1)
register("dist_histogram_negative", hist_sql(_NEG))(lambda spark, d: _hist(spark, d, _NEG))
_SHARES = Window(max_dist=600, max_overlap=1, min_dist=-60)
register("dist_percentage", O.percentage_sql(_SHARES, I.DAY, 20))(lambda spark, d: distances.count_distances(I.sites(spark, d), _rules(spark, d), _SHARES, percentage=True, percentage_bins=20))
_V = "over (partition by name1, name2)"
register("dist_scale_minmax", hist_sql(_DW, tail=f"select name1, name2, distance, round(coalesce((value - min(value) {_V}) / nullif(max(value) {_V} - min(value) {_V}, 0), 0), 9) as value from h"))(lambda spark, d: rounded(distances.scale(_hist(spark, d)), "value"))
register("dist_scale_fraction", hist_sql(_DW, tail=f"select name1, name2, distance, round(coalesce(value / nullif(sum(value) {_V}, 0), 0), 9) as value from h"))(lambda spark, d: rounded(distances.scale(_hist(spark, d), "fraction"), "value"))
register("dist_smooth", hist_sql(_DW, tail="select name1, name2, distance, round(value, 9) as value from (select name1, name2, distance, avg(value) over (partition by name1, name2 order by distance rows between 2 preceding and 2 following) as value from h) where distance between 2 and 98"))(lambda spark, d: rounded(distances.smooth(_hist(spark, d), 5), "value"))
register("dist_smooth_full", hist_sql(_DW, tail="select name1, name2, distance, round(avg(value) over (partition by name1, name2 order by distance rows between 1 preceding and 2 following), 9) as value from h"))(lambda spark, d: rounded(distances.smooth(_hist(spark, d), 4, reduce=False), "value"))
register("dist_zscore", hist_sql(_DW, tail=f"select name1, name2, distance, round(coalesce((value - avg(value) {_V}) / nullif(stddev_pop(value) {_V}, 0), 0), 6) as value from h"))(lambda spark, d: rounded(distances.zscores(_hist(spark, d)), "value", to=6))
register("dist_mean", hist_sql(_DW, tail="select name1, name2, round(sum(value * distance) / nullif(sum(value), 0), 9) as mean_distance from h group by 1, 2"))(lambda spark, d: rounded(distances.mean_distance(_hist(spark, d)), "mean_distance"))
register("dist_max", hist_sql(_DW, tail="select name1, name2, distance as max_distance from (select *, row_number() over (partition by name1, name2 order by value desc, distance) as k from h) where k = 1"))(lambda spark, d: distances.max_distance(_hist(spark, d)))
register("dist_collapse_negative", hist_sql(_NEG, "select name1, name2, case when distance < 0 then -1 else distance end as distance, max(value) as value from h group by 1, 2, 3"))(lambda spark, d: distances.collapse_negative(_hist(spark, d, _NEG)))


_PEAK = 1.5


def _signal_and_peaks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The smoothed signal and its peaks; the counts, of a row per pair and distance, are checkpointed since both are used again."""
    c = checkpointed(_hist(spark, d))
    signal = distances.smooth(distances.scale(c), 3)
    return signal, checkpointed(distances.analyze(c, signal, "zscore", _PEAK, smooth_window=3))


def _peaks(spark: SparkSession, d: str) -> DataFrame:
    return _signal_and_peaks(spark, d)[1]


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    signal, peaks = _signal_and_peaks(spark, d)
    return distances.rank(peaks.join(distances.noise(signal, peaks), ["name1", "name2"]))


register("dist_background")(lambda spark, d: distances.correct_background(distances.scale(_hist(spark, d)), keep=True))
register("dist_peaks", O.peaks_sql(_DW, _PEAK))(lambda spark, d: rounded(_peaks(spark, d), "height", "prominence", "percent", to=6))
register("dist_preferred")(lambda spark, d: distances.preferred(*_every(spark, d), _DW, 2.0))
register("dist_noise", O.noise_sql(_DW, _PEAK))(lambda spark, d: rounded(distances.noise(*_signal_and_peaks(spark, d)), "noisiness", to=6))
register("dist_rank")(_ranked)
register("dist_hubs", f"{O.peaks_ctes(_DW, _PEAK)} select name1, count(distinct name2) as partners from pk group by 1")(lambda spark, d: distances.hubs(_peaks(spark, d)))
register("dist_count_peaks", f"{O.peaks_ctes(_DW, _PEAK)} select name1, name2, count(pk.distance) as n_peaks from f left join pk using (name1, name2) group by 1, 2")(lambda spark, d: distances.count_peaks(_every(spark, d)[1], _peaks(spark, d)))
register("dist_classify", f"{O.peaks_ctes(_DW, _PEAK)} select name1, name2, count(pk.distance) > 0 as is_peaking from f left join pk using (name1, name2) group by 1, 2")(lambda spark, d: distances.classify(_every(spark, d)[1], _peaks(spark, d)))
register("dist_periodicity", O.periodicity_sql(_DW))(lambda spark, d: distances.periodicity(_hist(spark, d)))
register("dist_autocorrelation", O.autocorrelation_sql(_DW))(lambda spark, d: rounded(distances.autocorrelation(_hist(spark, d)), "value", to=6).withColumn("value", F.when(F.col("value") == 0, 0.0).otherwise(F.col("value"))))
register("network_of_peaks", f"{O.peaks_ctes(_DW, _PEAK)}, e as (select *, row_number() over (partition by least(name1, name2), greatest(name1, name2) order by round(prominence, 6) desc, name1, name2, distance) as k from pk) select name1 as node1, name2 as node2, distance, round(prominence, 6) as prominence from e where k = 1")(
    lambda spark, d: network.build(rounded(_peaks(spark, d), "prominence", to=6), order=[F.col("prominence").desc(), "node1", "node2", "distance"])[1].select(F.col("node1"), F.col("node2"), "distance", "prominence")
)
_WIDE = ", ".join(f'max(case when distance = {k} then value end) as "{k}"' for k in range(11))
register("dist_wide", hist_sql(Window(max_dist=10), f"select name1, name2, {_WIDE} from h group by 1, 2"))(lambda spark, d: distances.wide(_hist(spark, d, Window(max_dist=10)), 0, 10))

# differential

_TWO = f"""{I.SITES}, s0 as (select * from s where (site_id // 4) % 2 = 0), s1 as (select * from s where (site_id // 4) % 2 = 1), {I.rules_sql(I.DAY, 's0', 'r0')}, {I.rules_sql(I.DAY, 's1', 'r1')}"""


def _samples(spark: SparkSession, d: str, join: str = "inner") -> DataFrame:
    return differential.combine({"a": rules.rules_of(I.half(spark, d, 0), I.DAY), "b": rules.rules_of(I.half(spark, d, 1), I.DAY)}, join=join)


_J = "j as (select r0.name1, r0.name2, r0.cosine as a, r1.cosine as b from r0 join r1 on r0.name1 = r1.name1 and r0.name2 = r1.name2)"
register("diff_inner", f"with {_TWO}, {_J} select name1, name2, round(a, 9) as a_cosine, round(b, 9) as b_cosine from j")(lambda spark, d: rounded(_samples(spark, d), "a_cosine", "b_cosine"))
register("diff_outer", f"with {_TWO} select coalesce(r0.name1, r1.name1) as name1, coalesce(r0.name2, r1.name2) as name2, round(coalesce(r0.cosine, 0), 9) as a_cosine, round(coalesce(r1.cosine, 0), 9) as b_cosine from (select * from r0 where name1 <> 'error') r0 full join r1 on r0.name1 = r1.name1 and r0.name2 = r1.name2")(
    lambda spark, d: rounded(differential.combine({"a": rules.rules_of(I.half(spark, d, 0), I.DAY).where("name1 <> 'error'"), "b": rules.rules_of(I.half(spark, d, 1), I.DAY)}, join="outer"), "a_cosine", "b_cosine")
)
_NORM = f"""with {_TWO}, {_J}, l as (select name1, name2, 'a' as smp, a as v from j union all select name1, name2, 'b', b from j), k as (select *, row_number() over (partition by smp order by v, name1, name2) as k from l),
m as (select k, avg(v) as m from k group by k), q as (select name1, name2, smp, v, avg(m) over (partition by smp, v) as q from k join m using (k))
select name1, name2, round(max(case when smp = 'a' then case when v = 0 then 0 else q end end), 9) as a_cosine, round(max(case when smp = 'b' then case when v = 0 then 0 else q end end), 9) as b_cosine from q group by 1, 2"""
register("diff_normalize", _NORM)(lambda spark, d: rounded(differential.normalize(_samples(spark, d)), "a_cosine", "b_cosine"))
register("diff_log2fc", f'with {_TWO}, {_J} select name1, name2, round(log2((a + 0.01) / (b + 0.01)), 6) as "a/b_cosine_log2fc" from j')(lambda spark, d: rounded(differential.fold_changes(_samples(spark, d)).select("name1", "name2", "`a/b_cosine_log2fc`"), "a/b_cosine_log2fc", to=6))
register("diff_select", f"with {_TWO}, {_J} select name1, name2 from j where (log2((a + 0.01) / (b + 0.01)) <= -0.05 or log2((a + 0.01) / (b + 0.01)) >= 0.05) and (a + b) / 2 >= 0.1")(lambda spark, d: differential.select(differential.fold_changes(_samples(spark, d)), bounds=(-0.05, 0.05), least_mean=0.1).select("name1", "name2"))
register("diff_correlation", f"with {_TWO}, {_J}, x as (select round(corr(a, b), 6) as r from j) select 'a' as sample1, 'a' as sample2, 1.0::double as r union all select 'b', 'b', 1.0 union all select 'a', 'b', r from x union all select 'b', 'a', r from x")(lambda spark, d: rounded(differential.correlation(_samples(spark, d)), "r", to=6))
_RANKS = f"with {_TWO}, {_J}, k as (select *, row_number() over (order by a) as ka, row_number() over (order by b) as kb from j), x as (select round(corr(ra, rb), 6) as r from (select avg(ka) over (partition by a) as ra, avg(kb) over (partition by b) as rb from k))"
register("diff_spearman", f"{_RANKS} select 'a' as sample1, 'a' as sample2, 1.0::double as r union all select 'b', 'b', 1.0 union all select 'a', 'b', r from x union all select 'b', 'a', r from x")(lambda spark, d: rounded(differential.correlation(_samples(spark, d), method="spearman"), "r", to=6))
_FOLD = 'round(log2((a + 0.01) / (b + 0.01)), 6)'
register("diff_extremes", f"""with {_TWO}, {_J}, v as (select name1, name2, {_FOLD} as v from j),
k as (select *, row_number() over (order by v, name1, name2) as lo, row_number() over (order by v desc, name1, name2) as hi from v)
select name1, name2, v as "a/b_cosine_log2fc", 'low' as "end" from k where lo <= 5 union all select name1, name2, v, 'high' from k where hi <= 5""")(
    lambda spark, d: plotdata.extremes(rounded(differential.fold_changes(_samples(spark, d)), "a/b_cosine_log2fc", to=6).select("name1", "name2", "`a/b_cosine_log2fc`"), "a/b_cosine_log2fc", 5)
)

# network


def _edges(spark: SparkSession, d: str) -> DataFrame:
    r = rules.rules_of(I.items(spark, d), _WEEK)
    return network.build(r, order=[F.col("cosine").desc()])[1]


_EDGES = f"with {I.ITEMS}, {I.rules_sql(_WEEK)}, e as (select name1 as node1, name2 as node2, n12, cosine from (select *, row_number() over (partition by least(name1, name2), greatest(name1, name2) order by cosine desc, name1, name2) as k from r) where k = 1)"
register("net_edges", f"{_EDGES} select node1, node2, n12, round(cosine, 9) as cosine from e")(lambda spark, d: rounded(_edges(spark, d).select("node1", "node2", "n12", "cosine"), "cosine"))
register("net_nodes", f"{_EDGES} select node1 as node from e union select node2 from e")(lambda spark, d: network.build(rules.rules_of(I.items(spark, d), _WEEK), order=[F.col("cosine").desc()])[0])
register("net_degree", f"{_EDGES} select node, count(*)::double as degree from (select node1 as node from e union all select node2 from e) group by node")(lambda spark, d: network.degree(_edges(spark, d)))
register("net_degree_weighted", f"{_EDGES} select node, round(sum(w), 6) as degree from (select node1 as node, cosine as w from e union all select node2, cosine from e) group by node")(lambda spark, d: rounded(network.degree(_edges(spark, d), "cosine"), "degree", to=6))
register("net_degree_out", f"{_EDGES} select node, sum(w)::double as degree from (select node1 as node, 1 as w from e union all select node2, 0 from e) group by node")(lambda spark, d: network.degree(_edges(spark, d), direction="out"))
_ATTRIBUTES = " union all ".join(f"select '{c}' as attribute from r having count(distinct name1) = count(distinct {c}) and count(distinct name1) = count(distinct (name1, {c}))" for c in ("name2", "pair", "n12", "n1", "n2", "cosine"))
register("net_node_attributes", f"with {I.ITEMS}, {I.rules_sql(_WEEK)} {_ATTRIBUTES}")(lambda spark, d: spark.createDataFrame([(c,) for c in network.node_attributes(rules.rules_of(I.items(spark, d), _WEEK), "name1")], "attribute string"))
register("net_louvain")(lambda spark, d: network.cluster(_edges(spark, d), weight="cosine"))
register("net_blockmodel")(lambda spark, d: network.cluster(_edges(spark, d), "blockmodel"))
register("net_betweenness")(lambda spark, d: network.betweenness(_edges(spark, d)))
register("net_neighbourhood", f"{_EDGES}, b as (select 'Brand#11' as n union select node2 from e where node1 = 'Brand#11' union select node1 from e where node2 = 'Brand#11') select node1, node2 from e where node1 in (select n from b) and node2 in (select n from b)")(
    lambda spark, d: network.neighbourhood(_edges(spark, d), "Brand#11").select("node1", "node2")
)
register("net_random")(lambda spark, d: network.random_network(network.build(rules.rules_of(I.items(spark, d), _WEEK))[0], 50))
register("net_powerlaw")(lambda spark, d: network.powerlaw(network.degree(_edges(spark, d))))

# annotation and enrichment

_ANNOTATE = f"""with {I.SITES}, {I.REGIONS}, f as (select site_id as f_id, contig, strand, 'g' || (site_id % 50) as gene_name, case when strand = '-' then en + 600 else st end as pt from s where name = 'purchase'),
j as (select r.site_id, f.f_id, f.gene_name, ((r.st + r.en) // 2 - pt) * case when strand = '-' then -1 else 1 end as distance from r join f on r.contig = f.contig),
k as (select *, row_number() over (partition by site_id order by abs(distance), f_id) as k from j where distance between -10000 and 1000)"""
register("annotate_best", f"{_ANNOTATE} select r.site_id, f_id, gene_name, distance from r left join (select * from k where k = 1) x on x.site_id = r.site_id")(lambda spark, d: annotation.annotate(I.regions(spark, d), I.features(spark, d)).select("site_id", "f_id", "gene_name", "distance"))
register("annotate_all", f"{_ANNOTATE} select site_id, f_id, gene_name, distance from k")(lambda spark, d: annotation.annotate(I.regions(spark, d), I.features(spark, d), best=False, keep_all=False).select("site_id", "f_id", "gene_name", "distance"))
register("annotated_genes", f"{_ANNOTATE} select distinct gene_name as gene from k where k = 1")(lambda spark, d: annotation.annotated_genes(annotation.annotate(I.regions(spark, d), I.features(spark, d))))


def _enriched(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as genes, the brands and types of what they ship as terms."""
    li, part = I.table(spark, d, "lineitem"), I.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    j = li.join(part, "l_partkey")
    owned = j.select(F.col("l_suppkey").cast("string").alias("gene"), F.col("p_brand").alias("term")).union(j.select(F.col("l_suppkey").cast("string"), F.col("p_type")))
    terms = owned.select("term").distinct().select("term", F.when(F.col("term").startswith("Brand"), "brand").otherwise("type").alias("aspect"), F.lit(1).alias("depth"), F.col("term").alias("description"))
    return annotation.enrichment(owned.where("cast(gene as long) % 3 = 0").select("gene"), owned, terms)


register("enrichment", O.enrichment_sql())(lambda spark, d: doubles_rounded(_enriched(spark, d).drop("depth", "description")))
_HIERARCHY = "h as (select n_name as term, r_name as parent from nation join region on n_regionkey = r_regionkey union select r_name, 'WORLD' from region)"
register("term_closure", f"with {_HIERARCHY}, t as (select term from h union select parent from h) select term, term as ancestor from t union select term, parent from h union select a.term, b.parent from h a join h b on b.term = a.parent")(lambda spark, d: annotation.closure(I.hierarchy(spark, d)))
register("term_depths", f"with {_HIERARCHY} select term, case when parent = 'WORLD' then 1 else 2 end as depth from h union select 'WORLD', 0")(
    lambda spark, d: files.depths(I.hierarchy(spark, d).select("term").union(I.hierarchy(spark, d).select("parent")).distinct(), I.hierarchy(spark, d))
)

# motifs

_MOTIF = {"M": [[9.0, 0, 0, 0], [0, 9.0, 0, 0], [0, 0, 9.0, 0]]}


def _motif_sites(spark: SparkSession, d: str) -> DataFrame:
    g = I.genome(spark, d)
    return motifs.scan(g.select("contig", F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end")), g, _MOTIF, pvalue=0.02, resolve=None)


register(
    "motif_scan",
    f"""with {I.SITES}, g as (select contig, string_agg(case name[1] when 'c' then 'A' when 'e' then 'C' when 'p' then 'G' when 's' then 'T' else 'A' end, '' order by st, site_id) as seq from s group by contig),
k as (select contig, seq, unnest(range(0, length(seq) - 2)) as i from g)
select contig, i as start, i + 3 as "end", 'M' as name, case when seq[i + 1:i + 3] = 'ACG' then '+' else '-' end as strand from k where seq[i + 1:i + 3] in ('ACG', 'CGT')""",
)(lambda spark, d: _motif_sites(spark, d).select("contig", "start", "end", "name", "strand"))

# figures

register("plot_bubble", all_sql("select pair, round(cosine, 9) as cosine from r order by r.cosine desc, name1, name2 limit 10"))(lambda spark, d: rounded(plotdata.bubble(_rules(spark, d), n=10).select("pair", "cosine"), "cosine"))
register("plot_heatmap", all_sql("select a.name1, b.name2, round(coalesce(r.cosine, 0), 9) as value from (select distinct name1 from t) a cross join (select distinct name2 from t) b left join r on r.name1 = a.name1 and r.name2 = b.name2").replace(" select a.name1, b.name2,", ", t as (select * from r order by cosine desc, name1, name2 limit 6) select a.name1, b.name2,"))(
    lambda spark, d: rounded(plotdata.heatmap(_rules(spark, d), n=6), "value")
)
register("plot_scatter", all_sql("select pair, round(cosine, 9) as x, round(confidence, 9) as y, cosine >= 0.2 and confidence >= 0.1 as selected from r"))(lambda spark, d: rounded(plotdata.scatter(_rules(spark, d), "cosine", "confidence", 0.2, 0.1), "x", "y"))
register("plot_network_sizes", f"{_EDGES} select node1, node2, round(1 + coalesce((cosine - min(cosine) over ()) / nullif(max(cosine) over () - min(cosine) over (), 0), 0) * 9, 6) as size from e")(lambda spark, d: rounded(plotdata.scaled(_edges(spark, d), "cosine").select("node1", "node2", "size"), "size", to=6))
register("plot_genome_view", f"with {I.SITES} select site_id, contig, st as start, en as \"end\", name from s where contig = (select min(contig) from s) order by st, en, site_id limit 100")(lambda spark, d: plotdata.genome_view(I.sites(spark, d)).select("site_id", "contig", "start", "end", "name"))
register("plot_signal", hist_sql(_DW, tail="select distance, value from h where name1 = 'Brand#11' and name2 = 'Brand#12'"))(lambda spark, d: plotdata.one_signal(_hist(spark, d), "Brand#11", "Brand#12"))
register("plot_orientation", f"with u as ({_UNDIRECTED}) select name1 || '-' || name2 as pair, 'same' as scenario, same_share as share from u union all select name1 || '-' || name2, 'opposite', opposite_share from u")(
    lambda spark, d: rounded(plotdata.shares(orientation.orientation(rules.rules_of(I.sites(spark, d), _OW), p_values=False)), "share")
)
register("gene_column", "select 'entrez' as matched")(lambda spark, d: spark.createDataFrame([(annotation.match_column(*_gene_tables(spark, d)),)], "matched string"))
register("enrichment_matched", O.matched_sql())(lambda spark, d: annotation.matched(*_gene_tables(spark, d), "entrez").select("gene"))


def _gene_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Genes named by a number, and a table of their ids under several names, in which that number is the column entrez."""
    s = I.table(spark, d, "supplier")
    genes = s.where("s_suppkey % 3 = 0").select((F.col("s_suppkey") + 7000).cast("string").alias("gene"))
    return genes, s.select("s_name", F.col("s_suppkey").alias("ensembl"), (F.col("s_suppkey") + 7000).alias("entrez"))


register("plot_terms", O.term_bubble_sql())(lambda spark, d: rounded(plotdata.term_bubble(rounded(_enriched(spark, d), "fdr"), "brand").select("term", "count", "minus_log_fdr"), "minus_log_fdr", to=5))
