"""Readers and writers of the file formats of sites, features, sequences, signals and terms."""

from __future__ import annotations

import json
import math
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.storage import checkpointed
from pairloom.schema import SITE, Window

_BED = "contig string, start bigint, end bigint, name string, score string, strand string"


def with_ids(df: DataFrame) -> DataFrame:
    """Sites in their layout, with ids that follow the order of the files' rows where there is none yet."""
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in SITE if f.name != "site_id"]
    return df.select((F.col("site_id") if "site_id" in have else F.monotonically_increasing_id()).alias("site_id"), *cols)


def read_bed(spark: SparkSession, path) -> DataFrame:
    """Sites from BED: tab-separated, no header, at least four columns; comments and track lines are skipped."""
    raw = spark.read.text(path).where("length(trim(value)) > 0 and not value rlike '^(#|track|browser)'")
    cell = F.split("value", "\t")
    at = lambda i: F.when(F.get(cell, F.lit(i)) != ".", F.get(cell, F.lit(i)))
    return with_ids(raw.select(F.get(cell, F.lit(0)).alias("contig"), F.get(cell, F.lit(1)).cast("long").alias("start"), F.get(cell, F.lit(2)).cast("long").alias("end"), F.get(cell, F.lit(3)).alias("name"), at(4).try_cast("double").alias("score"), F.get(cell, F.lit(5)).alias("strand")))


def read_footprints(spark: SparkSession, folder: str, condition: str) -> DataFrame:
    """Sites of <name>/beds/*_<condition>_bound.bed below a folder; an unknown condition is an error that names the known ones."""
    raw = spark.read.option("pathGlobFilter", "*_bound.bed").option("recursiveFileLookup", "true").text(folder).where("length(trim(value)) > 0 and not value rlike '^(#|track|browser)'").withColumn("_path", F.col("_metadata.file_path"))
    raw = raw.withColumn("_condition", F.regexp_extract("_path", r"/beds/[^/]*?([^_/]+)_bound\.bed$", 1))
    if not raw.where(F.col("_condition") == condition).limit(1).count():
        known = sorted(r[0] for r in raw.select("_condition").distinct().collect())
        raise ValueError(f"no files of condition {condition!r}; there are {', '.join(known) or 'none'}")
    cell = F.split("value", "\t")
    rows = raw.where(F.col("_condition") == condition).select(F.get(cell, F.lit(0)).alias("contig"), F.get(cell, F.lit(1)).cast("long").alias("start"), F.get(cell, F.lit(2)).cast("long").alias("end"), F.get(cell, F.lit(3)).alias("name"), F.get(cell, F.lit(4)).try_cast("double").alias("score"), F.get(cell, F.lit(5)).alias("strand"))
    return with_ids(rows)


def read_gtf(spark: SparkSession, path, keys: tuple[str, ...] = ("gene_id", "gene_name")) -> DataFrame:
    """Features from GTF, half-open from 0, with the chosen attributes as columns and all of them as a map.

    Values may be quoted or not. Of an attribute that is given more than once, as tags often are, the first value counts.
    """
    raw = spark.read.text(path).where("length(trim(value)) > 0 and not value like '#%'")
    cell = F.split("value", "\t")
    one = r'([^\s;"]+)\s+(?:"([^"]*)"|([^\s;"]+))'
    found = F.regexp_extract_all(F.get(cell, F.lit(8)), F.lit(one), F.lit(0))
    pairs = F.transform(found, lambda x: F.struct(F.regexp_extract(x, one, 1).alias("k"), F.concat(F.regexp_extract(x, one, 2), F.regexp_extract(x, one, 3)).alias("v")))
    names = F.transform(pairs, lambda x: x["k"])
    attributes = F.map_from_entries(F.filter(pairs, lambda x, i: F.array_position(names, x["k"]) == i + 1))
    rows = raw.select(F.monotonically_increasing_id().alias("f_id"), F.get(cell, F.lit(0)).alias("contig"), F.get(cell, F.lit(2)).alias("feature"), (F.get(cell, F.lit(3)).cast("long") - 1).alias("start"), F.get(cell, F.lit(4)).cast("long").alias("end"), F.get(cell, F.lit(6)).alias("strand"), attributes.alias("attributes"))
    return rows.select("f_id", "contig", "feature", "start", "end", "strand", *[F.col("attributes")[k].alias(k) for k in keys], "attributes")


def read_table(spark: SparkSession, path, sep: str = "\t") -> DataFrame:
    """A table with a header; types are inferred."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=True)


def read_signal(spark: SparkSession, path) -> DataFrame:
    """A signal from bedGraph: (contig, start, end, value)."""
    return spark.read.csv(path, sep="\t", schema="contig string, start bigint, end bigint, value double", comment="#")


def read_fasta(spark: SparkSession, path) -> DataFrame:
    """(contig, seq): one row per record, which Spark splits at the header marks."""
    raw = spark.read.option("lineSep", ">").text(path).where("length(trim(value)) > 0")
    head = F.regexp_extract("value", r"^(\S+)", 1)
    return raw.select(head.alias("contig"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")).alias("seq"))


def read_obo(spark: SparkSession, path) -> tuple[DataFrame, DataFrame]:
    """(terms, parents): term, aspect, depth, description; and term, parent. Obsolete terms, and stanzas of other kinds, are left out."""
    raw = spark.read.option("lineSep", "[Term]").text(path)
    # a stanza ends where the next one, of whatever kind, begins
    stanza = F.regexp_replace("value", r"(?s)\n\[[A-Z][A-Za-z]*\].*", "\n")
    raw = raw.select(stanza.alias("value"))
    line = lambda k: F.regexp_extract("value", rf"(?m)^{k}: (.*?)\s*$", 1)
    t = raw.where(F.col("value").rlike(r"(?m)^id: ") & ~F.col("value").rlike(r"(?m)^is_obsolete: true")).select(line("id").alias("term"), line("namespace").alias("aspect"), line("name").alias("description"), F.regexp_extract_all("value", F.lit(r"(?m)^is_a: (\S+)"), F.lit(1)).alias("up"))
    t = t.where("term <> ''")
    parents = t.select("term", F.explode("up").alias("parent"))
    return t.join(depths(t.select("term"), parents), "term", "left").select("term", "aspect", "depth", "description"), parents


def depths(terms: DataFrame, parents: DataFrame) -> DataFrame:
    """(term, depth): the longest way up to a root. A cycle, which has no longest way, raises."""
    level = terms.select("term").distinct().join(parents, "term", "left_anti").withColumn("depth", F.lit(0))
    total = terms.select("term").distinct().count()
    out, depth = level, 0
    while True:
        depth += 1
        level = checkpointed(parents.join(level.select(F.col("term").alias("parent")), "parent", "left_semi").select("term").distinct().withColumn("depth", F.lit(depth)))
        if not level.limit(1).count():
            break
        if depth > total:
            raise ValueError("the terms' parents form a cycle")
        out = out.unionByName(level)
    return out.groupBy("term").agg(F.max("depth").alias("depth"))


def check_bounds(regions: DataFrame, genome: DataFrame) -> DataFrame:
    """The regions, if all lie on known contigs and inside them."""
    sizes = genome.select("contig", F.length("seq").alias("_size"))
    bad = regions.join(sizes, "contig", "left").where("_size is null or start < 0 or end > _size").limit(3).collect()
    if bad:
        raise ValueError("regions outside the sequences: " + "; ".join(f"{r.contig}:{r.start}-{r.end}" for r in bad))
    return regions


def bed_lines(sites: DataFrame) -> DataFrame:
    """One text line per site; null fields are left out."""
    return sites.select(F.concat_ws("\t", "contig", F.col("start").cast("string"), F.col("end").cast("string"), "name", F.col("score").cast("string"), "strand").alias("value"))


def write_bed(sites: DataFrame, path: str) -> None:
    bed_lines(sites).write.text(path)


def pair_lines(pairs: DataFrame, fmt: str = "bed", merge: bool = False) -> DataFrame:
    """Text lines of pair occurrences: two BED lines each, or one over both sites, or one of BEDPE."""
    if fmt == "bedpe":
        cols = [F.col(c).cast("string") for c in ("site1_contig", "site1_start", "site1_end", "site2_contig", "site2_start", "site2_end")]
        return pairs.select(F.concat_ws("\t", *cols, F.concat_ws("-", "site1_name", "site2_name"), F.col("distance").cast("string"), F.coalesce("site1_strand", F.lit(".")), F.coalesce("site2_strand", F.lit("."))).alias("value"))
    if fmt != "bed":
        raise ValueError("fmt must be bed or bedpe")
    if merge:
        return pairs.select(F.concat_ws("\t", "site1_contig", F.least("site1_start", "site2_start").cast("string"), F.greatest("site1_end", "site2_end").cast("string"), F.concat_ws("-", "site1_name", "site2_name"), F.col("distance").cast("string"), F.lit(".")).alias("value"))
    one = lambda n: F.concat_ws("\t", f"site{n}_contig", F.col(f"site{n}_start").cast("string"), F.col(f"site{n}_end").cast("string"), f"site{n}_name", F.lit("."), F.coalesce(f"site{n}_strand", F.lit(".")))
    return pairs.select(F.explode(F.array(one(1), one(2))).alias("value"))


def write_table(table: DataFrame, path: str, sep: str = "\t") -> None:
    """Delimited files with a header."""
    table.write.csv(path, sep=sep, header=True)


def write_text_file(lines: DataFrame, path: str) -> None:
    """Lines as the one file `path`: for files whose name tells something. They pass through one task."""
    spark = lines.sparkSession
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    lines.coalesce(1).write.text(f"{path}.parts")
    parts = [f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(f"{path}.parts")) if f.getPath().getName().startswith("part-")]
    if parts:
        fs.rename(parts[0], to)
    else:
        fs.create(to).close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}.parts"), True)


def save(path: str, tables: dict[str, DataFrame], window: Window | None = None) -> None:
    """Tables as Parquet below a folder, with the settings they were counted with."""
    for name, t in tables.items():
        t.write.parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(json.dumps({"tables": sorted(tables), "window": asdict(window) if window else None}),)], "value string").coalesce(1).write.text(f"{path}/params")


def load(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], Window | None]:
    p = json.loads(spark.read.text(f"{path}/params").first().value)
    return {t: spark.read.parquet(f"{path}/{t}") for t in p["tables"]}, Window(**p["window"]) if p["window"] else None


# motifs


def read_motifs(text: str) -> dict[str, list[list[float]]]:
    """Motifs of a JASPAR or MEME file, by name: for each place the counts or shares of A, C, G and T."""
    out: dict[str, list[list[float]]] = {}
    name, rows = None, {}
    if "MEME version" in text or text.lstrip().startswith("MOTIF"):
        for line in text.splitlines():
            w = line.split()
            if w[:1] == ["MOTIF"]:
                name = w[2] if len(w) > 2 else w[1]
                out[name] = []
            elif name and len(w) == 4 and all(x.replace(".", "", 1).replace("e-", "", 1).isdigit() for x in w):
                out[name].append([float(x) for x in w])
        return out
    for line in text.splitlines():
        if line.startswith(">"):
            w = line[1:].split()
            name, rows = (w[1] if len(w) > 1 else w[0]), {}
        elif name and line.strip():
            w = line.replace("[", " ").replace("]", " ").split()
            rows[w[0]] = [float(x) for x in w[1:]]
            if len(rows) == 4:
                out[name] = [list(x) for x in zip(*(rows[b] for b in "ACGT"), strict=True)]
    return out


def score_matrix(counts: list[list[float]], gc: float = 0.5, pseudo: float = 0.8) -> list[list[float]]:
    """Log-odds of each base at each place against a background of this share of G and C."""
    base = [(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2]
    out = []
    for row in counts:
        total = sum(row)
        scale = 1.0 if total > 1.5 else 100.0
        out.append([math.log2((x * scale + pseudo * b) / (total * scale + pseudo) / b) for x, b in zip(row, base, strict=True)])
    return out


def score_threshold(matrix: list[list[float]], pvalue: float = 1e-5, gc: float = 0.5, step: float = 0.01) -> float:
    """The smallest score that a random sequence reaches with at most this probability, from the distribution of rounded scores."""
    base = [(1 - gc) / 2, gc / 2, gc / 2, (1 - gc) / 2]
    dist = {0: 1.0}
    for row in matrix:
        nxt: dict[int, float] = {}
        for s, p in dist.items():
            for x, b in zip(row, base, strict=True):
                k = s + round(x / step)
                nxt[k] = nxt.get(k, 0.0) + p * b
        dist = nxt
    tail, best = 0.0, None
    for s in sorted(dist, reverse=True):
        tail += dist[s]
        if tail > pvalue:
            break
        best = s
    return math.inf if best is None else best * step - step * len(matrix) / 2
