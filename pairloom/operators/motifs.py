"""Sites from motifs: scanning the sequences of regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.storage import ship
from pairloom.operators.sites import resolve_overlaps, widen
from pairloom.sources.files import check_bounds, score_matrix, score_threshold, with_ids

#: Bases of a sequence that one row holds; contigs are cut into overlapping pieces of it before regions are joined.
PIECE = 1 << 16


def pieces(genome: DataFrame, overlap: int) -> DataFrame:
    """(contig, piece, offset, seq): the sequences in pieces that overlap, so that no task needs a whole contig."""
    n = F.length("seq")
    g = genome.select("contig", "seq", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / PIECE)).cast("int"))).alias("piece"))
    return g.select("contig", "piece", (F.col("piece").cast("long") * PIECE).alias("offset"), F.substring("seq", F.col("piece") * PIECE + 1, F.lit(PIECE + overlap)).alias("seq"))


def scan(regions: DataFrame, genome: DataFrame, motifs: dict[str, list[list[float]]], pvalue: float = 1e-5, gc: float = 0.5, extend: int = 0, resolve: str | None = "merge") -> DataFrame:
    """Sites where a motif scores at its threshold or above, on either strand, in regions of known sequences.

    Motifs are broadcast; their number has nothing to do with the size of the sequences. Overlapping sites of one
    motif are resolved over the whole result.
    """
    spark = regions.sparkSession
    tables = {}
    for name, counts in motifs.items():
        m = np.array(score_matrix(counts, gc))
        tables[name] = (m, m[::-1, ::-1], score_threshold(m.tolist(), pvalue, gc))
    shared = spark.sparkContext.broadcast(tables)
    longest = max(len(m) for m, _, _ in tables.values())
    wide = check_bounds(widen(regions, extend) if extend else regions, genome).select("contig", "start", "end").distinct()
    seqs = pieces(genome, longest - 1)
    r = wide.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / PIECE).cast("int"), F.floor(F.greatest("start", F.col("end") - 1) / PIECE).cast("int"))))
    # what of the region begins in the piece, and as much of it as a motif reaches beyond
    lo = F.greatest(F.col("start"), F.col("offset"))
    hi = F.least(F.col("end"), F.col("offset") + PIECE + longest - 1)
    parts = r.join(seqs, ["contig", "piece"]).select("contig", lo.alias("at"), F.substring("seq", (lo - F.col("offset") + 1).cast("int"), (hi - lo).cast("int")).alias("seq"), F.least(F.col("end"), F.col("offset") + PIECE).alias("until"))

    def work(batches):
        code = np.full(256, 4, np.int8)
        for i, b in enumerate(b"ACGT"):
            code[b] = i
        for p in batches:
            out = []
            for contig, at, seq, until in zip(p.contig, p["at"], p.seq, p.until, strict=True):
                x = code[np.frombuffer(seq.encode(), np.uint8)]
                for name, (fwd, rev, least) in shared.value.items():
                    k = len(fwd)
                    n = len(x) - k + 1
                    if n <= 0:
                        continue
                    for matrix, strand in ((fwd, "+"), (rev, "-")):
                        full = np.column_stack([matrix, np.full(k, -np.inf)])
                        s = sum(full[j][x[j : j + n]] for j in range(k))
                        out += [(contig, at + i, at + i + k, name, float(s[i]), strand) for i in np.flatnonzero(s >= least).tolist() if at + i < until]
            yield pd.DataFrame(out, columns=["contig", "start", "end", "name", "score", "strand"])

    ship(regions.sparkSession)
    found = parts.mapInPandas(work, "contig string, start bigint, end bigint, name string, score double, strand string").distinct()
    key = F.xxhash64("contig", "start", "end", "name", "strand")
    sites = with_ids(found.withColumn("site_id", key))
    return resolve_overlaps(sites, resolve) if resolve else sites
