"""SimHash near-duplicates (operator 10), found through deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four bits differ in at most
one bit of some segment (two in each would be six). Each segment is indexed once for each
of its bits with that bit left out, so such two share a signature (segment, bit left out, the rest), and an equality
join finds every pair within the distance. The join verifies the whole distance, and takes a pair at one signature only.
For very many fingerprints the other two segments are cut further, and a signature holds one of these runs as well.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, map_texts, saved, spaced_words
from pairloom.llm.components import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: (lowest bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Different fingerprints from which signatures hold a run of the other segments too.
REFINE_FROM = 30_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bit i is set if it is set in over half the hashes of the shingles, repeats included; without words zero."""
    words = spaced_words(text)
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(shingle, len(words))
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(line[a:b], seed) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist(), strict=True)], "<u8")
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, fingerprint (as a signed long) and the columns `more`, for whole texts. Null texts have no words."""

    def work(batch, texts):
        out = {n: column(batch, n) for n in batch.schema.names if n != "text"}
        return out | {"fingerprint": pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))}

    rows = docs.select("doc_id", "text", *more)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"]
    return map_texts(rows, rows.columns, ", ".join([*kinds, "fingerprint bigint"]), work)


def _long(x: int) -> int:
    """64 bits as a signed long."""
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks() -> list[int]:
    return [((1 << bits) - 1) << low for low, bits in SEGMENTS]


def _parts(segment: int, distance: int) -> list[tuple[int, int]]:
    """(lowest bit, bits) of distance + 1 runs of the bits outside a segment. Of two fingerprints within the distance at least one run is equal."""
    left, runs = distance + 1, []
    others = [x for k, x in enumerate(SEGMENTS) if k != segment]
    for k, (low, bits) in enumerate(others):
        n = -(-left // (len(others) - k))
        cuts = [bits * i // n for i in range(n + 1)]
        runs += [(low + a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        left -= n
    return runs


def _runs(segment: int, distance: int, refine: bool) -> list[tuple[int, int]]:
    return _parts(segment, distance) if refine else [(0, 0)]


def signatures(prints: DataFrame, distance: int = DISTANCE, refine: bool = False) -> DataFrame:
    """The columns of prints(f, ...) and key: 64 rows for each fingerprint f, distance + 1 times as many if refined.

    A key holds the bit left out, the number of the run of the other segments that it holds as well (refined), the
    rest of the bit's segment, and that run.
    """
    take = lambda mask, low: F.shiftrightunsigned(F.col("f").bitwiseAND(F.lit(_long(mask))), low)
    keys = [
        F.lit(((low + i) << 3 | j) << 34).bitwiseOR(F.shiftleft(take(mask & ~(1 << (low + i)), low), 12)).bitwiseOR(take(((1 << n) - 1) << at, at))
        for k, ((low, bits), mask) in enumerate(zip(SEGMENTS, _masks(), strict=True))
        for i in range(bits)
        for j, (at, n) in enumerate(_runs(k, distance, refine))
    ]
    return prints.select("*", F.explode(F.array(*keys)).alias("key"))


def links(prints: DataFrame, distance: int = DISTANCE, refine: bool | None = None) -> DataFrame:
    """Every pair (a, b), a < b as signed longs, of distinct fingerprints prints(f) within `distance` (at most 5), once.

    With a column c only pairs that differ in it. `refine` adds to every signature a run of the other segments that
    must be equal; the pairs are the same, with more signatures and far fewer candidates. If not given it is chosen by
    the number of fingerprints: signatures alone have some 20 bits, so beyond REFINE_FROM they become crowded.
    """
    if distance >= 2 * len(SEGMENTS):
        raise ValueError("three segments hold for a distance of at most five")
    if refine is None:
        refine = prints.count() > REFINE_FROM
    x = F.col("a.f").bitwiseXOR(F.col("b.f"))
    first = None
    # of the signatures that a pair shares, it is taken at its first segment with one difference or none, there at the bit that differs or else the lowest, and at the first equal run
    for k, ((low, _), mask) in reversed(list(enumerate(zip(SEGMENTS, _masks(), strict=True)))):
        d = x.bitwiseAND(F.lit(_long(mask)))
        bit = F.when(d == 0, F.lit(low).cast("long")).otherwise(F.bit_count(d - 1).cast("long"))
        run = F.coalesce(*[F.when(x.bitwiseAND(F.lit(_long(((1 << n) - 1) << at))) == 0, F.lit(j).cast("long")) for j, (at, n) in enumerate(_runs(k, distance, refine))])
        here = F.when(F.bit_count(d) <= 1, F.shiftleft(bit, 3) + run)
        first = here if first is None else F.coalesce(here, first)
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.f") < F.col("b.f")) & (F.bit_count(x) <= distance) & (F.shiftright(F.col("a.key"), 34) == first)
    if "c" in prints.columns:
        on = on & (F.col("a.c") != F.col("b.c"))
    s = signatures(prints, distance, refine)
    # Spark takes the exploded table for no larger than the one it comes from, and would broadcast it
    return s.alias("a").join(s.alias("b").hint("merge"), on).select(F.col("a.f").alias("a"), F.col("b.f").alias("b"))


def stars(prints: DataFrame, distance: int = DISTANCE, refine: bool = False) -> DataFrame:
    """Links (a, b) of each fingerprint of prints(f) to the smallest one of each of its signatures, if that is within the distance."""
    s = signatures(prints, distance, refine)
    least = s.groupBy("key").agg(F.min("f").alias("m"))
    near = (F.col("f") != F.col("m")) & (F.bit_count(F.col("f").bitwiseXOR(F.col("m"))) <= distance)
    return s.join(least.hint("merge"), "key").where(near).select(F.col("f").alias("a"), F.col("m").alias("b"))


def groups(prints: DataFrame, distance: int = DISTANCE, refine: bool | None = None) -> DataFrame:
    """(f, component) for every fingerprint of prints(f): the smallest fingerprint reachable by links, itself included.

    Dense groups are contracted first: each fingerprint is linked to the smallest one of each of its signatures if that
    is within the distance. Then all pairs that share a signature are verified, but only those between different
    contracted groups are given out, so a group of near fingerprints gives few links, not all its pairs.
    """
    if refine is None:
        refine = prints.count() > REFINE_FROM
    near = components(stars(prints, distance, refine)).select(F.col("node").alias("f"), F.col("component").alias("c"))
    # tables with a row for each fingerprint or group are merged: broadcast, they would go through the driver and into every executor
    part = saved(prints.join(near.hint("merge"), "f", "left").select("f", F.coalesce("c", "f").alias("c")), "contracted")
    between = links(part, distance, refine)
    side = lambda c: part.select(F.col("f").alias(c), F.col("c").alias(f"c{c}"))
    whole = components(between.join(side("a").hint("merge"), "a").join(side("b").hint("merge"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    return part.join(whole.select(F.col("node").alias("c"), "component"), "c", "left").select("f", F.coalesce("component", "c").alias("component"))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id: the smallest doc_id reachable by links, itself included.

    Equal fingerprints are linked through their one row in the table of distinct fingerprints, so groups of copies are
    never expanded into pairs. Null and empty texts have fingerprint zero, linked like any other. Repeated rows stay.
    A null doc_id counts as larger than any other; a group of such rows alone has component_id null. An empty table
    gives no rows; other columns, one named fingerprint among them, are not read.
    """
    prints = saved(fingerprints(docs), "prints")
    classes = saved(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("least")), "classes")
    member = classes.join(groups(classes.select("f"), distance).hint("merge"), "f")
    tops = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of = member.join(tops, "component").select("f", "component_id")
    return prints.join(of, prints.fingerprint == of.f).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group: one of each group, its smallest doc_id.

    Of rows that repeat that doc_id, that with the smallest text hash stays, of rows that repeat both one. A group
    whose ids are all null keeps one row. Null and empty texts are one group. An empty table stays empty.
    """
    name = "pairloom_row"
    kept = saved(docs.withColumn(name, F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.xxhash64("text").alias("h"))), "rows")
    prints = saved(fingerprints(kept, F.col(name)), "prints")
    classes = saved(prints.groupBy(F.col("fingerprint").alias("f")).agg(F.min(name).alias("least")), "classes")
    member = classes.join(groups(classes.select("f"), distance).hint("merge"), "f")
    best = member.groupBy("component").agg(F.min("least").alias("k")).select(F.col("k.n").alias("kn"), F.coalesce("k.d", F.lit(0)).alias("kd"), F.col("k.h").alias("kh"))
    rows = kept.join(best.hint("merge"), (F.col(f"{name}.n") == F.col("kn")) & (F.coalesce(F.col(f"{name}.d"), F.lit(0)) == F.col("kd")) & (F.col(f"{name}.h") == F.col("kh")), "left_semi")
    # rows that repeat both id and text: one of them
    return rows.dropDuplicates([name]).drop(name)
