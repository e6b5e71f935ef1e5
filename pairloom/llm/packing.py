"""Best-fit packing (operator 4) with conflicts.

Texts become pieces of at most a bin's capacity, and pieces go into bins so that no bin holds two of the same source or
of the same cluster of duplicates. Bins are kept in order of what is free in them, with one bitmap of their sources
and one of their clusters; a piece goes into the fullest bin that has room and shares no bit with it, found by a
successor search from its size on that passes over whole ranges of bins which all conflict. Longer pieces go first.

Bins are packed in cells of about CELL_TOKENS tokens and CELL_PIECES pieces at most, into which a hash of the content
deals the pieces, so that hot sources and large clusters are spread evenly and a task holds one cell, however large
the corpus is. The cells, and so the bins, don't depend on the order or the files of the input.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import column, long_id, map_texts, saved, ship
from pairloom.llm.tokens import encoder, shared_proof

CAPACITY = 2048
CELL_TOKENS = 2_000_000
CELL_PIECES = 16_384
#: Bins of equal room that are passed over or looked through together.
CHUNK = 32
#: Rows that repeat id and text which one row unfolds at a time.
UNFOLD = 10_000


class Bins:
    """Open bins in order of (room, number), each with a bitmap of what it holds.

    Bins of equal room are lists of chunks; a chunk, a room and every node of a binary tree over the rooms know the
    bits that all their bins have in common. Where these meet a piece's bits all bins below conflict with it. What is
    empty has all bits, bit 0 among them, which every piece asks for and no bin has.
    """

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.base)
        self.rooms: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by room: chunks of bin numbers in order
        self.shared: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room: the bits that a chunk's bins have in common
        self.bits: list[int] = []

    def _changed(self, room: int) -> None:
        x = -1
        for y in self.shared[room]:
            x &= y
        k = self.base + room
        common = self.common
        while common[k] != x:
            common[k] = x
            k >>= 1
            if not k:
                break
            x = common[2 * k] & common[2 * k + 1]

    def _and(self, chunk: list[int]) -> int:
        x = -1
        for b in chunk:
            x &= self.bits[b]
        return x

    def add(self, room: int, b: int) -> None:
        chunks, shared = self.rooms[room], self.shared[room]
        i = max(0, bisect_left(chunks, b, key=lambda c: c[0] - 0.5) - 1)
        if not chunks:
            chunks.append([b])
            shared.append(self.bits[b])
        else:
            chunk = chunks[i]
            chunk.insert(bisect_left(chunk, b), b)
            if len(chunk) > 2 * CHUNK:
                chunks[i : i + 1] = [chunk[:CHUNK], chunk[CHUNK:]]
                shared[i : i + 1] = [self._and(chunk[:CHUNK]), self._and(chunk[CHUNK:])]
            else:
                shared[i] &= self.bits[b]
        self._changed(room)

    def take(self, size: int, mask: int) -> tuple[int, int] | None:
        """(room, bin) of the fullest bin with room for `size` and none of the bits of `mask`, taken out; the one of the smallest number of several."""
        common, base, k = self.common, self.base, self.base + size
        bits = self.bits
        while True:
            # up while all bins below conflict, to the next subtree on the right
            while common[k] & mask:
                while k & 1:
                    k >>= 1
                    if not k:
                        return None
                k += 1
                if k & (k - 1) == 0:
                    return None
            # down to its first room
            while k < base:
                k *= 2
                while common[k] & mask and not k & 1:
                    k += 1
                if common[k] & mask:
                    break
            if common[k] & mask:
                continue
            room = k - base
            chunks, shared = self.rooms[room], self.shared[room]
            for i, x in enumerate(shared):
                if not x & mask:
                    for j, b in enumerate(chunks[i]):
                        if not bits[b] & mask:
                            del chunks[i][j]
                            if chunks[i]:
                                shared[i] = self._and(chunks[i])
                            else:
                                del chunks[i], shared[i]
                            self._changed(room)
                            return room, b
            # some bins lack the source, the others the cluster
            while k & 1:
                k >>= 1
                if not k:
                    return None
            k += 1
            if k & (k - 1) == 0:
                return None


def best_fit(pieces: Iterable[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each piece (length, source, cluster), in the order given. None conflicts with nothing.

    A piece as long as a bin opens one of its own that takes no other.
    """
    pieces = list(pieces)
    # only what occurs more than once can conflict; bit 0 is that of empty ranges, sources come next, then clusters
    codes, at = [], 1
    for field in (1, 2):
        seen = Counter(p[field] for p in pieces if p[field] is not None)
        several = sorted((x for x, n in seen.items() if n > 1), key=str)
        codes.append({x: 1 << (at + i) for i, x in enumerate(several)})
        at += len(several)
    bins = Bins(capacity)
    out = []
    for size, source, cluster in pieces:
        own = codes[0].get(source, 0) | codes[1].get(cluster, 0)
        found = bins.take(size, own | 1)
        if found:
            room, b = found
        else:
            room, b = capacity, len(bins.bits)
            bins.bits.append(0)
        bins.bits[b] |= own
        out.append(b)
        if room > size:
            bins.add(room - size, b)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, vocabulary: str | None = None, cell_tokens: int = CELL_TOKENS, cell_pieces: int = CELL_PIECES) -> DataFrame:
    """doc_id, piece, first (token of the text), n_tokens and bin_id: every token of every text is in exactly one piece.

    `cluster` tells duplicates, equal texts without regard to case if not given. Null texts count as empty; an empty
    text is one piece of no tokens, and empty texts are duplicates of each other. A null source, or a null cluster,
    conflicts with nothing. Null ids and repeated rows are kept (rows that repeat a text share a cluster, so never a
    bin). Without a column `source` only clusters conflict. Of pieces of equal length the smaller doc_id goes first,
    nulls last. An empty table gives no pieces. Further columns are not read. A doc_id that is no whole number raises.
    """
    ship(docs.sparkSession)
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(long_id(docs), source.alias("source"), (F.xxhash64(F.lower(text)) if cluster is None else cluster).cast("string").alias("cluster"), F.xxhash64(text).alias("h"), "text")

    whole = shared_proof(docs.sparkSession, vocabulary)

    def cut(batch, texts):
        n = encoder(vocabulary, whole).count(texts)
        keep, piece, size = [], [], []
        for i, k in enumerate(n):
            for j in range(max(1, -(-k // capacity))):
                keep.append(i)
                piece.append(j)
                size.append(min(capacity, k - j * capacity))
        at = pa.array(keep, pa.int64())
        return {c: column(batch, c).take(at) for c in ("doc_id", "source", "cluster", "h")} | {"piece": pa.array(piece, pa.int32()), "n_tokens": pa.array(size, pa.int64())}

    pieces = map_texts(rows, rows.columns, "doc_id bigint, source string, cluster string, h bigint, piece int, n_tokens bigint", cut)
    key = ["doc_id", "source", "cluster", "h", "piece", "n_tokens"]
    # rows that are alike in all are counted, then told apart by their number
    counted = saved(pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")), "pieces")
    total, n = counted.agg(F.sum(F.col("n_tokens") * F.col("copies")), F.sum("copies")).first()
    cells = max(1, math.ceil((total or 0) / cell_tokens), math.ceil((n or 0) / cell_pieces))
    parts = counted.select(*key, "copies", F.explode(F.sequence(F.lit(0), F.floor((F.col("copies") - 1) / UNFOLD))).alias("part"))
    each = parts.select(*key, F.explode(F.sequence(F.col("part") * UNFOLD, F.least(F.col("copies"), (F.col("part") + 1) * UNFOLD) - 1)).alias("copy"))
    dealt = each.withColumn("cell", F.pmod(F.xxhash64(*key, "copy"), F.lit(cells))).repartition("cell")
    placed = dealt.sortWithinPartitions("cell", F.col("n_tokens").desc(), F.col("doc_id").asc_nulls_last(), "piece", "cluster", "source", "h", "copy")

    def bins(cell: int, part: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(part)
        b = best_fit(zip(*(t[c].to_pylist() for c in ("n_tokens", "source", "cluster")), strict=True), capacity)
        cols = {"doc_id": t["doc_id"], "piece": t["piece"], "n_tokens": t["n_tokens"], "bin_id": pa.array([(cell << 24) + x for x in b], pa.int64())}
        return pa.RecordBatch.from_pydict({k: v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for k, v in cols.items()})

    def work(batches):
        cell, part = -1, []
        for b in batches:
            of = column(b, "cell").to_numpy()
            lo = 0
            while lo < len(of):
                hi = int(of.searchsorted(of[lo], side="right"))
                if of[lo] != cell:
                    if part:
                        yield bins(cell, part)
                    cell, part = int(of[lo]), []
                part.append(b.slice(lo, hi - lo))
                lo = hi
        if part:
            yield bins(cell, part)

    out = placed.mapInArrow(work, "doc_id bigint, piece int, n_tokens bigint, bin_id bigint")
    return out.select("doc_id", "piece", (F.col("piece").cast("long") * capacity).alias("first"), "n_tokens", "bin_id")
