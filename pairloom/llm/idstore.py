"""Token-id output (operator 7): raw id shards with a minimal perfect hash index for keyed access.

Files in one folder, all integers little-endian:

    ids-NNNNNN.bin   magic "PLID0001", uint32 bytes per id, then the ids of the shard's documents, nothing between them
    idx-NNNNNN.mph   magic "PLMP0002", uint32 levels, uint64 keys, per level uint64 slots; then the levels' bitmaps in
                     blocks of 512 bits, each a uint64 (set bits before it, in all levels) and 64 bytes; then for each
                     hash slot one record: uint32 fingerprint, uint32 shard, uint64 first id in shard, uint64 ids,
                     uint64 ids before the document in the whole corpus

A document's key is its id and an ordinal among the rows that repeat the id (0, 1, ...); rows without an id have the
key (0, -1), (0, -2), ... Its index file follows from a hash of the key, its slot in it from the perfect hash, and the
record tells where its ids lie. One lookup reads the head of one file, one block for each level that it passes, one
record and the ids: no more, however many documents there are. Shards hold ascending document ids, those without id
first, and are cut at quantiles of them; an id with more rows than a shard takes is dealt over several by a hash of the
texts. Every file is written under a name of the task attempt and renamed when it is complete, so that a repeated task
replaces it with the same bytes.
"""

from __future__ import annotations

import math
import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import column, long_id, map_texts, saved, scratch, ship
from pairloom.llm.tokens import encoder, shared_proof

IDS_MAGIC, MPH_MAGIC = b"PLID0001", b"PLMP0002"
RECORD = np.dtype([("print", "<u4"), ("shard", "<u4"), ("first", "<u8"), ("n", "<u8"), ("start", "<u8")])
#: 512 bits of a level, with the number of set bits before them.
BLOCK = np.dtype([("rank", "<u8"), ("bits", "u1", 64)])
END_ID = 2
#: Documents that a shard, and an index file, hold on average.
DOCS_PER_SHARD = 8_192
MOST_SHARDS = 65_536
DOCS_PER_INDEX = 131_072
GAMMA = 2.0


# files


class Store:
    """Files below a folder: file: paths with the standard library, others with pyarrow's file systems."""

    def __init__(self, at: str):
        u = urlparse(at)
        self.local = u.scheme in ("", "file")
        if self.local:
            self.root = u.path or at
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(at)

    def write(self, name: str, parts: Iterator[bytes]) -> None:
        """Write under a name of this attempt, then rename."""
        to, tmp = f"{self.root}/{name}", f"{self.root}/.{name}.{uuid.uuid4().hex}"
        with open(tmp, "wb") if self.local else self.fs.open_output_stream(tmp) as f:
            for p in parts:
                f.write(p)
        os.replace(tmp, to) if self.local else self.fs.move(tmp, to)

    def open(self, name: str):
        return open(f"{self.root}/{name}", "rb") if self.local else self.fs.open_input_file(f"{self.root}/{name}")


# minimal perfect hash


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of 64-bit keys (the finaliser of SplitMix64)."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix2(keys: np.ndarray, ordinals: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of pairs of 64-bit numbers. Pairs that meet under one seed don't under the next."""
    return mix((mix(keys, seed) ^ mix(ordinals, seed + 5000)).view(np.int64), seed + 1)


def fingerprint(keys: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    return (mix2(keys, ordinals, 1000) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Maps n distinct keys (64-bit number, 64-bit ordinal) onto 0..n-1, in levels of bitmaps: a key settles on the first level where it is alone in its slot."""

    def __init__(self, levels: list[tuple[int, np.ndarray]], n: int):
        self.levels, self.n = levels, n

    @classmethod
    def build(cls, keys: np.ndarray, ordinals: np.ndarray | None = None) -> PerfectHash:
        """Repeated keys raise."""
        left = np.asarray(keys, np.int64)
        more = np.zeros(len(left), np.int64) if ordinals is None else np.asarray(ordinals, np.int64)
        order = np.lexsort((more, left))
        if ((left[order][1:] == left[order][:-1]) & (more[order][1:] == more[order][:-1])).any():
            raise ValueError("keys must be distinct")
        n, levels, before = len(left), [], 0
        while len(left):
            m = max(64, math.ceil(len(left) * GAMMA))
            at = (mix2(left, more, len(levels)) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            blocks = np.zeros(-(-m // 512), BLOCK)
            bits = np.packbits(alone, bitorder="little")
            blocks["bits"] = np.pad(bits, (0, len(blocks) * 64 - len(bits))).reshape(-1, 64)
            counts = np.bitwise_count(blocks["bits"]).sum(1, dtype=np.uint64)
            blocks["rank"] = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            levels.append((m, blocks))
            keep = ~alone[at]
            left, more = left[keep], more[keep]
        return cls(levels, n)

    def slots(self, keys: np.ndarray, ordinals: np.ndarray | None = None) -> np.ndarray:
        """The slot of each key; a foreign key gets some slot or -1."""
        keys = np.asarray(keys, np.int64)
        ordinals = np.zeros(len(keys), np.int64) if ordinals is None else np.asarray(ordinals, np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, blocks) in enumerate(self.levels):
            if not len(open_):
                break
            at = (mix2(keys[open_], ordinals[open_], level) % np.uint64(m)).astype(np.int64)
            found = ranks(blocks[at >> 9], at & 511)
            out[open_[found >= 0]] = found[found >= 0]
            open_ = open_[found < 0]
        return out

    def dump(self) -> Iterator[bytes]:
        yield MPH_MAGIC + struct.pack(f"<IQ{len(self.levels)}Q", len(self.levels), self.n, *(m for m, _ in self.levels))
        for _, blocks in self.levels:
            yield blocks.tobytes()

    @staticmethod
    def head(f) -> tuple[int, list[int]]:
        """(number of keys, slots of each level) from the beginning of a file."""
        if f.read(8) != MPH_MAGIC:
            raise ValueError("not an index file")
        count, n = struct.unpack("<IQ", f.read(12))
        return n, list(struct.unpack(f"<{count}Q", f.read(8 * count)))

    @classmethod
    def load(cls, f) -> PerfectHash:
        n, sizes = cls.head(f)
        return cls([(m, np.frombuffer(f.read(-(-m // 512) * BLOCK.itemsize), BLOCK)) for m in sizes], n)


def ranks(blocks: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """For each block and bit (0 to 511) the number of set bits before it in the whole bitmap, -1 where it is not set."""
    byte, low = bit >> 3, (bit & 7).astype(np.uint16)
    row = np.arange(len(blocks))
    bits = blocks["bits"]
    here = bits[row, byte]
    upto = np.where(np.arange(64)[None, :] < byte[:, None], bits, 0)
    n = np.bitwise_count(upto).sum(1, dtype=np.int64) + np.bitwise_count(here & ((np.uint16(1) << low) - 1).astype(np.uint8))
    return np.where((here >> low) & 1 == 1, blocks["rank"].astype(np.int64) + n, -1)


class Index:
    """One index file in memory: records of documents by key."""

    def __init__(self, store: Store, name: str):
        with store.open(name) as f:
            self.hash = PerfectHash.load(f)
            self.records = np.frombuffer(f.read(self.hash.n * RECORD.itemsize), RECORD)

    def find(self, keys: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, records): a key counts as found if the stored fingerprint is its own."""
        slot = self.hash.slots(keys, ordinals)
        found = slot >= 0
        records = self.records[np.where(found, slot, 0)] if self.hash.n else np.zeros(len(slot), RECORD)
        return found & (records["print"] == fingerprint(keys, ordinals)), records


def index_of(keys: np.ndarray, ordinals: np.ndarray, files: int) -> np.ndarray:
    return (mix2(np.asarray(keys, np.int64), np.asarray(ordinals, np.int64), 2000) % np.uint64(max(1, files))).astype(np.int64)


def read_ids(store: Store, shard: int, first: int, n: int) -> np.ndarray:
    """n ids of a shard from the first on."""
    with store.open(f"ids-{shard:06d}.bin") as f:
        if f.read(8) != IDS_MAGIC:
            raise ValueError("not an id shard")
        (w,) = struct.unpack("<I", f.read(4))
        f.seek(12 + first * w)
        return np.frombuffer(f.read(n * w), f"<u{w}")


class IdFolder:
    """Keyed access to a written folder."""

    def __init__(self, at: str, index_files: int):
        self.store, self.index_files = Store(at), index_files

    def find(self, doc_id: int | None, ordinal: int = 0) -> np.void | None:
        """The record of a document, or None if it isn't there. Reads a head, a block for each level passed and one record."""
        key, more = (np.array([x], np.int64) for x in ((0, -1 - ordinal) if doc_id is None else (doc_id, ordinal)))
        with self.store.open(f"idx-{int(index_of(key, more, self.index_files)[0]):06d}.mph") as f:
            n, sizes = PerfectHash.head(f)
            base, slot = f.tell(), -1
            for level, m in enumerate(sizes):
                if slot < 0:
                    at = int(mix2(key, more, level)[0] % np.uint64(m))
                    f.seek(base + (at >> 9) * BLOCK.itemsize)
                    slot = int(ranks(np.frombuffer(f.read(BLOCK.itemsize), BLOCK), np.array([at & 511]))[0])
                base += -(-m // 512) * BLOCK.itemsize
            if slot < 0:
                return None
            f.seek(base + slot * RECORD.itemsize)
            r = np.frombuffer(f.read(RECORD.itemsize), RECORD)[0]
        return r if r["print"] == fingerprint(key, more)[0] else None

    def get(self, doc_id: int | None, ordinal: int = 0) -> np.ndarray | None:
        """The ids of a document, or None if it isn't there: of the rows that repeat the id (or have none) that with this ordinal."""
        r = self.find(doc_id, ordinal)
        return None if r is None else read_ids(self.store, int(r["shard"]), int(r["first"]), int(r["n"]))


# writing


def write_ids(docs: DataFrame, at: str, vocabulary: str | None = None, end_id: int = END_ID) -> tuple[DataFrame, int]:
    """Encode whole texts and write shards and index; returns (table of doc_id, ordinal, shard, first, n, start) and the number of index files.

    Null and empty texts have only the end id. Rows are in the order of doc_id, those without one first; rows that
    repeat a doc_id, or have none, follow the hash of their text, equal texts each other, and are numbered in this
    order from 0. An empty table writes an index without keys. A doc_id that is no whole number raises; other columns are not read.
    """
    spark = docs.sparkSession
    ship(spark)
    ids = docs.select(long_id(docs), "text")
    total, known = ids.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    shards = min(MOST_SHARDS, max(1, math.ceil(known / DOCS_PER_SHARD)))
    without = min(MOST_SHARDS, math.ceil((total - known) / DOCS_PER_SHARD))  # shards of rows without id, before the others
    # quantiles of a narrow column, so that neither texts nor ids are read twice for the bounds
    at_ranks = [i / shards for i in range(1, shards)]
    cuts = np.array(sorted(ids.agg(F.percentile_approx("doc_id", at_ranks, 10 * shards)).first()[0] or []) if at_ranks else [], np.int64)

    whole = shared_proof(spark, vocabulary)

    def work(batch, texts):
        enc = encoder(vocabulary, whole)
        end = np.array([end_id], enc.dtype).tobytes()
        raw = [x + end for x in enc.encode(texts)]
        d = column(batch, "doc_id")
        h = np.fromiter((xxhash.xxh64_intdigest(t) >> 1 for t in texts), np.int64, len(texts))
        null = d.is_null().to_numpy(zero_copy_only=False)
        key = d.fill_null(0).to_numpy()
        # a cut that stands there more than once is an id with more rows than a shard takes
        lo, hi = (np.searchsorted(cuts, key, side=x) for x in ("left", "right"))
        lo, n = np.where(null, 0, without + lo), np.where(null, without, np.where(hi - lo > 1, hi - lo + 1, 1))
        shard = lo + np.minimum((h / 2.0**63 * n).astype(np.int64), np.maximum(n, 1) - 1)
        return {"doc_id": d, "h": pa.array(h), "shard": pa.array(shard.astype(np.int32)), "w": pa.array([enc.dtype.itemsize] * len(raw), pa.int32()), "ids": pa.array(raw, pa.binary())}

    coded = map_texts(ids, ["doc_id", "text"], "doc_id bigint, h bigint, shard int, w int, ids binary", work)
    placed = coded.repartitionById(shards + without, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "h", "ids").select("doc_id", "shard", "w", "ids")

    def write(batches):
        """One file for each shard of the partition; its rows arrive in order."""
        store = Store(at)
        rows = (
            (s, d, w, x)
            for b in batches
            for s, d, w, x in zip(b.column(1).to_pylist(), b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True)
        )
        row = next(rows, None)
        while row is not None:
            shard, width = row[0], row[2]
            out: list[tuple] = []

            def payload():
                nonlocal row
                yield IDS_MAGIC + struct.pack("<I", width)
                first = ordinal = 0
                before = row[1]
                while row is not None and row[0] == shard:
                    x = row[3].as_buffer()
                    if row[1] != before:
                        before, ordinal = row[1], 0
                    out.append((row[1], ordinal, first, n := x.size // width))
                    first, ordinal = first + n, ordinal + 1
                    yield x
                    row = next(rows, None)

            store.write(f"ids-{shard:06d}.bin", payload())
            for k in range(0, len(out), 65_536):
                d, o, f, n = zip(*out[k : k + 65_536], strict=True)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(d, pa.int64()), "ordinal": pa.array(o, pa.int64()), "shard": pa.array([shard] * len(d), pa.int32()), "first": pa.array(f, pa.int64()), "n": pa.array(n, pa.int64())})

    entries = saved(placed.mapInArrow(write, "doc_id bigint, ordinal bigint, shard int, first bigint, n bigint"), "entries")
    # one row for each shard: where its first id stands in the corpus, and how many rows of its first id the shards before it hold
    ends = entries.groupBy("shard").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"), F.min(F.struct("first", "doc_id"))["doc_id"].alias("a"), F.max(F.struct("first", "doc_id", "ordinal")).alias("z"))
    base, ids_before, of, carried = [], 0, (), 0
    for s, n, rows, a, z in ends.orderBy("shard").collect():
        carried = carried if of == (a,) else 0
        base.append((s, ids_before, a, carried))
        ids_before += n
        carried = z["ordinal"] + 1 + (carried if z["ordinal"] + 1 == rows else 0)
        of = (z["doc_id"],)
    table = spark.createDataFrame(base, "shard int, base long, a long, carried long")
    entries = entries.join(F.broadcast(table), "shard").select(
        "doc_id", (F.col("ordinal") + F.when(F.col("doc_id").eqNullSafe(F.col("a")), F.col("carried")).otherwise(0)).alias("ordinal"), "shard", "first", "n", (F.col("base") + F.col("first")).alias("start")
    )
    files = max(1, math.ceil(total / DOCS_PER_INDEX))

    def index(batches):
        """One file after the other; the entries of one are held at a time."""
        store, file, part = Store(at), -1, []

        def put():
            rows = pa.Table.from_batches(part).drop_null()
            keys, more = rows.column("key").to_numpy(), rows.column("more").to_numpy()
            ph = PerfectHash.build(keys, more)
            records = np.zeros(len(keys), RECORD)
            slot = ph.slots(keys, more)
            records["print"][slot] = fingerprint(keys, more)
            for name in ("shard", "first", "n", "start"):
                records[name][slot] = rows.column(name).to_numpy()
            store.write(f"idx-{file:06d}.mph", iter([*ph.dump(), records.tobytes()]))
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "keys": pa.array([len(keys)], pa.int64())})

        for b in batches:
            of = column(b, "file").to_numpy()
            for lo, hi in runs(of):
                if of[lo] != file:
                    if part:
                        yield put()
                    file, part = int(of[lo]), []
                part.append(b.slice(lo, hi - lo))
        if part:
            yield put()

    # a row without key for each file, so that files without keys are written too and a missing file is an error
    every = spark.range(files).select(F.col("id").cast("int").alias("file"))
    filed = _filed(entries, files).drop("doc_id", "ordinal").unionByName(every, allowMissingColumns=True)
    filed.repartition(min(files, 4096), "file").sortWithinPartitions("file").mapInArrow(index, "file int, keys bigint").agg(F.sum("keys")).collect()
    return entries, files


# reading


def _filed(keys: DataFrame, files: int) -> DataFrame:
    """keys(doc_id, ordinal, ...) with the two numbers of their keys and the file of the index that has them."""

    def file_of(batches):
        for b in batches:
            more = [pa.array(index_of(column(b, "key").to_numpy(), column(b, "more").to_numpy(), files).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "file"])

    null = F.col("doc_id").isNull()
    rows = keys.select("*", F.coalesce("doc_id", F.lit(0)).alias("key"), F.when(null, -1 - F.col("ordinal")).otherwise(F.col("ordinal")).alias("more"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(file_of, f"{kinds}, file int")


def read_back(keys: DataFrame, at: str, files: int) -> DataFrame:
    """Look every key up in the index files, read its ids from the shards: doc_id, start, n_tokens, ids_crc32.

    `keys` has doc_id and, for rows that repeat an id or have none, their ordinal; without that column the first row
    of an id is meant. Keys that the folder doesn't hold give no row.
    """
    ship(keys.sparkSession)

    def find(batches):
        store = Store(at)
        at_file, index = -1, None
        for b in batches:
            d, key, more, file = (column(b, c) for c in ("doc_id", "key", "more", "file"))
            key, more, file = key.to_numpy(), more.to_numpy(), file.to_numpy()
            for lo, hi in runs(file):
                if file[lo] != at_file:
                    at_file, index = int(file[lo]), Index(store, f"idx-{int(file[lo]):06d}.mph")
                ok, r = index.find(key[lo:hi], more[lo:hi])
                yield pa.RecordBatch.from_pydict({"doc_id": d.slice(lo, hi - lo).filter(pa.array(ok))} | {c: pa.array(r[c][ok].astype(np.int64)) for c in ("shard", "first", "n", "start")})

    def fetch(batches):
        store, shard, f, w = Store(at), -1, None, 0
        for b in batches:
            s, first, n, start = (c.to_numpy() for c in b.columns[1:])
            crc = np.empty(len(s), np.int64)
            for i in range(len(s)):
                if s[i] != shard:
                    if f:
                        f.close()
                    shard, f = int(s[i]), store.open(f"ids-{int(s[i]):06d}.bin")
                    if f.read(8) != IDS_MAGIC:
                        raise ValueError("not an id shard")
                    (w,) = struct.unpack("<I", f.read(4))
                f.seek(12 + int(first[i]) * w)
                crc[i] = zlib.crc32(np.frombuffer(f.read(int(n[i]) * w), f"<u{w}").astype("<u4").tobytes())
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "start": pa.array(start), "n_tokens": pa.array(n), "ids_crc32": pa.array(crc)})
        if f:
            f.close()

    wanted = _filed(keys.select(long_id(keys), F.col("ordinal").cast("long").alias("ordinal") if "ordinal" in keys.columns else F.lit(0).cast("long").alias("ordinal")), files)
    places = wanted.repartition("file").sortWithinPartitions("file").mapInArrow(find, "doc_id bigint, shard bigint, first bigint, n bigint, start bigint")
    return places.repartition("shard").sortWithinPartitions("shard", "first").mapInArrow(fetch, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def runs(x: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(x):
        return []
    cut = [0, *(np.flatnonzero(x[1:] != x[:-1]) + 1).tolist(), len(x)]
    return list(zip(cut[:-1], cut[1:], strict=True))


def encode_store_read(spark: SparkSession, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the ids of `docs` to a folder in the shared folder and read every document back by its key: one row per row of docs."""
    at = scratch(spark, "ids")
    keys, files = write_ids(docs, at, vocabulary)
    return read_back(keys.select("doc_id", "ordinal"), at, files)
