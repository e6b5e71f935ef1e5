"""Embedding near-duplicates (operator 5): cross-polytope hashing after fast Hadamard rotations.

Each table turns a unit vector K times by three rounds of random signs and a fast Hadamard transform; the nearest
signed axis of each turn is a hash. A vector is stored under its K hashes, and looked up under these and, in order of
how much nearer another axis would have to be, under the next best combinations (multiprobe). Pairs that meet are
verified by their cosine in double precision.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import saved, ship
from pairloom.llm.components import components

COSINE = 0.93
TABLES = 12
TURNS = 3
PROBES = 8
#: Axes of a turn that probes choose among.
CHOICES = 4
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The normalised Walsh-Hadamard transform of the rows; their length is a power of two."""
    rows, n = x.shape
    h = 1
    while h < n:
        y = x.reshape(rows, n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(rows, n)
        h *= 2
    return x / np.sqrt(n)


@lru_cache(maxsize=8)
def signs(n: int, tables: int, turns: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, n]).choice([-1.0, 1.0], (tables, turns, 3, n))


def probes(unit: np.ndarray, tables: int = TABLES, turns: int = TURNS, count: int = PROBES, seed: int = SEED) -> np.ndarray:
    """(rows, tables, count): codes under which to look each unit vector up, the one it is stored under first."""
    dim = unit.shape[1]
    n = max(2, 1 << (dim - 1).bit_length())
    x = np.zeros((len(unit), n))
    x[:, :dim] = unit
    choices = min(CHOICES, n)
    combos = np.array(list(itertools.product(range(choices), repeat=turns)))
    out = np.empty((len(unit), tables, min(count, len(combos))), np.int64)
    for t, turn in enumerate(signs(n, tables, turns, seed)):
        cost, code = np.zeros((len(x), len(combos))), np.zeros((len(x), len(combos)), np.int64)
        for j, flips in enumerate(turn):
            y = x
            for f in flips:
                y = hadamard(y * f)
            size = np.abs(y)
            top = np.argpartition(-size, choices - 1, axis=1)[:, :choices] if choices < n else np.tile(np.arange(n), (len(x), 1))
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(size, top, 1), axis=1, kind="stable"), 1)
            v = np.take_along_axis(size, top, 1)
            axis = top * 2 + (np.take_along_axis(y, top, 1) > 0)
            cost += ((v[:, :1] - v) ** 2)[:, combos[:, j]]
            code = code * (2 * n) + axis[:, combos[:, j]]
        out[:, t] = np.take_along_axis(code, np.argsort(cost, axis=1, kind="stable")[:, : out.shape[2]], 1)
    return out


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows with the two hashes of label and vector, and one row for each distinct vector that can link."""
    v = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(F.when(fine, F.exists(v, lambda x: x != 0)), F.lit(False))
    rows = saved(
        vectors.select("vec_id", "label", "embedding").select(
            "vec_id", F.when(valid, F.xxhash64("label", "embedding")).alias("h1"), F.when(valid, F.xxhash64(F.lit(1), "label", "embedding")).alias("h2"), F.when(valid, F.col("label")).alias("label"), F.when(valid, v).alias("embedding")
        ),
        "vectors",
    )
    classes = (
        rows.where("h1 is not null")
        .groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    return rows.select("vec_id", "h1", "h2"), saved(classes, "classes")


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(flat values as doubles, lengths) of a list column, each vector divided by its largest component so that no square overflows or vanishes."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False).astype(float), np.diff(column.offsets.to_numpy())
    return (flat / np.repeat(np.maximum.reduceat(np.abs(flat), np.cumsum(n) - n), n) if len(flat) else flat), n


def links(classes: DataFrame, cosine: float = COSINE, tables: int = TABLES, turns: int = TURNS, count: int = PROBES) -> DataFrame:
    """(a, b), a < b: the pairs of classes with equal labels whose cosine reaches `cosine`, of those that meet in a bucket."""
    ship(classes.sparkSession)

    def code(batches):
        for b in batches:
            flat, dims = _matrix(b.column(1))
            ends = np.concatenate([[0], np.cumsum(dims)])
            for dim in np.unique(dims).tolist():
                for rows in np.array_split(at := np.flatnonzero(dims == dim), max(1, len(at) // 2048)):
                    x = flat[(ends[rows][:, None] + np.arange(dim)).ravel()].reshape(len(rows), dim)
                    found = probes(x / np.linalg.norm(x, axis=1, keepdims=True), tables, turns, count)
                    p = found.shape[2]
                    keep = pa.array(np.repeat(rows, tables * p))
                    yield pa.RecordBatch.from_pydict({
                        "cid": b.column(0).take(keep),
                        "label": b.column(2).take(keep),
                        "bucket": pa.array(found.ravel()),
                        "tab": pa.array(np.tile(np.repeat(np.arange(tables), p), len(rows)).astype(np.int32)),
                        "dim": pa.array(np.full(len(keep), dim, np.int32)),
                        "probe": pa.array(np.tile(np.arange(p), len(rows) * tables).astype(np.int32)),
                    })

    kind = classes.schema["label"].dataType.simpleString()
    codes = classes.select("cid", "embedding", "label").mapInArrow(code, f"cid bigint, label {kind}, bucket bigint, tab int, dim int, probe int")
    # a bucket is known by a hash of all that defines it; what meets by chance is verified away with the rest
    keyed = saved(codes.select("cid", F.xxhash64("label", "dim", "tab", "bucket").alias("key"), "probe"), "codes")
    stored = keyed.where("probe = 0").select(F.col("cid").alias("x"), "key")
    pairs = stored.join(keyed, "key").where("x <> cid").select(F.least("x", "cid").alias("a"), F.greatest("x", "cid").alias("b")).distinct()
    side = lambda c: classes.select(F.col("cid").alias(c), F.col("label").alias(f"l{c}"), F.col("embedding").alias(f"v{c}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b").where((F.col("la") == F.col("lb")) & (F.size("va") == F.size("vb"))).select("a", "b", "va", "vb")

    def check(batches):
        for b in batches:
            x, dims = _matrix(b.column(2))
            y, _ = _matrix(b.column(3))
            if not len(dims):
                continue
            at = np.concatenate([[0], np.cumsum(dims)])[:-1]
            dot, nx, ny = (np.add.reduceat(z, at) for z in (x * y, x * x, y * y))
            near = pa.array(dot / (np.sqrt(nx) * np.sqrt(ny)) >= cosine)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    return full.mapInArrow(check, "a bigint, b bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable, itself included), kept: one row per input row.

    Equal vectors of a label are one class, counted with its copies and never expanded into pairs. Rows whose id, label
    or vector is null, or whose vector is empty, zero or has null or non-finite components, link with nothing and are
    a component of their own (kept; where the id is null, component_id and kept are null). Rows that repeat an id
    count as vectors of their own. Vectors of different lengths don't link. An empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    rows, classes = classes_of(vectors)
    pairs = saved(links(classes, cosine), "links")
    ends = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = ends.join(classes.select(F.col("cid").alias("b"), "copies"), "b").groupBy("a").agg(F.sum("copies").alias("n"))
    groups = components(pairs)
    member = (
        classes.select("cid", "h1", "h2", "least", "copies")
        .join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left")
        .withColumn("component", F.coalesce("component", "cid"))
        .join(others.withColumnRenamed("a", "cid"), "cid", "left")
    )
    member = saved(member, "member")
    tops = member.groupBy("component").agg(F.min("least").alias("component_id"))
    of = member.join(tops, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    alone = rows.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.where("h1 is not null").join(of, ["h1", "h2"]).select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


ORACLE = """
with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and label is not null and embedding is not null),
u as (select vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) as n from v),
w as (select * from u where n > 0 and isfinite(n) and len(list_filter(e, lambda x: x is null)) = 0),
links as (select a.vec_id as a, b.vec_id as b from w a join w b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach as (select a as x, a as y from links union select r.x, l.b from reach r join links l on r.y = l.a),
c as (select x, min(y) as m from reach group by x),
d as (select a, count(*) as k from links group by a)
select vec_id, coalesce(k, 0)::bigint as n_links, coalesce(least(m, vec_id), vec_id) as component_id, vec_id = coalesce(least(m, vec_id), vec_id) as kept
from embeddings left join c on vec_id = c.x left join d on vec_id = d.a
"""
