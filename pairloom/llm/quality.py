"""Quality classifier (operator 6): hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

Features of a text, all hashed into one weight vector and divided by the number of words: words, word pairs, the
shapes of words (case, digits and marks, runs collapsed) in n-grams up to three, a pair of equal words as one
feature of its own, and word trigrams that the text repeats as another. A score is the logistic function of the
sparse dot product with the weights. Labels, language, source and id take no part in a score.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import labelled
from pairloom.llm.common import column, held, map_texts

#: Labelled documents that a fit reads at most.
SAMPLE = 4000
BITS = 18
CACHE_WORDS = 400_000
FOLDS, HELD_OUT = 3, 1

_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_SHIFT = np.uint64(64 - BITS)
_RUN = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """The word with letters as X or x and digits as 9, runs collapsed."""
    return _RUN.sub(r"\1", "".join("9" if c.isdigit() else ("X" if c.isupper() else "x") if c.isalpha() else c for c in word))


class Words:
    """Hashes of words and of their shapes, each computed once while it is held."""

    def __init__(self, most: int = CACHE_WORDS):
        self.most, self.at = most, {}
        self.word = np.empty(1 << 16, np.uint64)
        self.shape = np.empty(1 << 16, np.uint64)

    def ids(self, lists: list[list[bytes]]) -> np.ndarray:
        seen = set().union(*lists)
        new = seen.difference(self.at)
        if len(self.at) + len(new) > self.most:
            self.at.clear()
            new = seen
        top = len(self.at) + len(new)
        while top > len(self.word):
            self.word, self.shape = (np.concatenate([x, np.empty(len(x), np.uint64)]) for x in (self.word, self.shape))
        for w in new:
            i = self.at[w] = len(self.at)
            u = w.decode("utf-8", "replace")
            self.word[i] = xxhash.xxh64_intdigest(u.lower().encode(), 6)
            self.shape[i] = xxhash.xxh64_intdigest(shape(u).encode(), 7)
        get = self.at.__getitem__
        return np.fromiter((i for ws in lists for i in map(get, ws)), np.int64, sum(map(len, lists)))


def words() -> Words:
    return held("quality", Words)


def features(texts: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each family of n-grams the hashed indices, with the document of each; and the documents' numbers of words."""
    lists = [t.split() for t in texts]
    n = np.array([len(x) for x in lists], np.int64)
    cache = words()
    ids = cache.ids(lists)
    w, s = cache.word[ids], cache.shape[ids]
    doc = np.repeat(np.arange(len(lists)), n)
    same1, same2 = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    with np.errstate(over="ignore"):
        pair = np.where(w[1:] == w[:-1], _K[3], (w[:-1] * _K[0]) ^ (w[1:] * _K[1]))[same1]
        s2 = ((s[:-1] * _K[1]) ^ (s[1:] * _K[2]))[same1]
        s3 = ((s[:-2] * _K[0]) ^ (s[1:-1] * _K[2]) ^ (s[2:] * _K[3]))[same2]
        three = ((w[:-2] * _K[2]) ^ (w[1:-1] * _K[3]) ^ (w[2:] * _K[0]))[same2]
        d2, d3 = doc[1:][same1], doc[2:][same2]
        # trigrams that the document has had already
        key = three ^ (d3.astype(np.uint64) * _K[0])
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        fams = [w * _K[0], pair * _K[1], s * _K[2], s2 * _K[0], s3 * _K[1], np.full(int(again.sum()), _K[2], np.uint64)]
    at = [doc, d2, doc, d2, d3, d3[again]]
    return [(f >> _SHIFT).astype(np.int32) for f in fams], at, n


def logits(texts: list[bytes], weights: np.ndarray, bias: float) -> np.ndarray:
    fams, at, n = features(texts)
    total = np.zeros(len(texts))
    for f, d in zip(fams, at, strict=True):
        total += np.bincount(d, weights[f], len(texts))
    return bias + SCALE * total / np.maximum(n, 1)


#: Multiplies the mean of the weights, so that the learner's steps are of a usual size.
SCALE = 16.0


class Ftrl:
    """FTRL-Proximal (McMahan et al., 2013) for sparse logistic regression; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, g: np.ndarray, w: np.ndarray) -> None:
        root = np.sqrt(self.n[at] + g * g)
        self.z[at] += g - (root - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE, epochs: int = 4) -> tuple[np.ndarray, float]:
    """(weights, bias) from at most `most` labelled documents outside the held-out fold; without any, all zero.

    Rows with a null id or label are left out, null and empty texts have no feature but the bias, of labels that
    repeat an id the smallest counts, of texts that repeat one the smallest. Executors turn texts into sparse
    features, the driver receives only those and passes over them in an order that a hash of doc_id fixes, so equal
    tables give equal weights.
    """
    if "doc_id" not in labels.columns or label not in labels.columns:
        raise ValueError(f"labels need doc_id and {label}")

    def work(batch, texts):
        fams, at, n = features(texts)
        f, d = np.concatenate(fams), np.concatenate(at)
        out_i, out_v = [], []
        order = np.argsort(d, kind="stable")
        for part in np.split(f[order], np.cumsum(np.bincount(d, minlength=len(texts)))[:-1]):
            i, c = np.unique(part, return_counts=True)
            out_i.append(i)
            out_v.append(c)
        return {
            "doc_id": column(batch, "doc_id"),
            "label": column(batch, "label"),
            "i": pa.array(out_i, pa.list_(pa.int32())),
            "v": pa.array([SCALE * v / max(1, k) for v, k in zip(out_v, n, strict=True)], pa.list_(pa.float32())),
        }

    rows = map_texts(labelled.sample(docs, labels, label, FOLDS, HELD_OUT, most), ["doc_id", "label", "text"], "doc_id bigint, label int, i array<int>, v array<float>", work)
    t = rows.toArrow()
    if not t.num_rows:
        return np.zeros(1 << BITS), 0.0
    ids, y = t["doc_id"].to_numpy(), t["label"].to_numpy()
    order = sorted(range(t.num_rows), key=lambda k: xxhash.xxh64_intdigest(str(ids[k])))
    i, v = t["i"].combine_chunks(), t["v"].combine_chunks()
    off, flat_i, flat_v = i.offsets.to_numpy(), i.values.to_numpy(), v.values.to_numpy().astype(float)
    model, bias = Ftrl((1 << BITS) + 1), np.array([1 << BITS])
    for _ in range(epochs):
        for k in order:
            at = np.concatenate([flat_i[off[k] : off[k + 1]], bias])
            x = np.concatenate([flat_v[off[k] : off[k + 1]], [1.0]])
            w = model.weights(at)
            model.update(at, (sigmoid(w @ x) - y[k]) * x, w)
    w = model.weights()
    return w[:-1], float(w[-1])


def score(docs: DataFrame, model: tuple[np.ndarray, float], cut: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted for whole texts. No shuffle; one row per input row.

    Null and empty texts score as the bias alone. A null id has held_out null. Repeated rows score alike; an empty
    table gives no rows; other columns are not read.
    """
    weights, bias = docs.sparkSession.sparkContext.broadcast(np.asarray(model[0], np.float32)), model[1]

    def work(batch, texts):
        p = sigmoid(logits(texts, weights.value, bias))
        return {"doc_id": column(batch, "doc_id"), "held_out": column(batch, "held_out"), "score": pa.array(p), "predicted": pa.array((p >= cut).astype(np.int32))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, ["doc_id", "text", (labelled.crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out")], f"doc_id {kind}, held_out boolean, score double, predicted int", work)


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float], cut: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, that score at least `cut`; null ids and repeated rows as any, null and empty texts by the bias alone."""
    weights, bias = docs.sparkSession.sparkContext.broadcast(np.asarray(model[0], np.float32)), model[1]

    def work(batch, texts):
        return batch.filter(pa.array(sigmoid(logits(texts, weights.value, bias)) >= cut))

    return map_texts(docs, [F.col(f"`{c}`") for c in docs.columns], docs.schema, work)
