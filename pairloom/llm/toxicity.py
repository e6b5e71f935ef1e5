"""Toxicity (operator 9): multiple-instance learning over sentences.

A sentence's logit is a bias plus the weights of its distinct hashed words (and, if the settings say so, of their
prefixes); a document is toxic unless all its sentences are clean, so its score is the noisy-or of theirs. Only
document labels are known; the gradient of the noisy-or shares a document's label out among its sentences. Sentences
end at . ! ? or a line break.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm import labelled
from pairloom.llm.common import column, held, map_texts
from pairloom.llm.quality import Ftrl, sigmoid

#: Labelled documents that a fit reads at most.
SAMPLE = 4000
BITS = 18
CACHE_WORDS = 400_000
FOLDS, HELD_OUT = 4, 2
#: The logit of a sentence without known words, before training.
PRIOR = -7.0
NONE = 1 << BITS

_MARKS = ".,;:!?\"'()[]{}<>|*#$%&-_=+/\\~`^@"
_ENDS = (b".", b"!", b"?", b'."', b'!"', b'?"', b".)", b"!)", b"?)")
#: The words that `_tokens` gives, and line breaks.
_TOKEN = re.compile(rb"\n|[^\x00\x09-\x0D\x20]+")


class Settings(NamedTuple):
    """What choose_toxicity chooses among: lengths of prefixes of words that are features besides the words, and the learner's."""

    prefixes: tuple[int, ...] = ()
    alpha: float = 1.0
    l1: float = 1.0
    l2: float = 0.0
    epochs: int = 5


#: The choice of `python -m pairloom.llm.choose_toxicity`, which reads learnable rows only.
CHOSEN = Settings(prefixes=(4, 5, 6))


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    prefixes: tuple[int, ...]


class Words:
    """For each word held its hashed indices (the word and its prefixes; NONE where there is none) and whether a sentence ends with it."""

    def __init__(self, prefixes: tuple[int, ...] = (), most: int = CACHE_WORDS):
        self.prefixes, self.most, self.at = prefixes, most, {}
        self.index = np.empty((1 << 16, 1 + len(prefixes)), np.int32)
        self.ends = np.empty(1 << 16, bool)

    def ids(self, lists: list[list[bytes]]) -> np.ndarray:
        seen = set().union(*lists)
        new = seen.difference(self.at)
        if len(self.at) + len(new) > self.most:
            self.at.clear()
            new = seen
        while len(self.at) + len(new) > len(self.ends):
            self.index, self.ends = (np.concatenate([x, np.empty_like(x)]) for x in (self.index, self.ends))
        for w in new:
            i = self.at[w] = len(self.at)
            bare = w.decode("utf-8", "replace").strip(_MARKS).lower()
            self.index[i] = [xxhash.xxh64_intdigest(x.encode(), 9) >> (64 - BITS) if x else NONE for x in (bare, *(f"{bare[:k]}*" if len(bare) >= k else "" for k in self.prefixes))]
            self.ends[i] = w == b"\x00" or w.endswith(_ENDS)
        get = self.at.__getitem__
        return np.fromiter((i for ws in lists for i in map(get, ws)), np.int64, sum(map(len, lists)))


def words(prefixes: tuple[int, ...]) -> Words:
    return held(("toxicity", prefixes), lambda: Words(prefixes))


def _tokens(text: bytes) -> list[bytes]:
    """Words and, as a zero byte, line breaks: the same as _TOKEN finds one by one."""
    return text.replace(b"\x00", b" ").replace(b"\n", b" \x00 ").split()


def sentences(texts: list[bytes], prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, sentence) of each token of all texts, and the document of each sentence. The one splitter of training, scoring and locating."""
    lists = [_tokens(t) for t in texts]
    cache = words(prefixes)
    ids = cache.ids(lists)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    new = np.ones(len(ids), bool)
    new[1:] = cache.ends[ids[:-1]] | (doc[1:] != doc[:-1])
    return ids, np.cumsum(new) - 1, doc[new]


def instances(ids: np.ndarray, sentence: np.ndarray, prefixes: tuple[int, ...], weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(word, sentence) of each distinct word of each sentence, only of words that have a weight if weights are given."""
    cache = words(prefixes)
    known = cache.index[: len(cache.at)]
    real = known[:, 0] != NONE if weights is None else (weights[known] != 0).any(1)
    real = real[ids]
    key = np.unique(sentence[real] << 32 | ids[real])
    return key & 0xFFFFFFFF, key >> 32


def noisy_or(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document scores, sentence scores, the document of each sentence and the sentence of each token. Only sentences that hold a known word count."""
    ids, of_token, of = sentences(texts, model.prefixes)
    word, sentence = instances(ids, of_token, model.prefixes, model.weights)
    a = np.full(len(of), model.bias) + np.bincount(sentence, model.weights[words(model.prefixes).index[word]].sum(1), len(of))
    p = np.where(np.bincount(sentence, minlength=len(of)) > 0, sigmoid(a), 0.0)
    clean = np.bincount(of, np.log1p(-np.minimum(p, 1 - 1e-12)), len(texts))
    return -np.expm1(clean), p, of, of_token


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = SAMPLE, settings: Settings = CHOSEN) -> Model:
    """A model from at most `most` labelled documents outside the held-out fold; without any, no word is known.

    Rows with a null id or label are left out, null texts have no sentence, of labels that repeat an id the smallest
    counts, of texts that repeat one the smallest. Executors turn texts into sentences of indices, the driver receives
    only those and passes over them in an order that a hash of doc_id fixes, so equal tables give equal models.
    """
    prefixes = settings.prefixes

    def work(batch, texts):
        ids, of_token, of = sentences(texts, prefixes)
        word, sentence = instances(ids, of_token, prefixes)
        index = words(prefixes).index[word]
        real = index != NONE
        index, sentence = index[real], np.broadcast_to(sentence[:, None], real.shape)[real]
        d = of[sentence]
        first = np.searchsorted(of, np.arange(len(texts)))
        cut_w = np.searchsorted(d, np.arange(1, len(texts)))
        return {
            "doc_id": column(batch, "doc_id"),
            "label": column(batch, "label"),
            "i": pa.array([x.astype(np.int32) for x in np.split(index, cut_w)], pa.list_(pa.int32())),
            "s": pa.array([x.astype(np.int32) for x in np.split(sentence - first[d], cut_w)], pa.list_(pa.int32())),
        }

    rows = map_texts(labelled.sample(docs, labels, label, FOLDS, HELD_OUT, most), ["doc_id", "label", "text"], "doc_id bigint, label int, i array<int>, s array<int>", work)
    t = rows.toArrow()
    if not t.num_rows:
        return Model(np.zeros((1 << BITS) + 1), PRIOR, prefixes)
    ids, y = t["doc_id"].to_numpy(), t["label"].to_numpy()
    order = sorted(range(t.num_rows), key=lambda k: xxhash.xxh64_intdigest(str(ids[k])))
    i, s = t["i"].combine_chunks(), t["s"].combine_chunks()
    off, flat_i, flat_s = i.offsets.to_numpy(), i.values.to_numpy(), s.values.to_numpy()
    return learn([(flat_i[off[k] : off[k + 1]], flat_s[off[k] : off[k + 1]], y[k]) for k in order], settings)


def learn(examples: list[tuple[np.ndarray, np.ndarray, int]], settings: Settings) -> Model:
    """The model after passing over the examples (indices, the sentence of each, label) in their order."""
    model = Ftrl((1 << BITS) + 1, alpha=settings.alpha, l1=settings.l1, l2=settings.l2)
    bias, seen = PRIOR, 1.0
    for _ in range(settings.epochs):
        for at, sent, y in examples:
            if not len(at):
                continue
            at, back = np.unique(at, return_inverse=True)
            w = model.weights(at)
            a = bias + np.bincount(sent, w[back])
            p = np.minimum(sigmoid(a), 1 - 1e-9)
            q = np.exp(np.log1p(-p).sum())
            g = p * (-q / max(1 - q, 1e-9)) if y else p  # of the loss, by each sentence's logit
            model.update(at, np.bincount(back, g[sent], len(at)), w)
            gb = g.sum()
            seen += gb * gb
            bias -= 0.3 * gb / np.sqrt(seen)
    return Model(model.weights(), float(bias), settings.prefixes)


def offending(texts: list[bytes], model: Model, cut: float) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Document scores, and for each toxic text (start, end, score) in characters of the sentences whose own score reaches `cut`, or else of its highest."""
    total, each, of, of_token = noisy_or(texts, model)
    found: list[list[tuple[int, int, float]]] = [[] for _ in texts]
    token_at, sentence_at = (np.searchsorted(x, np.arange(len(texts) + 1)) for x in (of[of_token], of))
    for k in np.flatnonzero(total >= cut).tolist():
        first, p = sentence_at[k], each[sentence_at[k] : sentence_at[k + 1]]
        bad = np.flatnonzero(p >= cut) if (p >= cut).any() else np.array([np.argmax(p)])
        at: dict[int, list[int]] = {j: [] for j in bad.tolist()}
        for j, m in zip((of_token[token_at[k] : token_at[k + 1]] - first).tolist(), _TOKEN.finditer(texts[k]), strict=True):
            if j in at and m[0] != b"\n":
                at[j] += m.span()
        byte = char = 0
        for j, places in at.items():
            a, b = places[0], places[-1]
            start = char + len(texts[k][byte:a].decode("utf-8", "replace"))
            byte, char = b, start + len(texts[k][a:b].decode("utf-8", "replace"))
            found[k].append((start, char, float(p[j])))
    return total, found


def _shared(docs: DataFrame, model: Model):
    return docs.sparkSession.sparkContext.broadcast(model._replace(weights=np.asarray(model.weights, np.float32)))


def score(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, n_offending, offending: noisy-or scores of whole texts. No shuffle; one row per input row.

    offending holds start, end (characters) and score of the sentences of a toxic text whose own score reaches `cut`,
    its highest if none does; n_offending counts them. Null and empty texts have no sentence and score 0. A null id
    has held_out null. Repeated rows score alike; an empty table gives no rows; other columns are not read.
    """
    shared = _shared(docs, model)

    def work(batch, texts):
        p, found = offending(texts, shared.value, cut)
        spans = [[dict(zip(("start", "end", "score"), x, strict=True)) for x in xs] for xs in found]
        return {
            "doc_id": column(batch, "doc_id"),
            "held_out": column(batch, "held_out"),
            "score": pa.array(p),
            "predicted": pa.array((p >= cut).astype(np.int32)),
            "n_offending": pa.array([len(x) for x in found], pa.int64()),
            "offending": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "score double, predicted int, n_offending bigint, offending array<struct<start:bigint,end:bigint,score:double>>"
    return map_texts(docs, ["doc_id", "text", (labelled.crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out")], f"doc_id {kind}, held_out boolean, {more}", work)


def locate(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """One row per offending sentence of `score`: doc_id, start, end (characters), score, sentence.

    Texts that aren't toxic, null and empty ones among them, give no row; repeated rows give theirs each; an empty
    table gives none. Other columns are not read.
    """
    shared = _shared(docs, model)

    def work(batch, texts):
        rows = [(k, x) for k, xs in enumerate(offending(texts, shared.value, cut)[1]) for x in xs]
        if not rows:
            return None
        decoded = {k: texts[k].decode("utf-8", "replace") for k in {k for k, _ in rows}}
        return {
            "doc_id": column(batch, "doc_id").take(pa.array([k for k, _ in rows], pa.int64())),
            "start": pa.array([x[0] for _, x in rows], pa.int64()),
            "end": pa.array([x[1] for _, x in rows], pa.int64()),
            "score": pa.array([x[2] for _, x in rows], pa.float64()),
            "sentence": pa.array([decoded[k][x[0] : x[1]] for k, x in rows], pa.string()),
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs, ["doc_id", "text"], f"doc_id {kind}, start bigint, end bigint, score double, sentence string", work)


def keep_clean(docs: DataFrame, model: Model, cut: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that score below `cut`; null and empty texts, null ids and repeated rows among them."""
    shared = _shared(docs, model)

    def work(batch, texts):
        return batch.filter(pa.array(noisy_or(texts, shared.value)[0] < cut))

    return map_texts(docs, [F.col(f"`{c}`") for c in docs.columns], docs.schema, work)
