"""Token counts (operator 1): whole-token shortcut over a word-level BPE vocabulary.

Before a job, `prove_whole` encodes every vocabulary string on its own on the driver and keeps those that come back as
that single token; the workers get the proof ready-made. A pre-token found among them counts one token without any
merging; only the rest goes through the merges of the tokenizers library, each distinct pre-token once while the
cache holds it. A full cache lets go what was seen once, so frequent words are not merged again.

Why words can be handled on their own: the vocabulary's pre-tokenizer drops white space, so no token spans it, and
neither NFC nor lower-casing reaches across it. Lower-casing A-Z first changes nothing, since NFC followed by
lower-casing gives the same text. A text that holds the string of a special token goes through the library whole.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import column, held, map_texts

VOCABULARY = "word_bpe_49k.json"
#: Words from which on a worker's cache lets go the rarer ones; at most half as many stay.
CACHE_WORDS = 500_000

#: The contractions and classes of the vocabulary's own split pattern, for ASCII bytes in lower case.
_PRE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
_STOP = re.compile(rb"\.(?<=[a-z0-9]\.)(?!\S)")
_COMMA = re.compile(rb",(?<=[a-z0-9],)(?!\S)")
_SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def prove_whole(tokenizer) -> dict[bytes, int]:
    """The vocabulary's strings, in any script, that encode alone as one token: each is encoded and kept only if exactly its own id comes back.

    A string of a-z, digits and marks must be one pre-token as well, since such words are looked up by pre-token.
    """
    from tokenizers import decoders

    text = decoders.ByteLevel().decode  # the vocabulary spells bytes as characters
    spelt = [(text([s[:-4]]), i) for s, i in tokenizer.get_vocab(with_added_tokens=False).items() if s.endswith("</w>")]
    spelt = [(s, i) for s, i in spelt if (not s.isascii() or (m := _PRE.fullmatch(s.encode())) and m[0] == s.encode())]
    found = tokenizer.encode_batch([s for s, _ in spelt], add_special_tokens=False)
    return {s.encode(): i for (s, i), e in zip(spelt, found, strict=True) if e.ids == [i]}


@lru_cache(maxsize=2)
def proof(path: str) -> dict[bytes, int]:
    """prove_whole of a vocabulary file, made once in a process."""
    return prove_whole(load(path))


def shared_proof(spark: SparkSession, path: str | None = None):
    """The proof made on the driver, once for a session and vocabulary, as a broadcast. It has an entry per whole token at most, whatever the corpus."""
    sc, path = spark.sparkContext, vocabulary_path(path)
    made = sc.__dict__.setdefault("_pairloom_proofs", {})
    if path not in made:
        made[path] = sc.broadcast(proof(path))
    return made[path]


class _Numbers(dict):
    """Words by number; a word that is asked for the first time gets the next one and is noted."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """Ids of whole texts as the tokenizers library gives them, from a bounded cache of words.

    The empty text has no ids. Ids are uint16 bytes where the vocabulary allows it, else uint32.
    """

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS, whole: dict[bytes, int] | None = None):
        self.tokenizer = load(vocabulary_path(path))
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith("</w>")]] = True
        self.cache_words = cache_words
        self.whole = proof(vocabulary_path(path)) if whole is None else whole
        self._reset()

    def _reset(self) -> None:
        self.numbers = _Numbers()
        self.first = np.zeros(1 << 17, np.int64)  # by number: where a word's ids begin in the pool, and how many they are
        self.size = np.zeros(1 << 17, np.int64)
        self.seen = np.zeros(1 << 17, np.int64)  # by number: how often the word stood in a text
        self.pool = np.zeros(1 << 19, self.dtype)
        self.used = 0

    def _shrink(self) -> None:
        """Keep the words that were seen more than once, the most frequent if they are over half of what the cache may hold, and halve their counts."""
        words, seen = list(self.numbers), self.seen[: len(self.numbers)]
        keep, most = np.flatnonzero(seen > 1), self.cache_words // 2
        if len(keep) > most:
            keep = np.sort(keep[np.argsort(-seen[keep], kind="stable")[:most]])
        (ids, sizes), seen = self._gather(keep), seen[keep] >> 1
        kept = [words[i] for i in keep.tolist()]
        del words
        self._reset()
        self.numbers.update(zip(kept, range(len(kept)), strict=True))
        self._put(np.arange(len(kept)), ids, sizes)
        self.seen[: len(kept)] = seen

    def _library(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _put(self, at: np.ndarray | list[int], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Note the ids, laid end to end, of the words with these numbers."""
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while len(self.numbers) > len(self.first):
            self.first, self.size, self.seen = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.size, self.seen))
        at = np.asarray(at, np.int64)
        self.first[at] = self.used + np.cumsum(sizes) - sizes
        self.size[at] = sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _merge(self, at: list[int], words: list[bytes]) -> None:
        """Merge words of one pre-token each: many at once, cut apart again at the ids that end a word."""
        for k in range(0, len(words), 2000):
            part = words[k : k + 2000]
            ids = np.array(self._library(b" ".join(part).decode()), self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(part):
                self._put(at[k : k + 2000], ids, np.diff(cuts, prepend=0))
            else:
                self._apart(at[k : k + 2000], part)

    def _apart(self, at: list[int], words: list[bytes]) -> None:
        """Words that may be of several pre-tokens, each encoded by itself."""
        for k in range(0, len(words), 2000):
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[k : k + 2000]], add_special_tokens=False)]
            self._put(at[k : k + 2000], np.array([i for x in ids for i in x], self.dtype), np.array([len(x) for x in ids], np.int64))

    def _learn(self) -> None:
        """Encode the words that are new. They have the last numbers, in their order."""
        numbers, whole = self.numbers, self.whole
        new, numbers.new = numbers.new, []
        base = len(numbers) - len(new)
        get = numbers.__getitem__
        known, joined, apart = [], [], []
        made, n, at = [], [], []  # words of several parts, how many, and the parts
        for i, w in enumerate(new, base):
            if w in whole:
                known.append(i)
                continue
            if w.isalpha():
                joined.append(i)  # one pre-token of a-z
                continue
            if w.isascii():
                x = _PRE.findall(w)
                if x == [w]:
                    joined.append(i)
                    continue
            else:
                u = w.decode()
                if u.isalpha():
                    joined.append(i)
                    continue
                stem = u.rstrip(".,!?;:")
                if not (stem and stem != u and stem[-1].isalpha() and stem[-1].lower()[-1].isalpha()):
                    apart.append(i)
                    continue
                x = [stem.encode(), u[len(stem) :].encode()]
            made.append(i)
            n.append(len(x))
            at += map(get, x)
        more, numbers.new = numbers.new, []
        for i, w in enumerate(more, base + len(new)):
            (known if w in whole else joined if w.isascii() or w.decode().isalpha() else apart).append(i)
        words = new + more
        self._put(known, np.array([whole[words[i - base]] for i in known], self.dtype), np.ones(len(known), np.int64))
        self._merge(joined, [words[i - base] for i in joined])
        self._apart(apart, [words[i - base] for i in apart])
        if made:
            ids, sizes = self._gather(np.array(at, np.int64))
            ends = np.cumsum(n)
            total = np.concatenate([[0], np.cumsum(sizes)])
            self._put(made, ids, total[ends] - total[ends - n])

    def _gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words with these numbers, end to end, and how many each has."""
        sizes = self.size[at]
        ends = np.cumsum(sizes)
        place = np.repeat(self.first[at] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
        return self.pool[place], sizes

    def _words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """(numbers of all words, words of each text, texts that hold a special token's string and go through the library)."""
        if len(self.numbers) > self.cache_words:
            self._shrink()
        special, lists = [], []
        for k, t in enumerate(texts):
            low = t.lower()
            if any(s in low for s in _SPECIAL):
                special.append(k)
                lists.append([])
            else:
                # a full stop or comma between a-z or a digit and white space is a pre-token of its own
                lists.append(_COMMA.sub(b" ,", _STOP.sub(b" .", low)).split())
        n = np.array([len(x) for x in lists], np.int64)
        get = self.numbers.__getitem__
        at = np.fromiter(map(get, chain.from_iterable(lists)), np.int64, int(n.sum()))
        if self.numbers.new:
            self._learn()
        times = np.bincount(at)
        self.seen[: len(times)] += times
        return at, n, special

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, as raw little-endian bytes."""
        at, n, special = self._words(texts)
        ids, sizes = self._gather(at)
        raw, w = ids.tobytes(), self.dtype.itemsize
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum(n)])] * w
        out = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        for k in special:
            out[k] = np.array(self._library(texts[k].decode()), self.dtype).tobytes()
        return out

    def count(self, texts: list[bytes]) -> list[int]:
        """The number of ids of each text."""
        at, n, special = self._words(texts)
        total = np.concatenate([[0], np.cumsum(self.size[at])])
        ends = np.cumsum(n)
        out = (total[ends] - total[ends - n]).tolist()
        for k in special:
            out[k] = len(self._library(texts[k].decode()))
        return out


def encoder(path: str | None = None, whole=None) -> WordEncoder:
    """The worker process's encoder, whose cache outlives a task. `whole` is the broadcast of shared_proof."""
    return held(("tokens", path), lambda: WordEncoder(path, whole=whole and whole.value))


def count_tokens(docs: DataFrame, limit: int = 2048, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of whole texts: id, n_bytes, n_tokens, over_limit. No shuffle; one row per input row.

    Null texts count as empty: 0 bytes, 0 tokens. Null ids and repeated rows are kept as they are; other columns of
    `docs` are not read. An empty table gives no rows.
    """

    whole = shared_proof(docs.sparkSession, vocabulary)

    def work(batch: pa.RecordBatch, texts: list[bytes]) -> dict:
        n = encoder(vocabulary, whole).count(texts)
        return {
            "id": column(batch, "id"),
            "n_bytes": pa.array([len(t) for t in texts], pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "over_limit": pa.array([x > limit for x in n], pa.bool_()),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_texts(docs, [F.col(id_col).alias("id"), F.col(text_col).alias("text")], f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean", work)
    return out.withColumnRenamed("id", id_col)
