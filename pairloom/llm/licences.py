"""Licence scans (operator 3): diagonal voting.

Every rolling word k-gram hash of every text is joined in Spark to the positions at which the licence templates have
it. Hits of a text and template on one diagonal (position in the text less position in the template) are summed up,
neighbouring diagonals that overlap are merged, so that inserted or missing words don't break a match, and each merged
span is verified against the words of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.common import column, held, long_id, map_texts, plain_words, saved, ship

#: Phrases whose every place counts, with their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Notices of well-known licences, matched approximately, with labels of the method's own.
NOTICES = (
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("apache-2.0-notice", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2.0-line", "licensed under the apache license version 2 0"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-3.0-line", "this work is licensed under the gnu general public license version 3"),
    ("bsd-text", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0-notice", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc-line", "licensed under cc by nc 4 0"),
    ("cc-by-notice", "this work is licensed under the creative commons attribution 4 0 international license"),
    ("mit-line", "released under the mit license"),
)

#: Words of a k-gram for the phrases, and for the notices.
K_BASE, K_NOTICE = 2, 4
#: Diagonals this near to each other belong together.
GAP = 3
#: Least share of a notice's words that a verified span has.
LEAST = 0.6
CACHE_WORDS = 500_000


def _hashes() -> dict[bytes, int]:
    return held("licences", dict)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams of words with the hashes h."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)]
            out ^= out >> np.uint64(29)
    return out


def word_hashes(lists: list[list[bytes]]) -> list[np.ndarray]:
    """The hashes of the words of each list."""
    cache = _hashes()
    seen = set().union(*lists)
    if len(cache) > CACHE_WORDS:
        cache.clear()
    for w in seen.difference(cache):
        cache[w] = xxhash.xxh64_intdigest(w, 3) | 1
    get = cache.__getitem__
    return [np.fromiter(map(get, x), np.uint64, len(x)) for x in lists]


def templates() -> list[tuple[int, str, list[bytes], int]]:
    """(number, label, words, k): the base phrases first."""
    rows = [(label, phrase, K_BASE) for phrase, label in BASE] + [(label, text, K_NOTICE) for label, text in NOTICES]
    return [(i, label, plain_words(text.encode()), k) for i, (label, text, k) in enumerate(rows)]


def template_positions(spark: SparkSession) -> DataFrame:
    """(h, template, at): each k-gram of each template. The table has as many rows as the templates have words, whatever the corpus."""
    rows = [(int(h), t, at) for t, _, words, k in templates() for at, h in enumerate(rolling(word_hashes([words])[0], k).view(np.int64).tolist())]
    return spark.createDataFrame(rows, "h long, template int, at int")


def diagonals(docs: DataFrame, key: Column) -> DataFrame:
    """(key, template, diagonal, first, last, votes): the joined k-gram hits, summed up by diagonal."""

    def work(batch, texts):
        hashes = word_hashes([plain_words(t) for t in texts])
        grams = [rolling(h, k).view(np.int64) for k in (K_BASE, K_NOTICE) for h in hashes]
        ends = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
        keys = column(batch, "key")
        return {"key": pa.concat_arrays([keys, keys]), "grams": pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(grams)))}

    rows = docs.select(key.alias("key"), F.col("text"))
    kind = rows.schema["key"].dataType.simpleString()
    hashed = map_texts(rows, ["key", "text"], f"key {kind}, grams array<bigint>", work)
    return (
        hashed.select("key", F.posexplode("grams").alias("pos", "h"))
        .join(F.broadcast(template_positions(docs.sparkSession)), "h")
        .groupBy("key", "template", (F.col("pos") - F.col("at")).alias("diagonal"))
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("votes"))
    )


def verify(words: list[bytes], spans: list[dict], patterns: list) -> tuple[list[tuple], list[tuple]]:
    """(places of base phrases, spans of notices) that the words of the text bear out.

    A base place is a diagonal's stretch at which all words of the phrase stand. Notice diagonals no further apart
    than GAP whose stretches touch are merged; the merged span counts if the words that it has in common with the
    notice, in their order, are at least LEAST of the notice's.
    """
    base, notices = [], []
    by: dict[int, list[dict]] = {}
    for s in spans:
        by.setdefault(s["template"], []).append(s)
    for t, rows in by.items():
        _, label, pattern, k = patterns[t]
        if t < len(BASE):
            for s in rows:
                d = s["diagonal"]
                if d >= 0 and words[d : d + len(pattern)] == pattern:
                    base.append((d, d + len(pattern), label))
            continue
        merged: list[list[int]] = []
        reached: list[list[int]] = []
        for s in sorted(rows, key=lambda s: (s["first"], s["diagonal"])):
            reached = [m for m in reached if s["first"] <= m[1] + k + GAP]
            m = min(reached, key=lambda m: abs(s["diagonal"] - m[2]), default=None)
            if m and abs(s["diagonal"] - m[2]) <= GAP:
                m[1], m[2] = max(m[1], s["last"] + k), s["diagonal"]
            else:
                merged.append([s["first"], s["last"] + k, s["diagonal"]])
                reached.append(merged[-1])
        for a, b, _ in merged:
            a, b = max(0, a - GAP), min(len(words), b + GAP)
            share = common(words[a:b], pattern) / len(pattern)
            if share >= LEAST:
                notices.append((a, b, label, share))
    return sorted(set(base)), sorted(set(notices))


def common(x: list[bytes], y: list[bytes]) -> int:
    """Length of the longest common subsequence of words."""
    row = [0] * (len(y) + 1)
    for w in x:
        before = 0
        for j, v in enumerate(y, 1):
            before, row[j] = row[j], before + 1 if w == v else max(row[j], row[j - 1])
    return row[-1]


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, spans (array of start, end, label, base, share): all verified places of every document.

    Null and empty texts have no words and no spans. Null ids and repeated rows are kept; an empty table gives no
    rows; other columns are not read. A doc_id that is no whole number raises.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(long_id(docs), F.col("text"), F.xxhash64(long_id(docs), "text").alias("key"))
    found = diagonals(rows, F.struct(F.col("key"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("d")))
    # rows that repeat id and text give the same hits: a diagonal counts once
    hits = saved(found.groupBy(F.col("key.key").alias("key"), F.col("key.d").alias("d")).agg(F.array_sort(F.collect_list(F.struct("template", "diagonal", "first", "last"))).alias("hits")), "hits")
    joined = rows.withColumn("d", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).join(hits, ["key", "d"], "left").select("doc_id", "text", "hits")

    def work(batch, texts):
        patterns = templates()
        n, out = [], []
        for t, spans in zip(texts, column(batch, "hits").to_pylist(), strict=True):
            words = plain_words(t)
            n.append(len(words))
            base, notices = verify(words, spans, patterns) if spans else ([], [])
            out.append([{"start": a, "end": b, "label": x, "base": True, "share": 1.0} for a, b, x in base] + [{"start": a, "end": b, "label": x, "base": False, "share": s} for a, b, x, s in notices])
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("share", pa.float64())]))
        return {"doc_id": column(batch, "doc_id"), "n_words": pa.array(n, pa.int64()), "spans": pa.array(out, kind)}

    return map_texts(joined, joined.columns, "doc_id bigint, n_words bigint, spans array<struct<start:bigint,end:bigint,label:string,base:boolean,share:double>>", work)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: n_base, first_word, last_word, base_labels, labels and score (the largest share of a template that the text has).

    Without any place n_base is 0, first_word and last_word are null, both labels empty and the score is 0; so it is
    for null and empty texts. Null ids, repeated rows, empty tables and other columns are as in `scan`.
    """
    s = scan(docs)
    base = F.filter("spans", lambda x: x["base"])
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    return s.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda x: x["start"])).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("spans")).alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
