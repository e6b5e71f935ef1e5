"""The training-data operators against brute force, round trips and held-out accuracy, with odd rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from pairloom.llm import common, components, decontam, idstore, licences, packing, pages, quality, registry, simhash, tokens, toxicity, vectors

DOCS = "doc_id long, text string, lang string, source string, n_tokens string, fingerprint string"
ODD = [
    (1, "One two three four five six.", "en", "a", "clash", "clash"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", "", ""),
    (None, "no id at all", "en", None, None, None),
    (4, "twin row", "en", "b", None, None),
    (4, "twin row", "en", "b", None, None),
    (5, " \t\n ", "en", "b", None, None),
    (6, "Ünïcode, İstanbul İ. don't 's .. a.b ™, ﬁ \x1c x\x85y 中文。 <|endoftext|> <|ENDOFTEXT|>", "xx", "c", None, None),
    (7, "lorem ipsum dolor " * 4000, "la", "a", None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def plain(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def test_token_counts(odd, none):
    tok = tokens.load(tokens.vocabulary_path())
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(odd).collect())
    want = Counter()
    for d, t, *_ in ODD:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want[d, len((t or "").encode()), n, n > 2048] += 1
    assert got == want and tokens.count_tokens(none).count() == 0


def test_encoder_equals_library():
    r, tok, enc = random.Random(4), tokens.load(tokens.vocabulary_path()), tokens.WordEncoder(cache_words=50)
    alphabet = "aAbzé İΣςß.,!'’sS t0 9\n\t\x1c\x85 ́™中𝔸-_#"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(400)]
    for k in range(0, 400, 50):
        part = texts[k : k + 50]
        want = [tok.encode(t, add_special_tokens=False).ids for t in part]
        assert [np.frombuffer(x, enc.dtype).tolist() for x in enc.encode([t.encode() for t in part])] == want
        assert enc.count([t.encode() for t in part]) == [len(x) for x in want]


def test_proof():
    tok = tokens.load(tokens.vocabulary_path())
    whole = tokens.proof(tokens.vocabulary_path())
    other = [w for w in whole if not w.isascii()]
    assert len(whole) > 30_000 and len(other) > 100 and b"the" in whole
    assert all(tok.encode(w.decode(), add_special_tokens=False).ids == [whole[w]] for w in (*other, *list(whole)[::50]))
    enc = tokens.WordEncoder()
    texts = [b" ".join(other[k : k + 50]) for k in range(0, len(other), 50)]
    assert enc.count(texts) == [len(tok.encode(t.decode(), add_special_tokens=False).ids) for t in texts]


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(-(2**62), 2**62, 5000)
    h = idstore.PerfectHash.build(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(5000))
    assert idstore.PerfectHash.build(np.zeros(0, np.int64)).slots(np.array([5])).tolist() == [-1]
    with pytest.raises(ValueError):
        idstore.PerfectHash.build(np.array([1, 1]))


def brute_ids(rows):
    """(doc_id, start, n_tokens, crc) of each row of (doc_id, text), with the end id, in the store's order."""
    tok = tokens.load(tokens.vocabulary_path())
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode()) >> 1))
    start, out = 0, []
    for d, t, *_ in order:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_id_store(spark, odd, none, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "DOCS_PER_SHARD", 3)
    monkeypatch.setattr(idstore, "DOCS_PER_INDEX", 2)
    entries, files = idstore.write_ids(odd, f"file://{tmp_path}")
    got = [tuple(r) for r in idstore.read_back(entries, f"file://{tmp_path}", files).collect()]
    assert Counter(got) == Counter(brute_ids(ODD)) and len(got) == len(ODD)
    folder = idstore.IdFolder(f"file://{tmp_path}", files)
    assert folder.get(3).tolist() == [2] and folder.get(999) is None
    at = tmp_path / "none"
    at.mkdir()
    entries, files = idstore.write_ids(none, f"file://{at}")
    assert entries.count() == 0 and idstore.read_back(none, f"file://{at}", files).count() == 0


def test_id_store_repeated_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "DOCS_PER_SHARD", 3)
    monkeypatch.setattr(idstore, "DOCS_PER_INDEX", 4)
    r = random.Random(21)
    rows = [(r.choice([None, 5, 5, 5, 7, k]), " ".join(r.choice(["the", "of", "word", "é"]) for _ in range(r.randint(0, 5)))) for k in range(60)] + [(5, None), (None, None), (0, "zero"), (-1, "minus")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_ids(rows)
    entries, files = idstore.write_ids(df, f"file://{tmp_path}")
    assert entries.where("doc_id = 5").select("shard").distinct().count() > 1
    got = [tuple(x) for x in idstore.read_back(entries, f"file://{tmp_path}", files).collect()]
    assert Counter(got) == Counter(want)
    folder, seen = idstore.IdFolder(f"file://{tmp_path}", files), Counter()
    for d, start, n, crc in want:
        ids = folder.get(d, seen[d])
        assert len(ids) == n and zlib.crc32(ids.astype("<u4").tobytes()) == crc and int(folder.find(d, seen[d])["start"]) == start
        seen[d] += 1
    assert all(folder.get(d, n) is None for d, n in seen.items())
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(x) for x in registry.op7_token_ids(spark, str(tmp_path)).collect()) == Counter(want)


def test_keyed_access_reads_little(spark, tmp_path):
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 60_000)
    ph = idstore.PerfectHash.build(keys)
    records = np.zeros(len(keys), idstore.RECORD)
    slot = ph.slots(keys)
    records["print"][slot] = idstore.fingerprint(keys, np.zeros_like(keys))
    records["start"][slot] = np.arange(len(keys))
    store = idstore.Store(f"file://{tmp_path}")
    store.write("idx-000000.mph", iter([*ph.dump(), records.tobytes()]))
    folder, sizes = idstore.IdFolder(f"file://{tmp_path}", 1), []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *x):
            self.f.close()

        def read(self, n):
            sizes.append(n)
            return self.f.read(n)

        def __getattr__(self, name):
            return getattr(self.f, name)

    folder.store.open = lambda name, f=folder.store.open: Counted(f(name))
    for k in range(0, len(keys), 997):
        sizes.clear()
        assert int(folder.find(int(keys[k]))["start"]) == k and sum(sizes) < 4096


def hamming_groups(prints):
    n, least = len(prints), list(range(len(prints)))

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i in range(n):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                least[b] = a
    return [find(i) for i in range(n)]


def brute_print(t):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, odd, none):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    rows = []
    for g in range(12):
        base = [r.choice(words) for _ in range(150)]
        for k in range(5):
            t = base[:]
            for _ in range(k):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((100 + 7 * g + k, " ".join(t)))
    r.shuffle(rows)
    rows += [(d, t) for d, t, *_ in ODD if d is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    prints = [brute_print(t) for _, t in rows]
    of = hamming_groups(prints)
    smallest = {}
    for (d, _), g in zip(rows, of, strict=True):
        smallest[g] = min(d, smallest.get(g, d))
    want = Counter((d, f"{p:016x}", smallest[g]) for (d, _), p, g in zip(rows, prints, of, strict=True))
    got = Counter(tuple(x) for x in simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect())
    assert got == want
    kept = sorted(x.doc_id for x in simhash.keep_first(df).collect())
    assert kept == sorted(smallest.values())
    assert simhash.keep_first(odd).columns == odd.columns and simhash.near_duplicates(none).count() == 0
    assert simhash.near_duplicates(odd).count() == len(ODD)


def test_hamming_links(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(15)]
    near = [b ^ sum(1 << i for i in r.sample(range(64), k)) for b in base for k in (0, 1, 2, 3, 4, 5)]
    prints = sorted(set(near))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    got = {tuple(sorted((x.a, x.b))) for x in simhash.links(spark.createDataFrame([(s,) for s in signed], "f long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    assert got == want and simhash.links(spark.createDataFrame([(s,) for s in signed], "f long")).count() == len(want)


def test_refined_signatures(spark):
    r = random.Random(31)
    base = [r.getrandbits(64) for _ in range(25)]
    prints = sorted({b ^ sum(1 << i for i in r.sample(range(64), k)) for b in base for k in (0, 1, 2, 2, 3, 4, 4, 5)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(s,) for s in signed], "f long")
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4}
    got = [(x.a, x.b) for x in simhash.links(df, refine=True).collect()]
    assert set(got) == want and len(got) == len(want)
    of, least = hamming_groups(prints), {}
    for g, f in zip(of, signed, strict=True):
        least[g] = min(f, least.get(g, f))
    for refine in (False, True):
        assert {x.f: x.component for x in simhash.groups(df, refine=refine).collect()} == {f: least[g] for g, f in zip(of, signed, strict=True)}


def test_dense_group_gives_few_links(spark):
    """All fingerprints within two bits of one: 2,017 of them, over a million pairs within four bits."""
    flips = [0] + [1 << i for i in range(64)] + [1 << i | 1 << j for i in range(64) for j in range(i)]
    signed = [p - (1 << 64) if p >> 63 else p for p in (0x0123456789ABCDEF ^ f for f in flips)]
    got = simhash.groups(spark.createDataFrame([(s,) for s in signed], "f long")).collect()
    assert len(got) == len(signed) and {x.component for x in got} == {min(signed)}


def test_components(spark):
    r = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)] + [(7, 7), (None, 3), (1, 0)]
    got = {x.node: x.component for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    least = {}

    def find(x):
        while least.setdefault(x, x) != x:
            x = least[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            least[y] = x
    assert got == {x: find(x) for x in list(least)}


def brute_hits(docs, items):
    windows = {}
    for i, t in items:
        w = plain(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i))
    out = Counter()
    for d, t, *_ in docs:
        w, hit, found = plain(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out[d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)] += 1
    return out


def test_contamination(spark, odd, none, monkeypatch):
    r = random.Random(6)
    words = ["the", "of", "and"] + ["".join(r.choice("abc") for _ in range(3)) for _ in range(15)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    items = [(i, text(r.choice([1, 3, 9, 10, 11, 25]))) for i in range(12)] + [(50, None), (51, ""), (None, "the of"), (3, "and the and the of of"), (7, "lorem ipsum dolor " * 5)]
    items = [x for x in items if len(plain(x[1])) != 1 or r.random() < 0.3]
    docs = [(10 + k, " ".join([text(r.randint(0, 40)), (r.choice(items)[1] or ""), text(8)]).title(), "", "", "", "") for k in range(60)] + ODD
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = brute_hits(docs, [x for x in items if x[0] is not None])
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    get = lambda: Counter(tuple(x) for x in decontam.contamination(df, bench, slop=0).select(*cols).collect())
    assert get() == want
    monkeypatch.setattr(decontam, "SEGMENT_BYTES", 700)
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 60)
    monkeypatch.setattr(decontam.blocks, "__defaults__", (60,))
    assert get() == want
    clean = {k[0]: n for k, n in want.items() if not k[-1]}
    kept = decontam.keep_uncontaminated(df, bench)
    assert kept.columns == df.columns and Counter(x.doc_id for x in kept.collect()) == Counter({d: n for d, n in Counter(k[0] for k in want.elements() if not k[-1]).items()}) and clean
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where("contaminated").count() == 0


def test_proximity():
    seg = decontam.build_segment([b"x a b q c y", b"a q q q b c", b"c b a", b"a b c"])
    s = decontam.Segment(seg["n_words"], seg["terms"], seg["counts"], seg["positions"])
    i, f = s.lookup([b"a", b"b", b"c"])
    exact, near = decontam.match(s, i.tolist(), f, 1)
    assert s.document(exact).tolist() == [3] and sorted(s.document(near).tolist()) == [0, 3]


def brute_near(docs, items, slop, window=10):
    """How many rows there are of each (document, number of items that a window of ten words and `slop` inserted ones is near)."""
    windows = {}
    for i, t in items:
        w = plain(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + window]), set()).add(i)

    def near(words, w):
        for a in range(len(words)):
            if words[a] != w[0]:
                continue
            ends = {a}
            for t in w[1:]:
                ends = {b for e in ends for b in range(e + 1, min(len(words), a + len(w) + slop)) if words[b] == t}
            if ends:
                return True
        return False

    out = Counter()
    for d, t, *_ in docs:
        words = plain(t)
        out[d, len({i for w, own in windows.items() if near(words, w) for i in own})] += 1
    return out


def test_near_contamination(spark, tmp_path, monkeypatch):
    r = random.Random(16)
    words = ["".join(r.choice("abc") for _ in range(2)) for _ in range(9)] + [f"w{k}" for k in range(15)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(r.choice([2, 4, 10, 13])))) for i in range(12)]
    docs = []
    for k in range(80):
        w = r.choice(items)[1].split()
        for _ in range(k % 5):
            w.insert(r.randint(1, len(w) - 1), r.choice(["xx", r.choice(words)]))
        docs.append((k, " ".join(text(r.randint(0, 12)) + w + text(4)), "", "", "", ""))
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string")
    get = lambda **x: Counter((y.doc_id, y.n_near) for y in decontam.contamination(df, bench, **x).collect())
    want = {s: brute_near(docs, items, s) for s in (0, 1, 2)}
    assert want[0] != want[1] != want[2]
    assert all(get(slop=s) == want[s] for s in want)
    with monkeypatch.context() as m:
        m.setattr(decontam, "SEGMENT_BYTES", 700)
        m.setattr(decontam.blocks, "__defaults__", (60,))
        assert get(slop=2) == want[2]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    whole = registry.op8_decontamination(spark, str(tmp_path))
    exact = decontam.contamination(df, bench, slop=0).drop("n_near")
    assert Counter((y.doc_id, y.n_near) for y in whole.collect()) == want[2]
    assert Counter(whole.drop("n_near").collect()) == Counter(exact.collect())


def test_notice_with_an_inserted_word():
    patterns = licences.templates()
    number, label, notice, k = next(x for x in patterns if x[1] == "apache-2.0-notice")
    grams = lambda words: licences.rolling(licences.word_hashes([words])[0], k).tolist()
    for at in range(1, len(notice)):
        words = notice[:at] + [b"zzz"] + notice[at:]
        by = {}
        for pos, h in enumerate(grams(words)):
            for place, g in enumerate(grams(notice)):
                if g == h:
                    by.setdefault(pos - place, []).append(pos)
        spans = [{"template": number, "diagonal": d, "first": min(p), "last": max(p)} for d, p in by.items()]
        assert label in {x[2] for x in licences.verify(words, spans, patterns)[1]}, at


def test_notice_with_replaced_words():
    patterns = licences.templates()
    number, label, notice, k = next(x for x in patterns if x[1] == "mit-text")
    grams = lambda words: licences.rolling(licences.word_hashes([words])[0], k).tolist()
    r = random.Random(19)
    for _ in range(200):
        words = notice[:]
        at, of = r.randrange(len(words) - 4), r.randrange(len(words) - 4)
        words[at : at + 4] = notice[of : of + 4]
        words.insert(r.randrange(len(words)), b"zzz")
        by = {}
        for pos, h in enumerate(grams(words)):
            for place, g in enumerate(grams(notice)):
                if g == h:
                    by.setdefault(pos - place, []).append(pos)
        spans = [{"template": number, "diagonal": d, "first": min(p), "last": max(p)} for d, p in by.items()]
        found = {x[2] for x in licences.verify(words, spans, patterns)[1]}
        assert label in found, (at, of)


def test_licences(spark, odd, none):
    text = [
        "Released under the MIT License. mit license, CC-BY 4.0 and cc by",
        "gnu general public license GNU General Public License, gnu general public",
        "Permission is hereby granted, free of charge, to any kind person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
        "apache the license; public license; by cc",
    ]
    rows = [(20 + k, t) for k, t in enumerate(text)] + [(d, t) for d, t, *_ in ODD]
    got = {(r.doc_id, r.n_words): r for r in licences.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, t in rows:
        w, places, labels = plain(t), [], set()
        for phrase, label in licences.BASE:
            p = phrase.split()
            at = [k for k in range(len(w)) if w[k : k + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got[d, len(w)]
        assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
    by = {d: r for (d, _), r in got.items()}
    assert "mit-text" in by[22].labels.split(",") and by[23].labels == "" and 0 <= by[22].score <= 1
    assert licences.report(none).count() == 0


def test_best_fit():
    r = random.Random(7)
    pieces = sorted(((r.randint(0, 100), r.choice("xyz"), r.randint(0, 40)) for _ in range(200)), key=lambda p: -p[0])
    got = packing.best_fit(pieces, 100)
    bins = []
    for (n, s, c), b in zip(pieces, got, strict=True):
        fit = [(100 - x["n"], k) for k, x in enumerate(bins) if x["n"] + n <= 100 and x["n"] < 100 and s not in x["s"] and c not in x["c"]]
        want = min(fit)[1] if fit else len(bins)
        assert b == want
        if want == len(bins):
            bins.append({"n": 0, "s": set(), "c": set()})
        bins[b]["n"] += n
        bins[b]["s"].add(s)
        bins[b]["c"].add(c)
    assert packing.best_fit([(5, None, None)] * 4, 10) == [0, 0, 1, 1]


def test_packing(odd, none):
    rows = packing.pack(odd, capacity=512).collect()
    whole = Counter()
    for r in rows:
        whole[r.doc_id] += r.n_tokens
    want = Counter()
    for x in tokens.count_tokens(odd).collect():
        want[x.doc_id] += x.n_tokens
    assert +whole == +want and {r.doc_id for r in rows} == {d for d, *_ in ODD}
    load = Counter()
    for r in rows:
        load[r.bin_id] += r.n_tokens
    assert max(load.values()) <= 512 and packing.pack(none).count() == 0


def test_best_fit_against_all_bins():
    def brute(pieces, capacity):
        bins, out = [], []
        for n, s, c in pieces:
            fit = [(capacity - x[0], k) for k, x in enumerate(bins) if x[0] + n <= capacity and x[0] < capacity and (s is None or s not in x[1]) and (c is None or c not in x[2])]
            at = min(fit)[1] if fit else len(bins)
            if at == len(bins):
                bins.append([0, set(), set()])
            bins[at][0] += n
            bins[at][1].add(s)
            bins[at][2].add(c)
            out.append(at)
        return out

    r = random.Random(17)
    for _ in range(150):
        capacity = r.choice([1, 2, 7, 64, 100])
        pieces = [(r.randint(0, capacity), r.choice([None, "x", "x", "y", str(r.random())]), r.choice([None, *range(r.choice([2, 40]))])) for _ in range(r.randint(0, 250))]
        assert packing.best_fit(pieces, capacity) == brute(pieces, capacity)


@pytest.mark.parametrize("piece", [(0, None, "c"), (1, "s", None), (0, "s", "c")])
def test_best_fit_of_conflicts_only(piece):
    began = time.process_time()
    assert packing.best_fit([piece] * packing.CELL_PIECES, 2048) == list(range(packing.CELL_PIECES))
    assert time.process_time() - began < 5


def test_packing_in_full(spark):
    r = random.Random(18)
    rows = [(r.choice([None, *range(300)]), r.choice([None, "", "Twin", "twin", " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 700)))]), r.choice(["hot", "hot", "b", "c", None, str(r.random())])) for _ in range(700)]
    rows += [(None, None, None)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    capacity, tok = 256, tokens.load(tokens.vocabulary_path())
    got = packing.pack(df, capacity, cell_pieces=200).collect()
    want = Counter()
    for d, t, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        for j in range(max(1, -(-n // capacity))):
            want[d, j, j * capacity, min(capacity, n - j * capacity)] += 1
    assert Counter((x.doc_id, x.piece, x.first, x.n_tokens) for x in got) == want
    # what a bin holds is told by its rows, so put the source and text into the id
    ids = {}
    named = [(ids.setdefault((t, s, k), len(ids)), t, s) for k, (_, t, s) in enumerate(rows)]
    back = {i: ((t or "").lower(), s) for (t, s, _), i in ids.items()}
    frame = spark.createDataFrame(named, "doc_id long, text string, source string")
    bins = {}
    for x in packing.pack(frame, capacity, cell_pieces=200).collect():
        bins.setdefault(x.bin_id, []).append((x.n_tokens, *back[x.doc_id]))
    for b in bins.values():
        sources = [s for _, _, s in b if s is not None]
        assert sum(n for n, _, _ in b) <= capacity and len({t for _, t, _ in b}) == len(b) and len(set(sources)) == len(sources)
    # the files of the input don't matter
    assert Counter(packing.pack(df.repartition(7), capacity, cell_pieces=200).collect()) == Counter(got)
    # bins are well filled where nothing conflicts
    free = spark.createDataFrame([(k, " ".join(r.choice("abcdefgh") for _ in range(r.randint(1, 100))) + f" {k}", None) for k in range(1500)], "doc_id long, text string, source string")
    out = packing.pack(free, capacity).collect()
    assert sum(x.n_tokens for x in out) / capacity / len({x.bin_id for x in out}) > 0.98


def test_vectors(spark):
    r = np.random.default_rng(8)
    rows, k = [], 0
    for label in (0, 1):
        for _ in range(25):
            c = r.normal(size=24)
            for _ in range(4):
                # spread so that some neighbours lie on either side of the threshold
                rows.append((k := k + 1, (c + r.normal(size=24) * r.choice([0.02, 0.2, 0.27])).astype(np.float32).tolist(), label))
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, rows[0][1], None), (504, None, 0), (505, [0.0] * 24, 0), (506, [float("nan")] * 24, 0), (507, [], 0), (508, [1.0, None], 0), (None, rows[0][1], 0), (509, [float("inf")] * 24, 0), (510, rows[0][1][:23], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(i, np.array(v, float), y) for i, v, y in rows if i is not None and v and y is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    want = Counter()
    links = set()
    for a in range(len(good)):
        for b in range(a):
            (i, x, l), (j, y, m) = good[a], good[b]
            if l == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links.add((i, j))
                want[i] += 1
                want[j] += 1
    got = {r.vec_id: r for r in vectors.near_duplicates(df).collect()}
    n = sum(got[i].n_links for i, _, _ in good)
    assert n <= 2 * len(links) and n >= 0.98 * 2 * len(links)
    assert all(got[i].n_links <= want[i] for i, _, _ in good)
    for i in (503, 504, 505, 506, 507, 508, 509):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[501].component_id == 1 and got[None].component_id is None and len(got) == len(rows)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_of_any_size(spark):
    base = np.random.default_rng(3).normal(size=8)
    rows = [(1, (base * 1e200).tolist(), 0, "x"), (2, (base * 1e-200).tolist(), 0, "x"), (2, base.tolist(), 0, "y"), (3, (-base).tolist(), 0, None), (4, base.tolist(), 1, "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, cid string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    assert got == [(1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 16))
    y = vectors.hadamard(x)
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(vectors.hadamard(y), x)


def labelled(spark, n=700):
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(800)]
    docs, labels = [], []
    for d in range(n):
        s = [" ".join(r.choice(words) for _ in range(r.randint(4, 12))) + "." for _ in range(r.randint(2, 12))]
        bad, toxic = r.random() < 0.3, r.random() < 0.3
        if toxic:
            s[r.randrange(len(s))] = f"you {r.choice(['vile', 'nasty', 'rotten'])} {r.choice(words)} {r.choice(['vile', 'nasty', 'rotten'])}."
        t = " ".join(s)
        docs.append((d, " ".join(w.upper() + "!!" for w in t.split()) if bad else t))
        labels.append((d, int(not bad), int(toxic)))
    labels += [(None, 1, 1), (3, None, None), (10**6, 0, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {d: (q, t) for d, q, t in labels if q is not None and d is not None}


def test_classifiers(spark, odd, none):
    docs, labels, truth = labelled(spark)
    for module, at, mod, held, keep in ((quality, 0, 3, 1, quality.keep_good), (toxicity, 1, 4, 2, toxicity.keep_clean)):
        model = module.fit(docs, labels)
        rows = module.score(docs, model).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == held) for r in rows)
        test = [r for r in rows if r.held_out]
        assert np.mean([r.predicted == truth[r.doc_id][at] for r in test]) > 0.95
        scored = module.score(odd, model).collect()
        assert len(scored) == len(ODD) and all(0 <= r.score <= 1 for r in scored)
        kept = keep(docs, model)
        drop = {r.doc_id for r in rows if (r.predicted == 0) == (module is quality)}
        assert {r.doc_id for r in kept.collect()} == {d for d in range(700)} - drop
        assert keep(odd, model).columns == odd.columns and module.score(none, model).count() == 0
        empty = module.fit(none, labels)
        assert module.score(odd, empty).count() == len(ODD)
    model = toxicity.fit(docs, labels)
    found = toxicity.locate(docs, model).collect()
    assert found and np.mean([any(w in r.sentence.lower() for w in ("vile", "nasty", "rotten")) for r in found]) > 0.9


class DenseFtrl:
    """FTRL-Proximal coordinate by coordinate, from the paper's update."""

    def __init__(self, size, alpha, beta, l1, l2):
        self.z, self.n = [0.0] * size, [0.0] * size
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def w(self, i):
        if abs(self.z[i]) <= self.l1:
            return 0.0
        return -(self.z[i] - math.copysign(self.l1, self.z[i])) / ((self.beta + math.sqrt(self.n[i])) / self.alpha + self.l2)

    def step(self, g):
        for i, x in g.items():
            w, s = self.w(i), (math.sqrt(self.n[i] + x * x) - math.sqrt(self.n[i])) / self.alpha
            self.z[i] += x - s * w
            self.n[i] += x * x


def test_learner_of_quality(spark):
    size = 1 << quality.BITS
    docs, labels, truth = labelled(spark, 60)
    w, bias = quality.fit(docs, labels, epochs=2)
    learner, feats = DenseFtrl(size + 1, 0.3, 1.0, 0.02, 0.1), {}
    rows = sorted((r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 3 != 1), key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    for r in rows:
        fams, _, n = quality.features([r.text.encode()])
        feats[r.doc_id] = {i: quality.SCALE * c / n[0] for i, c in Counter(np.concatenate(fams).tolist()).items()} | {size: 1.0}
    for _ in range(2):
        for r in rows:
            x = feats[r.doc_id]
            p = 1 / (1 + math.exp(-sum(learner.w(i) * v for i, v in x.items())))
            learner.step({i: (p - truth[r.doc_id][0]) * v for i, v in x.items()})
    assert np.allclose(w, [learner.w(i) for i in range(size)], atol=1e-5) and bias == pytest.approx(learner.w(size), abs=1e-5)
    got = {r.doc_id: r.score for r in quality.score(docs, (w, bias)).collect()}
    for r in rows:
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-sum(learner.w(i) * v for i, v in feats[r.doc_id].items()))), abs=1e-4)


def test_learner_of_toxicity():
    r = random.Random(23)
    examples = [([r.randrange(20) for _ in range(n)], sorted(r.randrange(3) for _ in range(n)), r.randrange(2)) for n in (r.randint(0, 12) for _ in range(50))]
    settings = toxicity.Settings((), 1.0, 0.05, 0.0, 3)
    got = toxicity.learn([(np.array(i, np.int64), np.array(s, np.int64), y) for i, s, y in examples], settings)
    learner, bias, seen = DenseFtrl(20, 1.0, 1.0, 0.05, 0.0), toxicity.PRIOR, 1.0
    for _ in range(3):
        for i, s, y in examples:
            if not i:
                continue
            # every place of an index counts; a sentence without words has the bias alone, up to the last with one
            p = [1 / (1 + math.exp(-(bias + sum(learner.w(a) for a, b in zip(i, s) if b == k)))) for k in range(max(s) + 1)]
            clean = math.prod(1 - x for x in p)
            g = [-x * clean / (1 - clean) if y else x for x in p]
            grad = {}
            for a, b in zip(i, s):
                grad[a] = grad.get(a, 0) + g[b]
            learner.step(grad)
            seen += sum(g) ** 2
            bias -= 0.3 * sum(g) / math.sqrt(seen)
    assert np.allclose(got.weights[:20], [learner.w(i) for i in range(20)]) and got.bias == pytest.approx(bias)


def test_sentences_located(spark):
    index = lambda w: xxhash.xxh64_intdigest(w.encode(), 9) >> (64 - toxicity.BITS)
    weights = np.zeros((1 << toxicity.BITS) + 1)
    weights[index("bad")], weights[index("odd")] = 7.0, 5.8
    model = toxicity.Model(weights, -7.0, ())
    rows = [
        (1, "Bad one.\u00a0Good one. x"),  # a no-break space ends no word
        (2, "All good.\n\nÜber bad thing! (So bad.) Fine\x00bad"),
        (3, "odd one. odd two."),
        (4, None),
        (5, ""),
        (None, "bad"),
        (6, "bad\nbad line\r\n end"),
        (6, "bad\nbad line\r\n end"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = toxicity.locate(df, model).collect()
    texts = {}
    for x in found:
        texts.setdefault(x.doc_id, []).append(x.sentence)
    assert {d: sorted(t) for d, t in texts.items()} == {1: ["Bad one.\u00a0Good one."], 2: sorted(["Über bad thing!", "(So bad.)", "Fine\x00bad"]), 3: ["odd one."], None: ["bad"], 6: ["bad", "bad", "bad line", "bad line"]}
    scored = toxicity.score(df, model).collect()
    whole = dict(rows)
    assert Counter((r.doc_id, whole[r.doc_id][o.start : o.end]) for r in scored for o in r.offending) == Counter((x.doc_id, x.sentence) for x in found)
    assert all(r.n_offending == len(r.offending) for r in scored) and sum(r.n_offending for r in scored) == len(found)
    # sentence by sentence, the noisy-or by hand
    for r in scored:
        words = [[re.sub(r"^\W+|\W+$", "", w).lower() for w in s] for s in (re.split(r"[ \x00\r]+", t) for t in re.split(r"(?<=[.!?])\s|(?<=[.!?]\))\s|\n", (whole[r.doc_id] or "").replace("\u00a0", "_")))]
        if r.doc_id in (3, 6, None):
            p = [1 / (1 + math.exp(7 - 7 * ("bad" in s) - 5.8 * ("odd" in s))) for s in words if {"bad", "odd"} & set(s)]
            assert r.score == pytest.approx(1 - math.prod(1 - x for x in p), abs=1e-6)


def test_choice_reads_learnable_rows_only(spark):
    from pairloom.llm import choose_toxicity

    docs, labels, truth = labelled(spark, 300)
    train, check = choose_toxicity.learnable(docs, labels)
    ids = [r.doc_id for r in train.union(check).collect()]
    assert ids and len(set(ids)) == len(ids) and all(zlib.crc32(str(d).encode()) % 4 != 2 for d in ids)
    best = choose_toxicity.choose(docs, labels, [toxicity.CHOSEN, toxicity.Settings(epochs=1, l1=50.0)])
    assert best[0][3] == toxicity.CHOSEN and best[0][0] < best[1][0] and best[0][2] == check.count()


def test_blocks():
    page = "<head><title>T</title><style>p{}</style></head><body><p>a &amp; b<br>c<p><b>x</p></i></div><ul><li>1<li>2</ul><!-- <p>no</p> --><script>if (a<b) '</p>'</script>1 < 2 <table><tr><td>u<td>v</table>end &lt;p&gt; &am"
    assert [b.text for b in pages.blocks(page)] == ["a & b c", "x", "1", "2", "1 < 2", "u", "v", "end <p> &am"]
    assert pages.blocks("") == [] and pages.blocks("<p") and pages.blocks("<!-- open") == []


@pytest.mark.parametrize(
    "page, want",
    [
        ("<head><title>T</title><p>real text<p>more", ["real text", "more"]),
        ("<head><meta a=b>text at once", ["text at once"]),
        ("<html><head><title>a<b</title></head><body>x", ["x"]),
        ("<p>a</p><svg><g>x<p>more", ["a", "x", "more"]),
        ("<object data=x><p>fallback<p>y", ["fallback", "y"]),
        ("<canvas><video src=a><p>z", ["z"]),
        ("<svg>in</svg >out <video>in</VIDEO>too", ["out too"]),
        ("<style>x<p>y", []),
        ('<p class="x>Hello</p><p>b', ["Hello", "b"]),
        ("<a title=it's>link</a> and 'x' <b>y</b>", ["link and 'x' y"]),
        ('<p title="a>b" x=\'>\'>c', ["c"]),
        ("a < b <3 <!doctype <p>q", ["a < b <3 q"]),
        ("&#" + "9" * 6000 + "; &#x" + "f" * 5000 + " &#0000000000065; &#x41;", ["\ufffd \ufffd A A"]),
    ],
)
def test_odd_tags(page, want):
    assert [b.text for b in pages.blocks(page)] == want


@pytest.mark.parametrize("unit", ["<a ", "<div>x", "<h1>x", "<p><td>", "<svg>x", '<a x="', "<a x='>\" ", "<a class = ", "&#9", "<body>x", "</svg ", "<", "<!x", "<svg> > </svg "])
def test_long_broken_pages(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.process_time()
    pages.blocks(page)
    pages.blocks("<svg>" + page)
    assert time.process_time() - began < 15


def test_label_is_the_recurrence():
    """The batched network against one block at a time, and a page alone against the page among others."""
    w = {k: v.astype(float) for k, v in pages.new_weights(np.random.default_rng(3)).items()}
    layouts = pages.Layouts(4)
    data = [layouts.page()[0] for _ in range(5)]
    h = pages.HIDDEN
    sig = lambda z: 1 / (1 + np.exp(-z))
    for got, page in zip(pages.label(w, data), data, strict=True):
        x = []
        for i, b in enumerate(page):
            words = [w["word"][xxhash.xxh64_intdigest(t, 2) % pages.WORDS] for t in b.text.lower().split()]
            path = [w["path"][k] for k in pages.path_features(b.path)]
            x.append(np.concatenate([np.sum(path, 0) if path else np.zeros(pages.PATH_DIM), np.mean(words, 0) if words else np.zeros(pages.WORD_DIM), pages.measures(b, i / len(page))]))
        states = {}
        for d, order in (("f", range(len(x))), ("b", range(len(x) - 1, -1, -1))):
            s, c = np.zeros(h), np.zeros(h)
            for i in order:
                z = x[i] @ w["x" + d] + s @ w["h" + d] + w["c" + d]
                c = sig(z[h : 2 * h]) * c + sig(z[:h]) * np.tanh(z[3 * h :])
                s = sig(z[2 * h : 3 * h]) * np.tanh(c)
                states[d, i] = s
        want = [sig(np.concatenate([states["f", i], states["b", i], x[i]]) @ w["out"] + w["bias"][0]) for i in range(len(x))]
        assert np.allclose(got, want, atol=1e-4)


def test_gradients():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in pages.new_weights(rng).items()}
    data = [pages.Layouts(s).page() for s in (1, 2)]
    b, y = pages.Batch([p for p, _ in data]), np.concatenate([t for _, t in data])
    _, g = pages._gradients(w, b, y)

    def loss():
        z = pages._forward(w, b)[0].astype(float)
        return float((np.logaddexp(0, z) - z * y).sum() / 2)

    for k in ("xf", "hb", "out", "cf", "path"):
        i = tuple(np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape))
        old = w[k][i]
        w[k][i] = old + 1e-3
        up = loss()
        w[k][i] = old - 1e-3
        down = loss()
        w[k][i] = old
        assert g[k][i] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-3)


def test_extraction(spark):
    w = pages.trained()
    fresh = [pages.Layouts(77).page() for _ in range(1)]
    layouts = pages.Layouts(78)
    fresh = [layouts.page() for _ in range(150)]
    right = np.concatenate([(p >= 0.5) == y for p, (_, y) in zip(pages.label(w, [b for b, _ in fresh]), fresh, strict=True)])
    assert right.mean() > 0.98
    page = '<body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="cookie-notice">We use cookies</div><article><h1>Big &amp; small</h1><p>First   para\ngraph here.</p><p>Second one.</p></article><div class="comments"><p>Nice read!</p></div><footer>&copy; x</footer></body>'
    rows = [(1, "u", page, "clash"), (2, None, None, None), (None, "v", "", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in pages.extract(df, w).collect()}
    assert got[1].text == "Big & small\nFirst para graph here.\nSecond one." and got[1].n_chars == len(got[1].text)
    assert (got[2].text, got[2].n_chars, got[None].text) == ("", 0, "") and pages.extract(df.limit(0), w).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs, labels, _ = labelled(spark, 300)
    r = random.Random(1)
    more = [(1000 + k, x.text) for k, x in enumerate(docs.limit(40).collect())]
    full = docs.union(spark.createDataFrame(more, "doc_id long, text string")).selectExpr("doc_id", "text", "'en' as lang", "concat('s', doc_id % 5) as source", "length(text) as n_chars")
    bench = spark.createDataFrame([(k, " ".join(x.text.split()[:14])) for k, x in enumerate(r.sample(docs.collect(), 20))], "item_id long, text string")
    for n, t in (("documents", full), ("labels", labels), ("benchmark", bench)):
        t.write.parquet(f"{tmp_path}/{n}.parquet")
    d = str(tmp_path)
    full, labels, bench = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    rows = [(x.doc_id, x.text) for x in full.collect()]
    good = {x.doc_id for x in quality.score(full, quality.fit(full, labels)).collect() if x.predicted == 1}
    clean = {x.doc_id for x in toxicity.score(full, toxicity.fit(full, labels)).collect() if x.predicted == 0}
    left = [x for x in rows if x[0] in good & clean]
    of = hamming_groups([brute_print(t) for _, t in left])
    first = {}
    for (i, _), g in zip(left, of, strict=True):
        first[g] = min(i, first.get(g, i))
    left = [x for x in left if x[0] in first.values()]
    left = {k[0] for k in brute_hits(left, [(x.item_id, x.text) for x in bench.collect()]) if not k[-1]}
    out = corpus_pipeline.run(spark, d).collect()
    assert {x.doc_id for x in out} == left
    tok = tokens.load(tokens.vocabulary_path())
    size = Counter()
    for x in out:
        size[x.doc_id] += x.n_tokens
    assert all(size[i] == len(tok.encode(t, add_special_tokens=False).ids) for i, t in rows if i in left)


@pytest.mark.parametrize("refine", [False, True])
def test_signatures_are_never_broadcast(spark, refine):
    """64 rows and more for each fingerprint, which Spark's estimate of the exploded table leaves out."""
    prints = spark.range(500).selectExpr("xxhash64(id) as f")
    grouped = prints.selectExpr("f", "f as c")
    for find, table in (("links", prints), ("links", grouped), ("stars", prints)):
        plan = getattr(simhash, find)(table, refine=refine)._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pipeline_merges_signatures(spark, monkeypatch):
    """Both joins over signatures of the pipeline's stage, also where Spark takes its table for a small one."""
    docs = [(k, f"text {k % 40} of some words and more words", "en", "a", "n", "f") for k in range(60)]
    plans, run = [], simhash.components
    monkeypatch.setattr(simhash, "components", lambda found: plans.append(found._jdf.queryExecution().executedPlan().toString()) or run(found))
    assert 0 < corpus_pipeline.simhash_stage(spark, spark.createDataFrame(docs, DOCS), "").count() <= 40
    assert len(plans) == 2 and all("SortMergeJoin [key" in p and "HashJoin [key" not in p for p in plans)


def test_pipeline_merges_what_grows(spark):
    """Tables with a row for each fingerprint or group aren't broadcast, also where Spark takes them for small ones."""
    docs = [(k, f"text {k % 40} of some words and more words", "en", "a", "n", "f") for k in range(60)]
    plan = corpus_pipeline.simhash_stage(spark, spark.createDataFrame(docs, DOCS), "")._jdf.queryExecution().executedPlan().toString()
    kept = [line for line in plan.splitlines() if "Join" in line and ("LeftSemi" in line or "least" in line or "[f#" in line)]
    assert kept and all("SortMergeJoin" in line for line in kept)


def test_full_cache_keeps_frequent_words():
    """A word that stands often is merged once, however many rare ones come after it."""
    r, enc, asked = random.Random(7), tokens.WordEncoder(cache_words=50), []
    rare = lambda: " ".join("".join(r.choices("qxzvjkw", k=9)) for _ in range(80))
    often = [f"zqxv{a}{b}" for a in "abcde" for b in "abcdefgh"]
    library = enc._library
    enc._library = lambda text: asked.append(text) or library(text)
    for k in range(6):
        text = " ".join([*often[:10] * 3, *often * 2, rare()])
        assert enc.count([text.encode()]) == [len(library(text))]
        assert len(enc.numbers) <= 25 + 40 + 80
    assert sum(t.split().count(w) for t in asked for w in often[:10]) == 10


def test_caches_of_other_operators_go(spark):
    """A worker that goes on to an operator without a cache does not keep that of the one before."""
    docs = spark.createDataFrame([(i, f"some words {i}. and others") for i in range(64)], "doc_id long, text string").repartition(4)
    model = toxicity.Model(np.zeros((1 << toxicity.BITS) + 1), -7.0, (4,))
    assert toxicity.score(docs, model).count() == 64

    def peek(batch, texts):
        return {"n": pa.array([len(common._held)] * len(texts), pa.int64())}

    assert {r.n for r in common.map_texts(docs, ["text"], "n bigint", peek).collect()} == {0}
