"""Counting: the worked example, and random sites against a plain sweep."""

import itertools
import random
from collections import Counter

import pytest

from pairloom.operators import pairs
from pairloom.schema import SITE, Window

W20 = Window(max_dist=20)


def counts(df):
    return {(r.name1, r.name2): r.n for r in df.collect()}


@pytest.mark.parametrize(
    ("window", "directed", "whole"),
    [
        (W20, {"AA": 2, "AB": 4, "BA": 2, "BB": 1}, {"AA": 2, "AB": 6, "BA": 6, "BB": 1}),
        (W20.but(binarize=True), {"AA": 2, "AB": 2, "BA": 1, "BB": 1}, {"AA": 2, "AB": 3, "BA": 3, "BB": 1}),
        (W20.but(max_overlap=1), {"AA": 2, "AB": 4, "BA": 3, "BB": 1}, {"AA": 2, "AB": 7, "BA": 7, "BB": 1}),
        (W20.but(min_dist=5), {"AA": 2, "AB": 2, "BA": 1, "BB": 1}, {"AA": 2, "AB": 3, "BA": 3, "BB": 1}),
        (W20.but(anchor="outer"), {"AB": 1}, {"AB": 1, "BA": 1}),
        (W20.but(anchor="center"), {"AA": 1, "AB": 3, "BA": 1, "BB": 1}, {"AA": 1, "AB": 4, "BA": 4, "BB": 1}),
    ],
)
def test_worked_example(golden, window, directed, whole):
    d = pairs.directed_counts(golden, window)
    assert counts(d) == {tuple(k): n for k, n in directed.items()}
    assert counts(pairs.symmetric(d)) == {tuple(k): n for k, n in whole.items()}


def test_stranded(golden):
    got = counts(pairs.pair_counts(golden, W20.but(stranded=True)))
    assert {k: n for k, n in got.items() if k[0] <= k[1]} == {("A(+)", "A(-)"): 2, ("A(+)", "B(+)"): 2, ("A(+)", "B(-)"): 3, ("A(-)", "B(-)"): 1, ("B(+)", "B(-)"): 1}


def sweep(rows, w):
    """Sites in order, each looking on until its contig ends; what a binarized site has seen of its own label ends its counting."""
    mid = lambda r: (r[2] + r[3]) // 2
    order = sorted(rows, key=lambda r: (r[1], *([mid(r)] if w.anchor == "center" else []), r[2], r[3], r[0]))
    out = Counter()
    for i, a in enumerate(order):
        valid = []
        for b in order[i + 1 :]:
            if b[1] != a[1]:
                break
            d = {"inner": b[2] - a[3], "outer": b[3] - a[2], "center": mid(b) - mid(a)}[w.anchor]
            short = min(a[3] - a[2], b[3] - b[2])
            share = max(min(a[3], b[3]) - max(a[2], b[2]), 0) / short if short else None
            if w.min_dist <= max(d, 0) <= w.max_dist and (share is None or w.min_overlap <= share <= w.max_overlap):
                valid.append(b[4])
        if not w.binarize:
            out.update((a[4], n) for n in valid)
            continue
        own = valid.index(a[4]) if a[4] in valid else None
        for n in set(valid):
            if own is None or len(valid) - 1 - valid[::-1].index(n) <= own:
                out[a[4], n] += 1
    return dict(out)


@pytest.mark.parametrize("seed", range(3))
def test_against_sweep(spark, seed):
    r = random.Random(seed)
    rows = [(i, f"c{r.randint(0, 2)}", s := r.randint(0, 400), s + r.choice([0, 1, 5, 12, 90]), r.choice("ABCD"), 1.0, "+") for i in range(120)]
    df = spark.createDataFrame(rows, SITE).cache()
    for anchor, (lo, hi), (a, b), binarize in itertools.product(("inner", "outer", "center"), ((0, 30), (4, 60)), ((0, 0), (0, 1), (0.2, 0.8)), (False, True)):
        if r.random() < 0.6:
            continue
        w = Window(lo, hi, a, b, anchor, binarize=binarize)
        assert counts(pairs.directed_counts(df, w)) == sweep(rows, w), w
    # any width of bins gives the same
    w = Window(max_dist=30, max_overlap=1)
    assert pairs.window_pairs(df, w, width=3).count() == pairs.window_pairs(df, w, width=1000).count()


def test_nulls_and_empty(spark):
    rows = [(1, None, 0, 5, "A", None, None), (2, "c", None, 5, "A", None, None), (3, "c", 0, 5, None, None, "."), (4, "c", 6, 9, "B", None, None)]
    assert counts(pairs.directed_counts(spark.createDataFrame(rows, SITE), W20)) == {(None, "B"): 1}
    assert pairs.pair_counts(spark.createDataFrame([], SITE), W20).count() == 0


def test_orientation_of_a_pair(spark):
    from pyspark.sql import functions as F

    want = {"++": "1-2", "--": "2-1", "+-": "convergent", "-+": "divergent", "..": "NA", ".+": "away", ".-": "towards", "+.": "towards", "-.": "away"}
    df = spark.createDataFrame([(k[0], k[1]) for k in want], "a string, b string")
    got = df.select("a", "b", pairs.orientation_of(F.col("a"), F.col("b")).alias("o")).collect()
    assert {r.a + r.b: r.o for r in got} == want
