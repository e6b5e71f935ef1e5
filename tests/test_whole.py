"""The registered queries do the whole job: small tables on which a cut would show."""

import datetime
from collections import Counter

import numpy as np
import pytest

from pairloom.functions import thresholds
from pairloom.operators import background, network
from pairloom.plans import catalog

BRANDS = ["Brand#1", "Brand#13", "Brand#21", "Brand#34", "Brand#55"]


@pytest.fixture(scope="module")
def shipped(spark, tmp_path_factory):
    """(folder, rows): line items of five brands and three types, rows as (supplier, day, brand, type)."""
    d = tmp_path_factory.mktemp("shipped")
    part = [(k, BRANDS[k % 5], f"TYPE {k % 3}") for k in range(15)]
    items = [(k, 1, (k * 7 + k // 3) % 15, k % 6, datetime.date(1995, 1, 1) + datetime.timedelta(days=(k * k) % 90), float(1 + k % 50)) for k in range(150)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return str(d), [(x[3], x[4].toordinal(), *part[x[2]][1:]) for x in items]


def test_distances_of_every_label(spark, shipped, monkeypatch):
    d, rows = shipped
    want = Counter()
    for i, (s, x, a, _) in enumerate(rows):
        for t, y, b, _ in rows[:i]:
            if s == t and 0 <= (far := max(abs(x - y) - 1, -1)) <= 100:
                want[a, b, far] += 1
                want[b, a, far] += 1
    got = {(r.name1, r.name2, r.distance): r.value for r in catalog._hist(spark, d, of=catalog._every).where("value > 0").collect()}
    assert got == want
    seen, real = [], catalog.distances.count_distances
    monkeypatch.setattr(catalog.distances, "count_distances", lambda sites, rules, *w, **more: seen.append(rules) or real(sites, rules, *w, **more))
    for name in ("dist_background", "dist_peaks", "dist_preferred", "dist_noise", "dist_rank", "dist_hubs", "dist_count_peaks", "dist_classify", "dist_periodicity", "dist_autocorrelation"):
        seen.clear()
        catalog.QUERIES[name](spark, d)
        assert {(r.name1, r.name2) for r in seen[0].collect()} == {(a, b) for a in BRANDS for b in BRANDS}


def test_enrichment_over_every_line_item(spark, shipped):
    d, rows = shipped
    owners = {}
    for s, _, brand, kind in rows:
        owners.setdefault(brand, set()).add(s)
        owners.setdefault(kind, set()).add(s)
    seen = {}

    def spy(genes, owned, terms):
        seen["owned"] = {(r.term, int(r.gene)) for r in owned.collect()}
        return genes

    with pytest.MonkeyPatch.context() as m:
        m.setattr(catalog.annotation, "enrichment", spy)
        catalog.QUERIES["enrichment"](spark, d)
    assert seen["owned"] == {(t, s) for t, of in owners.items() for s in of}


def test_networks_of_every_edge(spark, monkeypatch):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3), ("d", "e", 4), ("e", "a", 6)], "node1 string, node2 string, n12 long")
    monkeypatch.setattr(catalog, "_edges", lambda *_: edges)
    assert {r.node: r.betweenness for r in catalog.QUERIES["net_betweenness"](spark, "").collect()} == dict.fromkeys("abcde", 1.0)
    assert {r.node for r in catalog.QUERIES["net_blockmodel"](spark, "").collect()} == set("abcde")
    assert [(r.degree, r.n) for r in catalog.QUERIES["net_powerlaw"](spark, "").collect()] == [(2, 5)]


def test_more_than_twelve_blocks():
    group = lambda k: [f"{k:02}-{i:02}" for i in range(14)]
    edges = [(a, b, 1.0) for k in range(16) for a in group(k) for b in group(k) if a <= b]
    got = network.blockmodel(edges)
    assert len(set(got.values())) > 12


@pytest.mark.parametrize(("name", "exact"), [("background_zscore", False), ("background_exact", True)])
def test_background_of_fifty_shuffles(spark, golden, monkeypatch, name, exact):
    monkeypatch.setattr(catalog.I, "sites", lambda *_: golden)
    seen = {}
    monkeypatch.setattr(background, "exact_shuffle", lambda sites, window, seed, *_: seen.setdefault(seed, sites))
    monkeypatch.setattr(background, "sweep_counts", lambda both, w: golden.limit(0).selectExpr("0 as seed", "name as name1", "name as name2", "start as n"))
    monkeypatch.setattr(background, "directed_counts", lambda s, w, extra: seen.update(dict.fromkeys(r.seed for r in s.select("seed").distinct().collect())) or golden.limit(0).selectExpr("0 as seed", "name as name1", "name as name2", "start as n"))
    catalog.QUERIES[name](spark, "")
    assert set(seen) == set(range(50))


def test_fit_of_many_equal_values(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([np.full(11_000, 0.5), rng.normal(5, 2, 9_000)])
    table = spark.createDataFrame([(float(v),) for v in x], "v double")
    kind, p = thresholds.fit(x)
    assert thresholds.threshold(table, "v") == pytest.approx((thresholds._ppf(kind, 0.05, p), thresholds._ppf(kind, 0.95, p)), rel=1e-3)
    for y in (x, x[:11_001], x[10_990:11_010]):
        v, n = np.unique(y, return_counts=True)
        assert thresholds.fit(v, n)[0] == thresholds.fit(y)[0]
