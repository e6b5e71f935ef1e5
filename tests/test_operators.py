"""Sites, rules, distances, orientation, comparison, network, files: small cases worked by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions import numerics, thresholds
from pairloom.operators import annotation, background, differential, distances, motifs, network, orientation, pairs, rules, sites
from pairloom.schema import SITE, Window
from pairloom.sources import files

W20 = Window(max_dist=20)


def test_measures(golden):
    r = {x.pair: x for x in rules.rules_of(golden, W20, rules.MEASURES).collect()}["A-B"]
    assert (r.n12, r.n1, r.n2) == (6, 4, 3)
    assert r.cosine == pytest.approx(6 / math.sqrt(12)) and r.confidence == 1.5 and r.lift == pytest.approx(500000) and r.jaccard == pytest.approx(6)


def test_keep_zero_and_selection(golden):
    full = rules.rules_of(golden, W20, keep_zero=True)
    assert full.count() == 9 and full.where("n12 = 0").count() == 5
    r = rules.rules_of(golden, W20)
    assert {x.pair for x in rules.simplify(r).collect()} == {"A-A", "A-B", "B-B"}
    assert [x.pair for x in rules.top(r, 2).collect()] == ["A-B", "B-A"]
    assert [x.pair for x in rules.named(r, ["B-B", "A-A"]).orderBy("place").collect()] == ["B-B", "A-A"]
    with pytest.raises(KeyError):
        rules.named(r, ["A-Z"])
    assert {x.pair for x in rules.with_labels(r, ["A"], "left").collect()} == {"A-A", "A-B"}


@pytest.mark.parametrize("chunk", [1 << 20, 9])
def test_overlaps(spark, chunk):
    rows = [(1, "c", 0, 10, "A", 1.0, "+"), (2, "c", 8, 15, "A", 3.0, "-"), (3, "c", 14, 20, "A", 2.0, "+"), (4, "c", 20, 25, "A", 5.0, "+")]
    df = spark.createDataFrame(rows, SITE)
    key = lambda d: sorted((r.start, r.end, r.score) for r in d.collect())
    assert key(sites.merge_overlaps(df, chunk=chunk)) == [(0, 20, 1.0), (20, 25, 5.0)]
    assert key(sites.keep_best(df, chunk=chunk)) == [(8, 15, 3.0), (20, 25, 5.0)]


def test_regions(golden, spark):
    reg = spark.createDataFrame([("chr1", 10, 13), ("chr1", 5, 30), ("chr2", 15, 16)], "contig string, start long, end long")
    assert {r.site_id for r in sites.subset_regions(golden, reg).collect()} == {1, 2, 3}
    assert {r.site_id for r in sites.flag_regions(golden, reg).where("overlap").collect()} == {1, 2, 3}


def test_histogram(golden, spark):
    wanted = spark.createDataFrame([("A", "B"), ("A", "A")], "name1 string, name2 string")
    get = lambda w: {(r.name2, r.distance): r.value for r in distances.count_distances(golden, wanted, w).where("value > 0").collect()}
    assert get(W20) == {("B", 0): 1, ("B", 1): 1, ("B", 2): 1, ("B", 5): 1, ("B", 20): 2, ("A", 5): 2, ("A", 15): 2}
    assert {k: v for k, v in get(W20.but(directional=True)).items() if k[0] == "B"} == {("B", 1): 1, ("B", 2): 1, ("B", 5): 1, ("B", 20): 1}


def test_undirected_orientation(golden):
    o = {(r.name1, r.name2): r for r in orientation.orientation(rules.rules_of(golden, W20.but(stranded=True))).collect()}
    ab, aa = o["A", "B"], o["A", "A"]
    assert (ab.same, ab.opposite, ab.std, ab.chi2, ab.pvalue) == (3, 3, 0, 0, 1)
    assert (aa.same, aa.opposite, aa.chi2) == (0, 2, 2) and ("C", "C") not in o


def test_peaks():
    assert numerics.find_peaks([0, 0, 5, 0], 1) == [(2, 5.0, 5.0)]
    assert numerics.find_peaks([4, 0, 0], 1) == [(0, 4.0, 4.0)]
    assert [p[0] for p in numerics.find_peaks([0, 3, 3, 3, 0, 3, 0], 1)] == [2, 5]
    assert numerics.find_peaks([0, 5, 3, 4, 0], 2) == [(1, 5.0, 5.0)]


def test_numerics():
    line = np.arange(30) * 2.0 + 1
    assert np.allclose(numerics.lowess(line), line) and np.allclose(numerics.lowess(np.full(9, 4.0)), 4)
    a = numerics.autocorrelation(np.sin(np.arange(64) * 2 * np.pi / 8))
    assert (np.abs(a) <= 1 + 1e-9).all()
    assert numerics.periodicity(np.sin(np.arange(81) * 2 * np.pi / 8))[0] == pytest.approx(8)
    s2, s4 = 3.841458820694124, 7.814727903251179
    x = math.sqrt(s2 * 100 / 4)
    assert numerics.uniform_p(np.array([50 + x, 50 - x])) == pytest.approx(0.05)
    y = math.sqrt(s4 * 25 / 2)
    assert numerics.uniform_p(np.array([25 + y, 25 - y, 25, 25])) == pytest.approx(0.05)
    assert numerics.hypergeometric_two_sided(3, 4, 4, 8) == pytest.approx(0.4857142857)
    assert numerics.cut_noise(np.array([1.0, 1, 9, 1, 1, 1]), [2]) == 1


def test_fits():
    rng = np.random.default_rng(1)
    kind, p = thresholds.fit(rng.normal(5, 2, 3000))
    assert kind in ("norm", "truncnorm", "lognorm", "weibull_min")
    assert thresholds._ppf(kind, 0.95, p) == pytest.approx(5 + 2 * 1.645, abs=0.3)
    assert thresholds.fit(rng.exponential(3, 3000))[0] in ("expon", "truncexpon", "weibull_min")


def test_signal_chain(golden, spark):
    wanted = spark.createDataFrame([("A", "B")], "name1 string, name2 string")
    c = distances.count_distances(golden, wanted, W20)
    s = distances.smooth(distances.scale(c), 3)
    assert {r.distance for r in s.collect()} == set(range(1, 20))
    p = distances.analyze(c, s, "flat", 0.1, smooth_window=3)
    assert p.count() and p.where("near <= total").count() == p.count()
    n = distances.noise(s, p)
    assert distances.rank(p.join(n, ["name1", "name2"])).where("mean_rank is not null").count() == p.count()


def test_background(golden):
    got = background.background_counts(golden, W20, 4)
    assert {r.seed for r in got.select("seed").distinct().collect()} <= {0, 1, 2, 3} and got.count()
    z = background.zscores(pairs.pair_counts(golden, W20), got, 4)
    rows = z.collect()
    per = {}
    for r in got.collect():
        per.setdefault((r.name1, r.name2), [0] * 4)[r.seed] = r.n
    for r in rows:
        v = np.array(per.get((r.name1, r.name2), [0] * 4), float)
        assert r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std())
        if v.std() == 0:
            assert r.zscore == (0 if r.n == v.mean() else math.copysign(math.inf, r.n - v.mean()))


def test_exact_background_is_a_sweep(golden):
    """Against a sweep that stops at the first site out of reach, over the same permutation."""
    rows = sorted(((r.contig, r.start, r.end, r.site_id, r.name) for r in golden.collect()))
    perm = np.random.RandomState(3).permutation(len(rows))
    new = []
    for k, (c, s, e, _, _) in enumerate(rows):
        _, s2, e2, _, name = rows[perm[k]]
        start = int(s + (e - s) / 2 - (e2 - s2) / 2)
        new.append((c, start, start + e2 - s2, name))
    want = {}
    for i, a in enumerate(new):
        for b in new[i + 1 :]:
            if b[0] != a[0] or (d := b[1] - a[2]) > 20:
                break
            short = min(a[2] - a[1], b[2] - b[1])
            if max(min(a[2], b[2]) - max(a[1], b[1]), 0) / short == 0 and max(d, 0) <= 20:
                want[a[3], b[3]] = want.get((a[3], b[3]), 0) + 1
    got = background.sweep_counts(background.exact_shuffle(golden, W20, 3), W20)
    assert {(r.name1, r.name2): r.n for r in got.collect()} == want


def test_differential(spark):
    make = lambda v: spark.createDataFrame([("A", b, float(x)) for b, x in v.items()], "name1 string, name2 string, cosine double")
    t = differential.combine({"x": make({"A": 1, "B": 4, "C": 0}), "y": make({"A": 2, "B": 6, "C": 8})})
    n = {r.name2: (r.x_cosine, r.y_cosine) for r in differential.normalize(t).collect()}
    assert n == {"A": (3.5, 1.0), "B": (6.0, 3.5), "C": (0.0, 6.0)}
    f = {r.name2: r["x/y_cosine_log2fc"] for r in differential.fold_changes(t).collect()}
    assert f["A"] == pytest.approx(math.log2(1.01 / 2.01))


def test_network(spark):
    edges = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("d", "e", 1.0), ("e", "f", 1.0), ("d", "f", 1.0), ("c", "d", 0.1)]
    label = network.louvain(edges)
    assert len(set(label.values())) == 2 and label["a"] == label["b"] == label["c"]
    assert network.modularity(edges, label) > network.modularity(edges, {x: x for x in "abcdef"})
    df = spark.createDataFrame([e[:2] for e in edges], "node1 string, node2 string")
    b = {r.node: r.betweenness for r in network.betweenness(df).collect()}
    assert b["c"] == 6 and b["a"] == 0
    assert {r.node: r.degree for r in network.degree(df).collect()}["c"] == 3
    assert network.neighbourhood(df, "a").count() == 3


def test_files(golden, spark, tmp_path):
    files.write_bed(golden, f"{tmp_path}/bed")
    back = files.read_bed(spark, f"{tmp_path}/bed")
    assert sorted((r.contig, r.start, r.name) for r in back.collect()) == sorted((r.contig, r.start, r.name) for r in golden.collect())
    files.save(f"{tmp_path}/all", {"sites": golden}, W20)
    tables, w = files.load(spark, f"{tmp_path}/all")
    assert w == W20 and tables["sites"].count() == 8
    (tmp_path / "f.gtf").write_text('c\tx\tgene\t11\t20\t.\t-\t.\tgene_id "g1"; gene_name "N";\n')
    g = files.read_gtf(spark, f"{tmp_path}/f.gtf").first()
    assert (g.start, g.end, g.strand, g.gene_name) == (10, 20, "-", "N")
    d = tmp_path / "foot" / "X" / "beds"
    d.mkdir(parents=True)
    (d / "X_cond_bound.bed").write_text("c\t1\t5\tX\t2.5\t+\n")
    assert files.read_footprints(spark, f"{tmp_path}/foot", "cond").first().score == 2.5
    with pytest.raises(ValueError, match="cond"):
        files.read_footprints(spark, f"{tmp_path}/foot", "other")


def test_motifs(spark, tmp_path):
    (tmp_path / "g.fa").write_text(">c1 x\nTTTTACGTTT\nTTTT\n>c2\nAACCGG\n")
    genome = files.read_fasta(spark, f"{tmp_path}/g.fa")
    assert {r.contig: r.seq for r in genome.collect()} == {"c1": "TTTTACGTTTTTTT", "c2": "AACCGG"}
    m = files.read_motifs(">M1 M\nA [ 9 0 0 ]\nC [ 0 9 0 ]\nG [ 0 0 9 ]\nT [ 0 0 0 ]\n")
    reg = spark.createDataFrame([("c1", 0, 14)], "contig string, start long, end long")
    found = {(r.start, r.end, r.strand) for r in motifs.scan(reg, genome, m, pvalue=0.02, resolve=None).collect()}
    assert found == {(4, 7, "+"), (5, 8, "-")}
    with pytest.raises(ValueError):
        files.check_bounds(spark.createDataFrame([("c2", 0, 99)], "contig string, start long, end long"), genome)


def test_annotation_and_terms(spark):
    reg = spark.createDataFrame([(1, "c", 90, 110), (2, "c", 100000, 100010)], "site_id long, contig string, start long, end long")
    feat = spark.createDataFrame([(1, "c", 300, 400, "+", "a"), (2, "c", 0, 95, "-", "b")], "f_id long, contig string, start long, end long, strand string, gene_name string")
    got = {r.site_id: (r.gene_name, r.distance) for r in annotation.annotate(reg, feat).collect()}
    assert got == {1: ("b", -5), 2: (None, None)}
    parents = spark.createDataFrame([("t3", "t2"), ("t2", "t1")], "term string, parent string")
    assert annotation.closure(parents).where(F.col("term") == "t3").count() == 3
    genes = spark.createDataFrame([(f"g{i}",) for i in range(4)], "gene string")
    owned = spark.createDataFrame([(f"g{i}", "t1" if i < 3 or i == 7 else "t2") for i in range(8)], "gene string, term string")
    terms = spark.createDataFrame([("t1", "p", 1, "x"), ("t2", "p", 1, "y")], "term string, aspect string, depth int, description string")
    e = {r.term: r for r in annotation.enrichment(genes, owned, terms).collect()}
    assert e["t1"].p == pytest.approx(0.4857142857) and e["t1"].direction == "increased" and e["t2"].direction == "decreased"
