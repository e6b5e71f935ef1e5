"""Brute force over the registered queries that SQL cannot express."""

import datetime
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from pairloom.functions import numerics
from pairloom.operators import background, distances, network
from pairloom.plans import catalog
from pairloom.schema import Window


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with events of three users and line items of four brands."""
    d = tmp_path_factory.mktemp("tables")
    r = random.Random(41)
    start = datetime.datetime(2024, 1, 1)
    events = [(k, r.randint(1, 3), start + datetime.timedelta(seconds=r.randint(0, 9000)), r.choice(["click", "view", "purchase", "error"]), round(r.uniform(-5, 20), 2)) for k in range(160)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{d}/events.parquet")
    part = [(k, f"Brand#{11 + k % 4}", f"TYPE {k % 3}") for k in range(12)]
    items = [(k, 1, r.randrange(12), r.randint(1, 3), datetime.date(1995, 1, 1) + datetime.timedelta(days=int(r.triangular(0, 300, 60))), 5.0) for k in range(400)]
    spark.createDataFrame(part, "p_partkey long, p_brand string, p_type string").write.parquet(f"{d}/part.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    return str(d)


def sites_of(spark, d):
    rows = [(r.contig, r.start, r.end, r.site_id, r.name, r.strand, r.score) for r in catalog.I.sites(spark, d).collect()]
    return sorted(rows)


def refit(sites, source):
    out = []
    for (c, s, e, i, *_), k in zip(sites, source, strict=True):
        n = sites[k][2] - sites[k][1]
        a = math.trunc(s + (e - s) / 2 - n / 2)
        out.append((c, a, a + n, i, sites[k][4]))
    return out


def swept(rows, w):
    """Directed counts of a sweep that ends at the first later site out of reach."""
    n = Counter()
    for k, (c, s, e, _, name) in enumerate(rows):
        for c2, s2, e2, _, name2 in rows[k + 1 :]:
            if c2 != c or s2 - e > w.max_dist:
                break
            short = min(e - s, e2 - s2)
            share = max(min(e, e2) - max(s, s2), 0) / short if short else 0
            if w.min_dist <= max(s2 - e, 0) <= w.max_dist and w.min_overlap <= share <= w.max_overlap:
                n[name, name2] += 1
    return n


def whole(n):
    return Counter({(a, b): n[a, b] + (n[b, a] if a != b else 0) for a, b in {*n, *((b, a) for a, b in n)}})


@pytest.mark.parametrize("exact", [False, True])
def test_zscores(spark, tables, exact):
    sites, w, seeds = sites_of(spark, tables), Window(max_dist=400), 5
    n = len(sites)
    frame = catalog.I.sites(spark, tables)
    shuffles = []
    for seed in range(seeds):
        source = np.random.RandomState(seed).permutation(n) if exact else background.permuted(np.arange(n), np.full(n, seed), n)
        assert sorted(source.tolist()) == list(range(n))
        rows = refit(sites, source.tolist())
        # the sweep takes the places as they lie, the join sorts them anew
        shuffles.append(whole(swept(rows if exact else sorted(rows), w)))
    got = background.zscores(catalog.pairs.pair_counts(frame, w), background.background_counts(frame, w, seeds, exact), seeds).collect()
    seen = whole(swept([(c, s, e, i, name) for c, s, e, i, name, *_ in sites], w))
    assert {(r.name1, r.name2): r.n for r in got} == {k: v for k, v in seen.items() if v}
    for r in got:
        x = [s[r.name1, r.name2] for s in shuffles]
        std = float(np.std(x))
        z = (r.n - np.mean(x)) / std if std else 0.0 if r.n == x[0] else math.copysign(math.inf, r.n - x[0])
        assert (r.mean, r.std) == pytest.approx((np.mean(x), std)) and r.zscore == pytest.approx(z)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_permutations(n):
    for seed in (0, 1, 49):
        assert sorted(background.permuted(np.arange(n), np.full(n, seed), n).tolist()) == list(range(n))
    if n > 60:
        a, b = (background.permuted(np.arange(n), np.full(n, s), n) for s in (0, 1))
        assert (a == b).mean() < 0.2 and abs(np.corrcoef(np.arange(n), a)[0, 1]) < 0.35


def slow_lowess(y, frac, passes=3):
    n = len(y)
    k = min(n, max(2, int(frac * n + 1e-10)))
    robust, fit = [1.0] * n, list(y)
    for _ in range(passes + 1):
        for i in range(n):
            reach = sorted(abs(i - j) for j in range(n))[k - 1]
            w = [robust[j] * max(0, 1 - (abs(i - j) / reach) ** 3) ** 3 for j in range(n)]
            t = sum(w) or 1
            mx, my = sum(a * j for j, a in enumerate(w)) / t, sum(a * b for a, b in zip(w, y)) / t
            vx = sum(a * (j - mx) ** 2 for j, a in enumerate(w))
            fit[i] = my + (sum(a * (j - mx) * (y[j] - my) for j, a in enumerate(w)) / vx * (i - mx) if vx > 1e-12 else 0)
        r = [abs(a - b) for a, b in zip(y, fit)]
        s = 6 * float(np.median(r))
        if s < 1e-12:
            break
        robust = [max(0, 1 - (x / s) ** 2) ** 2 for x in r]
    return fit


def signals(spark, d, **more):
    out = defaultdict(dict)
    for r in catalog._hist(spark, d, **more).collect():
        out[r.name1, r.name2][r.distance] = r.value
    return {k: [v[i] for i in sorted(v)] for k, v in out.items()}


def scaled(y):
    lo, hi = min(y), max(y)
    return [(v - lo) / (hi - lo) if hi > lo else 0.0 for v in y]


def slow_peaks(y, least):
    x, out, i = [0.0, *y, 0.0], [], 1
    while i < len(x) - 1:
        j = i
        while j + 1 < len(x) and x[j + 1] == x[i]:
            j += 1
        if j + 1 < len(x) and x[i - 1] < x[i] > x[j + 1]:
            at = (i + j) // 2
            sides = []
            for part in (x[at::-1], x[at:]):
                higher = next((k for k, v in enumerate(part) if v > x[at]), len(part))
                sides.append(min(part[:higher]))
            if x[at] >= least and x[at] - max(sides) >= least:
                out.append((at - 1, x[at], x[at] - max(sides)))
        i = j + 1
    return out


def test_background_of_distances_and_preferred_ones(spark, tables):
    series = signals(spark, tables)
    curve = defaultdict(dict)
    for r in catalog.QUERIES["dist_background"](spark, tables).collect():
        curve[r.name1, r.name2][r.distance] = (r.value, r.background)
    want = set()
    for pair, y in series.items():
        y0 = scaled(y)
        fit = slow_lowess(y0, 0.66)
        assert [curve[pair][i] for i in range(101)] == [pytest.approx((v - f, f), abs=1e-7) for v, f in zip(y0, fit)]
        smooth = [(y0[i - 1] + y0[i] + y0[i + 1]) / 3 for i in range(1, 100)]
        z = np.array(smooth) - slow_lowess(smooth, 0.66)
        z = (z - z.mean()) / z.std() if z.std() > 0 else z * 0
        if sum(y[1:100]) >= 1:
            for at, height, prominence in slow_peaks(z.tolist(), 2.0):
                d = at + 1
                near = sum(y[max(1, d - 1) : min(99, d + 1) + 1])
                want.add((*pair, d, round(height, 5), round(prominence, 5), sum(y[1:100]), near))
    got = {(r.name1, r.name2, r.distance, round(r.height, 5), round(r.prominence, 5), r.total, r.near) for r in catalog.QUERIES["dist_preferred"](spark, tables).collect()}
    assert got == want and want


def test_ranks(spark, tables):
    signal, peaks = catalog._signal_and_peaks(spark, tables)
    noise = {(r.name1, r.name2): r.noisiness for r in distances.noise(signal, peaks).collect()}
    rows = [(r.asDict() | {"noisiness": noise[r.name1, r.name2]}) for r in peaks.collect()]
    rank = {c: {v: k for k, v in enumerate(sorted({x[c] for x in rows}, reverse=c != "noisiness"), 1)} for c in ("percent", "height", "noisiness")}
    got = {(r.name1, r.name2, r.distance): (r.rank_percent, r.rank_height, r.rank_noisiness, r.mean_rank) for r in catalog.QUERIES["dist_rank"](spark, tables).collect()}
    for x in rows:
        k = [rank[c][x[c]] for c in ("percent", "height", "noisiness")]
        assert got[x["name1"], x["name2"], x["distance"]] == (*k, pytest.approx(sum(k) / 3))
    assert len(got) == len(rows) > 0


def test_orientation_p(spark, tables):
    rows = catalog.QUERIES["orient_pvalues"](spark, tables).collect()
    assert rows
    for r in rows:
        e = r.total / 2
        chi = (r.same - e) ** 2 / e + (r.opposite - e) ** 2 / e
        assert r.chi2 == pytest.approx(chi, abs=1e-9) and r.pvalue == pytest.approx(math.erfc(math.sqrt(chi / 2)))
    # four scenarios: three degrees of freedom, by numeric integration of the density
    for counts in ([5, 9, 2, 4], [3, 3, 3, 3], [50, 1, 1, 1]):
        e = sum(counts) / 4
        chi = sum((c - e) ** 2 / e for c in counts)
        t = np.linspace(math.sqrt(chi), 60, 400_001)
        y = t * t * np.exp(-t * t / 2)
        area = float(((y[1:] + y[:-1]) / 2 * np.diff(t)).sum()) * math.sqrt(2 / math.pi)
        assert numerics.uniform_p(np.array(counts)) == pytest.approx(area, rel=1e-5, abs=1e-12)


def test_animation(spark, tables):
    values = defaultdict(dict)
    framed = catalog._framed(spark, tables)
    for r in catalog.signals.window_values(framed, catalog._signal(spark, tables)).collect():
        values[r.pair_id][r.position] = r.value
    order = [r.pair_id for r in sorted(framed.collect(), key=lambda r: (r.distance, r.site1_rel_start, r.pair_id))]
    got = {(r.frame, r.position): r.value for r in catalog.QUERIES["signal_animation"](spark, tables).collect()}
    want = {}
    for frame in range((len(order) - 1) // 25 + 1):
        group = order[frame * 25 : frame * 25 + 50]
        for position in range(120):
            want[frame, position] = pytest.approx(np.mean([values[p][position] for p in group]))
    assert got == want and want


def test_clustered_labels(spark, tables):
    rows = sorted((r.contig, r.start, r.end, r.site_id, r.name) for r in catalog.I.sites(spark, tables, contigs=4).collect())
    size, both = Counter(), Counter()
    for c, s, e, _, n in rows:
        size[n] += e - s
        for c2, s2, e2, _, n2 in rows:
            if c == c2 and n < n2 and s < e2 and s2 < e:
                both[n, n2] += min(e, e2) - max(s, s2)
    share = lambda a, b: both[min(a, b), max(a, b)] / min(size[a], size[b])
    groups = [[n] for n in sorted(size)]
    while len(groups) > 1:
        best = max(itertools.combinations(groups, 2), key=lambda g: np.mean([share(a, b) for a in g[0] for b in g[1]]))
        if np.mean([share(a, b) for a in best[0] for b in best[1]]) < 0.00001:
            break
        groups = [g for g in groups if g not in best] + [sorted(best[0] + best[1])]
    of = {n: "/".join(g) for g in groups for n in g}
    want, last = Counter(), {}
    for c, s, e, _, n in rows:
        k = c, of[n]
        if s >= last.get(k, -1):
            want[of[n]] += 1
        last[k] = max(e, last.get(k, -1))
    assert {r.name: r.n for r in catalog.QUERIES["site_cluster_labels"](spark, tables).collect()} == want


def graph(seed, n=9, p=0.35):
    r = random.Random(seed)
    return [(a, b) for a, b in itertools.combinations("abcdefghijklmnop"[:n], 2) if r.random() < p]


@pytest.mark.parametrize("seed", range(3))
def test_betweenness(spark, seed):
    edges = graph(seed)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    score = dict.fromkeys(near, 0.0)
    for s, t in itertools.combinations(sorted(near), 2):
        paths, level = [], [[s]]
        while level and not paths:
            level = [[*x, y] for x in level for y in near[x[-1]] if y not in x]
            paths = [x for x in level if x[-1] == t]
        for x in paths:
            for v in x[1:-1]:
                score[v] += 1 / len(paths)
    got = {r.node: r.betweenness for r in network.betweenness(spark.createDataFrame(edges, "node1 string, node2 string")).collect()}
    assert got == {v: pytest.approx(x) for v, x in score.items()}


def modularity(edges, of):
    total = sum(w for *_, w in edges)
    inside, degree = Counter(), Counter()
    for a, b, w in edges:
        degree[of[a]] += w
        degree[of[b]] += w
        inside[of[a]] += w * (of[a] == of[b])
    return sum(inside[c] / total - (degree[c] / (2 * total)) ** 2 for c in degree)


def test_louvain_is_settled():
    """No two communities would be better as one: where the method stops, which need not be at the best of all partitions."""
    for seed in range(12):
        edges = [(a, b, 1.0 + (ord(a) * ord(b)) % 3) for a, b in graph(seed, 14, 0.25)]
        of = network.louvain(edges)
        now = modularity(edges, of)
        assert now >= modularity(edges, {x: x for x in of})
        for x, y in itertools.combinations(sorted(set(of.values())), 2):
            assert modularity(edges, {v: x if c == y else c for v, c in of.items()}) <= now + 1e-9


def test_network_queries(spark, monkeypatch):
    names = [f"{g}{i}" for g in "xyz" for i in range(5)]
    edges = [(a, b, 1.0) for a, b in itertools.combinations(names, 2) if a[0] == b[0]] + [("x0", "y0", 0.1), ("y1", "z1", 0.1), ("x2", "z2", 0.1)]
    frame = spark.createDataFrame(edges, "node1 string, node2 string, cosine double")
    monkeypatch.setattr(catalog, "_edges", lambda *_: frame)
    for name in ("net_louvain", "net_blockmodel"):
        rows = catalog.QUERIES[name](spark, "").collect()
        label = next(c for c in rows[0].__fields__ if c != "node")
        groups = defaultdict(set)
        for r in rows:
            groups[r[label]].add(r.node[0])
        assert len(groups) == 3 and all(len(g) == 1 for g in groups.values()) and len(rows) == 15
    degree = Counter(x for a, b, _ in edges for x in (a, b))
    rows = catalog.QUERIES["net_powerlaw"](spark, "").collect()
    assert {r.degree: r.n for r in rows} == Counter(degree.values())
    loss = lambda a: len(degree) * math.log(sum(k**-a for k in range(1, 200_000)) + 200_000 ** (1 - a) / (a - 1)) + a * sum(math.log(x) for x in degree.values())
    a = rows[0].exponent
    assert loss(a) <= min(loss(a - 0.01), loss(a + 0.01)) + 1e-3


def test_random_network(spark, monkeypatch):
    for n in (2, 3, 25, 40):
        names = [f"n{i:02}" for i in range(n)]
        nodes = spark.createDataFrame([(x,) for x in names], "node string")
        got = [(r.node1, r.node2) for r in network.random_network(nodes, 60, seed=n).collect()]
        every = list(itertools.combinations(names, 2))
        drawn = sorted({int(k) for k in np.random.default_rng(n).integers(0, len(every), 60)})
        assert got == [every[k] for k in drawn]


def test_long_chain(spark):
    """Sites that all overlap are walked in order, one held at a time."""
    from pairloom.operators import sites as S

    r = random.Random(43)
    rows = [(k, "c", 3 * k, 3 * k + 10, r.choice("ab"), float(r.randint(0, 9)), "+") for k in range(3000)]
    rows += [(5000 + k, "d", 7 * k, 7 * k + r.choice([5, 12]), "a", None if k % 5 == 0 else float(k % 3), "+") for k in range(300)]
    df = spark.createDataFrame(rows, catalog.files.SITE).repartition(5)
    for per_name in (True, False):
        want, last = set(), {}
        for x in sorted(rows, key=lambda x: (x[1], x[2], x[3], x[0])):
            k = (x[1], x[4]) if per_name else x[1]
            if k in last and x[2] < last[k][3]:
                if x[5] is None or last[k][5] is None or x[5] < last[k][5]:
                    continue
                want.discard(last[k][0])
            want.add(x[0])
            last[k] = x
        assert {r.site_id for r in S.keep_best(df, per_name).collect()} == want


def odd_sites(spark):
    r = random.Random(23)
    rows = []
    for k in range(700):
        a = r.choice([r.randint(-300, 3000), r.randint(0, 200), 7 * r.randint(0, 40)])
        rows.append((k, r.choice(["c1", "c1", "c1", "c2", "c3"]), a, a + r.choice([0, 1, 1, 5, 12, 30]), r.choice("ABCD"), 1.0, r.choice("+-")))
    rows += [(700, "c1", 100, 260, "A", 1.0, "+"), (701, None, 5, 9, "B", 1.0, "+"), (702, "c2", None, 9, "A", 1.0, "+"), (703, "c2", 4, None, "C", 1.0, "-"), (704, "c3", 50, 60, None, 1.0, "+")]
    return spark.createDataFrame(rows, "site_id long, contig string, start long, end long, name string, score double, strand string")


WINDOWS = [Window(max_dist=20), Window(min_dist=3, max_dist=40, max_overlap=0.5), Window(max_dist=60, anchor="outer", directional=True), Window(max_dist=25, anchor="center", max_overlap=1, stranded=True)]


@pytest.mark.parametrize("window", WINDOWS)
def test_background_over_blocks_is_that_of_the_join(spark, monkeypatch, window):
    monkeypatch.setattr(background, "BLOCK", 40)
    frame, w = odd_sites(spark), window.but(stranded=False)
    got = background.background_counts(frame, window, 3)
    want = background.pairs.directed_counts(background.shuffled_sites(frame, window, [0, 1, 2]), w, extra=("seed",))
    want = want if window.directional else background.pairs.symmetric(want, ("seed",))
    rows = lambda df: Counter((r.seed, r.name1, r.name2, r.n) for r in df.collect())
    assert rows(got) == rows(want) and got.count() > 10


@pytest.mark.parametrize("window", WINDOWS[:2])
def test_exact_background_over_blocks(spark, monkeypatch, window):
    monkeypatch.setattr(background, "BLOCK", 40)
    frame = odd_sites(spark).where("contig is not null and start is not null and end is not null and name is not null")
    rows = sorted((r.contig, r.start, r.end, r.site_id, r.name) for r in frame.collect())
    want = Counter()
    for seed in range(3):
        for (a, b), n in whole(swept(refit(rows, np.random.RandomState(seed).permutation(len(rows)).tolist()), window)).items():
            want[seed, a, b] += n
    got = background.background_counts(frame, window, 3, exact=True).collect()
    assert {(r.seed, r.name1, r.name2): r.n for r in got} == {k: n for k, n in want.items() if n}


def test_exact_background_has_no_bound(spark, monkeypatch):
    """More sites than exact mode took once (5 million there, three here)."""
    monkeypatch.setattr(background, "MOST_EXACT", 3, raising=False)
    frame = odd_sites(spark)
    got = background.background_counts(frame, Window(max_dist=20), 2, exact=True)
    assert frame.count() > 3 and {r.seed for r in got.collect()} == {0, 1}


@pytest.mark.parametrize("n", [1, 2, 1000, 5_000_001])
def test_drawn_permutations(n):
    """Those of numpy, in half the bytes."""
    got = background._drawn(7, n)
    assert got.dtype == np.int32 and (got == np.random.RandomState(7).permutation(n)).all()


@pytest.mark.parametrize(("longest", "size"), [(0, 1), (127, 1), (128, 2), (40_000, 4), (1 << 40, 8)])
def test_lengths_take_few_bytes(spark, longest, size):
    placed = spark.createDataFrame([(1, "a", 5, 5 + longest), (0, "b", 9, 9 - longest), (2, "a", None, 3)], "pos long, name string, start long, end long")
    names, n, codes, lengths = background._labels(background._label_file(placed, ["a", "b"], longest))
    assert lengths.itemsize == size and lengths.tolist() == [-longest, longest, background._none(lengths.dtype)]
    assert [names[c] for c in codes] == ["b", "a", "a"]


def test_a_permutation_is_drawn_by_few_tasks(spark, monkeypatch):
    """Not again for every partition of the sites, and not all of them by one task."""
    counted, seen = background.sweep_counts, []
    monkeypatch.setattr(background, "sweep_counts", lambda blocks, w: seen.append(blocks) or counted(blocks, w))
    background.background_counts(odd_sites(spark), Window(max_dist=20), 8, exact=True)
    assert seen[0].rdd.getNumPartitions() == 16


@pytest.mark.parametrize("exact", [False, True])
def test_shuffles_move_no_sites(spark, exact):
    """Only counts are shuffled, however many shuffles there are; no join for each of them."""
    plan = background.background_counts(odd_sites(spark), Window(max_dist=20), 4, exact)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan


def test_sites_are_never_broadcast(spark):
    plan = background.pairs.pair_counts(odd_sites(spark), Window(max_dist=20))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
