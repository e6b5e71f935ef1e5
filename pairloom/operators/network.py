"""The network of labels whose edges are rules."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairloom.functions.storage import checkpointed
from pairloom.schema import one_of


def node_attributes(edges: DataFrame, node: str) -> list[str]:
    """Columns that tell about the node alone: one value for each node, and one node for each value."""
    others = [c for c in edges.columns if c != node]
    if not others:
        return []
    row = edges.agg(F.countDistinct(F.col(node)).alias("n"), *[F.countDistinct(F.col(c)).alias(f"v{i}") for i, c in enumerate(others)], *[F.countDistinct(F.struct(node, c)).alias(f"b{i}") for i, c in enumerate(others)]).first()
    return [c for i, c in enumerate(others) if row["n"] == row[f"v{i}"] == row[f"b{i}"]]


def build(edges: DataFrame, node1: str = "name1", node2: str = "name2", order: list | None = None, nodes: DataFrame | None = None, multi: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): unless multi the first edge of each two nodes in `order` stays, whichever way it points."""
    e = edges.withColumnRenamed(node1, "node1").withColumnRenamed(node2, "node2")
    if not multi:
        w = W.partitionBy(F.least("node1", "node2"), F.greatest("node1", "node2")).orderBy(*(order or []), "node1", "node2")
        e = e.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    # a row for each pair of labels, used for the nodes and by what is done with the edges
    e = checkpointed(e)
    v = e.select(F.col("node1").alias("node")).union(e.select("node2")).distinct()
    if nodes is not None:
        v = v.join(nodes, "node", "left")
    return v, e


def degree(edges: DataFrame, weight: str | None = None, direction: str = "both") -> DataFrame:
    """(node, degree): edges, or their weights, summed up; a loop counts at both its ends."""
    one_of(direction, ("both", "in", "out"), "direction")
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("double")
    # a node without edges that way has degree 0
    ends = edges.select(F.col("node1").alias("node"), (w if direction != "in" else F.lit(0.0)).alias("w")).unionAll(edges.select(F.col("node2").alias("node"), (w if direction != "out" else F.lit(0.0)).alias("w")))
    return ends.groupBy("node").agg(F.sum("w").alias("degree"))


#: Edges that a search on the driver takes; of a larger network rules have to be selected first.
MOST_EDGES = 5_000_000


def gathered(edges: DataFrame, *cols) -> list:
    """The edges on the driver, if there are not too many; a network of labels has at most a row for every two of them."""
    rows = edges.select(*cols).limit(MOST_EDGES + 1).collect()
    if len(rows) > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges; select rules first")
    return rows


def louvain(edges: list[tuple[str, str, float]], seed: int = 1) -> dict[str, str]:
    """Communities of the best modularity that local moves and merging find; labels from "1"."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    number = {x: i for i, x in enumerate(nodes)}
    graph: list[dict[int, float]] = [defaultdict(float) for _ in nodes]
    for a, b, w in edges:
        i, j = number[a], number[b]
        graph[i][j] += w
        if i != j:
            graph[j][i] += w
    of = list(range(len(nodes)))
    rng = random.Random(seed)
    while True:
        n = len(graph)
        k = [sum(g.values()) + g.get(i, 0.0) for i, g in enumerate(graph)]
        m2 = sum(k)
        if m2 <= 0:
            break
        com, total = list(range(n)), k[:]
        moved_any, order = False, list(range(n))
        rng.shuffle(order)
        improved = True
        while improved:
            improved = False
            for i in order:
                c = com[i]
                to: dict[int, float] = defaultdict(float)
                for j, w in graph[i].items():
                    if j != i:
                        to[com[j]] += w
                total[c] -= k[i]
                best, gain = c, to.get(c, 0.0) - total[c] * k[i] / m2
                for d in sorted(to):
                    g = to[d] - total[d] * k[i] / m2
                    if g > gain + 1e-12:
                        best, gain = d, g
                total[best] += k[i]
                if best != c:
                    com[i] = best
                    improved = moved_any = True
        if not moved_any:
            break
        names = {c: x for x, c in enumerate(sorted(set(com)))}
        of = [names[com[c]] for c in of]
        merged: list[dict[int, float]] = [defaultdict(float) for _ in names]
        for i, g in enumerate(graph):
            for j, w in g.items():
                a, b = names[com[i]], names[com[j]]
                if a == b:
                    merged[a][a] += w if i == j else w / 2
                else:
                    merged[a][b] += w
        graph = merged
    order = {c: x for x, c in enumerate(dict.fromkeys(of))}
    return {x: str(order[c] + 1) for x, c in zip(nodes, of, strict=True)}


def modularity(edges: list[tuple[str, str, float]], label: dict[str, str]) -> float:
    m = sum(w for _, _, w in edges)
    k: dict[str, float] = defaultdict(float)
    inside = 0.0
    for a, b, w in edges:
        k[a] += w
        k[b] += w
        inside += w * (label[a] == label[b])
    total: dict[str, float] = defaultdict(float)
    for x, v in k.items():
        total[label[x]] += v
    return inside / m - sum((v / (2 * m)) ** 2 for v in total.values())


def blockmodel(edges: list[tuple[str, str, float]], seed: int = 1) -> dict[str, str]:
    """Blocks of a stochastic block model: the partition of the shortest description that greedy moves find, over all numbers of blocks.

    Numbers whose own cost is above the best description found cannot be better, as the cost of the edges is never negative.
    """
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {x: i for i, x in enumerate(nodes)}
    adj = np.zeros((len(nodes), len(nodes)))
    for a, b, _ in edges:
        adj[at[a], at[b]] = adj[at[b], at[a]] = 1
    most_edges = math.log(max(2, len(edges)))

    def own_cost(q: int) -> float:
        return len(nodes) * math.log(q) + q * (q + 1) / 2 * most_edges

    def bits(e: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        p = np.divide(e, pairs, out=np.zeros_like(e), where=pairs > 0)
        with np.errstate(all="ignore"):
            return pairs * (-np.nan_to_num(p * np.log(p)) - np.nan_to_num((1 - p) * np.log(1 - p)))

    def cost(z: np.ndarray, q: int) -> float:
        one = np.eye(q)[z]
        return float(bits(one.T @ adj @ one, np.outer(one.sum(0), one.sum(0))).sum() / 2 + own_cost(q))

    def moves(e: np.ndarray, n: np.ndarray, k: np.ndarray, loop: float) -> np.ndarray:
        """The cost of the edges with a node of k edges to the blocks in each of them; e and n are without it."""
        old = bits(e, np.outer(n, n))
        row, pairs = e + k, np.outer(n + 1, n)
        np.fill_diagonal(row, e.diagonal() + 2 * k + loop)
        np.fill_diagonal(pairs, (n + 1) ** 2)
        new = bits(row, pairs)
        return (old.sum() - 2 * old.sum(1) + old.diagonal() + 2 * new.sum(1) - new.diagonal()) / 2

    rng = np.random.default_rng(seed)
    best, found = math.inf, np.zeros(len(nodes), int)
    for q in range(1, len(nodes) + 1):
        if own_cost(q) >= best:
            break
        z = rng.integers(0, q, len(nodes))
        now = cost(z, q)
        for _ in range(20):
            before = now
            one = np.eye(q)[z]
            e, n = one.T @ adj @ one, one.sum(0)
            for i in range(len(nodes)):
                old, loop = z[i], adj[i, i]
                k = np.bincount(z, adj[i], q)
                k[old] -= loop
                e[old] -= k
                e[:, old] -= k
                e[old, old] -= loop
                n[old] -= 1
                tried = moves(e, n, k, loop)
                if tried[old] > tried.min() + 1e-9:
                    z[i] = int(np.argmin(tried))
                e[z[i]] += k
                e[:, z[i]] += k
                e[z[i], z[i]] += loop
                n[z[i]] += 1
            now = cost(z, q)
            if now >= before - 1e-9:
                break
        if now < best:
            best, found = now, z.copy()
    return {x: str(int(c) + 1) for x, c in zip(nodes, found, strict=True)}


def cluster(edges: DataFrame, method: str = "louvain", weight: str | None = None, seed: int = 1) -> DataFrame:
    """(node, cluster). The driver holds the edges: labels and their rules are few, however many sites there are."""
    one_of(method, ("louvain", "blockmodel"), "method")
    rows = [(r[0], r[1], float(r[2])) for r in gathered(edges, "node1", "node2", F.col(weight) if weight else F.lit(1.0))]
    label = louvain(rows, seed) if method == "louvain" else blockmodel(rows, seed)
    return edges.sparkSession.createDataFrame(sorted(label.items()), "node string, cluster string")


def betweenness(edges: DataFrame) -> DataFrame:
    """(node, betweenness): how many shortest paths between two others lead through a node (Brandes, 2001), of the undirected network."""
    graph: dict[str, set] = defaultdict(set)
    for a, b in gathered(edges, "node1", "node2"):
        graph[a].add(b)
        graph[b].add(a)
    score = dict.fromkeys(graph, 0.0)
    for s in graph:
        stack, before, paths, dist = [], defaultdict(list), defaultdict(float, {s: 1.0}), {s: 0}
        queue = [s]
        for v in queue:
            stack.append(v)
            for w in sorted(graph[v] - {v}):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        share = defaultdict(float)
        for w in reversed(stack):
            for v in before[w]:
                share[v] += paths[v] / paths[w] * (1 + share[w])
            if w != s:
                score[w] += share[w] / 2
    return edges.sparkSession.createDataFrame(sorted(score.items()), "node string, betweenness double")


def neighbourhood(edges: DataFrame, node: str, hops: int = 1) -> DataFrame:
    """The edges among the nodes at most so many steps from a node."""
    both = edges.select("node1", "node2").union(edges.select("node2", "node1"))
    seen = edges.sparkSession.createDataFrame([(node,)], "node string")
    for _ in range(hops):
        seen = seen.union(both.join(seen, both.node1 == seen.node, "left_semi").select(F.col("node2").alias("node"))).distinct()
    return edges.join(seen.select(F.col("node").alias("node1")), "node1", "left_semi").join(seen.select(F.col("node").alias("node2")), "node2", "left_semi").select(*edges.columns)


def random_network(nodes: DataFrame, edges: int, seed: int = 0) -> DataFrame:
    """(node1, node2): edges drawn with replacement among all two nodes, each kept once."""
    names = sorted(r.node for r in nodes.select("node").collect())
    rng = np.random.default_rng(seed)
    n = len(names)
    drawn = sorted({int(k) for k in rng.integers(0, n * (n - 1) // 2, edges)}) if n > 1 else []
    out = []
    for k in drawn:
        # the k-th of all (i, j), i < j: row i begins after i * (2n - i - 1) / 2 of them
        i = int((2 * n - 1 - math.sqrt((2 * n - 1) ** 2 - 8 * k)) / 2)
        i += (i + 1) * (2 * n - i - 2) // 2 <= k
        i -= i * (2 * n - i - 1) // 2 > k
        out.append((names[i], names[k - i * (2 * n - i - 1) // 2 + i + 1]))
    return nodes.sparkSession.createDataFrame(out, "node1 string, node2 string")


def powerlaw(degrees: DataFrame) -> DataFrame:
    """(degree, n, exponent): the histogram of degrees and the exponent of greatest likelihood of a discrete power law from 1."""
    hist = degrees.where("degree >= 1").groupBy(F.col("degree").cast("long").alias("degree")).agg(F.count(F.lit(1)).alias("n"))
    rows = hist.collect()
    x, n = np.array([r.degree for r in rows], float), np.array([r.n for r in rows], float)

    def loss(a: float) -> float:
        k = np.arange(1, 2000)
        zeta = (k**-a).sum() + 2000 ** (1 - a) / (a - 1)
        return float(n.sum() * math.log(zeta) + a * (n * np.log(x)).sum())

    lo, hi = 1.01, 12.0
    for _ in range(100):
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
    return hist.withColumn("exponent", F.lit((lo + hi) / 2 if len(rows) else None).cast("double"))
