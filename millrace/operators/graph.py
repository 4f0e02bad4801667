"""Co-occurrence graphs, label propagation, components, betweenness, modularity, Girvan-Newman.

A graph is a table of undirected edges (a, b) with a < b, each once; vertices are the ends.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.similarity import jaccard_pairs, shared_counts
from millrace.session import cut

#: Edges up to which a whole graph is sent to every task that walks it from its own roots.
SMALL = 200_000
TOLERANCE = 1e-9


def edges_of(df: DataFrame, a: str, b: str) -> DataFrame:
    """A clean edge table: no loops, no nulls, each edge once."""
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b and a is not null and b is not null").distinct()


def both_directions(edges: DataFrame) -> DataFrame:
    """(src, dst) in both directions."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return edges.select(ends.alias("e")).select("e.src", "e.dst")


def vertices(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def cooccurrence_edges(members: DataFrame, owner: str, member: str, threshold: int) -> DataFrame:
    """Edges between owners that share at least ``threshold`` distinct members."""
    rows = members.select(F.col(owner).alias("o"), F.col(member).alias("m"))
    return shared_counts(rows, threshold).where(F.col("k") >= threshold).select("a", "b")


def jaccard_edges(members: DataFrame, owner: str, member: str, threshold: float = 0.5) -> DataFrame:
    """Edges between owners whose member sets have at least this Jaccard similarity."""
    return jaccard_pairs(members, owner, member, threshold).select("a", "b")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): in every round each node takes its neighbours' most frequent label, the least at ties."""
    links = cut(both_directions(edges))
    labels = vertices(edges).select("node", F.col("node").alias("community"))
    for k in range(rounds):
        votes = links.join(labels.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.count("*").alias("n"))
        best = votes.groupBy(F.col("src").alias("node")).agg(F.min(F.struct((-F.col("n")).alias("n"), "community")).alias("v"))
        labels = best.select("node", F.col("v.community").alias("community"))
        if k % 5 == 4 and k + 1 < rounds:
            labels = cut(labels)
    return labels


def connected_components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): the least node that each node reaches.

    Each round takes the neighbours' least label and then the label's own label, so that
    distances halve; it ends when nothing changes.
    """
    links = cut(both_directions(edges))
    labels = cut(vertices(edges).select("node", F.col("node").alias("component")))
    for _ in range(most):
        near = links.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        jump = moved.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = cut(moved.join(jump, "component", "left").select("node", F.least("component", "further").alias("component"), "old"))
        if moved.where("component <> old").isEmpty():
            return moved.select("node", "component")
        labels = moved.select("node", "component")
    raise RuntimeError("components did not settle")


def shares_from(root, adjacency: dict) -> dict:
    """What one root adds to each edge: shortest paths from it, split evenly where they meet."""
    level, paths, order = {root: 0}, defaultdict(int, {root: 1}), [root]
    for node in order:
        for other in adjacency[node]:
            if other not in level:
                level[other] = level[node] + 1
                order.append(other)
            if level[other] == level[node] + 1:
                paths[other] += paths[node]
    credit, out = dict.fromkeys(order, 1.0), {}
    for node in reversed(order):
        for other in adjacency[node]:
            if level[other] == level[node] - 1:
                flow = credit[node] * paths[other] / paths[node]
                credit[other] += flow
                out[(other, node) if other < node else (node, other)] = flow
    return out


def edge_betweenness(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b, betweenness) of every edge; each pair of vertices counts once.

    A graph of at most ``small`` edges goes whole to the tasks, which share out the roots;
    a larger one is walked level by level as joins (``edge_betweenness_joins``).
    """
    edges = cut(edges.select("a", "b"))
    n = edges.count()
    if n > small:
        return edge_betweenness_joins(edges)
    spark = edges.sparkSession
    adjacency: dict = defaultdict(list)
    for a, b in edges.orderBy("a", "b").collect():
        adjacency[a].append(b)
        adjacency[b].append(a)
    shared = spark.sparkContext.broadcast(dict(adjacency))
    kind = edges.schema["a"].dataType.simpleString()

    def run(frames):
        total: dict = defaultdict(float)
        for frame in frames:
            for root in frame["node"]:
                for edge, flow in shares_from(root, shared.value).items():
                    total[edge] += flow
        yield pd.DataFrame([(a, b, v) for (a, b), v in total.items()], columns=["a", "b", "v"])

    roots = vertices(edges).repartition(max(1, min(64, n // 200)), "node")
    return roots.mapInPandas(run, f"a {kind}, b {kind}, v double").groupBy("a", "b").agg((F.sum("v") / 2).alias("betweenness"))


def edge_betweenness_joins(edges: DataFrame) -> DataFrame:
    """The same by joins alone: shortest-path counts level by level from all roots, then credits back."""
    links = cut(both_directions(edges))
    front = vertices(edges).select(F.col("node").alias("root"), "node", F.lit(1.0).alias("paths"), F.lit(0).alias("level"))
    seen = front = cut(front)
    level = 0
    while not front.isEmpty():
        level += 1
        reached = front.join(links, front.node == links.src).groupBy("root", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        front = cut(reached.join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level)))
        seen = cut(seen.unionByName(front)) if level % 4 == 0 else seen.unionByName(front)
    seen = cut(seen)
    credits, flows = None, None
    for k in range(level - 1, 0, -1):
        at = seen.where(F.col("level") == k)
        if credits is None:
            at = at.withColumn("credit", F.lit(1.0))
        else:
            at = at.join(credits, ["root", "node"], "left").withColumn("credit", F.lit(1.0) + F.coalesce("gain", F.lit(0.0)))
        above = seen.where(F.col("level") == k - 1).select("root", F.col("node").alias("dst"), F.col("paths").alias("over"))
        flow = at.join(links, at.node == links.src).join(above, ["root", "dst"]).select("root", "node", "dst", (F.col("credit") * F.col("over") / F.col("paths")).alias("flow"))
        flow = cut(flow)
        credits = flow.groupBy("root", F.col("dst").alias("node")).agg(F.sum("flow").alias("gain"))
        part = flow.groupBy(F.least("node", "dst").alias("a"), F.greatest("node", "dst").alias("b")).agg(F.sum("flow").alias("v"))
        flows = part if flows is None else flows.unionByName(part)
    if flows is None:
        return edges.select("a", "b", F.lit(0.0).alias("betweenness")).limit(0)
    return flows.groupBy("a", "b").agg((F.sum("v") / 2).alias("betweenness"))


def modularity(edges: DataFrame, communities: DataFrame, divisor: float = 2.0) -> DataFrame:
    """(modularity) of communities (node, community): links inside against those expected from degrees.

    ``divisor`` 2 gives the expected share k k / 2m; 1 the variant k k / m.
    """
    named = communities.select("node", "community")
    inside = edges.join(named.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(named.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = inside.groupBy("ca").agg(F.count(F.when(F.col("ca") == F.col("cb"), 1)).alias("e")).select(F.col("ca").alias("community"), "e")
    ends = degrees(edges).join(named, "node").groupBy("community").agg(F.sum("degree").alias("k"))
    m = edges.agg(F.count("*").alias("m"))
    rows = ends.join(inside, "community", "left").join(F.broadcast(m))
    each = 2 * F.coalesce("e", F.lit(0)) - F.col("k") * F.col("k") / (F.lit(divisor) * F.col("m"))
    return rows.agg(F.sum(each / (2 * F.col("m"))).alias("modularity"))


def _split(adjacency: dict) -> list[list]:
    """Components of a driver-side graph, in order of their least node."""
    seen, out = set(), []
    for root in sorted(adjacency):
        if root not in seen:
            seen.add(root)
            group = [root]
            for node in group:
                for other in adjacency[node]:
                    if other not in seen:
                        seen.add(other)
                        group.append(other)
            out.append(group)
    return out


def matrix_flows(links: np.ndarray) -> np.ndarray:
    """Edge betweenness of a graph given as a symmetric 0/1 matrix, from all roots at once.

    ``paths`` and ``level`` hold a row a root.  Level by level, the new nodes are those that
    the front reaches and nobody saw before; credits flow back the same way.
    """
    n = len(links)
    level, paths = np.where(np.eye(n) > 0, 0, -1), np.eye(n)
    front, depth = np.eye(n), 0
    while front.any():
        depth += 1
        front = np.where(level < 0, front @ links, 0.0)
        level[front > 0] = depth
        paths += front
    credit, flows = np.ones((n, n)), np.zeros((n, n))
    for at in range(depth - 1, 0, -1):
        down = np.where(level == at, credit / np.maximum(paths, 1.0), 0.0)
        up = np.where(level == at - 1, paths, 0.0)
        credit += up * (down @ links)
        flows += up.T @ down
    flows *= links
    return (flows + flows.T) / 2


def _walk(group: list, adjacency: dict) -> dict:
    """Edge betweenness inside a component: as matrices unless it is large or has few edges."""
    n = len(group)
    if n > 3000 or n > 64 and sum(len(adjacency[x]) for x in group) < 4 * n:
        total: dict = defaultdict(float)
        for root in group:
            for edge, flow in shares_from(root, adjacency).items():
                total[edge] += flow / 2
        return total
    order = sorted(group)
    place = {x: i for i, x in enumerate(order)}
    links = np.zeros((n, n))
    for x in order:
        links[place[x], [place[y] for y in adjacency[x]]] = 1
    flows = matrix_flows(links)
    return {(order[i], order[j]): float(flows[i, j]) for i, j in np.argwhere(np.triu(links) > 0).tolist()}


def _girvan_newman_small(pairs: list[tuple]) -> list[list]:
    """Girvan-Newman of a small graph; after a removal only the components it touched are walked again."""
    adjacency: dict = defaultdict(set)
    for a, b in pairs:
        adjacency[a].add(b)
        adjacency[b].add(a)
    degree, m, of = {x: len(y) for x, y in adjacency.items()}, len(pairs), {}
    original = {x: frozenset(y) for x, y in adjacency.items()}

    def part(group: list) -> float:
        """What a community adds to modularity, in the whole graph's links."""
        key = tuple(sorted(group))
        if key not in of:
            inside = set(group)
            of[key] = (sum(len(original[x] & inside) for x in group) - sum(degree[x] for x in group) ** 2 / (2 * m)) / (2 * m)
        return of[key]

    flows = {tuple(sorted(g)): _walk(g, adjacency) for g in _split(adjacency)}
    best, kept = None, []
    while True:
        top = max((v for f in flows.values() for v in f.values()), default=0.0)
        if not top:
            return kept
        for group, f in list(flows.items()):
            gone = [e for e, v in f.items() if v >= top - TOLERANCE]
            if gone:
                for a, b in gone:
                    adjacency[a].discard(b)
                    adjacency[b].discard(a)
                del flows[group]
                flows.update((tuple(sorted(g)), _walk(g, adjacency)) for g in _split({x: adjacency[x] for x in group}))
        if not any(flows.values()):
            return kept
        if len(flows) > 1:
            now = sum(part(list(g)) for g in flows)
            if best is None or now >= best - TOLERANCE:
                best, kept = max(now, best or now), [list(g) for g in flows]


def girvan_newman(edges: DataFrame, small: int = 5_000) -> DataFrame:
    """(node, community) of the best partition by modularity over the removal of edges.

    Each round removes all edges of the highest betweenness.  Partitions are scored after
    a removal that leaves edges, if there is more than one; of equal ones the later
    counts.  A community is named by its least node.  A graph of at most ``small`` edges
    is one task; larger ones take a round of distributed steps each.
    """
    edges = cut(edges.select("a", "b"))
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"node {kind}, community {kind}"
    if edges.count() <= small:

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            groups = _girvan_newman_small(list(zip(frame["a"], frame["b"])))
            return pd.DataFrame([(x, min(g)) for g in groups for x in g], columns=["node", "community"])

        return edges.withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(run, schema)
    left, best, kept = edges, None, edges.sparkSession.createDataFrame([], schema)
    everyone = cut(vertices(edges))
    while True:
        flows = cut(edge_betweenness(left))
        top = flows.agg(F.max("betweenness")).first()[0]
        if top is None:
            return kept
        left = cut(flows.where(F.col("betweenness") < top - TOLERANCE).select("a", "b"))
        if left.isEmpty():
            return kept
        groups = connected_components(left)
        groups = cut(everyone.join(groups, "node", "left").select("node", F.coalesce("component", "node").alias("community")))
        if groups.select("community").distinct().limit(2).count() > 1:
            now = modularity(edges, groups).first()[0]
            if best is None or now >= best - TOLERANCE:
                best, kept = max(now, best or now), groups
