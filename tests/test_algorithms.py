"""The six-node graph, with values by hand, and random graphs against plain Python."""

import random

import pytest

from nodeloom.model import Graph, NodeTable, RelTable
from nodeloom.operators import algorithms as A


@pytest.fixture(scope="module")
def six(spark):
    n = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    r = spark.createDataFrame([(11, 1, 2, 1), (12, 2, 3, 2), (13, 3, 1, 4), (14, 3, 4, 1), (15, 4, 5, 1), (16, 5, 4, 1)], "id long, src long, dst long, weight long")
    return Graph(spark, (NodeTable(frozenset(["Node"]), n),), (RelTable("CONNECTED", r, ("Node", "Node")),))


def column(g, call, what):
    return [r[1] for r in sorted(g.cypher(f"CALL {call} YIELD node, {what} RETURN id(node) AS id, {what}").collect())]


def test_six_nodes(six):
    assert column(six, "graph.degree()", "degree") == [2, 2, 3, 3, 2, 0]
    assert column(six, "graph.bfs(1)", "distance") == [0, 1, 2, 3, 4]
    assert column(six, "graph.dfs(1)", "order") == [0, 1, 2, 3, 4]
    assert column(six, "graph.dijkstra(1, 'weight')", "cost") == [0, 1, 3, 4, 5]
    assert column(six, "graph.wcc()", "component") == [0, 0, 0, 0, 0, 1]
    assert column(six, "graph.scc()", "component") == [0, 0, 0, 1, 1, 2]
    assert column(six, "graph.kcore()", "core") == [2, 2, 2, 1, 1, 0]
    assert column(six, "graph.clusteringcoefficient()", "coefficient") == [1, 1, 1 / 3, 0, 0, 0]
    assert column(six, "graph.louvain()", "community") == [0, 0, 0, 1, 1, 2]
    assert six.cypher("CALL graph.trianglecount()").first()[0] == 1
    assert tuple(six.cypher("CALL graph.shortestpath(1, 5) YIELD path, cost RETURN cost, size(nodes(path)) AS n, size(relationships(path)) AS r").first()) == (4, 5, 4)
    assert six.cypher("CALL graph.shortestpath(5, 1) YIELD cost RETURN cost").count() == 0


def test_pagerank(six):
    got = column(six, "graph.pagerank(0.85, 0.0, 30)", "score")
    rank, out = [1 / 6] * 6, {1: [2], 2: [3], 3: [1, 4], 4: [5], 5: [4], 6: []}
    for _ in range(30):
        lost = rank[5]
        rank = [0.15 / 6 + 0.85 * lost / 6 + 0.85 * sum(rank[s - 1] / len(o) for s, o in out.items() if v in o) for v in range(1, 7)]
    assert got == pytest.approx(rank) and sum(got) == pytest.approx(1)


def test_random_components_and_cores(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    nodes = spark.createDataFrame([(i,) for i in range(40)], "id long")
    df = spark.createDataFrame(edges, "src long, dst long")
    least = {i: i for i in range(40)}
    for _ in range(40):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    assert {r["id"]: r["least"] for r in A.least_ids(nodes, df).collect()} == least
    near = {i: {b for a, b in edges if a == i and b != i} | {a for a, b in edges if b == i and a != i} for i in range(40)}
    core, alive, k = {}, set(range(40)), 0
    while alive:
        low = [v for v in alive if len(near[v] & alive) <= k]
        if low:
            core.update(dict.fromkeys(low, k))
            alive -= set(low)
        else:
            k += 1
    assert {r["id"]: r["core"] for r in A.kcore(nodes, df).collect()} == core
    tri = sum(1 for a in near for b in near[a] if a < b for c in near[a] & near[b] if b < c)
    assert A.triangle_count(df).first()[0] == tri
