import heapq
import random
from collections import defaultdict
from itertools import combinations

import pytest

from strandmill.operators import graph

PATH = [(i, i + 1) for i in range(10)]
CYCLE = [(i, (i + 1) % 6) for i in range(6)]
TWO = [(1, 2), (2, 3), (1, 3), (11, 12), (12, 13), (11, 13)]
K5 = list(combinations(range(5), 2))
STAR = [(0, i) for i in range(1, 9)]
CHAIN = [(i, i + 1) for i in range(40)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "vi long, vj long")


def zones(edges):
    p = {}

    def find(x):
        p.setdefault(x, x)
        while p[x] != x:
            x = p[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        p[max(x, y)] = min(x, y)
    return {v: find(v) for v in list(p)}


@pytest.mark.parametrize("edges", [PATH, CYCLE, TWO, K5, STAR, CHAIN, [(3, 3)], [(5, 2), (2, 5), (9, 5)]])
def test_components(spark, edges):
    got = graph.cc_find(frame(spark, edges))
    assert {r.v: r.zone for r in got.collect()} == zones(edges)


def test_component_stats(spark):
    got = graph.cc_stats(graph.cc_find(frame(spark, TWO + [(50, 51)])))
    assert {(r.size, r.zones) for r in got.collect()} == {(3, 2), (2, 1)}


@pytest.mark.parametrize(("edges", "n"), [(PATH, 0), (TWO, 2), (K5, 10), (STAR, 0)])
def test_triangles(spark, edges, n):
    got = graph.triangles(graph.edge_upper(frame(spark, edges))).collect()
    assert len(got) == n == len({frozenset(r) for r in got})


def test_degrees_and_neighbours(spark):
    e = frame(spark, STAR + [(1, 1)])
    up = graph.edge_upper(e)
    assert {r.v: r.degree for r in graph.degree(up).collect()}[0] == 8
    assert {(r.degree, r.vertices) for r in graph.degree_stats(up).collect()} == {(8, 1), (1, 8)}
    assert {r.w for r in graph.degree_weight(up).collect()} == {1 / 8}
    assert {r.v: r.nbrs for r in graph.neighbors(up).collect()}[0] == list(range(1, 9))
    assert graph.vertex_extract(e).count() == 9
    assert graph.neighbors_with_triangles(graph.edge_upper(frame(spark, TWO))).count() == 12 + 6


RANDOM = [(a, b) for a, b in combinations(range(60), 2) if (a * 7919 + b * 104729) % 17 == 0]


@pytest.mark.parametrize("edges", [PATH, CYCLE, TWO, K5, STAR, CHAIN, RANDOM])
def test_independent_set(spark, edges):
    chosen = {r.v for r in graph.luby(graph.edge_upper(frame(spark, edges)), 12345).collect()}
    assert not any(a in chosen and b in chosen for a, b in edges)
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    assert all(v in chosen or near[v] & chosen for v in near)


def test_shortest_paths(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(30), rng.randrange(30), float(rng.randint(1, 9))) for _ in range(90)]
    dist, heap = {}, [(0.0, 0)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in dist:
            dist[v] = d
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (d + w, b))
    got = graph.sssp(spark.createDataFrame(edges, "vi long, vj long, w double"), 0).collect()
    assert {r.v: r.dist for r in got} == dist


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 1, 1.0), (3, 4, 1.0)], "vi long, vj long, w double")
    got = {r.v: r.rank for r in graph.pagerank(e, 30).collect()}
    # vertex 3 splits evenly between 1 and 4, which have no other source
    assert abs(sum(got.values()) - 1) < 1e-9 and abs(got[4] - got[1]) < 1e-12 and got[3] > got[1]


def test_rmat(spark):
    a = {tuple(r) for r in graph.rmat(spark, 6, 2, 0.4, 0.2, 0.2, 0.2, 0.1, 7).collect()}
    b = {tuple(r) for r in graph.rmat(spark, 6, 2, 0.4, 0.2, 0.2, 0.2, 0.1, 7).collect()}
    assert a == b and len(a) == 128 and all(0 <= x < 64 and 0 <= y < 64 for x, y in a)
    with pytest.raises(ValueError, match="must be 1"):
        graph.rmat(spark, 4, 2, 0.5, 0.5, 0.5, 0.1, 0.0, 1)
