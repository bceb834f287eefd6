"""Components and star clusters against plain algorithms."""

import random

import pytest

from pyspark.sql import functions as F

from twinlake.operators import graph
from twinlake.operators.graph import connected_components, hub_limit, star_clusters, with_least
from twinlake.session import written


def _components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def _stars(edges, cap):
    near = {}
    for a, b, c in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = c
    parts = {}
    for n, r in _components([e[:2] for e in edges]).items():
        parts.setdefault(r, []).append(n)
    out = set()
    for nodes in parts.values():
        free = set(nodes)
        if len(free) == 2:
            out |= {(min(free), x, k) for k, x in enumerate(sorted(free))}
            continue
        while True:
            degree = {n: sum(x in free for x in near[n]) for n in free}
            anchor = min(free, key=lambda n: (-degree[n], n), default=None)
            if anchor is None or degree[anchor] == 0:
                break
            taken = sorted((x for x in near[anchor] if x in free), key=lambda x: (-near[anchor][x], x))[: cap - 1]
            out |= {(anchor, x, k) for k, x in enumerate([anchor, *taken])}
            free -= {anchor, *taken}
    return out


def _random_edges(seed, n, m):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(a, b, round(rng.random(), 2)) for a, b in sorted(pairs)]


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 60, 40), (2, 40, 60)])
def test_components(spark, seed, n, m):
    edges = _random_edges(seed, n, m)
    df = spark.createDataFrame(edges, "src long, dst long, confidence double").drop("confidence")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == _components([e[:2] for e in edges])


def test_components_of_a_chain_nulls_loops_and_nothing(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(99, 99), (None, 3)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {k: 0 for k in range(41)} | {99: 99}
    assert connected_components(chain.where("false")).count() == 0


@pytest.mark.parametrize("cap", [3, 60])
def test_stars_alike_in_tasks_and_in_rounds(spark, cap):
    edges = _random_edges(5, 40, 55)
    df = spark.createDataFrame(edges, "src long, dst long, confidence double")
    want = _stars(edges, cap)
    for small in (2000, 2):
        got = {(r.cluster, r.node, r.position) for r in star_clusters(df, cap, small).collect()}
        assert got == want
    anchors = {}
    near = {frozenset(e[:2]) for e in edges}
    for c, n, _ in want:
        anchors.setdefault(c, []).append(n)
        assert n == c or frozenset((c, n)) in near
    assert all(2 <= len(x) <= cap for x in anchors.values())


def test_stars_of_random_graphs_in_ranges(spark):
    """Many components too large for a task of three edges: rounds, ranges and pieces give the sequential result."""
    for seed, n, m in ((8, 90, 110),):
        edges = _random_edges(seed, n, m)
        df = spark.createDataFrame(edges, "src long, dst long, confidence double").repartition(3)
        got = {(r.cluster, r.node, r.position) for r in star_clusters(df, 4, 12).collect()}
        assert got == _stars(edges, 4)


def test_stars_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    """10,000 nodes in ascending order: one anchor waits for the other, but ranges go on by themselves."""
    rounds = []
    real = graph._everywhere
    monkeypatch.setattr(graph, "_everywhere", lambda *a: rounds.append(1) or real(*a))
    n = 10_000
    df = spark.range(n).selectExpr("id as src", "id + 1 as dst", "0.5D as confidence")
    got = {(r.cluster, r.node, r.position) for r in star_clusters(df, 60, 2000).collect()}
    # the inner nodes have two neighbours; of these the least comes first, and so on: 1 takes 0 and 2, 4 takes 3 and 5
    want = set()
    for k in range(1, n, 3):
        want |= {(k, k, 0), (k, k - 1, 1), (k, k + 1, 2)}
    if n % 3 == 1:
        want |= {(n - 1, n - 1, 0), (n - 1, n, 1)}
    assert len(rounds) < 10
    assert got == want


def test_cliques_that_fit_no_task_take_no_rounds(spark, monkeypatch):
    """Black pictures are all copies of each other, equally surely: one class of twins, whatever hangs on it."""
    monkeypatch.setattr(graph, "_everywhere", lambda *a: pytest.fail("rounds over a clique"))
    cliques = [list(range(k, 600, 3)) for k in range(3)]
    edges = [(a, b, 0.95) for c in cliques for a in c for b in c if a < b]
    edges += [(1000 + k, 0, 0.5 + k % 3 / 10) for k in range(9)] + [(2000, 1, 0.99), (2000, 4, 0.9)]
    df = spark.createDataFrame(edges, "src long, dst long, confidence double").repartition(4)
    got = {(r.cluster, r.node, r.position) for r in star_clusters(df, 60, 1000).collect()}
    assert got == _stars(edges, 60)


def test_stars_by_twins_are_the_stars(spark, monkeypatch):
    solved, real = [], graph._by_twins
    monkeypatch.setattr(graph, "_by_twins", lambda *a: (lambda found: solved.append(found[0].count()) or found)(real(*a)))
    rng = random.Random(7)
    for turn in range(2):
        # classes of some nodes each, linked wholly or not at all; in the second turn some edges have another confidence
        sizes = [rng.randint(4, 9) for _ in range(9)]
        ids = rng.sample(range(500), sum(sizes))
        classes = [[ids.pop() for _ in range(n)] for n in sizes]
        edges = [(a, b, w) for c in classes for w in [rng.choice((0.5, 0.7, 0.9))] for a in c for b in c if a < b]
        for k, c in enumerate(classes):
            for d in classes[:k]:
                if rng.random() < 0.4:
                    w = rng.choice((0.5, 0.7, 0.9))
                    edges += [(a, b, w - (0.1 if turn and rng.random() < 0.01 else 0.0)) for a in c for b in d]
        df = spark.createDataFrame(edges, "src long, dst long, confidence double")
        got = {(r.cluster, r.node, r.position) for r in star_clusters(df, 5, 100).collect()}
        assert got == _stars(edges, 5)
    assert sum(solved)


def test_a_star_of_a_million_edges_stays_spread(spark):
    """The edges of a hub are joined where they lie, in the final plan too."""
    n = 1_000_000
    links = written(spark.range(n, numPartitions=8).selectExpr("id + 1 as a", "0L as b"), "test-star")
    both = links.union(links.select(F.col("b"), F.col("a")))
    least = written(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "test-least")
    hung = with_least(both.where("b > a"), least, hub_limit(2 * n, 8))
    rows = [r["count"] for r in hung.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == n and max(rows) <= 2 * n / 8
    plan = hung._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftOuter" in plan
    assert least.where(F.col("n") > hub_limit(2 * n, 8)).count() == 1


def test_components_of_hubs_and_chains(spark):
    edges = [(0, k) for k in range(1, 3000)] + [(5000 + k, 5001 + k) for k in range(30)] + [(2999, 5000)] + [(9000, 9000 + k) for k in range(2000)]
    df = spark.createDataFrame(edges, "src long, dst long").repartition(5)
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == _components(edges)
