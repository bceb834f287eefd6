"""The pruned neighbour search against all pairs."""

import numpy as np
import pytest

from twinlake.functions.signatures import rotation
from twinlake.operators import reach, vectors

KIND = "asset_id long, shape array<int>, shape_norm long"


def shapes(seed, n, centres=0, spread=25.0, blank=0):
    """Shapes of n assets: near one of some centres, or anywhere; some equal ones."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 480)) * 100
    if centres:
        x = (rng.normal(size=(centres, 480)) * 100)[rng.integers(0, centres, n)] + rng.normal(size=(n, 480)) * spread
    x = np.round(x).astype(np.int64)
    x[1::9] = x[::9][: len(x[1::9])]
    at, sign = rotation(1)
    x[2::9] = (x[::9][: len(x[2::9])])[:, at] * sign
    return x


def frame(spark, x, first=0):
    rows = [(first + k, v.tolist(), int((v * v).sum())) for k, v in enumerate(x)]
    return spark.createDataFrame(rows, KIND).repartition(3)


def brute(x, y, floor, turns=4):
    out = {}
    for t in range(turns):
        at, sign = rotation(t)
        c = (x[:, at] * sign).astype(float) @ y.T.astype(float) / np.sqrt((x * x).sum(1)[:, None] * (y * y).sum(1)[None, :].astype(float))
        out |= {(int(i), int(j), t): c[i, j] for i, j in zip(*np.nonzero(c >= floor))}
    return out


@pytest.mark.parametrize(("centres", "cell", "tile"), [(0, 256, 4096), (12, 16, 64), (3, 8, 16)])
def test_scores_equal_brute_force(spark, monkeypatch, centres, cell, tile):
    for name, v in (("CELL", cell), ("TILE", tile), ("BLOCK", max(4, tile // 4)), ("QUERIES", 32)):
        monkeypatch.setattr(reach, name, v)
    x = shapes(4, 300, centres)
    got = {tuple(r[:3]): r.score for r in reach.block_scores(frame(spark, x), None, 0.9).collect()}
    want = brute(x, x, 0.9)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    y = shapes(5, 120, centres)
    y[:60] = x[:60]
    got = {tuple(r[:3]) for r in reach.block_scores(frame(spark, y), frame(spark, x), 0.9).collect()}
    assert got == set(brute(y, x, 0.9))


def test_clustered_points_meet_few_blocks(spark, monkeypatch):
    """20,000 shapes of 200 scenes: less than a fifth of all pairs is scored, and none is lost."""
    x = shapes(6, 20_000, 200)
    t = frame(spark, x)
    pivots = reach.choose_pivots(t, len(x))
    there = reach.written(reach.placed(t, pivots), "test-reach")
    blocks = reach.Blocks.of(pivots, [tuple(r) for r in reach.shells(there).collect()])
    search = reach.plan_search(there, blocks, 0.96, 4, True)
    assert search.share < 0.2
    some = np.arange(0, len(x), 400)
    got = {tuple(r[:3]) for r in reach.scored(there, None, search, 0.96, 4, None).where("query % 400 = 0").collect()}
    assert got == {(int(some[i]), j, t) for i, j, t in brute(x[some], x, 0.96)}


def test_one_scene_holds_a_third(spark, monkeypatch):
    monkeypatch.setattr(reach, "QUERIES", 64)
    x = shapes(7, 300, 0)
    x[:100] = x[0]
    got = vectors.nearest(t := frame(spark, x), t, limit=5).collect()
    per = {}
    for r in got:
        per.setdefault(r["query"], []).append(r.point)
    assert sorted(per[50]) == [0, 1, 2, 3, 4, 5] and sorted(per[0]) == [1, 2, 3, 4, 5]


def test_nothing_and_one(spark):
    none = spark.createDataFrame([], KIND)
    one = frame(spark, shapes(1, 1))
    assert reach.block_scores(none, None, 0.9).count() == 0 == reach.block_scores(one, none, 0.9).count() == reach.block_scores(none, one, 0.9).count()
    assert {tuple(r[:3]) for r in reach.block_scores(one, None, 0.99).collect()} == {(0, 0, 0)}
