"""The grey zone is told where keys meet: no pair travels for its rows or its shapes."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinlake.operators import candidates as cand, verify
from twinlake.plans import media

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """The derived library with nulls here and there."""
    lib = media.library(spark, DATA)
    every = lambda n: F.pmod(F.xxhash64("asset_id"), F.lit(n)) == 0
    known = lambda c, n: F.when(~every(n), F.col(c))
    return lib.withColumns({"histogram": known("histogram", 31), "creation_ts": known("creation_ts", 5), "shape_norm": known("shape_norm", 37)})


@pytest.mark.parametrize("level", ["strict", "similar"])
def test_as_by_routes_and_scores(odd, monkeypatch, level):
    routed = verify.routes(cand.candidates(odd, level), odd, level)
    want = {(r.id_lo, r.id_hi): (r.score, r.accept) for r in verify.grey_scores(routed, odd).collect()}
    monkeypatch.setattr(verify, "routes", None)
    monkeypatch.setattr(verify, "grey_scores", None)
    for block in (32768, 16):
        monkeypatch.setattr(cand, "BLOCK", block)
        found = cand.grey_zone(odd, level).collect()
        assert {(r.id_lo, r.id_hi): (r.score, r.accept) for r in found} == want and len(found) == len(want) > 100


@pytest.mark.parametrize("level", ["strict", "similar"])
def test_the_query_joins_no_pairs(spark, monkeypatch, level):
    monkeypatch.setattr(verify, "routes", None)
    monkeypatch.setattr(verify, "grey_scores", None)
    out = media.QUERIES[f"grey_zone_{level}"](spark, DATA)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan[: plan.index("MapInArrow")] and out.count() > 400


@pytest.mark.parametrize("block", [32768, 8])
def test_own_rows_meet_in_one_order(spark, monkeypatch, block):
    monkeypatch.setattr(cand, "BLOCK", block)
    rng, n = np.random.default_rng(8), 150
    rows = [(k, int(rng.integers(0, 1 << 62)), float(l), float(a)) for k, (l, a) in enumerate(zip(rng.choice([0.4, 0.44, 0.5], n), rng.choice([1.3, 1.35], n)))]
    thin = spark.createDataFrame(rows, "asset_id long, dhash long, mean_luma double, aspect double")

    def solve(key, left):
        def against(right):
            i, j = np.nonzero(np.ones((len(left["asset_id"]), len(right["asset_id"]))))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (left["asset_id"][i], right["asset_id"][j], right["free"][j])], names=["a", "b", "free"])

        return against

    left, right = cand.gate_keys(thin, "strict")
    met = cand.met(left, right, cand.KEYS, ["asset_id"], solve, "a long, b long, free boolean").collect()
    once = [(min(r.a, r.b), max(r.a, r.b)) for r in met if r.free or r.a < r.b]
    assert len(once) == len(set(once)) and set(once) == {(i, j) for i in range(n) for j in range(i + 1, n)}
    assert block > n or len(met) < 0.6 * n * n


def test_counts_of_bins_in_use():
    rng = np.random.default_rng(9)
    a, b = (rng.multinomial(256, [w / sum(p) for w in p], 300).astype(np.int32) for p in ([3, 0, 2, 0, 1, 5], [1, 2, 0, 0, 1, 1]))
    i, j = rng.integers(0, 300, (2, 9000))
    x, y = cand.counted(a, b)
    assert x.shape[1] == y.shape[1] == 3
    assert (cand.common_counts(x, y, i, j) == np.minimum(a[i], b[j]).sum(1)).all()


def test_sixths_are_rounded_values(spark):
    values = [k / 256 for k in range(257)] + [-0.1234565, -1e-9, 0.98765449, 0.3, None]
    t = spark.createDataFrame([(v,) for v in values], "x double")
    rows = t.select(media._r("x").alias("a"), media._sixths("x").alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]


def test_blocks_fit_the_tasks(spark, monkeypatch):
    """A key of fewer rows than a block is dealt to as many tasks as the session has."""
    monkeypatch.setattr(cand, "LEAST", 8)
    rng = np.random.default_rng(10)
    rows = [(k, int(h), 0.4, 1.5) for k, h in enumerate(rng.integers(0, 1 << 62, 200))]
    thin = spark.createDataFrame(rows, "asset_id long, dhash long, mean_luma double, aspect double")

    def solve(key, left):
        return lambda right: iter([pa.RecordBatch.from_arrays([pa.array([len(left["asset_id"])])], names=["n"])])

    left, right = cand.gate_keys(thin, "similar")
    held = [r.n for r in cand.met(left, right, cand.KEYS, ["asset_id"], solve, "n long").collect()]
    assert len(held) >= 4 and max(held) < 100


def test_no_text_of_each_similarity(spark):
    plan = media.QUERIES["still_candidates_similar"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan[: plan.index("MapInArrow")]
