"""Pairs are told apart in the tasks where their keys meet, by histograms and short codes that ride along."""

import numpy as np
import pytest

from twinlake import config as C
from twinlake.operators import candidates as cand, codes, reach, vectors
from twinlake.plans import fixture

STILL = "asset_id long, kind int, pixel_width int, pixel_height int, dhash long, mean_luma double, histogram array<int>, creation_ts timestamp_ntz"
DATA = "/root/testdata/sf0.001"


def stills(spark, seed, n):
    rng = np.random.default_rng(seed)
    base, rows = rng.integers(0, 1 << 62, 3), []
    for k in range(n):
        h = int(base[rng.integers(0, 3)])
        for bit in rng.integers(0, 62, rng.integers(0, 26)):
            h ^= 1 << int(bit)
        hist = np.bincount(rng.integers(0, [4, 16, 64][k % 3], 256), minlength=64)
        if k % 5 == 4:
            hist = np.array(rows[-1][6])
            hist[0], hist[1] = hist[0] + min(k % 7, hist[1]), hist[1] - min(k % 7, hist[1])
        rows.append((k, C.PHOTO, 4000, 3000, h, float(round(0.4 + 0.2 * rng.random(), 2)), hist.tolist(), None))
    return spark.createDataFrame(rows, STILL), rows


@pytest.mark.parametrize("sensitivity", ["strict", "similar"])
@pytest.mark.parametrize("block", [32768, 16])
def test_no_pair_travels_for_its_histograms(spark, monkeypatch, sensitivity, block):
    monkeypatch.setattr(cand, "BLOCK", block)
    monkeypatch.setattr(cand, "with_similarity", None)
    df, rows = stills(spark, 3, 200)
    t, want = C.LEVELS[sensitivity], {}
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            d, s = (a[4] ^ b[4]).bit_count(), sum(map(min, a[6], b[6])) / 256
            if d <= t.hash_reject and abs(a[5] - b[5]) <= C.LUMA_TOLERANCE and s >= t.histogram_floor:
                want[i, j] = (d, s)
    found = cand.still_candidates(df, sensitivity).collect()
    assert {(r.id_lo, r.id_hi): (r.hash_distance, r.histogram_similarity) for r in found} == want and len(found) == len(want) > 100
    # without a date no pair is of one moment
    found = cand.still_candidates(df, sensitivity, routed=True).collect()
    near = C.ANYTIME[sensitivity].hash_reject
    assert {(r.id_lo, r.id_hi) for r in found} == {p for p, (d, _) in want.items() if d <= near}


@pytest.mark.parametrize("block", [32768, 8])
def test_colours_meet_by_counts(spark, monkeypatch, block):
    monkeypatch.setattr(cand, "BLOCK", block)
    df, rows = stills(spark, 4, 300)
    found = {(r.id_lo, r.id_hi): r.common for r in cand.colour_pairs(df, 256, 0.985).collect()}
    want = {}
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            common = sum(map(min, a[6], rows[j][6]))
            if common / 256 >= 0.985 and abs(a[5] - rows[j][5]) <= C.LUMA_TOLERANCE:
                want[i, j] = common
    assert found == want and len(want) > 20


def test_rasters_are_made_in_one_pass(spark):
    plan = fixture.still_pixels(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1


def test_codes_leave_near_pairs_only(spark):
    """Scenes of a few copies: what is scored grows with the shapes, and the best are those of a search of all."""
    rng = np.random.default_rng(5)
    scenes = rng.normal(size=(120, 40)) @ rng.normal(size=(40, 480)) * 100
    x = np.round(scenes[np.arange(600) % 120] + rng.normal(size=(600, 480)) * 20).astype(np.int64)
    x[:40] = x[0]
    t = spark.createDataFrame([(k, v.tolist(), int((v * v).sum())) for k, v in enumerate(x)], "asset_id long, shape array<int>, shape_norm long")
    reps = t.withColumnRenamed("asset_id", "rep")
    along = codes.axes(t, 0.96, 4)
    assert along.shape[1] < 128
    left = codes.close_pairs(reps, 600, along, 0.96, 4, None).count()
    assert left < 0.05 * 600 * 600 / 2
    u = x / np.sqrt((x * x).sum(1))[:, None]
    best = {}
    for turn in range(4):
        at, sign = reach.rotation(turn)
        c = (u[:, at] * sign) @ u.T
        for q in range(600):
            order = sorted(np.flatnonzero(c[q] >= 0.96).tolist(), key=lambda p: (-round(c[q, p], 9), p))[:6]
            for p in order:
                if p != q:
                    best[q, p] = max(best.get((q, p), -1), c[q, p])
    got = {(r["query"], r["point"]): r.score for r in vectors.nearest(t, t, limit=5).collect()}
    assert set(got) == set(best) and all(abs(got[k] - best[k]) < 1e-9 for k in got)


def test_products_of_codes_are_made_in_tiles(spark, monkeypatch):
    """Tiles that do not divide the rows find what one product finds."""
    rng = np.random.default_rng(6)
    x = np.round((rng.normal(size=(30, 480)) * 100)[np.arange(150) % 30] + rng.normal(size=(150, 480)) * 10).astype(np.int64)
    t = spark.createDataFrame([(k, v.tolist(), int((v * v).sum())) for k, v in enumerate(x)], "rep long, shape array<int>, shape_norm long")
    along = codes.axes(t.withColumnRenamed("rep", "asset_id"), 0.96, 4)
    found = []
    for step, wide in ((1000, 1000), (7, 11)):
        monkeypatch.setattr(codes, "STEP", step)
        monkeypatch.setattr(codes, "WIDE", wide)
        found.append(sorted(map(tuple, codes.close_pairs(t, 150, along, 0.96, 4, None).collect())))
    assert found[0] == found[1] and len(found[0]) >= 450


@pytest.mark.parametrize("n, m", [(1, 1), (64, 4096), (70, 5000), (0, 3), (3, 0)])
def test_near_hashes_of_ragged_tiles(n, m):
    rng = np.random.default_rng(7)
    a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (n, m))
    found = [(low + i, low_ + j, x) for low, low_, *c in cand.near_hashes(a, b, 22) for i, j, x in zip(*c)]
    i, j = np.nonzero(np.bitwise_count(a[:, None] ^ b[None]) <= 22)
    assert sorted(found) == list(zip(i, j, a[i] ^ b[j]))
