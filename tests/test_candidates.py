"""The index of the hash gate against all pairs, and how many pairs it compares."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinlake import config as C
from twinlake.operators import candidates as cand


def library(spark, seed, n):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    sizes = [(4032, 3024), (3024, 4032), (1920, 1080), (3000, 3000), (3000, 2800), (0, 0), (4000, 3100), (1000, 1420)]
    rows = []
    for k in range(n):
        h = int(base[rng.integers(0, 12)])
        for bit in rng.integers(0, 64, rng.integers(0, 30)):
            h ^= 1 << int(bit)
        h = h - (1 << 64) if h >= 1 << 63 else h
        w, t = sizes[rng.integers(0, len(sizes))]
        luma = float(round(rng.random(), 2)) if k % 3 else 0.5
        hist = [0] * 64
        hist[0] = 256
        rows.append((k, C.VIDEO if k % 50 == 7 else C.PHOTO, w, t, h, luma, hist))
    return spark.createDataFrame(rows, "asset_id long, kind int, pixel_width int, pixel_height int, dhash long, mean_luma double, histogram array<int>"), rows


def brute(rows, sensitivity):
    t, out = C.LEVELS[sensitivity], {}
    aspect = [max(w / h, h / w) if w > 0 and h > 0 else 1.0 for _, _, w, h, *_ in rows]
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            d = ((a[4] ^ b[4]) & (1 << 64) - 1).bit_count()
            near = abs(a[5] - b[5]) <= C.LUMA_TOLERANCE and abs(aspect[i] - aspect[j]) / max(aspect[i], aspect[j]) <= t.aspect_tolerance
            if C.VIDEO not in (a[1], b[1]) and near and d <= t.hash_reject:
                out[i, j] = d
    return out


@pytest.mark.parametrize("sensitivity", ["exact", "strict", "similar"])
@pytest.mark.parametrize("block", [4096, 8])
def test_no_pair_is_lost(spark, monkeypatch, sensitivity, block):
    monkeypatch.setattr(cand, "BLOCK", block)
    df, rows = library(spark, 5, 300)
    found = cand.still_candidates(df, sensitivity).collect()
    got = {(r.id_lo, r.id_hi): r.hash_distance for r in found}
    assert len(found) == len(got) and got == brute(rows, sensitivity)


@pytest.mark.parametrize(("sensitivity", "share"), [("exact", 0.12), ("strict", 0.3)])
def test_few_of_the_pairs_are_compared(spark, sensitivity, share):
    df, _ = library(spark, 6, 2000)
    thin = df.select("asset_id", "dhash", "mean_luma", cand.aspect_ratio().alias("aspect"))
    left, right = cand.gate_keys(thin, sensitivity)
    count = lambda t, n: t.groupBy(*cand.KEYS).agg(F.count(F.lit(1)).alias(n))
    compared = count(left, "x").join(count(right, "y"), cand.KEYS).agg(F.sum(F.col("x") * F.col("y"))).first()[0]
    band = cand._luma_range(F.col("mean_luma"))
    near = thin.select(F.explode(F.array(*(band + d for d in (-1, 0, 1)))).alias("band")).groupBy("band").agg(F.count(F.lit(1)).alias("y"))
    before = thin.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("x")).join(near, "band").agg(F.sum(F.col("x") * F.col("y"))).first()[0]
    assert compared < share * before
