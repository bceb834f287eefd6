"""Signatures against plain loops."""

import numpy as np

from twinlake.functions import export, signatures as S


def _rasters(edge, n=4, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (n, edge, edge, 3)).astype(np.uint8)


def _turned(rgb):
    """Clockwise."""
    return np.rot90(rgb, -1, axes=(1, 2))


def test_hash_of_flat_rasters_is_zero_and_of_a_slope_is_full():
    flat = np.full((1, 128, 128), 7000)
    slope = np.tile(np.arange(128) * 100, (128, 1))[None]
    assert S.difference_hash(flat)[0] == 0
    assert S.difference_hash(slope).view(np.uint64)[0] == np.uint64(2**64 - 1)


def test_box_sums_match_slices():
    luma = (_rasters(37).astype(np.int64) * S.LUMA).sum(3)
    sums, size = S.box_sums(luma, 8, 9)
    for r in range(8):
        for c in range(9):
            a, b, p, q = r * 37 // 8, (r + 1) * 37 // 8, c * 37 // 9, (c + 1) * 37 // 9
            assert (sums[:, r, c] == luma[:, a:b, p:q].sum((1, 2))).all()
            assert size[r, c] == (b - a) * (q - p)


def test_rotation_is_the_shape_of_the_turned_raster():
    rgb = _rasters(128)
    luma = lambda x: (x.astype(np.int64) * S.LUMA).sum(3)
    turned = rgb
    for turns in range(5):
        place, sign = S.rotation(turns)
        assert (S.shape_vector(luma(rgb))[:, place] * sign == S.shape_vector(luma(turned))).all()
        turned = _turned(turned)


def test_histogram_counts_every_pixel_and_survives_brightening():
    rgb = (_rasters(16) // 2 + 40).astype(np.uint8)
    a, b = S.chroma_histogram(rgb), S.chroma_histogram(np.minimum(255, rgb.astype(int) * 116 // 100).astype(np.uint8))
    assert (a.sum(1) == 256).all()
    assert (np.minimum(a, b).sum(1) / 256 > 0.9).all()
    black = np.zeros((1, 16, 16, 3), np.uint8)
    assert S.chroma_histogram(black)[0, 36] == 256


def test_tone_and_sharpness_of_plain_rasters():
    grey = np.full((1, 16, 16, 3), 128, np.uint8)
    luma = (grey.astype(np.int64) * S.LUMA).sum(3)
    exposure, mean = S.tone(luma)
    assert np.isclose(mean[0], 128 / 255) and np.isclose(exposure[0], 0.6)
    assert S.sharpness(luma)[0] == 0
    assert S.sharpness(luma[:, :2, :2])[0] == 0


def test_fingerprints_skip_what_cannot_be_read(spark):
    rows = [(1, 16, bytes(768)), (2, 16, b"short"), (3, 16, None), (4, 32, bytes(range(256)) * 12)]
    df = spark.createDataFrame(rows, "asset_id long, edge int, rgb binary")
    got = {r.asset_id: r for r in S.fingerprints(df).collect()}
    assert sorted(got) == [1, 4]
    assert got[1].shape_norm == 0 and len(got[4].shape) == 480
    assert S.fingerprints(df.where("false")).count() == 0


def test_point_ids_and_half_precision(spark):
    assert export.fnv1a64([b"", b"a", b"foobar"]).tolist() == [0xCBF29CE484222325, 0xAF63DC4C8601EC8C, 0x85944171F73967E8]
    df = spark.createDataFrame([("a", [1.0, 1 / 3]), (None, None)], "k string, v array<double>")
    got = export.half_precision(export.point_ids(df, "k"), "v").collect()
    assert got[0].point_id == 0xAF63DC4C8601EC8C - 2**64 and got[1].point_id is None
    assert abs(got[0].v[1] - 1 / 3) < 1e-3 and got[0].v[1] != 1 / 3 and got[1].v is None
