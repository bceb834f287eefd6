"""Visual signatures of small rasters, in exact integers where they are compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinlake.session import ship_package

#: Weights of the channels in a thousandth of luma.
LUMA = np.array([299, 587, 114], np.int64)
GRID = 16
SIGNATURES = (
    "asset_id long, dhash long, histogram array<int>, shape array<int>, shape_norm long, sharpness double, "
    "exposure double, mean_luma double"
)


def _bounds(edge: int, cells: int) -> list[tuple[int, int]]:
    low = [k * edge // cells for k in range(cells + 1)]
    return [(a, max(a + 1, b)) for a, b in zip(low, low[1:])]


def box_sums(luma: np.ndarray, rows: int, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and pixel counts of the cells of a grid laid over each raster."""
    edge = luma.shape[1]
    total = np.zeros((len(luma), edge + 1, edge + 1), np.int64)
    total[:, 1:, 1:] = luma.cumsum(1).cumsum(2)
    r, c = np.array(_bounds(edge, rows)), np.array(_bounds(edge, columns))
    at = lambda i, j: total[:, i][:, :, j]
    sums = at(r[:, 1], c[:, 1]) - at(r[:, 0], c[:, 1]) - at(r[:, 1], c[:, 0]) + at(r[:, 0], c[:, 0])
    return sums, np.outer(r[:, 1] - r[:, 0], c[:, 1] - c[:, 0])


def difference_hash(luma: np.ndarray) -> np.ndarray:
    """64 bits, the least first: set where a cell of 9 x 8 is darker than its right neighbour."""
    sums, size = box_sums(luma, 8, 9)
    darker = sums[:, :, :-1] * size[:, 1:] < sums[:, :, 1:] * size[:, :-1]
    bits = darker.reshape(len(luma), 64).astype(np.uint64) << np.arange(64, dtype=np.uint64)
    return np.bitwise_or.reduce(bits, axis=1).view(np.int64)


def chroma_histogram(rgb: np.ndarray) -> np.ndarray:
    """Counts in 8 x 8 bins of the red and green shares; nearly black pixels lie in the middle."""
    flat = rgb.reshape(len(rgb), -1, 3).astype(np.int64)
    total = flat.sum(2)
    share = np.minimum(7, 8 * flat[:, :, :2] // np.maximum(1, total)[:, :, None])
    bins = np.where(total < 30, 36, 8 * share[:, :, 0] + share[:, :, 1])
    rows = np.arange(len(rgb))[:, None] * 64
    return np.bincount((rows + bins).ravel(), minlength=64 * len(rgb)).reshape(-1, 64)


def shape_vector(luma: np.ndarray) -> np.ndarray:
    """240 differences to the right, then 240 downwards, of the cells of a 16 x 16 grid."""
    sums, _ = box_sums(luma, GRID, GRID)
    right, down = sums[:, :, 1:] - sums[:, :, :-1], sums[:, 1:] - sums[:, :-1]
    return np.concatenate([right.reshape(len(luma), -1), down.reshape(len(luma), -1)], axis=1)


def rotation(turns: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, sign): the shape of the raster turned clockwise by quarter turns is sign * shape[place]."""
    n = GRID
    place, sign = np.arange(2 * n * (n - 1)), np.ones(2 * n * (n - 1), np.int64)
    half = n * (n - 1)
    step, flip = np.zeros(2 * half, np.int64), np.ones(2 * half, np.int64)
    for r in range(n):
        for c in range(n - 1):
            step[r * (n - 1) + c], flip[r * (n - 1) + c] = half + (n - 2 - c) * n + r, -1
    for r in range(n - 1):
        for c in range(n):
            step[half + r * n + c] = (n - 1 - c) * (n - 1) + r
    for _ in range(turns % 4):
        place, sign = place[step], flip * sign[step]
    return place, sign


def sharpness(luma: np.ndarray) -> np.ndarray:
    """A thousand times the variance of the Laplacian of the luma, inner pixels only."""
    if luma.shape[1] <= 2:
        return np.zeros(len(luma))
    lap = 4 * luma[:, 1:-1, 1:-1] - luma[:, :-2, 1:-1] - luma[:, 2:, 1:-1] - luma[:, 1:-1, :-2] - luma[:, 1:-1, 2:]
    lap = lap.reshape(len(luma), -1)
    n, s, q = lap.shape[1], lap.sum(1).astype(float), (lap * lap).sum(1).astype(float)
    return np.maximum(0.0, q / n - (s / n) * (s / n)) / (255000.0 * 255000.0) * 1000.0


def tone(luma: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(exposure, mean luma): few clipped pixels and a wide middle range make a good exposure."""
    flat = luma.reshape(len(luma), -1)
    n = flat.shape[1]
    rows = np.arange(len(luma))[:, None] * 256
    counts = np.bincount((rows + flat // 1000).ravel(), minlength=256 * len(luma)).reshape(-1, 256)
    clipped = counts[:, [0, 1, 254, 255]].sum(1) / n
    upto = counts.cumsum(1)
    low, high = ((upto >= int(n * f)).argmax(1) for f in (0.05, 0.95))
    spread = np.minimum(1.0, (high - low) / 255.0 / 0.8)
    exposure = 0.6 * np.maximum(0.0, 1 - 1.5 * clipped) + 0.4 * spread
    return np.clip(exposure, 0, 1), flat.sum(1) / (255000.0 * n)


def signature_columns(rgb: np.ndarray) -> list[np.ndarray]:
    """All signatures of rasters (rows, edge, edge, 3), from one decoding."""
    luma = (rgb.astype(np.int64) * LUMA).sum(3)
    shape = shape_vector(luma)
    exposure, mean = tone(luma)
    norm = (shape * shape).sum(1)
    return [difference_hash(luma), chroma_histogram(rgb), shape, norm, sharpness(luma), exposure, mean]


def fingerprints(pixels: DataFrame) -> DataFrame:
    """One row of signatures for each row of pixels (asset_id, edge, rgb binary).

    Rows whose rgb is null or not 3 * edge * edge bytes cannot be read and have
    none. A blank raster has shape_norm 0.
    """
    ship_package(pixels.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, edges, raws = (b.column(c).to_pylist() for c in ("asset_id", "edge", "rgb"))
            for edge in sorted({e for e in edges if e}):
                good = [k for k, (e, r) in enumerate(zip(edges, raws)) if e == edge and r and len(r) == 3 * e * e]
                for low in range(0, len(good), 512):
                    own = good[low : low + 512]
                    rgb = np.frombuffer(b"".join(raws[k] for k in own), np.uint8).reshape(-1, edge, edge, 3)
                    dhash, hist, shape, norm, sharp, exposure, mean = signature_columns(rgb)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[k] for k in own], pa.int64()),
                            pa.array(dhash),
                            pa.array(hist.astype(np.int32).tolist(), pa.list_(pa.int32())),
                            pa.array(shape.astype(np.int32).tolist(), pa.list_(pa.int32())),
                            *(pa.array(x) for x in (norm, sharp, exposure, mean)),
                        ],
                        names=[x.split()[0] for x in SIGNATURES.split(", ")],
                    )

    return pixels.select("asset_id", "edge", "rgb").mapInArrow(work, SIGNATURES)


def rotated(shape: str, turns: int):
    """The shape column turned by quarter turns, as an expression."""
    place, sign = rotation(turns)
    at = F.array(*(F.lit(int(p)) for p in place))
    flip = F.array(*(F.lit(int(s)) for s in sign))
    return F.zip_with(F.transform(at, lambda p: F.get(F.col(shape), p)), flip, lambda x, s: x * s)
