"""Pixels of images, squashed to small squares."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinlake.functions.assets import file_id
from twinlake.session import ship_package
from twinlake.sources.catalog import plain_uri
from twinlake.sources.headers import orientation, upright
from twinlake.sources.shared_files import reader

EDGE = 128


def squash(pixels: np.ndarray, edge: int) -> np.ndarray:
    """The whole raster (height, width, 3) as edge x edge means of boxes; small rasters repeat pixels."""
    h, w, _ = pixels.shape
    total = np.zeros((h + 1, w + 1, 3), np.int64)
    total[1:, 1:] = pixels.astype(np.int64).cumsum(0).cumsum(1)
    cuts = lambda n: np.arange(edge + 1) * n // edge
    rows, columns = cuts(h), cuts(w)
    top, left = rows[:-1], columns[:-1]
    bottom, right = np.maximum(top + 1, rows[1:]), np.maximum(left + 1, columns[1:])
    at = lambda a, b: total[a][:, b]
    sums = at(bottom, right) - at(top, right) - at(bottom, left) + at(top, left)
    size = np.outer(bottom - top, right - left)[:, :, None]
    return ((2 * sums + size) // (2 * size)).astype(np.uint8)


def load_pixels(spark: SparkSession, path: str, edge: int = EDGE) -> DataFrame:
    """(asset_id, origin, status, edge, rgb) of each image below a path: ready, or undecodable without pixels.

    asset_id is that of the file, as in a scan of the folder. A JPEG file whose
    EXIF data turn or mirror it is put upright first.
    """
    ship_package(spark)
    images = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    flat = images.select(plain_uri("image.origin").alias("origin"), F.col("image.origin").alias("path"), "image.width", "image.height", "image.nChannels", "image.data")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("origin", "path", "width", "height", "nChannels", "data")), strict=True)
            out = []
            for origin, path, w, h, n, data in rows:
                if not data or min(w, h) <= 0 or len(data) != w * h * n:
                    out.append((origin, "undecodable", edge, None))
                    continue
                raw = np.frombuffer(data, np.uint8).reshape(h, w, n)
                rgb = np.repeat(raw, 3, axis=2) if n == 1 else raw[:, :, 2::-1]  # stored blue first
                if origin.lower().endswith((".jpg", ".jpeg")):
                    rgb = upright(rgb, orientation(reader(path)[0]))
                out.append((origin, "ready", edge, squash(rgb, edge).tobytes()))
            kind = pa.schema([("origin", pa.string()), ("status", pa.string()), ("edge", pa.int32()), ("rgb", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), kind)], schema=kind)

    out = flat.mapInArrow(work, "origin string, status string, edge int, rgb binary")
    return out.select(file_id(F.col("origin")).alias("asset_id"), "origin", "status", "edge", "rgb")


def outcomes(catalogue: DataFrame, pixels: DataFrame) -> DataFrame:
    """(asset_id, status) of every asset: that of its pixels, else notDownloaded where is_local is false, else missing."""
    away = ~F.coalesce("is_local", F.lit(True)) if "is_local" in catalogue.columns else F.lit(False)
    want = catalogue.select("asset_id", F.when(away, "notDownloaded").otherwise("missing").alias("absent"))
    return want.join(pixels.select("asset_id", "status"), "asset_id", "left").select("asset_id", F.coalesce("status", "absent").alias("status"))


def skip_counts(found: DataFrame) -> DataFrame:
    """(ready, not_downloaded, unreadable): how many images could be read, and how many not and why, in one row."""
    s = F.col("status")
    return found.agg(
        F.count_if(s == "ready").alias("ready"),
        F.count_if(s == "notDownloaded").alias("not_downloaded"),
        F.count_if(s.isin("missing", "undecodable")).alias("unreadable"),
    )
