"""A media library derived from the tables embeddings, events, lineitem and customer.

Every step is written twice, here for Spark and in fixture_sql for DuckDB.
Asset 8 v + k is variant k of vector v: 0 the original, 1 brightened, 2 coarser,
3 a quarter turn, 4 tinted, 5 black, 6 with its top mirrored; 7 is a clip of the
rasters of five vectors, and VIDEO_COPY higher lies its brightened copy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from twinlake import config as C
from twinlake.functions.assets import estimated_bytes, stamp
from twinlake.functions.signatures import fingerprints
from twinlake.session import partitions, ship_package, written

EDGE, VIDEO_COPY = 16, 8_000_000
#: Variant -> which vectors have it.
VARIANTS = {0: (1, 0), 1: (7, 0), 2: (7, 0), 3: (11, 0), 4: (5, 0), 5: (97, 0), 6: (13, 0)}


def _originals(v: np.ndarray, e: pa.Array) -> np.ndarray:
    """(rows, 256, 3): the raster of each vector; a missing entry is white."""
    some = e.is_valid().to_numpy(zero_copy_only=False)
    width = np.where(some, e.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    flat = e.flatten()
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(v)), width)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(width) - width, width)
    use = known & (place < 64)
    given, entry = np.zeros((len(v), 64), bool), np.zeros((len(v), 64))
    given[row[use], place[use]] = True
    entry[row[use], place[use]] = flat.fill_null(0).to_numpy(zero_copy_only=False)[use]
    third = np.fmod(v, 3)
    extra = {"r": 10 * np.fmod((v - third) // 3, 5), "g": 0 * v, "b": -8 * np.fmod((v - np.fmod(v, 15)) // 15, 5)}
    p, out = np.arange(256), np.empty((len(v), 256, 3), np.int64)
    for k, (c, shift) in enumerate({"r": 0, "g": 21, "b": 42}.items()):
        cell = (p // 32 * 8 + p % 16 // 2 + shift) % 64
        raw = np.floor((100 + 40 * third)[:, None] + 220 * entry[:, cell] + extra[c][:, None])
        out[:, :, k] = np.where(given[:, cell], np.clip(np.where(np.isnan(raw), 0, raw), 0, 255), 255)
    return out


def _bright(rgb: np.ndarray) -> np.ndarray:
    return np.minimum(255, rgb * 108 // 100)


_P = np.arange(256)
#: Where each pixel of a quarter turn, and of a raster with its top mirrored, comes from.
_TURNED = _P % 16 * 16 + 15 - _P // 16
_MIRRORED = np.where(_P // 16 < 6, _P // 16 * 16 + 15 - _P % 16, _P)
_CHANGES = {
    0: lambda x: x,
    1: _bright,
    2: lambda x: np.minimum(255, x // 8 * 8 + 4),
    3: lambda x: x[:, _TURNED],
    4: lambda x: x * np.array([88, 97, 100]) // 100,
    5: lambda x: np.full_like(x, 2),
    6: lambda x: x[:, _MIRRORED],
}


def _rasters(spark: SparkSession, sf_dir: str, of: Callable[[np.ndarray], list[tuple[np.ndarray, np.ndarray, np.ndarray, Callable]]]) -> DataFrame:
    """(asset_id, frame_idx, edge, rgb): of gives (rows, their ids, their frames, change of the raster) of some vectors v."""
    ship_package(spark)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                part = b.slice(low, 1024)
                v = part.column("v").to_numpy()
                base = _originals(v, part.column("e"))
                for rows, ids, frames, change in of(v):
                    raws = [x.tobytes() for x in change(base[rows]).astype(np.uint8)]
                    columns = [pa.array(ids, pa.int64()), pa.array(frames, pa.int32()), pa.array(np.full(len(rows), EDGE, np.int32)), pa.array(raws, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["asset_id", "frame_idx", "edge", "rgb"])

    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id is not null")
    e = e.select(F.col("vec_id").cast("long").alias("v"), F.col("embedding").cast("array<double>").alias("e"))
    # a file of vectors is small beside its rasters: they are made in as many tasks as the session asks for
    return e.repartition(partitions(spark), "v").mapInArrow(work, "asset_id long, frame_idx int, edge int, rgb binary")


def still_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, edge, rgb) of every still."""

    def of(v: np.ndarray) -> list:
        found = [(np.flatnonzero(np.fmod(v, every) == rest), k) for k, (every, rest) in VARIANTS.items()]
        return [(rows, 8 * v[rows] + k, 0 * rows, _CHANGES[k]) for rows, k in found]

    return _rasters(spark, sf_dir, of).select("asset_id", "edge", "rgb")


def keyframe_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, frame_idx, edge, rgb) of every clip: five frames, evenly spaced; a vector is a frame of one clip at most."""

    def of(v: np.ndarray) -> list:
        frame = np.fmod(v, 10) - 3
        s = v - frame
        clip = (frame >= 0) & (frame < C.KEYFRAMES)
        plain, copy = np.flatnonzero(clip), np.flatnonzero(clip & (np.fmod(s, 30) == 3))
        return [(plain, 8 * s[plain] + 7, frame[plain], _CHANGES[0]), (copy, 8 * s[copy] + 7 + VIDEO_COPY, frame[copy], _bright)]

    return _rasters(spark, sf_dir, of)


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset records of the library."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("v"))
    ks = F.array_compact(F.array(*(F.when(F.col("v") % every == rest, F.lit(k)) for k, (every, rest) in VARIANTS.items())))
    clips = v.where("v % 10 = 3").select("v", F.lit(7).alias("k"), F.lit(0).alias("far"))
    rows = v.select("v", F.explode(ks).alias("k"), F.lit(0).alias("far")).unionByName(clips)
    rows = rows.unionByName(clips.where("v % 30 = 3").withColumn("far", F.lit(VIDEO_COPY)))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("v"), "ts", "value")
    rows = rows.join(events, "v", "left")
    v, k = F.col("v"), F.col("k")
    wide = F.when(v % 3 == 0, 4032).when(v % 3 == 1, 1920).otherwise(3000)
    high = F.when(v % 3 == 0, 3024).when(v % 3 == 1, 1080).otherwise(3000)
    half = F.when(k.isin(1, 2), 2).otherwise(1)
    w, h = F.floor(wide / half).cast("int"), F.floor(high / half).cast("int")
    kind = F.when(k == 7, C.VIDEO).when(v % 20 == 1, C.SCREENSHOT).when(v % 20 == 2, C.LIVE).otherwise(C.PHOTO)
    out = rows.select(
        (8 * v + k + F.col("far")).alias("asset_id"),
        kind.alias("kind"),
        F.when(k == 3, h).otherwise(w).alias("pixel_width"),
        F.when(k == 3, w).otherwise(h).alias("pixel_height"),
        F.when(v % 29 != 0, F.timestamp_add("SECOND", 20 * k, F.col("ts"))).alias("creation_ts"),
        F.lit(None).cast("timestamp_ntz").alias("modification_ts"),
        F.when(k == 7, F.col("value") + F.when(F.col("far") > 0, 0.4).otherwise(0.0)).otherwise(0.0).alias("duration"),
        ((v % 17 == 0) & (k == 1)).alias("is_favorite"),
        F.when(v % 14 == 0, F.concat(F.lit("b"), v.cast("string"))).alias("burst_id"),
        ((v % 23 == 0) & (k == 2)).alias("is_edited"),
        (v % 19 == 0).alias("is_hdr"),
    )
    return out.withColumn("byte_size", estimated_bytes())


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, type, file_size) of the originals' files."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (8 * F.col("l_orderkey")).alias("asset_id"),
        F.when(F.col("l_returnflag") == "A", "adjustment").otherwise("original").alias("type"),
        F.floor("l_extendedprice").cast("long").alias("file_size"),
    )


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset_id, face_count, open_eye) of the assets that were looked at."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 3 <> 0")
    k = F.explode(F.array(*map(F.lit, (0, 1, 4)))).alias("k")
    return c.select("*", k).select(
        (8 * F.col("c_custkey") + F.col("k")).alias("asset_id"),
        ((F.col("c_nationkey") + F.col("k")) % 4).cast("int").alias("face_count"),
        (((F.col("c_custkey") + F.col("k")) % 11) / 10).alias("open_eye"),
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset records with their fingerprints, written once."""
    stills = fingerprints(still_pixels(spark, sf_dir)).withColumn("keyframes", F.array().cast("array<long>"))
    frames = keyframe_pixels(spark, sf_dir)
    # the frame number rides in the id, so that one pass signs all frames
    wide = frames.select((F.col("asset_id") * C.KEYFRAMES + F.col("frame_idx")).alias("asset_id"), "edge", "rgb")
    signed = fingerprints(wide).withColumn("frame_idx", (F.col("asset_id") % C.KEYFRAMES).cast("int"))
    signed = signed.withColumn("asset_id", F.expr(f"asset_id div {C.KEYFRAMES}"))
    from twinlake.operators.candidates import clip_fingerprints

    prints = stills.unionByName(clip_fingerprints(signed))
    return written(catalogue(spark, sf_dir).withColumn("stamp", stamp()).join(prints, "asset_id"), "library")
