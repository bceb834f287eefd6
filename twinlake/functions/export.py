"""Small conversions for tables that leave the engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinlake.session import ship_package

# Offset and prime of the 64-bit FNV-1a hash.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a64(texts: list[bytes]) -> np.ndarray:
    """64-bit FNV-1a of each byte string, all strings a position at a time."""
    sizes = np.array([len(t) for t in texts])
    order = np.argsort(-sizes, kind="stable")
    wide = int(sizes.max(initial=0))
    table = np.zeros((len(texts), wide), np.uint64)
    for row, k in enumerate(order):
        table[row, : sizes[k]] = np.frombuffer(texts[k], np.uint8)
    out = np.full(len(texts), FNV_OFFSET, np.uint64)
    with np.errstate(over="ignore"):
        for p in range(wide):
            n = int((sizes > p).sum())
            out[:n] = (out[:n] ^ table[:n, p]) * np.uint64(FNV_PRIME)
    back = np.empty_like(out)
    back[order] = out
    return back


def point_ids(df: DataFrame, key: str, name: str = "point_id") -> DataFrame:
    """df with the FNV-1a hash of a key as the number of its point; null keys have none."""
    ship_package(df.sparkSession)

    @F.arrow_udf("long")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            keys = b.to_pylist()
            found = fnv1a64([(k or "").encode() for k in keys]).view(np.int64).tolist()
            yield pa.array([None if k is None else f for k, f in zip(keys, found, strict=True)], pa.int64())

    return df.withColumn(name, hashed(F.col(key).cast("string")))


def half_precision(df: DataFrame, vector: str) -> DataFrame:
    """df with an array of doubles rounded to what sixteen bits hold, as in the compact form of a shape."""
    ship_package(df.sparkSession)

    @F.arrow_udf("array<double>")
    def rounded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = b.to_pylist()
            yield pa.array([None if r is None else np.array(r, np.float16).astype(float).tolist() for r in rows], pa.list_(pa.float64()))

    return df.withColumn(vector, rounded(F.col(vector)))


def unit_shape(shape: str = "shape", norm: str = "shape_norm") -> Column:
    """The shape at unit length; all zero where it is blank."""
    length = F.sqrt(F.col(norm).cast("double"))
    return F.transform(shape, lambda x: F.when(length > 0, x / length).otherwise(0.0))


def payload() -> Column:
    """What is kept beside a vector, as JSON."""
    return F.to_json(F.struct(F.col("asset_id").alias("asset"), "stamp", "near_stamp", "near_version", "near"))


def keyframe_times(duration: Column, n: int) -> Column:
    """Seconds at which a clip is sampled: n places, evenly spaced, none at the ends."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda k: duration * k / (n + 1))
