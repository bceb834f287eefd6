"""Catalogue drops taken in as they arrive; an addition of ours, the scan itself is batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from twinlake.functions.signatures import fingerprints
from twinlake.operators import incremental
from twinlake.schema import PIXELS, POINTS
from twinlake.session import written
from twinlake.sources.parts import Buckets
from twinlake.sources.store import Store


def rescan(pixels: DataFrame, stamps: DataFrame, prints: Store | Buckets, points: Store | Buckets | None = None) -> int:
    """Signs what is new or changed, updates the stores and returns how many were signed.

    pixels: (asset_id, edge, rgb); stamps: (asset_id, stamp). Only rows that
    changed are handed to the stores; kept in Buckets, only their buckets are
    written again.
    """
    todo = incremental.split_cached(stamps, prints.load()).where(~F.col("reuse")).select("asset_id", "stamp")
    new = fingerprints(pixels.join(todo.select("asset_id"), "asset_id", "left_semi"))
    new = new.join(todo, "asset_id").withColumn("keyframes", F.array().cast("array<long>"))
    new = written(new, "rescan-prints")
    n = todo.count()
    if n:
        prints.save(new)
    if points is not None:
        held = points.load()
        changed = incremental.to_write(held, prints.load().select("asset_id", "shape", "shape_norm", "stamp"))
        fields = (f for f in POINTS.fields if f.name not in changed.columns)
        # a point that is written loses its neighbour list
        changed = changed.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in fields)).select(*POINTS.names)
        changed = written(changed, "rescan-points")
        if not changed.isEmpty():
            points.save(changed)
    return n


def ingest(
    spark: SparkSession, path: str, checkpoint: str, prints: Store | Buckets, points: Store | Buckets | None = None,
    done: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Watches a folder of Parquet files (asset_id, edge, rgb, stamp) and keeps the stores up to date.

    Upserts are by key, so a batch that is repeated after a failure changes nothing.
    Of rows with one asset_id in a batch the newest counts.
    """
    schema = T.StructType([*PIXELS.fields, T.StructField("stamp", T.DoubleType())])
    source = spark.readStream.schema(schema).parquet(path)

    def take(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("asset_id").agg(F.max_by(F.struct("edge", "rgb", "stamp"), "stamp").alias("r"))
        newest = newest.select("asset_id", "r.*")
        n = rescan(newest.select("asset_id", "edge", "rgb"), newest.select("asset_id", "stamp"), prints, points)
        if done:
            done(n)

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
