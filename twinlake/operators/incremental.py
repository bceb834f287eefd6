"""What a rescan can reuse, as joins over keyed tables."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, functions as F

from twinlake import config as C
from twinlake.functions.assets import is_file


def _unchanged(a, b):
    return F.coalesce(F.abs(a - b) < C.UNCHANGED_S, F.lit(False))


def split_cached(records: DataFrame, cached: DataFrame) -> DataFrame:
    """records (asset_id, stamp) with reuse: whether the cached row's stamp is less than half a second off."""
    old = cached.select("asset_id", F.col("stamp").alias("__old"))
    out = records.join(old, "asset_id", "left")
    return out.withColumn("reuse", _unchanged(F.col("stamp"), F.col("__old"))).drop("__old")


def upsert(old: DataFrame, new: DataFrame, key: str = "asset_id") -> DataFrame:
    """old with the rows of new in place of those of equal key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def prune(cached: DataFrame, live: DataFrame, kinds: Collection[int], key: str = "asset_id") -> DataFrame:
    """cached without the rows that are live no more; only a scan of all kinds knows, and files are left."""
    if not C.all_kinds(kinds):
        return cached
    return cached.join(live.select(key), key, "left_semi").unionByName(
        cached.where(is_file(F.col(key))).join(live.select(key), key, "left_anti")
    )


def to_write(points: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """fingerprints whose point is missing or has another stamp; written points lose their neighbour lists."""
    split = split_cached(fingerprints, points)
    return split.where(~F.col("reuse")).drop("reuse")


def sync(points: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """points after to_write, with near, near_stamp and near_version null where written."""
    new = to_write(points, fingerprints.select("asset_id", "shape", "shape_norm", "stamp"))
    return upsert(points, new.select(*[c for c in points.columns if c in new.columns]))


def pending(points: DataFrame) -> DataFrame:
    """points that have to be searched for: never searched, or by another version, or before their last change."""
    fresh = (
        F.col("near").isNotNull()
        & (F.col("near_version") == C.NEAR_VERSION)
        & _unchanged(F.col("near_stamp"), F.col("stamp"))
    )
    return points.where(~F.coalesce(fresh, F.lit(False)))


def store_lists(points: DataFrame, lists: DataFrame) -> DataFrame:
    """points with the lists (query, point, score) found for pending ones, empty where nothing was found."""
    other = points.select(F.col("asset_id").alias("point"), F.col("stamp").alias("t"))
    near = lists.join(other, "point").groupBy(F.col("query").alias("asset_id")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("point").alias("a"), F.col("score").alias("s"), "t"))).alias("found")
    )  # a list is four times the neighbour limit at most
    todo = pending(points).select("asset_id", F.lit(True).alias("__todo"))
    out = points.join(todo, "asset_id", "left").join(near, "asset_id", "left")
    new = F.col("__todo").isNotNull()
    none = F.array().cast("array<struct<a: bigint, s: double, t: double>>")
    return out.withColumns(
        {
            "near": F.when(new, F.coalesce("found", none)).otherwise(F.col("near")),
            "near_stamp": F.when(new, F.col("stamp")).otherwise(F.col("near_stamp")),
            "near_version": F.when(new, F.lit(C.NEAR_VERSION)).otherwise(F.col("near_version")),
        }
    ).drop("__todo", "found")


def valid_lists(points: DataFrame) -> DataFrame:
    """(query, point, score) of stored entries whose point has not changed since."""
    entries = points.select(F.col("asset_id").alias("query"), F.explode("near").alias("n")).select("query", "n.*")
    now = points.select(F.col("asset_id").alias("a"), F.col("stamp").alias("now"))
    live = entries.join(now, "a").where(_unchanged(F.col("t"), F.col("now")))
    return live.select("query", F.col("a").alias("point"), F.col("s").alias("score"))
