"""Which member of a group to keep, and what a group looks like as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from twinlake import config as C
from twinlake.functions.assets import pixel_count, resolution_label, seconds_between
from twinlake.session import partitions, written

def _group():
    return Window.partitionBy("group_id")


def enrich(members: DataFrame, resources: DataFrame) -> DataFrame:
    """members with true sizes and edit flags, from the files of grouped assets only.

    The size is the sum over files that hold no adjustments, the estimate where
    that is nothing.
    """
    held = resources.join(members.select("asset_id").distinct(), "asset_id", "left_semi")
    size = F.sum(F.when(F.col("type") != "adjustment", F.col("file_size")))
    held = held.groupBy("asset_id").agg(size.alias("__bytes"), F.bool_or(F.col("type") == "adjustment").alias("__edited"))
    out = members.join(held, "asset_id", "left")
    known = F.when(F.col("__bytes") > 0, F.col("__bytes"))
    return out.withColumns(
        {"byte_size": F.coalesce(known, "byte_size"), "is_edited": F.coalesce("__edited", "is_edited")}
    ).drop("__bytes", "__edited")


def face_info(landmarks: DataFrame) -> DataFrame:
    """(asset_id, face_count, open_eye) from landmarks (asset_id, face, eye_width, eye_height), a row an eye.

    An eye is shut at a height of a tenth of its width and open at three tenths; a
    face is as open as its eyes on average, an asset as its faces.
    """
    ratio = F.col("eye_height") / F.when(F.col("eye_width") > 0, F.col("eye_width"))
    openness = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.avg(ratio) - 0.10) / 0.20))
    each = landmarks.groupBy("asset_id", "face").agg(openness.alias("o"))
    return each.groupBy("asset_id").agg(F.count(F.lit(1)).cast("int").alias("face_count"), F.avg(F.coalesce("o", F.lit(0.0))).alias("open_eye"))


def normalised(value: Column) -> Column:
    """Place between the least and the most of the group; a half where all are alike."""
    low, high = F.min(value).over(_group()), F.max(value).over(_group())
    return F.when(high - low > 1e-9, (value - low) / (high - low)).otherwise(0.5)


def contenders(members: DataFrame) -> DataFrame:
    """(group_id, asset_id) of the members that faces are looked for in.

    Groups whose sharpness differs enough send their first three members, in
    order of group_id, as long as the budget holds three more.
    """
    sharp = members.groupBy("group_id").agg(
        F.max("sharpness").alias("hi"), F.min("sharpness").alias("lo"), F.count(F.lit(1)).alias("n")
    )
    wide = sharp.where((F.col("hi") > 0) & ((F.col("hi") - F.col("lo")) / F.col("hi") > C.SHARPNESS_SPREAD))
    wide = wide.withColumn("cost", F.least(F.col("n"), F.lit(C.FACE_CONTENDERS)))
    # only the first groups can be within the budget, as each costs two at least
    wide = wide.orderBy("group_id").limit(C.FACE_BUDGET)
    spent = F.sum("cost").over(Window.orderBy("group_id").rowsBetween(Window.unboundedPreceding, -1))
    run = wide.withColumn("spent", F.coalesce(spent, F.lit(0))).where(
        C.FACE_BUDGET - F.col("spent") >= C.FACE_CONTENDERS
    )
    return members.where(F.col("position") < C.FACE_CONTENDERS).join(run.select("group_id"), "group_id").select("group_id", "asset_id")


def scored(members: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """members (group_id, position and asset and fingerprint columns) with score, rank (1: keep) and highlights."""
    m = members
    if faces is None:
        m = m.withColumns({"face_count": F.lit(None).cast("int"), "open_eye": F.lit(None).cast("double")})
    else:
        m = m.join(faces.select("asset_id", "face_count", "open_eye"), "asset_id", "left")
    with_faces = F.coalesce(F.max("face_count").over(_group()) > 0, F.lit(False))
    face = F.when(F.col("face_count").isNull(), 0.5).otherwise(
        0.7 * normalised(F.col("open_eye")) + 0.3 * normalised(F.col("face_count").cast("double"))
    )
    resolution = F.log2(F.greatest(F.lit(1), pixel_count()).cast("double"))
    w, b = C.WEIGHTS, C.BONUS
    mixed = F.max((F.col("kind") != C.SCREENSHOT).cast("int")).over(_group()) > 0
    flag = lambda cond, x: F.when(cond, F.lit(x)).otherwise(0.0)
    total = (
        w["sharpness"] * normalised(F.col("sharpness"))
        + w["resolution"] * normalised(resolution)
        + w["exposure"] * normalised(F.col("exposure"))
        + w["bytes"] * normalised(F.col("byte_size").cast("double"))
        + F.when(with_faces, w["faces"] * face).otherwise(0.0)
        + flag(F.col("is_favorite"), b["favourite"])
        + flag(F.col("is_edited"), b["edited"])
        + flag(F.col("kind") == C.LIVE, b["live"])
        + flag(F.col("is_hdr"), b["hdr"])
        + flag((F.col("kind") == C.SCREENSHOT) & mixed, b["screenshot"])
    )

    def first_by(value: Column) -> Column:
        return F.row_number().over(_group().orderBy(F.desc(value), "position")) == 1

    eldest = F.row_number().over(_group().orderBy(F.asc_nulls_last("creation_ts"), "position")) == 1
    wins = [
        ("favourite", F.col("is_favorite")),
        ("edited", F.col("is_edited")),
        ("sharpest", first_by(F.col("sharpness"))),
        ("highestResolution", first_by(resolution)),
        ("eyesOpen", with_faces & first_by(F.coalesce("open_eye", F.lit(0.0)))),
        ("mostFaces", with_faces & first_by(F.coalesce("face_count", F.lit(0)))),
        ("bestExposure", first_by(F.col("exposure"))),
        ("original", eldest),
        ("largestFile", first_by(F.col("byte_size"))),
        ("livePhoto", F.col("kind") == C.LIVE),
        ("highDynamicRange", F.col("is_hdr")),
    ]
    m = m.withColumn("score", F.round(total, 9))
    m = m.withColumns({f"__w{k}": won for k, (_, won) in enumerate(wins)})
    shown = F.array_compact(F.array(*(F.when(F.col(f"__w{k}"), F.lit(name)) for k, (name, _) in enumerate(wins))))
    m = m.withColumn("highlights", F.slice(shown, 1, 3)).drop(*(f"__w{k}" for k in range(len(wins))))
    return m.withColumn("rank", F.row_number().over(_group().orderBy(F.desc("score"), "position")))


def group_confidence(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(group_id, confidence): the mean over confirmed pairs inside, 0.8 where there is none.

    Confidences are added as whole numbers of 1e-10, so the order of addition does not show.
    """
    m = members.select("group_id", "asset_id")
    inside = edges.join(m.withColumnsRenamed({"asset_id": "id_lo"}), "id_lo")
    inside = inside.join(m.withColumnsRenamed({"asset_id": "id_hi", "group_id": "g2"}), "id_hi").where("group_id = g2")
    units = F.floor(F.col("confidence") * 1e10 + 0.5).cast("decimal(38,0)")
    mean = inside.groupBy("group_id").agg((F.sum(units).cast("double") / F.count(F.lit(1)) / 1e10).alias("c"))
    out = m.select("group_id").distinct().join(mean, "group_id", "left")
    return out.select("group_id", F.coalesce("c", F.lit(C.DEFAULT_CONFIDENCE)).alias("confidence"))


def dominant_kind(members: DataFrame) -> DataFrame:
    """(group_id, kind): the most frequent kind, the lowest code on a tie."""
    n = members.groupBy("group_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("group_id").agg(F.max_by("kind", F.struct("n", -F.col("kind"))).alias("kind"))


def burst_flag(members: DataFrame) -> DataFrame:
    """(group_id, is_burst): one burst id among those known, or three and more alike and close in time."""
    order = _group().orderBy("creation_ts", "asset_id")
    gaps = members.withColumn("prev", F.lag("creation_ts").over(order))
    g = gaps.groupBy("group_id").agg(
        F.count_distinct("burst_id").alias("bursts"),
        F.count(F.lit(1)).alias("n"),
        F.count("creation_ts").alias("dated"),
        F.count_distinct(resolution_label()).alias("sizes"),
        F.max(seconds_between("prev", "creation_ts")).alias("gap"),
    )
    close = (F.col("n") >= 3) & (F.col("sizes") == 1) & (F.col("dated") == F.col("n")) & (F.col("gap") <= C.BURST_GAP_S)
    return g.select("group_id", ((F.col("bursts") == 1) | F.coalesce(close, F.lit(False))).alias("is_burst"))


def groups(ranked: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a group: members, keeper, kind, burst flag, confidence and bytes that deleting the rest frees."""
    g = ranked.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.min(F.when(F.col("rank") == 1, F.col("asset_id"))).alias("keeper_id"),
        F.coalesce(F.sum(F.when(F.col("rank") > 1, F.col("byte_size"))), F.lit(0)).alias("reclaimable_bytes"),
    )
    g = g.join(dominant_kind(ranked), "group_id").join(burst_flag(ranked), "group_id")
    return g.join(group_confidence(ranked, edges), "group_id").orderBy(F.desc("reclaimable_bytes"), "group_id")


def summary(of_groups: DataFrame, scanned: int | Column) -> DataFrame:
    """Totals of a scan in one row."""
    return of_groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum(F.col("members") - 1), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum("reclaimable_bytes"), F.lit(0)).alias("reclaimable_bytes"),
    ).withColumn("assets_scanned", F.lit(scanned))


def numbered(rows: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """rows with their place, from 1, in an order that leaves no ties.

    Rows are dealt by ranges of the order; a range's rows are numbered in its task
    and put behind those of the ranges before it, of which only the sizes meet.
    """
    part = "__part"
    t = rows.repartitionByRange(partitions(rows.sparkSession), *order).withColumn(part, F.spark_partition_id())
    t = written(t, "numbered")
    sizes = t.groupBy(part).agg(F.count(F.lit(1)).alias("__n"))
    before = F.sum("__n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    ahead = F.broadcast(sizes.select(part, F.coalesce(before, F.lit(0)).alias("__ahead")))
    own = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return t.withColumn(name, own).join(ahead, part).withColumn(name, (F.col(name) + F.col("__ahead")).cast("int")).drop(part, "__ahead")
