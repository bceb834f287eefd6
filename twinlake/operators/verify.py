"""The rules that turn candidate pairs into confirmed ones."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from twinlake import config as C
from twinlake.functions.assets import confidence, cosine, degenerate, same_moment, shape_required


def accepted(d: Any, s: Any, shots: Any, t: C.Thresholds) -> Any:
    """Screenshots by structure and colour both, strictly; others led by either. Columns or arrays."""
    by_structure = (d <= t.hash_accept) & (s >= t.histogram_accept)
    by_colour = (s >= t.strong_histogram) & (d <= t.colour_led_hash)
    strictly = (d <= C.SCREENSHOT_HASH) & (s >= C.SCREENSHOT_HISTOGRAM)
    return (shots & strictly) | (~shots & (by_structure | by_colour))


def accepts(t: C.Thresholds) -> Column:
    shots = (F.col("a.kind") == C.SCREENSHOT) & (F.col("b.kind") == C.SCREENSHOT)
    return accepted(F.col("hash_distance"), F.col("histogram_similarity"), shots, t)


def routes(pairs: DataFrame, library: DataFrame, sensitivity: str) -> DataFrame:
    """pairs with route, confidence (null: not confirmed yet) and accept (cosine asked for in the grey zone).

    The first route that applies decides: degenerate, direct, moment, grey_moment,
    grey; pairs of no route are dropped.
    """
    t, anytime = C.LEVELS[sensitivity], C.ANYTIME[sensitivity]
    thin = library.select("asset_id", "kind", "mean_luma", "creation_ts")
    p = pairs.join(thin.select(F.col("asset_id").alias("id_lo"), F.struct("*").alias("a")), "id_lo")
    p = p.join(thin.select(F.col("asset_id").alias("id_hi"), F.struct("*").alias("b")), "id_hi")
    d, s = F.col("hash_distance"), F.col("histogram_similarity")
    flat = degenerate(F.col("a.mean_luma")) | degenerate(F.col("b.mean_luma"))
    moment = same_moment("a.creation_ts", "b.creation_ts") if sensitivity == "similar" else F.lit(False)
    video = (F.col("a.kind") == C.VIDEO) | (F.col("b.kind") == C.VIDEO)
    route = (
        F.when(flat, F.when((d == 0) & (s >= C.DEGENERATE_HISTOGRAM), "degenerate"))
        .when(accepts(anytime), "direct")
        .when(moment & accepts(t), "moment")
        .when(video, None)
        .when(moment, "grey_moment")
        .when(d <= anytime.hash_reject, "grey")
    )
    conf = confidence(d, s)
    r = F.col("route")
    return p.withColumn("route", route).where(r.isNotNull()).select(
        "id_lo", "id_hi", "hash_distance", "histogram_similarity", "route",
        F.when(r == "degenerate", C.DEGENERATE_CONFIDENCE)
        .when(r == "direct", conf)
        .when(r == "moment", F.least(F.lit(C.MOMENT_CONFIDENCE), conf)).alias("confidence"),
        F.when(r == "grey_moment", shape_required(s, t)).when(r == "grey", shape_required(s, anytime)).alias("accept"),
    )


def grey_scores(routed: DataFrame, library: DataFrame) -> DataFrame:
    """(id_lo, id_hi, score, accept, confidence) of the grey zone: exact cosines of the pairs asked for only."""
    grey = routed.where(F.col("route").isin("grey", "grey_moment"))
    shapes = library.where((F.size("keyframes") == 0) & (F.col("shape_norm") > 0)).select("asset_id", "shape", "shape_norm")
    g = grey.join(shapes.select(F.col("asset_id").alias("id_lo"), F.col("shape").alias("sa"), F.col("shape_norm").alias("na")), "id_lo")
    g = g.join(shapes.select(F.col("asset_id").alias("id_hi"), F.col("shape").alias("sb"), F.col("shape_norm").alias("nb")), "id_hi")
    score = cosine(F.col("sa"), F.col("sb"), F.col("na"), F.col("nb"))
    conf = F.least(F.lit(C.MODEL_CONFIDENCE), confidence(F.col("hash_distance"), F.col("histogram_similarity")))
    return g.select("id_lo", "id_hi", score.alias("score"), "accept", conf.alias("confidence"))


def confirmed(routed: DataFrame, scores: DataFrame) -> DataFrame:
    """(id_lo, id_hi, confidence, via) of the pairs that the rules or the grey zone confirm."""
    direct = routed.where("confidence is not null").select("id_lo", "id_hi", "confidence", F.col("route").alias("via"))
    grey = scores.where("score >= accept").select("id_lo", "id_hi", "confidence", F.lit("shape").alias("via"))
    return direct.unionByName(grey)
