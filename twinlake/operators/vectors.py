"""Exact nearest neighbours of shape vectors under quarter turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from twinlake import config as C
from twinlake.functions.assets import aspect_ratio, degenerate, overlap
from twinlake.operators.reach import block_scores

def indexable(library: DataFrame) -> DataFrame:
    """Stills with a shape, neither black nor white."""
    return library.where((F.size("keyframes") == 0) & (F.col("shape_norm") > 0) & ~degenerate(F.col("mean_luma")))


def nearest(queries: DataFrame, points: DataFrame, limit: int = C.NEIGHBOUR_LIMIT, floor: float = C.NEIGHBOUR_FLOOR) -> DataFrame:
    """(query, point, score): for each turn the limit + 1 best points, itself then left out, the best turn of each.

    Equal scores go by id. With the same DataFrame on both sides every pair is
    scored once. Exact: pairs are left out only where the angles to pivots rule
    them out (operators/reach.py).
    """
    scores = block_scores(queries, None if queries is points else points, floor, limit=limit + 1)
    return best_turns(scores, limit)


def best_turns(scores: DataFrame, limit: int = C.NEIGHBOUR_LIMIT) -> DataFrame:
    """(query, point, score) from scores of turns: for each turn the limit + 1 best, the query left out, the best turn of each."""
    ranked = Window.partitionBy("query", "turn").orderBy(F.desc("score"), "point")
    top = scores.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= limit + 1)
    return top.where("query <> point").groupBy("query", "point").agg(F.max("score").alias("score"))


def neighbour_pairs(lists: DataFrame, library: DataFrame, known: DataFrame, sensitivity: str) -> DataFrame:
    """(id_lo, id_hi, confidence) of neighbours past the pair rules, pairs already known left out.

    lists: (query, point, score), entries of either end; the better score counts.
    """
    t = C.ANYTIME[sensitivity]
    best = lists.where(F.col("score") >= t.neighbour_accept).groupBy(
        F.least("query", "point").alias("id_lo"), F.greatest("query", "point").alias("id_hi")
    ).agg(F.max("score").alias("score"))
    best = best.join(known.select("id_lo", "id_hi"), ["id_lo", "id_hi"], "left_anti")
    thin = indexable(library).select("asset_id", "kind", "mean_luma", aspect_ratio().alias("aspect"), "histogram")
    p = best.join(thin.select(F.col("asset_id").alias("id_lo"), F.struct("*").alias("a")), "id_lo")
    p = p.join(thin.select(F.col("asset_id").alias("id_hi"), F.struct("*").alias("b")), "id_hi")
    n = F.aggregate("a.histogram", F.lit(0), lambda s, x: s + x)
    p = p.withColumn("similarity", overlap(F.col("a.histogram"), F.col("b.histogram"), n))
    a, b = F.col("a.aspect"), F.col("b.aspect")
    fits = (
        ~((F.col("a.kind") == C.SCREENSHOT) & (F.col("b.kind") == C.SCREENSHOT))
        & (F.abs(F.col("a.mean_luma") - F.col("b.mean_luma")) <= C.LUMA_TOLERANCE)
        & (F.abs(a - b) / F.greatest(a, b) <= C.NEIGHBOUR_ASPECT)
        & (F.col("similarity") >= t.histogram_accept)
    )
    conf = F.least(F.lit(C.MODEL_CONFIDENCE), 0.35 * F.col("score") + 0.65 * F.col("similarity"))
    return p.where(fits).select("id_lo", "id_hi", conf.alias("confidence"))
