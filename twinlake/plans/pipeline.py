"""The whole scan over a table of assets with fingerprints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from twinlake import config as C
from twinlake.operators import candidates as cand, codes, scoring, vectors, verify
from twinlake.operators.graph import star_clusters
from twinlake.plans.control import Progress
from twinlake.session import written
from twinlake.sources import images


@dataclass
class Scan:
    """Tables of one scan; each is written once. skipped: how many assets could not be read, and why."""

    edges: DataFrame
    members: DataFrame
    ranked: DataFrame
    groups: DataFrame
    skipped: DataFrame | None = None


def confirmed_pairs(
    library: DataFrame, sensitivity: str, lists: DataFrame | None = None, progress: Progress = Progress()
) -> DataFrame:
    """(id_lo, id_hi, confidence, via) of all confirmed pairs: by rule, by shape, by neighbourhood."""
    progress.begin("rules", 2)
    points = vectors.indexable(library).select("asset_id", "shape", "shape_norm")
    # the grey zone asks for the shapes of stills of any luma
    shaped = library.where((F.size("keyframes") == 0) & (F.col("shape_norm") > 0)).select("asset_id", "shape", "shape_norm")
    pairs = cand.candidates(library, sensitivity, codes.shape_codes(shaped, C.LEVELS[sensitivity].shape_accept))
    routed = written(verify.routes(pairs, library, sensitivity), "routes")
    progress.done(1)
    known = written(verify.confirmed(routed, verify.grey_scores(routed, library)), "confirmed")
    progress.done(2)
    progress.begin("neighbours")
    if lists is None:
        lists = vectors.nearest(points, points)
    near = vectors.neighbour_pairs(lists, library, known, sensitivity)
    return known.unionByName(near.withColumn("via", F.lit("neighbour")))


def run_pipeline(
    library: DataFrame,
    sensitivity: str = "strict",
    faces: DataFrame | None = None,
    resources: DataFrame | None = None,
    lists: DataFrame | None = None,
    progress: Progress = Progress(),
    found: DataFrame | None = None,
) -> Scan:
    """Confirmed pairs, star clusters, ranked members and groups of a library.

    found: (asset_id, status) of all assets of the catalogue (images.outcomes),
    of which the scan then says how many it had to leave out.
    """
    edges = written(confirmed_pairs(library, sensitivity, lists, progress), "edges")
    progress.done(1)
    progress.begin("clusters", 2)
    stars = star_clusters(edges.select(F.col("id_lo").alias("src"), F.col("id_hi").alias("dst"), "confidence"), C.MAX_GROUP)
    progress.done(1)
    members = stars.withColumnsRenamed({"cluster": "group_id", "node": "asset_id"}).join(library, "asset_id")
    if resources is not None:
        members = scoring.enrich(members, resources)
    members = written(members, "members")
    progress.done(2)
    progress.begin("scores")
    if faces is not None:
        faces = faces.join(scoring.contenders(members).select("asset_id").distinct(), "asset_id", "left_semi")
    ranked = written(scoring.scored(members, faces), "ranked")
    progress.done(1)
    skipped = written(images.skip_counts(found), "skipped") if found is not None else None
    return Scan(edges, members, ranked, scoring.groups(ranked, edges), skipped)
