"""Queries on the derived media library, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from twinlake import config as C
from twinlake.functions import assets as A, export, signatures as S
from twinlake.operators import candidates as cand, incremental, review, scoring, vectors, verify
from twinlake.operators.graph import connected_components, star_clusters
from twinlake.operators.neighbour_index import NeighbourIndex
from twinlake.plans import fixture, pipeline
from twinlake.plans.fixture_sql import query
from twinlake.schema import FINGERPRINTS, PRINT_SIZES
from twinlake.session import new_path, written
from twinlake.sources import catalog
from twinlake.sources.parts import Buckets
from twinlake.sources.store import Store

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Tables that one query needs more than once; each query begins with none.
_tables: dict[tuple, DataFrame] = {}
_libraries: dict[tuple, DataFrame] = {}


def _once(spark: SparkSession, *key, make) -> DataFrame:
    if key not in _tables:
        _tables[key] = make()
    return _tables[key]


def library(spark: SparkSession, d: str) -> DataFrame:
    """The derived library, which is a stored table to the queries: written again only when its inputs change."""
    inputs = [spark.read.parquet(f"{d}/{t}.parquet").select("_metadata.file_modification_time") for t in ("embeddings", "events")]
    stamps = [i.agg(F.max("file_modification_time"), F.count(F.lit(1))).first() for i in inputs]
    key = (spark.sparkContext.applicationId, d, *map(tuple, stamps))
    if key not in _libraries:
        _libraries[key] = fixture.library(spark, d)
    return _libraries[key]


def _library(spark: SparkSession, d: str) -> DataFrame:
    return _once(spark, d, "library", make=lambda: library(spark, d))


def _routes(spark: SparkSession, d: str, level: str) -> DataFrame:
    lib = _library(spark, d)
    make = lambda: written(verify.routes(cand.candidates(lib, level), lib, level), "routes")
    return _once(spark, d, "routes", level, make=make)


def _edges(spark: SparkSession, d: str, level: str) -> DataFrame:
    return _once(spark, d, "edges", level, make=lambda: written(pipeline.confirmed_pairs(_library(spark, d), level), "edges"))


def _star_edges(spark: SparkSession, d: str, level: str) -> DataFrame:
    return _edges(spark, d, level).select(F.col("id_lo").alias("src"), F.col("id_hi").alias("dst"), "confidence")


def _members(spark: SparkSession, d: str, level: str = "strict") -> DataFrame:
    """Components as groups, members in order of id."""

    def make() -> DataFrame:
        parts = connected_components(_star_edges(spark, d, level))
        m = parts.withColumnsRenamed({"node": "asset_id", "component": "group_id"}).join(_library(spark, d), "asset_id")
        order = Window.partitionBy("group_id").orderBy("asset_id")
        return written(m.withColumn("position", F.row_number().over(order) - 1), "members")

    return _once(spark, d, "members", level, make=make)


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    make = lambda: written(scoring.scored(_members(spark, d), fixture.faces(spark, d)), "ranked")
    return _once(spark, d, "ranked", make=make)


def _register(name: str, sql: str | None = None):
    def keep(f):
        def run(spark: SparkSession, d: str) -> DataFrame:
            _tables.clear()
            return f(spark, d)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _sixth(c: str):
    """Six digits by arithmetic that both engines do alike, for means that can lie on an edge."""
    return (F.floor(F.col(c) * 1e6 + 0.5) / 1e6).alias(c)


def _sixths(c: str):
    """As _r for values of either sign below 1e12, as DuckDB does it: without the digits of each as text, for very many rows."""
    n = F.floor(F.abs(F.col(c)) * 1e6 + 0.5)
    return (F.when(F.col(c) < 0, -n).otherwise(n) / 1e6).alias(c)


_MEAN = "CAST(sum(CAST(floor(confidence * 1e10 + 0.5::DOUBLE) AS BIGINT)) AS DOUBLE) / count(*) / 1e10"


# records

_RECORD = "asset_id, kind, pixel_width, pixel_height, creation_ts, duration, is_favorite, burst_id, is_edited, is_hdr, byte_size"


def _scanned(spark: SparkSession, d: str, kinds=None) -> DataFrame:
    """The derived catalogue as a library keeps it, written and scanned."""
    c = fixture.catalogue(spark, d)
    media = F.when(F.col("kind") == C.VIDEO, "video").otherwise("image")
    raw = c.withColumns({"media": media, "is_screenshot": F.col("kind") == C.SCREENSHOT, "is_live": F.col("kind") == C.LIVE})
    hidden = raw.limit(1).withColumns({"asset_id": F.lit(-1).cast("long"), "is_hidden": F.lit(True)})
    path = new_path(spark, "catalogue")
    raw.withColumn("is_hidden", F.lit(False)).unionByName(hidden).drop("kind", "byte_size").write.parquet(path)
    return catalog.scan(spark, "library", path, kinds)


@_register("scan_records", query(f"SELECT {_RECORD} FROM assets", "assets"))
def scan_records(spark, d):
    return _scanned(spark, d).select(*_RECORD.split(", "))


@_register("kind_filter", query("SELECT asset_id, kind FROM assets WHERE kind IN (1, 3)", "assets"))
def kind_filter(spark, d):
    return _scanned(spark, d, [C.SCREENSHOT, C.VIDEO]).select("asset_id", "kind")


_UNIT = " ".join(
    f"WHEN byte_size >= 1e{e} THEN CASE WHEN byte_size / 1e{e} < 9.995 THEN printf('%.2f', round(byte_size / 1e{e}, 2))"
    f" WHEN byte_size / 1e{e} < 99.95 THEN printf('%.1f', round(byte_size / 1e{e}, 1)) ELSE printf('%.0f', round(byte_size / 1e{e})) END || ' {u}'"
    for e, u in ((12, "TB"), (9, "GB"), (6, "MB"), (3, "kB"))
)


@_register("size_labels", query(f"SELECT asset_id, CASE {_UNIT} ELSE byte_size || ' bytes' END AS label FROM assets", "assets"))
def size_labels(spark, d):
    return fixture.catalogue(spark, d).select("asset_id", A.byte_label(F.col("byte_size")).alias("label"))


@_register(
    "kind_classifier",
    "SELECT event_id, CASE WHEN event_type IN ('click', 'view') AND user_id % 5 = 0 THEN 1 WHEN event_type IN ('click', 'view') AND user_id % 7 = 0 THEN 2"
    " WHEN event_type IN ('click', 'view') THEN 0 ELSE 3 END AS kind FROM events WHERE event_type <> 'error'",
)
def kind_classifier(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.col("event_type")
    media = F.when(t.isin("click", "view"), "image").when(t != "error", "video")
    kind = A.classify(media, F.col("user_id") % 5 == 0, F.col("user_id") % 7 == 0)
    return e.select("event_id", kind.alias("kind")).where("kind is not null")


@_register("size_estimate", query("SELECT asset_id, byte_size FROM assets", "assets"))
def size_estimate(spark, d):
    return fixture.catalogue(spark, d).select("asset_id", A.estimated_bytes().alias("byte_size"))


@_register("aspect_ratio", query("SELECT asset_id, px AS pixel_count, round(aspect, 6) AS aspect FROM assets", "assets"))
def aspect_ratio(spark, d):
    return fixture.catalogue(spark, d).select("asset_id", A.pixel_count().alias("pixel_count"), F.round(A.aspect_ratio(), 6).alias("aspect"))


@_register(
    "enrich_sizes",
    query(
        "SELECT a.asset_id, coalesce(CASE WHEN b > 0 THEN b END, a.byte_size) AS byte_size, coalesce(x, is_edited) AS is_edited FROM assets a LEFT JOIN ("
        "SELECT asset_id, CAST(sum(file_size) FILTER (type <> 'adjustment') AS BIGINT) AS b, bool_or(type = 'adjustment') AS x FROM resources GROUP BY ALL) USING (asset_id)",
        "assets", "resources",
    ),
)
def enrich_sizes(spark, d):
    return scoring.enrich(fixture.catalogue(spark, d), fixture.resources(spark, d)).select("asset_id", "byte_size", "is_edited")


@_register(
    "labels_text",
    query(
        "SELECT asset_id, pixel_width || 'x' || pixel_height AS resolution, CAST(floor(duration) AS BIGINT) // 60 || ':' ||"
        " lpad(CAST(CAST(floor(duration) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS clock, round(log2(greatest(1, px)), 6) AS log_pixels,"
        " ['photo', 'screenshot', 'livePhoto', 'video'][kind + 1] AS kind_name FROM assets",
        "assets",
    ),
)
def labels_text(spark, d):
    return fixture.catalogue(spark, d).select(
        "asset_id",
        A.resolution_label().alias("resolution"),
        A.clock_label(F.col("duration")).alias("clock"),
        F.round(F.log2(F.greatest(F.lit(1), A.pixel_count())), 6).alias("log_pixels"),
        review.kind_label(F.col("kind")).alias("kind_name"),
    )


# signatures


@_register("dhash", query("SELECT asset_id, dhash FROM sig", "sig"))
def dhash(spark, d):
    return _library(spark, d).select("asset_id", "dhash")


@_register("colour_histogram", query("SELECT asset_id, histogram FROM sig", "sig"))
def colour_histogram(spark, d):
    return _library(spark, d).select("asset_id", "histogram")


@_register("shape_signature", query("SELECT asset_id, shape, shape_norm FROM sig", "sig"))
def shape_signature(spark, d):
    return _library(spark, d).select("asset_id", F.col("shape").cast("array<long>").alias("shape"), "shape_norm")


@_register(
    "shape_rotation",
    query("SELECT asset_id, turn, [CAST(x AS BIGINT) FOR x IN s] AS shape FROM turned WHERE turn > 0", "turned"),
)
def shape_rotation(spark, d):
    points = vectors.indexable(_library(spark, d)).select("asset_id", "shape")
    out = None
    for turn in (1, 2, 3):
        one = points.select("asset_id", F.lit(turn).alias("turn"), S.rotated("shape", turn).cast("array<long>").alias("shape"))
        out = one if out is None else out.unionByName(one)
    return out


@_register("luma_stats", query("SELECT asset_id, round(mean_luma, 6) AS mean_luma, mean_luma < 0.03 OR mean_luma > 0.97 AS degenerate FROM sig", "sig"))
def luma_stats(spark, d):
    return _library(spark, d).select("asset_id", _r("mean_luma"), A.degenerate(F.col("mean_luma")).alias("degenerate"))


@_register("sharpness", query("SELECT asset_id, round(sharpness, 6) AS sharpness FROM sig", "sig"))
def sharpness(spark, d):
    return _library(spark, d).select("asset_id", _r("sharpness"))


@_register("exposure", query("SELECT asset_id, round(exposure, 6) AS exposure FROM sig", "sig"))
def exposure(spark, d):
    return _library(spark, d).select("asset_id", _r("exposure"))


@_register("keyframe_hashes", query("SELECT asset_id, keyframes FROM sig WHERE len(keyframes) > 0", "sig"))
def keyframe_hashes(spark, d):
    return _library(spark, d).where(F.size("keyframes") > 0).select("asset_id", "keyframes")


# pairs

for _level in C.LEVELS:

    def _still(spark, d, level=_level):
        return cand.still_candidates(_library(spark, d), level).select("id_lo", "id_hi", "hash_distance", _sixths("histogram_similarity"))

    def _video(spark, d, level=_level):
        return cand.video_candidates(_library(spark, d), level).select("id_lo", "id_hi", "hash_distance", _r("histogram_similarity"))

    def _routed(spark, d, level=_level):
        return _routes(spark, d, level).select("id_lo", "id_hi", "route", _r("confidence"), _r("accept"))

    def _grey(spark, d, level=_level):
        out = cand.grey_zone(_library(spark, d), level)
        return out.select("id_lo", "id_hi", _sixths("score"), _sixths("accept"), (F.col("score") >= F.col("accept")).alias("confirmed"))

    def _neighbours(spark, d, level=_level):
        return _edges(spark, d, level).where("via = 'neighbour'").select("id_lo", "id_hi", _r("confidence"))

    def _confirmed(spark, d, level=_level):
        return _edges(spark, d, level).select("id_lo", "id_hi", _r("confidence"), "via")

    _shown = "SELECT id_lo, id_hi, d AS hash_distance, round(s, 6) AS histogram_similarity FROM"
    _register(f"still_candidates_{_level}", query(f"{_shown} stills_{_level}", f"stills_{_level}", level=_level))(_still)
    _register(f"video_candidates_{_level}", query(f"{_shown} videos_{_level}", f"videos_{_level}", level=_level))(_video)
    _register(
        f"pair_routes_{_level}",
        query(f"SELECT id_lo, id_hi, route, round(confidence, 6) AS confidence, round(accept, 6) AS accept FROM routes_{_level}", f"routes_{_level}", level=_level),
    )(_routed)
    _register(
        f"grey_zone_{_level}",
        query(f"SELECT id_lo, id_hi, round(score, 6) AS score, round(accept, 6) AS accept, score >= accept AS confirmed FROM grey_{_level}", f"grey_{_level}", level=_level),
    )(_grey)
    _register(
        f"neighbour_pairs_{_level}",
        query(f"SELECT id_lo, id_hi, round(confidence, 6) AS confidence FROM near_{_level}", f"near_{_level}", level=_level),
    )(_neighbours)
    _register(
        f"confirmed_pairs_{_level}",
        query(f"SELECT id_lo, id_hi, round(confidence, 6) AS confidence, via FROM edges_{_level}", f"edges_{_level}", level=_level),
    )(_confirmed)


@_register("neighbour_topk", query("SELECT query, point, round(score, 6) AS score FROM lists", "lists"))
def neighbour_topk(spark, d):
    points = vectors.indexable(_library(spark, d)).select("asset_id", "shape", "shape_norm")
    return vectors.nearest(points, points).select("query", "point", _r("score"))


@_register(
    "hamming_pairs",
    query(f"SELECT a.asset_id AS id_lo, c.asset_id AS id_hi, CAST(bit_count(xor(a.dhash, c.dhash)) AS INTEGER) AS distance FROM lib a JOIN lib c ON a.asset_id < c.asset_id"
          f" WHERE abs(a.mean_luma - c.mean_luma) <= {C.LUMA_TOLERANCE}::DOUBLE AND bit_count(xor(a.dhash, c.dhash)) <= {C.LEVELS['strict'].hash_reject}", "lib"),
)
def hamming_pairs(spark, d):
    """All pairs within the luma tolerance whose hashes are near."""
    lib = _library(spark, d).select("asset_id", "dhash", "mean_luma")
    distance = A.hamming(F.col("a.dhash"), F.col("b.dhash"))
    near = (F.col("a.asset_id") < F.col("b.asset_id")) & (distance <= C.LEVELS["strict"].hash_reject)
    p = cand.luma_pairs(lib, lib, near)
    return p.select(F.col("a.asset_id").alias("id_lo"), F.col("b.asset_id").alias("id_hi"), distance.alias("distance"))


@_register(
    "same_moment",
    query(f"SELECT a.asset_id AS id_lo, c.asset_id AS id_hi FROM assets a JOIN assets c ON a.asset_id < c.asset_id"
          f" WHERE abs(epoch(a.creation_ts) - epoch(c.creation_ts)) <= {C.SAME_MOMENT_S}", "assets"),
)
def same_moment(spark, d):
    """All pairs of assets of one moment."""
    return cand.moment_pairs(fixture.catalogue(spark, d))


# groups

for _level in C.LEVELS:

    def _components(spark, d, level=_level):
        return connected_components(_star_edges(spark, d, level)).select("node", "component")

    def _stars(spark, d, level=_level):
        return star_clusters(_star_edges(spark, d, level), C.MAX_GROUP)

    _register(f"connected_components_{_level}", query(f"SELECT node, root AS component FROM comp_{_level}", f"comp_{_level}", level=_level))(_components)
    _register(
        f"star_clusters_{_level}",
        query(f"SELECT cluster, node, position FROM stars_{_level}", f"stars_{_level}", level=_level),
    )(_stars)


@_register(
    "group_confidence",
    query(f"SELECT g.group_id, floor(coalesce(c, 0.8::DOUBLE) * 1e6 + 0.5) / 1e6 AS confidence FROM (SELECT DISTINCT group_id FROM members_strict) g LEFT JOIN ("
          f"SELECT group_id, {_MEAN} AS c FROM edges_strict JOIN members_strict ON asset_id = id_lo GROUP BY ALL) USING (group_id)",
          "members_strict", "edges_strict", level="strict"),
)
def group_confidence(spark, d):
    return scoring.group_confidence(_members(spark, d), _edges(spark, d, "strict")).select("group_id", _sixth("confidence"))


@_register(
    "dominant_kind",
    query("SELECT group_id, arg_max(kind, n * 10 - kind) AS kind FROM (SELECT group_id, kind, count(*) AS n FROM members_strict GROUP BY ALL) GROUP BY ALL",
          "members_strict", level="strict"),
)
def dominant_kind(spark, d):
    return scoring.dominant_kind(_members(spark, d))


_BURST = (
    "SELECT group_id, count(DISTINCT burst_id) = 1 OR coalesce(count(*) >= 3 AND count(DISTINCT (pixel_width, pixel_height)) = 1"
    " AND count(creation_ts) = count(*) AND max(gap) <= 10, FALSE) AS is_burst FROM (SELECT *, epoch(creation_ts)"
    " - epoch(lag(creation_ts) OVER (PARTITION BY group_id ORDER BY creation_ts, asset_id)) AS gap FROM members_strict) GROUP BY group_id"
)


@_register("burst_flag", query(_BURST, "members_strict", level="strict"))
def burst_flag(spark, d):
    return scoring.burst_flag(_members(spark, d))


def _norm(x: str) -> str:
    return (
        f"CASE WHEN max({x}) OVER g - min({x}) OVER g > 1e-9 THEN ({x} - min({x}) OVER g) / (max({x}) OVER g - min({x}) OVER g) ELSE 0.5::DOUBLE END"
    )


_first = "row_number() OVER (PARTITION BY group_id ORDER BY {} DESC, position) = 1"
_FACED = {
    "faced": (
        "members_strict faces",
        "SELECT m.*, face_count, open_eye, log2(CAST(greatest(1, px) AS DOUBLE)) AS res, coalesce(max(face_count) OVER (PARTITION BY group_id) > 0, FALSE) AS wf"
        " FROM members_strict m LEFT JOIN faces USING (asset_id)",
    ),
    "scored": (
        "faced",
        f"SELECT *, round(3.0::DOUBLE * ({_norm('sharpness')}) + 2.5::DOUBLE * ({_norm('res')}) + 1.2::DOUBLE * ({_norm('exposure')})"
        f" + 0.8::DOUBLE * ({_norm('CAST(byte_size AS DOUBLE)')}) + CASE WHEN wf THEN 2.0::DOUBLE * (CASE WHEN face_count IS NULL THEN 0.5::DOUBLE ELSE"
        f" 0.7::DOUBLE * ({_norm('open_eye')}) + 0.3::DOUBLE * ({_norm('CAST(face_count AS DOUBLE)')}) END) ELSE 0.0::DOUBLE END"
        " + CASE WHEN is_favorite THEN 5.0::DOUBLE ELSE 0 END + CASE WHEN is_edited THEN 1.2::DOUBLE ELSE 0 END + CASE WHEN kind = 2 THEN 0.8::DOUBLE ELSE 0 END"
        " + CASE WHEN is_hdr THEN 0.8::DOUBLE ELSE 0 END - CASE WHEN kind = 1 AND bool_or(kind <> 1) OVER g THEN 1.5::DOUBLE ELSE 0 END, 9) AS score"
        " FROM faced WINDOW g AS (PARTITION BY group_id)",
    ),
    "ranked": ("scored", "SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, position) AS rank FROM scored"),
    "wins": (
        "ranked",
        "SELECT asset_id, list_filter(["
        + ", ".join(
            f"CASE WHEN {cond} THEN '{name}' END"
            for name, cond in (
                ("favourite", "is_favorite"), ("edited", "is_edited"), ("sharpest", _first.format("sharpness")),
                ("highestResolution", _first.format("res")), ("eyesOpen", "wf AND " + _first.format("coalesce(open_eye, 0)")),
                ("mostFaces", "wf AND " + _first.format("coalesce(face_count, 0)")), ("bestExposure", _first.format("exposure")),
                ("original", "row_number() OVER (PARTITION BY group_id ORDER BY creation_ts ASC NULLS LAST, position) = 1"),
                ("largestFile", _first.format("byte_size")), ("livePhoto", "kind = 2"), ("highDynamicRange", "is_hdr"),
            )
        )
        + "], lambda x: x IS NOT NULL)[1:3] AS highlights FROM ranked",
    ),
    "kinds": ("members_strict", "SELECT group_id, arg_max(kind, n * 10 - kind) AS kind FROM (SELECT group_id, kind, count(*) AS n FROM members_strict GROUP BY ALL) GROUP BY ALL"),
    "grp": (
        "ranked kinds",
        "SELECT group_id, count(*) AS members, min(asset_id) FILTER (rank = 1) AS keeper_id, CAST(coalesce(sum(byte_size) FILTER (rank > 1), 0) AS BIGINT)"
        " AS reclaimable_bytes, any_value(kinds.kind) AS kind FROM ranked JOIN kinds USING (group_id) GROUP BY group_id",
    ),
    "marks": (
        "ranked",
        "SELECT asset_id, group_id, byte_size, (CASE WHEN max(burst_id) OVER g IS NOT NULL THEN FALSE WHEN bool_or(is_favorite) OVER g"
        " THEN asset_id <> min(asset_id) FILTER (is_favorite) OVER g ELSE rank > 1 END) <> is_edited AS marked FROM ranked WINDOW g AS (PARTITION BY group_id)",
    ),
    "gone": ("marks grp", "SELECT asset_id, byte_size FROM marks JOIN grp USING (group_id) WHERE marked AND grp.kind IN (0, 3)"),
}


def _strict(select: str, *names: str) -> str:
    return query(select, *names, level="strict", extra=_FACED)


@_register("quality_scores", _strict("SELECT group_id, asset_id, round(score, 6) AS score, rank FROM ranked", "ranked"))
def quality_scores(spark, d):
    return _ranked(spark, d).select("group_id", "asset_id", _r("score"), "rank")


@_register("highlights", _strict("SELECT asset_id, highlights FROM wins", "wins"))
def highlights(spark, d):
    return _ranked(spark, d).select("asset_id", "highlights")


def _groups(spark, d) -> DataFrame:
    return scoring.groups(_ranked(spark, d), _edges(spark, d, "strict"))


@_register("group_reclaimable", _strict("SELECT group_id, members, keeper_id, reclaimable_bytes, kind FROM grp", "grp"))
def group_reclaimable(spark, d):
    return _groups(spark, d).select("group_id", "members", "keeper_id", "reclaimable_bytes", "kind")


@_register(
    "scan_summary",
    _strict("SELECT count(*) AS groups, CAST(sum(members - 1) AS BIGINT) AS duplicates, CAST(sum(reclaimable_bytes) AS BIGINT) AS reclaimable_bytes,"
            " (SELECT count(*) FROM lib) AS assets_scanned FROM grp", "grp", "lib"),
)
def scan_summary(spark, d):
    return scoring.summary(_groups(spark, d), _library(spark, d).count())


@_register("kind_counts", _strict("SELECT kind, count(*) AS groups FROM grp GROUP BY kind", "grp"))
def kind_counts(spark, d):
    return review.kind_counts(_groups(spark, d))


def _edits(ranked: DataFrame) -> DataFrame:
    """What a user did: bursts are kept whole, in other groups a favourite is kept alone, and an edited asset is saved."""
    one = F.min(F.when(F.col("is_favorite"), F.col("asset_id"))).alias("favourite")
    g = ranked.groupBy("group_id").agg(one, F.max("burst_id").alias("burst"))
    whole = g.select(F.lit(1).alias("seq"), "group_id", F.when(F.col("burst").isNull(), F.col("favourite")).alias("asset_id"), "burst")
    whole = whole.where("burst is not null or asset_id is not null")
    action = F.when(F.col("burst").isNull(), "keep_only").otherwise("keep_all").alias("action")
    toggles = ranked.where("is_edited").select(F.lit(2).alias("seq"), "group_id", "asset_id", F.lit("toggle").alias("action"))
    return whole.select("seq", "group_id", "asset_id", action).union(toggles)


def _plan(spark, d) -> DataFrame:
    ranked = _ranked(spark, d)
    return review.deletion_plan(_marks(spark, d), ranked, review.visible(_groups(spark, d), [C.PHOTO, C.VIDEO]))


def _marks(spark, d) -> DataFrame:
    ranked = _ranked(spark, d)
    return review.apply_edits(review.default_review(ranked), _edits(ranked))


@_register("review_marks", _strict("SELECT group_id, asset_id, marked FROM marks", "marks"))
def review_marks(spark, d):
    return _marks(spark, d)


@_register("keeps_nothing", _strict("SELECT group_id, bool_and(marked) AS keeps_nothing FROM marks GROUP BY group_id", "marks"))
def keeps_nothing(spark, d):
    return review.keeps_nothing(_marks(spark, d))


@_register("deletion_plan", _strict("SELECT asset_id, byte_size, 'library' AS sink FROM gone", "gone"))
def deletion_plan(spark, d):
    return _plan(spark, d)


@_register("selection", _strict("SELECT count(*) AS selected, CAST(coalesce(sum(byte_size), 0) AS BIGINT) AS selected_bytes FROM gone", "gone"))
def selection(spark, d):
    return review.selection(_plan(spark, d))


@_register(
    "survivors_after_delete",
    _strict("SELECT group_id, asset_id, row_number() OVER (PARTITION BY group_id ORDER BY score DESC, position) AS rank FROM ("
            "SELECT *, count(*) OVER (PARTITION BY group_id) AS c FROM ranked WHERE asset_id NOT IN (SELECT asset_id FROM gone)) WHERE c >= 2", "ranked", "gone"),
)
def survivors_after_delete(spark, d):
    return review.survivors(_ranked(spark, d), _plan(spark, d)).select("group_id", "asset_id", "rank")


#: As _strict, over star clusters with true sizes, faces being looked for in the contenders only.
_STARRED = _FACED | {
    "true_sizes": (
        "resources",
        "SELECT asset_id, CAST(sum(file_size) FILTER (type <> 'adjustment') AS BIGINT) AS b, bool_or(type = 'adjustment') AS x FROM resources GROUP BY ALL",
    ),
    "members_strict": (
        "stars_strict lib true_sizes",
        "SELECT cluster AS group_id, position, lib.* REPLACE (coalesce(CASE WHEN b > 0 THEN b END, byte_size) AS byte_size, coalesce(x, is_edited) AS is_edited)"
        " FROM stars_strict JOIN lib ON lib.asset_id = node LEFT JOIN true_sizes USING (asset_id)",
    ),
    "wide": (
        "members_strict",
        f"SELECT group_id, least(count(*), {C.FACE_CONTENDERS}) AS cost FROM members_strict GROUP BY group_id HAVING max(sharpness) > 0"
        f" AND (max(sharpness) - min(sharpness)) / max(sharpness) > {C.SHARPNESS_SPREAD}::DOUBLE",
    ),
    "within": (
        "wide",
        f"SELECT group_id FROM (SELECT group_id, coalesce(sum(cost) OVER (ORDER BY group_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent"
        f" FROM wide) WHERE {C.FACE_BUDGET} - spent >= {C.FACE_CONTENDERS}",
    ),
    "looked_at": (
        "faces members_strict within",
        f"SELECT * FROM faces WHERE asset_id IN (SELECT asset_id FROM members_strict JOIN within USING (group_id) WHERE position < {C.FACE_CONTENDERS})",
    ),
    "faced": (_FACED["faced"][0].replace("faces", "looked_at"), _FACED["faced"][1].replace("JOIN faces", "JOIN looked_at")),
    "bursts": ("members_strict", _BURST),
    "sure": (
        "members_strict edges_strict",
        f"SELECT g.group_id, {_MEAN} AS c FROM edges_strict JOIN members_strict g ON g.asset_id = id_lo JOIN members_strict h ON h.asset_id = id_hi"
        " WHERE g.group_id = h.group_id GROUP BY ALL",
    ),
}


@_register(
    "keepers",
    query(
        "SELECT group_id, members, keeper_id, kind, is_burst, floor(coalesce(c, 0.8::DOUBLE) * 1e6 + 0.5) / 1e6 AS confidence, reclaimable_bytes,"
        " CASE WHEN coalesce(c, 0.8::DOUBLE) >= 0.92 THEN 'Certain' WHEN coalesce(c, 0.8::DOUBLE) >= 0.75 THEN 'Very likely' ELSE 'Possible' END AS confidence_label,"
        " row_number() OVER (ORDER BY reclaimable_bytes DESC, group_id) AS place"
        " FROM grp JOIN bursts USING (group_id) LEFT JOIN sure USING (group_id)",
        "grp", "bursts", "sure", level="strict", extra=_STARRED,
    ),
)
def keepers(spark, d):
    scan = pipeline.run_pipeline(_library(spark, d), "strict", fixture.faces(spark, d), fixture.resources(spark, d))
    return scoring.numbered(scan.groups, F.desc("reclaimable_bytes"), F.asc("group_id")).select(
        "group_id", "members", "keeper_id", "kind", "is_burst", _sixth("confidence"), "reclaimable_bytes",
        A.confidence_label(F.col("confidence")).alias("confidence_label"), "place",
    )


# rescans: cached rows are those of assets whose vector is no multiple of three, some with another stamp

_STAMP = "epoch(creation_ts)"
_CACHE = {
    "stamped": ("assets", "SELECT asset_id, coalesce(epoch(creation_ts), -62135769600.0::DOUBLE) AS stamp FROM assets"),
    "cached": (
        "stamped",
        "SELECT asset_id, stamp + CASE asset_id // 8 % 4 WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END AS stamp FROM stamped WHERE asset_id // 8 % 3 <> 0",
    ),
    "noted": (
        "lists stamped",
        "SELECT query, point, score, s.stamp + CASE WHEN point % 3 = 0 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM lists JOIN stamped s ON s.asset_id = point",
    ),
}


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    return fixture.catalogue(spark, d).select("asset_id", A.stamp().alias("stamp"))


def _cached(spark: SparkSession, d: str) -> DataFrame:
    v = F.expr("asset_id div 8")
    off = F.when(v % 4 == 1, 10.0).when(v % 4 == 2, 0.25).otherwise(0.0)
    return _stamped(spark, d).where(v % 3 != 0).withColumn("stamp", F.col("stamp") + off)


@_register(
    "cache_split",
    query("SELECT s.asset_id, round(s.stamp, 3) AS stamp, coalesce(abs(s.stamp - c.stamp) < 0.5, FALSE) AS reuse FROM stamped s LEFT JOIN cached c USING (asset_id)",
          "stamped", "cached", extra=_CACHE),
)
def cache_split(spark, d):
    return incremental.split_cached(_stamped(spark, d), _cached(spark, d)).withColumn("stamp", F.round("stamp", 3))


@_register(
    "upsert",
    query("SELECT asset_id, round(stamp, 3) AS stamp FROM cached WHERE asset_id % 5 <> 0 UNION ALL SELECT asset_id, round(stamp, 3) FROM stamped WHERE asset_id % 5 = 0",
          "stamped", "cached", extra=_CACHE),
)
def upsert(spark, d):
    new = _stamped(spark, d).where("asset_id % 5 = 0")
    return incremental.upsert(_cached(spark, d), new).select("asset_id", F.round("stamp", 3).alias("stamp"))


@_register(
    "vector_sync",
    query("SELECT s.asset_id FROM stamped s LEFT JOIN cached c USING (asset_id) WHERE c.stamp IS NULL OR abs(s.stamp - c.stamp) >= 0.5", "stamped", "cached", extra=_CACHE),
)
def vector_sync(spark, d):
    """Points that have to be written again."""
    return incremental.to_write(_cached(spark, d), _stamped(spark, d)).select("asset_id")


@_register("store_scan", query("SELECT asset_id, dhash, histogram FROM lib WHERE asset_id % 3 <> 0 UNION ALL SELECT asset_id, 0, histogram FROM lib WHERE asset_id % 3 = 0", "lib"))
def store_scan(spark, d):
    """A store of fingerprints written, brought up to date and read back; every third asset was signed again since."""
    lib = _library(spark, d).select(*FINGERPRINTS.names)
    store = Store(spark, new_path(spark, "store"), FINGERPRINTS, sizes=PRINT_SIZES)
    store.replace(lib)
    store.save(lib.where("asset_id % 3 = 0").withColumn("dhash", F.lit(0).cast("long")))
    return store.load().select("asset_id", "dhash", "histogram")


@_register("bucket_upsert", query("SELECT asset_id, dhash, mean_luma FROM lib WHERE asset_id % 50 <> 0 AND asset_id % 7 <> 3 UNION ALL SELECT asset_id, 1, mean_luma FROM lib WHERE asset_id % 50 = 0 AND asset_id % 7 <> 3", "lib"))
def bucket_upsert(spark, d):
    """A table in buckets after an upsert of every fiftieth asset and a deletion of every seventh."""
    lib = _library(spark, d).select("asset_id", "dhash", "mean_luma")
    store = Buckets(spark, new_path(spark, "buckets"), lib.schema)
    store.save(lib)
    store.save(lib.where("asset_id % 50 = 0").withColumn("dhash", F.lit(1).cast("long")))
    store.drop(lib.where("asset_id % 7 = 3"))
    return store.load()


@_register("index_search", query("SELECT query, point, round(score, 6) AS score FROM lists WHERE query % 40 = 0", "lists"))
def index_search(spark, d):
    """Neighbours of a fortieth of the points in a stored index, which was built of others and brought up to date."""
    points = vectors.indexable(_library(spark, d)).select("asset_id", "shape", "shape_norm")
    index = NeighbourIndex(spark, new_path(spark, "index"))
    turned = points.withColumn("shape", F.reverse("shape"))
    index.build(points.where("asset_id % 3 <> 0").unionByName(turned.where("asset_id % 3 = 0")))
    index.update(points.where("asset_id % 3 = 0"))
    return index.nearest(points.where("asset_id % 40 = 0")).select("query", "point", _r("score"))


@_register("prune_stale", query("SELECT asset_id FROM cached WHERE asset_id % 7 <> 0", "cached", extra=_CACHE))
def prune_stale(spark, d):
    live = _stamped(spark, d).where("asset_id % 7 <> 0")
    return incremental.prune(_cached(spark, d), live, C.ScanSettings().kinds).select("asset_id")


@_register(
    "neighbour_cache_valid",
    query("SELECT query, point, round(score, 6) AS score FROM noted n JOIN stamped s ON s.asset_id = point WHERE abs(n.t - s.stamp) < 0.5", "noted", "stamped", extra=_CACHE),
)
def neighbour_cache_valid(spark, d):
    lib = vectors.indexable(_library(spark, d))
    points = lib.select("asset_id", "shape", "shape_norm")
    lists = vectors.nearest(points, points)
    none = {"near": "array<struct<a: bigint, s: double, t: double>>", "near_stamp": "double", "near_version": "int"}
    table = lib.select("asset_id", "shape", "shape_norm", "stamp", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    table = incremental.store_lists(table, lists)
    # points of every third id were changed after their neighbours had been noted
    changed = F.transform("near", lambda n: F.struct(n["a"].alias("a"), n["s"].alias("s"), (n["t"] + F.when(n["a"] % 3 == 0, 10.0).otherwise(0.0)).alias("t")))
    return incremental.valid_lists(table.withColumn("near", changed)).select("query", "point", _r("score"))


@_register(
    "keyframe_times",
    query("SELECT asset_id, [round(duration * k / 6, 6) FOR k IN range(1, 6)] AS times FROM assets WHERE kind = 3", "assets"),
)
def keyframe_times(spark, d):
    clips = fixture.catalogue(spark, d).where(F.col("kind") == C.VIDEO)
    times = export.keyframe_times(F.col("duration"), C.KEYFRAMES)
    return clips.select("asset_id", F.transform(times, lambda t: F.round(t, 6)).alias("times"))


@_register(
    "eye_openness",
    "SELECT asset_id, CAST(count(*) AS INTEGER) AS face_count, round(avg(o), 6) AS open_eye FROM (SELECT l_orderkey AS asset_id, l_linenumber AS face,"
    " least(1.0::DOUBLE, greatest(0.0::DOUBLE, (avg(l_quantity / 100.0::DOUBLE) - 0.10::DOUBLE) / 0.20::DOUBLE)) AS o FROM lineitem GROUP BY ALL) GROUP BY asset_id",
)
def eye_openness(spark, d):
    eyes = spark.read.parquet(f"{d}/lineitem.parquet").select(
        F.col("l_orderkey").alias("asset_id"), F.col("l_linenumber").alias("face"), F.lit(100.0).alias("eye_width"), F.col("l_quantity").alias("eye_height")
    )
    return scoring.face_info(eyes).select("asset_id", "face_count", _r("open_eye"))


@_register(
    "histogram_intersection",
    query(f"SELECT id_lo, id_hi, round(s, 6) AS similarity FROM (SELECT a.asset_id AS id_lo, c.asset_id AS id_hi,"
          " list_sum(list_transform(list_zip(a.histogram, c.histogram), lambda z: least(z[1], z[2]))) / 256.0::DOUBLE AS s"
          f" FROM lib a JOIN lib c ON a.asset_id < c.asset_id AND abs(a.mean_luma - c.mean_luma) <= {C.LUMA_TOLERANCE}::DOUBLE)"
          f" WHERE s >= {C.LEVELS['strict'].strong_histogram}::DOUBLE", "lib"),
)
def histogram_intersection(spark, d):
    """All pairs within the luma tolerance whose colours nearly agree."""
    pixels = fixture.EDGE**2
    p = cand.colour_pairs(_library(spark, d), pixels, C.LEVELS["strict"].strong_histogram)
    return p.select("id_lo", "id_hi", F.round(F.col("common") / pixels, 6).alias("similarity"))


@_register(
    "group_preview",
    _strict("SELECT group_id, asset_id, rank, greatest(0, count(*) OVER (PARTITION BY group_id) - 4) AS more FROM ranked QUALIFY rank <= 4", "ranked"),
)
def group_preview(spark, d):
    return review.preview(_ranked(spark, d))
