"""Column expressions on asset records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from twinlake import config as C


def pixel_count(p: str = "") -> Column:
    return F.col(f"{p}pixel_width").cast("long") * F.col(f"{p}pixel_height")


def aspect_ratio(p: str = "") -> Column:
    """Longer side by shorter; 1 where a side is not positive."""
    w, h = F.col(f"{p}pixel_width").cast("double"), F.col(f"{p}pixel_height").cast("double")
    return F.when((w <= 0) | (h <= 0), F.lit(1.0)).otherwise(F.greatest(w, h) / F.least(w, h))


def classify(media: Column, is_screenshot: Column, is_live: Column) -> Column:
    """Kind code of a library entry; null where it is neither image nor video."""
    return (
        F.when((media == "image") & is_screenshot, C.SCREENSHOT)
        .when((media == "image") & is_live, C.LIVE)
        .when(media == "image", C.PHOTO)
        .when(media == "video", C.VIDEO)
    )


def estimated_bytes() -> Column:
    """Size guess from kind, pixels and duration, until the true one is looked up."""
    px = pixel_count().cast("double")
    video = F.col("duration") * 1.2e6 * F.greatest(F.lit(0.25), px / (1920 * 1080))
    return (
        F.when(F.col("kind") == C.VIDEO, F.floor(video))
        .when(F.col("kind") == C.SCREENSHOT, F.floor(px * 0.15))
        .when(F.col("kind") == C.LIVE, F.floor(px * 0.30) + 1_800_000)
        .otherwise(F.floor(px * 0.30))
        .cast("long")
    )


def stamp() -> Column:
    """Epoch seconds of the last change; the distant past where no date is known."""
    at = F.coalesce("modification_ts", "creation_ts").cast("timestamp_ntz")
    seconds = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at) / 1e6
    return F.coalesce(seconds, F.lit(-62135769600.0))


def seconds_between(a: str, b: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / 1e6


def same_moment(a: str, b: str) -> Column:
    """Both dates known and no further apart than the scene window."""
    return F.coalesce(F.abs(seconds_between(a, b)) <= C.SAME_MOMENT_S, F.lit(False))


def degenerate(luma: Column) -> Column:
    return (luma < C.DARK) | (luma > C.BRIGHT)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def overlap(a: Column, b: Column, pixels: Column) -> Column:
    """Histogram intersection of two count arrays of as many pixels."""
    common = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return common / pixels


def dot(a: Column, b: Column) -> Column:
    """Exact inner product of integer arrays."""
    products = F.zip_with(a, b, lambda x, y: x.cast("long") * y)
    return F.aggregate(products, F.lit(0).cast("long"), lambda s, x: s + x)


def cosine(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    return dot(a, b) / F.sqrt(norm_a.cast("double") * norm_b.cast("double"))


def keyframe_distance(a: Column, b: Column) -> Column:
    """Mean Hamming distance of the leading keyframes both have; null where there is none."""
    n = F.least(F.size(a), F.size(b))
    bits = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: hamming(x, y))
    return F.when(n > 0, F.aggregate(bits, F.lit(0), lambda s, x: s + x) / n)


def confidence(distance: Column, similarity: Column) -> Column:
    return F.least(F.lit(1.0), 0.35 * F.greatest(F.lit(0.0), 1 - distance / 32) + 0.65 * similarity)


def shape_required(similarity: Column, t: C.Thresholds) -> Column:
    """Cosine that a pair in the grey zone has to reach: the less its colours agree, the more."""
    lack = (t.histogram_accept - similarity) / (t.histogram_accept - t.histogram_floor)
    short = F.least(F.lit(1.0), F.greatest(F.lit(0.0), lack))
    needed = t.shape_accept + short * (C.SHAPE_COPY - t.shape_accept)
    return F.when(similarity >= t.histogram_accept, F.lit(t.shape_accept)).otherwise(needed)


def confidence_label(c: Column) -> Column:
    return F.when(c >= 0.92, "Certain").when(c >= 0.75, "Very likely").otherwise("Possible")


def resolution_label() -> Column:
    return F.concat_ws("x", F.col("pixel_width").cast("string"), F.col("pixel_height").cast("string"))


def clock_label(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def file_id(origin: Column) -> Column:
    """The id of a file in a folder: a negative number made from its URI; ids of a library are not negative."""
    return -1 - F.shiftrightunsigned(F.xxhash64(origin), 2)


def is_file(asset_id: Column) -> Column:
    return asset_id < 0


def byte_label(n: Column) -> Column:
    """A size for people: bytes as they are, else three digits of kB, MB, GB or TB, in powers of 1,000."""
    out = F.concat(n.cast("string"), F.lit(" bytes"))
    for k, unit in enumerate(("kB", "MB", "GB", "TB"), 1):
        x = n / 1000**k
        digits = F.when(x < 9.995, F.format_string("%.2f", F.round(x, 2))).when(x < 99.95, F.format_string("%.1f", F.round(x, 1)))
        out = F.when(n >= 1000**k, F.concat(F.coalesce(digits, F.format_string("%.0f", F.round(x))), F.lit(f" {unit}"))).otherwise(out)
    return out
