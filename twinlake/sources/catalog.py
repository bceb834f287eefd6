"""Asset records from catalogues and folders."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from twinlake import config as C
from twinlake.functions.assets import classify, estimated_bytes, file_id, is_file
from twinlake.schema import ASSETS
from twinlake.session import ship_package, written
from twinlake.sources.headers import image_size, movie_size
from twinlake.sources.shared_files import reader

_FILES = T.StructType([*ASSETS.fields, T.StructField("origin", T.StringType())])
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "gif", "bmp")
MOVIE_ENDINGS = ("mp4", "m4v", "mov", "qt", "3gp", "3g2")
#: Files whose headers one task reads.
FILES = 256


def scan_catalogue(spark: SparkSession, path: str, kinds=None, form: str = "parquet") -> DataFrame:
    """Records of a library catalogue by creation date, hidden ones left out.

    The catalogue has the columns of a record without kind and byte_size, and
    media (image or video), is_screenshot, is_live and, where it knows, is_hidden.
    """
    raw = spark.read.format(form).load(path)
    if "is_hidden" in raw.columns:
        raw = raw.where(~F.coalesce("is_hidden", F.lit(False)))
    no = F.lit(False)
    kind = classify(F.col("media"), F.coalesce("is_screenshot", no), F.coalesce("is_live", no))
    out = raw.withColumn("kind", kind).where("kind is not null")
    if kinds is not None:
        out = out.where(F.col("kind").isin(*kinds))
    out = out.withColumn("byte_size", estimated_bytes())
    return out.select(*ASSETS.names).orderBy(F.asc_nulls_last("creation_ts"), "asset_id")


def plain_uri(name: str):
    """Readers write a local path with one slash or three, and its blanks as they are or escaped."""
    one = F.regexp_replace(F.col(name), "^file:/+", "file:/")
    return F.coalesce(F.try_url_decode(F.replace(one, F.lit("+"), F.lit("%2B"))), one)


def _ends(origin, endings: tuple[str, ...]):
    return F.col(origin).rlike("(?i)\\.(" + "|".join(endings) + ")$")


def measured(files: DataFrame) -> DataFrame:
    """files (path, is_movie) with width, height and seconds by their headers; zeros where a file cannot be read.

    Heads of files are read where they lie, by URIs that pyarrow opens (file,
    hdfs, s3, gs); no image is decoded and no movie is read.
    """
    ship_package(files.sparkSession)
    out = T.StructType([*files.schema.fields, *(T.StructField(n, T.IntegerType()) for n in ("width", "height")), T.StructField("seconds", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, movie in zip(b.column("path").to_pylist(), b.column("is_movie").to_pylist(), strict=True):
                try:
                    read, length = reader(quote(path, safe="/:@"))  # listed as it is, without escapes
                    found.append(movie_size(read, length) if movie else (*image_size(read), 0.0))
                except (OSError, ValueError, struct.error):
                    found.append((0, 0, 0.0))
            w, h, t = zip(*found, strict=True) if found else ((), (), ())
            fine = lambda v: pa.array([x if x < 1 << 31 else 0 for x in v], pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, fine(w), fine(h), pa.array(t, pa.float64())], names=out.names)

    return files.mapInArrow(work, out)


def scan_folder(spark: SparkSession, path: str, kinds=None) -> DataFrame:
    """Records of the images and movies below a folder, with their URIs as origin; sizes true, flags false.

    Pixel sizes come from headers (PNG, JPEG, GIF, BMP; as stored), those of
    movies (MP4, M4V, MOV, 3GP; as turned for display) with their length. An
    asset_id is made from the URI (file_id), so that a rescan finds it again; two
    files of one id, which are not to be expected, end the scan. Hidden files and
    what has no size are left out.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(
        "path", plain_uri("path").alias("origin"), "modificationTime", "length"
    )
    movie = _ends("origin", MOVIE_ENDINGS)
    listed = listed.where((_ends("origin", IMAGE_ENDINGS) | movie) & ~F.col("origin").rlike(r"/\.[^/]*$"))
    listed = listed.withColumn("is_movie", movie)
    if kinds is not None:  # before any file is opened
        listed = listed.where(F.when(F.col("is_movie"), C.VIDEO).otherwise(C.PHOTO).isin(*kinds))
    listed = written(listed, "folder-files")
    rows = measured(listed.repartition(max(1, min(10_000, listed.count() // FILES)))).where("width > 0 and height > 0")
    no = F.lit(False)
    rows = rows.select(
        "origin", file_id(F.col("origin")).alias("asset_id"), F.when(F.col("is_movie"), C.VIDEO).otherwise(C.PHOTO).alias("kind"),
        F.col("width").alias("pixel_width"), F.col("height").alias("pixel_height"),
        F.lit(None).cast("timestamp_ntz").alias("creation_ts"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modification_ts"),
        F.col("seconds").alias("duration"), no.alias("is_favorite"), F.lit(None).cast("string").alias("burst_id"),
        no.alias("is_edited"), no.alias("is_hdr"), F.col("length").alias("byte_size"),
    )
    rows = written(rows.select(*_FILES.names), "folder-records")
    if not rows.groupBy("asset_id").count().where("count > 1").isEmpty():
        raise ValueError("two files have one id")
    return rows


def scan(spark: SparkSession, source: str, path: str, kinds=None) -> DataFrame:
    """Records from a library catalogue or a folder."""
    if source == "library":
        return scan_catalogue(spark, path, kinds)
    if source == "folder":
        return scan_folder(spark, path, kinds)
    raise ValueError(f"no such source: {source}")


def split_by_sink(ids: DataFrame) -> DataFrame:
    """(asset_id, sink): ids of files belong to folders, others to the library."""
    return ids.select("asset_id", F.when(is_file(F.col("asset_id")), "file").otherwise("library").alias("sink"))
