"""Tables in partitions of which an update rewrites those that it touches, by Spark's dynamic partition overwrite."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import AnalysisException

from twinlake.session import written

#: Rows of a file at most.
ROWS = 1 << 20


def overwrite_parts(df: DataFrame, uri: str, by: str) -> None:
    """Replaces the partitions (by) of the Parquet table uri that df has rows for; others stay as they are."""
    df = df.repartition(F.col(by))  # a task a partition
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").option("maxRecordsPerFile", ROWS).partitionBy(by).parquet(uri)


def read_parts(spark: SparkSession, uri: str, schema: T.StructType) -> DataFrame:
    """The table, or an empty one where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(uri)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Buckets:
    """A keyed table in hash buckets of its key.

    Saving rows of 1 % of the buckets reads and writes these only: the new rows
    replace those of equal key, and Spark swaps the files of the touched buckets
    when the job commits. A bucket is written by one task, so there should be as
    many as give each some hundred thousand rows. A bucket that loses all its
    rows keeps one without a key, which no reader sees.
    """

    def __init__(self, spark: SparkSession, uri: str, schema: T.StructType, key: str = "asset_id", buckets: int = 64) -> None:
        self.spark, self.uri, self.key, self.n, self.names = spark, uri.rstrip("/"), key, buckets, schema.names
        self.schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema.fields), T.StructField("bucket", T.IntegerType())])

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.n)).cast("int"))

    def _stored(self, buckets: Iterable[int] | None = None) -> DataFrame:
        t = read_parts(self.spark, self.uri, self.schema)
        if buckets is not None:
            t = t.where(F.col("bucket").isin(list(buckets)))  # prunes the folders that are read
        return t.where(F.col(self.key).isNotNull())

    def load(self) -> DataFrame:
        return self._stored().select(*self.names)

    def _rewrite(self, change: DataFrame, keep: bool) -> list[int]:
        change = written(change, "buckets-change")
        touched = sorted(r[0] for r in change.select("bucket").distinct().collect())  # at most the number of buckets
        old = self._stored(touched).join(change.select(self.key).distinct(), self.key, "left_anti").select(*self.names, "bucket")
        new = old.unionByName(change.select(*self.names, "bucket")) if keep else old
        new = written(new, "buckets-new")
        if not keep:
            empty = change.select("bucket").distinct().join(new.select("bucket").distinct(), "bucket", "left_anti")
            fields = (f for f in self.schema.fields if f.name != "bucket")
            new = new.unionByName(empty.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields), "bucket"))
        overwrite_parts(new, self.uri, "bucket")
        return touched

    def save(self, rows: DataFrame) -> list[int]:
        """Puts rows in place of those of equal key; returns the buckets rewritten. Rows without a key are left out."""
        return self._rewrite(self._dealt(rows.where(F.col(self.key).isNotNull()).select(*self.names)), True)

    def drop(self, keys: DataFrame) -> list[int]:
        """Drops the rows of some keys; returns the buckets rewritten."""
        return self._rewrite(self._dealt(keys.where(F.col(self.key).isNotNull()).select(self.key).distinct()), False)
