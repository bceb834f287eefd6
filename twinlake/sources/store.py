"""Keyed tables kept between scans: snapshots in a folder, and a pointer to the newest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Collection

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from twinlake import config as C
from twinlake.operators import incremental
from twinlake.schema import POINTS  # noqa: F401  the store that most use
from twinlake.sources.shared_files import open_folder

class Store:
    """A table that is replaced as a whole: readers see the old snapshot until the pointer moves.

    What cannot be read - no folder, a torn pointer or file, another version, files
    that are gone, other rows than were written - is an empty table; a scan then
    starts afresh and never fails. sizes: array columns and the length they have;
    rows where one has another are left out.
    """

    def __init__(
        self, spark: SparkSession, uri: str, schema: T.StructType, version: int = C.STORE_VERSION, sizes: dict[str, int] | None = None
    ) -> None:
        self.spark, self.uri, self.schema, self.version, self.sizes = spark, uri.rstrip("/"), schema, version, sizes or {}

    def _pointer(self) -> dict | None:
        system, top = open_folder(self.uri)
        try:
            with system.open_input_stream(f"{top}/current.json", compression=None) as f:
                said = json.loads(f.read())
            return said if said["version"] == self.version and said["rows"] >= 0 else None
        except (OSError, ValueError, KeyError, TypeError):
            return None

    def load(self) -> DataFrame:
        said = self._pointer()
        if said:
            try:
                df = self.spark.read.schema(self.schema).parquet(f"{self.uri}/{said['snapshot']}")
                if df.count() == said["rows"]:  # reads the end of every file
                    for column, n in self.sizes.items():
                        df = df.where(F.size(column) == n)
                    return df
            except Exception as e:  # noqa: BLE001  Spark reports unreadable files in many ways
                if "FileNotFound" not in str(e) and "PATH_NOT_FOUND" not in str(e) and "not a Parquet" not in str(e) and "CANNOT_READ" not in str(e) and "FAILED_READ_FILE" not in str(e):
                    raise
        return self.spark.createDataFrame([], self.schema)

    def replace(self, df: DataFrame) -> None:
        """Writes a snapshot, moves the pointer, then drops the snapshot before."""
        before, name = self._pointer(), f"snapshot-{uuid.uuid4().hex}"
        df.select(*self.schema.names).write.option("compression", "zstd").parquet(f"{self.uri}/{name}")
        rows = self.spark.read.schema(self.schema).parquet(f"{self.uri}/{name}").count()
        system, top = open_folder(self.uri)
        raw = json.dumps({"version": self.version, "snapshot": name, "rows": rows}).encode()
        with system.open_output_stream(f"{top}/next.json", compression=None) as f:
            f.write(raw)
        system.move(f"{top}/next.json", f"{top}/current.json")
        if before:
            system.delete_dir(f"{top}/{before['snapshot']}")

    def save(self, new: DataFrame) -> None:
        self.replace(incremental.upsert(self.load(), new))

    def prune(self, live: DataFrame, kinds: Collection[int]) -> None:
        if C.all_kinds(kinds):
            self.replace(incremental.prune(self.load(), live, kinds))

    def clear(self) -> None:
        system, top = open_folder(self.uri)
        if system.get_file_info(top).type == fs.FileType.Directory:
            system.delete_dir_contents(top)

    def count(self) -> int:
        return self.load().count()

    def disk_usage(self) -> int:
        system, top = open_folder(self.uri)
        if system.get_file_info(top).type != fs.FileType.Directory:
            return 0
        return sum(i.size or 0 for i in system.get_file_info(fs.FileSelector(top, recursive=True)))
