"""What every job needs from its session: the shared folder, written tables, shipped code."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Rows of a file of a small table.
FILE_ROWS = 1 << 15
#: The limit of an Arrow batch in bytes: its name, Spark's default and ours.
BATCH, UNBOUNDED, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir.

    Only where the session names none and all of it runs in one process (a
    test, a notebook) is a local one made and set; other masters get an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.mkdtemp(prefix="twinlake-")).as_uri()
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def free_names(columns: Iterable[str], *names: str) -> list[str]:
    """names, each lengthened until it is no column; columns differ in more than case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def new_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, codec: str = "zstd", rows: int | None = None, per: int = FILE_ROWS) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks after this point only.
    rows: how many there are at most, where the caller knows; a small table then
    gets no more files than it fills, per rows each, and not one for each
    partition that the job has.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(1 + rows // per)
    path = new_path(spark, tag)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once an application.

    Also sets smaller Arrow batches for them, where the session leaves the limit
    at its default: what a worker holds is a multiple of a batch.
    """
    if spark.conf.get(BATCH, UNBOUNDED) == UNBOUNDED:
        spark.conf.set(BATCH, BATCH_BYTES)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="twinlake-code-")) / "twinlake.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(Path("twinlake") / p.relative_to(top)))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def partitions(spark: SparkSession) -> int:
    """The shuffle width the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
