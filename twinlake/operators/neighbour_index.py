"""Stored vectors by cell, so that a search for few of them reads what they can reach only."""

from __future__ import annotations

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from twinlake import config as C
from twinlake.operators import incremental, reach
from twinlake.operators.vectors import best_turns
from twinlake.session import written
from twinlake.sources.parts import overwrite_parts, read_parts
from twinlake.sources.shared_files import open_folder

_L, _I, _D = T.LongType(), T.IntegerType(), T.DoubleType()
STORED = T.StructType([
    T.StructField("asset_id", _L), T.StructField("shape", T.ArrayType(_I)), T.StructField("shape_norm", _L),
    T.StructField("angle", _D), T.StructField("spread", _L), T.StructField("cell", _I),
])
PIVOT = T.StructType([T.StructField("k", _I), T.StructField("unit", T.ArrayType(_D))])
SHELLS = T.StructType([T.StructField("shell", _I), T.StructField("n", _L), T.StructField("low", _D), T.StructField("high", _D), T.StructField("cell", _I)])


class NeighbourIndex:
    """Points (asset_id, shape, shape_norm) in folders by their nearest pivot, with the shells of each cell.

    A search reads the pivots and shells, which are few, and then the cells that
    one of its queries can reach: the result is that of a search of all points.
    An update rewrites the cells that lose or get points; pivots stay as they
    were built, so after much change it pays to build anew.
    """

    def __init__(self, spark: SparkSession, uri: str) -> None:
        self.spark, self.uri = spark, uri.rstrip("/")

    def build(self, points: DataFrame) -> None:
        """Chooses pivots and stores points; what was stored before is replaced."""
        pivots = reach.choose_pivots(points, points.count())
        rows = self.spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(pivots)], PIVOT)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.uri}/pivots")
        # cells of an earlier build that have no points now are emptied too
        old = read_parts(self.spark, f"{self.uri}/shells", SHELLS).select("cell").distinct()
        self._put(self._placed(points), written(old, "index-old"))

    def pivots(self) -> np.ndarray:
        rows = read_parts(self.spark, f"{self.uri}/pivots", PIVOT).orderBy("k").collect()  # PIVOTS at most
        return np.array([r["unit"] for r in rows]) if rows else np.zeros((0, 0))

    def _placed(self, points: DataFrame) -> DataFrame:
        pivots = self.pivots()
        if not len(pivots):
            return self.spark.createDataFrame([], STORED)
        return written(reach.placed(points, pivots).select(*STORED.names), "index-placed")

    def _put(self, rows: DataFrame, touched: DataFrame) -> None:
        """Rewrites the cells of rows, and those of touched (cell) that have no rows left."""
        empty = touched.join(rows.select("cell").distinct(), "cell", "left_anti")
        fill = lambda s: empty.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in s.fields if f.name != "cell"), "cell")
        overwrite_parts(rows.select(*STORED.names).unionByName(fill(STORED)), f"{self.uri}/points", "cell")
        overwrite_parts(reach.shells(rows).select(*SHELLS.names).unionByName(fill(SHELLS)), f"{self.uri}/shells", "cell")

    def points(self, cells: list[int] | None = None) -> DataFrame:
        t = read_parts(self.spark, f"{self.uri}/points", STORED)
        if cells is not None:
            t = t.where(F.col("cell").isin(cells))
        return t.where("asset_id is not null")

    def blocks(self) -> reach.Blocks:
        rows = read_parts(self.spark, f"{self.uri}/shells", SHELLS).where("shell is not null")
        return reach.Blocks.of(self.pivots(), [tuple(r) for r in rows.select("cell", "shell", "n", "low", "high").collect()])

    def update(self, points: DataFrame, gone: DataFrame | None = None) -> None:
        """Puts points in place of those of equal id, and drops those of gone (asset_id)."""
        new = self._placed(points)
        ids = new.select("asset_id") if gone is None else new.select("asset_id").union(gone.select("asset_id"))
        ids = written(ids.distinct(), "index-ids")
        # ids and cells only: no vector of an untouched cell is read
        before = self.points().select("asset_id", "cell").join(ids, "asset_id", "left_semi").select("cell")
        touched = written(before.union(new.select("cell")).distinct(), "index-touched")
        cells = [r[0] for r in touched.collect()]  # PIVOTS at most
        kept = self.points(cells).join(ids, "asset_id", "left_anti").select(*STORED.names)
        self._put(written(kept.unionByName(new), "index-kept"), touched)

    def count(self) -> int:
        """How many points are stored, by their shells."""
        return read_parts(self.spark, f"{self.uri}/shells", SHELLS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def clear(self) -> None:
        system, top = open_folder(self.uri)
        if system.get_file_info(top).type == fs.FileType.Directory:
            system.delete_dir_contents(top)

    def plan(self, queries: DataFrame, floor: float = C.NEIGHBOUR_FLOOR) -> tuple[DataFrame, reach.Search]:
        """The placed queries, and what of the index they reach."""
        asked = self._placed(queries)
        return asked, reach.plan_search(asked, self.blocks(), floor, 4, False)

    def nearest(self, queries: DataFrame, limit: int = C.NEIGHBOUR_LIMIT, floor: float = C.NEIGHBOUR_FLOOR) -> DataFrame:
        """(query, point, score) as vectors.nearest(queries, all stored points)."""
        asked, search = self.plan(queries, floor)
        scores = reach.scored(asked, self.points(search.cells), search, floor, 4, limit + 1)
        return best_turns(scores, limit)


def refreshed(points: DataFrame, index: NeighbourIndex) -> DataFrame:
    """points (the stored table) with lists for those that have none that is fresh; the index has all points as they are now."""
    todo = incremental.pending(points).select("asset_id", "shape", "shape_norm")
    return incremental.store_lists(points, index.nearest(todo))
