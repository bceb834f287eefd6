"""Partitions that an update touches, and those that it leaves."""

import os
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F
from test_reach import frame, shapes

from twinlake.operators import incremental, reach, vectors
from twinlake.operators.neighbour_index import NeighbourIndex, refreshed
from twinlake.schema import FINGERPRINTS, POINTS
from twinlake.sources.parts import Buckets
from twinlake.streaming.ingest import rescan


def _files(folder: Path) -> dict:
    return {str(p): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_an_upsert_rewrites_its_buckets_only(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id as asset_id", "cast(id as string) as name", "array(id) as more")
    store = Buckets(spark, (tmp_path / "t").as_uri(), rows.schema, buckets=25)
    assert store.load().count() == 0
    assert len(store.save(rows)) == 25
    before = _files(tmp_path / "t")
    touched = store.save(rows.where("asset_id in (5, 17)").selectExpr("asset_id", "'new' as name", "more"))
    after = _files(tmp_path / "t")
    changed = {os.path.basename(os.path.dirname(f)) for f, _ in set(before.items()) ^ set(after.items())}
    assert changed == {f"bucket={b}" for b in touched} and len(touched) <= 2
    assert store.load().count() == 20_000 and {r.asset_id for r in store.load().where("name = 'new'").collect()} == {5, 17}
    store.save(spark.createDataFrame([(None, "x", [1]), (30_000, None, None)], "asset_id long, name string, more array<long>"))
    assert store.load().count() == 20_001


def test_a_bucket_can_lose_all_rows(spark, tmp_path):
    rows = spark.range(10).selectExpr("id as asset_id", "1 as x")
    store = Buckets(spark, (tmp_path / "t").as_uri(), rows.schema, buckets=50)
    store.save(rows)
    store.drop(rows.where("asset_id < 9"))
    assert [r.asset_id for r in store.load().collect()] == [9]
    store.drop(spark.range(5).withColumnRenamed("id", "asset_id"))
    assert store.load().count() == 1
    store.save(rows)
    assert store.load().count() == 10


def test_a_rescan_reads_what_it_reaches(spark, tmp_path):
    """1 % changed points of clustered data: under a quarter of the cells, and the lists of a search of all."""
    x = shapes(11, 2400, 24)
    index = NeighbourIndex(spark, (tmp_path / "index").as_uri())
    index.build(frame(spark, x))
    changed = np.arange(0, 2400, 40)[:40]
    x[changed] = shapes(12, 40, 0) // 20 + x[7]
    queries = frame(spark, x).where(f"asset_id % 40 = 0 and asset_id < {40 * 40}")
    before = _files(tmp_path / "index" / "points")
    index.update(queries)
    after = _files(tmp_path / "index" / "points")
    assert index.points().count() == 2400
    few = queries.where("asset_id < 1600")
    asked, search = index.plan(few)
    assert len(search.cells) < len(index.pivots()) / 4
    read = index.points(search.cells).select("_metadata.file_path").distinct().count()
    assert read < len(after) / 4
    plan = index.points(search.cells)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    got = {(r.query, r.point): r.score for r in index.nearest(few).collect()}
    whole = frame(spark, x)
    want = {(r.query, r.point): r.score for r in vectors.nearest(few, whole).collect()}
    assert got == want and len(got) > 40
    assert len(set(before.items()) & set(after.items())) > 0


def test_lists_are_refreshed_from_the_index(spark, tmp_path):
    x = shapes(13, 200, 5)
    table = frame(spark, x).selectExpr("*", "0.0D as stamp")
    points = incremental.sync(spark.createDataFrame([], POINTS), table)
    index = NeighbourIndex(spark, (tmp_path / "index").as_uri())
    index.build(table)
    points = spark.createDataFrame(refreshed(points, index).select(*POINTS.names).collect(), POINTS)
    lists = {(r.query, r.point) for r in incremental.valid_lists(points).collect()}
    assert lists == {(r.query, r.point) for r in vectors.nearest(table, table).collect()}
    assert incremental.pending(points).count() == 0 and refreshed(points, index).count() == 200


def test_index_of_nothing_and_built_again(spark, tmp_path):
    index = NeighbourIndex(spark, (tmp_path / "i").as_uri())
    x = shapes(14, 60, 3)
    index.build(frame(spark, x).where("false"))
    assert index.nearest(frame(spark, x)).count() == 0
    index.build(frame(spark, x))
    n = index.nearest(frame(spark, x)).count()
    index.build(frame(spark, x).where("asset_id < 30"))
    assert index.points().count() == 30 and 0 < index.nearest(frame(spark, x)).count() < n
    index.update(frame(spark, x).where("asset_id = 40"), gone=frame(spark, x).where("asset_id < 29"))
    assert sorted(r.asset_id for r in index.points().collect()) == [29, 40]
    assert reach.shells(index.points()).agg({"n": "sum"}).first()[0] == 2 == index.count()
    index.clear()
    assert index.count() == 0 == index.nearest(frame(spark, x)).count()
    index.build(frame(spark, x))
    assert index.count() == 60


def test_a_rescan_into_buckets(spark, tmp_path):
    """What is signed again is all that is written again, and its points lose their lists."""
    prints = Buckets(spark, (tmp_path / "prints").as_uri(), FINGERPRINTS, buckets=20)
    points = Buckets(spark, (tmp_path / "points").as_uri(), POINTS, buckets=20)
    raw = lambda k: bytes((k * 7 + i * (k % 5 + 1)) % 256 for i in range(768))
    pixels = lambda ids, more=0: spark.createDataFrame([(k, 16, raw(k + more)) for k in ids], "asset_id long, edge int, rgb binary")
    stamps = lambda ids, t: spark.createDataFrame([(k, t) for k in ids], "asset_id long, stamp double")
    assert rescan(pixels(range(40)), stamps(range(40), 0.0), prints, points) == 40
    points.save(points.load().withColumn("near_version", F.lit(1)))
    before = {n: _files(tmp_path / n) for n in ("prints", "points")}
    assert rescan(pixels(range(40), 3), stamps([1, 2], 9.0).union(stamps(range(3, 40), 0.2)), prints, points) == 2
    for n in ("prints", "points"):
        changed = {os.path.dirname(f) for f, _ in set(before[n].items()) ^ set(_files(tmp_path / n).items())}
        assert 1 <= len(changed) <= 2
    assert {r.asset_id for r in points.load().where("near_version is null").collect()} == {1, 2}
    assert prints.load().count() == 40 == points.load().count()
    assert {r.stamp for r in prints.load().where("asset_id in (1, 2)").collect()} == {9.0}
    assert rescan(pixels([]), stamps([1], 9.0), prints, points) == 0
