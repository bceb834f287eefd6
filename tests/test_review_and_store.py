"""Review edits, rescans, stores, sources and streaming ingest."""

import json
import struct
import threading
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from twinlake import config as C
from twinlake.functions import assets as A, export, signatures as S
from twinlake.operators import incremental, review, scoring, vectors
from twinlake.plans.control import PHASES, Progress, cancel, cancellable
from twinlake.plans.pipeline import run_pipeline
from twinlake.schema import FINGERPRINTS
from twinlake.sources import catalog, images
from twinlake.sources.store import POINTS, Store
from twinlake.streaming.ingest import ingest


def test_edits_last_one_wins(spark):
    base = spark.createDataFrame([(1, a, a > 1) for a in (1, 2, 3)] + [(2, 9, False)], "group_id long, asset_id long, marked boolean")
    edits = [(1, 1, 2, "toggle"), (2, 1, 3, "keep_only"), (3, 1, 1, "toggle"), (4, 2, 9, "toggle"), (5, 2, 9, "toggle")]
    e = spark.createDataFrame(edits, "seq long, group_id long, asset_id long, action string")
    got = {(r.group_id, r.asset_id): r.marked for r in review.apply_edits(base, e).collect()}
    assert got == {(1, 1): False, (1, 2): True, (1, 3): False, (2, 9): False}
    got = {r.asset_id: r.marked for r in review.apply_edits(base, e.where("seq < 2")).collect()}
    assert got == {1: False, 2: False, 3: True, 9: False}
    all_of = spark.createDataFrame([(1, 1, True), (1, 2, True), (2, 3, False)], base.schema)
    assert {r.group_id: r.keeps_nothing for r in review.keeps_nothing(all_of).collect()} == {1: True, 2: False}


def test_edits_of_a_large_group_do_not_meet_all_its_members(spark):
    base = spark.range(3000).selectExpr("1L as group_id", "id as asset_id", "id > 0 as marked")
    keep = spark.createDataFrame([(1, 1, 7, "keep_only")], "seq long, group_id long, asset_id long, action string")
    edits = keep.union(base.selectExpr("2L as seq", "group_id", "asset_id", "'toggle' as action"))
    out = review.apply_edits(base, edits)
    assert {r.asset_id for r in out.where("not marked").collect()} == set(range(3000)) - {7}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join " in x]
    assert joins and not any(" OR " in x for x in joins)


def test_contenders_keep_to_the_budget(spark):
    rows = [(g, 3 * g + k, k, 1.0 + k) for g in range(200) for k in range(3)]
    m = spark.createDataFrame(rows, "group_id long, asset_id long, position int, sharpness double")
    got = {r.group_id for r in scoring.contenders(m).collect()}
    assert got == set(range(133))  # 399 of 400, no group of three more fits


def _shapes(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.integers(-1000, 1000, (n, 480))


def test_neighbours_reused_invalidated_and_found_again(spark):
    x = _shapes(4)
    place, sign = S.rotation(1)
    x[1] = x[0][place] * sign

    def table(stamps):
        rows = [(k, [int(v) for v in x[k]], int((x[k] ** 2).sum()), float(t)) for k, t in enumerate(stamps)]
        return spark.createDataFrame(rows, "asset_id long, shape array<int>, shape_norm long, stamp double")

    points = incremental.sync(spark.createDataFrame([], POINTS), table([0, 0, 0, 0]))
    assert incremental.pending(points).count() == 4
    lists = vectors.nearest(table([0] * 4), table([0] * 4))
    points = spark.createDataFrame(incremental.store_lists(points, lists).select(*POINTS.names).collect(), POINTS)
    assert incremental.pending(points).count() == 0
    assert {(r.query, r.point) for r in incremental.valid_lists(points).collect()} == {(0, 1), (1, 0)}
    again = table([0, 50, 0, 0])
    assert incremental.to_write(points, again).count() == 1
    points = spark.createDataFrame(incremental.sync(points, again).select(*POINTS.names).collect(), POINTS)
    assert [r.asset_id for r in incremental.pending(points).collect()] == [1]
    assert incremental.valid_lists(points).count() == 0
    points = incremental.store_lists(points, lists)
    assert {(r.query, r.point) for r in incremental.valid_lists(points).collect()} == {(1, 0)}


def test_store_upserts_prunes_and_survives_damage(spark, tmp_path):
    store = Store(spark, (tmp_path / "s").as_uri(), POINTS)
    assert store.count() == 0 and store.disk_usage() == 0
    row = lambda k, t: (k, [1], 1, t, None, None, None)
    store.save(spark.createDataFrame([row(1, 0.0), row(2, 0.0), row(3, 0.0)], POINTS))
    store.save(spark.createDataFrame([row(2, 99.0)], POINTS))
    assert {r.asset_id: r.stamp for r in store.load().collect()} == {1: 0.0, 2: 99.0, 3: 0.0}
    live = spark.createDataFrame([(1,), (2,)], "asset_id long")
    store.prune(live, kinds=(C.PHOTO, C.VIDEO))
    assert store.count() == 3
    store.prune(live, kinds=C.ScanSettings().kinds)
    assert store.count() == 2 and store.disk_usage() > 0
    files = spark.createDataFrame([(-5,), (1,), (2,)], "asset_id long")
    assert {r.asset_id for r in incremental.prune(files, live.where("asset_id = 1"), C.ScanSettings().kinds).collect()} == {-5, 1}
    assert Store(spark, store.uri, POINTS, sizes={"shape": 1}).count() == 2
    assert Store(spark, store.uri, POINTS, sizes={"shape": 480}).count() == 0
    assert Store(spark, store.uri, POINTS, version=C.STORE_VERSION + 1).count() == 0
    many = spark.createDataFrame([row(k, 0.0) for k in range(40)], POINTS).repartition(4)
    store.replace(many)
    torn = sorted((tmp_path / "s").glob("snapshot-*/part-*"))[-1]
    torn.write_bytes(torn.read_bytes()[:100])
    for crc in torn.parent.glob(".*.crc"):
        crc.unlink()
    assert store.count() == 0
    (tmp_path / "s" / "current.json").write_text("{")
    assert store.count() == 0
    store.save(spark.createDataFrame([row(7, 1.0)], POINTS))
    assert store.count() == 1
    store.clear()
    assert store.count() == 0


def _png(path, rgb):
    h, w, _ = rgb.shape
    raw = b"".join(b"\0" + rgb[y].tobytes() for y in range(h))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    head = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_folder_scan_and_pixels(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 256, (16, 32, 3)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    _png(tmp_path / "in" / "a.png", a)
    _png(tmp_path / ".hidden.png", a)
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "note.txt").write_text("x")
    rows = catalog.scan_folder(spark, str(tmp_path)).collect()
    assert [(r.origin.split("/")[-1], r.pixel_width, r.pixel_height) for r in rows] == [("a.png", 32, 16)]
    assert rows[0].asset_id < 0
    assert rows[0].byte_size == (tmp_path / "in" / "a.png").stat().st_size
    got = {r.origin.split("/")[-1]: r for r in images.load_pixels(spark, str(tmp_path), edge=16).collect()}
    assert got["bad.png"].status == "undecodable" and got["bad.png"].rgb is None
    want = (a[:, ::2].astype(int) + a[:, 1::2] + 1) // 2
    assert (np.frombuffer(got["a.png"].rgb, np.uint8).reshape(16, 16, 3) == want).all()


def test_a_folder_from_scan_to_deletion_plan(spark, tmp_path):
    rng = np.random.default_rng(8)
    first = np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((8, 8, 1), int)).astype(np.uint8)
    other = np.kron(rng.integers(0, 256, (8, 8, 3)), np.ones((8, 8, 1), int)).astype(np.uint8)
    for name, x in (("a", first), ("copy of a", np.minimum(first.astype(int) + 3, 255).astype(np.uint8)), ("b", other)):
        _png(tmp_path / f"{name}.png", x)
    seen = []
    records = catalog.scan(spark, "folder", str(tmp_path)).withColumn("stamp", A.stamp())
    pixels = images.load_pixels(spark, str(tmp_path), edge=16)
    prints = S.fingerprints(pixels.where("status = 'ready'")).withColumn("keyframes", F.array().cast("array<long>"))
    library = records.join(prints, "asset_id")
    scan = run_pipeline(library, "strict", progress=Progress(lambda *x: seen.append(x)))
    plan = review.deletion_plan(review.default_review(scan.ranked), scan.ranked, scan.groups)
    gone = plan.join(records.select("asset_id", "origin"), "asset_id").collect()
    assert [r.sink for r in gone] == ["file"] and gone[0].origin.endswith("a.png")
    assert {r.sink for r in catalog.split_by_sink(records.select("asset_id")).collect()} == {"file"}
    assert [s[0] for s in seen if s[3] == s[4]] == list(PHASES) and all(s[3] <= s[4] for s in seen)
    absent = spark.createDataFrame([(7, True), (8, False), (9, None)], "asset_id long, is_local boolean")
    states = images.outcomes(absent.union(records.select("asset_id", F.lit(True))), pixels)
    assert tuple(images.skip_counts(states).first()) == (3, 1, 2)
    assert tuple(run_pipeline(library.limit(1), "strict", found=states).skipped.first()) == (3, 1, 2)
    for few in (library.where("false"), library.limit(1)):
        assert run_pipeline(few, "strict").groups.count() == 0


def test_a_scan_is_cancelled(spark):
    failed = []

    def work():
        with cancellable(spark, "scan"):
            try:
                spark.range(4).repartition(4).mapInPandas(lambda b: (time.sleep(60) or x for x in b), "id long").count()
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    t = threading.Thread(target=work)
    t.start()
    for _ in range(60):
        time.sleep(0.5)
        cancel(spark, "scan")
        if not t.is_alive():
            break
    t.join(1)
    assert failed and not t.is_alive()


def test_labels_and_payload(spark):
    row = spark.createDataFrame([(1, [1], 1, 2.0, [(7, 0.5, 3.0)], 2.0, 1)], POINTS)
    said = json.loads(row.select(export.payload().alias("p")).first().p)
    assert said == {"asset": 1, "stamp": 2.0, "near_stamp": 2.0, "near_version": 1, "near": [{"a": 7, "s": 0.5, "t": 3.0}]}
    sizes = [0, 999, 1000, 1_234_567, 45_600_000, 999_000_000_000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(A.byte_label(F.col("n")).alias("t")).collect()
    assert [r.t for r in rows] == ["0 bytes", "999 bytes", "1.00 kB", "1.23 MB", "45.6 MB", "999 GB"]


def test_catalogue_scan_orders_filters_and_classifies(spark, tmp_path):
    rows = [(1, "image", False, False, None, False), (2, "image", True, False, "2024-01-02", False), (3, "video", False, False, "2024-01-01", False), (4, "image", False, True, "2024-01-03", True), (5, "sound", False, False, None, False)]
    df = spark.createDataFrame(rows, "asset_id long, media string, is_screenshot boolean, is_live boolean, day string, is_hidden boolean")
    df = df.selectExpr("asset_id", "media", "is_screenshot", "is_live", "is_hidden", "100 AS pixel_width", "50 AS pixel_height", "cast(day AS timestamp_ntz) AS creation_ts", "cast(null AS timestamp_ntz) AS modification_ts", "2.0D AS duration", "false AS is_favorite", "cast(null AS string) AS burst_id", "false AS is_edited", "false AS is_hdr")
    df.write.parquet(str(tmp_path / "c"))
    got = catalog.scan(spark, "library", str(tmp_path / "c")).collect()
    assert [(r.asset_id, r.kind) for r in got] == [(3, C.VIDEO), (2, C.SCREENSHOT), (1, C.PHOTO)]
    assert got[0].byte_size == 600_000 and got[1].byte_size == 750
    assert catalog.scan_catalogue(spark, str(tmp_path / "c"), kinds=[C.VIDEO]).count() == 1


def test_streaming_ingest_signs_only_what_changed(spark, tmp_path):
    prints = Store(spark, (tmp_path / "prints").as_uri(), FINGERPRINTS)
    points = Store(spark, (tmp_path / "points").as_uri(), POINTS)
    drop, seen = tmp_path / "drop", []

    def send(rows):
        spark.createDataFrame(rows, "asset_id long, edge int, rgb binary, stamp double").coalesce(1).write.mode("append").parquet(str(drop))
        ingest(spark, str(drop), str(tmp_path / "cp"), prints, points, seen.append).awaitTermination()

    raw = lambda k: bytes((k * 7 + i) % 256 for i in range(768))
    send([(1, 16, raw(1), 0.0), (2, 16, raw(2), 0.0)])
    send([(1, 16, raw(1), 0.2), (2, 16, raw(3), 9.0), (3, 16, raw(4), 0.0)])
    assert seen == [2, 2]
    assert {r.asset_id: r.stamp for r in prints.load().collect()} == {1: 0.0, 2: 9.0, 3: 0.0}
    assert points.count() == 3


def test_settings_round_trip():
    s = C.ScanSettings("similar", (0, 3), "/pictures")
    assert C.ScanSettings.from_json(s.to_json()) == s
    assert not s.stale(s.to_json()) and C.ScanSettings().stale(s.to_json())
    assert C.ScanSettings().all_kinds() and not s.all_kinds()
