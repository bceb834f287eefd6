"""The engine's queries on the derived library, held against DuckDB at the smallest scale."""

import glob
import os

import duckdb
import pytest

from twinlake.plans import media

DATA = "/root/testdata/sf0.001"
FAST = [
    "scan_records", "kind_classifier", "enrich_sizes", "labels_text", "dhash", "exposure", "confirmed_pairs_strict",
    "connected_components_strict", "quality_scores", "survivors_after_delete", "cache_split", "upsert", "prune_stale",
]


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(v):
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return repr(float(v)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = media.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    found = duck.sql(media.ORACLES[name])
    at = [found.columns.index(c) for c in cols]
    assert sorted(found.columns) == cols
    assert got == sorted(tuple(_plain(r[k]) for k in at) for r in found.fetchall())


def test_groups_hold_one_scene_each(spark, duck):
    edges = media._edges(spark, DATA, "strict").collect()
    mixed = [e for e in edges if e.id_lo // 8 != e.id_hi // 8 and not (e.id_lo % 8 == 5 or e.id_lo % 8 == 7)]
    assert not mixed
    turned = [e for e in edges if e.via == "neighbour" and e.id_hi % 8 == 3]
    assert turned


def test_sensitivities_nest_on_pairs(spark, duck):
    pairs = {z: {(r.id_lo, r.id_hi) for r in media._edges(spark, DATA, z).collect()} for z in ("exact", "strict", "similar")}
    assert pairs["exact"] <= pairs["strict"] <= pairs["similar"]


def test_keepers_are_members_and_groups_disjoint(spark, duck):
    rows = media.QUERIES["keepers"](spark, DATA).collect()
    assert len({r.keeper_id for r in rows}) == len(rows)
    assert all(2 <= r.members <= 60 for r in rows)
