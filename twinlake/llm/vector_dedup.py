"""Near-duplicate embeddings by cross-polytope hashing, with every candidate pair verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from twinlake.llm.batches import release
from twinlake.operators.graph import connected_components
from twinlake.session import free_names, ship_package, written

#: Members of a bucket that meet in one task; larger buckets are cut into tiles of pairs of blocks.
TILE = 512
#: Probability that a pair at the threshold shares no bucket of any table.
MISSED = 1e-6


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row; the width is a power of two."""
    n, d = x.shape
    half = 1
    while half < d:
        y = x.reshape(n, d // (2 * half), 2, half)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        half *= 2
    return x / math.sqrt(d)


def probes(x: np.ndarray, tables: int, functions: int, seed: int = 7) -> np.ndarray:
    """(rows, tables, functions + 1) bucket codes: the nearest vertices, then each swapped for the second nearest.

    A function turns the vector by three rounds of random signs and Hadamard
    transforms and takes the nearest vertex of the cross-polytope. Two vectors
    meet if they share any code of a table.
    """
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = np.random.default_rng([seed, width]).choice([-1.0, 1.0], (tables, functions, 3, width))
    out = np.zeros((len(x), tables, functions + 1), np.int64)
    for t in range(tables):
        near = []
        for f in range(functions):
            y = x
            for s in signs[t, f]:
                y = hadamard(y * s)
            two = np.argsort(-np.abs(y), axis=1, kind="stable")[:, :2]
            near.append(2 * two + (np.take_along_axis(y, two, 1) < 0))
        for p in range(functions + 1):
            for f in range(functions):
                out[:, t, p] = out[:, t, p] * (2 * width) + near[f][:, int(p == f + 1)]
    return out


def tables_for(width: int, functions: int, threshold: float, pairs: int = 1000, trial: int = 6) -> int:
    """Tables that leave a pair at the threshold unmet with probability MISSED; measured on random pairs of this width."""
    rng = np.random.default_rng([width, functions])
    x, y = rng.normal(size=(2, pairs, max(2, width)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + math.sqrt(max(0.0, 1 - threshold**2)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    a, b = probes(x, trial, functions), probes(y, trial, functions)
    met = (a[:, :, :, None] == b[:, :, None, :]).any((2, 3)).mean()
    return max(2, math.ceil(math.log(MISSED) / math.log(max(1e-9, min(1 - met, 0.5)))))


def _first_shared(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of codes (pairs, tables, probes): the first table with a shared code, and the least such code."""
    table = np.full(len(a), -1)
    code = np.zeros(len(a), np.int64)
    for t in range(a.shape[1]):
        same = a[:, t, :, None] == b[:, t, None, :]
        least = np.where(same.any(2), a[:, t], np.iinfo(np.int64).max).min(1)
        new = (table < 0) & (least < np.iinfo(np.int64).max)
        table[new], code[new] = t, least[new]
    return table, code


def link_tile(
    key: tuple[int, int], x: np.ndarray, codes: np.ndarray, weight: np.ndarray, block: np.ndarray, blocks: tuple[int, int],
    threshold: float,
) -> tuple[np.ndarray, np.ndarray]:
    """(links, root) of the members of one tile.

    links: the copies of the linked partners, of pairs whose first shared bucket
    is this one, so over all buckets each pair counts once. root: the first member
    that a member reaches by links of the tile.
    """
    n = len(x)
    links, root = np.zeros(n, np.int64), np.arange(n)
    rows = [np.flatnonzero(block == b) for b in blocks]
    src, dst = [], []
    for low in range(0, len(rows[0]), 512):
        i = rows[0][low : low + 512]
        a, b = np.nonzero(x[i] @ x[rows[1]].T >= threshold)
        a, b = i[a], rows[1][b]
        if blocks[0] == blocks[1]:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 1 << 16):
            p, q = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
            table, code = _first_shared(codes[p], codes[q])
            own = (table == key[0]) & (code == key[1])
            np.add.at(links, p[own], weight[q[own]])
            np.add.at(links, q[own], weight[p[own]])
        src.append(a)
        dst.append(b)
    a, b = np.concatenate(src or [root[:0]]), np.concatenate(dst or [root[:0]])
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return links, root


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.98,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    functions: int | None = None,
    tables: int | None = None,
    tile: int = TILE,
) -> DataFrame:
    """vectors with n_links, component_id and kept; links join vectors of equal label and cosine >= threshold.

    Equal vectors are one class from the start. Classes meet in the buckets of
    cross-polytope hashes of rotated vectors, each looked up with its nearest
    vertex and second nearest ones; pairs are verified by their cosine in double
    precision, tile by tile, and only counts and one edge a member leave a tile.
    functions: hash functions a table, by default as many as keep buckets of
    unrelated vectors nearly empty, which grows with the logarithm of the rows.
    tables: by default as many as leave one pair in a million at the threshold
    unmet, whatever the width, the functions and the number of rows.

    A vector that is null, empty, zero or holds null or non-finite components,
    one whose label is null, and one without vec_id link with nothing: 0 links,
    their own id, kept. Vectors of different length do not link. Rows that
    repeat a vec_id and vector count as vectors of their own and share one
    component; kept is then true for each row of the least id. Other columns
    pass through; those named as new ones are replaced. An empty table gives an
    empty table.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    new = ("n_links", "component_id", "kept")
    vectors = vectors.drop(*new)
    x = F.col(embedding)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    good = (
        F.col(label).isNotNull() & F.col(vec_id).isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda v: v != 0)
    )
    good = F.coalesce(good, F.lit(False))
    plain = vectors.where(good).select(F.col(label).alias("label"), x.alias("x"), F.col(vec_id).alias("id"))
    classes = plain.groupBy("label", "x").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = written(classes, "vector-classes")
    width = classes.agg(F.max(F.size("x"))).first()[0] or 2
    if functions is None:
        most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
        functions = max(1, math.ceil(math.log(64 * most) / math.log(2 * width)))
    tables = tables or tables_for(width, functions, threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 1024):
                part = b.slice(low, 1024)
                rows = [np.asarray(v, np.float64) for v in part.column("x").to_pylist()]
                codes: list[list[int]] = [[]] * len(rows)
                for d in {len(r) for r in rows}:
                    mine = [k for k, r in enumerate(rows) if len(r) == d]
                    m = np.array([rows[k] for k in mine])
                    found = probes(m / np.abs(m).max(1, keepdims=True), tables, functions)
                    for k, c in zip(mine, found.reshape(len(mine), -1).tolist(), strict=True):
                        codes[k] = c
                names = [*part.schema.names, "codes"]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(codes, pa.list_(pa.int64()))], names=names)

    coded = classes.mapInArrow(hashed, T.StructType([*classes.schema.fields, T.StructField("codes", T.ArrayType(T.LongType()))]))
    coded = written(coded, "vector-codes")
    each = coded.select("label", F.size("x").alias("dim"), "rep", F.posexplode("codes").alias("k", "code"))
    # a class may reach one bucket by two probes
    each = each.select("label", "dim", F.expr(f"cast(k div {functions + 1} as int)").alias("t"), "code", "rep").distinct()
    keys = ["label", "dim", "t", "code"]
    full = written(each.groupBy(*keys).agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "vector-full")
    blocks = F.ceil(F.col("members") / tile).cast("int")
    placed = each.join(full, keys).withColumn("block", F.pmod(F.xxhash64("rep"), blocks).cast("int"))
    others = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.struct(F.least("block", o).alias("lo"), F.greatest("block", o).alias("hi")),
    )
    placed = placed.select(*keys, "rep", "block", F.explode(others).alias("tile"))
    body = coded.select("label", F.size("x").alias("dim"), "rep", "n", "x", "codes")
    tiles = placed.join(body, ["label", "dim", "rep"]).select(
        F.xxhash64(*keys, "tile").alias("deal"), F.struct(*keys, "tile").alias("key"), "rep", "n", "block", "x", "codes"
    )

    def solve(rows: list) -> pa.RecordBatch:
        key = rows[0][0]
        m = np.array([r[4] for r in rows], np.float64)
        m /= np.abs(m).max(1, keepdims=True)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        codes = np.array([r[5] for r in rows], np.int64).reshape(len(rows), tables, functions + 1)
        links, root = link_tile(
            (key["t"], key["code"]), m, codes, np.array([r[2] for r in rows]), np.array([r[3] for r in rows]),
            (key["tile"]["lo"], key["tile"]["hi"]), threshold,
        )
        reps = [r[1] for r in rows]
        some = np.flatnonzero((links > 0) | (root != np.arange(len(root)))).tolist()
        return pa.RecordBatch.from_arrays(
            [
                pa.array([reps[k] for k in some], pa.int64()),
                pa.array([reps[root[k]] for k in some], pa.int64()),
                pa.array([int(links[k]) for k in some], pa.int64()),
            ],
            names=["src", "dst", "links"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "rep", "n", "block", "x", "codes")]
            for r in zip(*cols, strict=True):
                if rows and r[0] != rows[0][0]:
                    if len(rows) > 1:
                        yield solve(rows)
                    rows = []
                rows.append(r)
        if len(rows) > 1:
            yield solve(rows)
        release()

    dealt = tiles.repartition("deal").sortWithinPartitions("deal", "key", "rep")
    found = written(dealt.mapInArrow(work, "src long, dst long, links long"), "vector-links")
    linked = found.groupBy(F.col("src").alias("rep")).agg(F.sum("links").alias("links"))
    parts = connected_components(found.select("src", "dst")).withColumnRenamed("node", "rep")
    one = classes.join(linked, "rep", "left").join(parts, "rep", "left")
    own_label, own, links, component = free_names(vectors.columns, "own_label", "own", "links", "component")
    one = one.select(
        F.col("label").alias(own_label), F.col("x").alias(own),
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias(links), F.coalesce("component", "rep").alias(component),
    )
    one = written(one, "vector-one")  # a plain table, so that a vector that many rows have can be split
    out = vectors.where(good).join(one, (F.col(label) == F.col(own_label)) & (x == F.col(own)))
    done = out.select(
        *vectors.columns,
        F.col(links).cast("long").alias("n_links"),
        F.col(component).alias("component_id"),
        (F.col(vec_id) == F.col(component)).alias("kept"),
    )
    rest = vectors.where(~good).select("*", F.lit(0).cast("long").alias("n_links"), F.col(vec_id).alias("component_id"), F.lit(True).alias("kept"))
    return done.union(rest)


def op3_vector_dedup(spark, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    out = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("vec_id", "n_links", "component_id", "kept")


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
c(node, root) USING KEY (node) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT p.a, min(c.root) FROM p JOIN c ON c.node = p.b JOIN recurring.c AS own ON own.node = p.a
  WHERE c.root < own.root GROUP BY p.a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, root AS component_id, vec_id = root AS kept
FROM embeddings JOIN c ON c.node = vec_id LEFT JOIN n ON n.a = vec_id
"""
