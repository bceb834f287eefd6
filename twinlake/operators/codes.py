"""Short codes of shapes, whose products are never less than the cosines; and the pairs of shapes that they leave."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinlake.functions.signatures import rotation
from twinlake.operators.reach import SCORES, SINGLE, _shapes, _unit
from twinlake.session import partitions, ship_package, written

#: Shapes that the axes are chosen from, their pairs that are tried, and the share of these that codes may let through.
DRAWN, TRIED, SPARE = 2048, 512, 1e-5
#: Numbers of axes that are tried.
WIDTHS = (8, 16, 24, 32, 64, 128, 256)
#: Blocks that shapes are dealt in, shapes of a block from which there are more, and below which there are fewer.
BLOCKS, MOST, LEAST = 12, 1 << 16, 1 << 10
#: Rows of a block, and of the other, that are multiplied at once: their products stay in a core's cache.
STEP, WIDE = 256, 1024


def axes(points: DataFrame, floor: float, turns: int = 1) -> np.ndarray:
    """Orthonormal axes as columns: as few as tell nearly all pairs of some drawn shapes apart that are not within floor.

    They are the directions in which a bounded number of shapes, drawn by hash of
    their ids, are longest. How many and which they are decides how many pairs
    are looked at closer, never which are found.
    """
    drawn = points.orderBy(F.xxhash64("asset_id", F.lit("axes")), "asset_id").limit(DRAWN).select("shape", "shape_norm").toArrow()
    if not drawn.num_rows:
        return np.zeros((0, 0))
    u = _unit(drawn["shape"].combine_chunks().flatten().to_numpy().reshape(drawn.num_rows, -1), drawn["shape_norm"].to_numpy())
    if turns > 1:
        all_of = np.concatenate([u[:, at] * sign for at, sign in map(rotation, range(turns))])
    else:
        all_of = u
    _, found = np.linalg.eigh(all_of.T @ all_of)
    found = found[:, ::-1]
    near = (all_of[-TRIED:] @ u.T >= floor).mean()
    for k in WIDTHS:
        if k < len(found) and (coded(all_of[-TRIED:], found[:, :k]) @ coded(u, found[:, :k]).T >= floor - SINGLE).mean() <= near + SPARE:
            return found[:, :k]
    return found


def coded(unit: np.ndarray, along: np.ndarray) -> np.ndarray:
    """Coordinates along the axes, and the length of what lies across them: by Cauchy and Schwarz products are at least the cosines."""
    c = unit @ along
    return np.c_[c, np.sqrt(np.maximum(0.0, 1 - (c * c).sum(1)))].astype(np.float32)


def shape_codes(points: DataFrame, floor: float) -> DataFrame:
    """(asset_id, code) of points (asset_id, shape, shape_norm)."""
    along = axes(points, floor)
    ship_package(points.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = coded(_unit(_shapes(b), b.column("shape_norm").to_numpy()), along)
                yield pa.RecordBatch.from_arrays([b.column("asset_id"), _lists(c)], names=["asset_id", "code"])

    return points.select("asset_id", "shape", "shape_norm").mapInArrow(work, "asset_id long, code array<float>")


def _lists(c: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * c.shape[1], pa.int32()), pa.array(c.ravel()))


def _worth(of: np.ndarray, upper: np.ndarray, lower: np.ndarray, limit: int) -> np.ndarray:
    """Which rows can be among the limit best of their group."""
    order = np.lexsort((-lower, of))
    o = of[order]
    head = np.flatnonzero(np.r_[True, o[1:] != o[:-1]])
    count = np.diff(np.r_[head, len(o)])
    bar = np.where(count >= limit, lower[order][np.minimum(head + limit - 1, len(o) - 1)], -np.inf)
    out = np.empty(len(of), bool)
    out[order] = upper[order] >= np.repeat(bar, count)
    return out


DEALT = "i int, j int, left boolean, rep long, codes array<float>"
CLOSE = "a long, b long, turns int"


def close_pairs(shapes: DataFrame, n: int, along: np.ndarray, floor: float, turns: int, limit: int | None) -> DataFrame:
    """CLOSE rows, a <= b: pairs of shapes (rep, shape, shape_norm), n in all, with a bit for each turn of a that b may be within floor of.

    Shapes are dealt in blocks, and each two blocks meet in one task: a row has
    one copy more than there are blocks, which is BLOCKS until these have MOST
    rows. Codes travel, not shapes. limit: what cannot be among so many best of
    either end is left out.
    """
    spark = shapes.sparkSession
    ship_package(spark)
    blocks, wide = max(min(BLOCKS, -(-n // LEAST)), -(-n // MOST)), along.shape[1] + 1
    step, across_step = STEP, WIDE

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                b = batch.slice(low, 1024)
                unit = _unit(_shapes(b), b.column("shape_norm").to_numpy())
                turned = [coded(unit[:, at] * sign, along) for at, sign in map(rotation, range(turns))]
                rep, own = b.column("rep").to_numpy(), b.column("block").to_numpy()
                for left, codes in ((True, np.concatenate(turned, 1)), (False, turned[0])):
                    across = blocks - own if left else own + 1
                    row = np.repeat(np.arange(len(rep)), across)
                    other = np.concatenate([np.arange(k, blocks) if left else np.arange(k + 1) for k in own.tolist()])
                    i, j = (own[row], other) if left else (other, own[row])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(row), left)), pa.array(rep[row]), _lists(codes[row])],
                        names=["i", "j", "left", "rep", "codes"],
                    )

    def solve(a: np.ndarray, codes: np.ndarray, b: np.ndarray, codes_: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        codes = codes.reshape(len(a), turns, wide)
        across = np.ascontiguousarray(codes_.T)
        rest = 2 * codes_[:, -1]
        for low in range(0, len(a), step):
            found = []
            for t in range(turns):
                some, tiles = codes[low : low + step, t], []
                for low_ in range(0, len(b), across_step):
                    upper = some @ across[:, low_ : low_ + across_step]
                    at = np.flatnonzero(upper >= floor - SINGLE)
                    if len(at):
                        tiles.append((*np.divmod(at, upper.shape[1]), upper.ravel()[at], np.full(len(at), low_)))
                if not tiles:
                    continue
                m, k, most, low_ = (np.concatenate(c) for c in zip(*tiles, strict=True))
                k += low_
                if same:
                    fine = a[low + m] <= b[k]
                    m, k, most = m[fine], k[fine], most[fine]
                if not len(m):
                    continue
                if limit is not None:
                    least = most - some[m, -1] * rest[k] - 2 * SINGLE
                    fine = _worth(m, most, least, limit) | _worth(k, most, least, limit)
                    m, k = m[fine], k[fine]
                found.append((low + m, k, np.full(len(m), 1 << t)))
            if found:
                m, k, bit = (np.concatenate(c) for c in zip(*found, strict=True))
                pair, at = np.unique(m * len(b) + k, return_inverse=True)
                m, k = np.divmod(pair, len(b))
                bits = np.bincount(at, bit, len(pair)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[m], b[k])), pa.array(np.maximum(a[m], b[k])), pa.array(np.where(a[m] <= b[k], bits, _back(bits, turns)))], names=["a", "b", "turns"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {True: [], False: []}

        def one() -> Iterator[pa.RecordBatch]:
            if held[True] and held[False]:
                sides = [np.concatenate(c) for side in (True, False) for c in zip(*held[side], strict=True)]
                yield from solve(*sides, key[0] == key[1])

        for x in batches:
            i, j, left, rep = (x.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            heads = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (left[1:] != left[:-1])]).tolist() if x.num_rows else []
            for low, high in zip(heads, [*heads[1:], x.num_rows], strict=True):
                if key != (i[low], j[low]):
                    yield from one()
                    key, held = (i[low], j[low]), {True: [], False: []}
                c = x.column(4).slice(low, high - low).flatten().to_numpy()
                held[bool(left[low])].append((rep[low:high], c.reshape(high - low, -1)))
        yield from one()

    t = shapes.select("rep", "shape", "shape_norm", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int").alias("block"))
    dealt = t.mapInArrow(deal, DEALT).repartition(max(partitions(spark), min(blocks * (blocks + 1) // 2, 10_000)), "i", "j")
    return dealt.sortWithinPartitions("i", "j", "left").mapInArrow(work, CLOSE)


def _back(bits: np.ndarray, turns: int) -> np.ndarray:
    """Turn t of a against b is turn -t of b against a."""
    out = np.zeros_like(bits)
    for t in range(turns):
        out |= (bits >> t & 1) << (-t % turns)
    return out


def exact_scores(pairs: DataFrame, shapes: DataFrame, floor: float, turns: int) -> DataFrame:
    """SCORES rows between the shapes of CLOSE rows, from either end, where the cosine reaches floor."""
    side = lambda k: shapes.select(F.col("rep").alias(k), F.col("shape").alias(f"shape_{k}"), F.col("shape_norm").alias(f"norm_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "turns", "norm_a", "norm_b", "shape_a", "shape_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            a, b, bits, na, nb = (x.column(k).to_numpy() for k in range(5))
            sa, sb = (x.column(k).flatten().to_numpy().reshape(len(a), -1) for k in (5, 6))
            for t in range(turns):
                k = np.flatnonzero(bits >> t & 1)
                at, sign = rotation(t)
                # integers below 2 ** 53: the products are exact
                score = np.einsum("ij,ij->i", sa[k][:, at].astype(np.float64) * sign, sb[k].astype(np.float64))
                score /= np.sqrt(na[k].astype(np.float64) * nb[k].astype(np.float64))
                k, score = k[score >= floor], score[score >= floor]
                two = a[k] != b[k]
                for p, q, s, turn in ((a[k], b[k], score, t), (b[k][two], a[k][two], score[two], -t % turns)):
                    yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(q), pa.array(np.full(len(p), turn, np.int32)), pa.array(s)], names=["query", "point", "turn", "score"])

    return both.mapInArrow(work, SCORES)


def own_scores(points: DataFrame, floor: float, turns: int = 4, limit: int | None = None) -> DataFrame:
    """SCORES rows of points (asset_id, shape, shape_norm) among themselves, exactly; limit: of each query and turn the best ones at least.

    Equal shapes are looked at once: those that are less far from each other than
    floor by their codes are scored, and then stand for their points.
    """
    spark = points.sparkSession
    t = points.groupBy("shape", F.col("shape_norm").cast("long").alias("shape_norm")).agg(F.sort_array(F.collect_list("asset_id")).alias("ids"))
    t = written(t.select(F.col("ids")[0].alias("rep"), "shape", "shape_norm", "ids"), "code-shapes")
    n = t.count()
    if not n:
        return spark.createDataFrame([], SCORES)
    along = axes(t.withColumnRenamed("rep", "asset_id"), floor, turns)
    scores = exact_scores(written(close_pairs(t, n, along, floor, turns, limit), "code-pairs"), t, floor, turns)
    ids = t.select("rep", "ids")
    few = F.slice("ids", 1, limit) if limit is not None else F.col("ids")
    out = scores.join(ids.withColumnsRenamed({"rep": "query", "ids": "queries"}), "query")
    out = out.join(ids.select(F.col("rep").alias("point"), few.alias("points")), "point")
    out = out.select(F.explode("queries").alias("query"), "points", "turn", "score")
    return out.select("query", F.explode("points").alias("point"), "turn", "score")
