"""Which vectors can be within an angle of each other, by their angles to pivots; and the scores of those that can."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinlake.functions.signatures import rotation
from twinlake.session import partitions, ship_package, written

#: Vectors a pivot should have, pivots at most, and vectors from which they are chosen, for each pivot.
CELL, PIVOTS, DRAWN = 32, 2048, 8
#: Width of a shell in radians.
SHELL = 0.14
#: Vectors of a block and of a tile; queries that meet a tile in one task.
BLOCK, TILE, QUERIES = 1024, 4096, 8192
#: Share of a tile's blocks from which its queries are multiplied with all of it.
DENSE = 0.2
#: What rounding can take from an angle, in radians, or add to a cosine in single precision.
SLACK, SINGLE = 1e-6, 1e-4
POINT = "asset_id long, shape array<int>, shape_norm long, cell int, angle double, spread long"


def _unit(shapes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return shapes / np.sqrt(norms.astype(np.float64))[:, None]


def _shapes(b: pa.RecordBatch) -> np.ndarray:
    return b.column("shape").flatten().to_numpy().reshape(b.num_rows, -1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def choose_pivots(points: DataFrame, n: int) -> np.ndarray:
    """Unit vectors that lie far from each other, as rows: one for CELL points, at most PIVOTS.

    They are taken from a bounded number of points, drawn by hash of their ids:
    each next one is the one farthest from those before it.
    """
    want = min(PIVOTS, max(1, -(-n // CELL)))
    drawn = points.orderBy(F.xxhash64("asset_id", F.lit("pivot")), "asset_id").limit(DRAWN * want).select("shape", "shape_norm").toArrow()
    if not drawn.num_rows:
        return np.zeros((0, 0))
    u = _unit(drawn["shape"].combine_chunks().flatten().to_numpy().reshape(drawn.num_rows, -1), drawn["shape_norm"].to_numpy())
    chosen, near = [0], u @ u[0]
    while len(chosen) < min(want, len(u)):
        chosen.append(int(near.argmin()))
        if near[chosen[-1]] > 1 - 1e-9:
            chosen.pop()
            break
        near = np.maximum(near, u @ u[chosen[-1]])
    return u[chosen]


def placed(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """POINT rows: each point's nearest pivot (cell), its angle to it, and a hash that spreads equal points."""
    ship_package(points.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cosine = _unit(_shapes(b), b.column("shape_norm").to_numpy()) @ pivots.T
                cell = cosine.argmax(1)
                angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1.0, 1.0))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("asset_id", "shape", "shape_norm")), pa.array(cell.astype(np.int32)), pa.array(angle), b.column("spread")],
                    names=[x.split()[0] for x in POINT.split(", ")],
                )

    t = points.select("asset_id", "shape", F.col("shape_norm").cast("long").alias("shape_norm"), F.xxhash64("asset_id").alias("spread"))
    return t.mapInArrow(work, POINT)


def shells(points: DataFrame) -> DataFrame:
    """(cell, shell, n, low, high): points (POINT rows) of a cell by ranges of their angle to its pivot."""
    shell = F.floor(F.col("angle") / SHELL).cast("int")
    return points.groupBy("cell", shell.alias("shell")).agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("low"), F.max("angle").alias("high"))


def _chain(pivots: np.ndarray) -> np.ndarray:
    """An order of the pivots in which each is followed by the nearest of those left."""
    left, at, out = np.ones(len(pivots), bool), 0, []
    for _ in range(len(pivots)):
        out.append(at)
        left[at] = False
        if left.any():
            at = int(np.where(left, pivots @ pivots[at], -2.0).argmax())
    return np.array(out, np.int64)


@dataclass
class Blocks:
    """Blocks of points: a shell of a cell, or a part of one where it is large; tiles are runs of blocks.

    cell, low, high, rows, tile: a value a block. first, parts: by (cell, shell),
    the shell's first block and how many it has.
    """

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray
    tile: np.ndarray
    first: dict[tuple[int, int], tuple[int, int]] = field(default_factory=dict)

    @classmethod
    def of(cls, pivots: np.ndarray, rows: list) -> Blocks:
        """rows: (cell, shell, n, low, high); their number is bounded by that of pivots."""
        place = np.empty(len(pivots), np.int64)
        place[_chain(pivots)] = np.arange(len(pivots))
        first, out = {}, []
        for cell, shell, n, low, high in sorted(rows, key=lambda r: (place[r[0]], r[1])):
            parts = -(-n // BLOCK)
            first[cell, shell] = (len(out), parts)
            out += [(cell, low, high, n / parts)] * parts
        cell, low, high, size = (np.array(c) for c in zip(*out, strict=True)) if out else (np.zeros(0),) * 4
        upto = np.cumsum(size)
        return cls(pivots, cell.astype(np.int64), low, high, size, ((upto - size) // TILE).astype(np.int64), first)

    def block_of(self, cell: np.ndarray, angle: np.ndarray, spread: np.ndarray) -> np.ndarray:
        out = np.empty(len(cell), np.int64)
        shell = np.floor(angle / SHELL).astype(np.int64)
        for k, key in enumerate(zip(cell.tolist(), shell.tolist(), strict=True)):
            low, parts = self.first[key]
            out[k] = low + int(spread[k]) % parts
        return out

    def reached(self, unit: np.ndarray, floor: float, turns: int) -> np.ndarray:
        """(turns, vectors, blocks): whether a turned vector can score floor with any point of a block.

        The angle is a distance: a point whose angle to the pivot is below low or
        above high by more than the angle of the floor, as seen from the vector,
        is too far from it.
        """
        reach = np.arccos(np.clip(floor, -1.0, 1.0)) + SLACK
        out = np.empty((turns, len(unit), len(self.cell)), bool)
        for t in range(turns):
            at, sign = rotation(t)
            a = _angles(unit[:, at] * sign, self.pivots)[:, self.cell]
            out[t] = (a >= self.low - reach) & (a <= self.high + reach)
        return out


@dataclass
class Search:
    """What a search deals: tasks of each tile, and the share of all pairs (turns counted) that are scored."""

    blocks: Blocks
    chunks: np.ndarray
    share: float
    cells: list[int]


def plan_search(queries: DataFrame, blocks: Blocks, floor: float, turns: int, own: bool) -> Search:
    """Counts, in one pass over the placed queries, which tiles they reach; collects a row a tile and a row a cell."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, cells = np.zeros(int(blocks.tile.max(initial=-1)) + 1, np.int64), np.zeros(len(blocks.pivots), bool)
        pairs, n = 0.0, 0
        for near, _, b in _reaching(batches, blocks, floor, turns, own):
            any_turn = near.any(0)
            tiles += np.add.reduceat(any_turn, np.flatnonzero(np.r_[True, blocks.tile[1:] != blocks.tile[:-1]]), axis=1).astype(bool).sum(0)
            cells[blocks.cell[any_turn.any(0)]] = True
            pairs += float((near.sum((0, 1)) * blocks.rows).sum())
            n += b.num_rows
        k = np.r_[np.arange(len(tiles)), -1 - np.flatnonzero(cells)]
        v = np.r_[tiles, np.ones(cells.sum(), np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(v.astype(np.int64)), pa.array(np.where(k == 0, pairs, 0.0)), pa.array(np.where(k == 0, n, 0))], names=["k", "v", "pairs", "n"])

    sums = queries.mapInArrow(work, "k long, v long, pairs double, n long").groupBy("k").agg(*(F.sum(c).alias(c) for c in ("v", "pairs", "n"))).collect()
    chunks = np.ones(int(blocks.tile.max(initial=-1)) + 1, np.int64)
    for r in sums:
        if r["k"] >= 0:
            chunks[r["k"]] = max(1, -(-r["v"] // QUERIES))
    total = sum(r["n"] for r in sums) * float(blocks.rows.sum()) * turns / (2 if own else 1)
    return Search(blocks, chunks, sum(r["pairs"] for r in sums) / max(total, 1.0), sorted(-1 - r["k"] for r in sums if r["k"] < 0))


def _reaching(batches, blocks: Blocks, floor: float, turns: int, own: bool, step: int = 512):
    """(reached, own blocks, rows) of a few rows at a time; own: among themselves, the later block of a pair of blocks is looked for."""
    for b in batches:
        for low in range(0, b.num_rows, step):
            part = b.slice(low, step)
            near = blocks.reached(_unit(_shapes(part), part.column("shape_norm").to_numpy()), floor, turns)
            home = np.full(part.num_rows, -1, np.int64)
            if own:
                home = blocks.block_of(part.column("cell").to_numpy(), part.column("angle").to_numpy(), part.column("spread").to_numpy())
                near &= np.arange(len(blocks.cell)) >= home[:, None]
            yield near, home, part


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(tile, columns) of each run of rows of one tile and chunk."""
    key, parts = None, []
    for b in batches:
        i, j = b.column("tile").to_numpy(), b.column("chunk").to_numpy()
        shapes = _shapes(b)
        rows = [b.column("asset_id").to_numpy(), b.column("shape_norm").to_numpy(), b.column("block").to_numpy(), np.array(b.column("mask").to_pylist(), object), shapes]
        heads = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]).tolist() if b.num_rows else []
        for low, high in zip(heads, [*heads[1:], b.num_rows], strict=True):
            here = (int(i[low]), int(j[low]))
            if parts and here != key:
                yield key[0], [np.concatenate(c) for c in zip(*parts, strict=True)]
                parts = []
            key = here
            parts.append([r[low:high] for r in rows])
    if parts:
        yield key[0], [np.concatenate(c) for c in zip(*parts, strict=True)]


def _best(query: np.ndarray, point: np.ndarray, score: np.ndarray, limit: int | None) -> np.ndarray:
    """Places of the limit best points of each query, ties by point; all without a limit."""
    if limit is None:
        return np.arange(len(query))
    order = np.lexsort((point, -score, query))
    q = query[order]
    head = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(head, np.diff(np.r_[head, len(q)]))
    return order[rank < limit]


SCORES = "query long, point long, turn int, score double"
DEALT = "tile long, chunk long, asset_id long, shape_norm long, block long, mask binary, shape array<int>"


def scored(queries: DataFrame, points: DataFrame | None, search: Search, floor: float, turns: int, limit: int | None) -> DataFrame:
    """SCORES rows of placed queries and points (None: the queries themselves).

    A query goes to the tiles that it reaches, with a bit for each block and turn;
    a tile's points to as many tasks as its queries need. In a task, each block is
    one product of matrices with the queries that reach it, in single precision,
    and what reaches the floor but for its error is scored exactly. Among
    themselves, two blocks meet once: turn r of one against the other is turn -r
    of the other against it. limit: of each query, turn and tile only so many best
    leave the task.
    """
    own, blocks, chunks = points is None, search.blocks, search.chunks
    ship_package(queries.sparkSession)
    starts = np.flatnonzero(np.r_[True, blocks.tile[1:] != blocks.tile[:-1]]) if len(blocks.tile) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(blocks.tile)]

    def deal(b: pa.RecordBatch, row: np.ndarray, tile: np.ndarray, chunk: np.ndarray, block: np.ndarray, masks: list) -> pa.RecordBatch:
        some = b.select(["asset_id", "shape_norm", "shape"]).take(pa.array(row))
        return pa.RecordBatch.from_arrays(
            [pa.array(tile), pa.array(chunk), some.column(0), some.column(1), pa.array(block), pa.array(masks, pa.binary()), some.column(2)],
            names=[x.split()[0] for x in DEALT.split(", ")],
        )

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for near, home, b in _reaching(batches, blocks, floor, turns, own):
            spread = b.column("spread").to_numpy() >> 20
            for t, (low, high) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                bits = near[:, :, low:high]
                row = np.flatnonzero(bits.any((0, 2)))
                if len(row):
                    packed = np.packbits(bits[:, row].transpose(1, 0, 2).reshape(len(row), -1), axis=1)
                    yield deal(b, row, np.full(len(row), t), spread[row] % chunks[t], home[row], [m.tobytes() for m in packed])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                block = blocks.block_of(b.column("cell").to_numpy(), b.column("angle").to_numpy(), b.column("spread").to_numpy())
                tile = blocks.tile[block]
                row = np.repeat(np.arange(b.num_rows), chunks[tile])
                chunk = np.concatenate([np.arange(c) for c in chunks[tile].tolist()])
                yield deal(b, row, tile[row], chunk, block[row], [None] * len(row))

    def solve(tile: int, ids: np.ndarray, norms: np.ndarray, block: np.ndarray, mask: np.ndarray, shapes: np.ndarray) -> Iterator[pa.RecordBatch]:
        side = np.array([m is not None for m in mask])
        a, p = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(a) or not len(p):
            return
        low, high = int(starts[tile]), int(ends[tile])
        bits = np.unpackbits(np.array([np.frombuffer(m, np.uint8) for m in mask[a]]), axis=1)[:, : turns * (high - low)].reshape(len(a), turns, high - low)
        unit = _unit(shapes, norms).astype(np.float32)
        p = p[np.argsort(block[p], kind="stable")]
        of = block[p]
        for turn in range(turns):
            at, sign = rotation(turn)
            turned = unit[a][:, at] * sign.astype(np.float32)
            found = []
            want = bits[:, turn].astype(bool)
            # where most is reached one large product is quicker than many small ones, and gives the same
            groups = [(low, high)] if want.mean() > DENSE else [(k, k + 1) for k in range(low, high)]
            for first, last in groups:
                r = p[np.searchsorted(of, first) : np.searchsorted(of, last)]
                q = np.flatnonzero(want[:, first - low : last - low].any(1))
                if not len(r) or not len(q):
                    continue
                other, place = unit[r].T, block[r] - low
                for s in range(0, len(q), 512):
                    m, n = np.nonzero(turned[q[s : s + 512]] @ other >= floor - SINGLE)
                    fine = want[q[s + m], place[n]]
                    found.append((a[q[s + m[fine]]], r[n[fine]]))
            if not found:
                continue
            m, n = (np.concatenate(c) for c in zip(*found, strict=True))
            exact = np.empty(len(m))
            for s in range(0, len(m), 1 << 14):
                i = slice(s, s + (1 << 14))
                # integers below 2 ** 53: the products are exact
                exact[i] = np.einsum("ij,ij->i", shapes[m[i]][:, at].astype(np.float64) * sign, shapes[n[i]].astype(np.float64))
            exact /= np.sqrt(norms[m].astype(np.float64) * norms[n].astype(np.float64))
            fine = exact >= floor
            m, n, exact = m[fine], n[fine], exact[fine]
            ways = [(m, n, exact, turn)]
            if own:
                two = block[m] != block[n]
                ways.append((n[two], m[two], exact[two], -turn % turns))
            for x, y, score, t in ways:
                best = _best(ids[x], ids[y], score, limit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[x][best]), pa.array(ids[y][best]), pa.array(np.full(len(best), t, np.int32)), pa.array(score[best])],
                    names=["query", "point", "turn", "score"],
                )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile, rows in _runs(batches):
            yield from solve(tile, *rows)

    dealt = queries.mapInArrow(ask, DEALT).unionByName((queries if own else points).mapInArrow(answer, DEALT))
    dealt = dealt.repartition(max(partitions(queries.sparkSession), min(int(chunks.sum()), 10_000)), "tile", "chunk").sortWithinPartitions("tile", "chunk")
    return dealt.mapInArrow(work, SCORES)


def block_scores(
    queries: DataFrame, points: DataFrame | None, floor: float, turns: int = 4, limit: int | None = None
) -> DataFrame:
    """(query, point, turn, score) with cosine of the turned query and the point >= floor, exactly.

    queries, points: (asset_id, shape, shape_norm); points None: the queries
    themselves, which meet by short codes (operators/codes.py), for the shapes
    would travel once for each tile. An empty side gives an empty table.
    """
    if points is None:
        from twinlake.operators.codes import own_scores

        return own_scores(queries, floor, turns, limit)
    pivots = choose_pivots(points, points.count())
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], SCORES)
    there = written(placed(points, pivots), "reach-points")
    blocks = Blocks.of(pivots, [tuple(r) for r in shells(there).collect()])
    asked = written(placed(queries, pivots), "reach-queries")
    return scored(asked, there, plan_search(asked, blocks, floor, turns, False), floor, turns, limit)
