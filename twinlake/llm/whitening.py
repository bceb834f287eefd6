"""Whitening of embeddings: a covariance summed without rounding errors that matter, and its leading components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from twinlake.llm.eigen import symmetric_eigen
from twinlake.session import partitions, ship_package, written

#: Rows of a block, and bits of a slice: 2 * SLICE + log2(BLOCK) <= 52, so that a product of slices is exact.
BLOCK, SLICE, SLICES = 256, 22, 5
#: Entries beyond it count as it: a double holds every whole number up to here.
LARGEST = float(1 << 53)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b rounded, and what the rounding left out, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(hi: np.ndarray, lo: np.ndarray, more: np.ndarray, rest: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The double-double hi + lo with more + rest added."""
    s, e = two_sum(hi, more)
    return two_sum(s, e + (lo + rest))


def centred(x: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """x - sums / n as double-doubles."""
    means = [Fraction(s, n) for s in sums]
    hi = np.array([float(m) for m in means])
    lo = np.array([float(m - Fraction(h)) for m, h in zip(means, hi.tolist(), strict=True)])
    c, e = two_sum(x.astype(float), -hi[None, :])
    return two_sum(c, e - lo[None, :])


def outer_products(hi: np.ndarray, lo: np.ndarray) -> Iterator[np.ndarray]:
    """Matrices whose exact sum is c' @ c, c = hi + lo, but for what is below 2 ** -106 of the largest product.

    Each row is cut into slices of few bits; the product of two slices of a block
    of rows has no rounding error, so the outer products of the block's rows are
    summed by one matrix product.
    """
    top = np.abs(hi).max(initial=0.0)
    if top == 0:
        return
    unit, cut = 2.0 ** (np.ceil(np.log2(top)) + 1 - SLICE), []
    for _ in range(SLICES):
        s = np.round(hi / unit) * unit
        hi, lo = two_sum(hi - s, lo)
        cut.append(s)
        unit *= 2.0**-SLICE
    for i in range(SLICES):
        for j in range(i, SLICES - i):
            p = cut[i].T @ cut[j]
            yield p
            if i != j:
                yield p.T


def covariance_part(x: np.ndarray, n: int, sums: list[int], hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of centred outer products hi + lo with those of the rows of x added."""
    for at in range(0, len(x), BLOCK):
        for p in outer_products(*centred(x[at : at + BLOCK], n, sums)):
            hi, lo = add(hi, lo, p)
    return hi, lo


@dataclass
class Whitening:
    """What was fitted: rows and sums of the fit list, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray  # a row a component
    explained: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        hi, lo = centred(x, self.n, self.sums)
        return (hi + lo) @ (self.vectors / np.sqrt(self.values)[:, None]).T

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, exactly; None where one is no 64-bit integer."""
        top = int(np.abs(x).max(initial=0)) * self.n + max((abs(s) for s in self.sums), default=0)
        if len(self.sums) * top * top < 1 << 63:
            d = x * self.n - np.array(self.sums, np.int64)
            return (d * d).sum(1).tolist()
        out = (sum((self.n * c - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x.tolist())
        return [v if v < 1 << 63 else None for v in out]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width)


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x) of rows whose vector is not null and has finite entries only: floor(256 * entry), as long.

    Entries beyond 2 ** 53 after scaling count as that.
    """
    fine = F.forall(embedding, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    scaled = lambda c: F.greatest(F.least(c.cast("double") * 256, F.lit(LARGEST)), F.lit(-LARGEST))
    t = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding"))
    return t.where(F.col("embedding").isNotNull() & fine).select("vec_id", F.transform("embedding", lambda c: F.floor(scaled(c)).cast("long")).alias("x"))


def _partial_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
    for b in batches:
        x = _matrix(b.column("x"), width)
        n += len(x)
        high += (x >> 26).sum(0)
        low += (x & (1 << 26) - 1).sum(0)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([n] * width), pa.array(range(width), pa.int64()), pa.array(high), pa.array(low)], names=["n", "i", "high", "low"])


def fit_whitening(vectors: DataFrame, components: int = 4) -> tuple[Whitening, DataFrame] | None:
    """The whitening of vectors (x array<long>) and the fit list, each distinct x once; None without any vector.

    The vectors have the commonest width (the shorter on a tie). Sums are whole
    numbers. Each task adds up its rows' centred outer products as double-doubles
    (hi, lo); the parts of each row of the matrix then meet in one task, high and
    low apart, so a task holds two matrices of the width and never two tasks'
    parts. The driver gets one matrix, whose size is the width's square, and
    solves it. Components whose eigenvalue is no more than rounding are left out.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    widths = vectors.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return None
    d = widths["w"]
    fit = written(vectors.where(F.size("x") == d).select("x").distinct(), "whiten-fit")
    if d == 0:
        return Whitening(1, [], np.zeros(0), np.zeros((0, 0)), np.zeros(0)), fit
    parts = fit.mapInArrow(lambda batches: _partial_sums(batches, d), "n long, i long, high long, low long")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low"))).orderBy("i").collect()
    n, sums = int(rows[0]["n"]), [(int(r["high"]) << 26) + int(r["low"]) for r in rows]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hi, lo, some = np.zeros((d, d)), np.zeros((d, d)), False
        for b in batches:
            hi, lo = covariance_part(_matrix(b.column("x"), d), n, sums, hi, lo)
            some = True
        if some:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([task] * d, pa.int32()), pa.array(list(hi)), pa.array(list(lo))], names=["i", "task", "hi", "lo"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, hi, lo = None, np.zeros(d), np.zeros(d)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([row], pa.int32()), pa.array([hi]), pa.array([lo])], names=["i", "hi", "lo"])
        for b in batches:
            for i, h, v in zip(b.column("i").to_pylist(), _matrix(b.column("hi"), d), _matrix(b.column("lo"), d), strict=True):
                if row is not None and i != row:
                    yield done()
                    hi, lo = np.zeros(d), np.zeros(d)
                row = i
                hi, lo = add(hi, lo, h, v)
        if row is not None:
            yield done()

    made = written(fit.mapInArrow(part, "i int, task int, hi array<double>, lo array<double>"), "whiten-parts")
    dealt = made.repartition(min(d, partitions(spark)), "i").sortWithinPartitions("i", "task")
    total = dealt.mapInArrow(merge, "i int, hi array<double>, lo array<double>").orderBy("i").toArrow()
    hi, lo = (_matrix(total[c].combine_chunks(), d) for c in ("hi", "lo"))
    # hi and lo of a sum divided by n, then rounded once
    q = hi / n
    v = q + np.array([[float(Fraction(a) - Fraction(b) * n) for a, b in zip(*x, strict=True)] for x in zip(hi.tolist(), q.tolist(), strict=True)]) / n + lo / n
    v = (v + v.T) / 2
    values, vectors_ = symmetric_eigen(v)
    values, vectors_ = values[::-1][:components], vectors_[:, ::-1].T[:components]
    real = values > d * 2.0**-50 * max(values[0], 0.0)
    values, vectors_ = values[real], vectors_[real]
    trace = float(np.trace(v))
    return Whitening(n, sums, values, vectors_, values / trace if trace else values), fit


def identity_error(fit: DataFrame, w: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    d, k = len(w.sums), len(w.values)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, second = np.zeros(k), np.zeros((k, k))
        for b in batches:
            y = w.project(_matrix(b.column("x"), d))
            first += y.sum(0)
            second += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(range(k + k * k), pa.int64()), pa.array(np.r_[first, second.ravel()])], names=["i", "v"])

    if k == 0:
        return 0.0
    sums = fit.mapInArrow(part, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow()["v"].to_numpy() / w.n
    mean, second = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())


OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 4, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """OUT rows: each remaining vector on each of the leading components of the fit list, whitened.

    vectors: (vec_id long, embedding array of numbers); other columns are left
    out. Rows with a null vector or a null or non-finite entry are dropped, and
    those of another width than most. Rows that repeat, or that have no vec_id,
    each come back; repeated vectors weigh once in the fit. There are fewer
    components where the vectors are narrow or span less, and no rows where all
    vectors are equal or none is left. deviation is null where it is no 64-bit
    integer.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = whole_vectors(vectors, vec_id, embedding)
    found = fit_whitening(rows, components)
    if found is None:
        return spark.createDataFrame([], OUT)
    w, fit = found
    error, d, k = identity_error(fit, w), len(w.sums), len(w.values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x"), d)
            m = len(x)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.arange(m), k)).cast(pa.int64()) if not m else b.column("vec_id").cast(pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, w.n)),
                    pa.array([v for v in w.deviation(x) for _ in range(k)], pa.int64()),
                    pa.array(w.project(x).ravel()),
                    pa.array(np.tile(w.explained, m)),
                    pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    if k == 0:
        return spark.createDataFrame([], OUT)
    return rows.where(F.size("x") == d).mapInArrow(work, OUT)


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """All usable embeddings on their four leading components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
