"""Pairs of assets that are worth a closer look."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twinlake import config as C
from twinlake.functions.assets import aspect_ratio, degenerate, keyframe_distance, overlap, same_moment, shape_required
from twinlake.operators import verify
from twinlake.operators.reach import SINGLE
from twinlake.operators.verify import accepted
from twinlake.session import partitions, ship_package, written

#: Assets of one band that meet one task's rows of the other side in joins; in numpy, rows that a task holds at most and at least, and how many times as many it reads past them.
BAND, BLOCK, LEAST, ACROSS = 4096, 32768, 4096, 2
#: Rows of either side whose hashes are compared at once, rows that are read at once, and rows of a batch of pairs.
TILE, READ, BATCH = (64, 4096), 8192, 1 << 16
#: Pairs whose shapes are multiplied at once: they stay in a core's cache.
DOTS = 256
#: Parts of a hash: of so many, one is equal in two hashes that differ in fewer bits.
PARTS = 11


def clip_fingerprints(frames: DataFrame) -> DataFrame:
    """One fingerprint a clip from those of its frames: the middle frame's, with the hashes of all in keyframes.

    frames: fingerprints with frame_idx. Frames that could not be read are absent,
    and later ones move up; the middle is counted among those present.
    """
    all_of = F.sort_array(F.collect_list(F.struct("frame_idx", *[c for c in frames.columns if c not in ("asset_id", "frame_idx")])))
    clips = frames.groupBy("asset_id").agg(all_of.alias("f"))  # a handful of frames
    middle = F.get("f", F.expr("cast(size(f) div 2 as int)"))
    fields = ("dhash", "histogram", "shape", "shape_norm", "sharpness", "exposure", "mean_luma")
    return clips.select("asset_id", *(middle[c].alias(c) for c in fields), F.col("f.dhash").alias("keyframes"))


def _luma_range(luma: Column) -> Column:
    # a little wider than the tolerance, against rounding
    return F.floor(luma / (C.LUMA_TOLERANCE + 1e-4)).cast("int")


def banded_pairs(left: DataFrame, right: DataFrame, band: Column, condition: Column) -> DataFrame:
    """Pairs (a, b) of rows of the same or adjacent bands (a whole number of each row) that satisfy condition.

    Bands make a tolerance a hash join. One band can hold a large part of all
    rows, so each is cut further: left rows take one of n blocks, right rows go
    to all n, n being set by how many rows the band has; no task holds a band.
    """
    size = left.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"))
    size = size.select("band", F.ceil(F.col("n") / BAND).cast("int").alias("blocks"))
    a = left.select(F.struct("*").alias("a"), band.alias("band")).join(size, "band")
    a = a.withColumn("block", F.pmod(F.xxhash64("a.asset_id"), "blocks").cast("int")).drop("blocks")
    near = F.array(*(band + d for d in (-1, 0, 1)))
    b = right.select(F.struct("*").alias("b"), F.explode(near).alias("band")).join(size, "band")
    b = b.select("b", "band", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return a.join(b, (a["band"] == b["band"]) & (a["block"] == b["block"]) & condition).select("a", "b")


def luma_pairs(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Pairs (a, b) of rows whose mean luma is within tolerance and that satisfy condition."""
    gate = F.abs(F.col("a.mean_luma") - F.col("b.mean_luma")) <= C.LUMA_TOLERANCE
    return banded_pairs(left, right, _luma_range(F.col("mean_luma")), gate & condition)


def with_similarity(pairs: DataFrame, assets: DataFrame) -> DataFrame:
    """(id_lo, id_hi, hash_distance, histogram_similarity): histograms are fetched for pairs only."""
    hist = assets.select("asset_id", "histogram")
    pairs = pairs.join(hist.select(F.col("asset_id").alias("id_lo"), F.col("histogram").alias("ha")), "id_lo")
    pairs = pairs.join(hist.select(F.col("asset_id").alias("id_hi"), F.col("histogram").alias("hb")), "id_hi")
    n = F.aggregate("ha", F.lit(0), lambda s, x: s + x)
    pairs = pairs.withColumn("histogram_similarity", overlap(F.col("ha"), F.col("hb"), n))
    return pairs.select("id_lo", "id_hi", "hash_distance", "histogram_similarity")


KEYS = ["luma_key", "aspect_key", "part", "bits"]
GATES = ["asset_id", "dhash", "mean_luma", "aspect"]
PAIR = "id_lo long, id_hi long, hash_distance int"
#: Whether a pair is of one moment, and the cosine of its shapes.
GREY = ", together boolean, score double"
#: The moment's limit in microseconds.
MICROS = C.SAME_MOMENT_S * 1_000_000


def gate_keys(thin: DataFrame, sensitivity: str) -> tuple[DataFrame, DataFrame]:
    """(left, right): rows of stills under KEYS that every pair past the gates shares, left and right.

    thin: (asset_id, dhash, mean_luma, aspect). Keys are
    - half ranges of the luma: the right row is in the range of the left one or
      in one of the two above it;
    - ranges of the logarithm of the aspect, as wide as the tolerance, and the
      ones beside: in one range of the luma, the one above only;
    - where at most PARTS - 1 bits may differ, the hash in PARTS parts: one of
      them has to be equal, and the first that is counts. With more bits than
      that, parts would be too short to tell anything, and the numbers of set
      bits, which may differ as much, too.
    No pair is lost; a row has a few copies, whatever the number of rows. Pairs
    meet in one order only but for those of equal ranges, of which both rows are
    own to the key. Further columns of thin ride along.
    """
    t = C.LEVELS[sensitivity]
    half = F.floor(F.col("mean_luma") * (2 / (C.LUMA_TOLERANCE + 1e-4))).cast("int")
    wide = F.floor(F.log("aspect") / (-math.log(1 - t.aspect_tolerance) + 1e-9)).cast("int")
    at = _cuts()
    piece = lambda k: F.shiftrightunsigned("dhash", at[k]).bitwiseAND((1 << at[k + 1] - at[k]) - 1).cast("int")
    pieces = F.array(*(F.struct(F.lit(k).alias("part"), piece(k).alias("bits")) for k in range(PARTS)))
    whole = F.array(F.struct(F.lit(0).alias("part"), F.lit(0).alias("bits")))

    def under(cells: list[tuple[int, int]]) -> DataFrame:
        at = (F.struct((half - k).alias("luma_key"), (wide + m).alias("aspect_key"), F.lit((k, m) == (0, 0)).alias("own")) for k, m in cells)
        keyed = thin.select("*", F.explode(F.array(*at)).alias("cell"))
        keyed = keyed.select("*", F.explode(pieces if _parted(sensitivity) else whole).alias("p"))
        return keyed.select(*thin.columns, "cell.luma_key", "cell.aspect_key", "cell.own", "p.part", "p.bits")

    return under([(0, 0)]), under([(0, 0), (0, -1), *((k, m) for k in (1, 2) for m in (-1, 0, 1))])


def _cuts() -> list[int]:
    return [k * 64 // PARTS for k in range(PARTS + 1)]


def _parted(sensitivity: str) -> bool:
    return C.LEVELS[sensitivity].hash_reject < PARTS


def met(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], solve: Callable[[dict, dict], Callable[[dict], Iterator[pa.RecordBatch]]], schema: str, least: int | None = None) -> DataFrame:
    """What solve(key, left rows) says of right rows of the key, fields as arrays.

    Both sides of a key with many rows are dealt in blocks, so no task holds a
    key: it holds BLOCK left rows at most, fewer (not below least) where the
    session's tasks would have too little to share, and reads right ones past them. right.own:
    rows that are on the left as well; of these, a pair meets in one order, or,
    in one block, in both. Of the right rows, free says which meet in one.
    """
    spark = left.sparkSession
    ship_package(spark)
    count = lambda t, n: t.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    # the keys of both sides, and how many rows either has: as few rows as there are keys
    sizes = written(count(left, "nl").join(count(right, "nr"), keys), "keys", rows=1)
    block = min(BLOCK, max(least or LEAST, (sizes.agg(F.sum("nl")).first()[0] or 0) // partitions(spark)))
    of = lambda n, rows: F.ceil(F.col(n) / rows).cast("int")
    sizes = sizes.select(*keys, of("nl", block).alias("ls"), of("nr", ACROSS * block).alias("rs"))
    tiles = sizes.where("ls * rs > 1").agg(F.sum(F.col("ls") * F.col("rs"))).first()[0] or 0
    own = F.col("own") if "own" in right.columns else F.lit(False)
    place = lambda n: F.pmod(F.xxhash64("asset_id"), n).cast("int")
    to = lambda n: F.explode(F.sequence(F.lit(0), n))
    a, b = left.join(sizes, keys), right.join(sizes, keys)
    a = a.select(*keys, place("ls").alias("l"), to(F.col("rs") - 1).alias("r"), F.lit(True).alias("left"), F.lit(True).alias("free"), *fields)
    b = b.select("*", to(F.when(own, place("ls")).otherwise(F.col("ls") - 1)).alias("l"))
    b = b.select(*keys, "l", place("rs").alias("r"), F.lit(False).alias("left"), (~own | (place("ls") > F.col("l"))).alias("free"), *fields)
    key = [*keys, "l", "r"]

    def array(c: pa.Array) -> np.ndarray:
        if not pa.types.is_list(c.type):
            return c.to_numpy(zero_copy_only=False)
        if not c.null_count:
            return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        some, flat = c.is_valid().to_numpy(zero_copy_only=False), c.flatten().to_numpy(zero_copy_only=False)
        out = np.full((len(c), len(flat) // max(1, int(some.sum()))), np.nan, np.float32)
        if some.any():
            out[some] = flat.reshape(int(some.sum()), -1)
        return out

    def joined(parts: tuple[np.ndarray, ...]) -> np.ndarray:
        if parts[0].ndim == 1:
            return np.concatenate(parts)
        wide = max(p.shape[1] for p in parts)  # parts of nulls only have no width
        return np.concatenate([p if p.shape[1] == wide else np.full((len(p), wide), np.nan, np.float32) for p in parts])

    def rows(held: list[list[np.ndarray]]) -> dict[str, np.ndarray]:
        return dict(zip(["free", *fields], map(joined, zip(*held, strict=True)), strict=True))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lefts, rights, against = None, [], [], None

        def told() -> Iterator[pa.RecordBatch]:
            nonlocal against
            if rights:
                if against is None:
                    against = solve(dict(zip(keys, now, strict=False)), rows(lefts))
                    lefts.clear()
                some = rows(rights)
                rights.clear()
                yield from against(some)

        for x in batches:
            if not x.num_rows:
                continue
            columns = [array(c) for c in x.columns]
            edge = np.zeros(x.num_rows, bool)
            for c in columns[: len(key) + 1]:
                edge[1:] |= c[1:] != c[:-1]
            heads = [0, *np.flatnonzero(edge).tolist()]
            for low, high in zip(heads, [*heads[1:], x.num_rows], strict=True):
                at = [int(c[low]) for c in columns[: len(key)]]
                if now != at:
                    yield from told()
                    now, against = at, None
                    lefts.clear()
                some = [c[low:high] for c in columns[len(key) + 1 :]]
                if columns[len(key)][low]:
                    lefts.append(some)
                elif lefts or against is not None:
                    rights.append(some)
                    if sum(len(c[0]) for c in rights) >= READ:
                        yield from told()
        yield from told()

    dealt = a.union(b).repartition(max(partitions(spark), min(tiles, 10_000)), *key)
    return dealt.sortWithinPartitions(*key, F.desc("left")).mapInArrow(work, schema)


def counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The histograms a and b without the bins that are empty in one of them, in single precision where that is exact."""
    used = np.flatnonzero(a.any(0) & b.any(0))
    kind = np.float32 if max(x.sum(1, dtype=np.int64).max(initial=0) for x in (a, b)) < 1 << 24 else np.float64
    return tuple(np.ascontiguousarray(x[:, used], kind) for x in (a, b))


def common_counts(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many pixels the histograms a[i] and b[j] (counted) have in common."""
    out, one, step = np.empty(len(i), np.int64), np.ones(a.shape[1], a.dtype), 1 << 12
    of, to = (np.empty((min(step, len(i)), a.shape[1]), a.dtype) for _ in range(2))
    for low in range(0, len(i), step):
        s = slice(low, low + step)
        n = len(i[s])
        np.take(a, i[s], 0, out=of[:n], mode="clip")  # by any other mode take makes a copy
        np.take(b, j[s], 0, out=to[:n], mode="clip")
        out[s] = np.minimum(of[:n], to[:n], out=of[:n]) @ one
    return out


def _dots(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the integer rows a[i] and b[j]: exact, as sums below 2 ** 53 are."""
    out = np.empty(len(i))
    for low in range(0, len(i), DOTS):
        s = slice(low, low + DOTS)
        out[s] = np.einsum("ij,ij->i", a[i[s]].astype(np.float64), b[j[s]].astype(np.float64))
    return out


def _batches(pairs: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """pairs as batches of BATCH rows and more."""
    held, n = [], 0
    for columns in pairs:
        held.append(columns)
        n += len(columns[0])
        if n >= BATCH:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)
            held, n = [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*held, strict=True)], names=names)


def _worth(distance: np.ndarray, similarity: np.ndarray, bound: np.ndarray, t: C.Thresholds) -> np.ndarray:
    """Whether verify.routes or the grey zone can confirm a pair; some that they do not are let through."""
    rules = (
        (distance <= t.hash_accept) & (similarity >= t.histogram_accept)
        | (distance <= t.colour_led_hash) & (similarity >= t.strong_histogram)
        | (distance <= C.SCREENSHOT_HASH) & (similarity >= C.SCREENSHOT_HISTOGRAM)
        | (distance == 0) & (similarity >= C.DEGENERATE_HISTOGRAM)
    )
    return rules | (bound >= t.shape_accept - SINGLE)


def near_hashes(hashes: np.ndarray, others: np.ndarray, most: int, apart: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, first of the others, rows and others counted from these, bits in which they differ) of a tile: pairs that differ in few bits.

    The tile's arrays are made once: with new ones for each tile most of the time goes into their pages. apart: tiles without pairs.
    """
    wide = min(TILE[1], len(others))
    xor, bits, near = (np.empty((min(TILE[0], len(hashes)), wide), kind) for kind in (np.uint64, np.uint8, bool))
    for low in range(0, len(hashes), TILE[0]):
        for low_ in range(0, len(others), TILE[1]):
            if apart is not None and apart[low // TILE[0], low_ // TILE[1]]:
                continue
            a, b = hashes[low : low + TILE[0]], others[low_ : low_ + TILE[1]]
            x, n, fine = (c[: len(a), : len(b)] for c in (xor, bits, near))
            np.bitwise_xor(a[:, None], b[None], out=x)
            np.less_equal(np.bitwise_count(x, out=n), most, out=fine)
            found = np.flatnonzero(fine)
            if len(found):
                i = found // len(b)  # by one number: several times as fast as divmod
                yield low, low_, i, found - i * len(b), x.take(found)


def _those(fine: np.ndarray, *columns: np.ndarray) -> Iterable[np.ndarray]:
    """Columns where fine holds: by places, as masks are slow where most do."""
    at = np.flatnonzero(fine)
    return columns if len(at) == len(fine) else (c.take(at) for c in columns)


def _spans(c: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest of each so many rows."""
    heads = np.arange(0, len(c), rows)
    return np.minimum.reduceat(c, heads), np.maximum.reduceat(c, heads)


def _gated(key: dict, left: dict, sensitivity: str) -> Callable[[dict], Iterator[tuple[np.ndarray, ...]]]:
    """Of some right rows of the key, columns of the pairs past the gates: PAIR, the similarity where histograms ride along, GREY where shapes do."""
    t, anytime, at = C.LEVELS[sensitivity], C.ANYTIME[sensitivity], _cuts()

    def sorted_(rows: dict, *by: str) -> dict:
        """rows in an order in which those of a tile are alike; shapes stay where they are."""
        order = np.lexsort([rows[c] for c in by])
        out = {k: c if k == "shape" else c[order] for k, c in rows.items()} | {"order": order}
        return out | ({"pixels": out["histogram"].sum(1, dtype=np.int64)} if "histogram" in out else {})

    left = sorted_(left, "mean_luma", "aspect")
    ids, luma, aspect = (left[c] for c in GATES if c != "dhash")
    hashes = left["dhash"].view(np.uint64)

    def against(right: dict) -> Iterator[tuple[np.ndarray, ...]]:
        right = sorted_(right, "mean_luma", "aspect", "free")
        ids_, luma_, aspect_ = (right[c] for c in GATES if c != "dhash")
        hashes_ = right["dhash"].view(np.uint64)
        if "histogram" in left:
            hist, hist_ = counted(left["histogram"], right["histogram"])
            pixels = np.unique(np.r_[left["pixels"], right["pixels"]])
        # by tiles: whether luma or aspect tell all pairs apart, and whether they tell any
        (low_l, high_l), (low_r, high_r) = _spans(luma, TILE[0]), _spans(luma_, TILE[1])
        gap, reach = np.maximum(low_l[:, None] - high_r, low_r - high_l[:, None]), np.maximum(high_l[:, None] - low_r, high_r - low_l[:, None])
        (low_a, high_a), (low_b, high_b) = _spans(aspect, TILE[0]), _spans(aspect_, TILE[1])
        one = (low_a[:, None] == high_b) & (high_a[:, None] == low_b)
        free = _spans(right["free"], TILE[1])[0]
        for low, low_, i, j, other in near_hashes(hashes, hashes_, t.hash_reject, gap > C.LUMA_TOLERANCE):
            m, m_ = low // TILE[0], low_ // TILE[1]
            i, j = i + low, j + low_
            fine = []
            if not free[m_]:
                fine.append(right["free"].take(j) | (ids.take(i) < ids_.take(j)))
            if not reach[m, m_] <= C.LUMA_TOLERANCE:
                fine.append(np.abs(luma.take(i) - luma_.take(j)) <= C.LUMA_TOLERANCE)
            if not one[m, m_]:
                fine.append(np.abs((x := aspect.take(i)) - (y := aspect_.take(j))) / np.maximum(x, y) <= t.aspect_tolerance)
            if _parted(sensitivity):
                fine += [(other >> np.uint64(at[k])) & np.uint64((1 << at[k + 1] - at[k]) - 1) != 0 for k in range(key["part"])]
            distance = np.bitwise_count(other)
            if "moment" in left and "shape" not in left:
                # beyond this distance only pairs of one moment have a route, which looks again: with nulls these are floats
                fine.append((distance <= anytime.hash_reject) | (np.abs(left["moment"][i] - right["moment"][j]) <= MICROS + 64))
            if fine:
                i, j, distance = _those(np.logical_and.reduce(fine), i, j, distance)
            more = []
            if "histogram" in left:
                common = common_counts(hist, hist_, i, j)
                of = max(1, pixels[0]) if len(pixels) == 1 else np.where(ids[i] < ids_[j], left["pixels"][i], right["pixels"][j]).clip(1)
                similarity = common / of
                fine = similarity >= t.histogram_floor
                if "shape" in left:
                    together = np.zeros(len(i), bool)
                    if "moment" in left:
                        together = left["dated"][i] & right["dated"][j] & (np.abs(left["moment"][i] - right["moment"][j]) <= MICROS)
                    shots = (left["kind"][i] == C.SCREENSHOT) & (right["kind"][j] == C.SCREENSHOT)
                    fine &= ~accepted(distance, similarity, shots, anytime)
                    fine &= np.where(together, ~accepted(distance, similarity, shots, t), distance <= anytime.hash_reject)
                    more = [together]
                elif "code" in left:
                    a, b = left["code"][i], right["code"][j]
                    # sides without any code have none of its width
                    bound = np.einsum("ij,ij->i", a, b) if a.shape[1] == b.shape[1] else np.full(len(i), np.nan)
                    fine &= _worth(distance, similarity, bound, t)
                more = [similarity, *more]
                i, j, distance, *more = _those(fine, i, j, distance, *more)
            if "shape" in left:
                norms = left["shape_norm"][i].astype(np.float64) * right["shape_norm"][j].astype(np.float64)
                more.append(_dots(left["shape"], right["shape"], left["order"][i], right["order"][j]) / np.sqrt(norms))
            if len(i):
                one_id, other_id = ids.take(i), ids_.take(j)
                yield np.minimum(one_id, other_id), np.maximum(one_id, other_id), distance.astype(np.int32), *more

    return against


def gated_pairs(thin: DataFrame, sensitivity: str) -> DataFrame:
    """PAIR rows of all pairs of stills (GATES) past the gates; with thin.histogram also histogram_similarity, past its floor.

    Rows meet under gate_keys; in a task, hashes are compared as two vectors of
    words, and histograms where these are near. thin.moment (microseconds): pairs
    that no route takes are left out. thin.code (a short code of the shape, or
    null): as are those that nothing can confirm. thin.shape, with shape_norm and
    kind: all but those of the grey zone are, which get GREY; there moment has no
    nulls, and dated says where there is one.
    """
    left, right = gate_keys(thin, sensitivity)
    schema = PAIR + (", histogram_similarity double" if "histogram" in thin.columns else "") + (GREY if "shape" in thin.columns else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def solve(key: dict, rows: dict) -> Callable[[dict], Iterator[pa.RecordBatch]]:
        against = _gated(key, rows, sensitivity)
        return lambda others: _batches(against(others), names)

    # shapes are wide: no more of them travel than has to
    return met(left, right, KEYS, thin.columns, solve, schema, BLOCK if "shape" in thin.columns else None)


def _micros() -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("creation_ts").cast("timestamp_ntz"))


def still_candidates(library: DataFrame, sensitivity: str, routed: bool = False, codes: DataFrame | None = None) -> DataFrame:
    """(id_lo, id_hi, hash_distance, histogram_similarity) of all pairs of stills past the gates.

    Where few hashes are near, histograms are fetched for the pairs that are
    left; elsewhere these would be many times the stills, and each still takes
    its histogram to the tasks that compare its hash. routed: pairs that
    verify.routes drops can be left out. codes (asset_id, code): so can pairs that
    nothing confirms (operators/codes.py).
    """
    t = C.LEVELS[sensitivity]
    stills = library.where(F.col("kind") != C.VIDEO)
    # a still without a hash or luma is near none
    gates = ["asset_id", "dhash", "mean_luma", aspect_ratio().alias("aspect")]
    if _parted(sensitivity):
        pairs = gated_pairs(stills.select(*gates).dropna(), sensitivity)
        return with_similarity(pairs, stills).where(F.col("histogram_similarity") >= t.histogram_floor)
    known = stills.where("histogram is not null")
    if routed:
        # without a date: null, which is near nothing (ids of files are too large to be told apart by a product)
        known = known.withColumn("moment", _micros())
    if codes is not None:
        known = known.join(codes, "asset_id", "left")
    extra = [c for c, use in (("moment", routed), ("code", codes is not None)) if use]
    thin = known.select(*gates, "histogram", *extra).dropna(subset=["asset_id", "dhash", "mean_luma", "aspect"])
    return gated_pairs(thin, sensitivity)


def grey_zone(library: DataFrame, sensitivity: str) -> DataFrame:
    """(id_lo, id_hi, score, accept) of all pairs of stills in the grey zone (verify.routes), with exact cosines.

    Where few hashes are near, shapes are fetched for the pairs that are left;
    elsewhere these are many times the stills. There each still takes its
    histogram and its shape to the tasks that compare its hash, which leave no
    other pairs: neither these nor shapes travel again.
    """
    t, anytime = C.LEVELS[sensitivity], C.ANYTIME[sensitivity]
    if _parted(sensitivity):
        routed = verify.routes(still_candidates(library, sensitivity), library, sensitivity)
        return verify.grey_scores(routed, library).select("id_lo", "id_hi", "score", "accept")
    # of blank stills, and those without a shape, no pair is in the zone
    known = library.where((F.col("kind") != C.VIDEO) & (F.size("keyframes") == 0) & (F.col("shape_norm") > 0) & ~degenerate(F.col("mean_luma")))
    known = known.where("histogram is not null and shape is not null")
    fields = ["asset_id", "dhash", "mean_luma", aspect_ratio().alias("aspect"), "histogram", "kind", "shape", "shape_norm"]
    if sensitivity == "similar":  # no other asks for moments
        fields += [F.coalesce(_micros(), F.lit(0)).alias("moment"), F.col("creation_ts").isNotNull().alias("dated")]
    found = gated_pairs(known.select(*fields).dropna(subset=GATES), sensitivity)
    s = F.col("histogram_similarity")
    return found.select("id_lo", "id_hi", "score", F.when(F.col("together"), shape_required(s, t)).otherwise(shape_required(s, anytime)).alias("accept"))


#: Sets of bins: those whose number has an odd count of bits in common with the mask.
MASKS = (1, 8, 9)


def _alike(left: dict, right: dict, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    hist, hist_ = counted(left["histogram"], right["histogram"])
    for low in range(0, len(left["asset_id"]), TILE[0]):
        for low_ in range(0, len(right["asset_id"]), TILE[1]):
            s, s_ = slice(low, low + TILE[0]), slice(low_, low_ + TILE[1])
            near = left["asset_id"][s, None] < right["asset_id"][None, s_]
            near &= np.abs(left["mean_luma"][s, None] - right["mean_luma"][None, s_]) <= C.LUMA_TOLERANCE
            i, j = np.nonzero(near)
            i, j = i + low, j + low_
            n = common_counts(hist, hist_, i, j)
            fine = n >= least
            if fine.any():
                yield left["asset_id"][i[fine]], right["asset_id"][j[fine]], n[fine]


def colour_pairs(library: DataFrame, pixels: int, floor: float) -> DataFrame:
    """(id_lo, id_hi, common) of all pairs within the luma tolerance whose histograms, of so many pixels each, share floor of them.

    They differ in few pixels, so the counts of any set of bins differ by as few:
    rows meet under three such counts, in ranges a little wider than that and the
    ones beside. No pair is lost, and no task holds a key (met).
    """
    least = math.ceil(floor * pixels - 1e-9)
    apart = pixels - least + 1
    cells = []
    for m in MASKS:
        bins = [F.get("histogram", F.lit(k)) for k in range(64) if (k & m).bit_count() % 2]
        cells.append(F.floor(sum(bins[1:], bins[0]) / apart).cast("int"))
    names = [f"cell_{m}" for m in MASKS]
    thin = library.select("asset_id", "mean_luma", "histogram", *(c.alias(n) for c, n in zip(cells, names, strict=True))).dropna()
    beside = thin
    for n in names:
        beside = beside.withColumn(n, F.explode(F.array(*(F.col(n) + k for k in (-1, 0, 1)))))
    said = ["id_lo", "id_hi", "common"]
    solve = lambda k, a: lambda b: _batches(_alike(a, b, least), said)
    return met(thin, beside, names, ["asset_id", "mean_luma", "histogram"], solve, "id_lo long, id_hi long, common long")


def moment_pairs(catalogue: DataFrame) -> DataFrame:
    """(id_lo, id_hi) of all pairs of assets created within SAME_MOMENT_S of each other.

    Windows of that length make the band a hash join; an asset meets those of its
    own window and of the two beside it.
    """
    window = F.floor(F.unix_micros(F.col("creation_ts").cast("timestamp")) / (C.SAME_MOMENT_S * 1_000_000)).cast("long")
    t = catalogue.where("creation_ts is not null").select("asset_id", "creation_ts", window.alias("window"))
    p = banded_pairs(t, t, F.col("window"), (F.col("a.asset_id") < F.col("b.asset_id")) & same_moment("a.creation_ts", "b.creation_ts"))
    return p.select(F.col("a.asset_id").alias("id_lo"), F.col("b.asset_id").alias("id_hi"))


def durations_match(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return (d <= C.DURATION_S) | (d / F.greatest(a, b, F.lit(0.001)) <= C.DURATION_SHARE)


def video_candidates(library: DataFrame, sensitivity: str) -> DataFrame:
    """As still_candidates, for clips in the same or adjacent whole seconds of duration whose keyframes agree."""
    t = C.LEVELS[sensitivity]
    clips = library.where(F.col("kind") == C.VIDEO)
    thin = clips.select("asset_id", "duration", "keyframes")
    mean = keyframe_distance(F.col("a.keyframes"), F.col("b.keyframes"))
    close = (F.col("a.asset_id") < F.col("b.asset_id")) & durations_match(F.col("a.duration"), F.col("b.duration"))
    pairs = banded_pairs(thin, thin, F.col("duration").cast("long"), close & (mean <= t.video_hash_accept))
    pairs = pairs.select(
        F.col("a.asset_id").alias("id_lo"), F.col("b.asset_id").alias("id_hi"), F.round(mean).cast("int").alias("hash_distance")
    )
    return with_similarity(pairs, clips)


def candidates(library: DataFrame, sensitivity: str, codes: DataFrame | None = None) -> DataFrame:
    """Pairs of stills and of clips for verify.routes, without those that it drops; codes: without those that nothing confirms."""
    return still_candidates(library, sensitivity, True, codes).unionByName(video_candidates(library, sensitivity))
