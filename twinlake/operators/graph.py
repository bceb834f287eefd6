"""Connected components and star clusters over edge tables that are too large for one machine."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from twinlake.session import partitions, ship_package, written

#: A node with fewer edges is never a hub.
HUB = 1024
#: Edges of a component, or of a range of nodes, that one task solves.
EDGES = 1 << 19


def hub_limit(rows: int, width: int) -> int:
    """Edges from which a node counts as a hub: at most 4 * width nodes of a table of so many rows do."""
    return max(HUB, -(-rows // (4 * width)))


def with_least(edges: DataFrame, least: DataFrame, limit: int) -> DataFrame:
    """(a, b, m): edges (a, b) with m of their node a, from least (a, m, n), n being how many edges a has.

    The edges of hubs never meet in one task: hubs are fewer than rows / limit,
    so their rows of `least` go to every task. The other nodes' edges are joined
    by a shuffle in which no key has more than limit rows. Where least is a
    grouping of edges, both parts read one shuffle of it.
    """
    hubs = F.broadcast(least.where(F.col("n") > limit).select("a", "m"))
    marked = edges.join(hubs, "a", "left")
    rest = marked.where("m is null").select("a", "b").join(least.where(F.col("n") <= limit).select("a", "m"), "a")
    return marked.where("m is not null").select("a", "b", "m").union(rest.select("a", "b", "m"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (src, dst); component is the least node reached.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each node
    is hung from the least node of its neighbourhood until nothing moves. The
    number of rounds grows with the logarithm of the component size. Every step
    is a grouped minimum, which is worked out before rows move, and a join in
    which the edges of a hub stay where they are (with_least); tables are written
    to the shared folder. So no task holds a component or a star. Null ends and
    self loops link nothing; repeated edges count once; an empty table gives an
    empty table.
    """
    width = partitions(edges.sparkSession)
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    nodes = e.select(F.col("a").alias("node")).union(e.select("b"))
    links = e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = written(links, "links"), None
    n = links.count()
    for _ in range(max_rounds if n else 0):
        # large star: every larger neighbour goes to the least neighbour
        both = links.union(links.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        least = least.select("a", F.least("a", "m").alias("m"), "n")
        large = with_least(both.where("b > a"), least, hub_limit(2 * n, width))
        large = written(large.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "links-large")
        # small star: every smaller neighbour, and the node, go to the least
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, least, hub_limit(n, width)).select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = written(small.where("a <> b").union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        # exact 128-bit sums tell when a round changed nothing
        now = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.hash("b", "a").cast("long"))
        ).first()
        if now == before:
            break
        before, n = now, now[0]
    else:
        if n:
            raise RuntimeError("components did not settle")
    found = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = nodes.distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
    return found.union(roots)


def _grouped(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, start, neighbour, order): the edges of each node, surest first, neighbours of equal weight by id."""
    order = np.lexsort((dst, -weight, src))
    s = src[order]
    head = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[head], np.r_[head, len(s)], dst[order], order


def solve_stars(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, cap: int, bars: dict[int, tuple[int, int]] | None = None) -> list[tuple[int, int, int]]:
    """Greedy stars (cluster, node, position) over edges given from both ends, as far as they are certain.

    A queue by degree gives the anchors: a node whose degree fell since it was
    queued goes back with what it has left, so the work is that of the edges
    times a logarithm. bars: for the nodes that may anchor, the key (degree, -id)
    that they have to exceed; other nodes belong to other tasks, have only their
    edges to nodes of this one, and can be taken but do not anchor. A node that does not exceed its bar holds back all within
    two steps of it. None: all nodes are here.
    """
    nodes, start, near, _ = _grouped(src, dst, weight)
    place = {int(v): k for k, v in enumerate(nodes.tolist())}
    start, near = start.tolist(), near.tolist()
    degree = [b - a for a, b in zip(start, start[1:])]
    out: list[tuple[int, int, int]] = []
    taken: set[int] = set()
    held: set[int] = set()
    if bars is None and len(nodes) == 2:
        a, b = nodes.tolist()
        return [(a, a, 0), (a, b, 1)]
    queue = [(-d, v) for v, d in zip(nodes.tolist(), degree) if bars is None or v in bars]
    heapq.heapify(queue)
    while queue:
        d, v = heapq.heappop(queue)
        k = place[v]
        if v in taken or degree[k] == 0:
            continue
        if -d != degree[k]:
            heapq.heappush(queue, (-degree[k], v))
            continue
        around = near[start[k] : start[k + 1]]
        if bars is not None and (v in held or (degree[k], -v) <= bars[v]):
            # what is within two steps of it comes later in the order, and has to wait for it
            held.add(v)
            for y in around:
                if y not in taken:
                    j = place[y]
                    held.update(near[start[j] : start[j + 1]])
            held.update(around)
            continue
        members = [v]
        for y in around:
            if y not in taken:
                members.append(y)
                if len(members) == cap:
                    break
        out += [(v, m, p) for p, m in enumerate(members)]
        taken.update(members)
        for m in members:
            j = place[m]
            for x in near[start[j] : start[j + 1]]:
                degree[place[x]] -= 1
    return out


def solve_twins(twin: np.ndarray, node: np.ndarray, a: np.ndarray, b: np.ndarray, weight: np.ndarray, cap: int) -> list[tuple[int, int, int]]:
    """As solve_stars for all of a component, whose nodes are given by classes of twins (twin, node), and edges by pairs of classes from both ends.

    Nodes of a class have the same degree until they are taken, and are taken in
    order of id whoever takes them: of a class, what is left and its least id tell all.
    """
    order = np.lexsort((node, twin))
    names, head = np.unique(twin[order], return_index=True)
    ids = [x.tolist() for x in np.split(node[order], head[1:])]
    order = np.lexsort((b, -weight, a))
    start = np.searchsorted(a[order], np.r_[names, names[-1] + 1]).tolist()
    near, sure = np.searchsorted(names, b[order]).tolist(), weight[order].tolist()
    gone, degree = [0] * len(ids), []
    for k in range(len(ids)):
        around = near[start[k] : start[k + 1]]
        degree.append(sum(len(ids[j]) for j in around) - (k in around))
    out: list[tuple[int, int, int]] = []
    queue = [(-d, x[0], k) for k, (d, x) in enumerate(zip(degree, ids, strict=True))]
    heapq.heapify(queue)
    while queue:
        d, v, k = heapq.heappop(queue)
        if gone[k] == len(ids[k]) or degree[k] == 0:
            continue
        if (-d, v) != (degree[k], ids[k][gone[k]]):
            heapq.heappush(queue, (-degree[k], ids[k][gone[k]], k))
            continue
        taken = {k: 1}
        gone[k] += 1
        members, low, high = [v], start[k], start[k + 1]
        while low < high and len(members) < cap:
            # classes that are equally sure give their nodes in one order of id
            end = low + 1
            while end < high and sure[end] == sure[low]:
                end += 1
            free = cap - len(members)
            some = heapq.merge(*([(y, j) for y in ids[j][gone[j] : gone[j] + free]] for j in near[low:end]))
            for y, j in islice(some, free):
                members.append(y)
                gone[j] += 1
                taken[j] = taken.get(j, 0) + 1
            low = end
        out += [(v, m, p) for p, m in enumerate(members)]
        for j, n in taken.items():
            for x in near[start[j] : start[j + 1]]:
                degree[x] -= n
        if gone[k] < len(ids[k]):
            heapq.heappush(queue, (-degree[k], ids[k][gone[k]], k))
    return out


STAR = "cluster long, node long, position int"


def _frame(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    cluster, node, position = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(cluster, pa.int64()), pa.array(node, pa.int64()), pa.array(position, pa.int32())], names=["cluster", "node", "position"])


def _in_tasks(edges: DataFrame, key: str, cap: int) -> DataFrame:
    """Stars of components (key) that each fit in a task."""
    ship_package(edges.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = []
        here = None
        for b in batches:
            of = b.column(0).to_numpy()
            rows = [b.column(k).to_numpy() for k in (1, 2, 3)]
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist() if len(of) else []
            for low, high in zip(heads, [*heads[1:], len(of)], strict=True):
                if parts and of[low] != here:
                    yield _frame(solve_stars(*(np.concatenate(c) for c in zip(*parts, strict=True)), cap))
                    parts = []
                here = of[low]
                parts.append([r[low:high] for r in rows])
        if parts:
            yield _frame(solve_stars(*(np.concatenate(c) for c in zip(*parts, strict=True)), cap))

    return edges.select(key, "src", "dst", "c").repartition(partitions(edges.sparkSession), key).sortWithinPartitions(key).mapInArrow(work, STAR)


def _by_twins(large: DataFrame, cap: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(component, STAR rows) of components of large (component, src, dst, c) that twins make small: the components, and their stars.

    Twins are nodes with an edge between them and the same neighbours, all of equal
    confidence; a million edges among a thousand black pictures are one class. Such
    classes are found by a hash of the neighbours and then counted: a component is
    solved by its classes only where every two of them are linked wholly and by one
    confidence, and where its nodes and pairs of classes are at most `most`.
    """
    spark = large.sparkSession
    ship_package(spark)
    each = large.groupBy("component", "src", "c").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("dst", "c")).alias("x"))
    each = each.groupBy("component", "src").agg(F.max_by("c", F.struct("n", "c")).alias("w"), F.bit_xor("x").alias("x"))
    # the node itself counts among its neighbours, as far from itself as its twins
    each = each.select("component", F.col("src").alias("node"), F.col("x").bitwiseXOR(F.xxhash64("src", "w")).alias("x"))
    classes = each.groupBy("component", "x").agg(F.min("node").alias("twin"), F.count(F.lit(1)).alias("size"))
    nodes = written(each.join(classes, ["component", "x"]).select("component", "node", "twin", "size"), "star-twins")
    first = F.col("node") == F.col("twin")
    sums = nodes.groupBy("component").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(first).alias("classes"), F.count_if(first & (F.col("size") > 1)).alias("shared")
    )
    sums = written(sums.where(2 * F.col("classes") <= F.col("nodes")), "star-twin-sums")
    side = lambda end, k: nodes.select("component", F.col("node").alias(end), F.col("twin").alias(k), F.col("size").alias(f"size_{k}"))
    pairs = large.join(sums.select("component"), "component", "left_semi").join(side("src", "a"), ["component", "src"]).join(side("dst", "b"), ["component", "dst"])
    pairs = pairs.groupBy("component", "a", "b", "size_a", "size_b").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c"), F.max("c").alias("most"))
    same = F.col("a") == F.col("b")
    whole = (F.col("n") == F.col("size_a") * (F.col("size_b") - same.cast("int"))) & (F.col("c") == F.col("most")) & ~F.isnan("c")
    pairs = written(pairs.select("component", "a", "b", "c", F.coalesce(whole, F.lit(False)).alias("whole"), same.alias("same")), "star-twin-pairs")
    judged = pairs.groupBy("component").agg(F.count(F.lit(1)).alias("pairs"), F.bool_and("whole").alias("whole"), F.count_if("same").alias("own"))
    fit = judged.join(sums, "component").where(F.col("whole") & (F.col("own") == F.col("shared")) & (F.col("pairs") + F.col("nodes") <= most))
    fit = written(fit.select("component"), "star-fit")
    rows = nodes.select("component", F.lit(True).alias("is_node"), F.col("twin").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("c"))
    rows = rows.union(pairs.select("component", F.lit(False), "a", "b", "c")).join(fit, "component", "left_semi")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(held: list[list[np.ndarray]]) -> pa.RecordBatch:
            is_node, a, b, c = (np.concatenate(x) for x in zip(*held, strict=True))
            return _frame(solve_twins(a[is_node], b[is_node], a[~is_node], b[~is_node], c[~is_node], cap))

        held, here = [], None
        for x in batches:
            of, *columns = (x.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist() if len(of) else []
            for low, high in zip(heads, [*heads[1:], len(of)], strict=True):
                if held and of[low] != here:
                    yield one(held)
                    held = []
                here = of[low]
                held.append([c[low:high] for c in columns])
        if held:
            yield one(held)

    dealt = rows.select("component", "is_node", "a", "b", "c").repartition(partitions(spark), "component").sortWithinPartitions("component")
    return fit, dealt.mapInArrow(work, STAR)


def _in_ranges(left: DataFrame, cap: int, rows: int, edges: int) -> DataFrame:
    """Certain stars of ranges of nodes, each range in one task, from left (src, dst, c).

    Each task has all edges of its nodes, but for hubs, which are nobody's here.
    What lies in other ranges counts with the rank it had at the start; ranks only
    fall, so a node that exceeds all of them within two steps does so whatever
    the other tasks do, and no two tasks take the same node: each of their
    anchors would have to outrank the other.
    """
    rank = left.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    rank = written(rank.select("src", "d", F.struct("d", (-F.col("src")).alias("m")).alias("key")), "star-ranks")
    limit = max(HUB, edges // 8)
    small = rank.where(F.col("d") <= limit).select("src")
    near = left.join(rank.select(F.col("src").alias("dst"), F.col("key").alias("other")), "dst")
    # the two highest ranks around each node: the highest that is not one's own
    two = near.groupBy("src").agg(F.max("other").alias("first"))
    second = near.join(two, "src").where(F.col("other") < F.col("first")).groupBy("src").agg(F.max("other").alias("second"))
    around = two.join(second, "src", "left").join(rank.select("src", "key"), "src")
    around = written(around.select(F.col("src").alias("dst"), "key", "first", "second"), "star-around")
    flat = left.join(around, "dst").join(small, "src", "left_semi")
    fields = [(k, f) for k in ("key", "first", "second") for f in ("d", "m")]
    flat = flat.select("src", "dst", "c", *(F.coalesce(F.col(f"{k}.{f}"), F.lit(0)).alias(f"{k}_{f}") for k, f in fields))
    width = max(1, -(-rows // edges))
    ship_package(left.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return
        t = pa.Table.from_batches(some)
        src, dst, c = (t[k].to_numpy() for k in ("src", "dst", "c"))
        own = np.unique(src)
        outside = ~np.isin(dst, own)
        far, to = src[outside].tolist(), dst[outside].tolist()
        keys = [list(zip(*(t[f"{k}_{f}"].to_numpy()[outside].tolist() for f in ("d", "m")), strict=True)) for k in ("key", "first", "second")]
        # the best elsewhere that is one step away, by a neighbour that is here or behind one that is not
        step = dict.fromkeys(own.tolist(), (0, 0))
        bars = dict(step)
        for v, key, first, second in zip(far, *keys, strict=True):
            step[v] = max(step[v], key)
            bars[v] = max(bars[v], key, second if first[1] == -v else first)
        for v, y in zip(src[~outside].tolist(), dst[~outside].tolist(), strict=True):
            bars[v] = max(bars[v], step[y])
        yield _frame(solve_stars(np.r_[src, to].astype(np.int64), np.r_[dst, far].astype(np.int64), np.r_[c, c[outside]], cap, bars))

    dealt = flat.repartitionByRange(width, "src")
    return dealt.mapInArrow(work, STAR)


def star_clusters(edges: DataFrame, cap: int = 60, small: int = EDGES) -> DataFrame:
    """(cluster, node, position) of greedy stars over edges (src, dst, confidence).

    In each component the node with most unassigned neighbours (least id on a
    tie) anchors a cluster of itself and its surest cap - 1 neighbours (least id
    on a tie), until no unassigned node has an unassigned neighbour; a component
    of two is a cluster as it is. Nodes left alone are in no cluster. cluster is
    the anchor, position 0 the anchor and then by confidence.

    Components of up to `small` edges are solved each in one task, and so are larger
    ones that classes of twins make as small (_by_twins). Others
    take rounds over the whole table. In each, every node that outranks all
    others within two steps anchors at once, which gives the same clusters,
    because a pick changes degrees within two steps only and degrees never rise;
    then ranges of nodes go on by themselves as far as they are certain
    (_in_ranges). What falls apart into components of up to `small` edges goes
    back to the first way.
    """
    e = edges.select("src", "dst", "confidence").where("src is not null and dst is not null and src <> dst")
    both = e.union(e.select("dst", "src", "confidence")).groupBy("src", "dst").agg(F.max("confidence").cast("double").alias("c"))
    left = written(both, "star-edges")
    out = None
    while out is None or not left.isEmpty():
        parts = written(connected_components(left.select("src", "dst")), "star-parts")
        of = written(left.join(parts.withColumnRenamed("node", "src"), "src"), "star-parted")
        size = written(of.groupBy("component").agg(F.count(F.lit(1)).alias("n")), "star-sizes")
        few = of.join(size.where(F.col("n") <= 2 * small), "component", "left_semi")
        solved = written(_in_tasks(few, "component", cap), "star-solved")
        out = solved if out is None else out.union(solved)
        left = written(of.join(size.where(F.col("n") > 2 * small), "component", "left_semi"), "star-left")
        if not left.isEmpty():
            fit, stars = _by_twins(left, cap, 2 * small)
            out = out.union(written(stars, "star-twinned"))
            left = left.join(fit, "component", "left_anti")
        left = written(left.select("src", "dst", "c"), "star-left")
        for step in ("everywhere", "in ranges"):
            rows = left.count()
            if not rows:
                break
            new = written(_everywhere(left, cap) if step == "everywhere" else _in_ranges(left, cap, rows, 2 * small), "star-round")
            out = out.union(new)
            gone = new.select("node")
            left = left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
            left = written(left.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), "star-left")
    return out


def _everywhere(left: DataFrame, cap: int) -> DataFrame:
    """The stars of all nodes that outrank all others within two steps."""
    rank = left.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    rank = rank.select(F.col("src").alias("node"), F.struct("d", (-F.col("src")).alias("m")).alias("key"))
    near = left.join(rank.withColumnsRenamed({"node": "dst", "key": "other"}), "dst")
    one = near.groupBy("src").agg(F.max("other").alias("other")).join(rank.withColumnRenamed("node", "src"), "src")
    one = written(one.select(F.col("src").alias("node"), F.greatest("key", "other").alias("top"), "key"), "star-tops")
    two = left.join(one.select(F.col("node").alias("dst"), "top"), "dst").groupBy("src").agg(F.max("top").alias("top"))
    two = two.join(one.select(F.col("node").alias("src"), "key", F.col("top").alias("own")), "src")
    picks = written(two.where((F.col("key") >= F.col("top")) & (F.col("key") >= F.col("own"))).select("src"), "star-picks")
    order = Window.partitionBy("src").orderBy(F.desc("c"), "dst")
    chosen = left.join(picks, "src").withColumn("position", F.row_number().over(order)).where(F.col("position") < cap)
    anchors = picks.select(F.col("src").alias("cluster"), F.col("src").alias("node"), F.lit(0).alias("position"))
    return anchors.union(chosen.select("src", "dst", "position"))
