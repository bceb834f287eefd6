"""Near-duplicate texts by ProbMinHash signatures, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinlake.llm.batches import TOGETHER, pieces
from twinlake.llm.shingles import prob_min_hash, probability_jaccard, weighted_shingles
from twinlake.operators.graph import connected_components
from twinlake.session import free_names, partitions, ship_package, written

#: Members of an open bucket, and bytes of their texts, in a block; a block of loose members and one of all meet in a task.
TILE, TILE_BYTES = 2048, 4 << 20


def signatures(documents: DataFrame, bands: int, rows: int, words: int) -> DataFrame:
    """(doc_id, digest, size, sig): sig is bands * rows little-endian 32-bit registers; texts without words are left out."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "raw"):
            texts = b.column("raw").to_pylist()
            doc, shingle, weight = weighted_shingles(texts, words)
            sig = prob_min_hash(doc, shingle, weight, len(texts), bands * rows).astype("<u4")
            some = np.flatnonzero(np.bincount(doc, minlength=len(texts))).tolist()
            kept = b.select(["doc_id", "digest"]).take(pa.array(some, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array([len(texts[k]) for k in some], pa.int64()), pa.array([sig[k].tobytes() for k in some], pa.binary())],
                names=["doc_id", "digest", "size", "sig"],
            )

    return documents.mapInArrow(work, "doc_id long, digest binary, size long, sig binary")


def _reaches(similarity, threshold: float):
    """Whether a similarity, exact but for the rounding of its sum, is threshold or more."""
    return similarity >= threshold - 1e-9


def _bags(texts: list[bytes], words: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(shingles ascending, occurrences) of each text, made TOGETHER bytes at a time."""
    out, low, size = [], 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size > TOGETHER or k == len(texts) - 1:
            doc, shingle, weight = weighted_shingles(texts[low : k + 1], words)
            cuts = np.searchsorted(doc, np.arange(k + 2 - low))
            out += [(shingle[i:j], weight[i:j]) for i, j in zip(cuts, cuts[1:])]
            low, size = k + 1, 0
    return out


class Compared:
    """Exact probability Jaccards of one text at a time with all of a list."""

    def __init__(self, bags: list[tuple[np.ndarray, np.ndarray]], others: np.ndarray) -> None:
        sizes = np.array([len(x) for x, _ in bags])
        _, local = np.unique(np.concatenate([x for x, _ in bags]), return_inverse=True)
        self.local, self.weight = np.split(local, np.cumsum(sizes)[:-1]), [w for _, w in bags]
        self.n, self.wide = len(others), 1 + max(int(w.max()) for w in self.weight)
        self.flat = np.concatenate([self.local[k] for k in others])
        self.y = np.concatenate([self.weight[k] for k in others])
        self.owner = np.repeat(np.arange(self.n), sizes[others])
        self.total = np.array([int(self.weight[k].sum()) for k in others])
        self.mark = np.zeros(local.max() + 1, np.int64)

    def similarities(self, q: int) -> np.ndarray:
        """Of text q with each of the others.

        Common shingles with equal ratios of their occurrences x and y in the two
        texts have the same terms up to a factor x, so they are summed by ratio.
        """
        self.mark[self.local[q]] = self.weight[q]
        x = self.mark[self.flat]
        self.mark[self.local[q]] = 0
        hit = np.flatnonzero(x)
        x, y, owner = x[hit], self.y[hit], self.owner[hit]
        used, code = np.unique(x * self.wide + y, return_inverse=True) if self.wide > 1000 else _few(x * self.wide + y)
        ratio, same = np.unique((used % self.wide) / (used // self.wide), return_inverse=True)
        at = owner * len(ratio) + same[code]
        mine, theirs = (np.bincount(at, v, self.n * len(ratio)).reshape(self.n, -1) for v in (x, y))
        before = (self.weight[q].sum() - mine.sum(1))[:, None] + mine.cumsum(1)
        after = self.total[:, None] - theirs.cumsum(1)
        return (mine / (before + after / ratio)).sum(1)


def _few(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with return_inverse, for small numbers."""
    used = np.flatnonzero(np.bincount(code, minlength=1))
    place = np.zeros(used[-1] + 1 if len(used) else 1, np.int64)
    place[used] = np.arange(len(used))
    return used, place[code]


def _open_links(members: DataFrame, bands: int, rows: int, words: int, threshold: float) -> DataFrame:
    """(a, b): parts that verified links of a tile join.

    members: (bucket, i, j, band, loose, rep, part, sig, raw). A tile holds loose
    rows and rows of the whole bucket. Every loose row is verified with every
    other of another part, unless links found before it have joined them: those
    whose first shared band is another one, in that band's bucket, and those
    whose signatures agree in less than half of the registers, never. A pair at
    the threshold does so with probability below 10**-16.
    """
    half, names_of = bands * rows * (threshold - 0.3), members.columns

    def solve(tile: list[tuple]) -> list[tuple[int, int]]:
        query = np.array([r[4] for r in tile])
        others, root = np.flatnonzero(~query), np.array([r[6] for r in tile])
        if query.all() or not query.any():
            return []
        sig = np.frombuffer(b"".join(r[7] for r in tile), "<u4").reshape(len(tile), bands * rows)
        base, found = sig[others], []
        compared = Compared(_bags([r[8] for r in tile], words), others)
        for q in np.flatnonzero(query).tolist():
            equal = base == sig[q]
            first = equal.reshape(len(others), bands, rows).all(2).argmax(1)
            near = (root[others] != root[q]) & (first == tile[q][3]) & (equal.sum(1) >= half)
            if near.any():
                for k in others[near & _reaches(compared.similarities(q), threshold)].tolist():
                    if root[k] != root[q]:
                        found.append((int(root[q]), int(root[k])))
                        root[root == root[k]] = root[q]
        return found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(tile: list[tuple]) -> pa.RecordBatch:
            found = solve(tile)
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        tile: list[tuple] = []
        for b in pieces(batches, "raw"):
            for r in zip(*(b.column(c).to_pylist() for c in names_of), strict=True):
                if tile and r[:3] != tile[0][:3]:
                    yield out(tile)
                    tile = []
                tile.append(r)
        if tile:
            yield out(tile)

    dealt = members.repartition(partitions(members.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "rep")
    return dealt.mapInArrow(work, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, words: int, threshold: float) -> DataFrame:
    """(a, b) of the pairs of texts (rep, raw) whose exact probability Jaccard reaches threshold.

    A text that many pairs share travels once for every 256 of them.
    """
    salts = 1 + F.floor(F.col("n") / 256).cast("int")
    crowd = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "minhash-crowds", rows=pairs.count())
    spread = crowd.select("a", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    left = spread.join(texts.select(F.col("rep").alias("a"), F.col("raw").alias("x")), "a")
    right = pairs.join(crowd, "a").withColumn("salt", F.pmod(F.xxhash64("b"), salts).cast("int")).drop("n")
    right = right.join(texts.select(F.col("rep").alias("b"), F.col("raw").alias("y")), "b")
    both = right.join(left, ["a", "salt"]).select("a", "b", "x", "y")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "x", "y"):
            x, y = b.column("x").to_pylist(), b.column("y").to_pylist()
            place = {t: k for k, t in enumerate(dict.fromkeys([*x, *y]))}
            bags = _bags(list(place), words)
            plain = [(w == 1).all() for _, w in bags]
            keep = []
            for k, (p, q) in enumerate(zip(x, y, strict=True)):
                i, j = place[p], place[q]
                if plain[i] and plain[j]:
                    common = len(np.intersect1d(bags[i][0], bags[j][0], assume_unique=True))
                    similarity = common / (len(bags[i][0]) + len(bags[j][0]) - common)
                else:
                    similarity = probability_jaccard(bags[i], bags[j])
                if _reaches(similarity, threshold):
                    keep.append(k)
            yield b.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    return both.mapInArrow(work, "a long, b long")


def near_duplicates(
    documents: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    bands: int = 32,
    rows: int = 5,
    tile: int = TILE,
) -> DataFrame:
    """documents with class_id and kept: classes of texts linked by probability Jaccard >= threshold.

    Shingles of `words` words weigh as often as they occur. Equal texts are one
    class from the start. Signatures are cut into bands; a pair at the threshold
    shares a band with probability 1 - (1 - 0.8 ** 5) ** 32 = 0.999997. In each
    bucket every member is verified exactly with the least one, so a group of
    copies gives as many pairs as it has members. Only where that leaves a bucket
    in several parts, the members outside its largest part (the loose ones) are
    verified with all of the bucket, block by block, and only links leave a task.
    So no link that would join two classes is lost. class_id is the least doc_id
    of the class. tile: members of a block.

    Null and empty texts and those without words are classes of their own, as
    are rows without doc_id (class_id null, kept). A text with fewer words is
    one shingle. Rows that repeat a doc_id are one node, with all of their
    texts; they are kept or dropped together. Other columns pass through;
    class_id and kept are replaced. An empty table gives an empty table.
    """
    spark = documents.sparkSession
    ship_package(spark)
    documents = documents.drop("class_id", "kept")
    raw = F.encode(F.col(text), "UTF-8")
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), raw.alias("raw"))
    docs = docs.where("doc_id is not null and octet_length(raw) > 0").select("doc_id", F.unhex(F.md5("raw")).alias("digest"), "raw")
    # as many tasks sign texts, fetch and verify them as the tables have partitions: the sizes of texts differ
    signed = written(signatures(docs, bands, rows, words), "minhash-signatures")
    n = signed.count()
    # partial aggregation: a text leaves a map task once, however many rows hold it
    least = signed.groupBy("digest").agg(F.min(F.struct("doc_id", "size", "sig")).alias("r"))
    reps = written(least.select("digest", F.col("r.doc_id").alias("rep"), "r.size", "r.sig"), "minhash-classes", rows=n, per=8192)
    of_doc = signed.select("doc_id", "digest").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep").distinct()
    of_doc = written(of_doc, "minhash-nodes", rows=n)
    keys = F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda k: F.unhex(F.md5(F.concat(F.substring(F.col("sig"), k * (4 * rows) + 1, F.lit(4 * rows)), k.cast("string").cast("binary")))),
    )
    banded = reps.select("rep", "digest", "size", F.posexplode(keys).alias("band", "bucket"))
    full = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("rep").alias("leader"))
    full = written(full.where("n > 1"), "minhash-full", rows=4 * n)
    many = full.agg(F.sum("n")).first()[0] or 0
    placed = written(banded.drop("size").join(full, "bucket"), "minhash-buckets", rows=many)
    pairs = placed.where("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    pairs = written(pairs, "minhash-pairs", rows=many)
    # texts of candidates only, each from its least row
    held = pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct().join(reps.select("rep", "digest"), "rep")
    held = written(held.withColumn("doc_id", F.col("rep")), "minhash-held", rows=n)
    # the plan for large tables at every size
    texts = docs.join(held.hint("merge"), ["doc_id", "digest"]).select("rep", "digest", "raw").dropDuplicates(["rep", "digest"])
    texts = written(texts, "minhash-texts")
    links = written(_verified(pairs, texts.select("rep", "raw"), words, threshold), "minhash-links")
    # the texts of one doc_id are one node
    own = of_doc.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    same = of_doc.join(written(own, "minhash-own", rows=n), "doc_id").select("a", F.col("rep").alias("b")).where("a <> b")
    edges = links.union(same).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    parts = connected_components(edges)
    parts = written(parts.withColumnsRenamed({"node": "rep", "component": "part"}), "minhash-parts", rows=n)
    # buckets in several parts, but for those of two, which are settled
    sided = placed.where("n > 2").join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    sided = written(sided, "minhash-sided", rows=many)
    shares = sided.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c"))
    state = shares.groupBy("bucket").agg(F.max("c").alias("most"), F.max_by("part", "c").alias("main"), F.sum("c").alias("all"))
    state = written(state.where("most < all"), "minhash-open", rows=4 * n)
    opened = sided.join(state, "bucket")
    blocks = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("bytes") / TILE_BYTES)).cast("int")
    opened = opened.withColumns({"at": F.xxhash64("digest"), "js": blocks})
    loose = F.expr("all - most")
    opened = opened.withColumn("is", F.least("js", F.ceil(loose / F.col("all") * F.col("js")).cast("int")))
    cols = ["bucket", "i", "j", "band", "loose", "rep", "part"]
    query = opened.where("part <> main").withColumns({"i": F.expr("cast(pmod(at, is) as int)"), "loose": F.lit(True)})
    query = query.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("js") - 1)))
    base = opened.withColumns({"j": F.expr("cast(pmod(at, js) as int)"), "loose": F.lit(False)})
    base = base.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("is") - 1)))
    members = query.select(*cols, "digest").union(base.select(*cols, "digest"))
    members = members.join(reps.select("rep", "digest", "sig"), ["rep", "digest"]).join(texts, ["rep", "digest"])
    if not state.isEmpty():
        more = _open_links(members.select(*cols, "sig", "raw"), bands, rows, words, threshold)
        more = written(more, "minhash-more")
        wider = connected_components(more.select(F.col("a").alias("src"), F.col("b").alias("dst")))
        parts = of_doc.select("rep").distinct().join(parts, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
        parts = parts.join(wider.withColumnsRenamed({"node": "part", "component": "whole"}), "part", "left")
        parts = written(parts.select("rep", F.coalesce("whole", "part").alias("part")), "minhash-wider", rows=n)
    own_id, class_id = free_names(documents.columns, "own_id", "class_id")
    # nodes are named by their least doc_id, and so are classes
    of_doc = of_doc.join(parts, "rep", "left").select(F.col("doc_id").alias(own_id), F.coalesce("part", "rep").alias(class_id)).distinct()
    of_doc = written(of_doc, "minhash-of", rows=n)
    known = documents.where(F.col(doc_id).isNotNull()).withColumn(own_id, F.col(doc_id).cast("long"))
    known = known.join(of_doc, own_id, "left").withColumn(class_id, F.coalesce(class_id, own_id))
    known = known.withColumn("kept", F.col(class_id) == F.col(own_id)).drop(own_id)
    other = documents.where(F.col(doc_id).isNull()).withColumns({class_id: F.lit(None).cast("long"), "kept": F.lit(True)})
    return known.select(other.columns).union(other)


def op8_prob_minhash(spark, sf_dir: str) -> DataFrame:
    """Classes of near-duplicate texts over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "class_id", "kept")
