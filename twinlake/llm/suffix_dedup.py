"""Suffix-array dedup: bytes covered by a long string that occurs more than once.

Blockwise suffix sorting with a difference cover, cut for a cluster. Suffixes
matter to `span` bytes only. They are dealt into buckets by their content, the
buckets that can hold a repeat are sorted block by block, and long ties are
resolved by ranks of cover suffixes made beforehand for the block. A bucket that
is too large for a block is dealt again by more of its content.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinlake.llm.batches import pieces
from twinlake.llm.suffix_blocks import Anchors, digest, repeated
from twinlake.session import free_names, partitions, ship_package, written

RUN = "doc binary, bucket long, ctx binary, anchor int, first int, last int"
CONTEXT = "ctx binary, bucket long, anchor int, lo int, hi int, bytes binary"


@cache
def _anchors(span: int, gram: int) -> Anchors:
    return Anchors(span, gram)


def _buckets(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """(bucket) of each run of starts that share one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _anchors(span, gram)
        for b in pieces(batches, "raw"):
            for found in cut.of(b.column("raw").to_pylist(), contexts=False):
                yield pa.RecordBatch.from_arrays([pa.array(found[1])], names=["bucket"])

    return docs.select("raw").mapInArrow(work, "bucket long")


def _runs(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """A row for each run of starts that share a bucket; ctx stands for all the bytes that the run's strings cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _anchors(span, gram)
        for b in pieces(batches, "raw"):
            keys = b.column("doc").to_pylist()
            for k, bucket, ctx, anchor, first, last in cut.of(b.column("raw").to_pylist()):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[i] for i in k.tolist()], pa.binary()), pa.array(bucket), pa.array(ctx, pa.binary())]
                    + [pa.array(x.astype(np.int32)) for x in (anchor, first, last)],
                    names=["doc", "bucket", "ctx", "anchor", "first", "last"],
                )

    return docs.select("doc", "raw").mapInArrow(work, RUN)


def _contexts(docs: DataFrame, wanted: DataFrame, span: int, gram: int) -> DataFrame:
    """The bytes of each wanted context (ctx, bucket, doc, anchor, first, last), and the offsets its strings can have."""
    by_doc = wanted.groupBy("doc").agg(
        F.collect_list(F.struct("ctx", "bucket", "anchor", "first", "last")).alias("runs")  # bounded by the document's length
    )
    cut = F.transform(
        "runs",
        lambda r: F.struct(
            r["ctx"].alias("ctx"),
            r["bucket"].alias("bucket"),
            (r["anchor"] - r["first"]).alias("anchor"),
            F.lit(0).alias("lo"),
            F.lit(span - gram).alias("hi"),
            F.substring(F.col("raw"), r["first"] + 1, r["last"] - r["first"] + span).alias("bytes"),
        ),
    )
    return docs.join(by_doc, "doc").select(F.explode(cut).alias("c")).select("c.*")


def _sort_blocks(contexts: DataFrame, span: int, block_bytes: int) -> DataFrame:
    """(ctx, low, high): repeated starts of each context, as offsets, high included.

    One row a maximal run. Buckets come one after the other; a block is as many whole buckets as fit
    block_bytes.
    """

    def solve(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        text = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        ends = np.cumsum([len(r[2]) for r in rows])
        begins = np.r_[0, ends[:-1]]
        count = ends - begins - span + 1
        row = np.repeat(np.arange(len(rows)), count)
        offset = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        hit = repeated(text, begins[row] + offset, span)
        row, offset = row[hit], offset[hit]
        new = np.r_[True, (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)] if len(row) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        tail = np.r_[head[1:], len(row)] - 1 if len(row) else head
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[i][1] for i in row[head].tolist()], pa.binary())]
            + [pa.array(offset[x].astype(np.int32)) for x in (head, tail)],
            names=["ctx", "low", "high"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, bytes, bytes]] = []
        size, last = 0, None
        for b in pieces(batches, "bytes"):
            for r in zip(*(b.column(c).to_pylist() for c in ("bucket", "ctx", "bytes")), strict=True):
                if size >= block_bytes and r[0] != last:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size, last = size + len(r[2]), r[0]
        if rows:
            yield solve(rows)

    # by a hash of the bucket: dealt by the bucket itself, Spark would take over the partitions of the join before
    # it, and may merge or split these
    dealt = contexts.select("bucket", "ctx", "bytes").repartition(partitions(contexts.sparkSession), F.xxhash64("bucket"))
    return dealt.sortWithinPartitions("bucket").mapInArrow(work, "ctx binary, low int, high int")


def _halved(contexts: DataFrame, span: int) -> DataFrame:
    """CONTEXT rows with parent and shift: each context cut in two by the offset of its strings' anchor.

    All strings of offsets lo to hi hold the bytes from the first to the last of
    them in common, so these are the new bucket: the narrower the offsets, the
    more content the bucket stands for, up to the whole string.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "bytes"):
            out: list[tuple] = []
            for ctx, anchor, lo, hi, raw in zip(*(b.column(c).to_pylist() for c in ("ctx", "anchor", "lo", "hi", "bytes")), strict=True):
                mid = (lo + hi) // 2
                for low, high in ((lo, mid), (mid + 1, hi)):
                    first, last = max(0, anchor - high), min(len(raw) - span, anchor - low)
                    if low <= high and first <= last:
                        part, where = raw[first : last + span], b"%d %d " % (low, high)
                        bucket = int.from_bytes(digest(where + raw[anchor - low : anchor - high + span])[:8], "little", signed=True)
                        name = digest(where + b"%d " % (anchor - first) + part)
                        out.append((ctx, first, name, bucket, anchor - first, low, high, part))
            kinds = [pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            names = ["parent", "shift", "ctx", "bucket", "anchor", "lo", "hi", "bytes"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return contexts.select("ctx", "anchor", "lo", "hi", "bytes").mapInArrow(work, f"parent binary, shift int, {CONTEXT}")


def _repeats(contexts: DataFrame, span: int, block_bytes: int, bucket_contexts: int) -> DataFrame:
    """(ctx, low, high): starts, high included, of strings of each of the (different) contexts that others hold too."""
    sizes = contexts.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a plain table, so that Spark can split a hot bucket of the join
    sizes = written(sizes, "suffix-sizes", rows=contexts.count())
    held = contexts.join(sizes, "bucket")
    out = _sort_blocks(held.where(F.col("n") <= bucket_contexts), span, block_bytes)
    if sizes.where(F.col("n") > bucket_contexts).isEmpty():
        return out
    halves = _halved(held.where(F.col("n") > bucket_contexts), span)
    halves = written(halves, "suffix-halves")
    rest = [F.any_value(c).alias(c) for c in ("bucket", "anchor", "lo", "hi", "bytes")]
    each = written(halves.groupBy("ctx").agg(F.count(F.lit(1)).alias("n"), *rest), "suffix-halved")
    inner = _repeats(each.drop("n"), span, block_bytes, bucket_contexts)
    whole = each.where("n > 1").select("ctx", F.lit(0).alias("low"), (F.octet_length("bytes") - span).alias("high"))
    found = written(inner.union(whole), "suffix-found")
    back = halves.select("parent", "shift", "ctx").join(found, "ctx")
    return out.union(back.select("parent", F.col("low") + F.col("shift"), F.col("high") + F.col("shift")))


def repeated_intervals(
    docs: DataFrame, span: int = 400, block_bytes: int = 1 << 20, bucket_contexts: int = 2048
) -> DataFrame:
    """(doc, low, high) byte intervals, high excluded, that repeated strings of span bytes cover.

    docs: (doc binary key of the content, raw binary), a row for each key; a
    written table, as it is read several times. Intervals of a document may
    overlap and repeat. bucket_contexts: buckets with more different contexts
    than a task should sort are dealt again by more of their content, and so on;
    nothing is dropped. Contexts are the same if the 128 bits of their BLAKE2b
    digests are; all else is compared byte by byte.
    """
    ship_package(docs.sparkSession)
    gram = span // 2
    often = _buckets(docs, span, gram).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    some = 32 * docs.count()  # a text has some tens of runs
    often = written(often, "suffix-often", rows=some)
    runs = written(_runs(docs, span, gram).join(often, "bucket", "left_semi"), "suffix-runs")
    each = runs.groupBy("ctx").agg(
        F.count(F.lit(1)).alias("n"), F.min("bucket").alias("bucket"), F.min(F.struct("doc", "anchor", "first", "last")).alias("rep")
    )
    n = runs.count()
    each = written(each, "suffix-contexts", rows=n)
    mixed = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("contexts")).where("contexts > 1").select("bucket")
    mixed = written(mixed, "suffix-mixed", rows=n)
    wanted = each.join(mixed, "bucket").select("ctx", "bucket", "rep.*")
    texts = written(_contexts(docs, wanted, span, gram), "suffix-texts")
    found = _repeats(texts, span, block_bytes, bucket_contexts).groupBy("ctx").agg(
        F.collect_set(F.struct("low", "high")).alias("parts")  # at most gram + 1 starts, so a few hundred intervals
    )
    verdict = each.join(found, "ctx", "left").where("n > 1 or parts is not null")
    verdict = written(verdict.select("ctx", (F.col("n") > 1).alias("whole"), "parts"), "suffix-verdicts", rows=n)
    hit = runs.select("ctx", "doc", "first", "last").join(verdict, "ctx")
    full = F.array(F.struct(F.lit(0).alias("low"), (F.col("last") - F.col("first")).alias("high")))
    hit = hit.select("doc", "first", F.explode(F.when(F.col("whole"), full).otherwise(F.col("parts"))).alias("p"))
    return hit.select(
        "doc", (F.col("first") + F.col("p.low")).alias("low"), (F.col("first") + F.col("p.high") + span).alias("high")
    )


def _merge(parts: list[dict[str, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["low"], x["high"]) for x in parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _whole_words(t: bytes, low: int, high: int) -> int:
    """Words between white space that lie in t[low:high] as a whole."""
    inside = t[low:high]
    cut = low > 0 and not t[low - 1 : low].isspace() and not t[low : low + 1].isspace()
    tail = high < len(t) and not t[high : high + 1].isspace() and not t[high - 1 : high].isspace()
    return max(0, len(inside.split()) - cut - tail)


def remove_repeats(
    documents: DataFrame, span: int = 400, text: str = "text", as_text: bool = False, least_words: int = 0, **options
) -> DataFrame:
    """documents with removed_spans array<struct<low, high>> (bytes, high excluded) and kept (binary).

    as_text: kept is a string; characters of which a cut left a part go as a whole.
    least_words: removed runs that hold fewer whole words stay.

    Every byte goes that a string of span bytes covers which also starts anywhere
    else in the table, in the same document or another; overlapping occurrences
    count, and strings are judged on the input. Strings never cross documents.

    Null and empty texts keep nothing and lose nothing. Texts shorter than span
    lose nothing. Rows that repeat a text are occurrences of each other, so all
    their bytes go; texts count once each in what follows, however many rows
    hold them. Other columns pass through, whatever their names, except those
    named removed_spans and kept, which are replaced. An empty table gives an
    empty table.
    """
    spark = documents.sparkSession
    ship_package(spark)
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    long = F.octet_length(raw) >= span
    docs = documents.where(long).select(F.unhex(F.md5(raw)).alias("doc"), raw.alias("raw"))
    # partial aggregation: a text leaves a map task once
    docs = docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.any_value("raw").alias("raw"))
    docs = written(docs, "suffix-docs")
    copied = docs.where("n > 1").select("doc", F.lit(0).alias("low"), F.octet_length("raw").alias("high"))
    found = repeated_intervals(docs.select("doc", "raw"), span, **options).union(copied)

    cols = [c for c in documents.columns if c not in ("removed_spans", "kept")]
    doc, hit, cut_, whole = free_names(documents.columns, "doc", "hit", "cut", "raw")
    found = written(found.groupBy(F.col("doc").alias(doc)).agg(F.collect_set(F.struct("low", "high")).alias(hit)), "suffix-hits")
    kind = pa.struct([("removed_spans", pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))), ("kept", pa.string() if as_text else pa.binary())])

    @F.arrow_udf(f"removed_spans array<struct<low: int, high: int>>, kept {'string' if as_text else 'binary'}")
    def cut(raws: pa.Array, hits: pa.Array) -> pa.Array:
        out = []
        for t, h in zip(raws, hits, strict=True):
            if not h.is_valid:
                out.append(None)
                continue
            t = t.as_py()
            merged = [m for m in _merge(h.as_py()) if not least_words or _whole_words(t, *m) >= least_words]
            at = [0, *(x for s in merged for x in s), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(at[::2], at[1::2], strict=True))
            spans = [{"low": a, "high": b} for a, b in merged]
            # a cut can leave the head or the tail of a character
            out.append({"removed_spans": spans, "kept": kept.decode("utf-8", "ignore") if as_text else kept})
        return pa.array(out, kind)

    none = F.array().cast("array<struct<low: int, high: int>>")
    uncut = F.coalesce(F.col(text), F.lit("")) if as_text else raw
    short = documents.where(~long).select(*cols, none.alias("removed_spans"), uncut.alias("kept"))
    left = documents.where(long).select(*cols, *[text] * (text not in cols), F.unhex(F.md5(raw)).alias(doc))
    left = left.join(found, doc, "left").withColumn(whole, F.when(F.col(hit).isNotNull(), raw))
    done = left.withColumn(cut_, cut(whole, hit))
    done = done.select(
        *cols,
        F.coalesce(F.col(cut_)["removed_spans"], none).alias("removed_spans"),
        F.when(F.col(cut_).isNull(), uncut).otherwise(F.col(cut_)["kept"]).alias("kept"),
    )
    return done.union(short)


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Digest of remove_repeats over all documents."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    gone = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda a, s: a + (s["high"] - s["low"]))
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length(F.encode("text", "UTF-8")), F.lit(0)).cast("long").alias("n_bytes"),
        gone.alias("n_removed"),
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
