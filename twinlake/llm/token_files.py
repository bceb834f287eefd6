"""Token ids in binary files, Simple-8b coded, in order of document."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from twinlake.llm import simple8b
from twinlake.llm.batches import pieces, release
from twinlake.llm.bpe import read_vocabulary, vocabulary
from twinlake.session import new_path, partitions, ship_package, written
from twinlake.sources.shared_files import read_file, write_file

MAGIC = b"TLS8B001"
#: Ids of a block at least, but for the last; a block begins where a document begins or goes on.
BLOCK = 1 << 16


def _block(ids: np.ndarray) -> bytes:
    """Count of words, count of escapes, words, escaped values; little-endian."""
    words, escaped = simple8b.pack(ids)
    return struct.pack("<QQ", len(words), len(escaped)) + words.astype("<u8").tobytes() + escaped.astype("<u8").tobytes()


def _unblock(raw: bytes) -> np.ndarray:
    n, _ = struct.unpack_from("<QQ", raw)
    rest = np.frombuffer(raw, "<u8", offset=16)
    return simple8b.unpack(rest[:n], rest[n:])


def _parts(docs: Iterator[tuple[int | None, np.ndarray]], totals: list[int]) -> Iterator[bytes]:
    """The bytes of one file: blocks, then where each block begins and what each document has."""
    yield MAGIC
    at, offsets, counts, keys, sizes = len(MAGIC), [], [], [], []
    open_ids: list[np.ndarray] = []
    size = 0

    def block() -> bytes:
        nonlocal at, open_ids, size
        raw = _block(np.concatenate(open_ids))
        offsets.append(at)
        counts.append(size)
        at, open_ids, size = at + len(raw), [], 0
        return raw

    for key, ids in docs:
        keys.append(key)
        sizes.append(len(ids))
        for low in range(0, len(ids), BLOCK):  # a long document takes several blocks
            open_ids.append(ids[low : low + BLOCK])
            size += len(open_ids[-1])
            if size >= BLOCK:
                yield block()
    if size:
        yield block()
    index = pa.BufferOutputStream()
    columns = {"offset": pa.array(offsets, pa.int64()), "ids": pa.array(counts, pa.int64())}
    owners = {"doc_id": pa.array(keys, pa.int64()), "ids": pa.array(sizes, pa.int64())}
    lengths = []
    for c in (columns, owners):
        t, before = pa.table(c), index.tell()
        with pa.ipc.new_stream(index, t.schema) as w:
            w.write_table(t)
        lengths.append(index.tell() - before)
    yield index.getvalue().to_pybytes()
    yield struct.pack("<QQQ", at, *lengths) + MAGIC
    totals += [len(keys), sum(sizes)]


def read_documents(uri: str, name: str) -> Iterator[tuple[list[int | None], np.ndarray, np.ndarray]]:
    """(doc ids, counts, ids) of a file, block by block; a document comes with the block it ends in."""
    with read_file(uri, name) as f:
        end = f.size()
        f.seek(end - 32)
        at, n_blocks, n_docs = struct.unpack("<QQQ", f.read(24))
        if f.read(8) != MAGIC:
            raise ValueError(f"{name} is no token file")
        f.seek(at)
        blocks = pa.ipc.open_stream(f.read(n_blocks)).read_all()
        docs = pa.ipc.open_stream(f.read(n_docs)).read_all()
        keys, sizes = docs["doc_id"].to_pylist(), docs["ids"].to_numpy()
        starts = blocks["offset"].to_pylist()
        ends = [*starts, at][1:]  # none in the file of an empty range
        upto = np.cumsum(sizes)
        held, size, done, before = [], 0, 0, 0
        for a, b in zip(starts, ends, strict=True):
            f.seek(a)
            held.append(_unblock(f.read(b - a)))
            size += len(held[-1])
            full = int(np.searchsorted(upto, before + size, side="right"))
            if full > done:
                ids, some = np.concatenate(held), int(upto[full - 1]) - before
                yield keys[done:full], sizes[done:full], ids[:some]
                held, size, done, before = [ids[some:]], size - some, full, before + some


def write_token_files(documents: DataFrame, tokenizer_path: str, uri: str, end_id: int = 0, text: str = "text") -> DataFrame:
    """Encodes documents, ends each with end_id and writes token files to the folder uri.

    Returns one row a file, in ascending order of doc_id: (shard, name, docs,
    ids, start), start being the ids in the files before it. Documents are dealt
    by ranges of doc_id, as many files as the session has shuffle partitions;
    equal doc_ids come in order of text, null ones first. A null or empty text
    has the end id only. Rows that repeat are written as often. A lost task
    writes its file again under another name.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(tokenizer_path))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, task, totals = vocabulary(shared.value), TaskContext.get(), []
        end = np.array([end_id], np.uint32)

        def docs():
            for b in pieces(batches, "text"):
                for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield key, np.concatenate([vocab.encode(t), end]) if t else end

        name = write_file(uri, f"tokens-{task.partitionId():06d}-{task.taskAttemptId()}.s8b", _parts(docs(), totals))
        yield pa.RecordBatch.from_pydict(
            {"shard": [task.partitionId()], "name": [name], "docs": [totals[0]], "ids": [totals[1]]},
            pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]),
        )

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    # rows of one doc_id, and those without, are many files' if they are many
    dealt = rows.repartitionByRange(partitions(spark), "doc_id", F.substring("text", 1, 12)).sortWithinPartitions("doc_id", "text")
    files = written(dealt.mapInArrow(work, "shard int, name string, docs long, ids long"), "token-files")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, uri: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary) of each document in the files that write_token_files returned."""
    ship_package(files.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                for keys, sizes, ids in read_documents(uri, name):
                    ends = np.cumsum(sizes)
                    raw = ids.astype("<u4").tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(keys, pa.int64()),
                            pa.array(start + ends - sizes),
                            pa.array(sizes),
                            pa.array([raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist())], pa.binary()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    start += int(ends[-1])
        release()

    dealt = files.select("name", "start").repartition(partitions(files.sparkSession), "name")
    return dealt.mapInArrow(work, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """What the token files of all documents hold, read back from them."""
    import public_tokenizers

    uri = new_path(spark, "tokens")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    files = write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), uri, end_id=0)
    return read_token_files(files, uri).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
