"""BPE encoding and decoding with content-defined chunks that documents share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from twinlake.llm.batches import TOGETHER, pieces
from twinlake.llm.bpe import Vocabulary, read_vocabulary, vocabulary
from twinlake.session import ship_package

#: A cut falls behind a byte where the hash of the last WINDOW bytes has MASK's bits clear.
WINDOW, MASK = 12, np.uint32((1 << 10) - 1)
#: Chunks are no shorter than this, but for the last of a text.
SHORTEST = 64
#: Characters of chunks a worker remembers; full, the older half goes.
MEMO = 8 << 20

_GEAR = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.uint32)
_FIRST = regex.compile(r"\S(?=\s)")
_LAST = regex.compile(r"(?s).*\S(?=\s)")


def cut_points(raw: bytes) -> np.ndarray:
    """Offsets behind which a content-defined cut may fall."""
    g = _GEAR[np.frombuffer(raw, np.uint8)]
    h = g.copy()
    for k in range(1, WINDOW):
        h[k:] += g[:-k] << np.uint32(k)
    h ^= h >> np.uint32(15)
    return np.flatnonzero((h * np.uint32(0x85EBCA6B) >> np.uint32(9)) & MASK == 0) + 1


class Chunk:
    """Ids of a chunk, and its ends up to the first and from the last place where words surely part."""

    __slots__ = ("ids", "head", "tail", "body")

    def __init__(self, text: str, vocab: Vocabulary) -> None:
        self.ids = vocab.encode(text)
        first = _FIRST.search(text)
        if first is None:
            self.head, self.tail, self.body = text, "", None
            return
        self.head, self.tail = text[: first.end()], text[_LAST.match(text).end() :]
        n_head, n_tail = len(vocab.encode(self.head)), len(vocab.encode(self.tail))
        self.body = self.ids[n_head : len(self.ids) - n_tail]


class ChunkEncoder:
    """Encodes texts from the ids of their chunks.

    A chunk met before is not encoded again. A join of two chunks is repaired by
    encoding anew from the last place in the left chunk to the first in the
    right where a space follows a word: no pre-token spans such a place and
    nothing before it depends on what follows, so from there on the new ids and
    those of the chunk agree exactly. Without such a place the repair goes on
    through the next chunk.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        self.memo: dict[str, Chunk] = {}
        self.joins: dict[str, np.ndarray] = {}
        self.size = 0

    def _chunk(self, text: str) -> Chunk:
        got = self.memo.get(text)
        if got is None:
            if self.size > MEMO:
                for old in list(self.memo)[: len(self.memo) // 2]:
                    del self.memo[old]
                self.size = sum(map(len, self.memo))
            got = self.memo[text] = Chunk(text, self.vocab)
            self.size += len(text)
        return got

    def _join(self, text: str) -> np.ndarray:
        if len(text) > 64:
            return self.vocab.encode(text)
        got = self.joins.get(text)
        if got is None:
            if len(self.joins) > 100_000:
                self.joins.clear()
            got = self.joins[text] = self.vocab.encode(text)
        return got

    def _plain(self, chunks: list[str]) -> list[np.ndarray]:
        if len(chunks) == 1:
            return [self._chunk(chunks[0]).ids]
        out, loose = [], []
        for text in chunks:
            c = self._chunk(text)
            loose.append(c.head)
            if c.body is not None:
                out += [self._join("".join(loose)), c.body]
                loose = [c.tail]
        return [*out, self._join("".join(loose))]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        group: list[tuple[str, bytes]] = []
        size = 0
        for t in texts:
            group.append((t, t.encode()))
            size += len(group[-1][1])
            if size > TOGETHER:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, group: list[tuple[str, bytes]]) -> Iterator[np.ndarray]:
        raw = b"".join(r for _, r in group)
        cuts = cut_points(raw)
        at = 0
        for text, own in group:
            lo, hi = np.searchsorted(cuts, (at + SHORTEST, at + len(own)))
            if self.vocab.odd(text):
                yield self.vocab.encode(text)
            elif len(parts := self.vocab.parts(text)) > 1:  # special strings are words of their own, at odd places
                yield np.concatenate([self._special(p) if k % 2 else self._whole(p.encode(), cut_points(p.encode())) for k, p in enumerate(parts)])
            else:
                yield self._whole(own, cuts[lo:hi] - at)
            at += len(own)

    def _special(self, text: str) -> np.ndarray:
        return np.array([self.vocab.special[text]], np.uint32)

    def _whole(self, own: bytes, cuts: np.ndarray) -> np.ndarray:
        """Ids of a text without special strings, chunk by chunk."""
        if not own:
            return np.zeros(0, np.uint32)
        chunks, begin = [], 0
        for c in cuts.tolist():
            while c < len(own) and own[c] & 0xC0 == 0x80:
                c += 1
            if c - begin >= SHORTEST and c < len(own):
                chunks.append(own[begin:c].decode())
                begin = c
        chunks.append(own[begin:].decode())
        return np.concatenate(self._plain(chunks)) if len(chunks) > 1 else self._chunk(chunks[0]).ids


_encoders: dict[int, ChunkEncoder] = {}


def encode_texts(
    documents: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """documents with ids: little-endian unsigned 32-bit token ids of the text, as binary.

    The ids are those of the tokenizers library without added tokens; special
    strings inside a text are their single id, as its default has it. Chunks are
    remembered by each Python worker; nothing is shuffled. decoded names a
    column for the text that the ids decode to, in the same pass.

    Null and empty texts: no ids, empty binary, decoded an empty text. Texts of
    any length are encoded whole. Repeated rows get equal ids. Other columns
    pass through, those named as new ones are replaced. An empty table gives an
    empty table.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    kept = documents.select(*[c for c in documents.columns if c not in (ids, decoded)])
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.BinaryType())])
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        encoder = _encoders.setdefault(id(vocab), ChunkEncoder(vocab))
        for part in pieces(batches, text):
            done = list(encoder.encode([t or "" for t in part.column(text).to_pylist()]))
            more = [pa.array([x.astype("<u4", copy=False).tobytes() for x in done], pa.binary())]
            if decoded:
                more.append(pa.array([vocab.decode(x) for x in done], pa.binary()).cast(pa.string()))
            names = [*part.schema.names, ids, *[decoded] * bool(decoded)]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=names)

    return kept.mapInArrow(work, schema)


def decode_ids(encoded: DataFrame, tokenizer_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encoded with decoded: the text of the ids, special tokens included.

    Bytes that are no UTF-8 become U+FFFD, as in the library. Null ids give an
    empty text. Other columns pass through, one named as decoded is replaced.
    """
    spark = encoded.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    kept = encoded.select(*[c for c in encoded.columns if c != decoded])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(shared.value)
        for part in pieces(batches, ids):
            texts = [vocab.decode(np.frombuffer(x or b"", "<u4")) for x in part.column(ids).to_pylist()]
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*part.columns, new], names=[*part.schema.names, decoded])

    return kept.mapInArrow(work, T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())]))


def op9_bpe_chunk_reuse(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids and the decoded texts of all documents."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = encode_texts(docs, path, decoded="decoded")
    return out.select(
        "doc_id",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )
