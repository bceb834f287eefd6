"""Exact token counts of every prefix of a text, by dynamic programming over prefixes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from twinlake.llm.batches import release
from twinlake.llm.bpe import Vocabulary, read_vocabulary, vocabulary
from twinlake.session import free_names, ship_package

#: Words that a worker keeps the counts of; full, the memo starts anew.
MEMO = 500_000
#: Words of up to so many bytes are worked out many at once, longer ones each alone.
SHORT = 32
#: Characters of text whose words are looked up together.
TOGETHER = 1 << 22

_B, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC4CEB9FE1A85EC53)


class Table:
    """Open addressing from 64-bit keys to small numbers, read many keys at once."""

    def __init__(self, bits: int) -> None:
        self.bits, self.used = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((keys ^ (keys >> np.uint64(31))) * _SPREAD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds different keys that are absent; a full table starts anew."""
        if 2 * (self.used + len(keys)) > 1 << self.bits:
            self.__init__(max(self.bits, (4 * len(keys)).bit_length()))
        self.used += len(keys)
        at, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.values[at[todo]] < 0]
            won = free[np.unique(at[free], return_index=True)[1]]
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            todo = np.setdiff1d(todo, won, assume_unique=True)
            at[todo] = (at[todo] + 1) % (1 << self.bits)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values, -1 for keys that are absent."""
        at = self._slots(keys)
        out = self.values[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != keys))
        while len(todo):
            at[todo] = (at[todo] + 1) % (1 << self.bits)
            out[todo] = self.values[at[todo]]
            todo = todo[(out[todo] >= 0) & (self.keys[at[todo]] != keys[todo])]
        return out


class PrefixCounts:
    """Token counts of all prefixes, from the last token of each.

    The encoding of a prefix ends in the one token t for which the encoding of
    what precedes t ends in a token that BPE would not merge into t. So the
    last token and the count of a prefix follow from those of a shorter one.
    """

    def __init__(self, vocab: Vocabulary) -> None:
        if not vocab.by_rank:
            raise ValueError("prefix counts need a byte-level BPE file whose merges follow its ids")
        self.vocab = vocab
        self.apart, self.tokens = Table(22), Table(18)
        self.ends = ahocorasick.Automaton()  # of bytes as characters: the tokens that end at each place
        for raw, i in vocab.ids.items():
            self.ends.add_word(raw.decode("latin-1"), (len(raw), i))
        self.ends.make_automaton()
        self.told: dict[int, bool] = {}
        self._forget()
        with np.errstate(over="ignore"):
            self.letter = (np.arange(1, 257, dtype=np.uint64) * _SPREAD) ^ _B
            self.power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(SHORT, _B)])
            short = [(raw, i) for raw, i in vocab.ids.items() if len(raw) <= SHORT]
            sizes = np.array([len(raw) for raw, _ in short])
            text = np.frombuffer(b"".join(raw.ljust(SHORT, b"\0") for raw, _ in short), np.uint8).reshape(-1, SHORT)
            h = np.zeros(len(short), np.uint64)
            for k in range(SHORT):
                h = np.where(k < sizes, h * _B + self.letter[text[:, k]], h)
            self.tokens.put(h, np.array([i for _, i in short], np.int32))

    def _forget(self) -> None:
        """Word -> its row in: tokens, characters, and where its counts begin."""
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((3, 0), np.int64)
        self.counts = np.zeros(0, np.uint32)

    def _test(self, key: int) -> bool:
        """Whether BPE leaves the tokens of key as they are, side by side."""
        a, b = (key >> 32) - 1, key & 0xFFFFFFFF
        left = self.vocab.bytes[a] if a >= 0 else b""
        return self.vocab.piece(left + self.vocab.bytes[b]) == ([a, b] if a >= 0 else [b])

    def _stay_apart(self, keys: np.ndarray) -> np.ndarray:
        known = self.apart.get(keys)
        if (new := known < 0).any():
            some, back = np.unique(keys[new], return_inverse=True)
            found = np.array([self._test(int(k)) for k in some], np.int32)
            self.apart.put(some, found)
            known[new] = found[back]
        return known > 0

    def _short(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of the byte prefixes of raws, longest first, and their bytes; a row each."""
        sizes = np.array([len(r) for r in raws])
        wide = int(sizes[0])
        text = np.frombuffer(b"".join(r.ljust(wide, b"\0") for r in raws), np.uint8).reshape(-1, wide)
        last = np.full((len(raws), wide + 1), -1, np.int64)
        count = np.zeros((len(raws), wide + 1), np.uint32)
        with np.errstate(over="ignore"):
            sums = np.zeros((len(raws), wide + 1), np.uint64)
            for k in range(wide):
                sums[:, k + 1] = sums[:, k] * _B + self.letter[text[:, k]]
            for end in range(1, wide + 1):
                rows = np.arange(np.searchsorted(-sizes, -end, side="right"))
                for start in range(end):
                    token = self.tokens.get(sums[rows, end] - sums[rows, start] * self.power[end - start])
                    hit = np.flatnonzero(token >= 0)
                    token, at = token[hit].astype(np.int64), rows[hit]
                    fine = self._stay_apart(((last[at, start] + 1) << 32 | token).astype(np.uint64))
                    at = at[fine]
                    last[at, end], count[at, end] = token[fine], count[at, start] + 1
                    keep = np.ones(len(rows), bool)
                    keep[hit[fine]] = False
                    rows = rows[keep]
                    if not len(rows):
                        break
        return count[:, 1:], text

    def _long(self, raw: bytes) -> np.ndarray:
        """Counts of the byte prefixes of one long word: at each end the longest token that stays apart."""
        last, count, done = [-1] * (len(raw) + 1), [0] * (len(raw) + 1), -1
        for end, (size, token) in self.ends.iter(raw.decode("latin-1")):
            if end == done:
                continue
            key = (last[end + 1 - size] + 1) << 32 | token
            fine = self.told.get(key)
            if fine is None:
                if len(self.told) > MEMO:
                    self.told.clear()
                fine = self.told[key] = bool(self._stay_apart(np.array([key], np.uint64))[0])
            if fine:
                last[end + 1], count[end + 1], done = token, count[end + 1 - size] + 1, end
        return np.array(count[1:], np.uint32)

    def learn(self, words: set[str]) -> None:
        """Puts the counts of each character prefix of pre-tokens in the memo."""
        raws = sorted(((w.encode(), w) for w in words), key=lambda x: -len(x[0]))
        n_long = sum(len(r) > SHORT for r, _ in raws)
        found = [self._long(r) for r, _ in raws[:n_long]]
        if raws[n_long:]:
            counts, _ = self._short([r for r, _ in raws[n_long:]])
            found += [c[: len(r)] for (r, _), c in zip(raws[n_long:], counts, strict=True)]
        totals = [int(c[-1]) for c in found]
        for k, (raw, w) in enumerate(raws):
            if len(raw) != len(w):  # keep the ends of characters
                b = np.frombuffer(raw + b"a", np.uint8)
                found[k] = found[k][(b[1:] & 0xC0) != 0x80]
            if w in ("'ll", "'re", "'ve"):  # cut short, these are two words
                found[k] = np.array([1, 2, totals[k]], np.uint32)
        sizes = np.array([len(c) for c in found])
        begins = np.cumsum(sizes) - sizes + len(self.counts)
        self.memo.update(zip((w for _, w in raws), range(len(self.memo), len(self.memo) + len(raws))))
        self.rows = np.hstack([self.rows, [totals, sizes, begins]])
        self.counts = np.concatenate([self.counts, *found])

    def _rows(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
        except KeyError:
            new = set(words).difference(self.memo)
            if len(self.memo) + len(new) > MEMO:
                self._forget()
                new = set(words)
            self.learn(new)
            return np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Counts of the prefixes of texts that hold no special strings."""
        each = [self.vocab.words(t) for t in texts]
        words = [w for ws in each for w in ws]
        at = self._rows(words)
        tokens, sizes, begins = self.rows[:, at]
        ends, done = np.cumsum(sizes), np.cumsum(tokens)
        counts = self.counts[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - ends + sizes, sizes)]
        counts = counts + np.repeat(done - tokens, sizes)
        out, k = [], 0
        for text, ws in zip(texts, each, strict=True):
            if not ws:
                out.append(np.zeros(0, np.uint32))
                continue
            low = ends[k] - sizes[k]
            own = (counts[low : ends[k + len(ws) - 1]] - (done[k] - tokens[k])).astype(np.uint32)
            if _TWO_SPACES.search(text):
                # white space before more of it: cut after the next character, it is one longer run
                for i in range(len(ws) - 1):
                    if ws[i][-1].isspace() and ws[i + 1][0].isspace():
                        run = self._rows([ws[i] + ws[i + 1][0]])
                        own[ends[k + i] - low] = done[k + i] - tokens[k + i] - done[k] + tokens[k] + self.rows[0, run[0]]
            out.append(own)
            k += len(ws)
        return out

    def special(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text with special strings."""
        parts = self.vocab.parts(text)
        out, base, start = [], 0, 0
        for k, p in enumerate(parts):
            if k % 2:
                # a special string cut short is ordinary text that follows the part before it
                cut = self.plain([parts[k - 1] + p[:-1]])[0][len(parts[k - 1]) :] + np.uint32(start)
                base += 1
                out.append(np.r_[cut, np.uint32(base)])
            else:
                start = base
                if p:
                    out.append(self.plain([p])[0] + np.uint32(base))
                    base = int(out[-1][-1])
        return np.concatenate(out)

    def of(self, texts: list[str]) -> Iterator[np.ndarray]:
        """For each text, the token counts of text[:1], text[:2], ... text, each as if encoded alone."""
        group: list[str] = []
        size = 0
        for t in texts:
            single = len(self.vocab.parts(t)) > 1
            if group and (single or size > TOGETHER):
                yield from self.plain(group)
                group, size = [], 0
            if single:
                yield self.special(t)
            else:
                group.append(t)
                size += len(t)
        yield from self.plain(group)


_TWO_SPACES = regex.compile(r"\s\s")
_counters: dict[int, PrefixCounts] = {}


def count_prefixes(
    documents: DataFrame, tokenizer_path: str, limits: Sequence[int] = (1024,), table: bool = False, text: str = "text"
) -> DataFrame:
    """documents with n_tokens, cuts array<int> and, if asked for, prefix_counts.

    cuts: for each limit, the characters of the longest prefix of at most that
    many tokens. prefix_counts: unsigned 32-bit little-endian token counts of
    the prefixes of 1, 2, ... characters; entry k answers any question about a
    truncation at character k + 1 without encoding again. Counts are those of
    the tokenizers library without added tokens; special strings inside a text
    are one token each, as its default has it.

    Null and empty texts: 0 tokens, cuts of 0, an empty table. Texts of any
    length are counted whole. Rows are independent, so ties and repeated rows
    change nothing; other columns pass through, and columns named as the new
    ones are replaced. An empty table gives an empty table.
    """
    spark = documents.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(tokenizer_path))
    limits = [int(x) for x in limits]
    kind = pa.struct([("n_tokens", pa.int64()), ("cuts", pa.list_(pa.int32()))] + [("prefix_counts", pa.binary())] * table)

    @F.arrow_udf("n_tokens long, cuts array<int>" + ", prefix_counts binary" * table)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(shared.value)
        counter = _counters.setdefault(id(vocab), PrefixCounts(vocab))
        for b in batches:
            rows = []
            for counts in counter.of([t or "" for t in b.to_pylist()]):
                cuts = []
                for limit in limits:
                    fit = np.flatnonzero(counts <= limit)
                    cuts.append(int(fit[-1]) + 1 if len(fit) else 0)
                row = {"n_tokens": int(counts[-1]) if len(counts) else 0, "cuts": cuts}
                rows.append(row | {"prefix_counts": counts.tobytes()} if table else row)
            yield pa.array(rows, kind)
        release()

    cols = [c for c in documents.columns if c not in ("n_tokens", "cuts", "prefix_counts")]
    (found,) = free_names(documents.columns, "counted")
    return documents.select(*cols, count(F.col(text)).alias(found)).select(*cols, f"{found}.*")


def tokens_of_prefix(prefix_counts: F.Column, chars: F.Column) -> F.Column:
    """Tokens of a text cut behind so many characters, from its stored prefix_counts; all of it where it has no more.

    No characters, and an empty table, are 0 tokens. A look at four bytes, by
    built-in functions.
    """
    at = F.least(chars.cast("long"), (F.octet_length(prefix_counts) / 4).cast("long"))
    raw = F.hex(F.substring(prefix_counts, (4 * at - 3).cast("int"), F.lit(4)))
    back = F.concat(*(F.substring(raw, k, 2) for k in (7, 5, 3, 1)))  # the least byte is stored first
    return F.when(at > 0, F.conv(back, 16, 10).cast("long")).when(at <= 0, F.lit(0).cast("long"))


def chars_within(prefix_counts: F.Column, budget: F.Column) -> F.Column:
    """Characters of the longest prefix of at most budget tokens, from stored prefix_counts; null where either is.

    Budgets can differ from row to row. A longer prefix can have fewer tokens
    than a shorter one, so the last that fits is looked for, not the first that
    does not. Needs ship_package where no operator has run yet.
    """

    @F.arrow_udf(T.LongType())
    def last_within(counts: pa.Array, most: pa.Array) -> pa.Array:
        out = []
        for raw, n in zip(counts, most.to_pylist(), strict=True):
            fit = np.flatnonzero(np.frombuffer(raw.as_py(), "<u4") <= n) if raw.is_valid and n is not None else None
            out.append(None if fit is None else int(fit[-1]) + 1 if len(fit) else 0)
        return pa.array(out, pa.int64())

    return last_within(prefix_counts, budget)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token totals and the 1,024-token cut of all documents."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = count_prefixes(docs, public_tokenizers.path("byte_bpe_50k.json"), limits=(1024,))
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 1024).alias("over_limit"),
        F.col("cuts")[0].alias("chars_within_limit"),
    )
