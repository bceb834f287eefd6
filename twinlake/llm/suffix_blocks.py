"""numpy parts of the blockwise suffix sort: bucket anchors, cover ranks, tie splitting."""

from __future__ import annotations

import hashlib

import numpy as np

#: A perfect difference set, every residue of 31 is a difference of two members.
COVER_PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_BASE = 0x9E3779B97F4A7C15
#: Piece of text that is hashed at once; positions in it fit in POS_BITS.
PIECE, POS_BITS = 1 << 18, np.uint64(19)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _shift_table() -> np.ndarray:
    """[r, s] -> the least t for which r + t and s + t are both in the cover."""
    v, inside = COVER_PERIOD, np.zeros(COVER_PERIOD, bool)
    inside[list(COVER)] = True
    r, s, t = np.ogrid[:v, :v, :v]
    return (inside[(r + t) % v] & inside[(s + t) % v]).argmax(axis=2)


class Rolling:
    """Hashes of any stretch of a text in constant time each (polynomials modulo 2**64)."""

    def __init__(self) -> None:
        n = 2 * PIECE + 2
        self.up, self.down = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)
        with np.errstate(over="ignore"):
            self.letter = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))

    def sums(self, text: np.ndarray) -> np.ndarray:
        out = np.zeros(len(text) + 1, np.uint64)
        np.cumsum(self.letter[text] * self.up[: len(text)], out=out[1:])
        return out


class Anchors:
    """Cuts the starts of span-byte strings into runs that share a suffix bucket.

    The bucket of a string is the least hash among its gram-byte substrings, so
    equal strings always meet in one bucket, at the same offset. Neighbouring
    strings mostly share theirs, and go as one run.
    """

    def __init__(self, span: int, gram: int) -> None:
        self.span, self.gram, self.roll = span, gram, Rolling()

    def of(self, texts: list[bytes], contexts: bool = True):
        """Yields (text index, bucket, context digests, anchor, first start, last start) of the runs of a piece."""
        todo: list[tuple[int, int, bytes]] = []
        size = 0
        for k, t in enumerate(texts):
            step = PIECE - self.span
            for at in range(0, max(1, len(t) - self.span + 1), step):
                piece = t[at : at + step + self.span - 1]
                if len(piece) < self.span:
                    continue
                todo.append((k, at, piece))
                size += len(piece)
                if size >= PIECE:
                    yield self._piece(todo, contexts)
                    todo, size = [], 0
        if todo:
            yield self._piece(todo, contexts)

    def _piece(self, todo, contexts):
        span, gram, roll = self.span, self.gram, self.roll
        raw = b"".join(p for _, _, p in todo)
        text = np.frombuffer(raw, np.uint8)
        ends = np.cumsum([len(p) for _, _, p in todo])
        with np.errstate(over="ignore"):
            sums = roll.sums(text)
            n = len(text) - gram + 1
            h = mix((sums[gram:] - sums[:-gram]) * roll.down[:n])
            key = (h >> POS_BITS << POS_BITS) | np.arange(n, dtype=np.uint64)
            width, want = 1, span - gram + 1
            low = key
            while 2 * width <= want:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            if width < want:
                low = np.minimum(low[: len(low) - (want - width)], low[want - width :])
            starts = np.arange(len(text) - span + 1)
            owner = np.searchsorted(ends, starts, side="right")
            fits = starts + span <= ends[owner]
            anchor = (low & ((np.uint64(1) << POS_BITS) - np.uint64(1))).astype(np.int64)
            starts, owner, anchor = starts[fits], owner[fits], anchor[fits]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(starts)] - 1
            a, i0, i1 = anchor[first], starts[first], starts[last]
        o = owner[first]
        ctx = [digest(raw[i : j + span]) for i, j in zip(i0.tolist(), i1.tolist(), strict=True)] if contexts else None
        base = np.array([at for _, at, _ in todo]) - np.r_[0, ends[:-1]]
        which = np.array([k for k, _, _ in todo])
        shift = base[o]
        return which[o], h[a].view(np.int64), ctx, a + shift, i0 + shift, i1 + shift


def digest(raw: bytes) -> bytes:
    """128 bits that stand for the bytes of a context."""
    return hashlib.blake2b(raw, digest_size=16).digest()


def _words(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one big-endian number."""
    out = np.zeros(len(at), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | text[at + k]
    return out


def _names(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks of the rows of keys, the first key weighing most."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class CoverRanks:
    """Ranks of the cover suffixes of a text to a depth of whole periods, by doubling."""

    def __init__(self, text: np.ndarray, depth: int) -> None:
        v = COVER_PERIOD
        padded = np.r_[text, np.zeros(8 * v + depth, np.uint8)]
        at = np.concatenate([np.arange(c, len(text), v) for c in COVER])
        self.place = np.full(len(text) + depth + v, -1, np.int64)
        self.place[at] = np.arange(len(at))
        rank = {v: _names(*(_words(padded, at + d) for d in (0, 8, 16, v - 8)))}

        def later(r: np.ndarray, d: int) -> np.ndarray:
            p = self.place[at + d]
            return np.where(p >= 0, r[p], -1)

        have = v
        while have < depth:
            step = max(s for s in rank if have + s <= depth)
            rank[have + step] = _names(rank[have], later(rank[step], have))
            have += step
        self.rank = rank[have]

    def at(self, pos: np.ndarray) -> np.ndarray:
        return self.rank[self.place[pos]]


def repeated(text: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For each start, whether its span bytes start anywhere else among starts.

    Sorts the starts by their first COVER_PERIOD bytes and by those after the
    depth of the cover ranks; what still ties is split around pivots by these
    ranks, so no comparison reads the long common part again. The result is
    exact. span is two periods at least.
    """
    v, out = COVER_PERIOD, np.zeros(len(starts), bool)
    depth = (span - v + 1) // v * v
    offsets = (0, 8, 16, v - 8, *range(depth, span - 8, 8), span - 8)
    name = _names(*(_words(text, starts + d) for d in offsets))
    order = np.argsort(name, kind="stable")
    s = name[order]
    tied = np.zeros(len(s), bool)
    tied[1:] = s[1:] == s[:-1]
    tied[:-1] |= tied[1:]
    rows, group = order[tied], s[tied]
    if not len(rows):
        return out
    cover, shifts = CoverRanks(text, depth), _shift_table()
    while len(rows):
        head = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        pivot = starts[rows[np.repeat(head, np.diff(np.r_[head, len(rows)]))]]
        own = starts[rows]
        d = shifts[own % v, pivot % v]
        side = np.sign(cover.at(own + d) - cover.at(pivot + d))
        by = np.lexsort((side, group))
        rows, group, side = rows[by], group[by], side[by]
        new = np.r_[True, (group[1:] != group[:-1]) | (side[1:] != side[:-1])]
        group = np.cumsum(new)
        many = np.bincount(group)[group] > 1
        out[rows[many & (side == 0)]] = True
        more = many & (side != 0)
        rows, group = rows[more], group[more]
    return out
