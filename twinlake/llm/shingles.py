"""Hashed word shingles, ProbMinHash signatures and exact probability Jaccard, in numpy."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from twinlake.llm.batches import TOGETHER, segments
from twinlake.llm.suffix_blocks import mix

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _GOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _long_word(raw: bytes) -> np.uint64:
    """What word_hashes sums for one word, a piece at a time."""
    total = np.uint64(0)
    for at in range(0, len(raw), TOGETHER):
        piece = np.frombuffer(raw, np.uint8)[at : at + TOGETHER].astype(np.uint64) + np.uint64(1)
        power = np.multiply.accumulate(np.r_[np.uint64(pow(int(_BASE), at, 1 << 64)), np.full(len(piece) - 1, _BASE)])
        total += (piece * power).sum(dtype=np.uint64)
    return total


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of each word between ASCII white space, in order; so much memory for any length."""
    out = [np.zeros(0, np.uint64)]
    with np.errstate(over="ignore"):
        for part in segments(text):
            if len(part) > 2 * TOGETHER:  # hardly any white space
                words = part.split()
                h = np.array([_long_word(w) for w in words], np.uint64)
                size = np.array([len(w) for w in words], np.uint64)
            else:
                raw = np.frombuffer(part + b"\n", np.uint8)
                space = _SPACE[raw]
                first = np.flatnonzero(~space & np.r_[True, space[:-1]])
                if not len(first):
                    continue
                size = np.flatnonzero(space & np.r_[False, ~space[:-1]]) - first
                begin = np.cumsum(size) - size
                place = np.arange(int(size.sum())) - np.repeat(begin, size)
                power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(size.max()), _BASE)])
                h = np.add.reduceat((raw[~space].astype(np.uint64) + np.uint64(1)) * power[place], begin)
            out.append(mix(h + size.astype(np.uint64)))
    return np.concatenate(out)


def weighted_shingles(texts: Sequence[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, shingle, occurrences), by text and shingle.

    Words lie between ASCII white space. A text with fewer words than a shingle
    takes has one shingle of all of them, a text without words has none.
    """
    # short texts are hashed together, the ends of each being told by its count of words
    joined = word_hashes(b"\n".join(texts))
    count = np.array([len(t.split()) for t in texts], np.int64)
    if not len(joined):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        owner = np.repeat(np.arange(len(texts)), count)
        held = np.minimum(count, words)  # words of a shingle of this text
        at = np.arange(len(joined)) - np.repeat(np.cumsum(count) - count, count)
        heads = np.flatnonzero(at <= (count - held)[owner])
        gram = held[owner[heads]].astype(np.uint64) * _GOLD
        for k in range(words):
            inside = k < held[owner[heads]]
            nxt = np.where(inside, joined[np.minimum(heads + k, len(joined) - 1)], np.uint64(0))
            gram = mix(gram * _BASE + nxt)
    doc = owner[heads]
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])])
    return doc[new], gram[new], np.diff(np.r_[new, len(doc)])


def prob_min_hash(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, size: int) -> np.ndarray:
    """(n, size) ProbMinHash signatures; rows of texts without shingles are zero.

    Every element is a Poisson process of its weight whose points fall on random
    registers; a register keeps the element of its earliest point. Points come in
    order of time, and an element stops as soon as its next point is later than
    the latest register of its text: it can change nothing any more.
    """
    low = np.full(n * size, _FULL)
    owner, key, w = doc.astype(np.int64), shingle, weight.astype(np.float64)
    own = key & np.uint64(0xFFFFFFFF)
    time = np.zeros(len(key))
    latest = np.full(n, np.inf)
    k = 0
    with np.errstate(over="ignore"):
        while len(key):
            k += 1
            point = mix(key + np.uint64(k) * _GOLD)
            u = ((point >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
            time = time - np.log(u) / w
            alive = time < latest[owner]
            if not alive.all():
                owner, key, w, own, time, point = (x[alive] for x in (owner, key, w, own, time, point))
            register = (mix(point ^ _BASE) % np.uint64(size)).astype(np.int64)
            stamp = time.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32) | own
            np.minimum.at(low, owner * size + register, stamp)
            if k < 8 or k % 4 == 0:
                some = np.unique(owner)
                times = (low.reshape(n, size)[some] >> np.uint64(32)).astype(np.uint32).max(1)
                latest[some] = np.where(times == 0xFFFFFFFF, np.inf, times.view(np.float32) * (1 + 1e-6))
    out = (low & np.uint64(0xFFFFFFFF)).astype(np.uint32).reshape(n, size)
    out[np.bincount(doc, minlength=n) == 0] = 0
    return out


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum over common i of 1 / sum over j of max(x_j / x_i, y_j / y_i), for (shingles ascending, weights) of two texts."""
    keys = np.union1d(a[0], b[0])
    x, y = np.zeros(len(keys)), np.zeros(len(keys))
    x[np.searchsorted(keys, a[0])] = a[1]
    y[np.searchsorted(keys, b[0])] = b[1]
    if not len(keys):
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right") - 1
    before, after = np.cumsum(x)[upto], y.sum() - np.cumsum(y)[upto]
    both = (x > 0) & (y > 0)
    return float((1 / (before[both] / x[both] + after[both] / y[both])).sum())
