"""Document quality by co-training: a text view and a page-metadata view teach each other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from twinlake.llm.batches import pieces, segments
from twinlake.llm.suffix_blocks import mix
from twinlake.session import free_names, ship_package, written

#: Labelled documents that a token must occur in to be a feature of the regression, and such tokens at most, the commonest first.
LEAST_DOCS, WORDS = 5, 1 << 15
#: Bits of a token's hash that name its bucket in what a view is taught.
TAUGHT_BITS = 17
#: Numbers of a text that features() gives.
NUMBERS = 9
#: Hashed values of the metadata view.
META_BITS = 12
#: Ranges that a number of the metadata view is cut into.
BINS = 16
#: Squared-weight penalty of each view's regression.
PENALTY = {"text": 1e-3, "meta": 1e-4}
#: A view is sure of a document at this probability of its class.
SURE = 0.9
#: Bytes of text whose tokens are found together; its arrays fit a processor's cache.
PART = 1 << 18
#: (row, feature) pairs that a step of a regression works on together, so that the driver makes no large arrays.
PIECE = 1 << 18

_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters and digits, 2 other signs
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index of each token, token hashes, counts of each text).

    Counts: bytes, capitals, digits, signs, white space, line ends, tokens, bytes of tokens, tokens of signs.
    """
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    kind = _KIND[raw]
    edge = np.r_[True, kind[1:] != kind[:-1]]
    first = np.flatnonzero(edge & (kind > 0))
    last = np.flatnonzero(np.r_[edge[1:], True] & (kind > 0)) + 1
    n = len(texts)
    with np.errstate(over="ignore"):
        if len(first):
            length = last - first
            letters = _LOWER[raw[kind > 0]].astype(np.uint64) + np.uint64(1)
            begin = np.cumsum(length) - length
            power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(length.max()), _BASE)])
            h = mix(np.add.reduceat(letters * power[np.arange(len(letters)) - np.repeat(begin, length)], begin))
        else:
            length, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.searchsorted(ends, first, side="right")
    # of each text, how many of its bytes are of each class; the end that was put to it does not count
    classes = (raw >= 65) & (raw <= 90), (raw >= 48) & (raw <= 57), kind == 2, kind == 0, raw == 10
    of_bytes = [np.add.reduceat(c.view(np.uint8), ends - sizes, dtype=np.int64) - k for c, k in zip(classes, (0, 0, 0, 1, 1))]
    of_tokens = [np.bincount(owner, w, minlength=n) for w in (None, length, kind[first] == 2)]
    return owner, h, np.stack([sizes - 1, *of_bytes, *of_tokens], axis=1).astype(np.float64)


def features(texts: list[bytes], meta: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """(text index of each token, token hashes, numbers of each text, metadata features of each row).

    Tokens are runs of letters and digits, lower case, and runs of other signs.
    Numbers: length, shares of capitals, digits, signs and white space, mean token
    length, share of distinct tokens, lines, share of tokens of signs. Long texts
    are counted by segments.
    """
    parts = [(k, s) for k, t in enumerate(texts) for s in segments(t, PART)]
    found, low, size = [], 0, 0
    for k, (_, s) in enumerate(parts):
        size += len(s)
        if size > PART or k == len(parts) - 1:
            owner, h, counts = _counts([s for _, s in parts[low : k + 1]])
            text = np.array([i for i, _ in parts[low : k + 1]])
            found.append((text[owner], h, text, counts))
            low, size = k + 1, 0
    owner, h, text, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    counts = np.stack([np.bincount(text, c, minlength=len(texts)) for c in counts.T])
    length, capitals, digits, signs, white, lines, many, token_bytes, sign_tokens = counts
    short = np.uint64(20)  # enough to count the distinct tokens of one text
    distinct = np.unique(owner.astype(np.uint64) << short | h >> np.uint64(44))
    distinct = np.bincount((distinct >> short).astype(np.int64), minlength=len(texts))
    share = [x / np.maximum(1, length) for x in (capitals, digits, signs, white + 1)]
    per_token = [x / np.maximum(1, many) for x in (token_bytes, distinct, sign_tokens)]
    numbers = np.stack([np.log1p(length), *share, *per_token[:2], np.log1p(lines + 1), per_token[2]], axis=1)
    hashed = []
    for row in meta:
        keys = [f"{k}={v}".encode() for k, v in enumerate(row)]
        whole = [int.from_bytes(hashlib.blake2b(k, digest_size=8).digest(), "little") for k in keys]
        hashed.append((np.array(whole, np.uint64) >> np.uint64(64 - META_BITS)).astype(np.int32))
    return owner, h, numbers, hashed


def _meta_rows(hashed: list[np.ndarray], numbers: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    """Features of the metadata view: hashed values, then the range of each number."""
    ranges = np.stack([np.searchsorted(e, numbers[:, k], side="right") for k, e in enumerate(edges)], axis=1)
    at = (1 << META_BITS) + np.arange(len(edges)) * (BINS + 1) + ranges
    return [np.r_[h, a].astype(np.int32) for h, a in zip(hashed, at, strict=True)]


def _flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows), dtype=np.int32), sizes), np.concatenate([*rows, np.zeros(0, np.int32)])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """Logistic regression on present features, each scaled by its log odds ratio in the sample."""

    w: np.ndarray
    b: float

    @staticmethod
    def fit(
        r: np.ndarray, c: np.ndarray, width: int, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 300
    ) -> Linear:
        """Full-batch Adam from zero on (row, feature) pairs; the sample is bounded, so this runs on the driver."""
        n = len(y)
        weight = weight * np.where(y > 0, 0.5 / (weight * y).sum(), 0.5 / (weight * (1 - y)).sum())
        many = max(1, int(y.sum())), max(1, int(n - y.sum()))
        pieces = [slice(k, k + PIECE) for k in range(0, len(r), PIECE)]

        def by_row(values: np.ndarray) -> np.ndarray:
            return sum((np.bincount(r[s], values[c[s]], minlength=n) for s in pieces), np.zeros(n))

        def by_feature(values: np.ndarray) -> np.ndarray:
            return sum((np.bincount(c[s], values[r[s]], minlength=width) for s in pieces), np.zeros(width))

        good = (by_feature(y) + 0.5) / (many[0] + 1)
        bad = (by_feature(1 - y) + 0.5) / (many[1] + 1)
        scale = np.abs(np.log(good / bad))
        w, b = np.zeros(width), 0.0
        m, v, mb, vb = np.zeros(width), np.zeros(width), 0.0, 0.0
        for k in range(1, steps + 1):
            p = _sigmoid(by_row(w * scale) + b)
            g = (p - y) * weight
            gw, gb = by_feature(g) * scale + penalty * w, g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            fix = np.sqrt(1 - 0.999**k) / (1 - 0.9**k) * 0.05
            w -= fix * m / (np.sqrt(v) + 1e-9)
            b -= fix * mb / (np.sqrt(vb) + 1e-9)
        return Linear(w * scale, float(b))

    def logits(self, r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(r, self.w[c], minlength=n) + self.b


def _platt(z: np.ndarray, y: np.ndarray, columns: int) -> np.ndarray:
    """Weights and bias of a logistic fit of y on the columns of z, by Newton steps."""
    x = np.c_[z.reshape(len(y), columns), np.ones(len(y))]
    t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    w = np.zeros(columns + 1)
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(columns + 1), x.T @ (p - t) + 1e-3 * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Views:
    """Two classifiers, what each was taught, their calibrations and their combination.

    A view has two scores: its regression on the labelled documents, and what it
    was taught: the mean of the log odds of a document's features among those that
    the other view was sure of. platt weighs both,
    so the weight of what was taught comes from labelled documents held back.
    """

    words: np.ndarray
    text: Linear
    meta: Linear
    edges: np.ndarray
    taught: tuple[np.ndarray, np.ndarray]
    platt: tuple[np.ndarray, np.ndarray]
    both: np.ndarray

    def scores(self, owner, h, numbers, hashed) -> list[np.ndarray]:
        """Of the text and the metadata view: a row a document of (regression, taught)."""
        n = len(hashed)
        r, c = _flat(_meta_rows(hashed, numbers, self.edges))
        out = []
        buckets = (h >> np.uint64(64 - TAUGHT_BITS)).astype(np.int64)
        for plain, at, f, odds in (
            (self.text.logits(*among(owner, h, self.words), n), owner, buckets, self.taught[0]),
            (self.meta.logits(r, c, n), r, c, self.taught[1]),
        ):
            many = np.bincount(at, minlength=n)
            out.append(np.stack([plain, np.bincount(at, odds[f], minlength=n) / (1 + many)], 1))
        return out

    def score(self, owner, h, numbers, hashed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of the text view, the metadata view and both."""
        return self.combined(self.scores(owner, h, numbers, hashed))

    def combined(self, z: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        c = [x @ p[:2] + p[2] for x, p in zip(z, self.platt, strict=True)]
        return _sigmoid(c[0]), _sigmoid(c[1]), _sigmoid(parted(z, self.platt) @ self.both[:4] + self.both[4])


def parted(z: list[np.ndarray], platt: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The calibrated views in their two parts each: the views agree more on what they taught each other, so it gets weights of its own."""
    return np.concatenate([x * p[:2] for x, p in zip(z, platt, strict=True)], 1)


def sure_of(teacher: np.ndarray, pupil: np.ndarray) -> np.ndarray:
    """1 and -1 where the teacher is SURE of good and of bad and the pupil does not lean the other way, else 0."""
    return ((teacher >= SURE) & (pupil >= 0.5)).astype(np.int8) - ((teacher <= 1 - SURE) & (pupil < 0.5))


def log_odds(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Log odds of each feature by its share of all of either class; 0 for what neither has, and where a class has none."""
    g, b = good.sum(), bad.sum()
    if not g or not b:
        return np.zeros(len(good))
    e = 1 / min(g, b)
    return np.log((good / g + e) / (bad / b + e))


def among(owner: np.ndarray, h: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct tokens that are among words, which ascend."""
    if not len(words) or not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
    hit = words[at] == h
    both = np.unique(owner[hit] * len(words) + at[hit])
    return both // len(words), both % len(words)


SCORES = T.StructType([T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "score")])


def _features(b: pa.RecordBatch, text: str, meta: list[str]) -> tuple:
    texts = [(t or "").encode() for t in b.column(text).to_pylist()]
    extra = list(zip(*(b.column(c).to_pylist() for c in meta), strict=True)) if meta else [()] * len(texts)
    return features(texts, extra)


def _score(documents: DataFrame, views: Views, text: str, meta: list[str], keep: list[str]) -> DataFrame:
    """The columns keep of documents, and the scores."""
    shared = documents.sparkSession.sparkContext.broadcast(views)  # a few MB: two models of fixed size

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            new = [pa.array(x) for x in shared.value.score(*_features(b, text, meta))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *new], names=[*keep, *SCORES.names])

    return documents.mapInArrow(work, T.StructType([*(documents.schema[c] for c in keep), *SCORES.fields]))


def _chosen(documents: DataFrame, ids: DataFrame, doc_id: str, text: str, meta: list[str]) -> DataFrame:
    """(doc_id, text, *meta, y) of a bounded set of documents, ids with their classes y, written.

    Of the rows that repeat an id, the one of least text hash stands for it.
    """
    chosen = documents.select(doc_id, text, *meta).join(F.broadcast(ids), doc_id)
    least, row = free_names([doc_id, text, *meta], "least", "row")
    first = F.min(F.struct(F.xxhash64(text).alias(least), text, *meta, "y")).alias(row)
    return written(chosen.groupBy(doc_id).agg(first).select(doc_id, *(F.col(row)[c].alias(c) for c in (text, *meta, "y"))), "cotraining-chosen")


def _vocabulary(chosen: DataFrame, text: str) -> np.ndarray:
    """Hashes of the tokens of LEAST_DOCS of the chosen documents, ascending: counted on the cluster, WORDS at most."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            owner, h, _, _ = _features(b, text, [])
            own = np.unique(np.stack([owner.astype(np.uint64), h]), axis=1)[1]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64))], names=["h"])

    count = chosen.select(text).mapInArrow(work, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_DOCS)
    return np.sort(count.orderBy(F.desc("n"), "h").limit(WORDS).select("h").toArrow()["h"].to_numpy().view(np.uint64))


def _collect(chosen: DataFrame, words: np.ndarray, doc_id: str, text: str, meta: list[str]) -> dict:
    """Features of the chosen documents on the driver: at most WORDS places a document, however long it is."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            owner, h, numbers, hashed = _features(b, text, meta)
            row, place = among(owner, h, words)
            cuts = np.searchsorted(row, np.arange(b.num_rows + 1))
            places = [place[i:j].astype(np.int32) for i, j in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column(doc_id), b.column("y")]
                + [pa.array([x.tobytes() for x in col], pa.binary()) for col in (places, numbers, hashed)],
                names=["doc_id", "y", "places", "numbers", "hashed"],
            )

    got = chosen.mapInArrow(work, "doc_id long, y double, places binary, numbers binary, hashed binary").toArrow()
    got = got.sort_by([("doc_id", "ascending")])
    read = lambda c, kind: [np.frombuffer(x, kind) for x in got[c].to_pylist()]
    return {
        "id": got["doc_id"].to_numpy(),
        "y": got["y"].to_numpy(),
        "places": read("places", np.int32),
        "numbers": np.array(read("numbers", np.float64)).reshape(len(got), NUMBERS),
        "hashed": read("hashed", np.int32),
    }


def _taught(documents: DataFrame, views: Views, own: np.ndarray, doc_id: str, text: str, meta: list[str]) -> tuple[np.ndarray, np.ndarray, dict]:
    """What either view is to be taught, in one pass over all documents but those of the ids own.

    Each view labels all that it is sure of for the other (sure_of); the other's
    features of these are counted by class, a task its own and then all, so the
    driver gets a row a feature. Also how many documents were labelled, by (pupil, class).
    """
    shared = documents.sparkSession.sparkContext.broadcast((views, own))
    sizes = (1 << TAUGHT_BITS), (1 << META_BITS) + len(views.edges) * (BINS + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, labelled = shared.value
        # a place behind the features counts the documents
        sums = [np.zeros((2, n + 1), np.int64) for n in sizes]
        for b in pieces(batches, text):
            owner, h, numbers, hashed = _features(b, text, meta)
            p_text, p_meta, _ = model.score(owner, h, numbers, hashed)
            ids = b.column(doc_id)
            new = ~np.isin(ids.fill_null(0).to_numpy(), labelled) | ids.is_null().to_numpy(zero_copy_only=False)
            r, c = _flat(_meta_rows(hashed, numbers, model.edges))
            for view, (said, at, f) in enumerate((
                (sure_of(p_meta, p_text), owner, (h >> np.uint64(64 - TAUGHT_BITS)).astype(np.int64)),
                (sure_of(p_text, p_meta), r, c),
            )):
                for side, sign in enumerate((1, -1)):
                    chosen = new & (said == sign)
                    sums[view][side, :-1] += np.bincount(f[chosen[at]], minlength=sizes[view])
                    sums[view][side, -1] += chosen.sum()
        for view, s in enumerate(sums):
            k = np.flatnonzero(s.any(0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), view)), pa.array(k), pa.array(s[0, k]), pa.array(s[1, k])], names=["view", "k", "good", "bad"])

    some = documents.select(F.col(doc_id).cast("long").alias(doc_id), text, *meta).mapInArrow(work, "view long, k long, good long, bad long")
    got = some.groupBy("view", "k").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).toArrow()
    view, k, good, bad = (got[c].to_numpy() for c in ("view", "k", "good", "bad"))
    out, many = [], {}
    for v, n in enumerate(sizes):
        g, w = np.zeros(n + 1), np.zeros(n + 1)
        g[k[view == v]], w[k[view == v]] = good[view == v], bad[view == v]
        many[("text", "meta")[v]] = int(g[-1]), int(w[-1])
        out.append(log_odds(g[:-1], w[:-1]))
    return *out, many


def _own_scores(chosen: DataFrame, views: Views, doc_id: str, text: str, meta: list[str]) -> list[np.ndarray]:
    """scores() of the chosen documents by ascending id."""
    shared = chosen.sparkSession.sparkContext.broadcast(views)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            z = shared.value.scores(*_features(b, text, meta))
            yield pa.RecordBatch.from_arrays([b.column(doc_id), *(pa.array(x) for v in z for x in v.T)], names=["id", "a", "b", "c", "d"])

    got = chosen.mapInArrow(work, "id long, a double, b double, c double, d double").toArrow().sort_by([("id", "ascending")])
    a, b, c, d = (got[x].to_numpy() for x in "abcd")
    return [np.stack([a, b], 1), np.stack([c, d], 1)]


def train(
    documents: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    meta: tuple[str, ...] = ("source", "lang"),
    rounds: int = 2,
    labelled: int = 12_000,
) -> Views | None:
    """Co-trains the two views; None where the labels hold fewer than two classes.

    labels (doc_id, quality, toxic): a document is good if its quality is 1 and
    it is not toxic. At most `labelled` labelled ids that documents holds, those
    of the least hashes, are used, a fifth of them for calibration; an id on
    several rows is learnt from the one of least text hash. Each view is a
    regression on these. In each round both views look at the whole corpus, and
    each labels every other document that it is SURE of for the other, unless
    that one leans the other way. These are as many as there are; the pupil
    learns from the counts of their features, and the weight of that beside its
    regression is fitted on the labelled documents held back for calibration.
    """
    spark = documents.sparkSession
    ship_package(spark)
    meta = list(meta)
    good = (F.min("quality") >= 1) & (F.max(F.coalesce("toxic", F.lit(0))) < 1)
    known = labels.where(F.col(doc_id).isNotNull() & F.col("quality").isNotNull()).groupBy(doc_id).agg(good.cast("double").alias("y"))
    known = written(known, "cotraining-known", rows=labels.count())
    present = documents.select(doc_id).distinct()
    sample = known.join(present, doc_id, "left_semi").orderBy(F.xxhash64(F.col(doc_id), F.lit("sample")), doc_id).limit(labelled)
    chosen = _chosen(documents, sample, doc_id, text, meta)
    words = _vocabulary(chosen, text)
    base = _collect(chosen, words, doc_id, text, meta)
    if len(set(base["y"].tolist())) < 2:
        return None
    with np.errstate(over="ignore"):
        held = mix(base["id"].astype(np.uint64) + _BASE) % np.uint64(5) == 0
    if len(set(base["y"][held].tolist())) < 2 or len(set(base["y"][~held].tolist())) < 2:
        held = np.zeros(len(held), bool)
    fit, check = np.flatnonzero(~held), np.flatnonzero(held) if held.any() else np.arange(len(held))
    edges = np.quantile(base["numbers"][fit], np.arange(1, BINS + 1) / (BINS + 1), axis=0).T
    width = {"text": len(words), "meta": (1 << META_BITS) + len(edges) * (BINS + 1)}

    def one(view: str) -> Linear:
        rows = base["places"] if view == "text" else _meta_rows(base["hashed"], base["numbers"], edges)
        return Linear.fit(*_flat([rows[i] for i in fit]), width[view], base["y"][fit], np.ones(len(fit)), PENALTY[view])

    none = np.zeros(1 << TAUGHT_BITS), np.zeros(width["meta"])
    views = Views(words, one("text"), one("meta"), edges, none, (np.array([1.0, 0.0, 0.0]),) * 2, np.array([1.0, 1.0, 1.0, 1.0, 0.0]))

    def calibrate(views: Views) -> None:
        y = base["y"][check]
        z = [x[check] for x in _own_scores(chosen, views, doc_id, text, meta)]
        views.platt = tuple(_platt(x, y, 2) for x in z)
        views.both = _platt(parted(z, views.platt), y, 4)

    calibrate(views)
    for _ in range(rounds):
        *taught, _ = _taught(documents, views, base["id"], doc_id, text, meta)
        views = Views(words, views.text, views.meta, edges, tuple(taught), views.platt, views.both)
        calibrate(views)
    return views


def quality_scores(
    documents: DataFrame, labels: DataFrame, threshold: float = 0.5, text: str = "text", **options
) -> DataFrame:
    """documents with p_text, p_meta, score and kept.

    The scores are calibrated probabilities that a document is good, by its
    text, by its metadata and by both; kept says that the last reaches threshold.
    See train() for how the views are fitted.

    A null or empty text has no tokens and is scored by what else is known.
    Null metadata is a value of its own. Rows that repeat are scored alike. With
    labels of fewer than two classes there is nothing to learn: scores are null
    and everything is kept. Other columns pass through; those named as new ones
    are replaced. An empty table gives an empty table.
    """
    new = [*SCORES.names, "kept"]
    documents = documents.drop(*new)
    views = train(documents, labels, text=text, **options)
    if views is None:
        return documents.select("*", *(F.lit(None).cast("double").alias(c) for c in SCORES.names), F.lit(True).alias("kept"))
    out = _score(documents, views, text, list(options.get("meta", ("source", "lang"))), documents.columns)
    return out.withColumn("kept", F.col("score") >= threshold)


def op10_cotraining(spark, sf_dir: str) -> DataFrame:
    """Scores and verdicts of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    out = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", *SCORES.names, "kept")
