"""Main text of web pages: boosted trees label the nodes, and one least-cost labelling of the tree is taken."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from twinlake.llm.batches import pieces, release
from twinlake.llm.boosting import Trees, boost, log_softmax
from twinlake.llm.dom import CODE, OTHER, Page
from twinlake.llm.layouts import labelled_page
from twinlake.session import free_names, ship_package

#: Labels of nodes: both kinds of text below it, main text only, none of the main text.
MIXED, MAIN, REST = range(3)
#: Pages learnt from, and tokens of attributes that are features.
PAGES, TOKENS = 2500, 320
#: Nodes scored at once; characters of pages read at once.
NODES, GROUPS = 1 << 15, OTHER + 1
PARAGRAPH, LI = CODE["p"], CODE["li"]


class Layout:
    """The nodes of some pages as arrays; runs that are all that their element has stand for it."""

    def __init__(self, pages: list[Page]):
        sizes = [len(p.tag) for p in pages]
        self.start = np.r_[0, np.cumsum(sizes)].astype(np.int64)
        n = int(self.start[-1])
        of = lambda name: np.fromiter((v for p in pages for v in getattr(p, name)), np.int64, n)
        shift = np.repeat(self.start[:-1], sizes)
        self.tag, self.depth = of("tag"), of("depth")
        self.end = of("end") + shift
        self.parent = of("parent")
        self.root = self.parent < 0
        self.parent = np.where(self.root, np.arange(n), self.parent + shift)
        self.tokens = [t for p in pages for t in p.tokens]
        self.run = np.zeros(n, bool)
        self.own = np.zeros((n, 7))
        self.marked = np.zeros(n)
        for at, p in zip(self.start, pages, strict=False):
            for r, t in p.text.items():
                self.run[at + r] = True
                words = len(t.split())
                self.own[at + r] = (len(t.strip()), words, p.links[r], sum(map(t.count, ",.;:!?")), sum(map(str.isdigit, t)), t.count("©") + t.count("|") + t.count("·"), words > 0)
                self.marked[at + r] = p.marked.get(r, 0)
        # elements with children that are no runs
        self.branch = np.zeros(n, bool)
        self.branch[self.parent[~self.run & ~self.root]] = True
        self.alias = np.where(self.run & ~self.branch[self.parent], self.parent, np.arange(n))
        self.scored = ~self.run | self.branch[self.parent]

    def sums(self, v: np.ndarray) -> np.ndarray:
        """Of each node and all below it."""
        c = np.concatenate([np.zeros((1, *v.shape[1:])), v.cumsum(0)])
        return c[self.end] - c[:-1]

    def numbers(self) -> np.ndarray:
        """Density, size, depth and siblings of each node."""
        n = len(self.tag)
        total = self.sums(self.own)
        elements = self.sums((~self.run).astype(float))
        chars, words, links, marks, digits, signs, runs = total.T
        paragraph = self.sums((self.tag == PARAGRAPH).astype(float))
        page = np.searchsorted(self.start, np.arange(n), side="right") - 1
        whole = chars[self.start[page]]
        before = np.r_[0.0, self.own[:, 0].cumsum()][:-1]
        before = before - before[self.start[page]]
        each = np.maximum(chars, 1)
        # siblings: by place among the children that are scored
        k = np.flatnonzero(self.scored & ~self.root)
        order = k[np.lexsort((k, self.parent[k]))]
        up = self.parent[order]
        first = np.r_[True, up[1:] != up[:-1]] if len(up) else np.zeros(0, bool)
        head = np.flatnonzero(first)
        count = np.diff(np.r_[head, len(order)])
        place = np.arange(len(order)) - np.repeat(head, count)
        size = np.repeat(count, count)
        side = np.zeros((n, 8))
        side[order, 0], side[order, 1] = place, size
        for column, step in ((2, -1), (5, 1)):
            other = np.roll(order, -step)
            fine = (place + step >= 0) & (place + step < size)
            other = np.where(fine, other, -1)
            side[order, column] = np.where(fine, np.log1p(chars[other]), -1)
            side[order, column + 1] = np.where(fine, links[other] / each[other], -1)
            side[order, column + 2] = np.where(fine, self.tag[other] == self.tag[order], -1)
        up = self.parent
        return np.column_stack([
            np.log1p(chars), np.log1p(words), links / each, marks / each, digits / each, np.minimum(signs, 9), np.log1p(runs), chars / (elements + 1),
            words / np.maximum(runs, 1), chars / each / np.maximum(words, 1) * chars, np.log1p(paragraph), np.log1p(elements), np.minimum(self.depth, 60),
            chars / np.maximum(whole, 1), before / np.maximum(whole, 1), chars / np.maximum(chars[up], 1), np.log1p(chars[up]), links[up] / each[up],
            np.log1p(paragraph[up]), np.log1p(whole), self.branch, side,
        ])

    def flags(self, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(node, flag) pairs: tags and tokens of the node, of its parent and of any ancestor."""
        width, none = len(vocabulary), np.zeros(0, np.int64)
        inherited: list[np.ndarray] = []
        rows, columns = [], []
        known = {t: np.array(sorted(vocabulary[w] for w in t if w in vocabulary), np.int64) for t in set(self.tokens)}
        up, tag, root = self.parent.tolist(), self.tag.tolist(), self.root.tolist()
        shared: dict = {}
        for k in range(len(tag)):
            # what a node hands on: its tags and tokens, and those it was handed; equal sets are kept once
            own = known[self.tokens[k]]
            above = none if root[k] else inherited[up[k]]
            at = (above.tobytes(), tag[k], own.tobytes())
            if at not in shared:
                shared[at] = np.unique(np.r_[above, tag[k], GROUPS + own])
            inherited.append(shared[at])
            if self.scored[k]:
                flags = np.r_[tag[k], 2 * GROUPS + own, GROUPS + (GROUPS - 1 if root[k] else tag[up[k]]), 2 * GROUPS + width + above]
                rows.append(np.full(len(flags), k))
                columns.append(flags)
        return (np.concatenate(rows), np.concatenate(columns)) if rows else (none, none)


def flag_width(vocabulary: dict[str, int]) -> int:
    return 3 * GROUPS + 2 * len(vocabulary)


@dataclass
class Extractor:
    trees: Trees
    vocabulary: dict[str, int]

    def costs(self, layout: Layout) -> np.ndarray:
        """Minus log probabilities of the labels of the nodes that are scored."""
        n = len(layout.tag)
        out = np.zeros((n, 3))
        numbers, (row, column) = layout.numbers(), layout.flags(self.vocabulary)
        for at in range(0, n, NODES):
            low, high = np.searchsorted(row, (at, at + NODES))
            flags = np.zeros((min(NODES, n - at), flag_width(self.vocabulary)), bool)
            flags[row[low:high] - at, column[low:high]] = True
            k = np.flatnonzero(layout.scored[at : at + NODES])
            out[at + k] = -log_softmax(self.trees.log_odds(numbers[at : at + NODES][k], flags[k]))
        return out

    def texts(self, htmls: list[str | None]) -> list[str]:
        """Main texts of pages."""
        pages = [Page(h or "") for h in htmls]
        layout = Layout(pages)
        label = decode(layout, self.costs(layout))
        kept = (label[layout.alias] == MAIN).tolist()
        return [p.join(kept[a:b]) for p, a, b in zip(pages, layout.start[:-1].tolist(), layout.start[1:].tolist(), strict=True)]


def decode(layout: Layout, costs: np.ndarray) -> np.ndarray:
    """The labelling of least cost in which nothing below REST is kept and nothing below MAIN is MIXED.

    Below MAIN a part can be REST (an advert in an article). Nodes without
    children are not MIXED. Costs go up the tree once, labels down it once.
    """
    n = len(layout.tag)
    cost = [c.tolist() for c in costs.T]
    text = layout.sums(layout.own[:, 0]).tolist()
    branch, scored, root, up = layout.branch.tolist(), layout.scored.tolist(), layout.root.tolist(), layout.parent.tolist()
    mixed, main, rest = cost
    for k in range(n - 1, -1, -1):
        if not scored[k] or not text[k]:
            continue
        if not branch[k]:
            # of a leaf only the two count: they are all that it can be
            mixed[k] = float("inf")
        if root[k]:
            continue
        p = up[k]
        a, b, c = mixed[k], main[k], rest[k]
        best = b if b < c else c
        mixed[p] += a if a < best else best
        main[p] += best
        rest[p] += c
    label = [REST] * n
    for k in range(n):
        if not scored[k] or not text[k]:
            continue
        above = MIXED if root[k] else label[up[k]]
        if above == REST:
            continue
        if above == MIXED and mixed[k] < main[k] and mixed[k] < rest[k]:
            label[k] = MIXED
        elif main[k] < rest[k]:
            label[k] = MAIN
    return np.array(label, np.int8)


@lru_cache(2)
def learn(pages: int = PAGES, tokens: int = TOKENS, rounds: int = 60, depth: int = 6, rate: float = 0.2) -> Extractor:
    """An extractor from so many labelled pages, laid out at random from fixed seeds; the same on every call."""
    found = [Page(labelled_page(k)) for k in range(pages)]
    layout = Layout(found)
    count = Counter(w for t in layout.tokens for w in t)
    vocabulary = {w: k for k, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0]))[:tokens])}
    chars, main = layout.sums(layout.own[:, 0]), layout.sums(layout.marked)
    some = layout.sums((layout.own[:, 0] > 0) & (layout.marked == 0)) > 0
    y = np.where(main == 0, REST, np.where(some, MIXED, MAIN))
    # items of menus are most of all nodes and much alike: one in five is enough
    dull = (layout.tag == LI) & (y == REST) & (np.arange(len(y)) % 5 > 0)
    use = np.flatnonzero(layout.scored & (chars > 0) & ~dull)
    row, column = layout.flags(vocabulary)
    flags = np.zeros((len(layout.tag), flag_width(vocabulary)), bool)
    flags[row, column] = True
    return Extractor(boost(layout.numbers()[use], flags[use], y[use], 3, rounds, depth, rate), vocabulary)


def extract_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """pages, without the html, with the main text of each.

    The extractor learns on the driver from pages laid out at random (learn());
    no row of the table is needed for it. Each page is read whole, in the task
    that has it: nothing is shuffled. Character references are decoded, white
    space inside a block is one space, and blocks are joined by one. A null or
    empty page has an empty text, as has one without main text; pages that end
    early or nest badly are read as far as they go. Rows that repeat come back
    as often. A column named as the text is replaced, others pass through.
    """
    spark = pages.sparkSession
    ship_package(spark)
    shared = spark.sparkContext.broadcast(learn())
    keep = [c for c in pages.columns if c.lower() not in (html.lower(), text.lower())]
    (body,) = free_names([*keep, text], "body")
    out = pages.select(*keep, F.col(html).cast("string").alias(text))
    given = pages.select(*keep, F.col(html).cast("string").alias(body))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in pieces(batches, body):
            texts = model.texts(b.column(body).to_pylist())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text])
        release()

    return given.mapInArrow(work, out.schema)


def op11_html_extract(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    t = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return t.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
