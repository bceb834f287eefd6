"""A tolerant reader of HTML: a page as flat lists of nodes in document order."""

from __future__ import annotations

import html
import re
from functools import lru_cache

# ---- fixed values: elements of HTML by how they are read ----
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noframes noscript xmp".split())
#: Elements without text of their own: what stands in them is no text of the page.
MUTE = RAW | frozenset("head template svg math canvas audio video object applet map select datalist button".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table caption thead tbody tfoot tr td th ul".split()
)
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third stands between them.
ENDS = {
    "li": ("li", "ul ol menu dir"), "dd": ("dd dt", "dl"), "dt": ("dd dt", "dl"), "tr": ("tr", "table thead tbody tfoot"),
    "td": ("td th", "tr table"), "th": ("td th", "tr table"), "thead": ("thead tbody tfoot", "table"),
    "tbody": ("thead tbody tfoot", "table"), "tfoot": ("thead tbody tfoot", "table"),
}
FENCE = frozenset("table td th caption html body".split())
TAGS = (
    "#text html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li nav header footer aside form table tbody tr td th "
    "blockquote pre figure figcaption dl dt dd span a"
).split()
# ---- end of fixed values ----

CODE = {t: k for k, t in enumerate(TAGS)}
OTHER = len(TAGS)
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>""")
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Stands before text of the main part in labelled pages.
MARK = "\ue000"


@lru_cache(1 << 14)
def _tokens(attrs: str) -> frozenset[str]:
    """Words of the class, id and role attributes, in lower case."""
    found = [next(filter(None, m.groups()[1:]), "") for m in _ATTR.finditer(attrs)]
    return frozenset(w.lower() for v in found for w in _WORD.findall(v))


class Page:
    """Nodes in document order: elements that matter for the layout, and runs of text.

    Elements are blocks and what carries a class, an id or a role; other inline
    elements belong to the run they stand in. end is one past a node's last
    descendant. order lists the runs and, as -1, the breaks between blocks. A run
    has its text, characters in links and, in labelled pages, those of the main part.
    """

    def __init__(self, page: str):
        self.tag: list[int] = []
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.end: list[int] = []
        self.tokens: list[frozenset[str]] = []
        self.text: dict[int, str] = {}
        self.links: dict[int, int] = {}
        self.marked: dict[int, int] = {}
        self.order: list[int] = []
        self._read(page)

    def _open(self, tag: int, parent: int, tokens: frozenset[str]) -> int:
        k = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tokens.append(tokens)
        self.end.append(-1)
        return k

    def _read(self, page: str) -> None:
        none = frozenset()
        # open elements as (name, node or -1, mute); node is the innermost that is listed
        names, nodes = ["#root"], [self._open(OTHER, -1, none)]
        at_name: dict[str, list[int]] = {}
        fences, blocks = [], []
        mute = links = 0
        run, parts, linked = -1, [], 0

        def finish_run() -> None:
            nonlocal run, parts, linked
            if run >= 0:
                t = "".join(parts)
                if MARK in t:
                    self.marked[run] = sum(len(x) for x in parts if MARK in x)
                    t = t.replace(MARK, "")
                self.text[run], self.links[run] = t, linked
                self.end[run] = run + 1
            run, parts, linked = -1, [], 0

        def brk() -> None:
            finish_run()
            if self.order and self.order[-1] >= 0:
                self.order.append(-1)

        def pop() -> None:
            nonlocal mute, links
            name, node = names.pop(), nodes.pop()
            k = len(names)
            at_name[name].pop()
            if fences and fences[-1] == k:
                fences.pop()
            if blocks and blocks[-1] == k:
                blocks.pop()
            mute -= name in MUTE
            links -= name == "a"
            if nodes[-1] != node:
                finish_run()
                self.end[node] = len(self.tag)
            if name in BLOCK:
                brk()

        def close(name: str, above: int) -> None:
            """Ends the innermost open element of a name, if it stands higher than above."""
            held = at_name.get(name)
            if held and held[-1] > above:
                k = held[-1]
                while len(names) > k:
                    pop()

        def say(text: str) -> None:
            nonlocal run, linked
            if mute and names[-1] == "head" and not text.isspace():
                pop()
            if mute:
                return
            t = html.unescape(text) if "&" in text else text
            if run < 0:
                if t.isspace():
                    if self.order and self.order[-1] >= 0:
                        # white space between inline nodes belongs to the words around it
                        self.text[self.order[-1]] += " "
                    return
                run = self._open(0, nodes[-1], none)
                self.order.append(run)
            parts.append(t)
            if links:
                linked += len(t)

        at, n = 0, len(page)
        while at < n:
            low = page.find("<", at)
            if low < 0:
                say(page[at:])
                break
            if low > at:
                say(page[at:low])
            nxt = page[low + 1 : low + 2]
            if nxt == "!" or nxt == "?":
                if page.startswith("<!--", low):
                    stop = page.find("-->", low + 4) if not page.startswith("<!-->", low) else low + 2
                    at = n if stop < 0 else stop + 3
                else:
                    stop = page.find(">", low)
                    at = n if stop < 0 else stop + 1
                continue
            if not (nxt.isascii() and nxt.isalpha()) and not (nxt == "/" and page[low + 2 : low + 3].isalpha()):
                say("<")
                at = low + 1
                continue
            m = _TAG.match(page, low)
            if m:
                at, name, attrs, closing = m.end(), m[2].lower(), m[3], m[1]
            else:  # a quote that nothing closes
                stop = page.find(">", low)
                if stop < 0:
                    break
                head = page[low + 1 : min(stop, low + 64)].lstrip("/").split(None, 1)
                at, name, attrs, closing = stop + 1, head[0].lower() if head else "", "", "/" if nxt == "/" else ""
            if closing:
                if name == "br":
                    say(" ")
                elif name in BLOCK:
                    if name == "p" and not at_name.get("p"):
                        brk()
                    close(name, -1 if name in FENCE else (fences[-1] if fences else -1))
                else:
                    close(name, blocks[-1] if blocks else -1)
                continue
            if names[-1] == "head" and name not in IN_HEAD:
                pop()
            if name in ("html", "body") and at_name.get(name):
                continue
            if name in VOID:
                if name == "br" and run >= 0:
                    parts.append(" ")
                elif name in ("br", "hr"):
                    brk()
                continue
            if name in RAW:
                stop = re.compile(f"</{name}[\\s/>]", re.I).search(page, at)
                stop = page.find(">", stop.start()) if stop else -1
                at = n if stop < 0 else stop + 1
                continue
            block = name in BLOCK
            if block:
                close("p", fences[-1] if fences else -1)
                if name in ENDS:
                    ended, kept = ENDS[name]
                    above = max((at_name[x][-1] for x in kept.split() if at_name.get(x)), default=-1)
                    for x in ended.split():
                        close(x, above)
                brk()
            tokens = _tokens(attrs) if "=" in attrs else none
            if block or tokens or name in MUTE:
                finish_run()
                node = self._open(CODE.get(name, OTHER), nodes[-1], tokens)
            else:
                node = nodes[-1]
            k = len(names)
            names.append(name)
            nodes.append(node)
            at_name.setdefault(name, []).append(k)
            if name in FENCE:
                fences.append(k)
            if block:
                blocks.append(k)
            mute += name in MUTE
            links += name == "a"
        while len(names) > 1:
            pop()
        finish_run()
        self.end[0] = len(self.tag)
        for r in self.text:
            self.end[r] = r + 1

    def join(self, kept) -> str:
        """The text of the runs r with kept[r]: blocks with single spaces inside and between them."""
        parts = [" " if r < 0 else self.text[r] for r in self.order if r < 0 or kept[r]]
        return " ".join("".join(parts).split())
