"""Labelled pages to learn from: layouts drawn at random, with what is main text marked."""

from __future__ import annotations

import random

from twinlake.llm.dom import MARK

# ---- fixed values: names that pages give to their parts ----
MAIN = (
    "content article post entry story text body main article-body post-content entry-content story-body article__content "
    "main-content page-content content-main post-body article-text blog-post news-item prose markdown-body article-content "
    "body-text entry-body detail reader single-post"
).split()
AROUND = "wrapper container page site outer row col layout inner wrap grid root app shell holder region block clearfix center".split()
MENU = "nav menu navbar navigation main-menu topnav breadcrumb breadcrumbs nav-links pagination pager toolbar tabs sitemap subnav skip-links".split()
HEADER = "header site-header masthead top banner topbar logo branding site-title page-header head hero-bar".split()
FOOTER = "footer site-footer bottom copyright foot legal colophon page-footer footer-links credits".split()
SIDE = "sidebar side aside widget related related-posts recent recommended trending popular rail tags tag-cloud categories archive more-stories secondary blogroll teaser toc".split()
ADVERT = "ad ads advert advertisement sponsored promo banner-ad adsense ad-slot ad-container sponsor dfp commercial promotion affiliate ad-box".split()
NOTICE = "cookie cookie-banner consent gdpr notice alert newsletter subscribe popup modal overlay announcement paywall disclaimer toast warning-bar cookies privacy-notice signup".split()
FORM = "form search search-form login contact-form comment-form respond subscribe-form searchbox".split()
COMMENT = "comments comment comment-list disqus replies discussion reader-comments responses user-comments commentlist comment-body comments-area feedback thread".split()
SHARE = "share social social-links sharing share-buttons follow author-bio byline-links meta-links post-meta tools print-link".split()
LABELS = "Home|About us|Contact|Log in|Read more|Share|Privacy|Terms of use|Next page|Archive|Search|Sign up|Follow us|News|Sport|Help".split("|")
# ---- end of fixed values ----
_SYLLABLES = "an be co du er fi ga ho in jo ka le mi no ou pa que re si ti un ver wi zé äu ch ñe".split()


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.noisy = self.r.random() < 0.15
        self.odd = self.r.choice([0.0, 0.01, 0.03, 0.1])  # share of numbers and signs among words, in all parts alike

    def word(self) -> str:
        if self.r.random() < self.odd:
            return self.r.choice([str(self.r.randint(0, 10 ** self.r.randint(1, 12))), "a@b.example", "10.0.0.1", "+49 30 1234567", "|", "·", "©", "#tag", "$5", "(x)", '"so"', "&lt;b&gt;", "{}", "=", "—"])
        w = "".join(self.r.choice(_SYLLABLES) for _ in range(min(5, 1 + int(self.r.expovariate(0.8)))))
        if self.noisy and self.r.random() < 0.5:
            w += self.r.choice(["***", "###", "%%%", "$$$", "&amp;"])
        return w

    def words(self, n: int) -> str:
        return " ".join(self.word() for _ in range(max(1, n)))

    def prose(self, mean: float = 14, sentences: float = 3) -> str:
        out = []
        for _ in range(1 + int(self.r.expovariate(1 / sentences))):
            s = self.words(2 + int(self.r.expovariate(1 / mean)))
            out.append(s[:1].upper() + s[1:] + self.r.choice([".", ".", ".", "!", "?"]))
        return (", " if self.r.random() < 0.1 else " ").join(out)

    def label(self) -> str:
        return self.r.choice(LABELS) if self.r.random() < 0.5 else self.words(self.r.randint(1, 3))

    def attrs(self, names: list[str], bare: float = 0.3) -> str:
        if self.r.random() < bare:
            return ""
        some = [self.r.choice(names)]
        if self.r.random() < 0.2:
            some.append(self.r.choice(AROUND))
        if self.r.random() < 0.1:
            some.append(f"x{self.r.randint(0, 999)}")
        return f' {"id" if self.r.random() < 0.25 else "class"}="{" ".join(some)}"'

    def pick(self, *tags: str) -> str:
        return self.r.choice(tags)

    def box(self, tag: str, attrs: str, inside: str) -> str:
        return f"<{tag}{attrs}>{inside}</{tag}>"

    # ---- the main text ----

    def inline(self, text: str) -> str:
        words = text.split(" ")
        for _ in range(self.r.randint(0, 2)):
            k = self.r.randrange(len(words))
            t = self.pick("b", "i", "em", "strong", "a", "span", "code")
            words[k] = f'<{t} href="/x">{words[k]}</{t}>' if t == "a" else self.box(t, "", words[k])
        if self.r.random() < 0.1:
            words[0] = f"<b>{words[0]}"
        if self.r.random() < 0.1:
            words.insert(len(words) // 2, "<br>")
        return " ".join(words)

    def main(self, text: str) -> str:
        return MARK + self.inline(text).replace("<br>", f"<br>{MARK}").replace(">", f">{MARK}").replace(f">{MARK}<", "><")

    def paragraph(self) -> str:
        kind = self.r.random()
        if kind < 0.72:
            text = self.prose() if self.r.random() < 0.8 else self.words(self.r.randint(1, 5)) + "."
            return f"<p{self.attrs(['lead', 'intro', 'text', 'first'], 0.93)}>{self.main(text)}{'</p>' if self.r.random() < 0.9 else ''}"
        if kind < 0.8:
            return self.box(self.pick("h2", "h3", "h4"), self.attrs(["title", "subtitle", "heading"], 0.85), self.main(self.words(self.r.randint(2, 7))))
        if kind < 0.88:
            items = "".join(f"<li>{self.main(self.prose(6, 1))}{'</li>' if self.r.random() < 0.8 else ''}" for _ in range(self.r.randint(2, 6)))
            return self.box(self.pick("ul", "ol"), "", items)
        if kind < 0.93:
            return self.box("blockquote", self.attrs(["quote", "pullquote"], 0.7), f"<p>{self.main(self.prose())}</p>")
        if kind < 0.96:
            rows = "".join("<tr>" + "".join(f"<td>{self.main(self.words(2))}</td>" for _ in range(3)) + "</tr>" for _ in range(self.r.randint(2, 5)))
            return self.box("table", self.attrs(["data", "wikitable"], 0.6), rows)
        if kind < 0.98:
            return f"<figure><img src=x><figcaption>{self.main(self.prose(8, 1))}</figcaption></figure>"
        return self.box("pre", "", self.main(self.words(12)))

    def article(self) -> str:
        n = self.r.choice([0, 1, 2, 3, 5, 8, 13, 25])
        parts = [self.paragraph() for _ in range(n)]
        if not parts:
            parts = [f"<p>{self.main(self.prose(5, 1))}</p>"]
        if self.r.random() < 0.15:  # text without paragraphs
            parts = ["<br><br>".join(MARK + self.prose() for _ in range(len(parts)))]
        elif self.r.random() < 0.15:
            parts = [p.replace("<p", "<div").replace("</p>", "</div>") if p.startswith("<p") and p.endswith("</p>") else p for p in parts]
        for _ in range(self.r.choice([0, 0, 1, 1, 2, 3])):
            parts.insert(self.r.randint(1, len(parts)), self.pick(self.advert(), self.share(), self.side("div"), self.notice()))
        head = self.box("h1", self.attrs(["title", "headline", "entry-title"], 0.7), self.main(self.words(self.r.randint(2, 10)))) if self.r.random() < 0.85 else ""
        if self.r.random() < 0.2:
            head = self.box("header", "", head)
        tag = self.pick("article", "article", "article", "div", "div", "main", "section", "td")
        body = head + "".join(parts)
        if tag == "td":
            return f"<table><tr><td{self.attrs(MAIN, 0.5)}>{body}</td></tr></table>"
        if tag == "div" and self.r.random() < 0.8:
            return self.box(tag, self.attrs(MAIN, 0.0), body)
        out = self.box(tag, self.attrs(MAIN, 0.6), body)
        if self.r.random() < 0.25:
            out = self.box("div", self.attrs(MAIN, 0.2), out)
        return self.box("main", self.attrs(MAIN, 0.7), out) if tag != "main" and self.r.random() < 0.2 else out

    # ---- everything else ----

    def links(self, n: int, item: str = "li") -> str:
        return "".join(f'<{item}><a href="/{k}">{self.label()}</a></{item}>' for k in range(n))

    def menu(self) -> str:
        inside = f"<ul>{self.links(self.r.randint(2, 9))}</ul>" if self.r.random() < 0.7 else " | ".join(f"<a href=/>{self.label()}</a>" for _ in range(self.r.randint(2, 8)))
        return self.box("nav", self.attrs(MENU, 0.6), inside) if self.r.random() < 0.6 else self.box(self.pick("div", "ul", "section"), self.attrs(MENU, 0.05), inside)

    def header(self) -> str:
        inside = self.pick(f"<h1>{self.words(2)}</h1>", f'<a href="/">{self.words(2)}</a>', f"<p>{self.prose(5, 1)}</p>", self.words(3)) + (self.menu() if self.r.random() < 0.5 else "")
        return self.box("header", self.attrs(HEADER, 0.5), inside) if self.r.random() < 0.6 else self.box("div", self.attrs(HEADER, 0.0), inside)

    def footer(self) -> str:
        inside = self.pick("&copy; ", "© ", "") + self.pick(self.words(3), f"example.org &middot; {self.prose(8, 2)}", self.prose(8, 2), f"<p>{self.prose(8, 2)}</p>", f"<ul>{self.links(4)}</ul>")
        return self.box("footer", self.attrs(FOOTER, 0.6), inside) if self.r.random() < 0.6 else self.box("div", self.attrs(FOOTER, 0.0), inside)

    def side(self, tag: str | None = None) -> str:
        head = f"<h3>{self.words(2)}</h3>" if self.r.random() < 0.6 else ""
        inside = head + self.pick(f"<ul>{self.links(self.r.randint(2, 8))}</ul>", f"<p>{self.prose()}</p>", "".join(f"<div class=teaser><a href=/>{self.words(6)}</a><p>{self.prose(8, 1)}</p></div>" for _ in range(3)))
        return self.box("aside", self.attrs(SIDE, 0.5), inside) if tag is None and self.r.random() < 0.5 else self.box("div", self.attrs(SIDE, 0.0), inside)

    def advert(self) -> str:
        inside = self.pick(self.prose(7, 2), self.prose(10, 3), f"<a href=/>{self.prose(6, 1)}</a>", f"<p>{self.prose(8, 2)}</p>", f"<b>{self.words(3)}</b> {self.prose(6, 1)}")
        return self.box(self.pick("div", "div", "aside", "section", "span", "p"), self.attrs(ADVERT, 0.0), inside)

    def notice(self) -> str:
        inside = self.pick(f"<p>{self.prose()}</p>", self.prose(10, 2)) + self.pick("<button>OK</button>", "<a href=/>" + self.label() + "</a>", "")
        return self.box(self.pick("div", "section"), self.attrs(NOTICE, 0.0), inside)

    def form(self) -> str:
        inside = f"<label>{self.words(2)}</label><input name=q>" + self.pick("", f"<p>{self.prose(8, 1)}</p>", f"<h3>{self.words(3)}</h3>")
        return self.box("form", self.attrs(FORM, 0.5), inside)

    def comments(self) -> str:
        each = lambda: self.box(self.pick("div", "li", "div", "li", "article"), self.attrs(COMMENT, 0.3), f"<b>{self.words(1)}</b> <span>{self.r.randint(1, 28)}.3.</span><p>{self.prose()}</p><a href=/>Reply</a>")
        inside = f"<h3>{self.words(2)}</h3>" + "".join(each() for _ in range(self.r.randint(1, 6))) + (self.form() if self.r.random() < 0.4 else "")
        return self.box(self.pick("div", "section", "ol"), self.attrs(COMMENT, 0.0), inside)

    def share(self) -> str:
        return self.box(self.pick("div", "ul", "p"), self.attrs(SHARE, 0.0), self.links(self.r.randint(2, 5), self.pick("li", "span")))

    def page(self) -> str:
        maybe = lambda p, f: f() if self.r.random() < p else ""
        core = maybe(0.2, self.notice) + maybe(0.5, self.advert) + maybe(0.15, self.share) + self.article() + maybe(0.15, self.share)
        core += maybe(0.3, self.comments) + maybe(0.15, self.advert)
        beside = [maybe(0.4, self.side), maybe(0.2, self.side)]
        inside = "".join([core, *beside] if self.r.random() < 0.7 else [*beside, core])
        for _ in range(self.r.choice([0, 0, 0, 1, 1, 2, 3])):
            inside = self.box(self.pick("div", "div", "section", "form"), self.attrs(AROUND, 0.3), inside)
        parts = maybe(0.25, self.notice) + maybe(0.5, self.header) + maybe(0.7, self.menu) + maybe(0.15, self.form) + inside + maybe(0.15, self.form) + maybe(0.8, self.footer) + maybe(0.1, self.notice)
        if self.r.random() < 0.2:
            parts = self.box("div", self.attrs(AROUND, 0.2), parts)
        return f"<html><head><title>{self.words(5)}</title></head><body{self.attrs(AROUND, 0.8)}>{parts}</body></html>"


def labelled_page(seed: int) -> str:
    """A page whose main text stands behind MARK, run by run."""
    return _Writer(seed).page()
