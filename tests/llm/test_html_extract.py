"""HTML extraction: held-out layouts, pages written by hand, the tables' own layout, the reader and the labelling."""

import html as H
import itertools
import re

import numpy as np
import pytest

from twinlake.llm import html_extract as X
from twinlake.llm.dom import MARK, Page
from twinlake.llm.layouts import labelled_page

PROSE = "The council met on Tuesday to discuss the new bridge, which will cost 4 million. Work starts in spring, said the mayor. "
HAND = [
    (f"<html><body><nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>A bridge</h1><p>{PROSE}<p>{PROSE * 2}</article><footer>&copy; 2024</footer>", f"A bridge {PROSE}{PROSE * 2}"),
    (f"<body><header class=site-header><a href=/>The Gazette</a></header><div class='content'><h1>A &lt;bridge&gt;</h1><p>{PROSE}</p><div class=ad>Buy now. Only today.</div><p>{PROSE}</p></div><div class=sidebar><h3>Related</h3><ul><li><a href=/>One</a></ul></div>", f"A <bridge> {PROSE}{PROSE}"),
    (f"<main><h1>T</h1><p>{PROSE}</p><p>{PROSE}</p></main><section class=comments><h3>2 comments</h3><div class=comment><b>Ann</b><p>{PROSE}</p></div></section>", f"T {PROSE}{PROSE}"),
    (f"<div class='cookie-banner'><p>We use cookies. {PROSE}</p><button>OK</button></div><article><p>{PROSE}</p><p>{PROSE}</p><script>var a = '<p>no</p>';</script><style>p{{}}</style></article><aside class=related><p>Read also.</p></aside>", PROSE * 2),
    ("", ""), (None, ""), ("<", "<"), ("<nav><a href=/>x</a></nav>", ""),
]


def _f1(a: str, b: str) -> float:
    a, b = a.split(), b.split()
    left = list(b)
    both = 0
    for w in a:
        if w in left:
            left.remove(w)
            both += 1
    return 2 * both / max(1, len(a) + len(b))


def test_held_out_layouts():
    model, score, exact = X.learn(), [], 0
    pages = [labelled_page(k) for k in range(10**6, 10**6 + 150)]
    got = model.texts([h.replace(MARK, "") for h in pages])
    for h, t in zip(pages, got):
        p = Page(h)
        want = p.join([k in p.marked for k in range(len(p.tag))])
        exact += want == t
        score.append(_f1(want, t))
    assert exact >= 0.85 * len(pages) and np.mean(score) > 0.93


def test_pages_by_hand(spark):
    df = spark.createDataFrame([(k, "u", h, "old") for k, (h, _) in enumerate(HAND)] * 2, "page_id long, url string, html string, body string")
    rows = X.extract_text(df.repartition(3)).collect()
    assert len(rows) == 2 * len(HAND) and set(rows[0].asDict()) == {"page_id", "url", "body", "text"}
    for r in rows:
        if HAND[r.page_id][0] != "<":
            assert r.text == " ".join(HAND[r.page_id][1].split()), r.page_id


def test_layout_of_the_tables(spark, tmp_path):
    """The whole of each article, whatever it says; next to it a menu, an advert and a footer of the same words."""
    words = "Thheouble heenwh on reti ingeser erster that. 4868701055796358 êoi*** réé%%% &amp; x < y © ".split()
    pages = []
    for k in range(60):
        text = " ".join(words[(k + j) % len(words)] for j in range(3 + 5 * k))
        body = f"<h1>{text[:40]}</h1><p><b>{text}<br><p>{text}</p><p>{text[:30]}</p>"
        nav = "".join(f'<li><a href="/{w}">{w}</a></li>' for w in words[:5])
        pages.append((k, "u", f'<!DOCTYPE html><html lang="en"><head><title>{text}</title><style>p{{}}</style></head><body><nav><ul>{nav}</ul></nav><!-- ad --><div class="ad">{text[:60]}</div><article>{body}</article><footer>&copy; a.example &middot; {text[:50]}</footer></body></html>'))
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = X.op11_html_extract(spark, str(tmp_path)).collect()
    assert dict(X.op11_html_extract(spark, str(tmp_path)).dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    for r in rows:
        article = re.search(r"<article>(.*)</article>", pages[r.page_id][2], re.S)[1]
        want = " ".join(H.unescape(re.sub(r"<b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_labelling_is_the_least_cost():
    """decode() against all labellings of small trees."""
    rng = np.random.default_rng(1)
    for k in range(40):
        page = Page("<div>a<p>b</p><ul><li>c<li>d</ul></div><p class=x>e")
        layout = X.Layout([page])
        costs = rng.exponential(size=(len(layout.tag), 3)) * layout.scored[:, None]
        nodes = [int(n) for n in np.flatnonzero(layout.scored)]
        best = (float("inf"), None)
        for labels in itertools.product(range(3), repeat=len(nodes)):
            of = dict(zip(nodes, labels))
            fine = all(layout.branch[n] or of[n] != X.MIXED for n in nodes) and all(
                layout.root[n] or of[int(layout.parent[n])] == X.MIXED or (of[int(layout.parent[n])] == X.MAIN and of[n] != X.MIXED) or of[n] == X.REST for n in nodes
            )
            if fine:
                best = min(best, (sum(costs[n, of[n]] for n in nodes), labels))
        got = X.decode(layout, costs)
        assert tuple(int(got[n]) for n in nodes) == best[1]


@pytest.mark.parametrize("page, text", [
    ("a<br>b c<p>d &amp; e&nbsp;f<p>g", "a b c d & e f g"), ("<b>x</b>y <i>z</i>", "xy z"), ("<p>a<!-- no <p> --><td>b", "a b"), ("a < b <3", "a < b <3"),
    ("<script>x</SCRIPT >y<title>no</title><textarea>no</textarea>", "y"), ("<a href='x>y", "y"), ("x<p class=\"a>b</p>c", "x b c"), ("<ul><li>1<li>2<ul><li>3</ul></ul>4", "1 2 3 4"),
])
def test_reader(page, text):
    p = Page(page)
    assert p.join([True] * len(p.tag)) == text


def test_very_long_and_very_deep_pages():
    model = X.learn()
    assert model.texts(["<div>" * 50_000 + "x"])[0] in ("x", "")
    text = "word, " * 200 + "end."
    assert model.texts(["<article>" + f"<p>{text}</p>" * 2000 + "</article><footer>no</footer>"])[0] == " ".join([text] * 2000)


def test_digits_of_a_whole_text_count():
    words = "word " * 600
    near, far = X.Layout([Page(f"<p>{'12345 ' * 400}{words}</p>")]), X.Layout([Page(f"<p>{words}{'12345 ' * 400}</p>")])
    assert near.own[:, 4].sum() == far.own[:, 4].sum() == 2000
