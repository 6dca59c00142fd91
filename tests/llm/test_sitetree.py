from __future__ import annotations

import re
import time
from html import unescape

import pytest

from docflow.llm import sitetree
from docflow.llm.queries import page_texts
from tests.llm.conftest import table

PAGES = "page_id long, url string, html string"


def text(html):
    return sitetree.kept_text(html, frozenset())


def got(frame):
    assert frame.columns == ["page_id", "url", "text", "n_chars"]
    return {r.page_id: r.text for r in frame.collect()}


def test_whole_table(llm, small):
    """The given pages have one article of headings and paragraphs; read by patterns here."""
    pages = llm.read.parquet(f"{small}/pages.parquet").collect()
    want = {}
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " "))
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks]
        want[page.page_id] = (page.url, "\n\n".join(b for b in blocks if b))
    rows = page_texts(llm, small).collect()
    assert {r.page_id: (r.url, r.text) for r in rows} == want and len(rows) == len(want)
    assert all(r.n_chars == len(r.text) for r in rows)


@pytest.mark.parametrize(
    "html, want",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>a\n  b&nbsp;c<p>d<br>e", "a b c\n\nd e"),
        ("<body><header>Site</header><article><header><h1>T</h1></header><p>x</p></article><footer>f</footer>", "T\n\nx"),
        ("<main><p>in</p><aside>side</aside><form><p>mail</p><input></form></main><p>out</p>", "in"),
        ("<div class='layout-sidebar'><article><p>x</p><div class='share-bar'>tweet</div></article></div>", "x"),
        ("<article>x<script>if (a<b) '</p>'</script><style>p{}</style><!-- c -->y</article>", "xy"),
        ("<article><p>x</p></article><section id=comments><article class='comment'><p>rude</p></article></section>", "x"),
        ("<div class=cookieNotice>We use cookies</div><div><p>Long enough text</p></div>", "Long enough text"),
        ("<form action=x><h1>Old site</h1><p>All in one form</p></form><nav>a b c</nav>", "Old site\n\nAll in one form"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>a<td>b</table><pre>x  y</pre></article>", "one\n\ntwo\n\na\n\nb\n\nx y"),
        ("<article><p>a <span class='ad'>buy</span>b <button>go</button>c</p></article>", "a b c"),
        ("<article><p>a <span class='notice'>kept</span></p></article>", "a kept"),
        ("<article><p title=\"x > y\" class='p'>a 1 < 2 &lt;b&gt;</p>", "a 1 < 2 <b>"),
        ("<article><p>one</div></p>two</article></b>", "one\n\ntwo"),
        ("<ARTICLE><P>Upper</P><NAV>menu</NAV></ARTICLE>", "Upper"),
        ("<article><p>open <!-- never closed <p>gone", "open"),
        ("<title>t</title><article><h1>&#72;i &eacute; &bogus;</h1></article>", "Hi é &bogus;"),
        ("<div role=navigation>menu</div><div role='main'><p>x</p></div>", "x"),
    ],
)
def test_markup(html, want):
    assert text(html) == want


def site(host, n, first=0):
    pages = []
    for i in range(first, first + n):
        body = "".join(f"<p>Text {i} of paragraph {k}.</p>" for k in range(1 + i % 3))
        html = (
            f"<body><div class='a1'>Subscribe to us</div><div class='body'><h2>Title {i}</h2>{body}"
            f"<p>A line on every page.</p><div class='z'><a>Share</a> <a>Print</a></div></div>"
            f"<div class='b2'>All rights reserved</div></body>"
        )
        pages.append((i, f"https://{host}/{i}", html))
    return pages


def content(i):
    return "\n\n".join([f"Title {i}", *[f"Text {i} of paragraph {k}." for k in range(1 + i % 3)], "A line on every page."])


def test_boilerplate_of_a_site(llm):
    """Unnamed branches that are alike on all pages of a host go; paragraphs beside them stay."""
    pages = [*site("a.example.org", 12), *site("b.example.org", 3, 100)]
    # twice the same page is one page of the tree, and a copied article stays
    pages += [(200 + i, "https://A.example.org:80/x", pages[0][2]) for i in range(5)]
    pages += [(300, None, None), (301, "https://a.example.org/e", ""), (302, "no address", "<p>x</p>")]
    frame = table(llm, pages, PAGES)
    for name in ("host", "branch", "cut", "text", "page", "importance"):
        frame = frame.withColumn(name, sitetree.F.lit(1))
    found = got(sitetree.extract(frame))
    for i in range(12):
        assert found[i] == content(i)
    # too few pages to tell
    assert found[100].startswith("Subscribe to us\n\nTitle 100") and found[100].endswith("All rights reserved")
    assert {found[200 + i] for i in range(5)} == {content(0)}
    assert (found[300], found[301], found[302]) == ("", "", "x")


def test_copies_of_one_article_stay(llm):
    """Pages that differ in a stamp only: all their branches are alike, none is emptied."""
    pages = [
        (i, f"http://c.example.net/{i}", f"<body><div class='m'><div class='t'><p>The same story.</p><p>Its end.</p></div>"
         f"<div class='s'>{i}</div></div><div class='u'>Join us</div></body>")
        for i in range(30)
    ]
    found = got(sitetree.extract(table(llm, pages, PAGES)))
    assert all(found[i].startswith("The same story.\n\nIts end.") and "Join us" not in found[i] for i in range(30))


def test_importance_as_by_hand(llm):
    rows = [(None, "h", f"<body><div class='d'><p>{'same' if i < 6 else i}</p>{'<ul><li>x</ul>' * (i % 2)}</div></body>") for i in range(8)]
    frame = llm.createDataFrame([(h, html + "<!-- %d -->" % i) for i, (_, h, html) in enumerate(rows)], "host string, html string")
    [div] = [r for r in sitetree.branch_importance(frame).collect() if r.pages == 8]
    from math import log

    # "same" on 6 pages, two texts on one page each, "x" on 4; half of the pages have a list
    evenness = (log(6) + 0 + 0 + log(4)) / 4 / log(8)
    presentation, fading = log(2) / log(8), 0.9**1.5
    assert div.importance == pytest.approx((1 - fading) * presentation + fading * (1 - evenness))


def test_empty_table(llm):
    assert got(sitetree.extract(table(llm, [], PAGES))) == {}


def test_time_grows_with_the_page():
    def seconds(html):
        start = time.time()
        sitetree.kept_text(html, frozenset([1]))
        return time.time() - start

    for part in ("<div>x", "<p>a <b>b<br>", "<a href=\"x", "<!-", "<li>&amp; x", "</div><span class='ad'>", "a='<"):
        assert seconds(part * 100_000) < 20
