import pytest

from siftloom.llm import html_text
from siftloom.llm.html_text import Page

PAGE = "page_id long, url string, html string, text long, host string"


def text(html):
    p = Page(html)
    out = p.dropped()
    return "\n".join(p.blocks(out, p.roots(out)))


@pytest.mark.parametrize(
    "html,want",
    [
        ("", ""),
        ("plain  words\n here", "plain words here"),
        ("<p>a<p>b<div>c</div>d", "a\nb\nc\nd"),
        ("<article><h1>T &amp; U</h1><p><b>x<br><p>y &#233;&nbsp;z</p></article>", "T & U\nx\ny é z"),
        ("<body><nav>menu</nav><article><p>a</p><aside>b</aside><p>c <i>d</i></p></article><footer>f</footer>", "a\nc d"),
        ("<article><p>one</p><div class='comments'><p>nice!</p></div></article><article class=comment>no</article>", "one"),
        ("<article><header><h1>Head</h1></header><p>t</p></article><header>site</header>", "Head\nt"),
        ("<body><header><h1>Site</h1></header><main><p>m</p><form>f<input></form></main>", "m"),
        ("<script>var t='</p><article>x</article>';</script><p>a<!-- <p>no</p> --></p><style>p{}</style>", "a"),
        ("<p title='a > b'>q</p><p data-x=\"'\">r", "q\nr"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<div class='side-bar sidebar'>x</div><div id=cookie-notice>y</div><div role=alert>z</div><p hidden>h</p><p>k", "k"),
        ("<div class='adventure'>kept</div>", "kept"),
        ("<script>never ends <p>x", ""),
        ("<!-- never ends <p>x", ""),
        ("<p>broken <a href='x", "broken"),
        ("<article><p>a</p>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "a\ndeep"),
        ("</div></p>x</article>", "x"),
    ],
)
def test_text(html, want):
    assert text(html) == want


def site(n, host="h.example"):
    """Pages of one host with an unnamed template around and inside the article, copies of one page, and a shared paragraph."""
    out = []
    for i in range(n):
        body = f"<p>own words {i if i > 5 else 0}</p><p>a paragraph that all pages share</p>"
        out.append((i, f"https://{host}/p/{i}", f"<body><div class=x1><p>Template top</p></div><article>{body}<div class=x2>Read more on this site</div></article><div>Bottom</div></body>", 1, "q"))
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_templates_recur_on_a_host(spark, monkeypatch, most):
    monkeypatch.setattr(html_text, "MOST_HASHES", most)
    rows = site(30) + [(100, None, None, 1, None), (100, None, None, 1, None), (101, "::bad[", "", 1, None), (None, "http://other.example/", "<div class=x1><p>Template top</p></div><div>Read more on this site</div>", 1, None)]
    got = {}
    for r in html_text.main_text(spark.createDataFrame(rows, PAGE)).collect():
        got.setdefault(r.page_id, []).append((r.text, r.n_chars))
    for i in range(30):
        t = f"own words {i if i > 5 else 0}\na paragraph that all pages share"
        assert got[i] == [(t, len(t))]
    assert got[100] == [("", 0)] * 2 and got[101] == [("", 0)]
    assert got[None][0][0] == "Template top\nRead more on this site"


def test_copies_of_a_page_are_no_template(spark):
    one = "<body><div>Only here</div><p>and this</p></body>"
    rows = [(i, "http://c.example/x", one, 1, None) for i in range(20)]
    assert {r.text for r in html_text.main_text(spark.createDataFrame(rows, PAGE)).collect()} == {"Only here\nand this"}


def test_empty_table(spark):
    assert html_text.main_text(spark.createDataFrame([], PAGE)).count() == 0


def test_long_templates_go(spark):
    """A block of more than 20,000 characters in the article, with direct text, on each page of a host."""
    block = "<div>Read also" + "".join(f"<p>teaser {i} of the whole site and its archive</p> <a href='/{i}'>more</a>" for i in range(600)) + "</div>"
    rows = [(i, "http://l.example/x", f"<body><article><p>own {i}</p>{block}</article></body>", 1, None) for i in range(6)]
    assert len(block) > 20_000
    assert {r.text for r in html_text.main_text(spark.createDataFrame(rows, PAGE)).collect()} == {f"own {i}" for i in range(6)}


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_verdict_does_not_change_with_the_host(spark, monkeypatch, most):
    """A box on five different pages goes, whether its host has 5 or 605."""
    monkeypatch.setattr(html_text, "MOST_HASHES", most)
    page = lambda i, box: (i, f"http://{'small' if i < 5 else 'large'}.example/{i}", f"<article><p>own {i}</p>{box}</article>", 1, None)
    rows = [page(i, "<div>Of one section</div>") for i in range(10)] + [page(i, "") for i in range(10, 610)]
    got = {r.page_id: r.text for r in html_text.main_text(spark.createDataFrame(rows, PAGE)).collect()}
    assert got == {i: f"own {i}" for i in range(610)}
