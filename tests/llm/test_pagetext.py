from collections import defaultdict

import pytest

from spanforge.llm import pagetext, registry
from spanforge.llm.pagetext import Page

CASES = [
    ("", ""),
    ("plain  text\n here &amp; there", "plain text here & there"),
    ("<p>a<p>b", "a\n\nb"),
    ("<article><h1>T</h1><p><b>one<br><p>two</article><footer>&copy; x</footer>", "T\n\none\n\ntwo"),
    ("<article></article><p>x", ""),
    ("<main><p>m</main><p>o", "m"),
    ("<main><p>lead</p><article><p>m</article></main>", "m"),
    ("a<!-- b --><!-->c<!--- d --!>e<!-- never", "ace"),
    ("a < b & c > d", "a < b & c > d"),
    ("&lt;p&gt; &#233;&#xe9; &copy &am &amp;amp;", "<p> éé © &am &amp;"),
    ("<script>var t='</p>'; '<p>'</script ><style>p{}</style>x<textarea><p>y</textarea><title>t</title>", "x"),
    ("<ul><li>a<li>b</ul><dl><dt>c<dd>d</dl>", "a\n\nb\n\nc\n\nd"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
    ("<a title='x>y'>l</a>k<a title=\"", "lk"),
    ("</div>x</article></p>y<div/>z", "xy\n\nz"),
    ("<article><header><h1>T</h1>by me</header><p>a &nbsp;b</p><header class=x><h2>U</h2></header></article><header><h1>S</h1></header>", "T\n\na b\n\nU"),
    ("<article><div class='page-header'><h2>H</h2>no</div><p>yes</article>", "H\n\nyes"),
    ("<article class='post has-comments'><p>a <button>Go</button>b</p><div class=ad-slot>buy</div><section id=comments><article><p>hi</article></section></article>", "a b"),
    ("<body class=no-sidebar><div id='wrap with-sidebar'><p>a</p></div><div class='cookieNotice'>c</div><aside>s</aside><form>f</form><div hidden>h</div>", "a"),
    ("<p class=headline>a<p class='shared'>b<p role=navigation>c<p id=downloads>d", "a\n\nb\n\nd"),
    ("<svg><text>s</text></svg><select><option>1<option>2</select>x<![CDATA[y]]><?php z ?><!DOCTYPE q>", "x"),
    ("x" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "y", "x\n\ndeep\n\ny"),
]


@pytest.mark.parametrize("html,want", CASES)
def test_blocks(html, want):
    assert "\n\n".join(t for t, _ in Page(html).main()) == want


def test_many_open_quotes_take_linear_time():
    assert Page("<a b='" * 50_000 + "<p c=\"" * 50_000).main() == []
    assert Page("<b>" * 100_000 + "x").main()[0][0] == "x"


def test_equal_subtrees_have_equal_hashes():
    one, two, other = (Page(f"<div class='{c}'>\n<ul><li><a href='/{c}'>A  b</a></li></ul>{x}</div><p>{c}").candidates() for c, x in (("u", ""), ("v", ""), ("v", "!")))
    assert len(set(one) & set(two)) == 3  # div, ul, li
    assert len(set(one) & set(other)) == 2


PAGES = "page_id long, url string, html string, text string, n_chars int, `a.b` int, __salt int"


def page(menu, body, i):
    return f"<html><body><div class=top{i}><ul><li><a href=/{i}>{menu}</a></ul></div><div><p>{body}</p></div><div>Printed on paper.</div></body></html>"


def test_templates_of_a_host(spark):
    """Menus without any telling tag go where they recur on pages of different content; copies of a page count once."""
    rows = [(i, f"http://many.example.com/{i}", page("Home", f"body {i}", i)) for i in range(6)]
    rows += [(10 + i, f"http://few.example.com:80/{i}", page("Home", f"body {i}", i)) for i in range(4)]
    rows += [(20 + i, f"https://copies.example.com/{i}", page("Home", "one body", 0)) for i in range(40)]
    rows += [(70 + i, f"HTTP://u@MANY.example.com?{i}", page("Home", "body 1", 1)) for i in range(2)]
    rows += [(80 + i, "http://article.example.com", f"<article><div><p>Quoted line.</div><p>body {i}</p><div>Share this</div></article>") for i in range(6)]
    rows += [(90 + i, u, page("Home", f"body {i}", i)) for i, u in enumerate([None, "", "no host", "/path", "mailto:x", "a b"])]
    df = spark.createDataFrame([(*r, "x", 1, r[0], 2) for r in rows], PAGES)
    out = pagetext.extracted(df)
    assert set(out.columns) == set(df.columns) - {"html"}
    got = {r["page_id"]: r for r in out.collect()}
    assert all(r["a.b"] == i and r["__salt"] == 2 and r["n_chars"] == len(r["text"]) for i, r in got.items())
    text = {i: r["text"] for i, r in got.items()}
    # brute force: pages of different content of each host that hold a subtree
    hosts = [*["many"] * 6, *["few"] * 4, *["copies"] * 40, *["many"] * 2, *["article"] * 6, *["none"] * 6]
    pages, content = {r[0]: Page(r[2]) for r in rows}, {}
    seen = defaultdict(set)
    for (i, *_), host in zip(rows, hosts):
        content[i] = tuple(t for t, _ in pages[i].main())
        for h in pages[i].candidates():
            seen[host, h].add(content[i])
    for (i, *_), host in zip(rows, hosts):
        assert text[i] == "\n\n".join(t for t, marks in pages[i].main() if not any(len(seen[host, h]) >= 5 for h in marks))
    assert text[0] == "body 0" and text[70] == "body 1" and text[90] == "body 0"
    assert text[10] == "Home\n\nbody 0\n\nPrinted on paper." and text[20] == "Home\n\none body\n\nPrinted on paper."
    assert text[83] == "Quoted line.\n\nbody 3"


def test_share_of_a_host(spark):
    rows = [(i, "http://h", f"<p>body {i}</p>" + ("<div>now and then</div>" if i < 6 else ""), "x", 1, 0, 0) for i in range(30)]
    df = spark.createDataFrame(rows, PAGES)
    assert sum("now" in r["text"] for r in pagetext.extracted(df, share=0.5).collect()) == 6
    assert sum("now" in r["text"] for r in pagetext.extracted(df, share=0.1).collect()) == 0


def test_odd_pages(spark, write, agree):
    long = "<article>" + "<p>" + "word " * 400_000 + "</p>" + "<p>é&amp;</p>" * 1000 + "</article>"
    rows = [(1, "http://a/b", "<article><h1>x</h1></article>", "t", 0, 0, 0)] * 2 + [(None, None, None, None, None, None, None), (3, "http://a", "", "t", 0, 0, 0), (4, "u", long, "t", 0, 0, 0)]
    folder = write(pages=spark.createDataFrame(rows, PAGES))
    df = registry.queries()["op13_pagetext"](spark, folder)
    assert dict(df.dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert agree(df, pagetext.ORACLE, folder) == 5
    assert max(r["n_chars"] for r in df.collect()) == 5 * 400_000 - 1 + 1000 * 4
    empty = write(pages=spark.createDataFrame([], PAGES))
    assert registry.queries()["op13_pagetext"](spark, empty).collect() == []
