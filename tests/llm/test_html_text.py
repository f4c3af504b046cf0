from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import html_text as h

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T &amp; U</title><style>p{}</style><script>var t="</p>";</script></head>
<body><header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and more of them, always.</div><div id="sidebar"><p>Read also this long side text, please, now.</p></div>
<main><article><h1>Title &amp; more</h1><p><b>First   line,\n&eacute;t&#233; &lt;x&gt;.<br><p>Second <a href="x">link</a> words, indeed; it goes on.</p>
<ul><li>one<li>two</ul><div class="ad">Buy now, buy more, buy it all today.</div><form>Name <input></form></article>
<section id="comments"><p>Nice read, thank you very much, friend.</p></section></main><footer>&copy; us, all rights.</footer></body></html>"""


def test_page():
    assert h.main_text(PAGE).split("\n\n") == ["Title & more", "First line, été <x>.", "Second link words, indeed; it goes on.", "one", "two"]


def test_plain_divisions():
    page = "<body><div class=top><a href=x>One</a> <a href=y>Two</a></div><div><div>A first paragraph, long enough, to count.</div><div>A second one, just as long, in all.</div><div>Short.</div></div></body>"
    assert h.main_text(page).split("\n\n") == ["A first paragraph, long enough, to count.", "A second one, just as long, in all.", "Short."]


def test_nothing_of_an_article_is_cut():
    long, short = "A long paragraph, with marks, and more of it. " * 6, "A shorter part, still of the text, goes here."
    says = lambda page: h.main_text(f"<body><nav><a href=x>Menu</a></nav>{page}</body>").split("\n\n")
    long = long.strip()
    uneven = f"<article><section><p>{long}<p>{long}<p>{long}</section><section><p>{long}</section></article>"
    assert says(uneven) == [long] * 4
    for tag, item in (("ul", "li"), ("ol", "li"), ("table", "td")):
        items = "".join(f"<tr><{item}>{long}" if tag == "table" else f"<{item}>{long}" for _ in range(9))
        assert says(f"<article><h1>T</h1><p>{short}</p><{tag}>{items}</{tag}></article>") == ["T", short] + [long] * 9
        assert says(f"<div><h1>T</h1><p>{short}</p><{tag}>{items}</{tag}></div>") == ["T", short] + [long] * 9
    assert says(f"<article><p>{long}</p><ul><li><a href=x>A source</a></ul></article>") == [long, "A source"]
    for name in ("layout has-sidebar", "with-comments", "sidebar"):
        assert says(f'<div class="{name}"><p>{long}</p><p>{long}</p></div>') == [long, long]
    assert says(f'<article><div class="post-header"><h1>T</h1></div><p>{long}</p></article>') == ["T", long]
    assert says(f'<div class="site-header"><a href=x>Home</a></div><div class="related-posts"><a href=x>More</a></div><div><p>{long}</p></div>') == [long]


def test_embedded_elements_take_no_text_with_them():
    says = lambda page: h.main_text(f"<body>{page}</body>").split("\n\n")
    assert says('<article><p>A</p><svg width="1" height="1"/><p>B</p></article>') == ["A", "B"]
    assert says("<article><p>A</p><video src=x><p>B</p></article>") == ["A", "B"]
    for tag in ("svg", "math", "select", "object", "canvas", "audio", "video", "template", "noscript", "iframe", "textarea"):
        assert says(f"<article><p>A</p><{tag} a=b><i>no</i> <b>no</b></{tag}><p>B</p></article>") == ["A", "B"], tag
        assert says(f"<article><p>A</p><{tag} a=b/><p>B</p></article>")[-1] == "B", tag
        assert says(f"<article><p>A</p><{tag} a=b><p>B</p></article>") == ["A", "B"], tag
    assert says("<article><p>A</p><textarea></p></article></textarea><p>B</p></article>") == ["A", "B"]
    assert says("<article><p>A</p><svg><g><text>no</text></g></svg> B</article>") == ["A", "B"]


def test_names_decide_with_links_or_with_all_their_parts():
    long = "A long paragraph, with marks, and more of it. " * 3
    says = lambda page: [x.strip() for x in h.main_text(f"<body>{page}</body>").split("\n\n")]
    for name in ('class="share-price"', 'id="social-history"', 'class="ad-lib notes"', 'class="cookie-recipe"'):
        assert says(f"<article><p>{long}</p><section {name}><p>{long}</p></section></article>") == [long.strip()] * 2, name
    for name in ("share-buttons", "comment-list", "newsletter-signup", "ads", "cookie-bar"):
        assert says(f"<article><p>{long}</p><div class='{name}'><p>{long}</p></div></article>") == [long.strip()], name
    assert says(f"<article><p>{long}</p><div class='share-now'><a href=x>{long}</a></div></article>") == [long.strip()]


def test_hostile_pages_take_linear_time():
    import time

    n = 1_000_000
    for page in ("<p " + "a" * n + ">x", "<" + "a" * n, "<?" * (n // 2), "<a b='" * (n // 6), "<iframe>" * (n // 8) + "x", "<p class='" + "share-" * (n // 6) + "'>x", "<p a" + " " * n + ">x", "<!" * (n // 2), "<p a=\"" * (n // 6), "</" * (n // 2)):
        began = time.time()
        h.main_text(page)
        assert time.time() - began < 4, page[:20]


def test_bare_and_broken():
    assert h.main_text(None) == h.main_text("") == h.main_text("<p> &nbsp; </p><!-- a") == ""
    assert h.main_text("just text, 1 < 2") == "just text, 1 < 2"
    assert h.main_text("<p>a<script>x") == "a"
    assert h.main_text("<" * 100_000 + "<a b='" * 20_000)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='x'>", "</div>", "<b", ">", "<!--", "-->", "a, b.", "&amp;", "<td>", "<tr>", "<li>", "</ul>", "<nav>", "\n"]), max_size=30).map("".join))
def test_never_fails(page):
    assert "\n\n\n" not in h.main_text(page)


def test_all_pages(spark):
    rows = [(1, "u", PAGE, 5), (1, "u", PAGE, 5), (2, None, None, 1), (None, "v", "", 1)]
    got = h.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 4 and sorted(r.n_chars for r in got) == [0, 0, *[len(h.main_text(PAGE))] * 2]
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    for r in h.extracted(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = r.html.split("<article>")[1].split("</article>")[0]
        import html as std
        import re

        want = [" ".join(std.unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner.replace("<b>", ""))]
        assert r.text == "\n\n".join(x for x in want if x), r.page_id


def test_deep_pages_take_linear_time():
    import time
    import tracemalloc

    for page in ("<div>word " * 50_000, "<p>a<li>" * 30_000, "</b></i></table>" * 30_000 + "<ul><li>x" * 20_000, "<div class=menu>w " * 30_000):
        tracemalloc.start()
        began = time.time()
        assert h.main_text(page)
        assert time.time() - began < 8 and tracemalloc.get_traced_memory()[1] < 100e6
        tracemalloc.stop()
