import random

import pytest

from tidelog.llm import html_text as h

P = "Some words of a paragraph that is long enough to count as text, {}."


def page(body, head="<title>T</title><style>p{}</style><script>var a='<p>x</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


def article(n=4):
    return "".join(f"<p>{P.format(k)}</p>" for k in range(n)), [P.format(k) for k in range(n)]


@pytest.mark.parametrize("wrap", [
    "<nav><ul><li><a href=/a>A</a></li><li><a href=/b>B</a></li></ul></nav><div class='ad'>Buy this now, only today, it is cheap.</div><article><h1>Title</h1>{}</article><footer>&copy; me</footer>",
    "<div id=page><header><a href=/>Home</a> <a href=/x>X</a></header><main><h1>Title</h1><div class=body>{}</div></main><aside>Side text here</aside></div>",
    "<div class='layout has-sidebar'><div class=content><h1>Title</h1>{}</div><div class=sidebar><p>Read more of this elsewhere, please.</p></div></div>",
    "<div role=navigation>Menu entries</div><div id='cookie-notice'><p>We use cookies to make things better for you.</p></div><article><header><h1>Title</h1></header>{}<div class=share><a href=1>Share</a></div><section id=comments><h2>Comments</h2><article class=comment><p>I like this very much, thanks for it.</p></article></section></article>",
    "<article><h1>Title</h1>{}<form><label>Your mail</label><input><button>Send</button></form></article><noscript>Enable it</noscript><div style='display: none'>hidden</div>",
])
def test_furniture_goes(wrap):
    body, want = article()
    assert h.main_text(page(wrap.format(body))).split("\n") == ["Title", *want]


def test_without_article_or_names():
    body, want = article(6)
    links = "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(12))
    got = h.main_text(page(f"<div><ul>{links}</ul></div><div><div>{body}</div></div>")).split("\n")
    assert got == want


def test_blocks_spaces_references_and_broken_markup():
    got = h.main_text("<article><h1>A&amp;B &#233;&nbsp;\n c</h1><p><b>one\ttwo<br><p>x &lt;p&gt; &eacute;</p>tail<ul><li>i<li>j <i>k</i></ul><table><tr><td>1<td>2<tr><td>3</table>a <!-- c --> b &am")
    assert got.split("\n") == ["A&B é c", "one two", "x <p> é", "tail", "i", "j k", "1 2", "3", "a b &am"]
    assert h.main_text("<article><p>text <a hre") == "text"
    assert h.main_text("<article><p>a < b and 3<4</p></article>") == "a < b and 3<4"
    assert h.main_text("<p>only <b>bold</p><p>next</b> x</p>").split("\n") == ["only bold", "next x"]
    assert h.main_text("<article><p>x</p><script>if (a</b) '</p>'") == "x"


def test_density_decides():
    """Without names, article or main: furniture loses by density, and without density it would not."""
    body, want = article(5)
    links = "".join(f"<li><a href=/{k}>Entry {k}</a></li>" for k in range(8))
    cases = [
        f"<div><p>Buy this now, only today, it is cheap and good.</p></div><div>{body}</div>", f"<div>Achetez maintenant</div><div>{body}</div>",
        f"<div><ul>{links}</ul></div><div><div>{body}</div></div><div><a href=1>About</a> <a href=2>Imprint</a> 2024</div>",
        f"<table><tr><td><ul>{links}</ul></td><td>{body}</td><td><a href=3>More of this</a></td></tr></table>",
    ]
    for c in cases:
        assert h.main_text(page(c)).split("\n") == want
    was, h.density = h.density, lambda *_: 1.0
    try:
        changed = sum(h.main_text(page(c)).split("\n") != want for c in cases)
    finally:
        h.density = was
    assert changed >= 2


def test_names_alone_drop_nothing():
    body, want = article(2)
    got = h.main_text(page(f"<div>{body}<div class=share-price-table><p>The price of a share rose again today.</p></div><div class=related-work><p>Others have done the same thing before.</p></div><section id=discussion><p>Discussion of results.</p></section></div>"))
    assert got.split("\n") == [*want, "The price of a share rose again today.", "Others have done the same thing before.", "Discussion of results."]
    sources = "".join(f"<li><a href=/{k}>A source, {k}</a></li>" for k in range(4))
    assert h.main_text(page(f"<nav>x</nav><article>{body}<ul>{sources}</ul></article>")).count("A source") == 4


def test_parts_of_one_text_stay_together():
    body, want = article(5)
    got = h.main_text(page(f"<div><h1>T</h1><section><h2>A</h2>{body}</section><section><h2>B</h2><p>Short but part of it.</p></section><div><a href=1>x</a></div></div>"))
    assert got.split("\n") == ["T", "A", *want, "B", "Short but part of it."]


def brute_sums(node, share):
    """Density sums by plain recursion."""
    def counts(x):
        n = [0, 0, 0, 0]
        for c in x.children:
            if isinstance(c, str):
                n[0] += len(c.strip())
            else:
                k = counts(c)
                n = [n[0] + k[0], n[1] + k[1], n[2] + k[2] + (c.tag in h.BLOCKS or c.tag == "a"), n[3] + k[3] + (c.tag == "a")]
        return [n[0], n[0] if x.tag == "a" else n[1], n[2], n[3]]

    d = {id(c): h.density(*counts(c), share) for c in node.children if not isinstance(c, str)}
    runs = sum(h.density(len(c.strip()), 0, 0, 0, share) for c in node.children if isinstance(c, str))
    total, own = runs + sum(d.values()), h.density(*counts(node), share)
    leaf = node.tag not in h.HOLDERS and not any(not isinstance(c, str) and c.tag in h.BLOCKS for c in node.children)
    return [(node, min(total, own) if leaf else total)] + [y for c in node.children if not isinstance(c, str) for y in brute_sums(c, share)]


def test_sums_equal_plain_recursion():
    r = random.Random(2)
    for _ in range(60):
        html = "".join(r.choice(["<div>", "</div>", "<p>", "</p>", "<a href=x>", "</a>", "<b>", "</b>", "<ul><li>", "</ul>", "words here ", "some more of it, longer than before "]) for _ in range(80))
        root = h.parse(html)
        h._prune(root)
        nodes = h._below(root)
        h._measure(nodes)
        want = dict((id(n), t) for n, t in brute_sums(root, root.links / max(1, root.chars)))
        assert {id(n): n.total for n in nodes} == pytest.approx(want)


def test_time_grows_with_the_page():
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        h.main_text("<b><div>" * n + "x" + "</b></i></span>" * n)
        h.main_text("<p><i>" * n + "x" + "</p>" * n)
        took.append(time.process_time() - began)
    assert took[1] < 12 * took[0] + 1


def test_plain_empty_and_hostile():
    assert h.main_text("") == "" and h.main_text("   ") == "" and h.main_text("just text") == "just text"
    assert h.main_text("<html><body></body></html>") == ""
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert h.main_text(deep) == "deep text"
    assert h.main_text("<article>" + "<p>w w</p>" * 30000 + "</article>").count("\n") == 29999
    r = random.Random(1)
    for _ in range(400):
        h.main_text("".join(r.choices(["<", ">", "</", "p", "div", " class='", "\"", "a", "&", ";", "<!--", "-->", "<p>", "</p>", "<b>", "</div>", "<script>", "<td>"], k=60)))


def test_table(spark):
    body, want = article()
    pages = spark.createDataFrame([(1, "u", page(f"<article>{body}</article>"), "z"), (1, "u", page(f"<article>{body}</article>"), "z"), (2, None, None, "z"), (None, "v", "", "z")], "page_id long, url string, html string, text string")
    rows = h.extract(pages).collect()
    assert sorted((str(r.page_id), str(r.url), r.text) for r in rows) == sorted([("1", "u", "\n".join(want))] * 2 + [("2", "None", ""), ("None", "v", "")])
    assert h.extract(pages.limit(0)).collect() == []
