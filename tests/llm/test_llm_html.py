import random
import time

import duckdb
import pytest

from netloom.llm import htmltext

P = ["First paragraph with a fair number of words in it, so that it reads like prose.", "Second one &amp; it has <b>bold</b>, <a href=x>a link</a> and more words.",
     "Révi.", "Third: 1 &lt; 2, &eacute;t&eacute; &#8212; &copy 2020 and a <em>long</em> enough tail to be dense."]
WANT = ["First paragraph with a fair number of words in it, so that it reads like prose.", "Second one & it has bold, a link and more words.", "Révi.",
        "Third: 1 < 2, été — © 2020 and a long enough tail to be dense."]
BODY = "".join(f"<p>{p}</p>\n" for p in P)
NAV = "<nav><ul>" + "".join(f"<li><a href='/{i}'>Menu entry {i}</a></li>" for i in range(8)) + "</ul></nav>"
NOISE = ("<div class='ad'>Buy this wonderful thing now, it is really very good and cheap.</div><aside>Side story that is long, with a lot of text in it.</aside>"
         "<div id=\"cookie-notice\">We use cookies on this site for many good reasons.</div><form>Sign up <input name=q> <button>Go</button></form>")
COMMENTS = "<section class='user comments'><h3>Comments</h3><div class=comment><p>I liked this a lot, thank you for writing it down here.</p></div></section>"
FOOT = "<footer>&copy; example.com &middot; Some footer text that goes on for a while.</footer>"


def page(main, before=NAV + NOISE, after=COMMENTS + FOOT):
    return f"<!DOCTYPE html><html lang=en><head><title>T</title><style>p{{margin:0}}</style><script>var t=\"</p>\";</script></head><body>{before}{main}{after}</body></html>"


CASES = {
    "article": (page(f"<article><h1>Title</h1>{BODY}</article>"), ["Title", *WANT]),
    "no article": (page(f"<div class=content><h1>Title here</h1>{BODY}</div>"), ["Title here", *WANT]),
    "sections": (page(f"<div id=page><div class=part>{BODY}</div><div class=part>{BODY}</div></div>"), [*WANT, *WANT]),
    "own header": (page(f"<article><header><h1>Title</h1></header>{BODY}</article>", before=f"<header><h1>Site name</h1></header>{NAV}"), ["Title", *WANT]),
    "header by name": (page(f"<div id=content><div class='entry-header'><h2>Title words</h2></div>{BODY}</div>", before="<div id=header><p>Site name and a slogan that is long enough.</p></div>"
                            "<div class='notices'><p>Some notice that readers see on all pages.</p></div>"), ["Title words", *WANT]),
    "unclosed": (page("<article><h1>T</h1><p><b>Bold lead<br><p>" + "<p>".join(P)).replace("</body></html>", ""), None),
    "advert inside": (page(f"<article>{BODY}{NOISE}{BODY}</article>"), [*WANT, *WANT]),
    "article with comments": (page(f"<article>{BODY}<div id=comments><article class=comment><p>Nice one, indeed, I thought.</p></article></div></article>"), WANT),
    "main": (page(f"<main><h1>T</h1>{BODY}</main>"), ["T", *WANT]),
    "table and list": (page("<article><ul><li>One<li>Two</ul><table><tr><td>a<td>b</table><pre>x\n  y</pre></article>"), ["One", "Two", "a", "b", "x y"]),
    "short": (page("<article><p>Hi.</p></article>"), ["Hi."]),
    "line breaks": (page("<article><p>one<br>two<br/>three\n\t four</p></article>"), ["one two three four"]),
    "broken": ("<p>a < b and <c <p>next</p></x></body>", None),
    "hidden": (page(f"<article>{BODY}<div style='display: none'>secret</div><p hidden>no</p><template>t</template></article>"), WANT),
    "comment marks": (page(f"<article><!-- <p>not this</p> -->{BODY}<!-- open</article>"), None),
    "plain": ("Just text &amp; nothing else", ["Just text & nothing else"]),
    "empty": ("", []), "null": (None, []), "tags only": ("<html><body><p></p></body></html>", []),
}


LONG = "Some long story text, with many words in it, that goes on and on. " * 8
CASES |= {
    "no-sidebar": (f"<body><div class='content no-sidebar'><p>{LONG}</p><p>{LONG}</p></div></body>", [LONG.strip()] * 2),
    "has-sidebar": (f"<body><div class='layout has-sidebar'><article><p>{LONG}</p></article></div></body>", [LONG.strip()]),
    "comments-open": (f"<body><article class='post comments-open'><p>{LONG}</p></article></body>", [LONG.strip()]),
    "popular-science": (f"<body>{NAV}<div class='popular-science'><p>{LONG}</p></div>{FOOT}</body>", [LONG.strip()]),
    "two articles": (page(f"<div id=c><article><h2>A</h2><p>{LONG}</p></article><article><h2>B</h2><p>{LONG}</p></article></div>"), ["A", LONG.strip(), "B", LONG.strip()]),
    "teaser": (page(f"<div class=story><h1>S</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div><article><p>Teaser of few words</p></article>"),
               ["S", LONG.strip(), "Short.", LONG.strip()]),
    "parts of the body": (f"<body>{NAV}<div>Imprint</div><h1>Head</h1><div><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><p>Short.</p><div><p>{LONG}</p></div><div>Terms</div>{FOOT}</body>",
                          ["Head", *[LONG.strip()] * 3, "Short.", LONG.strip()]),
    "inline elements": (f"<body>{NAV}<div><h1>T</h1><p>{LONG}<b>{LONG}</b><br><i>{LONG}</i></p><p>{LONG}</p></div></body>", ["T", " ".join([(LONG * 2).strip(), LONG.strip()]), LONG.strip()]),
    "more comments than story": (f"<body><article><p>{LONG}</p></article><section class=comments><p>{LONG * 4}</p></section></body>", [LONG.strip()]),
}


def by_the_book(root):
    """Densities, sums and heart, every block counted on its own from its whole subtree."""
    def kids(x):
        return [c for c in x.children if isinstance(c, htmltext.Node) and not c.bad]

    def below(x):
        return [d for c in kids(x) for d in (c, *below(c))]

    def chars(x):
        return sum(len(htmltext._WHITE.sub(" ", c.strip())) for y in (x, *below(x)) for c in y.children if isinstance(c, str))

    def links(x):  # outermost links
        return [d for c in kids(x) for d in ([c] if c.name == "a" else links(c))]

    def tags(x):
        return sum(d.name == "a" or htmltext._is_block(d) for d in below(x))

    def nearest(x):  # blocks inside x with no block between
        return [d for c in kids(x) for d in ([c] if htmltext._is_block(c) else nearest(c))]

    nodes = [root, *below(root)]
    body = next((x for x in nodes if x.name == "body"), root)
    numbers = lambda x: (chars(x), tags(x), sum(map(chars, links(x))), sum(tags(a) + 1 for a in links(x)))
    bc, _, bl, _ = numbers(body)
    dense = {x: htmltext.density(*numbers(x), bc, bl) for x in nodes if htmltext._is_block(x)}
    sums = {x: sum(dense[d] for d in nearest(x)) or dense[x] for x in dense}
    inside = [x for x in dense if (x is body or x in below(body)) and chars(x)]
    return dense, sums, max(inside, key=lambda x: (sums[x], -nodes.index(x)), default=None)


@pytest.mark.parametrize("name", [n for n, (h, _) in CASES.items() if h])
def test_densities_and_heart_by_the_book(name):
    root = htmltext.parse(CASES[name][0])
    got = htmltext.measured(root)
    dense, sums, heart = by_the_book(root)
    assert {x: pytest.approx(x.density) for x in got} == dense and {x: pytest.approx(x.sum) for x in got} == sums
    parts = htmltext.main_parts(root)
    if heart is not None:
        assert any(isinstance(p, htmltext.Node) and (p.holds(heart) or heart.holds(p)) for p in parts)


def test_generated_pages_by_the_book_and_without_the_element():
    """The method decides on every page: without <article> the same text comes out."""
    rows = duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for i, (html,) in enumerate(rows):
        plain = html.replace("<article>", "<div>").replace("</article>", "</div>")
        assert htmltext.extract(plain) == htmltext.extract(html)
        if i < 40:
            root = htmltext.parse(plain)
            got = htmltext.measured(root)
            dense, sums, heart = by_the_book(root)
            assert {x: pytest.approx(x.density) for x in got} == dense
            assert max((x for x in got if x.own), key=lambda x: (x.sum, -x.start)) is heart or pytest.approx(sums[heart]) == max(sums.values())


@pytest.mark.parametrize("name,html", [
    ("nested", "<div>" * 100_000 + "x" + "</div>" * 100_000), ("quotes", "<a x=\"" * 170_000), ("stray", "<div>" * 50_000 + "</span>" * 100_000),
    ("inline", "<b>" * 100_000 + "<div></div>" * 50_000), ("items", "<li>" * 200_000), ("signs", "<" * 1_000_000), ("open quote", "<a title=\"" + "x>" * 400_000),
    ("unclosed", "<p><b>" * 100_000), ("comment", "<!--" * 200_000), ("scripts", "<script>" * 100_000)])
def test_a_megabyte_of_broken_marks_is_read_in_linear_time(name, html):
    start = time.process_time()
    htmltext.extract(html)
    assert time.process_time() - start < 6  # a quadratic reader needs minutes


@pytest.mark.parametrize("name", CASES)
def test_cases(name):
    html, want = CASES[name]
    got = htmltext.extract(html)
    if want is not None:
        assert got == "\n\n".join(want)


def test_unclosed_elements_lose_nothing():
    got = htmltext.extract(CASES["unclosed"][0])
    assert got.startswith("T\n\nBold lead\n\n" + "\n\n".join(WANT))


def test_deep_and_long_pages():
    deep = "<div>" * 3000 + "core text of the page" + "</div>" * 3000
    assert htmltext.extract(deep) == "core text of the page"
    many = page("<article>" + "<p>some words of prose</p>" * 20_000 + "</article>")
    assert htmltext.extract(many).count("\n\n") == 19_999


def test_random_pages_never_fail():
    rng = random.Random(6)
    parts = ["<p>", "</p>", "<div class=ad>", "</div>", "<a href='x'>", "</a>", "text &amp; more", "<!--", "-->", "<script>", "</script>", "<", ">", "\"", "<li>", "<table>", "<td>", "&#x110000;", "<br>"]
    for _ in range(500):
        htmltext.extract("".join(rng.choice(parts) for _ in range(rng.randint(0, 60))))


def test_density_prefers_prose_to_links():
    prose, links = htmltext.density(400, 4, 0, 0, 800, 300), htmltext.density(400, 20, 380, 18, 800, 300)
    assert prose > links >= 0 and htmltext.density(0, 3, 0, 0, 800, 300) == 0


def test_table(spark):
    rows = [(i, "u", h, 5) for i, (h, _) in enumerate(CASES.values())] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = htmltext.main_text(df).collect()
    assert len(got) == len(rows) and all(r.text == htmltext.extract(rows[r.page_id][2]) for r in got)
    assert htmltext.main_text(df.limit(0)).count() == 0


def test_generated_pages():
    """Of the driver's pages the article is all that is wanted."""
    import html
    import re

    for page_html, in duckdb.connect().execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*)</article>", page_html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", "", b).replace("<", "<"))).strip()
                  for b in re.split(r"</?(?:p|h1)>", re.sub(r"<br>", " ", inner)))
        assert htmltext.extract(page_html) == "\n\n".join(b for b in blocks if b)
