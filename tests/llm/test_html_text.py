import random
import re
import time
from html.parser import HTMLParser

import pytest

from feldspar.llm import html_text as h

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";x(0);</script></head>
<body><header><h2>Site name</h2></header><nav><ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></ul></nav><!-- c --><div class="ad">Buy now, the best of all
offers is here for you today and tomorrow</div><div id="cookie-notice">We use cookies.</div>
<article><h1>A title&nbsp;here</h1><p><b>First   paragraph
with <a href=x>a link</a>.<br><p>Second &lt;b&gt; &eacute;&#8364; &amp one.</p><ul><li>item one<li>item two</ul><table><tr><td>cell</td></tr></table>
<aside>Related: <a href=q>thing</a></aside><form><label>Name</label><input></form><p>Last one.</p><section class="comments"><p>A reader wrote a long comment about all of this.</p></section></article>
<div class="sidebar"><p>Popular posts of the week and other things that nobody needs to read.</p></div><footer>&copy; 2020 me &middot; all rights</footer></body></html>"""
EXPECTED = ["A title here", "First paragraph with a link.", "Second <b> é€ & one.", "item one", "item two", "cell", "Last one."]


def test_article_is_taken_whole_and_nothing_else():
    assert h.main_text(PAGE) == "\n\n".join(EXPECTED)
    assert h.main_text(PAGE.replace("</body></html>", "").replace("</footer>", "")) == "\n\n".join(EXPECTED)
    assert h.main_text(PAGE.replace("</article>", "")) == "\n\n".join(EXPECTED)


def test_pages_without_an_article():
    body = "<p>" + "A paragraph of plain text that goes on for quite a number of words so that it is content. " * 3 + "</p>"
    page = f"<html><body><div class=menu><a href=1>One</a> <a href=2>Two</a></div>{body}{body}<div><a href=1>next</a> <a href=2>previous</a></div></body></html>"
    assert h.main_text(page).count("\n\n") == 1 and "previous" not in h.main_text(page)


def test_awkward_pages():
    assert h.main_text(None) == h.main_text("") == h.main_text("<") == h.main_text("<p>") == h.main_text("<!-- never closed <p>x</p>") == ""
    assert h.main_text("<article>a < b > c &unknown; &#x41;</article>") == "a < b > c &unknown; A"
    assert h.main_text("<article><p>x</p><script>never closed <p>y</p>") == "x"
    assert h.main_text("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>") == "deep"
    long = "word " * 200_000
    assert h.main_text(f"<article><p>{long}</p></article>") == long.strip()


def test_tree_agrees_with_its_table():
    agreed = sum(h.is_main(x) == label for x, label in h.LABELLED)
    assert agreed >= 0.95 * len(h.LABELLED)


def test_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None)], "page_id long, url string, html string, text string")
    rows = h.extract(pages).collect()
    assert sorted(len(r.text) for r in rows) == [0, len("\n\n".join(EXPECTED)), len("\n\n".join(EXPECTED))]
    assert h.extract(pages.where("false")).collect() == []


@pytest.mark.parametrize(
    "page",
    [
        '<div class="main with-sidebar"><p>Kept.</p></div>',
        '<article class="overflow-hidden"><p>Kept.</p></article>',
        '<article><div class="body has-comments"><p>Kept.</p></div></article>',
        '<article><p data-id="ad-12">Kept.</p></article>',
        '<article><p title="see id=ad">Kept.</p></article>',
        "<article><p data-x='class=\"ad\"'>Kept.</p></article>",
        '<article><div class="article-header"><p>Kept.</p></div></article>',
        "<article><math>Kept.</math></article>",
    ],
)
def test_names_say_only_what_they_are(page):
    assert h.main_text(page) == "Kept."


@pytest.mark.parametrize("name", ["ad", "ads-box", "site-footer", "comment-list", "cookieNotice", "sidebar-left", "page-header x", "ad-12", "social-share", "related-posts"])
def test_asides_go(name):
    assert h.main_text(f"<body><div class='{name}'><p>Some words that stand aside from all the rest of the page.</p></div><article><p>Kept.</p></article></body>") == "Kept."


def test_neighbours_decide_where_nothing_else_does():
    long = "A paragraph of plain text that goes on for quite a number of words so that it is content. " * 3
    short = "A short line."
    assert short in h.main_text(f"<body><div>{long}</div><div>{short}</div><div>{long}</div></body>")
    assert h.main_text(f"<body><div>x y</div><div>{short}</div><div>z</div></body>") == ""
    links = "<a href=1>One link</a> <a href=2>another link</a>"
    assert short not in h.main_text(f"<body><div>{links}</div><div>{short}</div><div>{links}</div><div>{long}</div></body>")
    used = set()

    def walk(node):
        if not isinstance(node, bool):
            used.add(node[0])
            walk(node[2])
            walk(node[3])

    walk(h.tree())
    assert used >= {0, 1, 2, 3, 4, 5}


@pytest.mark.parametrize("piece", ["<a '", "<b ", "<div>x", "<", '<a x="', "</b>", "<b></i>", "<article>", "<p><span>", "<li><div>", "<script>", "<!--", "<a href='x\">", "<ul><li>x", "&amp;", "<div class='ad x' ", "<a b=", "</script", "<title>"])
def test_hostile_pages_take_time_in_proportion(piece):
    for page in (piece * (1_000_000 // len(piece)), "<article>" + piece * (1_000_000 // len(piece)), "<script>" + piece * (1_000_000 // len(piece))):
        began = time.time()
        h.main_text(page)
        assert time.time() - began < 5


class Plain(HTMLParser):
    """The blocks of a well-formed page, read the plain way."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.out, self.text = [], [], ""
        self.feed(page)
        self.flush()

    def flush(self):
        if text := re.sub(r"\s+", " ", self.text).strip():
            self.out.append((text, any("article" in s for s in self.stack), any("aside" in s for s in self.stack)))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag in h.BLOCK:
            self.flush()
        says = {"article"} if tag == "article" else {"aside"} if tag in h.ASIDE or dict(attrs).get("class") == "ad" else set()
        self.stack.append({tag, *says})

    def handle_endtag(self, tag):
        if tag in h.BLOCK:
            self.flush()
        self.stack.pop()

    def handle_data(self, data):
        self.text += data


def test_blocks_equal_those_of_a_plain_reader():
    rnd = random.Random(3)

    def words():
        return " ".join(rnd.choice(["word", "a&amp;b", "&lt;p&gt;", "x\n  y", "é", "1 &gt; 0"]) for _ in range(rnd.randint(1, 12)))

    def page(depth):
        out = words() if rnd.random() < 0.5 else ""
        for _ in range(rnd.randint(0, 3) if depth else 0):
            tag = rnd.choice(["div", "section", "nav", "article", "div class='ad'", "div title='a > b'", "b", "em", "ul", "aside", "h2" if depth == 1 else "div"])
            out += f"<{tag}>{page(depth - 1)}</{tag.split()[0]}>" + (words() if rnd.random() < 0.4 else "")
        return out

    for _ in range(300):
        text = page(4)
        found = [(b.text, b.article, b.aside) for b in h.blocks(f"<div>{text}</div>")]
        assert found == Plain(f"<div>{text}</div>").out


def test_every_page_of_the_tables_is_its_article():
    """The invented pages have one article each, and what they put into it is known from their markup."""
    import pyarrow.parquet as pq

    for row in pq.read_table("/root/testdata/sf0.001/pages.parquet").to_pylist():
        page = row["html"] or ""
        found = re.search(r"(?s)<article>(.*?)(</article>|<footer>|$)", page)
        inner = re.sub(r"(?s)<!--.*?-->|<script.*?</script>", "", found[1]) if found else ""
        plain = [re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<br>", " ", x))).strip() for x in re.split(r"</?(?:p|h1|div|ul|li)[^>]*>", re.sub(r"</?[ab](?: [^>]*)?>", "", inner))]
        assert h.main_text(page) == "\n\n".join(p for p in plain if p)
