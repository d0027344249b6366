import random
import time
from html.parser import HTMLParser

import pytest

from lakeloom.llm.html_text import extract_pages, main_text

ARTICLE = "<article><h1>Title</h1><p><b>First  line<br><p>Second &amp; more.</p><p>x</p></article>"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{a:b}}</style><script>var t="</p><article>no</article>";</script></head>
<body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy this thing now and save a lot of money today.</div>{ARTICLE}<footer>&copy; foot</footer>"""


def test_article_is_kept_whole():
    assert main_text(PAGE) == "Title\n\nFirst line\n\nSecond & more.\n\nx"
    assert main_text(PAGE + "</body></html>") == main_text(PAGE)


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("<article><p>a&nbsp;b<p>c<form>f</form><aside>g</aside></article>", "a b\n\nc"),
        ("<main><div>one<p>two</p>three</div><section class='comments'><p>reader</p></section></main>", "one\n\ntwo\n\nthree"),
        ("<article><p>a<script>x < 'y</script> b</p><p hidden>c</p><p style='display: none'>d</p></article>", "a b"),
        ("<article><p>open <!-- never closed", "open"),
        ("<article><p title='a > b'>t</p><ul><li>l1<li>l2</ul><table><tr><td>c1<td>c2</table></article>", "t\n\nl1\n\nl2\n\nc1 c2"),
        ("<article><header><h1>h</h1></header><p>&#72;&eacute;&lt;p&gt;</p></article><header>no</header>", "h\n\nHé<p>"),
    ],
)
def test_cases(html, text):
    assert main_text(html) == text


def test_pages_without_an_article_need_running_text():
    long = "This is a sentence of some length that goes on for a while. " * 3
    page = f"<body><div><a href=x>Home</a></div><p>Short.</p><div class='sidebar'>{long}</div><p>{long}</p><p>End of it.</p></body>"
    assert main_text(page) == f"{long.strip()}\n\nEnd of it."


def test_running_text_outside_an_article_is_kept():
    long = "This is a sentence of some length that goes on for a while. " * 3
    teaser = "<article><h2>Teaser</h2><p>Read on.</p></article>"
    page = f"<body><p>Short.</p>{teaser}<div class='content'><p>{long}</p><p>End of it.</p></div><ul><li><a href=x>{long}</a></li></ul>{teaser}<p>Stray.</p></body>"
    assert main_text(page) == f"Teaser\n\nRead on.\n\n{long.strip()}\n\nEnd of it.\n\nTeaser\n\nRead on."


LONG = "This is a sentence of some length that goes on for a while."


@pytest.mark.parametrize(
    "html, text",
    [
        ("<body><p>Hello there.</p></body>", "Hello there."),
        ("<body><h1>Head</h1><p>Short.</p><p><a href=x>A link</a></p><p>LONG LONG</p><ul><li><a href=a>1</a><li><a href=b>2</a><li><a href=c>3</a></ul>", "Head\n\nShort.\n\nA link\n\nLONG LONG"),
        ("<p>LONG LONG</p><footer>no</footer><p>Stray.</p><nav>no</nav><p>LONG LONG</p>", "LONG LONG\n\nLONG LONG"),
        ("<p>LONG LONG</p><div class='ad'>no</div><p>Yes.</p>", "LONG LONG\n\nYes."),
        ("<article><div class='related-work'>a</div><p id='notice-period'>b</p><section class='social-history'>c</section><div class='share post'>d</div></article>", "a\n\nb\n\nc\n\nd"),
        ("<article><p>a</p><div class='ad-box x'>n</div><div id='comments-section'>n</div><section class='related items'>n</section><p>b</p></article>", "a\n\nb"),
        ("<article><p>one</p></article><article class='comment'><p>reader</p></article><article><p>two</p></article>", "one\n\ntwo"),
        ("<article><p>say <button>Copy</button>it</p></article>", "say it"),
        ("<article><script>if(a<b){c='</p>'}</script><p>t</article>", "t"),
        ("<article><p>t<a href='x", "t"),
    ],
)
def test_windows_decide_and_names_drop_only_as_a_whole(html, text):
    assert main_text(html.replace("LONG", LONG)) == text.replace("LONG", LONG)


class Article(HTMLParser):
    """The text of the only article, by the standard library's parser: an independent extractor for plain pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.now, self.depth, self.skip = [], "", 0, 0

    def cut(self):
        if text := " ".join(self.now.split()):
            self.blocks.append(text)
        self.now = ""

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("aside", "form", "script")
        if tag in ("p", "h1", "h2", "li", "ul", "article", "aside", "form", "blockquote"):
            self.cut()
        if tag == "br":
            self.now += " "

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "li", "ul", "article", "aside", "form", "blockquote"):
            self.cut()
        self.depth -= tag == "article"
        self.skip -= tag in ("aside", "form", "script")

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.now += data


@pytest.mark.parametrize("seed", range(20))
def test_generated_articles_against_an_independent_extractor(seed):
    rng = random.Random(seed)
    words = lambda n: " ".join(rng.choice(("alpha", "be&amp;ta", "g&eacute;", "<b>delta</b>", "<a href=x>eps</a>", "x &lt; y", "zeta<br>")) for _ in range(n))
    parts = []
    for _ in range(rng.randrange(1, 25)):
        kind = rng.choice(("p", "p", "p", "h2", "blockquote", "ul", "aside", "form", "script"))
        body = "<li>" + "</li><li>".join(words(rng.randrange(1, 6)) for _ in range(3)) + "</li>" if kind == "ul" else words(rng.choice((1, 3, 40)))
        parts.append(f"<{kind}>{body}</{kind}>")
    article = "<article><h1>" + words(4) + "</h1>" + "".join(parts) + "</article>"
    page = f"<html><body><nav><a href=x>{words(3)}</a></nav><div class=ad>{words(30)}</div>{article}<footer>{words(9)}</footer></body></html>"
    parser = Article()
    parser.feed(article)
    assert main_text(page) == "\n\n".join(parser.blocks)


@pytest.mark.parametrize("piece", ["<a ", "<i>x ", "<![CDATA[>", "<!--", "<div>x", "<p>y <b>", '<a b="', "<script>", "<li><a>", "</b><i>", "&", "<"])
def test_very_long_hostile_pages_take_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    start = time.process_time()
    main_text(page)
    assert time.process_time() - start < 5


def test_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string").withColumnRenamed("url", "url")
    rows = extract_pages(pages).collect()
    assert sorted((r["page_id"], r["url"] or "", len(r["text"])) for r in rows) == [(1, "u", len(main_text(PAGE)))] * 2 + [(2, "", 0)]
    assert extract_pages(pages.limit(0)).count() == 0
    clashing = pages.selectExpr("page_id", "url", "html", "'x' AS text", "'y' AS _html")
    assert sorted(r["text"] for r in extract_pages(clashing, keep=("page_id", "url", "_html")).collect()) == sorted(["", main_text(PAGE), main_text(PAGE)])
    with pytest.raises(ValueError, match="text"):
        extract_pages(clashing, keep=("page_id", "text"))
