import html
import re
import time

import pytest
from hypothesis import given, settings, strategies as st

from tabrisk.llm import html_extract
from tabrisk.llm.html_extract import main_text

SCHEMA = "page_id long, url string, html string, text string, n_chars int"
LONG = "This paragraph is long enough, with a comma or two, to count as the main text of its page."
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>
<div id="cookie-notice"><p>We use cookies, a lot of them, and we tell you so in a long line of text, yes, we do.</p></div>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="wrap"><div class="content"><h2>Title &amp; more</h2>
<p>{LONG}<p>Second&nbsp;one   has <a href="/x>y">linked</a> words, and <b>bold
ones</b>.<ul><li>one item<li>two items</ul><script>if(a<b){{"</p>"}}</script><!-- <p>hidden</p> --><blockquote>quoted</blockquote></div>
<div class="sidebar"><p>{LONG} {LONG}</p></div><section id="comments"><p>{LONG} says a reader</p></section></div>
<form><p>{LONG}</p></form><footer>foot</footer></body></html>"""


def test_a_page():
    assert main_text(PAGE).split("\n\n") == ["Title & more", LONG, "Second one has linked words, and bold ones.", "one item", "two items", "quoted"]


def test_article_is_whole():
    page = (f"<body><div class=ad>{LONG}</div><article><header><h1>Head</h1><div class=by>me</div></header><div><p>{LONG}</p></div>"
            f"<p>Short.</p><aside>{LONG}</aside><p>End &lt;b&gt; &copy;</p><div class='comments'><p>{LONG}</p></div></article><footer>x</footer>")
    assert main_text(page) == f"Head\n\n{LONG}\n\nShort.\n\nEnd <b> ©"


def test_siblings_and_link_density():
    links = " ".join(f"<a href=/{i}>a link, of many, words {i}</a>" for i in range(20))
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG} More, and more, of it.</p></div><div><p>{links}</p></div></body>"
    got = main_text(page)
    assert got.count(LONG) == 3 and "a link" not in got


def test_marks_do_not_lose_the_article():
    article = f"<article><h1>Head</h1><p>{LONG}</p><p>Short.</p></article>"
    whole = f"Head\n\n{LONG}\n\nShort."
    for mark in ("class='page with-sidebar'", "class='content no-sidebar'", "class='post has-comments'", "id=social-science", "class=sidebar",
                 "class='layout search'", "id=comments", "class=content-sidebar-wrap"):
        assert main_text(f"<body><div {mark}>{article}</div><div class=ad><p>{LONG}</p></div></body>") == whole, mark
    plain = f"<h2>Head</h2><p>{LONG}</p><p>{LONG}</p>"
    for mark in ("class='page with-sidebar'", "id=social-science", "class='search'", "class=header-space", "class=alert"):
        assert main_text(f"<body><div {mark}>{plain}</div><div id=comments><p>{LONG} {LONG}</p></div></body>") == f"Head\n\n{LONG}\n\n{LONG}", mark
    assert main_text(f"<article><p>{LONG}</p><section id=social-science><p>{LONG}</p></section></article>") == f"{LONG}\n\n{LONG}"


def test_marked_elements_beside_the_article_go():
    article = f"<article><p>{LONG}</p></article>"
    for mark in ("class=sidebar", "class='related-posts'", "id=comments-area", "class='cookie-notice'", "role=search"):
        other = f"<article><p><a href=x>{LONG} {LONG}</a></p></article>"
        assert main_text(f"<body>{article}<div {mark}>{other}</div></body>") == LONG, mark
    many = f"<p>{LONG}</p>" * 9
    assert main_text(f"<body><div class=text><p>{LONG}</p></div><div class=comments>{many}</div></body>") == LONG


def test_parts_beside_the_best_container():
    """Of a page without article or main nothing of the text goes."""
    links = "".join(f"<li><a href=/{i}>a link, of many, words {i}</a>" for i in range(9))
    body = f"<div class=body><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div>"
    long = "\n\n".join([LONG] * 3)
    page = f"<body><div id=top><ul>{links}</ul></div><div id=content><h1>Title</h1><p>Short.</p>{body}<ul><li>item</ul><ul>{links}</ul></div><div>x</div></body>"
    assert main_text(page) == f"Title\n\nShort.\n\n{long}\n\nitem"
    assert main_text(f"<body><div id=a><div class=head><h1>Title</h1></div>{body}bare text</div></body>") == f"Title\n\n{long}\n\nbare text"
    strong = f"<section>{f'<p>{LONG}</p>' * 8}</section>"
    for box in ("<body>{}</body>", "<body><div>{}</div></body>"):
        page = box.format(strong + "<section><p>So this is the end of it all.</p></section>")
        assert main_text(page) == "\n\n".join([LONG] * 8 + ["So this is the end of it all."])
    page = f"<body><h1>Title</h1><div id=wrap><div class=one>{body}</div><div class=two><p>So this is the end of it all.</p></div></div></body>"
    assert main_text(page) == f"Title\n\n{long}\n\nSo this is the end of it all."


def test_broken_markup():
    for source, want in (("", ""), (None, ""), ("<", "<"), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<div><div", ""), ("</p></div>x", "x"),
                         ("<table><tr><td>a<td>b<tr><td>c</table>", "a\n\nb\n\nc"), ("<a href=\"x", ""), ("a<br>b", "a b"), ("<script>x", ""),
                         ("1 < 2 &amp; 3 > 2", "1 < 2 & 3 > 2"), ("<p>" + "<div>" * 3000 + "deep", "deep"), ("<!-- open", "")):
        assert main_text(source) == want, source


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href=x>", "</a>", "<article>", "</article>", "<li>", "<nav>",
                                 "</nav>", "<!--", "-->", "text, more", "<", ">", "\"", "<td>", "<br>", "<script>", "</script>"]), max_size=40))
def test_never_fails(parts):
    got = main_text("".join(parts))
    assert got == got.strip()


def test_pages_against_their_articles(spark):
    """All pages of the table hold one article of plain blocks."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = html_extract.extract(pages).collect()
    assert len(got) == len(source)
    for r in got:
        inner = source[r["page_id"]].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>|<br>", inner)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_rows(spark):
    rows = [(1, "u", PAGE, "clash", 0), (1, "u", PAGE, "clash", 0), (2, None, None, None, None), (None, "u", "", "", 0),
            (3, "v", f"<article><p>{LONG * 3000}</p></article>", "", 0)]
    got = html_extract.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["page_id"]), str(r["url"]), r["n_chars"]) for r in got) == sorted(
        [("1", "u", len(main_text(PAGE)))] * 2 + [("2", "None", 0), ("None", "u", 0), ("3", "v", len(LONG) * 3000)])
    assert html_extract.extract(spark.createDataFrame([], SCHEMA)).collect() == []


PARA = "A long enough paragraph of the article, with commas, that says one thing after another, and so on."


def test_form_round_the_page_keeps_the_article():
    page = f"<body><form id=aspnetForm><div><h1>Title</h1><p>{PARA}</p><p>{PARA} Again.</p></div><input name=q><button>Go</button></form></body>"
    assert html_extract.main_text(page) == f"Title\n\n{PARA}\n\n{PARA} Again."
    page = f"<form><main><article><h1>Title</h1><p>{PARA}</p></article></main></form>"
    assert html_extract.main_text(page) == f"Title\n\n{PARA}"
    page = f"<main><form><h1>Title</h1><p>{PARA}</p></form></main>"
    assert html_extract.main_text(page) == f"Title\n\n{PARA}"
    page = f"<div><h1>Title</h1><p>{PARA}</p><p>{PARA}</p><form><p>Write to us, now, please, if you like.</p><input></form></div>"
    assert html_extract.main_text(page) == f"Title\n\n{PARA}\n\n{PARA}"


def test_comments_dialogs_and_hidden_parts_go():
    extra = "Nice text, I liked it very much, thank you."
    for element in ('<div id="comment-12" class="comment-body">', '<div class="comment-content">', '<li class="comment_author">', '<div id=comment-form>',
                    '<div role="dialog">', '<div style="color:red; display: none">', '<div style="visibility:hidden">'):
        tag = element[1:].split(" ")[0]
        page = f"<main><h1>Title</h1><p>{PARA}</p>{element}<p>{extra}</p></{tag}></main>"
        assert html_extract.main_text(page) == f"Title\n\n{PARA}", element
    page = f'<main><h1>Title</h1><div class="body-text content-12" style="display:block"><p>{PARA}</p></div></main>'
    assert html_extract.main_text(page) == f"Title\n\n{PARA}"


@pytest.mark.parametrize("page", ["<b>" * 50_000 + "</i>" * 50_000, "</i>" * 100_000, "<b><div>" + "<i>" * 50_000 + "</b>" * 50_000,
                                  "<b>" * 50_000 + "x<hr>" * 50_000, "<header>" * 50_000, "<div>" * 50_000 + "<p>x" * 50_000,
                                  "<ul>" + "<li><b>" * 50_000, "<a <a '" * 50_000])
def test_time_is_linear(page):
    begin = time.time()
    html_extract.main_text(f"<article><h1>Title</h1><p>{PARA}</p></article>" + page)
    assert time.time() - begin < 4
