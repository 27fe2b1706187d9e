import html
import re
import time

import numpy as np
import pytest

from convlake.llm import html_extract
from convlake.llm.html_extract import extract, main_text

SITE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="top"><h2>Site</h2></header>
<nav><a href="/">Home</a></nav><div id="cookie-notice">We use cookies, as ever.</div><div class="ad">Buy it now!</div>%s
<aside><p>A sidebar, with commas, and a sentence.</p></aside><section class="comments"><article class="comment"><p>Nice post, thank you!</p></article></section>
<form><p>Your name, please:</p><input><button>Send</button></form><script>var t="</p>";</script><footer>&copy; 2020</footer></body></html>"""
BODY = "<h1>Title &amp; more</h1><p>A first\n paragraph, long enough,&nbsp;with <b>bold</b> words and <a href='x'>a link</a>.<br>Next line.<p>Short.</p><ul><li>one<li>two</ul><p>The last paragraph, with commas, and an end.</p>"
TEXT = "Title & more\n\nA first paragraph, long enough, with bold words and a link. Next line.\n\nShort.\n\none\n\ntwo\n\nThe last paragraph, with commas, and an end."


def test_article_is_found_by_element_class_or_ratio_alone():
    for open_, close in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div class="x"><div>', "</div></div>"), ('<div class="with-sidebar"><article>', "</article></div>")):
        assert main_text(SITE % (open_ + BODY + close)) == TEXT, open_


PLAIN = """<html><body><div><div>Home</div><div>About us</div><div>Contact</div></div><div><div>Some words of a teaser</div><div>More</div></div>
<section>%s</section><div><div>Cheap shoes, now</div><div>Top ten of the week</div><div>All the terms</div></div></body></html>"""


MORE = "One more paragraph of the article, which is longer than the others, with commas, as such paragraphs are, and with an end."
LONG, LONG_TEXT = f"{BODY}<p>{MORE}<p>{MORE}", f"{TEXT}\n\n{MORE}\n\n{MORE}"


def test_tag_path_ratios_select_the_article_where_nothing_names_it():
    assert main_text(PLAIN % LONG) == LONG_TEXT
    assert main_text(PLAIN % f"<div>{LONG}</div>") == LONG_TEXT


@pytest.mark.parametrize("change", [lambda s: np.ones(len(s)), lambda s: s.max() - s, lambda s: np.arange(len(s), 0, -1.0)])
def test_other_scores_give_other_text(monkeypatch, change):
    own = html_extract.path_scores
    monkeypatch.setattr(html_extract, "path_scores", lambda blocks, tree: change(own(blocks, tree)))
    assert main_text(PLAIN % LONG) != LONG_TEXT


def test_an_element_named_article_is_a_prior_only():
    teaser = "<article><h3>A teaser</h3></article>"
    assert main_text(f"<body>{teaser}<div>{BODY}</div></body>").endswith(TEXT)
    assert main_text(f'<body><article class="discussion">{BODY}</article></body>') == TEXT


def test_forms():
    form = "<form><p>Your name, please:</p><input><button>Send</button></form>"
    assert main_text(f"<form id='aspnet'><body><article>{BODY}</article>{form}</body></form>").startswith(TEXT)
    assert main_text(f"<body><form><article>{BODY}</article></form>{form}</body>") == TEXT
    assert main_text(f"<body><article>{BODY}{form}</article></body>") == TEXT


@pytest.mark.parametrize("page", ["<div>" * 40_000 + "text", "<center>" * 40_000 + "text", "<p>a<x>" * 20_000, "<b x'" * 40_000, "<b x'\"" * 40_000, "<div a='>" * 40_000, "<li>x" * 20_000, "</div>" * 40_000, "<!" * 40_000, "<" * 80_000, "<div>x" * 20_000])
def test_time_is_linear(page):
    begin = time.process_time()
    main_text(page[: len(page) // 4])
    quarter = time.process_time() - begin
    begin = time.process_time()
    main_text(page)
    assert time.process_time() - begin < 8 * quarter + 0.5


def test_linked_blocks_of_the_article_stay():
    link = "<a href='x'>%s</a>"
    words = "A sentence of the article, with commas, which is long enough to be one."
    body = f"<h1>{link % 'Linked title'}</h1><p>{words}</p><h2>{link % 'Linked heading'}</h2><p>{words}</p><blockquote>{link % 'Linked quotation'}</blockquote><table><tr><td>{link % 'Cell one'}<td>{link % 'Cell two'}</table>"
    body += f"<figure><figcaption>{link % 'Linked caption'}</figcaption></figure><ul><li>{link % 'A single item'}</ul><h2>Sources</h2><ol><li>{link % 'First source'}<li>{link % 'Second source'}</ol>"
    expected = ["Linked title", words, "Linked heading", words, "Linked quotation", "Cell one", "Cell two", "Linked caption", "A single item", "Sources", "First source", "Second source"]
    for open_, close in (("<article>", "</article>"), ('<div class="post-content">', "</div>")):
        assert main_text(SITE % (open_ + body + close)) == "\n\n".join(expected)
    menu = f"<ul><li>{link % 'Home'}<li>{link % 'About'}</ul><div>{link % 'One'} | {link % 'Two'}</div>"
    page = f"<body>{menu}{body}<p>{words}</p><section>{menu}</section>"
    assert main_text(page) == "\n\n".join([*expected, words])


def test_an_article_in_several_elements_is_whole():
    parts = [f"Sentence {i} of the article, with commas, which is long enough, all in all, to be one." for i in range(5)]
    p = [f"<p>{x}</p>" for x in parts]
    advert = '<div class="ad"><p>Buy it now, today, or never!</p></div>'
    one, two, most = "".join(p[:3]), "".join(p[3:]), "".join(p[:4])
    for a, b in ((one, two), (most, p[4]), (p[0], "".join(p[1:]))):
        for open_, close in (('<div class="article-body">', "</div>"), ("<article>", "</article>"), ('<article><div class="entry-content">', "</div></article>"), ('<div><div class="article-body">', "</div></div>")):
            assert main_text(SITE % f"{open_}{a}{close}{advert}{open_}{b}{close}") == "\n\n".join(parts), open_
    assert main_text(SITE % f"<main><article>{one}</article>{advert}<article>{two}</article></main>") == "\n\n".join(parts)
    assert main_text(SITE % f"<article>{one}{two}</article><article><a href='x'>Other</a></article>") == "\n\n".join(parts)


def test_hidden_is_an_attribute_not_a_word():
    words = "A sentence of the article, with commas, which is long enough to be one."
    for shown in ('title="the hidden garden"', 'data-x="aria-hidden=true"', 'title="display: none"', 'aria-hidden="false"', "alt='hidden'"):
        assert main_text(f"<article><div {shown}><p>{words}</p></div></article>") == words, shown
    for hidden in ("hidden", "HIDDEN=''", 'class="x" hidden', 'aria-hidden="true"', "aria-hidden=true", 'style="color:red; display : none"'):
        assert main_text(f"<article><p>{words}</p><div {hidden}><p>{words}</p></div></article>") == words, hidden


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<script>x</script>") == main_text("<nav>a</nav>") == ""
    assert main_text("just &lt;text") == "just <text"
    assert main_text("<p>cut off &am") == "cut off &am"
    assert main_text("<article><p>open") == "open"
    assert main_text("<p>a<br>b\n c") == "a b c"
    assert main_text("a < b and c > d") == "a < b and c > d"
    assert main_text("<p>" + "word " * 50_000) == ("word " * 50_000).strip()


def test_pages_keep_every_article_paragraph(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    got = {r.page_id: r for r in extract(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).collect()}
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1|h2|li|ul)[^>]*>", re.sub(r"</?b>", "", article.replace("<br>", "\n")))
        expected = "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)
        assert got[r.page_id].text == expected and got[r.page_id].n_chars == len(expected)


def test_nulls_empty_table_and_clashing_columns(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    assert extract(spark.createDataFrame([], schema)).count() == 0
    got = extract(spark.createDataFrame([(None, None, None, "x", 1), (1, "u", "<p>a", "x", 1), (1, "u", "<p>a", "x", 1)], schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]


TWO = "<p>The first paragraph is a long one, with commas, and it ends here.</p><p>The second one is as long as the first, or longer, with an end.</p>"
TWO_TEXT = "The first paragraph is a long one, with commas, and it ends here.\n\nThe second one is as long as the first, or longer, with an end."


@pytest.mark.parametrize("name", ['div class="post no-sidebar"', 'div class="content-with-sidebar"', 'section class="has-share"', 'div class="sidebar-left"', 'div id="comment-enabled"', 'div class="newsletter form"'])
def test_words_do_not_drop_what_holds_the_page(name):
    assert main_text(f"<body><h1>Title</h1><{name}>{TWO}</{name.split()[0]}></body>").removeprefix("Title\n\n") == TWO_TEXT
    assert main_text(f"<body><{name}><h1>Title</h1>{TWO}</{name.split()[0]}><div class='sidebar'><p>Other, short.</p></div></body>") == f"Title\n\n{TWO_TEXT}"


@pytest.mark.parametrize("tag", ['section id="user-feedback"', 'section class="comments"', 'div id="disqus_thread" class="replies"'])
def test_comments_behind_a_named_article_stay_out(tag):
    comments = "<p>I read this, and I liked it, all of it, from the first line to the last.</p>" * 2
    for name in ("main", "article"):
        assert main_text(f"<body><{name}>{TWO}</{name}><{tag}>{comments}</{tag.split()[0]}></body>") == TWO_TEXT
    long = comments * 40
    assert main_text(f"<body><article>{TWO}</article><section class='comments'>{long}</section></body>") == TWO_TEXT


def test_adverts_and_notices_inside_the_article_go():
    inside = "<div class='ad-slot'>Buy it now!</div><div class='newsletter'><p>Sign up, for free.</p></div>"
    first, second = TWO.split("</p><p>")
    assert main_text(f"<body><article>{first}</p>{inside}<p>{second}</article></body>") == TWO_TEXT
    assert main_text(f"<body><div class='x'>{first}</p>{inside}<p>{second}</div></body>") == TWO_TEXT
