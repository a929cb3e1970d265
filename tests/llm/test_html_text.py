"""Main text: the pages of the test data against a plain reading of their article, other layouts, the tree, edge rows."""

import html
import re
import time

import numpy as np
import pytest

from tablewright.llm import html_text as ht
from tablewright.llm.queries import op5_html_text

TREE = ht.trained_tree()


def test_tree_fits_its_table_and_looks_at_neighbours():
    table = np.array(ht.LABELLED, dtype=np.float64)
    assert (TREE.predict(table[:, :-1]) == table[:, -1]).all()
    used = {ht.FEATURES[f] for f in TREE.feature if f >= 0}
    assert {"article", "other", "links"} <= used and used & {"words_before", "links_before", "words_after", "links_after"}


def plain_article(page):
    inner = re.search(r"<article>(.*?)(</article>|\Z)", page, re.DOTALL)[1].replace("<br>", " ")
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(p for p in parts if p)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_matches_a_plain_reading(spark, sf):
    pages = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()
    want = sorted((p.page_id, p.url, plain_article(p.html), len(plain_article(p.html))) for p in pages)
    assert sorted(map(tuple, op5_html_text(spark, f"/root/testdata/{sf}").collect())) == want


BODY = "This paragraph of the article is long enough to be told from what stands around it, with no link at all."
AROUND = """<header class="masthead"><h1>Site</h1><a href="/">Home</a></header><ul class="main-nav"><li><a href=1>One</a><li><a href=2>Two</a></ul>
<div class="cookie-notice"><p>We use cookies to make this long notice seem like an article paragraph of text.</p></div>%s
<div id="sidebar"><p>About the author, in a paragraph that is as long as any other of this page here.</p></div>
<form action=x><label>Mail</label><p>Subscribe to our newsletter to get many more articles like this one every week.</p></form>
<section class="comments"><p>I liked this article very much and write a long comment about it, as readers do.</p></section><footer>&copy; 2020</footer>"""


@pytest.mark.parametrize("wrapper", ['<article class="post tag-menu">%s</article>', '<main>%s</main>', '<div id="content">%s</div>', '<div class="entry-content has-sidebar">%s', "<div><div>%s</div></div>"])
def test_layouts(wrapper):
    inner = f"<h1>A title of six words here</h1><p>{BODY}<p class='ad-box'>Buy this now</p><p>{BODY} &amp; &eacute;\n\t more</p><ul class=share-links><li>Share</ul><p>{BODY}</p>"
    page = f"<!doctype html><html><head><title>t</title><style>p{{}}</style></head><body class='header-fixed sidebar-left'>{AROUND % (wrapper % inner)}<script>'<p>x</p>'</script></body>"
    # A container that is never closed takes the following parts in, which say themselves what they are.
    assert ht.main_texts([page], TREE) == [f"A title of six words here\n\n{BODY}\n\n{BODY} & é more\n\n{BODY}"]


@pytest.mark.parametrize("odd", ['<svg class="i"/>', "<iframe src=x>", "<button>", "<canvas/>", "<select>", "<textarea>", "<button><button>Send</button>", "<svg><path d='M0'/></svg>"])
def test_elements_without_text_that_are_not_closed(odd):
    page = f"<body><nav><a href=1>Home</a></nav><article><p>{BODY}</p>{odd}<p>{BODY}</p></article><p hidden>x</p></body>"
    assert ht.main_texts([page], TREE) == [f"{BODY}\n\n{BODY}"]


def test_open_scripts_take_the_rest():
    page = f"<article><p>{BODY}</p><script/><p>{BODY}</p>"
    assert ht.main_texts([page, page.replace("script/", "style")], TREE) == [BODY, BODY]


@pytest.mark.parametrize("name", ["id='film-reviews'", "class='head-line-story'", "class='popular related'", "id=search-forms"])
def test_names_of_the_whole_article_do_not_empty_it(name):
    around = "<nav><a href=1>Home</a></nav><div %s><h1>A title of six words here</h1><p>" + BODY + "</p><p>" + BODY + "</p></div>%s<footer>&copy;</footer>"
    want = f"A title of six words here\n\n{BODY}\n\n{BODY}"
    assert ht.main_texts([around % (name, "")], TREE) == [want]
    # Where the page has another article, or the part is the smaller one, the name is believed.
    own = f"<article><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></article>"
    assert ht.main_texts([around % (name, own)], TREE) == ["\n\n".join([BODY] * 3)]
    own = f"<div><p>{BODY}</p><p>{BODY}</p><p>{BODY}</p></div>"
    assert ht.main_texts([around % (name, own)], TREE) == ["\n\n".join([BODY] * 3)]


@pytest.mark.parametrize("heading", ["3 replies", "Comments (12)", "1 Kommentar", "Leave a reply"])
def test_comments_told_by_their_heading(heading):
    page = f"<article><h1>A title of six words here</h1><p>{BODY}</p></article><div><h3>{heading}</h3><div><p>{BODY}</p></div><p>{BODY}</p></div><div><p>{BODY}</p></div>"
    assert ht.main_texts([page], TREE) == [f"A title of six words here\n\n{BODY}\n\n{BODY}"]


def test_stray_tags_take_linear_time():
    start = time.process_time()
    page = "<div>" * 30_000 + "</ul>" * 30_000 + "<button>" * 30_000 + "<svg>" * 30_000 + f"<article><p>{BODY}</p>"
    assert ht.main_texts([page], TREE) == [BODY]
    assert time.process_time() - start < 10


def test_edge_rows(spark):
    bad = ["<", "<p", "</x>", "<!-- open", "<script>var a", "<p title='>'>", "&", "<a href=x", "</div></div><nav>"]
    rows = [(1, None, None), (2, "u", ""), (None, "u", f"<article><p>{BODY}"), (3, "u", f"<article><p>{BODY}"), (3, "u", f"<article><p>{BODY}")]
    rows += [(10 + i, "u", b) for i, b in enumerate(bad)] + [(99, "u", "<article>" + "<p>a b</p>" * 60_000 + "<div>" * 50_000)]
    pages = spark.createDataFrame([(*r, "t", 5) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = ht.extract(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows) and texts[1] == texts[2] == "" and texts[3] == texts[None] == BODY
    assert texts[99] == "\n\n".join(["a b"] * 60_000) and all(r.n_chars == len(r.text) for r in got)
    assert ht.extract(pages.where("false")).count() == 0
