import html
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import html_text as H


def brute(page):
    """The article by the known layout of the test pages."""
    page = re.sub(r"<script>.*?</script>|<style>.*?</style>|<!--.*?-->", "", page, flags=re.S)
    if "<article>" not in page:
        return ""
    body = page.split("<article>", 1)[1].split("</article>")[0]
    body = re.sub(r"<[a-z/][^>]*\Z", "", body)
    blocks = [re.sub(r"<[^>]*>", " " if "<br>" in b else "", b) for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(b).split())))


def test_query(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = {r.page_id: r for r in H.op6_html_text(spark, d).collect()}
    assert got.keys() == pages.keys()
    for i, r in got.items():
        assert r.text == brute(pages[i].html), i
        assert r.n_chars == len(r.text) and r.url == pages[i].url


LONG = "This paragraph has quite a few words in it so that nobody can take it for a scrap of furniture."


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("   ", ""),
        (f"<p>{LONG}", LONG),
        (f"<article><p>a &lt;b&gt; &amp;amp; 1 < 2 &eacute;</p><p>{LONG}</p></article>", f"a <b> &amp; 1 < 2 é\n{LONG}"),
        (f"<article>one<b>two</b> <i>three</i><br>four<p>{LONG}<script>x('</p>')</script></article>", f"onetwo three four\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='ad'>{LONG}</div><aside>{LONG}</aside><p>end</p></article><section id=comments><p>{LONG}</p></section>", f"{LONG}\nend"),
        (f"<header><h1>Site</h1></header><main><header><h1>Title here</h1></header><p>{LONG}</p><form><p>{LONG}</p></form></main><footer>{LONG}</footer>", f"Title here\n{LONG}"),
        (f"<div class='cookie-notice'>{LONG}</div><div class=post-content><h2>Head</h2><p>{LONG}</p></div><div id=sidebarLeft>{LONG}</div>", f"Head\n{LONG}"),
        (f"<ul><li><a href=/a>one</a><li><a href=/b>two</a><li><a href=/c>three</a></ul><p>{LONG}<p>{LONG}", f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><p title='a > b'>x &am</p><p", f"{LONG}\nx &am"),
        (f'<article><p>{LONG}</p><p title="a>open</p><p>next</p></article>', f"{LONG}\nopen\nnext"),
        (f"<article><!-- <p>no</p> --><p>{LONG}</p><!-- unfinished <p>x</p>", LONG),
        ("<article><p>a \n\t b</p></article>", "a b"),
    ],
)
def test_pages(page, want):
    assert H.main_text(page) == want


def test_tree_fits_its_table():
    rows = np.array(H.LABELLED)
    assert (H.judge(rows[:, :-1]) == rows[:, -1]).mean() > 0.95


def test_long_and_odd_pages(spark):
    page = "<article>" + f"<p>{LONG}</p>" * 20000 + "<a b='" * 2000
    assert H.main_text(page).count("\n") == 19999
    assert H.main_text("<b>" * 50000 + LONG + "</x>" * 50000) == LONG
    pages = spark.createDataFrame([(1, None, 5), (1, f"<p>{LONG}", 6), (None, "", None)], "page_id long, html string, text int")
    assert sorted(r.text for r in H.extract(pages).collect()) == ["", "", LONG]
    assert H.extract(pages.limit(0)).count() == 0


def neutral(page):
    """The page without names, its landmarks as plain divs."""
    page = re.sub(r"<(/?)(?:nav|article|footer|header|aside|main|section)\b[^>]*>", r"<\1div>", page)
    return re.sub(r"\s(?:class|id|role)=(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", "", page)


def test_pages_without_names_and_landmarks(spark):
    kept = right = wanted = 0
    for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").collect():
        got, want = H.main_text(neutral(r.html or "")).split("\n"), brute(r.html or "").split("\n")
        kept, wanted = kept + len(got), wanted + len(want)
        right += sum((Counter(got) & Counter(want)).values())
    assert right / kept > 0.95 and right / wanted > 0.95, (right / kept, right / wanted)


def test_words_and_links_decide_many_blocks(spark):
    """Of the test pages' blocks; no mark is asked on the way to their leaf."""
    places, every = {name: i for i, name in enumerate(H.FEATURES)}, []
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        every.append(H.features(H.text_blocks(r.html or "")))
    unasked = 0
    for row in np.concatenate(every):
        node, asked = H.tree(), set()
        while not isinstance(node, int):
            asked.add(node[0])
            node = node[2] if row[node[0]] <= node[1] else node[3]
        unasked += places["mark"] not in asked and places["page_marked"] not in asked
    assert unasked / sum(map(len, every)) > 0.2
    used = set()

    def walk(node):
        if not isinstance(node, int):
            used.add(H.FEATURES[node[0]])
            walk(node[2])
            walk(node[3])

    walk(H.tree())
    assert {"words", "links", "words_before", "links_before", "words_after"} & used >= {"words", "links"} and len(used & {"words_before", "links_before", "words_after", "links_after"}) >= 2


@pytest.mark.parametrize(
    "page",
    [
        "<div class='content-sidebar-wrap'><article><p>{x}</p></article></div>",
        "<div class='page-with-sidebar'><article class='post no-comments tag-privacy'><p>{x}</p></article><div class='sidebar'>{x}</div></div>",
        "<form action=/go><div class=menu><a href=/>Home</a></div><article><p>{x}</p></article></form>",
        "<article><p>{x}</p></article><section class=comments><article class=comment><p>{x}</p></article></section>",
        "<main><p>{x}</p></main><div class=related-posts><article><p>{x}</p></article></div>",
    ],
)
def test_articles_in_wrappers(page):
    assert H.main_text(page.replace("{x}", LONG)) == LONG


def test_short_last_paragraph_of_a_page_without_marks():
    assert H.main_text(f"<h1>A title</h1><p>{LONG}</p><p>The end.</p><p>{LONG}</p><p>So it was.</p>") == f"A title\n{LONG}\nThe end.\n{LONG}\nSo it was."


PROSE = "This long paragraph of the text has quite a few words in it, as the paragraphs of real articles do, so that nobody would take it for a menu."


@pytest.mark.parametrize(
    "page",
    [
        "<html><body><nav><a href=a>Home</a></nav><article class='legal'><p>{0}</p><p>{0}</p></article></body></html>",
        "<html><body><nav><a href=a>Home</a></nav><section id='privacy'><h1>{0}</h1><p>{0}</p></section></body></html>",
        "<html><body><article class='newsletter'><p>{0}</p><p><label>{0}</label></p></article><div class='cookie'>We use cookies</div></body></html>",
        "<html><body><article><p>{0}</p><p>{0}</p></article><article class='comment'><p>{0}</p></article><article class='ad'><p>{0}</p></article></body></html>",
    ],
)
def test_articles_about_what_furniture_is_named_for(page):
    """Legal texts, privacy statements and newsletters are articles; comments and adverts aren't, whatever their element."""
    assert H.main_text(page.format(PROSE)) == f"{PROSE}\n{PROSE}"
