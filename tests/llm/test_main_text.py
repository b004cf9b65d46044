from __future__ import annotations

import re
from html import unescape

import pytest

from kilnspark.llm.main_text import extract, main_text, op12_main_text

from .helpers import with_clashes

ONE = "The ferry left the harbour at dawn, long before the market opened, and nobody saw it go."
TWO = "By noon the wind had turned, the gulls were gone, and the harbour master began to worry about it."
THREE = "In the evening a light was seen far out, small and steady, where no light should have been."
PROSE = f"{ONE} {TWO} {THREE}"
PARAS = f"<p>{ONE}</p><p>{TWO}</p><p>{THREE}</p>"
LINKS = "<ul><li><a href=/a>Home</a></li><li><a href=/b>News from here</a></li><li><a href=/c>About us</a></li></ul>"

PAGES = {
    "article among the rest": (f"<body><header><h1>Site</h1></header><nav>{LINKS}</nav><article><h1>Lost ferry</h1>{PARAS}</article><aside><p>{ONE}</p></aside><footer>&copy; us, all of us, everywhere</footer>", f"Lost ferry {PROSE}"),
    "containers by class only": (f"<div id=header>Our site, since 1990, for all of you</div><div class='top-menu'>{LINKS}</div><div class=content>{PARAS}</div><div class=sidebar><p>{ONE}, {TWO}</p></div><div class='site-footer'>{THREE}</div>", PROSE),
    "no names at all": (f"<div>{LINKS}</div><div><div>{PARAS}</div></div><div><a href=x>one</a> <a href=y>two</a> <a href=z>three and more of it</a></div>", PROSE),
    "comments longer than the article": (f"<div class=post>{PARAS}</div><div class='comments-area'><ol class=comment-list>" + f"<li class=comment><article class=comment-body><p>{TWO} {TWO} {TWO}</p></article></li>" * 9 + "</ol></div>", PROSE),
    "notices and adverts inside": (f"<article><div class='cookie-consent'><p>We use cookies, as all do, to serve you better.</p></div><p>{ONE}</p><div class=ad>Buy now, pay later, regret never, at the harbour shop.</div><p>{TWO}</p><div id='newsletter-signup'><p>Get it all, weekly, in your inbox, for free.</p></div><p>{THREE}</p></article>", PROSE),
    "forms": (f"<main><p>{ONE}</p><form action=x><label>Your name, please</label><input name=n><textarea>Words, words</textarea><button>Send</button></form><p>{TWO}</p><select><option>One<option>Two</select><p>{THREE}</p></main>", PROSE),
    "a form around the whole page": (f"<form id=aspnetForm><div id=nav>{LINKS}</div><h1>Lost ferry</h1><div class=text>{PARAS}</div></form>", f"Lost ferry {PROSE}"),
    "layout named after a sidebar": (f"<body class='has-sidebar no-comments'><div class='content-sidebar-wrap'><main>{PARAS}</main><div class=sidebar>{TWO}</div></div>", PROSE),
    "short paragraphs stay": (f"<div class=entry>{PARAS}<p>Yes.</p><p>It was.</p></div>", f"{PROSE} Yes. It was."),
    "short article": ("<body><article><h1>Note</h1><p>Closed.</p></article><div>Rights in this page are held by the harbour, all of them.</div>", "Note Closed."),
    "chapters side by side": (f"<body><div>{PARAS * 4}</div><div>{PARAS}</div><div>Short line</div></body>", " ".join([PROSE] * 5)),
    "text without paragraphs": (f"<body><div>{ONE}<br><br>{TWO}<br>\n\n{THREE}</div></body>", PROSE),
    "no tags": (f" {ONE}\n\t{TWO}   {THREE} ", PROSE),
    "unclosed tags": (f"<article><p><b>{ONE}<br><p>{TWO}<div>{THREE}", PROSE),
    "lists, tables and quotes stay": (f"<article><p>{ONE}</p><ul><li>First<li>Second</ul><table><tr><td>a<td>b<tr><td>c</table><blockquote>{TWO}</blockquote><pre>x  =\n1</pre></article>", f"{ONE} First Second a b c {TWO} x = 1"),
    "menus inside without a name": (f"<article>{LINKS}{PARAS}</article>", PROSE),
    "links in prose stay": (f"<article><p>{ONE} <a href=x>See the map</a>, or <a href=y>the log</a>.</p><p>{TWO}</p></article>", f"{ONE} See the map, or the log. {TWO}"),
    "scripts, styles, comments, hidden text": (f"<html><head><title>T</title><style>p{{}}</style></head><body><script>if (a < b) document.write('<p>no</p>')</script><!-- <p>no --><p>{ONE}</p><noscript>no</noscript><p hidden>no</p><p style='display: none'>no</p><p>{TWO}</p><svg><text>no</text></svg>", f"{ONE} {TWO}"),
    "references and spaces": ("<article><p>Fish&nbsp;&amp; chips &lt;b&gt; &#8212; caf&eacute; &#x1F41F; 5&nbsp;&euro; &unknown;\n\n  end</p></article>", "Fish & chips <b> — café 🐟 5 € &unknown; end"),
    "inline tags join words": ("<article><p>un<b>believ</b>able <i>st</i>ory<span>-line</span></p></article>", "unbelievable story-line"),
    "own header of an article": (f"<article><header><h1>Lost ferry</h1></header>{PARAS}<footer>Filed under boats</footer></article>", f"Lost ferry {PROSE}"),
    "title before its text": (f"<div><h1>Lost ferry</h1><div class=story>{PARAS}</div><h3>Related</h3>{LINKS}</div>", f"Lost ferry {PROSE}"),
    "roles": (f"<div role=navigation>{LINKS}</div><div role=main>{PARAS}</div><div role=contentinfo>{TWO}</div>", PROSE),
    "long-form is no form": (f"<div class='long-form'>{PARAS}</div>", PROSE),
    "quotes in attributes": (f"<article data-x='a > b' title=\"it's\"><p class=x\">{ONE}</p></article>", ONE),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    html, want = PAGES[name]
    assert main_text(html) == want


def test_broken_deep_and_long_pages_take_linear_time():
    for piece in ("<b>", "<div>", "<p><table><tr><td><b><div>", '<a href="', "<!--", "<b", "</", "<ul><li><a>x</a>", "<article><div class=ad>", "<form><h1>x", "&", "<![CDATA[", "<p></div>"):
        main_text(piece * 20000 + "end")
    assert main_text("<div>" * 50000 + PARAS) == PROSE
    assert main_text("<article>" + f"<p>{ONE}</p>" * 20000 + "</article>") == " ".join([ONE] * 20000)


def test_rows(spark):
    rows = [(1, "http://a/", PAGES["forms"][0]), (1, "http://a/", PAGES["forms"][0]), (None, None, None), (2, "b", ""), (3, "c", "<html></html>"), (4, "d", "<p>" + "word, " * 400_000)]
    df = with_clashes(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumnRenamed("n", "n_chars")
    got = sorted((tuple(r) for r in extract(df).collect()), key=str)
    long = ("word, " * 400_000).strip()
    assert got == sorted([(1, "http://a/", PROSE, len(PROSE))] * 2 + [(None, None, "", 0), (2, "b", "", 0), (3, "c", "", 0), (4, "d", long, len(long))], key=str)
    assert extract(df.limit(0)).collect() == []


def test_the_query_against_plain_cutting(spark, sf_dir):
    """The given pages keep their text in one article element and bare tags: patterns cut it out."""
    for page in op12_main_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())
        assert (page.text, page.n_chars) == (want, len(want))
