"""Main text of pages that were written and labelled by hand, and of the tables' pages by a rule of their own."""

from __future__ import annotations

import re
from html import unescape

from auditloom.llm import html_extract

#: (page, main text); none comes from the generator that the model is fitted on
PAGES = [
    (
        """<!doctype html><html lang="en"><head><meta charset="utf-8"><title>Tides | Harbour Weekly</title>
<script type="application/ld+json">{"@type": "NewsArticle", "headline": "Tides"}</script></head>
<body class="single-post"><a class="skip-link" href="#main">Skip to content</a>
<div id="cookie-banner" role="dialog"><p>We use cookies to improve this site. <a href="/privacy">Read more</a></p><button>Accept all</button></div>
<header class="site-header"><a href="/">Harbour Weekly</a><nav class="primary-menu"><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/food">Food</a></li></ul></nav></header>
<main id="main"><article class="post type-post"><h1 class="entry-title">Why the spring tide came early</h1>
<div class="entry-content"><p>On Monday the water stood a hand's breadth above the old quay, three days before anyone had expected it.
Harbour master Ines Duval had seen it coming.</p>
<p>&ldquo;The wind had been pushing from the west all week,&rdquo; she said, &ldquo;and the moon did the rest.&rdquo;</p>
<h2>What happens next</h2><p>The town will raise the gates by forty centimetres before autumn, at a cost of two million.</p></div></article></main>
<aside class="widget-area"><section class="widget"><h3>Most read</h3><ul><li><a href="/1">Bakery reopens</a></li><li><a href="/2">Ferry late again</a></li></ul></section></aside>
<section id="comments" class="comments-area"><h2>2 comments</h2><ol><li class="comment"><p>My cellar was wet on Sunday already.</p></li><li class="comment"><p>Thanks for the clear report, very helpful.</p></li></ol></section>
<footer class="site-footer"><p>&copy; 2024 Harbour Weekly. All rights reserved.</p><ul><li><a href="/about">About</a></li><li><a href="/contact">Contact</a></li></ul></footer></body></html>""",
        "Why the spring tide came early\nOn Monday the water stood a hand's breadth above the old quay, three days before anyone had expected it. "
        "Harbour master Ines Duval had seen it coming.\n“The wind had been pushing from the west all week,” she said, “and the moon did the rest.”\n"
        "What happens next\nThe town will raise the gates by forty centimetres before autumn, at a cost of two million.",
    ),
    (
        """<html><head><title>Sourdough</title><style>.ad{float:right}</style></head><body><div id="wrapper"><div id="header"><h2>Baker's Notes</h2></div>
<div class="navigation"><a href="/">Home</a> | <a href="/breads">Breads</a> | <a href="/cakes">Cakes</a></div>
<div class="content"><h1>A plain sourdough</h1><p>This loaf needs a day, most of which it spends alone in a bowl, so start it in the evening and bake it after lunch.
<p>Mix 500 g of flour with 350 g of water and let it rest for an hour.<ul><li>Add the starter and the salt, and knead for ten minutes.<li>Fold it every hour, four times in all.
<li>Shape it, and leave it in the cold overnight.</ul><p>Bake it hot, at 240 degrees, for about forty minutes, until the crust is dark.</div>
<div class="sidebar"><div class="newsletter"><h4>Letters</h4><form action="/subscribe"><input type="email"><button>Subscribe</button></form></div></div>
<div class="sponsored"><p>Mixers now at half the price. <a href="//shop">Buy one today</a></p></div><div id="footer">Baker's Notes, printed with flour on both hands.</div></div></body></html>""",
        "A plain sourdough\nThis loaf needs a day, most of which it spends alone in a bowl, so start it in the evening and bake it after lunch.\n"
        "Mix 500 g of flour with 350 g of water and let it rest for an hour.\nAdd the starter and the salt, and knead for ten minutes.\nFold it every hour, four times in all.\n"
        "Shape it, and leave it in the cold overnight.\nBake it hot, at 240 degrees, for about forty minutes, until the crust is dark.",
    ),
    (
        """<!DOCTYPE html><html><body><nav><ol class="breadcrumb"><li><a href="/docs">Docs</a></li><li>Install</li></ol></nav><div class="container"><aside class="side"><ul><li><a href="#a">Install</a></li><li><a href="#b">Configure</a></li></ul></aside>
<article><h1>Installing the agent</h1><p>The agent runs on any machine with four gigabytes of memory. Download the archive, unpack it, and run the script below.</p>
<pre>tar xf agent.tar
./agent --start</pre><h2>Settings</h2><table><tr><th>Name</th><th>Default</th></tr><tr><td>port</td><td>8080</td></tr></table>
<blockquote><p>Restart the agent after each change of a setting, or it will go on with the old one.</p></blockquote></article></div>
<footer><p>Was this page helpful? <a href="#">Yes</a> <a href="#">No</a></p></footer></body></html>""",
        "Installing the agent\nThe agent runs on any machine with four gigabytes of memory. Download the archive, unpack it, and run the script below.\n"
        "tar xf agent.tar ./agent --start\nSettings\nName\nDefault\nport\n8080\nRestart the agent after each change of a setting, or it will go on with the old one.",
    ),
    (
        """<body><header role="banner"><p>The county gazette, since 1881</p><form class="search-form"><input name="q"><button>Search</button></form></header>
<section class="article-body"><h1>Council votes on the bridge</h1><p class="lead">By nine votes to six the council decided last night to keep the old bridge and to close it for lorries.</p>
<p>Several speakers had asked for a new one. The cost, said the treasurer, would have been four times as high.</p>
<div class="advert"><p>Garden chairs from nineteen ninety. While stocks last!</p></div>
<p>Work on the railings begins in May and should end before the summer holidays.</p></section>
<section class="related-posts"><h3>Related</h3><p><a href="/x">Bridge built in 1902</a></p><p><a href="/y">Lorries find a way round</a></p></section>
<div class="comments"><div class="comment"><b>olga</b><p>Finally a sound decision from the council, I say.</p></div></div></body>""",
        "Council votes on the bridge\nBy nine votes to six the council decided last night to keep the old bridge and to close it for lorries.\n"
        "Several speakers had asked for a new one. The cost, said the treasurer, would have been four times as high.\nWork on the railings begins in May and should end before the summer holidays.",
    ),
    (
        """<html><head><title>x</title></head><body><svg width="10"><article><h1>An open drawing</h1><p>The drawing above never ends, and a browser shows the rest of the page all the same, as it must.</p>
<p>So the text stays, in both paragraphs.</p></article><footer>Imprint</footer></body></html>""",
        "An open drawing\nThe drawing above never ends, and a browser shows the rest of the page all the same, as it must.\nSo the text stays, in both paragraphs.",
    ),
]


def test_pages_labelled_by_hand(spark):
    rows = [(k, "u", page) for k, (page, _) in enumerate(PAGES)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    blocks = [(set(got[k].split("\n")), set(text.split("\n"))) for k, (_, text) in enumerate(PAGES)]
    both, found, wanted = (sum(map(len, x)) for x in ([a & b for a, b in blocks], [a for a, _ in blocks], [b for _, b in blocks]))
    assert both >= 0.9 * wanted and both >= 0.9 * found, (both, found, wanted, got)


def test_pages_of_the_tables(spark):
    """These have one <article>, whose paragraphs are never nested: a few regular expressions tell its text."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").filter("html is not null")
    right = n = 0
    for r in html_extract.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inside = re.search(r"<article>(.*?)</article>", r.html, re.S)
        if inside:
            blocks = (" ".join(unescape(re.sub("<[^>]*>", " " if "<br" in b else "", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside[1]))
            n += 1
            right += r.text == "\n".join(b for b in blocks if b)
    assert n > 100 and right >= 0.97 * n
