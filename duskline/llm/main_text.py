"""Main text of HTML pages: flat blocks, classified by a decision tree.

The tree looks at a block's words and link density, those of its neighbours, and the kind of
containers around it; it is trained on the labelled blocks of the pages below (`data-keep` tells the
label and is no feature). Blocks that it keeps are joined by an empty line.

Defined cases: a null or empty html, and a page without main text, give an empty text; unclosed
and crossed tags are tolerated; repeated rows are extracted one by one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decision_tree import Node, fit, predict
from .html_blocks import blocks_of, features_of
from .tables import shared

SEPARATOR = "\n\n"

_LONG = "The river rose slowly through the night and by the morning the lower fields were under water again."
_MORE = "Farmers moved their animals to the hill, where the old barn gave shelter until the rain had passed."
_SHORT = "It rained."

LABELLED = [
    f"""<html><head><title>River</title></head><body data-keep="0"><header><a href="/">Home</a> <p>Daily paper</p></header>
    <nav><ul><li><a href="/a">News</a></li><li><a href="/b">Sport</a></li><li><a href="/c">Culture</a></li></ul></nav>
    <div class="ad">Buy new boots today and pay later.</div>
    <article data-keep="1"><h1>River rises</h1><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE}</p><ul><li>Three fields</li><li>Two roads</li></ul>
    <blockquote>We have seen worse, said one farmer.</blockquote><p>See <a href="/d">the map</a>.</p></article>
    <aside><h2>Related</h2><p>{_MORE}</p><ul><li><a href="/e">Older floods</a></li></ul></aside>
    <footer>&copy; Daily paper &middot; All rights reserved</footer></body></html>""",
    f"""<body data-keep="0"><div id="topbar">Log in or sign up</div><div class="sidebar"><p>{_LONG}</p><p>Short note</p></div>
    <div class="cookie-notice">We use cookies to make this page better for all its readers. <button>Fine</button></div>
    <main data-keep="1"><h1>Barn</h1><p>{_MORE}</p><h2>Roof</h2><p>{_LONG}</p><p>{_SHORT}</p><table><tr><td>Wood</td><td>Stone</td></tr></table></main>
    <div class="comments" id="comments"><h3>Comments</h3><p>{_LONG} I liked this very much.</p><p>Me too</p></div>
    <form><p>Write to us about this story and what you think of it.</p><label>Name</label></form><div class="footer">Imprint</div></body>""",
    f"""<body data-keep="0"><ul class="menu"><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul>
    <div class="post-content" data-keep="1"><p>{_LONG}</p><p>{_SHORT}</p><p>{_MORE} <a href="/x">More of it</a></p><div class="share" data-keep="0">Share this with your friends</div><p>{_MORE}</p></div>
    <div class="related-posts"><p>{_LONG}</p><p>Old story</p></div><div id="footer"><p>Terms and privacy of the paper and its partners</p></div></body>""",
    f"""<body data-keep="0"><p><a href="/1">Start</a> | <a href="/2">Archive</a> | <a href="/3">Contact</a></p>
    <h1 data-keep="1">A plain page about water</h1><p data-keep="1">{_LONG}</p><p data-keep="1">{_MORE}</p><p data-keep="1">{_LONG} {_MORE}</p>
    <p><a href="/4">Next page</a></p><p>&copy; 2020 by the paper</p></body>""",
    f"""<body data-keep="0"><div><a href="/1">Start</a></div><div><a href="/2">All stories of this week</a></div>
    <h1 data-keep="1">Another plain page</h1><div data-keep="1">{_MORE}</div><div data-keep="1">{_LONG} {_MORE}</div><div data-keep="1">{_MORE}</div>
    <div>&copy; the paper &middot; contact</div></body>""",
    f"""<body data-keep="0"><article data-keep="1"><header><h1>Short one</h1></header><p>{_SHORT}</p><aside data-keep="0">{_LONG}</aside>
    <nav data-keep="0"><a href="/p">Page two</a></nav><p>{_MORE}</p><footer data-keep="0">Filed under water</footer>
    <section class="comments" data-keep="0"><p>{_MORE}</p><article><p>{_LONG} Good.</p></article></section></article><div class="newsletter">Get our letter every week by mail</div></body>""",
    f"""<body data-keep="0"><nav><a href="/1">Home</a></nav><div class="ad">{_LONG}</div><article data-keep="1"><h1>One heading alone</h1></article>
    <footer>&copy; w.example.org &middot; {_MORE}</footer></body>""",
    # Pages that end in their article, with and without containers; a last block may be short.
    f"""<p data-keep="1">{_LONG}</p>""",
    f"""<body data-keep="0"><nav><a href="/1">Home</a></nav><article data-keep="1"><h1>Last words</h1><p>{_MORE}</p><p>{_SHORT}</p></article></body>""",
    f"""<body data-keep="0"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul><h1 data-keep="1">Water again</h1><p data-keep="1">{_MORE}</p></body>""",
    f"""<main data-keep="1"><p>{_LONG}</p><p>The mark &copy; stands on each map of the firm, and its owners say so: {_MORE}</p></main>""",
    f"""<div data-keep="1">{_MORE} {_LONG}</div><div data-keep="0">&copy; 2019 by the paper</div>""",
    f"""<p data-keep="1">{_LONG}</p><p data-keep="1">{_SHORT}</p><p data-keep="1">{_MORE}</p><p data-keep="0"><a href="/9">Up</a></p>""",
]


def trained() -> Node:
    rows, labels = [], []
    for page in LABELLED:
        blocks = blocks_of(page)
        rows += features_of(blocks)
        labels += [bool(b.label) for b in blocks]
    return fit(np.array(rows), np.array(labels, float), least=1)


def extract(page: str | None, tree: Node) -> str:
    blocks = blocks_of(page)
    kept = zip(blocks, features_of(blocks), strict=True)
    return SEPARATOR.join(b.text for b, row in kept if predict(tree, row) >= 0.5)


def main_texts(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per row of `pages`."""
    tree = shared(pages.sparkSession, trained())

    def run(batches):
        known = tree()
        for batch in batches:
            texts = [extract(html.as_py(), known) for html in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return source.mapInArrow(run, "page_id long, url string, text string").withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
