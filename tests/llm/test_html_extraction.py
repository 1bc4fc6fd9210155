import math
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from pixelloom.llm import html_extraction as he
from pixelloom.llm.html_extraction import Page, host_column, html_extraction, node_importance

FRAME = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><a href="/">Site</a></header><nav><ul><li>Home<li>News</ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
<div id="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p><b>One<br><p>Two&nbsp;2 <i>it</i>alic</p><form>Mail <input></form>{0}</article>
<section class="comments"><p>First!</p></section><aside>Side</aside><footer>&copy; all</footer></body></html>"""


def text_of(source):
    return " ".join(t for _, t in Page(source).main_blocks())


def test_one_page():
    assert text_of(FRAME.format("<ul><li>a<li>b</ul><pre>x\n  y</pre>")) == "Title & more One Two 2 italic a b x y"
    assert text_of("<p>no article<div>two</div><script>x") == "no article two"
    assert text_of("<main><p>in</main><p>out") == "in"
    assert text_of("<table><tr><td>a<td>b<tr><td>c</table> d < 3 &lt;b&gt;") == "a b c d < 3 <b>"
    assert text_of(None) == text_of("") == text_of("<!-- open") == text_of("<style>p") == ""
    assert text_of("<p class='x>y'>q</p><p data-a=\"</p>\">r") == "q r"
    assert text_of("<div>" * 3000 + "deep") == "deep"


def test_hosts(spark):
    hosts = {
        "https://A.example.com:80/x?y": "a.example.com", None: "", "http://[bad": "", "nothing": "", "//b.example/path": "b.example", "http://user:pw@c.example?q": "c.example",
        "http://[::1]:8080/x": "[::1]", "mailto:x@d.example": "", "http://e.example": "e.example",
    }
    df = spark.createDataFrame([(u,) for u in hosts], "url string")
    assert {r.url: r.h for r in df.withColumn("h", host_column(F.col("url"))).collect()} == hosts


def site():
    rows = []
    for i in range(40):
        body = f"<div><div>Subscribe now and never miss a story</div><div><p>Story {i} begins here</p><p>It ends with {i * 7}</p></div><div>All rights reserved</div></div>"
        rows.append((i, f"http://big.example/{i}", f"<html><body>{body}</body></html>", "x"))
    rows += [(100 + i, f"http://few.example/{i}", "<body><div>Same text</div></body>", None) for i in range(3)]
    return rows + [(200, None, "<p>lone</p>", None), (200, None, "<p>lone</p>", None), (None, "http://e.example", None, None), (201, "bad url", "", None)]


def test_repeated_branches_go(spark):
    df = spark.createDataFrame(site(), "page_id long, url string, html string, text string")
    got = html_extraction(df).select("page_id", "text").collect()
    assert len(got) == len(site())
    by = {r.page_id: r.text for r in got}
    for i in range(40):
        assert by[i] == f"Story {i} begins here It ends with {i * 7}"
    assert by[100] == "Same text" and by[200] == "lone" and by[None] == "" and by[201] == ""
    joined = html_extraction(df, broadcast_rows=0).select("page_id", "text").collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))
    assert html_extraction(df.limit(0)).select(F.count("*")).first()[0] == 0


def test_time_is_linear_in_depth():
    began = time.perf_counter()
    assert text_of("<div>" * 100_000 + "deep") == "deep"
    assert text_of("<p><table><tr><td>" + "<div>" * 50_000 + "x") == "x"
    assert text_of("<ul><li>" * 50_000 + "y") == "y"
    assert time.perf_counter() - began < 20


def brute_importance(pages):
    """{(host, path): worth} by the definition, from parsed pages."""
    parsed = [(host, Page(source)) for host, source in pages if host]
    signed = he._signed

    def measured(group):
        have, texts, styles, parent = Counter(), defaultdict(Counter), defaultdict(Counter), {}
        for page in group:
            have.update({0, *map(signed, page.parents)})
            parent.update({signed(p): signed(q) for p, q in page.parents.items()})
            for p, t in {(signed(e.path), t) for e, t, *_ in page.blocks}:
                texts[p][t] += 1
            for p, s in page.sequences.items():
                styles[signed(p)][s] += 1
        out = {}
        for p, counts in texts.items():
            m = have[p]
            if m < he.FEWEST:
                out[p] = m, None
                continue
            # A text on k pages alike has the entropy log k.
            content = 1 - sum(math.log(k, m) for k in counts.values()) / len(counts)
            q, around = parent.get(p, 0), 0.0
            if p and have[q] >= he.FEWEST and styles[q]:
                total = sum(styles[q].values())
                around = -sum(k / total * math.log(k / total, have[q]) for k in styles[q].values())
            out[p] = m, 1 - (1 - content) * (1 - he.LIFT * around)
        return out

    def moved(start, m, evidence, inertia):
        return start if evidence is None else (math.log(m) * evidence + inertia * start) / (math.log(m) + inertia)

    everywhere = measured([page for _, page in parsed])
    out = {}
    for host in {h for h, _ in parsed}:
        for p, found in measured([page for h, page in parsed if h == host]).items():
            out[host, p] = moved(moved(he.START, *everywhere[p], he.INERTIA[0]), *found, he.INERTIA[1])
    return out


def test_importance_matches_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(160):
        menu = "".join(f"<li>{rng.choice('abcdef')}" for _ in range(rng.randint(2, 4)))
        parts = "".join(rng.choice(["<p>", "<h2>", "<div class='x1'>"]) + f"t{rng.randrange(90)}" for _ in range(rng.randint(1, 6)))
        rows.append((rng.choice(["a.x", "a.x", "b.x", "c.x", "", "rare.x" if i < 9 else "a.x"]), f"top {i % 3}<ul>{menu}</ul><section>{parts}</section><nav>n</nav>"))
    df = spark.createDataFrame(rows, "host string, html string").repartition(5)
    got = {(r.host, r.path): r.worth for r in node_importance(df, "host").collect()}
    want = brute_importance(rows)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def unnamed(source):
    """The page without what names its article and parts: article tags, classes, roles and ids."""
    return re.sub(r' (class|role|id)="[^"]*"', "", re.sub(r"</?article>", "", source))


@pytest.mark.parametrize("broadcast_rows", [0, 100_000])
def test_the_tree_decides_where_pages_name_nothing(spark, broadcast_rows):
    pages = duckdb.sql("select page_id, url, html from '/root/testdata/sf0.1/pages.parquet'").fetchall()
    articles = {i: text_of("<body>" + re.search(r"<article>(.*?)</article>", h, re.S)[1]) for i, _, h in pages}
    df = spark.createDataFrame([(i, u, unnamed(h)) for i, u, h in pages], "page_id long, url string, html string").repartition(8)
    assert {r.page_id: r.text for r in html_extraction(df, broadcast_rows=broadcast_rows).collect()} == articles


def test_names_are_a_prior(spark):
    """A notice outside of the article goes even if nothing is known of the host; an unnamed text of a lone page stays."""
    rows = [(1, "http://one.example", "<div>notice</div><article>story</article>"), (2, "http://two.example", "<div>story</div><div class='widget'>x</div>"), (3, "http://two.example", "<nav><article>teaser</article></nav>")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "page_id long, url string, html string, host int, worth int")
    got = html_extraction(df)
    assert got.columns == ["page_id", "url", "html", "host", "worth", "text"]
    assert {r.page_id: (r.text, r.host, r.worth) for r in got.collect()} == {1: ("story", 1, 2), 2: ("story", 1, 2), 3: ("", 1, 2)}
