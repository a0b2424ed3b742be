import time

import pytest

from tessergrid.llm import page_text as P
from tests.conftest import DATA

ODD = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";if(a<b){}</script></head>
<body><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">Accept</div>
<article><h1>Head &amp; tail</h1><p>One<br>two &lt;three&gt;<p>Four <b>five</b>six
 seven<ul><li>eight<li>nine</ul><form><input>no</form><!-- <p>no</p> --><table><tr><td>a</td><td>b</td></tr></table>
<aside>no</aside><div id="comments"><p>no</p></div><p>x < y & z</p></article><footer>&copy; no</footer></body></html>"""


def test_blocks():
    assert P.main_text(ODD).split("\n\n") == ["Head & tail", "One two <three>", "Four fivesix seven", "eight", "nine", "a b", "x < y & z"]


def test_awkward_pages():
    assert [P.main_text(h) for h in (None, "", "plain", "<p>open", "</div></p>stray", "<script>never closed", "<!-- open")] == ["", "", "plain", "open", "stray", "", ""]
    assert P.main_text("<main><p>in</p></main><p>out</p>") == "in"
    assert len(P.main_text("<div>" * 5000 + "deep" + "</div>" * 5000)) == 4
    assert P.host_of("https://Ex.org/a") == "ex.org" and P.host_of(None) == "" and P.host_of("http://[bad") == ""


LONG = {
    "comparisons": "a<b and c<d " * 80_000, "no end": "<a " * 300_000, "glued": "<svg" * 250_000, "glued, quoted": "<svg" * 250_000 + '"', "stray ends": "<div>" * 100_000 + "</p>" * 100_000,
    "open quotes": '<a b="' * 150_000, "one name": "<div x=1 " + "a" * 1_000_000 + ">", "heads": "<head>" * 150_000, "lists": "<ul>" + "<div>" * 60_000 + "<li></li>" * 60_000,
    "mains": "<div>" * 60_000 + "<main></main>" * 60_000, "declarations": "<!" * 500_000, "scripts": "<script>" + "</script " * 100_000, "blanks": "<p " + " " * 1_000_000 + "a=b" + " " * 1_000_000 + ">x",
}


@pytest.mark.parametrize("name", LONG)
def test_long_pages_take_time_in_proportion(name):
    began = time.process_time()
    P._page_hashes(LONG[name])
    assert time.process_time() - began < 25  # about a second; hours for what looks ahead from each place


def test_what_is_no_tag_is_text():
    assert P.main_text("<p>a<b and c<d") == "a<b and c<d"
    assert P.main_text("<p>1 < 2 <3 </ 4</p><p title='>' class=\"x>y\">in</p>") == "1 < 2 <3 </ 4\n\nin"
    assert P.main_text('<p>said <a href="x>open</p>') == 'said <a href="x>open'
    assert P.main_text("<p>a<!x</p><p>b<!-- c") == "a\n\nb"
    assert P.main_text("<script>if (a<b ? 'x>y' : \"</script><p>after</p>") == "after"


def site(n, host="a.org", block="<div><p>Read our other stories</p><p>and more</p></div>"):
    return [(i, f"https://{host}/{i}", f"<body><div>{block}</div><div><p>Story {host} {i} is a long text of its own, longer than what the site adds</p></div></body>") for i in range(n)]


def test_template_is_counted_per_host(spark):
    rows = site(8) + [(100 + i, u, h) for i, u, h in site(2, "b.org")]
    pages = spark.createDataFrame([(*r, "x", 5) for r in rows], "page_id bigint, url string, html string, text string, n_chars int")
    for limit in (100_000, 0):  # broadcast, and join
        got = {r.page_id: r.text for r in P.extract_pages(pages, broadcast_rows=limit).collect()}
        assert got[3] == "Story a.org 3 is a long text of its own, longer than what the site adds"
        assert got[101].startswith("Read our other stories\n\nand more\n\nStory b.org 1")


def test_copied_articles_stay(spark):
    rows = [(i, "https://c.org/x", "<article><h1>Same</h1><p>Everywhere the same</p></article>") for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text for r in P.extract_pages(pages).collect()} == {"Same\n\nEverywhere the same"}


def test_copies_stay_whatever_holds_them(spark):
    inner = "<h1>Tiny</h1><p>AAAA</p><p>BBBB</p><ul><li>CCCC</li></ul>"
    holds = ["<main>{}</main>", "<div role=main>{}</div>", "<body>{}</body>"]
    rows = [(10 * k + i, f"https://h{k}.org/{i}", h.format(inner) + f"<footer>page {i}</footer>") for k, h in enumerate(holds) for i in range(9)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for limit in (100_000, 0):
        assert {r.text for r in P.extract_pages(pages, broadcast_rows=limit).collect()} == {"Tiny\n\nAAAA\n\nBBBB\n\nCCCC"}


def test_many_pages_are_enough_on_a_large_host(spark):
    notice = "<div><p>Read our other stories</p></div>"
    story = "<main>{}<div><p>Story {} is a long text of its own, longer than what the site adds</p></div></main>"
    rows = [(i, f"https://big.org/{i}", story.format(notice if i < 30 else "", i)) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for limit in (100_000, 0):
        assert {r.text[:6] for r in P.extract_pages(pages, broadcast_rows=limit).collect()} == {"Story "}


def test_nulls_and_empty(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>é😀</p>"), (1, None, None)], "page_id bigint, url string, html string")
    assert sorted((r.text, r.n_chars) for r in P.extract_pages(pages).collect()) == [("", 0), ("", 0), ("é😀", 2)]
    assert P.extract_pages(pages.limit(0)).count() == 0


def test_sample_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in P.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_innocent_names_and_formulas_stay_in_an_article():
    page = """<body><div class="site-notice">no</div><article><h1>T</h1><section class="related-work"><p>one</p></section><div id="notice-board-history">two</div><p class="social-history menu-design">three</p>
    <div class="share-buttons">no</div><div class="comments">no</div><div class="ad">no</div><p>four <math><mi>x</mi><mo>=</mo><mn>2</mn></math></p><object data="f.swf"><p>five</p></object><noscript>no</noscript><button>no</button></article></body>"""
    assert P.main_text(page).split("\n\n") == ["T", "one", "two", "three", "four x=2", "five"]


def test_template_rule_by_brute_force(spark):
    import random
    from collections import Counter

    rng = random.Random(8)
    pages, parts = [], {}
    for host, n in (("one.org", 15), ("two.org", 30), ("three.org", 150)):
        pool = [(f"{host} block {k} says {'so ' * (k % 4)}", rng.choice([0.02, 0.1, 0.19, 0.25, 0.9])) for k in range(12)]
        for i in range(n):
            blocks = [f"Story {i} of {host}" + " is long and its own" * 40] + [b.strip() for b, p in pool if rng.random() < p]
            rng.shuffle(blocks)
            parts[len(pages)] = (host, blocks)
            pages.append((len(pages), f"https://{host}/{i}", "<body>" + "".join(f"<section><div><p>{b}</p></div></section>" for b in blocks) + "</body>"))
    on, size = Counter((h, b) for h, bs in parts.values() for b in set(bs)), Counter(h for h, _ in parts.values())
    gone = {(h, b) for (h, b), n in on.items() if n >= P.MIN_PAGES and n >= min(P.MIN_SHARE * size[h], P.MANY_PAGES)}
    assert {h for h, _ in gone} == set(size) and len(on) > len(gone)
    want = {k: "\n\n".join(b for b in bs if (h, b) not in gone) for k, (h, bs) in parts.items()}
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    for limit in (100_000, 0):
        assert {r.page_id: r.text for r in P.extract_pages(frame, broadcast_rows=limit).collect()} == want
