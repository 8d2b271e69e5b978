"""Main text: the page reader, the site tree against its recursive definition, and whole sites."""

import math
import random
import re
from collections import Counter, defaultdict
from html import unescape

import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import FOLDER, prose
from wardscope.llm import main_text, queries
from wardscope.llm.page_dom import DEEPEST, Page


def text(spark, *pages, url="http://one.example/x", **options):
    df = spark.createDataFrame([(k, url, p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in sorted(main_text.extract_main_text(df, **options).collect())]


# ---- the page reader ----

@pytest.mark.parametrize("source,blocks", [
    ("<p>a <b>b</b>c<br>d\n\t e</p>f", ["a bc d e", "f"]),
    ("<p><b>T.<br><p>x</p>y", ["T.", "x", "y"]),
    ("a&amp;&amp;lt;&nbsp;b &copy &#x41;", ["a&&lt; b © A"]),
    ("<script>var t='</p><p>no';</script>x<STYLE>p{}</Style >y", ["x y"]),
    ("<script>never ends <p>x", []),
    ("<!-- a <p> --><p>x<!-- y -->z<![CDATA[<p>]]></p><!doctype x><?pi?>", ["xz<p>"]),
    ("1 < 2 <3 <p title='a>b'>x</p><p a=\"'>y</p>", ["1 < 2 <3", "x", "y"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
    ("<dl><dt>a<dd>b<dt>c</dl><h1>d</h2>e", ["a", "b", "c", "d", "e"]),
    ("<p>x<p", ["x"]),
    ("", []),
    ("<div>" * 500 + "deep<p>er" + "</div>" * 500 + "out", ["deep", "er", "out"]),
])
def test_blocks_of_a_page(source, blocks):
    page = Page(source)
    assert [t for _, t in page.blocks] == blocks
    assert max(page.depths) <= DEEPEST


def test_names_decide_without_a_host(spark):
    page = """<html><head><title>t</title></head><body><header>top</header><div class="main-with-sidebar"><nav>n</nav>
    <article><header><h1>Head</h1></header><p>one</p><div class="ad-box">buy</div><p>two<ul><li>three</ul>
    <section id="Comments"><article class=comment><p>reader</p></article></section><form>f</form><p hidden>h</p></article></div>
    <aside>a</aside><footer>f</footer></body></html>"""
    assert text(spark, page, "<div>a</div><footer>b</footer>", None, "", "plain", url=None) == ["Head\none\ntwo\nthree", "a", "", "", "plain"]


def test_pages_table_gives_exactly_the_articles(spark):
    got = {r.page_id: r for r in queries.op12_main_text(spark, FOLDER).collect()}
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        inner = re.search("<article>(.*?)(?:</article>|$)", page.html, re.DOTALL).group(1)
        blocks = [" ".join(unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n".join(b for b in blocks if b)
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (want, len(want), page.url)


# ---- the tree ----

def site(rng, n, mirror=0):
    """Pages without any telling name: a template in plain divs around varied stories, some of them copies."""
    stories = [[prose(rng, 12) for _ in range(rng.randrange(1, 6))] for _ in range(n)]
    pages = []
    for k in range(n):
        story = stories[0] if k < mirror else stories[k]
        body = "".join(f"<p>{p}</p>" for p in story)
        links = "".join(f"<li><a href=/{j}>Topic {j}</a>" for j in range(5))
        pages.append(f"<div id=x1><ul>{links}</ul></div><div id=x2><h2>Story {k}</h2>{body}</div><div id=x3>All rights reserved by us {rng.randrange(2)}</div><div id=x4><p>Read our terms</p></div>")
    return pages, stories


def test_template_without_names_is_found(spark):
    pages, stories = site(random.Random(5), 60)
    got = text(spark, *pages)
    assert got == ["\n".join([f"Story {k}", *stories[k]]) for k in range(60)]
    assert text(spark, *pages, names=False) == got
    few = text(spark, *pages[:3])  # too few pages to judge: everything stays
    assert all("terms" in t for t in few)
    assert all("terms" in t for t in text(spark, *pages, least_pages=100))


def test_copies_of_a_story_stay(spark):
    pages, stories = site(random.Random(6), 60, mirror=20)
    got = text(spark, *pages)
    assert got == ["\n".join([f"Story {k}", *stories[0 if k < 20 else k]]) for k in range(60)]
    same = ["<div id=x><p>menu</p></div><article><h1>Same</h1><p>copied everywhere</p></article>"] * 30  # a named article is no template
    assert set(text(spark, *same)) == {"Same\ncopied everywhere"}


def by_definition(pages, least, damping, threshold):
    placed = [main_text.PlacedPage(Page(p), "one.example") for p in pages]
    shown, styles, children, features = Counter(), defaultdict(Counter), defaultdict(dict), defaultdict(lambda: defaultdict(list))
    for p in placed:
        shown.update(p.nodes.keys())
        for (node, style), c in p.styles.items():
            styles[node][style] += c
        for node, (_, _, style, _) in p.nodes.items():
            children[style][node] = True
        for (node, key), c in p.features.items():
            features[node][key].append(c)

    def entropy(counts, m):
        return -sum(c / sum(counts) * math.log(c / sum(counts), m) for c in counts)

    values = {}

    def value(node):
        m = shown[node]
        if styles[node]:
            d = damping ** len(styles[node])
            own = 1.0 if m < least else (1 - d) * min(1.0, entropy(list(styles[node].values()), m))
            share = {s: c / sum(styles[node].values()) for s, c in styles[node].items()}
            below = sum(p * sum(value(k) for k in children[s]) / len(children[s]) for s, p in share.items())
            values[node] = own + d * below
        elif m < least:
            values[node] = 1.0
        else:
            per = [entropy(c, m) for c in features[node].values()]
            values[node] = max(0.0, 1 - sum(per) / len(per)) if per else 0.0
        return values[node]

    value(placed[0].node[0])

    def noisy(node):
        inner = [k for s in styles[node] for k in children[s]]
        return values[node] < threshold and shown[node] >= least and all(values[k] < threshold and below(k) for k in inner)

    def below(node):
        return all(values[k] < threshold and below(k) for s in styles[node] for k in children[s])

    return {n: (v, noisy(n)) for n, v in values.items()}


@pytest.mark.parametrize("least,damping,threshold", [(4, 0.9, 0.4), (2, 0.7, 0.6)])
def test_importances_by_definition(spark, monkeypatch, least, damping, threshold):
    rng = random.Random(9)
    pages = site(rng, 25)[0] + ["<div id=x1>a<p>b</p></div>", "<div><div><p>c</div></div>", "<p>d<p>e<h1>f</h1><p>d", ""]
    monkeypatch.setattr(main_text, "CHUNK_PAGES", 4)
    df = spark.createDataFrame([("HTTPS://u@one.EXAMPLE:80/a", p) for p in pages], "url string, html string").repartition(3)
    tree = main_text.site_tree(df, least_pages=least, damping=damping, threshold=threshold).collect()
    want = by_definition(pages, least, damping, threshold)
    assert {r.node for r in tree} == set(want) and {r.host for r in tree} == {"one.example"}
    for r in tree:
        assert r.importance == pytest.approx(want[r.node][0], abs=1e-9) and r.noise == want[r.node][1]


def test_odd_tables(spark):
    schema = "page_id long, url string, html string, text string, chunk string, node string, payload string"
    assert main_text.extract_main_text(spark.createDataFrame([], schema)).collect() == []
    assert main_text.site_tree(spark.createDataFrame([], schema)).collect() == []
    row = (None, "http://a/b", "<article><p>x</article>", "z", "z", "z", "z")
    rows = [row, row, (1, None, None, None, None, None, None), (1, "no host", "<p>" + "y " * 200_000, "z", "z", "z", "z")]
    got = main_text.extract_main_text(spark.createDataFrame(rows, schema).withColumn("gone", F.lit(1)), keep=["page_id", "text", "chunk"])
    assert got.columns == ["page_id", "text", "chunk", "text"]
    assert sorted((str(r[0]), r[1] or "", r[3][:3]) for r in got.collect()) == [("1", "", ""), ("1", "z", "y y"), ("None", "z", "x"), ("None", "z", "x")]
