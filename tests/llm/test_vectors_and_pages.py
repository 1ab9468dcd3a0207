"""Centroid clustering and hard-negative mining against brute force, main text of pages."""

import hashlib
import html
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ball_tree, hard_negatives, html_text
from tests.test_queries import SMALL

VECTORS = "vec_id long, embedding array<double>, label int, cluster string, id long, slot int, score double"


def vectors(spark, rows):
    """Vectors with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 0.5) for i, v, label in rows], VECTORS)


def drawn(seed, n=300, width=64, spread=0.1):
    """Vectors in groups of unlike size, with copies, repeated ids and rows that take no part."""
    r = np.random.default_rng(seed)
    middle = r.normal(size=(5, width))
    rows = [(int(i), [float(x) for x in middle[min(4, int(r.exponential(1)))] * 0.5 + r.normal(size=width) * spread], int(r.integers(10))) for i in range(n)]
    rows += [(n + i, rows[3][1], i % 3) for i in range(40)]
    bad = [(1000, None, 1), (1001, [], 1), (1002, [1.0] * (width - 1) + [None], 1), (1003, [float("nan")] * width, 1), (1004, [float("inf")] * width, 1), (1005, [1.0] * (width + 1), 2), (1006, [1e300] * width, 2)]
    return rows, bad


def integer(v):
    return np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64)


def lloyd(rows, k, rounds):
    x = np.array([integer(v) for _, v, _ in rows])
    order = sorted(range(len(rows)), key=lambda j: (rows[j][0] is None, hashlib.sha256(f"2:{rows[j][0]}".encode()).hexdigest(), rows[j][1]))
    c = x[order[:k]].copy()
    for step in range(rounds + 1):
        away = ((x[:, None] - c[None]) ** 2).sum(2)
        near = away.argmin(1)
        if step < rounds:
            for j in range(len(c)):
                if (near == j).any():
                    c[j] = [int(s) // int((near == j).sum()) for s in x[near == j].sum(0)]
    best = away.min(1)
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c.tolist()]
    return sorted((str(r[0]), int(near[j]), int(best[j]), int(best[near == near[j]].sum()), int(best.sum()), names[near[j]]) for j, r in enumerate(rows))


@pytest.mark.parametrize(("seed", "k", "size"), [(1, 40, 4096), (2, 7, 64), (3, 500, 33)])
def test_clusters_are_those_of_plain_rounds(spark, monkeypatch, seed, k, size):
    rows, bad = drawn(seed)
    rows += [rows[5], (7, rows[9][1], 1), (None, rows[2][1], 1), (None, rows[4][1], 1)]
    monkeypatch.setattr(ball_tree.planted, "__defaults__", (size,))
    got = ball_tree.cluster(vectors(spark, rows + bad).repartition(3), k).collect()
    assert sorted((str(r.vec_id), *tuple(r)[1:]) for r in got) == lloyd(rows, k, 5)


def test_clusters_of_few_and_no_vectors(spark):
    rows, bad = drawn(4)
    assert ball_tree.cluster(vectors(spark, bad)).count() == 0
    assert ball_tree.cluster(vectors(spark, rows).where("false")).count() == 0
    same = [(i, rows[0][1], 0) for i in range(90)]
    got = ball_tree.cluster(vectors(spark, same)).collect()
    assert {(r.cluster, r.distance, r.inertia) for r in got} == {(0, 0, 0)}, "equal centroids: the smallest number"


def test_whole_balls_go_to_one_centroid():
    """Far groups are settled at balls; no single vector is looked at, and sums are those of the vectors."""
    r = np.random.default_rng(5)
    x = np.concatenate([r.integers(-5, 5, size=(200, 64)), r.integers(-5, 5, size=(200, 64)) + 500])
    tree = ball_tree.Tree.plant(x)
    (node, first, last, whole), (place, _, _) = tree.split(np.array([[0] * 64, [500] * 64]))
    assert len(place) == 0 and len(node) < 10 and (last - first).sum() == 400
    assert sorted({int(c) for c in whole}) == [0, 1]
    got = {a["cluster"]: a for a in tree.added(np.array([[0] * 64, [500] * 64]))}
    assert got[0]["sums"] == x[:200].sum(0).tolist() and got[1]["n"] == 200
    assert got[0]["inertia"] == int((x[:200] ** 2).sum())


def test_products_stay_exact_beyond_floats():
    from tessera.llm.vectorlib import products

    big = np.full((2, 64), 2**26 + 1, np.int64)
    assert products(big, big)[0, 0] == 64 * (2**26 + 1) ** 2


def mined(rows, every=100):
    """Plain version: (anchor, positive, rank, negative, two scores)."""
    rows = [(i, integer(v), (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    anchors = {}
    for i, v, label in rows:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (label, v.tolist())), (label, v.tolist()))
    out = []
    for a, (label, v) in anchors.items():
        others = sorted((-int(w @ np.array(v)), i, x) for i, w, x in rows if i != a)
        for s, p, _ in [o for o in others if o[2] == label][:5]:
            low = [(t, i) for t, i, x in others if x != label and 80 * -s <= 100 * -t <= 100 * -s][:5]
            out += [(a, p, k + 1, i, -s, -t) for k, (t, i) in enumerate(low)]
    return sorted(out)


RELABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"


@pytest.mark.parametrize(("seed", "block", "anchors"), [(11, 4096, 512), (12, 16, 3)])
def test_hard_negatives(spark, monkeypatch, seed, block, anchors):
    rows, bad = drawn(seed, n=250, spread=0.3)
    rows += [(200, rows[1][1], 4), rows[3], rows[3], (-100, rows[8][1], 2)]
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    extra = [(None, rows[0][1], 1), (2000, rows[0][1], None)]
    got = hard_negatives.mine(vectors(spark, rows + extra + [b for b in bad if b[0] != 1005]).repartition(3), label=F.expr(RELABEL)).collect()
    assert sorted(map(tuple, got)) == mined(rows) and len(got)


def test_hard_negatives_without_anchors(spark):
    rows, _ = drawn(13, n=50)
    assert hard_negatives.mine(vectors(spark, [r for r in rows if r[0] % 100])).count() == 0
    assert hard_negatives.mine(vectors(spark, rows).where("false")).count() == 0
    lonely = [(0, rows[0][1], 1), (1, rows[1][1], 2)]
    assert hard_negatives.mine(vectors(spark, lonely)).count() == 0, "no positives"


def test_anchors_do_not_pass_through_the_driver(spark, monkeypatch):
    """However small Spark takes the anchors to be, no step broadcasts them; what adaptive execution makes of the last one included."""
    rows, _ = drawn(14, n=320, spread=0.3)
    plans, write = [], hard_negatives.written

    def planned(df, name="step"):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(hard_negatives, "written", planned)
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    got = hard_negatives.mine(vectors(spark, rows).repartition(3), label=F.expr(RELABEL))
    found = sorted(map(tuple, got.collect()))
    plans.append(got._jdf.queryExecution().executedPlan().toString())
    assert found == mined(rows) and len(found)
    assert "isFinalPlan=true" in plans[-1] and not [p for p in plans if "Broadcast" in p]


LONG = "A sentence of the article that says something at some length, as articles do. " * 4
OTHER = "Another paragraph which goes on about the matter in its own words, and then ends. " * 3


def article(*parts):
    return "<html><head><title>t</title><script>var a = '</p><p>no';</script></head><body>" + "".join(parts) + "</body></html>"


def p(text):
    return f"<p>{text}</p>"


def lines(*texts):
    return "\n".join(" ".join(t.split()) for t in texts)


MENU = "<ul><li><a href='/a'>Home page</a></li><li><a href='/b'>All news</a></li><li><a href='/c'>About us</a></li></ul>"
CASES = {
    "plain": (p(LONG) + p(OTHER), lines(LONG, OTHER)),
    "no markup": ("only text\n here", "only text here"),
    "unlabelled parts": (article("<div>", MENU, "</div><div><h1>Title</h1>", p(LONG), p("Short."), p(OTHER), "</div><div>We use cookies on this site.</div>"), lines("Title", LONG, "Short.", OTHER)),
    "labelled parts": (
        article("<header><h1>Site</h1></header><nav>", MENU, "</nav><main><article><header><h1>Title</h1></header>", p(LONG), "<div class='ad-slot'>Buy this now</div>", p(OTHER), "<form><p>Your mail</p></form><footer>Tags</footer></article>",
                "<section id='comments'>", p(LONG) * 9, "</section></main><aside>", p(OTHER), "</aside><footer>Imprint</footer>"), lines("Title", LONG, OTHER)),
    "readers' comments outnumber the article": (article("<div class='story'>", p(LONG), p(OTHER), "</div><div class='reader-comments'>", p("I like this very much, thank you all for it. " * 5) * 30, "</div>"), lines(LONG, OTHER)),
    "notices": (article("<div class='cookieNotice'>", p(OTHER), "</div><div role='alert'>", p(OTHER), "</div><div style='display: none'>", p(OTHER), "</div><div>", p(LONG), p(OTHER), "</div>"), lines(LONG, OTHER)),
    "names that only lay out": (article("<div class='has-sidebar no-comments'>", p(LONG), p(OTHER), "</div>"), lines(LONG, OTHER)),
    "sections": (article("<main>", "".join(f"<section><h2>Part {i}</h2>{p(LONG)}{p('Few words.')}</section>" for i in range(3)), "</main>"), lines(*(x for i in range(3) for x in (f"Part {i}", LONG, "Few words.")))),
    "heading before": (article("<h1>Title</h1><div>", p(LONG), p(OTHER), "</div>"), lines("Title", LONG, OTHER)),
    "unclosed": ("<body><div class=text><p>" + LONG + "<p><b>" + OTHER + "<br><p>End <i>of <b>it", lines(LONG, OTHER, "End of it")),
    "lists and tables": (article("<article>", p(LONG), "<ul><li>One thing<li>Other <a href='/x'>thing</a></ul><table><tr><td>a<td>b</table>", p(OTHER), "</article>"), lines(LONG, "One thing", "Other thing", "a", "b", OTHER)),
    "references": (article("<article>", p("Caf&eacute; &lt;b&gt; &amp;amp; &#8364;&#x41; &nbsp; x &unknown; &am"), p(LONG), "</article>"), lines("Café <b> &amp; €A x &unknown; &am", LONG)),
    "one line a block": (article("<article>", "<p>one<br>two <b>th</b>ree\n\t four</p>tail <span class='ad'>hidden</span> end", p(LONG), "</article>"), lines("one two three four", "tail end", LONG)),
    "broken quotes": ("<p title=\"x>broken</p><p>ok</p>", "broken\nok"),
    "comments and raw text": (article("<article><!-- <p>no</p> --><style>p{}</style>", p(LONG), "<textarea>no</textarea><noscript>", p("no"), "</noscript></article>"), lines(LONG)),
    "only markup": ("<html><body><nav><a href='/'>x</a></nav></body></html>", ""),
    "empty": ("", ""),
    "null": (None, ""),
}


@pytest.mark.parametrize("name", CASES)
def test_main_text(name):
    page, want = CASES[name]
    assert html_text.main_text(page) == want


def test_density_selects_where_nothing_is_labelled():
    """The block of the greatest sum of densities wins over denser single blocks and over longer lists of links."""
    links = "".join(f"<li><a href='/{i}'>A headline of another article {i}</a></li>" for i in range(60))
    page = article(f"<div><ul>{links}</ul></div><div>{p(LONG)}{p(OTHER)}{p(LONG)}</div><div>{p('One dense line that stands alone on the page and has no links at all in it.')}</div>")
    assert html_text.main_text(page).split("\n")[:3] == [" ".join(x.split()) for x in (LONG, OTHER, LONG)]
    assert "headline" not in html_text.main_text(page)
    body = next(n for n in html_text.measure(html_text.blocks(page)) if n.name == "body")
    first, second, _ = body.parts
    assert second.total > first.total and second.density > first.density


def test_deep_and_very_long_pages():
    assert html_text.main_text("<div>" * 20_000 + p(OTHER) + p(LONG) + "</div>" * 20_000) == lines(OTHER, LONG)
    r = random.Random(3)
    paragraphs = [" ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(40)) for _ in range(4000)]
    assert html_text.main_text(article("<article>", *map(p, paragraphs), "</article>")) == "\n".join(paragraphs)
    assert html_text.main_text("<" * 50_000) == "<" * 50_000


def test_every_page_of_the_table(spark):
    """The tables' pages have one article each; a plain cut of it by its tags is the main text."""
    pages = duckdb.sql(f"SELECT page_id, html FROM '{SMALL}/pages.parquet'").fetchall()
    want = {}
    for i, page in pages:
        body = page[page.index("<article>") + 9 : page.index("</article>")].replace("<br>", " ")
        want[i] = lines(*(html.unescape(re.sub("<[^>]*>", "", x)) for x in re.split("</?(?:p|h1)>", body) if x.strip() and re.sub("<[^>]*>", "", x).strip()))
    got = html_text.extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_pages_with_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "u", p("a"), "t", 9), (1, "u", p("a"), "t", 9), (None, None, p("b"), "t", 9), (2, "v", None, "t", 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((str(r.page_id), str(r.url), r.text, r.n_chars) for r in html_text.extract(pages).collect())
    assert got == [("1", "u", "a", 1), ("1", "u", "a", 1), ("2", "v", "", 0), ("None", "None", "b", 1)]
    assert html_text.extract(pages.where("false")).count() == 0
