"""Searches against brute force, archives and pages against known answers."""

import hashlib
import random
import time
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from oracle import compare, connect

from orrery.llm import ann, catalog, covertree, htmltree, maintext, vectors, warc


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(rng.normal(size=(400, 8)))]
    rows += [(400 + i, rows[7][1], 0, "x") for i in range(30)]  # ties
    rows += [(900, None, 0, "x"), (950, [0.0] * 8, 0, "x"), (1000, [float("nan")] * 8, 0, "x"), (1050, [1.0, None] * 4, 0, "x"), (1100, [1.0], 0, "x"), (None, rows[0][1], 0, "x"), (50, rows[50][1], 0, "x"), (1150, [1.0, 2.0, -0.5], 0, "x"), (1151, [3.0, 1.0, 1.0], 0, "x")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, score string")


def brute(table, nonzero, change, measure):
    rows = {(r.vec_id, tuple(r.embedding)) for r in table.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and (not nonzero or any(r.embedding))}
    rows = [(i, change(np.array(v))) for i, v in rows]
    out = {}
    for q, v in rows:
        if q % 50 == 0:
            best = sorted(((-measure(v, w), i) for i, w in rows if i != q and len(v) == len(w)))[:5]
            out[q] = [(i, -s) for s, i in best]
    return {q: best for q, best in out.items() if best}


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_cover_tree_search(spark, table):
    want = brute(table, False, lambda v: np.floor(256 * v), lambda a, b: int(a @ b))
    assert answers(covertree.search(table)) == want
    assert covertree.search(table.where("vec_id < 0")).count() == 0
    assert covertree.search(table.where("vec_id = 50")).count() == 0


def test_cover_tree_prunes_and_covers():
    rng = np.random.default_rng(1)
    data = np.round(rng.normal(size=(2000, 2)) * 500)

    def check(node):
        assert (np.sqrt(((data[node.points] - node.centre) ** 2).sum(1)) <= node.radius + 1e-9).all()
        assert sorted(np.concatenate([node.singles, *(c.points for c in node.kids)])) == sorted(node.points)
        for c in node.kids:
            check(c)

    check(covertree.cover_tree(data))
    tree = covertree.DualTree(data, np.arange(2000), 6)
    who, places, scores = tree(data[::20])
    assert tree.compared < 0.2 * 100 * 2000
    for k in range(100):
        all_ = data[::20][k] @ data.T
        order = np.lexsort((np.arange(2000), -all_))[:6]
        assert places[who == k].tolist() == order.tolist() and scores[who == k].tolist() == all_[order].tolist()


def test_products_beyond_doubles():
    data = np.array([[3e9, 1], [3e9, 2], [3e9, 3], [-5, 7]])
    who, places, scores = covertree.DualTree(data, np.arange(4), 2)(data)
    whole = [[int(x) for x in v] for v in data.tolist()]
    for k in range(4):
        want = sorted((-(whole[k][0] * v[0] + whole[k][1] * v[1]), i) for i, v in enumerate(whole))[:2]
        assert [(-s, p) for s, p in zip(scores[who == k].tolist(), places[who == k].tolist(), strict=True)] == want
    with pytest.raises(OverflowError):
        covertree.DualTree(data * 2, np.arange(4), 2)(data * 2)


def test_partitions_are_balanced():
    rng = np.random.default_rng(0)
    unit = ann.normed(rng.normal(size=(512, 8)))
    parts = ann.partition(ann.neighbours(unit, 8), 8)
    assert set(np.bincount(parts)) == {64}


def test_ann_search(spark, table):
    want = brute(table, True, lambda v: v, lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))))
    report = {}
    got = answers(ann.search(table, recall=0.9, report=report))
    assert report[8][0] == 8 and set(report) == {8}  # the method runs on small tables, too
    assert set(got) == set(want) and got[1150] == [(1151, pytest.approx(4.5 / (5.25 * 11) ** 0.5))]
    exact = {q: dict(best) for q, best in want.items()}
    assert all(np.isclose(s, exact[q][i]) for q, best in got.items() for i, s in best if i in exact[q])
    assert sum(i in exact[q] for q, best in got.items() for i, _ in best) >= 0.9 * sum(map(len, want.values()))
    assert ann.search(table.where("vec_id < 0")).count() == 0


def recall(spark, x, **args):
    """Recall against brute force, and the greatest share of the parts that is probed."""
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    report = {}
    got = {(r.query_id, r.vec_id) for r in ann.search(rows, report=report, **args).collect()}
    unit = ann.normed(x)
    near = unit[::50] @ unit.T
    near[np.arange(len(near)), np.arange(0, len(x), 50)] = -9
    want = {(50 * q, int(i)) for q, best in enumerate(np.argsort(-near, axis=1)[:, :5]) for i in best}
    return len(got & want) / len(want), max(probes / parts for parts, probes in report.values())


def test_ann_recall_in_clusters(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 16))[rng.integers(0, 200, 9000)] + rng.normal(size=(9000, 16)) * 0.2
    found, probed = recall(spark, x, sample=4096)
    assert found >= 0.9 and probed < 0.5


def test_ann_recall_with_a_dense_third(spark):
    rng = np.random.default_rng(2)
    found, _ = recall(spark, np.concatenate([rng.normal(size=(6000, 16)), rng.normal(size=(3000, 16)) * 0.05 + 1]), sample=4096)
    assert found >= 0.9


def test_ann_recall_without_structure(spark):
    """As the driver's vectors, which have none: all rows are learned, and fewer than half of the parts are probed."""
    found, probed = recall(spark, np.random.default_rng(3).normal(size=(2000, 64)))
    assert found >= 0.9 and probed < 0.5


def test_classes_keep_least_ids(spark, table):
    rows = vectors.usable(table, "vec_id", "embedding", True)
    longest = max(vectors.classes(rows, 5).collect(), key=lambda r: len(r.ids))
    assert longest.ids == [7, 400, 401, 402, 403, 404]


def test_warc(spark, sf):
    big = "é" * 600
    rows = [(1, "http://a/x\r\ny", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (None, "u", big), (6, "u", None), (7, "u", "a" * 999), (8, "u", "a" * 999), (9, "u", "b" * 1000), (10, "u", "b" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as refers_to")
    folder, listed = warc.write_archives(pages, bytes_per_file=1500)
    out = {r.page_id: r for r in warc.read_archives(folder, listed).collect()}
    assert len(out) == 10 and out[2].record_type == "response" and (out[1].record_type, out[1].refers_to) == ("revisit", 2) and out[None].refers_to == 2 and out[9].refers_to == 10
    assert {i for i, r in out.items() if r.record_type == "response"} == {2, 3, 4, 6, 7, 8, 10}
    assert out[1].payload_bytes == 1200 and out[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and out[2].payload.decode() == big and out[6].payload_bytes == 0
    assert out[1].url == "http://a/x%0D%0Ay" and out[2].url is None
    pairs = spark.createDataFrame([(i, f"http://h/{i}", "z" * 2000) for i in range(1, 4)] + [(3, "http://h/3b", "z" * 2000)], "page_id long, url string, html string")
    folder, listed = warc.write_archives(pairs, date="2020-02-03T04:05:06Z")
    whole = [(f, b) for path in sorted(Path(folder.removeprefix("file://")).glob("*.warc.gz")) for f, b in warc.records(path.read_bytes())]
    assert {f["warc-date"] for f, _ in whole} == {"2020-02-03T04:05:06Z"} and sum(f["warc-type"] == "warcinfo" for f, _ in whole) == listed.count()
    assert all(f["warc-block-digest"] == warc.sha1_label(b) for f, b in whole)
    again = [f for f, _ in whole if f["warc-type"] == "revisit"]
    assert [(f["x-page-id"], f["warc-refers-to-target-uri"], f["warc-refers-to-date"]) for f in sorted(again, key=lambda f: f["x-page-id"])] == [(i, "http://h/3b", "2020-02-03T04:05:06Z") for i in "12"]
    assert {f["warc-refers-to"] for f in again} == {f["warc-record-id"] for f, _ in whole if f.get("x-page-id") == "3"}
    folder, listed = warc.write_archives(pages.where("page_id < 0"))
    assert warc.read_archives(folder, listed).count() == 0


def test_html_tree():
    tree = htmltree.parse("<ul><li>a<li>b</ul><p>x<br>y &amp;amp; z<p><a href='>'>l</a> t<script>var a='</p>';</script><div>d<!-- c --></div>")
    assert [n.text for n in tree if n.text] == ["a", "b", "x y &amp; z", "l t", "d"]
    for page in ("", "<", "<p", "<p \"'", "<" * 200, "<div>" * 2000, "</p></div>", "<table><tr><td>1<td>2<tr><td>3</table>", "<![CDATA[x]]>", "<textarea>" + "<p>", "\0"):
        htmltree.parse(page)


def test_messages_are_exact():
    """Marginals by messages equal those by summing over all states."""
    tree = htmltree.parse("<div><p>one two</p><p>three <a href=x>four</a></p></div>")
    forest, model, rng = maintext.Forest([tree]), maintext.TreeModel(), np.random.default_rng(0)
    model.w, model.pair = rng.normal(size=len(model.w)), rng.normal(size=model.pair.shape)
    n = len(tree)
    total, on = 0.0, np.zeros(n)
    for code in range(2**n):
        s = np.array([code >> i & 1 for i in range(n)])
        p = np.exp((forest.x @ model.w) @ s + sum(model.pair[forest.kind[i], s[forest.parent[i]], s[i]] for i in range(n) if forest.parent[i] >= 0))
        total, on = total + p, on + p * s
    assert np.allclose(model.messages(forest)[0], on / total)


@pytest.mark.parametrize("known", [1.0, 0.5, 0.0])
def test_main_text_held_out(known):
    """Pages of another seed; at 0 no part has a name that a feature knows."""
    model = maintext.trained()
    forest, labels = maintext.labelled_forest(maintext.labelled_pages(150, 99, known))
    node, _ = model.messages(forest)
    blocks = forest.kind == 0
    assert ((node > 0.5) == labels)[blocks].mean() > 0.97


class Blocks(HTMLParser):
    """Texts between block tags, by the standard library's parser."""

    def __init__(self, page):
        super().__init__()
        self.out, self.parts = [], []
        self.feed(page)
        self.close()
        self.flush()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "article", "ul", "li", "div", "blockquote", "table", "tr", "td", "pre"):
            self.flush()
        elif tag == "br":
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag not in ("b", "i", "a", "span"):
            self.flush()

    def handle_data(self, data):
        self.parts.append(data)


def test_main_text(spark, sf):
    table = spark.read.parquet(f"{sf}/pages.parquet")
    out = {r.page_id: r for r in maintext.main_text(table).collect()}
    for r in table.collect():
        article = "\n\n".join(Blocks(r.html[r.html.index("<article>") : r.html.index("</article>")]).out)
        assert out[r.page_id].text == article and out[r.page_id].n_chars == len(article)
    odd = spark.createDataFrame([(1, None, None, 1), (None, "u", "", 2), (2, "u", "<p>", 3), (2, "u", "<p>", 3)], "page_id long, url string, html string, text int").selectExpr("*", "1 n_chars")
    assert [r.text for r in maintext.main_text(odd).collect()] == [""] * 4
    assert maintext.main_text(odd.where("page_id > 5")).count() == 0


#: Pages written by hand, and what a reader would call their text.
BY_HAND = [
    (
        """<html><head><title>T</title><script>x = "<p>no</p>"</script></head><body><header class="crown"><a href=/>Home</a> <a href=/n>News</a></header>
        <div class="qx-71"><h1>Storm over the bay</h1><p>The storm came in at noon, and by three the harbour was closed. Nobody was hurt.</p>
        <p>Let <math><mi>x</mi></math> be the <button>key</button> of&nbsp;it: A &lt; B &amp; C, as we said in an <a href="/o">older report</a> on the same storm.</p>
        <ul><li>Boats were moved to the inner basin on Monday evening.</li><li>The ferry runs again from Friday.</li></ul></div>
        <footer><p>&copy; 2024 Bay Press. All rights reserved.</p></footer></body></html>""",
        ["Storm over the bay", "The storm came in at noon, and by three the harbour was closed. Nobody was hurt.", "Let x be the key of it: A < B & C, as we said in an older report on the same storm.", "Boats were moved to the inner basin on Monday evening.", "The ferry runs again from Friday."],
    ),
    (
        """<body><nav><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul></nav><main><article><h2>How to bake bread</h2>
        <p>Mix flour, water, salt and yeast.<br>Wait for an hour, then fold the dough twice.<p>Bake it at a high heat for forty minutes. Let it cool before you cut it.
        <blockquote>Good bread takes time, my grandmother used to say.</blockquote></article>
        <aside><h3>Related</h3><ul><li><a href=d>Cakes for beginners</a><li><a href=e>Ten soups</a></ul></aside></main>
        <section id="comments"><h3>Comments</h3><div class="comment"><p>Great, thank you! It worked.</p></div><div class="comment"><p>Mine burnt.</p></div></section>
        <form action=/s><label>Search</label><input name=q><select><option>All<option>News</select></form></body>""",
        ["How to bake bread", "Mix flour, water, salt and yeast. Wait for an hour, then fold the dough twice.", "Bake it at a high heat for forty minutes. Let it cool before you cut it.", "Good bread takes time, my grandmother used to say."],
    ),
    (
        """<div class="cookie-banner"><p>We use cookies. Accept them?</p><button>OK</button></div><div class="page"><div class="ad"><a href=/buy>Buy two, pay one</a></div>
        <div class="article-body"><p>Prices rose by two percent in May, the office said. Food was dearer, fuel was not.</p><div class="share"><a href=t>Share</a> <a href=m>Mail</a></div>
        <p>Rents went up most in the cities, where few flats are built. Wages rose by three percent.</p></div></div><div class="footer">Imprint | Contact</div>""",
        ["Prices rose by two percent in May, the office said. Food was dearer, fuel was not.", "Rents went up most in the cities, where few flats are built. Wages rose by three percent."],
    ),
]


@pytest.mark.parametrize("page, text", BY_HAND)
def test_pages_by_hand(page, text):
    assert maintext.extract([page], maintext.trained()) == [text]


@pytest.mark.parametrize("part", ["<a b=c ", '<a "', "<a '\"", "</x", "<", "<!", "<li>", "<p>x", "<section><p></table>", "<b></i>"])
def test_long_broken_pages(part):
    began = time.time()
    htmltree.parse(part * (1_000_000 // len(part)))
    assert time.time() - began < 10  # quadratic ones would take minutes


def test_deep_pages():
    page = "<div>" * 3000 + "<p>Deep down there is a sentence, and another one.</p>" + "</p></div>" * 3000 + "<p>last"
    tree = htmltree.parse(page)
    assert max(n.depth for n in tree) == 3003 and [n.text for n in tree if n.text] == ["Deep down there is a sentence, and another one.", "last"]
    assert [n.parent for n in tree if n.text == "last"] == [len(tree) - 2] and tree[-2].parent == 1


def test_ends_of_tags():
    """At the first > outside quotes, else at the first, against a reader of single characters."""

    def brute(page, at):
        quote = None
        for i in range(at, len(page)):
            if quote is None and page[i] == ">":
                return i
            quote = (page[i] if page[i] in "\"'" else None) if quote is None else None if page[i] == quote else quote
        return page.find(">", at)

    rng = random.Random(6)
    for _ in range(2000):
        page = "".join(rng.choice("ab>\"'") if rng.random() < 0.7 else "x" for _ in range(rng.randint(0, 25)))
        ends = htmltree.TagEnds(page)
        for at in sorted(rng.sample(range(len(page) + 1), min(5, len(page) + 1))):
            assert ends.find(at) == brute(page, at)
        assert len(ends.failed) <= 3


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql(spark, sf, name):
    compare(connect(sf), catalog.oracle_sql()[name], catalog.queries()[name](spark, sf))


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        assert kept.count() <= docs.count()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in rows} <= {r.doc_id for r in docs.collect()} and all(r.offset + r.length <= 2048 for r in rows)
