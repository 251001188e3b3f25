"""Main text of pages by a tree-structured graphical model.

Every node of a page's tree is a variable: content or not. Potentials of a node come from its features (element,
names in class, id and role, amount of text, share of links, sentences), those of parent and child from their states
and the child's kind. Sum-product messages, upward from the blocks and then downward from the page, give each block's
exact marginal; blocks above one half are the text. All weights are trained by gradient ascent on the
likelihood of labelled pages, whose gradient needs the same messages.

The labelled pages are written here by rules (labelled_pages), in many layouts with known answers.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from orrery.llm.common import slices, small_batches
from orrery.llm.htmltree import Element, parse

#: Names in class, id or role that speak for a part of a page.
NAMES = {
    "body": "article content entry post story main text body articlebody blog markdown prose",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc links sitemap",
    "head": "header masthead banner topbar logo branding site",
    "foot": "footer foot copyright contentinfo legal colophon bottom",
    "side": "sidebar aside side rail widget widgets related recommended recommendations trending popular complementary more tags",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense dfp",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner message warning toast dialog",
    "talk": "comment comments disqus reply replies respond discussion reviews thread responses",
    "form": "form search subscribe newsletter signup login register contact input",
    "share": "share social sharing follow buttons toolbar meta byline",
}
_GROUP = {name: group for group, names in NAMES.items() for name in names.split()}
TAGS = "html body main article section div p h1 h2 h3 ul ol li table td blockquote pre figure nav header footer aside form dialog dl dd address details".split()
FEATURES = ["bias", *(f"tag:{t}" for t in TAGS), "tag:other", *(f"name:{g}" for g in NAMES), "hidden", "chars", "share", "share>third", "linked", "linked>half", "block", "block:chars", "block:sentences", "block:short", "block:linked", "block:all linked", "block:sentence", "block:mark", "in:list"]
PLACE = {name: i for i, name in enumerate(FEATURES)}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Kinds of edges, by the child: block, paragraph or heading, other element.
EDGES = 3


@lru_cache(4096)
def named(about: str) -> tuple[int, ...]:
    groups = {_GROUP[w] for w in (x.lower() for x in _WORD.findall(about)) if w in _GROUP}
    found = [PLACE[f"name:{g}"] for g in sorted(groups)]
    if re.search(r"\bhidden\b|display:\s*none|aria-hidden=true", about):
        found.append(PLACE["hidden"])
    return tuple(found)


class Forest:
    """Trees of several pages as arrays, ordered for the messages."""

    def __init__(self, pages: list[list[Element]]):
        nodes = [n for page in pages for n in page]
        first = np.repeat(np.cumsum([0, *map(len, pages)])[:-1], [len(p) for p in pages]) if pages else np.zeros(0, np.int64)
        self.parent = np.array([n.parent for n in nodes], np.int64)
        self.parent = np.where(self.parent >= 0, self.parent + first, -1)
        depth = np.array([n.depth for n in nodes], np.int64)
        order = np.argsort(depth, kind="stable")
        bounds = np.searchsorted(depth[order], np.arange(depth.max(initial=0) + 2))
        self.levels = [order[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        self.kind = np.array([0 if n.text is not None else 1 if n.name in ("p", "h1", "h2", "h3", "li") else 2 for n in nodes], np.int64)
        self.nodes = nodes
        self.total = np.repeat([page[0].chars for page in pages], [len(p) for p in pages]) if pages else np.zeros(0, np.int64)

    def features(self, a: int, b: int) -> np.ndarray:
        """Rows of features of the nodes from a to b."""
        x = np.zeros((b - a, len(FEATURES)))
        for row, n, p, most in zip(x, self.nodes[a:b], self.parent[a:b].tolist(), self.total[a:b].tolist(), strict=True):
            self.describe(row, n, self.nodes[p] if p >= 0 else None, most)
        return x

    @cached_property
    def x(self) -> np.ndarray:
        """Features of all nodes: for training, where they are needed again and again."""
        return self.features(0, len(self.nodes))

    def scores(self, w: np.ndarray) -> np.ndarray:
        """The features' products with w, a few nodes at a time: a page may have millions."""
        if "x" in self.__dict__:
            return self.x @ w
        return np.concatenate([np.zeros(0), *(self.features(i, min(i + 4096, len(self.nodes))) @ w for i in range(0, len(self.nodes), 4096))])

    @staticmethod
    def describe(x: np.ndarray, n: Element, parent: Element | None, most: int) -> None:
        """most: characters of the page."""
        x[0] = 1
        share = n.linked / n.chars if n.chars else 0.0
        if n.text is None:
            x[PLACE.get(f"tag:{n.name}", PLACE["tag:other"])] = 1
            if n.attrs:
                x[list(named(n.attrs))] = 1
            x[PLACE["chars"]] = min(1.0, np.log1p(n.chars) / 8)
            x[PLACE["share"]], x[PLACE["share>third"]] = n.chars / max(1, most), 3 * n.chars > most
            x[PLACE["linked"]], x[PLACE["linked>half"]] = share, share > 0.5
            return
        x[PLACE["block"]], x[PLACE["block:chars"]], x[PLACE["block:short"]] = 1, min(1.0, np.log1p(n.chars) / 8), n.chars < 40
        x[PLACE["block:linked"]], x[PLACE["block:all linked"]] = share, share > 0.9
        x[PLACE["block:sentence"]] = n.text[-1] in ".!?…。\"”'" or ". " in n.text
        x[PLACE["block:sentences"]] = min(3, n.text.count(". "))
        x[PLACE["block:mark"]] = any(c in n.text for c in "©®»›")
        x[PLACE["in:list"]] = parent is not None and parent.name == "li"


class TreeModel:
    def __init__(self):
        self.w, self.pair = np.zeros(len(FEATURES)), np.zeros((EDGES, 2, 2))

    def messages(self, f: Forest) -> tuple[np.ndarray, np.ndarray]:
        """Marginals of content of every node, and of (parent, child) states of every edge."""
        n = len(f.parent)
        up = np.zeros((n, 2))
        up[:, 1] = f.scores(self.w)
        sent, down, edges = np.zeros((n, 2)), np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in f.levels[:0:-1]:
            t = self.pair[f.kind[level]] + up[level][:, None, :]
            sent[level] = np.logaddexp(t[:, :, 0], t[:, :, 1])
            np.add.at(up, f.parent[level], sent[level])
        for level in f.levels[1:]:
            p = f.parent[level]
            t = self.pair[f.kind[level]] + (up[p] + down[p] - sent[level])[:, :, None]
            down[level] = np.logaddexp(t[:, 0], t[:, 1])
            both = t + up[level][:, None, :]
            both = np.exp(both - both.max((1, 2), keepdims=True))
            edges[level] = both / both.sum((1, 2), keepdims=True)
        total = up + down
        return 1 / (1 + np.exp(np.clip(total[:, 0] - total[:, 1], -500, 500))), edges

    def train(self, f: Forest, y: np.ndarray, steps: int = 500, rate: float = 0.03, ridge: float = 1e-4) -> None:
        inner = f.parent >= 0
        seen = np.zeros((EDGES, 2, 2))
        np.add.at(seen, (f.kind[inner], y[f.parent[inner]], y[inner]), 1)
        at, n = f.x.T @ y, len(y)  # from here on f keeps its features
        params = [self.w, self.pair]
        m, v = [0 * p for p in params], [0 * p for p in params]
        for t in range(1, steps + 1):
            node, edges = self.messages(f)
            expected = np.zeros((EDGES, 2, 2))
            np.add.at(expected, f.kind[inner], edges[inner])
            for k, g in enumerate(((at - f.x.T @ node) / n - ridge * self.w, (seen - expected) / n - ridge * self.pair)):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.95 * v[k] + 0.05 * g * g
                params[k] += rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.95**t)) + 1e-7)


#: Stands in the text of content in labelled pages.
CONTENT = "⁣"


#: Names that pages give their parts and that no feature knows.
STRANGE = {
    "body": "richtext hentry copyblock longform bodycopy storypane inhalt texte",
    "menu": "drawer rubriken sections burger toplinks jump",
    "head": "crown marquee kopf entete topline",
    "foot": "fuss pied baseline endmatter imprint",
    "side": "rechts gutter outer companion extras satellite",
    "ad": "anzeige publicite werbung billboard leaderboard outbrain",
    "notice": "hinweis bandeau snackbar interstitial privacy",
    "talk": "kommentare avis feedback forum echo",
    "form": "formular abo mailing anmeldung",
    "share": "teilen partager spread socials",
}


def labelled_pages(n: int, seed: int, known: float = 0.5) -> list[str]:
    """Pages in random layouts, with CONTENT in every block of the article.

    Of the parts that have a name, the share `known` have one that the features know; the others have one of STRANGE, or
    a made-up one, so that the model has to go by elements, texts, links and neighbours.
    """
    rng = random.Random(seed)
    syllables = "ka to ri mel san der ou en la schi tion ber ge pa é vin lo ra nt est".split()

    def word() -> str:
        return "".join(rng.choices(syllables, k=rng.randint(1, 4)))

    def sentence(k: int | None = None) -> str:
        return " ".join(word() for _ in range(k or rng.randint(2, 18))).capitalize() + rng.choice("....?!,")

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(rng.randint(a, b)))

    def a_name(kind: str) -> str:
        return rng.choice(NAMES[kind].split()) if rng.random() < known else rng.choice([rng.choice(STRANGE[kind].split()), word() + rng.choice(["", "-2", "_a"])])

    def div(kind: str, inner: str, tag: str | None = None) -> str:
        """A part by its element, or a div with a telling name."""
        if tag and rng.random() < 0.5:
            return f"<{tag}>{inner}</{tag}>"
        attr = rng.choice(["class", "id", "class"])
        name = a_name(kind)
        own = rng.choice([tag, "div", "section"]) if tag else "div"
        return f'<{own} {attr}="{rng.choice(["", "site-", "page ", "l-", "my_"])}{name}">{inner}</{own}>'

    def links(k: int) -> str:
        items = [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(k)]
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>", lambda: " | ".join(items), lambda: "".join(f"<span>{x}</span>" for x in items), lambda: "<p>" + " ".join(items) + "</p>"])()

    def block(tag: str, text: str) -> str:
        inner = CONTENT + text
        if rng.random() < 0.2:
            inner += f' <a href="/{word()}">{words(1, 3)}</a> {words(1, 4)}'
        if rng.random() < 0.2:
            inner = f"<b>{inner}" + ("</b>" if rng.random() < 0.7 else "<br>")
        return f"<{tag}>{inner}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.8 else "")

    def paragraph() -> str:
        text = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))
        if rng.random() < 0.15:  # tables as text, noise
            text = text.replace(" ", rng.choice([" | ", "%%% ", "*** ", " $$$ ", " - ", " / "]))
        return block("p", text)

    def junk() -> str:
        return rng.choice([
            lambda: div("menu", links(rng.randint(2, 9)), "nav"),
            lambda: div("side", f"<h3>{words(1, 3)}</h3>{links(rng.randint(2, 6))}", "aside"),
            lambda: div("side", f"<p>{sentence()}</p><p>{sentence()}</p>", "aside"),
            lambda: div("ad", rng.choice([sentence(), f"<p>{sentence()}</p>", f'<a href="/x">{words(3, 9)}</a>'])),
            lambda: div("notice", f"<p>{sentence()} {sentence()}</p><button>OK</button>"),
            lambda: div("form", f"<form><p>{sentence()}</p><label>{words(1, 2)}</label><input name=q></form>"),
            lambda: f"<form action='/s'><label>{words(1, 3)}</label><input><p>{sentence()}</p></form>",
            lambda: div("share", links(3)),
        ])()

    def comments() -> str:
        many = "".join(rng.choice([f'<div class="comment"><p>{sentence()} {sentence()}</p></div>', f"<li class=reply><b>{word()}</b><p>{sentence()}</p></li>", f'<article class="comment"><p>{sentence()}</p></article>']) for _ in range(rng.randint(1, 6)))
        return div("talk", f"<h3>{words(1, 2)}</h3>{many}")

    out = []
    for _ in range(n):
        title = words(3, 9) if rng.random() < 0.85 else words(20, 90)
        article = [block(rng.choice(["h1", "h1", "h2"]), title)] if rng.random() < 0.7 else [paragraph()]
        brief = rng.random() < 0.2
        for _ in range(rng.choice([0, 1, 2, 3, 6, 10, 20])):
            if brief:
                article.append(block("p", words(1, 3).capitalize() + "."))
                continue
            article.append(rng.choice([paragraph] * 9 + [lambda: block("h2", words(1, 6)), lambda: f"<ul>{''.join(block('li', sentence()) for _ in range(3))}</ul>", lambda: f"<blockquote>{paragraph()}</blockquote>", lambda: f"<table><tr>{block('td', words(1, 4))}{block('td', words(1, 3))}</tr></table>", lambda: f"<pre>{CONTENT}{words(4, 20)}</pre>"])())
        if rng.random() < 0.3:
            article.insert(rng.randint(1, len(article)), rng.choice([div("ad", f"<p>{sentence()}</p>"), div("side", links(4), "aside"), div("share", links(3)), div("form", f"<form><p>{sentence()}</p></form>")]))
        if rng.random() < 0.15:
            article.append(comments())
        body = "".join(article)
        body = rng.choice([lambda: f"<article>{body}</article>"] * 5 + [lambda: f'<div class="{a_name("body")}">{body}</div>'] * 3 + [lambda: f"<main><article>{body}</article></main>", lambda: f"<main>{body}</main>", lambda: f'<div class="{a_name("body")}">{body}</div>', lambda: f'<div id="{a_name("body")}"><div class="x-{a_name("body")}">{body}</div></div>', lambda: f"<main><div>{body}</div></main>", lambda: body])()
        top = [div("head", rng.choice([f"<h1>{words(1, 3)}</h1>", f"<p>{words(1, 4)}</p>", words(1, 4)]) + rng.choice(["", links(4)]), "header")] if rng.random() < 0.6 else []
        top += [junk() for _ in range(rng.randint(0, 3))]
        end = [junk() for _ in range(rng.randint(0, 2))] + ([comments()] if rng.random() < 0.3 else [])
        if rng.random() < 0.85:
            end.append(div("foot", rng.choice([f"&copy; {word()}.example &middot; {sentence()}", f"<p>© {words(2, 6)}</p>", f"<p>{sentence()} {sentence()}</p>" + links(3)]), "footer"))
        inner = "".join(top) + body + "".join(end)
        if rng.random() < 0.3:
            inner = f'<div class="{rng.choice(["wrapper", "container", "page", "site"])}">{inner}</div>'
        out.append(f"<!DOCTYPE html><html><head><title>{title}</title></head><body>{inner}</body></html>")
    return out


def labelled_forest(pages: list[str]) -> tuple[Forest, np.ndarray]:
    """Labels: a block with CONTENT is content; so is an element that holds some, if it is the least that holds all of a
    page's or lies within it, or if nine tenths of its text are."""
    trees = [parse(p) for p in pages]
    labels = []
    for tree in trees:
        good, many = np.zeros(len(tree)), np.zeros(len(tree), int)
        for i in range(len(tree) - 1, -1, -1):
            if tree[i].text is not None:
                many[i] = CONTENT in tree[i].text
                good[i] = tree[i].chars * many[i]
                tree[i].text = tree[i].text.replace(CONTENT, "") or "x"
            if tree[i].parent >= 0:
                good[tree[i].parent] += good[i]
                many[tree[i].parent] += many[i]
        least = max((t.depth for t, n in zip(tree, many, strict=True) if t.text is None and n == many[0]), default=0)
        labels += [int(n > 0 and (t.text is not None or t.depth >= least or g >= 0.9 * t.chars)) for t, n, g in zip(tree, many, good, strict=True)]
    return Forest(trees), np.array(labels)


@lru_cache(1)
def trained(pages: int = 1000, seed: int = 1) -> TreeModel:
    model = TreeModel()
    model.train(*labelled_forest(labelled_pages(pages, seed)))
    return model


def extract(pages: list[str], model: TreeModel) -> list[list[str]]:
    """The content blocks of each page, in page order."""
    trees = [parse(p) for p in pages]
    node, _ = model.messages(Forest(trees))
    out, at = [], 0
    for tree in trees:
        out.append([n.text for n, p in zip(tree, node[at : at + len(tree)], strict=True) if n.text is not None and p > 0.5])
        at += len(tree)
    return out


def main_text(pages: DataFrame, model: TreeModel | None = None) -> DataFrame:
    """Per row, repeated ones too: page_id, url, text (blocks joined by an empty line; empty if there are none) and n_chars.

    Whole pages are read, however long or deep; null html counts as empty, null ids and urls stay null, other columns are
    not read, and an empty table has an empty answer. Rows are independent: no shuffle.
    """
    spark = pages.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model or trained())  # a few dozen weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1_000_000):
            texts = ["\n\n".join(blocks) for blocks in extract([h or "" for h in batch.column("html").to_pylist()], shared.value)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
