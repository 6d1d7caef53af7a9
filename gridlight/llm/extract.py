"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

The trees are trained here, on pages that this module makes up: layouts as they are common on the web, with random words, in
which it is known what belongs to the article. No page of the input is learned from.
"""

from __future__ import annotations

import functools
import hashlib
import io
import random
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from gridlight.llm import boosting, dom
from gridlight.llm.common import map_rows, stored
from gridlight.llm.dom import Page

#: Pages that the trees are trained on.
PAGES = 300


class _Maker:
    """Pages of random layout; blocks of the article carry a mark by which they are told from the rest."""

    MARK = "⁣"

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def pick(self, *options):
        return options[self.rng.randrange(len(options))]

    def chance(self, p: float) -> bool:
        return self.rng.random() < p

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        letters = "etaoinshrdlucmfwypvbgk"
        out = ["".join(self.rng.choices(letters, k=self.rng.randint(1, 10))) for _ in range(n)]
        for i in range(n):
            if self.chance(0.1):
                out[i] += self.pick(",", ".", ".", "?")
        return " ".join(out).capitalize()

    def attr(self, *names: str) -> str:
        if self.chance(0.15):
            return ""
        name = self.pick(*names)
        if self.chance(0.3):
            name += self.pick("-wrap", " box", "-inner", " col-8", "__block", " clearfix")
        return f' {self.pick("class", "class", "id")}="{name}"'

    def links(self, low: int, high: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 4)}</a>' for i in range(self.rng.randint(low, high))]
        if self.chance(0.7):
            return "<ul>" + "".join(f"<li>{x}{'</li>' if self.chance(0.9) else ''}" for x in items) + "</ul>"
        return self.pick(" | ", " ", " · ").join(items)

    def text(self, low: int, high: int) -> str:
        out = self.words(low, high) + "."
        if self.chance(0.25):
            out += f' <a href="x">{self.words(1, 3)}</a> ' + self.words(2, 9) + "."
        if self.chance(0.2):
            out = f"<b>{out}" + self.pick("</b>", "<br>", "")
        return out

    def block(self) -> str:
        """One block of the article."""
        m = self.MARK
        long = self.rng.random()
        low, high = (1, 6) if long < 0.2 else (5, 40) if long < 0.6 else (30, 160)
        kind = self.rng.random()
        if kind < 0.78:
            return f"<p>{m}{self.text(low, high)}" + ("</p>" if self.chance(0.85) else "")
        if kind < 0.84:
            return f"<h2>{m}{self.words(2, 8)}</h2>"
        if kind < 0.9:
            tag = self.pick("ul", "ol")
            return f"<{tag}>" + "".join(f"<li>{m}{self.text(2, 20)}</li>" for _ in range(self.rng.randint(2, 6))) + f"</{tag}>"
        if kind < 0.95:
            return f"<blockquote>{self.pick('', '<p>')}{m}{self.text(5, 40)}</blockquote>"
        if kind < 0.98:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{m}{self.words(1, 5)}</td>" for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>"
        return f"<pre>{m}{self.words(5, 30)}</pre>"

    def advert(self) -> str:
        return f"<div{self.attr('ad', 'ad', 'ads', 'advert', 'sponsored', 'promo', 'ad-slot')}>{self.pick('', '<p>')}{self.text(3, 25)}</div>"

    def notice(self) -> str:
        body = self.text(5, 30) + self.pick("", "<button>Ok</button>", f'<a href="#">{self.words(1, 3)}</a>')
        return f"<div{self.attr('cookie-notice', 'consent', 'notice', 'gdpr', 'newsletter', 'popup', 'alert')}>{self.pick('', '<p>')}{body}</div>"

    def side(self) -> str:
        body = f"<h3>{self.words(1, 3)}</h3>" * self.chance(0.6) + self.pick(self.links(3, 10), f"<p>{self.text(5, 40)}</p>", self.links(3, 8) + f"<p>{self.text(3, 20)}</p>")
        return f"<aside{self.attr('sidebar', 'related', 'widget')}>{body}</aside>" if self.chance(0.6) else f"<div{self.attr('sidebar', 'related', 'widget', 'rail', 'recommended')}>{body}</div>"

    def comments(self) -> str:
        one = lambda: f"<{(t := self.pick('div', 'li', 'article'))} class=\"{self.pick('comment', 'reply', 'comment-body')}\">{self.pick('', '<b>' + self.words(1, 2) + '</b>')}<p>{self.text(3, 60)}</p></{t}>"
        tag = self.pick("section", "div", "ol")
        return f"<{tag}{self.pick(' id=comments', ' class=comments', ' class=discussion', ' id=respond')}><h3>{self.words(1, 3)}</h3>" + "".join(one() for _ in range(self.rng.randint(1, 8))) + f"</{tag}>"

    def form(self) -> str:
        return f"<form{self.attr('search', 'login', 'contact', 'signup')}>{self.pick('', '<p>')}<label>{self.words(1, 6)}</label><input name=q>{self.text(1, 15)}<button>{self.words(1, 2)}</button></form>"

    def page(self) -> str:
        rng = self.rng
        out = ["<!DOCTYPE html><html><head><title>", self.words(2, 8), "</title><style>p{}</style></head><body>"]
        lead = []
        if self.chance(0.85):
            menu = self.links(3, 12)
            lead.append(f"<nav{self.attr('nav', 'menu')}>{menu}</nav>" if self.chance(0.7) else f"<div{self.attr('menu', 'navbar', 'nav')}>{menu}</div>")
        if self.chance(0.5):
            head = f"<header{self.attr('header', 'masthead')}>{self.pick('<h1>' + self.words(1, 4) + '</h1>', self.words(1, 8), '<p>' + self.text(2, 14) + '</p>')}{lead.pop() if lead and self.chance(0.5) else ''}</header>"
            lead.insert(0, head)
        for make, p in ((self.notice, 0.35), (self.advert, 0.6), (self.form, 0.2), (self.side, 0.2)):
            if self.chance(p):
                lead.append(make())
        body = [self.block() for _ in range(rng.randint(1, 29))]
        if self.chance(0.7):
            body.insert(0, f"<h1>{self.MARK}{self.words(2, 12)}</h1>")
        inner = list(body)
        for make, p in ((self.advert, 0.3), (self.notice, 0.12), (self.side, 0.15), (self.form, 0.08), (lambda: f"<div class=\"share\">{self.links(2, 5)}</div>", 0.15)):
            if self.chance(p):
                inner.insert(rng.randint(0, len(inner)), make())
        if self.chance(0.12):
            inner.append(self.comments())
        tag = self.pick("article", "article", "article", "main", "div", "section")
        main = f"<{tag}{self.attr('article', 'content', 'post', 'entry-content', 'story') if tag in ('div', 'section') or self.chance(0.4) else ''}>{''.join(inner)}</{tag}>"
        if self.chance(0.3):
            main = f"<{(t := self.pick('main', 'div'))}{self.attr('main', 'container', 'page', 'wrap')}>{main}{self.side() if self.chance(0.3) else ''}</{t}>"
        tail = [make() for make, p in ((self.comments, 0.3), (self.side, 0.35), (self.advert, 0.25), (self.form, 0.15), (self.notice, 0.15)) if self.chance(p)]
        foot = f"&copy; {self.words(1, 4)} &middot; {self.text(2, 30)}"
        if self.chance(0.9):
            tail.append(f"<footer{self.attr('footer')}>{self.pick('', '<p>')}{foot}{self.links(2, 6) if self.chance(0.4) else ''}</footer>" if self.chance(0.75) else f"<div{self.attr('footer', 'colophon', 'legal')}>{foot}</div>")
        return "".join([*out, *lead, main, *tail, "</body></html>" if self.chance(0.9) else ""])


def examples(pages: int = PAGES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of made-up pages, and whether each holds or is text of the article."""
    maker, xs, ys = _Maker(seed), [], []
    for _ in range(pages):
        page = Page(maker.page())
        y = np.array([t is not None and maker.MARK in t for t in page.text])
        for i in range(len(y) - 1, 0, -1):
            page.text[i] = page.text[i] and page.text[i].replace(maker.MARK, "")
            y[page.parent[i]] |= y[i]
        xs.append(page.features()[1:])
        ys.append(y[1:])
    return np.concatenate(xs).astype(np.float64), np.concatenate(ys).astype(np.float64)


@functools.lru_cache(maxsize=2)
def model(pages: int = PAGES, seed: int = 1) -> boosting.Forest:
    x, y = examples(pages, seed)
    return boosting.fit(x, y)


def stored_model(spark: SparkSession, pages: int = PAGES, seed: int = 1) -> boosting.Forest:
    """model(), trained once for a shared folder; the name holds the parameters and a digest of the code that makes it."""
    code = hashlib.blake2b(b"".join(Path(f).read_bytes() for f in (__file__, dom.__file__, boosting.__file__)), digest_size=8).hexdigest()

    def make() -> bytes:
        out, forest = io.BytesIO(), model(pages, seed)
        np.savez(out, feature=forest.feature, edge=forest.edge, value=forest.value, base=forest.base)
        return out.getvalue()

    with np.load(io.BytesIO(stored(spark, f"forest-{pages}-{seed}-{code}", make))) as z:
        return boosting.Forest(z["feature"], z["edge"], z["value"], float(z["base"]))


def main_text(sources: list[str | None], forest: boosting.Forest) -> list[str]:
    pages = [Page(s or "") for s in sources]
    margins = forest.margin(np.concatenate([p.features() for p in pages])) if pages else np.zeros(0)
    out, at = [], 0
    for p in pages:
        out.append("\n".join(p.text[i] for i in p.decode(margins[at : at + len(p.parent)])))
        at += len(p.parent)
    return out


def extract(pages: DataFrame, key: str = "page_id", keep: tuple[str, ...] = ("url",), source: str = "html") -> DataFrame:
    """One row per input row: key, ``keep``, text (empty where there is none) and n_chars, from the whole page.

    Null and empty pages have no text; broken markup is read as far as it goes; repeated rows are extracted each; other
    columns are ignored; no rows give no rows.
    """
    forest = stored_model(pages.sparkSession)
    schema = pages.schema

    def make(cols: list[list]) -> list[list]:
        texts = main_text(cols[-1], forest)
        return [*cols[:-1], texts, list(map(len, texts))]

    ddl = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in (key, *keep)) + ", text string, n_chars long"
    return map_rows(pages.select(key, *keep, source), make, ddl, rows=128)
