"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every element is described by its tag, the words of its class, id and role attributes and those of its ancestors, its depth, the
density of text, links and punctuation in its subtree, and its siblings. Trees give the log odds that the element's own text is
main text. Choices are decoded from the root: an element may be kept only if its parent is, and the kept set has the
largest sum of log odds weighted by the elements' own text, so no element stands against its ancestors.

The trees are fitted on pages built from templates in this module (articles in many layouts, with the menus, adverts, notices, forms,
sidebars and comments that surround or interrupt them), so no labels are needed; the fit is the same in every process.

Edge cases: null, empty and text-less pages give an empty text; broken markup is read as browsers do, roughly (a quote begins a value only
where a value begins; a tag that isn't closed ends at the next "<", and goes if the page ends in it), in time proportional to the page; repeated
rows give equal texts; an empty table gives an empty result; extra columns are ignored. Nothing is cut, whatever the length.
"""

from __future__ import annotations

import functools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytide.llm.dom import Page
from keytide.llm.shared import ship, table
from keytide.llm.trees import Boosted

TRAIN_PAGES, SEED = 500, 11


class _Maker:
    """Pages from templates; elements whose own text is main text bear the attribute data-main."""

    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        w = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.choice((2, 3, 3, 4, 5, 7, 9)))) for _ in range(r.randint(low, high))]
        marks = r.random()
        return " ".join(x + ("." if r.random() < 0.08 else "," if r.random() < 0.05 else "***" if marks < 0.1 else "") for x in w).capitalize() + r.choice((".", ".", ""))

    def attr(self, *names: str, often: float = 0.8) -> str:
        r = self.r
        if not names or r.random() > often:
            return ""
        other = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 6))) if r.random() < 0.3 else "clearfix"  # a word that tells nothing
        return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}{r.choice(("", "", "-1", f" {other}", "-wrap", f"-{other}"))}"'

    def links(self, low: int, high: int) -> str:
        return "".join(f'<li><a href="/{self.words(1, 1)}">{self.words(1, 3)}</a></li>' for _ in range(self.r.randint(low, high)))

    def menu(self) -> str:
        r = self.r
        body = f"<ul>{self.links(3, 12)}</ul>"
        return r.choice((f"<nav{self.attr('main-nav', often=0.3)}>{body}</nav>", f"<div{self.attr('nav', 'menu', 'navbar', 'breadcrumbs')}>{body}</div>", f'<div role="navigation">{body}</div>'))

    def advert(self) -> str:
        return self.r.choice((f"<div{self.attr('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', 'ad-slot', often=1)}>{self.words(3, 30)}</div>", f"<aside{self.attr('ad', 'promo')}>{self.words(3, 25)}</aside>", f"<p{self.attr('ad', 'sponsored', 'advertisement', often=1)}>{self.words(3, 25)}</p>"))

    def notice(self) -> str:
        return f"<div{self.attr('cookie-banner', 'cookie-notice', 'consent', 'newsletter', 'alert', 'popup', 'notice', often=1)}>{self.r.choice(('', '<p>'))}{self.words(5, 40)}<button>{self.words(1, 2)}</button></div>"

    def form(self) -> str:
        return f"<form{self.attr('search', 'login', 'newsletter', 'subscribe')}><label>{self.words(1, 3)}</label><input name=q><p>{self.words(3, 15)}</p><button>{self.words(1, 2)}</button></form>"

    def sidebar(self) -> str:
        r = self.r
        body = f"<h3>{self.words(1, 4)}</h3>" + r.choice((f"<ul>{self.links(3, 10)}</ul>", f"<p>{self.words(10, 60)}</p>", f"<p>{self.words(10, 60)}</p><ul>{self.links(2, 6)}</ul>"))
        return r.choice((f"<aside{self.attr('sidebar', 'related', 'widget', often=0.5)}>{body}</aside>", f"<div{self.attr('sidebar', 'related', 'side', 'widget', 'recommended', often=1)}>{body}</div>", f'<div role="complementary">{body}</div>'))

    def comments(self) -> str:
        r = self.r
        each = "".join(f"<{(t := r.choice(('div', 'li', 'article')))}{self.attr('comment', 'reply', 'comment-body')}><b>{self.words(1, 2)}</b><p>{self.words(5, 70)}</p></{t}>" for _ in range(r.randint(1, 6)))
        tag = r.choice(("div", "section", "ol"))
        return f"<{tag}{self.attr('comments', 'comment-list', 'disqus', 'responses discussion', often=1)}><h3>{self.words(1, 3)}</h3>{each}</{tag}>"

    def foot(self) -> str:
        r = self.r
        body = r.choice((f"&copy; {self.words(2, 15)}", f"<p>&copy; {self.words(3, 25)}</p>", f"<ul>{self.links(3, 8)}</ul>&copy; {self.words(2, 6)}"))
        return r.choice((f"<footer>{body}</footer>", f"<footer>{body}</footer>", f"<div{self.attr('footer', 'copyright', 'foot', often=1)}>{body}</div>"))

    def head(self) -> str:
        r = self.r
        body = r.choice(("", f"<h1>{self.words(1, 3)}</h1>", f"<a href='/'>{self.words(1, 3)}</a>")) + f"<p>{self.words(1, 8)}</p>" + r.choice(("", self.menu(), self.form()))
        return r.choice((f"<header{self.attr('site-header', often=0.3)}>{body}</header>", f"<div{self.attr('header', 'masthead', 'top', often=1)}>{body}</div>"))

    def share(self) -> str:
        return f"<div{self.attr('share', 'social', 'meta', 'tags', 'byline', often=1)}>{self.words(1, 5)} <a href=#>{self.words(1, 2)}</a> <a href=#>{self.words(1, 2)}</a></div>"

    def main(self) -> str:
        r = self.r
        n = r.choice((0, 1, 1, 2, 4, 8, 15, 30))
        out = [f"<h1 data-main>{self.words(2, 12)}</h1>"] * (r.random() < 0.8)
        for _ in range(n):
            x = r.random()
            text = self.words(*r.choice(((1, 4), (5, 30), (20, 150))))
            if x < 0.5:
                out.append(f"<p data-main>{text}</p>")
            elif x < 0.6:
                out.append(f"<p data-main>{text} <a href=/x data-main>{self.words(1, 3)}</a> {self.words(3, 20)}</p>")
            elif x < 0.68:
                out.append(f"<p data-main><b data-main>{text}<br>")
            elif x < 0.74:
                out.append(f"<h2 data-main>{self.words(1, 6)}</h2>")
            elif x < 0.8:
                out.append("<ul>" + "".join(f"<li data-main>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif x < 0.84:
                out.append(f"<blockquote data-main>{text}</blockquote>")
            elif x < 0.88:
                out.append(f"<pre data-main>{text}</pre>")
            elif x < 0.91:
                out.append("<table><tr>" + "".join(f"<td data-main>{self.words(1, 5)}</td>" for _ in range(4)) + "</tr></table>")
            elif x < 0.94:
                out.append(f"<div data-main>{text}</div>")
            elif x < 0.96:
                out.append(f"<figure><img src=x><figcaption data-main>{self.words(2, 12)}</figcaption></figure>")
            else:
                out.append(r.choice((self.advert, self.form, self.share, self.sidebar, self.notice))())
        if not n:
            out.append(f"<p data-main><b data-main>{self.words(2, 40)}<br>")
        if r.random() < 0.2:
            out.append(self.comments())
        return "".join(out)

    def page(self) -> str:
        r = self.r
        some = lambda f, p: f() if r.random() < p else ""
        kind = r.random()
        body = self.main()
        if kind < 0.55:
            body = f"<article{self.attr('post', 'entry', often=0.2)}>{body}</article>"
        elif kind < 0.75:
            body = f"<div{self.attr('content', 'article', 'post-content', 'entry', 'story', 'main-text', often=0.85)}>{body}</div>"
        elif kind < 0.85:
            body = f"<main>{body}</main>"
        elif kind < 0.95:
            body = f"<section{self.attr('content', 'article-body', 'text')}>{body}</section>"
        if r.random() < 0.3:
            body = f"<div{self.attr('container', 'wrapper', 'page')}>{body}{some(self.sidebar, 0.4)}</div>"
        if r.random() < 0.2 and "<main>" not in body:
            body = f"<main>{body}</main>"
        before = [some(self.head, 0.4), some(self.menu, 0.7), some(self.advert, 0.5), some(self.notice, 0.3), some(self.form, 0.15), some(self.sidebar, 0.2)]
        after = [some(self.sidebar, 0.3), some(self.comments, 0.25), some(self.share, 0.2), some(self.advert, 0.25), some(self.notice, 0.2), some(self.menu, 0.1)]
        r.shuffle(before)
        end = r.choice(("</body></html>", "</body></html>", ""))
        return f"<!DOCTYPE html><html><head><title>{self.words(2, 9)}</title><style>p{{}}</style></head><body{self.attr('home', often=0.1)}>{''.join(before)}{body}{''.join(after)}{some(self.foot, 0.85)}{end}"


@functools.cache
def trained(pages: int = TRAIN_PAGES, seed: int = SEED) -> Boosted:
    """Trees fitted on pages from the templates."""
    maker = _Maker(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        page = Page(maker.page())
        f, own, never = page.features()
        at = np.flatnonzero((own > 0) & ~never)
        xs.append(f[at])
        ys.append(np.array(page.mark)[at])
        ws.append(1 + np.log1p(own[at]))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float), np.concatenate(ws))


def decode(page: Page, gain: np.ndarray, never: np.ndarray) -> np.ndarray:
    """The kept nodes: the best set that holds with each node its parent, among sums of gains."""
    n = len(page.tags)
    best, parent = gain.tolist(), page.parent
    barred = never.tolist()
    for i in range(n - 1, 0, -1):  # children stand behind their parents
        if best[i] > 0 and not barred[i]:
            best[parent[i]] += best[i]
    kept = np.zeros(n, bool)
    kept[0] = True
    for i in range(1, n):
        kept[i] = kept[parent[i]] and not barred[i] and best[i] > 0
    return kept


def main_texts(sources: list[str | None], trees: Boosted) -> list[str]:
    pages = [Page(s or "") for s in sources]
    parts = [p.features() for p in pages]
    if not parts:
        return []
    odds = trees.log_odds(np.concatenate([f for f, _, _ in parts]))
    out, at = [], 0
    for page, (_, own, never) in zip(pages, parts, strict=True):
        gain = np.clip(odds[at : at + len(own)], -6, 6) * np.log1p(own)
        at += len(own)
        out.append(page.text(decode(page, gain, never)))
    return out


#: Characters of pages whose features are held at once; a longer page is handled alone.
AT_ONCE = 4 << 20


def extractor(trees: Boosted):
    @F.arrow_udf("string")
    def extract(column: pa.Array) -> pa.Array:
        out: list[str] = []
        held: list[str | None] = []
        size = 0
        for source in column:
            held.append(source.as_py())
            size += len(held[-1] or "")
            if size >= AT_ONCE:
                out += main_texts(held, trees)
                held, size = [], 0
        return pa.array(out + main_texts(held, trees), pa.string())

    return extract


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of every row of pages(page_id, url, html)."""
    ship(pages.sparkSession)
    return pages.select("page_id", "url", extractor(trained())(F.col("html")).alias("text"))


def op4_tree_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
