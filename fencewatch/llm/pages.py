"""Main text of web pages: boosted trees over DOM nodes, then one consistent choice for the whole tree.

There are no labelled pages, so the trees are learned from pages that this module lays out itself: one
main part among menus, adverts, notices, forms, comments and so on, in many arrangements, with the
words that page authors put into class and id attributes.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fencewatch.llm.boosting import BoostedTrees, boosted
from fencewatch.llm.common import steps, texts
from fencewatch.llm.dom import Page, joined, read_page

#: What it costs to treat the children of a node differently, in log-odds.
SPLIT_COST = 0.5
_PUNCTUATION = frozenset(".,;:!?")


@dataclass(frozen=True)
class PageModel:
    words: dict[str, float]  # log-odds of attribute and tag tokens
    trees: BoostedTrees


def _node_tokens(page: Page, node: int) -> list[str]:
    return ["<" + page.tag[node], *page.tokens[node]]


def features(page: Page, words: dict[str, float]) -> np.ndarray:
    """One row per node: its own tokens and those above it, subtree density, depth, siblings, place."""
    n = len(page.tag)
    own, marks, before = [0] * n, [0] * n, [-1] * n
    total = 0
    for run in page.runs:
        if run is not None and (size := len(run[1].strip())):
            node, text = run
            if before[node] < 0:
                before[node] = total
            own[node] += size
            marks[node] += sum(text.count(c) for c in _PUNCTUATION)
            total += size
    chars, links, link_chars = own[:], page.links[:], page.link_chars[:]
    elements, controls = [1 + i for i in page.inline], page.controls[:]
    paragraphs = [int(t == "p") for t in page.tag]
    children: list[list[int]] = [[] for _ in range(n)]
    for node in range(n - 1, 0, -1):
        up = page.parent[node]
        children[up].append(node)
        for column in (chars, links, link_chars, elements, controls, paragraphs, marks):
            column[up] += column[node]
        if before[node] >= 0:
            before[up] = before[node] if before[up] < 0 else min(before[up], before[node])
    log, rows = math.log1p, []
    depth, low, high, low_at = [0] * n, [0.0] * n, [0.0] * n, [0.0] * n
    place = {}
    for kids in children:
        kids.reverse()
        place.update((kid, i) for i, kid in enumerate(kids))
    alike = [Counter(page.tag[kid] for kid in kids) for kids in children]
    for node in range(n):
        values = [words.get(t, 0.0) for t in page.tokens[node]]
        tag_value = words.get("<" + page.tag[node], 0.0)
        up = page.parent[node]
        if up >= 0:
            depth[node] = depth[up] + 1
            low[node], high[node] = min(low[up], low_at[up]), max(high[up], high_at(words, page, up))
        low_at[node] = min([tag_value, *values])
        kids = children[up] if up >= 0 else [node]
        i = place.get(node, 0)
        size = max(1, chars[node])
        last = kids[i - 1] if i else node
        rows.append(
            (
                tag_value, sum(values), min(values, default=0.0), max(values, default=0.0), low[node], high[node], depth[node],
                log(chars[node]), link_chars[node] / size, 100 * elements[node] / size, log(own[node]), 100 * marks[node] / size,
                log(paragraphs[node]), i / len(kids), log(len(kids)), alike[up][page.tag[node]] / len(kids) if up >= 0 else 1.0,
                chars[node] / max(1, chars[up] if up >= 0 else size), max(0, before[node]) / max(1, total), chars[node] / max(1, total),
                log(links[node]), log((chars[up] if up >= 0 else size) / len(kids)), link_chars[last] / max(1, chars[last]), log(controls[node]),
            )
        )
    return np.array(rows, np.float64)


def high_at(words: dict[str, float], page: Page, node: int) -> float:
    return max(words.get(t, 0.0) for t in _node_tokens(page, node))


def decoded(page: Page, logit: np.ndarray) -> list[bool]:
    """Keep or drop for every node: a subtree is kept whole, dropped whole, or split into its children's best.

    Whatever is chosen for a whole subtree holds for all nodes in it, so none can contradict a node
    above it; a node that is split decides for the text it holds itself only.
    """
    n = len(page.tag)
    keep = -np.logaddexp(0, -np.clip(logit, -8, 8))
    drop = -np.logaddexp(0, np.clip(logit, -8, 8))
    whole_keep, whole_drop = keep.tolist(), drop.tolist()
    own = np.maximum(keep, drop)
    has_own = np.zeros(n, bool)
    for run in page.runs:
        if run is not None and run[1].strip():
            has_own[run[0]] = True
    split = np.where(has_own, own, 0.0).tolist()
    best = [0.0] * n
    for node in range(n - 1, -1, -1):
        best[node] = max(whole_keep[node], whole_drop[node], split[node] - SPLIT_COST)
        up = page.parent[node]
        if up >= 0:
            whole_keep[up] += whole_keep[node]
            whole_drop[up] += whole_drop[node]
            split[up] += best[node]
    chosen: list[bool | None] = [None] * n
    kept = [False] * n
    for node in range(n):
        up = page.parent[node]
        chosen[node] = chosen[up] if up >= 0 else None
        if chosen[node] is None:
            if split[node] - SPLIT_COST > max(whole_keep[node], whole_drop[node]):
                kept[node] = bool(logit[node] > 0)
                continue
            chosen[node] = whole_keep[node] >= whole_drop[node]
        kept[node] = bool(chosen[node])
    return kept


def main_text(source: str, model: PageModel) -> str:
    page = read_page(source)
    if len(page.tag) == 1 and not page.runs:
        return ""
    return joined(page, decoded(page, model.trees.logit(features(page, model.words))))


# --- pages to learn from -----------------------------------------------------------------------

# Words that page authors use for the parts of a page; fixed values, in plain text.
_PARTS = {
    "menu": "nav menu navbar navigation topnav mainnav links tabs dropdown breadcrumb breadcrumbs pagination pager toc skip",
    "header": "header masthead branding logo site-title tagline banner top topbar hero-bar",
    "footer": "footer colophon copyright bottom legal site-info credits foot",
    "sidebar": "sidebar aside widget rail secondary related recommended trending popular more-stories tags archive categories",
    "advert": "ad ads advert advertisement adsense sponsored sponsor promo promotion banner-ad dfp outbrain taboola affiliate",
    "notice": "cookie consent gdpr notice alert warning disclaimer popup modal overlay newsletter subscribe paywall message privacy",
    "form": "form search searchbox login signup register contact-form subscribe-form input field",
    "comments": "comment comments commentlist replies reply respond disqus discussion reader-comments thread feedback reviews",
    "share": "share social sharing follow buttons tweet like rating",
}
_MAIN = "article content post entry main story body text post-content entry-content article-body main-content page-content hentry prose blog-post"
_PLAIN = "wrapper container page row col inner outer site layout grid box section block group left right center clearfix wrap"
_TAGS = {
    "menu": "nav nav ul div div", "header": "header header div", "footer": "footer footer div", "sidebar": "aside aside div section",
    "advert": "div div ins aside section p", "notice": "div div section p aside dialog", "form": "form form div", "comments": "section div div ol aside",
    "share": "div ul section",
}


class _Layout:
    def __init__(self, draw: random.Random):
        self.draw = draw

    def words(self, n: int) -> str:
        letters = "aaabcdeeefghiijlmnnoopqrrssttuuv"
        return " ".join("".join(self.draw.choice(letters) for _ in range(self.draw.randint(1, 9))) for _ in range(n))

    def sentences(self, low: int, high: int) -> str:
        made = []
        for _ in range(self.draw.randint(low, high)):
            text = self.words(self.draw.randint(3, 18)).capitalize()
            made.append(text.replace(" ", ", ", 1) + "." if self.draw.random() < 0.3 else text + ".")
        return " ".join(made)

    def attributes(self, names: str, chance: float = 0.85) -> str:
        if self.draw.random() > chance:
            return "" if self.draw.random() < 0.6 else f' class="{self.words(1)}"'
        name = self.draw.choice(names.split())
        extra = f" {self.draw.choice(_PLAIN.split())}" if self.draw.random() < 0.2 else ""
        return f' {self.draw.choice(["class", "class", "id"])}="{name}{extra}"'

    def links(self, low: int, high: int) -> str:
        item = [f'<li><a href="/{i}">{self.words(self.draw.randint(1, 4))}</a></li>' for i in range(self.draw.randint(low, high))]
        return f"<ul>{''.join(item)}</ul>" if self.draw.random() < 0.8 else "".join(x[4:-5] + " " for x in item)

    def part(self, kind: str) -> str:
        draw, tag = self.draw, self.draw.choice(_TAGS[kind].split())
        named = tag in ("nav", "header", "footer", "aside", "form")
        attributes = self.attributes(_PARTS[kind], 0.5 if named else 1.0)
        if kind in ("menu", "share"):
            inside = self.links(3, 9)
        elif kind == "header":
            inside = f"<h1><a href='/'>{self.words(2)}</a></h1>" + (f"<p>{self.words(5)}</p>" if draw.random() < 0.5 else self.links(0, 5))
        elif kind == "footer":
            inside = f"&copy; {self.words(2)} &middot; {self.sentences(1, 3)}" if draw.random() < 0.6 else self.links(2, 8) + f"<p>{self.sentences(1, 2)}</p>"
        elif kind == "sidebar":
            inside = f"<h3>{self.words(2)}</h3>" + (self.links(2, 8) if draw.random() < 0.6 else f"<p>{self.sentences(1, 5)}</p>")
        elif kind in ("advert", "notice"):
            text = self.sentences(1, 4)
            inside = text if draw.random() < 0.6 or tag == "p" else f"<p>{text}</p>" + ("<button>OK</button>" if draw.random() < 0.4 else "")
        elif kind == "form":
            inside = f"<label>{self.words(2)}</label><input name=q><button>{self.words(1)}</button>" + (f"<p>{self.sentences(1, 2)}</p>" if draw.random() < 0.4 else "")
        else:
            one = "li" if tag == "ol" else draw.choice(["div", "article", "div"])
            name = self.attributes("comment reply review comment-body", 0.8)
            inside = "".join(f"<{one}{name}><p>{self.sentences(1, 6)}</p></{one}>" for _ in range(draw.randint(1, 6)))
            inside = (f"<h3>{self.words(2)}</h3>" if draw.random() < 0.6 else "") + inside
        return f"<{tag}{attributes}>{inside}</{tag}>"

    def article(self) -> str:
        draw = self.draw
        open_ = draw.random() < 0.3  # bold and paragraph elements that are never closed
        bits = [f"<h1>{self.words(draw.randint(3, 10))}</h1>"] if draw.random() < 0.7 else []
        for _ in range(draw.choice([0, 1, 1, 1, 2, 2, 3, 5, 8, 12, 20])):
            r = draw.random()
            text = self.sentences(1, draw.choice([1, 3, 9])) if draw.random() < 0.8 else self.words(draw.randint(1, 30))
            if r < 0.68:
                bits.append(f"<p><b>{text}<br>" if open_ and draw.random() < 0.3 else f"<p>{text}</p>")
            elif r < 0.78:
                bits.append(f"<h2>{self.words(draw.randint(1, 7))}</h2><p>{text}</p>")
            elif r < 0.85:
                bits.append(f"<ul>{''.join(f'<li>{self.sentences(1, 1)}</li>' for _ in range(draw.randint(2, 6)))}</ul>")
            elif r < 0.9:
                bits.append(f"<blockquote><p>{text}</p></blockquote>")
            elif r < 0.94:
                bits.append(f"<p>{self.words(4)} <a href='/x'>{self.words(2)}</a> {text}</p>")
            elif r < 0.97:
                bits.append(f"<div>{text}</div>")
            else:
                bits.append(f"<table><tr><td>{self.words(2)}</td><td>{self.words(2)}</td></tr></table>")
        if not bits or all(b.startswith("<h1") for b in bits):
            bits.append(f"<p>{self.sentences(1, 3)}</p>" if draw.random() < 0.8 else self.sentences(1, 4))
        for _ in range(draw.choice([0, 0, 0, 1, 2])):
            kind = draw.choice(["advert", "share", "sidebar", "notice", "form", "comments"])
            bits.insert(draw.randint(1, len(bits)), f"<!--x-->{self.part(kind)}<!--y-->")
        return "".join(bits)

    def page(self) -> str:
        draw = self.draw
        tag = draw.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        main = self.article()
        attributes = self.attributes(_MAIN, 0.3 if tag in ("article", "main") else 1.0)
        body = f"<!--main--><{'div' if tag == 'td' else tag}{attributes}>{main}</{'div' if tag == 'td' else tag}><!--end-->"
        if draw.random() < 0.3:
            after = "".join(self.part(draw.choice(["comments", "share", "sidebar", "advert"])) for _ in range(draw.randint(0, 2)))
            body = f"<div{self.attributes(_PLAIN + ' main content')}>{body}{after}</div>"
        first = "".join(self.part(draw.choice(["menu", "header", "menu", "advert", "notice", "form", "share"])) for _ in range(draw.randint(0, 4)))
        last = "".join(self.part(draw.choice(["footer", "footer", "sidebar", "comments", "advert", "notice", "menu", "form"])) for _ in range(draw.randint(0, 4)))
        body = first + body + last
        for _ in range(draw.choice([0, 0, 1, 2])):
            body = f"<div{self.attributes(_PLAIN)}>{body}</div>"
        return f"<html><head><title>{self.words(3)}</title></head><body>{body}</body></html>"


def _labelled(source: str) -> tuple[Page, np.ndarray]:
    """A laid-out page and, for each node, the share of its text that is main text."""
    start, end = source.index("<!--main-->"), source.index("<!--end-->")
    inside = source[start:end].replace("<!--x-->", "\x01").replace("<!--y-->", "\x02")
    page = read_page(source[:start] + "\x03" + inside + "\x04" + source[end:])
    main, part = False, False
    good, total = [0] * len(page.tag), [0] * len(page.tag)
    for i, run in enumerate(page.runs):
        if run is None:
            continue
        node, text = run
        clean = []
        for c in text:
            if c in "\x01\x02\x03\x04":
                main, part = {"\x03": True, "\x04": False}.get(c, main), {"\x01": True, "\x02": False}.get(c, part)
            else:
                clean.append(c)
                total[node] += not c.isspace()
                good[node] += main and not part and not c.isspace()
        page.runs[i] = (node, "".join(clean))
    for node in range(len(page.tag) - 1, 0, -1):
        good[page.parent[node]] += good[node]
        total[page.parent[node]] += total[node]
    return page, np.array([g / t if t else -1 for g, t in zip(good, total)])


@cache
def trained(pages: int = 1600, seed: int = 5) -> PageModel:
    """Token log-odds from half of the laid-out pages, trees from the other half; the same in every run."""
    layout = _Layout(random.Random(seed))
    made = [_labelled(layout.page()) for _ in range(pages)]
    yes, no = Counter(), Counter()
    for page, share in made[: pages // 2]:
        for node in range(len(page.tag)):
            if share[node] >= 0:
                (yes if share[node] > 0.5 else no).update(_node_tokens(page, node))
    words = {t: math.log((yes[t] + 1) / (no[t] + 1)) for t in yes | no if yes[t] + no[t] >= 3}
    rows, answers = [], []
    for page, share in made[pages // 2 :]:
        use = share >= 0
        rows.append(features(page, words)[use])
        answers.append(share[use] > 0.5)
    return PageModel(words, boosted(np.concatenate(rows), np.concatenate(answers).astype(np.float64)))


def extracted(pages: DataFrame, key: str = "page_id", model: PageModel | None = None) -> DataFrame:
    """(key, url, text) of every row: the main text of html.

    A null or empty html, and one without text, give an empty text. Repeated rows and null keys stay;
    other columns are not read.
    """
    kind = pages.schema[key].dataType.simpleString()
    model = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "html"):
            sources = [read_page(source) for source in texts(batch.column(2))]
            rows = [features(page, model.words) for page in sources]
            logits = np.split(model.trees.logit(np.concatenate(rows)), np.cumsum([len(r) for r in rows])[:-1])
            out = [joined(page, decoded(page, logit)) for page, logit in zip(sources, logits)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string())], [key, "url", "text"]
            )

    return pages.select(key, "url", "html").mapInArrow(run, f"`{key}` {kind}, url string, text string")
