"""Main text of web pages by tag-path ratios.

A page becomes a list of text blocks in page order, each with its path of block-level tags from the root. For each path the
text length and the punctuation of all its blocks are summed and divided by the number of blocks; both ratios are smoothed
along the page, fused by their product, and compared to half of the greatest. All blocks of the chosen paths are kept.
They give the element that holds nearly all of them; unless that is the whole body, what else it holds is kept too but for
lists of links, and so are short blocks next to chosen ones. An article element decides nothing about which paths are chosen;
one that holds chosen blocks keeps its other blocks too, lists of links among them. Headings stay with the block they stand
over, and so does the last h1 before the text; those of a header outside articles only where that block is no heading itself,
so that the text has no other title.

Before that, elements are set aside that their tag or a word of their class or id says to be no article (menus, notices,
comments, forms ...). Such a sign is not believed where the page's text speaks against it: a form, a header or a player comes
back if it holds most of the unlinked text that is left, what a class names if it holds nearly all, and any of them, comments
and hidden elements excepted, if the page's h1, article or main element is in it with a good part of the text.

Time and memory are linear in the page: elements are numbers with a parent each, paths are interned, sums run over the numbers
backwards and signs forwards, and nothing is searched for twice.
"""

from __future__ import annotations

import heapq
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.runtime import small_batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is no markup; it ends at their end tag or with the page.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Tags whose text is part of the block around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt mstyle msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: How far an element is set aside: by the amount of its text, by a name, by a stronger sign, for good; a header that only its place says to be the site's.
MASTHEAD, AMOUNT, NAMED, STRONG, GONE = 1, 2, 3, 4, 5
TAGS = (
    dict.fromkeys("form fieldset object canvas audio video".split(), AMOUNT)
    | dict.fromkeys("nav footer aside dialog menu noscript template".split(), STRONG)
    | dict.fromkeys("head button select option datalist svg".split(), GONE)
)
ROLES = dict.fromkeys("navigation banner complementary contentinfo search dialog alertdialog alert menu menubar toolbar".split(), STRONG) | {"form": AMOUNT}
#: Words of a class or id that say what an element is for.
COMMENTS = frozenset("comment comments commentlist disqus feedback guestbook reply replies respond response responses talkback".split())
WORDS = (
    dict.fromkeys(
        "nav navbar navigation menu submenu sidebar sidenav footer foot masthead topbar banner notice notices notification notifications alert popup modal overlay signup login share sharing social "
        "related recommended recommendations breadcrumb breadcrumbs pagination pager toolbar widget widgets copyright disclaimer skip".split(), NAMED
    )
    | dict.fromkeys("ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr newsletter subscribe subscription".split(), STRONG)
    | dict.fromkeys(COMMENTS, GONE) | {"hidden": GONE}
)
#: A name that begins or ends so says what the element has not, or has among others.
NOT_FIRST, NOT_LAST = frozenset("has is no non not show with without".split()), frozenset("closed disabled enabled free none off on open".split())
#: A header is one of the site, and set aside, unless it is in an article or its class or id has one of these.
ARTICLE_WORDS = frozenset("article post entry story content main title".split())
#: A start tag that ends an open element of these.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"),
}
SCOPES = frozenset("table ul ol dl html body article section div main td th nav aside footer header form".split())
#: Start tags that end an svg that is still open.
BREAKOUT = frozenset("article aside blockquote body center div dl dt dd footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table ul".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Standard deviation of the smoothing, in blocks; share of the greatest fused ratio that a path must reach; share of the chosen text that the root holds.
SIGMA, THRESHOLD, ROOT_SHARE = 1.0, 0.5, 0.9
#: An element comes back that holds so many times the unlinked text outside what is set aside; and where it holds a mark of the article.
BACK = {MASTHEAD: 1.0, AMOUNT: 1.0, NAMED: 4.0}
MARKED = 0.5


def named(value: str) -> tuple[int, set[str]]:
    """How far the names of a class or id set an element aside, and the words in them."""
    aside, words = 0, set()
    for name in value.split():
        parts = [w.lower() for w in NAME.findall(name)]
        words.update(parts)
        if parts and parts[0] not in NOT_FIRST and parts[-1] not in NOT_LAST:
            aside = max(aside, *(WORDS.get(w, 0) for w in (parts[0], parts[-1], "".join(parts))))
    return aside, words


def _boilerplate(tag: str, attributes: str, inside_article: bool) -> tuple[int, str, str]:
    """How far the element is set aside, its step in a path, and its role."""
    aside, names, role = TAGS.get(tag, 0), "", ""
    site = tag == "header" and not inside_article
    if attributes and tag not in ("html", "body"):
        for key, *values in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), next((v for v in values if v), "")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
                aside = GONE
            elif key == "role":
                role = value.lower()
                aside = max(aside, ROLES.get(role, 0))
            elif key in ("class", "id"):
                found, words = named(value)
                if tag not in ("main", "article") or found == GONE and words & COMMENTS:
                    aside = max(aside, found)
                if "header" in words and not inside_article and not words & ARTICLE_WORDS and tag not in HEADINGS:
                    aside = max(aside, NAMED)
                site = site and not words & ARTICLE_WORDS
                if key == "class":
                    names = "." + ".".join(sorted(value.split()))
    return aside or (MASTHEAD if site else 0), tag + names, role


class Page:
    """Elements of a page as parallel lists, and its text blocks in page order; element 0 is the page itself."""

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.aside = [-1], [""], [0], [0]
        self.marks: list[int] = []  # elements that stand for the article: h1, article, main
        self.articles: list[int] = []
        self.whole = {0}  # html and body
        self.at: list[int] = []  # element of each block
        self.text: list[str] = []
        self.linked: list[int] = []
        self._read(page)

    def _read(self, page: str) -> None:
        stack = [0]
        homes = [0]  # number of open article and main elements up to each level of the stack
        scopes = [0]
        paths: dict[tuple[int, str], int] = {}
        opened: Counter = Counter()  # open elements by tag
        scoped: Counter = Counter()  # open elements by (innermost scope, tag)
        parts: list[str] = []
        linked = 0
        link = quiet = -1  # depth of the stack where an open link, a hidden inline element began
        quiet_tag, quiet_deep = "", 0
        svg: list[int] = []
        at, end = 0, len(page)

        def flush() -> None:
            nonlocal linked
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                self.at.append(stack[-1])
                self.text.append(text)
                self.linked.append(min(linked, len(text)))
            linked = 0

        def close(k: int) -> None:
            nonlocal link, quiet
            flush()
            while len(stack) > k:
                e = stack.pop()
                homes.pop()
                tag = self.tag[e]
                if tag in SCOPES:
                    scopes.pop()
                opened[tag] -= 1
                scoped[scopes[-1], tag] -= 1
                if svg and svg[-1] == len(stack):
                    svg.pop()
            link = -1 if len(stack) < link else link
            quiet = -1 if len(stack) < quiet else quiet

        while at < end:
            m = TOKEN.search(page, at)
            upto = m.start() if m else end
            if upto > at and quiet < 0:
                piece = html.unescape(page[at:upto])
                parts.append(piece)
                if link >= 0:
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            if not m[2] or m[0][-1] != ">":
                continue
            tag, shut, given = m[2].lower(), bool(m[1]), m[3]
            if tag in INLINE:
                if quiet >= 0:
                    if tag == quiet_tag:
                        quiet_deep += -1 if shut else 1
                        quiet = quiet if quiet_deep else -1
                elif tag == "a":
                    link = -1 if shut else len(stack)
                elif not shut and given and not given.rstrip().endswith("/") and _boilerplate(tag, given, True)[0]:
                    quiet, quiet_tag, quiet_deep = len(stack), tag, 1
                continue
            if tag in VOID:
                if tag == "br":
                    parts.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in RAW:
                if not shut and not (svg and given.endswith("/")):
                    x = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
                    at = x.end() if x else end
                continue
            if shut:
                flush()
                if opened[tag] > 0:
                    close(next(k for k in range(len(stack) - 1, -1, -1) if self.tag[stack[k]] == tag))
                continue
            if svg and tag in BREAKOUT and not opened["foreignobject"]:
                close(svg[0])
            flush()
            top = self.tag[stack[-1]]
            if top in ("p", "head") or top in HEADINGS and tag not in HEADINGS:
                close(len(stack) - 1)
            ends = CLOSES.get(tag, ())
            while any(scoped[scopes[-1], t] > 0 for t in ends):
                k = next(k for k in range(len(stack) - 1, -1, -1) if self.tag[stack[k]] in ends)
                close(k)
            number, above = len(self.parent), stack[-1]
            aside, step, role = _boilerplate(tag, given, homes[-1] > 0)
            home = tag in ("article", "main") or role in ("article", "main")
            self.parent.append(above)
            self.tag.append(tag)
            self.path.append(paths.setdefault((self.path[above], step), len(paths) + 1))
            self.aside.append(aside)
            if home and not aside or tag == "h1":
                self.marks.append(number)
            if home and "main" not in (tag, role):
                self.articles.append(number)
            if tag in ("html", "body"):
                self.whole.add(number)
            if not given.endswith("/"):
                scoped[scopes[-1], tag] += 1
                opened[tag] += 1
                if tag == "svg":
                    svg.append(len(stack))
                stack.append(number)
                homes.append(homes[-1] + (home and not aside))
                if tag in SCOPES:
                    scopes.append(number)
        flush()

    def settle(self) -> list[int]:
        """For each element the nearest one above it, itself included, that stays set aside, or 0; signs that the text speaks against are taken back."""
        n = len(self.parent)
        owner, above = [0] * n, [0] * n
        for e in range(1, n):
            above[e] = owner[self.parent[e]]
            owner[e] = e if self.aside[e] else above[e]
        held = [0] * n  # unlinked text by nearest element set aside; of what is not, at 0
        for e, text, linked in zip(self.at, self.text, self.linked):
            held[owner[e]] += len(text) - linked
        marked = [0] * n
        for e in self.marks:
            marked[e] = 1
        for e in range(n - 1, 0, -1):
            marked[self.parent[e]] |= marked[e]
        heap = [(-held[e], e) for e in range(1, n) if self.aside[e] and self.aside[e] != GONE and held[e]]
        heapq.heapify(heap)
        while heap:
            size, e = heapq.heappop(heap)
            kind = self.aside[e]
            if -size != held[e] or not kind:
                continue
            over = above[e]
            while over and not self.aside[over]:
                over = above[e] = above[over]
            if held[e] > BACK.get(kind, np.inf) * held[0] or marked[e] and kind != MASTHEAD and held[e] > MARKED * held[0]:
                self.aside[e] = 0
                held[over] += held[e]
                if over and self.aside[over] != GONE:
                    heapq.heappush(heap, (-held[over], over))
        for e in range(1, n):
            owner[e] = e if self.aside[e] else owner[self.parent[e]]
        return owner


def _smooth(values: np.ndarray) -> np.ndarray:
    reach = int(np.ceil(2 * SIGMA))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    return np.convolve(values, kernel, "same") / np.convolve(np.ones(len(values)), kernel, "same") if len(values) > reach * 2 else values


def main_text(page: str | None) -> str:
    """Content blocks of a page, white space inside each made one space, joined by two line feeds; '' if there is none.

    Null, empty and text-free pages give ''. Markup that is never closed, or cut off in a tag, is read as far as it goes.
    """
    if not page:
        return ""
    tree = Page(page)
    owner = tree.settle()
    parent, tag = tree.parent, tree.tag
    every = [k for k, e in enumerate(tree.at) if not owner[e] or tree.aside[owner[e]] == MASTHEAD and tag[e] in HEADINGS]
    found = [k for k in every if not owner[tree.at[k]]]
    if not found:
        return ""
    masthead = set(every).difference(found)
    at, text, linked = tree.at, tree.text, tree.linked
    _, of = np.unique(np.array([tree.path[at[k]] for k in found]), return_inverse=True)
    size = np.array([len(text[k]) - linked[k] for k in found], float)
    marks = np.array([len(PUNCTUATION.findall(text[k])) for k in found], float)
    nodes = np.bincount(of)
    length, punctuation = np.bincount(of, size) / nodes, np.bincount(of, marks) / nodes
    fused = np.log1p(_smooth(length[of])) * np.log1p(1 + _smooth(punctuation[of]))
    by_path = np.bincount(of, fused) / nodes
    chosen = (by_path >= THRESHOLD * float(by_path.max()))[of].tolist()
    picked = [k for k, yes in zip(found, chosen) if yes]
    total = sum(len(text[k]) for k in picked)
    weight, some = [0] * len(parent), [False] * len(parent)
    for k in picked:
        weight[max(parent[at[k]], 0)] += len(text[k])
        some[at[k]] = True
    for e in range(len(parent) - 1, 0, -1):
        weight[parent[e]] += weight[e]
        some[parent[e]] |= some[e]
    root = max(e for e, w in enumerate(weight) if w >= ROOT_SHARE * total)
    homes = {max(parent[at[k]], 0) for k in picked} | {root}
    held, inside = [False] * len(parent), [root == 0] + [False] * (len(parent) - 1)
    for e in tree.articles:
        held[e] = some[e]
    for e in range(1, len(parent)):
        held[e] |= held[parent[e]]
        inside[e] = e == root or inside[parent[e]]
    kept = set(picked)
    for k in found:
        e = at[k]
        part = inside[e] and root not in tree.whole or tag[e] in HEADINGS or e in homes or parent[e] in homes
        if held[e] or inside[e] and part and linked[k] <= 0.5 * len(text[k]):
            kept.add(k)
    start = next((i for i, k in enumerate(every) if k in kept), 0)
    kept.update([k for k in every[:start] if tag[at[k]] == "h1" and k not in masthead][-1:])
    for k, after in zip(every[-2::-1], every[:0:-1]):
        if tag[at[k]] in HEADINGS and after in kept and not (k in masthead and tag[at[after]] in HEADINGS):
            kept.add(k)
    return "\n\n".join(text[k] for k in every if k in kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """`pages` without its html but with text (or, where that name is taken, with underscores before it): see main_text.

    Every row returns, repeated ones too; other columns, nulls among them, stay as they are.
    """
    from pyspark.sql.types import StringType, StructField, StructType

    from lumenframe.llm.runtime import fresh

    small_batches(pages.sparkSession)
    others = [c for c in pages.columns if c != html_col]
    name = fresh(others, "text")
    schema = StructType([*(pages.schema[c] for c in others), StructField(name, StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([main_text(x) for x in batch.column(len(others)).to_pylist()], pa.string())], [*others, name])

    return pages.select(*[F.col(f"`{c}`") for c in others], F.col(f"`{html_col}`")).mapInArrow(run, schema)
