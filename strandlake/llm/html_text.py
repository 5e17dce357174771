"""Main text of web pages: flat text blocks, a decision tree over each block and its neighbours.

A page is cut at block-level tags into flat blocks of text. Each block has its word count and link density, those of the
blocks before and after it, and what its tags say (boilerplate elements and class names round it, article or outside of
the page's article, heading, list item, paragraph). A decision tree, trained by Gini impurity on the blocks of the small
labelled table of layouts below, says which blocks are main text; of cuts that part the blocks as well, one by word count
or link density is taken. Many layouts have no telling tag or name, so that counts and densities of a block and its
neighbours decide there. In
a block every run of white space becomes one space; `<br>` counts as white space. Blocks are joined by a line feed.

Null and empty pages, and pages without a main block, give an empty text. Unclosed tags, comments and scripts run to the
end of the page. Character references are decoded within each piece of text between tags. A link's words are those of the
text within it, blocks within it as well; a link that isn't closed ends with the block round it. Pages are read whole; repeated rows give repeated results; an empty table gives an empty result; columns
other than page_id, url and html are ignored.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
#: Fixed values of HTML: elements whose content is no markup, elements without content, elements that break a block.
RAW = frozenset("script style title textarea xmp".split())
FOREIGN = frozenset("iframe noscript noembed noframes template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BREAKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no main text, wherever they stand; and outside an article.
BOILERPLATE = frozenset("nav footer aside form menu button select dialog fieldset".split())
OUTSIDE = frozenset(("header",))
#: Beginnings of words in class and id names of what surrounds an article.
HINTS = ("advert", "sponsor", "promo", "cookie", "consent", "sidebar", "sidenav", "navbar", "navig", "breadcrumb", "footer", "disqus", "newsletter", "subscri", "signup", "popup", "modal", "overlay", "copyright", "pagination", "toolbar", "masthead", "topbar")
#: Words that say so alone or beside words of a box only, as in related-posts but not in related-work.
WEAK_HINTS = frozenset("ad ads adbox adslot nav gdpr alert aside tags reply replies legal disclaimer notice notices banner menu menus comment comments commentlist respond share sharing social related recommended recommendations login widget widgets pager trending top bottom header".split())
BOX = frozenset("area bar block body box btn button buttons card cards col column container content count div drawer entries form group header holder icons inner item items left links list main module outer panel post posts right row section site slot text thread title toggle top unit wrap wrapper articles stories author meta".split())
#: Weak hints that say nothing within an article, where they may name its own parts.
OUTSIDE_HINTS = frozenset("header top bottom".split())
READERS = frozenset("comment comments commentlist reply replies".split())
WRAPPERS = frozenset("with has no".split())
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none""", re.I)


@dataclass
class Block:
    text: str
    words: int
    linked: int
    boilerplate: int
    hints: int
    article: int
    heading: int
    item: int
    paragraph: int
    sure: int = 0


@functools.lru_cache(4096)
def names_of(attributes: str) -> tuple[frozenset[str], ...]:
    """The words of each class, id and role name."""
    found = [n for m in NAMES.finditer(attributes) for n in (m[1] or m[2] or m[3] or "").split()]
    return tuple(frozenset(w for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", n).lower()) if w) for n in found)


@functools.lru_cache(4096)
def hinted(attributes: str, in_article: bool) -> int:
    if HIDDEN.search(NAMES.sub("", attributes)):
        return 1
    for words in names_of(attributes):
        if words & WRAPPERS:
            continue
        weak = words & WEAK_HINTS if not in_article else words & WEAK_HINTS - OUTSIDE_HINTS
        strong = {w for w in words if w.startswith(HINTS)}
        # Within an article a name may begin like a hint and be of its subject: there all of it must be hints or boxes.
        if strong and (not in_article or words - strong <= WEAK_HINTS | BOX) or weak and words <= WEAK_HINTS | BOX:
            return 1
    return 0


def blocks(page: str) -> list[Block]:
    """The page's non-empty blocks in order."""
    out: list[Block] = []
    parts: list[str] = []
    linked_parts: list[str] = []
    stack: list[tuple[str, int, int, int]] = []  # element, and how much it adds to boilerplate, hints and article
    boilerplate = hints = article = mains = 0
    heading = item = paragraph = title = False
    open_: Counter[str] = Counter()  # elements on the stack
    breaks = 0
    link: list[int] | None = None  # of the open link: breaks and elements before it, and whether it holds text itself

    def close() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, text.count(" ") + 1, min(len("".join(linked_parts).split()), text.count(" ") + 1), min(boilerplate, 1), min(hints, 1), min(article, 1), int(heading), int(item), int(paragraph), int(title or mains > 0)))
            parts.clear()
            linked_parts.clear()

    def said(s: str) -> None:
        """A piece of text between two tags; what stands between links parts their words."""
        if s:
            s = html.unescape(s)
            parts.append(s)
            linked_parts.append(s if link else " ")
            if link and link[0] == breaks and s.strip():
                link[2] = 1

    absent: set[str] = set()  # elements of other markup that end nowhere behind this place
    at = 0
    while m := TOKEN.search(page, at):
        said(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            if name in BREAKS:
                close()
                heading = item = paragraph = title = False
                while open_[name]:
                    top, b, h, a = stack.pop()
                    open_[top] -= 1
                    mains -= int(a and top == "main")
                    boilerplate, hints, article = boilerplate - b, hints - h, article - a
                    if top == name:
                        break
                if link and (link[0] == breaks or len(stack) < link[1]):
                    link = None  # never closed: the block round it has ended
                breaks += 1
            elif name == "a":
                link = None
            continue
        attributes = m[3] if m[2] else m[6]
        if name in ("svg", "math") and attributes.rstrip().endswith("/"):  # foreign elements may close themselves
            said(" ")
        elif name in RAW or name in FOREIGN:
            if name not in absent:
                end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                if not end and name in FOREIGN:
                    absent.add(name)
                else:
                    at = end.end() if end else len(page)
            said(" ")
        elif name == "a":
            link = [breaks, len(stack), 0]
        elif name == "br":
            said(" ")
        elif name in BREAKS:
            close()
            if link and link[2]:
                link = None  # a link with text of its own before a block was never closed; one round blocks goes on
            breaks += 1
            heading, item, paragraph = name in ("h1", "h2", "h3", "h4", "h5", "h6"), name == "li", name == "p"
            title = name == "h1"
            if name not in VOID and name not in ("p", "li", "html", "body", "head", "td", "th", "tr", "option", "dt", "dd"):
                b = int(name in BOILERPLATE or name in OUTSIDE and not article)
                a = int(name in ("article", "main"))
                if a and any(words & READERS and words <= READERS | BOX for words in names_of(attributes)):
                    a, h = 0, 1  # a reader's comment is no article
                else:
                    h = 0 if a or not attributes else hinted(attributes, article > 0)
                stack.append((name, b, h, a))
                open_[name] += 1
                mains += int(a and name == "main")
                boilerplate, hints, article = boilerplate + b, hints + h, article + a
    said(page[at:])
    close()
    return out


FEATURES = ("words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "boilerplate", "hints", "article", "outside", "heading", "item", "paragraph")


def features(found: list[Block]) -> np.ndarray:
    own = np.array([(b.words, b.linked / b.words) for b in found], float).reshape(-1, 2)
    edge = np.zeros((1, 2))
    # Outside is what stands outside of the page's `main` element, of an article with its main heading, or of articles that
    # hold most of the text that may be main; other articles are teasers beside a text that is no article.
    may = [b for b in found if not b.boilerplate and not b.hints]
    within = sum(b.words for b in may if b.article)
    has = 2 * within >= sum(b.words for b in may) > 0 or any(b.article and b.sure for b in may)
    tags = np.array([(b.boilerplate, b.hints, b.article, has and not b.article, b.heading, b.item, b.paragraph) for b in found], float).reshape(-1, 7)
    return np.concatenate([own, np.concatenate([edge, own])[:-1], np.concatenate([own, edge])[1:], tags], axis=1)


#: The labelled table, as layouts: +n stands for n words of main text and -n for n other words, /k for k of them linked.
LAYOUTS = (
    "<nav><ul><li>-1/1<li>-1/1<li>-2/2</ul></nav><div class=ad>-9</div><article><h1>+6</h1><p>+60</p><p>+2</p><p>+25/6</p></article><footer>-9</footer>",
    "<nav><a>-1/1</a></nav><div class=ad>-3</div><article><h1>+2</h1><p>+1</p><p>+400</p></article><footer>-30</footer>",
    "<header><p>-3</p><p>-2/2</p></header><main><h1>+3</h1><p>+22</p><ul><li>+2<li>+11</ul><h2>+1</h2><p>+1</p><p>+7/5</p></main><aside><h3>-2</h3><p>-14</p></aside><footer><p>-1</p></footer>",
    "<div id=header>-5</div><div class=sidebar><p>-18</p></div><div class=text><h2>+4</h2><p>+20</p><p>+1</p><p>+14</p></div><div id=comments><p>-19</p><p>-1</p></div>",
    "<div class=cookie-notice><p>-16</p></div><div>-3/3</div><div><p>+24</p><p>+6</p></div><form><p>-13</p><label>-2</label></form><div class=footer>-2</div>",
    "<ul class=menu><li>-1<li>-1</ul><article><header><h1>+3</h1><p>+3</p></header><p>+2</p><p>+19</p><div class=ad>-13</div><p>+9/2</p><section class=comments><p>-18</p></section></article><div>-7/7</div>",
    "<div class=related><h3>-2</h3><p>-15</p></div><p>+17</p><p>+2</p><p>+9</p><p>-2/2</p><p>-2/2</p>",
    "<div><p>-4/4</p></div><article><p>+1</p><p>+6/6</p><ol><li>+2/2<li>+4</ol><p>+2</p></article><aside>-1</aside><nav>-1/1</nav>",
    "<nav>-1/1</nav><article><h1>+3</h1><p>+18</p><p>+2</p><footer>-16</footer>",
    "<article><h1>+2</h1><p>+19</p><aside><p>-15</p></aside><p>+4</p><form><p>-16</p></form><nav><p>-1</p></nav><p>+9</p><footer><p>-3</p></footer></article>",
    "<div class=content><p>+20</p><p>+4</p></div><footer><p>-15</p></footer><aside><p>-17</p></aside><nav><p>-18</p></nav>",
    "<article><p>+30</p><ul><li>+4/4<li>+3/3</ul><p>+12/12</p><p>+20</p><div>+7/7</div></article>",
    "<article><p>+40</p><p>+31</p></article>",
    "<div><article><p>+15</p><p>+22/2</p><p>+9</p></article></div><div>-4/4</div>",
    "<div><p>+44</p></div><article><p>-6/3</p></article><article><p>-4/4</p></article>",
    # No telling tag or name.
    "<p>+16</p><div>+30</div><div>-4/4</div>",
    "<div><p>+12</p><p>+60</p><p>+9</p></div>",
    "<p>+5</p><p>+33</p><p>+21/2</p>",
    "<div><div>-1/1</div><div>-1/1</div><div>-2/2</div></div><div><h1>+5</h1><div>+45</div><div>+3</div><div>+30/4</div></div><div>-8/6</div>",
    "<ul><li>-1/1<li>-2/2<li>-1/1</ul><div>+35</div><div>+28/3</div><div>+4</div><div>+16</div><ul><li>-3/3<li>-4/4</ul>",
    "<p>-5/5</p><p>+50</p><p>+8/6</p><p>+31</p><p>-3/3</p>",
    "<div><p>+7/5</p></div>",
    "<div><p>+9/7</p></div>",
    "<p>+30</p><p>+10/8</p><p>+12</p><p>+5/4</p><p>+20</p>",
    "<div><p>+3</p></div>",
    "<p>+1</p>",
    "<div>+12</div>",
    "<table><tr><td>-1/1<td>-1/1<td>-1/1</table><h1>+4</h1><p>+40</p><p>+2</p><ul><li>+6<li>+3<li>+9/2</ul><p>+22</p><div>-6/4</div>",
    "<div>-2/2</div><div>-2/2</div><h2>+6</h2><p>+18/9</p><p>+44</p><h2>+2</h2><p>+12</p><div>-9/8</div>",
    "<div>-4/3</div><div>+26</div><div>+70/8</div><div>+5/2</div><div>-5/4</div><div>-10/9</div>",
    "<div>-6/4</div><p>+14</p><p>+11/8</p><p>+33</p><div>-6/4</div>",
    # A few words over a list of links name the list; between paragraphs they are a heading or a short paragraph.
    "<div>-2</div><div>-1/1</div><div>-2/2</div><div>-1/1</div><div>+40</div><div>+2</div><div>+33</div><div>-2</div><div>-3/3</div><div>-2/2</div>",
    "<p>-1</p><ul><li>-1/1<li>-2/2</ul><p>+30</p><p>+1</p><p>+20</p><p>-3</p><p>-4/4</p><p>-3/3</p>",
    "<h3>-2</h3><ul><li>-2/2<li>-3/3</ul><h1>+5</h1><p>+25</p><h3>+2</h3><p>+40</p><h3>-3</h3><ul><li>-5/5<li>-4/4</ul>",
    "<div>-3</div><p>-4/4</p><p>+3</p><p>+27</p><p>+2</p><div>+21</div><div>-1</div><div>-2/2</div>",
    # What stands outside a page's article isn't its text, whatever it is called.
    "<div>-8</div><div>-30</div><article><h1>+4</h1><p>+12</p></article><div>-25</div><p>-14</p>",
    "<h1>-3</h1><p>-12</p><main><p>+5/4</p><p>+16</p><div>+9</div></main><p>-20/2</p><ul><li>-7<li>-2/2</ul>",
    "<div class=banner>-12</div><article><h2>+3</h2><ul><li>+1/1<li>+2/2<li>+8</ul><div class=share>-2/2</div><p>+3/3</p></article><article class=comment><p>-22</p></article>",
)
LABEL = re.compile(r"([+-])(\d+)(?:/(\d+))?")


def labelled(layout: str) -> str:
    """The page of a layout; each block begins with its label's sign."""

    def text(m: re.Match) -> str:
        words = [m[1] + "word", *["word"] * (int(m[2]) - 1)]
        k = len(words) - int(m[3] or 0)
        return " ".join(words[:k]) + (f" <a href=/x>{' '.join(words[k:])}</a>" if m[3] else "")

    return re.sub(r"(?<=>)[^<]+", lambda m: LABEL.sub(text, m[0]), layout)


@dataclass
class Node:
    main: bool
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


def grown(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Node:
    """A decision tree by Gini impurity; of equal cuts the first feature's lowest wins, and main text of equal counts."""
    node = Node(bool(y.mean() >= 0.5))
    gini = lambda v: 2 * v.mean() * (1 - v.mean()) * len(v) if len(v) else 0.0
    if depth == 0 or y.min() == y.max():
        return node
    best = (gini(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= cut
            best = min(best, (round(gini(y[low]) + gini(y[~low]), 9), f, cut), key=lambda b: b[0])
    if best[1] < 0:
        return node
    low = x[:, best[1]] <= best[2]
    node.feature, node.cut = best[1], best[2]
    node.low, node.high = grown(x[low], y[low], depth - 1), grown(x[~low], y[~low], depth - 1)
    return node


@functools.cache
def tree() -> Node:
    rows, labels = [], []
    for layout in LAYOUTS:
        found = blocks(labelled(layout))
        rows.append(features(found))
        labels += [b.text[0] == "+" for b in found]
    return grown(np.concatenate(rows), np.array(labels, float))


def classified(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), bool)
    todo = [(tree(), np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.feature < 0:
            out[rows] = node.main
        elif len(rows):
            low = x[rows, node.feature] <= node.cut
            todo += [(node.low, rows[low]), (node.high, rows[~low])]
    return out


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n".join(b.text for b, main in zip(found, classified(features(found)), strict=True) if main)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [main_text(h.as_py()) for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], ["page_id", "url", "text"])

    return common.small_batches(pages).select("page_id", "url", "html").mapInArrow(run, "page_id bigint, url string, text string")


def digest(found: DataFrame) -> DataFrame:
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
