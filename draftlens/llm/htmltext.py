"""Main text of web pages from the event stream of the standard library's parser.

The parser's events cut a page into lines: the text between two block tags. Each line has a text-to-tag ratio (its
characters over the tags met in it, one at least). The logarithms of the ratios are smoothed along the page by a
Gaussian and split by a threshold into two clusters (midway between two means, but never above `PROSE` characters a tag,
so that a short paragraph is prose beside a very long one). Lines belong to regions: the outermost article or main
around them, or else the nearest div, section, cell or body. A region stays where its lines,
weighted by their text, reach the threshold; the best region always does. It keeps its short lines too, which have low
ratios anywhere. Four rules go with that: what stands outside all articles stays only where it has more content than
they have together; outside them a line of links alone needs a ratio of its own; a heading right before a line that
stays, stays, and so does a region between two of the same parent that stay, unless it is links alone.

Text in menus, footers, asides, forms, notices, adverts, comments and the like is judged by element and by name, piece
by piece: a line of it has the ratio zero, is one of the lower cluster, and never stays. But where no article stands
outside such an element and it holds over half of the text, its name says something else, and it is judged by ratio as
any other.

Edge cases: null, empty and textless pages give the empty string; tags left open or closed twice end where an enclosing
tag ends; text outside any body is a line like any other; character references are decoded once; repeated rows stay rows.
Time grows in proportion to the page, however broken it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlens.session import ship_package

SIGMA = 0.6
#: Characters a tag from which a line counts as prose wherever the clusters lie, and how far apart two clusters are at least (as a factor).
PROSE, APART = 20.0, 2.0
#: Elements by their use in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SILENT = frozenset("script style noscript template head title iframe object svg canvas math audio video select option textarea button datalist".split())
CHROME = frozenset("nav footer aside form menu dialog fieldset".split())
GROUPS = frozenset("article body div header html main section td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Those of CHROME that may stand around a whole page.
WRAPPERS = frozenset("form fieldset".split())
CONTAINERS = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class, id and role names that mark what is not the article.
NOISE_WORDS = "ads?|advert\\w*|banner|breadcrumbs?|comments?|comment-?list|respond|cookies?|consent|disclaimer|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo\\w*|related|share|sharing|sidebar|social|sponsor\\w*|subscribe|toolbar|widget|complementary|contentinfo|search"
NOISE = re.compile(rf"(?:^|[\s_-])(?:{NOISE_WORDS})(?:$|[\s_-])", re.I)
#: Inside an article a name counts only as a whole, with nothing but words of layout beside it: "related-work" is a chapter.
LAYOUT = "area|articles?|bar|block|box|buttons?|container|content|form|icons?|inner|items?|label|links?|list|posts?|section|signup|slot|stories|title|unit|wrap|wrapper|\\d+"
NOISE_INSIDE = re.compile(rf"(?:^|\s)(?:(?:article|content|entry|inline|page|post|site)[_-])?(?:{NOISE_WORDS})(?:[_-](?:{NOISE_WORDS}|{LAYOUT}))*(?:$|\s)", re.I)
#: The same for an article, whose names say more of its kind than of its place.
NOT_ARTICLE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|promo|related|reply|sponsor\w*|teaser)(?:$|[\s_-])", re.I)
#: A p is closed by any of these opening inside it.
CLOSES_P = BLOCKS - {"body", "html", "caption", "legend", "summary", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt"}


@dataclass(slots=True)
class Node:
    parent: int
    tag: str
    silent: bool
    doubt: int  # 0: none of its own, 1: by its name or as a wrapper, 2: by its element
    container: int  # the outermost article or main it stands in, or is
    group: int  # the nearest element of GROUPS
    link: bool
    bad: bool = False
    text: int = 0


@dataclass(slots=True)
class Line:
    parts: list[tuple[str, int]]  # text and the node it stands in
    tags: int
    text: str = ""
    node: int = 0


class Lines(HTMLParser):
    """Collects the elements of a page and its lines, in page order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(-1, "", False, 0, -1, 0, False)]
        self.open = [0]
        self.places: dict[str, list[int]] = {}  # of the open elements of each name in self.open
        self.blocks: list[int] = []  # of the open blocks other than p
        self.lines: list[Line] = []
        self.parts: list[tuple[str, int]] = []
        self.tags = 0

    def end_line(self) -> None:
        if self.parts:
            self.lines.append(Line(self.parts, self.tags))
            self.parts, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.end_line()
            if tag in CLOSES_P:
                self.leave("p", inside=self.blocks)
        elif tag == "br" and self.parts:
            self.parts.append((" ", self.open[-1]))
        self.tags += 1
        if tag in VOID:
            return
        up, own = self.open[-1], len(self.nodes)
        over = self.nodes[up]
        heads = over.container >= 0 and (tag in HEADINGS or tag in ("header", "hgroup"))
        inside = NOISE_INSIDE if over.container >= 0 else NOISE
        noise = None if tag in ("html", "body", "main") else NOT_ARTICLE if tag == "article" or heads else inside
        named = noise is not None and any(k in ("class", "id", "role", "aria-label") and v and noise.search(v) for k, v in attrs)
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)
        if (tag in CHROME and tag not in WRAPPERS) or hidden:
            doubt = 2
        else:
            doubt = int(named or tag in WRAPPERS or (tag == "header" and over.container < 0))
        container = own if tag in CONTAINERS and over.container < 0 and not doubt else over.container
        self.nodes.append(Node(up, tag, over.silent or tag in SILENT, doubt, container, own if tag in GROUPS else over.group, over.link or tag == "a"))
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS and tag != "p":
            self.blocks.append(len(self.open))
        self.open.append(own)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def finish(self) -> None:
        super().close()
        self.end_line()

    def leave(self, tag: str, inside: list[int] | None = None) -> None:
        """Close the last open element of this name and what is open in it, unless one of `inside` is. Each element is closed once."""
        at = self.places.get(tag)
        if not at or (inside and inside[-1] > at[-1]):
            return
        to = at[-1]
        while len(self.open) > to:
            name = self.nodes[self.open.pop()].tag
            self.places[name].pop()
            if name in BLOCKS and name != "p":
                self.blocks.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.end_line()
        self.tags += 1
        if tag in BLOCKS or tag in SILENT:
            self.leave(tag)
        elif not (self.places.get("p") and self.places["p"][-1] > self.places.get(tag, [0])[-1]):
            # inline tags don't close the block they stand in
            self.leave(tag, inside=self.blocks)

    def handle_data(self, data: str) -> None:
        node = self.nodes[self.open[-1]]
        if not node.silent:
            self.parts.append((data, self.open[-1]))
            node.text += len(data) - data.count(" ")

    def unknown_decl(self, data: str) -> None:
        pass

    def judge_names(self) -> None:
        """Set bad for what stands in an element of doubt, save where that holds over half of the text and no article is elsewhere."""
        nodes = self.nodes
        hard, doubted = [False] * len(nodes), [False] * len(nodes)
        for k, n in enumerate(nodes[1:], 1):
            hard[k] = hard[n.parent] or n.doubt == 2
            doubted[k] = doubted[n.parent] or n.doubt > 0
        total = sum(n.text for n, h in zip(nodes, hard, strict=True) if not h)
        article = any(n.text and n.container >= 0 and not d for n, d in zip(nodes, doubted, strict=True))
        inside = [0 if h else n.text for n, h in zip(nodes, hard, strict=True)]
        for k in range(len(nodes) - 1, 0, -1):
            inside[nodes[k].parent] += inside[k]
        for k, n in enumerate(nodes[1:], 1):
            spared = n.doubt == 1 and not article and 2 * inside[k] > total
            n.bad = nodes[n.parent].bad or (n.doubt > 0 and not spared)
            if n.container < 0 and n.tag in CONTAINERS and not n.bad and n.doubt == 0:
                n.container = k


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Convolution with a Gaussian over three sigma each way; the ends repeat."""
    reach = max(1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(level: np.ndarray) -> float:
    """Midway between the means of two clusters; the least level where they are less than APART apart."""
    low, high = level.min(), level.max()
    for _ in range(20):
        upper = level >= (low + high) / 2
        if not upper.any() or upper.all():
            break
        low, high = level[~upper].mean(), level[upper].mean()
    return float(level.min()) if high - low < np.log(APART) else float(min((low + high) / 2, np.log1p(PROSE)))


def closed_markup(html: str) -> str:
    """The page without a comment that never ends, and with every "<" after its last ">" as text: no tag can end there.

    The parser would look for the end of each of them again and again.
    """
    at = html.rfind("-->") + 3 if "-->" in html else 0
    begun = html.find("<!--", at)
    html = html if begun < 0 else html[:begun]
    last = html.rfind(">") + 1
    return html[:last] + html[last:].replace("<", "&lt;")


def between_kept(keep: np.ndarray, good: np.ndarray, region: np.ndarray, nodes: list[Node], plain: np.ndarray) -> np.ndarray:
    """keep, with the lines of regions that stand between two kept ones of the same parent and are not links alone."""
    first, last, own = {}, {}, {}
    for k, r in enumerate(region.tolist()):
        if good[k]:
            own.setdefault(r, []).append(k)
            if keep[k]:
                up = nodes[r].parent if r else -1
                first.setdefault(up, k)
                last[up] = k
    out = keep.copy()
    for r, places in own.items():
        up = nodes[r].parent if r else -1
        if not keep[places].any() and plain[places].any() and up in first and first[up] < places[0] and places[-1] < last[up]:
            out[places] = True
    return out


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    if not html:
        return ""
    page = Lines()
    page.feed(closed_markup(html))
    page.finish()
    page.judge_names()
    nodes, lines = page.nodes, []
    for line in page.lines:
        good = [(t, k) for t, k in line.parts if not nodes[k].bad]
        line.text = " ".join("".join(t for t, _ in good or line.parts).split())
        if line.text:
            line.node = next(k for t, k in good or line.parts if t.strip())
            lines.append((line, bool(good) and any(t.strip() for t, _ in good)))
    if not any(good for _, good in lines):
        return ""
    good = np.array([g for _, g in lines])
    size = np.array([len(x.text) for x, _ in lines], dtype=float)
    tags = np.array([max(1, x.tags) for x, _ in lines])
    level = smoothed(np.log1p(good * size / tags), sigma)
    container = np.array([nodes[x.node].container for x, _ in lines])
    region = np.where(container >= 0, container, [nodes[x.node].group for x, _ in lines])
    _, own = np.unique(np.where(good, region, -1), return_inverse=True)
    reached = np.bincount(own, size * level) / np.bincount(own, size)
    keep = good & (reached >= min(threshold(level), reached.max()))[own]
    linked = np.array([all(nodes[k].link for t, k in x.parts if t.strip()) for x, _ in lines])
    keep = between_kept(keep, good, region, nodes, ~linked)
    votes = np.where(keep, size, 0)
    inside = container >= 0
    if votes[~inside].sum() > votes[inside].sum():
        # links alone are no article, unless a line of them is as dense as one
        keep &= inside | ~linked | (size / tags >= PROSE)
    else:
        keep &= inside
    for k in range(len(lines) - 2, -1, -1):
        n = lines[k][0].node
        while nodes[n].tag not in BLOCKS and nodes[n].parent > 0:
            n = nodes[n].parent
        if keep[k + 1] and good[k] and nodes[n].tag in HEADINGS:
            keep[k] = True
    return "\n\n".join(x.text for (x, _), k in zip(lines, keep, strict=True) if k)


def _extract(sigma: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), sigma) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, sigma: float = SIGMA) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text, n_chars."""
    ship_package(pages.sparkSession)
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return base.mapInArrow(_extract(sigma), "page_id long, url string, text string, n_chars long")
