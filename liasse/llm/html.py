"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks of text at block-level tags. A block has its word
count, its link density (share of words inside links) and the marks of the
elements around it (navigation and the like, article and the like, or none);
an article takes off the mark of a wrapper, not that of a list of remarks or
teasers, and a form around the page marks nothing; it also sees the counts and densities of its two neighbours. A decision tree
on these eight numbers says which blocks are main text. The tree is grown on
the labelled blocks of ``labelled_pages.html``, a small file beside this
module, with Gini splits.

Contents of scripts, styles, forms and the head never are text. Comments and
tags go, character references are decoded, white space inside a block becomes
one space, blocks are joined in page order by one space.

Results for odd input: null and empty pages give an empty text; tags that are
never closed reach to the end of what encloses them; a page may be cut
anywhere; pages of any length are read whole; repeated rows stay; an empty
table gives an empty one.
"""

from __future__ import annotations

import bisect
import functools
import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from liasse.llm.batches import map_batches

FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "mark", "heading")
DEPTH = 6
LEAST_LEAF = 2
ROWS_OUT = 256

#: Elements of HTML by what they mean for text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SILENT = set("script style noscript template head title svg math canvas iframe object audio video select textarea button datalist".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
AROUND = set("nav footer aside form dialog menu header".split())
MAIN = set("article main".split())
#: Words of names in class, id and role that tell what stands around a text.
AROUND_WORDS = set(
    "ad ads advert advertisement adsense banner sponsor sponsored promo promotion sidebar side rail widget nav navbar navigation menu breadcrumb breadcrumbs header "
    "masthead footer cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended "
    "comment comments disqus reply replies respond pagination pager toolbar copyright legal contentinfo complementary hidden".split())
#: Words that only say which or where; a name of others too (has-sidebar, comments-open) tells of a state or a layout.
PLAIN_WORDS = set(
    "site global main top bottom left right primary secondary first second third inner outer area bar block box container wrap wrapper section panel list item items "
    "link links button buttons group form text thread unit slot".split())
#: Words for texts; a header of one (entry-header) holds its title.
TEXT_WORDS = set("article articles entry entries page post posts story stories".split())
HEADER_WORDS = set("header banner masthead".split())
#: What holds remarks, teasers or hidden text in article elements of their own.
CARDS = set("nav footer aside dialog menu".split())
CARD_WORDS = set("related recommended comment comments disqus reply replies respond hidden".split())
MAIN_NAMES = set("article article-body post-body post-content entry-content story-body main-content".split())
#: Elements that a form which sends something doesn't hold, but one around the page does.
_LANDMARK = re.compile(r"<(?:article|main|h1|nav|aside|header|footer)\b|\brole\s*=\s*[\"']?(?:main|article)\b", re.I)
_FORM_END = re.compile(r"</form\b", re.I)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|data-keep)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
_WORD = re.compile(r"\S+")


@dataclass
class Block:
    text: str
    words: int
    linked: int
    mark: int
    heading: int
    keep: str | None = None

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


def _around(name: str) -> set[str]:
    """The words of a name which tell that it stands around a text; none if it also tells something else."""
    words = [w for w in re.split(r"[-_]+", name.lower()) if w and not w.isdigit()]
    hits = AROUND_WORDS.intersection(words)
    if hits <= HEADER_WORDS and TEXT_WORDS.intersection(words):
        return set()
    return hits if all(w in hits or w in PLAIN_WORDS or w in TEXT_WORDS for w in words) else set()


def _mark(tag: str, attributes: dict[str, str], above: int, around_page: bool) -> int:
    """-1: stands around the text, -2: so do articles inside it, 1: article and the like, 0: says nothing.

    ``above``: the mark of what encloses it; ``around_page``: a form that holds the parts of a page. Names
    on the whole page tell what it holds, not what it is; those of an article, what belongs to it.
    """
    if tag in ("html", "body"):
        return 0
    role = attributes.get("role", "").lower().split()
    names = [n for k in ("class", "id") for n in attributes.get(k, "").split()] + role
    if "hidden" in attributes:
        own = -2
    elif tag in MAIN or "main" in role or MAIN_NAMES.intersection(n.lower() for n in names):
        own = 1
    else:
        hits = set().union(*map(_around, names))
        titled = tag == "header" and (above == 1 or any(TEXT_WORDS.intersection(re.split(r"[-_]+", n.lower())) for n in names))
        if tag in CARDS or hits & CARD_WORDS:
            own = -2
        else:
            own = -1 if hits or tag in AROUND and not titled and not around_page else 0
    if above == -2:
        return 1 if own == 1 and (tag == "main" or "main" in role) else -2
    if above == -1:
        return own or -1
    return own or above


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; blocks without a word are left out."""
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    open_tags: list[tuple[str, int, bool, str | None]] = [("", 0, False, None)]  # tag, mark, silent, label
    ends: list[int] | None = None  # of forms and, below, the page's landmarks; both are looked for at the first form
    landmarks: list[int] = []

    def end_block() -> None:
        # references are decoded over the joined parts, so that the tags between them don't matter
        text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
        if text:
            linked = sum(len(_WORD.findall(t)) for t, link in parts if link)
            words = text.count(" ") + 1
            heading = int(any(re.fullmatch(r"h[1-6]", t[0]) for t in open_tags))
            out.append(Block(text, words, min(linked, words), max(open_tags[-1][1], -1), heading, open_tags[-1][3]))
        parts.clear()

    def hear(text: str) -> None:
        if text and not open_tags[-1][2]:
            parts.append((text, any(t[0] == "a" for t in open_tags)))

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        hear(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag not in INLINE and tag not in VOID:
            end_block()
        elif tag in ("br", "hr", "img", "wbr"):
            hear(" ")
        if m[1]:
            depth = next((i for i in range(len(open_tags) - 1, 0, -1) if open_tags[i][0] == tag), 0)
            if depth and (tag not in INLINE or all(t[0] in INLINE for t in open_tags[depth:])):
                del open_tags[depth:]
            continue
        if tag in VOID or m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "article", "section", "div", "footer", "header", "nav", "aside"):
            _close_implied(tag, open_tags)
        above = open_tags[-1]
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(m[3])}
        around_page = False
        if tag == "form":
            if ends is None:
                ends, landmarks = ([x.start() for x in p.finditer(page)] for p in (_FORM_END, _LANDMARK))
                ends.append(len(page))
            end = ends[bisect.bisect_left(ends, at)]
            around_page = bisect.bisect_left(landmarks, at) < bisect.bisect_left(landmarks, end)
        open_tags.append((tag, _mark(tag, attributes, above[1], around_page), above[2] or tag in SILENT, attributes.get("data-keep", above[3])))
    hear(page[at:] if not page[at:].lstrip().startswith("<") else "")
    end_block()
    return out


def _close_implied(tag: str, open_tags: list) -> None:
    """A paragraph or an item ends where the next one, or a larger part, begins; inline elements in it end with it."""
    ends = {"p"} if tag not in ("li", "dt", "dd", "tr", "td", "th", "option") else {tag, "p"}
    i = len(open_tags) - 1
    while i > 0 and open_tags[i][0] in INLINE:
        i -= 1
    if i > 0 and open_tags[i][0] in ends:
        del open_tags[i:]


def features(page: list[Block]) -> np.ndarray:
    if not page:
        return np.empty((0, len(FEATURES)))
    own = np.array([[b.words, b.density] for b in page], np.float64)
    none = np.zeros((1, 2))
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    rest = np.array([[b.mark, b.heading] for b in page], np.float64)
    return np.concatenate([own, before, after, rest], axis=1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = DEPTH):
    """A tree as nested (feature, limit, below or at, above) with the share of main text at the leaves."""
    share = float(y.mean())
    best = None
    if depth and 0 < share < 1:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for limit in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= limit
                n = int(low.sum())
                if LEAST_LEAF <= n <= y.size - LEAST_LEAF:
                    p, q = y[low].mean(), y[~low].mean()
                    impurity = n * p * (1 - p) + (y.size - n) * q * (1 - q)
                    if best is None or impurity < best[0] - 1e-12:
                        best = (impurity, f, float(limit), low)
    if best is None or best[0] >= y.size * share * (1 - share) - 1e-12:
        return share
    _, f, limit, low = best
    return f, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def decide(tree, row: np.ndarray) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@functools.lru_cache(maxsize=1)
def trained():
    """The tree of the labelled pages; in the file, ``data-keep`` says 1 for main text and 0 for the rest."""
    pages = resources.files("liasse.llm").joinpath("labelled_pages.html").read_text("utf-8").split("<!-- page -->")
    xs, ys = [], []
    for page in pages:
        own = blocks(page)
        if own:
            xs.append(features(own))
            ys += [float(b.keep == "1") for b in own]
    return grow(np.concatenate(xs), np.array(ys))


def main_text(page: str | None, tree) -> str:
    own = blocks(page or "")
    return " ".join(b.text for b, row in zip(own, features(own), strict=True) if decide(tree, row) >= 0.5)


def extracted(pages: DataFrame, keep: list[str], source: str = "html", out: str = "text") -> DataFrame:
    """The columns ``keep`` of ``pages`` and the main text of each page."""
    tree = trained()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(i, ROWS_OUT)
                texts = pa.array([main_text(p.as_py(), tree) for p in part.column("_page")], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), texts], [*keep, out])

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{out}` string"])
    return map_batches(pages.select(*keep, F.col(source).alias("_page")), run, schema)


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text and its length in code points of every page."""
    return extracted(pages, ["page_id", "url"]).withColumn("n_chars", F.length("text").cast("long"))
