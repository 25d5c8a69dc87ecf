"""Main text of HTML pages by classifying flat text blocks.

A page is cut into blocks of text at block-level tags. Each block has its number
of words and its link density, those of the blocks before and after it, and two
hints: where the tags around it put it, and what the names of the containers
around it say. A decision tree, trained on the small labelled table below, keeps
or drops each block. No name decides by itself: long prose among long prose stays
whatever its container is called, and runs of links go even inside an article.

The tags are read by one regular expression that never backtracks into what it
has read, so malformed pages cost no more than well-formed ones.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspan.llm.common import read

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>|<[!?/][^>]*+>",
    re.S,
)
#: A name, with a value if it has one, from the end of the one before.
_ATTRIBUTE = re.compile(r"[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>]*+)))?")
_OWN, _MAIN = re.compile(r"<(?:main|article)(?=[\s/>])", re.I), re.compile(r"<main(?=[\s/>])", re.I)
_HAS = re.compile(r"(?<![^\s])(?:has|with|without|no)[-_]\S+", re.I)
#: The next tag of a link.
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Tags that end a block.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Tags whose content is no markup, and tags whose content is no text of the page.
RAW = frozenset("script style textarea title iframe noembed xmp".split())
SKIPPED = frozenset("noscript template svg math select button object canvas audio video datalist map dialog".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Containers that are remembered, with where their tag alone puts what is inside.
ARTICLE, BOILER, FIXED, PLAIN = "article", "boiler", "fixed", ""
CONTAINERS = {"article": ARTICLE, "main": ARTICLE, "nav": FIXED, "aside": FIXED, "footer": FIXED, "form": FIXED, "menu": FIXED, "header": "header", "dialog": FIXED, "div": PLAIN, "section": PLAIN, "ul": PLAIN, "ol": PLAIN, "table": PLAIN, "td": PLAIN, "p": PLAIN, "span": PLAIN, "details": PLAIN, "blockquote": PLAIN, "body": PLAIN}
#: Words in class, id and role. Those of FIXED hold for all that is inside.
WORDS = {w: BOILER for w in "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall".split()}
WORDS |= {w: FIXED for w in "sidebar menu nav navigation navbar topbar breadcrumb breadcrumbs masthead footer copyright contentinfo complementary comment comments discussion disqus respond reply replies reactions related recommended recommendations trending share sharing social login signup search form widget toolbar pagination pager tracking".split()}
WORDS |= {w: ARTICLE for w in "article main content post entry story".split()}
WORDS |= {"header": "header"}
#: Words of FIXED that say what an article inside is: no article of the page's own.
OTHERS = frozenset("comment comments discussion disqus respond reply replies reactions related recommended recommendations trending".split())
#: Words that leave the one before them the head of a name, as in ad-slot.
AROUND = frozenset("area bar block body box button buttons col column container group holder icons inner item items left link links list outer panel primary region right row secondary section slot text top bottom unit wrap wrapper".split())

#: Kinds of blocks that the labelled table speaks of: words and link density.
KINDS = {"none": (0, 0.0), "word": (1, 0.0), "line": (4, 0.0), "short": (12, 0.0), "para": (30, 0.0), "prose": (90, 0.0), "link": (2, 1.0), "phrase": (9, 1.0), "mixed": (30, 0.5)}
#: Labelled by hand. Place (1 in an article's tag, -1 in a tag for something else, 0
#: neither), name (1 a word for content, -1 one for something else, 0 neither), the
#: block, the block before, the block after, 1 to keep. Alternatives have commas
#: between; a row stands for each choice among them.
TABLE = """
1   0,1     word,line,short,para,prose,mixed  none,word,line,short,para,prose,link,phrase,mixed  none,word,line,short,para,prose,link,phrase,mixed  1
1   0,1     link,phrase                       none,word,line,short,para,prose,mixed              none,word,line,short,para,prose,mixed              1
1   0,1     link,phrase                       link,phrase                                        none,word,line,short,para,prose,link,phrase,mixed  0
1   0,1     link,phrase                       none,word,line,short,para,prose,mixed              link,phrase                                        0
-1  -1,0,1  word,line,short,para,prose,mixed  none,word,line,short,para,prose,link,phrase,mixed  none,word,line,short,para,prose,link,phrase,mixed  0
-1  -1,0,1  link,phrase                       none,word,line,short,para,prose,link,phrase,mixed  none,word,line,short,para,prose,link,phrase,mixed  0
0,1 -1      word,line,short,para,mixed        none,word,line,short,para,prose,link,phrase,mixed  none,word,line,short,para,prose,link,phrase,mixed  0
0,1 -1      link,phrase                       none,word,line,short,para,prose,link,phrase,mixed  none,word,line,short,para,prose,link,phrase,mixed  0
0,1 -1      prose                             none,word,line,short,link,phrase,mixed             none,word,line,short,para,prose,link,phrase,mixed  0
0,1 -1      prose                             para,prose                                         none,word,line,short,link,phrase,mixed             0
0,1 -1      prose                             para,prose                                         para,prose                                         1
0   1       word,line,short,para,prose,mixed  none,word,line,short,para,prose,link,phrase,mixed  none,word,line,short,para,prose,link,phrase,mixed  1
0   1       link,phrase                       none,word,line,short,para,prose,mixed              none,word,line,short,para,prose,mixed              1
0   1       link,phrase                       link,phrase                                        none,word,line,short,para,prose,link,phrase,mixed  0
0   1       link,phrase                       none,word,line,short,para,prose,mixed              link,phrase                                        0
0   0       link,phrase                       none,word,line,short,para,prose,link,phrase,mixed  none,word,line,short,para,prose,link,phrase,mixed  0
0   0       mixed                             none,word,line,short,link,phrase,mixed             none,word,line,short,para,prose,link,phrase,mixed  0
0   0       mixed                             para,prose                                         none,word,line,short,link,phrase,mixed             0
0   0       mixed                             para,prose                                         para,prose                                         1
0   0       para,prose                        none,word,line,short,para,prose,link,phrase,mixed  none,word,line,short,para,prose,link,phrase,mixed  1
0   0       short                             short,para,prose                                   none,word,line,short,para,prose,link,phrase,mixed  1
0   0       short                             none,word,line,link,phrase,mixed                   short,para,prose                                   1
0   0       short                             none                                               none                                               1
0   0       short                             word,line,link,phrase,mixed                        none,word,line,link,phrase,mixed                   0
0   0       short                             none                                               word,line,link,phrase,mixed                        0
0   0       line                              none,word,line,short,para,prose,link,phrase,mixed  para,prose                                         1
0   0       line                              short,para,prose                                   short                                              1
0   0       line                              none,word,line,link,phrase,mixed                   none,word,line,short,link,phrase,mixed             0
0   0       line                              short,para,prose                                   none,word,line,link,phrase,mixed                   0
0   0       word                              short,para,prose                                   short,para,prose                                   1
0   0       word                              none,word,line,link,phrase,mixed                   none,word,line,short,para,prose,link,phrase,mixed  0
0   0       word                              short,para,prose                                   none,word,line,link,phrase,mixed                   0
"""
#: Columns of the table that the text gives, not the markup.
TEXT = range(2, 8)


def _gini(kept: np.ndarray) -> float:
    p = kept.mean()
    return 2 * p * (1 - p) * len(kept)


def grow(rows: np.ndarray, depth: int = 16) -> float | tuple:
    """A decision tree: the share kept at a leaf, else (column, at most, then, else)."""
    x, y = rows[:, :-1], rows[:, -1]
    best = (_gini(y) - 1e-9, None)
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, c] <= cut
            if (g := _gini(y[low]) + _gini(y[~low])) < best[0] - 1e-12:
                best = (g, (c, float(cut), low))
    if not depth or best[1] is None:
        return float(y.mean())
    c, cut, low = best[1]
    return (c, cut, grow(rows[low], depth - 1), grow(rows[~low], depth - 1))


def kept(tree: float | tuple, x: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def table() -> np.ndarray:
    """The labelled table: place, name, words and link density of the block, the same
    two of the block before and of the block after, kept."""
    rows = []
    for line in TABLE.strip().splitlines():
        *hints, block, before, after, keep = (x.split(",") for x in line.split())
        rows += [(*map(float, h), *KINDS[b], *KINDS[p], *KINDS[n], float(keep[0])) for h in product(*hints) for b, p, n in product(block, before, after)]
    return np.array(rows)


def _attributes(rest: str) -> dict[str, str]:
    """Of a tag's names and values, the first value of each name."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return found


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes and attributes["hidden"].lower() != "until-found"


def _words(attributes: dict[str, str]) -> set[str]:
    """The heads of the names in class, id and role, and what is before words such as
    box or left: ad of top-ad and ad-slot, but study of social-study. Names that say
    what else there is, as with-sidebar, have none."""
    heads = set()
    for k in ("class", "id", "role"):
        for name in _HAS.sub(" ", attributes.get(k, "")).split():
            words = [w.lower() for w in _NAME.findall(name)]
            while len(words) > 1 and words[-1] in AROUND:
                words.pop()
            heads.update(words[-1:])
    return heads


def _outer(page: str) -> set[int]:
    """Where the containers begin that hold the page's main or else its first article,
    and where that begins. Their words for FIXED say what else they hold. One that is
    skipped, in a tag for FIXED or, as an article, in a container of OTHERS is not it."""
    if not (found := _OWN.search(page)):
        return set()
    last, first = _MAIN.search(page, found.start()), None
    stack: list[tuple[str, int, bool, bool]] = []  # name, where, never holds it, holds other articles
    for m in _tags(page):
        name = (m["name"] or m["name2"]).lower()
        if m["end"] or m["end2"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name not in SKIPPED and name not in CONTAINERS:
            continue
        if name == "p" and stack and stack[-1][0] == "p":
            stack.pop()
        attributes = _attributes(m["rest"] or m["rest2"] or "")
        never = name in SKIPPED or CONTAINERS[name] in (FIXED, "header") or _hidden(attributes)
        others = name != "body" and not OTHERS.isdisjoint(_words(attributes))
        stack.append((name, m.start(), never, others))
        if name in ("main", "article") and not any(x[2] for x in stack):
            if name == "main":
                return {x[1] for x in stack}
            if first is None and not any(x[3] for x in stack):
                first = {x[1] for x in stack}
        if first is not None and last is None:
            break
    return first or set()


def _tags(page: str) -> Iterator[re.Match]:
    """The page's tags; what is inside a raw one is none."""
    at = 0
    while m := _TAG.search(page, at):
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        yield m
        if name in RAW and not (m["end"] or m["end2"]):
            at = _raw_end(page, name, at)


def _raw_end(page: str, name: str, at: int) -> int:
    found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
    return found.start() if found else len(page)


def _says(name: str, rest: str, above: tuple[str, str], outer: bool = False) -> tuple[str, str] | None:
    """(place, name) of a container's content, given those around it; None if hidden."""
    place, named = above
    own = CONTAINERS.get(name, PLAIN)
    attributes = _attributes(rest) if rest else {}
    if _hidden(attributes):
        return None
    # the body's words are of the whole page
    found = {WORDS.get(w) for w in _words(attributes)} if name != "body" else set()
    if outer:
        found -= {FIXED, BOILER}
    if place != FIXED:
        if own == ARTICLE:
            place = ARTICLE
        elif own == FIXED or own == "header" and place != ARTICLE:  # an article's own header is part of it
            place = FIXED
    if named != FIXED:
        if FIXED in found or "header" in found and place != ARTICLE:
            named = FIXED
        elif BOILER in found:
            named = BOILER
        elif own == ARTICLE:  # a container's word for content doesn't undo boilerplate; the tags do
            named = ARTICLE if ARTICLE in found else PLAIN
        elif ARTICLE in found and named != BOILER:
            named = ARTICLE
    return place, named


_HINT = {ARTICLE: 1, PLAIN: 0, FIXED: -1, BOILER: -1}


def blocks(page: str) -> list[tuple[str, int, int, int, float]]:
    """(text, place, name, words, link density) of each block with text, in order."""
    out, parts, links = [], [], 0
    anchor = None  # True in a link that is closed, False in one that isn't and so ends with its block
    stack: list[tuple[str, tuple[str, str] | None]] = []
    says: tuple[str, str] | None = (PLAIN, PLAIN)
    outer = _outer(page)

    def flush() -> None:
        nonlocal parts, links, anchor
        if parts:
            words = "".join(parts).split()
            if words and says:
                out.append((" ".join(words), _HINT[says[0]], _HINT[says[1]], len(words), min(1.0, links / len(words))))
            parts, links = [], 0
        if anchor is False:
            anchor = None

    def add(a: int, b: int) -> None:
        nonlocal links
        if b > a:
            text = page[a:b]
            if "&" in text:
                text = entities.unescape(text)
            parts.append(text)
            if anchor is not None:
                links += len(text.split())

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            add(at, n)
            break
        add(at, m.start())
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        closing = bool(m["end"] or m["end2"])
        if name in BLOCKS:
            flush()
        if name == "br":
            parts.append(" ")
        elif name == "a":
            after = None if closing else _LINK.search(page, at)
            anchor = None if closing else bool(after and after[1])
        elif closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    flush()
                    del stack[k:]
                    says = stack[-1][1] if stack else (PLAIN, PLAIN)
                    break
        elif name in RAW:
            at = _raw_end(page, name, at)
        elif name in SKIPPED or name in CONTAINERS:
            if name == "p" and stack and stack[-1][0] == "p":  # a paragraph ends the one before
                stack.pop()
                says = stack[-1][1] if stack else (PLAIN, PLAIN)
            inside = None if name in SKIPPED or says is None else _says(name, m["rest"] or m["rest2"] or "", says, m.start() in outer)
            if inside != says:
                flush()
            stack.append((name, inside))
            says = inside
    flush()
    return out


def features(found: list[tuple[str, int, int, int, float]]) -> list[tuple]:
    """The table's columns for each block; beyond the ends of a page are no words."""
    ends = [("", 0, 0, 0, 0.0)]
    return [(*b[1:], *a[3:], *c[3:]) for a, b, c in zip(ends + found[:-1], found, found[1:] + ends, strict=True)] if found else []


def extract(page: str | None, tree: float | tuple) -> str:
    """The kept blocks, joined by two line ends; empty for null."""
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, x in zip(found, features(found), strict=True) if kept(tree, x))


def extractor():
    """A function of an HTML column: the page's main text."""
    tree = grow(table())

    def run(column):
        import pandas as pd

        return pd.Series([extract(page, tree) for page in column], dtype="object")

    udf = F.pandas_udf(run, "string")

    def of(html: Column) -> Column:
        return udf(html)

    return of


def main_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """pages with the main text in `name`; a column of that name is replaced.

    A null or empty page, and one without kept blocks, has the empty text. Other
    columns are kept; repeated rows are repeated; an empty table stays empty.
    """
    return pages.withColumn(name, extractor()(F.col(html)))


def op10_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = main_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
