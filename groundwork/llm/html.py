"""Main text of web pages by tag-path ratios.

A page is read once as a sequence of text nodes with their root-to-leaf tag paths. For every path the text length
and the punctuation of its nodes are added up and divided by the number of nodes; both ratios are laid along the page,
smoothed over neighbouring nodes, multiplied, and the nodes above the threshold are content. The article is the
outermost article or main element around nearly all of the selected text; on pages without one it's the smallest element
that holds all selected text and the headings before it. Its text is given whole, short paragraphs included, without what
lies in elements that are no article text by their name, role or class. A class word alone never removes an article: an element named so that holds an article or
main element, or over HALF of the text around it, is only in doubt, as are inside an article the names that also stand for parts of a story; of what is in doubt the ratio of the
path decides, and where nothing else is content, all that it selects is.

Defined results: a null or empty page, or one without text, gives an empty text; other columns, repeated rows and very
long pages pass through whole. The work is proportional to the page's length, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Neighbours on each side, and the standard deviation, of the smoothing window.
REACH, SIGMA = 2, 1.0
#: Nodes whose fused ratio is at least this share of the spread of the ratios are content.
LEVEL = 0.5
#: Share of the selected text by which an article or main element is found; what lies in that element is given whole.
HELD = 0.9
#: Share of the text of an article, or of a page, over which an element can't be told to be no text by its class.
HALF = 0.5
# Element names by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg select object canvas noembed noframes xmp math".split())
NOISE = set("nav footer aside form button menu dialog head".split()) | RAW
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"thead", "tbody", "tfoot", "tr", "td", "th"}, "tbody": {"thead", "tbody", "tfoot", "tr", "td", "th"}}
SCOPES = set("html body table td th ul ol dl div article section main".split())
NAMED = re.compile(
    r"(?:^|[-_\s])(?:ads?|adverts?|advertisements?|advertising|banner|sponsor(?:ed)?|promo(?:tion|s)?|sidebar|side-bar|rail|menu|nav(?:igation|bar)?|breadcrumbs?|footer|foot|masthead|site-header|page-header|topbar|"
    r"comments?|comment-list|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend(?:ed|ations)?|"
    r"widget|pagination|pager|tags|toolbar|skip-link|skip|copyright|legal|disclaimer|search)(?=$|[-_\s])",
    re.IGNORECASE,
)
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Of these, words that also stand in names of story parts: inside an article they count only as a whole class word.
WHOLE = set("banner promo promotion promos rail foot share sharing social related recommend recommended recommendations tags skip copyright legal disclaimer search".split())
#: Of these, words that inside an article leave a doubt in a longer class word, as in an eviction-notice.
WEAK = set("notice notices alert comment comments menu foot rail tags skip respond replies banner overlay widget search".split())
#: Beginnings of class words that say something of a page and not of the element.
ABOUT = re.compile(r"(?:has|no|not|with|without|hide|show|is|page-has|layout)-\S*", re.IGNORECASE)
#: Of these, words that stories are marked with too, so that the ratio of the element's path decides inside an article.
DOUBTED = set("copyright legal disclaimer search".split())
_QUOTE = re.compile(r"=\s*([\"'])")
_ATTR = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[^\s/>]+")
_MARKS = re.compile(r"[.,;:!?…。、，！？؟]")
_SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Element:
    """named: a class word says that it's no article text; path: number of the tag path; heading: it's a heading or in one; inside: it lies in an article."""

    name: str
    parent: int
    noise: bool
    path: int
    doubt: bool = False
    named: bool = False
    heading: bool = False
    inside: bool = False


@dataclass(slots=True)
class Node:
    text: str
    element: int
    block: int


def _is_noise(name: str, attributes: str, inside_article: bool) -> tuple[bool, bool, bool]:
    """Whether an element is no article text, whether its class says so, and whether only its ratio can tell."""
    if name in NOISE or name == "header" and not inside_article:
        return True, False, False
    if name in ("html", "body", "article", "main") or not attributes.strip():
        return False, False, False
    found = {k.lower(): html.unescape(a or b or c) for k, a, b, c in _ATTR.findall(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.IGNORECASE):
        return True, False, False
    if found.get("role", "").lower() in ROLES:
        return True, False, False
    words = [w for w in f"{found.get('class', '')} {found.get('id', '')}".lower().split() if not ABOUT.fullmatch(w)]
    said = {x.strip("-_ \t\r\n\f") for x in NAMED.findall(" ".join(words))}
    if not inside_article:
        return False, bool(said), False
    whole = {w.strip("-_") for w in words if NAMED.fullmatch(w)}
    sure = (whole - DOUBTED) | (said - WHOLE - WEAK - DOUBTED)
    return False, bool(sure), bool(said & (WEAK | DOUBTED))


class Tags:
    """The markup of a page, read once from left to right."""

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}

    def _end(self, at: int) -> int:
        """The place of a tag's closing sign, or -1. A quotation begins only after an equals sign and only where it's closed in front of white space
        or the tag's end; any other quotation mark is a letter like others."""
        page, pos = self.page, at
        end = page.find(">", at)
        while end >= 0 and (m := _QUOTE.search(page, pos, end)):
            pos = m.end()
            close = page.find(m[1], pos) if pos <= self.last[m[1]] else -1
            if close >= 0 and (page[close + 1 : close + 2].isspace() or page[close + 1 : close + 2] in ("/", ">")):
                pos = close + 1
                end = page.find(">", pos) if pos > end else end
        return end

    def next(self, at: int) -> tuple[int, int, str, str, str] | None:
        """From `at`, the next markup: where it begins and ends, its slash, name and attributes; a name of "" is a comment or the like."""
        page, n = self.page, len(self.page)
        while (at := page.find("<", at)) >= 0:
            sign = page[at + 1 : at + 2]
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, n if end < 0 else end + 3, "", "", ""
            if page.startswith("<![CDATA[", at):
                end = page.find("]]>", at)
                return at, n if end < 0 else end + 3, "", "", ""
            slash = "/" if sign == "/" else ""
            first = page[at + 1 + len(slash) : at + 2 + len(slash)]
            if first.isascii() and first.isalpha():
                end = self._end(at + 2)
                if end < 0:
                    return at, n, "", "", ""
                inner = page[at + 1 + len(slash) : end]
                name = _NAME.match(inner)[0]
                return at, end + 1, slash, name.lower(), inner[len(name) :]
            if sign in ("!", "?", "/"):
                end = page.find(">", at)
                return at, n if end < 0 else end + 1, "", "", ""
            at += 1
        return None


def parse(page: str) -> tuple[list[Element], list[Node]]:
    """Elements and text nodes of a page in order; unclosed and misplaced tags are taken as browsers do, roughly."""
    elements, nodes = [Element("#root", -1, False, 0)], []
    stack, block, at, inside_article, scopes = [0], 0, 0, 0, 0
    opened: dict[str, int] = defaultdict(int)
    paths: dict[tuple[int, str], int] = {}

    def text(s: str) -> None:
        if s and (not s.isspace() or nodes):
            nodes.append(Node(html.unescape(s), stack[-1], block))

    def pop(to: int) -> None:
        nonlocal block, inside_article, scopes
        while len(stack) > to:
            name = elements[stack.pop()].name
            opened[name] -= 1
            scopes -= name in SCOPES
            block += name not in INLINE
            inside_article -= name in ("article", "main")

    tags = Tags(page)
    while tag := tags.next(at):
        begin, end, slash, name, attributes = tag
        text(page[at:begin])
        at = end
        if not name:
            continue
        if slash and not opened[name]:
            block += name not in INLINE and not (scopes and name in ("p", "li"))
            continue
        if slash:
            for depth in range(len(stack) - 1, 0, -1):
                own = elements[stack[depth]].name
                if own == name:
                    pop(depth)
                    break
                if own in SCOPES and name in INLINE | {"p", "li"}:
                    break
            else:
                block += name not in INLINE
            continue
        if name in CLOSES_P or name in SIBLINGS:
            ends = SIBLINGS.get(name, set()) | ({"p"} if name in CLOSES_P else set())
            for depth in range(len(stack) - 1, 0, -1) if any(opened[x] for x in ends) else ():
                own = elements[stack[depth]].name
                if own in ends:
                    pop(depth)
                    break
                if own in SCOPES:
                    break
        if name == "br":
            nodes.append(Node(" ", stack[-1], block))
            continue
        if name not in INLINE:
            block += 1
        if name in VOID or attributes.rstrip().endswith("/") and name not in CLOSES_P:
            continue
        up = elements[stack[-1]]
        noise, named, doubt = _is_noise(name, attributes, inside_article > 0)
        path = paths.setdefault((up.path, name), len(paths) + 1)
        elements.append(Element(name, stack[-1], up.noise or noise, path, doubt, named, up.heading or name in HEADINGS, inside_article > 0))
        if name in RAW:
            closed = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(page, at)
            at = closed.end() if closed else len(page)
            block += 1
            continue
        stack.append(len(elements) - 1)
        opened[name] += 1
        scopes += name in SCOPES
        inside_article += name in ("article", "main")
    text(page[at:])
    _settle(elements, nodes)
    return elements, nodes


def _settle(elements: list[Element], nodes: list[Node]) -> None:
    """Decides of elements that are named as no text, by what they hold; passes noise and doubt on to what lies in them."""
    size, holds = [0] * len(elements), [False] * len(elements)
    for n in nodes:
        if not elements[n.element].noise:
            size[n.element] += len(n.text.strip())
    for i in range(len(elements) - 1, 0, -1):  # children come after their parents
        e = elements[i]
        size[e.parent] += size[i]
        holds[e.parent] |= not e.noise and (holds[i] or e.name in ("article", "main"))
    around = [size[0]] * len(elements)  # the text of the article that an element lies in, or of the page
    for i in range(1, len(elements)):
        e, up = elements[i], elements[i].parent
        around[i] = size[i] if e.name in ("article", "main") and not e.inside else around[up]
        if e.named:
            kept = holds[i] or size[i] > HALF * around[i]
            e.noise |= not kept
            e.doubt |= kept and not holds[i]
        e.noise |= elements[up].noise
        e.doubt |= elements[up].doubt


def content_nodes(elements: list[Element], nodes: list[Node]) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are content by the smoothed, fused ratios of their tag paths: without those in doubt by their names, and those in doubt."""
    sums: dict[int, list[float]] = defaultdict(lambda: [0.0, 0.0, 0.0])
    real = [bool(n.text.strip()) and not elements[n.element].noise for n in nodes]
    for n, ok in zip(nodes, real, strict=True):
        if ok:
            s = sums[elements[n.element].path]
            s[0] += len(n.text)
            s[1] += len(_MARKS.findall(n.text))
            s[2] += 1
    ratio = {p: (a / c, b / c) for p, (a, b, c) in sums.items()}
    rows = [ratio[elements[n.element].path] if ok else (0.0, 0.0) for n, ok in zip(nodes, real, strict=True)]
    at = np.flatnonzero(real)
    if not len(at):
        return np.zeros(len(nodes), dtype=bool), np.zeros(len(nodes), dtype=bool)
    both = np.array(rows)[at]
    weights = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / (2 * SIGMA**2))
    weights /= weights.sum()
    smooth = np.column_stack([np.convolve(np.pad(both[:, k], REACH, mode="edge"), weights, mode="valid") for k in (0, 1)])
    fused = smooth[:, 0] * (1 + smooth[:, 1])
    out = np.zeros(len(nodes), dtype=bool)
    out[at] = fused >= LEVEL * fused.std()
    doubt = np.array([elements[n.element].doubt for n in nodes], dtype=bool)
    return out & ~doubt, out & doubt


def article(elements: list[Element], nodes: list[Node], content: np.ndarray) -> int:
    """The outermost article or main around HELD of the selected text; else the smallest element that holds all of it and the headings before it."""
    weight, count = [0] * len(elements), [0] * len(elements)
    total = needed = 0
    first = int(content.argmax())
    for i, (n, ok) in enumerate(zip(nodes, content, strict=True)):
        e = elements[n.element]
        if ok or i < first and n.text.strip() and not e.noise and e.heading:
            size = len(n.text.strip()) if ok else 0
            total += size
            needed += 1
            weight[n.element] += size
            count[n.element] += 1
    for i in range(len(elements) - 1, 0, -1):  # children come after their parents
        weight[elements[i].parent] += weight[i]
        count[elements[i].parent] += count[i]
    at, found = max((i for i, w in enumerate(weight) if w >= HELD * total), default=0), -1
    while at >= 0:
        found, at = at if elements[at].name in ("article", "main") else found, elements[at].parent
    if found >= 0:
        return found
    best = max((i for i, k in enumerate(count) if k == needed), default=0)
    while elements[best].name in INLINE | HEADINGS | {"p", "li", "blockquote", "pre", "dd", "td"} and elements[best].parent >= 0:
        best = elements[best].parent
    return best


def main_text(page: str | None) -> str:
    if not page:
        return ""
    elements, nodes = parse(page)
    content, doubted = content_nodes(elements, nodes)
    if not content.any():
        content = doubted
    if not content.any():
        return ""
    root = article(elements, nodes, content)
    inside = [False] * len(elements)
    inside[root] = True
    for i in range(root + 1, len(elements)):
        inside[i] = inside[elements[i].parent]
    blocks: dict[int, list[str]] = {}
    for n, told in zip(nodes, doubted, strict=True):
        if inside[n.element] and not elements[n.element].noise and (told or not elements[n.element].doubt):
            blocks.setdefault(n.block, []).append(n.text)
    lines = (_SPACE.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in lines if x)


@K.udf("struct<text: string, n_chars: long>")
def _extract(pages: pa.Array) -> pa.Array:
    texts = [main_text(x) for x in pages.to_pylist()]
    return pa.StructArray.from_arrays([K.strings(texts), pa.array([len(x) for x in texts], pa.int64())], ["text", "n_chars"])


def extract(df: DataFrame, page: str = "html", name: str = "main") -> DataFrame:
    """df with a struct: text, n_chars (code points)."""
    return df.withColumn(name, _extract(F.col(page)))
