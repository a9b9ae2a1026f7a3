"""Main text of web pages by the line-block distribution (operator 3).

The markup is stripped to lines: each block element (heading, paragraph, list item, cell ...) is a
line with its text. A line weighs as much as it is long, up to CAP characters, less twice what is links;
headings weigh HEADING times that. Markup only weighs: a line in an article or main element weighs ARTICLE times
its length and OWN more, and the lines inside and outside of articles weigh by the share of the page's text that stands
there. Lines in a part that is no main text (menus, headers, footers, sidebars, notices, adverts, forms,
reader comments) weigh PART of what they would. A part is told by its element, role or class; a class or id counts only if all its words are such
words or say no more than what kind of box it is, and where the page would have no text without it, or all its articles
lie within it, it counts for nothing.

Weights are summed over a sliding window, of a line and those after it. The text surges at a line where the window's
sum reaches the threshold and the line carries its share of it, RISE of the window's mean: so a short line
before the text, such as an advert before a headline, is no start. It dives where the window's sum
falls below DIVE of the threshold, and where an article starts or ends. The threshold is SURGE, or half of the largest
sum on a page that has less. What lies between surge and dive is main text; of lines in a part only those that carry RISE of
the mean of the page's heaviest window, parts weighed in full. So are short and link-rich lines in the same container (all articles of a page are
one; otherwise the nearest div, section, list, table cell and the like), and those between two kept lines of one container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Lines that a window sums, characters at which text surges, and the share of a window's mean that a first line carries.
WINDOW, SURGE, RISE = 3, 86, 0.5
#: The share of the threshold at which text dives, and of its weight that a line in a part has.
DIVE, PART = 0.1, 0.02
#: Characters of a line that weigh, the weight of headings, and of lines in articles: by their length, and besides. With
#: OWN = RISE / (1 - RISE) * ARTICLE * CAP every line of an article can be a first one.
CAP, HEADING, ARTICLE = 300, 6, 8
OWN = RISE / (1 - RISE) * ARTICLE * CAP

#: Elements whose content is no text, whole (fixed values).
_SILENT = ("script", "style", "noscript", "template", "svg", "math", "iframe", "object", "canvas", "select", "textarea", "button", "title", "head")
#: Elements that end a line (fixed values).
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements, roles and words of class or id that mark what is never main text (fixed values).
_PART = frozenset("nav header footer aside form menu dialog".split())
_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_NAMED = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent gdpr notice notices popup modal newsletter subscribe signup login comments comment disqus respond replies reply related share sharing social widget toolbar pagination pager skip legal copyright".split()
)
#: Words that say only what kind of box, or where, an element is (fixed values).
_BOX = frozenset(
    "area article bar block body bottom box btn button center col column container content desktop element entry fixed footer form global group head header icon id inline inner item js layout left link links list lists main mobile module outer overlay page panel post primary region right row secondary section site slot spot static sticky story tablet text title top unit widget wrap wrapper zone".split()
)
#: Those of the words that also stand in names of what encloses main text, as in page-sidebar-left, and words that make a name no part's (fixed values).
_LAYOUT = frozenset("nav navbar navigation menu sidebar aside footer header masthead notice popup modal related share sharing social widget toolbar".split())
_ABOUT = frozenset("has with without no not is".split())
#: Words that name a headline where they stand in an article (fixed values).
_HEADLINE = frozenset("header masthead".split())
#: Class or id words that name the main text, and elements without an end tag (fixed values).
_MAIN = frozenset("article main".split())
_HEADS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold lines together (fixed values).
_HOLDS = frozenset("aside dd details dialog dir div dl fieldset footer form header menu nav ol section table td th ul".split())
#: An open paragraph ends where one of these starts (fixed values).
_ENDS_P = _BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?([A-Za-z][^\s/>]*)([^>]*)>", re.S)
_SKIP = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in _SILENT}
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_SPACE = re.compile(r"\s+")


def _part(tag: str, attributes: str, in_article: bool) -> str | None:
    """What part an element is that is no main text: hidden, certain, named (by class or id), likely (its name is as much one of layout) or None.

    A header in an article is its headline.
    """
    kind = None
    if tag in _PART and not (tag == "header" and in_article):
        kind = "likely" if tag == "form" else "certain"
    if attributes and not attributes.isspace():
        for name, *values in _ATTR.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return "hidden"
            if name == "role" and value in _ROLE:
                kind = kind or ("likely" if value == "form" else "certain")
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                for one in value.split():
                    words = _WORD.findall(one)
                    named = _NAMED.intersection(words) - (_HEADLINE if in_article else set())
                    if named and words[0] not in _ABOUT and all(w in _NAMED or w in _BOX for w in words):
                        sure = not named <= _LAYOUT or named.issuperset(words) and value.strip() == one
                        kind = kind if kind == "certain" else "named" if sure else kind or "likely"
    return kind


def lines_of(page: str) -> list[tuple[str, bool, bool, int, int, bool]]:
    """(text, in an article, never main text, characters in links, container, heading) of the lines of a page, in order.

    Containers are numbered from 1; 0 is the page itself.
    """
    out: list[tuple[str, int, tuple[int, ...], int, int, bool]] = []
    stack: list[tuple[str, int, tuple[int, ...], int]] = []  # tag, article, parts, container
    kinds: list[tuple[str, int]] = []  # of parts: kind, and the article they lie in
    around: list[tuple[int, ...]] = [()]  # of articles: the parts they lie in
    line: list[str] = []
    links = depth_a = at = container = containers = article = 0
    parts: tuple[int, ...] = ()

    def end_line() -> None:
        nonlocal links
        if line:
            text = _SPACE.sub(" ", html.unescape("".join(line))).strip()
            if text:
                out.append((text, article, parts, links, container, any(x[0] in _HEADS for x in stack[-2:])))
            line.clear()
        links = 0

    def close(tag: str) -> None:
        nonlocal article, parts, container
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == tag:
                del stack[k:]
                article, parts, container = stack[-1][1:] if stack else (0, (), 0)
                return

    while True:
        m = _TOKEN.search(page, at)
        piece = page[at : m.start()] if m else page[at:]
        if piece:
            line.append(piece)
            links += len(piece) if depth_a else 0
        if not m:
            break
        at = m.end()
        tag, attributes = (m[1] or m[3] or "").lower(), m[2] or m[4] or ""  # the latter where a quote is not closed
        if not tag:
            if m[0].startswith("<![CDATA["):
                line.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[0][1] == "/":
            if tag in _BLOCK:
                end_line()
                close(tag)
            elif tag == "a":
                depth_a = max(0, depth_a - 1)
            continue
        if tag in _SKIP:
            if tag != "head" and not attributes.rstrip().endswith("/"):
                e = _SKIP[tag].search(page, at)
                at = e.end() if e else len(page)
            elif tag == "head":
                e = _SKIP[tag].search(page, at)
                at = e.end() if e else at
            line.append(" ")
        elif tag == "br":
            line.append(" ")
        elif tag in _BLOCK:
            end_line()
            if tag in _ENDS_P and any(s[0] == "p" for s in stack):
                close("p")
            if tag == "li" and stack and stack[-1][0] == "li":
                close("li")
            if tag not in _VOID and not attributes.rstrip().endswith("/"):
                if kind := _part(tag, attributes, article > 0):
                    kinds.append((kind, article))
                    parts = (*parts, len(kinds) - 1)
                if not article and (tag in _MAIN or 'role="main"' in attributes):
                    around.append(parts)
                    article = len(around) - 1
                if tag in _HOLDS:
                    container = containers = containers + 1
                stack.append((tag, article, parts, container))
        elif tag == "a":
            depth_a += 1
    end_line()
    off = _off(out, kinds, around)
    hidden = {p for p, (kind, _) in enumerate(kinds) if kind == "hidden"}
    out = [x for x in out if hidden.isdisjoint(x[2])]
    return [(text, a > 0, not off.isdisjoint(ps), n, c, head) for text, a, ps, n, c, head in out]


def _off(lines: list[tuple[str, int, tuple[int, ...], int, int, bool]], kinds: list[tuple[str, int]], around: list[tuple[int, ...]]) -> set[int]:
    """The parts that are no main text, by where the page's text is."""
    articles = {a for _, a, *_ in lines if a}
    surely = {p for p, (kind, _) in enumerate(kinds) if kind != "likely"}
    mass: dict[tuple[int, int], int] = {}  # of characters outside links, by part or -1, and article
    for text, a, ps, n, *_ in lines:
        if surely.isdisjoint(ps):
            for p in (-1, *ps):
                mass[p, a] = mass.get((p, a), 0) + max(0, len(text) - n)
    off = set()
    for p, (kind, inside) in enumerate(kinds):
        whole = bool(articles) and all(p in around[a] for a in articles)
        most = kind == "likely" and (inside or not articles) and 2 * mass.get((p, inside), 0) > mass.get((-1, inside), 0)
        if kind == "hidden" or not (whole or most):
            off.add(p)
    # where classes and ids leave the page no text, the one with the most text in it counts for nothing
    if lines and all(not off.isdisjoint(ps) for _, _, ps, *_ in lines):
        inside: dict[int, int] = {}
        for text, _, ps, *_ in lines:
            gone = [p for p in ps if p in off]
            if all(kinds[p][0] in ("named", "likely") for p in gone):
                inside[gone[0]] = inside.get(gone[0], 0) + len(text)
        if inside:
            off.discard(max(inside, key=lambda p: (inside[p], -p)))
    return off


def weights(lines: list[tuple[str, bool, bool, int, int, bool]]) -> list[float]:
    """What each line weighs, whatever part it is in."""
    plain = [len(text) if i else max(0, len(text) - 2 * links) for text, i, _, links, *_ in lines]
    marked, total = sum(n for n, (_, i, *_) in zip(plain, lines, strict=True) if i), max(1, sum(plain))
    out = []
    for n, (_, i, _, _, _, head) in zip(plain, lines, strict=True):
        w = min(n, CAP) * (1 if i or not head else HEADING)
        out.append(0.0 if not n else (ARTICLE * w + OWN) * marked / total if i else w * (total - marked) / total)
    return out


def between(sums: list[float], heavy: list[float], inside: list[bool], window: int, surge: float, rise: float) -> list[bool]:
    """The lines from each surge up to the next dive."""
    least = min(surge, max(sums, default=0) / 2)
    out, within = [], False
    for k, (w, total) in enumerate(zip(heavy, sums, strict=True)):
        goes_on = within and inside[k] == inside[k - 1] and total >= DIVE * least
        starts = w > 0 and total >= least and w >= rise * total / min(window, len(heavy) - k)
        within = total > 0 and (goes_on or starts)
        out.append(within)
    return out


def main_text(page: str | None, window: int = WINDOW, surge: float = SURGE, rise: float = RISE) -> str:
    """The kept blocks of a page, joined by two line feeds."""
    lines = lines_of(page) if page else []
    off, inside = [x[2] for x in lines], [x[1] for x in lines]
    own = [-1 if i else c for _, i, _, _, c, _ in lines]  # container
    whole = weights(lines)
    heavy = [w * PART if o else w for w, o in zip(whole, off, strict=True)]
    sums = [sum(heavy[k : k + window]) for k in range(len(heavy))]
    peak = max((sum(whole[k : k + window]) for k in range(len(whole))), default=0) / window
    main = [m and w > 0 and (not o or w >= rise * peak) for m, w, o in zip(between(sums, heavy, inside, window, surge, rise), heavy, off, strict=True)]
    near = {c for c, m, o in zip(own, main, off, strict=True) if m and not o}
    keep = [m or c in near and not o for m, c, o in zip(main, own, off, strict=True)]
    last = -1
    for k in [k for k, kept in enumerate(keep) if kept]:
        if last >= 0 and own[k] == own[last] > 0:
            keep[last + 1 : k] = [kept or not o for kept, o in zip(keep[last + 1 : k], off[last + 1 : k], strict=True)]
        last = k
    return "\n\n".join(text for (text, *_), kept in zip(lines, keep, strict=True) if kept)


def extract(pages: DataFrame, column: str = "html", window: int = WINDOW, surge: float = SURGE, rise: float = RISE) -> DataFrame:
    """Every row of pages with text (empty where there is none) and n_chars, its code points.

    A null or empty page gives an empty text. Broken markup is read as far as it goes: what is not
    closed reaches to the end of its parent. Columns of pages that are named text or n_chars are
    replaced, others stay; repeated rows give repeated results.
    """
    keep = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, window, surge, rise) for p in batch.column(column).to_pylist()]
            yield pa.record_batch([*(batch.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return pages.select(*keep, column).mapInArrow(run, schema)
