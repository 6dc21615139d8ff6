"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text blocks, each with the path of block elements from the root to it.

1. *Ratios.*  For every path the text length outside of links and the punctuation of its blocks are summed and divided by their number.
2. *Fuse and smooth.*  Both ratios, each over its largest value, are fused by their geometric mean, and smoothed along the sequence of blocks; a path's
   score is the geometric mean of its own ratio and its blocks' mean smoothed ratio.
3. *Threshold.*  Content are the blocks of the paths whose score reaches ``threshold`` standard deviations of all paths' scores (or the largest
   score, if none does).
4. *Gaps.*  Short blocks whose paths stay below belong to the text where content surrounds them: blocks between two blocks of content, headings right
   before one, and list items, cells or code right after one under a common element below the body.  Two blocks of links in a row are a
   menu and never fill a gap; a single one does, also right after content in the same ``article`` or ``main``.

Menus, footers, sidebars, buttons, scripts, styles and hidden parts that their element says to be so take no part.  Forms, headers, and what
role, class or id call a menu, notice, advert, reader comment and the like are marked.  Names only lower a path: a marked part is a path of its
own, its ratio counts a twentieth, and it fills no gap.  On paragraphs, headings, list items and cells only the names of adverts, consent
and the like count.  A mark falls if its element is around the page's ``main`` or, with no unmarked ``article`` or ``main`` on the page, holds
most of the content's text (in an unmarked one, most of that one's); blocks of links do not count.  Adverts, consent and the like count
only with a ``main``, ``article`` or ``h1`` in them, reader comments and related pages only with a ``main`` or ``h1``, unless the page
has nothing else.  A marked inline element is dropped, unless a block begins in it: then it is a wrapper like others.

Within a block white space becomes one space (a line break element too); inline elements, dropped ones too, do not split a block.  Character
references are decoded in each stretch of text between tags, so none is put together across them.

Nulls: a null page has no text.  Malformed mark-up: unclosed elements close with their parents, a stray end is ignored, a ``<`` that opens no tag is
text.  Very long and very deep pages are read whole, in time linear in their length; paths are numbers with a link to their parent.  Repeated
rows are kept; extra columns are ignored by name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from turfline.llm import by_value

by_value(__name__)

#: Standard deviations of the paths' scores that a path must reach.
THRESHOLD = 0.8
#: What is left of the ratio of a marked path.
MARKED = 0.05
_KERNEL = (0.25, 0.5, 0.25)
_RAW = "script|style|title|textarea|iframe|noscript|xmp|template|noembed|noframes"
_TOKEN = re.compile(
    rf"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?:{_RAW})(?=[\s/>])(?P<raw>[^>]*)>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S | re.I)
_RAW_NAME = re.compile(r"<([a-zA-Z]+)")
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside button select option input menu dialog head svg math object audio video canvas figure-controls".split())
_FOREIGN = frozenset(("svg", "math"))  # the only elements that a slash closes at once
_PHRASING = frozenset("svg math audio video canvas object button select".split())  # dropped, but part of the line around them
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_ALIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}
_FRAME = frozenset(("html", "body", "main", "article"))
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored nav navbar navigation menu menubar footer sidebar aside "
    "cookie cookies consent gdpr notice notices alert disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "comment comments commentlist disqus replies respond reply discussion related recommended recommendations breadcrumb breadcrumbs pagination pager "
    "widget toolbar search masthead copyright skip skiplink form tags".split())
_STEMS = ("advert", "sidebar", "cookie", "comment", "newsletter", "breadcrumb", "pagination", "navbar", "sponsor", "popup", "footer")
#: Names of text of another kind than the page's own, and of such text that may be in articles itself.
_OTHER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr disclaimer popup newsletter "
    "subscribe subscription signup breadcrumb breadcrumbs pagination pager copyright".split())
_OTHER_STEMS = ("advert", "cookie", "newsletter", "breadcrumb", "pagination", "sponsor", "popup")
_READERS = frozenset("comment comments commentlist disqus replies respond reply discussion related recommended recommendations".split())
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li dt dd td th pre blockquote caption figcaption".split())
_DROP, _LAYOUT, _APART, _READER = 1, 2, 3, 4
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？¿¡]")


def _mark(name: str, attrs: str, in_article: bool) -> int:
    """0, _DROP for what is never content, or the kind of a mark."""
    if name in _FRAME:
        return 0
    if name in _DROPPED:
        return _DROP
    kind = _LAYOUT if name == "form" or name == "header" and not in_article else 0
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return kind
    said = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if said.get("aria-hidden", "").lower() == "true" or "display:none" in said.get("style", "").replace(" ", "").lower():
        return _DROP
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)):
        return _DROP
    if said.get("role", "").lower() in _ROLES:
        kind = _LAYOUT
    own = f"{said.get('class', '')} {said.get('id', '')}"
    words = {w.lower() for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", own)}
    if name in _TEXT:
        return _APART if words & _OTHER or any(stem in w for w in words for stem in _OTHER_STEMS) else 0
    if words & _READERS or any("comment" in w for w in words):
        return _READER
    if words & _OTHER or any(stem in w for w in words for stem in _OTHER_STEMS):
        return _APART
    if "header" in words and not in_article and not words & {"article", "entry", "post", "content"}:
        return _LAYOUT
    return _LAYOUT if words & _NAMES or any(stem in w for w in words for stem in _STEMS) else kind


class _Page:
    """Blocks of a page and its elements, each with a link to the one around it; an element's number is larger than its parent's."""

    def __init__(self, source: str):
        self.texts: list[str] = []  # of each block: its text, path and innermost element, and whether it has text outside of links
        self.paths: list[int] = []
        self.inner: list[int] = []
        self.plain: list[int] = []
        self.names, self.parents = ["#root"], [0]
        self.numbers: dict[tuple[int, str], int] = {}  # of paths
        self.marks: dict[int, int] = {}  # kind of mark by element
        self.stack: list[tuple[str, int, bool, int, int, bool]] = [("#root", 0, False, 0, 0, False)]  # name, element, dropped, own mark, path, in an article
        self.open: Counter[str] = Counter()
        self.first_dropped = 0  # place of the outermost dropped element on the stack, or 0
        self.parts: list[str] = []
        self.outside = 0
        self.in_link = self.wrapped = False
        at = 0
        while True:
            found = _TOKEN.search(source, at)
            text = source[at:found.start() if found else len(source)]
            if text and not self.first_dropped:
                text = html.unescape(text)
                self.parts.append(text)
                if not self.in_link:
                    self.outside += len(text.strip())
            if found is None:
                break
            at = found.end()
            if found["raw"] is not None:
                at = self._raw(source, found)
            elif found["name"]:
                self._tag(found["name"].lower(), bool(found["end"]), found["attrs"])
        self._flush()

    def _raw(self, source: str, found: re.Match) -> int:
        """The end of an element whose content is no mark-up and no text of the page."""
        name = _RAW_NAME.match(found[0])[1]
        if found["raw"].endswith("/"):
            return found.end()
        end = re.compile(rf"</{name}\s*[^>]*>", re.I).search(source, found.end())
        return end.end() if end else len(source)

    def _tag(self, name: str, ends: bool, attrs: str) -> None:
        if name == "br":
            self.parts.append(" ")
            return
        dropped = self.first_dropped > 0
        if name == "a":
            self.in_link = not ends and "href" in attrs.lower()
        if name in _INLINE or name in _PHRASING:
            if ends:
                self._close_dropped(name)
            elif name not in _VOID and not (name in _FOREIGN and attrs.endswith("/")):
                own = _DROP if name in _PHRASING else _mark(name, attrs, True) if "=" in attrs else 0
                if dropped or own:
                    self._push(name, True, own)
                elif self.wrapped and self.open[name]:
                    self._push(name, False, 0)
            return
        if not dropped:
            self._flush()
        elif not ends:
            self._wrap()
        if ends:
            self._close(name)
            return
        if name in _CLOSES_P:
            self._close_open(("p",), {"button", "table", "td", "th", "li", "div", "section", "article", "blockquote"})
        if name in _ALIKE:
            self._close_open(_ALIKE[name], _SCOPES[name])
        if name not in _VOID:
            own = _mark(name, attrs, self.stack[-1][5])
            bad = self.first_dropped > 0 or own == _DROP
            self._push(name, bad, own)
            if own and not bad:
                self.marks[self.stack[-1][1]] = own

    def _push(self, name: str, bad: bool, own: int) -> None:
        _, parent, _, _, path, in_article = self.stack[-1]
        if name not in _INLINE:
            path = self.numbers.setdefault((path, name), len(self.numbers) + 1)
        self.names.append(name)
        self.parents.append(parent)
        if bad and not self.first_dropped:
            self.first_dropped = len(self.stack)
        self.stack.append((name, len(self.names) - 1, bad, own, path, in_article or name in ("article", "main")))
        self.open[name] += 1

    def _wrap(self) -> None:
        """A block begins in inline elements that are dropped for their names only: they are wrappers, and keep their marks."""
        if any(s[0] not in _INLINE or s[3] == _DROP for s in self.stack[self.first_dropped:]):
            return
        for i in range(self.first_dropped, len(self.stack)):
            name, element, _, own, path, in_article = self.stack[i]
            self.stack[i] = (name, element, False, own, path, in_article)
            if own:
                self.marks[element] = own
        self._flush(self.stack[self.first_dropped - 1])
        self.first_dropped, self.wrapped = 0, True

    def _pop(self, i: int) -> None:
        for entry in self.stack[i:]:
            self.open[entry[0]] -= 1
        del self.stack[i:]
        if self.first_dropped >= i:
            self.first_dropped = 0

    def _cut(self, i: int) -> None:
        """Close the element at place i and all in it; the text before a dropped inline element ends with its block."""
        if not self.stack[i][2]:
            self._flush()
        self._pop(i)

    def _close_dropped(self, name: str) -> None:
        """Close the innermost inline element of this name, if it is dropped or in a wrapper of its name; others are not on the stack."""
        if not self.open[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if not self.stack[i][2] and not self.wrapped:
                return
            if self.stack[i][0] == name:
                if self.stack[i][1] in self.marks or i < len(self.stack) - 1 and not self.stack[-1][2]:
                    self._flush()
                self._pop(i)
                return

    def _close(self, name: str) -> None:
        if not self.open[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == name:
                self._cut(i)
                return
            if name == "p" and self.stack[i][0] in ("div", "article", "section", "body", "td"):
                return

    def _close_open(self, names, scope: set[str]) -> None:
        if not any(self.open[n] for n in names):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] in names:
                self._cut(i)
                return
            if self.stack[i][0] in scope:
                return

    def _flush(self, entry: tuple | None = None) -> None:
        """End the current block; it lies in the innermost element that is not dropped."""
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                inner = entry or self.stack[(self.first_dropped or len(self.stack)) - 1]
                self.texts.append(text)
                self.paths.append(inner[4])
                self.inner.append(inner[1])
                self.plain.append(min(self.outside, len(text)))
            self.parts, self.outside = [], 0

    def below(self, start, step) -> list:
        """A value for every element from that of its parent: ``step(value, element)``."""
        values = [start] * len(self.names)
        for e in range(1, len(values)):
            values[e] = step(values[self.parents[e]], e)
        return values

    def above(self, values: list[int]) -> list[int]:
        """Sums over each element and all in it."""
        for e in range(len(values) - 1, 0, -1):
            values[self.parents[e]] += values[e]
        return values

    def standing(self, fallen: set[int]) -> list[bool]:
        return self.below(False, lambda over, e: over or e in self.marks and e not in fallen)


def scores(page: _Page, scope: list[int], marked: list[bool]) -> dict[tuple[int, bool], float]:
    """The score of every (path, marked) of the blocks in ``scope``."""
    if not scope:
        return {}
    keys = [(page.paths[i], marked[page.inner[i]]) for i in scope]
    sums: dict[tuple[int, bool], list[float]] = {}
    for i, key in zip(scope, keys):
        own = sums.setdefault(key, [0.0, 0.0, 0.0])
        own[0] += page.plain[i]
        own[1] += len(_PUNCTUATION.findall(page.texts[i])) if page.plain[i] else 0
        own[2] += 1
    free = [x for key, x in sums.items() if not key[1]] or list(sums.values())
    most = [max(x[k] / x[2] for x in free) for k in (0, 1)]

    def ratio(key: tuple[int, bool]) -> float:
        length, points = (min(1.0, sums[key][k] / sums[key][2] / most[k]) if most[k] else 1.0 for k in (0, 1))
        return math.sqrt(length * points) * (MARKED if key[1] else 1.0)

    ratios = {key: ratio(key) for key in sums}
    row = [ratios[key] for key in keys]
    padded = [row[0], *row, row[-1]]
    smooth: dict[tuple[int, bool], float] = {}
    for n, key in enumerate(keys):
        smooth[key] = smooth.get(key, 0.0) + sum(w * x for w, x in zip(_KERNEL, padded[n:n + 3]))
    return {key: math.sqrt(ratios[key] * smooth[key] / sums[key][2]) for key in sums}


def content(page: _Page, scope: list[int], marked: list[bool], threshold: float) -> list[int]:
    """The blocks of ``scope`` whose paths reach the threshold."""
    found = scores(page, scope, marked)
    if not found:
        return []
    mean = sum(found.values()) / len(found)
    spread = math.sqrt(sum((x - mean) ** 2 for x in found.values()) / len(found))
    least = min(threshold * spread, max(found.values()))
    return [i for i in scope if found[page.paths[i], marked[page.inner[i]]] >= least]


def _fallen(page: _Page, threshold: float) -> set[int]:
    """The marked elements whose marks fall."""
    marks, fallen, size = page.marks, set(), len(page.names)
    bit = {"main": 1, "article": 1 << 20, "h1": 1 << 40}
    inside = page.above([bit.get(n, 0) for n in page.names])
    holds = lambda e, *names: any(inside[e] // bit[n] % (1 << 20) for n in names)
    apart = {e for e, kind in marks.items() if kind == _READER and not holds(e, "main", "h1") or kind == _APART and not holds(e, "main", "h1", "article")}
    in_apart = page.below(False, lambda over, e: over or e in apart)
    own = [0] * size
    for e in page.inner:
        own[e] += 1
    filled = page.above(own)
    frames = [e for e in range(size) if page.names[e] in ("article", "main") and filled[e]]
    unmarked = [False] * size

    def held(scope: list[int]) -> list[int]:
        """The marked elements that hold most of the content of these blocks, outer ones first."""
        scope = [i for i in scope if page.plain[i]]
        scope = [i for i in scope if not in_apart[page.inner[i]]] or scope
        sizes = [0] * size
        for i in content(page, scope, unmarked, threshold):
            sizes[page.inner[i]] += len(page.texts[i])
        sizes = page.above(sizes)
        return [e for e in sorted(marks) if sizes[e] * 2 > sizes[0]]

    free = page.standing(fallen)
    if all(free[f] for f in frames):
        for f in frames:
            if page.names[f] == "main" and not in_apart[f]:
                e = f
                while e and e not in fallen:
                    if e in marks:
                        fallen.add(e)
                    e = page.parents[e]
        free = page.standing(fallen)
    if all(free[f] for f in frames):
        chain = held(list(range(len(page.texts))))
        place = {e: k for k, e in enumerate(chain)}
        # how far the chain must fall until nothing stands around an element
        need = page.below(-1, lambda over, e: over if e not in marks or e in fallen else max(over, place.get(e, len(chain))))
        least = min((need[f] for f in frames), default=len(chain))
        fallen.update(chain[:least + 1])
        free = page.standing(fallen)
    opened = {f for f in frames if not free[f]}
    if opened:
        within = page.below(False, lambda over, e: over or e in opened)
        fallen.update(held([i for i, e in enumerate(page.inner) if within[e]]))
    return fallen


def _kept(page: _Page, chosen: list[int], marked: list[bool]) -> list[int]:
    """``chosen`` and the blocks that fill its gaps."""
    n = len(page.texts)
    keep = [False] * n
    for i in chosen:
        keep[i] = True
    links = [not p for p in page.plain]
    menu = [links[i] and (i > 0 and links[i - 1] or i + 1 < n and links[i + 1]) for i in range(n)]
    may = [not marked[page.inner[i]] and not menu[i] for i in range(n)]
    frame = page.below(0, lambda over, e: e if page.names[e] in ("article", "main") else over)
    level = page.below(0, lambda over, _: over + 1)
    body = max((level[e] for e in range(len(level)) if page.names[e] in ("html", "body") and level[e] < 3), default=0)
    names = [page.names[e] for e in page.inner]

    def joined(i: int, k: int) -> bool:
        """Whether an element below the body holds both blocks."""
        a, b = page.inner[i], page.inner[k]
        while a != b:
            if level[a] >= level[b]:
                a = page.parents[a]
            else:
                b = page.parents[b]
            if level[a] <= body or level[b] <= body:
                return False
        return level[a] > body

    for i in range(chosen[0], chosen[-1]):
        keep[i] |= may[i]
    for i in range(n - 2, -1, -1):
        keep[i] |= keep[i + 1] and may[i] and names[i] in _HEADINGS and frame[page.inner[i]] == frame[page.inner[i + 1]]
    for i in range(chosen[-1] + 1, n):
        if not may[i] or not keep[i - 1]:
            break
        if links[i]:
            keep[i] = frame[page.inner[i]] > 0 and frame[page.inner[i]] == frame[page.inner[i - 1]]
        else:
            keep[i] = names[i] in _ITEMS and joined(i, i - 1)
    return [i for i in range(n) if keep[i]]


def main_text(source: str | None, threshold: float = THRESHOLD) -> str:
    """The main text of a page: its blocks joined by an empty line."""
    page = _Page(source or "")
    if not page.texts:
        return ""
    marked = page.standing(_fallen(page, threshold)) if page.marks else [False] * len(page.names)
    chosen = content(page, list(range(len(page.texts))), marked, threshold)
    return "\n\n".join(page.texts[i] for i in _kept(page, chosen, marked))


def extract(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, threshold) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             ["page_id", "url", "text", "n_chars"])
    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
