"""Main text of web pages by composite text density.

A page becomes a tree. Elements that hold no article text by their kind (menus, forms, scripts, ...) or by the head word of
a class, id or role (advert, sidebar, comments, ...; ``with-sidebar`` or ``social-policy`` say something else) are left out, but no
form, header or named element goes that holds most of the page's text outside links while no article or main element
has text beside it. Reader comments go whatever their share, unless nothing else is left.

For every other element the density is characters per tag, adjusted by how much of both lies in links; an element's sum is
that of its children's densities. The densest element and its ancestors up to the body give the threshold, their least
density; of the elements that reach it, the one with the largest sum is the main subtree. From there the way to the body
is followed, since a long text may be dealt over several subtrees: what stands beside the main subtree is taken too if it is a
paragraph, list or the like next to it, a heading before it, or a subtree over the threshold with at least a quarter of
its sum. Tags decide only what density leaves open: the way ends at an article or main element, and all of that article is
taken. Menus by content (lists and boxes of links only) at either end of what was taken go. The text is given block by block,
with nothing else dropped.

Cases: a null or empty page, or one without text, gives an empty text; a page without tags is one block; tags that are
never closed, or closed without being open, and pages cut off in the middle are read as far as they go, in time linear in the
page; repeated rows and ids each keep their row; an empty table gives an empty result; other columns of the input,
whatever their names, are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements without text of their own; that never hold article text; whose content isn't markup; that have no content; that start a new block.
SILENT = frozenset("script style noscript template iframe svg canvas object button select textarea input label head title audio video map".split())
DROPPED = frozenset("nav footer aside dialog menu".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body address article aside blockquote dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody thead tfoot tr caption ul hgroup center".split())
#: Head words of a class, id or role that mark what isn't the article; those of reader comments.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner sidebar menu nav navigation navbar breadcrumb breadcrumbs footer header "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login form share sharing social related recommended pagination "
    "pager toolbar widget widgets masthead topbar copyright disclaimer skip hidden contentinfo complementary search".split()
)
COMMENTS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: Parts that say where or how a thing stands, not what it is; first parts after which a name says something about another thing.
PLACES = frozenset("left right top bottom inner outer wrapper wrap container box block area list item items link links button buttons bar slot unit group posts articles thread section content body main primary secondary".split())
ABOUT = frozenset("with has have no not is without hide show".split())
#: First parts of headers that are the article's own.
OWN_HEADER = frozenset("article entry post story content section chapter title hentry".split())
MAINS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
FLOW = HEADINGS | frozenset("p pre blockquote ul ol dl table figure details".split())
#: A start tag of these ends an open element of those.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("table ul ol dl body html article section div main".split())
#: Share of the main subtree's sum that another subtree needs; characters of a link in a menu at most.
BESIDE, LINK = 0.25, 60
#: Why an element is left out: it has no text; its kind or name; it holds comments.
KEPT, MUTE, NAMED, COMMENT = 0, 1, 2, 3

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_NAME = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("chars", "children", "density", "drop", "link_chars", "link_tags", "parent", "plain", "tag", "tags", "total")

    def __init__(self, tag: str, parent: Element | None, drop: int):
        self.tag, self.parent, self.drop, self.children = tag, parent, drop, []
        self.chars = self.tags = self.link_chars = self.link_tags = self.plain = 0
        self.density = self.total = 0.0


def marked(name: str) -> int:
    """What a class, id or role of several words says: KEPT, NAMED or COMMENT. The last part that isn't a place is the head."""
    for word in name.lower().split():
        parts = [x for x in re.split(r"[^a-z]+", word) if x]
        if not parts or parts[0] in ABOUT:
            continue
        first = parts[0]
        while len(parts) > 1 and parts[-1] in PLACES:
            parts.pop()
        head = parts[-1]
        if head in COMMENTS:
            return COMMENT
        if head in MARKS and not (head == "header" and first in OWN_HEADER):
            return NAMED
    return KEPT


def _unwanted(tag: str, attributes: str, in_article: bool) -> int:
    if tag in SILENT:
        return MUTE
    if tag in DROPPED or tag == "form" or tag == "header" and not in_article:
        return NAMED
    if not attributes or tag in ("html", "body"):
        return KEPT
    for m in _NAME.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower()):
            return MUTE
        if name in ("class", "id", "role") and (mark := marked(value)) and (mark == COMMENT or tag not in MAINS):
            return mark
    return KEPT


class _Open:
    """The open elements, with the depths of each name, so that no search walks the whole stack."""

    def __init__(self, root: Element):
        self.stack, self.depths, self.scopes = [root], {}, [0]

    def push(self, e: Element) -> None:
        self.depths.setdefault(e.tag, []).append(len(self.stack))
        if e.tag in _SCOPES:
            self.scopes.append(len(self.stack))
        self.stack.append(e)

    def close(self, depth: int) -> None:
        """Everything from this depth on."""
        while len(self.stack) > depth:
            e = self.stack.pop()
            self.depths[e.tag].pop()
            if e.tag in _SCOPES:
                self.scopes.pop()

    def last(self, tag: str) -> int:
        return found[-1] if (found := self.depths.get(tag)) else 0

    def end(self, tag: str) -> None:
        """A closing tag; inline ones don't reach beyond the scope they stand in."""
        if (depth := self.last(tag)) and (tag in BLOCKS or depth >= self.scopes[-1]):
            self.close(depth)

    def implied(self, tags: tuple[str, ...]) -> None:
        """Closes the outermost of these that is open in the present scope."""
        if depths := [d for t in tags if (d := self.last(t)) > self.scopes[-1]]:
            self.close(min(depths))


def parsed(page: str) -> Element:
    """The tree of a page; text is a str among an element's children."""
    root = Element("", None, KEPT)
    pos, n, at = 0, len(page), _Open(root)
    while pos < n:
        m = _TAG.search(page, pos)
        if m is None:
            at.stack[-1].children.append(page[pos:])
            break
        if m.start() > pos:
            at.stack[-1].children.append(page[pos : m.start()])
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            at.end(tag)
            continue
        if tag in BLOCKS:  # an open paragraph ends here, whatever is open in it
            at.implied(("p",))
        if tag in ENDS:
            at.implied(ENDS[tag])
        new = Element(tag, at.stack[-1], _unwanted(tag, attributes, bool(at.last("article") or at.last("main"))))
        at.stack[-1].children.append(new)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else n
        elif tag not in VOID and not attributes.endswith("/"):
            at.push(new)
    return root


def _settle(root: Element) -> None:
    """Takes back the marks of elements that hold most of the page's text outside links, unless they stand outside of
    article and main elements that have text; and the marks of comments if nothing else has text."""
    order, todo = [], [(root, False, False)]
    within = set()  # elements inside of article or main
    while todo:
        e, linked, inside = todo.pop()
        order.append(e)
        if inside:
            within.add(id(e))
        linked, inside = linked or e.tag == "a", inside or e.tag in MAINS and e.drop != COMMENT
        for c in e.children:
            if isinstance(c, str):
                e.plain += 0 if linked else len(c.strip())
            elif c.drop != MUTE:
                todo.append((c, linked, inside))
    mains: dict[int, int] = {}  # text of outermost article and main elements in each element
    for e in reversed(order):
        if e.tag in MAINS and e.drop != COMMENT:
            mains[id(e)] = e.plain
        if e.parent is not None:
            e.parent.plain += e.plain
            mains[id(e.parent)] = mains.get(id(e.parent), 0) + mains.get(id(e), 0)
    comments, hidden = 0, set()
    for e in order:
        if e.drop == NAMED and e.tag not in DROPPED and 2 * e.plain > root.plain and (id(e) in within or mains.get(id(e), 0) == mains.get(id(root), 0)):
            e.drop = KEPT
        if id(e.parent) in hidden or e.drop == COMMENT:
            hidden.add(id(e))
            comments += e.plain if id(e.parent) not in hidden else 0
    if comments == root.plain:
        for e in order:
            e.drop = KEPT if e.drop == COMMENT else e.drop


def _measure(top: Element) -> list[Element]:
    """Counts of all elements that aren't left out, children before parents."""
    order, todo = [], [(top, False)]
    while todo:
        e, linked = todo.pop()
        order.append(e)
        linked = linked or e.tag == "a"
        for c in reversed(e.children):
            if isinstance(c, str):
                k = len(c.strip())
                e.chars += k
                e.link_chars += k * linked
            elif not c.drop:
                todo.append((c, linked))
    order.reverse()
    for e in order:
        if (p := e.parent) is not None and e is not top:
            p.chars += e.chars
            p.tags += e.tags + 1
            p.link_chars += e.link_chars
            p.link_tags += e.link_tags + (e.tag == "a")
    return order


def _densities(order: list[Element], body: Element) -> None:
    share = body.link_chars / max(1, body.chars)
    for e in order:
        if e.chars:
            c, lc, t, lt = e.chars, max(1, e.link_chars), max(1, e.tags), max(1, e.link_tags)
            base = math.log(c / max(1, c - e.link_chars) * e.link_chars + share * c + math.e)
            e.density = c / t * max(0.0, math.log(c / lc * t / lt)) / base
    for e in order:
        if e.parent is not None:
            e.parent.total += e.density


def body_of(root: Element) -> Element:
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag == "body":
            return e
        todo += [c for c in reversed(e.children) if not isinstance(c, str) and c.tag in ("html", "body")]
    return root


def _menu(e: Element) -> bool:
    """A list or box of several short links and nothing else."""
    return e.tag not in FLOW - {"ul", "ol", "dl", "table"} and e.link_tags > 1 and 10 * e.link_chars >= 9 * e.chars and e.link_chars <= LINK * e.link_tags


def _by_tags(best: Element, body: Element) -> Element:
    """The article that the main subtree lies in, or else the only article or main element in it that holds half of its text."""
    article, at = None, best
    while at is not None and at is not body:
        article = at if at.tag == "article" else article
        at = at.parent
    if article is not None:
        return article
    for tag in ("article", "main"):
        found, todo = [], [best]
        while todo:
            e = todo.pop()
            if e.tag == tag:
                found.append(e)
            else:
                todo += [c for c in e.children if not isinstance(c, str) and not c.drop]
        if len(found) == 1 and 2 * (found[0].chars - found[0].link_chars) >= best.chars - best.link_chars > 0:
            return found[0]
    return best


def main_parts(root: Element) -> list[Element | str]:
    """What makes up the main text, in the order of the page."""
    _settle(root)
    body = body_of(root)
    order = _measure(body)
    _densities(order, body)
    densest = max(reversed(order), key=lambda e: e.density)
    least, at = densest.density, densest
    while at is not body:
        at = at.parent
        least = min(least, at.density)
    best = max((e for e in reversed(order) if e.density >= least), key=lambda e: (e.total, -e.tags))
    if best.total == 0:
        return [body]
    best = _by_tags(best, body)
    parts: list[Element | str] = [best]
    at, near = best, True
    while at is not body and at.tag not in MAINS:
        before, after, seen = [], [], False
        for c in at.parent.children:
            if c is at:
                seen = True
            elif isinstance(c, str):
                if near:
                    (after if seen else before).append(c)
            elif not c.drop and c.chars:
                heading = c.tag in HEADINGS and not seen
                own = near and (c.tag in FLOW or c.tag not in BLOCKS) and not _menu(c)
                beside = c.tag in BLOCKS - FLOW and c.density >= least and c.total >= BESIDE * best.total and 2 * c.link_chars < c.chars
                if heading or own or beside:
                    (after if seen else before).append(c)
        parts = [*before, *parts, *after]
        at, near = at.parent, False
    return parts


def _without_menus(parts: list[Element | str]) -> list[Element | str | None]:
    """The parts without the menus that stand at either end of them; None stands for the end of a block."""
    left: deque = deque(parts)

    def trim(take: Callable, put: Callable, inwards: Callable) -> None:
        while left:
            e = take()
            if e is None or isinstance(e, str) and not e.strip() or isinstance(e, Element) and (e.drop or not e.chars):
                continue
            if isinstance(e, str) or e.tag in FLOW - {"ul", "ol", "dl", "table"} or e.tag not in BLOCKS:
                return put(e)
            if not _menu(e):
                if e.tag in FLOW:
                    return put(e)
                put(None)
                for c in inwards(e.children):
                    put(c)

    trim(left.popleft, left.appendleft, reversed)
    trim(left.pop, left.append, iter)
    return list(left)


def text_of(parts: list[Element | str | None]) -> str:
    """The parts' text; None among them ends a block."""
    blocks, run = [], []

    def end() -> None:
        if run:
            block = _SPACE.sub(" ", entities.unescape("".join(run))).strip()
            if block:
                blocks.append(block)
            run.clear()

    todo: list = list(reversed(parts))
    while todo:
        e = todo.pop()
        if e is None:
            end()
        elif isinstance(e, str):
            run.append(e)
        elif not e.drop:
            if e.tag in BLOCKS:
                end()
                todo.append(None)
            elif e.tag in ("br", "td", "th"):
                run.append(" ")
            todo += reversed(e.children)
    end()
    return "\n\n".join(blocks)


def main_text(page: str | None) -> str:
    return text_of(_without_menus(main_parts(parsed(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
