"""Main text of web pages by tree scoring.

A page becomes a light tree; paragraphs pass points for length and commas to their ancestors, a container's points are
discounted by its link density, and the best container and the siblings that read like it are kept, less menus, forms,
notices, adverts, comments and link lists inside. Class words only weigh against an element: it stays if it holds the
article or most of the page's text. So does one whose end tag is missing. Words that articles use as well weigh only
together with the form of what they name: short or full of links, or a row of like elements, as comments are. If one
article element (or else one main) holds prose, it is judged by itself, so that many comments beside it don't outweigh it.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
_HIDE = frozenset("head script style noscript template button select textarea iframe object embed svg canvas input label audio video map noembed noframes title xmp datalist".split())
_IN_HEAD = frozenset("base link meta noscript script style template title".split())
_APART = frozenset("nav footer aside menu dialog".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul br".split())
_ENDS_P = _BLOCK - {"br", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "html", "body", "legend"}
_SAME = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_SAME = {k: (frozenset(a.split()), frozenset(b)) for k, (a, b) in _SAME.items()}
_SCORED = frozenset("p pre td blockquote li dd h2 h3".split())
#: Words of class and id that mark what isn't the article, anywhere in a name.
_BAD = frozenset("ad ads adsbygoogle adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus feedback footer gdpr masthead menu modal nav navbar navigation newsletter outbrain pager pagination paywall popup promo promoted promotion recommendations recommended related replies respond sidebar signup sponsor sponsored subscribe subscription taboola talkback widget widgets".split())
#: Words that do so only among themselves and with words of place and form.
_WEAK = frozenset("alert banner copyright disclaimer discussion discussions hidden login notice notices notification opinions overlay reactions reply responses search share sharing skip social thread threads toolbar".split())
_FORM = frozenset("a area article b bar block bottom box buttons button c center col column container content form global header icons inline inner items item js left link links list main message page panel post posts reader readers right row section site slot sticky story text the to top unit user users visitor visitors wrap wrapper".split())
#: Weak words that need a form: what is short or full of links, and what is a row of like elements.
_SHORT = frozenset("alert reply search share sharing skip social".split())
_ROW = frozenset("discussion discussions opinions reactions responses thread threads".split())
#: Own characters from which on an element is not short.
_LONG = 160
#: Words that make a name one of a layout around.
_AROUND = frozenset("has with without no is show hide enable enabled disabled layout".split())
_COMMENT = frozenset("comment comments disqus replies respond feedback talkback".split()) | _ROW
_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog menu menubar".split())
_ROOTS = frozenset("html body main article".split())


class _Node:
    __slots__ = ("anchors", "attrs", "chars", "closed", "doubt", "form", "kids", "links", "parent", "points", "tag")

    def __init__(self, tag, parent, doubt=0.0, form="", attrs=""):
        self.form, self.attrs = form, attrs  # the form that doubt needs: short or row
        self.tag, self.parent, self.kids, self.points, self.chars, self.links, self.anchors = tag, parent, [], 0.0, 0, 0, 0
        self.doubt = doubt  # the share of the page's text up to which the element is left out
        self.closed = False  # whether it had an end tag of its own


def _refused(name: str) -> set[str]:
    """The words for which one class or id is refused; none if it isn't."""
    words = [w.lower() for w in _WORDS.findall(name)]
    bad = set(words) & (_BAD | _WEAK)
    if not bad or _AROUND & set(words):
        return set()
    return bad if bad & _BAD or not set(words) - _WEAK - _FORM else set()


def _unwanted(tag: str, attrs: str, inside: bool) -> tuple[float, str]:
    """1 for what is never content, 0 for what may be; else the share of the page's text up to which the element is refused.

    And the form that it must have to be refused, if any.
    """
    if tag in _APART or (tag == "header" and not inside):
        return 1.0, ""
    doubt = 0.5 if tag == "form" else 0.0
    if not attrs:
        return doubt, ""
    names, words, others = set(), set(), False
    for name, *values in _ATTR.findall(attrs):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if (name == "hidden" or (name == "aria-hidden" and value.lower() == "true")) and tag not in _ROOTS:
            return 1.0, ""
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) and tag not in _ROOTS:
                return 1.0, ""
        elif name == "role":
            words |= {value.lower()} & _ROLES
        elif name in ("class", "id"):
            names.update(value.split())
    for name in names:
        found = _refused(name)
        words |= found
        others |= not found
    if tag in ("html", "body", "main") or not (words & _COMMENT if tag == "article" else words):
        return doubt, ""
    form = "" if doubt or words - _SHORT - _ROW else "row" if words & _ROW else "short"
    return (2.0 if not others else 0.9 if words & _COMMENT else 0.5), form  # 2: named for nothing else


def _tree(page: str) -> _Node:
    """The page without what has no text of its own; text is decoded, elements in doubt are marked."""
    root = node = _Node("html", None)
    at, skip, inside = 0, None, 0
    while m := _TAG.search(page, at):
        if m.start() > at and skip is None:
            node.kids.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            if skip is None and m[0].startswith("<![CDATA["):
                node.kids.append(m[0][9:-3])
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in _RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(page, at)
            at = end.start() if end else len(page)
        if skip is not None:  # (tag, depth) of the element around that is left out
            if tag == skip[0]:
                skip[1] += -1 if closing else 1
                if not skip[1]:
                    skip = None
                continue
            if skip[0] == "head":
                if closing or tag in _IN_HEAD:
                    continue
            elif not closing or tag not in ("body", "html", "article", "main"):
                continue
            skip = None  # one that was never closed ends with its container, a head with what it can't hold
        if closing:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                up.closed = True
                while node is not up:
                    inside -= node.tag in ("article", "main")
                    node = node.parent
                inside -= node.tag in ("article", "main")
                node = node.parent
            continue
        if tag == "html":
            continue
        if tag in _HIDE:
            if tag not in _VOID:
                skip = [tag, 1]
            continue
        doubt, form = _unwanted(tag, attrs, bool(inside))
        if doubt and tag in _VOID:
            continue
        if doubt and not form and tag in ("p", "li"):
            doubt = 3.0  # out for certain, also without an end tag
        if tag in _ENDS_P:
            up = node
            while up is not None and up.tag != "p" and (up.tag not in _BLOCK):
                up = up.parent
            if up is not None and up.tag == "p":
                node = up.parent
        if tag in _SAME:
            same, stop = _SAME[tag]
            up = node
            while up is not None and up.tag not in same and up.tag not in stop:
                up = up.parent
            if up is not None and up.tag in same:
                node = up.parent
                if tag == "tr" and node.tag == "tr":
                    node = node.parent
        new = _Node(tag, node, doubt, form, attrs)
        node.kids.append(new)
        if tag not in _VOID:
            node = new
            inside += tag in ("article", "main")
    if skip is None and at < len(page):
        node.kids.append(html.unescape(page[at:]))
    return root


def _all(root: _Node) -> list[_Node]:
    """Nodes, parents first, without recursion: pages may nest deeply."""
    out = [root]
    for n in out:
        out.extend(k for k in n.kids if type(k) is _Node)
    return out


def _blocks(roots: list[_Node], leave: set[int]) -> str:
    """The text of roots in page order: blocks apart by one space, white space inside turned into one space."""
    parts: list[str] = []
    stack: list = roots[::-1]
    while stack:
        x = stack.pop()
        if type(x) is str:
            parts.append(x)
        elif id(x) not in leave:
            edge = x.tag in _BLOCK
            if edge:
                parts.append(" ")
                stack.append(" ")
            stack.extend(reversed(x.kids))
    return " ".join("".join(parts).split())


def _measure(nodes: list[_Node]) -> dict[int, int]:
    """Sets chars, links (chars inside links) and anchors (links) of the nodes; their commas."""
    commas: dict[int, int] = {}
    for n in reversed(nodes):  # children before parents
        n.chars, n.links, n.anchors, own = 0, 0, 0, 0
        for k in n.kids:
            if type(k) is str:
                n.chars += len(k) - k.count("\n") if not k.isspace() else 0
                own += k.count(",") + k.count("，") + k.count("、")
            else:
                n.chars += k.chars
                n.links += k.links
                n.anchors += k.anchors
                own += commas[id(k)]
        if n.tag == "a":
            n.links, n.anchors = n.chars, 1
        commas[id(n)] = own
    return commas


def _worth(n: _Node, commas: dict[int, int]) -> float:
    """The points a paragraph passes on; 0 for other nodes."""
    text = n.tag in _SCORED or (n.tag in ("div", "section", "article", "main", "body", "html", "center") and any(type(k) is str and len(k.strip()) >= 25 for k in n.kids))
    if not text or n.chars < 25 or n.parent is None and n.tag != "html":
        return 0.0
    return 1 + commas[id(n)] + min(n.chars / 100, 3)


def _without(root: _Node, nodes: list[_Node], out: set[int]) -> tuple[list[_Node], dict[int, int]]:
    """The tree without the nodes `out`, measured again."""
    for n in nodes:
        if id(n) in out:
            n.parent.kids.remove(n)
    nodes = _all(root)
    return nodes, _measure(nodes)


def _class(n: _Node) -> str:
    """An element's class as written."""
    return next((v[1] or v[2] or v[3] for v in _ATTR.findall(n.attrs) if v[0].lower() == "class"), "")


def _like(n: _Node) -> tuple[int, list[_Node]]:
    """How many children of an element are most alike (by tag and class; bare paragraphs don't count), and those that aren't headings."""
    inner = [k for k in n.kids if type(k) is _Node and k.tag not in ("h1", "h2", "h3", "h4", "br", "hr")]
    names = Counter((k.tag, _class(k)) for k in inner)
    return max((c for (tag, name), c in names.items() if tag != "p" or name), default=0), inner


def _has_form(n: _Node) -> bool:
    """Whether an element looks like what its name says, if that has a form: short or full of links, or a row of like elements."""
    if n.form == "short":
        return n.chars - n.links < _LONG or n.links > 0.3 * n.chars
    if n.form != "row":
        return True
    most, inner = _like(n)
    if most < 2 and len(inner) == 1:  # a list or table around the row
        most, inner = _like(inner[0])
    return most > 1 and 2 * most > len(inner)


def _prune(root: _Node, nodes: list[_Node]) -> tuple[list[_Node], dict[int, int]]:
    """Takes out what is never content, then elements in doubt unless they hold the article or much of the page's text."""
    certain = {id(n) for n in nodes if n.doubt == 3 or (n.doubt == 1 and n.closed)}
    nodes, commas = _without(root, nodes, certain)
    most, holds = root.chars - root.links, set()
    for n in reversed(nodes):
        large = n.tag in ("main", "article") and not n.doubt and n.chars - n.links >= 0.3 * most
        if n.parent is not None and (large or id(n) in holds):
            holds.add(id(n.parent))
    share = lambda n: 0.5 if n.doubt == 1 else n.doubt  # noqa: E731  1 here: its end tag is missing
    return _without(root, nodes, {id(n) for n in nodes if n.doubt and id(n) not in holds and n.chars - n.links <= share(n) * most and _has_form(n)}) if any(n.doubt for n in nodes) else (nodes, commas)


def _density(n: _Node) -> float:
    return n.links / n.chars if n.chars else 0.0


def _link_list(n: _Node) -> bool:
    """A block of links: nearly nothing else, or mostly links of a few words (a list of references isn't one)."""
    return n.tag in ("ul", "ol", "div", "section", "table", "dl") and (n.links > 0.9 * n.chars or (n.links > 0.5 * n.chars and n.chars < 40 * n.anchors))


def _alone(nodes: list[_Node]) -> list[_Node]:
    """The nodes of the page's one article element, or else of its one main, if that holds prose; none if there isn't one."""
    for tag in ("article", "main"):
        outer = [n for n in nodes if n.tag == tag and not any(up.tag == tag for up in _above(n))]
        if len(outer) == 1:
            inner = _all(outer[0])
            long_ = [n.chars for n in inner if n.tag in ("p", "pre", "blockquote") and n.chars > 80 and _density(n) < 0.25]
            if len(long_) > 1 or sum(long_) > 400:
                return inner
    return []


def _above(n: _Node):
    while (n := n.parent) is not None:
        yield n


def _kept(nodes: list[_Node]) -> list[_Node]:
    """The best container and the siblings that read like it, or the article around if those are most of it."""
    worth = lambda n: n.points * (1 - _density(n))
    own = lambda n: n.chars - n.links
    best = max(_alone(nodes) or nodes, key=worth)
    if best.points <= 0:
        return [nodes[0]] if _density(nodes[0]) < 0.5 else []
    kept = [best]
    if best.parent is not None:
        bar, kept = max(10.0, 0.2 * worth(best)), []
        for k in best.parent.kids:
            if type(k) is str:
                continue
            prose = k.tag in ("p", "pre", "blockquote") and k.chars > 80 and _density(k) < 0.25
            if k is best or worth(k) >= bar or prose or (k.tag in ("h1", "h2", "p") and 0 < k.chars and not k.links):
                kept.append(k)
    for tag in ("article", "main"):
        up = best
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None:
            inner = best is up or best.parent is up or any(k is up for k in kept) or 2 * sum(map(own, kept)) >= own(up)
            return [up] if inner and _density(up) < 0.5 else kept
    return kept


def main_text(page: str | None) -> str:
    """The article's text; empty if the page has none."""
    if not page:
        return ""
    root = _tree(page)
    nodes = _all(root)
    commas = _measure(nodes)
    if any(n.doubt for n in nodes):
        nodes, commas = _prune(root, nodes)
    for n in nodes:
        points = _worth(n, commas)
        if not points:
            continue
        up, level = n if n.tag not in _SCORED else n.parent, 1
        while up is not None and level <= 4:
            up.points += points / (1 if level == 1 else 2 if level == 2 else level * 3)
            up, level = up.parent, level + 1
    kept = _kept(nodes)
    chosen = {id(n) for n in kept}
    return _blocks(kept, {id(n) for n in nodes if n.links and id(n) not in chosen and _link_list(n)})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row.

    Null html counts as empty and gives an empty text; pages of any length are read whole; of equally good containers the
    first in page order is taken; repeated rows come out as often as they came in; an empty table gives an empty result;
    null ids and urls are passed on; extra columns of any name are left out.
    """
    picked = pages.select("page_id", "url", "html")

    def each(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    schema = picked.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return picked.mapInArrow(each, schema)
