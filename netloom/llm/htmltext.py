"""Main text of web pages by composite text density.

1. A page is read into a tree of elements once, in time linear in its length; scripts, styles and comments hold no text.
2. Parts that are furniture by element or by name (menus, footers, side bars, notices, adverts, forms, reader comments) are left out
   before densities are taken.  A name counts only where the part does not hold most of the page's text.
3. Inline elements fold into their block.  Every block gets C characters, T tags (blocks and links), and of those LC and LT inside links.
   Its composite density is characters a tag, adjusted for links: C/T times a logarithm whose base grows with the share of
   link text, of (C/~LC) (T/LT).
4. A block's density sum adds up its child blocks' densities.  The block with the largest sum is the heart of the main text; the least
   density on the path from it to the body is the threshold that other branches must reach, with a fair share of its text, to
   belong to it.  The smallest block that holds all of them is the main subtree, from the first of them to the last.
5. <article> and <main> only break ties: if one holds most of what was chosen, or the whole of it, it is the main text.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame

from netloom.llm.shared import map_rows

# HTML's element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
#: Elements without main text.
SKIP = frozenset("head script style noscript template iframe object embed svg canvas audio video map form button input select "
                 "option textarea label fieldset nav footer aside menu dialog title xmp noembed noframes".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption "
                  "search legend optgroup option".split())
#: A start tag that ends an open element of the second set, up to the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
#: Block elements that end an open paragraph.
_ENDS_P = BLOCK - {"html", "body", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup"} | {"li", "dd", "dt"}
# Names of furniture; the second list also has other uses.
_ALWAYS = (r"ads?|advert\w*|adsense|adslot|adbox|adbanner|sponsor\w*|cookies?|consent|gdpr|popups?|newsletters?|signup|login|sidebars?|"
           r"nav|navbar|navigation|navi|menus?|menubar|breadcrumbs?|pagination|pager|footers?|masthead|topbar|toolbar|comments?|commentlist|disqus|"
           r"respond|replies|outbrain|taboola|searchbox")
_OFTEN = (r"promo\w*|banners?|notices?|notifications?|alerts?|modals?|overlays?|subscribe|subscription|paywall|aside|widgets?|toc|discussion|"
          r"share|sharing|social|follow|related|recommended|recommendations|trending|popular|tags|skip|hidden")
#: One of these as a whole part of a class, id or role marks furniture, but for a name that says what a part has or has not.
_STRONG, _WEAK = (re.compile(rf"(?:^|[\s_-])(?:{n})(?:$|[\s_-])") for n in (_ALWAYS, _OFTEN))
_STATE = re.compile(r"(?:^|[_-])(?:no|not|non|has|with|without|is)[_-]|[_-](?:open|opened|closed|enabled|disabled|on|off|active|true|false)$")
#: Share of the page's text outside links that a part named so may hold and still be furniture.
MOST_STRONG, MOST_WEAK = 0.9, 0.5
#: Least share of the heart's text in another branch of the main text.
BRANCH = 0.1
#: Names of a page's own header, which an article's may share.
_HEADER = re.compile(r"(?:^|\s)(?:(?:site|page|top|global|main)[_-])?header(?:$|\s)")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WHITE = re.compile(r"\s+")


class Node:
    __slots__ = ("name", "parent", "children", "bad", "named", "start", "stop", "chars", "tags", "link_chars", "link_tags", "density", "sum", "own")

    def __init__(self, name: str, parent: Node | None, bad: bool = False, named: float = 0.0):
        self.name, self.parent, self.bad, self.named = name, parent, bad, named
        self.children: list = []  # nodes and strings in page order

    def holds(self, other: Node) -> bool:
        return self.start <= other.start and other.stop <= self.stop


def _furniture(name: str, attrs: str, inside: bool) -> tuple[bool, float]:
    """Whether an element is furniture for sure, and the share of text up to which its name makes it that (0: no such name).

    ``inside``: within an article or main element, where <header> is the article's own.
    """
    if name in SKIP or name == "header" and not inside:
        return True, 0.0
    if not attrs or name in ("html", "body"):
        return False, 0.0
    words = []
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, 0.0
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0.0
        if key == "role" and value.lower() in _ROLES:
            return True, 0.0
        if key in ("class", "id"):
            words += (w for w in _CAMEL.sub("-", value).lower().split() if not _STATE.search(w))
    named = " ".join(words)
    if name in ("main", "article") and not re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", named):
        return False, 0.0
    if not inside and _HEADER.search(named) or _STRONG.search(named):
        return False, MOST_STRONG
    return False, MOST_WEAK if _WEAK.search(named) else 0.0


class _Tags:
    """Places of tags in a page.  A quote that is never closed turns quotes into plain characters for the rest, so that no
    part of the page is read again and again."""

    def __init__(self, page: str):
        self.page, self.quotes, self.last = page, True, page.rfind(">")

    def end(self, at: int) -> int:
        """Place of the ``>`` that ends the tag whose attributes begin at ``at``, or -1."""
        if at > self.last:
            return -1
        page, i = self.page, at
        while self.quotes:
            i = _PLAIN.match(page, i).end()
            if i < len(page) and page[i] == ">":
                return i
            close = page.find(page[i], i + 1) if i < len(page) else -1
            if close < 0:
                self.quotes = False
            i = close + 1
        return page.find(">", at)


def parse(page: str) -> Node:
    """The page's tree.  Unclosed elements end with their parent; stray end tags are dropped."""
    root = Node("#root", None)
    stack, open_ = [root], {}
    at, n, low, tags = 0, len(page), None, _Tags(page)

    def pop(depth: int) -> None:
        while len(stack) > depth:
            open_[stack.pop().name] -= 1

    def find(names, stop=frozenset()) -> int:
        """Depth of the innermost open element of ``names`` below any of ``stop``, or 0."""
        if any(open_.get(x) for x in names):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name in names:
                    return depth
                if stack[depth].name in stop:
                    break
        return 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        nxt = page[lt + 1:lt + 2]
        end = -1
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            end = n if end < 0 else end + 2
        elif nxt in ("!", "?"):
            end = page.find(">", lt)
        elif nxt == "/":
            end = page.find(">", lt) if lt <= tags.last else -1
        elif nxt.isascii() and nxt.isalpha():
            name_end = _NAME.match(page, lt + 1).end()
            end = tags.end(name_end)
        if end < 0:  # no tag: a plain character
            stack[-1].children.append(page[at:lt + 1])
            at = lt + 1
            continue
        if lt > at:
            stack[-1].children.append(page[at:lt])
        at = end + 1
        if nxt in ("!", "?"):
            continue
        if nxt == "/":
            m = _NAME.match(page, lt + 2)
            name = m[0].lower() if m else ""
            # An inline end tag does not close a block.
            depth = find((name,), frozenset() if name in BLOCK else BLOCK)
            if depth:
                pop(depth)
            elif name == "br":
                stack[-1].children.append(" ")
            continue
        name, attrs = page[lt + 1:name_end].lower(), page[name_end:end]
        if name in CLOSES:
            own, stop = CLOSES[name]
            while depth := find(own, stop):
                pop(depth)
        if name in _ENDS_P and (depth := find(("p",), BLOCK - {"p"})):
            pop(depth)
        inside = bool(open_.get("article") or open_.get("main"))
        parent = stack[-1]
        bad, named = _furniture(name, attrs, inside)
        child = Node(name, parent, parent.bad or bad, named)
        parent.children.append(child)
        if name in VOID or attrs.endswith("/") and name not in BLOCK and name not in RAW:
            continue
        if name in RAW:
            if low is None:
                low = page.lower() if len(page.lower()) == n else page
            stop = low.find(f"</{name}", at)
            child.children.append(page[at:stop if stop >= 0 else n])
            at = n if stop < 0 else (page.find(">", stop) + 1 or n)
            continue
        stack.append(child)
        open_[name] = open_.get(name, 0) + 1
    return root


def _walk(root: Node) -> list[Node]:
    """Nodes that may hold main text, parents first, numbered so that ``holds`` is two comparisons."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        node.start = len(out)
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node) and not c.bad]
    for node in reversed(out):
        node.stop = node.start
        for c in node.children:
            if isinstance(c, Node) and not c.bad:
                node.stop = max(node.stop, c.stop)
    return out


def _is_block(x: Node) -> bool:
    return x.name in BLOCK or x.name == "#root"


def _count(nodes: list[Node]) -> None:
    """Characters and tags of every node, in links and in all, children first.  Tags are blocks and links."""
    for x in reversed(nodes):
        x.chars = sum(len(_WHITE.sub(" ", c.strip())) for c in x.children if isinstance(c, str))
        x.tags = x.link_chars = x.link_tags = 0
        for c in x.children:
            if isinstance(c, Node) and not c.bad:
                x.chars += c.chars
                x.tags += c.tags + (c.name == "a" or _is_block(c))
                x.link_chars += c.chars if c.name == "a" else c.link_chars
                x.link_tags += c.tags + 1 if c.name == "a" else c.link_tags


def _drop_named(nodes: list[Node]) -> bool:
    """Marks parts that their names make furniture, unless they hold too much of the page's text outside links."""
    total = max(nodes[0].chars - nodes[0].link_chars, 1)
    found = False
    for x in nodes:
        if x.named and x.chars - x.link_chars <= x.named * total:
            x.bad = found = True
    return found


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_chars: int, body_links: int) -> float:
    """Composite text density; empty counts are taken as 1."""
    c, t, lc, lt = max(chars, 1), max(tags, 1), max(link_chars, 1), max(link_tags, 1)
    plain = max(chars - link_chars, 1)
    base = math.log(c / plain * lc + body_links / max(body_chars, 1) * c + math.e)
    inner = c / lc * t / lt
    return 0.0 if not chars else max(0.0, c / t * math.log(max(inner, 1.0) + 1e-12, max(base, 1.0 + 1e-9)))


def measured(root: Node) -> list[Node]:
    """The blocks outside furniture, parents first, with density and density sum."""
    nodes = _walk(root)
    _count(nodes)
    if _drop_named(nodes):
        nodes = _walk(root)
        _count(nodes)
    body = next((x for x in nodes if x.name == "body"), root)
    for x in nodes:
        x.density = density(x.chars, x.tags, x.link_chars, x.link_tags, body.chars, body.link_chars)
        x.own, x.sum = _is_block(x) and x.chars > 0, 0.0
    for x in reversed(nodes):
        if _is_block(x):
            x.sum = x.sum or x.density  # a block without blocks inside counts by itself
        if x.parent is not None:
            # Blocks inside an inline element count for the block around it.
            x.parent.sum += x.density if _is_block(x) else x.sum
    return [x for x in nodes if _is_block(x)]


def main_parts(root: Node) -> list[Node | str]:
    """The main subtree: one node, or the children of one from its first part of the main text to its last."""
    blocks_ = measured(root)
    body = next((x for x in blocks_ if x.name == "body"), root)
    inside = [x for x in blocks_ if body.holds(x) and x.own]
    if not inside:
        return [body]
    heart = max(inside, key=lambda x: (x.sum, -x.start))
    least, node = heart.density, heart
    while node is not body:
        node = node.parent
        if _is_block(node):
            least = min(least, node.density)
    text = lambda x: x.chars - x.link_chars
    top = heart
    for x in inside:
        if x.density >= least and text(x) >= BRANCH * text(heart) and text(x) > x.link_chars and not x.holds(heart):
            while not top.holds(x):
                top = top.parent
    stated = [x for x in inside if x.name in ("article", "main")]
    around = [x for x in stated if x.holds(top)]
    if around:  # the innermost one around it
        top = around[-1]
    else:
        outer, stop = [], -1
        for x in stated:
            if top.holds(x) and x.start > stop:
                outer.append(x)
                stop = x.stop
        if len(outer) == 1 and text(outer[0]) >= text(top) / 2:
            return [outer[0]]
    if top is heart or around:
        return [top]
    belongs = [i for i, c in enumerate(top.children) if isinstance(c, Node) and not c.bad and c.chars and _is_block(c) and (
        c.holds(heart) or c.density >= least and text(c) >= BRANCH * text(heart) and text(c) > c.link_chars)]
    if not belongs:
        return [top]
    first = belongs[0]
    while first and (not isinstance(top.children[first - 1], Node) or top.children[first - 1].name in _HEADS):
        first -= 1
    return top.children[first:belongs[-1] + 1]


_HEADS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def blocks(parts: list[Node | str]) -> list[str]:
    """Text blocks of a subtree in page order: character references decoded, white space folded, empty ones gone.  Furniture is left out."""
    out: list[str] = []
    part: list[str] = []

    def flush():
        text = _WHITE.sub(" ", html.unescape("".join(part))).strip()
        part.clear()
        if text:
            out.append(text)

    stack: list = parts[::-1]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            part.append(x)
        elif x is None:
            flush()
        elif not x.bad:
            if x.name == "br":
                part.append(" ")
            block = x.name in BLOCK or x.name == "#root"
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.children)
    flush()
    return out


def extract(page: str | None) -> str:
    """Main text of a whole page: its blocks joined by an empty line."""
    return "\n\n".join(blocks(main_parts(parse(page)))) if page else ""


def main_text(df: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """``df`` plus ``out``: the page's main text, empty for null and empty pages and pages without text.

    A column called ``out`` is replaced; repeated rows are read each.  A map over Arrow batches: no shuffle.
    """

    def make():
        return lambda p: (extract(p),)

    return map_rows(df, {"p": page}, f"`{out}` string", make)
