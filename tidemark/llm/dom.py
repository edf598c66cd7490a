"""HTML to a table of nodes, many pages at once, inside tasks.

Nodes are block-level elements and text leaves, in page order. A leaf is the text between
two block boundaries of one element, inline elements included, so joining leaves by a
blank gives the text of the page. Parsing follows browsers where text depends on it:
implied end tags, void and raw-text elements, quoted attributes, open comments, tags cut off at
the end. Elements that never show text are left out.
"""

from __future__ import annotations

import html
import re

#: Fixed facts about HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript".split())
UNSEEN = frozenset("script style title textarea iframe noembed noframes noscript template svg select datalist button object audio video canvas".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var output meter progress math".split()
)
CONTROLS = frozenset("input select textarea button".split())
MEDIA = frozenset("img iframe video audio object svg canvas embed".split())
#: A start tag of the key closes an open element of the values, up to the barrier.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
NOT_IN_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3"
    " h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
P_BARRIER = frozenset("table td th caption button object template html body".split())

_TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[^>])*+)>"
    r"|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Attributes whose words say what an element is for.
TELLING = ("class", "id", "role", "itemprop", "hidden")


def attribute_words(text: str) -> tuple[str, ...]:
    """Lower-case words of the telling attributes in the inside of a tag."""
    if not text or text.isspace():
        return ()
    out: list = []
    for name, a, b, c, alone in _ATTRIBUTE.findall(text):
        name = (name or alone).lower()
        if name == "hidden" or (name == "aria-hidden" and "true" in (a, b, c)):
            out.append("hidden")
        elif name in TELLING:
            out += [w.lower() for w in _WORD.findall(a or b or c)]
        elif name == "style" and "display:none" in (a or b or c).replace(" ", "").lower():
            out.append("hidden")
    return tuple(out)


class Pages:
    """Columns of the nodes of the pages added; a node's subtree is the rows up to ``end``."""

    def __init__(self):
        self.page, self.parent, self.end, self.depth = [], [], [], []
        self.tag, self.words, self.mark = [], [], []
        self.chars, self.linked, self.stops, self.digits = [], [], [], []
        self.controls, self.media, self.text = [], [], []
        self.count = 0
        self._attributes: dict = {}

    def _node(self, tag, parent, words, mark):
        self.page.append(self.count)
        self.parent.append(parent)
        self.end.append(0)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tag.append(tag)
        self.words.append(words)
        self.mark.append(mark)
        for column in (self.chars, self.linked, self.stops, self.digits, self.controls, self.media):
            column.append(0)
        self.text.append(None)
        return len(self.tag) - 1

    def _close_leaf(self, leaf, parts, linked):
        words = "".join(parts).split()
        text = " ".join(words)
        self.text[leaf] = text
        self.chars[leaf] = n = len(text)
        self.linked[leaf] = min(n, linked)
        self.stops[leaf] = sum(map(text.count, ".,;:!?"))
        self.digits[leaf] = sum(map(text.count, "0123456789"))
        self.end[leaf] = len(self.tag)

    def add(self, page: str, mark=None) -> None:
        """Nodes of one page; ``mark`` (tag, words, attributes) may label elements."""
        pos, size = 0, len(page)
        root = self._node("#page", -1, (), None)
        # Open elements: (tag, node or -1 for inline, words)
        open_: list = [("#page", root, ())]
        blocks: list = [root]
        unseen = 0  # depth inside an element that shows no text
        links = 0
        leaf, parts, linked = -1, [], 0
        search = _TOKEN.search

        def pop_to(depth):
            nonlocal leaf, parts, linked, unseen, links
            while len(open_) > depth:
                tag, node, _ = open_.pop()
                if tag == "a":
                    links -= 1
                if tag in UNSEEN:
                    unseen -= 1
                if node >= 0:
                    if leaf >= 0:
                        self._close_leaf(leaf, parts, linked)
                        leaf, parts, linked = -1, [], 0
                    blocks.pop()
                    self.end[node] = len(self.tag)

        while pos < size:
            found = search(page, pos)
            stop = found.start() if found else size
            if stop > pos and not unseen:
                text = page[pos:stop]
                if "&" in text:
                    text = html.unescape(text)
                if leaf < 0 and not text.isspace():
                    words = tuple(w for o in open_[1:] if o[1] < 0 for w in o[2])
                    leaf = self._node("#text", blocks[-1], words, None)
                if leaf >= 0:
                    parts.append(text)
                    if links:
                        linked += len(text)
            if not found:
                break
            pos = found.end()
            closing, tag, inside = found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                for depth in range(len(open_) - 1, 0, -1):
                    if open_[depth][0] == tag:
                        pop_to(depth)
                        break
                    if tag in INLINE and open_[depth][1] >= 0:
                        break  # an inline end tag doesn't close blocks
                continue
            block = tag not in INLINE and tag not in VOID
            if tag in NOT_IN_P:
                self._close_open(open_, {"p"}, P_BARRIER, pop_to)
            if tag in CLOSES:
                self._close_open(open_, *CLOSES[tag], pop_to)
            if tag in CONTROLS:
                self.controls[blocks[-1]] += 1
            if tag in MEDIA:
                self.media[blocks[-1]] += 1
            if tag == "br" and leaf >= 0:
                parts.append(" ")
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, pos)
                closed = page.find(">", end.end()) if end else -1
                pos = closed + 1 if closed >= 0 else size
                continue
            if tag == "hr" and leaf >= 0:
                self._close_leaf(leaf, parts, linked)
                leaf, parts, linked = -1, [], 0
            if tag in VOID:
                continue
            if tag in UNSEEN:
                # It may hold markup, svg and template do; nothing in it is shown.
                unseen += 1
                open_.append((tag, -1, ()))
                continue
            words = self._attributes.get(inside)
            if words is None:
                words = attribute_words(inside)
                if len(self._attributes) < 20_000:
                    self._attributes[inside] = words
            if not block:
                links += tag == "a"
                open_.append((tag, -1, words))
                continue
            if unseen:
                open_.append((tag, -1, ()))
                continue
            if leaf >= 0:
                self._close_leaf(leaf, parts, linked)
                leaf, parts, linked = -1, [], 0
            node = self._node(tag, blocks[-1], words, mark(tag, words, inside) if mark else None)
            open_.append((tag, node, words))
            blocks.append(node)
        pop_to(1)
        if leaf >= 0:
            self._close_leaf(leaf, parts, linked)
        self.end[root] = len(self.tag)
        self.count += 1

    @staticmethod
    def _close_open(open_, tags, barrier, pop_to):
        for depth in range(len(open_) - 1, 0, -1):
            if open_[depth][0] in tags:
                pop_to(depth)
                return
            if open_[depth][0] in barrier:
                return
