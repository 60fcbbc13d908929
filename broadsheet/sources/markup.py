"""A small document tree for HTML, with the selectors that registries use. Standard library only."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache
from html import unescape
from html.parser import HTMLParser

# Elements without content, and which open elements a start tag ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HIDDEN = frozenset("script style template noscript".split())

_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs or {}, parent, []

    def walk(self):
        """This node and all below it, in document order; without recursion, as pages may be deep."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, skip: frozenset = HIDDEN) -> str:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                if node.tag in BLOCKS or node.tag == "br":
                    out.append(" ")
                stack.append(" " if node.tag in BLOCKS else "")
                stack.extend(reversed(node.children))
        return _SPACE.sub(" ", "".join(out)).strip()

    def raw(self) -> str:
        return "".join(c for n in self.walk() for c in n.children if isinstance(c, str))

    def classes(self) -> set[str]:
        return set(self.attrs.get("class", "").split())

    def tagged(self, tag: str | None) -> Iterable[Node]:
        """Nodes below this one, with a tag if one is given, in document order."""
        return (n for n in self.walk() if n is not self and (tag is None or n.tag == tag))

    def _selected(self, selector: str) -> Iterable[Node]:
        tests = _alternatives(selector)
        if len(tests) != 1:
            return (n for n in self.tagged(None) if any(_fits(n, t, self) for t in tests))
        tag, bare = _last_tag(selector)
        return self.tagged(tag) if bare else (n for n in self.tagged(tag) if _fits(n, tests[0], self))

    def select(self, selector: str) -> list[Node]:
        return list(self._selected(selector))

    def first(self, selector: str) -> Node | None:
        return next(iter(self._selected(selector)), None)


class Document(Node):
    """The root of a page, with its nodes by tag: pages are asked for a dozen tags each."""

    __slots__ = ("tags",)

    def __init__(self):
        super().__init__("#document")
        self.tags: dict[str, list[Node]] = {}

    def tagged(self, tag: str | None) -> Iterable[Node]:
        return super().tagged(None) if tag is None else self.tags.get(tag, ())


# Text, then a tag, doctype or comment without peculiarities: all that HTMLParser reads in one way only, in any version.
_GAP = r"[ \t\n\r\f]"
_PIECE = re.compile(
    rf"""([^<]*+)(?:<([A-Za-z][A-Za-z0-9]*)((?:{_GAP}+[A-Za-z][A-Za-z0-9_:-]*=(?:"[^"]*"|'[^']*'))*){_GAP}*(/?)>|</([A-Za-z][A-Za-z0-9]*)>|<!(?:[Dd][Oo][Cc][Tt][Yy][Pp][Ee][^>]*|--(?!-?>)(?:[^->]|-(?!-))*--)>)"""
)
_ATTRIBUTE = re.compile(r"""([A-Za-z][A-Za-z0-9_:-]*)=(?:"([^"]*)"|'([^']*)')""")
#: Elements whose content isn't read as markup, and where it ends.
_OWN_CONTENT = {t: re.compile(rf"</{t}\s*>", re.I) for t in {*HTMLParser.CDATA_CONTENT_ELEMENTS, *getattr(HTMLParser, "RCDATA_CONTENT_ELEMENTS", ()), "plaintext"}}


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Document()

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def goahead(self, end):
        """Reads plain pieces by one expression, elements with content of their own by HTMLParser, and from the first other piece on leaves all to it."""
        said, at = self.rawdata, 0
        while self.cdata_elem is None and (m := _PIECE.match(said, at)):
            text, start, attrs, empty, stop = m.groups()
            own = _OWN_CONTENT.get(start.lower()) if start else None
            over = own and not empty and own.search(said, m.end())
            if own and not over:
                break
            if text:
                self.handle_data(unescape(text))
            at = m.end()
            if own:
                at, self.rawdata = over.end(), said[m.start(2) - 1 : over.end()]
                super().goahead(False)
                if self.rawdata or self.cdata_elem is not None:
                    said, at = self.rawdata + said[at:], 0
                    break
            elif start:
                pairs = [(k.lower(), unescape(v or w)) for k, v, w in _ATTRIBUTE.findall(attrs)] if attrs else ()
                (self.handle_startendtag if empty else self.handle_starttag)(start.lower(), pairs)
            elif stop:
                self.handle_endtag(stop.lower())
        self.rawdata = said[at:]
        super().goahead(end)

    def _add(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else None, self.at)
        self.at.children.append(node)
        self.root.tags.setdefault(tag, []).append(node)
        return node

    def handle_starttag(self, tag, attrs):
        ends = ENDS.get(tag, ("p",) if tag in BLOCKS else ())
        if self.at.tag in ends:
            self.at = self.at.parent
        node = self._add(tag, attrs)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(markup: str) -> Node:
    builder = _Builder()
    builder.feed(markup or "")
    builder.close()
    return builder.root


# --- selectors: tag, .class, #id, [attr], [attr=v], *=, ^=, $=, ~=, :not(), descendant, child, comma ---

_SIMPLE = re.compile(r"""(?P<tag>[A-Za-z][\w-]*|\*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[*^$~|]?=)\s*(?P<val>"[^"]*"|'[^']*'|[^\]\s]+)\s*)?\]|:not\((?P<no>[^()]*)\)""")
_MEMO: dict[str, list] = {}


def _split(text: str, by: str) -> list[str]:
    """Parts of a selector at a character that is outside brackets."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "[(") - (c in "])")
        if c == by and not depth:
            out.append(text[at:i])
            at = i + 1
    return [s.strip() for s in [*out, text[at:]] if s.strip()]


def _compiled(selector: str) -> list[tuple[str, list]]:
    """[(combinator, tests)] from left to right; raises ValueError for what is no selector."""
    if selector not in _MEMO:
        steps, at, combinator, text = [], 0, " ", selector.strip()
        while at < len(text):
            if m := re.compile(r"\s*>\s*|\s+").match(text, at):
                combinator, at = (">" if ">" in m[0] else " "), m.end()
            tests = []
            while m := _SIMPLE.match(text, at):
                tests.append(m.groupdict())
                at = m.end()
            if not tests:
                raise ValueError(f"not a selector: {selector!r}")
            steps.append((combinator, tests))
        _MEMO[selector] = steps
    return _MEMO[selector]


@lru_cache(1024)
def _alternatives(selector: str) -> list[list]:
    return [_compiled(s) for s in _split(selector, ",")]


@lru_cache(1024)
def _last_tag(selector: str) -> tuple[str | None, bool]:
    """The tag that the last step of a selector without commas names, and whether that is all the selector says."""
    steps = _alternatives(selector)[0]
    tests = steps[-1][1]
    tag = next((t["tag"].lower() for t in tests if t["tag"] and t["tag"] != "*"), None)
    return tag, tag is not None and len(steps) == len(tests) == 1


def _simple(node: Node, t: dict) -> bool:
    if t["tag"]:
        return t["tag"] == "*" or node.tag == t["tag"].lower()
    if t["cls"]:
        return t["cls"] in node.classes()
    if t["id"]:
        return node.attrs.get("id") == t["id"]
    if t["no"] is not None:
        return not any(all(_simple(node, x) for x in _compiled(s)[-1][1]) for s in _split(t["no"], ","))
    have, op = node.attrs.get(t["attr"].lower()), t["op"]
    if have is None or op is None:
        return have is not None
    want = t["val"].strip("\"'")
    return {"=": have == want, "*=": want in have, "^=": have.startswith(want), "$=": have.endswith(want), "~=": want in have.split(), "|=": have == want or have.startswith(want + "-")}[op]


def _fits(node: Node, steps: list, root: Node) -> bool:
    *before, (combinator, tests) = steps
    for t in tests:
        if not _simple(node, t):
            return False
    if not before:
        return True
    up = node.parent
    while up is not None and up is not root:
        if _fits(up, before, root):
            return True
        if combinator == ">":
            return False
        up = up.parent
    return False
