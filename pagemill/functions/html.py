"""A tolerant HTML tokenizer and tree, for pages as they are: implied end tags, unclosed formatting, raw text."""

from __future__ import annotations

import re
from collections.abc import Container, Iterator, Mapping
from html import unescape
from types import MappingProxyType
from typing import NamedTuple

#: Elements by behaviour (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag closes open elements of these names, up to a boundary.
IMPLIES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "optgroup": ("option", "optgroup"), "thead": ("td", "th", "tr", "tbody", "tfoot"), "tbody": ("td", "th", "tr", "thead", "tbody", "tfoot"), "tfoot": ("td", "th", "tr", "thead", "tbody"),
}
BOUNDARY = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}

ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
TAG_END = re.compile(r"""[^>"']*+(?:(?:"[^"]*"|'[^']*')[^>"']*+)*+>""")
TAG_NAME = re.compile(r"/?([^\s/>]*)")
#: Tags as most are: letters and digits, no attributes.
PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")


class Token(NamedTuple):
    kind: str  # text, start, end, other
    name: str
    start: int
    end: int
    attrs: Mapping[str, str] = MappingProxyType({})
    raw: bool = False


def tokens(html: str) -> Iterator[Token]:
    """Tokens that cover html without gaps."""
    at, size, lower = 0, len(html), None
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            yield Token("text", "", at, size)
            return
        plain = PLAIN_TAG.match(html, lt)
        if plain and (name := plain[2].lower()) not in RAW:
            if lt > at:
                yield Token("text", "", at, lt)
            at = plain.end()
            yield Token("end" if plain[1] else "start", name, lt, at)
            continue
        after = html[lt + 1 : lt + 2]
        if not (after.isalpha() and after.isascii() or after in ("/", "!", "?")) or (after == "/" and not html[lt + 2 : lt + 3].isalpha()):
            end = html.find("<", lt + 1)
            end = size if end < 0 else end
            yield Token("text", "", at, end)
            at = end
            continue
        if lt > at:
            yield Token("text", "", at, lt)
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 4)
            at = size if end < 0 else end + 3
            yield Token("other", "", lt, at)
            continue
        found = TAG_END.match(html, lt + 1)
        end = found.end() if found else (html.find(">", lt) + 1 or size)
        if after in "!?":
            yield Token("other", "", lt, end)
            at = end
            continue
        name = TAG_NAME.match(html, lt + 1, end)[1].lower()
        if after == "/":
            yield Token("end", name, lt, end)
            at = end
            continue
        body = html[lt + 1 + len(name) : end - 1]
        attrs: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(body):
            attr, double, single, bare = m.groups()
            attrs.setdefault(attr.lower(), unescape(double or single or bare or ""))
        yield Token("start", name, lt, end, attrs)
        at = end
        if name in RAW:
            lower = lower if lower is not None else html.lower()
            stop = lower.find(f"</{name}", end) if len(lower) == size else next((m.start() for m in re.finditer(f"</{name}", html[end:], re.I)), -1)
            stop = size if stop < 0 else stop
            if stop > end:
                yield Token("text", "", end, stop, raw=name not in ("title", "textarea"))
            at = stop


# ---------------------------------------------------------------- tree


class Element:
    __slots__ = ("attrs", "children", "name", "parent")

    def __init__(self, name: str, attrs: dict[str, str] | None = None, parent: Element | None = None):
        self.name, self.attrs, self.parent, self.children = name, attrs or {}, parent, []

    def add(self, child: Element | str) -> None:
        if isinstance(child, Element):
            child.parent = self
        self.children.append(child)

    def elements(self) -> Iterator[Element]:
        """All elements below, in document order; no recursion, so depth is no limit."""
        stack = [c for c in reversed(self.children) if isinstance(c, Element)]
        while stack:
            now = stack.pop()
            yield now
            stack.extend(c for c in reversed(now.children) if isinstance(c, Element))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            now = stack.pop()
            if isinstance(now, str):
                out.append(now)
            elif now.name not in ("script", "style"):
                stack.extend(reversed(now.children))
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def remove(self) -> None:
        if self.parent is not None:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None


#: Open elements at most: deeper start tags become siblings, so that hostile nesting stays cheap.
DEEPEST = 256


def parse(html: str) -> Element:
    """The document as a tree under an element named ''. Unclosed formatting elements go on in later blocks."""
    root = Element("")
    stack, pending = [root], []

    def last(names: Container[str]) -> int:
        """Place of the last open element of one of the names, or 0."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                return k
        return 0

    def pop_to(k: int, by: str) -> None:
        """Close stack[k] and what is open in it; formatting elements closed on the way are opened again later."""
        for e in stack[k:]:
            if e.name in FORMATTING and e.name != by:
                pending.append((e.name, e.attrs))
        del stack[k:]

    def reopen() -> None:
        for name, attrs in pending:
            made = Element(name, attrs)
            stack[-1].add(made)
            stack.append(made)
        pending.clear()

    for token in tokens(html):
        if token.kind == "text":
            text = html[token.start : token.end]
            if pending and text.strip():
                reopen()
            stack[-1].add(text if token.raw else unescape(text))
        elif token.kind == "start":
            name = token.name
            if name in ("html", "body", "head") and any(e.name == name for e in stack):
                continue
            if name in CLOSES_P:
                k = last(("p", "button", "td", "th", "table"))
                if k and stack[k].name == "p":
                    pop_to(k, "p")
            for target in IMPLIES.get(name, ()):
                k = last((target, *BOUNDARY.get(name, ("table",))))
                if k and stack[k].name == target:
                    pop_to(k, target)
            if name == "a":
                pending[:] = [x for x in pending if x[0] != "a"]
                k = last(("a",))
                if k:
                    pop_to(k, "a")
            if pending and name not in CLOSES_P and name not in IMPLIES and name not in RAW and name not in ("html", "head", "body", "table", "meta", "link"):
                reopen()
            made = Element(name, token.attrs)
            stack[-1].add(made)
            if name not in VOID and len(stack) < DEEPEST:
                stack.append(made)
        elif token.kind == "end":
            name = token.name
            k = last((name,))
            if pending and not k and any(x[0] == name for x in pending):
                pending.pop(max(k for k, x in enumerate(pending) if x[0] == name))
                continue
            if k:
                pop_to(k, name)
            elif name == "p":
                stack[-1].add(Element("p"))
    return root


def _attr(value: str) -> str:
    return value.replace("&", "&amp;").replace('"', "&quot;").replace("\xa0", "&nbsp;")


def _text(value: str) -> str:
    return value.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace("\xa0", "&nbsp;")


def serialise(node: Element | str, raw: bool = False) -> str:
    """Outer HTML."""
    if isinstance(node, str):
        return node if raw else _text(node)
    inner = "".join(serialise(c, node.name in RAW and node.name not in ("title", "textarea")) for c in node.children)
    if not node.name:
        return inner
    head = f"<{node.name}" + "".join(f' {k}="{_attr(v)}"' for k, v in node.attrs.items()) + ">"
    return head if node.name in VOID else f"{head}{inner}</{node.name}>"


# ---------------------------------------------------------------- chrome

#: What strip_chrome removes (fixed values): elements, classes, and parts of class attributes.
CHROME_TAGS = frozenset("nav footer aside form style script noscript button".split())
CHROME_CLASSES = frozenset(["pagination-nav", "theme-doc-footer", "theme-doc-toc-mobile"])
CHROME_CLASS_PARTS = ("copyButton", "feedback-prompt", "was-this-helpful")


def is_chrome(name: str, attrs: dict[str, str]) -> bool:
    if name in CHROME_TAGS:
        return True
    value = attrs.get("class")
    return bool(value) and (not CHROME_CLASSES.isdisjoint(value.split()) or any(part in value for part in CHROME_CLASS_PARTS))


def strip_chrome(html: str) -> str:
    """html without navigation and other boilerplate elements; all other source characters stay as they are."""
    out, kept, stack, gone = [], 0, [], None  # gone: depth of the element that is being removed
    for token in tokens(html):
        if token.kind == "start":
            hit = gone is None and is_chrome(token.name, token.attrs)
            if hit:
                out.append(html[kept : token.start])
            if token.name in VOID:
                if hit:
                    kept = token.end
                continue
            stack.append(token.name)
            if hit:
                gone = len(stack)
        elif token.kind == "end" and token.name in stack:
            depth = len(stack) - 1 - stack[::-1].index(token.name)
            if gone is not None and depth + 1 <= gone:
                kept = token.end if depth + 1 == gone else token.start
                gone = None
            del stack[depth:]
    if gone is None:
        out.append(html[kept:])
    return "".join(out)
