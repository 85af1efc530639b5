"""CSS selectors over the tree: type, universal, class, id, attribute tests, common pseudo-classes, combinators, lists."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pagemill.functions.html import Element, parse, serialise

NAME = r"-?(?:[_A-Za-z\u0080-\U0010ffff]|\\.)(?:[-\w\u0080-\U0010ffff]|\\.)*"
PIECE = re.compile(
    rf"""(?P<tag>\*|{NAME})|\#(?P<id>(?:[-\w\u0080-\U0010ffff]|\\.)+)|\.(?P<cls>{NAME})
    |\[\s*(?P<attr>{NAME})\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>{NAME}|[\w-]+))\s*(?P<flag>[iIsS])?\s*)?\]
    |:(?P<pseudo>first-child|last-child|only-child|empty|root|nth-child|nth-last-child|nth-of-type|first-of-type|last-of-type|not|is|where)""",
    re.X,
)


class SelectorError(ValueError):
    """The selector isn't valid."""


@dataclass
class Compound:
    tests: list = field(default_factory=list)

    def fits(self, e: Element) -> bool:
        return all(test(e) for test in self.tests)


def _elements(e: Element) -> list[Element]:
    return [c for c in e.parent.children if isinstance(c, Element)] if e.parent is not None else [e]


def _nth(text: str):
    text = text.strip().lower().replace(" ", "")
    text = {"odd": "2n+1", "even": "2n"}.get(text, text)
    found = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?|([+-]?\d+)", text)
    if not found:
        raise SelectorError(f"bad position {text!r}")
    if found[3]:
        return lambda k: k == int(found[3])
    step = int(found[1] + "1") if found[1] in ("", "+", "-") else int(found[1])
    start = int(found[2] or 0)
    return lambda k: (k == start) if step == 0 else (k - start) % step == 0 and (k - start) // step >= 0


def _attribute(name: str, op: str | None, value: str, fold: bool):
    def test(e: Element) -> bool:
        have = e.attrs.get(name)
        if have is None:
            return False
        a, b = (have.lower(), value.lower()) if fold else (have, value)
        match op:
            case None:
                return True
            case "=":
                return a == b
            case "~=":
                return b in a.split()
            case "|=":
                return a == b or a.startswith(b + "-")
            case "^=":
                return bool(b) and a.startswith(b)
            case "$=":
                return bool(b) and a.endswith(b)
            case _:
                return bool(b) and b in a

    return test


def _pseudo(name: str, argument: str | None):
    takes = name.startswith("nth") or name in ("not", "is", "where")
    if takes != (argument is not None):
        raise SelectorError(f":{name} has a wrong argument")
    if name in ("not", "is", "where"):
        inner = compile_selector(argument)
        return lambda e: any(matches(e, x) for x in inner) != (name == "not")
    same = lambda e: [c for c in _elements(e) if c.name == e.name]
    place = lambda e, of: next(k for k, c in enumerate(of, 1) if c is e)
    if name.startswith("nth"):
        fits = _nth(argument)
        if name == "nth-last-child":
            return lambda e: fits(place(e, _elements(e)[::-1]))
        return lambda e: fits(place(e, same(e) if name == "nth-of-type" else _elements(e)))
    return {
        "first-child": lambda e: _elements(e)[0] is e,
        "last-child": lambda e: _elements(e)[-1] is e,
        "only-child": lambda e: len(_elements(e)) == 1,
        "first-of-type": lambda e: same(e)[0] is e,
        "last-of-type": lambda e: same(e)[-1] is e,
        "empty": lambda e: not any(isinstance(c, Element) or c for c in e.children),
        "root": lambda e: e.parent is not None and e.parent.parent is None,
    }[name]


def _balanced(text: str, at: int) -> tuple[str, int]:
    depth, k = 1, at
    while k < len(text) and depth:
        depth += {"(": 1, ")": -1}.get(text[k], 0)
        k += 1
    if depth:
        raise SelectorError("a bracket isn't closed")
    return text[at : k - 1], k


def compile_selector(text: str) -> list[list[tuple[str, Compound]]]:
    """Alternatives; each is [(combinator before it, compound)], leftmost first."""
    alternatives, chain, now, combinator, at = [], [], Compound(), "", 0

    def push() -> None:
        nonlocal now
        if not now.tests:
            raise SelectorError("a selector lacks a part")
        chain.append((combinator, now))
        now = Compound()

    text = text.strip()
    while at < len(text):
        gap = re.match(r"\s*([>+~,])\s*|\s+", text[at:])
        if gap:
            at += gap.end()
            push()
            if gap[1] == ",":
                alternatives.append(chain)
                chain, combinator = [], ""
            else:
                combinator = gap[1] or " "
            continue
        m = PIECE.match(text, at)
        if not m:
            raise SelectorError(f"bad selector {text!r} at {at}")
        at = m.end()
        clean = lambda s: re.sub(r"\\(.)", r"\1", s)
        if m["tag"]:
            if now.tests:
                raise SelectorError("a type must come first")
            now.tests.append((lambda e: True) if m["tag"] == "*" else (lambda e, tag=clean(m["tag"]).lower(): e.name == tag))
        elif m["id"]:
            now.tests.append(lambda e, v=clean(m["id"]): e.attrs.get("id") == v)
        elif m["cls"]:
            now.tests.append(lambda e, v=clean(m["cls"]): v in e.classes())
        elif m["attr"]:
            value = next((v for v in (m["v1"], m["v2"], m["v3"]) if v is not None), "")
            now.tests.append(_attribute(clean(m["attr"]).lower(), m["op"], value, (m["flag"] or "").lower() == "i"))
        else:
            argument = None
            if text[at : at + 1] == "(":
                argument, at = _balanced(text, at + 1)
            now.tests.append(_pseudo(m["pseudo"], argument))
    push()
    return [*alternatives, chain]


def matches(e: Element, chain: list[tuple[str, Compound]]) -> bool:
    combinator, last = chain[-1]
    if not last.fits(e):
        return False
    rest = chain[:-1]
    if not rest:
        return True
    if combinator == ">":
        return e.parent is not None and bool(e.parent.name) and matches(e.parent, rest)
    if combinator == " ":
        up = e.parent
        while up is not None and up.name:
            if matches(up, rest):
                return True
            up = up.parent
        return False
    before = _elements(e)
    before = before[: next(k for k, c in enumerate(before) if c is e)]
    return any(matches(c, rest) for c in (before[-1:] if combinator == "+" else before))


def select(root: Element, selector: str) -> list[Element]:
    """Elements that match, in document order."""
    chains = compile_selector(selector)
    return [e for e in root.elements() if any(matches(e, c) for c in chains)]


def scope(html: str, selector: str) -> str | None:
    """Outer HTML of every match, joined by line feeds; None if nothing matches. Nested matches each appear."""
    found = select(parse(html), selector)
    return "\n".join(map(serialise, found)) if found else None
