"""Main content by readability scoring: text density, link density and class names, as published for reader views."""

from __future__ import annotations

import re

from pagemill.functions.html import Element, parse, serialise

#: Class and id wording that speaks against or for an element (fixed values of the published heuristics).
UNLIKELY = re.compile(r"-ad-|ai2html|banner|breadcrumbs|combx|comment|community|cover-wrap|disqus|extra|footer|gdpr|header|legends|menu|related|remark|replies|rss|shoutbox|sidebar|skyscraper|social|sponsor|supplemental|ad-break|agegate|pagination|pager|popup|yom-remote", re.I)
MAYBE = re.compile(r"and|article|body|column|content|main|shadow", re.I)
POSITIVE = re.compile(r"article|body|content|entry|hentry|h-entry|main|page|pagination|post|text|blog|story", re.I)
NEGATIVE = re.compile(r"-ad-|hidden|^hid$| hid$| hid |^hid |banner|combx|comment|com-|contact|footer|gdpr|masthead|media|meta|outbrain|promo|related|scroll|share|shoutbox|sidebar|skyscraper|sponsor|shopping|tags|widget", re.I)
DROPPED = frozenset("script style noscript nav aside footer form button input select textarea iframe object embed link template svg".split())
#: What a paragraph adds by the element that holds it.
BASE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
LEAST_PARAGRAPH, LEAST_TEXT = 25, 140


def _weight(e: Element) -> int:
    out = 0
    for text in (e.attrs.get("class", ""), e.attrs.get("id", "")):
        if text:
            out += 25 * bool(POSITIVE.search(text)) - 25 * bool(NEGATIVE.search(text))
    return out


def _link_share(e: Element) -> float:
    whole = len(e.text())
    return sum(len(a.text()) for a in e.elements() if a.name == "a") / whole if whole else 0.0


def _clean(root: Element, unlikely: bool) -> None:
    for e in list(root.elements()):
        if e.name in DROPPED:
            e.remove()
        elif unlikely and e.name not in ("html", "body", "a", "article", "main", "table", "td", "th", "tr", "p"):
            words = f"{e.attrs.get('class', '')} {e.attrs.get('id', '')}"
            if UNLIKELY.search(words) and not MAYBE.search(words):
                e.remove()


def _grab(root: Element) -> list[Element]:
    """The best-scored element with siblings that belong to it; empty if no paragraph scored."""
    scores: dict[int, float] = {}
    known: dict[int, Element] = {}
    for e in root.elements():
        plain = e.name == "div" and not any(isinstance(c, Element) and c.name in ("div", "p", "pre", "table", "ul", "ol", "dl", "blockquote", "section", "article") for c in e.children)
        if e.name not in ("p", "td", "pre") and not plain:
            continue
        text = re.sub(r"\s+", " ", e.text()).strip()
        if len(text) < LEAST_PARAGRAPH:
            continue
        points, up, level = 1 + text.count(",") + min(len(text) // 100, 3), e.parent, 0
        while up is not None and up.name and level < 5:
            if id(up) not in scores:
                scores[id(up)], known[id(up)] = BASE.get(up.name, 0) + _weight(up), up
            scores[id(up)] += points / (1 if level == 0 else 2 if level == 1 else level * 3)
            up, level = up.parent, level + 1
    if not scores:
        return []
    final = {k: s * (1 - _link_share(known[k])) for k, s in scores.items()}
    top = known[max(final, key=lambda k: final[k])]
    while top.parent is not None and top.parent.name not in ("", "body", "html") and sum(isinstance(c, Element) for c in top.parent.children) == 1:
        top = top.parent
    if top.parent is None or top.name in ("body", "html"):
        return [top]
    limit, out = max(10.0, final.get(id(top), 0) * 0.2), []
    for c in top.parent.children:
        if not isinstance(c, Element):
            continue
        keep = c is top or final.get(id(c), float("-inf")) >= limit
        if not keep and c.name == "p":
            text, share = c.text().strip(), _link_share(c)
            keep = len(text) > 80 and share < 0.25 or 0 < len(text) <= 80 and share == 0 and bool(re.search(r"\.( |$)", text))
        if keep:
            out.append(c)
    return out


def title_of(root: Element) -> str | None:
    for name in ("title", "h1"):
        for e in root.elements():
            if e.name == name and (text := " ".join(e.text().split())):
                return text
    return None


def prune(html: str) -> tuple[str | None, str | None]:
    """(title, html of the main content); the content is None only for a page without any text.

    An article or main element stands for itself when scoring finds nothing long enough; the last resort is the body.
    """
    title = title_of(parse(html))
    best: str | None = None
    for unlikely in (True, False):
        root = parse(html)
        _clean(root, unlikely)
        found = _grab(root)
        if sum(len(e.text().strip()) for e in found) >= LEAST_TEXT:
            return title, "\n".join(map(serialise, found))
        if best is None:
            named = [e for e in root.elements() if e.name == "article" and e.text().strip()] or [e for e in root.elements() if e.name == "main" and e.text().strip()] or found
            if named and any(e.text().strip() for e in named):
                best = "\n".join(map(serialise, named))
    if best is None:
        body = next((e for e in parse(html).elements() if e.name == "body"), parse(html))
        best = serialise(body) if body.text().strip() else None
    return title, best
