"""HTML to markdown, code fences with language tags, and numbered citations."""

from __future__ import annotations

import re

from pagemill.functions import urls
from pagemill.functions.codelang import guess_language
from pagemill.functions.html import CLOSES_P, Element, parse

BLOCKS = CLOSES_P | frozenset("html body head title tr td th thead tbody tfoot caption li dt dd noscript colgroup select option legend optgroup iframe".split())
SKIPPED = frozenset("script style".split())
SILENT = frozenset("input textarea meta link base template select svg".split())
#: Stands for a hard line break while blank runs collapse.
BREAK = "\ue000"
INLINE_MARKS = re.compile(r"([\\*_\[\]`])")
#: What may start a mark of a line, and the marks.
LEADS = re.compile(r"[-+>#=~\d]")
ESCAPES = [
    (re.compile(r"\A([-+>]|#{1,6})(?= |\Z)"), r"\\\1"),
    (re.compile(r"\A(=+)"), r"\\\1"),
    (re.compile(r"\A(~~~)"), r"\\\1"),
    (re.compile(r"\A(\d+)\.(?= )"), r"\1\\."),
]


BLANKS = re.compile(r"[ \t\n\r\f]+")
SPACES = re.compile(" {2,}")
AROUND_BREAKS = re.compile(rf" *{BREAK} *")
BACKTICKS = re.compile("`+")
LEADING_BACKTICKS = re.compile("^`+", re.M)
HEADINGS = {f"h{k}": "#" * k for k in range(1, 7)}
LANGUAGE = re.compile(r"^(?:language|lang|highlight|prism)-")


def escape(text: str) -> str:
    text = INLINE_MARKS.sub(r"\\\1", text)
    if LEADS.match(text):
        for pattern, to in ESCAPES:
            text = pattern.sub(to, text)
    return text


class Writer:
    def __init__(self, no_links: bool = False, no_images: bool = False):
        self.no_links, self.no_images = no_links, no_images

    # ------------------------------------------------ inline

    def inline(self, node: Element | str, verbatim: bool = False) -> str:
        if isinstance(node, str):
            text = BLANKS.sub(" ", node)
            return text if verbatim else escape(text)
        name = node.name
        if name in SKIPPED or name in SILENT:
            return ""
        if name == "br":
            return BREAK
        if name == "img":
            return self.image(node)
        if name in ("code", "kbd", "samp", "tt"):
            return self.code(node)
        inner = "".join(self.inline(c, verbatim) for c in node.children)
        if name == "a":
            return self.link(node, inner)
        if name in ("b", "strong"):
            return self.wrapped(inner, "**")
        if name in ("i", "em"):
            return self.wrapped(inner, "*")
        if name in ("s", "del", "strike"):
            return self.wrapped(inner, "~~")
        return inner

    @staticmethod
    def wrapped(inner: str, mark: str) -> str:
        body = inner.strip(" " + BREAK)
        if not body:
            return inner
        lead, tail = inner[: len(inner) - len(inner.lstrip(" " + BREAK))], inner[len(inner.rstrip(" " + BREAK)) :]
        return f"{lead}{mark}{body}{mark}{tail}"

    def image(self, node: Element) -> str:
        if self.no_images or "src" not in node.attrs:
            return ""
        title = " ".join(node.attrs.get("title", "").split())
        alt = " ".join(node.attrs.get("alt", "").split())
        return f"![{alt}]({node.attrs['src']}" + (f' "{title}"' if title else "") + ")"

    def code(self, node: Element) -> str:
        text = BLANKS.sub(" ", node.text())
        if not text.strip():
            return text
        fence = "`" * (max(map(len, BACKTICKS.findall(text)), default=0) + 1)
        pad = " " if text.startswith("`") or text.endswith("`") else ""
        return f"{fence}{pad}{text}{pad}{fence}"

    def link(self, node: Element, inner: str) -> str:
        href = node.attrs.get("href")
        if self.no_links or href is None:
            return inner
        body = inner.strip(" ")
        lead, tail = (" " if inner[:1] == " " else ""), (" " if len(inner) > 1 and inner[-1:] == " " else "")
        title = " ".join(node.attrs.get("title", "").split()).replace('"', '\\"')
        return f"{lead}[{body}]({href}" + (f' "{title}"' if title else "") + f"){tail}"

    # ------------------------------------------------ blocks

    def blocks(self, node: Element) -> list[str]:
        """Blocks of a container, each without blank lines around it."""
        out, run = [], []

        def flush() -> None:
            if not run:
                return
            text = SPACES.sub(" ", "".join(run))
            text = AROUND_BREAKS.sub(BREAK, text).strip(" " + BREAK) if BREAK in text else text.strip(" ")
            run.clear()
            if text:
                out.append(text.replace(BREAK, "  \n"))

        for child in node.children:
            if isinstance(child, str):
                run.append(self.inline(child))
            elif child.name in SKIPPED or child.name in SILENT:
                continue
            elif child.name in BLOCKS or self.holds_blocks(child):
                flush()
                out.extend(self.block(child))
            else:
                run.append(self.inline(child))
        flush()
        return out

    def holds_blocks(self, node: Element) -> bool:
        return any(e.name in BLOCKS for e in node.elements())

    def block(self, node: Element) -> list[str]:
        name = node.name
        if name in HEADINGS:
            text = " ".join(self.flat(node).replace(BREAK, " ").split(" ")).strip()
            return [f"{HEADINGS[name]} {text}"] if text else []
        if name == "hr":
            return ["* * *"]
        if name == "pre":
            return self.fence(node)
        if name in ("ul", "ol", "menu", "dir"):
            return self.items(node)
        if name == "blockquote":
            body = "\n\n".join(self.blocks(node))
            return ["\n".join(f"> {line}".rstrip() for line in body.split("\n"))] if body else []
        if name == "table":
            return self.table(node)
        if name in BLOCKS:
            return self.blocks(node)
        inner = self.blocks(node)  # an inline element around blocks: its mark goes around each plain one
        mark = {"b": "**", "strong": "**", "i": "*", "em": "*"}.get(name)
        return [self.wrapped(x, mark) if mark and "\n" not in x and not x.startswith(("#", "|", "-", ">")) else x for x in inner]

    def flat(self, node: Element) -> str:
        return SPACES.sub(" ", "".join(self.inline(c) if isinstance(c, str) or c.name not in BLOCKS else " " + self.flat(c) + " " for c in node.children))

    def fence(self, node: Element) -> list[str]:
        inner = next((e for e in node.elements() if e.name == "code"), None)
        classes = [c for e in (inner, node) if e is not None for c in e.classes()]
        language = next((c for c in classes if c.startswith(("language-", "lang-", "highlight-", "prism-"))), "")
        language = LANGUAGE.sub("", language)
        text = node.text().removeprefix("\n").rstrip("\n")
        ticks = "`" * max(3, max(map(len, LEADING_BACKTICKS.findall(text)), default=0) + 1)
        return [f"{ticks}{language}\n{text}\n{ticks}"]

    def items(self, node: Element) -> list[str]:
        ordered = node.name == "ol"
        number = int(node.attrs["start"]) if ordered and re.fullmatch(r"\d{1,9}", node.attrs.get("start", "")) else 1
        out = []
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    out.append(escape(" ".join(child.split())))
                continue
            if child.name in ("ul", "ol", "menu") and out:
                out[-1] += "\n" + "\n".join("  " + x for x in "\n".join(self.items(child)).split("\n"))
                continue
            mark = f"{number}. " if ordered else "- "
            body = self.blocks(child) if child.name == "li" else self.block(child) if child.name in BLOCKS else [self.inline(child).strip()]
            loose = any(isinstance(c, Element) and c.name == "p" for c in child.children)
            text = ""
            for part in body:
                nested = part.startswith(("- ", "1. "))
                text += ("" if not text else "\n" if nested and not loose else "\n\n") + part
            out.append(mark + text.replace("\n", "\n" + " " * len(mark)))
            number += 1
        return ["\n".join(out)] if out else []

    def table(self, node: Element) -> list[str]:
        rows = []
        for e in node.elements():
            if e.name == "tr":
                cells = [c for c in e.children if isinstance(c, Element) and c.name in ("td", "th")]
                rows.append([self.flat(c).replace(BREAK, " ").strip().replace("|", "\\|") for c in cells])
        rows = [r for r in rows if r]
        out = [self.flat(c).strip() for c in node.children if isinstance(c, Element) and c.name == "caption"]
        if not rows:
            return out
        n = max(map(len, rows))
        rows = [r + [""] * (n - len(r)) for r in rows]
        widths = [max(3, *(len(r[k]) for r in rows)) for k in range(n)]
        line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, widths)) + " |"
        return [*out, "\n".join([line(rows[0]), "| " + " | ".join("-" * w for w in widths) + " |", *map(line, rows[1:])])]


def blank_lines(md: str) -> str:
    """No trailing blanks on lines, one blank line at most in a row, one line feed at the end."""
    out, blank = [], False
    for line in md.replace("\r\n", "\n").split("\n"):
        line = line.rstrip()
        if line or not blank:
            out.append(line)
        blank = not line
    return "\n".join(out).rstrip() + "\n"


FENCE = re.compile(r"^(\s*)(`{3,}|~{3,})[ \t]*([^\n`]*)$")


def tag_fences(md: str) -> str:
    """Tags of opening fences are reduced to the bare language; an untagged fence gets a guessed one."""
    if "```" not in md and "~~~" not in md:
        return md
    lines, out, k = md.split("\n"), [], 0
    while k < len(lines):
        opened = FENCE.match(lines[k])
        if not opened:
            out.append(lines[k])
            k += 1
            continue
        indent, ticks, tag = opened.groups()
        stop, closing = k + 1, re.compile(rf"\s*{re.escape(ticks[0])}{{{len(ticks)},}}\s*")
        while stop < len(lines) and not closing.fullmatch(lines[stop]):
            stop += 1
        body = lines[k + 1 : stop]
        tag = re.sub(r"^(?:language-|prism-|highlight-)", "", tag.split()[0]) if tag.strip() else guess_language("\n".join(body)) or ""
        out.append(f"{indent}{ticks}{tag}")
        out.extend(body)
        out.extend(lines[stop : stop + 1])
        k = stop + 1
    return "\n".join(out)


def convert(html: str, no_links: bool = False, no_images: bool = False) -> str:
    blocks = Writer(no_links, no_images).blocks(parse(html))
    return blank_lines(tag_fences(blank_lines("\n\n".join(blocks))))


LINK = re.compile(r"\[([^\]]*)\]\(([^)]*)\)")


def cite(md: str, base: str, refs: bool = False) -> str:
    """Inline links become text[n], n numbering targets by first appearance; images and code are left alone."""
    start, numbers = urls.parse(base), {}

    def replaced(part: str, before: str) -> str:
        out, at = [], 0
        for m in re.finditer(r"\[", part):
            if m.start() < at:
                continue
            found = LINK.match(part, m.start())
            previous = part[m.start() - 1] if m.start() else before[-1:]
            if not found or previous == "!" or re.search(r"\s", found[2]):
                continue
            target = str(urls.parse(found[2], start) or found[2])
            n = numbers.setdefault(target, len(numbers) + 1)
            out.append(part[at : m.start()] + f"{found[1]}[{n}]")
            at = found.end()
        return "".join(out) + part[at:]

    parts = md.split("`")  # every backtick opens or closes code
    done = "`".join(replaced(p, parts[k - 1] if k else "") if k % 2 == 0 else p for k, p in enumerate(parts))
    if refs and numbers:
        done += "\n\n## References\n\n" + "".join(f"[{n}]: {target}\n" for target, n in numbers.items())
    return done
