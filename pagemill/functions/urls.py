"""URLs by the WHATWG rules that a crawler meets: parse, normalise, join.

Java's and Python's own URL functions follow RFC 3986 and differ: they keep default ports, letter case of hosts,
backslashes and unescaped characters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Schemes with an authority and a default port (fixed values).
PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}
SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
#: Characters beyond controls, DEL and non-ASCII that are escaped in a component.
IN_PATH, IN_QUERY, IN_FRAGMENT, IN_USER = " \"#<>?^`{}", " \"#<>'", " \"<>`", " \"#<>?`{}/:;=@[\\]^|"
FORBIDDEN_HOST = re.compile(r"[\x00-\x20#/:<>?@\[\\\]^|%\x7f]")


def escaped(text: str, extra: str) -> str:
    out = []
    for c in text:
        if c <= "\x1f" or c >= "\x7f" or c in extra:
            out.extend(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass"))
        else:
            out.append(c)
    return "".join(out)


@dataclass(frozen=True)
class Url:
    scheme: str
    user: str
    host: str
    port: int | None
    path: str
    query: str | None
    fragment: str | None
    special: bool = True

    @property
    def authority(self) -> str:
        return (f"{self.user}@" if self.user else "") + self.host + (f":{self.port}" if self.port is not None else "")

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.authority}"

    def __str__(self) -> str:
        start = f"{self.scheme}://{self.authority}" if self.special else f"{self.scheme}:"
        return start + self.path + (f"?{self.query}" if self.query is not None else "") + (f"#{self.fragment}" if self.fragment is not None else "")


def _host(text: str) -> str | None:
    if text.startswith("["):
        return text.lower() if re.fullmatch(r"\[[0-9A-Fa-f:.]+\]", text) else None
    plain = re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), text)
    if not plain.isascii():
        try:
            plain = plain.encode("idna").decode()
        except UnicodeError:
            return None
    plain = plain.lower()
    return None if not plain or FORBIDDEN_HOST.search(plain) else plain


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")[1:]
    for k, part in enumerate(parts):
        plain = part.lower().replace("%2e", ".")
        last = k == len(parts) - 1
        if plain == "..":
            if out:
                out.pop()
            if last:
                out.append("")
        elif plain == ".":
            if last:
                out.append("")
        else:
            out.append(part)
    return "/" + "/".join(out)


def _split(rest: str) -> tuple[str, str | None, str | None]:
    rest, mark, fragment = rest.partition("#")
    path, asked, query = rest.partition("?")
    return path, escaped(query, IN_QUERY) if asked else None, escaped(fragment, IN_FRAGMENT) if mark else None


def _absolute(scheme: str, rest: str) -> Url | None:
    rest = rest.lstrip("/\\")
    end = min((k for k in (rest.find(c) for c in "/\\?#") if k >= 0), default=len(rest))
    authority, rest = rest[:end], rest[end:]
    user, at, place = authority.rpartition("@")
    port = None
    found = re.fullmatch(r"(.*?)(?::([0-9]*))?", place, re.S)
    if not found:
        return None
    if found[2]:
        port = int(found[2])
        if port > 65535:
            return None
    host = _host(found[1])
    if host is None:
        return None
    path, query, fragment = _split(rest)
    name, colon, word = user.partition(":")
    user = escaped(name, IN_USER) + (f":{escaped(word, IN_USER)}" if word else "")
    return Url(scheme, user if at else "", host, None if port == PORTS[scheme] else port, _without_dots(escaped("/" + path.replace("\\", "/").removeprefix("/"), IN_PATH)), query, fragment)


def parse(text: str | None, base: Url | None = None) -> Url | None:
    """None where a browser would fail."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    found = SCHEME.match(text)
    if found:
        scheme, rest = found[1].lower(), text[found.end() :]
        if scheme in PORTS:
            if base is not None and base.special and base.scheme == scheme and not re.match(r"[/\\]", rest):
                return _relative(rest, base)
            return _absolute(scheme, rest)
        path, query, fragment = _split(rest)
        return Url(scheme, "", "", None, escaped(path, ""), query, fragment, False)
    if base is None:
        return None
    if not base.special:
        return None if not text.startswith("#") else Url(base.scheme, "", "", None, base.path, base.query, escaped(text[1:], IN_FRAGMENT), False)
    return _relative(text, base)


def _relative(text: str, base: Url) -> Url | None:
    if re.match(r"[/\\]{2}", text):
        return _absolute(base.scheme, text)
    path, query, fragment = _split(text)
    path = path.replace("\\", "/")
    if not path:
        return Url(base.scheme, base.user, base.host, base.port, base.path, query if query is not None else base.query, fragment)
    if not path.startswith("/"):
        path = base.path.rpartition("/")[0] + "/" + path
    return Url(base.scheme, base.user, base.host, base.port, _without_dots(escaped(path, IN_PATH)), query, fragment)


def normalise(text: str | None) -> str | None:
    url = parse(text)
    return None if url is None else str(url)


def join(base: str | None, target: str | None) -> str | None:
    """target seen from base; None where either can't be parsed."""
    start = parse(base)
    url = None if start is None else parse(target, start)
    return None if url is None else str(url)
