"""Sitemap documents: page and sub-sitemap locations of well-formed and broken XML, packed or not."""

from __future__ import annotations

import gzip
import re
import zlib
from xml.parsers import expat

#: Bytes of a document at most, unpacked.
MOST_BYTES = 128 << 20


def unpack(url: str, body: bytes) -> bytes:
    """Gunzips by name or magic number; cut at MOST_BYTES; what can't be unpacked stays as it is."""
    if not (url.endswith(".gz") or body[:2] == b"\x1f\x8b"):
        return body
    try:
        engine = zlib.decompressobj(31)
        return engine.decompress(body, MOST_BYTES)
    except zlib.error:
        return body


def pack(body: bytes) -> bytes:
    return gzip.compress(body, mtime=0)


def looks_like_sitemap(url: str) -> bool:
    low = url.lower()
    return low.endswith(".xml") or "sitemap" in low


def locations(body: bytes) -> tuple[list[str], list[str]]:
    """(page urls, sub-sitemap urls) in document order. If parsing fails before anything is found, <loc> is searched."""
    urls, subs, path, text = [], [], [], []
    parser = expat.ParserCreate(namespace_separator=None)
    local = lambda name: name.rpartition(":")[2].lower()
    quiet = [False]

    def start(name, _):
        path.append(local(name))
        text.clear()

    def end(name):
        if path and path[-1] == "loc":
            found = "".join(text).strip()
            if found:
                (subs if "sitemap" in path[:-1] else urls).append(found)
        if path:
            path.pop()
        text.clear()

    def cdata(on):
        quiet[0] = on

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: cdata(True), lambda: cdata(False)
    parser.CharacterDataHandler = lambda data: None if quiet[0] else text.append(data)
    try:
        parser.Parse(body, True)
    except expat.ExpatError:
        if not urls and not subs:
            for found in re.findall(r"<loc>(.*?)</loc>", body.decode("utf-8", "replace"), re.S):
                found = found.strip()
                if found.startswith("http"):
                    (subs if looks_like_sitemap(found) else urls).append(found)
    return urls, subs
