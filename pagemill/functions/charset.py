"""Which encoding a page is in, by the WHATWG labels."""

from __future__ import annotations

import codecs
import re

#: Labels whose Python codec differs from the WHATWG meaning (fixed values).
LABELS = {
    "iso-8859-1": "cp1252", "latin1": "cp1252", "l1": "cp1252", "ascii": "cp1252", "us-ascii": "cp1252", "iso8859-1": "cp1252", "windows-1252": "cp1252",
    "iso-8859-9": "cp1254", "latin5": "cp1254", "gb2312": "gbk", "gbk": "gb18030", "shift_jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "euc-kr": "cp949",
    "ks_c_5601-1987": "cp949", "big5": "big5hkscs", "utf8": "utf-8", "unicode-1-1-utf-8": "utf-8", "x-gbk": "gb18030", "tis-620": "cp874", "iso-8859-11": "cp874",
}
BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def codec(label: str | None) -> str | None:
    label = (label or "").strip().strip("\"'").lower()
    if not label:
        return None
    try:
        return codecs.lookup(LABELS.get(label, label)).name
    except LookupError:
        return None


def encoding_of(content_type: str | None, body: bytes) -> str:
    """Header charset, else the first charset= within 1024 bytes, else UTF-8."""
    found = re.search(r"charset=([^;]*)", content_type or "")
    if found and (name := codec(found[1])):
        return name
    found = re.search(rb"charset=[\"']?([A-Za-z0-9_:.-]+)", body[:1024])
    return codec(found[1].decode()) or "utf-8" if found else "utf-8"


def decode(content_type: str | None, body: bytes) -> str:
    for mark, name in BOMS:
        if body.startswith(mark):
            return body[len(mark) :].decode(name, "replace")
    name = encoding_of(content_type, body)
    text = body.decode(name, "replace")
    if name == "cp1252" and "�" in text:  # the five bytes that WHATWG maps to controls
        text = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in body)
    return text
