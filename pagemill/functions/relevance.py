"""BM25 over the blocks of one document: statistics and scores stay within it, so a corpus needs no shuffle."""

from __future__ import annotations

import math
import re
from collections import Counter

#: Parameters of BM25, and the share of blocks that a query keeps.
K1, B, KEEP = 1.2, 0.75, 0.4
#: Words without meaning of their own (fixed values).
STOP = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
VOWEL = re.compile(r"[aeiouy]")


def stem(word: str) -> str:
    """Plurals, -ed and -ing, and a final y: the first step of Porter's stemmer."""
    if len(word) <= 2 or not word.isascii():
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if VOWEL.search(word[:-3]) else word
    else:
        for end in ("ed", "ing"):
            if word.endswith(end) and VOWEL.search(word[: -len(end)]):
                word = word[: -len(end)]
                if word.endswith(("at", "bl", "iz")):
                    word += "e"
                elif len(word) > 2 and word[-1] == word[-2] and word[-1] not in "lsz":
                    word = word[:-1]
                break
    if word.endswith("y") and VOWEL.search(word[:-1]):
        word = word[:-1] + "i"
    return word


def terms(text: str) -> list[str]:
    return [stem(w) for w in re.findall(r"\w+", text.lower()) if w not in STOP]


def split_blocks(md: str) -> list[str]:
    """Blocks between blank lines; a heading goes with the block after it, the last of several headings wins."""
    parts = [p.strip() for p in md.split("\n\n")]
    parts = [p for p in parts if p]
    heading = [p.startswith("#") and "\n" not in p for p in parts]
    return [parts[k - 1] + "\n\n" + p if k and heading[k - 1] and not heading[k] else p for k, p in enumerate(parts) if not heading[k] or k == len(parts) - 1]


def scores(blocks: list[str], query: str) -> list[float]:
    """BM25 of each block against the query, with statistics of these blocks alone."""
    bags = [Counter(terms(b)) for b in blocks]
    lengths = [sum(c.values()) for c in bags]
    mean = sum(lengths) / max(len(blocks), 1) or 1.0
    out = [0.0] * len(blocks)
    for term in terms(query):
        df = sum(term in bag for bag in bags)
        idf = math.log(1 + (len(blocks) - df + 0.5) / (df + 0.5))
        for k, bag in enumerate(bags):
            if tf := bag[term]:
                out[k] += idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[k] / mean))
    return out


def best_blocks(found: list[float], keep: float = KEEP) -> list[int]:
    """The best max(1, round(n * keep)) of n scores, in document order; equal ones (to 9 digits) go to the earlier."""
    n = max(1, math.floor(len(found) * keep + 0.5))
    return sorted(sorted(range(len(found)), key=lambda k: (-round(found[k], 9), k))[:n])


def filter_blocks(md: str, query: str | None, keep: float = KEEP) -> str:
    """The best blocks in document order; all of them for a blank query or a share of 1."""
    if not query or not query.strip() or keep >= 1:
        return md
    blocks = split_blocks(md)
    if len(blocks) <= 1:
        return md
    return "\n\n".join(blocks[k] for k in best_blocks(scores(blocks, query), keep)) + "\n"
