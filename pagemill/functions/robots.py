"""robots.txt by RFC 9309: groups by product token, longest match, allow wins ties."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

#: Product token of our user agent, and the longest crawl delay that is honoured, in seconds.
AGENT, LONGEST_DELAY = "pagemill", 10.0


@dataclass
class Rules:
    rules: list[tuple[bool, str]] = field(default_factory=list)  # (allow, pattern)
    delay: float | None = None
    sitemaps: list[str] = field(default_factory=list)

    def allowed(self, path: str) -> bool:
        """path with its query."""
        best = (-1, True)
        for allow, pattern in self.rules:
            if matches(pattern, path):
                best = max(best, (len(pattern), allow))
        return best[1] or path == "/robots.txt"


def pieces(pattern: str) -> tuple[list[str], bool]:
    """The literal pieces between a pattern's stars, and whether it is anchored at the end."""
    end = pattern.endswith("$")
    return (pattern[:-1] if end else pattern).split("*"), end


def matches(pattern: str, path: str) -> bool:
    """Whether path starts with the pattern. Each piece is looked for once, from where the one before it ended: the
    first place is always good enough, so the time is linear whatever the pattern."""
    parts, end = pieces(pattern)
    if not path.startswith(parts[0]):
        return False
    at = len(parts[0])
    if len(parts) == 1:
        return not end or at == len(path)
    for part in parts[1:-1] if end else parts[1:]:
        found = path.find(part, at)
        if found < 0:
            return False
        at = found + len(part)
    return not end or (len(path) - at >= len(parts[-1]) and path.endswith(parts[-1]))


def parse(body: str | None, agent: str = AGENT) -> Rules:
    """The group of the agent, else of '*'; groups that name the same agent are one."""
    groups: dict[str, Rules] = {}
    sitemaps, current, in_rules = [], [], False
    for line in (body or "").removeprefix("﻿").splitlines():
        name, colon, value = line.split("#", 1)[0].partition(":")
        name, value = name.strip().lower(), value.strip()
        if not colon:
            continue
        if name == "sitemap":
            if value:
                sitemaps.append(value)
        elif name == "user-agent":
            if in_rules:
                current, in_rules = [], False
            current.append(groups.setdefault(value.lower(), Rules()))
        elif name in ("allow", "disallow"):
            in_rules = True
            if value:
                for group in current:
                    group.rules.append((name == "allow", value))
        elif name == "crawl-delay":
            in_rules = True
            if re.fullmatch(r"\d+(?:\.\d+)?|\.\d+", value):
                for group in current:
                    group.delay = float(value)
    own = groups.get(agent.lower()) or groups.get("*") or Rules()
    return Rules(own.rules, None if own.delay is None else min(own.delay, LONGEST_DELAY), sitemaps)
