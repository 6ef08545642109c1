"""Gitignore-style path patterns as one regular expression each."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(glob: str) -> str:
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", r"\\")
            out.append("[" + ("^" + body[1:] if body[0] in "!^" else body) + "]")
            i = end
        elif ch == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(ch))
        i += 1
    return "".join(out)


def to_regex(pattern: str) -> str | None:
    """Regular expression over a relative path; None for comments and blanks.

    A pattern with an inner or leading slash is anchored at the root, others
    match at any depth; a match covers everything below it; a trailing slash
    asks for a directory.
    """
    body = pattern.rstrip()
    if not body or body.startswith("#"):
        return None
    directory_only = body.endswith("/")
    body = body.rstrip("/")
    anchored = "/" in body
    parts = [p for p in body.split("/") if p]
    if not parts:
        return None
    regex = "^" if anchored else "^(?:.*/)?"
    for position, part in enumerate(parts):
        last = position == len(parts) - 1
        if part == "**":
            regex += ".+" if last else "(?:.*/)?"
        else:
            regex += _segment(part) + ("" if last else "/")
    if parts[-1] == "**":
        return regex + "$"
    return regex + ("/.*$" if directory_only else "(?:/.*)?$")


def is_excluded(path: Column, patterns: list[str]) -> Column:
    """True when the last pattern that matches excludes (``!p`` re-includes)."""
    verdict = F.lit(False)
    for pattern in patterns:
        negated = pattern.startswith("!")
        regex = to_regex(pattern[1:] if negated else pattern)
        if regex is not None:
            verdict = F.when(path.rlike(regex), F.lit(not negated)).otherwise(verdict)
    return verdict
