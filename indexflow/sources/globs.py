"""Glob patterns over paths, as regular expressions inside the plan."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """The anchored regular expression of a glob: * and ? cross slashes, **/ is any folders or none, [..] and {a,b} as usual."""
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out.append("(?:.*/)?")
            i += 3
            continue
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
            while pattern.startswith("*", i + 1):
                i += 1
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close]
            body = "^" + body[1:] if body[0] in "!^" else body
            out.append("[" + re.sub(r"([\\\[\]&])", r"\\\1", body) + "]")
            i = close
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"a brace isn't closed in {pattern!r}")
    return f"^(?s:{''.join(out)})$"


def any_glob(path: Column, patterns: list[str]) -> Column:
    return F.lit(False) if not patterns else path.rlike("|".join(glob_regex(p) for p in patterns))


def matches(path: Column, included: list[str] | None, excluded: list[str] | None, *, prune: bool = True) -> Column:
    """Whether a relative path is included, by any pattern or for want of patterns, and not excluded.

    With ``prune`` an excluded folder excludes all that is below it.
    """
    keep = any_glob(path, included) if included else F.lit(True)
    if not excluded:
        return keep
    keep = keep & ~any_glob(path, excluded)
    if prune:
        parts = F.split(path, "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        keep = keep & ~F.exists(above, lambda p: any_glob(p, excluded))
    return keep
