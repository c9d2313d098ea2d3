"""Globs compiled to one regular expression on the driver; matching stays native."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str | None:
    """A Java regular expression for a glob; None if the glob is invalid.

    ``*`` and ``?`` also match ``/``, ``**`` must be a whole path component (as
    such it matches none, one or more of them), ``[...]`` is a class.
    """
    out, i, n = "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        if c == "*":
            j = i
            while j < n and pattern[j] == "*":
                j += 1
            if j - i > 2:
                return None
            if j - i == 2:
                if (i > 0 and pattern[i - 1] != "/") or (j < n and pattern[j] != "/"):
                    return None
                if j < n:  # "**/" is any number of folders
                    out += "(?:.*/)?"
                    i = j + 1
                    continue
            out += ".*"
            i = j
        elif c == "?":
            out += "."
            i += 1
        elif c == "[":
            end = pattern.find("]", i + 2 + (pattern[i + 1 : i + 2] == "!"))
            if end < 0:
                return None
            body = pattern[i + 1 : end]
            negate = body.startswith("!")
            body = body[1:] if negate else body
            out += "[" + "^" * negate + re.sub(r"([\\\[\]^&])", r"\\\1", body) + "]"
            i = end + 1
        else:
            out += re.escape(c) if not c.isalnum() and c not in "_/" else c
            i += 1
    return "(?s)^" + out + "$"


def glob_matches(path: Column, pattern: str, lenient: bool = False) -> Column:
    """Whether a path matches; an invalid glob matches nothing, or with ``lenient`` as a substring."""
    found = glob_regex(pattern)
    if found is not None:
        return path.rlike(found)
    if lenient:
        return path.contains(pattern.removeprefix("**/"))
    return F.lit(False)
