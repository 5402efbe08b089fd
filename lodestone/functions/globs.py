"""File patterns compiled to a folder to start from and an expression on relative paths."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Glob:
    """``folder`` below the base that holds all matches, ``regex`` for paths relative to the base,
    whether folders below ``folder`` must be looked into, and a pattern of names that a lister can apply."""

    folder: str
    regex: str
    deep: bool
    names: str | None


def _part(part: str) -> str:
    """The expression of one name of a path."""
    out, i = "", 0
    while i < len(part):
        c = part[i]
        i += 1
        if c == "*":
            while part[i : i + 1] == "*":
                i += 1
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", i + 1 + (part[i : i + 1] == "!"))) > 0:
            inner = part[i:end]
            inner = ("^" + inner[1:]) if inner.startswith("!") else inner
            out += "[" + re.sub(r"([\[\\&~|])", r"\\\1", inner if not inner.startswith("^") or part[i] == "!" else "\\" + inner) + "]"
            i = end + 1
        else:
            out += re.escape(c)
    return out


def compiled(pattern: str) -> Glob:
    """``*`` and ``?`` stay within a name, ``[a-c]`` and ``[!a-c]`` are sets, a name ``**`` stands for any number of folders.

    At the end ``**`` stands for all files below. Names that begin with a dot are matched like others.
    """
    parts = [p for p in pattern.split("/") if p not in ("", ".")]
    fixed = 0
    while fixed < len(parts) - 1 and not re.search(r"[*?\[]", parts[fixed]):
        fixed += 1
    regex = ""
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p == "**":
            regex += ".+" if last else "(?:[^/]+/)*"
        else:
            regex += _part(p) + ("" if last else "/")
    name = parts[-1] if parts else "**"
    return Glob("/".join(parts[:fixed]), f"^{regex or '.+'}$", len(parts) - fixed > 1 or name == "**", name if re.fullmatch(r"[^\[\]{}\\]+", name) and name != "**" else None)
