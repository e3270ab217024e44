"""JSON paths with wildcards, counts and members of all elements, on raw text.

A path is names and positions divided by dots; a backslash keeps the next character plain, `*` and `?`
match in names, `#` is the number of elements, or before more steps all of them. What is found is given
as it is written: texts without quotes, objects and arrays with their own blanks.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

_BLANK = re.compile(r"[ \t\n\r]*")
_DECODER = json.JSONDecoder()


def steps(path: str) -> list[tuple[str, re.Pattern | None]]:
    """(name, pattern of a name with wildcards) of each step."""
    out, name, pattern, wild, i = [], "", "", False, 0
    while i <= len(path):
        c = path[i : i + 1]
        if c in ("", "."):
            out.append((name, re.compile(pattern + r"\Z", re.S) if wild else None))
            name, pattern, wild = "", "", False
        elif c == "\\" and i + 1 < len(path):
            i += 1
            name, pattern = name + path[i], pattern + re.escape(path[i])
        else:
            wild |= c in "*?"
            name, pattern = name + c, pattern + {"*": ".*", "?": "."}.get(c, re.escape(c))
        i += 1
    return out


def _skip(text: str, at: int) -> int:
    return _BLANK.match(text, at).end()


def _end(text: str, at: int) -> int:
    return _DECODER.raw_decode(text, at)[1]


def members(text: str, at: int) -> Iterator[tuple[str | None, int]]:
    """(name or None, place) of each value in the object or array at a place."""
    close = "}" if text[at] == "{" else "]"
    at = _skip(text, at + 1)
    while text[at] != close:
        name = None
        if close == "}":
            name, at = scanstring(text, at + 1)
            at = _skip(text, _skip(text, at) + 1)
        yield name, at
        at = _skip(text, _end(text, at))
        if text[at] == ",":
            at = _skip(text, at + 1)


def _found(text: str, at: int, path: list) -> str | None:
    """Raw text of the value a path leads to."""
    if not path:
        return text[at : _end(text, at)]
    (name, pattern), rest = path[0], path[1:]
    if text[at] not in "{[":
        return None
    if text[at] == "[":
        if name == "#":
            if not rest:
                return str(sum(1 for _ in members(text, at)))
            return "[" + ",".join(x for _, place in members(text, at) if (x := _found(text, place, rest)) is not None) + "]"
        if not name.isdigit():
            return None
        return next((_found(text, place, rest) for i, (_, place) in enumerate(members(text, at)) if i == int(name)), None)
    return next((_found(text, place, rest) for key, place in members(text, at) if (pattern.match(key) if pattern else key == name)), None)


def find(text: str | None, path: list) -> str:
    """The value a path leads to, or nothing; a text that is no JSON has no values."""
    try:
        raw = _found(text, _skip(text, 0), path) if text else None
    except (ValueError, IndexError, RecursionError):
        return ""
    if raw is None or raw == "null":
        return ""
    return json.loads(raw) if raw[0] == '"' else raw
