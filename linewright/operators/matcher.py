"""Matchers: regular expressions, token patterns and the whole line.

A matcher gives one array of texts per line, computed once: the groups from 0 on, or fewer
than two entries beyond them where the line doesn't match (see `Matcher.parts`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divides groups while they travel in one text: a noncharacter. A line that holds it takes a slower way.
MARK = "\ufdd0"
#: Named classes of bracket expressions.
CLASSES = {"alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "upper": "Upper", "xdigit": "XDigit"}
#: Escapes that mean the same here and there.
SAME = set("dDwWbBAzafnrtxQE") | set("\\.+*?()|[]{}^$/-\"'`~!@#%&=:;,<>_ ")


class MatchError(ValueError):
    pass


@dataclass
class Matcher:
    """`parts` matches and extracts in one go; `pattern` None is the whole line."""

    pattern: str | None
    names: dict[str, int] = field(default_factory=dict)
    count: int = 0
    whole: str | None = None  # the pattern as group 1, between whatever is before and after it
    first: int = 0  # the group that is {0}

    def parts(self, line: Column) -> Column:
        """Groups 0..count and one more entry where the line matches; otherwise one entry. `line` is named more than once."""
        if self.pattern is None:
            return F.array(line, F.lit(""))
        groups = range(self.first, self.first + self.count + 1)
        text = "".join(f"${i + (not self.first)}{MARK}" for i in groups)
        slow = F.when(line.rlike(self.pattern), F.array(*[F.regexp_extract(line, self.pattern, i) for i in groups], F.lit(""))).otherwise(F.array(line))
        return F.when(F.contains(line, F.lit(MARK)), slow).otherwise(F.split(F.regexp_replace(line, self.whole, text), MARK, -1))

    def test(self, line: Column) -> Column:
        return F.lit(True) if self.pattern is None else line.rlike(self.pattern)

    def group(self, line: Column, i: int) -> Column:
        return F.coalesce(F.get(self.parts(line), F.lit(i)), F.lit("")) if i <= self.count else F.lit("")


def always() -> Matcher:
    return Matcher(None)


def _translate(pattern: str, backtracking: bool, shift: int) -> tuple[str, dict[str, int], int]:
    """The pattern in Java's dialect, its names and its number of groups; `shift` is added to references."""
    names: dict[str, int] = {}
    out, i, n, inside, multi = "", 0, 0, False, [False]
    while i < len(pattern):
        c, rest = pattern[i], pattern[i:]
        if c == "\\":
            e = pattern[i + 1 : i + 2]
            if not e:
                raise MatchError("escape at the end")
            quoted = re.match(r"\\Q(.*?)(?:\\E|\Z)", rest, re.S)
            octal = re.match(r"\\(0[0-7]{0,2}|[1-7][0-7]{2})", rest)
            prop = re.match(r"\\([pP])(?:\{(\^?)(\w+)\}|(\w))", rest)
            named = re.match(r"\\k[<{'](\w+)[>}']", rest)
            if quoted and not inside:
                out, i = out + _quote(quoted[1]), i + quoted.end()
            elif rest.startswith("\\E"):
                i += 2
            elif prop:
                name = prop[3] or prop[4]
                kind = prop[1] if not prop[2] else {"p": "P", "P": "p"}[prop[1]]
                out, i = out + f"\\{kind}{{{name if len(name) < 3 else 'Is' + name}}}", i + prop.end()
            elif e == "s":
                out, i = out + ("\\t\\n\\f\\r " if inside else "[\\t\\n\\f\\r ]"), i + 2
            elif e == "S":
                out, i = out + "[^\\t\\n\\f\\r ]", i + 2
            elif e == "v":
                out, i = out + "\\x0B", i + 2
            elif octal:
                out, i = out + f"\\0{octal[1]}", i + octal.end()
            elif backtracking and e.isdigit():
                out, i = out + f"\\{int(e) + shift}", i + 2
            elif backtracking and named and named[1] in names:
                out, i = out + f"\\{names[named[1]] + shift}", i + named.end()
            elif e in SAME or backtracking or ord(e) > 127:
                out, i = out + rest[:2], i + 2
            else:
                raise MatchError(f"escape \\{e}")
            continue
        if inside:
            named = re.match(r"\[:(\^?)(\w+):\]", rest)
            if named:
                if named[2] == "word":
                    out += "\\W" if named[1] else "\\w"
                elif named[2] == "space":
                    out += "[^\\t\\n\\x0B\\f\\r ]" if named[1] else "\\t\\n\\x0B\\f\\r "
                elif named[2] in CLASSES:
                    out += f"\\{'P' if named[1] else 'p'}{{{CLASSES[named[2]]}}}"
                else:
                    raise MatchError(f"class {named[2]}")
                i += named.end()
                continue
            if c in "[&":  # plain here, nested or an intersection there
                c = "\\" + c
            inside = c != "]"
        elif c == "[":
            inside = True
            lead = re.match(r"\[\^?\]?", rest)[0]
            out, i = out + lead.replace("]", "\\]"), i + len(lead)
            continue
        elif c == "(":
            name = re.match(r"\(\?P?<([A-Za-z_]\w*)>", rest)
            flags = re.match(r"\(\?([a-zA-Z]*)(-[a-zA-Z]+)?([:)])", rest)
            if name:
                n += 1
                if name[1] in names:
                    raise MatchError(f"twice: {name[1]}")
                names[name[1]] = n
                out, i = out + "(", i + name.end()
                multi.append(multi[-1])
                continue
            if flags:
                if "U" in flags[1] + (flags[2] or ""):
                    raise MatchError("ungreedy flag")
                on = flags[1] + ("u" if "i" in flags[1] else "")
                m = "m" not in (flags[2] or "") and (multi[-1] or "m" in flags[1])
                if flags[3] == ":":
                    multi.append(m)
                else:
                    multi[-1] = m
                out, i = out + f"(?{on}{flags[2] or ''}{flags[3]}", i + flags.end()
                continue
            if rest.startswith("(?") and not backtracking:
                raise MatchError(f"group {rest[:3]}")
            n += not rest.startswith("(?") and not rest.startswith("(*")
            multi.append(multi[-1])
        elif c == ")":
            if len(multi) > 1:
                multi.pop()
        elif c == "$" and not multi[-1]:
            c = "\\z"
        elif c in "*+?}" and not backtracking and re.match(r"[*+?}]\+", rest):
            raise MatchError("repeated repetition")
        out += c
        i += 1
    return out, names, n


def regex(pattern: str, ignore_case: bool = False, backtracking: bool = False) -> Matcher:
    """First match, unanchored, leftmost and first alternative.

    The dialect is that of a linear engine: what needs backtracking is refused. `backtracking` allows
    look-around, references, atomic groups and possessive repetition, and then an empty line never matches.
    """
    flags = "(?diu)" if ignore_case else "(?d)"
    plain, names, n = _translate(pattern, backtracking, 0)
    shifted = _translate(pattern, backtracking, 1)[0]
    some = "(?=[\\s\\S])" if backtracking else ""
    return Matcher(flags + some + plain, names, n, f"\\A{some}(?s:.*?)({flags}{shifted})(?s:.*)\\z")


def longest(pattern: str, ignore_case: bool = False) -> Matcher:
    """Leftmost and longest match, as POSIX wants it; no built-in expression does this, so lines pass through Python in Arrow batches."""
    import regex as engine

    try:
        _, names, n = _translate(pattern, False, 0)
        engine.compile(pattern)
    except engine.error as e:
        raise MatchError(str(e)) from None
    return _Longest(pattern, names, n, "(?i)" if ignore_case else "")


class _Longest(Matcher):
    def parts(self, line: Column) -> Column:
        import pandas as pd

        pattern, flags = self.pattern, self.whole

        def find(lines):
            import regex as engine

            search = engine.compile(flags + pattern, engine.POSIX).search
            found = ((v, search(v)) for v in lines.fillna(""))
            return pd.Series([[m[0], *(g or "" for g in m.groups()), ""] if m else [v] for v, m in found])

        find.__annotations__ = {"lines": pd.Series, "return": pd.Series}
        return F.pandas_udf(find, "array<string>")(line)

    def test(self, line: Column) -> Column:
        return F.size(self.parts(line)) > 1


def dissect(pattern: str, ignore_case: bool = False) -> Matcher:
    """Literals in order after the first occurrence of the prefix, never reconsidered; %{?x} skips, %{} is numbered."""
    parts = re.split(r"%\{([^}]*)\}", pattern)
    if "%{" in "".join(parts[::2]):
        raise MatchError("unclosed token")
    literals, tokens = [p.split("%", 1)[0] for p in parts[::2]], parts[1::2]
    if any(not x for x in literals[1:-1]):
        raise MatchError("tokens without a literal between")
    names, n, body = {}, 1, ""
    for token, until in zip(tokens, literals[1:]):
        skip = token.startswith("?")
        if not skip:
            n += 1
            if token in names and token:
                raise MatchError(f"twice: {token}")
            if token:
                names[token] = n - 1
        group = "(?:.*?)" if skip else "(.*?)"
        quoted = _quote(until)
        body += f"(?>{group}{quoted})" if until else f"(?>{group.replace('?)', ')') if not skip else '(?:.*)'})"
    head = _quote(literals[0])
    flags = "(?siu)" if ignore_case else "(?s)"
    span = f"{flags}\\A(?>.*?(?={head}))({head}{body})" if literals[0] else f"{flags}\\A({body})"
    # group 1 of the pattern is the whole span
    return Matcher(span, names, n - 1, f"{span}.*\\z", 1)


def _quote(s: str) -> str:
    return "".join("\\" + c if not (c.isalnum() or ord(c) > 127 or c.isspace()) else c for c in s)
