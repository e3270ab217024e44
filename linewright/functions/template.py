"""Templates: literal text with {variable} and {function argument ...} parts, parsed on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field


class TemplateError(ValueError):
    """A template that cannot be compiled; `code` is the short in-band name of the fault."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code} {detail}".strip())
        self.code = code


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = field(default_factory=tuple)  # of Template


@dataclass(frozen=True)
class Template:
    parts: tuple

    @property
    def constant(self) -> str | None:
        """The text where no part depends on a row."""
        return "".join(p.value for p in self.parts) if all(isinstance(p, Text) for p in self.parts) else None


_ESCAPES = {"n": "\n", "r": "\r", "t": "\t"}


def split_arguments(body: str) -> list[tuple[str, bool]]:
    """Words of a call, honouring quotes, braces and backslashes; (word, was quoted)."""
    out, word, quote, depth, quoted, i = [], "", "", 0, False, 0
    while i < len(body):
        c = body[i]
        if c == "\\":
            if i + 1 >= len(body):
                raise TemplateError("escape", "at the end")
            word += body[i : i + 2] if not quote or depth else "\\" + body[i + 1]
            i += 2
            continue
        if quote:
            if c == quote:
                quote = ""
            else:
                word += c
        elif depth == 0 and c in "\"'":
            quote, quoted = c, True
        elif depth == 0 and c in " \t\n":
            if word or quoted:
                out.append((word, quoted))
            word, quoted = "", False
        else:
            depth += (c == "{") - (c == "}")
            word += c
        i += 1
    if quote or depth:
        raise TemplateError("unclosed", body)
    if word or quoted:
        out.append((word, quoted))
    return out


def parse(text: str) -> Template:
    parts, plain, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            if i + 1 >= len(text):
                raise TemplateError("escape", "at the end")
            plain += _ESCAPES.get(text[i + 1], text[i + 1])
            i += 2
        elif c == "{":
            depth, j, quote = 1, i + 1, ""
            while j < len(text) and depth:
                d = text[j]
                if d == "\\":
                    j += 1
                elif quote:
                    quote = "" if d == quote else quote
                elif d in "\"'" and text[j - 1] in " \t\n":
                    quote = d
                else:
                    depth += (d == "{") - (d == "}")
                j += 1
            if depth:
                raise TemplateError("unclosed", text)
            words = split_arguments(text[i + 1 : j - 1])
            if not words:
                raise TemplateError("empty", text)
            if plain:
                parts.append(Text(plain))
                plain = ""
            parts.append(Var(words[0][0]) if len(words) == 1 else Call(words[0][0], tuple(parse(w) for w, _ in words[1:])))
            i = j
        elif c == "}":
            raise TemplateError("unopened", text)
        else:
            plain += c
            i += 1
    if plain:
        parts.append(Text(plain))
    return Template(tuple(parts))


#: Functions whose arguments from this place on have variables {0}, {1}, ... of their own.
SCOPED = {"@map": 1, "@filter": 1, "@reduce": 1, "@for": 1}


def substitute(t: Template, args: tuple) -> Template:
    """The template with {0}, {1}, ... replaced by args: how user functions expand. Sub-expressions with variables of their own keep them."""
    parts: list = []
    for p in t.parts:
        if isinstance(p, Var) and p.name.isdigit():
            parts += args[int(p.name)].parts if int(p.name) < len(args) else ()
        elif isinstance(p, Call):
            own = SCOPED.get(p.name, len(p.args))
            parts.append(Call(p.name, tuple(substitute(a, args) if i < own else a for i, a in enumerate(p.args))))
        else:
            parts.append(p)
    return Template(tuple(parts))


def load_functions(text: str, known: dict[str, Template] | None = None) -> dict[str, Template]:
    """User functions, one `name template` per line; # starts a comment, a trailing backslash joins lines."""
    out, line = dict(known or {}), ""
    for raw in text.splitlines():
        line += raw.split("#", 1)[0].rstrip()
        if line.endswith("\\"):
            line = line[:-1]
            continue
        name, _, body = line.strip().partition(" ")
        if name:
            out[name] = parse(body.strip())
        line = ""
    return out
