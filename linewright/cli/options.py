"""Options of the command line: long and short names, values that may begin with a dash, joined switches."""

from __future__ import annotations

from dataclasses import dataclass, field


class UsageError(ValueError):
    pass


@dataclass(frozen=True)
class Option:
    name: str
    short: tuple[str, ...] = ()
    kind: str = "switch"  # switch, text, int, float, list
    default: object = None

    def value(self, text: str):
        try:
            return {"text": str, "list": str, "int": int, "float": float}[self.kind](text)
        except ValueError:
            raise UsageError(f"invalid value {text!r} for --{self.name}") from None


@dataclass
class Parsed:
    values: dict = field(default_factory=dict)
    given: set = field(default_factory=set)
    rest: list = field(default_factory=list)

    def __getitem__(self, name: str):
        return self.values[name]


def parse(options: list[Option], args: list[str]) -> Parsed:
    """Options and plain arguments may be mixed; `--` ends the options."""
    by = {n: o for o in options for n in (o.name, *o.short)}
    out = Parsed({o.name: [] if o.kind == "list" else (o.default if o.kind != "switch" else bool(o.default)) for o in options})
    queue = list(args)

    def put(o: Option, given: str | None):
        if o.kind == "switch":
            out.values[o.name] = given is None or given.lower() in ("true", "1", "t")
        else:
            if given is None:
                if not queue:
                    raise UsageError(f"--{o.name} needs a value")
                given = queue.pop(0)
            if o.kind == "list":
                out.values[o.name].append(o.value(given))
            else:
                out.values[o.name] = o.value(given)
        out.given.add(o.name)

    while queue:
        a = queue.pop(0)
        if a == "--":
            out.rest += queue
            break
        if a == "-" or not a.startswith("-"):
            out.rest.append(a)
            continue
        name, eq, value = a.lstrip("-").partition("=")
        if name in by:
            put(by[name], value if eq else None)
        elif not a.startswith("--") and all(c in by for c in name):
            for i, c in enumerate(name):  # joined: all but the last are switches
                if i < len(name) - 1 and by[c].kind != "switch":
                    raise UsageError(f"-{c} needs a value")
                put(by[c], value if eq and i == len(name) - 1 else None)
        else:
            raise UsageError(f"unknown option {a}")
    for o in options:
        if o.kind == "list" and o.name not in out.given and o.default:
            out.values[o.name] = list(o.default)
    return out
