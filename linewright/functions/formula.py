"""Formulas: infix arithmetic over DOUBLE columns, parsed on the driver."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


class FormulaError(ValueError):
    pass



def _truth(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def _mod(a, b):
    b = b.cast("long")
    return F.when(b != 0, F.try_mod(a.cast("long"), F.when(b != 0, b))).cast("double")


def _divide(a, b):
    inf, nan = F.lit(float("inf")), F.lit(float("nan"))
    return F.when(b != 0, F.try_divide(a, b)).when(a > 0, inf).when(a < 0, -inf).otherwise(nan)


#: Operators of each level, from tight to loose; all associate to the left.
LEVELS: list[dict[str, Callable]] = [
    {"^": F.pow},
    {">>": lambda a, b: F.call_function("shiftright", a.cast("long"), b.cast("int")).cast("double"), "<<": lambda a, b: F.call_function("shiftleft", a.cast("long"), b.cast("int")).cast("double")},
    {"*": lambda a, b: a * b, "/": _divide, "%": _mod},
    {"&": lambda a, b: a.cast("long").bitwiseAND(b.cast("long")).cast("double"), "|": lambda a, b: a.cast("long").bitwiseOR(b.cast("long")).cast("double")},
    {"+": lambda a, b: a + b, "-": lambda a, b: a - b},
    {"==": lambda a, b: _truth(a == b), "<=": lambda a, b: _truth(a <= b), ">=": lambda a, b: _truth(a >= b), ">": lambda a, b: _truth(a > b), "<": lambda a, b: _truth(a < b)},
    {"&&": lambda a, b: _truth((a != 0) & (b != 0)), "||": lambda a, b: _truth((a != 0) | (b != 0))},
]
#: Unary operators.
UNARY: dict[str, Callable] = {
    "-": lambda a: -a, "!": lambda a: _truth(a == 0), "abs": F.abs, "sin": F.sin, "asin": F.asin, "cos": F.cos, "acos": F.acos, "tan": F.tan, "atan": F.atan,
    "sqrt": F.sqrt, "floor": lambda a: F.floor(a).cast("double"), "ceil": lambda a: F.ceil(a).cast("double"), "round": lambda a: F.round(a), "exp": F.exp,
    "exp2": lambda a: F.pow(F.lit(2.0), a), "log": F.ln, "log10": F.log10, "log2": F.log2,
}
_TOKEN = re.compile(r"\s*(?:(0[xX][0-9a-fA-F]+|0[bB][01]+|0[oO][0-7]+|\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|\[([^\]]*)\]|([A-Za-z][A-Za-z0-9]*)|(&&|\|\||==|<=|>=|<<|>>|[-+*/%^&|<>!()]))")


def compile_formula(text: str, variable: Callable[[str], Column]) -> Column:
    """A DOUBLE column; `variable` gives the column of [name], [0] or a bare name."""
    tokens, at = [], 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise FormulaError(f"unexpected {text[at:]!r}")
        tokens.append(next((k, v) for k, v in zip(("number", "bracket", "name", "op"), m.groups()) if v is not None))
        at = m.end()
    place = 0

    def peek():
        return tokens[place] if place < len(tokens) else (None, None)

    def take():
        nonlocal place
        if place >= len(tokens):
            raise FormulaError("unexpected end")
        place += 1
        return tokens[place - 1]

    def group():
        out = level(len(LEVELS) - 1)
        if take() != ("op", ")"):
            raise FormulaError("unclosed parenthesis")
        return out

    def atom():
        kind, v = take()
        if kind == "op" and v in "-!":
            return UNARY[v](atom())
        if kind == "name" and v.lower() in UNARY and peek() == ("op", "("):
            return UNARY[v.lower()](atom())
        if kind == "op" and v == "(":
            out = group()
        elif kind == "number":
            out = F.lit(float(int(v, 0)) if v[:2].lower() in ("0x", "0b", "0o") else float(v))
        elif kind in ("bracket", "name"):
            return variable(v)
        else:
            raise FormulaError(f"unexpected {v}")
        while peek() == ("op", "("):  # implied product
            take()
            out = out * group()
        return out

    def level(n):
        if n < 0:
            return atom()
        out = level(n - 1)
        while peek()[0] == "op" and peek()[1] in LEVELS[n]:
            op = LEVELS[n][take()[1]]
            out = op(out, level(n - 1))
        return out

    out = level(len(LEVELS) - 1)
    if place < len(tokens):
        raise FormulaError("unopened parenthesis" if tokens[place][1] == ")" else f"expected an operator, found {tokens[place][1]}")
    return out
