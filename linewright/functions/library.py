"""The template functions as rules that lower a call to a STRING column; nothing here runs per row in Python.

Missing is the empty text. A value of the wrong kind gives BAD in the row; a faulty call
(number of arguments, non-constant where a constant is due) raises on the driver.
Arrays are texts joined by NUL. Overflow gives BAD.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .formula import FormulaError, compile_formula
from .template import Call, Template, TemplateError, Text, Var, parse, substitute

BAD, PARSE, NUL = "<BAD-TYPE>", "<PARSE-ERROR>", "\0"
RULES: dict[str, Callable] = {}


class Context:
    """What variables mean; `functions` are user templates.

    `stage`, where given, collects columns that several templates share, such as a parsed time;
    `staged` adds them to a table, where each is computed once a row.
    """

    def __init__(self, variable: Callable[[str], Column], functions: dict[str, Template] | None = None, load: bool = True, stage: dict | None = None, scope: tuple = ()):
        self.variable, self.functions, self.load, self.stage, self.scope = variable, functions or {}, load, stage, scope

    def inner(self, **names) -> Context:
        return Context(lambda n: names.get(f"v{n}", None) if f"v{n}" in names else self.variable(n), self.functions, self.load, None, self.scope)

    def once(self, key, make: Callable[[], Column]) -> Column:
        """make(), as a column of its own where the same key is asked for again."""
        if self.stage is None:
            return make()
        if key not in self.stage:
            self.stage[key] = (f"_s{len(self.stage)}", make())
        return F.col(self.stage[key][0])

    def let(self, value: Column, use: Callable[[Column], Column], key=None) -> Column:
        """use(value) with the value evaluated once a row: as a column of its own, or bound within an expression."""
        if self.stage is None:
            return bound(value, use)
        return use(self.once(key or ("let", len(self.stage)), lambda: value))

    def staged(self, rows):
        """rows with the columns, each of which may use those before it."""
        for name, column in (self.stage or {}).values():
            rows = rows.withColumn(name, column)
        return rows


def rule(*names, low=None, high=None):
    def wrap(f):
        for n in names:
            RULES[n] = (f, low, high)
        return f

    return wrap


def lower_template(t: Template, ctx: Context) -> Column:
    parts = [lower_part(p, ctx) for p in t.parts]
    if not parts:
        return F.lit("")
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def lower_part(p, ctx: Context) -> Column:
    if isinstance(p, Text):
        return F.lit(p.value)
    if isinstance(p, Var):
        return ctx.variable(p.name)
    if p.name in ctx.functions:
        return lower_template(substitute(ctx.functions[p.name], p.args), ctx)
    if p.name not in RULES:
        raise TemplateError("function", p.name)
    f, low, high = RULES[p.name]
    if (low is not None and len(p.args) < low) or (high is not None and len(p.args) > high):
        raise TemplateError("arguments", f"of {p.name}: {len(p.args)}")
    return f(ctx, p.name, p.args)


def compile_template(text: str, variable, functions=None) -> Column:
    return lower_template(parse(text), Context(variable, functions))


def const(t: Template, what: str = "constant") -> str:
    if t.constant is None:
        raise TemplateError("constant", what)
    return t.constant


def const_int(t: Template) -> int:
    try:
        return int(const(t))
    except ValueError:
        raise TemplateError("number", const(t)) from None


# kinds -------------------------------------------------------------------------------

INT, NUM = r"^[+-]?[0-9]+\z", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
_NUMBER = r"(?i)^(?:[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|[+-]?inf(?:inity)?|nan)\z"


def fitting(c: Column, pattern: str) -> Column:
    """c where the pattern fits, otherwise null: a cast of other text, the empty one too, would cost an exception a row."""
    return F.get(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(0))


def as_int(c: Column) -> Column:
    """A BIGINT, null for other text; c is named once, so that it is computed once."""
    known = vars(c).get("_integer")
    return known if known is not None else fitting(c, INT).try_cast("bigint")


def as_num(c: Column) -> Column:
    known = vars(c).get("_number")  # text that num_text made: the number itself, without reading it back
    if known is None and "_integer" in vars(c):
        known = vars(c)["_integer"].cast("double")
    return known if known is not None else fitting(c, _NUMBER).try_cast("double")


def int_text(v: Column) -> Column:
    """The text of a BIGINT, or BAD; further functions take the number without reading it back."""
    out = text(v)
    out._integer = v
    return out


def text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(BAD))


def bound(c: Column, use) -> Column:
    """use(c) with c evaluated once a row, however often `use` names it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def num_text(ctx, d: Column) -> Column:
    """Shortest digits, never an exponent."""
    d = ctx.let(d, lambda v: v)
    out = F.coalesce(ctx.let(d.cast("string"), _digits), F.lit(BAD))
    out._number = d
    return out


def _digits(s: Column) -> Column:
    """Spark's text of a double without `.0` and exponents."""
    plain = F.regexp_replace(s.try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    exponent = bound(plain, lambda p: F.when(F.abs(s.cast("double")) >= 1e20, F.format_string("%.0f", s.cast("double"))).when(p == "", "0").otherwise(F.coalesce(p, s)))
    return F.when(s.endswith(".0"), F.left(s, F.length(s) - 2)).when(s == "Infinity", "+Inf").when(s == "-Infinity", "-Inf").when(F.contains(s, F.lit("E")), exponent).otherwise(s)


def truthy(c: Column) -> Column:
    return c.rlike(r"\S")


def flag(c: Column) -> Column:
    return F.when(c, "1").otherwise("")


def args_of(ctx, args):
    return [lower_template(a, ctx) for a in args]


def items(c: Column) -> Column:
    return F.split(c, NUL, -1)


def joined(c: Column) -> Column:
    return F.array_join(c, NUL)


# conditions --------------------------------------------------------------------------

@rule("coalesce")
def _coalesce(ctx, _, args):
    return F.coalesce(*[F.nullif(a, F.lit("")) for a in args_of(ctx, args)], F.lit(""))


@rule("if", low=2, high=3)
def _if(ctx, _, args):
    c, a, *b = args_of(ctx, args)
    return F.when(truthy(c), a).otherwise(b[0] if b else F.lit(""))


@rule("unless", low=2, high=2)
def _unless(ctx, _, args):
    c, a = args_of(ctx, args)
    return F.when(~truthy(c), a).otherwise("")


@rule("switch", low=2)
def _switch(ctx, _, args):
    a = args_of(ctx, args)
    out = a[-1] if len(a) % 2 else F.lit("")
    for i in range(len(a) // 2 * 2 - 2, -1, -2):
        out = F.when(truthy(a[i]), a[i + 1]).otherwise(out)
    return out


@rule("eq", "neq", low=2)
def _equal(ctx, name, args):
    return functools.reduce(lambda x, y: flag(x == y if name == "eq" else x != y), args_of(ctx, args))


@rule("not", low=1, high=1)
def _not(ctx, _, args):
    return flag(~truthy(args_of(ctx, args)[0]))


@rule("lt", "gt", "lte", "gte", low=2, high=2)
def _compare(ctx, name, args):
    for t in args:
        if t.constant is not None and not re.match(NUM.replace(r"\z", "$"), t.constant):
            raise TemplateError("number", t.constant)
    a, b = (as_num(x) for x in args_of(ctx, args))
    test = {"lt": a < b, "gt": a > b, "lte": a <= b, "gte": a >= b}[name]
    return F.when(a.isNull() | b.isNull(), BAD).when(F.isnan(a) | F.isnan(b), "").otherwise(flag(test))


@rule("and", "or", low=1)
def _logic(ctx, name, args):
    tests = [a != "" for a in args_of(ctx, args)]
    return flag(functools.reduce((lambda x, y: x & y) if name == "and" else (lambda x, y: x | y), tests))


@rule("like", "prefix", "suffix", low=2, high=2)
def _like(ctx, name, args):
    a, b = args_of(ctx, args)
    return F.when({"like": F.contains, "prefix": F.startswith, "suffix": F.endswith}[name](a, b), a).otherwise("")


@rule("isint", "isnum", low=1, high=1)
def _is(ctx, name, args):
    a = args_of(ctx, args)[0]
    return flag((as_int if name == "isint" else as_num)(a).isNotNull())


# numbers -----------------------------------------------------------------------------

def _known(a, b, out):
    return F.when(a.isNotNull() & b.isNotNull(), out)


_INTS = {
    "sumi": F.try_add, "subi": F.try_subtract, "multi": F.try_multiply,
    "maxi": lambda a, b: _known(a, b, F.greatest(a, b)), "mini": lambda a, b: _known(a, b, F.least(a, b)),
}


def _truncdiv(a, b):
    """Whole quotient toward zero, exact on BIGINT; null for a zero divisor."""
    safe = F.when(b != 0, b)
    return F.when(safe == -1, F.try_subtract(F.lit(0).cast("bigint"), a)).otherwise(F.try_divide((a - a % safe).cast("decimal(20,0)"), safe.cast("decimal(20,0)")).cast("bigint"))


_INTS["divi"] = lambda a, b: _known(a, b, F.when(b == 0, F.lit(2**63 - 1)).otherwise(_truncdiv(a, b)))
_INTS["modi"] = lambda a, b: _known(a, b, F.when(b == 0, F.lit(0).cast("bigint")).otherwise(a % F.when(b != 0, b)))


@rule(*_INTS, low=2)
def _ints(ctx, name, args):
    known = [as_int(a) for a in args_of(ctx, args)]
    if name not in ("sumi", "subi", "multi"):  # these name their arguments more than once
        return int_text(functools.reduce(lambda x, y: ctx.let(x, lambda a: ctx.let(y, lambda b: _INTS[name](a, b))), known))
    return int_text(functools.reduce(_INTS[name], known))


def _float_divide(a, b):
    inf = F.lit(float("inf"))
    return F.when(a.isNull() | b.isNull(), None).when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), F.lit(float("nan"))).when(a > 0, inf).otherwise(-inf)


_FLOATS = {"sumf": lambda a, b: a + b, "subf": lambda a, b: a - b, "multf": lambda a, b: a * b, "divf": _float_divide, "pow": F.pow}


@rule(*_FLOATS, low=2)
def _floats(ctx, name, args):
    return num_text(ctx, functools.reduce(_FLOATS[name], [as_num(a) for a in args_of(ctx, args)]))


def _log(f):
    return lambda v: F.when(v == 0, F.lit(float("-inf"))).when(v < 0, F.lit(float("nan"))).otherwise(f(v))


_UNARY = {"log10": _log(F.log10), "log2": _log(F.log2), "ln": _log(F.ln), "sqrt": lambda v: F.when(v < 0, F.lit(float("nan"))).otherwise(F.sqrt(v))}


@rule(*_UNARY, low=1, high=1)
def _unary(ctx, name, args):
    return num_text(ctx, ctx.let(as_num(args_of(ctx, args)[0]), _UNARY[name]))


@rule("floor", "ceil", low=1, high=1)
def _whole(ctx, name, args):
    v = as_num(args_of(ctx, args)[0])
    return text((F.floor if name == "floor" else F.ceil)(v).cast("bigint"))


def fixed(v: Column, places: int) -> Column:
    """Half-even decimal text with `places` digits."""
    return F.replace(F.format_number(v, places), F.lit(","), F.lit(""))


@rule("round", low=1, high=2)
def _round(ctx, _, args):
    places = const_int(args[1]) if len(args) > 1 else 0
    return text(fixed(as_num(args_of(ctx, args[:1])[0]), places))


def _bucket_start(v, size):
    s = F.lit(size).cast("bigint")
    return v - v % s - F.when(v < 0, s).otherwise(F.lit(0))


@rule("bucket", "bucketrange", low=2, high=2)
def _bucket(ctx, name, args):
    size = const_int(args[1])
    if size <= 0:
        raise TemplateError("value", str(size))
    start = ctx.let(as_int(args_of(ctx, args[:1])[0]), lambda v: _bucket_start(v, size))
    return int_text(start) if name == "bucket" else text(F.concat(start.cast("string"), F.lit(" - "), (start + (size - 1)).cast("string")))


@rule("expbucket", low=1, high=1)
def _expbucket(ctx, _, args):
    v = as_int(args_of(ctx, args)[0])
    return text(F.when(v > 0, F.rpad(F.lit("1"), F.length(v.cast("string")), "0")).when(v.isNotNull(), "0"))


@rule("clamp", low=3, high=3)
def _clamp(ctx, _, args):
    a = args_of(ctx, args[:1])[0]
    v, lo, hi = as_int(a), const_int(args[1]), const_int(args[2])
    return ctx.let(v, lambda n: F.when(n.isNull(), BAD).when(n < lo, "min").when(n > hi, "max").otherwise(a))


@rule("!", low=1)
def _formula(ctx, _, args):
    try:
        number = lambda n: ctx.once(("number", ctx.scope, n), lambda: as_num(ctx.variable(n)))
        out = compile_formula("".join(const(a) for a in args), number)
    except FormulaError as e:
        raise TemplateError("formula", str(e)) from None
    return num_text(ctx, out)


# text --------------------------------------------------------------------------------

@rule("len", low=1, high=1)
def _len(ctx, _, args):
    return F.octet_length(args_of(ctx, args)[0]).cast("string")


@rule("upper", "lower", low=1, high=1)
def _case(ctx, name, args):
    return (F.upper if name == "upper" else F.lower)(args_of(ctx, args)[0])


def _bytes_slice(s: Column, start: Column, n: Column) -> Column:
    return F.substring(s.cast("binary"), start.cast("int") + 1, n.cast("int")).cast("string")


@rule("substr", low=2, high=3)
def _substr(ctx, _, args):
    s, left, *rest = args_of(ctx, args)
    size, at = F.octet_length(s), as_int(left)
    n = as_int(rest[0]) if rest else F.lit(-1)
    start = F.greatest(F.when(at < 0, at + size).otherwise(at), F.lit(0))
    count = F.when(n < 0, size).otherwise(n)
    return F.when(s == "", "").when(at.isNull() | n.isNull(), BAD).when(start >= size, "").otherwise(_bytes_slice(s, start, F.least(count, size)))


@rule("index", "lastindex", low=2, high=2)
def _index(ctx, name, args):
    s, x = args_of(ctx, args)
    if name == "index":
        return F.when(F.contains(s, x), F.octet_length(F.left(s, F.call_function("instr", s, x) - 1))).otherwise(-1).cast("string")
    back = F.call_function("instr", F.reverse(s), F.reverse(x))
    return F.when(back == 0, -1).otherwise(F.octet_length(F.left(s, F.length(s) - back - F.length(x) + 1))).cast("string")


@rule("replace", low=3, high=3)
def _replace(ctx, _, args):
    whole, old, new = args_of(ctx, args)
    between = F.concat(new, F.regexp_replace(whole, "(?s)(.)", F.concat(F.lit("$1"), F.regexp_replace(new, r"([\\\\$])", r"\\\\$1"))))
    if args[1].constant == "":  # before each character and at the end
        return between
    return F.replace(whole, old, new) if args[1].constant else F.when(old == "", between).otherwise(F.replace(whole, old, new))


@rule("pick", low=3, high=3)
def _pick(ctx, _, args):
    s, _, i = args_of(ctx, args)
    at = as_int(i)
    return F.when(at.isNull(), BAD).otherwise(F.split_part(s, F.lit(const(args[1])), (F.greatest(at, F.lit(0)) + 1).cast("int")))


@rule("select", low=2, high=2)
def _select(ctx, _, args):
    s, i = args_of(ctx, args)
    at = as_int(i)
    found = F.regexp_extract_all(s, F.lit(r'("[^"]*"|[^ \t\n\x00]+)'), F.lit(1))
    return F.when(at.isNull(), BAD).otherwise(F.coalesce(F.regexp_replace(F.get(found, F.greatest(at, F.lit(0)).cast("int")), '^"|"$', ""), F.lit("")))


@rule("format", low=1)
def _format(ctx, _, args):
    rest, out, at, used = args_of(ctx, args[1:]), [], 0, 0
    pattern = const(args[0])
    for m in re.finditer(r"%([-+# 0]*)(\d*)(?:\.(\d+))?([a-zA-Z%])?", pattern):
        out.append(F.lit(pattern[at : m.start()]))
        at = m.end()
        flags, width, places, verb = m.groups()
        if verb == "%":
            out.append(F.lit("%"))
            continue
        if verb is None:
            out.append(F.lit("%!(NOVERB)"))
            continue
        if used >= len(rest):
            out.append(F.lit(f"%!{verb}(MISSING)"))
            continue
        a, used = rest[used], used + 1
        if verb in "sv":
            v = F.left(a, F.lit(int(places))) if places else a
        elif verb == "q":
            v = _quoted(a)
        elif verb in "xX":
            v = (F.hex if verb == "X" else lambda c: F.lower(F.hex(c)))(a.cast("binary"))
        else:  # every value is a text
            v = F.concat(F.lit(f"%!{verb}(string="), a, F.lit(")"))
        if width:
            n = F.greatest(F.lit(int(width)), F.length(v))
            v = F.rpad(v, n, " ") if "-" in flags else F.lpad(v, n, "0" if "0" in flags else " ")
        out.append(v)
    out.append(F.lit(pattern[at:]))
    if used < len(rest):
        extra = [F.concat(F.lit("string="), a) for a in rest[used:]]
        out += [F.lit("%!(EXTRA "), F.concat_ws(", ", *extra), F.lit(")")]
    return F.concat(*out)


def _quoted(a: Column) -> Column:
    """In double quotes, with backslashes where a source text needs them."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\0", "\\x00")):
        a = F.replace(a, F.lit(plain), F.lit(escaped))
    return F.concat(F.lit('"'), a, F.lit('"'))


@rule("repeat", low=2, high=2)
def _repeat(ctx, _, args):
    n = as_int(args_of(ctx, args[1:])[0])
    return F.when(n.isNull(), BAD).otherwise(F.repeat(F.lit(const(args[0])), F.greatest(n, F.lit(0)).cast("int")))


@rule("tab")
def _tab(ctx, _, args):
    return F.concat_ws("\t", *args_of(ctx, args))


@rule("csv")
def _csv(ctx, _, args):
    quoted = [F.when(a.rlike("[\"\r\n,]"), F.concat(F.lit('"'), F.replace(a, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(a) for a in args_of(ctx, args)]
    return F.concat_ws(",", *quoted)


@rule("basename", "dirname", "extname", low=1, high=1)
def _path(ctx, name, args):
    p = args_of(ctx, args)[0]
    bare = F.regexp_replace(p, "/+$", "")
    if name == "extname":
        return F.regexp_extract(p, r"(\.[^./]*)$", 1)
    if name == "basename":
        return F.when(p == "", ".").when(bare == "", "/").otherwise(F.regexp_extract(bare, "([^/]*)$", 1))
    return bound(F.regexp_extract(p, "(?s)^(.*/)[^/]*$", 1), _clean)


def _clean(p: Column) -> Column:
    """A path without `.`, inner `..` and repeated slashes; nothing is `.`."""
    rooted = p.startswith("/")

    def step(done, part):
        last = F.element_at(done, -1)
        up = F.when((F.size(done) > 0) & (F.when(F.size(done) > 0, last) != ".."), F.slice(done, F.lit(1), F.size(done) - 1)).when(rooted, done).otherwise(F.array_append(done, part))
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.array_append(done, part))

    parts = F.array_join(F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step), "/")
    return bound(parts, lambda c: F.when(rooted, F.concat(F.lit("/"), c)).when(c == "", ".").otherwise(c))


#: Terminal colours by name.
COLORS = {"black": 30, "red": 31, "green": 32, "yellow": 33, "blue": 34, "magenta": 35, "cyan": 36, "white": 37}


@rule("color", low=2, high=2)
def _color(ctx, _, args):
    code = COLORS.get(const(args[0]).lower())
    if code is None:
        raise TemplateError("enum", const(args[0]))
    return F.concat(F.lit(f"\x1b[{code}m"), args_of(ctx, args[1:])[0], F.lit("\x1b[0m"))


@rule("bar", low=3, high=4)
def _bar(ctx, _, args):
    from ..operators.scale import unit

    v, top, size = as_num(args_of(ctx, args[:1])[0]), const_int(args[1]), const_int(args[2])
    eighths = F.floor(unit(v, F.lit(0.0), F.lit(float(top)), const(args[3]) if len(args) > 3 else "linear") * (size * 8)).cast("int")
    part = F.when(eighths % 8 > 0, F.substring(F.lit("▏▎▍▌▋▊▉"), (eighths % 8), F.lit(1))).otherwise("")
    return text(F.concat(F.repeat(F.lit("█"), F.floor(eighths / 8).cast("int")), part))


# readable numbers --------------------------------------------------------------------

@rule("hi", "hf", low=1, high=1)
def _commas(ctx, name, args):
    a = args_of(ctx, args)[0]
    if name == "hi":
        return text(F.format_number(as_int(a), 0))
    v = as_num(a)
    return F.when(F.isnan(v), "NaN").when(F.abs(v) == float("inf"), F.when(v > 0, "Inf").otherwise("-Inf")).otherwise(text(F.format_number(v, 4)))


def sized(v: Column, places: int, base: int, units: list[str], gap: str) -> Column:
    out = F.lit(None).cast("string")
    for i in range(len(units) - 1, -1, -1):
        scaled = F.concat(fixed(v / float(base**i), places if i else 0), F.lit(gap + units[i] if units[i] else ""))
        out = F.when((F.abs(v) >= float(base**i)) if i else F.lit(True), F.coalesce(scaled, F.lit(BAD))) if i == len(units) - 1 else out.when((F.abs(v) >= float(base**i)) if i else F.lit(True), scaled)
    return out


#: Unit names.
SIZES = {"bytesize": (1024, ["B", "KB", "MB", "GB", "TB", "PB", "EB", "ZB"], " "), "bytesizesi": (1000, ["b", "kB", "mB", "gB", "tB", "pB", "eB", "zB"], " "), "downscale": (1000, ["", "k", "M", "B", "T"], "")}


@rule(*SIZES, low=1, high=2)
def _sized(ctx, name, args):
    v = as_int(args_of(ctx, args[:1])[0])
    v = v if name == "downscale" else F.when(v >= 0, v)
    return F.coalesce(sized(v.cast("double"), const_int(args[1]) if len(args) > 1 else 0, *SIZES[name]), F.lit(BAD))


@rule("percent", low=1, high=4)
def _percent(ctx, _, args):
    v, *ends = [as_num(a) for a in args_of(ctx, [args[0], *args[2:]])]
    lo, hi = (F.lit(0.0), F.lit(1.0)) if not ends else (F.lit(0.0), ends[0]) if len(ends) == 1 else ends
    places = const_int(args[1]) if len(args) > 1 else 1
    shown = lambda x: F.when(F.isnan(x), "NaN").when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").otherwise(fixed(x, places))
    return text(F.concat(bound(_float_divide((v - lo) * 100, hi - lo), shown), F.lit("%")))


# arrays ------------------------------------------------------------------------------

@rule("$", "@", low=1)
def _array(ctx, _, args):
    return F.concat_ws(NUL, *args_of(ctx, args))


@rule("@len", low=1, high=1)
def _alen(ctx, _, args):
    a = args_of(ctx, args)[0]
    return F.when(a == "", "0").otherwise(F.size(items(a)).cast("string"))


@rule("@split", low=1, high=2)
def _asplit(ctx, _, args):
    by = const(args[1]) if len(args) > 1 else " "
    if not by:
        raise TemplateError("empty", "delimiter")
    return F.replace(args_of(ctx, args[:1])[0], F.lit(by), F.lit(NUL))


@rule("@join", low=1, high=2)
def _ajoin(ctx, _, args):
    return F.replace(args_of(ctx, args[:1])[0], F.lit(NUL), F.lit(const(args[1]) if len(args) > 1 else " "))


@rule("@select", low=2, high=2)
def _aselect(ctx, _, args):
    a, i = items(args_of(ctx, args[:1])[0]), const_int(args[1])
    return F.coalesce(F.get(a, F.lit(i) if i >= 0 else F.size(a) + i), F.lit(""))


@rule("@map", low=2, high=2)
def _amap(ctx, _, args):
    return joined(F.transform(items(args_of(ctx, args[:1])[0]), lambda x: lower_template(args[1], ctx.inner(v0=x))))


@rule("@filter", low=2, high=2)
def _afilter(ctx, _, args):
    return joined(F.filter(items(args_of(ctx, args[:1])[0]), lambda x: truthy(lower_template(args[1], ctx.inner(v0=x)))))


@rule("@reduce", low=2, high=3)
def _areduce(ctx, _, args):
    a = items(args_of(ctx, args[:1])[0])
    step = lambda m, x: lower_template(args[1], ctx.inner(v0=m, v1=x))
    init = const(args[2]) if len(args) > 2 else ""
    if init:
        return F.aggregate(a, F.lit(init), step)
    return F.aggregate(F.slice(a, F.lit(2), F.size(a)), F.get(a, F.lit(0)), step)


@rule("@slice", low=2, high=3)
def _aslice(ctx, _, args):
    a, start = items(args_of(ctx, args[:1])[0]), const_int(args[1])
    at = F.greatest(F.size(a) + start, F.lit(0)) if start < 0 else F.lit(start)
    n = F.lit(const_int(args[2])) if len(args) > 2 else F.size(a)
    return joined(F.slice(a, at + 1, F.greatest(n, F.lit(0))))


@rule("@in", low=2, high=2)
def _ain(ctx, _, args):
    inner = args[1]
    found = [lower_template(inner, ctx)] if inner.constant is None else None
    if found is None:
        return flag(args_of(ctx, args[:1])[0].isin(inner.constant.split(NUL)))
    if any(isinstance(p, Var) for p in inner.parts):
        raise TemplateError("constant", "set")
    return flag(F.array_contains(items(found[0]), args_of(ctx, args[:1])[0]))


@rule("@range", low=1, high=3)
def _arange(ctx, _, args):
    v = [as_int(a) for a in args_of(ctx, args)]
    start, stop, step = [F.lit(0).cast("bigint"), v[0], F.lit(1).cast("bigint")] if len(v) == 1 else [*v, F.lit(1).cast("bigint")][:3]
    good = (step != 0) & ((start == stop) | ((stop > start) == (step > 0)))
    last = F.when(good & (start != stop), stop - F.signum(step).cast("bigint"))
    return F.when(start.isNull() | stop.isNull() | step.isNull(), BAD).when(~good, "<VALUE>").when(start == stop, "").otherwise(joined(F.sequence(start, last, F.when(good, step)).cast("array<string>")))


@rule("@for", low=3, high=3)
def _afor(ctx, _, args, most: int = 1_000_000):
    """Values while the test holds; `<INF>` where it still holds after a million, as is defined.

    Folds over blocks of growing size, so that a short loop stays short: a block is only made while the loop runs.
    """
    start = args_of(ctx, args[:1])[0]
    state = F.struct(start.alias("v"), F.array().cast("array<string>").alias("a"), F.lit(True).alias("on"), F.lit(0).alias("n"))

    def step(s, _i):
        i = s["n"].cast("string")
        on = s["on"] & truthy(lower_template(args[1], ctx.inner(v0=s["v"], v1=i)))
        nxt = lower_template(args[2], ctx.inner(v0=s["v"], v1=i))
        return F.struct(F.when(on, nxt).otherwise(s["v"]).alias("v"), F.when(on, F.array_append(s["a"], s["v"])).otherwise(s["a"]).alias("a"), on.alias("on"), (s["n"] + F.when(on, 1).otherwise(0)).alias("n"))

    def block(s, size):
        steps = F.when(s["on"], F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
        part = F.aggregate(steps, F.struct(s["v"].alias("v"), F.array().cast("array<string>").alias("a"), s["on"].alias("on"), s["n"].alias("n")), step)
        return F.struct(part["v"].alias("v"), F.concat(s["a"], part["a"]).alias("a"), part["on"].alias("on"), part["n"].alias("n"))

    sizes, left = [16, 64, 256], most
    sizes += [1024] * ((most - sum(sizes)) // 1024 + 1)
    out = F.aggregate(F.array(*[F.lit(n) for n in sizes[:3]]), state, block)
    rest = F.when(out["on"], F.array_repeat(F.lit(1024), len(sizes) - 3)).otherwise(F.array().cast("array<int>"))
    out = F.aggregate(rest, out, block)
    return bound(out, lambda o: F.when(o["on"] & (o["n"] >= left), "<INF>").otherwise(joined(o["a"])))


# lookups, json -----------------------------------------------------------------------

@rule("load", low=1, high=1)
def _load(ctx, _, args):
    if not ctx.load:
        raise TemplateError("file", "loading is off")
    try:
        with open(const(args[0]), encoding="utf-8") as f:
            return F.lit(f.read())
    except OSError as e:
        raise TemplateError("file", str(e)) from None


def lookup_table(content: str, comment: str = "") -> dict[str, str]:
    out = {}
    for line in content.splitlines():
        if comment and line.startswith(comment):
            continue
        w = line.split()
        if 0 < len(w) < 3:
            out[w[0]] = w[1] if len(w) == 2 else ""
    return out


@rule("lookup", "haskey", low=2, high=3)
def _lookup(ctx, name, args):
    content = args[1].constant
    if content is None and len(args[1].parts) == 1 and isinstance(args[1].parts[0], Call) and args[1].parts[0].name == "load":
        if not ctx.load:
            raise TemplateError("file", "loading is off")
        with open(const(args[1].parts[0].args[0]), encoding="utf-8") as f:
            content = f.read()
    if content is None:
        raise TemplateError("constant", "table")
    table = lookup_table(content, const(args[2]) if len(args) > 2 else "")
    key = args_of(ctx, args[:1])[0]
    if name == "haskey":
        return flag(key.isin(list(table)))
    if not table:
        return F.lit("")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(""))


@rule("json", low=1, high=2)
def _json(ctx, _, args):
    """Paths of plain names and positions stay in the JVM, where an object's own blanks are lost; all others go through Python in Arrow batches."""
    doc = ctx.variable("0") if len(args) == 1 else args_of(ctx, args[:1])[0]
    path = args[-1].constant
    if path is None or re.search(r"[*?#\\]", path):
        return _json_found(doc, lower_template(args[-1], ctx))
    plain = "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in path.split("."))
    return F.coalesce(F.get_json_object(doc, plain), F.lit(""))


def _json_found(doc: Column, path: Column) -> Column:
    import pandas as pd

    def find(docs, paths):
        from linewright.functions.jsonpath import find, steps

        known: dict[str, list] = {}
        return pd.Series([find(d, known[p] if p in known else known.setdefault(p, steps(p))) for d, p in zip(docs, paths)])

    find.__annotations__ = {"docs": pd.Series, "paths": pd.Series, "return": pd.Series}
    return F.pandas_udf(find, "string")(doc, path)
