"""lines -> match -> ignore -> extract -> aggregate, as one lazily built DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import times  # noqa: F401  (registers its rules)
from ..functions.library import BAD, NUL, Context, as_int, as_num, lower_template, truthy
from ..functions.template import Call, Template, Var, parse
from . import matcher as M
from .sorting import sort_columns


class Lines:
    """A column of lines with a matcher; `src` and `line` columns, where present, give {src} and {line}."""

    def __init__(self, df: DataFrame, column: str = "value", matcher: M.Matcher | None = None, functions=None, tests=(), load: bool = True, watch=None):
        self.df, self.column, self.matcher, self.functions, self.tests, self.load, self.watch = df, column, matcher, functions or {}, tuple(tests), load, watch

    def _with(self, **k) -> Lines:
        have = {"df": self.df, "column": self.column, "matcher": self.matcher, "functions": self.functions, "tests": self.tests, "load": self.load, "watch": self.watch}
        return Lines(**(have | k))

    def _matching(self, matcher: M.Matcher) -> Lines:
        if self.matcher is not None:
            raise M.MatchError("one matcher only")
        return self._with(matcher=matcher)

    def match(self, pattern: str, ignore_case: bool = False, backtracking: bool = False, longest: bool = False) -> Lines:
        return self._matching(M.longest(pattern, ignore_case) if longest else M.regex(pattern, ignore_case, backtracking))

    def dissect(self, pattern: str, ignore_case: bool = False) -> Lines:
        return self._matching(M.dissect(pattern, ignore_case))

    def ignore(self, *templates: str) -> Lines:
        return self._with(tests=[*self.tests, *templates])

    def watched(self) -> tuple[Lines, Callable[[], tuple[int, int, int]]]:
        """Lines that count as they run, and what gives (read, matched, ignored) after the first action, without a pass of its own."""
        seen = {n: Observation() for n in ("read", "hit", "out")}

        def counts():
            read, hit, out = (o.get["n"] for o in seen.values())
            return read, out, hit - out

        return self._with(watch=seen), counts

    def _seen(self, rows: DataFrame, name: str) -> DataFrame:
        return rows if self.watch is None else rows.observe(self.watch[name], F.count(F.lit(1)).alias("n"))

    def variable(self, name: str) -> Column:
        """A variable over the columns of `matched`: the groups lie in `_m`."""
        m = self.matcher or M.always()
        group = lambda i: F.get("_m", F.lit(i)) if i <= m.count else F.lit("")
        if name.isdigit():
            return group(int(name))
        if name == "src":
            return F.col("src") if "src" in self.df.columns else F.lit("")
        if name == "line":
            return F.col("line").cast("string") if "line" in self.df.columns else F.lit("0")
        if name == "@":
            return F.array_join(F.slice("_m", 2, m.count), NUL) if m.count else F.lit("")
        if name in (".", "#", ".#", "#."):
            fields = [(n, group(i)) for n, i in m.names.items()] if "." in name else []
            if "#" in name:
                fields += [(str(i), group(i)) for i in range(m.count + 1)]
            literal = lambda c: F.when(c.rlike(r"^-?[0-9]+(\.[0-9]+)?\z") | c.isin("true", "false"), c).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r'([\\"])', r"\\$1"), "\n", r"\\n"), F.lit('"')))
            return F.concat(F.lit("{"), F.concat_ws(", ", *[F.when(c != "", F.concat(F.lit(f'"{n}": '), literal(c))) for n, c in fields]), F.lit("}"))
        if name in m.names:
            return group(m.names[name])
        return F.lit("<NAME>")

    def context(self) -> Context:
        return Context(self.variable, self.functions, self.load, {})

    def compile(self, template: str) -> Column:
        return lower_template(parse(template), Context(self.variable, self.functions, self.load))

    def evaluate(self, rows: DataFrame, templates: dict[str, str], keep: tuple = ()) -> DataFrame:
        """(*keep, a column per template) over rows of `matched`; what templates share is computed once a row."""
        ctx = self.context()
        out = [lower_template(parse(t), ctx).alias(n) for n, t in templates.items()]
        return ctx.staged(rows).select(*keep, *out)

    def _parts(self) -> Column:
        return (self.matcher or M.always()).parts(F.coalesce(F.col(self.column), F.lit("")))

    def matched(self) -> DataFrame:
        """Rows that match and that no ignore template accepts, with their groups in `_m`.

        The groups are found once a row: nothing that is asked of what a generator gives is pushed below it.
        """
        if self.matcher is None:
            rows = self._seen(self.df, "read").withColumn("_m", self._parts())
        else:
            rows = self._seen(self.df, "read").select("*", F.explode(F.array(self._parts())).alias("_m")).where(F.size("_m") > 1)
        rows = self._seen(rows, "hit")
        for t in self.tests:
            rows = rows.where(~truthy(self.compile(t)))
        return rows

    def extract(self, template: str | list[str] = "{0}", keep: tuple = (), separator: str = NUL) -> DataFrame:
        """(*keep, key); rows with an empty key go."""
        many = [template] if isinstance(template, str) else template
        ctx = self.context()
        parts = [lower_template(parse(t), ctx) for t in many]
        key = parts[0] if len(parts) == 1 else F.concat_ws(separator, *parts)
        # a generator again: a filter would be pushed down and the key be computed twice
        return self._seen(ctx.staged(self.matched()).select(*keep, F.explode(F.array(key)).alias("key")).where("key <> ''"), "out")

    def filter(self, template: str | list[str] = "{0}", keep: tuple = (), limit: int | None = None) -> DataFrame:
        out = self.extract(template, keep, "\t")
        return out if limit is None else out.limit(limit)

    def metrics(self, template: str | list[str] | None = None) -> DataFrame:
        """One row: read, matched, ignored; with a template, lines with an empty key count as ignored."""
        rows = self.df.select("*", self._parts().alias("_m"))
        dropped = F.lit(False)
        for t in self.tests:
            dropped = dropped | truthy(self.compile(t))
        if template is not None:
            many = [template] if isinstance(template, str) else template
            dropped = dropped | (F.concat(*[self.compile(t) for t in many]) == "") if len(many) == 1 else dropped
        hit = F.size("_m") > 1
        flags = rows.select(F.when(hit, dropped).alias("dropped"))
        return flags.agg(F.count("*").alias("read"), F.count_if(~F.col("dropped")).alias("matched"), F.count_if("dropped").alias("ignored"))

    def _counted(self, template, names: list[str], keep: tuple = ()) -> DataFrame:
        """Key parts as columns and `inc`; a missing increment is 1, a bad one is null."""
        rows, n = self.extract(template, keep), len(names)
        many, p = F.contains("key", F.lit(NUL)), F.split("key", NUL, -1)
        parts = [F.when(many, F.coalesce(F.get(p, F.lit(i)), F.lit(""))).otherwise(F.col("key") if i == 0 else F.lit("")).alias(c) for i, c in enumerate(names)]
        inc = F.when(many & (F.size(p) > n), as_int(F.get(p, F.lit(n)))).otherwise(F.lit(1).cast("bigint"))
        return rows.select(*keep, *parts, inc.alias("inc"))

    def _increments(self, template, names: list[str]) -> DataFrame:
        """Summed increments of each key; rows with a bad one go."""
        sums = self._counted(template, names).groupBy(*names).agg(F.sum("inc").alias("count"))
        return sums.where("count is not null")

    def parse_errors(self, template, n: int) -> DataFrame:
        """One row: how many extracted rows have a bad increment after `n` key parts."""
        return self._counted(template, [f"k{i}" for i in range(n)]).agg(F.count_if(F.col("inc").isNull()).alias("errors"))

    def histogram(self, template="{0}", n: int | None = None, at_least: int | None = None, sort: str = "value", percent: bool = False) -> DataFrame:
        out = self._increments(template, ["key"])
        if percent:
            total = out.agg(F.sum("count").alias("total"))  # one row
            out = out.crossJoin(F.broadcast(total)).select("key", "count", (F.col("count") / F.col("total")).alias("share"))
        if n is not None:
            out = out.orderBy(*sort_columns(out, sort)).limit(n)
        return out if at_least is None else out.where(F.col("count") >= at_least)

    def bars(self, template) -> DataFrame:
        return self._increments(template, ["key", "subkey"])

    def table(self, template, delimiter: str = NUL) -> DataFrame:
        """Long form (col, row, count)."""
        if delimiter == NUL:
            return self._increments(template, ["col", "row"])
        parts = self.extract(template).select(F.split("key", "\\Q" + delimiter + "\\E", -1).alias("p"))
        inc = F.when(F.size("p") > 2, as_int(F.get("p", F.lit(2)))).otherwise(F.lit(1).cast("bigint"))
        rows = parts.select(F.get("p", F.lit(0)).alias("col"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("row"), inc.alias("inc"))
        return rows.groupBy("col", "row").agg(F.sum("inc").alias("count")).where("count is not null")

    def may_fail(self, template, n: int) -> bool:
        """Whether a row of this template can hold more than n parts, and so a bad increment."""
        many = [template] if isinstance(template, str) else list(template)
        return len(many) > n or any("{" + f in t for t in many for f in ("$", "@"))

    def numbers(self, template="{0}") -> DataFrame:
        """(v): extracted numbers, null for other text."""
        return self.extract(template).select(as_num(F.col("key")).alias("v"))

    def analyze(self, template="{0}", quantiles=(90, 99, 99.9), reverse: bool = False) -> DataFrame:
        """One row; the order statistics are picked by distributed rank, never from one collected list."""
        return self.analyzed(self.numbers(template).where("v is not null"), quantiles, reverse)

    def analyzed(self, v: DataFrame, quantiles=(), reverse: bool = False, ranked: bool = True) -> DataFrame:
        base = v.agg(F.count("*").alias("samples"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("stddev"), F.min("v").alias("min"), F.max("v").alias("max"))
        if not ranked:
            return base
        counts = v.groupBy("v").agg(F.count("*").alias("c"))
        mode = F.max_by("v", F.struct("c", F.col("v") if reverse else -F.col("v"))).alias("mode")
        # distinct values in order carry the number of samples before them: range partitions, then offsets
        ordered = running(counts, "v", "c", descending=reverse)
        picks = [("median", 0.5)] + [(f"p{q:g}", q / 100) for q in quantiles]
        total = base.select("samples")
        at = lambda p: F.least(F.floor(F.col("samples") * p), F.col("samples") - 1)
        picked = ordered.crossJoin(F.broadcast(total)).agg(mode, *[F.max(F.when((F.col("before") <= at(p)) & (at(p) < F.col("before") + F.col("c")), F.col("v"))).alias(name) for name, p in picks])
        return base.crossJoin(picked)

    def reduce(self, columns: list[tuple[str, str, str]], group: list[tuple[str, str]] = (), order: tuple = (), extract="{@}") -> DataFrame:
        return fold(self.extract(extract, keep=order), list(columns), list(group), list(order), self.functions, self.load)


def running(counts: DataFrame, value: str, count: str, descending: bool = False, ranges: int = 1024) -> DataFrame:
    """(value, count, before): samples before each distinct value.

    Values are cut into ranges at quantiles, and the number of a range is a column, so the sums of
    ranges and the rows they are added to agree however Spark lays out its partitions.
    """
    sign = -1 if descending else 1
    edges = sorted({float(e) for e in counts.approxQuantile(value, [i / ranges for i in range(1, ranges)], 1 / ranges)})
    place = F.array(*[F.lit(e) for e in edges]) if edges else F.array().cast("array<double>")
    parts = counts.select(value, F.col(count).alias("c"), (F.size(F.filter(place, lambda e: e < F.col(value))) * sign).alias("part"))
    offsets = parts.groupBy("part").agg(F.sum("c").alias("s"))  # at most `ranges` rows
    offsets = offsets.select(F.col("part").alias("p"), (F.sum("s").over(Window.orderBy("part")) - F.col("s")).alias("base"))
    inner = F.sum("c").over(Window.partitionBy("part").orderBy(F.col(value).desc() if descending else F.col(value).asc())) - F.col("c")
    return parts.join(F.broadcast(offsets), F.col("part") == F.col("p")).select(value, "c", (F.col("base") + inner).alias("before"))


def lookup_join(rows: DataFrame, key: str, table: DataFrame, name: str = "found") -> DataFrame:
    """rows with the value of their key in a table (key, value) of any size as `name`; a missing key gives the empty text.

    A key listed more than once gives its greatest value; a literal table in a template serves small lists.
    """
    values = table.select(F.col("key").cast("string").alias("_k"), F.col("value").cast("string").alias("_v")).groupBy("_k").agg(F.max("_v").alias("_v"))
    return rows.join(values, rows[key] == F.col("_k"), "left").select(*[rows[c] for c in rows.columns], F.coalesce("_v", F.lit("")).alias(name))


def totals(long: DataFrame) -> DataFrame:
    """Cells, row, column and grand totals; a total's missing key is null."""
    return long.cube("col", "row").agg(F.sum("count").alias("count"))


def minmax(long: DataFrame) -> DataFrame:
    """Least and greatest cell of the full matrix, where missing cells are 0."""
    out = long.agg(F.count("*").alias("n"), (F.count_distinct("col") * F.count_distinct("row")).alias("full"), F.min("count").alias("lo"), F.max("count").alias("hi"))
    return out.select(F.coalesce(F.when(F.col("n") < F.col("full"), F.least("lo", F.lit(0))).otherwise(F.col("lo")), F.lit(0)).alias("min"), F.coalesce(F.when(F.col("n") < F.col("full"), F.greatest("hi", F.lit(0))).otherwise(F.col("hi")), F.lit(0)).alias("max"))


def wide(long: DataFrame, columns: list[str]) -> DataFrame:
    return long.groupBy("row").pivot("col", columns).agg(F.sum("count")).na.fill(0)


def last_columns(long: DataFrame, n: int, sort: str = "smart") -> DataFrame:
    """Cells of the last n columns in sort order."""
    cols = long.select("col").distinct()
    flip = [c for c in sort_columns(cols, sort + ":desc" if ":" not in sort else sort, key="col")]
    keep = cols.orderBy(*flip).limit(n).withColumnRenamed("col", "_c")
    return long.join(F.broadcast(keep), F.col("col") == F.col("_c")).drop("_c")


def fold(rows: DataFrame, columns, group, order, functions, load: bool = True) -> DataFrame:
    """A grouped fold. Columns of a known shape become plain aggregates; only others fold in order, over each group's rows in one array."""
    elements = F.split("key", NUL, -1)

    def outer(name):
        if name == "0":
            return F.col("key")
        return F.coalesce(F.get(elements, F.lit(int(name) - 1)), F.lit("")) if name.isdigit() else F.lit("")

    ctx = Context(outer, functions, load)
    names = [c[0] for c in columns]
    at = {n: f"_d{i}" for i, n in enumerate(names)}  # names of any text
    by = [f"_g{i}" for i in range(len(group))]
    keys = [lower_template(parse(t), ctx).alias(g) for g, (_, t) in zip(by, group)]
    named = lambda df: df.select(*by, *at.values()).toDF(*[n for n, _ in group], *names)
    out, later, plain = [], [], True
    for i, (name, init, template) in enumerate(columns):
        t = parse(template)
        shape = _shape(t, name, names)
        if shape is None:
            used = _names(t)
            if used <= set(names[:i]) and not used & {"."} and used and not _has_positions(t):
                later.append((name, t))
                continue
            plain = False
            break
        kind, x = shape
        out.append(_aggregate(kind, lower_template(x, ctx), init, order).alias(at[name]))
    if plain:
        if not out:
            out = [F.count("*").alias("_n")]
        found = rows.groupBy(*keys).agg(*out) if group else rows.agg(*out)
        for name, t in later:
            found = found.withColumn(at[name], lower_template(t, Context(lambda n: F.col(at[n]).cast("string") if n in at else F.lit(""), functions, load)))
        return named(found)
    if not order:
        raise ValueError("a fold needs an order of rows")
    line = F.struct(*order, F.col("key").alias("_key"))
    lists = rows.select(*keys, line.alias("_e")).groupBy(*by).agg(F.array_sort(F.collect_list("_e")).alias("_l"))
    start = F.struct(*[F.lit(init).alias(at[n]) for n, init, _ in columns])

    def step(state, e):
        now = {n: state[at[n]] for n in names}
        parts = F.split(e["_key"], NUL, -1)
        for n, _, template in columns:
            def variable(v, n=n):
                if v == ".":
                    return now[n]
                if v == "0":
                    return e["_key"]
                return F.coalesce(F.get(parts, F.lit(int(v) - 1)), F.lit("")) if v.isdigit() else now.get(v, F.lit(""))

            now[n] = lower_template(parse(template), Context(variable, functions, load))
        return F.struct(*[now[n].alias(at[n]) for n in names])

    return named(lists.withColumn("_s", F.aggregate("_l", start, step)).select(*by, *[F.col(f"_s.{at[n]}").alias(at[n]) for n in names]))


def group_keys(found: DataFrame, groups: list[str], columns: dict[str, str], template: str = "", functions=None) -> DataFrame:
    """Groups of a fold with what they are sorted by, `_sort`: a template, or their key `_key`.

    In the template {.} is the key, {0} the first group, and a name the column that `columns` gives for it.
    """
    key = F.concat_ws(NUL, *groups) if groups else F.lit("")

    def variable(name):
        if name == ".":
            return key
        if name.isdigit():
            return F.col(groups[int(name)]) if int(name) < len(groups) else F.lit("")
        return F.coalesce(F.col(columns[name]), F.lit("")) if name in columns else F.lit("")

    by = lower_template(parse(template), Context(variable, functions)) if template else key
    return found.withColumns({"_sort": by, "_key": key})


def sort_groups(found: DataFrame, groups: list[str], columns: dict[str, str], template: str = "", reverse: bool = False, functions=None) -> DataFrame:
    """Groups of a fold in the contextual order of `group_keys`; ties by the key."""
    keyed = group_keys(found, groups, columns, template, functions)
    return keyed.orderBy(*sort_columns(keyed, "contextual" + (":desc" if reverse else ""), key="_sort"), "_key").drop("_sort", "_key")


def format_columns(df: DataFrame, formats: dict[str, str], functions=None) -> DataFrame:
    """df with columns shown by templates, where {0}, {val}, {value} and {.} are the value; a bare function name formats {0}."""
    from ..functions.library import RULES

    out = {}
    for name, template in formats.items():
        if template in RULES or template in (functions or {}):
            template = "{" + template + " {0}}"
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        out[name] = lower_template(parse(template), Context(lambda v, value=value: value if v in ("0", "val", "value", ".") else F.lit(""), functions))
    return df.withColumns(out) if out else df


def needs_order(columns) -> bool:
    """Whether some column of a fold depends on the order of rows."""
    names = [c[0] for c in columns]
    for i, (name, _, template) in enumerate(columns):
        t = parse(template)
        shape = _shape(t, name, names)
        if shape is None and not _names(t) <= set(names[:i]) or shape is not None and shape[0] == "last" or shape is None and _has_positions(t):
            return True
    return False


def _names(t: Template) -> set[str]:
    out = set()
    for p in t.parts:
        if isinstance(p, Var) and not p.name.isdigit():
            out.add(p.name)
        elif isinstance(p, Call):
            for a in p.args:
                out |= _names(a)
    return out


def _has_positions(t: Template) -> bool:
    return any((isinstance(p, Var) and p.name.isdigit()) or (isinstance(p, Call) and any(_has_positions(a) for a in p.args)) for p in t.parts)


def _shape(t: Template, name: str, names):
    """(kind, template of X) of {sumi {.} X} and its like, or of a last value."""
    if len(t.parts) == 1 and isinstance(t.parts[0], Call):
        c = t.parts[0]
        own = len(c.args) == 2 and c.args[0].parts in ((Var("."),), (Var(name),))
        if own and c.name in ("sumi", "subi", "maxi", "mini", "sumf") and not _names(c.args[1]):
            return c.name, c.args[1]
    return ("last", t) if not _names(t) else None


def _aggregate(kind, x: Column, init: str, order) -> Column:
    if kind == "last":
        if not order:
            raise ValueError("a last value needs an order of rows")
        return F.max_by(x, F.struct(*order))
    v = as_num(x) if kind == "sumf" else as_int(x)
    start = F.lit(float(init) if kind == "sumf" else int(init))
    total = F.try_sum(v)
    value = {"sumi": lambda: F.try_add(start, total), "sumf": lambda: start + F.sum(v), "subi": lambda: F.try_subtract(start, total), "maxi": lambda: F.greatest(start, F.max(v)), "mini": lambda: F.least(start, F.min(v))}[kind]()
    from ..functions.library import num_text

    return F.when(F.bool_or(v.isNull()), BAD).otherwise(num_text(Context(lambda n: F.lit("")), value) if kind == "sumf" else F.coalesce(value.cast("string"), F.lit(BAD)))
