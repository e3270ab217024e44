"""The command line: each command reads lines, runs one plan of the engine and prints its small result.

Exit codes: 0, 1 no data, 2 wrong usage or bad increments, 3 read errors, 4 output errors, 130 interrupted.
"""

from __future__ import annotations

import shutil
import sys
import time
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.library import NUL, RULES, Context, lower_template
from ..functions.template import load_functions, parse
from ..operators.engine import Lines, format_columns, needs_order, sort_groups
from ..operators.fuzzy import fuzzy_keys
from ..operators.sorting import sort_columns
from ..sources import text as source
from . import render
from .options import Option, Parsed, UsageError
from .options import parse as parse_options

NO_DATA, USAGE, READ, OUTPUT, INTERRUPTED = 1, 2, 3, 4, 130
#: Names of sorts and orders.
SORTS = {"text": "text", "t": "text", "": "text", "numeric": "numeric", "n": "numeric", "smart": "smart", "s": "smart", "contextual": "contextual", "context": "contextual", "c": "contextual", "date": "date", "d": "date", "value": "value", "val": "value", "v": "value"}
ORDERS = {"rev": "rev", "reverse": "rev", "r": "rev", "desc": "desc", "descending": "desc", "d": "desc", "asc": "asc", "ascending": "asc", "a": "asc"}

GLOBAL = [
    Option("nocolor", ("nc",)), Option("color"), Option("noformat", ("nf",)), Option("nounicode", ("nu",)), Option("noload", ("nl",)),
    Option("funcs", (), "list"), Option("notrim"), Option("version", ("v",)), Option("help", ("h",)),
]
WALK = [Option("recursive", ("R",)), Option("include", (), "list"), Option("exclude", (), "list"), Option("exclude-dir", (), "list"), Option("follow-symlinks", ("L",)), Option("read-symlinks", (), "switch", True), Option("mount")]
EXTRACT = [
    *WALK, Option("follow", ("f",)), Option("reopen", ("F",)), Option("poll"), Option("tail", ("t",)), Option("gunzip", ("z",)), Option("posix", ("p",)), Option("pcre"),
    Option("match", ("m",), "text"), Option("dissect", ("d",), "text"), Option("extract", ("e",), "list", ("{0}",)), Option("ignore", ("i",), "list"), Option("ignore-case", ("I",)),
    Option("batch", (), "int", 1000), Option("batch-buffer", (), "int", 1), Option("workers", ("w",), "int", 1), Option("readers", ("wr",), "int", 1), Option("readers-buffer", ("wrb",), "int", 1 << 19),
]
SHOW = [Option("snapshot"), Option("noout"), Option("csv", ("o",), "text")]
NUMBERS = [Option("scale", (), "text", "linear"), Option("format", ("fmt",), "text", "")]
GRID = [Option("delim", (), "text", NUL), Option("num", ("rows", "n"), "int", 20)]


def sort_name(full: str) -> str:
    """The engine's name of a sort given as `key:order`."""
    key, colon, order = full.lower().partition(":")
    if key not in SORTS:
        raise UsageError("unknown sort, options: text, numeric, smart, contextual, date, value")
    if colon and order not in ORDERS:
        raise UsageError("invalid sort modifier, options: reverse, descending, ascending")
    kind = SORTS[key]
    if not colon:
        return kind
    flipped = (kind == "value") != (ORDERS[order] == "rev") if ORDERS[order] == "rev" else ORDERS[order] == "desc"
    if kind == "value":  # falls where nothing is said
        return "value" if flipped else "value:asc"
    return f"{kind}:desc" if flipped else kind


def bytes_text(n: float) -> str:
    for unit in ("B", "KB", "MB", "GB", "TB", "PB"):
        if n < 1024 or unit == "PB":
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1024


class Session:
    """What a run shares: options, the Spark session, the style of output, and what was read."""

    def __init__(self, spark: SparkSession | None, opts: Parsed, out, err, stdin):
        self._spark, self.opts, self.out, self.err, self.stdin = spark, opts, out, err, stdin
        self.color = opts["color"] or (not opts["nocolor"] and getattr(out, "isatty", lambda: False)())
        self.style = render.Style(self.color, not opts["nounicode"])
        self.functions = {}
        for name in opts["funcs"]:
            with open(name, encoding="utf-8") as f:
                self.functions = load_functions(f.read(), self.functions)
        self.read_errors, self.paths, self.excluded, self.started = [], [], 0, time.time()
        self.last: list[str] = []

    @property
    def spark(self) -> SparkSession:
        if self._spark is None:
            self._spark = SparkSession.builder.appName("linewright").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
            self._spark.sparkContext.setLogLevel("ERROR")
        return self._spark

    def number(self, n: int) -> str:
        return str(n) if self.opts["noformat"] else f"{n:,}"

    def real(self, x: float) -> str:
        return f"{x:.4f}" if self.opts["noformat"] else f"{x:,.4f}"

    def say(self, lines: list[str]) -> None:
        """Prints a picture; a live one over the one before, unless output is no terminal."""
        if self.opts.values.get("noout") or self.opts.values.get("csv") == "-":
            return
        if not self.opts["notrim"]:
            size = shutil.get_terminal_size((100_000, 24)).columns if self.live() else 0
            lines = [x if not size or render.visible(x) < size or "\x1b" in x else x[: size - 1] for x in lines]
        if self.live() and self.last:
            self.out.write(f"\x1b[{len(self.last)}A")
            lines = [x + "\x1b[K" for x in lines]
        self.last = lines
        self.out.write("".join(x + "\n" for x in lines))
        self.out.flush()

    def live(self) -> bool:
        return bool(self.following() and not self.opts.values.get("snapshot") and getattr(self.out, "isatty", lambda: False)())

    def following(self) -> bool:
        v = self.opts.values
        return bool(v.get("follow") or v.get("reopen"))

    def evaluate(self, template: str, rows: list[dict[str, str]], names=()) -> list[str]:
        """The template over rows of named texts, as one small plan; a bare function name formats {0}."""
        if not rows:
            return []
        if template in RULES or template in self.functions:
            template = "{" + template + " {0}}"
        keys = sorted({k for r in rows for k in r})
        df = self.spark.createDataFrame([(i, *[r.get(k, "") for k in keys]) for i, r in enumerate(rows)], ["i", *[f"v{j}" for j in range(len(keys))]]).coalesce(1)
        at = {k: f"v{j}" for j, k in enumerate(keys)}
        ctx = Context(lambda n: F.col(at[n]) if n in at else F.lit(""), self.functions, not self.opts["noload"], {})
        out = lower_template(parse(template), ctx)
        return [r.x for r in ctx.staged(df).select("i", out.alias("x")).orderBy("i").collect()]

    def shower(self, template: str):
        """Formats (value, least, greatest) triples."""
        if not template:
            return lambda triples: [self.number(v) for v, _, _ in triples]
        if template not in RULES and template not in self.functions:
            parse(template)  # a fault shows before anything is read

        def show(triples):
            names = ("0", "val", "value", "."), ("1", "min"), ("2", "max")
            return self.evaluate(template, [{n: str(v) for same, v in zip(names, t) for n in same} for t in triples])

        return show

    def lines(self, paths: list[str], separate: str = NUL, number: bool = False) -> Lines:
        o = self.opts
        for name in ("batch", "readers", "readers-buffer"):
            if o[name] < 1:
                raise UsageError(f"--{name} must be at least 1")
        if (o["poll"] or o["tail"]) and not self.following():
            raise UsageError("Follow (-f) must be enabled for --poll and --tail")
        templates = [*o["extract"], *o["ignore"], *o.values.get("accumulator", [])]
        number = number or any("{line}" in t for t in templates)
        if not paths or paths[0] == "-":
            if o["gunzip"]:
                raise UsageError("Cannot decompress (-z) with stdin")
            df = source.from_lines(self.spark, self.stdin)
        elif self.following():
            from ..streaming import tail

            df = tail.follow(self.spark, *self._walk(paths), tail=o["tail"])
        else:
            remote = [p for p in paths if "://" in p]
            good, bad = source.readable(self._walk([p for p in paths if p not in remote]))
            self.read_errors += bad
            for b in bad:
                self.err.write(b + "\n")
            self.paths = good + remote
            df = source.read(self.spark, *self.paths, numbered=number, gunzip=o["gunzip"]) if self.paths else source.from_lines(self.spark, [])
        lines = Lines(df, functions=self.functions, load=not o["noload"])
        if "match" in o.given and "dissect" in o.given:
            raise UsageError("match and dissect conflict")
        if "dissect" in o.given:
            lines = lines.dissect(o["dissect"], o["ignore-case"])
        elif "match" in o.given:
            lines = lines.match(o["match"], o["ignore-case"], o["pcre"], o["posix"])
        return lines.ignore(*o["ignore"])

    def _walk(self, paths: list[str]) -> list[str]:
        o = self.opts
        walk = source.Walk(paths, o["recursive"], tuple(o["include"]), tuple(o["exclude"]), tuple(o["exclude-dir"]), o["follow-symlinks"], o["mount"], o["read-symlinks"])
        found = list(walk)
        self.excluded += walk.excluded
        for e in walk.errors:
            self.err.write(e + "\n")
        return found

    def bytes_read(self) -> int:
        import os

        return sum(os.path.getsize(p) for p in self.paths if "://" not in p)

    def summary(self, counts, errors: int = 0, *more: str) -> str:
        read, matched, ignored = counts
        paint, n = self.style.paint, self.number
        out = f"Matched: {paint(n(matched), '92')} / {paint(n(read), 'bright white')}"
        out += "".join(f" {m}" for m in more)
        if ignored:
            out += f" (Ignored: {paint(n(ignored), 'red')})"
        return out + (f" {paint(f'(Errors: {n(errors)})', 'red')}" if errors else "")

    def status(self) -> str:
        """Files, bytes and rate of what was read."""
        n, took, size = len(self.paths) + len(self.read_errors), time.time() - self.started, self.bytes_read()
        files = f"[{len(self.paths)}/{n}{f' !{len(self.read_errors)}' if self.read_errors else ''}] " if n > 1 else ""
        return f"{files}{bytes_text(size)} in {took:.1f}s (~{bytes_text(size / max(took, 1e-3))}/s)"

    def code(self, matched: int, errors: int = 0) -> int:
        if self.read_errors:
            self.err.write("Read errors\n")
            return READ
        if errors:
            self.err.write("Parse errors\n")
            return USAGE
        return 0 if matched else NO_DATA

    def save(self, header: list[str], rows) -> None:
        if self.opts["csv"]:
            source.write_csv(header, rows, self.opts["csv"], self.out)


def _wait(query) -> int:
    """Until the query ends or is interrupted; an interrupt may end the JVM as well."""
    try:
        while not query.awaitTermination(1):
            pass
    except KeyboardInterrupt:
        return INTERRUPTED
    finally:
        with suppress(Exception):
            query.stop()
    return 0


def _aggregate(s: Session, lines: Lines, names: list[str], counted, draw) -> int:
    """Runs an aggregate to its end, or again and again while following; draws it with its summary."""
    template = s.opts["extract"]
    if s.following():
        from ..streaming import tail

        return _wait(tail.live(counted(lines), lambda df: s.say(draw(df, None)[0])))
    watched, counts = lines.watched()
    df = counted(watched).persist()
    df.count()
    errors = lines.parse_errors(template, len(names)).first()[0] if lines.may_fail(template, len(names)) else 0
    read = counts()
    picture, extra = draw(df, lambda *more: s.summary(read, errors, *more))
    s.say([*picture, *([s.status()] if s.live() else [])])
    if extra:
        extra()
    df.unpersist()
    return s.code(read[1], errors)


def histogram(s: Session, o: Parsed, counted=None, note=None) -> int:
    show, scale, order = s.shower(o["format"]), render.Scale(o["scale"]), sort_name(o["sort"])
    many, percent = o["bars"] or o["extra"], o["percentage"] or o["extra"]
    lines = s.lines(o.rest)

    def draw(df: DataFrame, summary):
        groups, total = (df.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first())
        sort = sort_columns(df, order)
        top = lambda n: [(r.key, r["count"]) for r in df.orderBy(*sort).limit(n).collect() if r["count"] >= o["atleast"]]
        more = [f"(Groups: {s.style.paint(s.number(groups), 'bright blue')})", *(note(df) if note else [])]
        foot = [summary(*more)] if summary else []
        picture = render.histogram(top(o["num"]), total, o["num"], s.style, scale, show, many, percent)

        def rest():
            if o["all"]:
                s.say(["Full Table:", *render.histogram(top(max(groups, 1)), total, 0, s.style, scale, show, True, True), *foot])
            s.save(["group", "value"], ((r.key, r["count"]) for r in df.orderBy(F.desc("count"), "key").toLocalIterator()))

        return picture + foot, rest

    return _aggregate(s, lines, ["key"], counted or (lambda x: x.histogram(o["extract"])), draw)


def bargraph(s: Session, o: Parsed) -> int:
    if o["stacked"] and "scale" in o.given:
        raise UsageError("Unable to set graph scale on stacked graphs")
    if o["stacked"] and o["inline-key"]:
        raise UsageError("Unable to use inline-key on stacked graphs")
    show, scale, order = s.shower(o["format"]), render.Scale(o["scale"]), sort_name(o["sort"])
    lines = s.lines(o.rest)

    def draw(df: DataFrame, summary):
        keys = [r.subkey for r in df.select("subkey").distinct().orderBy("subkey").collect()]
        wide = df.groupBy("key").agg(F.sum("count").alias("count"), F.map_from_entries(F.collect_list(F.struct("subkey", "count"))).alias("m"))  # a row per bar: what is shown
        rows = [(r.key, [r.m.get(k, 0) for k in keys]) for r in wide.orderBy(*sort_columns(wide, order)).collect()]
        picture = render.bars(rows, keys, s.style, scale, show, o["stacked"], o["inline-key"])

        def rest():
            s.save(["group", *keys], ([n, *v] for n, v in sorted(rows)))

        return picture + ([summary()] if summary else []), rest

    return _aggregate(s, lines, ["key", "subkey"], lambda x: x.bars(o["extract"]), draw)


class Cells:
    """A long table (col, row, count) with the rows and columns to show, picked by Spark."""

    def __init__(self, df: DataFrame, rows_by: str, cols_by: str, num: int, cols: int, last: bool = False, trim: bool = False):
        self.df = df
        sums = {k: df.groupBy(F.col(k).alias("key")).agg(F.sum("count").alias("count")) for k in ("row", "col")}
        self.n_rows, self.n_cols = (sums[k].count() for k in ("row", "col"))
        order = sort_columns(sums["col"], cols_by)
        if last and self.n_cols > cols:  # the last columns of the order
            place = sums["col"].withColumn("at", F.row_number().over(Window.orderBy(*order)))
            self.columns = [(r.key, r["count"]) for r in place.where(F.col("at") > self.n_cols - cols).orderBy("at").collect()]
            if trim:  # what isn't shown counts no more
                self.df = df = df.where(F.col("col").isin([c for c, _ in self.columns]))
                sums["row"] = df.groupBy(F.col("row").alias("key")).agg(F.sum("count").alias("count"))
                self.n_rows, self.n_cols = sums["row"].count(), len(self.columns)
        else:
            self.columns = [(r.key, r["count"]) for r in sums["col"].orderBy(*order).limit(cols).collect()]
        self.rows = [(r.key, r["count"]) for r in sums["row"].orderBy(*sort_columns(sums["row"], rows_by)).limit(num).collect()]
        cells = df.where(F.col("row").isin([r for r, _ in self.rows]) & F.col("col").isin([c for c, _ in self.columns])).collect()
        self.cells = {(r.row, r.col): r["count"] for r in cells}
        ends = df.agg(F.count("*"), F.min("count"), F.max("count"), F.sum("count")).first()
        self.total, gaps = ends[3] or 0, ends[0] < self.n_rows * self.n_cols
        self.low, self.high = (min(ends[1], 0), max(ends[2], 0)) if gaps and ends[0] else (ends[1] or 0, ends[2] or 0)

    def values(self) -> list[tuple[str, list[int]]]:
        return [(r, [self.cells.get((r, c), 0) for c, _ in self.columns]) for r, _ in self.rows]

    def save(self, s: Session) -> None:
        if not s.opts["csv"]:
            return
        names = [r.col for r in self.df.select("col").distinct().orderBy("col").collect()]
        wide = self.df.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "count"))).alias("m")).orderBy("row")
        s.save(["", *names], ([r.row, *[r.m.get(c, 0) for c in names]] for r in wide.toLocalIterator()))


def _grid(s: Session, o: Parsed, picture, last: bool = False) -> int:
    order = sort_name(o["sort-rows"]), sort_name(o["sort-cols"])
    lines = s.lines(o.rest)

    def draw(df: DataFrame, summary):
        cells = Cells(df, *order, o["num"], o["cols"], last, last and not o["notruncate"])
        shape = f"(R: {s.style.paint(str(cells.n_rows), 'yellow')}; C: {s.style.paint(str(cells.n_cols), 'bright blue')})"
        return picture(cells) + ([summary(shape)] if summary else []), lambda: cells.save(s)

    def counted(x: Lines) -> DataFrame:
        long = x.table(o["extract"], o["delim"])
        return long

    return _aggregate(s, lines, ["col", "row"], counted, draw)


def tabulate(s: Session, o: Parsed) -> int:
    show = s.shower(o["format"])
    by_row, by_col = o["rowtotal"] or o["extra"], o["coltotal"] or o["extra"]
    return _grid(s, o, lambda c: render.table([n for n, _ in c.columns], c.values(), s.style, show, c.low, c.high, [t for _, t in c.rows] if by_row else None, [t for _, t in c.columns] if by_col else None, c.total))


def heatmap(s: Session, o: Parsed) -> int:
    show, scale = s.shower(o["format"]), render.Scale(o["scale"])
    ends = lambda c: (o["min"] if "min" in o.given else c.low, o["max"] if "max" in o.given else c.high)
    return _grid(s, o, lambda c: render.heatmap([n for n, _ in c.columns], c.values(), s.style, scale, show, *ends(c), c.n_rows - len(c.rows), c.n_cols - len(c.columns)))


def spark(s: Session, o: Parsed) -> int:
    show, scale = s.shower(o["format"]), render.Scale(o["scale"])
    return _grid(s, o, lambda c: render.sparklines([n for n, _ in c.columns], c.values(), s.style, scale, show, c.low, c.high, c.n_rows - len(c.rows)), True)


def analyze(s: Session, o: Parsed) -> int:
    try:
        quantiles = [float(q) for q in o["quantile"]]
    except ValueError:
        raise UsageError("a quantile is not a number") from None
    lines = s.lines(o.rest)
    watched, counts = lines.watched()
    values = watched.numbers(o["extract"]).persist()
    errors = values.where("v is null").count()
    r = lines.analyzed(values.where("v is not null"), quantiles if o["extra"] else (), o["reverse"], o["extra"]).first()
    white = lambda x: s.style.paint(x, "bright white")
    real = lambda x: white(s.real(x or 0.0))
    out = [f"Samples:  {white(s.number(r.samples))}", f"Mean:     {real(r['mean'])}", f"StdDev:   {real(r.stddev)}", f"Min:      {real(r['min'])}", f"Max:      {real(r['max'])}"]
    if o["extra"]:
        out += ["", f"Median:   {real(r['median'])}", f"Mode:     {real(r['mode'])}", *[f"P{q:02.4f}: {real(r[f'p{q:g}'])}" for q in quantiles]]
    read = counts()
    s.say([*out, "", s.summary(read, errors)])
    return s.code(read[1], errors)


def _named(text: str) -> tuple[str, str]:
    name, eq, value = text.partition("=")
    return (name, value) if eq else (text, text)


def reduce(s: Session, o: Parsed) -> int:
    groups, columns = [_named(g) for g in o["group"]], []
    for a in o["accumulator"]:
        name, value = _named(a)
        key, colon, start = name.partition(":") if "=" in a else (name, "", "")
        columns.append((key, start if colon else o["initial"], value))
    if len({n for n, *_ in columns}) < len(columns) or len({n for n, _ in groups}) < len(groups):
        raise UsageError("duplicate data expression")
    formats: dict[str, str] = {}
    for f in o["format"]:
        if "=" in f:
            name, value = _named(f)
            if name not in [c[0] for c in columns]:
                raise UsageError(f"Unknown data column {name}")
            formats[name] = value
        else:
            formats = dict.fromkeys([c[0] for c in columns], f)
    for f in formats.values():
        s.shower(f)
    ordered = needs_order(columns)
    lines = s.lines(o.rest, number=ordered)
    watched, counts = lines.watched()
    order = tuple(c for c in ("src", "line") if c in lines.df.columns) if ordered else ()
    names, data = [f"g{i}" for i in range(len(groups))], [f"d{i}" for i in range(len(columns))]
    if not columns and not groups:
        n = watched.extract(o["extract"]).count()
        s.say([s.summary(counts())])
        return s.code(n)
    found = watched.reduce(columns, groups, order, o["extract"]).toDF(*names, *data).persist()
    n = found.count()
    read = counts()

    shown = format_columns(found, {data[i]: formats[name] for i, (name, *_) in enumerate(columns) if name in formats}, s.functions)
    if groups or o["table"]:
        ordered = sort_groups(found, names, {name: d for d, (name, *_) in zip(data, columns)}, o["sort"], o["sort-reverse"], s.functions)
        rows = format_columns(ordered.limit(max(0, o["num"] - 1)), {data[i]: formats[name] for i, (name, *_) in enumerate(columns) if name in formats}, s.functions).collect()
        head = [s.style.paint(g, "93;4") for g, _ in groups] + [s.style.paint(c[0], "94;4") for c in columns]
        body = [[*[s.style.paint(r[g], "bright white") for g in names], *[r[d] or "" for d in data]] for r in rows]
        picture = render.grid([r[: o["cols"]] for r in [head, *body]]) if head else []
        s.say([*picture, s.summary(read, 0, f"(R: {n}; C: {len(groups) + len(columns)})")])
    else:
        values = shown.first() or [""] * len(columns)
        width = max(len(c[0]) for c in columns)
        s.say([*[f"{c[0]:<{width}}: {v}" for c, v in zip(columns, values)], s.summary(read)])
    s.save([*[g for g, _ in groups], *[c[0] for c in columns]], ([r[x] for x in names + data] for r in found.orderBy(*names).toLocalIterator()) if names else ([r[x] for x in data] for r in found.collect()))
    return s.code(read[1])


def filter_(s: Session, o: Parsed, paths: list[str] | None = None) -> int:
    lines = s.lines(o.rest if paths is None else paths, number=o["line"])
    own = "extract" in o.given
    keep = (*[c for c in ("src", "line") if c in lines.df.columns], "value", "_m")
    rows = lines.filter(o["extract"], keep, o["num"] or None)
    plain = F.col("key") if own else F.when(F.is_valid_utf8("value"), F.col("value")).otherwise("Binary Match") if o["text"] else F.col("value")
    shown = rows.select(*[c for c in keep[:-2]], plain.alias("text"), *(["_m"] if s.color and not own else []))

    def write(r):
        head = f"{s.style.paint(r['src'], '92')} {s.style.paint(str(r['line']), '93')}: " if o["line"] else ""
        text = r["text"]
        if s.color and not own:
            for i, g in enumerate([g for g in (r["_m"][1:-1] or r["_m"][:1]) if g]):
                a, b, c = text.partition(g)
                text = a + s.style.paint(b, render.SERIES[i % len(render.SERIES)]) + c if b and "\x1b" not in a else text
        s.out.write(f"{head}{text}\n")

    n = 0
    if s.following():
        def batch(df, _):
            for r in df.toLocalIterator():
                write(r)
            s.out.flush()

        return _wait(shown.writeStream.foreachBatch(batch).trigger(processingTime="250 milliseconds").start())
    for r in shown.toLocalIterator():
        write(r)
        n += 1
        if o["num"] and n >= o["num"]:
            break
    s.out.flush()
    if o["summary"]:
        s.err.write(f"Read   : {len(s.paths)} file(s) ({bytes_text(s.bytes_read())})" + (f", {s.excluded} excluded" if s.excluded else "") + (f", {len(s.read_errors)} error(s)" if s.read_errors else "") + "\n")
    read = lines.metrics(o["extract"]).first() if not o["num"] else None
    s.err.write((s.summary((read.read, read.matched, read.ignored)) if read else f"Matched: {s.number(n)} / {s.number(o['num'])}") + "\n")
    return s.code(n)


def search(s: Session, o: Parsed) -> int:
    rest = list(o.rest)
    if not rest:
        raise UsageError("Missing match argument")
    if "match" not in o.given and "dissect" not in o.given:
        o.values["match"] = rest.pop(0)
        o.given.add("match")
    return filter_(s, o, rest or ["."])


def walk(s: Session, o: Parsed) -> int:
    found = source.Walk(o.rest, o["recursive"], tuple(o["include"]), tuple(o["exclude"]), tuple(o["exclude-dir"]), o["follow-symlinks"], o["mount"], o["read-symlinks"])
    for p in found:
        s.out.write(p + "\n")
    if not found.total:
        s.err.write("No paths found\n")
        return NO_DATA
    s.err.write(f"Found {s.number(found.total)} path(s)" + (f", {s.number(found.excluded)} excluded" if found.excluded else "") + (f", {len(found.errors)} error(s)" if found.errors else "") + "\n")
    return 0


def expression(s: Session, o: Parsed) -> int:
    if o["listfuncs"]:
        s.out.write("Builtin:   " + ", ".join(sorted(RULES)) + "\n" + ("FuncsFile: " + ", ".join(sorted(s.functions)) + "\n" if s.functions else ""))
        return 0
    if len(o.rest) != 1 or not o.rest[0]:
        raise UsageError("expected exactly 1 expression argument. Use - for stdin" if len(o.rest) != 1 else "empty expression")
    text = "".join(s.stdin) if o.rest[0] == "-" else o.rest[0]
    data, keys = list(o["data"]), dict(_named(k) for k in o["key"])
    values = {str(i): v for i, v in enumerate(data)} | keys
    quoted = lambda pairs: "{" + ", ".join(f'"{k}": ' + (v if v.lstrip("-").replace(".", "", 1).isdigit() or v in ("true", "false") else '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"') for k, v in pairs if v) + "}"
    numbered, named = [(str(i), v) for i, v in enumerate(data)], list(keys.items())
    values |= {"src": "<args>", "line": "0", ".": quoted(named), "#": quoted(numbered), ".#": quoted(numbered + named), "#.": quoted(numbered + named), "@": NUL.join(data)}
    names = {k: f"v{i}" for i, k in enumerate(values)}
    df = s.spark.createDataFrame([tuple(values.values())], list(names.values()))
    compiled = lower_template(parse(text), Context(lambda n: F.col(names[n]) if n in names else F.lit(""), s.functions, not s.opts["noload"]))
    began = time.time()
    result = df.select(compiled.alias("x")).first().x
    if not o["raw"] and NUL in result:
        result = "[" + ", ".join(result.split(NUL)) + "]"
    if o["stats"] or o["benchmark"]:
        s.out.write(f"Expression: {text}\nResult:     {result}\n")
    else:
        s.out.write(result + ("" if o["skip-newline"] else "\n"))
    if o["stats"]:
        s.out.write(f"\nStats\n  Stages:        {len(parse(text).parts)}\n")
    if o["benchmark"]:
        many = df.crossJoin(s.spark.range(1_000_000)).select(compiled.alias("x"))
        began = time.time()
        many.write.format("noop").mode("overwrite").save()
        took = time.time() - began
        s.out.write(f"\nBenchmark: {took * 1000:.0f}ns (1,000,000 iterations in {took:.2f}s)\n")
    return 0


def fuzzy(s: Session, o: Parsed) -> int:
    def counted(lines: Lines) -> DataFrame:
        return fuzzy_keys(lines.extract(o["extract"]), o["similarity"], o["similarity-offset"]).groupBy("key").agg(F.sum("count").alias("count"))

    return histogram(s, o, counted)


def version(s: Session, o: Parsed) -> int:
    import pyspark

    s.out.write(f"linewright 2, Spark {pyspark.__version__}; regex: linear dialect on java.util.regex\n")
    return 0


_HISTOGRAM = [Option("all", ("a",)), Option("bars", ("b",)), Option("percentage"), Option("extra", ("x",)), Option("num", ("n",), "int", 5), Option("atleast", (), "int", 0), Option("sort", (), "text", "value")]
_FILTER = lambda on: [Option("line", ("l",), "switch", on), Option("num", ("n",), "int", 0), Option("text", ("a",), "switch", on), Option("summary", ("s",), "switch", on)]
_WIDTH = max(10, shutil.get_terminal_size((80, 24)).columns - 15)
_SORTED = lambda rows, cols: [Option("sort-rows", (), "text", rows), Option("sort-cols", (), "text", cols)]


def _with(options: list[Option], **defaults) -> list[Option]:
    return [Option(o.name, o.short, o.kind, defaults[o.name.replace("-", "_")]) if o.name.replace("-", "_") in defaults else o for o in options]


COMMANDS = {
    ("histogram", "histo", "h"): (histogram, EXTRACT + _HISTOGRAM + SHOW + NUMBERS),
    ("bargraph", "bars", "bar", "b"): (bargraph, EXTRACT + [Option("stacked", ("s",)), Option("inline-key", ("k",)), Option("sort", (), "text", "smart")] + SHOW + NUMBERS),
    ("tabulate", "table", "t"): (tabulate, EXTRACT + GRID + [Option("cols", (), "int", 10), Option("rowtotal"), Option("coltotal"), Option("extra", ("x",))] + _SORTED("value", "value") + SHOW + NUMBERS[1:]),
    ("heatmap", "heat", "hm"): (heatmap, EXTRACT + GRID + [Option("cols", (), "int", _WIDTH), Option("min", (), "int"), Option("max", (), "int")] + _SORTED("smart", "smart") + SHOW + NUMBERS),
    ("spark", "sparkline", "s"): (spark, EXTRACT + GRID + [Option("cols", (), "int", _WIDTH), Option("notruncate")] + _SORTED("value", "smart") + SHOW + NUMBERS),
    ("analyze", "a"): (analyze, EXTRACT + [Option("extra", ("x",)), Option("reverse", ("r",)), Option("quantile", ("q",), "list", ("90", "99", "99.9")), Option("snapshot")]),
    ("reduce", "r"): (reduce, _with(EXTRACT, extract=("{@}",)) + [Option("accumulator", ("a",), "list"), Option("group", ("g",), "list"), Option("initial", (), "text", "0"), Option("table"), Option("num", ("rows", "n"), "int", 20), Option("cols", (), "int", 10), Option("sort", (), "text", ""), Option("sort-reverse"), Option("format", ("fmt",), "list")] + SHOW),
    ("filter", "f"): (filter_, EXTRACT + _FILTER(False)),
    ("search",): (search, _with(EXTRACT, recursive=True, ignore_case=True) + _FILTER(True)),
    ("walk",): (walk, WALK),
    ("expression", "exp", "x"): (expression, [Option("benchmark", ("b",)), Option("stats", ("s",)), Option("data", ("d",), "list"), Option("key", ("k",), "list"), Option("skip-newline", ("n",)), Option("no-optimize"), Option("listfuncs"), Option("raw")]),
    ("fuzzy", "fuz", "z"): (fuzzy, EXTRACT + _HISTOGRAM + [Option("similarity", (), "float", 0.75), Option("similarity-offset", (), "int", 10), Option("similarity-size", (), "int", 100)] + SHOW + NUMBERS),
}


def main(args: list[str], spark: SparkSession | None = None, out=None, err=None, stdin=None) -> int:
    """Runs a command line; returns its exit code."""
    out, err, stdin = out or sys.stdout, err or sys.stderr, stdin if stdin is not None else sys.stdin
    at = next((i for i, a in enumerate(args) if not a.startswith("-") and (i == 0 or args[i - 1] != "--funcs")), len(args))
    name = args[at] if at < len(args) else None
    try:
        found = next((c for names, c in COMMANDS.items() if name in names), None)
        # a command's own short names come before the global ones
        command, options = found or (version, [])
        taken = {n for o in options for n in (o.name, *o.short)}
        general = [Option(o.name, tuple(n for n in o.short if n not in taken), o.kind, o.default) for o in GLOBAL if o.name not in taken]
        before = parse_options(GLOBAL, args[:at])
        opts = parse_options(options + general, args[at + 1 :])
        for o in GLOBAL:
            if o.name in before.given:
                opts.values[o.name] = before[o.name]
        if found is None and not opts["version"] or opts.values.get("help"):
            known = ", ".join(names[0] for names in COMMANDS)
            err.write((f"No such command: {name}\n" if name else "") + f"Commands: {known}\n" + (f"Options: {', '.join('--' + o.name for o in options)}\n" if found else ""))
            return 0 if opts.values.get("help") else USAGE
        return command(Session(spark, opts, out, err, stdin), opts)
    except ValueError as e:  # of options, templates, patterns, formulas
        err.write(f"{e}\n")
        return USAGE
    except BrokenPipeError:
        return OUTPUT
    except KeyboardInterrupt:
        return INTERRUPTED
    except OSError as e:
        err.write(f"{e}\n")
        return OUTPUT if isinstance(e, FileNotFoundError) and "csv" in args else USAGE
