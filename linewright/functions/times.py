"""Time functions. A layout in the reference-date style becomes a regular expression on the driver.

A text is read by one expression that puts its pieces in a fixed order; numbers are made of the
pieces, so a text that doesn't fit is a null and never an exception. Nothing depends on the
session's time zone.
"""

from __future__ import annotations

import re
import time
from datetime import datetime, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .library import BAD, INT, PARSE, args_of, as_int, bound, const, fitting, rule
from .template import TemplateError

#: Named layouts.
LAYOUTS = {
    "": "2006-01-02T15:04:05Z07:00", "ANSIC": "Mon Jan _2 15:04:05 2006", "UNIX": "Mon Jan _2 15:04:05 MST 2006", "RUBY": "Mon Jan 02 15:04:05 -0700 2006",
    "RFC822": "02 Jan 06 15:04 MST", "RFC822Z": "02 Jan 06 15:04 -0700", "RFC1123": "Mon, 02 Jan 2006 15:04:05 MST", "RFC1123Z": "Mon, 02 Jan 2006 15:04:05 -0700",
    "RFC3339": "2006-01-02T15:04:05Z07:00", "RFC3339N": "2006-01-02T15:04:05.999999999Z07:00", "NGINX": "_2/Jan/2006:15:04:05 -0700",
    "MONTH": "01", "MONTHNAME": "January", "MNTH": "Jan", "DAY": "02", "YEAR": "2006", "HOUR": "15", "MINUTE": "04", "SECOND": "05",
    "TIMEZONE": "MST", "NTIMEZONE": "-0700", "NTZ": "-0700", "WEEKDAY": "Monday", "WDAY": "Mon",
}
#: Layout pieces, the text each reads, and the Java pattern that writes it (zones are written apart).
PIECES = {
    "January": ("month", r"([A-Za-z]{3})[A-Za-z]*", "MMMM"), "Jan": ("month", r"([A-Za-z]{3})", "MMM"), "Monday": (None, r"[A-Za-z]+", "EEEE"), "Mon": (None, r"[A-Za-z]{3}", "EEE"),
    "2006": ("year", r"(\d{4})", "yyyy"), "Z07:00": ("zone", r"(Z|[+-]\d\d:\d\d)", None), "Z0700": ("zone", r"(Z|[+-]\d{4})", None), "-07:00": ("zone", r"([+-]\d\d:\d\d)", None),
    "-0700": ("zone", r"([+-]\d{4})", None), "MST": ("zone", r"([A-Z]{3,5}|[+-]\d\d)", None), "01": ("month", r"(\d\d)", "MM"), "02": ("day", r"(\d\d)", "dd"), "_2": ("day", r" ?(\d{1,2})", "_d"),
    "15": ("hour", r"(\d{1,2})", "HH"), "03": ("hour", r"(\d\d)", "hh"), "04": ("minute", r"(\d\d)", "mm"), "05": ("second", r"(\d\d)", "ss"), "06": ("year", r"(\d\d)", "yy"),
    "PM": ("half", r"([AaPp][Mm])", "a"), ".999999999": (None, "", ""), ".000000": (None, "", ".SSSSSS"), ".000": (None, "", ".SSS"),
    "1": ("month", r"(\d{1,2})", "M"), "2": ("day", r"(\d{1,2})", "d"), "3": ("hour", r"(\d{1,2})", "h"), "4": ("minute", r"(\d{1,2})", "m"), "5": ("second", r"(\d{1,2})", "s"),
}
_PIECE = re.compile("|".join(re.escape(p) for p in sorted(PIECES, key=len, reverse=True)))
#: Layouts that detection tries in turn; a trailing zone, a leading weekday and fractions may be added to each.
DETECT = [
    "_2/Jan/2006:15:04:05", "2006-01-02T15:04:05", "2006-01-02 15:04:05", "2006-01-02 15:04", "2006-01-02T15:04", "2006-01-02", "2006/01/02 15:04:05", "2006/01/02", "2006.01.02",
    "1/2/2006 3:04:05 PM", "1/2/2006 15:04:05", "1/2/2006 3:04 PM", "1/2/2006 15:04", "1/2/2006", "1/2/06", "1.2.2006", "2-Jan-2006", "2-Jan-06", "2/Jan/2006 15:04:05", "2/Jan/2006", "2006-Jan-02",
    "January 2, 2006 3:04:05 PM", "January 2, 2006 15:04:05", "January 2, 2006 at 3:04:05 PM", "January 2, 2006 3:04 PM", "January 2, 2006 15:04", "January 2, 2006", "January 2 2006",
    "2 January 2006 15:04:05", "2 January 2006, 15:04:05", "2 January 2006 15:04", "2 January 2006", "2 January 06 15:04", "January _2 15:04:05 2006", "January _2 15:04:05 MST 2006", "January _2 15:04:05 -0700 2006", "20060102T150405",
]
#: The months.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def readers(layout: str, loose: bool = False) -> list[tuple[str, str]]:
    """(pattern, replacement) pairs that turn a text of the layout into `year-month-day hour:minute:second|half|zone`; one for each century."""
    if (short := re.search(r"(?<!20)06(?!\d)", layout)) and "06" in _PIECE.findall(layout):
        at = short.start()
        return [_reader(layout, loose, at, century) for century in (("19", r"(69|[7-9]\d)"), ("20", r"(\d\d)"))]
    return [_reader(layout, loose)]


def _reader(layout: str, loose: bool, short: int = -1, century: tuple[str, str] = ("", "")) -> tuple[str, str]:
    out, at, found, n = "", 0, {}, 0

    def literal(s):
        return "".join(" +" if c.isspace() else re.escape(c) for c in re.sub(r"\s+", " ", s))

    for m in _PIECE.finditer(layout):
        out += literal(layout[at : m.start()])
        at = m.end()
        name, pattern, _ = PIECES[m[0]]
        if m.start() == short:
            pattern = century[1]
        if out.endswith(" +") and m[0] == "_2":
            pattern = pattern.removeprefix(" ?")
        out += pattern
        if name:
            n += 1
            found[name] = f"${n}"
        if name == "second":  # a fraction may follow the seconds
            out += r"(?:(\.\d{1,6})\d*|,\d+)?"
            n += 1
            found["second"] += f"${n}"
    out += literal(layout[at:])
    if loose:
        out = r"(?:[A-Za-z]{3,9},? +)?" + out + ("" if "zone" in found else r"(?: *(Z|[+-]\d\d:?\d\d|[A-Z]{3,5}))?(?: \([A-Z]+\))?")
        found.setdefault("zone", f"${n + 1}")
    get = lambda f, other: found.get(f, other)
    order = f"{century[0]}{get('year', '1970')}-{get('month', '01')}-{get('day', '01')} {get('hour', '00')}:{get('minute', '00')}:{get('second', '00')}|{get('half', '')}|{get('zone', '')}"
    return r"^ *" + out + r" *\z", order


def _layout(name: str) -> str:
    return LAYOUTS.get(name.upper(), name)


def fields(s: Column, layout: str) -> Column:
    """s as `readers` put it; null where it doesn't fit."""
    auto = layout.lower() in ("", "auto", "cache")
    out = F.lit(None).cast("string")
    for pattern, order in reversed([r for one in (DETECT if auto else [_layout(layout)]) for r in readers(one, auto)]):
        out = F.when(s.rlike(pattern), F.regexp_replace(s, pattern, order)).otherwise(out)
    return out


def _moment(p: Column) -> Column:
    """struct(wall, offset) of the parts of `fields`: the text's own clock, and its seconds east of UTC if it names any."""
    text, half, zone = (F.get(p, F.lit(i)) for i in range(3))
    # a month by name has three letters at the sixth place
    place = F.call_function("instr", F.lit(MONTHS), F.lower(F.substring(text, 6, 3)))
    month = F.when(place % 3 == 1, F.floor((place + 2) / 3).cast("string"))
    plain = F.when(F.substring(text, 6, 1) >= "A", F.concat(F.left(text, F.lit(5)), month, F.substring(text, 9, 64))).otherwise(text)

    def twelve(v):
        hour = F.regexp_extract(v, r" (\d+):", 1).cast("int")
        moved = hour % 12 + F.when(F.upper(half) == "PM", 12).otherwise(0)
        return F.when((hour >= 1) & (hour <= 12), F.concat(F.substring_index(v, " ", 1), F.lit(" "), moved.cast("string"), F.lit(":"), F.substring_index(v, ":", -2)))

    wall = F.when(half == "", plain).otherwise(bound(plain, twelve)).try_cast("timestamp_ntz")
    digits = F.replace(F.substring(zone, 2, 5), F.lit(":"), F.lit(""))
    signed = (F.left(digits, F.lit(2)).try_cast("int") * 3600 + F.coalesce(F.substring(digits, 3, 2).try_cast("int"), F.lit(0)) * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    # a zone by name has no offset of its own
    return F.struct(wall.alias("wall"), F.when(zone == "", None).when(zone.rlike(r"^[+-]"), signed).otherwise(0).alias("offset"))


def parsed(ctx, template, layout: str) -> Column:
    """struct(number, wall, offset) of a template: unix seconds, or a time as written. One parse a row, however often it is asked for."""
    s = args_of(ctx, [template])[0]
    none, layout = F.lit(None), layout.lower() if layout.lower() in ("", "auto", "cache", "epoch") or layout == "unix" else _layout(layout)

    def make():
        number = lambda v: fitting(v, INT).try_cast("bigint")
        if layout in ("epoch", "unix"):
            return F.struct(number(s).alias("number"), none.cast("timestamp_ntz").alias("wall"), none.cast("int").alias("offset"))
        # bound within the expression: as columns of one stage they would make a method too large to be compiled
        moment = lambda v: bound(F.split(F.when(~v.rlike(r"^[+-]?\d+\z"), fields(v, layout)), r"\|", -1), _moment)
        whole = lambda v, m: F.struct(number(v).alias("number"), m["wall"].alias("wall"), m["offset"].cast("int").alias("offset"))
        return bound(s, lambda v: bound(moment(v), lambda m: whole(v, m)))

    return ctx.once(("time", ctx.scope, template, layout), make)


def seconds(wall: Column) -> Column:
    """Seconds of a zoneless timestamp since 1970, rounded down."""
    days = F.datediff(wall.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + (F.hour(wall) * 3600 + F.minute(wall) * 60 + F.second(wall)).cast("bigint")


def at_seconds(n: Column) -> Column:
    """The zoneless timestamp n seconds after 1970."""
    days = F.floor(n / 86400)
    return F.timestamp_add("SECOND", (n - days * 86400).cast("int"), F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("timestamp_ntz"))


def _zone(args, i) -> str:
    z = const(args[i]) if len(args) > i else "UTC"
    if z.lower() in ("", "utc", "local"):
        return "UTC"
    try:
        ZoneInfo(z)
    except (KeyError, ValueError, OSError):
        raise TemplateError("zone", z) from None
    return z


def _transitions(zone: str) -> list[tuple[int, int, str]]:
    """(since unix second, seconds east of UTC, abbreviation) of a zone, from 1900 to 2100; searched to the second."""
    z = ZoneInfo(zone)

    def state(t):
        d = datetime.fromtimestamp(t, timezone.utc).astimezone(z)
        return int(d.utcoffset().total_seconds()), d.tzname()

    start, step, out = -2208988800, 30 * 86400, []
    out.append((-(1 << 62), *state(start)))
    for t in range(start, 4102444800, step):
        low, high = t, t + step
        if state(low) != state(high):
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if state(mid) == out[-1][1:] else (low, mid)
            out.append((high, *state(high)))
    return out


def _offsets(zone: str) -> tuple[Column, Column, Column]:
    """Arrays of when offsets begin, the offsets, and their names; literals of a few hundred entries."""
    rows = _transitions(zone)
    return tuple(F.array(*[F.lit(r[i]).cast(t) for r in rows]) for i, t in enumerate(("bigint", "int", "string")))


def _at_zone(n: Column, zone: str) -> tuple[Column, Column]:
    """(seconds east of UTC, abbreviation) of a zone at unix second n."""
    if zone == "UTC":
        return F.lit(0), F.lit("UTC")
    since, east, names = _offsets(zone)
    place = F.size(F.filter(since, lambda s: s <= n)) - 1
    return F.get(east, place), F.get(names, place)


def _from_wall(wall: Column, zone: str) -> Column:
    """Unix seconds of a wall clock in a zone; of a time that occurs twice, the first."""
    n = seconds(wall)
    if zone == "UTC":
        return n
    rows = _transitions(zone)
    # the last offset that has begun by the wall clock, read with the offset before
    since = F.array(*[F.lit(rows[max(0, i - 1)][1] + r[0] if i else r[0]).cast("bigint") for i, r in enumerate(rows)])
    east = F.array(*[F.lit(r[1]) for r in rows])
    return n - F.get(east, F.size(F.filter(since, lambda s: s <= n)) - 1)


def instant(t: Column, zone: str) -> Column:
    """Unix seconds of what `parsed` gives."""
    own = seconds(t["wall"]) - t["offset"]
    return F.when(t["number"].isNotNull(), t["number"]).when(t["offset"].isNotNull(), own).otherwise(_from_wall(t["wall"], zone))


_STARTED = time.time()


@rule("time", low=1, high=3)
def _time(ctx, _, args):
    special = args[0].constant
    if special in ("now", "live"):  # a query has one clock
        return F.unix_timestamp().cast("string")
    if special == "delta":
        return (F.unix_timestamp() - F.lit(int(_STARTED))).cast("string")
    t, zone = parsed(ctx, args[0], const(args[1]) if len(args) > 1 else ""), _zone(args, 2)
    n = ctx.once(("instant", ctx.scope, args), lambda: bound(t, lambda v: instant(v, zone)))
    out = F.coalesce(n.cast("string"), F.lit(PARSE))
    out._integer = n
    return out


def _pad(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def written(n: Column, layout: str, zone: str) -> Column:
    """Unix seconds n in a layout, on the clock of a zone."""

    def at(v):
        east, name = _at_zone(v, zone)
        wall = at_seconds(v + east)
        size = F.abs(east)
        sign = F.when(east < 0, "-").otherwise("+")
        hours, minutes = _pad(F.floor(size / 3600)), _pad(F.floor(size % 3600 / 60))
        plain, colon = F.concat(sign, hours, minutes), F.concat(sign, hours, F.lit(":"), minutes)
        zones = {"-0700": plain, "-07:00": colon, "Z07:00": F.when(east == 0, "Z").otherwise(colon), "Z0700": F.when(east == 0, "Z").otherwise(plain), "MST": F.when(name.rlike("^[A-Z]"), name).otherwise(F.regexp_replace(name, ":?00$", ""))}
        out, done = [], 0
        quoted = lambda s: re.sub(r"[A-Za-z]+", lambda m: f"'{m[0]}'", s.replace("'", "''"))
        pattern = ""

        def flush():
            nonlocal pattern
            if pattern:
                out.append(F.date_format(wall, pattern))
            pattern = ""

        for m in _PIECE.finditer(layout):
            pattern += quoted(layout[done : m.start()])
            done = m.end()
            java = PIECES[m[0]][2]
            if java is None:
                flush()
                out.append(zones[m[0]])
            elif java == "_d":
                flush()
                out.append(F.lpad(F.dayofmonth(wall).cast("string"), 2, " "))
            else:
                pattern += java
        pattern += quoted(layout[done:])
        flush()
        return F.concat(*out) if out else F.lit("")

    return bound(n, at)


@rule("timeformat", low=1, high=3)
def _timeformat(ctx, _, args):
    layout = _layout(const(args[1]) if len(args) > 1 else "")
    zone = _zone(args, 2)
    known = vars(args_of(ctx, args)[0]).get("_integer")
    n = known if known is not None else bound(parsed(ctx, args[0], ""), lambda t: instant(t, zone))
    return F.coalesce(written(n, layout, zone), F.lit(PARSE))


def _wall(ctx, args) -> Column:
    """The text's own clock; unix seconds on the clock of the zone."""
    t, zone = parsed(ctx, args[0], const(args[2]) if len(args) > 2 else ""), _zone(args, 3)
    shifted = lambda n: at_seconds(n + _at_zone(n, zone)[0])
    return ctx.once(("wall", ctx.scope, args[0], args[2:]), lambda: bound(t, lambda v: F.when(v["number"].isNotNull(), shifted(v["number"])).otherwise(v["wall"])))


@rule("timeattr", low=2, high=4)
def _timeattr(ctx, _, args):
    kinds = {
        "weekday": lambda t: F.dayofweek(t) - 1, "week": F.weekofyear, "quarter": lambda t: F.floor(F.month(t) / 3) + 1, "quarter_iso": F.quarter,
        "yearweek": lambda t: F.concat(F.extract(F.lit("yearofweek"), t).cast("string"), F.lit("-"), F.weekofyear(t).cast("string")),
    }
    kind = const(args[1]).lower()
    if kind not in kinds:
        raise TemplateError("enum", kind)
    return F.coalesce(kinds[kind](_wall(ctx, args)).cast("string"), F.lit(PARSE))


#: Bucket units in the order they are tried, with their patterns.
UNITS = [("nanos", "yyyy-MM-dd HH:mm:ss.SSSSSSSSS"), ("seconds", "yyyy-MM-dd HH:mm:ss"), ("minutes", "yyyy-MM-dd HH:mm"), ("hours", "yyyy-MM-dd HH"), ("days", "yyyy-MM-dd"), ("months", "yyyy-MM"), ("years", "yyyy")]


@rule("buckettime", low=2, high=4)
def _buckettime(ctx, _, args):
    unit = const(args[1]).lower()
    pattern = next((p for n, p in UNITS if unit and n.startswith(unit)), None)
    if pattern is None:
        raise TemplateError("enum", unit)
    out = F.date_format(_wall(ctx, args), pattern)
    if unit == "n" or pattern.endswith("S"):
        out = F.regexp_replace(out, r"(?:\.|(\.\d*[1-9]))0+$", "$1")
    return F.coalesce(out, F.lit(PARSE))


#: Seconds of duration units.
SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


@rule("duration", low=1, high=1)
def _duration(ctx, _, args):
    return bound(args_of(ctx, args)[0], _seconds_of)


def _seconds_of(s: Column) -> Column:
    total = F.lit(0.0)
    for u, f in SECONDS.items():
        found = F.regexp_extract_all(s, F.lit(rf"([0-9]*\.?[0-9]+){u}(?![a-zµ])"), F.lit(1))
        total = total + F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double")) * f
    whole = F.when(s.startswith("-"), -total).otherwise(total).cast("bigint").cast("string")
    return F.when(s == "0", "0").when(s.rlike(r"^[+-]?([0-9]*\.?[0-9]+(h|ms|m|s|us|µs|ns))+\z"), whole).otherwise(PARSE)


@rule("durationformat", low=1, high=1)
def _durationformat(ctx, _, args):
    return bound(as_int(args_of(ctx, args)[0]), _duration_text)


def _duration_text(v: Column) -> Column:
    a = F.abs(v)
    h, m, s = (F.floor(a / 3600).cast("string"), F.floor(a % 3600 / 60).cast("string"), (a % 60).cast("string"))
    body = F.when(a >= 3600, F.concat(h, F.lit("h"), m, F.lit("m"), s, F.lit("s"))).when(a >= 60, F.concat(m, F.lit("m"), s, F.lit("s"))).otherwise(F.concat(s, F.lit("s")))
    return F.coalesce(F.concat(F.when(v < 0, "-").otherwise(""), body), F.lit(BAD))
