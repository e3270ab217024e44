"""Text pictures of small results: plain functions from values to lines."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Characters of bars, sparks and heat, and terminal colours.
EIGHTHS = " ▏▎▍▌▋▊▉█"
SPARKS, PLAIN_SPARKS = "_▁▂▃▄▅▆▇█", "_.-^"
DIGITS = "0123456789ABCDEF"
HEAT = "-123456789"
HEAT_COLORS = (16, 17, 18, 19, 20, 21, 57, 93, 129, 165, 201, 200, 199, 198, 197, 196)
COLORS = {"red": "31", "green": "32", "yellow": "33", "blue": "34", "magenta": "35", "cyan": "36", "gray": "90", "bright blue": "94", "bright white": "97", "underline": "4"}
SERIES = ("31", "32", "33", "34", "35", "36", "91", "92", "93", "94", "95", "96")


@dataclass(frozen=True)
class Style:
    """What the terminal shows: colour codes, characters beyond ASCII."""

    color: bool = False
    unicode: bool = True

    def paint(self, text: str, color: str) -> str:
        code = COLORS.get(color, color)
        return f"\x1b[{code}m{text}\x1b[0m" if self.color and text else text

    def bar(self, share: float, width: int, color: str = "blue") -> str:
        if not self.unicode:
            return self.paint("|" * int(share * width), color)
        parts = int(share * width * len(EIGHTHS))
        full, rest = divmod(parts, len(EIGHTHS))
        return self.paint("█" * full + (EIGHTHS[rest] if rest else ""), color)

    def key(self, i: int) -> str:
        """The mark of a series."""
        return self.paint("█" if self.unicode else "|", SERIES[i % len(SERIES)]) if self.color else DIGITS[i % 16]

    def heat(self, share: float) -> str:
        if not self.color:
            return HEAT[int(share * (len(HEAT) - 1))]
        code = HEAT_COLORS[int(share * (len(HEAT_COLORS) - 1))]
        return f"\x1b[38;5;{code}m{'█' if self.unicode else '#'}\x1b[0m"

    def spark(self, share: float) -> str:
        marks = SPARKS if self.unicode else PLAIN_SPARKS
        return marks[int(share * (len(marks) - 1))]


class Scale:
    """Values to shares of 0..1; linear, log2 or log10."""

    def __init__(self, kind: str = "linear"):
        kinds = {"linear": "linear", "lin": "linear", "": "linear", "log10": "log10", "log": "log10", "log2": "log2"}
        if kind.lower() not in kinds:
            raise ValueError("unknown scaler, options: linear, log10, log2")
        self.base = {"linear": None, "log10": 10.0, "log2": 2.0}[kinds[kind.lower()]]

    def _at(self, v: float) -> float:
        return v if self.base is None else 0.0 if v <= 1 else math.log(v, self.base) if self.base != 10 else math.log10(v)

    def _ends(self, low: int, high: int) -> tuple[float, float]:
        return math.floor(self._at(low)), math.ceil(self._at(max(high, low + 1)))

    def share(self, v: int, low: int, high: int) -> float:
        if high < low or v < low:
            return 0.0
        if v > high:
            return 1.0
        a, b = self._ends(low, high)
        return (self._at(v) - a) / (b - a) if b != a else 0.0

    def keys(self, n: int, low: int, high: int) -> list[int]:
        """At most n values from low to high in even steps, none twice."""
        a, b = self._ends(low, high)
        steps = [(b - a) * i / (n - 1) + a for i in range(n)]
        return list(dict.fromkeys(int(x if self.base is None else self.base**x) for x in steps))


def visible(text: str) -> int:
    """Characters of a text without its colour codes."""
    out, i = 0, 0
    while i < len(text):
        if text[i] == "\x1b":
            i = text.find("m", i) + 1 or len(text)
        else:
            out, i = out + 1, i + 1
    return out


def _pad(text: str, width: int) -> str:
    return text + " " * (width - visible(text))


def grid(rows: list[list[str]]) -> list[str]:
    """Columns padded to their widest cell, each followed by a blank."""
    widths = [max((visible(r[i]) for r in rows if i < len(r)), default=0) for i in range(max(map(len, rows), default=0))]
    return ["".join(_pad(c, w) + " " for c, w in zip(r, widths)) for r in rows]


def histogram(items, total: int, rows: int, style: Style, scale: Scale, show, bars: bool = False, percent: bool = False) -> list[str]:
    """items: (key, count), shown(count) per item; as many lines as `rows`."""
    most = max((v for _, v in items), default=0)
    width = max([8, *(len(k) for k, _ in items)])
    out = []
    for (key, v), text in zip(items, show([(v, 0, most) for _, v in items])):
        line = style.paint(_pad(key, width), "yellow") + "    " + f"{text:<10}"
        if percent and total > 0:
            line += " " + style.paint(f"[{v / total * 100:4.1f}%]", "cyan")
        if bars and most > 0:
            line += " " + style.bar(scale.share(v, 0, most), 50)
        out.append(line)
    return out + [""] * (rows - len(out))


def bars(rows, keys: list[str], style: Style, scale: Scale, show, stacked: bool = False, inline: bool = False, size: int = 50) -> list[str]:
    """rows: (name, values in the order of keys)."""
    width, out = max([4, *(len(n) for n, _ in rows)]), []
    if not inline and (len(keys) > 1 or keys[:1] not in ([], [""])):
        out.append(" " * (width + 2) + "".join(f"  {style.key(i)} {k}" for i, k in enumerate(keys)))
    most = max((sum(v) if stacked else max(v, default=0) for _, v in rows), default=0)
    texts = iter(show([(sum(v), 0, most) for _, v in rows] if stacked else [(x, 0, most) for _, v in rows for x in v]))
    name_width = max(map(len, keys), default=0)
    for name, values in rows:
        lead = style.paint(_pad(name, width), "yellow") + "  "
        if stacked:
            marks = ["█" if style.unicode else "|"] * len(values) if style.color else [DIGITS[i % 16] for i in range(len(values))]
            parts = [style.paint(m * (min(v, most) * size // most if most else 0), SERIES[i % len(SERIES)]) for i, (m, v) in enumerate(zip(marks, values))]
            out.append(lead + "".join(parts) + "  " + next(texts))
            continue
        for i, v in enumerate(values):
            key = _pad(style.paint(keys[i], "bright blue"), name_width + 2) if inline and name_width else ""
            out.append((" " * (width + 2) if i else lead) + key + style.bar(scale.share(v, 0, most), size, SERIES[i % len(SERIES)]) + " " + next(texts))
    return out


def table(columns: list[str], rows, style: Style, show, low: int, high: int, row_totals=None, col_totals=None, total: int | None = None) -> list[str]:
    """rows: (name, values); totals of rows and columns where given."""
    head = ["", *[style.paint(c, "94;4") for c in columns], style.paint("Total", "90;4") if row_totals is not None else ""]
    out = [head]
    text = lambda values: show([(v, low, high) for v in values])
    for i, (name, values) in enumerate(rows):
        out.append([style.paint(name, "yellow"), *text(values), style.paint(text([row_totals[i]])[0], "gray") if row_totals is not None else ""])
    if col_totals is not None:
        out.append([style.paint("Total", "90;4"), *[style.paint(t, "gray") for t in text(col_totals)], style.paint(text([total])[0], "bright white") if row_totals is not None else ""])
    return grid(out)


def _header(names: list[str], size: int, style: Style) -> str:
    """Names over the first of their columns, dots between, the last name ending at the last column."""
    out, i = "", 0
    light = lambda name, at: name[:at] + style.paint(name[at], "96;4") + name[at + 1 :] if style.color and at < len(name) else name
    while i < size:
        if i:
            dots = min(size - i, 2)
            out, i = out + "." * dots, i + dots
            if i >= size:
                break
        name = names[i]
        if i and i + len(name) + 2 >= size:
            name = names[size - 1]
            room = max(0, size - i - len(name))
            return out + "." * room + light(name, size - i - room - 1)
        out, i = out + light(name, 0), i + max(1, len(name))
    return out


def heatmap(columns: list[str], rows, style: Style, scale: Scale, show, low: int, high: int, more_rows: int = 0, more_columns: int = 0) -> list[str]:
    """rows: (name, values); one character a cell, under a legend and the names of columns."""
    width = max((len(n) for n, _ in rows), default=0)
    keys = scale.keys(6, low, high)
    legend = "    ".join(f"{style.heat(scale.share(k, low, high))} {t}" for k, t in zip(keys, show([(k, low, high) for k in keys])))
    head = " " + _header(columns, len(columns), style)
    out = [" " + legend, head + (style.paint(f" ({more_columns} more)", "gray") if more_columns else "")]
    out += [style.paint(n, "yellow") + " " * (width - len(n) + 1) + "".join(style.heat(scale.share(v, low, high)) for v in values) for n, values in rows]
    return out + ([style.paint(f"({more_rows} more)", "gray")] if more_rows else [])


def sparklines(columns: list[str], rows, style: Style, scale: Scale, show, low: int, high: int, more_rows: int = 0) -> list[str]:
    """rows: (name, values); the first and last value beside a line of blocks."""
    if not columns:
        return []
    dots = max(0, len(columns) - len(columns[0]) - len(columns[-1]))
    out = [["", style.paint("First", "underline"), columns[0] + "." * dots + columns[-1], style.paint("Last", "underline")]]
    ends = show([(v, low, high) for _, values in rows for v in (values[0], values[-1])])
    for i, (name, values) in enumerate(rows):
        out.append([style.paint(name, "yellow"), style.paint(ends[2 * i], "gray"), "".join(style.spark(scale.share(v, low, high)) for v in values), style.paint(ends[2 * i + 1], "gray")])
    return grid(out) + ([style.paint(f"({more_rows} more)", "gray")] if more_rows else [])
