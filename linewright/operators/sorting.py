"""Text-aware orders as lists of sort columns. Orders that look at the whole key set decide by one aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Names in their natural order.
WEEKDAYS = [("sunday", "sun"), ("monday", "mon"), ("tuesday", "tue", "tues"), ("wednesday", "wed"), ("thursday", "thu", "thur", "thurs"), ("friday", "fri"), ("saturday", "sat")]
MONTHS = [("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"), ("august", "aug"), ("september", "sep", "sept"), ("october", "oct"), ("november", "nov"), ("december", "dec")]


def smart(key: Column) -> list[Column]:
    from ..functions.library import fitting

    n = fitting(key, r"-?[0-9]+").try_cast("double")
    return [n.isNull(), n, key]


def numeric(key: Column) -> list[Column]:
    from ..functions.library import as_num

    n = as_num(key)
    return [n.isNull(), n, key]


def _rank(key: Column, names) -> Column:
    pairs = [F.lit(x) for i, group in enumerate(names) for name in group for x in (name, i)]
    return F.try_element_at(F.create_map(*pairs), F.lower(key))


def sort_key(df: DataFrame, kind: str, key: str = "key", value: str = "count") -> tuple[list[Column], bool]:
    """The columns that `kind` sorts by, and whether all of them fall."""
    from ..functions.library import Context
    from ..functions.template import Template, Var
    from ..functions.times import parsed

    kind, _, order = kind.partition(":")
    k = F.col(key)
    if kind == "text":
        out = [k]
    elif kind == "smart":
        out = smart(k)
    elif kind == "numeric":
        out = numeric(k)
    elif kind == "value":
        out = [F.col(value), k]
    elif kind in ("contextual", "date"):
        t = parsed(Context(lambda _: k), Template((Var("0"),)), "auto")["wall"]
        w, m = _rank(k, WEEKDAYS), _rank(k, MONTHS)
        seen = df.agg(F.bool_and(t.isNotNull()).alias("t"), F.bool_and(w.isNotNull()).alias("w"), F.bool_and(m.isNotNull()).alias("m")).first()
        out = [t, k] if kind == "date" and seen.t else [w, k] if seen.w else [m, k] if seen.m else smart(k)
    else:
        raise ValueError(kind)
    return out, (order in ("desc", "reverse", "rev")) != (kind == "value" and order in ("", "rev", "reverse"))


def sort_columns(df: DataFrame, kind: str, key: str = "key", value: str = "count") -> list[Column]:
    """Sort columns of `kind`: text, smart, numeric, contextual, date or value; `kind:desc` or `:rev` flips, and value falls by default."""
    out, down = sort_key(df, kind, key, value)
    return [c.desc() if down else c.asc() for c in out]


def ranked(df: DataFrame, kind: str, key: str = "key", value: str = "count", ranges: int = 256, few: int = 10_000) -> DataFrame:
    """df with its place in the order of `kind` as `rank`, from 1.

    Rows are dealt to ranges of the order, cut at places from a sample, and ranked within; a range's rows
    come after those of the ranges before it. No task sorts all rows, unless they are `few`.
    """
    columns, down = sort_key(df, kind, key, value)
    order, n = F.struct(*columns), df.count()
    cuts = []
    if n > few:
        sample = sorted_sample(df.select(order.alias("s")), 20 * ranges, n)
        cuts = [sample[i] for i in range(len(sample) // ranges, len(sample), max(1, len(sample) // ranges))]
    places = F.array(*[F.struct(*[F.lit(v) for v in c]) for c in cuts]) if cuts else None
    dealt = df.select("*", order.alias("_o")).withColumn("_part", F.size(F.filter(places, lambda c: c <= F.col("_o"))) if cuts else F.lit(0))
    before = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per range
    within = F.row_number().over(Window.partitionBy("_part").orderBy("_o"))
    place = dealt.withColumn("_k", within).join(F.broadcast(before), F.col("_part") == F.col("_p"))
    rank = F.col("_before") + F.col("_k")
    return place.select(*df.columns, ((n + 1 - rank) if down else rank).cast("int").alias("rank"))


def sorted_sample(df: DataFrame, size: int, n: int) -> list:
    """About `size` of the n values of column `s`, in order."""
    return [r.s for r in df.where(F.rand(5) < size / n).orderBy("s").collect()]
