"""Scales of values to 0..1 as column formulas."""

from pyspark.sql import functions as F


def unit(v, low, high, kind: str = "linear"):
    """linear, log2 or log10 position between low and high; 0 below, 1 above, logs of values up to 1 are 0."""
    if kind not in ("linear", "log2", "log10"):
        raise ValueError(kind)
    f = (lambda x: x) if kind == "linear" else (lambda x: F.when(x <= 1, 0.0).otherwise(F.log2(x) if kind == "log2" else F.log10(x)))
    a, b = (f(low), f(high)) if kind == "linear" else (F.floor(f(low)).cast("double"), F.ceil(f(high)).cast("double"))
    return F.when(v <= low, 0.0).when(v >= high, 1.0).otherwise(F.try_divide(f(v) - a, F.nullif(b - a, F.lit(0.0))))


def bucket(u, n: int):
    """0 to n-1."""
    return F.floor(u * (n - 1)).cast("int")
