"""URL rules indexed by their rarest literal token, in DataFrame functions only.

A rule `host/path` becomes one anchored regular expression over the canonical
`host/path` of a url. Its whole literal tokens are counted over all urls; the rule is
filed under the rarest. A url's tokens fetch candidate rules; only those run their
expression and the longest that fits decides. No fitting rule: `default`.

Up to `inline` rules the index is a literal map and no url is shuffled. Beyond, however
many, it is a table: the tokens of the distinct urls are joined with it, the best rule of
each is picked by a partial aggregate and joined back.

A rule without a path fits every path of its hosts; of two rules of one text `block` wins.
Null urls and urls without `://` have empty host and path and fit no rule; repeated
rows are judged alike; an empty table gives no rows; an empty rule list gives `default`
everywhere; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._util import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def rule_table(spark, rules) -> DataFrame:
    """(verdict, rule, pattern, t: the tokens that are whole in every url the rule fits; an open end may go on)."""
    if isinstance(rules, DataFrame):
        listed = rules.select(F.col("verdict"), F.col("rule")).distinct()
    else:
        text = F.lit(json.dumps([{"verdict": k, "rule": r} for k, r in sorted(set(rules))]))
        listed = spark.range(1).select(F.inline(F.from_json(text, "array<struct<verdict:string,rule:string>>")))
    rule = F.col("rule")
    quoted = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    host, path = F.substring_index(rule, "/", 1), F.expr("substring(rule, instr(rule, '/') + 1)")
    bare = ~F.contains(rule, F.lit("/"))
    pattern = F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quoted(host), F.when(bare, F.lit("(?:/|$)")).otherwise(F.concat(F.lit("/"), quoted(path))))
    parts = F.split(rule, "[./]")
    whole = F.filter(F.when(bare | F.endswith(rule, F.lit("/")), parts).otherwise(F.slice(parts, F.lit(1), F.size(parts) - 1)), lambda t: t != "")
    return listed.where("rule is not null").select("verdict", "rule", pattern.alias("pattern"), F.array_distinct(whole).alias("t"))


def _canonical(pages: DataFrame) -> DataFrame:
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    bare = F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^?#]*", 0)
    host = F.translate(F.regexp_extract(bare, r"(?s)^[^/]*", 0), UPPER, LOWER)
    return pages.select("page_id", "url").select("page_id", host.alias("host"), F.regexp_extract(bare, r"(?s)^[^/]*(.*)$", 1).alias("path"))


def _tokens(where: Column) -> Column:
    return F.array_distinct(F.split(where, "[./]"))


def judge(pages: DataFrame, rules=RULES, default: str = "allow", inline: int = 200) -> DataFrame:
    """`rules`: pairs (verdict, rule), or a table of them."""
    rows, where = _canonical(pages), F.concat("host", "path")
    listed = rule_table(pages.sparkSession, rules)
    wanted = listed.select("rule", "verdict", "pattern", F.explode("t").alias("t"))
    seen = rows.select(F.explode(_tokens(where)).alias("t")).join(wanted.select("t").distinct(), "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    entry = F.struct(F.length("rule").alias("n"), "rule", "verdict", "pattern")
    filed = wanted.join(seen, "t", "left").groupBy("rule", "verdict", "pattern").agg(F.min_by("t", F.struct(F.coalesce("n", F.lit(0)), "t")).alias("t")).select("t", entry.alias("entry"))
    few = filed.limit(inline + 1).collect()
    fits = lambda c: F.regexp_like(F.concat("host", "path"), c["pattern"])
    if len(few) <= inline:
        index: dict[str, list] = {}
        for r in few:
            index.setdefault(r.t, []).append(F.struct(*[F.lit(v).alias(k) for k, v in r.entry.asDict().items()]))
        best = F.lit(None).cast("struct<n:int,rule:string,verdict:string,pattern:string>")
        if index:
            found = F.create_map(*[x for t, entries in sorted(index.items()) for x in (F.lit(t), F.array(*entries))])
            fetched = F.flatten(F.filter(F.transform(_tokens(where), lambda t: F.try_element_at(found, t)), lambda x: x.isNotNull()))
            best = F.array_max(F.filter(fetched, fits))
        judged = rows.withColumn("best", best)
    else:
        candidates = rows.select("host", "path").distinct().select("host", "path", F.explode(_tokens(where)).alias("t")).join(filed, "t")
        best = candidates.where(fits(F.col("entry"))).groupBy("host", "path").agg(F.max("entry").alias("best"))
        judged = rows.join(best, ["host", "path"], "left")
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op5_urlfilter(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"))


_FITS = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"


def _sql() -> str:
    cases = []
    for kind, rule in sorted(RULES, key=lambda x: -len(x[1])):
        h, _, p = rule.partition("/")
        cases.append((_FITS.format(h=h, p="/" + p), rule, kind))
    pick = lambda i, other: "case " + " ".join(f"when {c[0]} then '{c[i]}'" for c in cases) + f" else {other} end"
    return f"""with a as (select page_id, case when strpos(url, '://') > 0 then url[strpos(url, '://') + 3:] else '' end r from pages),
b as (select page_id, regexp_extract(r, '^[^?#]*') r from a),
c as (select page_id, translate(regexp_extract(r, '^[^/]*'), '{UPPER}', '{LOWER}') host, regexp_extract(r, '^[^/]*(.*)$', 1) path from b)
select page_id, host, path, {pick(1, 'null')} as rule, {pick(2, "'allow'")} as verdict from c"""


QUERIES, SQL = {"op5_urlfilter": op5_urlfilter}, {"op5_urlfilter": _sql()}
