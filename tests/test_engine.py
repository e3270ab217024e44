"""The line engine: catalogue against DuckDB, golden values, functions, errors, sources and streaming."""

import duckdb
import pytest
from pyspark.sql import functions as F

from linewright.functions.formula import FormulaError, compile_formula
from linewright.functions.library import compile_template
from linewright.functions.template import TemplateError, load_functions, parse
from linewright.operators import matcher
from linewright.operators.engine import Lines, minmax, wide
from linewright.operators.sorting import ranked, sort_columns
from linewright.plans import catalogue
from linewright.sources import text as source
from linewright.streaming import tail

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), con.execute(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)

    def rows(d):
        d = d[columns].astype(object).where(d[columns].notna(), None)
        return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.values.tolist()), key=str)

    assert rows(got) == rows(want)


#: template, value of {0} and {1}, expected
CASES = [
    ("{bucket {0} 50}", "-100", "-150"), ("{eq {0} a a}", "a", ""), ("{divi {0} 0}", "5", "9223372036854775807"), ("{modi -7 3}", "", "-1"), ("{round 2.5}", "", "2"),
    ("{sumf 1 .5}", "", "1.5"), ("{multf 100000 123.45678}", "", "12345678"), ("{divf 1 0}", "", "+Inf"), ("{substr {0} -3}", "abcdef", "def"), ("{len {0}}", "é", "2"),
    ("{select {0} 1}", 'a "b c" d', "b c"), ("{clamp {0} 1 5}", "9", "max"), ("{time {0} NGINX}", "14/Apr/2016:19:12:25 +0200", "1460653945"), ("{buckettime {0} hour}", "14/Apr/2016:19:12:25 +0200", "2016-04-14 19"),
    ("{@join {@map {@split {0}} {sumi {0} 1}} ,}", "1 2", "2,3"), ("{percent 0.5}", "", "50.0%"), ("{bytesize 2048}", "", "2 KB"), ("{hi 12345}", "", "12,345"), ("{csv a {0}}", 'x"y', 'a,"x""y"'),
    ("{json {0} a.1}", '{"a":[1,"z"]}', "z"), ("{json {0} a.#}", '{"a":[1,2]}', "2"), ("{durationformat 14400}", "", "4h0m0s"), ("{duration 1h30m}", "", "5400"), ("{isint {0}}", "1 ", ""), ("{basename {0}}", "", "."),
    ("{replace {0} \"\" x}", "ab$", "xaxbx$x"), ("{replace {0} {1} x}", "a<NAME>", "ax"), ("{dirname {0}}", "a/../b/c", "b"), ("{dirname {0}}", "/../a//b/", "/a/b"), ("{dirname {0}}", "x", "."), ("{dirname {0}}", "../../x", "../.."), ("{dirname {0}}", "/x", "/"), ("{dirname {0}}", "", "."),
    ("{format %q {0}}", 'a"b', '"a\\"b"'), ("{format %5d {0}}", "7", "%!d(string=7)"), ("{format '%-4s|%4s|%.1s' ab cd ef}", "", "ab  |  cd|e"), ("{format %s}", "", "%!s(MISSING)"), ("{format a b}", "", "a%!(EXTRA string=b)"), ("{format 100%% {0}}", "", "100%%!(EXTRA string=)"), ("{format %x ab}", "", "6162"),
    ("{json {0} a.#.b}", '{"a": [{"b": 1}, {"c": 2}, {"b":{"x" :3}}]}', '[1,{"x" :3}]'), ("{json {0} a.*}", '{"a":{"k" : { "b": 1 }}}', '{ "b": 1 }'), ("{json {0} a?c}", '{"x":1,"abc":"é\\n"}', "é\n"), ("{json {0} a\\\\\\.b}", '{"a.b":5}', "5"), ("{json {0} #}", "[1, 2]", "2"), ("{json {0} x.#}", "no json", ""), ("{json {0} a.#.b}", '{"a":null}', ""), ("{json {0} a.b*}", '{"a":{"bb":null}}', ""),
    ("{percent 0.5 1 0 0}", "", "+Inf%"), ("{@len {@for 1 {lte {0} 2500} {sumi {0} 1}}}", "", "2500"), ("{@join {@for 0 {lt {1} 3} {sumi {0} 5}} ,}", "", "0,5,10"), ("{log10 100}{log2 8}{ln 1}", "", "230"), ("{log10 0}{ln -1}", "", "-InfNaN"), ("{color red x}", "", "\x1b[31mx\x1b[0m"),
    ("{! 0x10 + 0b11 + 0o7}", "", "26"), ("{! 6 & 3 | 8}", "", "10"), ("{! abs(-2) + sqrt(9) + exp2(3) + log2(4) + round(2.4) + ceil(1.2)}", "", "19"), ("{! 1/0}", "", "+Inf"), ("{sumf 1e20 0}", "", "100000000000000000000"), ("{multf 1e-4 1}", "", "0.0001"), ("{subf 1 2.5}", "", "-1.5"), ("{pow 2 10}", "", "1024"), ("{isnum inf}{isnum 1e5}{isnum 1d}", "", "11"),
    ("a\\{b", "", "a{b"), ("{if {0} yes no}", "  ", "no"), ("{and {0} b}", " ", "1"), ("{repeat - 3}", "", "---"), ("{! 2^3^2}", "", "64"), ("{nope}", "", "<NAME>"), ("{bar 5 10 4}", "", "██"),
]


#: template, value of {0}, expected; clocks, layouts and zones
TIMES = [
    ("{time {0} auto}", "14/Apr/2016:19:12:25 +0200", "1460653945"), ("{time {0} RFC1123}", "Thu, 14 Apr 2016 17:12:25 GMT", "1460653945"), ("{time {0} RFC1123Z}", "Thu, 14 Apr 2016 19:12:25 +0200", "1460653945"),
    ("{time {0} ANSIC}", "Thu Apr 14 17:12:25 2016", "1460653945"), ("{time {0} ANSIC}", "Mon Apr  4 17:12:25 2016", "1459789945"), ("{time {0} UNIX}", "Thu Apr 14 17:12:25 UTC 2016", "1460653945"),
    ("{time {0} RUBY}", "Thu Apr 14 19:12:25 +0200 2016", "1460653945"), ("{time {0} RFC822}", "14 Apr 16 17:12 UTC", "1460653920"), ("{time {0} RFC822Z}", "14 Apr 16 19:12 +0200", "1460653920"),
    ("{time {0} RFC3339}", "2016-04-14T19:12:25+02:00", "1460653945"), ("{time {0} RFC3339N}", "2016-04-14T17:12:25.123456Z", "1460653945"), ("{time {0}}", "Apr 14, 2016 7:12:25 PM", "1460661145"),
    ("{time {0}}", "14 Apr 2016 19:12:25", "1460661145"), ("{time {0}}", "April 14, 2016", "1460592000"), ("{time {0}}", "2016-04-14 19:12:25.5 +0200", "1460653945"), ("{time {0}}", "2016/04/14", "1460592000"),
    ("{time {0}}", "4/14/2016 7:12 AM", "1460617920"), ("{time {0}}", "Thu, 14 Apr 2016 19:12:25 +0200", "1460653945"), ("{time {0}}", "Thu Apr 14 17:12:25 2016", "1460653945"), ("{time {0}}", "1460653945", "1460653945"),
    ("{time {0}}", "2026-01-02 12:19:22", "1767356362"), ("{time {0}}", "31/Feb/2016:19:12:25 +0200", "<PARSE-ERROR>"), ("{time {0}}", "2016-04-14 25:00:00", "<PARSE-ERROR>"), ("{time {0} epoch}", "a", "<PARSE-ERROR>"), ("{time {0}}", "", "<PARSE-ERROR>"),
    ('{time {0} "2006-01-02 15:04" America/New_York}', "2016-07-01 12:00", "1467388800"), ('{time {0} "2006-01-02 15:04" America/New_York}', "2016-01-01 12:00", "1451667600"), ('{time {0} "2006-01-02 15:04" Europe/Berlin}', "1965-06-01 12:00", "-144680400"),
    ("{timeformat 0 NGINX America/New_York}", "", "31/Dec/1969:19:00:00 -0500"), ("{timeformat 1467388800 RFC1123 America/New_York}", "", "Fri, 01 Jul 2016 12:00:00 EDT"), ("{timeformat 0}", "", "1970-01-01T00:00:00Z"),
    ("{timeformat 0 RFC3339 Asia/Kolkata}", "", "1970-01-01T05:30:00+05:30"), ("{timeformat {time {0} NGINX} RFC3339 utc}", "14/Apr/2016:19:12:25 +0200", "2016-04-14T17:12:25Z"), ("{timeformat {0} RFC3339}", "14/Apr/2016:19:12:25", "2016-04-14T19:12:25Z"),
    ("{timeformat {sumi {time {0} NGINX} {duration 24h}} RFC822 utc}", "14/Apr/2016:19:12:25 +0200", "15 Apr 16 17:12 UTC"), ("{timeformat x}", "", "<PARSE-ERROR>"), ("{timeformat 86399 \"_2 at 3PM\"}", "", " 1 at 11PM"),
    ("{buckettime {0} nanos nginx}", "14/Apr/2016:19:12:25.123 +0200", "2016-04-14 19:12:25.123"), ("{buckettime {0} n}", "2016-04-14 19:12:20", "2016-04-14 19:12:20"), ("{buckettime {0} d}", "14/Apr/2016 23:00:00", "2016-04-14"),
    ("{timeattr {0} weekday epoch utc}", "1460595600", "4"), ("{timeattr {0} Yearweek}", "14/Apr/2016 01:00:00", "2016-15"), ("{buckettime 0 hour auto America/New_York}", "", "1969-12-31 19"), ("{timeattr {0} quarter_iso}", "2016-12-31", "4"),
]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_times(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for t, value, want in TIMES:
            col = compile_template(t, lambda n, v=value: F.lit(v) if n == "0" else F.lit("<NAME>"))
            assert spark.range(1).select(col).first()[0] == want, (t, value)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    delta = spark.range(1).select(compile_template("{time delta}", lambda n: F.lit(""))).first()[0]
    assert 0 <= int(delta) < 3600
    with pytest.raises(TemplateError):
        compile_template("{timeattr 0 weekday auto nowhere}", lambda n: F.lit(""))


def test_patterns(spark):
    for pattern, line, want in [
        (r"[[:digit:]]+", "ab12", "12"), (r"[[:alpha:]_]+", "1a_b2", "a_b"), (r"[^[:space:]]+", "  xy z", "xy"), (r"\Qb$\E", "ab$", "b$"), (r"(?i)É", "é", "é"), (r"a$", "b\na", "a"), (r"(?m)^b$", "a\nb\nc", "b"), (r"[]x]+", "a]x", "]x"),
        (r"[a&&b]+", "&b", "&b"), (r"\p{Greek}+", "aβγ", "βγ"), (r"\pL+", "1é", "é"), (r"x\vy", "x\x0by", "x\x0by"), (r"a|ab", "ab", "a"), (r"\101", "A", "A"), (r"(?s)a.b", "a\nb", "a\nb"), (r"[[a]", "[", "["), ("\ufdd0(.)", "a\ufdd0b", "\ufdd0b"),
    ]:
        df = spark.createDataFrame([(line,), ("",)], "value string")
        assert [r.key for r in Lines(df).match(pattern).extract("{0}").collect()] == [want], pattern
    for pattern in (r"(?=a)", r"a++", r"\1", r"(?U)a", r"\h", r"[[:nope:]]", "a\\"):
        with pytest.raises(matcher.MatchError):
            matcher.regex(pattern)
    df = spark.createDataFrame([("abab xyxy",), ("",), ("foobar",)], "value string")
    assert [r.key for r in Lines(df).match(r"(?P<t>\w\w)\k<t>", backtracking=True).extract("{t}").collect()] == ["ab"]
    assert Lines(df).match(r"foo(?=bar)|^$", backtracking=True).matched().count() == 1
    assert [r.key for r in Lines(df).match(r"foo|(foob)(ar)?", longest=True).extract("{0},{1},{2}").collect()] == ["foobar,foob,ar"]
    assert [r.key for r in Lines(df).match(r"FOO|foob", True, longest=True).extract("{0}").collect()] == ["foob"]
    with pytest.raises(matcher.MatchError):
        Lines(df).match("a").dissect("%{a}")


def test_one_extraction_a_row(spark):
    for name in ("histogram", "histogram_topn", "match_regex", "tabulate", "reduce"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_replace(") == 1 and plan.count("date_format(") <= 2 and plan.count("rlike") + plan.count("RLIKE") <= 3, name
    plan = catalogue.QUERIES["time"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("yyyy") <= 4 and plan.count(" AT TIME") == 0


def test_functions(spark):
    for t, value, want in CASES:
        col = compile_template(t, lambda n, v=value: F.lit(v) if n == "0" else F.lit("<NAME>"))
        assert spark.range(1).select(col).first()[0] == want, t


def test_compile_errors():
    for t in ("{", "}", "{}", "{nope a b}", "{eq a}", "{bucket {0} x}", "{@split {0} \"\"}", "{buckettime {0} zz}", "a\\"):
        with pytest.raises((TemplateError, ValueError)):
            compile_template(t, lambda n: F.lit(""))
    for t in ("(1", "1)", "1 +", "1 2"):
        with pytest.raises(FormulaError):
            compile_formula(t, lambda n: F.lit(1.0))
    for t in ("%{a", "%{a}%{b}", "%{a} %{a}"):
        with pytest.raises(matcher.MatchError):
            matcher.dissect(t)


def test_user_functions(spark):
    known = load_functions("double {multi {0} 2} # twice\nquad \\\n {double {double {0}}}\n")
    assert spark.range(1).select(compile_template("{quad 3}", lambda n: F.lit(""), known)).first()[0] == "12"
    assert parse("x").constant == "x"
    known = load_functions("dbl {@join {@map {@split {0}} {multi {0} 2}} ,}\nkeep {@join {@filter {@split {0}} {gt {0} 1}} {1}}\nadd {@reduce {@split {0}} {sumi {0} {1}} {1}}")
    got = [spark.range(1).select(compile_template(t, lambda n: F.lit("1 2 3") if n == "1" else F.lit("?"), known)).first()[0] for t in ("{dbl {1}}", "{keep {1} -}")]
    assert got == ["2,4,6", "2-3"]


def test_dissect_does_not_reconsider(spark):
    m = matcher.dissect("p%{x}q%{y}r")
    rows = {r.v: r for r in spark.createDataFrame([("pXq pYqZ",), ("apXqYrz",)], "v string").select("v", m.test(F.col("v")).alias("t"), m.group(F.col("v"), 0).alias("g"), m.group(F.col("v"), 2).alias("y")).collect()}
    assert not rows["pXq pYqZ"].t and rows["apXqYrz"].g == "pXqYr" and rows["apXqYrz"].y == "Y"


def test_golden_histogram_and_tables(spark):
    lines = source.from_lines(spark, ["a 5\r\n", "b 22", "c", "d 5", "", "e"])
    assert {(r.key, r["count"]) for r in Lines(lines).match(r"(\d+)").histogram("{bucket {1} 10}").collect()} == {("0", 2), ("20", 1)}
    m = Lines(lines).metrics().first()
    assert (m.read, m.matched) == (6, 6) and Lines(lines).extract().count() == 5
    heat = source.from_lines(spark, ["b x", "c x", "a y", "b y", "c y", "c y", "a z", "a z", "a z", "a z"])
    long = Lines(heat).match(r"(\w) (\w)").table("{$ {1} {2}}")
    assert tuple(minmax(long).first()) == (0, 4)
    assert [tuple(r) for r in wide(long, ["a", "b", "c"]).orderBy("row").collect()] == [("x", 0, 1, 1), ("y", 1, 1, 2), ("z", 4, 0, 0)]


def test_analyze_and_order(spark):
    df = source.from_lines(spark, [str(i) for i in range(10)])
    r = Lines(df).analyze("{0}").first()
    assert (r.samples, r["median"], r["mode"], r.p90) == (10, 5.0, 0.0, 9.0)
    keys = spark.createDataFrame([(k, 1) for k in ("mon", "Tuesday", "sun")], "key string, count int")
    assert [x.key for x in keys.orderBy(*sort_columns(keys, "contextual")).collect()] == ["sun", "mon", "Tuesday"]


def test_ranks_by_ranges(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("n")).select(F.when(F.col("n") % 5 == 0, F.concat(F.lit("x"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string")).alias("key"), F.lit(1).alias("count"))
    for kind in ("text", "text:desc", "numeric", "smart", "smart:desc", "value"):
        want = [r.key for r in df.orderBy(*sort_columns(df, kind)).collect()]
        got = ranked(df, kind, ranges=8, few=10)
        assert [r.key for r in got.orderBy("rank").collect()] == want and got.agg(F.max("rank")).first()[0] == 500, kind


def test_sources(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\rx\n")
    (tmp_path / "d" / "b.txt").write_text("three\n")
    assert [r.value for r in source.read(spark, str(tmp_path / "a.log")).collect()] == ["one", "two\rx"]
    assert [(r.line, r.value) for r in source.read(spark, str(tmp_path / "a.log"), numbered=True).collect()] == [(1, "one"), (2, "two\rx")]
    assert [p[-5:] for p in source.walk([str(tmp_path)], recursive=True, exclude=["*.log"])] == ["b.txt"]
    assert list(source.walk([str(tmp_path / "none*")])) == [str(tmp_path / "none*")]


def test_follow(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text("a 1\na 2\nb")
    seen = {}
    lines = Lines(tail.follow(spark, str(p))).match(r"^(\w)")
    q = tail.live(lines.histogram("{1}"), lambda df: seen.update({r.key: r["count"] for r in df.collect()}), "0 seconds", str(tmp_path / "ck"))
    try:
        q.processAllAvailable()
        assert seen == {"a": 2}
        with p.open("a") as f:
            f.write(" 3\nc\n")
        q.processAllAvailable()
        assert seen == {"a": 2, "b": 1, "c": 1}
    finally:
        q.stop()
