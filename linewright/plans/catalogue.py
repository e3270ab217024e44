"""One query per operator over the driver's tables, and its SQL restatement."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import scale
from ..operators.engine import Lines, format_columns, group_keys, last_columns, lookup_join, minmax, totals
from ..operators.fuzzy import fuzzy_keys
from ..operators.sorting import ranked
from ..sources.text import events_lines, read

QUERIES: dict = {}
ORACLE_SQL: dict = {}
LINE = """concat_ws(' ', event_id::varchar, '['||strftime(ts,'%d/%b/%Y:%H:%M:%S')||' +0000]', 'user='||user_id, event_type, value::varchar, props)"""
E = f"(select event_id, {LINE} as v from events)"


def query(name, sql=None):
    def wrap(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return wrap


def _lines(spark, sf):
    return Lines(events_lines(spark, sf))


def each(name, table, key, templates, sql, columns):
    """A query that evaluates templates over the text of a table's columns {1}, {2}, ..."""

    def run(spark, sf) -> DataFrame:
        df = spark.read.parquet(f"{sf}/{table}.parquet").select(key, *[F.expr(c).alias(f"c{i}") for i, c in enumerate(columns, 1)])
        lines = Lines(df, "c1")
        lines.variable = lambda n: F.col(f"c{n}") if n.isdigit() and 0 < int(n) <= len(columns) else F.col("c1") if n == "0" else F.lit("<NAME>")
        return lines.evaluate(df, templates, (key,))

    query(name, sql)(run)


# sources, matchers, projection ---------------------------------------------------------
query("scan_text", f"select event_id, v as value from {E}")(lambda s, d: events_lines(s, d))
query("match_always", f"select event_id, v as key from {E}")(lambda s, d: _lines(s, d).extract("{0}", ("event_id",)))
query("match_regex", f"select event_id, regexp_extract(v, 'user=(\\d+) (\\w+)', 1) || '/' || regexp_extract(v, 'user=(\\d+) (\\w+)', 2) as key from {E} where regexp_matches(v, 'user=(\\d+) (\\w+)')")(
    lambda s, d: _lines(s, d).match(r"user=(\d+) (\w+)").extract("{1}/{2}", ("event_id",)))
query("match_regex_named", f"select event_id, regexp_extract(v, '(error|view) ([0-9.]+)', 2) as key from {E} where regexp_matches(v, '(error|view) ([0-9.]+)')")(
    lambda s, d: _lines(s, d).match(r"(?P<kind_of>error|view) (?P<v>[0-9.]+)").extract("{v}", ("event_id",)))
query("match_regex_icase", f"select event_id, regexp_extract(v, '(?i)ERROR ([0-9]+)', 1) as key from {E} where regexp_matches(v, '(?i)ERROR ([0-9]+)')")(
    lambda s, d: _lines(s, d).match("ERROR ([0-9]+)", True).extract("{1}", ("event_id",)))
query("match_dissect", f"select event_id, split_part(split_part(v, 'user=', 2), ' ', 1) || '|' || split_part(split_part(v, 'user=', 2), ' ', 2) as key from {E}")(
    lambda s, d: _lines(s, d).dissect("user=%{u} %{kind} %{?rest}").extract("{u}|{kind}", ("event_id",)))
query("match_dissect_icase", f"select event_id, split_part(split_part(v, 'user=', 2), ' ', 1) as key from {E}")(
    lambda s, d: _lines(s, d).dissect("USER=%{u} ", True).extract("{u}", ("event_id",)))
query("ignore", f"select event_id, regexp_extract(v, 'user=(\\d+)', 1) as key from {E} where v not like '%error%' and regexp_extract(v, 'user=(\\d+)', 1)::bigint >= 20")(
    lambda s, d: Lines(events_lines(s, d).where("value not like '%error%'")).match(r"user=(\d+)").ignore("{lt {1} 20}").extract("{1}", ("event_id",)))
query("drop_empty_key", f"select event_id, regexp_extract(v, '(error)?', 1) as key from {E} where false union all select event_id, 'error' from {E} where v like '%error%'")(
    lambda s, d: _lines(s, d).match(r"^.*?(?:(error)|$)").extract("{1}", ("event_id",)))
query("match_counts", f"select count(*) as read, count(*) filter (where v like '%view%' and v not like '%user=1%') as matched, count(*) filter (where v like '%view%' and v like '%user=1%') as ignored from {E}")(
    lambda s, d: _lines(s, d).match("^.*view.*$").ignore("{like {0} user=1}").metrics())
query("filter", f"select event_id, regexp_extract(v, '^(\\d+)', 1) || chr(9) || regexp_extract(v, '(\\w+) [0-9.]+ \\{{', 1) as key from {E}")(
    lambda s, d: _lines(s, d).match(r"^(\d+).* (\w+) [0-9.]+ \{").filter(["{1}", "{2}"], ("event_id",)))
query("search", f"select event_id, v as key from {E} where regexp_matches(v, '(?i)PURCHASE 4')")(lambda s, d: _lines(s, d).match("^.*PURCHASE 4.*$", True).filter("{0}", ("event_id",)))
query("special_keys", f"select event_id, regexp_extract(v, 'user=(\\d+) (\\w+)', 1) || ',' || regexp_extract(v, 'user=(\\d+) (\\w+)', 2) || ' {{\"u\": ' || regexp_extract(v, 'user=(\\d+) (\\w+)', 1) || '}}' as key from {E}")(
    lambda s, d: _lines(s, d).match(r"user=(?P<u>\d+) (\w+)").extract("{@join {@} ,} {.}", ("event_id",)))



def _written(spark, sf):
    """The log lines as one text file, read back by the text source."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="linewright")
    path = f"{folder}/scan-{uuid.uuid4().hex}"
    events_lines(spark, sf).orderBy("event_id").select("value").coalesce(1).write.text(path)
    return path


query("scan_text_file", f"select v as value, row_number() over (order by event_id)::bigint as line from {E}")(lambda s, d: read(s, _written(s, d), numbered=True).select("value", "line"))
query("scan_text_twice", f"select v as value from {E} union all select v from {E}")(lambda s, d: (lambda p: read(s, p, p).select("value"))(_written(s, d)))
query("match_regex_posix", f"select event_id, regexp_extract(v, 'user=[0-9]+ [a-z]+') as key from {E}")(lambda s, d: _lines(s, d).match(r"user=[0-9]|user=[0-9]+ [a-z]+", longest=True).extract("{0}", ("event_id",)))
query("match_pcre2", f"select event_id, regexp_extract(v, 'user=([0-9]+) view', 1) as key from {E} where event_type = 'view'".replace("select event_id, v as key", "select").replace(f"from {E}", f"from (select event_id, event_type, {LINE} as v from events)"))(
    lambda s, d: _lines(s, d).match(r"(?<=user=)[0-9]+(?= view)", backtracking=True).extract("{0}", ("event_id",)))
query("match_classes", f"select event_id, regexp_extract(v, '[a-z]+ ([0-9.]+) ', 1) as key from {E}")(lambda s, d: _lines(s, d).match(r"[[:alpha:]]+ ([[:digit:].]+)\Q {\E").extract("{1}", ("event_id",)))
query("ignore_any", f"select event_id, regexp_extract(v, 'user=(\\d+)', 1) as key from (select event_id, event_type, user_id, {LINE} as v from events) where event_type <> 'error' and user_id >= 20 and user_id % 7 <> 0")(
    lambda s, d: _lines(s, d).match(r"user=(\d+) (\w+)").ignore("{eq {2} error}", "{lt {1} 20}", "{eq {modi {1} 7} 0}").extract("{1}", ("event_id",)))
query("special_keys_source", f"select event_id, 'log:' || event_id || ' {{\"0\": \"user=' || user_id || '\", \"1\": ' || user_id || '}} {{\"u\": ' || user_id || ', \"0\": \"user=' || user_id || '\", \"1\": ' || user_id || '}}' as key from events")(
    lambda s, d: Lines(events_lines(s, d).select("*", F.lit("log").alias("src"), F.col("event_id").alias("line"))).match(r"user=(?P<u>\d+)").extract("{src}:{line} {#} {.#}", ("event_id",)))
query("filter_limit", "select least(7, count(*))::bigint as n from events")(lambda s, d: _lines(s, d).filter("{0}", limit=7).agg(F.count("*").alias("n")))

# expressions ---------------------------------------------------------------------------
each("arithmetic_int", "lineitem", "l_orderkey", {"a": "{sumi {1} {2} 3}", "b": "{subi {1} {2}}", "c": "{multi {1} {2}}", "d": "{divi {1} {2}}", "e": "{modi {1} {2}}", "f": "{maxi {1} {2}}", "g": "{mini {1} {2}}", "h": "{sumi {1} x}", "i": "{divi {1} 0}"},
     "select l_orderkey, (l_partkey+l_suppkey+3)::varchar as a, (l_partkey-l_suppkey)::varchar as b, (l_partkey*l_suppkey)::varchar as c, case when l_suppkey=0 then '9223372036854775807' else (l_partkey//nullif(l_suppkey,0))::varchar end as d, case when l_suppkey=0 then '0' else (l_partkey%nullif(l_suppkey,0))::varchar end as e, greatest(l_partkey,l_suppkey)::varchar as f, least(l_partkey,l_suppkey)::varchar as g, '<BAD-TYPE>' as h, '9223372036854775807' as i from lineitem", ["cast(l_partkey as string)", "cast(l_suppkey as string)"])
each("arithmetic_float", "lineitem", "l_orderkey", {"a": "{round {sumf {1} {2}} 2}", "b": "{round {multf {1} {2}} 3}", "c": "{floor {1}}", "d": "{ceil {1}}", "e": "{round {divf {1} 7} 4}", "f": "{round {sqrt {1}} 4}", "g": "{sumf {2} x}"},
     "select l_orderkey, printf('%.2f', l_extendedprice+l_discount) as a, printf('%.3f', l_extendedprice*l_discount) as b, floor(l_extendedprice)::bigint::varchar as c, ceil(l_extendedprice)::bigint::varchar as d, printf('%.4f', l_extendedprice/7) as e, printf('%.4f', sqrt(l_extendedprice)) as f, '<BAD-TYPE>' as g from lineitem", ["cast(l_extendedprice as string)", "cast(l_discount as string)"])
each("buckets", "customer", "c_custkey", {"a": "{bucket {1} 500}", "b": "{bucketrange {1} 500}", "c": "{expbucket {2}}", "d": "{clamp {1} 0 5000}"},
     "with x as (select c_custkey, floor(c_acctbal)::bigint v from customer), y as (select *, (v // 500) * 500 - case when v < 0 then 500 else 0 end b from x) select c_custkey, b::varchar as a, b || ' - ' || (b + 499) as b, case when c_custkey = 0 then '0' else '1' || repeat('0', length(c_custkey::varchar) - 1) end as c, case when v < 0 then 'min' when v > 5000 then 'max' else v::varchar end as d from y", ["cast(floor(c_acctbal) as string)", "cast(c_custkey as string)"])
each("logic", "events", "event_id", {"a": "{if {eq {1} error} bad good}", "b": "{unless {eq {1} view} {1}}", "c": "{switch {eq {1} view} V {eq {1} click} C other}", "d": "{lt {2} 100}", "e": "{and {1} {eq {1} view}}", "f": "{or {eq {1} view} {gte {2} 400}}", "g": "{not {neq {1} view}}", "h": "{coalesce {eq {1} zzz} {1}}", "i": "{like {1} ic}{prefix {1} vi}{suffix {1} up}", "j": "{isnum {2}}{isint {2}}"},
     "select event_id, case when event_type='error' then 'bad' else 'good' end as a, case when event_type='view' then '' else event_type end as b, case event_type when 'view' then 'V' when 'click' then 'C' else 'other' end as c, case when value<100 then '1' else '' end as d, case when event_type='view' then '1' else '' end as e, case when event_type='view' or value>=400 then '1' else '' end as f, case when event_type='view' then '1' else '' end as g, event_type as h, case when event_type in ('click','view','signup') then event_type else '' end as i, '1' as j from events", ["event_type", "cast(value as string)"])
each("strings", "part", "p_partkey", {"a": "{len {1}}", "b": "{upper {1}}", "c": "{substr {1} 2 4}", "d": "{index {1} r}", "e": "{lastindex {1} r}", "f": "{replace {1} r RR}", "g": "{pick {2} # 1}", "h": "{select {1} 1}", "i": "{tab {1} {2}}", "j": "{csv {1} {2}}", "k": "{repeat ab 3}", "l": "{format '%s-%10s' {1} {2}}", "m": "{substr {1} -3}"},
     r"""select p_partkey, strlen(p_name)::varchar as a, upper(p_name) as b, substr(p_name,3,4) as c, (strpos(p_name,'r')-1)::varchar as d, case when strpos(p_name,'r')=0 then '-1' else (length(p_name)-strpos(reverse(p_name),'r'))::varchar end as e, replace(p_name,'r','RR') as f, split_part(p_brand,'#',2) as g, split_part(p_name,' ',2) as h, p_name||chr(9)||p_brand as i, p_name||','||p_brand as j, 'ababab' as k, p_name||'-'||lpad(p_brand,10,' ') as l, right(p_name,3) as m from part""", ["p_name", "p_brand"])
each("paths", "pages", "page_id", {"a": "{basename {1}}", "b": "{extname {1}}", "c": "{dirname {1}}"},
     "with x as (select page_id, regexp_extract(url, '^https?:/(/[^?#]*)', 1) p from pages) select page_id, regexp_extract(regexp_replace(p,'/+$',''),'([^/]*)$',1) as a, regexp_extract(p,'(\\.[^./]*)$',1) as b, regexp_extract(p,'^(.*)/[^/]*$',1) as c from x", ["regexp_extract(url, '^https?:/(/[^?#]*)', 1)"])
each("humanize", "orders", "o_orderkey", {"a": "{hi {2}}", "b": "{hf {1}}", "c": "{bytesize {2}}", "d": "{bytesizesi {2}}", "e": "{downscale {2} 1}", "f": "{percent {1} 1 500000}"},
     "with x as (select o_orderkey, o_totalprice p, floor(o_totalprice)::bigint n from orders) select o_orderkey, format('{:,}', n) as a, format('{:,.4f}', p) as b, case when n<1024 then n||' B' else printf('%.0f', n/1024.0::double)||' KB' end as c, case when n<1000 then n||' b' else printf('%.0f', n/1000.0::double)||' kB' end as d, case when n<1000 then n::varchar else printf('%.1f', n/1000.0::double)||'k' end as e, printf('%.1f', p*100/500000)||'%' as f from x", ["cast(o_totalprice as string)", "cast(floor(o_totalprice) as string)"])
each("arrays", "part", "p_partkey", {"a": "{@len {@split {1}}}", "b": "{@join {@map {@split {1}} {upper {0}}} -}", "c": "{@join {@filter {@split {1}} {like {0} r}} +}", "d": "{@select {@split {1}} -1}", "e": "{@reduce {@range 1 {3}} {sumi {0} {1}} 0}", "f": "{@join {@slice {@split {1}} 1 1}}", "g": "{@in {2} {$ Brand#1 Brand#17}}", "h": "{@join {@range 5 1 -2} ,}", "i": "{@join {@for 1 {lt {0} 20} {multi {0} 2}} ,}"},
     "with x as (select *, string_split(p_name,' ') l from part) select p_partkey, len(l)::varchar as a, upper(replace(p_name,' ','-')) as b, array_to_string(list_filter(l, lambda w: contains(w,'r')),'+') as c, l[-1] as d, case when p_size = 1 then '<BAD-TYPE>' else ((p_size*(p_size-1))//2)::varchar end as e, l[2] as f, case when p_brand in ('Brand#1','Brand#17') then '1' else '' end as g, '5,3' as h, '1,2,4,8,16' as i from x", ["p_name", "p_brand", "cast(p_size as string)"])
each("formula", "lineitem", "l_orderkey", {"a": "{round {! [1]*(1-[2])} 3}", "b": "{! [3]%7 + 2^3^1}", "c": "{! 2(3+1) << 1}", "d": "{! [3] > 100 && [3] < 500}", "e": "{! floor([1]/100)*100}", "f": "{! -abs(0-[3])}"},
     "select l_orderkey, printf('%.3f', l_extendedprice*(1-l_discount)) as a, (l_partkey%7+8)::varchar as b, '16' as c, case when l_partkey>100 and l_partkey<500 then '1' else '0' end as d, (floor(l_extendedprice/100)*100)::bigint::varchar as e, case when l_partkey = 0 then '-0' else (-l_partkey)::varchar end as f from lineitem", ["cast(l_extendedprice as string)", "cast(l_discount as string)", "cast(l_partkey as string)"])
each("formula_bits", "lineitem", "l_orderkey", {"a": "{! [0] & 12 | 1}", "b": "{! [0] >> 2}", "c": "{! [0] << 3}", "d": "{! 0x1f + 0b101 + 0o17}", "e": "{! [0] == 5 || [0] >= 100}", "f": "{! ![0] + abs(-[0])}", "g": "{round {! sqrt([0]) + exp(1) + log(10) + log2(8) + log10(100)} 4}", "h": "{round {! sin(1) + cos(1) + tan(1) + asin(0.5) + acos(0.5) + atan(1)} 4}", "i": "{! ceil([0] / 7) - floor([0] / 7)}"},
     "select l_orderkey, (l_partkey & 12 | 1)::varchar as a, (l_partkey >> 2)::varchar as b, (l_partkey << 3)::varchar as c, '51' as d, case when l_partkey = 5 or l_partkey >= 100 then '1' else '0' end as e, (case when l_partkey = 0 then 1 else 0 end + l_partkey)::varchar as f, printf('%.4f', sqrt(l_partkey) + exp(1) + ln(10) + 3 + 2) as g, printf('%.4f', sin(1) + cos(1) + tan(1) + asin(0.5) + acos(0.5) + atan(1)) as h, case when l_partkey % 7 = 0 then '0' else '1' end as i from lineitem", ["cast(l_partkey as string)"])
each("logarithms", "orders", "o_orderkey", {"a": "{round {log10 {1}} 4}", "b": "{round {log2 {1}} 4}", "c": "{round {ln {1}} 4}", "d": "{round {subf {1} 0.5} 2}", "e": "{round {pow {sqrt {1}} 2} 2}", "f": "{color red {1}}", "g": "{log10 0}"},
     "select o_orderkey, printf('%.4f', log10(o_totalprice)) as a, printf('%.4f', log2(o_totalprice)) as b, printf('%.4f', ln(o_totalprice)) as c, printf('%.2f', o_totalprice - 0.5) as d, printf('%.2f', pow(sqrt(o_totalprice), 2)) as e, chr(27) || '[31m' || o_totalprice || chr(27) || '[0m' as f, '-Inf' as g from orders", ["cast(o_totalprice as string)"])
each("strings_edge", "part", "p_partkey", {"a": "{replace {1} \"\" -}", "b": "{format '%q|%-9s|%.3s' {2} {2} {1}}", "c": "{dirname /x/../{2}/./y//z}", "d": "{dirname {2}}", "e": "{format %d {2}}"},
     "select p_partkey, '-' || regexp_replace(p_name, '(.)', '\\1-', 'g') as a, '\"' || p_brand || '\"|' || rpad(p_brand, greatest(9, length(p_brand))::int, ' ') || '|' || left(p_name, 3) as b, '/' || p_brand || '/y' as c, '.' as d, '%!d(string=' || p_brand || ')' as e from part", ["p_name", "p_brand"])
each("time_layouts", "events", "event_id", {a: "{time {%d}%s}" % (i, f" {n}" if n else "") for i, (a, n) in enumerate([("ansic", "ANSIC"), ("unix", "UNIX"), ("ruby", "RUBY"), ("rfc1123", "RFC1123"), ("rfc1123z", "RFC1123Z"), ("rfc3339", "RFC3339"), ("us", ""), ("long", ""), ("european", ""), ("day", "")], 1)},
     "select event_id, e as ansic, e as unix, e as ruby, e as rfc1123, e as rfc1123z, e as rfc3339, e as us, e as long, e as european, (epoch(date_trunc('day', ts)))::bigint::varchar as day from (select event_id, ts, epoch(date_trunc('second', ts))::bigint::varchar as e from events)",
     ["date_format(ts, 'EEE MMM d HH:mm:ss yyyy')", "concat(date_format(ts, 'EEE MMM d HH:mm:ss'), ' UTC ', date_format(ts, 'yyyy'))", "concat(date_format(ts, 'EEE MMM dd HH:mm:ss'), ' +0000 ', date_format(ts, 'yyyy'))", "concat(date_format(ts, 'EEE, dd MMM yyyy HH:mm:ss'), ' GMT')", "concat(date_format(ts + interval 2 hours, 'EEE, dd MMM yyyy HH:mm:ss'), ' +0200')", "concat(date_format(ts - interval 90 minutes, \"yyyy-MM-dd'T'HH:mm:ss\"), '-01:30')", "date_format(ts, 'MMM d, yyyy h:mm:ss a')", "date_format(ts, 'MMMM d, yyyy HH:mm:ss')", "date_format(ts, 'd MMM yyyy HH:mm:ss')", "date_format(ts, 'MMMM d, yyyy')"])
each("time_zones", "events", "event_id", {"a": '{time {1} "2006-01-02 15:04:05" Asia/Tokyo}', "b": "{timeformat {time {1}} NGINX Asia/Tokyo}", "c": "{timeformat {time {1}} RFC3339 Asia/Kolkata}", "d": "{buckettime {2} hour auto Asia/Tokyo}", "e": "{timeformat {2} RFC1123}", "f": "{buckettime {3} nanos}"},
     "select event_id, (epoch(t)::bigint - 32400)::varchar as a, strftime(t + interval 9 hour, '%-d/%b/%Y:%H:%M:%S +0900') as b0, strftime(t + interval 330 minute, '%Y-%m-%dT%H:%M:%S+05:30') as c, strftime(t + interval 9 hour, '%Y-%m-%d %H') as d, strftime(t, '%a, %d %b %Y %H:%M:%S UTC') as e, strftime(t, '%Y-%m-%d %H:%M:%S') || '.25' as f, lpad(strftime(t + interval 9 hour, '%-d'), 2, ' ') || strftime(t + interval 9 hour, '/%b/%Y:%H:%M:%S +0900') as b from (select event_id, date_trunc('second', ts) as t from events)".replace("strftime(t + interval 9 hour, '%-d/%b/%Y:%H:%M:%S +0900') as b0, ", ""),
     ["date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "cast(unix_seconds(cast(ts as timestamp)) as string)", "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), '.2500')"])
each("json", "events", "event_id", {"a": "{json {1} k}", "b": "{json k}", "c": "{json {1} missing}"}, "select event_id, json_extract_string(props,'$.k') as a, json_extract_string(props,'$.k') as b, '' as c from events", ["props"])
each("time", "events", "event_id", {"a": "{time {1}}", "b": "{buckettime {1} hour}", "c": "{timeattr {1} weekday}", "d": "{timeattr {1} week}", "e": "{timeattr {1} yearweek}", "f": "{timeattr {1} quarter}", "g": "{timeformat {time {1} NGINX} RFC3339}", "h": "{buckettime {1} mo nginx}", "i": "{durationformat {2}}", "j": "{duration {durationformat {2}}}", "k": "{time x}"},
     "select event_id, epoch(date_trunc('second', ts))::bigint::varchar as a, strftime(ts,'%Y-%m-%d %H') as b, dayofweek(ts)::varchar as c, week(ts)::varchar as d, isoyear(ts)||'-'||week(ts) as e, (month(ts)//3+1)::varchar as f, strftime(ts,'%Y-%m-%dT%H:%M:%SZ') as g, strftime(ts,'%Y-%m') as h, case when event_id>=3600 then (event_id//3600)||'h' else '' end||case when event_id>=60 then (event_id%3600//60)||'m' else '' end||(event_id%60)||'s' as i, event_id::varchar as j, '<PARSE-ERROR>' as k from events", ["concat(date_format(ts,'dd/MMM/yyyy:HH:mm:ss'), ' +0000')", "cast(event_id as string)"])


@query("lookup", "select c_custkey, coalesce(n_name,'') as name, case when n_name is null then '' else '1' end as has from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20")
def _lookup(spark, sf):
    small = spark.read.parquet(f"{sf}/nation.parquet").where("n_nationkey < 20").collect()  # a table of at most 25 rows
    content = "\n".join(f"{r.n_nationkey} {r.n_name}" for r in small)
    df = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("string").alias("value"))
    lines = Lines(df)
    return lines.evaluate(lines.matched(), {"name": '{lookup {0} "%s"}' % content, "has": '{haskey {0} "%s"}' % content}, ("c_custkey",))


query("lookup_join", "select c_custkey, coalesce(n_name, '') as found from customer left join nation on c_nationkey = n_nationkey and n_nationkey < 20")(
    lambda s, d: lookup_join(s.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.col("c_nationkey").cast("string").alias("key")), "key", s.read.parquet(f"{d}/nation.parquet").where("n_nationkey < 20").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))).select("c_custkey", "found"))
each("json_paths", "events", "event_id", {"a": "{json {1} a.#}", "b": "{json {1} a.#.b}", "c": "{json {1} k*}", "d": "{json {1} {2}}", "e": "{json {1} o}"},
     "select event_id, '2' as a, '[1,' || event_id || ']' as b, event_type as c, event_type as d, '{\"x\":1}' as e from events", ["concat('{\"a\":[{\"b\":1}, {\"b\": ', event_id, '}], \"kind\": \"', event_type, '\", \"o\":{\"x\":1}}')", "'kind'"])

# aggregates ----------------------------------------------------------------------------
HIST = f"(select regexp_extract(v, ' (\\w+) [0-9.]+ \\{{', 1) as key, count(*) as count from {E} group by 1)"
_hist = lambda s, d: _lines(s, d).match(r" (\w+) [0-9.]+ \{")
query("histogram", f"select (floor(value)::bigint // 10 * 10)::varchar as key, count(*) as count from events group by 1")(
    lambda s, d: _lines(s, d).match(r" (\d+)[0-9.]* \{").histogram("{bucket {1} 10}"))
query("histogram_weighted", "select event_type as key, sum(user_id)::bigint as count from events group by 1")(lambda s, d: _lines(s, d).match(r"user=(\d+) (\w+)").histogram("{$ {2} {1}}"))
query("histogram_topn", f"select * from {HIST} order by count desc, key desc limit 3")(lambda s, d: _hist(s, d).histogram("{1}", n=3))
query("histogram_atleast", f"select * from {HIST} where count >= 1000")(lambda s, d: _hist(s, d).histogram("{1}", n=100, at_least=1000))
query("histogram_percent", f"select key, count, count / sum(count) over () as share from {HIST}")(lambda s, d: _hist(s, d).histogram("{1}", percent=True))
query("histogram_all", f"select * from {HIST}")(lambda s, d: _hist(s, d).histogram("{1}"))
query("bargraph", "select event_type as key, (user_id % 3)::varchar as subkey, count(*) as count from events group by 1, 2")(lambda s, d: _lines(s, d).match(r"user=(\d+) (\w+)").bars("{$ {2} {modi {1} 3}}"))
LONG = "(select event_type as col, strftime(ts, '%H') as row, count(*) as count from events group by 1, 2)"
_long = lambda s, d: _lines(s, d).match(r":(\d\d):\d\d:\d\d .* (\w+) [0-9.]+ \{").table("{$ {2} {1}}")
query("tabulate", f"select * from {LONG}")(lambda s, d: _long(s, d))
query("table_totals", f"select col, row, sum(count)::bigint as count from {LONG} group by cube(col, row)")(lambda s, d: totals(_long(s, d)))
query("table_minmax", f"with l as {LONG}, f as (select coalesce(l.count, 0) c from (select distinct col from l) a cross join (select distinct row from l) b left join l on l.col = a.col and l.row = b.row) select min(c)::bigint as min, max(c)::bigint as max from f")(lambda s, d: minmax(_long(s, d)).select(F.col("min").cast("bigint"), F.col("max").cast("bigint")))
query("heatmap", f"with l as {LONG}, m as (select max(count) hi from l) select col, row, count, case when count >= hi then 9 else floor(count / hi * 9)::int end as heat from l, m")(
    lambda s, d: (lambda long: long.crossJoin(F.broadcast(long.agg(F.max("count").alias("hi")))).select("col", "row", "count", scale.bucket(scale.unit(F.col("count").cast("double"), F.lit(0.0), F.col("hi").cast("double")), 10).alias("heat")))(_long(s, d)))
query("spark", f"with l as (select row as col, col as row, count from {LONG}) select * from l where col in (select distinct col from l order by col desc limit 5)")(
    lambda s, d: last_columns(_lines(s, d).match(r":(\d\d):\d\d:\d\d .* (\w+) [0-9.]+ \{").table("{$ {1} {2}}"), 5, "text"))
query("analyze", "with x as (select list_sort(list(l_quantity)) s, count(*) n, avg(l_quantity) m, stddev_samp(l_quantity) d from lineitem), o as (select l_quantity v from lineitem group by 1 order by count(*) desc, 1 limit 1) select n as samples, round(m, 6) as mean, round(d, 6) as stddev, s[1] as min, s[-1] as max, v as mode, s[n//2+1] as median, s[(n*90)//100+1] as p90, s[(n*99)//100+1] as p99, s[(n*999)//1000+1] as \"p99.9\" from x, o")(
    lambda s, d: (lambda a: a.withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6)))(Lines(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").cast("string").alias("value"))).analyze("{0}")))
query("analyze_reverse", "with x as (select list_reverse_sort(list(value)) s, count(*) n from events) select s[n//2+1] as median, s[(n*90)//100+1] as p90 from x")(
    lambda s, d: _lines(s, d).match(r" ([0-9.]+) \{").analyze("{1}", (90,), True).select("median", "p90"))
query("reduce", "select event_type as kind, sum(user_id)::bigint::varchar as total, count(*)::varchar as n, (sum(user_id)//count(*))::bigint::varchar as mean, max(user_id)::varchar as top from events group by 1")(
    lambda s, d: _lines(s, d).match(r"user=(\d+) (\w+)").reduce([("total", "0", "{sumi {.} {1}}"), ("n", "0", "{sumi {.} 1}"), ("mean", "0", "{divi {total} {n}}"), ("top", "0", "{maxi {.} {1}}")], [("kind", "{2}")]))
query("reduce_sort", "select kind, total, row_number() over (order by total::bigint desc, kind)::int as rank from (select event_type as kind, sum(user_id)::bigint::varchar as total from events group by 1)")(
    lambda s, d: ranked(group_keys(_lines(s, d).match(r"user=(\d+) (\w+)").reduce([("total", "0", "{sumi {.} {1}}")], [("kind", "{2}")]), ["kind"], {"total": "total"}, "{subi 0 {total}}"), "contextual", "_sort").select("kind", "total", "rank"))
query("reduce_format", "select event_type as kind, format('{:,}', sum(user_id)::bigint) as total, 'n=' || count(*) as n from events group by 1")(
    lambda s, d: format_columns(_lines(s, d).match(r"user=(\d+) (\w+)").reduce([("total", "0", "{sumi {.} {1}}"), ("n", "0", "{sumi {.} 1}")], [("kind", "{2}")]), {"total": "hi", "n": "n={0}"}))
query("bargraph_stacked", "select event_type as key, count(*)::bigint as total, count(distinct user_id % 3)::bigint as parts from events group by 1")(
    lambda s, d: _lines(s, d).match(r"user=(\d+) (\w+)").bars("{$ {2} {modi {1} 3}}").groupBy("key").agg(F.sum("count").alias("total"), F.count("*").alias("parts")))
query("fuzzy")(lambda s, d: fuzzy_keys(s.read.parquet(f"{d}/part.parquet").select(F.col("p_name").alias("key"))))
query("reduce_fold", "select conv_id::varchar as conv, string_agg(role[1], '' order by turn) as roles from conversations group by 1")(
    lambda s, d: Lines(s.read.parquet(f"{d}/conversations.parquet").select("turn", F.concat_ws(" ", F.col("conv_id").cast("string"), "role").alias("value"))).match(r"^(\d+) (\w)").reduce([("roles", "", "{.}{2}")], [("conv", "{1}")], ("turn",)))


def _ranked(name, kind, table, column, sql):
    def run(spark, sf):
        df = spark.read.parquet(f"{sf}/{table}.parquet").groupBy(F.expr(column).alias("key")).agg(F.count("*").alias("count"))
        return ranked(df, kind).select("key", "rank")

    query(name, sql)(run)


_ranked("sort_text", "text", "nation", "n_name", "select n_name as key, row_number() over (order by n_name)::int as rank from nation")
_ranked("sort_smart", "smart", "nation", "n_name", "select n_name as key, row_number() over (order by regexp_extract(n_name,'[0-9]+')::int)::int as rank from nation")
_ranked("sort_numeric", "numeric", "part", "cast(p_size as string)", "select p_size::varchar as key, row_number() over (order by p_size)::int as rank from (select distinct p_size from part)")
_ranked("sort_contextual", "contextual", "events", "date_format(ts,'EEEE')", "select dayname(d) as key, row_number() over (order by dayofweek(d))::int as rank from (select min(ts) d from events group by dayofweek(ts))")
_ranked("sort_date", "date", "orders", "date_format(o_orderdate,'MM/dd/yyyy')", "select strftime(d,'%m/%d/%Y') as key, row_number() over (order by d)::int as rank from (select distinct o_orderdate::date d from orders)")
_ranked("sort_value", "value", "events", "event_type", "select event_type as key, row_number() over (order by count(*) desc, event_type desc)::int as rank from events group by 1")
query("levenshtein", "select p_partkey, levenshtein(p_name, 'small ring') as d, (length(p_name)+10-2*levenshtein(p_name,'small ring'))/(length(p_name)+10) as ratio from part")(
    lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.levenshtein("p_name", F.lit("small ring")).cast("bigint").alias("d"), F.length("p_name").alias("n")).select("p_partkey", "d", ((F.col("n") + 10 - 2 * F.col("d")) / (F.col("n") + 10)).alias("ratio")))
query("scale_log10", "select o_orderkey, round(case when o_totalprice <= 1 then 0 when o_totalprice >= 1000000 then 1 else log10(o_totalprice)/6 end, 9) as u from orders")(
    lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.round(scale.unit(F.col("o_totalprice"), F.lit(1.0), F.lit(1e6), "log10"), 9).alias("u")))
