"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

`queries` are warm times at that size. `repeated` are times over the events table taken twenty times, a task
each, so that fixed cost and cost per line can be told apart; `lines_per_cpu_second` is of these.
"""

import functools
import json
import os
import time

from pyspark.sql import SparkSession

from linewright.operators.engine import Lines
from linewright.plans.catalogue import QUERIES
from linewright.sources.text import events_lines

NAMES = ["filter", "histogram", "histogram_topn", "match_dissect", "tabulate", "analyze", "reduce", "arithmetic_int", "formula", "time"]
TIMES = 20
REPEATED = {
    "filter": lambda x: x.match(r"^(\d+).* (\w+) [0-9.]+ \{").filter(["{1}", "{2}"]),
    "histogram": lambda x: x.match(r" (\d+)[0-9.]* \{").histogram("{bucket {1} 10}"),
    "match_dissect": lambda x: x.dissect("user=%{u} %{kind} %{?rest}").histogram("{kind}"),
    "tabulate": lambda x: x.match(r":(\d\d):\d\d:\d\d .* (\w+) [0-9.]+ \{").table("{$ {2} {1}}"),
    "time": lambda x: x.match(r"\[(.+?)\]").histogram("{buckettime {1} hour nginx}"),
}


def warm(make, runs: int = 2) -> float:
    """Seconds of the last of some runs."""
    for _ in range(runs):
        began = time.time()
        make().write.format("noop").mode("overwrite").save()
        took = time.time() - began
    return round(took, 3)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    took = {n: warm(lambda n=n: QUERIES[n](spark, sf)) for n in NAMES}
    # lines as a text table, so that what is timed is matching and counting, not writing the lines
    once = events_lines(spark, sf).select("value").persist()
    n = once.count() * TIMES
    many = functools.reduce(lambda a, b: a.unionAll(b), [once] * TIMES)
    repeated = {k: warm(lambda f=f: f(Lines(many))) for k, f in REPEATED.items()}
    rate = {k: round(n / v / min(int(cpus), TIMES)) for k, v in repeated.items()}
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf).removeprefix("sf"), "repeated": repeated, "lines_per_cpu_second": rate}))


if __name__ == "__main__":
    main()
