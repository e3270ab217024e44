"""The command line against golden output, exit codes and csv files; renderers by themselves."""

import gzip
import io
import threading
import time

import pytest

from linewright.cli import render
from linewright.cli.commands import main, sort_name
from linewright.cli.options import Option, UsageError, parse
from linewright.operators.fuzzy import distance, similarity

LOG = "\n".join(f'10.0.0.{i % 3} - - [{1 + i // 20:02d}/Mar/2021:10:{i:02d}:00 +0100] "GET /p{i % 4} HTTP/1.1" {404 if i % 10 == 3 else 301 if i == 7 else 200} {100 * (i % 5) + 50}' for i in range(40)) + "\n"
STATUS = r"\[(.+?)\].*\" (\d{3}) (\d+)"


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "log.txt").write_text(LOG)
    (d / "small.txt").write_text("one 5\ntwo 22\nthree\n\nfour 7")
    (d / "zipped").write_bytes(gzip.compress(b"x 1\r\ny 2\n"))
    (d / "sub").mkdir()
    (d / "sub" / "a.log").write_text("error here\nfine\n")
    (d / "sub" / "b.txt").write_text("ERROR there\n")
    (d / "grid.txt").write_text("\n".join(["a x"] * 3 + ["b x", "b y", "b y", "c y", "c z"]))
    return d


@pytest.fixture
def run(spark, files, monkeypatch):
    monkeypatch.chdir(files)

    def call(*args, stdin=""):
        out, err = io.StringIO(), io.StringIO()
        code = main(list(args), spark, out, err, io.StringIO(stdin))
        return code, out.getvalue(), err.getvalue()

    return call


def test_filter(run):
    assert run("filter", "-n", "2", "-m", r'" (\d{3}) (\d+)', "-e", "{src}:{line} {1} {2}", "log.txt") == (0, "log.txt:1 200 50\nlog.txt:2 200 150\n", "Matched: 2 / 2\n")
    assert run("filter", "-m", r"(\d+)", "-i", "{gt {1} 10}", "-e", "{multi {1} 2}", "-", stdin="hello 5\n6 here\nmaybe 500\n") == (0, "10\n12\n", "Matched: 2 / 3 (Ignored: 1)\n")
    assert run("filter", "-m", r"(\w+) (\d)", "-e", "{1}", "-e", "{2}", "small.txt")[1] == "one\t5\ntwo\t2\nfour\t7\n"
    assert run("filter", "-m", "o", "small.txt", "small.txt")[2] == "Matched: 6 / 10\n"
    assert run("f", "small.txt") == (0, "one 5\ntwo 22\nthree\nfour 7\n", "Matched: 4 / 5 (Ignored: 1)\n")
    assert run("f", "-z", "zipped") == (0, "x 1\ny 2\n", "Matched: 2 / 2\n")
    assert run("filter", "-l", "-m", "two", "small.txt")[1] == "small.txt 2: two 22\n"
    assert run("filter", "-m", "nothing", "small.txt")[0] == 1
    assert run("filter", "missing", "small.txt")[0] == 3 and "no such file" in run("filter", "missing")[2]
    assert run("filter", "-p", "-m", "t|two 2", "-e", "{0}", "small.txt")[1] == "two 2\nt\n"
    assert run("filter", "--color", "-m", "(tw)o", "small.txt")[1] == "\x1b[31mtw\x1b[0mo 22\n"
    assert run("filter", "--dissect", "%{name} %{n}", "-e", "{n}:{name}", "small.txt")[1] == "5:one\n22:two\n7:four\n"


def test_search_and_walk(run):
    code, out, err = run("search", "error", "sub")
    assert code == 0 and sorted(out.splitlines()) == ["sub/a.log 1: error here", "sub/b.txt 1: ERROR there"] and err.startswith("Read   : 2 file(s) (") and err.endswith("Matched: 2 / 3\n")
    assert run("search")[0] == 2
    assert run("walk", "-R", "--include", "*.log", "sub") == (0, "sub/a.log\n", "Found 1 path(s), 1 excluded\n")
    assert run("walk", "-R", "--exclude-dir", "sub", "--exclude", "*.txt", ".")[1] == "./zipped\n" and run("walk", "sub")[0] == 1


def test_histogram(run, files):
    assert run("histo", "-m", r"(\d+)", "-e", "{bucket {1} 10}", "-x", "small.txt")[1].splitlines() == [
        "0           2          [66.7%] " + "█" * 50, "20          1          [33.3%] " + "█" * 25, "", "", "", "Matched: 3 / 5 (Groups: 2)"]
    code, out, _ = run("h", "--snapshot", "-n", "2", "-m", r'" (\d{3}) (\d+)', "-e", "{1}", "-e", "{2}", "--fmt", "bytesize", "--csv", "h.csv", "log.txt")
    assert code == 0 and out.splitlines()[:2] == ["200         8 KB      ", "404         1 KB      "] and (files / "h.csv").read_text().startswith("group,value\n200,")
    assert run("histo", "-n", "5", "--atleast", "2", "-m", r'" (\d{3})', "-e", "{1}", "--sort", "text:desc", "log.txt")[1].splitlines()[:2] == ["404         4         ", "200         35        "]
    code, out, err = run("histo", "-m", r"(\w+) (\w+)", "-e", "{$ {1} {2}}", "-", stdin="a 1\nb x\na 2\n")
    assert code == 2 and "Matched: 3 / 3 (Groups: 1) (Errors: 1)" in out and err == "Parse errors\n"
    assert "Full Table:" in run("histo", "-a", "small.txt")[1] and run("histo", "--noout", "small.txt")[1] == ""
    assert run("histo", "--csv", "-", "-m", r"(\d+)", "-e", "{bucket {1} 10}", "small.txt")[1] == "group,value\n0,2\n20,1\n"


def test_bars(run):
    base = ("-m", STATUS, "-e", "{buckettime {1} day}", "-e", "{2}", "log.txt")
    assert run("bars", *base)[1].splitlines()[:4] == ["              0 200  1 301  2 404".replace("    0 200", "0 200".rjust(9)), "2021-03-01  " + render.Style().bar(17 / 18, 50) + " 17", " " * 12 + render.Style().bar(1 / 18, 50) + " 1", " " * 12 + render.Style().bar(2 / 18, 50) + " 2"]
    assert run("bars", "-k", *base)[1].splitlines()[-3:] == [" " * 12 + "301   0", " " * 12 + "404  " + render.Style().bar(2 / 18, 50) + " 2", "Matched: 40 / 40"]
    assert run("bars", "-s", *base)[1].splitlines()[2] == "2021-03-02  " + "0" * 45 + "2" * 5 + "  20"
    assert run("bars", "-s", "-k", *base)[0] == 2 and run("bars", "-s", "--scale", "log2", *base)[0] == 2 and run("bars", "--scale", "cubic", *base)[0] == 2


def test_tables(run, files):
    grid = ("-m", r"(\w) (\w)", "-e", "{$ {1} {2}}", "grid.txt")
    assert run("table", "-x", "--csv", "t.csv", *grid)[1].splitlines() == ["      b a c Total ", "x     1 3 0 4     ", "y     2 0 1 3     ", "z     0 0 1 1     ", "Total 3 3 2 8     ", "Matched: 8 / 8 (R: 3; C: 3)"]
    assert (files / "t.csv").read_text() == ",a,b,c\nx,3,1,0\ny,0,2,1\nz,0,0,1\n"
    assert run("table", "--cols", "1", "--rows", "1", "--sort-cols", "text:desc", "--sort-rows", "text", *grid)[1].splitlines() == ["  c  ", "x 0  ", "Matched: 8 / 8 (R: 3; C: 3)"]
    assert run("heat", "--cols", "2", *grid)[1].splitlines() == [" - 0    3 1    6 2    9 3", " a. (1 more)", "x 93", "y -6", "z --", "Matched: 8 / 8 (R: 3; C: 3)"]
    assert run("heat", "--min", "0", "--max", "9", *grid)[1].splitlines()[2] == "x 31-"
    assert run("spark", "--cols", "2", "-n", "2", *grid)[1].splitlines() == ["  First bc Last ", "y 2     █▄ 1    ", "z 0     _▄ 1    ", "(1 more)", "Matched: 8 / 8 (R: 3; C: 2)"]
    assert run("table", "--delim", " ", "grid.txt")[1].splitlines()[-1] == "Matched: 8 / 8 (R: 3; C: 3)"


def test_analyze(run):
    assert run("analyze", "-m", r"(\d+)$", "-e", "{1}", "small.txt")[1].splitlines() == ["Samples:  3", "Mean:     11.3333", "StdDev:   9.2916", "Min:      5.0000", "Max:      22.0000", "", "Matched: 3 / 5"]
    out = run("analyze", "-x", "-q", "50", "-q", "90", "-", stdin="\n".join(map(str, range(10))))[1].splitlines()
    assert out[6:10] == ["Median:   5.0000", "Mode:     0.0000", "P50.0000: 5.0000", "P90.0000: 9.0000"]
    assert run("analyze", "-", stdin="1\nx\n")[0] == 2 and run("analyze", "-q", "x", "-", stdin="1\n")[0] == 2


def test_reduce(run, files):
    columns = ("-m", r'" (\d{3}) (\d+)', "-a", "total={sumi {.} {2}}", "-a", "n={sumi {.} 1}", "-a", "mean={divi {total} {n}}", "log.txt")
    assert run("reduce", "--fmt", "is {0}", "--fmt", "total=bytesize", *columns)[1].splitlines() == ["total: 10 KB", "n    : is 40", "mean : is 250", "Matched: 40 / 40"]
    assert run("reduce", "-g", "code={1}", "--sort", "-{mean}", "--csv", "r.csv", *columns)[1].splitlines()[0] == "code total n  mean "
    assert (files / "r.csv").read_text().splitlines()[0] == "code,total,n,mean"
    by_n = run("reduce", "-g", "{1}", "--sort", "{n}", "--sort-reverse", *columns)[1].splitlines()
    assert [x.split()[0] for x in by_n[1:4]] == ["200", "404", "301"] and by_n[4] == "Matched: 40 / 40 (R: 3; C: 4)"
    assert run("reduce", "-m", r"^(\w)", "-a", "all:>={.}{1}", "small.txt")[1].splitlines()[0] == "all: >ottf"
    assert run("reduce", "small.txt")[:2] == (1, "Matched: 0 / 5 (Ignored: 5)\n") and run("reduce", "-e", "{0}", "small.txt")[1] == "Matched: 4 / 5 (Ignored: 1)\n"
    assert run("reduce", "--fmt", "{!", *columns)[0] == 2 and run("reduce", "--fmt", "nope={0}", *columns)[0] == 2 and run("reduce", "-a", "a=1", "-a", "a=2", "small.txt")[0] == 2
    assert run("reduce", "--table", *columns)[1].splitlines()[0] == "total n  mean "


def test_expression_and_usage(run, files):
    assert run("expression", "-d", "5", "-k", "a=b", "{$ {0} {a}}") == (0, "[5, b]\n", "") and run("x", "-n", "{@}{src}")[1] == "<args>"
    assert run("expression", "-", stdin="{sumi 1 2}")[1] == "3\n" and "sumi" in run("expression", "--listfuncs")[1] and "Stages:" in run("expression", "-s", "{0}a")[1]
    assert [run(*a)[0] for a in (["expression"], ["expression", "{"], ["nope"], ["filter", "--nope"], ["filter", "--poll", "small.txt"], ["filter", "-z", "-"], ["histo", "-m", "a", "-d", "b", "small.txt"], ["histo", "--sort", "x", "small.txt"], ["histo", "--sort", "text:x", "small.txt"], ["histo", "-n", "x", "small.txt"], [])] == [2] * 11
    assert run("-v")[0] == 0 and run("--help")[0] == 0
    (files / "f.funcs").write_text("double {multi {0} 2} # twice\n")
    assert run("--funcs", "f.funcs", "filter", "-m", r"(\d+)", "-e", "{double {1}}", "small.txt")[1] == "10\n44\n14\n"
    assert run("--noload", "expression", "{load f.funcs}")[0] == 2 and run("expression", "{len {load f.funcs}}")[1] == "29\n"
    assert run("--nounicode", "histo", "-b", "-n", "1", "-m", "o", "small.txt")[1].splitlines()[0].endswith("|" * 50)
    assert run("--noformat", "analyze", "-", stdin="12345\n")[1].splitlines()[1] == "Mean:     12345.0000"


def follow(spark, files, args, name, wanted):
    """What a following command has printed when all that is wanted is there."""
    out, code = io.StringIO(), []
    (files / name).write_text("a 1\nb 2\na 3\nb")
    thread = threading.Thread(target=lambda: code.append(main([*args, str(files / name)], spark, out, io.StringIO(), io.StringIO())))
    thread.start()
    for seen, more in wanted:
        end = time.time() + 60
        while seen not in out.getvalue() and time.time() < end:
            time.sleep(0.2)
        assert seen in out.getvalue()
        with (files / name).open("a") as f:
            f.write(more)
    for q in spark.streams.active:
        q.stop()
    thread.join(60)
    return code[0]


def test_follow(spark, files):
    assert follow(spark, files, ["histo", "-f", "-m", r"(\w) (\d)", "-e", "{1}"], "f1.txt", [("a           2         \nb           1 ", " 5\nb 6\n"), ("b           3         \na           2 ", "")]) == 0
    assert follow(spark, files, ["filter", "-f", "-m", r"b (\d)", "-e", "<{1}>"], "f2.txt", [("<2>\n", " 5\nb 6\n"), ("<5>\n<6>\n", "")]) == 0


def test_sorts_by_default(run):
    text = "b 10\nb 10\na 2\nc 33\n"
    assert [x.split()[0] for x in run("histo", "-m", r"(\w)", "-e", "{1}", "-", stdin=text)[1].splitlines()[:3]] == ["b", "c", "a"]
    assert [x.split()[0] for x in run("bars", "-m", r"(\d+)", "-e", "{1}", "-", stdin=text)[1].splitlines()[:3]] == ["2", "10", "33"]
    assert [sort_name(n) for n in ("value", "v:rev", "value:asc", "v:desc", "smart", "s:r", "t:asc")] == ["value", "value:asc", "value:asc", "value", "smart", "smart:desc", "text"]


def test_options():
    options = [Option("num", ("n",), "int", 3), Option("all", ("a",)), Option("list", ("e",), "list", ("x",)), Option("on", ("o",), "switch", True)]
    p = parse(options, ["-an", "5", "file", "--list=-{a}", "-e", "-b", "-", "--on=false", "--", "-z"])
    assert (p["num"], p["all"], p["list"], p["on"], p.rest) == (5, True, ["-{a}", "-b"], False, ["file", "-", "-z"]) and parse(options, [])["list"] == ["x"]
    for bad in (["--num"], ["--num", "x"], ["-na"], ["--what"]):
        with pytest.raises(UsageError):
            parse(options, bad)


def test_scales_and_fuzzy(spark):
    s = render.Scale("log10")
    assert [round(s.share(v, 1, 10000), 3) for v in (-1, 0, 1, 10, 100, 99999)] == [0, 0, 0, 0.25, 0.5, 1] and s.keys(6, 0, 1000) == [1, 3, 15, 63, 251, 1000]
    assert render.Scale().keys(6, 0, 3) == [0, 1, 2, 3] and render.Scale("log2").share(8, 1, 64) == 0.5 and render.Scale().share(5, 9, 1) == 0
    assert render.visible("\x1b[31mab\x1b[0mc") == 3 and render.Style(True).heat(1.0) == "\x1b[38;5;196m█\x1b[0m" and render.Style(False, False).spark(1) == "^"
    assert distance("abc", "abc", 5) == 0 and distance("", "ab", 5) == 2 and distance("kitten", "sitting", 5) == 3 and similarity("user 1 in", "user 2 in", 10) > 0.85 and similarity("", "", 3) == 1
    from linewright.operators.fuzzy import fuzzy_keys

    keys = spark.createDataFrame([(k,) for k in ["conn 1 opened now"] * 3 + ["conn 2 opened now", "conn 3 opened now", "disk full", "conn"]], "key string")
    assert {(r.key, r["count"]) for r in fuzzy_keys(keys).collect()} == {("conn 1 opened now", 5), ("disk full", 1), ("conn", 1)}
