"""What must not meet in one task or as all pairs: long files' joins, row numbers, derived words; held against plain Python."""

import bisect
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textloom.errors import LimitExceeded
from textloom.functions import lexers
from textloom.functions.lexers import Nest, Scope
from textloom.operators import filters, order, scan
from textloom.plans.query import run_query
from textloom.sources.corpus import Corpus

A, B = {"id": "a", "scan": ["c"], "patterns": [{"id": "a", "regexp": r"a\d+"}]}, {"id": "b", "scan": ["c"], "patterns": [{"id": "b", "regexp": r"b\d+"}]}
WIDE = {"id": "w", "scan": ["c"], "patterns": [{"id": "w", "regexp": r"<[^<>]*>"}]}


def joined(spark, corpus, kind, left, right, on, select, **query):
    doc = {"version": 1, "sets": [left, right], "query": {"from": {"set": left["id"], "as": "x"}, "joins": [{"type": kind, "set": right["id"], "as": "y", "on": on}], "select": select, **query}}
    return run_query(spark, doc, {"c": corpus}).df


@pytest.fixture(scope="module")
def long_file(spark):
    """200,000 rows of a and as many of b in one file, three lines apart at most in every sixth pair."""
    return Corpus.from_text(spark, {"long": "\n".join(f"a{i}" + "\n" * (1 if i % 6 else 9) + f"b{i}" + "\n" * 8 for i in range(200_000)), "short": "a1 b2\nb3"})


def test_within_lines_of_a_long_file(spark, long_file):
    on = [{"op": "within_lines", "left": "x", "right": "y", "lines": 3}]
    began = time.time()
    df = joined(spark, long_file, "inner", A, B, on, {"p": "x.match", "q": "y.match"})
    near = {i for i in range(200_000) if i % 6}
    assert df.count() == len(near) + 2
    assert joined(spark, long_file, "anti", A, B, on, {"p": "x.match"}).count() == 200_000 - len(near)
    assert time.time() - began < 120
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "__bin" in plan


def test_before_and_after_of_a_long_file(spark, long_file):
    before, after = ([{"op": op, "left": "x", "right": "y"}] for op in ("before", "after"))
    assert joined(spark, long_file, "semi", A, B, before, {"p": "x.match"}).count() == 200_001
    assert joined(spark, long_file, "anti", A, B, before, {"p": "x.match"}).count() == 0
    assert joined(spark, long_file, "anti", B, A, before, {"p": "x.match"}).count() == 3
    assert joined(spark, long_file, "semi", A, B, after, {"p": "x.match"}).count() == 199_999
    assert joined(spark, long_file, "inner", A, B, before, {"p": "x.match", "q": "y.match"}, limit=5).count() == 5


def random_text(rng, n):
    out = ""
    for _ in range(n):
        out += rng.choice(["a1 ", "b2 ", "\n", "<" + "z" * rng.choice((0, 3, 40, 70, 600)), "> ", "a3\n", "b4"])
    return out


LOCATED = {
    "within_lines": lambda x, y: abs(x[2] - y[2]) <= 1,
    "before": lambda x, y: x[1] <= y[0],
    "after": lambda x, y: x[0] >= y[1],
    "contains_span": lambda x, y: x[0] <= y[0] and x[1] >= y[1],
}


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("op", LOCATED)
def test_located_joins_equal_all_pairs(spark, op, turned):
    rng = random.Random(len(op) + turned)
    texts = {f"f{i}": random_text(rng, rng.choice((0, 5, 60, 200))) for i in range(6)}
    corpus = Corpus.from_text(spark, texts)
    spans = lambda rx: [(f, m.start(), m.end(), t.count("\n", 0, m.start()) + 1) for f, t in texts.items() for m in re.finditer(rx, t)]
    left, right = (WIDE, B) if op == "contains_span" and not turned else (B, WIDE) if op == "contains_span" else (A, B)
    on = [{"op": op, "left": "y" if turned else "x", "right": "x" if turned else "y"} | ({"lines": 1} if op == "within_lines" else {})]
    xs, ys = (spans(s["patterns"][0]["regexp"]) for s in (left, right))
    holds = lambda x, y: x[0] == y[0] and (LOCATED[op](y[1:], x[1:]) if turned else LOCATED[op](x[1:], y[1:]))
    for kind in ("inner", "left", "semi", "anti"):
        select = {"f": "x.file", "a": "x.from"} | ({"b": "y.from"} if kind in ("inner", "left") else {})
        got = sorted(((r.f, r.a, r.b if kind in ("inner", "left") else None) for r in joined(spark, corpus, kind, left, right, on, select).collect()), key=str)
        want = []
        for x in xs:
            met = [y for y in ys if holds(x, y)]
            want += {"inner": [(x[0], x[1], y[1]) for y in met], "left": [(x[0], x[1], y[1]) for y in met] or [(x[0], x[1], None)], "semi": [(x[0], x[1], None)] * bool(met), "anti": [(x[0], x[1], None)] * (not met)}[kind]
        assert got == sorted(want, key=str), kind


def test_numbers_and_running_sums(spark):
    rng = random.Random(4)
    values = [(rng.randint(0, 50) if rng.random() < 0.6 else 7, i, rng.randint(-3, 9)) for i in range(3000)]
    df = spark.createDataFrame(values, "k int, i int, v long").repartition(5)
    places = sorted(values)
    got = {r.i: (r.n, r.s) for r in order.running(order.numbered(df, ["k", "i"], "n", 10), ["k", "i"], F.col("v"), "s").collect()}
    total, want = 0, {}
    for n, (_, i, v) in enumerate(places, 10):
        want[i] = (n, total)
        total += v
    assert got == want
    assert order.numbered(df.limit(0), ["k"], "n").count() == 0


def test_row_ids_use_no_single_task(spark, long_file):
    df = run_query(spark, {"version": 1, "sets": [A, B], "query": {"from": {"set": "a", "as": "x"}, "select": {"id": "x.row_id", "m": "x.match", "file": "x.file"}}}, {"c": long_file}).df
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString()
    got = [(r.id, r.m) for r in df.filter("file = 'long'").orderBy("id").limit(3).collect()]
    assert got == [(0, "a0"), (2, "a1"), (4, "a2")] and df.agg({"id": "max"}).first()[0] == 400_000


def test_derived_words_equal_derived_patterns(spark):
    rng = random.Random(9)
    words = ["ab", "a", "b_1", "x", "é", "aé", "7", "AB", "ab-x", "b"]
    texts = {f"t{i}": "".join(rng.choice(words) + rng.choice([" ", "-", "", "\n", "."]) for _ in range(40)) for i in range(12)} | {"keys": "[ab] [b_1] [ab-x] [x] [] [zz] [é] [7]"}
    corpus = Corpus.from_text(spark, {k: v for k, v in texts.items() if k != "keys"})
    keys = Corpus.from_text(spark, {"keys": texts["keys"]})
    sets = [{"id": "k", "scan": ["keys"], "patterns": [{"id": "k", "regexp": r"\[([^\]]*)\]", "extract": ["v"]}]}, {"id": "d", "scan": ["c"], "derive_patterns": {"from_set": "k", "field": "capture.v", "word_boundary": True}}]
    q = {"from": {"set": "d", "as": "d"}, "select": {c: f"d.{c}" for c in ("file", "from", "to", "line", "match", "context", "pattern_id", "derived.value", "derived.source_rows", "row_id")}}
    q["select"] = {k.replace(".", "_"): v for k, v in q["select"].items()}
    got = sorted((r.file, r["from"], r.to, r.line, r.match, r.context, r.pattern_id, tuple(r.derived_source_rows)) for r in run_query(spark, {"version": 1, "sets": sets, "query": q}, {"c": corpus, "keys": keys}).df.collect())
    values = sorted(v for v in re.findall(r"\[([^\]]*)\]", texts["keys"]) if v)
    at = {v: i for i, v in enumerate(re.findall(r"\[([^\]]*)\]", texts["keys"]))}
    want = []
    for f, t in texts.items():
        starts = [0] + [i + 1 for i, c in enumerate(t) if c == "\n"]
        for i, v in enumerate(sorted(values, key=str.encode)):
            for m in re.finditer(rf"\b(?:{re.escape(v)})\b", t, re.A) if f != "keys" else ():
                line = bisect.bisect_right(starts, m.start())
                byte = len(t[: m.start()].encode())
                want.append((f, byte, byte + len(v.encode()), line, v, t.split("\n")[line - 1], f"derived{i}", (at[v],)))
    assert got == sorted(want) and len({w[4] for w in want}) >= 5


def test_derived_words_have_no_bound_of_their_own(spark):
    """20,000 values; as other patterns they would be too many, and a stated limit still holds."""
    text = Corpus.from_text(spark, {"t": " ".join(f"w{i}" for i in range(0, 40_000, 3))})
    keys = Corpus.from_text(spark, {"k": " ".join(f"w{i}" for i in range(20_000))})
    doc = lambda **more: {"version": 1, "sets": [{"id": "k", "scan": ["keys"], "patterns": [{"id": "k", "regexp": r"w\d+"}]}, {"id": "d", "scan": ["c"], "derive_patterns": {"from_set": "k", "field": "match", **more}}], "query": {"from": {"set": "d", "as": "d"}, "select": {"n": {"count": "*"}}}}
    corpora = {"c": text, "keys": keys}
    assert run_query(spark, doc(word_boundary=True), corpora).df.first()[0] == len(range(0, 20_000, 3))
    for more in ({}, {"word_boundary": True, "max_patterns": 100}):
        with pytest.raises(LimitExceeded):
            run_query(spark, doc(**more), corpora)


def test_nested_regions_equal_the_loop():
    rng = random.Random(3)
    for _ in range(200):
        found = []
        for _ in range(rng.randint(0, 12)):
            a = rng.randint(0, 40)
            found.append(Scope("s", "k", a, a + rng.randint(1, 20), a, a + rng.randint(0, 2)))
        nest = Nest(found)
        for at in range(-1, 62):
            inside = [s for s in found if s.start <= at < s.end]
            want = min(inside, key=lambda s: (s.end - s.start, found.index(s)), default=None)
            assert nest.innermost(at) is want
            assert nest.declares(at, at + 3) == any(at <= s.name_start < at + 3 for s in found)


def test_a_file_of_many_scopes(spark):
    """50,000 functions inside one another and side by side, 50,000 matches: scopes, roles and the scope filter take seconds."""
    text = "".join(f"func f{i}() {{\n  hit{i}()\n}}\n" for i in range(50_000))
    corpus = Corpus.from_text(spark, {"a.go": text})
    from textloom.functions.patterns import Pattern

    began = time.time()
    rows = scan.match(corpus, [Pattern("hit", r"hit\d+")], options=scan.Options(frozenset(("scope", "role"))))
    assert rows.filter("enclosing.name = concat('f', substring(match, 4))").count() == 50_000
    scopes = scan.list_scopes(corpus)
    assert filters.in_scope(rows, scopes, "7$", "func").count() == 5_000
    assert time.time() - began < 60


def test_in_scope_equals_all_pairs(spark):
    rng = random.Random(6)
    rows = [(f"f{rng.randint(0, 3)}", rng.randint(0, 60), i) for i in range(200)]
    regions = [(f"f{rng.randint(0, 4)}", rng.choice(["get_a", "set_a", "get_b"]), rng.choice(["func", "class"]), a := rng.randint(0, 50), a + rng.randint(1, 15)) for _ in range(30)]
    r, s = spark.createDataFrame(rows, "file string, `from` long, i int"), spark.createDataFrame(regions, "file string, name string, kind string, `from` long, `to` long")
    for name, kind in (("^get_", None), (None, "func"), ("a$", "class"), (None, None)):
        got = sorted(x.i for x in filters.in_scope(r, s, name, kind).collect())
        want = sorted(i for f, at, i in rows if any(f == g and b <= at < e and (name is None or re.search(name, n)) and kind in (None, k) for g, n, k, b, e in regions))
        assert got == want


def test_accounting_takes_counters_on_the_way(spark, tmp_path):
    from textloom.functions.patterns import Pattern
    from textloom.operators import shapes

    (tmp_path / "a.txt").write_text("hit hit")
    (tmp_path / "b.txt").write_bytes(b"\0hit")
    (tmp_path / "c.txt").write_text("none")
    account = shapes.Accounting(Corpus.from_files(spark, [str(tmp_path / n) for n in ("a.txt", "b.txt", "c.txt", "gone.txt")]))
    assert account.shown(scan.match(account.corpus, [Pattern("h", "hit")])).count() == 2
    want = {"type": "summary", "files_scanned": 2, "bytes_scanned": 11, "buffered_bytes_peak": 7, "files_skipped_binary": 1, "files_failed": 0, "missing_paths": 1, "matches": 2, "bytes_shown": 20, "complete": False}
    assert account.record() == want
    account = shapes.Accounting(Corpus.from_text(spark, {"a": "hit hit hit"}))
    assert len(account.shown(scan.match(account.corpus, [Pattern("h", "hit")]), 2).collect()) == 2
    assert (account.record()["complete"], account.record()["stop_reason"], account.record()["matches"]) == (False, "limit", 2)


def test_anchor_is_parsed_once(monkeypatch):
    """The scopes of many texts parse their language's anchor once in a process, and only places where a match may begin are tried."""
    from textloom.functions import longest, patterns

    lexers._anchor.cache_clear()
    parsed, tried = [], []
    real, search = patterns.parser.parse, longest.Longest._longest
    monkeypatch.setattr(patterns.parser, "parse", lambda *a: parsed.append(a) or real(*a))
    monkeypatch.setattr(longest.Longest, "_longest", lambda self, text, at: tried.append(at) or search(self, text, at))
    for k in range(50):
        assert [(s.name, s.start) for s in lexers.scopes(f"package p\nfunc (a T) one_{k}() {{ x() }}\n", "a.go")] == [(f"one_{k}", 10)]
    assert len(parsed) < 20  # compiling parses too
    assert len(tried) == 50


def test_small_files_of_many_texts_are_dealt_out(spark, tmp_path):
    """A file of some hundred kilobytes may stand for many texts."""
    from pyspark.sql import functions as F

    rows = spark.range(0, 1500, 1, 1).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.write.parquet(str(tmp_path / "t"))
    dealt = Corpus.from_table(spark.read.parquet(str(tmp_path / "t")), "id", "text").spread()
    assert dealt.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism > 1


@pytest.mark.parametrize("select", [{"one": "x.file", "n": {"count": "*"}}, {"one": "x.file", "n": {"count": "*"}, "total": {"sum": "x.line"}, "kinds": {"count_distinct": "x.match"}, "low": {"min": "x.line"}, "first": {"first": "x.match"}, "seen": {"collect_distinct": "x.match"}}])
def test_counted_partners_make_no_pairs(spark, select):
    """What a left row and the number of its partners tell is told without pairs; captures without a part in the match meet, too."""
    given = {f"f{i}": " ".join(f"a{k % 3}" if k % 4 else "a" for k in range(i, 3 * i)) for i in range(12)}
    corpus = Corpus.from_text(spark, given)
    sets = [{"id": s, "scan": ["c"], "patterns": [{"id": s, "regexp": "a([0-9])?", "extract": ["x"]}]} for s in ("l", "r")]
    on = [{"op": "eq", "left": "y.capture.x", "right": "x.capture.x"}]
    doc = {"version": 1, "sets": sets, "query": {"from": {"set": "l", "as": "x"}, "joins": [{"type": "inner", "set": "r", "as": "y", "on": on}], "group_by": ["x.file"], "select": select}}
    found = run_query(spark, doc, {"c": corpus}).df
    every = [m for t in given.values() for m in re.findall("a[0-9]?", t)]
    want = {f: [(m, every.count(m)) for m in re.findall("a[0-9]?", t)] for f, t in given.items()}
    rows = {r.one: r for r in found.collect()}
    assert {f: r.n for f, r in rows.items()} == {f: sum(n for _, n in v) for f, v in want.items() if v}
    if "total" in select:
        assert all(r.total == r.n and r.low == 1 and r.kinds == len({m for m, _ in want[f]}) and r["first"] == want[f][0][0] and r.seen == list(dict.fromkeys(m for m, _ in want[f])) for f, r in rows.items())
    joins = found._jdf.queryExecution().optimizedPlan().toString().split("Join Inner")
    assert len(joins) == 2 and "Aggregate" in joins[1]


def test_references_of_small_files_stay_dealt(spark):
    """Many small files with references are not merged into one task for the few bytes they have."""
    from textloom.operators import references

    texts = spark.range(400).select(F.concat(F.lit("f"), "id", F.lit(".go")).alias("file"), F.lit("func a() {\n}\n").alias("text"), "id")
    corpus = Corpus.from_table(texts, "file", "text", "id")
    found = references.expand(spark, corpus, texts.select(F.concat("file", F.lit(":2")).alias("ref")))
    held = found.groupBy(F.spark_partition_id().alias("at")).agg(F.count(F.lit(1)).alias("n"), F.max("status").alias("status")).collect()
    assert sum(r.n for r in held) == 400 and {r.status for r in held} == {"ok"} and max(r.n for r in held) < 100
