"""Declarative queries over random server logs, held against plain Python over the same lines."""

import json
import random
import re
from collections import defaultdict
from itertools import product

import pytest

from textloom.errors import LimitExceeded, QueryError
from textloom.plans.query import Query, run_query
from textloom.sources.corpus import Corpus

KINDS = {"login": r"login (u\d+)", "fail": r"failed (u\d+) code (\d+)", "bye": r"logout (u\d+)"}


def logs() -> dict[str, str]:
    rng = random.Random(21)
    line = lambda: rng.choice((f"login u{rng.randrange(8)}", f"failed u{rng.randrange(8)} code {rng.randrange(400, 404)}", f"logout u{rng.randrange(8)}", "idle"))
    return {f"host{i}.log": "\n".join(line() for _ in range(rng.randrange(4, 14))) for i in range(6)}


class Row(dict):
    __getattr__ = dict.__getitem__


def plain(kind: str) -> list[Row]:
    out = []
    for file, text in logs().items():
        for m in re.finditer(KINDS[kind], text):
            out.append(Row(file=file, line=text.count("\n", 0, m.start()) + 1, start=m.start(), end=m.end(), match=m[0], user=m[1], code=m[2] if m.re.groups > 1 else None))
    return out


SETS = [{"id": k, "scan": ["logs"], "patterns": [{"id": k, "regexp": rx, "extract": ["user", "code"][: re.compile(rx).groups]}]} for k, rx in KINDS.items()]


@pytest.fixture(scope="module")
def corpora(spark):
    return {"logs": Corpus.from_text(spark, logs()), "notes": Corpus.from_text(spark, {"notes.txt": "u1 [vip]\nu7\nu1 [vip]\n\n"}), "code": Corpus.from_text(spark, {"dam.js": DAM})}


def run(spark, corpora, query, sets=SETS, **more):
    return run_query(spark, {"version": 1, "sets": sets, "query": query, **more}, corpora)


def rows(spark, corpora, query, **more):
    return sorted(tuple(r) for r in run(spark, corpora, query, **more).df.collect())


def pair(kind, on, select):
    return {"from": {"set": "fail", "as": "f"}, "joins": [{"type": kind, "set": "login", "as": "l", "on": on}], "select": select}


USER = {"op": "eq", "left": "f.capture.user", "right": "l.capture.user"}
CONDITIONS = [
    ([USER], lambda f, x: f.user == x.user),
    ([USER, {"op": "same_file", "left": "f", "right": "l"}], lambda f, x: f.user == x.user and f.file == x.file),
    ([{"op": "within_lines", "left": "f", "right": "l", "lines": 2}], lambda f, x: f.file == x.file and abs(f.line - x.line) <= 2),
    ([{"op": "before", "left": "f", "right": "l"}], lambda f, x: f.file == x.file and f.end <= x.start),
    ([{"op": "after", "left": "f", "right": "l"}, {"op": "ne", "left": "f.capture.user", "right": "l.capture.user"}], lambda f, x: f.file == x.file and f.start >= x.end and f.user != x.user),
]


@pytest.mark.parametrize("case", range(len(CONDITIONS)))
def test_every_join_against_loops(spark, corpora, case):
    on, holds = CONDITIONS[case]
    fails, logins = plain("fail"), plain("login")
    met = [(f, x) for f, x in product(fails, logins) if holds(f, x)]
    both = {"at": "f.from", "file": "f.file", "other": "l.from"}
    assert rows(spark, corpora, pair("inner", on, both)) == sorted((f.start, f.file, x.start) for f, x in met)
    alone = [f for f in fails if not any(f is g for g, _ in met)]
    key = lambda t: (t[0], t[1], -1 if t[2] is None else t[2])
    got = sorted((tuple(r) for r in run(spark, corpora, pair("left", on, both)).df.collect()), key=key)
    assert got == sorted([(f.start, f.file, x.start) for f, x in met] + [(f.start, f.file, None) for f in alone], key=key)
    own = {"at": "f.from", "file": "f.file"}
    assert rows(spark, corpora, pair("anti", on, own)) == sorted((f.start, f.file) for f in alone)
    assert rows(spark, corpora, pair("semi", on, own)) == sorted((f.start, f.file) for f in fails if not any(f is g for g in alone))


def test_groups_and_having(spark, corpora):
    by = defaultdict(list)
    for f in plain("fail"):
        by[f.user].append(f)
    q = {"from": {"set": "fail", "as": "f"}, "group_by": ["f.capture.user"], "having": {"op": "gt", "left": "n", "right": 1}}
    q["select"] = {"user": "f.capture.user", "n": {"count": "*"}, "hosts": {"count_distinct": "f.file"}, "codes": {"collect_distinct": "f.capture.code"}, "top": {"max": "f.capture.code"}, "low": {"min": "f.line"}, "lines": {"sum": "f.line"}, "first": {"first": "f.line"}}
    got = {r.user: r.asDict() for r in run(spark, corpora, q).df.collect()}
    assert set(got) == {u for u, fs in by.items() if len(fs) > 1}
    for user, r in got.items():
        fs = by[user]
        assert (r["n"], r["hosts"], sorted(r["codes"]), r["top"]) == (len(fs), len({f.file for f in fs}), sorted({f.code for f in fs}), max(f.code for f in fs))
        assert (r["low"], r["lines"], r["first"]) == (min(f.line for f in fs), sum(f.line for f in fs), fs[0].line)
    q["having"] = {"op": "contains", "left": "codes", "right": "403"}
    assert {r.user for r in run(spark, corpora, q).df.collect()} == {u for u, fs in by.items() if any(f.code == "403" for f in fs)}


def test_aggregate_of_nothing_is_one_row(spark, corpora):
    none = [{"id": "none", "scan": ["logs"], "patterns": [{"id": "none", "regexp": "reboot"}]}]
    q = {"from": {"set": "none", "as": "x"}, "select": {"n": {"count": "*"}, "s": {"sum": "x.line"}, "f": {"first": "x.file"}}}
    assert [json.loads(x) for x in run(spark, corpora, q, sets=none).df.toJSON().collect()] == [{"n": 0, "s": 0}]


def test_predicates_expressions_and_pages(spark, corpora):
    where = {"op": "and", "args": [{"op": "or", "args": [{"op": "starts_with", "left": "f.capture.code", "right": "40"}, {"op": "is_null", "left": "f.capture.code"}]}, {"op": "not", "arg": {"op": "in", "left": "f.capture.user", "right": ["u0", "u1"]}}, {"op": "lte", "left": "f.line", "right": 9}]}
    select = {"up": {"upper": "f.capture.user"}, "down": {"lower": {"literal": "ÀB"}}, "tag": {"concat": ["f.capture.user", {"literal": "/"}, "f.capture.code"]}, "base": {"basename": {"literal": "/var/log/x.gz"}}, "dir": {"dirname": {"literal": "/var/log/x.gz"}}, "scope": {"coalesce": ["f.enclosing.name", {"literal": "-"}]}, "file": "f.file", "at": "f.from"}
    q = {"from": {"set": "fail", "as": "f"}, "where": where, "select": select, "order_by": [{"field": "tag", "direction": "desc"}, {"field": "file"}, {"field": "at"}], "skip": 2, "limit": 5}
    want = sorted((f for f in plain("fail") if f.user not in ("u0", "u1") and f.line <= 9), key=lambda f: (f.file, f.start))
    want.sort(key=lambda f: f"{f.user}/{f.code}", reverse=True)
    got = [r.asDict() for r in run(spark, corpora, q).df.collect()]
    assert got == [{"up": f.user.upper(), "down": "Àb", "tag": f"{f.user}/{f.code}", "base": "x.gz", "dir": "/var/log", "scope": "-", "file": f.file, "at": f.start} for f in want[2:7]]


DAM = "function fill(lake) {\n  pump(lake);\n  seal(lake);\n  drain(lake);\n}\nfunction spill(pond) {\n  drain(pond);\n  pump(pond);\n}\nfunction rush(river) {\n  pump(river);\n  drain(river);\n}\n"


def test_three_sets_by_scope(spark, corpora):
    """What is pumped and later drained in the same function without being sealed there."""
    sets = [{"id": w, "scan": ["code"], "scope": "auto", "patterns": [{"id": w, "regexp": rf"{w}\((\w+)\)", "extract": ["what"]}]} for w in ("pump", "seal", "drain")]
    with_ = lambda b, *more: [{"op": "eq", "left": "p.capture.what", "right": f"{b}.capture.what"}, {"op": "same_scope", "left": "p", "right": b}, *more]
    joins = [{"type": "inner", "set": "drain", "as": "d", "on": with_("d", {"op": "before", "left": "p", "right": "d"})}, {"type": "anti", "set": "seal", "as": "s", "on": with_("s")}]
    q = {"from": {"set": "pump", "as": "p"}, "joins": joins, "select": {"what": "p.capture.what", "where": "p.enclosing.name"}}
    result = run(spark, corpora, q, sets=sets)
    assert [tuple(r) for r in result.df.collect()] == [("river", "rush")]
    assert len(result.plan["scan_stages"]) == 1 and [o["op"] for o in result.plan["postprocess"]][:2] == ["hash-inner-join", "hash-anti-join"]
    assert Query({"version": 1, "sets": SETS, "query": pair("inner", CONDITIONS[2][0], {"a": "f.file"})}).plan()["postprocess"][0]["op"] == "interval-inner-join"


def test_patterns_from_rows(spark, corpora):
    found = {"id": "known", "scan": ["notes"], "patterns": [{"id": "k", "regexp": r"^(u\d+)( \[vip\])?$", "extract": ["user", "mark"]}]}
    derive = {"from_set": "known", "field": "capture.user", "mode": "literal", "max_patterns": 5}
    sets = [found, {"id": "seen", "scan": ["logs"], "derive_patterns": derive}]
    q = {"from": {"set": "seen", "as": "s"}, "group_by": ["s.derived.value"], "select": {"user": "s.derived.value", "n": {"count": "*"}}}
    text = "\n".join(logs().values())
    assert rows(spark, corpora, q, sets=sets) == sorted((text.count(u), u) for u in ("u1", "u7") if u in text)
    q = {"from": {"set": "seen", "as": "s"}, "select": {"user": "s.derived.value", "rows": "s.derived.source_rows"}}
    assert {(r.user, tuple(r.rows)) for r in run(spark, corpora, q, sets=sets).df.collect()} <= {("u1", (0, 2)), ("u7", (1,))}
    derive["max_patterns"] = 1
    with pytest.raises(LimitExceeded):
        run(spark, corpora, q, sets=sets)


@pytest.mark.parametrize("limit", ["max_rows_per_set", "max_total_rows", "max_memory_bytes"])
def test_limits_raise_or_cut(spark, corpora, limit):
    q = {"from": {"set": "fail", "as": "f"}, "select": {"user": "f.capture.user"}}
    most = 200 if limit == "max_memory_bytes" else 2
    with pytest.raises(LimitExceeded):
        run(spark, corpora, q, sets=SETS[1:2], limits={limit: most})
    result = run(spark, corpora, q, sets=SETS[1:2], limits={limit: most}, on_limit="partial")
    assert not result.complete and result.stop_reason == limit and result.df.count() == 2
    assert run(spark, corpora, q, sets=SETS[1:2], limits={limit: 10**6}).complete


def test_products_are_guarded(spark, corpora):
    q = pair("inner", [{"op": "lt", "left": "f.line", "right": "l.line"}], {"a": "f.line", "b": "l.line"})
    with pytest.raises(LimitExceeded, match="predicted Cartesian"):
        Query({"version": 1, "sets": SETS, "query": q})
    q["joins"][0]["allow_cartesian"] = True
    assert rows(spark, corpora, q) == sorted((f.line, x.line) for f, x in product(plain("fail"), plain("login")) if f.line < x.line)


@pytest.mark.parametrize("bad", [{"from": {"set": "moon", "as": "m"}}, {"extra": 1}, {"select": {"a": "f.colour"}}, {"having": {"op": "eq", "left": "a", "right": 1}}, {"where": {"op": "resembles", "left": "a", "right": 1}}])
def test_bad_documents(bad):
    with pytest.raises(QueryError):
        Query({"version": 1, "sets": SETS, "query": {"from": {"set": "fail", "as": "f"}, "select": {"a": "f.file"}} | bad})
