from concurrent.futures import ThreadPoolExecutor

import json

import pytest

from textloom.errors import GuardViolation, QueryError
from textloom.functions.patterns import Pattern
from textloom.operators import edits, rank, references, retrieve, scan, seen, shapes
from textloom.plans.query import run_query
from textloom.plans.script import run_script
from textloom.sources.corpus import Corpus
from textloom.streaming import tail

AUTH = "package auth\n\nfunc validateToken(t string) bool {\n\treturn verifySignature(t)\n}\n"
CRYPTO = "package auth\n\nfunc verifySignature(t string) bool {\n\treturn t != \"\"\n}\n"
TEST = "package auth\n\nfunc TestValidate(x *T) {\n\tvalidateToken(\"a\")\n}\n"


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.from_text(spark, {"auth.go": AUTH, "crypto.go": CRYPTO, "auth_test.go": TEST, "docs/auth.md": "validateToken checks\n"})


def test_investigate(spark, corpus):
    report = retrieve.investigate(spark, corpus, ["validateToken"])
    got = {(x["category"], x["file"]) for x in report.evidence}
    assert {("seed_implementation", "auth.go"), ("related_helper", "crypto.go"), ("associated_test", "auth_test.go"), ("documentation", "docs/auth.md")} <= got
    assert report.summary["complete"] and "verifySignature" in [r["name"] for r in report.related]
    small = retrieve.investigate(spark, corpus, ["validateToken"], budget=250)
    assert not small.summary["complete"] and small.summary["bytes"] <= 250


def test_references(spark, corpus):
    ref = references.reference("auth.go", 4, "\treturn verifySignature(t)")
    got = {r.ref: r for r in references.expand(spark, corpus, [ref, ref.replace(":4@", ":1@"), "auth.go:2@abcdef", "gone.go:1@abcdef"]).collect()}
    assert got[ref].status == "ok" and got[ref].scope == "validateToken" and got[ref].line_start == 3
    assert got[ref.replace(":4@", ":1@")].status == "moved" and got["auth.go:2@abcdef"].status == "stale" and got["gone.go:1@abcdef"].status == "missing"
    with pytest.raises(QueryError):
        references.expand(spark, corpus, ["nothing"])
    rows = references.with_references(scan.match(corpus, [Pattern("v", "verifySignature\\(t\\)")]))
    assert rows.first().ref == ref


def test_seen(spark, corpus, tmp_path):
    shown = spark.createDataFrame([("a", 1, 2, "x"), ("b", 1, 1, "y")], "file string, line_start int, line_end int, text string")
    references.save_seen(shown.limit(1), str(tmp_path / "seen"))
    assert [r.file for r in references.unseen(shown, references.load_seen(spark, str(tmp_path / "seen"))).collect()] == ["b"]


def test_references_of_every_kind(spark):
    """Without a hash, moved, standing more than once, of another length, in paths with colons; from a table."""
    corpus = Corpus.from_text(spark, {"a:b.txt": "one\n  two \ntwo\nthree\n\nsix", "c@d.txt": "x"})
    h = references.line_hash
    refs = {"a:b.txt:1": ("ok", 1), f"a:b.txt:1@{h('six')}": ("moved", 6), f"a:b.txt:4@{h('two')}": ("ambiguous", None), f"a:b.txt:2@{h('two').upper()}": ("ok", 2), "a:b.txt:7": ("stale", None), f"a:b.txt:9@{h('three')}": ("moved", 4), "a:b.txt:1@abc": ("stale", None), "no.txt:1": ("missing", None), f"c@d.txt:1@{h('x')}": ("ok", 1)}
    got = references.expand(spark, corpus, spark.createDataFrame([(r,) for r in refs], "ref string"))
    assert {r.ref: (r.status, r.line) for r in got.collect()} == refs
    for bad in ("c@d.txt:1", "a.txt:0", "a.txt", ":3", "a.txt:1@xyz", "a.txt:x"):
        with pytest.raises(QueryError):
            references.expand(spark, corpus, [bad])


def test_many_references_to_one_file(spark):
    n = 20_000
    corpus = Corpus.from_text(spark, {"long": "\n".join(f"line {i}" for i in range(n))})
    refs = spark.range(n).selectExpr("concat('long:', id + 1) as ref").collect()
    moved = [f"long:{i + 2}@{references.line_hash(f'line {i}')}" for i in range(0, n, 4)]
    got = references.expand(spark, corpus, [r.ref for r in refs] + moved)
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == {"ok": n, "moved": n // 4}


def test_runs_at_the_same_time_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    shown = lambda k: spark.createDataFrame([(f"f{k}", 1, 2, f"text {k}"), ("all", 1, 1, "same")], "file string, line_start int, line_end int, text string")
    with ThreadPoolExecutor(6) as pool:
        numbers = sorted(pool.map(lambda k: seen.Store(spark, path).commit(shown(k), compact=k % 3 == 2), range(9)))
    assert numbers == list(range(1, 10))
    state = seen.Store(spark, path).load()
    assert {r.file for r in state.collect()} == {"all", *(f"f{k}" for k in range(9))}
    assert references.unseen(shown(4).union(shown(11)), state).select("file").collect() == [("f11",)]
    assert seen.Store(spark, path).commit(shown(1), compact=True) == 10
    assert seen.Store(spark, path).load().count() == 10


def test_state_as_text(spark, tmp_path):
    """Lines that are no entries are left out; quotes are plain text."""
    good = ['a "b.go\t1\t20\tab12', "c\t3\t4\tFF"]
    (tmp_path / "s.tsv").write_text("\n".join([good[0] + "\r", "x\t1\t2", "x\ty\t2\tab", "", "x\t1\t2\tzz", "x\t1\t2\tab\tmore", good[1]]))
    assert sorted("\t".join(map(str, r)) for r in seen.read_tsv(spark, str(tmp_path / "s.tsv")).collect()) == good


def test_batches_show_what_is_new(spark, tmp_path):
    told = []
    each = seen.batches(str(tmp_path / "state"), lambda df, n: told.append((n, sorted(r.file for r in df.collect()))))
    rows = lambda *names: spark.createDataFrame([(n, 1, 1, n) for n in names], "file string, line_start int, line_end int, text string")
    each(rows("a", "b"), 0)
    each(rows("b", "c"), 1)
    assert told == [(0, ["a", "b"]), (1, ["c"])]


def test_budget(spark, corpus):
    rows = scan.match(corpus, [Pattern("v", "validateToken"), Pattern("s", "verifySignature")])
    ranked = rank.files(rows, corpus.df.selectExpr("file", "5 line_count"), 2)
    out, dropped = retrieve.budget_pack(rows, ranked, 90)
    assert out[0].startswith("auth.go") and sum(len(x) + 1 for x in out) <= 90 and dropped is not None


def test_edits(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "a.go").write_text("func A() {\n\told()\n}\n// old\n")
    e = edits.Edit([Pattern("old", r"old\b")], content="new_$PAT_ID", expect=2)
    p = edits.plan(e, ["a.go"])
    assert "-\told()" in edits.diff(p) and (tmp_path / "a.go").read_text().count("old") == 2
    assert edits.apply(edits.load(__import__("json").dumps(p)))[-1] == {"type": "apply-summary", "committed": 1, "failed": 0, "complete": True}
    assert (tmp_path / "a.go").read_text() == "func A() {\n\tnew_old()\n}\n// new_old\n"
    with pytest.raises(GuardViolation):
        edits.apply(p)
    body = edits.plan(edits.Edit([Pattern("f", r"func (\w+)", extract=("n",))], span="scope-body", content="\\n\\tdone_$EXTRACT_N()\\n"), ["a.go"])
    edits.apply(body)
    assert (tmp_path / "a.go").read_text().startswith("func A() {\n\tdone_A()\n}\n")
    for bad in (dict(content="x", expect=5), dict(content="x", assert_contains="zzz"), dict(content="x", span="block", block_open="<", block_close=">")):
        with pytest.raises(GuardViolation):
            edits.plan(edits.Edit([Pattern("f", "func")], **bad), ["a.go"])
    with pytest.raises(QueryError):
        edits.Edit([Pattern("f", "func")])


def test_stream(spark, tmp_path):
    schema = "k long, t string"
    spark.createDataFrame([(1, "foo bar"), (2, "none")], schema).write.parquet(str(tmp_path / "in"))
    got = []
    q = tail.follow(spark, str(tmp_path / "in"), schema, "k", "t", [Pattern("f", "foo|bar")], lambda df, _: got.extend(r.match for r in df.collect()), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == ["bar", "foo"]


def test_records_say_what_was_cut(spark):
    c = Corpus.from_text(spark, {"a.c": "call(abcdéf) { one {two} é }\n"})
    options = scan.Options(frozenset(("context", "block", "captures")), max_match=10, max_context=12, max_block=8)
    (r,) = shapes.record(scan.match(c, [Pattern("p", r"call\((\w+é\w)\)", extract=("x",))], options=options)).collect()
    want = {"file": "a.c", "pat": "p", "line": 1, "col": 1, "from": 0, "to": 13, "match": "call(abcd", "context": "call(abcdéf", "block": " one {tw", "block_full": "call(abc", "block_start": 14, "block_end": 30, "block_line_start": 1, "block_line_end": 1}
    want |= dict.fromkeys(("match_truncated", "context_truncated", "block_truncated", "block_full_truncated", "truncated"), True) | {"extracted": {"x": "abcdéf"}}
    got = json.loads(r.json)
    assert got == want and list(got) == list(want)
    (r,) = shapes.record(scan.match(c, [Pattern("p", "call")])).collect()
    assert not any("trunc" in k for k in json.loads(r.json))


def test_legend_and_tabs(spark):
    patterns = [Pattern("a", "x\ty", description="first\tone"), Pattern("b", "q"), Pattern("i", "")]
    assert shapes.legend(patterns, ["src", "*.c"]) == ["query: 3 patterns over src, *.c", "  a — first one", "  b — /q/", "  i — (ident group)"]
    assert shapes.legend(patterns[1:], ["src"]) == []
    head, lines = shapes.tabbed(spark.createDataFrame([("a\tb\nc", None, [1, 2])], "x string, `y.z` int, l array<int>"))
    assert head == "x\ty.z\tl" and lines.first().text == "a b c\t\t[1,2]"


def test_documents_from_text_and_files(spark, tmp_path):
    doc = {"version": 1, "sets": [{"id": "s", "scan": ["c"], "patterns": [{"id": "p", "regexp": "[x\"]+"}]}], "query": {"from": {"set": "s", "as": "a"}, "select": {"m": "a.match"}, "max_rows": 1}, "on_limit": "partial"}
    corpora = {"c": Corpus.from_text(spark, {"t": "xx x"})}
    (tmp_path / "q.json").write_text(json.dumps(doc))
    for given in (doc, json.dumps(doc), str(tmp_path / "q.json"), tmp_path / "q.json"):
        found = run_query(spark, given, corpora)
        assert len(found.df.collect()) == 1 and found.footer() == '{"type":"query-footer","complete":false,"stop_reason":"max_rows"}' and found.footer(True) == "QUERY INCOMPLETE reason=max_rows"
    for bad in ("{", '{"a":' * 1001 + "1" + "}" * 1001, "{} {}"):
        with pytest.raises(QueryError):
            run_query(spark, bad, corpora)
    (tmp_path / "s.json").write_text(json.dumps({"patterns": [{"id": "p", "regexp": "x+", "on_match": [{"action": "print", "value": "$MATCH"}]}]}))
    assert [r.line for r in run_script(spark, tmp_path / "s.json", corpora["c"]).rows.orderBy("seq").collect()] == ["xx", "x"]
