import random
import re

import pytest

from textloom.errors import QueryError
from textloom.functions import lexers
from textloom.functions.longest import Longest
from textloom.functions.patterns import Pattern, escape, numbered, resolve, rule_pack
from textloom.operators import filters, rank, scan, shapes
from textloom.sources import paths
from textloom.sources.corpus import Corpus

GO = "package a\n\n// TODO: refactor this\nfunc main() {\n\thelper() // call\n}\n\nfunc helper() error {\n\ts := \"TODO\"\n\treturn nil\n}\n"


def brute(rx: str, text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(text):
        end = max((e for e in range(at + 1, len(text) + 1) if re.compile(rx, re.M).fullmatch(text, at, e)), default=0)
        if end:
            out.append((at, end))
            at = end
        else:
            at += 1
    return out


@pytest.mark.parametrize("rx", ["a|ab", "a+?b?", "(?:ab|a)(?:c|bcd)?", "a{1,3}?", "[ab]+c|a", "ab*?", "(a|b)*c", "a.?b"])
def test_longest_equals_brute_force(rx):
    rng = random.Random(1)
    p = Pattern("p", rx).check()
    for _ in range(150):
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))
        assert [(m.start(), m.end()) for m in p.matcher.finditer(text)] == brute(rx, text), text
        assert [(m.start(), m.end()) for m in Longest(p.tree, p.flags).finditer(text)] == brute(rx, text), text


def test_pattern_rules():
    assert [(m.start(), m.end()) for m in Pattern("p", r"^foo$").matcher.finditer("foo\nfoo\r\nfoo")] == [(0, 3), (9, 12)]
    for bad in ("a*", "(?=a)b", r"(a)\1", "(?<!a)b", "(", "x?"):
        with pytest.raises(QueryError):
            Pattern("p", bad).check()
    assert not Pattern("p", "foo|foobar").safe and Pattern("p", "[a-z]+@[a-z]+").safe
    assert escape("a+b.(c)") == r"a\+b\.\(c\)"
    assert Pattern("p", r"(\w+)=(\d+)?", extract=("k", "v")).captures("ab=") == {"k": "ab", "v": ""}
    assert [p.id for p in numbered([Pattern("", "a"), Pattern("x", "b")])] == ["p0", "x"] and resolve(numbered([Pattern("", "a")]), "0") == 0
    assert [p.regexp for p in rule_pack('# c\n\n{"id":"x","literal":"a+"}\n{"regexp":"b"}')] == [r"a\+", "b"]
    with pytest.raises(QueryError):
        rule_pack('{"id":"x","regexp":"a","why":1}')


def test_lexers():
    f = lexers.forms("a.go")
    r = lexers.roles(GO, f)
    assert [k for _, _, k in r.spans] == ["comment", "comment", "string"]
    assert [(s.name, s.kind) for s in lexers.scopes(GO, "a.go")] == [("main", "func"), ("helper", "func")]
    assert lexers.subtokens("parseHTTPRequest_v2") == ["parse", "HTTP", "Request", "v", "2"]
    assert lexers.identifier_matches("parseHTTPRequest", ["http", "req"]) and not lexers.identifier_matches("parseHTTPRequest", ["ttp"])
    assert lexers.block("f {a {b} c} {d}", 0, "{", "}") == (2, 10, 11)
    assert lexers.block("x { /* } */ }", 0, "{", "}", lexers.roles("x { /* } */ }", lexers.forms("a.c"))) == (2, 12, 13)
    rust = lexers.roles("/* a /* b */ c */ 'x \"s\ntwo\" // end", lexers.forms("a.rs"))
    assert [k for _, _, k in rust.spans] == ["comment", "string", "comment"]
    py = lexers.roles('import os\nx = """a # b\n"""\n', lexers.forms("a.py"))
    assert [k for _, _, k in py.spans] == ["string"] and py.imports == {0}


def test_scan_rows(spark):
    c = Corpus.from_text(spark, {"a.go": GO, "b.txt": "é TODO\n\xff".encode("latin-1")})
    o = scan.Options(frozenset(("context", "captures", "scope", "role", "block", "occurrence")))
    rows = scan.match(c, [Pattern("todo", "TODO"), Pattern("fn", r"func (\w+)", extract=("name",))], [("help",)], options=o).orderBy("walk_ord", "from", "pattern_index").collect()
    assert [(r.file, r.pattern_id, r["from"], r.line, r.column, r.role) for r in rows if r.pattern_id == "todo"] == [("a.go", "todo", 14, 3, 4, "comment"), ("a.go", "todo", GO.rindex("TODO"), 9, 8, "string"), ("b.txt", "todo", 2, 1, 3, None)]
    fn = [r for r in rows if r.pattern_id == "fn"]
    assert [r.captures["name"] for r in fn] == ["main", "helper"] and fn[0].block.full.startswith("func main() {") and fn[0].enclosing.name == "main"
    assert [(r.match, r.occurrence) for r in rows if r.pattern_id == "ident0"] == [("helper", "call_or_reference"), ("helper", "probable_definition")]
    got = scan.submatch(scan.match(c, [Pattern("line", "^.*TODO.*$")]).select("file", "match", "from"), "match", [Pattern("t", "T.D")], "from").select("file", "sub.*").orderBy("file", "from").collect()
    assert [(r.file, r["from"]) for r in got] == [("a.go", 14), ("a.go", GO.rindex("TODO")), ("b.txt", 4)]


def test_relations_and_shapes(spark):
    a = "func A() {\n mu.Lock()\n defer mu.Unlock()\n}\nfunc B() {\n mu.Lock()\n}\n"
    c = Corpus.from_text(spark, {"a.go": a, "b.txt": "nothing\n"})
    o = scan.Options(frozenset(("context", "captures", "scope", "role")))
    rows = scan.match(c, [Pattern("lock", r"mu\.Lock"), Pattern("un", r"mu\.Unlock")], options=o).cache()
    at = lambda df: sorted((r.pattern_id, r.line) for r in df.collect())
    assert at(filters.near(rows, "lock", "un", 1)) == [("lock", 2), ("un", 3)]
    assert at(filters.far(rows, "lock", "un", 1)) == [("lock", 6), ("un", 3)]
    assert at(filters.relations(rows, [("same_scope", "lock", "un")])) == [("lock", 2), ("un", 3)]
    assert at(filters.relations(rows, [("not_same_scope", "lock", "un")])) == [("lock", 6), ("un", 3)]
    assert at(filters.in_scope(rows, scan.list_scopes(c), name="^B$")) == [("lock", 6)]
    assert at(filters.lines(rows, "1:2,6")) == [("lock", 2), ("lock", 6)]
    where = lambda t: [r.file for r in filters.FileWhere(t, ["lock", "un"]).files(c.languages(), rows).orderBy("walk_ord").collect()]
    assert where("lock AND count(un) == 1") == ["a.go"] and where("!lock") == ["b.txt"] and where('lang != "go" OR (un && count(0) > 2)') == ["b.txt"]
    for bad in ("lock AND", "nope", "count(lock)", "(lock", "lang < go"):
        with pytest.raises(QueryError):
            filters.FileWhere(bad, ["lock", "un"])
    assert [(r.scope, dict(r.counts)) for r in shapes.rollup(rows).orderBy("line_start").collect()] == [("A", {"lock": 1, "un": 1}), ("B", {"lock": 1})]
    text = shapes.elided(c.df, rows, 0).collect()[0].text.split("\n")
    assert text[0] == "a.go" and "  1: func A() {" in text and "  4: }" in text
    assert "  2: [lock]  mu.Lock() in func A" in [r.text.split("\n")[-1] for r in shapes.compact(rows).collect()]
    assert shapes.record(rows).orderBy("from").first().json.startswith('{"file":"a.go","pat":"lock","line":2,"col":2')
    assert shapes.summary(c.df, rows).first().matches == 3
    assert [r.file for r in rank.hotspots(rows, c.df.selectExpr("file", "10 line_count"), 2, 5).collect()] == ["a.go"]


def test_paths(tmp_path):
    for p in ("a/x.go", "a/.hid/y.go", "a/b/z.py", "vendor/q.go", ".env", "_u.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    t = str(tmp_path)
    rel = lambda r: [x.removeprefix(t + "/") for x in r[0]]
    assert rel(paths.walk([f"{t}/**/*.go"])) == ["a/x.go", "vendor/q.go"]
    assert rel(paths.walk([t], exclude=["vendor"])) == ["_u.txt", "a/b/z.py", "a/x.go"]
    assert rel(paths.walk([f"{t}/.env", f"{t}/**/*.{{py,txt}}"])) == [".env", "_u.txt", "a/b/z.py"]
    assert paths.walk([], files=[f"{t}/a/x.go", f"{t}/none"])[1] == [f"{t}/none"]
    assert paths.braces("{a,b{c,d}}.x") == ["a.x", "bc.x", "bd.x"] and paths.file_list(b"a\r\nb\n") == ["a", "b"] and paths.file_list(b"a\0b", True) == ["a", "b"]
    assert paths.glob_match("src/**/[!x]*.c", "src/a/b/y.c") and not paths.glob_match("src/**/[!x]*.c", "src/x.c")


def test_files(spark, tmp_path):
    (tmp_path / "t.txt").write_bytes("é a\n".encode())
    (tmp_path / "b.bin").write_bytes(b"a\0b")
    c = Corpus.from_files(spark, [str(tmp_path), str(tmp_path / "gone")])
    assert [r.file.rsplit("/", 1)[-1] for r in c.df.collect()] == ["t.txt"] and len(c.missing) == 1
    assert [r.code for r in c.warnings.collect()] == ["binary_skip"]
