import random

import pytest

from textloom.functions.patterns import Pattern
from textloom.operators import chunks, retrieve, scan
from textloom.sources.corpus import Corpus

BODY = "\n".join(f"  step{i}()" for i in range(60))
GO = f"package a\n\n// hit outside\n\nfunc long(a int,\n  b int) {{\n{BODY}\n  hit(1)\n  end()\n  end()\n  end()\n}}\n\nfunc small() {{\n  x()\n  hit(2)\n}}\n"


def test_covers_equal_sets_of_lines():
    rng = random.Random(1)
    for _ in range(300):
        spans = [(a := rng.randint(1, 30), a + rng.randint(0, 6)) for _ in range(rng.randint(0, 8))]
        got = chunks.covered(spans)
        assert {n for a, b in got for n in range(a, b + 1)} == {n for a, b in spans for n in range(a, b + 1)}
        assert all(b + 1 < c for (_, b), (c, _) in zip(got, got[1:], strict=False))


def test_chunks_of_a_file(spark):
    corpus = Corpus.from_text(spark, {"a.go": GO})
    rows = scan.match(corpus, [Pattern("h", "hit")])
    loose, long, small = sorted(chunks.chunks(corpus, rows).collect(), key=lambda r: r["first"])
    assert (loose.scope, loose["first"], loose.last, loose.anchors) == (None, 1, 5, [3])
    assert loose.texts[1].split("\n")[0] == "a.go:1-5" and loose.texts[3] == "a.go:1-5" and loose.whole == [True, True, False, False]
    assert (long.scope, long["first"], long.last, long.anchors) == ("long", 5, 71, [67])
    assert long.texts[1] == "a.go:5-71 long\n  5: func long(a int,\n  6:   b int) {\n… (+58 lines)\n  65:   step58()\n  66:   step59()\n> 67:   hit(1)\n  68:   end()\n  69:   end()\n… (+2 lines)"
    assert long.texts[0] == long.texts[1] and long.texts[2].split("\n")[3:] == ["… (+60 lines)", "> 67:   hit(1)", "… (+4 lines)"]
    assert small.texts[0] == "a.go:73-76 small\n  73: func small() {\n  74:   x()\n> 75:   hit(2)\n  76: }" and small.whole[0]
    assert small.texts[2] == "a.go:73-76 small\n  73: func small() {\n… (+1 lines)\n> 75:   hit(2)\n… (+1 lines)"
    assert all(r.sizes == [len(t.encode()) + 1 for t in r.texts] for r in (loose, long, small))


@pytest.mark.parametrize("budget", [0, 9, 20, 60, 150, 400, 4000])
def test_packing_equals_a_greedy_loop(spark, budget):
    corpus = Corpus.from_text(spark, {f"{x}.go": GO for x in "abc"} | {"d.txt": "none\nhit"})
    found = chunks.chunks(corpus, scan.match(corpus, [Pattern("h", "hit")]))
    got = chunks.pack(found, ["file", "first"], budget)
    rows = sorted(found.collect(), key=lambda r: (r.file, r["first"]))
    held, used = [], 0
    for r in rows:
        level = next((k for k in (1, 2, 3) if used + r.sizes[k] <= budget), None)
        if level:
            held.append([r, level])
            used += r.sizes[level]
    for x in held:
        while x[1] and used + x[0].sizes[x[1] - 1] - x[0].sizes[x[1]] <= budget:
            used += x[0].sizes[x[1] - 1] - x[0].sizes[x[1]]
            x[1] -= 1
    assert got.texts == [r.texts[k] for r, k in held] and got.levels == [k for _, k in held] and got.used == used <= budget
    assert got.omitted == len(rows) - len(held) and got.complete == (budget == 4000 and not any(r.scope == "long" for r in rows))


def test_many_matches_in_one_file(spark):
    corpus = Corpus.from_text(spark, {"a.go": "".join(f"func f{i}() {{\n  hit()\n}}\n" for i in range(5000)), "b.txt": "hit\n" * 20_000})
    found = chunks.chunks(corpus, scan.match(corpus, [Pattern("h", "hit")]))
    assert found.filter("file = 'a.go'").count() == 5000 and found.filter("file = 'b.txt' and size(anchors) = 20000").count() == 1


def test_sources_in_a_report(spark):
    corpus = Corpus.from_text(spark, {"a.go": "package a\n\nfunc check(t string) bool {\n\treturn deep(t)\n}\n", "b.go": "package a\n\nfunc deep(t string) bool {\n\treturn true\n}\n", "a_test.go": "package a\n\nfunc TestCheck() {\n\tcheck(1)\n}\n"})
    report = retrieve.investigate(spark, corpus, ["check"], source_budget=2000)
    assert report.sources.levels == [0] * len(report.sources.texts) and len(report.sources.texts) == 3 and report.summary["source_complete"]
    assert any("> 3: func deep" in t for t in report.sources.texts)
    tight = retrieve.investigate(spark, corpus, ["check"], source_budget=60)
    assert tight.sources.used <= 60 and not tight.summary["source_complete"] and tight.summary["source_omitted"] == 3 - len(tight.sources.texts)
