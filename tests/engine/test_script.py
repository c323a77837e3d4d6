"""Scripts over random order books, held against plain Python over the same lines."""

import json
import random
import re
from collections import Counter, defaultdict

import pytest

from textloom.errors import QueryError
from textloom.plans.script import run_script
from textloom.sources.corpus import Corpus

BUY, GONE = r"buy (\w+) x(\d+)", r"cancel (\w+)"


def books() -> dict[str, str]:
    rng = random.Random(8)
    goods = "tea rice salt oil soap".split()
    line = lambda: rng.choice((f"buy {rng.choice(goods)} x{rng.randint(1, 9)}", f"cancel {rng.choice(goods)}", "note"))
    return {f"day{i}.txt": "\n".join(line() for _ in range(rng.randint(3, 9))) for i in range(5)} | {"quiet.txt": "note\nnote"}


def events():
    """(file, line, kind, good, pieces) in scan order."""
    for file, text in books().items():
        for n, line in enumerate(text.split("\n"), 1):
            if m := re.fullmatch(BUY, line):
                yield file, n, "buy", m[1], int(m[2])
            elif m := re.fullmatch(GONE, line):
                yield file, n, "cancel", m[1], 0


@pytest.fixture(scope="module")
def corpus(spark):
    return Corpus.from_text(spark, books())


def run(spark, corpus, **doc):
    out = run_script(spark, doc, corpus)
    found = [(r.kind, r.line) for r in out.rows.orderBy("phase", "walk_ord", "seq").collect()]
    return [json.loads(line) if kind == "json" else line for kind, line in found], out


def buy(*actions, **more):
    return {"id": "buy", "regexp": BUY, "extract": ["good", "pieces"], "on_match": list(actions), **more}


def cancel(*actions, **more):
    return {"id": "cancel", "regexp": GONE, "extract": ["good"], "on_match": list(actions), **more}


def emit(**data):
    return {"action": "emit", "data": data}


PLACE = emit(file="$FILE", line="$LINE", good="$EXTRACT_GOOD")
BOUGHT = [{"file": f, "line": n, "good": g} for f, n, k, g, _ in events() if k == "buy"]


def test_rows_text_pages_and_caps(spark, corpus):
    got, out = run(spark, corpus, patterns=[buy(PLACE)])
    assert got == BOUGHT and not out.warnings
    assert run(spark, corpus, patterns=[buy(PLACE)], skip=3, limit=4)[0] == BOUGHT[3:7]
    assert run(spark, corpus, patterns=[buy({"action": "print", "value": "$FILE/$LINE/$COL $MATCH"})])[0] == [f"{f}/{n}/1 buy {g} x{p}" for f, n, k, g, p in events() if k == "buy"]
    seen = Counter()
    assert run(spark, corpus, patterns=[buy(PLACE)], limit_per_file=2)[0] == [r for r in BOUGHT if not seen.update([r["file"]]) and seen[r["file"]] <= 2]
    grouped, _ = run(spark, corpus, patterns=[buy(PLACE)], group_by="good")
    assert [(g["key"], g["group"]) for g in grouped] == [(k, [r for r in BOUGHT if r["good"] == k]) for k in dict.fromkeys(r["good"] for r in BOUGHT)]


def test_sums_maps_and_lists_run_apart(spark, corpus):
    actions = [{"action": "add", "var": "pieces", "value": "$EXTRACT_PIECES"}, {"action": "map_increment", "target": "orders", "key": "$EXTRACT_GOOD"}, {"action": "unique_append", "target": "days", "value": "$FILE"}, {"action": "map_append", "target": "where", "key": "$EXTRACT_GOOD", "value": "$LINE"}]
    kinds = {"pieces": "int", "orders": "map", "days": "list", "where": "map"}
    each = {"action": "for_each", "var": "orders", "key_as": "good", "as": "n", "do": [emit(good="$good", n="$n")]}
    got, out = run(spark, corpus, variables={k: {"type": v} for k, v in kinds.items()}, patterns=[buy(*actions)], on_complete=[each, emit(pieces="$pieces", days="$days", where="$where")])
    orders, where = Counter(r["good"] for r in BOUGHT), defaultdict(list)
    for r in BOUGHT:
        where[r["good"]].append(r["line"])
    assert not out.warnings and got[:-1] == [{"good": g, "n": orders[g]} for g in sorted(orders)]
    assert got[-1] == {"pieces": sum(e[4] for e in events()), "days": list(dict.fromkeys(r["file"] for r in BOUGHT)), "where": where}


def test_state_of_a_file_is_reset_at_its_end(spark, corpus):
    over = {"action": "if", "condition": {"op": "gt", "args": ["$sum", 8]}, "then": [{"action": "set", "var": "big", "value": True}]}
    end = [{"action": "if", "condition": {"op": "isset", "args": ["big"]}, "then": [emit(file="$FILE", sum="$sum")], "else": [{"action": "print", "value": "small: $FILE"}]}, {"action": "reset", "vars": ["sum", "big"]}]
    got, out = run(spark, corpus, variables={"sum": {"type": "int"}, "big": {"type": "bool"}}, patterns=[buy({"action": "add", "var": "sum", "value": "$EXTRACT_PIECES"}, over)], on_file_end=end)
    total = {f: sum(e[4] for e in events() if e[0] == f) for f in books()}
    assert got == [{"file": f, "sum": n} if n > 8 else f"small: {f}" for f, n in total.items()] and not out.warnings


def test_state_across_files_needs_scan_order(spark, corpus):
    got, out = run(spark, corpus, variables={"n": {"type": "int"}}, patterns=[buy({"action": "increment", "var": "n"}, {"action": "print", "value": "$n"})])
    assert got == [str(i + 1) for i in range(len(BOUGHT))] and out.warnings


def test_second_phase_looks_up_the_first(spark, corpus):
    first = {"patterns": [buy({"action": "map_set", "target": "last", "key": "$EXTRACT_GOOD", "value": "$FILE"})]}
    second = {"patterns": [cancel({"action": "lookup", "map": "last", "key": "$EXTRACT_GOOD", "on_hit": [emit(at="$FILE", good="$LOOKUP_KEY", bought="$LOOKUP_VALUE")], "on_miss": [{"action": "print", "value": "never bought: $LOOKUP_KEY"}]})]}
    got, _ = run(spark, corpus, variables={"last": {"type": "map"}}, phases=[first, second])
    last = {r["good"]: r["file"] for r in BOUGHT}
    assert got == [{"at": f, "good": g, "bought": last[g]} if g in last else f"never bought: {g}" for f, _, k, g, _ in events() if k == "cancel"]


def test_absent_patterns(spark, corpus):
    got, _ = run(spark, corpus, patterns=[buy(emit(quiet="$FILE"), absent=True)])
    assert got == [{"quiet": f} for f, t in books().items() if not re.search(BUY, t)]


@pytest.mark.parametrize("kind", ["near", "far"])
def test_relations(spark, corpus, kind):
    asked = {"kind": kind, "a": "buy", "b": "cancel", "lines": 1}
    got, _ = run(spark, corpus, relations=[asked, {"kind": "near", "a": "other", "b": "buy", "lines": 0}], patterns=[buy(PLACE), cancel()])
    cancelled = {(f, n) for f, n, k, _, _ in events() if k == "cancel"}
    assert got == [r for r in BOUGHT if any((r["file"], r["line"] + d) in cancelled for d in (-1, 0, 1)) == (kind == "near")]
    twice, _ = run(spark, corpus, relations=[{"kind": kind, "a": "0", "b": "0", "lines": 1}], patterns=[buy(PLACE)])
    at = {(r["file"], r["line"]) for r in BOUGHT}
    assert twice == [r for r in BOUGHT if any((r["file"], r["line"] + d) in at for d in (-1, 1)) == (kind == "near")]


HOUSE = "fn kitchen() {\n  pot();\n  fn_call(pot);\n}\nlet pot = 1;\nfn hall() { pot(); }\n"


def test_enclosing_scopes_blocks_and_submatches(spark):
    house = Corpus.from_text(spark, {"house.rs": HOUSE})
    tell = emit(at="$LINE", room="$ENCLOSING_NAME", to="$ENCLOSING_LINE_END")
    got, _ = run(spark, house, scope="auto", patterns=[{"id": "pot", "regexp": r"\bpot\(", "on_match": [tell]}, {"id": "let", "regexp": "let", "on_match": [tell]}])
    assert got == [{"at": 2, "room": "kitchen", "to": 4}, {"at": 5, "room": "", "to": ""}, {"at": 6, "room": "hall", "to": 6}]
    record, _ = run(spark, house, scope="rust", patterns=[{"id": "p", "regexp": r"fn_call"}])
    assert record[0]["enclosing"] == {"name": "kitchen", "kind": "fn", "line_start": 1, "line_end": 4}
    inside = {"action": "submatch", "text": "$BLOCK", "patterns": [{"id": "w", "regexp": "pot", "on_match": [{"action": "print", "value": "$MATCH:$LINE"}]}, {"id": "no", "regexp": "cup", "absent": True, "on_match": [{"action": "print", "value": "no cup"}]}]}
    block = {"action": "block", "on_block": [{"action": "print", "value": "lines $BLOCK_LINE_COUNT"}, inside]}
    got, _ = run(spark, house, patterns=[{"id": "fn", "regexp": r"fn \w+", "on_match": [block]}])
    assert got == ["lines 4", "pot:2", "pot:3", "no cup", "lines 1", "pot:6", "no cup"]
    with pytest.raises(QueryError):
        run(spark, house, scope="cobol", patterns=[{"regexp": "x"}])


def test_list_algebra_and_whole_numbers(spark, corpus):
    left, right = ["oil", "tea", "ink"], {"tea": 1, "wax": 2}
    algebra = [{"action": f"set_{op}", "target": op, "a": "left", "b": "right"} for op in ("union", "intersection", "difference")]
    numbers = [{"action": "set", "var": "n", "value": -17}, {"action": "multiply", "var": "n", "value": 3}, {"action": "divide", "var": "n", "value": 4}, {"action": "divide", "var": "n", "value": 0}, {"action": "subtract", "var": "n", "value": 2}, {"action": "decrement", "var": "n"}]
    order = {"action": "sort", "var": "sizes", "key": "p", "value": "desc"}
    v = {"left": {"type": "list", "default": left}, "right": {"type": "map", "default": right}, "n": {"type": "int"}, "sizes": {"type": "list"}} | {op: {"type": "list"} for op in ("union", "intersection", "difference")}
    got, _ = run(spark, corpus, variables=v, patterns=[buy({"action": "append", "target": "sizes", "value": {"p": "$EXTRACT_PIECES"}})], on_complete=[*algebra, *numbers, order, emit(u="$union", i="$intersection", d="$difference", n="$n", s="$sizes")])
    sizes = sorted((str(e[4]) for e in events() if e[2] == "buy"), reverse=True)
    assert got[-1] == {"u": ["oil", "tea", "ink", "wax"], "i": ["tea"], "d": ["oil", "ink"], "n": -int(51 / 4) - 3, "s": [{"p": x} for x in sizes]}


def test_ranked_files_and_hooks(spark, corpus):
    """Ranking hides what matches emit, in every phase; what hooks emit stays."""
    got, _ = run(spark, corpus, patterns=[buy(PLACE), cancel(PLACE)], rank=True, on_file_end=[{"action": "print", "value": "end $FILE"}], on_complete=[{"action": "print", "value": "done"}])
    hooks, ranked = [x for x in got if isinstance(x, str)], [x for x in got if not isinstance(x, str)]
    assert hooks == [*(f"end {f}" for f in books()), "done"] and got[-len(ranked) :] == ranked
    assert {r["file"] for r in ranked} == {e[0] for e in events()} and [r["score"] for r in ranked] == sorted((r["score"] for r in ranked), reverse=True)


def test_summary_diagnostics_and_completeness(spark, corpus, tmp_path):
    got, _ = run(spark, corpus, patterns=[buy(PLACE)], summary=True)
    told = got[-1]
    assert (told["type"], told["files_scanned"], told["bytes_scanned"], told["emitted"], told["complete"]) == ("summary", len(books()), sum(map(len, books().values())), len(BOUGHT), True)
    (tmp_path / "a.txt").write_text("buy tea x1")
    (tmp_path / "b.txt").write_bytes(b"\0buy")
    files = Corpus.from_files(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt"), str(tmp_path / "gone.txt")])
    got, _ = run(spark, files, patterns=[buy(PLACE)], summary=True, diagnostics=True)
    assert {(x["code"], x["file"].rpartition("/")[2]) for x in got if x.get("type") == "warning"} == {("binary_skip", "b.txt"), ("missing_path", "gone.txt")}
    assert (got[-1]["files_skipped_binary"], got[-1]["missing_paths"], got[-1]["complete"]) == (1, 1, False)
    with pytest.raises(QueryError, match="incomplete"):
        run(spark, files, patterns=[buy(PLACE)], require_complete=True)


@pytest.mark.parametrize("bad", [{"patterns": [{"regexp": "a", "on_match": [{"action": "leap"}]}]}, {"patterns": [{"regexp": "a"}], "phases": []}, {"patterns": [{"regexp": "a"}], "pcre": True}, {"patterns": [{"regexp": "a"}], "variables": {"x": {"type": "money"}}}, {"patterns": [{"regexp": "a"}], "relations": [{"kind": "beside"}]}])
def test_bad_scripts(spark, corpus, bad):
    with pytest.raises(QueryError):
        run_script(spark, bad, corpus)


def paged(files, skip, limit, per_file, most):
    """Rows of files of (kind, text), one after the other, as a page of a script has them."""
    out, matched, emitted, size, done = [], 0, 0, 0, False
    for rows in files:
        own = 0
        for kind, text in rows:
            if done or per_file and own >= per_file:
                break
            if kind == "print":
                out.append(text)
                emitted += 1
                continue
            matched += 1
            if matched <= skip:
                continue
            if limit and emitted >= limit:
                done = True
                break
            out.append({"m": text})
            emitted, own, size = emitted + 1, own + 1, size + len(json.dumps({"m": text}, separators=(",", ":"))) + 1
            done = bool(most and size >= most or limit and emitted >= limit)
    return out


@pytest.mark.parametrize("seed", range(8))
def test_pages_of_every_kind(spark, seed):
    rng = random.Random(seed)
    files = [[(rng.choice(["emit", "emit", "print"] if seed % 2 else ["emit"]), f"{'xyzuvw'[f]}{i}") for i in range(rng.randint(0, 7))] for f in range(6)]
    corpus = Corpus.from_text(spark, {f"f{k}": " ".join(f"{kind}:{t}" for kind, t in rows) or "-" for k, rows in enumerate(files)})
    patterns = [{"id": "e", "regexp": r"emit:(\w+)", "extract": ["m"], "on_match": [{"action": "emit", "data": {"m": "$EXTRACT_M"}}]}, {"id": "p", "regexp": r"print:(\w+)", "extract": ["m"], "on_match": [{"action": "print", "value": "$EXTRACT_M"}]}]
    for _ in range(3):
        asked = {"skip": rng.choice((0, 3, 9)), "limit": rng.choice((0, 2, 7)), "limit_per_file": rng.choice((0, 1, 2, 4)), "max_output_bytes": rng.choice((0, 1, 30, 60))}
        got, _ = run(spark, corpus, patterns=patterns, **{k: v for k, v in asked.items() if v})
        assert got == paged(files, *asked.values()), asked


def test_skip_with_a_limit_for_each_file(spark):
    corpus = Corpus.from_text(spark, {"x": "x0 x1 x2 x3 x4 x5", "y": "y0 y1 y2 y3 y4 y5"})
    doc = {"variables": {"n": {"type": "int"}}, "skip": 3, "limit_per_file": 2, "on_complete": [{"action": "emit", "data": {"n": "$n"}}]}
    patterns = [{"id": "p", "regexp": r"\w\d", "on_match": [{"action": "increment", "var": "n"}, {"action": "emit", "data": {"m": "$MATCH"}}]}]
    assert run(spark, corpus, patterns=patterns, **doc)[0] == [{"m": m} for m in ("x3", "x4", "y0", "y1")] + [{"n": 7}]


def test_records_within_byte_budgets(spark):
    corpus = Corpus.from_text(spark, {"a": "first\nkey=abcdefé { inner text } end\nlast"})
    patterns = [{"id": "k", "regexp": r"key=(\w+é)", "extract": ["v"], "on_match": [{"action": "emit"}, {"action": "block", "on_block": [{"action": "emit"}]}]}]
    (one, two), _ = run(spark, corpus, patterns=patterns, context=1, max_match_bytes=11, max_context_bytes=8, max_block_bytes=5)
    assert one == {"file": "a", "pat": "k", "line": 2, "col": 1, "from": 6, "to": 18, "match": "key=abcdef", "match_truncated": True, "context": "first\nke", "context_truncated": True, "context_before": "first", "context_after": "last", "truncated": True, "extracted": {"v": "abcdefé"}}
    assert list(two) == sorted(two) and {k: two[k] for k in two if k.startswith("block")} == {"block": " inne", "block_end": 33, "block_full": "key=a", "block_full_truncated": True, "block_line_end": 2, "block_line_start": 2, "block_start": 19, "block_truncated": True}


def loop(var, *do, **more):
    return {"action": "for_each", "var": var, "key_as": "k", "as": "v", "do": list(do), **more}


@pytest.mark.parametrize("op", ["map_set", "map_increment", "map_append", "map_unique_append"])
def test_maps_that_stay_in_spark(spark, op):
    """Two phases add to a map with a default, a third looks it up, hooks loop over it; equal to plain Python, and no map is collected."""
    rng = random.Random(len(op))
    files = {f"f{i}": " ".join(f"{rng.choice('ab')}{rng.randint(0, 5)}={rng.randint(0, 2)}" for _ in range(rng.randint(0, 9))) or "-" for i in range(7)}
    change = {"action": op, "target": "m", "key": "$EXTRACT_K"} | ({} if op == "map_increment" else {"value": "$EXTRACT_V"})
    pattern = lambda rx, *actions: {"id": "p", "regexp": rx, "extract": ["k", "v"], "on_match": list(actions)}
    inner = {"action": "lookup", "map": "m", "key": "b$EXTRACT_V", "on_hit": [emit(second="$LOOKUP_KEY", v="$LOOKUP_VALUE")], "on_miss": [emit(none="$LOOKUP_KEY")]}
    look = {"action": "lookup", "map": "m", "key": "$EXTRACT_K", "on_hit": [emit(k="$LOOKUP_KEY", v="$LOOKUP_VALUE", f="$FILE"), inner], "on_miss": [emit(miss="$LOOKUP_KEY")]}
    default = {"a0": 1 if op == "map_increment" else ["x"] if op.endswith("append") else "x", "z": 4}
    phases = [{"patterns": [pattern(r"(a\d)=(\d)", change)], "on_complete": [emit(head=1), loop("m", emit(k="$k", v="$v")), emit(foot=1)]}, {"patterns": [pattern(r"(b[0-3])=(\d)", change)]}, {"patterns": [pattern(r"(\w\d)=(\d)", look)]}]
    big = {"action": "if", "condition": {"op": "ne", "args": ["$k", "z"]}, "then": [{"action": "print", "value": "$k:$v"}]}
    got, out = run(spark, Corpus.from_text(spark, files), variables={"m": {"type": "map", "default": default}}, phases=phases, on_complete=[loop("$m", big)])

    held, want = json.loads(json.dumps(default)), []

    def change_by(rx):
        for t in files.values():
            for k, v in re.findall(rx, t):
                if op == "map_set":
                    held[k] = v
                elif op == "map_increment":
                    held[k] = held.get(k, 0) + 1
                elif op == "map_append" or v not in held.get(k, []):
                    held.setdefault(k, []).append(v)

    change_by(r"(a\d)=(\d)")
    want += [{"head": 1}, *({"k": k, "v": v} for k, v in sorted(json.loads(json.dumps(held)).items())), {"foot": 1}]
    change_by(r"(b[0-3])=(\d)")
    for f, t in files.items():
        for k, v in re.findall(r"(\w\d)=(\d)", t):
            if k not in held:
                want.append({"miss": k})
                continue
            want += [{"k": k, "v": held[k], "f": f}, {"second": f"b{v}", "v": held[f"b{v}"]} if f"b{v}" in held else {"none": f"b{v}"}]
    text = lambda v: json.dumps(v, separators=(",", ":")) if isinstance(v, list) else str(v)
    want += [f"{k}:{text(v)}" for k, v in sorted(held.items()) if k != "z"]
    assert got == want
    assert set(out.variables.tables) == {"m"} and "m" not in dict(out.variables)
    assert out.variables["m"] == held


def test_maps_that_the_driver_holds(spark):
    """Maps that are read as a whole, by keys that hang on variables, or changed in one task stay variables."""
    corpus = Corpus.from_text(spark, {"a": "x1 x2 y1", "b": "x2"})
    add = {"action": "map_increment", "target": "m", "key": "$MATCH"}
    one = {"patterns": [{"id": "p", "regexp": r"x\d", "on_match": [add]}]}
    two = lambda key: {"patterns": [{"id": "p", "regexp": r"\w\d", "on_match": [{"action": "set", "var": "s", "value": "$MATCH"}, {"action": "lookup", "map": "m", "key": key, "on_hit": [emit(k="$LOOKUP_KEY", v="$LOOKUP_VALUE")]}]}], "on_file_end": [{"action": "reset", "vars": ["s"]}]}
    v = {"m": {"type": "map"}, "s": {"type": "string"}}
    want = [{"k": k, "v": n} for k, n in (("x1", 1), ("x2", 2), ("x2", 2))]
    for key, tables in (("$MATCH", {"m"}), ("$s", set())):
        got, out = run(spark, corpus, variables=v, phases=[one, two(key)])
        assert got == want and set(out.variables.tables) == tables
    got, out = run(spark, corpus, variables=v, phases=[one], on_complete=[emit(m="$m")])
    assert got == [{"m": {"x1": 1, "x2": 2}}] and not out.variables.tables
    got, out = run(spark, corpus, variables=v, phases=[one], on_complete=[loop("m", add)])
    assert not out.variables.tables


def test_a_map_of_many_keys(spark):
    """200,000 keys are counted, looked up and listed without a row on the driver."""
    corpus = Corpus.from_text(spark, {f"f{i}": " ".join(f"k{j}" for j in range(i * 20_000, (i + 1) * 20_000 + 100)) for i in range(10)})
    p = lambda *a: [{"id": "p", "regexp": r"k\d+", "on_match": list(a)}]
    look = {"action": "lookup", "map": "m", "key": "$MATCH", "on_hit": [{"action": "if", "condition": {"op": "gt", "args": ["$LOOKUP_VALUE", 1]}, "then": [emit(k="$LOOKUP_KEY")]}]}
    out = run_script(spark, {"variables": {"m": {"type": "map"}}, "phases": [{"patterns": p({"action": "map_increment", "target": "m", "key": "$MATCH"})}, {"patterns": p(look)}], "on_complete": [loop("m", emit(key="$k", n="$v"))]}, corpus)
    by = {r.phase_rows: r.n for r in out.rows.selectExpr("walk_ord >= 4611686018427387904 as phase_rows").groupBy("phase_rows").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert by == {True: 200_100, False: 2 * 9 * 100}


def test_summary_comes_from_the_scans_themselves(spark):
    """Counters of two phases; the texts are read once for each."""
    read = spark.sparkContext.accumulator(0)
    texts = {"a": "x x y", "b": "y", "c": "x"}

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    base = Corpus.from_text(spark, texts)
    corpus = Corpus(base.df.mapInArrow(count, base.df.schema))
    p = lambda rx, *a: {"patterns": [{"id": "p", "regexp": rx, "on_match": list(a)}]}
    got, _ = run(spark, corpus, variables={"m": {"type": "map"}}, phases=[p("x", {"action": "map_increment", "target": "m", "key": "$FILE"}), p("[xy]", PLACE_X)], summary=True)
    told = got[-1]
    assert {k: told[k] for k in ("files_scanned", "bytes_scanned", "matches", "scan_stages", "patterns_compiled", "emitted", "rows_output", "complete")} == {"files_scanned": 6, "bytes_scanned": 14, "matches": 8, "scan_stages": 2, "patterns_compiled": 2, "emitted": 5, "rows_output": 5, "complete": True}
    assert len(told) == 18 and read.value == 6
    got, _ = run(spark, base, **p("[xy]", PLACE_X), limit=3, summary=True)
    assert len(got) == 4 and (got[-1]["emitted"], got[-1]["complete"], got[-1]["stop_reason"]) == (3, False, "limit")
    got, _ = run(spark, base, **p("[xy]", PLACE_X), max_output_bytes=20, summary=True)
    assert (got[-1]["complete"], got[-1]["stop_reason"]) == (False, "output_budget")


PLACE_X = emit(file="$FILE", m="$MATCH")


SEQUENTIAL = [
    # a running number, a flag that earlier files set, the last value seen, a sum under a local condition
    ({"n": {"type": "int", "default": 5}}, [{"action": "increment", "var": "n"}, {"action": "print", "value": "$n $MATCH"}], {}),
    ({"seen": {"type": "bool"}, "last": {"type": "string", "default": "none"}}, [{"action": "if", "condition": {"op": "isset", "args": ["seen"]}, "then": [{"action": "print", "value": "$MATCH after $last"}]}, {"action": "if", "condition": {"op": "eq", "args": ["$EXTRACT_D", "7"]}, "then": [{"action": "set", "var": "seen", "value": True}, {"action": "set", "var": "last", "value": "$FILE:$MATCH"}]}], {}),
    ({"sum": {"type": "int"}, "big": {"type": "list"}, "m": {"type": "map"}}, [{"action": "add", "var": "sum", "value": "$EXTRACT_D"}, {"action": "if", "condition": {"op": "gt", "args": ["$sum", 60]}, "then": [{"action": "append", "target": "big", "value": "$MATCH at $sum"}, {"action": "map_set", "target": "m", "key": "$EXTRACT_D", "value": "$sum"}]}, {"action": "if", "condition": {"op": "eq", "args": ["$EXTRACT_D", "9"]}, "then": [{"action": "stop"}]}], {"on_complete": [{"action": "print", "value": "$sum $big $m"}]}),
    ({"n": {"type": "int"}}, [{"action": "subtract", "var": "n", "value": 2}, {"action": "emit", "data": {"n": "$n", "m": "$MATCH"}}], {"limit_per_file": 2, "on_file_end": [{"action": "print", "value": "$FILE $n"}]}),
]


@pytest.mark.parametrize("case", range(len(SEQUENTIAL)))
def test_files_that_read_earlier_ones_run_apart(spark, case, monkeypatch):
    """A prefix scan gives each file the state of all before it; equal to one task that runs them in order."""
    variables, actions, more = SEQUENTIAL[case]
    rng = random.Random(case)
    corpus = Corpus.from_text(spark, {f"f{i:02}": " ".join(f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 5))) for i in range(25)})
    patterns = [{"id": "p", "regexp": r"x(\d)", "extract": ["d"], "on_match": actions}]
    got, out = run(spark, corpus, variables=variables, patterns=patterns, **more)
    assert not any("one task" in w for w in out.warnings) and len(got) > (0 if case == 2 else 5)
    from textloom.plans.script import Script

    monkeypatch.setattr(Script, "carried", lambda *_: None)
    want, one = run(spark, corpus, variables=variables, patterns=patterns, **more)
    assert "one task" in one.warnings[0] and got == want and {k: out.variables[k] for k in variables} == {k: one.variables[k] for k in variables}


@pytest.mark.parametrize("actions", [
    [{"action": "if", "condition": {"op": "lt", "args": ["$n", 3]}, "then": [{"action": "increment", "var": "n"}]}],
    [{"action": "set", "var": "n", "value": "$n$MATCH"}, {"action": "print", "value": "$n"}],
    [{"action": "increment", "var": "n"}, {"action": "if", "condition": {"op": "gt", "args": ["$n", 3]}, "then": [{"action": "stop"}]}],
    [{"action": "multiply", "var": "n", "value": 2}, {"action": "print", "value": "$n"}],
    [{"action": "increment", "var": "n"}, {"action": "set", "var": "n", "value": 1}, {"action": "print", "value": "$n"}],
])
def test_files_that_hang_on_earlier_ones_run_in_order(spark, actions):
    corpus = Corpus.from_text(spark, {"a": "x x", "b": "x"})
    _, out = run(spark, corpus, variables={"n": {"type": "int", "default": 1}}, patterns=[{"id": "p", "regexp": "x", "on_match": actions}])
    assert "one task" in out.warnings[0]


def test_scripts_take_a_batch_in_pieces():
    """Of a batch of ten thousand files only some stand as Python objects at once, and rows leave as a piece ends."""
    import pyarrow as pa

    from textloom.plans.script import Script, _files

    script = Script({"patterns": [{"id": "a", "regexp": "a", "on_match": [{"action": "print", "value": "$FILE"}]}]})
    script.tabled = set()
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(1000)]), pa.array([b"a"] * 1000), pa.array(range(1000), pa.int64())], names=["file", "content", "walk_ord"])
    out = [b.num_rows for b in _files(script, script.phases[0], [], {}, set(), True, {}, None)(iter([batch]))]
    assert sum(out) == 1003 and max(out) <= 256
