"""Scripts: patterns with actions, hooks, phases and variables.

A phase runs in parallel, file by file, whenever its actions read only what does not change across files (tokens, loop variables, variables that on_file_end
resets, results of earlier phases). What it accumulates then leaves the tasks as events - increments, appends, map entries - which Spark aggregates by
variable and key in scan order. A phase that reads what other files changed runs in scan order in one group, exactly but not in parallel, and says so in `warnings`.
Output rows carry their order; `limit`, `skip` and `group_by` are DataFrame operations on them.
"""

from __future__ import annotations

import json
import os
import re
import time
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.errors import QueryError
from textloom.functions import lexers
from textloom.functions.patterns import Pattern, numbered
from textloom.operators import order, rank
from textloom.operators.scan import Member, Options, Text, hits, match_members, shown, truncated
from textloom.operators.scan import parts as scan_parts
from textloom.plans import maps
from textloom.plans.query import document
from textloom.sources.corpus import Corpus
from textloom.sources.shared import kept

ENCLOSING = ("NAME", "KIND", "LINE_START", "LINE_END")
DEFAULTS = {"string": "", "int": 0, "bool": False, "list": [], "map": {}}
TOP = {"scan", "exclude", "patterns", "phases", "variables", "context", "context_before", "context_after", "limit", "limit_per_file", "skip", "group_by", "rank", "rank_surprise", "rank_rich_clusters", "on_file_end", "on_complete", "summary", "diagnostics", "require_complete", "scope", "relations", "max_output_bytes", "max_match_bytes", "max_context_bytes", "max_block_bytes"}
REJECTED = ("boundary", "on_boundary", "ascii_only", "overlap", "files", "pcre")
ACTIONS = set("emit print set increment decrement add subtract multiply divide reset append collect unique_append sort map_set map_increment map_append map_unique_append count set_union set_intersection set_difference if for_each stop submatch block lookup".split())
ACCUMULATE = {"increment", "decrement", "add", "subtract", "append", "collect", "unique_append", "map_set", "map_increment", "map_append", "map_unique_append", "count", "set"}
TOKEN = re.compile(r"\$(EXTRACT_[A-Za-z_]\w*|[A-Za-z_]\w*)")


def text_of(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) if isinstance(v, (list, dict)) else str(v)


def int_of(v: Any) -> int:
    if isinstance(v, (bool, int)):
        return int(v)
    if isinstance(v, (list, dict)):
        return len(v)
    m = re.match(r"\s*[-+]?\d+", text_of(v))
    return int(m.group()) if m else 0


def same(a: Any, b: Any) -> bool:
    if a is None or b is None:
        return a is None and b is None
    if type(a) is type(b):
        return a == b
    return text_of(a) == text_of(b)


def _number(v: Any) -> float | None:
    try:
        return float(v) if not isinstance(v, (list, dict)) and v is not None else None
    except ValueError:
        return None


def _elements(v: Any) -> list[str]:
    if isinstance(v, dict):
        return sorted(v)
    return list(dict.fromkeys(map(text_of, v))) if isinstance(v, list) else [v] if isinstance(v, str) and v else []


@dataclass
class Phase:
    patterns: list[Pattern]
    absent: list[bool]
    actions: list[list[dict]]
    on_file_end: list[dict]
    on_complete: list[dict]
    quiet: bool = False  # rows of matches are not wanted
    relations: list[tuple[bool, int, int, int]] = field(default_factory=list)


class Stop(Exception):
    """Ends the current file."""


@dataclass
class Machine:
    """Runs actions. `store` holds variables; with `events`, changes of shared variables are noted instead of made."""

    store: dict[str, Any]
    types: dict[str, tuple[str, Any]]
    shared: set[str] = field(default_factory=set)
    rows: list[tuple[str, str]] = field(default_factory=list)  # kind, line
    events: list[tuple[str, str, str, str, int]] | None = None
    ctx: dict[str, Any] = field(default_factory=dict)
    text: Text | None = None
    file: str = ""
    match: tuple[int, int] | None = None
    before: int = 0
    after: int = 0
    most: int | None = None  # rows of a file
    skip: int = 0  # rows of the file that are left out first
    emitted: int = 0
    matches: int = 0  # of all files so far
    budgets: dict[str, int] = field(default_factory=dict)  # bytes of match, context and block
    quiet: bool = False  # rows are not wanted, as the script ranks files
    scope: tuple | None = None  # language and custom anchor, as in lexers.scopes
    regions: lexers.Nest = field(default_factory=lambda: lexers.Nest(()))

    def default(self, name: str) -> Any:
        kind, value = self.types.get(name, ("string", None))
        return json.loads(json.dumps(value if value is not None else DEFAULTS[kind]))

    def value(self, name: str) -> Any:
        return self.ctx[name] if name in self.ctx else self.store[name] if name in self.store else None

    def sub(self, v: Any) -> Any:
        if isinstance(v, str):
            if (m := TOKEN.fullmatch(v)) and self.known(m[1]):
                return self.value(m[1])
            return TOKEN.sub(lambda m: text_of(self.value(m[1])) if self.known(m[1]) else m[0], v)
        if isinstance(v, list):
            return [self.sub(x) for x in v]
        return {k: self.sub(x) for k, x in v.items()} if isinstance(v, dict) else v

    def known(self, name: str) -> bool:
        return name in self.ctx or name in self.store or name in ("WORD", "SENTENCE") or name.startswith("EXTRACT_")

    def record(self) -> dict:
        names = ("FILE", "LINE", "COL", "FROM", "TO", "MATCH", "CONTEXT", "BLOCK", "BLOCK_FULL", "BLOCK_START", "BLOCK_END", "BLOCK_LINE_START", "BLOCK_LINE_END")
        out = {t.lower(): self.ctx[t] for t in names if t in self.ctx} | {t.lower(): self.ctx[t] for t in ("CONTEXT_BEFORE", "CONTEXT_AFTER") if self.ctx.get(t)}
        if "PAT_ID" in self.ctx:
            out["pat"] = self.ctx["PAT_ID"]
        cut = [f"{t.lower()}_truncated" for t in ("MATCH", "CONTEXT", "BLOCK", "BLOCK_FULL") if self.ctx.get(f"{t}_TRUNCATED")]
        out |= dict.fromkeys([*cut, "truncated"] if cut else (), True)
        if found := self.ctx.get("EXTRACTED"):
            out["extracted"] = found
        if self.ctx.get("ENCLOSING_NAME"):
            out["enclosing"] = {k.lower(): self.ctx[f"ENCLOSING_{k}"] for k in ENCLOSING}
        return dict(sorted(out.items()))

    def cut(self, kind: str, **texts: str) -> dict[str, Any]:
        """The texts within the kind's budget, and which of them did not fit."""
        most = self.budgets.get(kind)
        return {k: truncated(v, most) for k, v in texts.items()} | {f"{k}_TRUNCATED": True for k, v in texts.items() if most is not None and truncated(v, most) != v}

    def condition(self, c: dict) -> bool:
        op, args = c.get("op"), c.get("args", [])
        if op == "and":
            return all(self.condition(a) for a in args)
        if op == "or":
            return any(self.condition(a) for a in args)
        if op == "not":
            return not self.condition(args[0])
        if op == "isset":
            return bool(self.value(args[0].lstrip("$")))
        a, b = self.sub(args[0]), self.sub(args[1])
        if op in ("eq", "ne"):
            return same(a, b) == (op == "eq")
        if op == "contains":
            return any(same(x, b) for x in a) if isinstance(a, list) else text_of(b) in text_of(a)
        x, y = _number(a), _number(b)
        x, y = (x, y) if x is not None and y is not None else (text_of(a), text_of(b))
        return {"gt": x > y, "lt": x < y, "gte": x >= y, "lte": x <= y}[op]

    def emit(self, kind: str, line: str) -> None:
        """A row of text is printed whatever the page; of the others, those to skip count for nothing, and the one that fills the file's limit ends the file."""
        if self.quiet:
            return
        if kind == "text":
            self.rows.append((kind, line))
        elif self.skip:
            self.skip -= 1
        else:
            self.rows.append((kind, line))
            self.emitted += 1
            if self.most is not None and self.emitted >= self.most:
                raise Stop

    def note(self, op: str, var: str, key: str = "", value: Any = None, n: int = 0) -> None:
        self.events.append((op, var, key, json.dumps(value, ensure_ascii=False), n))

    def run(self, actions: list[dict]) -> None:
        for a in actions:
            getattr(self, f"do_{a['action']}")(a)

    def target(self, a: dict) -> tuple[str, bool]:
        name = a.get("target", a.get("var"))
        if name not in self.store:
            self.store[name] = self.default(name)
        return name, self.events is not None and name in self.shared

    def do_emit(self, a):
        self.emit("json", json.dumps(self.sub(a["data"]) if "data" in a else self.record(), ensure_ascii=False, separators=(",", ":")))

    def do_print(self, a):
        self.emit("text", text_of(self.sub(a["value"])) if "value" in a else json.dumps(self.record(), ensure_ascii=False, separators=(",", ":")))

    def do_set(self, a):
        name, far = self.target(a)
        kind = self.types.get(name, (None, None))[0]
        v = self.sub(a.get("value"))
        v = {"string": text_of, "int": int_of, "bool": bool}.get(kind, lambda x: x)(v)
        if far:
            self.note("set", name, "", v)
        else:
            self.store[name] = v

    def _add(self, a, n: int):
        name, far = self.target(a)
        if far:
            self.note("inc", name, "", None, n)
        else:
            self.store[name] = int_of(self.store[name]) + n

    def do_increment(self, a):
        self._add(a, 1)

    def do_decrement(self, a):
        self._add(a, -1)

    def do_add(self, a):
        self._add(a, int_of(self.sub(a.get("value"))))

    def do_subtract(self, a):
        self._add(a, -int_of(self.sub(a.get("value"))))

    def do_multiply(self, a):
        name, _ = self.target(a)
        self.store[name] = int_of(self.store[name]) * int_of(self.sub(a.get("value")))

    def do_divide(self, a):
        name, _ = self.target(a)
        by = int_of(self.sub(a.get("value")))
        if by:
            x = int_of(self.store[name])
            self.store[name] = abs(x) // abs(by) * (1 if (x < 0) == (by < 0) else -1)

    def do_reset(self, a):
        for name in a.get("vars", [a.get("var")]):
            self.store[name] = self.default(name)

    def do_append(self, a, unique: bool = False):
        name, far = self.target(a)
        v = self.sub(a["value"]) if "value" in a else self.record()
        if far:
            self.note("unique" if unique else "append", name, "", v)
        elif not unique or not any(same(x, v) for x in self.store[name]):
            self.store[name].append(v)

    def do_unique_append(self, a):
        self.do_append(a, True)

    def do_collect(self, a):
        self.do_append({"target": a.get("target", a.get("var"))})

    def do_sort(self, a):
        name, _ = self.target(a)
        key = a.get("key", "")
        get = lambda x: x.get(key) if isinstance(x, dict) else x
        number = all(isinstance(get(x), (int, float)) for x in self.store[name])
        self.store[name].sort(key=(lambda x: get(x)) if number else (lambda x: text_of(get(x))), reverse=a.get("value") == "desc")

    def do_map_set(self, a):
        name, far = self.target(a)
        key, v = text_of(self.sub(a["key"])), self.sub(a.get("value"))
        if far:
            self.note("map_set", name, key, v)
        else:
            self.store[name][key] = v

    def do_map_increment(self, a):
        name, far = self.target(a)
        key = text_of(self.sub(a.get("key", "$PAT_ID")))
        if far:
            self.note("map_inc", name, key, None, 1)
        else:
            self.store[name][key] = int_of(self.store[name].get(key)) + 1

    do_count = do_map_increment

    def do_map_append(self, a, unique: bool = False):
        name, far = self.target(a)
        key, v = text_of(self.sub(a["key"])), self.sub(a["value"]) if "value" in a else self.record()
        if far:
            self.note("map_unique" if unique else "map_append", name, key, v)
            return
        held = self.store[name].get(key, [])
        held = held if isinstance(held, list) else [held]
        if not unique or not any(same(x, v) for x in held):
            held.append(v)
        self.store[name][key] = held

    def do_map_unique_append(self, a):
        self.do_map_append(a, True)

    def _sets(self, a):
        return self.target(a)[0], _elements(self.value(a["a"])), _elements(self.value(a["b"]))

    def do_set_union(self, a):
        name, x, y = self._sets(a)
        self.store[name] = list(dict.fromkeys([*x, *y]))

    def do_set_intersection(self, a):
        name, x, y = self._sets(a)
        self.store[name] = [v for v in x if v in set(y)]

    def do_set_difference(self, a):
        name, x, y = self._sets(a)
        self.store[name] = [v for v in x if v not in set(y)]

    def do_if(self, a):
        self.run(a.get("then", []) if self.condition(a["condition"]) else a.get("else", []))

    def do_for_each(self, a):
        v = self.value(a["var"].lstrip("$"))
        pairs = sorted(v.items()) if isinstance(v, dict) else [(i, x) for i, x in enumerate(list(v or []))]
        for k, x in pairs:
            if "key_as" in a:
                self.store[a["key_as"]] = k
            self.store[a.get("as", "item")] = x
            self.run(a.get("do", []))

    def do_stop(self, a):
        raise Stop

    def do_lookup(self, a):
        key = text_of(self.sub(a["key"]))
        held = self.value(a["map"])
        hit = isinstance(held, dict) and key in held
        self.ctx |= {"LOOKUP_KEY": key, "LOOKUP_VALUE": held[key] if hit else None}
        self.run(a.get("on_hit", []) if hit else a.get("on_miss", []))

    def do_block(self, a):
        if self.match is None:
            return
        forms = lexers.forms(self.file)
        found = lexers.block(self.text.text, self.match[0], a.get("open", "{"), a.get("close", "}"), lexers.roles(self.text.text, forms) if forms and a.get("open", "{") == "{" else None)
        if found is None:
            return
        t, saved = self.text, dict(self.ctx)
        first, last = t.line(found[0]), t.line(found[2] - 1)
        full = t.text[self.match[0] : found[2]]
        self.ctx |= self.cut("block", BLOCK=shown(t.text[found[0] + len(a.get("open", "{")) : found[1]]), BLOCK_FULL=shown(full)) | {"BLOCK_START": t.byte(found[0]), "BLOCK_END": t.byte(found[2]), "BLOCK_LINE_START": first, "BLOCK_LINE_END": last, "BLOCK_LINE_COUNT": last - first + 1, "BLOCK_BYTE_COUNT": t.byte(found[2]) - t.byte(self.match[0])}
        self.block_at = {"$BLOCK": found[0] + len(a.get("open", "{")), "$BLOCK_FULL": self.match[0]}
        self.run(a.get("on_block", []))
        self.ctx = saved

    def do_submatch(self, a):
        source = a.get("text", "$MATCH")
        text = text_of(self.sub(source))
        base = self.match[0] if source == "$MATCH" and self.match else getattr(self, "block_at", {}).get(source)
        patterns, absent, actions = _patterns(a["patterns"])
        saved, match = dict(self.ctx), self.match
        found = hits(text, [Member(p, "", i) for i, p in enumerate(patterns)])
        for s, k, e in found:
            if not absent[k]:
                self.at(patterns[k], s + base if base is not None else s, e + base if base is not None else e, text[s:e], base is not None)
                self.run(actions[k])
                self.ctx, self.match = dict(saved), match
        for k, p in enumerate(patterns):
            if absent[k] and not any(x[1] == k for x in found):
                self.ctx["PAT_ID"] = p.id
                self.run(actions[k])
                self.ctx = dict(saved)

    def at(self, p: Pattern, s: int, e: int, match: str, inside: bool = True) -> None:
        t = self.text
        if inside and self.scope is not None:
            r = self.regions.innermost(s)
            told = (r.name, r.kind, t.line(r.start), t.line(r.end - 1)) if r else ("", "", "", "")
            self.ctx |= {f"ENCLOSING_{k}": v for k, v in zip(ENCLOSING, told, strict=True)}
        found = p.captures(match)
        self.ctx |= {"FILE": self.file, "PAT_ID": p.id, "EXTRACTED": found} | self.cut("match", MATCH=shown(match)) | {f"EXTRACT_{k.upper()}": v for k, v in found.items()}
        if not inside:
            self.ctx |= {"FROM": len(t.text[:s].encode()), "TO": len(t.text[:e].encode())}
            return
        line = t.line(s)
        self.match = (s, e)
        self.ctx |= {"LINE": line, "COL": t.byte(s) - t.byte(t.lines[line - 1]) + 1, "FROM": t.byte(s), "TO": t.byte(e)} | self.cut("context", CONTEXT=shown(t.line_text(line - self.before, line + self.after)))
        if self.before:
            self.ctx["CONTEXT_BEFORE"] = truncated(shown(t.line_text(line - self.before, line - 1)), self.budgets.get("context")) if line > 1 else ""
        if self.after:
            self.ctx["CONTEXT_AFTER"] = truncated(shown(t.line_text(line + 1, line + self.after)), self.budgets.get("context")) if line < len(t.lines) else ""

    def one_file(self, file: str, content: bytes, phase: Phase, ends: list[dict]) -> None:
        """Matches in order, then absent patterns, then the file's end. A stop, or the file's limit, skips what is left of the file."""
        self.file, self.text, self.emitted = file, Text(content), 0
        if self.scope is not None:
            self.regions = lexers.Nest(lexers.scopes(self.text.text, file, self.scope[1], self.scope[0]))
        members = [Member(p, "", i) for i, p in enumerate(phase.patterns)]
        try:
            seen = set()
            self.quiet = phase.quiet
            found = self.related(hits(self.text.text, members), phase)
            self.matches += len(found)
            for s, k, e in found:
                seen.add(k)
                if not phase.absent[k]:
                    self.ctx = {}
                    self.at(phase.patterns[k], s, e, self.text.text[s:e])
                    self.run(phase.actions[k])
            self.match = None
            for k, p in enumerate(phase.patterns):
                if phase.absent[k] and k not in seen:
                    self.ctx = {"FILE": file, "PAT_ID": p.id}
                    self.run(phase.actions[k])
            self.quiet = False
            self.ctx = {"FILE": file}
            self.run(ends)
        except Stop:
            pass

    def related(self, found: list[tuple[int, int, int]], phase: Phase) -> list[tuple[int, int, int]]:
        """The matches that every relation of their pattern lets through, each judged on all matches of the file."""
        if not phase.relations or not found:
            return found
        lines = [self.text.line(s) for s, _, _ in found]
        held: dict[int, list[int]] = {}
        for line, (_, k, _) in zip(lines, found, strict=True):
            held.setdefault(k, []).append(line)  # hits come by place, so lines rise

        def passes(k: int, line: int) -> bool:
            for near, a, b, reach in phase.relations:
                if a == k:
                    there = held.get(b, [])
                    met = bisect_right(there, line + reach) - bisect_left(there, line - reach) - (a == b)
                    if (met > 0) != near:
                        return False
            return True

        return [x for x, line in zip(found, lines, strict=True) if passes(x[1], line)]


def _patterns(specs: list[dict]) -> tuple[list[Pattern], list[bool], list[list[dict]]]:
    out = []
    for s in specs:
        if "regexp" not in s:
            raise QueryError("a pattern needs regexp")
        out.append(Pattern(s.get("id", ""), s["regexp"], s.get("case_insensitive", False), s.get("word_boundary", False), s.get("utf8", True), s.get("ucp", False), float(s.get("weight", 1.0)), extract=tuple(s.get("extract", ()))))
    actions = [s.get("on_match", [{"action": "emit"}]) for s in specs]
    for a in actions:
        _check_actions(a)
    return numbered(out), [bool(s.get("absent")) for s in specs], actions


def _inner(a: dict) -> list[list[dict]]:
    return [a[k] for k in ("then", "else", "do", "on_block", "on_hit", "on_miss") if k in a] + [p.get("on_match", []) for p in a.get("patterns", [])]


def _check_actions(actions: list[dict]) -> None:
    for a in actions:
        if a.get("action") not in ACTIONS:
            raise QueryError(f"unknown action {a.get('action')}")
        for inner in _inner(a):
            _check_actions(inner)


def _walk(actions: list[dict]):
    for a in actions:
        yield a
        for inner in _inner(a):
            yield from _walk(inner)


def _guarded(actions: list[dict], under: frozenset[str]):
    """Each action with what the conditions, loops and look-ups around it read."""
    for a in actions:
        yield a, under
        for inner in _inner(a):
            yield from _guarded(inner, under | _reads(a))


def _reads(a: dict) -> set[str]:
    own = {k: v for k, v in a.items() if k not in ("then", "else", "do", "on_block", "on_hit", "on_miss", "patterns", "action")}
    names = set(TOKEN.findall(json.dumps(own)))
    if a["action"] in ("for_each", "lookup", "sort", "set_union", "set_intersection", "set_difference", "multiply", "divide"):
        names |= {str(a[k]).lstrip("$") for k in ("var", "map", "a", "b", "target") if k in a}
    for c in re.findall(r'"op": "isset", "args": \["\$?(\w+)"', json.dumps(own)):
        names.add(c)
    return names


@dataclass
class Output:
    """rows: ord (phase, walk_ord, seq), kind (json or text), line."""

    rows: DataFrame
    variables: dict[str, Any]
    warnings: list[str]


def _relation(spec: dict, patterns: list[Pattern]) -> tuple[bool, int, int, int] | None:
    """near or not, the two patterns' places, lines; none if the phase lacks one of them."""
    if not isinstance(spec, dict) or spec.get("kind") not in ("near", "far") or not all(isinstance(spec.get(k), str) for k in "ab") or not isinstance(spec.get("lines"), (int, float)):
        raise QueryError("a relation needs kind (near or far), a, b and lines")
    ids = [p.id for p in patterns]
    at = [ids.index(x) if x in ids else int(x) if x.isdecimal() and int(x) < len(ids) else None for x in (spec["a"], spec["b"])]
    return None if None in at else (spec["kind"] == "near", *at, max(0, int(spec["lines"])))


def _scope(spec: str | dict | None) -> tuple | None:
    """Language and custom anchor, as in lexers.scopes."""
    if spec is None:
        return None
    if isinstance(spec, dict):
        if not spec.get("pattern"):
            raise QueryError("a custom scope needs a pattern")
        return "auto", (spec["pattern"], spec.get("open", "{"), spec.get("close", "}"), spec.get("kind") or "func")
    if spec != "auto" and {"c++": "cpp", "cc": "cpp"}.get(spec, spec) not in lexers.ANCHORS:
        raise QueryError(f"unknown scope {spec}")
    return spec, None


class Script:
    def __init__(self, doc: dict):
        for k in doc:
            if k in REJECTED or k.startswith("run_pattern_"):
                raise QueryError(f"{k} is not supported")
            if k not in TOP:
                raise QueryError(f"unknown field {k}")
        if ("patterns" in doc) == ("phases" in doc):
            raise QueryError("a script needs exactly one of patterns and phases")
        self.doc = doc
        self.types = {}
        for name, v in doc.get("variables", {}).items():
            if v.get("type") not in DEFAULTS:
                raise QueryError(f"variable {name}: unknown type")
            self.types[name] = (v["type"], v.get("default"))
        self.phases = []
        for p in doc.get("phases", [doc]):
            own = p if "phases" in doc else {}
            patterns, absent, actions = _patterns(p["patterns"])
            self.phases.append(Phase(patterns, absent, actions, own.get("on_file_end", []), own.get("on_complete", [])))
        for hook in ("on_file_end", "on_complete"):
            _check_actions(doc.get(hook, []))
        for p in self.phases:
            _check_actions(p.on_file_end)
            _check_actions(p.on_complete)

        for p in self.phases:
            p.quiet = bool(doc.get("rank"))
            p.relations = [r for x in doc.get("relations", []) if (r := _relation(x, p.patterns))]
        self.scope = _scope(doc.get("scope"))
        self.tabled: set[str] = set()  # maps that are tables
        self.budgets = {k: doc[f"max_{k}_bytes"] for k in ("match", "context", "block") if doc.get(f"max_{k}_bytes")}
        self.prints = any(a["action"] == "print" for p in self.phases for group in (*p.actions, p.on_file_end, p.on_complete, doc.get("on_file_end", []), doc.get("on_complete", [])) for a in _walk(group))

    def local(self, ends: list[dict]) -> set[str]:
        """Variables that a file's end resets, whatever happens."""
        return {n for a in ends if a["action"] == "reset" for n in a.get("vars", [a.get("var")])}

    def shared(self, phase: Phase, ends: list[dict]) -> tuple[set[str], bool]:
        """Variables that files change for one another, and whether the files can still run apart."""
        actions = [a for group in (*phase.actions, ends) for a in _walk(group)]
        loops = {a[k] for a in actions if a["action"] == "for_each" for k in ("as", "key_as") if k in a}
        changed = {a.get("target", a.get("var")) for a in actions if a["action"] in ACTIONS - {"emit", "print", "if", "for_each", "stop", "submatch", "block", "lookup", "reset"}} - {None} - loops
        far = changed - self.local(ends)
        apart = all(not _reads(a) & far for a in actions) and all(a["action"] in ACCUMULATE for a in actions if a.get("target", a.get("var")) in far and a["action"] != "reset")
        kinds: dict[str, set[str]] = {}
        for a in actions:
            if (name := a.get("target", a.get("var"))) in far:
                kinds.setdefault(name, set()).add("inc" if a["action"] in ("increment", "decrement", "add", "subtract") else "set" if a["action"] == "set" else "map" if a["action"].startswith("map") or a["action"] == "count" else "list")
        return far, apart and all(len(k) == 1 for k in kinds.values())

    def carried(self, phase: Phase, ends: list[dict], far: set[str]) -> dict[str, str] | None:
        """How the shared variables that files read come to be (inc: by sums, set: as the last value), if what a file adds to them does not hang on them; None if it may.

        Then a file's state is that of all files before it, which a prefix scan over the files' own sums and last values gives.
        """
        actions = [x for group in (*phase.actions, ends) for x in _guarded(group, frozenset())]
        read = {n for a, _ in actions for n in _reads(a)} & far
        kinds: dict[str, set[str]] = {}
        for a, under in actions:
            act, name = a["action"], a.get("target", a.get("var"))
            decided = under & far
            if act == "stop" and decided or act == "emit" and decided and self.doc.get("limit_per_file") or act == "reset" and far & {*a.get("vars", [a.get("var")])}:
                return None
            if name not in far or act in ("for_each", "lookup", "emit", "print", "if"):
                continue
            kind = "inc" if act in ("increment", "decrement", "add", "subtract") else "set" if act == "set" else "map" if act.startswith("map") or act == "count" else "list" if act in ACCUMULATE else "other"
            kinds.setdefault(name, set()).add(kind)
            if name in read and (kind not in ("inc", "set") or decided or _reads(a) & far):
                return None
        if any(len(k) > 1 or "other" in k for k in kinds.values()) or any(a["action"] in ("for_each", "sort") and a["var"].lstrip("$") in far for a, _ in actions if "var" in a):
            return None
        return {n: next(iter(kinds[n])) for n in read}


SCHEMA = "walk_ord long, seq int, kind string, line string, op string, var string, key string, value string, n long"
KINDS = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64())


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _files(script: Script, phase: Phase, ends: list[dict], store: dict, shared: set[str], apart: bool, skips: dict[int, int], most: int | None):
    """skips: rows to leave out first, by the files' walk_ord; most: rows of a file after these."""
    doc = script.doc
    before, after = doc.get("context_before", doc.get("context", 0)), doc.get("context_after", doc.get("context", 0))
    own = {k: v for k, v in store.items() if k not in script.tabled}

    def run(batches):
        m = Machine(json.loads(json.dumps(own)), script.types, shared, before=before, after=after, most=most, scope=script.scope, budgets=script.budgets)
        keep, read = json.dumps(own), {"files": 0, "bytes": 0}
        for batch in (p for b in batches for p in scan_parts(b)):
            out = []
            more = [batch.column(n).to_pylist() if n in batch.schema.names else [None] * batch.num_rows for n in ("maps", "state")]
            for file, content, at, part, state in zip(*(batch.column(i).to_pylist() for i in range(3)), *more, strict=True):
                m.rows, m.events = [], [] if apart else None
                if apart:
                    m.store = json.loads(keep) | {name: {} for name in script.tabled}
                    for x in part or ():
                        m.store[x["var"]][x["key"]] = json.loads(x["value"])
                    m.store |= json.loads(state or "{}")
                m.skip = skips.get(at, 0)
                m.one_file(file, content, phase, ends)
                read["files"] += 1
                read["bytes"] += len(content)
                out += [(at, i, kind, line, None, None, None, None, None) for i, (kind, line) in enumerate(m.rows)]
                out += [(at, i, None, None, *e) for i, e in enumerate(m.events or ())]
            yield _batch(out)
        yield _batch([(None, None, None, None, "stat", name, "", None, n) for name, n in (read | {"matches": m.matches}).items()])
        if not apart:
            yield _batch([(None, None, None, None, "store", name, "", json.dumps(v, ensure_ascii=False), 0) for name, v in m.store.items()])

    return run


def _deltas(script: Script, phase: Phase, ends: list[dict], store: dict, carry: dict[str, str], most: int | None):
    """file, walk_ord and, of each carried variable in turn, its sum (inc) or last value (set, JSON; null: none) in the file alone."""
    doc = script.doc
    before, after = doc.get("context_before", doc.get("context", 0)), doc.get("context_after", doc.get("context", 0))

    def run(batches):
        keep = json.dumps(store)
        m = Machine({}, script.types, set(carry), before=before, after=after, most=most, scope=script.scope, budgets=script.budgets)
        for batch in (p for b in batches for p in scan_parts(b)):
            out = []
            for file, content, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                m.rows, m.events, m.store = [], [], json.loads(keep)
                m.one_file(file, content, phase, ends)
                own = {n: 0 if kind == "inc" else None for n, kind in carry.items()}
                for op, name, _, value, n in m.events:
                    own[name] = own[name] + n if op == "inc" else value
                out.append((file, at, *own.values()))
            kinds = (pa.string(), pa.int64(), *(pa.int64() if k == "inc" else pa.string() for k in carry.values()))
            columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "walk_ord", *(f"d{i}" for i in range(len(carry)))])

    return run


def _with_states(texts: DataFrame, deltas: DataFrame, carry: dict[str, str], store: dict) -> tuple[DataFrame, dict]:
    """texts with state: the carried variables before each file, as JSON; and the variables after all files."""
    names = list(carry)
    sums, lasts = ({f"b{i}": F.col(f"d{i}") for i, n in enumerate(names) if carry[n] == kind} for kind in ("inc", "set"))
    before = order.prefixes(deltas, ["walk_ord", "file"], sums, lasts)
    # an inc variable's state is a number, a set one's the JSON of its last value
    parts = [F.concat(F.lit(json.dumps(n) + ":"), (F.col(f"b{i}") + int_of(store.get(n))).cast("string") if carry[n] == "inc" else F.coalesce(f"b{i}", F.lit(json.dumps(store.get(n), ensure_ascii=False)))) for i, n in enumerate(names)]
    states = before.select("file", "walk_ord", F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("state"))
    at = F.struct("walk_ord", "file")
    after = deltas.agg(*(F.coalesce(F.sum(f"d{i}"), F.lit(0)) if carry[n] == "inc" else F.max_by(f"d{i}", F.when(F.col(f"d{i}").isNotNull(), at)) for i, n in enumerate(names))).first()
    final = {n: int_of(store.get(n)) + v if carry[n] == "inc" else store.get(n) if v is None else json.loads(v) for n, v in zip(names, after, strict=True)}
    return texts.join(states, ["file", "walk_ord"]).select("file", "content", "walk_ord", "state"), final


def _asked(script: Script, phase: Phase, store: dict):
    """file, walk_ord, var and key of what each file's matches look up in maps that are tables, each once."""
    doc = script.doc
    own = {k: v for k, v in store.items() if k not in script.tabled}

    def run(batches):
        m = Machine(json.loads(json.dumps(own)), script.types, scope=script.scope, budgets=script.budgets, before=doc.get("context_before", doc.get("context", 0)), after=doc.get("context_after", doc.get("context", 0)))
        members = [Member(p, "", i) for i, p in enumerate(phase.patterns)]
        lookups = [[] if absent else maps.asked_for(actions, script.tabled) for actions, absent in zip(phase.actions, phase.absent, strict=True)]
        for batch in (p for b in batches for p in scan_parts(b)):
            out = []
            for file, content, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                m.file, m.text = file, Text(content)
                m.regions = lexers.Nest(lexers.scopes(m.text.text, file, script.scope[1], script.scope[0]) if script.scope is not None else ())
                keys = {}
                for s, k, e in m.related(hits(m.text.text, members), phase):
                    m.ctx = {}
                    if lookups[k]:
                        m.at(phase.patterns[k], s, e, m.text.text[s:e])
                    keys |= {(a["map"], text_of(m.sub(a["key"]))): None for a in lookups[k]}
                for k, (p, absent) in enumerate(zip(phase.patterns, phase.absent, strict=True)):
                    m.ctx = {"FILE": file, "PAT_ID": p.id}
                    keys |= {(a["map"], text_of(m.sub(a["key"]))): None for a in maps.asked_for(phase.actions[k], script.tabled) if absent}
                out += [(file, at, name, key) for name, key in keys]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["file", "walk_ord", "var", "key"])

    return run


def _merged(events: DataFrame, store: dict, script: Script) -> None:
    """Aggregates events by variable and key, in scan order, into the store."""
    order = F.struct("walk_ord", "seq")
    grouped = events.groupBy("op", "var", "key").agg(
        F.sum("n").alias("n"),
        F.max_by("value", order).alias("last"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("op").isin("append", "unique", "map_append", "map_unique"), F.struct("walk_ord", "seq", "value")))), lambda x: x["value"]).alias("listed"),
    )
    for r in sorted(grouped.collect(), key=lambda r: (r.var, r.key)):
        held = store.setdefault(r.var, json.loads(json.dumps(script.types.get(r.var, ("", None))[1] if script.types.get(r.var, ("", None))[1] is not None else DEFAULTS[script.types.get(r.var, ("string", None))[0]])))
        if r.op == "inc":
            store[r.var] = int_of(held) + r.n
        elif r.op == "set":
            store[r.var] = json.loads(r.last)
        elif r.op in ("append", "unique"):
            for v in map(json.loads, r.listed):
                if r.op == "append" or not any(same(x, v) for x in held):
                    held.append(v)
        else:
            held[r.key] = maps.value_of(r.op, held.get(r.key), r.n, r.last, r.listed, int_of, same)


def run_script(spark: SparkSession, doc: dict | str | os.PathLike, corpus: Corpus | None = None) -> Output:
    """Output rows in order, final variables and warnings. Without a corpus the script's own scan is read."""
    doc = document(doc)
    script, began = Script(doc), time.time()
    corpus = corpus or Corpus.from_files(spark, doc.get("scan", ()), doc.get("exclude", ()))
    store: dict[str, Any] = {}
    m = Machine(store, script.types)
    for name in script.types:
        store[name] = m.default(name)
    parts, warnings, stats = [], [], []
    # a page that also limits each file must know how many rows of a file the page skips
    per_file, skip = doc.get("limit_per_file"), doc.get("skip", 0)
    by_file = bool(per_file and skip)
    script.tabled = maps.tabled(script, by_file, _walk, _reads)
    for name in script.tabled:
        store[name] = spark.createDataFrame([(x, json.dumps(v, ensure_ascii=False)) for x, v in store[name].items()], "key string, value string")
    df = corpus.df.select("file", "content", "walk_ord")
    empty = spark.createDataFrame([], "phase int, walk_ord long, seq int, kind string, line string")
    for k, phase in enumerate(script.phases):
        last = k == len(script.phases) - 1
        ends = [*phase.on_file_end, *(doc.get("on_file_end", []) if last else [])]
        shared, apart = script.shared(phase, ends)
        texts_with, final = None, {}
        if not apart and not by_file and (carry := script.carried(phase, ends, shared)):
            warnings.append(f"phase {k} reads what other files change; its texts are read twice, first for what each file adds")
            for name in carry:
                store.setdefault(name, m.default(name))
            deltas = kept(corpus.spread().select("file", "content", "walk_ord").mapInArrow(_deltas(script, phase, ends, store, carry, per_file), "file string, walk_ord long" + "".join(f", d{i} {'long' if kind == 'inc' else 'string'}" for i, kind in enumerate(carry.values()))), "script-deltas")
            texts_with, final = _with_states(df, deltas, carry, store)
            apart, shared = True, shared - set(carry)
        if not apart:
            warnings.append(f"phase {k} reads what other files change; it runs in scan order in one task")

        def files(skips: dict[int, int], most: int | None, apart=apart, phase=phase, ends=ends, shared=shared, texts_with=texts_with) -> DataFrame:
            texts = texts_with if texts_with is not None else corpus.spread().select("file", "content", "walk_ord") if apart else df.orderBy("walk_ord").coalesce(1).sortWithinPartitions("walk_ord")
            if any(maps.asked_for(a, script.tabled) for a in phase.actions):
                texts = maps.with_parts(df, texts.mapInArrow(_asked(script, phase, store), "file string, walk_ord long, var string, key string"), {n: store[n] for n in script.tabled})
            return texts.mapInArrow(_files(script, phase, ends, store, shared, apart, skips, most), SCHEMA)

        skips: dict[int, int] = {}
        if by_file and skip:
            # the first files' rows without any limit, up to the one in which the skipped rows end: `skip` files at most
            counts = files({}, None).filter("kind = 'json'").groupBy("walk_ord").count().orderBy("walk_ord").limit(skip).collect()
            for r in counts:
                if skip <= 0:
                    break
                skips[r.walk_ord] = skip
                skip -= r["count"]
            skip = max(0, skip)
        out = files(skips, per_file)
        if shared or doc.get("summary"):
            out = kept(out, "script-phase")
            stats.append(out.filter("op = 'stat'"))
        if shared:
            if apart:
                events = out.filter("op is not null and op <> 'stat'")
                for name in script.tabled & shared:
                    store[name] = maps.merged(events, name, store[name], int_of, same)
                held = [*script.tabled] or [""]
                _merged(events.filter(~F.col("var").isin(held)), store, script)
            else:
                store |= {r.var: json.loads(r.value) for r in out.filter("op = 'store'").collect()}
        store |= final
        parts.append(out.filter("kind is not null").select(F.lit(k).alias("phase"), "walk_ord", "seq", "kind", "line"))
        m.store, m.rows, m.ctx, m.file = store, [], {}, ""
        m.skip = skip if by_file else 0
        told: list[tuple] = []
        for i, a in enumerate([*phase.on_complete, *(doc.get("on_complete", []) if last else [])]):
            if a["action"] == "for_each" and (name := a["var"].lstrip("$")) in script.tabled:
                plain = {n: v for n, v in store.items() if n not in script.tabled}
                parts.append(maps.looped(store[name], a, lambda plain=plain, types=script.types: Machine(dict(plain), types), k, i))
                continue
            m.rows, ended = [], False
            try:
                m.run([a])
            except Stop:
                ended = True
            told += [(k, maps.AFTER + i * maps.STEP, j, kind, line) for j, (kind, line) in enumerate(m.rows)]
            if ended:
                break
        skip = m.skip if by_file else skip
        if told:
            parts.append(spark.createDataFrame(told, empty.schema))
    if doc.get("rank"):
        members = [Member(p, "", i) for i, p in enumerate(script.phases[-1].patterns)]
        found = match_members(corpus, members, Options(frozenset()))
        counts = corpus.df.select("file", F.size(F.split(F.col("content").cast("string"), "\n")).alias("line_count"))
        ranked = rank.files(found, counts, len(members), {p.id: p.weight for p in script.phases[-1].patterns}, doc.get("rank_surprise", False), doc.get("rank_rich_clusters", False))
        rows = ranked.select(F.lit(len(script.phases)).alias("phase"), F.row_number().over(rank.Window.orderBy(F.desc("score"), F.desc("density"), "file")).cast("long").alias("walk_ord"), F.lit(0).alias("seq"), F.lit("json").alias("kind"), F.to_json(F.struct("file", "score", "density", "matched_patterns")).alias("line"))
        parts.append(rows)
    rows = empty
    for p in parts:
        rows = rows.unionByName(p)
    rows = _paged(rows, doc, 0 if by_file else skip, script.prints)
    if doc.get("summary"):
        rows = kept(rows, "script-rows")
    page = rows
    if doc.get("group_by"):
        rows = grouped(rows, doc["group_by"])
    return Output(_accounted(rows, page, stats, script, corpus, began), maps.Variables(store, {n: store[n] for n in script.tabled if isinstance(store[n], DataFrame)}), warnings)


def _paged(rows: DataFrame, doc: dict, skip: int, prints: bool) -> DataFrame:
    """The rows of the page: printed text is not skipped but counts for the limit, which only a JSON row can reach; the row that fills max_output_bytes is the last."""
    place = ["phase", "walk_ord", "seq"]
    limit, most = doc.get("limit"), doc.get("max_output_bytes")
    if limit and not prints:
        rows = rows.orderBy(*place).offset(skip).limit(limit)
    else:
        if skip:
            rows = order.numbered(rows.filter("kind = 'json'"), place, "n").filter(F.col("n") >= skip).drop("n").unionByName(rows.filter("kind <> 'json'"))
        if limit:
            rows = order.numbered(rows, place, "n", 1)
            last = rows.filter(f"kind = 'json' and n >= {limit}").agg(F.min("n")).first()[0]
            rows = (rows if last is None else rows.filter(F.col("n") < last + (last == limit))).drop("n")
    if most:
        size = F.when(F.col("kind") == "json", F.octet_length("line") + 1).otherwise(0)
        rows = order.running(rows, place, size, "before").filter(F.col("before") < most).drop("before")
    return rows


def _accounted(rows: DataFrame, page: DataFrame, stats: list[DataFrame], script: Script, corpus: Corpus, began: float) -> DataFrame:
    """rows with warning records (diagnostics) and the summary record; require_complete raises where something could not be read. The counters were written by the scans themselves, so no text is read again."""
    spark, doc, last = rows.sparkSession, script.doc, len(script.phases)
    told = [] if corpus.warnings is None else [corpus.warnings.select("code", "file")]
    if corpus.missing:
        told.append(spark.createDataFrame([("missing_path", x) for x in corpus.missing], "code string, file string"))
    warned = told[0] if told else None
    for more in told[1:]:
        warned = warned.unionByName(more)
    if doc.get("require_complete") and warned is not None and not warned.filter("code <> 'binary_skip'").isEmpty():
        raise QueryError("incomplete: a listed path is missing or a file could not be read")
    place = lambda phase: (F.lit(phase).alias("phase"), F.lit(0).cast("long").alias("walk_ord"), F.lit(0).alias("seq"), F.lit("json").alias("kind"))
    out = rows
    if doc.get("diagnostics") and warned is not None:
        out = out.unionByName(warned.select(*place(last + 1), F.to_json(F.struct(F.lit("warning").alias("type"), "code", "file")).alias("line")))
    if doc.get("summary"):
        codes = {} if warned is None else {r.code: r["count"] for r in warned.groupBy("code").count().collect()}
        read: dict[str, int] = {}
        for s in stats:
            for r in s.groupBy("var").agg(F.sum("n").alias("n")).collect():
                read[r["var"]] = read.get(r["var"], 0) + r.n
        json_row = F.col("kind") == "json"
        told = page.agg(F.count(F.lit(1)).alias("emitted"), F.coalesce(F.sum(F.when(json_row, F.octet_length("line") + 1)), F.lit(0)).alias("bytes"), F.coalesce(F.sum(F.when(json_row & F.get_json_object("line", "$.truncated").isNotNull(), 1)), F.lit(0)).alias("cut")).first()
        stop = "limit" if doc.get("limit") and told.emitted >= doc["limit"] else "output_budget" if doc.get("max_output_bytes") and told.bytes >= doc["max_output_bytes"] else None
        failed, missing = codes.get("read_error", 0), codes.get("missing_path", 0)
        matches = read.get("matches", 0)
        record = {"type": "summary", "files_scanned": read.get("files", 0), "bytes_scanned": read.get("bytes", 0), "files_skipped_binary": codes.get("binary_skip", 0), "files_failed": failed, "missing_paths": missing}
        record |= {"matches": matches, "matches_seen": matches, "scan_stages": last, "matcher_compilations": last, "patterns_compiled": sum(len(p.patterns) for p in script.phases), "rows_materialized": matches}
        record |= {"rows_output": told.emitted, "rows_truncated": told.cut, "buffered_bytes_peak": told.bytes if doc.get("group_by") else 0, "emitted": told.emitted, "complete": stop is None and failed + missing == 0}
        record |= ({"stop_reason": stop} if stop else {}) | {"elapsed_ms": int(1000 * (time.time() - began))}
        out = out.unionByName(spark.range(1).select(*place(last + 2), F.lit(json.dumps(record, separators=(",", ":"))).alias("line")))
    return out


def grouped(rows: DataFrame, key: str) -> DataFrame:
    """JSON rows as one row for each value of a field, in order of first sight; text rows stay."""
    value = F.coalesce(F.get_json_object("line", f"$.{key}"), F.lit(""))
    order = F.struct("phase", "walk_ord", "seq")
    lists = rows.filter("kind = 'json'").groupBy(value.alias("key")).agg(F.min(order).alias("o"), F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("phase", "walk_ord", "seq", "line"))), lambda x: x["line"])).alias("all"))
    made = lists.select("o.phase", "o.walk_ord", "o.seq", F.lit("json").alias("kind"), F.concat(F.lit('{"key":'), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(',"group":['), "all", F.lit("]}")).alias("line"))
    return made.unionByName(rows.filter("kind <> 'json'"))
