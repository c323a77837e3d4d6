"""Declarative queries: a JSON document of sets, joins, filters, groups and orders, lowered to DataFrame operators.

Everything is checked before any scan. Sets with equal scan settings share one pass. Location conditions bring the file as an equality, so that
Catalyst plans an equi-join, and where they bound how far rows may be apart, a bin of lines or bytes too, so that a long file's rows do not all meet; equality is null-safe and typed by the fields' static kinds.
Values that become patterns stay in Spark: whole words are joined with the texts' words, only other literals and expressions are collected. Row limits hold only where the document states them.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.errors import LimitExceeded, QueryError
from textloom.functions.patterns import IDENTIFIER, Pattern, escape
from textloom.operators import order as ordered
from textloom.operators import scan
from textloom.sources.corpus import Corpus
from textloom.sources.shared import kept

NULL, BOOL, INT, STR, LIST = "null", "bool", "int", "str", "list"
FIELDS = {"row_id": INT, "set_id": STR, "pattern_id": STR, "pattern_index": INT, "file": STR, "language": STR, "from": INT, "to": INT, "line": INT, "column": INT, "match": STR, "context": STR}
FIELDS |= {f"enclosing.{n}": k for n, k in (("name", STR), ("kind", STR), ("from", INT), ("to", INT), ("line_start", INT), ("line_end", INT))}
FIELDS |= {"derived.value": STR, "derived.source_rows": LIST}
LIMITS = ("max_rows_per_set", "max_total_rows", "max_join_rows", "max_cartesian_rows", "max_adaptive_stages", "max_memory_bytes")
#: Rows expected of a set or a join when the product of a join without any key is guessed; how many rows of it are allowed; adaptive stages.
DEFAULTS = {"max_rows_per_set": 250_000, "max_join_rows": 500_000, "max_cartesian_rows": 1_000_000, "max_adaptive_stages": 4}
LOCATION = ("same_file", "same_scope", "within_lines", "before", "after", "contains_span")
#: Sizes of bins of bytes; the last holds any span of a text.
SPANS = tuple(8**k for k in range(2, 13))
BINARY = ("eq", "ne", "lt", "lte", "gt", "gte", "contains", "in", "starts_with", "ends_with")
AGGREGATES = ("count", "count_distinct", "min", "max", "sum", "collect", "collect_distinct", "first")
SCALARS = ("literal", "coalesce", "concat", "lower", "upper", "basename", "dirname")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass
class Value:
    kind: str
    col: Column
    items: list | None = None  # of a literal list


@dataclass
class SetSpec:
    id: str
    scan: tuple[str, ...]
    exclude: tuple[str, ...]
    scope: str | None
    patterns: list[Pattern]
    derive: dict | None

    @property
    def captures(self) -> set[str]:
        return {n for p in self.patterns for n in p.extract}


@dataclass
class Result:
    df: DataFrame
    plan: dict
    complete: bool = True
    stop_reason: str | None = None

    def footer(self, tabbed: bool = False) -> str | None:
        """What says that rows are missing, as JSON or as text."""
        if self.complete:
            return None
        return f"QUERY INCOMPLETE reason={self.stop_reason}" if tabbed else json.dumps({"type": "query-footer", "complete": False, "stop_reason": self.stop_reason}, separators=(",", ":"))
    warnings: list[str] = field(default_factory=list)


def _only(o: Any, allowed: tuple[str, ...], where: str) -> dict:
    if not isinstance(o, dict):
        raise QueryError(f"{where} must be an object")
    for k in o:
        if k not in allowed:
            raise QueryError(f"{where}: unknown field {k}")
    return o


def _strings(o: Any, where: str) -> tuple[str, ...]:
    if o is None:
        return ()
    if not isinstance(o, list) or any(not isinstance(x, str) for x in o):
        raise QueryError(f"{where} must be an array of strings")
    return tuple(o)


class Query:
    """A checked document. `plan()` tells what would run; `run()` lowers it."""

    def __init__(self, doc: dict):
        _only(doc, ("version", "sets", "query", "limits", "on_limit"), "query document")
        if doc.get("version") != 1:
            raise QueryError("query document version must be 1")
        if not isinstance(doc.get("sets"), list) or not isinstance(doc.get("query"), dict):
            raise QueryError("query document requires a sets array and a query object")
        self.sets: dict[str, SetSpec] = {}
        for i, s in enumerate(doc["sets"]):
            one = self._set(s, f"sets[{i}]")
            if one.id in self.sets:
                raise QueryError(f"duplicate set {one.id}")
            self.sets[one.id] = one
        self.limits = dict(_only(doc.get("limits", {}), LIMITS, "limits"))
        if any(not isinstance(v, int) or v <= 0 for v in self.limits.values()):
            raise QueryError("limits must be positive")
        self.partial = doc.get("on_limit", "fail") == "partial"
        if doc.get("on_limit", "fail") not in ("fail", "partial"):
            raise QueryError("on_limit must be fail or partial")
        q = self.query = _only(doc["query"], ("from", "joins", "where", "select", "group_by", "having", "order_by", "limit", "skip", "max_rows", "max_output_rows"), "query")
        self.aliases: dict[str, str] = {}
        start = _only(q.get("from"), ("set", "as"), "from")
        self._alias(start)
        self.gone: set[str] = set()
        self.joins = []
        for j in q.get("joins", []):
            _only(j, ("type", "set", "as", "on", "allow_cartesian"), "join")
            if j.get("type") not in ("inner", "left", "semi", "anti"):
                raise QueryError("join type must be inner, left, semi or anti")
            self._alias(j)
            on = j.get("on")
            on = [on] if isinstance(on, dict) else on
            if not isinstance(on, list):
                raise QueryError("join needs on")
            for p in on:
                self._check(p)
            self.joins.append((j, on, self._strategy(j["as"], on)))
            if j["type"] in ("semi", "anti"):
                self.gone.add(j["as"])
        if not isinstance(q.get("select"), dict) or not q["select"]:
            raise QueryError("query needs select")
        if "where" in q:
            self._check(q["where"])
        for name, e in q["select"].items():
            self._check_expression(e, name)
        self.grouped = bool(q.get("group_by")) or any(self._aggregate(e) for e in q["select"].values())
        for g in q.get("group_by", []):
            self._reference(g, needed=True)
        if "having" in q and not self.grouped:
            raise QueryError("having needs grouping")
        for o in q.get("order_by", []):
            if o.get("field") not in q["select"] or o.get("direction", "asc") not in ("asc", "desc"):
                raise QueryError("order_by takes projected fields, asc or desc")
        for n in ("limit", "skip", "max_rows", "max_output_rows"):
            if n in q and (not isinstance(q[n], int) or q[n] < 0):
                raise QueryError(f"{n} must be a non-negative number")
        self._adaptive()
        self._guard()
        self.gone = set()  # checked; lowering a semi or anti join refers to its own alias
        text = repr(doc)
        self.needs_ids = "row_id" in text or "source_rows" in text

    # --- checks

    def _set(self, s: Any, where: str) -> SetSpec:
        _only(s, ("id", "scan", "exclude", "scope", "patterns", "derive_patterns"), where)
        if not isinstance(s.get("id"), str) or not IDENTIFIER.match(s["id"]):
            raise QueryError(f"{where}.id must be an identifier")
        if ("patterns" in s) == ("derive_patterns" in s):
            raise QueryError(f"{where} needs exactly one of patterns and derive_patterns")
        patterns = []
        if "patterns" in s:
            if not isinstance(s["patterns"], list) or not s["patterns"]:
                raise QueryError(f"{where}.patterns must be a non-empty array")
            for p in s["patterns"]:
                _only(p, ("id", "regexp", "literal", "case_insensitive", "word_boundary", "utf8", "ucp", "extract"), f"{where} pattern")
                if not isinstance(p.get("id"), str) or not IDENTIFIER.match(p["id"]):
                    raise QueryError(f"{where}: pattern id must be an identifier")
                if ("regexp" in p) == ("literal" in p):
                    raise QueryError(f"{where}: pattern needs exactly one of regexp and literal")
                extract = _strings(p.get("extract"), "extract")
                if len(set(extract)) < len(extract):
                    raise QueryError("extract names must be unique")
                patterns.append(Pattern(p["id"], p["regexp"] if "regexp" in p else escape(p["literal"]), p.get("case_insensitive", False), p.get("word_boundary", False), p.get("utf8", True), p.get("ucp", False), extract=extract).check())
            if len({p.id for p in patterns}) < len(patterns):
                raise QueryError(f"{where}: duplicate pattern id")
        else:
            d = _only(s["derive_patterns"], ("from_set", "field", "mode", "word_boundary", "deduplicate", "max_patterns", "max_value_bytes"), f"{where}.derive_patterns")
            if not isinstance(d.get("from_set"), str) or not isinstance(d.get("field"), str):
                raise QueryError(f"{where}.derive_patterns requires from_set and field")
            if d.get("mode", "literal") not in ("literal", "regexp"):
                raise QueryError("mode must be literal or regexp")
            if d.get("deduplicate", True) is not True:
                raise QueryError("derived values are always distinct: deduplicate cannot be false")
        return SetSpec(s["id"], _strings(s.get("scan"), "scan"), _strings(s.get("exclude"), "exclude"), s.get("scope"), patterns, s.get("derive_patterns"))

    def _alias(self, o: dict) -> None:
        if o.get("set") not in self.sets:
            raise QueryError(f"unknown set {o.get('set')}")
        if not isinstance(o.get("as"), str) or not IDENTIFIER.match(o["as"]) or o["as"] in self.aliases:
            raise QueryError("as must be a new identifier")
        self.aliases[o["as"]] = o["set"]

    def _kind(self, set_id: str, name: str) -> str | None:
        if name.startswith("capture."):
            return STR if name[8:] in self.sets[set_id].captures else None
        return FIELDS.get(name)

    def _reference(self, text: str, needed: bool = False) -> tuple[str, str] | None:
        """Alias and field of a reference; None for a text that is none."""
        alias, dot, name = text.partition(".")
        if not dot or alias not in self.aliases:
            if needed:
                raise QueryError(f"{text} is no field")
            return None
        if alias in self.gone:
            raise QueryError(f"{alias} is not available after a semi or anti join")
        if self._kind(self.aliases[alias], name) is None:
            raise QueryError(f"unknown field {text}")
        return alias, name

    def _check(self, p: Any) -> None:
        if not isinstance(p, dict) or "op" not in p:
            raise QueryError("a condition needs op")
        op = p["op"]
        if op in ("and", "or"):
            if not isinstance(p.get("args"), list) or not p["args"]:
                raise QueryError(f"{op} needs args")
            for a in p["args"]:
                self._check(a)
        elif op == "not":
            self._check(p.get("arg", p.get("left")))
        elif op in LOCATION:
            for side in ("left", "right"):
                if p.get(side) not in self.aliases or p[side] in self.gone:
                    raise QueryError(f"{op} compares aliases")
            if op == "within_lines" and (not isinstance(p.get("lines"), int) or p["lines"] < 0):
                raise QueryError("within_lines needs lines")
        elif op in BINARY or op in ("is_null", "is_not_null"):
            for side in ("left", "right") if op in BINARY else ("left",):
                if side not in p:
                    raise QueryError(f"{op} needs {side}")
                if isinstance(p[side], str):
                    self._reference(p[side])
        else:
            raise QueryError(f"unknown op {op}")

    def _aggregate(self, e: Any) -> str | None:
        return next((k for k in e if k in AGGREGATES), None) if isinstance(e, dict) else None

    def _check_expression(self, e: Any, where: str) -> None:
        if isinstance(e, str):
            self._reference(e)
        elif isinstance(e, dict):
            if len(e) != 1 or next(iter(e)) not in AGGREGATES + SCALARS:
                raise QueryError(f"{where}: unknown expression")
            op, arg = next(iter(e.items()))
            if op in ("coalesce", "concat"):
                if not isinstance(arg, list) or not arg:
                    raise QueryError(f"{op} needs a list")
                for a in arg:
                    self._check_expression(a, where)
            elif op != "literal" and arg != "*":
                self._check_expression(arg, where)
        elif isinstance(e, list):
            raise QueryError(f"{where}: a list needs literal")

    def _adaptive(self) -> None:
        seen: set[str] = set()
        stages = 0
        for s in self.sets.values():
            if s.derive:
                stages += 1
                if s.derive["from_set"] not in seen:
                    raise QueryError("derive_patterns takes an earlier set")
                if self._kind(s.derive["from_set"], s.derive["field"]) is None:
                    raise QueryError(f"unknown field {s.derive['field']}")
            seen.add(s.id)
        if stages > self.limits.get("max_adaptive_stages", DEFAULTS["max_adaptive_stages"]):
            raise LimitExceeded("too many adaptive stages")

    def _strategy(self, alias: str, on: list[dict]) -> str:
        for p in on:
            if p["op"] == "eq":
                sides = [r[0] if isinstance(p[s], str) and (r := self._reference(p[s])) else None for s in ("left", "right")]
                if None not in sides and sides.count(alias) == 1:
                    return "hash"
        if any(p["op"] in LOCATION and alias in (p["left"], p["right"]) and p["left"] != p["right"] for p in on):
            return "interval"
        return "nested-loop"

    def _guard(self) -> None:
        bound = {k: self.limits.get(k, v) for k, v in DEFAULTS.items()}
        for i, (j, _, strategy) in enumerate(self.joins):
            rows = bound["max_rows_per_set"] if i == 0 else bound["max_join_rows"]
            if strategy == "nested-loop" and not j.get("allow_cartesian") and rows * bound["max_rows_per_set"] > bound["max_cartesian_rows"]:
                raise LimitExceeded("predicted Cartesian product exceeds max_cartesian_rows; add an equality or location condition, or allow_cartesian")

    # --- the plan record

    def stages(self) -> list[list[SetSpec]]:
        """Static sets by scan settings, then each derived set."""
        groups: dict[tuple, list[SetSpec]] = {}
        for s in self.sets.values():
            if not s.derive:
                groups.setdefault((tuple(sorted(s.scan)), tuple(sorted(s.exclude)), s.scope), []).append(s)
        return [*groups.values(), *([s] for s in self.sets.values() if s.derive)]

    def plan(self) -> dict:
        q = self.query
        ops = [{"op": f"{strategy}-{j['type']}-join", "set": j["set"], "as": j["as"]} for j, _, strategy in self.joins]
        ops += [{"op": "filter"}] if "where" in q else []
        ops += [{"op": "aggregate", "keys": q.get("group_by", [])}] if self.grouped else [{"op": "project"}]
        ops += [{"op": "having"}] if "having" in q else []
        ops += [{"op": "order", "fields": [o["field"] for o in q["order_by"]]}] if q.get("order_by") else []
        ops += [{"op": "page", "skip": q.get("skip", 0), "limit": q.get("limit")}] if "limit" in q or "skip" in q else []
        stages = []
        for i, sets in enumerate(self.stages()):
            one = {"id": f"scan{i}", "sets": [s.id for s in sets], "patterns": sum(len(s.patterns) for s in sets), "inputs": sorted(sets[0].scan)}
            stages.append(one | ({"scope": sets[0].scope} if sets[0].scope else {}) | ({"adaptive": sets[0].derive["from_set"]} if sets[0].derive else {}))
        return {"type": "execution-plan", "mode": "query", "scan_stages": stages, "postprocess": ops, "limits": dict(sorted(self.limits.items()))}

    # --- values

    def _operand(self, x: Any, projected: dict[str, Value] | None = None) -> Value:
        if projected and isinstance(x, str) and x in projected:
            return projected[x]
        if isinstance(x, str) and (r := self._reference(x)):
            return self._field(*r)
        return _literal(x)

    def _field(self, alias: str, name: str) -> Value:
        kind = self._kind(self.aliases[alias], name)
        if name.startswith("capture."):
            return Value(STR, F.try_element_at(F.col(f"`{alias}`.captures"), F.lit(name[8:])))
        if kind == INT:
            return Value(INT, F.col(f"`{alias}`.{_path(name)}").cast("long"))
        return Value(kind, F.col(f"`{alias}`.{_path(name)}"))

    def _expression(self, e: Any) -> Value:
        if not isinstance(e, dict):
            return self._operand(e)
        op, arg = next(iter(e.items()))
        if op == "literal":
            return _literal(arg)
        if op == "coalesce":
            values = [self._expression(a) for a in arg]
            kinds = {v.kind for v in values} - {NULL}
            if len(kinds) == 1:
                return Value(kinds.pop(), F.coalesce(*(v.col for v in values)))
            return Value(STR, F.coalesce(*(F.when(v.col.isNotNull(), _text(v)) for v in values)))
        if op == "concat":
            return Value(STR, F.concat(*(_text(self._expression(a)) for a in arg)))
        text = _text(self._expression(arg))
        if op in ("lower", "upper"):
            return Value(STR, F.translate(text, *((UPPER, LOWER) if op == "lower" else (LOWER, UPPER))))
        if op == "basename":
            return Value(STR, F.regexp_extract(text, "([^/]*)$", 1))
        return Value(STR, F.when(text.rlike("^/[^/]*$"), "/").otherwise(F.regexp_extract(text, "(?s)^(.*)/[^/]*$", 1)))

    def _predicate(self, p: dict, projected: dict[str, Value] | None = None) -> Column:
        op = p["op"]
        if op in ("and", "or"):
            out = self._predicate(p["args"][0], projected)
            for a in p["args"][1:]:
                out = out & self._predicate(a, projected) if op == "and" else out | self._predicate(a, projected)
            return out
        if op == "not":
            return ~self._predicate(p.get("arg", p.get("left")), projected)
        if op in LOCATION:
            return F.coalesce(self._location(p), F.lit(False))
        a = self._operand(p["left"], projected)
        if op in ("is_null", "is_not_null"):
            return a.col.isNull() if op == "is_null" else a.col.isNotNull()
        return _compare(op, a, self._operand(p["right"], projected))

    def _location(self, p: dict) -> Column:
        a, b = (F.col(f"`{p[s]}`") for s in ("left", "right"))
        same, op = a["file"] == b["file"], p["op"]
        if op == "same_file":
            return same
        if op == "same_scope":
            return same & (a["enclosing"]["from"] == b["enclosing"]["from"]) & (a["enclosing"]["to"] == b["enclosing"]["to"])
        if op == "within_lines":
            return same & (F.abs(a["line"] - b["line"]) <= p["lines"])
        if op == "before":
            return same & (a["to"] <= b["from"])
        if op == "after":
            return same & (a["from"] >= b["to"])
        return same & (a["from"] <= b["from"]) & (a["to"] >= b["to"])

    # --- lowering

    def run(self, spark: SparkSession, corpora: dict[str, Corpus] | None = None) -> Result:
        """corpora: by the name that a scan item has, as in {"table:documents": ...}; other items are files."""
        result = Result(spark.range(0), self.plan())
        rows = self._scanned(spark, corpora or {}, result)
        q = self.query
        df = self._rows(rows, q["from"]["set"], q["from"]["as"])
        order = [q["from"]["as"]]
        weight = self._weighted()
        for j, on, strategy in self.joins:
            right = self._rows(rows, j["set"], j["as"])
            if weight:
                df = self._met(df, right, on)
                break
            df = self._joined(df, right, j, on, strategy)
            if j["type"] in ("inner", "left"):
                order.append(j["as"])
            if "max_join_rows" in self.limits:
                df = self._limited(df, self.limits["max_join_rows"], "max_join_rows", result)
        if "where" in q:
            df = df.filter(self._predicate(q["where"]))
        ordinal = F.struct(*[F.col(f"`{a}`.__at").alias(f"o{i}") for i, a in enumerate(order)])
        out, kinds = self._grouped(df, F.struct(F.col(f"`{order[0]}`.__at").alias("o0")) if weight else ordinal, weight) if self.grouped else self._projected(df)
        if q.get("order_by"):
            keys = []
            for o in q["order_by"]:
                v = Value(kinds[o["field"]], F.col(f"`{o['field']}`"))
                k = v.col if v.kind in (INT, BOOL) else _text(v)
                keys.append(k.desc_nulls_last() if o.get("direction") == "desc" else k.asc_nulls_first())
            out = out.orderBy(*keys, F.to_json(F.struct(*[F.col(f"`{c}`") for c in out.columns]), {"ignoreNullFields": "false"}))
        if q.get("skip"):
            out = out.offset(q["skip"])
        if "limit" in q:
            out = out.limit(q["limit"])
        for n in ("max_rows", "max_output_rows"):
            if n in q:
                out = self._limited(out, q[n], n, result)
        result.df = out
        return result

    def _limited(self, df: DataFrame, most: int, name: str, result: Result) -> DataFrame:
        """df, if it has no more rows than that; they are written as they are counted, so that nothing runs twice."""
        rows = kept(df.limit(most + 1), "limited")
        if rows.count() <= most:
            return rows
        if not self.partial:
            raise LimitExceeded(name)
        result.complete, result.stop_reason = False, name
        return rows.limit(most)

    def _scanned(self, spark: SparkSession, corpora: dict[str, Corpus], result: Result) -> dict[str, DataFrame]:
        out: dict[str, DataFrame] = {}
        stage_rows: list[DataFrame] = []
        global_index = 0
        for stage, sets in enumerate(self.stages()):
            corpus = _corpus(spark, corpora, sets[0])
            need = {"context", "captures"} | ({"scope"} if sets[0].scope else set())
            options = scan.Options(frozenset(need), sets[0].scope or "auto")
            members, values, found = [], None, None
            if sets[0].derive:
                values, members, words = self._derived(sets[0], out, result)
                found = None if words is None else scan.match_words(corpus, words, sets[0].id, options)
            else:
                for s in sets:
                    members += [scan.Member(p, s.id, i) for i, p in enumerate(s.patterns)]
            if members:
                other = scan.match_members(corpus, members, options)
                found = other if found is None else found.union(other)
            elif found is None:
                found = spark.createDataFrame([], scan.SCHEMA)
            found = found.withColumn("__at", F.struct(F.lit(stage).alias("stage"), "walk_ord", F.col("from").alias("start"), F.col("pattern_index").alias("index"), F.col("set_id").alias("set")))
            global_index += len(members)
            if values is not None and self.needs_ids:
                found = found.join(values.select("__value", "source_rows"), F.col("derived_value") == F.col("__value"), "left").drop("__value")
            else:
                found = found.withColumn("source_rows", F.array().cast("array<long>"))
            if self.needs_ids:
                found = ordered.numbered(found, ["__at"], "row_id", sum(r.count() for r in stage_rows))
            else:
                found = found.withColumn("row_id", F.lit(None).cast("long"))
            if self.limits.keys() & {"max_total_rows", "max_memory_bytes"}:
                found = self._within(kept(found, "stage"), stage_rows, result)
            stage_rows.append(found)
            for s in sets:
                mine = found.filter(F.col("set_id") == s.id) if len(sets) > 1 else found
                if "max_rows_per_set" in self.limits:
                    if self.partial:
                        most = self.limits["max_rows_per_set"]
                        mine = kept(mine.orderBy("__at").limit(most + 1), "limited")
                        if mine.count() > most:
                            result.complete, result.stop_reason = False, "max_rows_per_set"
                            mine = mine.orderBy("__at").limit(most)
                    else:
                        mine = self._limited(mine, self.limits["max_rows_per_set"], "max_rows_per_set", result)
                out[s.id] = mine
        return out

    def _within(self, found: DataFrame, before: list[DataFrame], result: Result) -> DataFrame:
        """A stage's match rows under the limits of all stages together: rows, and bytes of matches and contexts (with 64 for the numbers of each row)."""
        for name, size in (("max_total_rows", F.lit(1)), ("max_memory_bytes", F.octet_length("match") + F.coalesce(F.octet_length("context"), F.lit(0)) + 64)):
            if name not in self.limits:
                continue
            total = lambda df: df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]
            left = self.limits[name] - sum(map(total, before))
            if total(found) <= left:
                continue
            if not self.partial:
                raise LimitExceeded(name)
            result.complete, result.stop_reason = False, name
            found = ordered.running(found, ["__at"], size, "__before").filter(F.col("__before") + size <= left).drop("__before")
        return found

    def _derived(self, s: SetSpec, rows: dict[str, DataFrame], result: Result) -> tuple[DataFrame, list[scan.Member], DataFrame | None]:
        """The distinct values of the source set with their numbers and source rows; those that are searched as patterns (at most max_patterns, else an error) as members; those that are whole words, which are
        joined with the texts' words, as a table. A stated max_patterns counts both."""
        d = s.derive
        most, size = d.get("max_patterns", 10_000), d.get("max_value_bytes", 4096)
        source = rows[d["from_set"]].alias("x").select(F.struct("*").alias("x"))
        self.aliases.setdefault("x", d["from_set"])
        saved, self.aliases["x"] = self.aliases["x"], d["from_set"]
        value = _text(self._field("x", d["field"]))
        self.aliases["x"] = saved
        if saved == d["from_set"] and "x" not in [self.query["from"]["as"], *(j["as"] for j, _, _ in self.joins)]:
            del self.aliases["x"]
        values = source.select(value.alias("__value"), F.col("x.row_id").alias("row_id"), F.col("x.__at").alias("at"))
        sources = F.transform(F.array_sort(F.collect_list(F.struct("at", "row_id"))), lambda r: r["row_id"]) if self.needs_ids else F.array().cast("array<long>")
        told = kept(values.groupBy("__value").agg(F.count(F.lit(1)).alias("n"), sources.alias("source_rows")), "derived-values")
        good = (F.col("__value") != "") & (F.octet_length("__value") <= size)
        skipped = told.filter(~good).agg(F.sum("n")).first()[0]
        if skipped:
            result.warnings.append(f"skipped {skipped} empty or too long derived values of {s.id}")
        literal, whole = d.get("mode", "literal") == "literal", d.get("word_boundary", False)
        told, words = told.filter(good), None
        if literal and whole:
            told = ordered.numbered(told.withColumn("word", F.col("__value").rlike("^[A-Za-z0-9_]+$")), ["__value"], "index")
            words = told.filter("word").select(F.col("__value").alias("value"), "index")
            found = told.filter(~F.col("word")).select("__value", "index").orderBy("index").limit(most + 1).collect()
        else:
            found = [(r[0], i) for i, r in enumerate(told.select("__value").orderBy("__value").limit(most + 1).collect())]
        if len(found) > most or words is not None and "max_patterns" in d and told.limit(most + 1).count() > most:
            raise LimitExceeded("max_patterns")
        members = []
        for v, i in found:
            pattern = Pattern(f"derived{i}", escape(v) if literal else v, word_boundary=whole).check()
            members.append(scan.Member(pattern, s.id, i, v))
        return told, members, words

    def _rows(self, rows: dict[str, DataFrame], set_id: str, alias: str) -> DataFrame:
        df = rows[set_id]
        derived = F.struct(F.col("derived_value").alias("value"), "source_rows").alias("derived")
        names = [F.col(f"`{n}`") for n in ("row_id", "set_id", "pattern_id", "pattern_index", "file", "language", "from", "to", "line", "column", "match", "context", "captures", "enclosing", "__at")]
        return df.select(F.struct(*names, derived).alias(alias))

    def _joined(self, left: DataFrame, right: DataFrame, j: dict, on: list[dict], strategy: str) -> DataFrame:
        condition = F.lit(True)
        for p in on:
            if p["op"] == "eq" and strategy == "hash":
                a, b = self._operand(p["left"]), self._operand(p["right"])
                # as keys, values of different kinds never meet
                condition &= a.col.eqNullSafe(b.col) if a.kind == b.kind else F.lit(False) if NULL not in (a.kind, b.kind) else _compare("eq", a, b)
            elif p["op"] in LOCATION:
                condition &= self._location(p)
            else:
                condition &= self._predicate(p)
        how = {"inner": "inner", "left": "left", "semi": "left_semi", "anti": "left_anti"}[j["type"]]
        if strategy != "interval":
            return left.join(right, condition, how)
        if j["type"] in ("semi", "anti") and len(on) == 1 and on[0]["op"] in ("before", "after"):
            # whether any partner stands before or after: the file's outermost one tells
            name = f"`{j['as']}`"
            ends = right.groupBy(F.col(f"{name}.file").alias("file")).agg(F.max(F.col(f"{name}.from")).alias("from"), F.min(F.col(f"{name}.to")).alias("to"))
            return left.join(ends.select(F.struct("file", "from", "to").alias(j["as"])), condition, how)
        for p in on:
            if binned := self._bins(p, j["as"], j["type"]):
                mine, others = binned
                left, right = left.withColumn("__bin", mine), right.withColumn("__bins", F.explode(others))
                return left.join(right, condition & (F.col("__bin") == F.col("__bins")), how).drop("__bin", "__bins")
        return left.join(right, condition, how)

    def _weighted(self) -> bool:
        """Whether the one join is an equality of captures or other fields, and all that is asked of its rows can be told from the left row and the number of its partners: then no pairs are made."""
        q = self.query
        if len(self.joins) != 1 or not self.grouped or "where" in q or self.limits.keys() & {"max_join_rows"}:
            return False
        j, on, strategy = self.joins[0]
        alias = j["as"]
        if j["type"] != "inner" or strategy != "hash":
            return False
        for p in on:
            sides = [r[0] if isinstance(p.get(s), str) and (r := self._reference(p[s])) else None for s in ("left", "right")]
            if p["op"] != "eq" or sorted(map(str, sides)) != sorted(map(str, (q["from"]["as"], alias))) or alias == q["from"]["as"]:
                return False
            if len({self._operand(p[s]).kind for s in ("left", "right")}) > 1:
                return False
        named = lambda x: any(map(named, x.values() if isinstance(x, dict) else x)) if isinstance(x, (dict, list)) else isinstance(x, str) and (r := self._reference(x)) is not None and r[0] == alias
        collects = any((op := self._aggregate(e)) and op.startswith("collect") and op != "collect_distinct" for e in q["select"].values())
        return not collects and not named(q["select"]) and not named(q.get("group_by", []))

    def _met(self, left: DataFrame, right: DataFrame, on: list[dict]) -> DataFrame:
        """left with __n, the number of its partners in right, for rows that have some: both sides meet as keys, and right's are counted first."""
        alias = self.joins[0][0]["as"]
        mine, others = [], []
        for p in on:
            sides = [p["left"], p["right"]]
            if self._reference(p["left"])[0] == alias:
                sides.reverse()
            mine.append(self._operand(sides[0]).col)
            others.append(self._operand(sides[1]).col)
        counts = right.groupBy(*(c.alias(f"__c{i}") for i, c in enumerate(others))).agg(F.count(F.lit(1)).alias("__n"))
        condition = F.lit(True)
        for i, c in enumerate(mine):
            condition &= c.eqNullSafe(F.col(f"__c{i}"))
        return left.join(counts, condition).drop(*(f"__c{i}" for i in range(len(mine))))

    def _bins(self, p: dict, alias: str, kind: str) -> tuple[Column, Column] | None:
        """For a condition that bounds how far its rows may be apart: the bin of a row so far and the bins of a row of `alias` in which it may be, so that each pair meets once; None if there is no such bound."""
        if alias not in (p.get("left"), p.get("right")) or p.get("left") == p.get("right"):
            return None
        mine = F.col(f"`{p['right' if p['left'] == alias else 'left']}`")
        other = F.col(f"`{alias}`")
        if p["op"] == "within_lines":
            at = lambda x: F.floor(x["line"] / (p["lines"] + 1)).cast("long")
            return at(mine), F.array(*(at(other) + k for k in (-1, 0, 1)))
        if p["op"] != "contains_span":
            return None
        # a span lies in one or two bins of the smallest size that is no shorter; what it holds looks for it at every size, in its own bin and the one before
        bin_of = lambda x, size: F.struct(F.lit(size).alias("size"), F.floor(x["from"] / size).cast("long").alias("at"))

        def outer(x: Column) -> Column:
            out = bin_of(x, SPANS[-1])
            for size in reversed(SPANS[:-1]):
                out = F.when(x["to"] - x["from"] <= size, bin_of(x, size)).otherwise(out)
            return out

        def inner(x: Column) -> Column:
            return F.array(*(F.struct(F.lit(size).alias("size"), (F.floor(x["from"] / size) - k).cast("long").alias("at")) for size in SPANS for k in (0, 1)))

        if p["right"] == alias:
            return outer(mine), inner(other)
        # here the rows so far would be many each: only where a row without partner has no meaning of its own
        return None if kind != "inner" else (F.explode(inner(mine)), F.array(outer(other)))

    def _projected(self, df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
        values = {n: self._expression(e) for n, e in self.query["select"].items()}
        return df.select(*[values[n].col.alias(n) for n in sorted(values)]), {n: v.kind for n, v in values.items()}

    def _grouped(self, df: DataFrame, ordinal: Column, weighted: bool = False) -> tuple[DataFrame, dict[str, str]]:
        q, aggregates, kinds = self.query, [], {}
        for name in sorted(q["select"]):
            e = q["select"][name]
            op = self._aggregate(e)
            if op is None:
                v = self._expression(e)
                aggregates.append(F.min_by(F.struct(v.col.alias("v")), ordinal)["v"].alias(name))
                kinds[name] = v.kind
                continue
            v = self._expression(e[op]) if e[op] != "*" else Value(INT, F.lit(1))
            kinds[name] = INT if op in ("count", "count_distinct", "sum") else LIST if op.startswith("collect") else v.kind
            aggregates.append(_aggregated(op, v, ordinal, F.col("__n") if weighted else None).alias(name))
        keys = [self._field(*self._reference(g)).col.alias(f"__k{i}") for i, g in enumerate(q.get("group_by", []))]
        out = df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)
        if "having" in q:
            out = out.filter(self._predicate(q["having"], {n: Value(k, F.col(f"`{n}`")) for n, k in kinds.items()}))
        return out.select(*[F.col(f"`{n}`") for n in sorted(q["select"])]), kinds


def _corpus(spark: SparkSession, corpora: dict[str, Corpus], s: SetSpec) -> Corpus:
    named = [x for x in s.scan if x in corpora]
    if not named:
        return Corpus.from_files(spark, s.scan, s.exclude)
    if len(named) < len(s.scan):
        raise QueryError("a set scans either registered corpora or files")
    df = corpora[named[0]].df
    for n in named[1:]:
        df = df.unionByName(corpora[n].df)
    return Corpus(df)


def _path(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def _literal(x: Any) -> Value:
    if x is None:
        return Value(NULL, F.lit(None).cast("string"))
    if isinstance(x, bool):
        return Value(BOOL, F.lit(x))
    if isinstance(x, (int, float)):
        return Value(INT, F.lit(int(x)).cast("long"))
    if isinstance(x, list):
        values = [_literal(i) for i in x]
        kinds = {v.kind for v in values}
        column = F.array(*(v.col for v in values)) if len(kinds) == 1 else F.array(*(F.when(v.col.isNotNull(), _text(v)) for v in values)) if values else F.array().cast("array<string>")
        return Value(LIST, column, values)
    if isinstance(x, dict):
        return Value(STR, F.lit(json.dumps(x, sort_keys=True, separators=(",", ":"))))
    return Value(STR, F.lit(x))


def _text(v: Value) -> Column:
    """A value as text; null is the empty text."""
    if v.kind == STR:
        return F.coalesce(v.col, F.lit(""))
    if v.kind == NULL:
        return F.lit("")
    return F.coalesce(F.to_json(v.col) if v.kind == LIST else v.col.cast("string"), F.lit(""))


def _equal(a: Value, b: Value) -> Column:
    if a.kind == NULL or b.kind == NULL:
        return a.col.isNull() & b.col.isNull()
    if a.kind == b.kind:
        return a.col.eqNullSafe(b.col)
    return F.when(a.col.isNull() | b.col.isNull(), a.col.isNull() & b.col.isNull()).otherwise(_text(a) == _text(b))


def _compare(op: str, a: Value, b: Value) -> Column:
    if op == "eq":
        return _equal(a, b)
    if op == "ne":
        return ~_equal(a, b)
    if op in ("lt", "lte", "gt", "gte"):
        test = {"lt": lambda x, y: x < y, "lte": lambda x, y: x <= y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y}[op]
        if {a.kind, b.kind} <= {INT, BOOL}:
            x, y = a.col.cast("long"), b.col.cast("long")
            return F.when(x.isNotNull() & y.isNotNull(), test(x, y)).otherwise(test(_text(a), _text(b)))
        return test(_text(a), _text(b))
    if op == "contains":
        if a.kind == LIST:
            return F.coalesce(F.exists(a.col.cast("array<string>"), lambda x: x.eqNullSafe(_text(b) if b.kind != NULL else F.lit(None).cast("string"))), F.lit(False))
        return F.contains(_text(a), _text(b))
    if op == "in":
        if b.kind != LIST:
            return F.lit(False)
        if b.items is not None:
            out = F.lit(False)
            for item in b.items:
                out |= _equal(a, item)
            return out
        return F.coalesce(F.exists(b.col.cast("array<string>"), lambda x: x.eqNullSafe(_text(a))), F.lit(False))
    return F.startswith(_text(a), _text(b)) if op == "starts_with" else F.endswith(_text(a), _text(b))


def _aggregated(op: str, v: Value, ordinal: Column, times: Column | None = None) -> Column:
    """times: for how many rows a row stands (none: for itself)."""
    if op == "count":
        return F.count(F.lit(1)) if times is None else F.coalesce(F.sum(times), F.lit(0))
    if op == "first":
        return F.min_by(F.struct(v.col.alias("v")), ordinal)["v"]
    if op == "count_distinct":
        return F.count_distinct(F.struct(v.col.isNull().alias("n"), _text(v).alias("t")))
    if op == "sum":
        number = v.col.cast("long") if v.kind in (INT, BOOL) else F.size(v.col).cast("long") if v.kind == LIST else F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(_text(v), r"^\s*([-+]?\d{1,18})", 1), F.lit("")), F.lit("S999999999999999999")).cast("long"), F.lit(0))
        number = F.coalesce(number, F.lit(0))
        return F.coalesce(F.sum(number if times is None else number * times), F.lit(0)).cast("long")
    if op in ("min", "max"):
        key = F.struct(v.col.isNotNull().alias("n"), v.col.cast("long").alias("k")) if v.kind in (INT, BOOL) else F.struct(_text(v).alias("k"))
        return (F.min_by if op == "min" else F.max_by)(F.struct(v.col.alias("v")), key)["v"]
    listed = F.transform(F.array_sort(F.collect_list(F.struct(ordinal.alias("o"), v.col.alias("v")))), lambda s: s["v"])
    return F.array_distinct(listed) if op == "collect_distinct" else listed


#: How deep a document's text may be nested.
DEPTH = 1000


def document(given: dict | str | os.PathLike) -> dict:
    """A document as it is, from its JSON text, or from a file that holds that."""
    if isinstance(given, dict):
        return given
    text = str(given)
    if not text.lstrip().startswith("{"):
        with open(given, encoding="utf-8") as f:
            text = f.read()
    depth = most = 0
    in_text = escaped = False
    for c in text:
        if in_text:
            in_text, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            in_text = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    if most > DEPTH:
        raise QueryError(f"the document is nested deeper than {DEPTH}")
    try:
        found = json.loads(text)
    except ValueError as e:
        raise QueryError(f"the document is no JSON: {e}") from e
    if not isinstance(found, dict):
        raise QueryError("the document must be an object")
    return found


def run_query(spark: SparkSession, doc: dict | str | os.PathLike, corpora: dict[str, Corpus] | None = None) -> Result:
    return Query(document(doc)).run(spark, corpora)
