"""Maps of scripts as tables of keys and values, for the scripts that use them row by row.

What files add to a map are events; they are merged by key in Spark and stay there. A later phase that looks keys up first tells which keys each file asks for, a join fetches these, and every
file is run with its own part of the map. A loop over the map after the last file runs its actions for each row of the table, in the order of keys. So neither keys nor values come to the driver.
`tabled` says for which maps this is possible; all others are held by the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import order
from textloom.sources.shared import kept

CHANGES = {"map_set": "map_set", "map_increment": "map_inc", "count": "map_inc", "map_append": "map_append", "map_unique_append": "map_unique"}
ROWWISE = {"emit", "print", "if"}
#: Rows of hooks after the last file come behind all files', in the order of actions, then of keys.
AFTER, STEP = 2**62, 2**40


class Variables(dict):
    """A script's variables; a map that is a table is collected when it is asked for."""

    def __init__(self, values: dict[str, Any], tables: dict[str, DataFrame]):
        super().__init__((k, v) for k, v in values.items() if k not in tables)
        self.tables = tables

    def __missing__(self, name: str) -> Any:
        if name not in self.tables:
            raise KeyError(name)
        self[name] = {r.key: json.loads(r.value) for r in self.tables[name].collect()}
        return self[name]


def _loop(a: dict, name: str) -> bool:
    return a["action"] == "for_each" and a["var"].lstrip("$") == name


def _named(actions: list[dict], walk: Callable, reads: Callable) -> set[str]:
    return set().union(*(reads(a) | {a.get("target", a.get("var"))} for a in walk(actions)), set())


def tabled(script, per_file_pages: bool, walk: Callable, reads: Callable) -> set[str]:
    """The maps that are only changed by files that run apart, looked up by keys that a match alone gives, and looped over row by row after all files."""
    if per_file_pages:
        return set()
    doc = script.doc
    last = len(script.phases) - 1
    hooks = [a for k, p in enumerate(script.phases) for a in (*p.on_complete, *(doc.get("on_complete", []) if k == last else []))]
    out = set()
    for name, (kind, _) in script.types.items():
        if kind == "map" and all(_phase_allows(script, k, name, walk, reads) for k in range(last + 1)) and _hooks_allow(hooks, name, walk, reads):
            out.add(name)
    return out


def _phase_allows(script, k: int, name: str, walk: Callable, reads: Callable) -> bool:
    phase, doc = script.phases[k], script.doc
    ends = [*phase.on_file_end, *(doc.get("on_file_end", []) if k == len(script.phases) - 1 else [])]
    every = [a for group in (*phase.actions, ends) for a in walk(group)]
    changes = [a for a in every if a["action"] in CHANGES and a.get("target", a.get("var")) == name]
    lookups = [a for a in every if a["action"] == "lookup" and a["map"] == name]
    touched = [a for a in every if name in reads(a) | {a.get("target", a.get("var"))} | set(a.get("vars", ()))]
    if len(touched) > len(changes) + len(lookups):
        return False
    shared, apart = script.shared(phase, ends)
    if changes and (not apart or name not in shared or len({CHANGES[a["action"]] for a in changes}) > 1 or lookups):
        return False
    if not lookups:
        return True
    known = set(script.types) | {a.get("target", a.get("var")) for a in every} | {a[x] for a in every for x in ("as", "key_as") if x in a}
    plain = [a for actions in phase.actions for a in asked_for(actions, {name})]
    return apart and len(plain) == len(lookups) and all(not {t for t in reads({"action": "emit", "data": a["key"]})} & (known | {"LOOKUP_KEY", "LOOKUP_VALUE"}) for a in lookups)


def _hooks_allow(hooks: list[dict], name: str, walk: Callable, reads: Callable) -> bool:
    loops = [a for a in hooks if _loop(a, name)]
    others = [a for a in hooks if not _loop(a, name)]
    if name in _named(others, walk, reads):
        return False
    for a in loops:
        body = a.get("do", [])
        rest = [b for b in hooks if b is not a]
        own = {a.get("as", "item"), a.get("key_as")} - {None}
        if any(b["action"] not in ROWWISE for b in walk(body)) or name in _named(body, walk, reads) or own & _named([b for b in rest if b["action"] != "for_each"], walk, reads):
            return False
    return True


def asked_for(actions: list[dict], names: set[str]) -> list[dict]:
    """Lookups of these maps in actions of a match: on its own, in branches, or in branches of lookups."""
    out = []
    for a in actions:
        if a["action"] == "lookup" and a["map"] in names:
            out.append(a)
        if a["action"] in ("if", "lookup"):
            for k in ("then", "else", "on_hit", "on_miss"):
                out += asked_for(a.get(k, []), names)
    return out


def value_of(op: str, held: Any, n: int, last: str | None, listed: list[str] | None, int_of: Callable, same: Callable) -> Any:
    """A key's value (None: none yet) after its events of one kind."""
    if op == "map_inc":
        return int_of(held) + n
    if op == "map_set":
        return json.loads(last)
    have = [] if held is None else held if isinstance(held, list) else [held]
    for v in map(json.loads, listed or ()):
        if op == "map_append" or not any(same(x, v) for x in have):
            have.append(v)
    return have


def merged(events: DataFrame, name: str, before: DataFrame | dict, int_of: Callable, same: Callable) -> DataFrame:
    """key, value (JSON) of the map after its events, in scan order."""
    spark = events.sparkSession
    if isinstance(before, dict):
        before = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in before.items()], "key string, value string")
    at = F.struct("walk_ord", "seq")
    lists = F.when(F.col("op").isin("map_append", "map_unique"), F.struct("walk_ord", "seq", "value"))
    made = events.filter(F.col("var") == name).groupBy("key").agg(F.max("op").alias("op"), F.sum("n").alias("n"), F.max_by("value", at).alias("last"), F.transform(F.array_sort(F.collect_list(lists)), lambda x: x["value"]).alias("listed"))
    both = made.join(before.withColumnRenamed("value", "held"), "key", "full").select("key", "op", "n", "last", "listed", "held")

    def run(batches):
        for batch in batches:
            keys, values = [], []
            for key, op, n, last, listed, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys.append(key)
                values.append(held if op is None else json.dumps(value_of(op, None if held is None else json.loads(held), n, last, listed, int_of, same), ensure_ascii=False))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], names=["key", "value"])

    return kept(both.mapInArrow(run, "key string, value string"), f"map-{name}")


def with_parts(texts: DataFrame, keys: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """texts (file, content, walk_ord) with maps: of each map the keys that the file asks for. keys: file, walk_ord, var, key, each once for a file."""
    every = None
    for name, t in tables.items():
        t = t.select(F.lit(name).alias("var"), "key", "value")
        every = t if every is None else every.unionByName(t)
    parts = keys.join(every, ["var", "key"]).groupBy("file", "walk_ord").agg(F.collect_list(F.struct("var", "key", "value")).alias("maps"))
    return texts.join(parts, ["file", "walk_ord"], "left").select("file", "content", "walk_ord", "maps")


def looped(table: DataFrame, action: dict, machine: Callable, phase: int, at: int) -> DataFrame:
    """Rows (phase, walk_ord, seq, kind, line) of a loop over the table: the actions run for each key, in the order of keys. machine: makes a Machine."""

    def run(batches):
        m = machine()
        for batch in batches:
            rows = []
            for key, value, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                m.rows = []
                if "key_as" in action:
                    m.store[action["key_as"]] = key
                m.store[action.get("as", "item")] = json.loads(value)
                m.run(action.get("do", []))
                rows += [(phase, AFTER + at * STEP + n, i, kind, line) for i, (kind, line) in enumerate(m.rows)]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["phase", "walk_ord", "seq", "kind", "line"])

    return order.numbered(table.select("key", "value"), ["key"], "n").mapInArrow(run, "phase int, walk_ord long, seq int, kind string, line string")
