"""Source chunks: what a reader needs to see of the places that matched, at four levels of detail whose sizes are known before anything is packed.

Matches of one scope share a chunk; matches outside scopes share one if the lines around them touch. A chunk's lines are a cover of intervals: at level 0 a small scope whole, else its signature and the lines around the matches;
at 1 the signature and the lines around; at 2 the signature and the lines that matched; at 3 only where it is. What is left out between shown lines is counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexers
from textloom.operators.scan import Text, shown
from textloom.sources.corpus import Corpus

#: Lines of a scope that is shown whole; lines around a match.
SMALL, AROUND = 40, 2
LEVELS = 4
#: Bytes that the shortest place takes, with its line end.
LEAST = len("x:1-1\n")
FIELDS = [("file", pa.string()), ("walk_ord", pa.int64()), ("scope", pa.string()), ("kind", pa.string()), ("first", pa.int32()), ("last", pa.int32()), ("anchors", pa.list_(pa.int32())), ("texts", pa.list_(pa.string())), ("sizes", pa.list_(pa.int32())), ("whole", pa.list_(pa.bool_()))]
SCHEMA = "file string, walk_ord long, scope string, kind string, first int, last int, anchors array<int>, texts array<string>, sizes array<int>, whole array<boolean>"


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Lines first to last of the spans, joined where they touch or overlap."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def rendered(lines: list[str], first: int, last: int, spans: list[tuple[int, int]], anchors: set[int]) -> tuple[str, bool]:
    """Numbered lines of the cover, matches marked, with counts of what is left out between first and last; and whether nothing is."""
    out, at, whole = [], first, True
    for a, b in covered(spans):
        if a > at:
            out.append(f"… (+{a - at} lines)")
            whole = False
        out += [f"{'>' if n in anchors else ' '} {n}: {lines[n - 1]}" for n in range(a, b + 1)]
        at = b + 1
    if at <= last:
        out.append(f"… (+{last - at + 1} lines)")
        whole = False
    return "\n".join(out), whole


def _levels(file: str, lines: list[str], name: str | None, first: int, last: int, signature: tuple[int, int] | None, anchors: set[int], around: int) -> tuple[list[str], list[bool]]:
    head = f"{file}:{first}-{last}" + (f" {name}" if name else "")
    near = [(max(first, n - around), min(last, n + around)) for n in anchors]
    top = [signature] if signature else []
    forms = [[(first, last)] if signature and last - first < SMALL else near + top, near + top, [(n, n) for n in anchors] + top]
    told = [rendered(lines, first, last, spans, anchors) for spans in forms]
    return [*(f"{head}\n{text}" for text, _ in told), head], [*(whole for _, whole in told), False]


def of_file(file: str, content: bytes, anchors: list[int], around: int = AROUND) -> Iterator[tuple]:
    """The chunks of a file: scope, kind, first and last line, anchors, texts of all levels, whether they leave nothing out."""
    t = Text(content)
    lines, count = [shown(x) for x in t.text.split("\n")], len(t.lines)
    nest = lexers.Nest(lexers.scopes(t.text, file))
    scopes: dict[lexers.Scope, set[int]] = {}
    loose: list[int] = []
    for n in sorted({n for n in anchors if 1 <= n <= count}):
        begin = t.lines[n - 1]
        s = nest.innermost(begin + len(lines[n - 1]) - len(lines[n - 1].lstrip()))
        if s:
            scopes.setdefault(s, set()).add(n)
        else:
            loose.append(n)
    for s, own in scopes.items():
        first, last = t.line(s.start), t.line(s.end - 1)
        texts, whole = _levels(file, lines, s.name, first, last, (first, t.line(s.body)), own, around)
        yield s.name, s.kind, first, last, sorted(own), texts, whole
    for first, last in covered([(max(1, n - around), min(count, n + around)) for n in loose]):
        own = {n for n in loose if first <= n <= last}
        texts, whole = _levels(file, lines, None, first, last, None, own, around)
        yield None, None, first, last, sorted(own), texts, whole


def chunks(corpus: Corpus, rows: DataFrame, around: int = AROUND) -> DataFrame:
    """Chunks of the places in rows (file, line): file, walk_ord, scope, kind, first, last, anchors, and by level texts, sizes (bytes) and whether the text is whole. Each file is read once."""
    wanted = rows.groupBy("file").agg(F.collect_set(F.col("line").cast("int")).alias("lines"))
    joined = wanted.join(corpus.df.filter("content is not null"), "file").select("file", "content", "walk_ord", "lines")

    def run(batches):
        for batch in batches:
            out = []
            for file, content, at, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(file, at, *found[:5], found[5], [len(x.encode()) + 1 for x in found[5]], found[6]) for found in of_file(file, content, lines, around)]
            columns = list(zip(*out, strict=True)) or [[]] * len(FIELDS)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)], names=[n for n, _ in FIELDS])

    return joined.mapInArrow(run, SCHEMA)


@dataclass
class Packed:
    """Texts in order with the level of each, bytes used, and how many chunks have no place; complete if every chunk is there and leaves nothing out."""

    texts: list[str]
    levels: list[int]
    used: int
    omitted: int
    complete: bool


def pack(found: DataFrame, order: list, budget: int) -> Packed:
    """Chunks in order within the budget: each at the fullest of the levels 1 to 3 that fits, then the first ones are raised to level 0 with what is left.

    Chunks come to the driver in order, a partition at a time, until nothing more can fit.
    """
    smallest = F.get("sizes", F.lit(LEVELS - 1))
    some = found.filter(smallest <= budget).orderBy(*order).select("texts", "sizes", "whole")
    held, used = [], 0
    for r in some.toLocalIterator():
        level = next((k for k in range(1, LEVELS) if used + r.sizes[k] <= budget), None)
        if level is not None:
            held.append([r, level])
            used += r.sizes[level]
        if budget - used < LEAST:
            break
    for x in held:
        r, level = x
        while level and used - r.sizes[level] + r.sizes[level - 1] <= budget:
            used += r.sizes[level - 1] - r.sizes[level]
            level -= 1
        x[1] = level
    omitted = found.count() - len(held)
    return Packed([r.texts[k] for r, k in held], [k for _, k in held], used, omitted, omitted == 0 and all(r.whole[k] for r, k in held))
