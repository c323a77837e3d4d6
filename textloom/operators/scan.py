"""The multi-pattern scan: one pass over the corpus, every hit a row.

All patterns of all sets are matched in one mapInArrow by one automaton (`functions/automaton.py`); texts that lack every pattern's required factor are left out by a native filter before they reach Python.
A set is a filter on set_id. Lines, scopes and roles are computed for texts with hits only, and only if asked for
(`need`), because neither filters nor column pruning reach through Python.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions import lexers
from textloom.functions.automaton import Scanner, native_filter
from textloom.functions.patterns import Pattern, numbered
from textloom.sources.corpus import Corpus

ENCLOSING = pa.struct([("name", pa.string()), ("kind", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("line_start", pa.int32()), ("line_end", pa.int32())])
BLOCK = pa.struct([("text", pa.string()), ("full", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("line_start", pa.int32()), ("line_end", pa.int32())])
FIELDS = [
    ("walk_ord", pa.int64()), ("file", pa.string()), ("language", pa.string()), ("set_id", pa.string()), ("pattern_id", pa.string()), ("pattern_index", pa.int32()),
    ("from", pa.int64()), ("to", pa.int64()), ("line", pa.int32()), ("column", pa.int32()), ("match", pa.string()), ("context", pa.string()),
    ("captures", pa.map_(pa.string(), pa.string())), ("enclosing", ENCLOSING), ("role", pa.string()), ("block", BLOCK), ("derived_value", pa.string()), ("occurrence", pa.string()), ("cut", pa.list_(pa.string())),
]
CONTEXT = [n for n, _ in FIELDS].index("context")
SCHEMA = (
    "walk_ord long, file string, language string, set_id string, pattern_id string, pattern_index int, `from` long, `to` long, line int, `column` int, match string, context string, captures map<string,string>, "
    "enclosing struct<name: string, kind: string, `from`: long, `to`: long, line_start: int, line_end: int>, role string, block struct<text: string, full: string, start: long, `end`: long, line_start: int, line_end: int>, derived_value string, occurrence string, cut array<string>"
)


@dataclass(frozen=True)
class Member:
    """A pattern in its set; index is its number within the set."""

    pattern: Pattern
    set_id: str = ""
    index: int = 0
    derived: str = ""
    ident: tuple[str, ...] = ()


class Text:
    """A text with its byte offsets and lines; bytes that are no UTF-8 are kept."""

    def __init__(self, content: bytes):
        self.text = content.decode("utf-8", "surrogateescape")
        self.ascii = len(self.text) == len(content)
        self._bytes: list[int] | None = None
        self._lines: list[int] | None = None

    def byte(self, at: int) -> int:
        if self.ascii:
            return at
        if self._bytes is None:
            total, self._bytes = 0, [0]
            for c in self.text:
                o = ord(c)
                total += 1 if o < 128 or 0xDC80 <= o <= 0xDCFF else 2 if o < 0x800 else 3 if o < 0x10000 else 4
                self._bytes.append(total)
        return self._bytes[at]

    @property
    def lines(self) -> list[int]:
        """Where each line begins."""
        if self._lines is None:
            self._lines, at = [0], self.text.find("\n")
            while at >= 0:
                self._lines.append(at + 1)
                at = self.text.find("\n", at + 1)
        return self._lines

    def line(self, at: int) -> int:
        return bisect_right(self.lines, at)

    def line_text(self, first: int, last: int | None = None) -> str:
        """Text of lines first to last, from 1, without the last line end."""
        last = min(last or first, len(self.lines))
        first = max(1, first)
        end = self.lines[last] - 1 if last < len(self.lines) else len(self.text)
        return self.text[self.lines[first - 1] : end]


def shown(text: str) -> str:
    """A text whose stray bytes became U+FFFD, as a string column needs."""
    return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def truncated(text: str, most: int | None) -> str:
    """At most so many bytes, cut between code points."""
    if most is None:
        return text
    data = text.encode("utf-8", "surrogateescape")
    return text if len(data) <= most else data[:most].decode("utf-8", "ignore")


@dataclass(frozen=True)
class Options:
    need: frozenset[str] = frozenset(("context", "captures"))  # also: scope, role, block, occurrence
    scope: str = "auto"
    custom_scope: tuple[str, str, str, str] | None = None
    before: int = 0
    after: int = 0
    block_open: str = "{"
    block_close: str = "}"
    max_match: int | None = None
    max_context: int | None = None
    max_block: int | None = None


@lru_cache(maxsize=64)
def _scanner(members: tuple[Member, ...]) -> Scanner:
    return Scanner(members)


def hits(text: str, members: Sequence[Member]) -> list[tuple[int, int, int]]:
    """(from, member, to) by from, then member; each member's longest, not overlapping matches."""
    return _scanner(tuple(members)).hits(text)


def rows_of(file: str, content: bytes, walk_ord: int, members: Sequence[Member], o: Options, find: Callable[[str], list[tuple[int, int, int]]]) -> Iterator[tuple]:
    """Match rows of a text: find gives (from, member, to)."""
    t = Text(content)
    found = find(t.text)
    if not found:
        return
    text, need = t.text, o.need
    forms = lexers.forms(file)
    kinds = lexers.roles(text, forms) if forms and need & {"role", "occurrence", "block"} else None
    regions = lexers.Nest(lexers.scopes(text, file, o.custom_scope, o.scope, kinds) if need & {"scope", "role", "occurrence"} else ())
    lang = lexers.language(file)
    for s, k, e in found:
        m, line = members[k], t.line(s)
        match = text[s:e]
        scope = regions.innermost(s)
        block, cut = None, []

        def within(kind: str, x: str, most: int | None) -> str:
            """The text within its bytes; what does not fit is told in `cut`."""
            out = truncated(x, most)
            if len(out) < len(x):
                cut.append(kind)  # noqa: B023  of this match
            return shown(out)

        match_text = within("match", match, o.max_match)
        context = within("context", t.line_text(line - o.before, line + o.after), o.max_context) if "context" in need else None
        if "block" in need and (b := lexers.block(text, s, o.block_open, o.block_close, kinds if o.block_open == "{" else None)):
            inside = text[b[0] + len(o.block_open) : b[1]]
            block = {"text": within("block", inside, o.max_block), "full": within("block_full", text[s : b[2]], o.max_block), "start": t.byte(b[0]), "end": t.byte(b[2]), "line_start": t.line(b[0]), "line_end": t.line(b[2] - 1)}
        yield (
            walk_ord, file, lang, m.set_id, m.pattern.id, m.index, t.byte(s), t.byte(e), line, t.byte(s) - t.byte(t.lines[line - 1]) + 1,
            match_text, context,
            list(m.pattern.captures(match).items()) if "captures" in need else None,
            {"name": scope.name, "kind": scope.kind, "from": t.byte(scope.start), "to": t.byte(scope.end), "line_start": t.line(scope.start), "line_end": t.line(scope.end - 1)} if scope else None,
            lexers.role(text, kinds, regions, s, e) if "role" in need else None,
            block, m.derived, lexers.occurrence(text, kinds, regions, s, e)[0] if "occurrence" in need else None, cut or None,
        )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.nulls(len(c), k) if c.count(None) == len(c) else pa.array(c, k) for c, (_, k) in zip(columns, FIELDS, strict=True)], names=[n for n, _ in FIELDS])


def _batches(rows: Iterator[tuple], most: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of bounded rows and, as every match of a long line has that line as its context, bounded text."""
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += len(row[CONTEXT] or "") + len(row[CONTEXT - 1])
        if len(held) >= most or letters >= size:
            yield _batch(held)
            held, letters = [], 0
    yield _batch(held)


def _run(members: Sequence[Member], options: Options):
    def rows(batches):
        find = Scanner(members).hits
        for batch in batches:
            for file, content, at in zip(*(batch.column(i) for i in range(3)), strict=True):
                yield from rows_of(file.as_py(), content.as_py(), at.as_py(), members, options, find)

    return lambda batches: _batches(rows(batches))


def match_members(corpus: Corpus, members: Sequence[Member], options: Options = Options()) -> DataFrame:
    wanted = native_filter(F.col("content"), members)
    some = corpus.df.filter(F.col("content").isNotNull() if wanted is None else wanted)
    return Corpus(some).spread().select("file", "content", "walk_ord").mapInArrow(_run(members, options), SCHEMA)


WORD = r"[A-Za-z0-9_]+"


def match_words(corpus: Corpus, words: DataFrame, set_id: str, options: Options = Options()) -> DataFrame:
    """Match rows of whole words, however many: words (value, index) meet the texts' words in a join, and only texts that hold one are read, each for its own words."""
    texts = corpus.df.filter(F.col("content").isNotNull()).select("file", "content", "walk_ord")
    held = texts.select("file", "walk_ord", F.explode(F.array_distinct(F.regexp_extract_all(F.col("content").cast("string"), F.lit(WORD), F.lit(0)))).alias("value"))
    wanted = held.join(words, "value").groupBy("file", "walk_ord").agg(F.collect_list(F.struct("value", "index")).alias("words"))
    token = re.compile(WORD)

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                asked = batch.column(3)[i].as_py()
                members = [Member(Pattern(f"derived{w['index']}", ""), set_id, w["index"], w["value"]) for w in asked]
                place = {w["value"]: k for k, w in enumerate(asked)}
                find = lambda text: [(m.start(), place[m[0]], m.end()) for m in token.finditer(text) if m[0] in place]  # noqa: B023, E731
                yield from rows_of(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), members, options, find)

    return texts.join(wanted, ["file", "walk_ord"]).select("file", "content", "walk_ord", "words").mapInArrow(lambda batches: _batches(rows(batches)), SCHEMA)


def match(corpus: Corpus, patterns: Iterable[Pattern], idents: Iterable[Sequence[str]] = (), set_id: str = "", options: Options = Options()) -> DataFrame:
    """Match rows of patterns and of identifier groups (ident0, ident1, ...; every group's terms all occur), which come last."""
    checked = numbered(list(patterns))
    members = [Member(p, set_id, i) for i, p in enumerate(checked)]
    members += [Member(Pattern(f"ident{i}", ""), set_id, len(checked) + i, ident=tuple(terms)) for i, terms in enumerate(idents)]
    return match_members(corpus, members, options)


def submatch(df: DataFrame, text: str, patterns: Iterable[Pattern], base: str | None = None) -> DataFrame:
    """Patterns over a text column: df's columns with sub (pattern_id, from, to, match). base: a column of the text's own byte offset, added to from and to."""
    checked = numbered(list(patterns))
    members = [Member(p, "", i) for i, p in enumerate(checked)]
    schema = df.select("*", F.lit(None).cast("struct<pattern_id: string, `from`: long, `to`: long, match: string>").alias("sub")).schema
    kind = pa.struct([("pattern_id", pa.string()), ("from", pa.int64()), ("to", pa.int64()), ("match", pa.string())])
    at, offset = df.columns.index(text), df.columns.index(base) if base else None

    def run(batches):
        find = Scanner(members).hits
        for batch in batches:
            take, subs = [], []
            for i, x in enumerate(batch.column(at).to_pylist()):
                if x is None:
                    continue
                t = Text(x.encode())
                shift = batch.column(offset)[i].as_py() if offset is not None else 0
                for s, k, e in find(t.text):
                    take.append(i)
                    subs.append({"pattern_id": members[k].pattern.id, "from": t.byte(s) + shift, "to": t.byte(e) + shift, "match": t.text[s:e]})
            picked = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(subs, kind)], names=[*batch.schema.names, "sub"])

    return df.mapInArrow(run, schema)


SCOPES = "walk_ord long, file string, name string, kind string, line_start int, line_end int, `from` long, `to` long"


def parts(batch: pa.RecordBatch, most: int = 256) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of some rows, so that as Python's objects only a piece of it stands in memory at once."""
    for at in range(0, batch.num_rows, most):
        yield batch.slice(at, most)


def list_scopes(corpus: Corpus, scope: str = "auto", custom: tuple[str, str, str, str] | None = None) -> DataFrame:
    """Every named region of every text."""

    def run(batches):
        for batch in (p for b in batches for p in parts(b, 1024)):
            rows = []
            for file, content, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                t = Text(content)
                rows += [(at, file, s.name, s.kind, t.line(s.start), t.line(s.end - 1), t.byte(s.start), t.byte(s.end)) for s in lexers.scopes(t.text, file, custom, scope)]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["walk_ord", "file", "name", "kind", "line_start", "line_end", "from", "to"])

    return corpus.spread().select("file", "content", "walk_ord").mapInArrow(run, SCOPES)
