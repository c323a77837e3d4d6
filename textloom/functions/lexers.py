"""Source code views of a text: language, comments and strings, import lines, balanced blocks, scopes, identifiers, roles.

Offsets are code points of the text; callers turn them into bytes.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heappop, heappush

# Language by suffix; scope anchors, kinds and names that are no scopes; comment, string and import forms.
LANGUAGES = {"go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hpp": "cpp", "hh": "cpp", "hxx": "cpp", "java": "java", "js": "js", "jsx": "js", "mjs": "js", "ts": "ts", "tsx": "ts"}
ANCHORS = {
    "go": (r"func\s+(?:\([^)]*\)\s+)?(\w+)\s*\(", "func", ()),
    "rust": (r"fn\s+(\w+)", "fn", ()),
    "c": (r"\b([a-zA-Z_]\w*)\s*\([^;{}]*\)\s*\{", "func", ("if", "for", "while", "switch", "return", "sizeof")),
    "cpp": (r"\b([a-zA-Z_]\w*)\s*\([^;{}]*\)\s*(?:const|noexcept|override|final|[\s])*\{", "func", ("if", "for", "while", "switch", "return", "sizeof", "catch")),
    "java": (r"\b([a-zA-Z_]\w*)\s*\([^;{}]*\)\s*(?:throws[^{]*)?\{", "method", ("if", "for", "while", "switch", "return", "catch", "synchronized")),
    "js": (r"(?:function\s+(\w+)|class\s+(\w+))", "func", ()),
    "ts": (r"(?:function\s+(\w+)|class\s+(\w+)|method\s+(\w+))", "func", ()),
}
# End of fixed values; the lexical forms below are those of the languages themselves.


@dataclass(frozen=True)
class Forms:
    line: str = "//"
    line_after_space: bool = False
    block: tuple[str, str] | None = ("/*", "*/")
    nested: bool = False
    quotes: str = "\"'"
    wide: str = ""  # quotes whose strings may hold line ends
    raw: str = ""  # quotes without escapes
    triple: bool = False
    imports: tuple[str, ...] = ()
    cpp_raw: bool = False


FORMS = {
    "go": Forms(raw="`", imports=("import ", "import (")),
    "rust": Forms(nested=True, quotes="", wide='"', imports=("use ", "extern crate ")),
    "c": Forms(imports=("#include",), cpp_raw=True),
    "java": Forms(imports=("import ",)),
    "js": Forms(wide="`", imports=("import ",)),
    "py": Forms("#", block=None, triple=True, imports=("import ", "from ")),
    "sh": Forms("#", True, block=None),
    "rb": Forms("#", block=None, imports=("require ", "require_relative ")),
    "hash": Forms("#", block=None),
}
FORMS |= {"cpp": FORMS["c"], "ts": FORMS["js"], "bash": FORMS["sh"], "yml": FORMS["hash"], "yaml": FORMS["hash"], "toml": FORMS["hash"]}


def suffix(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1] if "." in name else ""


def language(path: str) -> str:
    return LANGUAGES.get(suffix(path), "")


def forms(path: str) -> Forms | None:
    return FORMS.get(language(path) or suffix(path))


@dataclass
class Roles:
    spans: list[tuple[int, int, str]] = field(default_factory=list)
    imports: set[int] = field(default_factory=set)  # starts of import lines

    def __post_init__(self):
        self.starts = [s for s, _, _ in self.spans]

    def at(self, offset: int) -> str | None:
        k = bisect_right(self.starts, offset) - 1
        return self.spans[k][2] if k >= 0 and offset < self.spans[k][1] else None


@lru_cache(maxsize=64)
def _starters(f: Forms) -> re.Pattern:
    """What comments and strings begin with."""
    starters = [re.escape(f.line)]
    if f.block:
        starters.append(re.escape(f.block[0]))
    if f.cpp_raw:
        starters.append(r'R"[^()\\\s]{0,16}\(')
    if f.triple:
        starters += ['"""', "'''"]
    marks = f.quotes + f.wide + f.raw
    if marks:
        starters.append(f"[{re.escape(marks)}]")
    return re.compile("|".join(starters))


@lru_cache(maxsize=256)
def _stops(f: Forms, token: str) -> re.Pattern:
    """What a string that begins with the token is read up to: an escape, the token, or the line's end."""
    ends = [re.escape(token)]
    if token not in f.raw:
        ends.insert(0, r"\\")
    if len(token) != 3 and token not in f.wide + f.raw:
        ends.append("\n")
    return re.compile("|".join(ends))


def roles(text: str, f: Forms) -> Roles:
    """Comments and strings of a text, and the lines of code that import."""
    rx, spans, at, n = _starters(f), [], 0, len(text)
    while (m := rx.search(text, at)) is not None:
        s, token = m.start(), m.group()
        if token == f.line:
            if f.line_after_space and s and not text[s - 1].isspace():
                at = s + 1
                continue
            e = text.find("\n", s)
            e = n if e < 0 else e
            spans.append((s, e, "comment"))
        elif f.block and token == f.block[0]:
            e, depth = m.end(), 1
            while depth:
                close = text.find(f.block[1], e)
                again = text.find(f.block[0], e) if f.nested else -1
                if close < 0:
                    e = n
                    break
                if 0 <= again < close:
                    depth, e = depth + 1, again + len(token)
                else:
                    depth, e = depth - 1, close + len(f.block[1])
            spans.append((s, e, "comment"))
        elif token.startswith('R"') and f.cpp_raw:
            e = text.find(f"){token[2:-1]}\"", m.end())
            e = n if e < 0 else e + len(token) - 1
            spans.append((s, e, "string"))
        else:
            stops, e = _stops(f, token), m.end()
            while (stop := stops.search(text, e)) is not None:
                if stop[0] == token:
                    e = stop.end()
                    break
                if stop[0] == "\n":
                    e = stop.start()
                    break
                e = stop.end() + 1
            e = n if stop is None else e
            spans.append((s, e, "string"))
        at = max(e, s + 1)
    out = Roles(spans)
    if f.imports:
        at = 0
        for line in text.split("\n"):
            code = line.lstrip(" \t")
            begin = at + len(line) - len(code)
            if code.startswith(f.imports) and out.at(begin) is None:
                out.imports.add(at)
            at += len(line) + 1
    return out


@lru_cache(maxsize=64)
def _braces(opening: str, closing: str) -> re.Pattern:
    return re.compile(f"{re.escape(opening)}|{re.escape(closing)}" if opening != closing else re.escape(opening))


def block(text: str, start: int, opening: str, closing: str, skip: Roles | None = None) -> tuple[int, int, int] | None:
    """The first opening at or after start and what balances it: where it opens, where its inside ends, and its end. skip: comments and strings to overlook."""
    depth, begin = 0, -1
    for m in _braces(opening, closing).finditer(text, start):
        if skip is not None and skip.at(m.start()) is not None:
            continue
        if m.group() == opening and (depth == 0 or opening != closing):
            begin = m.start() if depth == 0 else begin
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                return begin, m.start(), m.end()
    return None


@dataclass(frozen=True)
class Scope:
    name: str
    kind: str
    start: int
    end: int
    body: int
    name_start: int


@lru_cache(maxsize=64)
def _anchor(regexp: str):
    """The anchor's pattern: parsed once in a process, not once for each text."""
    from textloom.functions.patterns import Pattern

    return Pattern("scope", regexp)


def scopes(text: str, path: str, custom: tuple[str, str, str, str] | None = None, lang: str = "auto", known: Roles | None = None) -> list[Scope]:
    """Named regions by start. custom: anchor pattern, opening, closing, kind. known: the text's roles, if they have been read."""
    if custom:
        anchor, opening, closing, kind = custom
        names: tuple[str, ...] = ()
    else:
        found = ANCHORS.get(language(path) if lang == "auto" else {"c++": "cpp", "cc": "cpp"}.get(lang, lang))
        if found is None:
            return []
        (anchor, kind, names), opening, closing = found, "{", "}"
    f = forms(path)
    skip = (known or roles(text, f)) if f and opening == "{" else None
    pattern, out = _anchor(anchor), []
    for m in pattern.matcher.finditer(text):
        s, e = m.start(), m.end()
        if e - s > 4096 or skip is not None and skip.at(s) is not None:
            continue
        g = pattern.capturing.search(text[s:e])
        k = next((i for i in range(1, len(g.groups()) + 1) if g.group(i)), 0) if g else 0
        name = g.group(k) if k else ""
        if name in names:
            continue
        body = block(text, e - 1 if text[s:e].endswith(opening) else s, opening, closing, skip)
        if body is None:
            continue
        begin = s
        if language(path) in ("c", "cpp") and not custom:
            begin = _signature(text, s)
        out.append(Scope(name, kind, begin, body[2], body[0], s + (g.start(k) if k else 0)))
    return out


def _signature(text: str, start: int) -> int:
    """Back over at most twelve lines to where a C-like declaration begins."""
    line = text.rfind("\n", 0, start) + 1
    for _ in range(12):
        if line == 0:
            break
        before = text.rfind("\n", 0, line - 1) + 1
        prior = text[before : line - 1].strip()
        if not prior or prior[-1] in ";{}:>)" or prior.startswith(("#", "//", "*", "/*")):
            break
        if text[line:start].strip() and re.search(r"\w\s", text[line:start]):
            break
        line = before
    return line + len(text[line:]) - len(text[line:].lstrip()) if text[line:start].strip() or line < start else start


class Nest:
    """Regions, ready to be asked for: one sweep over their ends finds the smallest one (of equal ones the first) on each stretch between two ends, so that a look-up is a bisection, however many regions a text has."""

    def __init__(self, found: Sequence[Scope]):
        self.found = found
        opened: dict[int, list[int]] = {}
        for k, s in enumerate(found):
            opened.setdefault(s.start, []).append(k)
        self.cuts = sorted({x for s in found for x in (s.start, s.end)})
        self.best: list[Scope | None] = []
        open_: list[tuple[int, int]] = []  # a heap by size, then by place; ended ones leave when they come up
        for at in self.cuts:
            for k in opened.get(at, ()):
                heappush(open_, (found[k].end - found[k].start, k))
            while open_ and found[open_[0][1]].end <= at:
                heappop(open_)
            self.best.append(found[open_[0][1]] if open_ else None)
        self.names = sorted(s.name_start for s in found)

    def __bool__(self) -> bool:
        return bool(self.found)

    def innermost(self, offset: int) -> Scope | None:
        k = bisect_right(self.cuts, offset) - 1
        return self.best[k] if k >= 0 else None

    def declares(self, start: int, end: int) -> bool:
        """Whether some region's name begins in the span."""
        return bisect_left(self.names, start) < bisect_left(self.names, end)


def innermost(found: Sequence[Scope], offset: int) -> Scope | None:
    return Nest(found).innermost(offset)


WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*", re.A)
PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", re.A)


def identifiers(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in WORD.finditer(text)]


def subtokens(identifier: str) -> list[str]:
    """Parts of an identifier: at underscores, before capitals, runs of capitals and of digits."""
    return PART.findall(identifier)


def identifier_matches(identifier: str, terms: list[str]) -> bool:
    """Every term begins, in any case, at the start of some part and runs on through the identifier's letters."""
    low, starts = identifier.lower(), [m.start() for m in PART.finditer(identifier)]
    return all(any(low.startswith(t.lower(), s) for s in starts) for t in terms)


def role(text: str, at: Roles | None, found: Nest, start: int, end: int) -> str | None:
    """comment, string, def or import, in this order; none otherwise."""
    if at is None and not found:
        return None
    if at is not None and (r := at.at(start)) is not None:
        return r
    if found.declares(start, end):
        return "def"
    if at is not None and text.rfind("\n", 0, start) + 1 in at.imports:
        return "import"
    return None


def occurrence(text: str, at: Roles | None, found: Nest, start: int, end: int) -> tuple[str, str]:
    """A guess at what an identifier's occurrence is, with low, medium or high confidence."""
    r = role(text, at, found, start, end)
    if r == "def":
        return "probable_definition", "high"
    if r == "import":
        return "import", "high"
    if r in ("comment", "string"):
        return "other", "low"
    stop = text.find("\n", end)
    after = text[end : len(text) if stop < 0 else stop].lstrip()
    before = text[text.rfind("\n", 0, start) + 1 : start]
    if re.search(r"\b(?:class|struct|enum|interface|type|def|func|fn|function|trait|impl)\s+$", before):
        return "probable_definition", "medium"
    if re.match(r"(?::=|[-+*/|&^]?=(?!=))", after):
        return "assignment", "medium"
    if re.search(r"\b(?:let|var|const|int|auto|bool|char|long|float|double|string)\s+\**$", before):
        return "declaration", "medium"
    return "call_or_reference", "medium" if after.startswith("(") else "low"
