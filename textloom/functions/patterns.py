"""Patterns: checks, literals, whole words, rule packs, and which of them Python's own search answers rightly.

A match is the longest one at its leftmost start, and matches of one pattern do not overlap. Python's search prefers the first alternative and
lazy quantifiers; `greedy_is_longest` tells for which patterns that makes no difference. All others go to `longest.Longest`.
"""

from __future__ import annotations

import json
import re
import re._constants as C
import re._parser as parser
from dataclasses import dataclass, fields, replace
from functools import cached_property

from textloom.errors import QueryError

IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*\Z")
META = frozenset("\\^$.[]|()?*+{}")


@dataclass(frozen=True)
class Pattern:
    id: str
    regexp: str
    case_insensitive: bool = False
    word_boundary: bool = False
    utf8: bool = True
    ucp: bool = False
    weight: float = 1.0
    description: str = ""
    extract: tuple[str, ...] = ()

    def __reduce__(self):
        return Pattern, tuple(getattr(self, f.name) for f in fields(self))  # parsed forms are made again where they are used

    @cached_property
    def source(self) -> str:
        body = self.regexp.replace(r"\z", r"\Z")
        return rf"\b(?:{body})\b" if self.word_boundary else body

    @cached_property
    def flags(self) -> int:
        return re.M | (re.I if self.case_insensitive else 0) | (0 if self.ucp else re.A)

    @cached_property
    def tree(self):
        try:
            return parser.parse(self.source, self.flags)
        except re.error as e:
            raise QueryError(f"pattern {self.id}: {e}") from e

    def check(self) -> Pattern:
        """The pattern itself, or an error: no lookaround, back reference, atomic group, and no empty match."""
        _supported(self.tree, self.id)
        if self.tree.getwidth()[0] == 0:
            raise QueryError(f"pattern {self.id} can match the empty string")
        return self

    @cached_property
    def safe(self) -> bool:
        return greedy_is_longest(self.tree)

    @cached_property
    def matcher(self):
        """An object with finditer(text) whose matches have start() and end()."""
        if self.safe:
            return re.compile(self.source, self.flags)
        from textloom.functions.longest import Longest

        return Longest(self.tree, self.flags)

    @cached_property
    def capturing(self) -> re.Pattern:
        return re.compile(self.regexp.replace(r"\z", r"\Z"), self.flags)

    def captures(self, match: str, most: int = 4096) -> dict[str, str]:
        """Declared captures, by search inside the match; groups without part in it, and matches over `most` bytes, give empty strings."""
        if not self.extract:
            return {}
        found = self.capturing.search(match) if len(match.encode("utf-8", "surrogateescape")) <= most else None
        groups = found.groups("") if found else ()
        return {name: groups[i] if i < len(groups) else "" for i, name in enumerate(self.extract)}


def literal(id: str, text: str, **options) -> Pattern:
    return Pattern(id, escape(text), **options)


def escape(text: str) -> str:
    return "".join(f"\\{c}" if c in META else c for c in text)


def numbered(patterns: list[Pattern]) -> list[Pattern]:
    """Patterns without an id are p0, p1, ...; ids must be unique identifiers."""
    out = [p if p.id else replace(p, id=f"p{i}") for i, p in enumerate(patterns)]
    ids = [p.id for p in out]
    if len(set(ids)) < len(ids):
        raise QueryError("duplicate pattern id")
    return [p.check() for p in out]


def resolve(patterns: list[Pattern], name: str) -> int:
    """An id, or else a number from zero."""
    for i, p in enumerate(patterns):
        if p.id == name:
            return i
    if name.isdigit() and int(name) < len(patterns):
        return int(name)
    raise QueryError(f"unknown pattern {name}")


RULE_FIELDS = frozenset(("id", "regexp", "literal", "description", "case_insensitive", "word_boundary", "utf8", "ref"))


def rule_pack(text: str) -> list[Pattern]:
    """Patterns from JSON lines; blank lines and lines that begin with # are none."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        try:
            rule = json.loads(line)
        except ValueError as e:
            raise QueryError(f"rule {n}: {e}") from e
        if unknown := set(rule) - RULE_FIELDS:
            raise QueryError(f"rule {n}: unknown field {min(unknown)}")
        if ("regexp" in rule) == ("literal" in rule):
            raise QueryError(f"rule {n} needs exactly one of regexp and literal")
        out.append(Pattern(rule.get("id", ""), rule.get("regexp") or escape(rule["literal"]), rule.get("case_insensitive", False), rule.get("word_boundary", False), rule.get("utf8", True), description=rule.get("description", "")))
    return out


# --- which patterns are safe

REPEATS = (C.MAX_REPEAT, C.MIN_REPEAT)


def _supported(tree, name: str) -> None:
    for op, av in tree:
        if op in (C.ASSERT, C.ASSERT_NOT, C.GROUPREF, C.GROUPREF_EXISTS, C.ATOMIC_GROUP, C.POSSESSIVE_REPEAT):
            raise QueryError(f"pattern {name}: {str(op).lower()} is not supported")
        if op in REPEATS:
            _supported(av[2], name)
        elif op is C.BRANCH:
            for branch in av[1]:
                _supported(branch, name)
        elif op is C.SUBPATTERN:
            _supported(av[3], name)


def _shape(tree) -> tuple[int, bool]:
    """How many parts have no fixed width, and whether any is lazy or a branch of different widths."""
    loose, odd = 0, False
    for op, av in tree:
        if op in REPEATS:
            inner, inner_odd = _shape(av[2])
            lazy = op is C.MIN_REPEAT and av[0] != av[1]
            odd |= inner_odd or lazy
            loose += (av[0] != av[1]) + 2 * (inner > 0)
        elif op is C.BRANCH:
            widths = {b.getwidth() for b in av[1]}
            odd |= len(widths) > 1 or any(a != b for a, b in widths) or any(_shape(b)[1] for b in av[1])
        elif op is C.SUBPATTERN:
            inner, inner_odd = _shape(av[3])
            loose, odd = loose + inner, odd or inner_odd
    return loose, odd


EVERY = frozenset(range(129))  # the ASCII characters, and 128 for all others
WORD = frozenset(i for i in range(128) if chr(i).isalnum() or i == 95)
CATEGORY = {C.CATEGORY_DIGIT: frozenset(range(48, 58)), C.CATEGORY_SPACE: frozenset(map(ord, " \t\n\r\f\v")), C.CATEGORY_WORD: WORD}
CATEGORY |= {getattr(C, str(k).replace("CATEGORY_", "CATEGORY_NOT_")): EVERY - v for k, v in list(CATEGORY.items())}


def _one(op, av) -> frozenset[int] | None:
    """Characters of a node that is one character wide."""
    if op is C.LITERAL:
        c = min(av, 128)
        return frozenset((c, ord(chr(c).swapcase()))) if c < 128 else frozenset((128,))
    if op is C.NOT_LITERAL or op is C.ANY:
        return EVERY
    if op is C.IN:
        out: set[int] = set()
        for kind, v in av:
            if kind is C.NEGATE:
                return EVERY
            if kind is C.LITERAL:
                out |= _one(C.LITERAL, v)
            elif kind is C.RANGE:
                for x in range(min(v[0], 128), min(v[1], 128) + 1):
                    out |= _one(C.LITERAL, x)
            elif kind is C.CATEGORY:
                out |= CATEGORY.get(v, EVERY) | {128}
        return frozenset(out)
    return None


def _first(items: list, after: frozenset[int]) -> frozenset[int]:
    """Characters that can come next."""
    out: set[int] = set()
    for op, av in items:
        if (one := _one(op, av)) is not None:
            return frozenset(out | one)
        if op is C.AT:
            continue
        if op in REPEATS:
            out |= _first(list(av[2]), frozenset())
            if av[0]:
                return frozenset(out)
        elif op is C.SUBPATTERN:
            out |= _first(list(av[3]), frozenset())
            if av[3].getwidth()[0]:
                return frozenset(out)
        else:
            return EVERY
    return frozenset(out | after)


def greedy_is_longest(tree) -> bool:
    """True only if the first greedy match surely is the longest: at most one part of open width, or every repeated character differs from what may follow."""
    loose, odd = _shape(tree)
    if odd:
        return False
    if loose <= 1:
        return True

    def disjoint(items: list, after: frozenset[int]) -> bool:
        for i, (op, av) in enumerate(items):
            follow = _first(items[i + 1 :], after)
            if op in REPEATS and av[0] != av[1]:
                inner = list(av[2])
                one = _one(*inner[0]) if len(inner) == 1 else None
                if one is None or one & follow:
                    return False
            elif op is C.SUBPATTERN and not disjoint(list(av[3]), follow):
                return False
            elif op is C.BRANCH or op in REPEATS and _shape(av[2])[0]:
                return False
        return True

    return disjoint(list(tree), frozenset())
