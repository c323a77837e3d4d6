"""One automaton for all patterns.

Of every pattern's parse tree a required factor is taken: texts of which each match holds one, and how far from the match's start it stands. All factors of all patterns are the words of one Aho-Corasick
automaton, which reads a text once, however many patterns there are. A pattern that is a literal (with or without word boundaries) is found by that alone; one whose factor has a place is tried only at
the starts which that leaves; one whose factor may stand anywhere searches only texts that have it; the rest search every text. The hits are those of a search for each pattern in turn.

The same factors tell which texts need not be read at all (`required`).
"""

from __future__ import annotations

import re
import re._constants as C
from collections.abc import Sequence
from dataclasses import dataclass

from textloom.functions import lexers
from textloom.functions.patterns import REPEATS, Pattern

#: Texts of one factor, and starts to try for one of its places; beyond these a factor is of no use, or is one without a place.
MOST, STARTS = 64, 64
#: Factors that a native filter asks for at most.
ASKED = 32


@dataclass(frozen=True)
class Factor:
    """texts: every match holds one of them, so many characters after its start (high None: anywhere). fold: they are in lower case and stand for both cases of ASCII letters."""

    texts: tuple[str, ...]
    low: int
    high: int | None
    fold: bool

    def worth(self) -> tuple:
        """Long texts and known places first."""
        least = min(map(len, self.texts))
        return min(least, 3), self.high is not None and self.high - self.low <= STARTS, least, -len(self.texts)


@dataclass(frozen=True)
class Exact:
    """A literal, and whether a word must begin and end with it."""

    text: str
    fold: bool
    begins: bool
    ends: bool


def folded(text: str) -> str:
    """ASCII letters in lower case; all places stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogateescape").lower().decode("utf-8", "surrogateescape")


def _flat(items) -> list | None:
    """The items of a sequence without plain groups; None if a group has flags of its own."""
    out = []
    for op, av in items:
        if op is C.SUBPATTERN:
            inner = None if av[1] or av[2] else _flat(av[3])
            if inner is None:
                return None
            out += inner
        elif op in REPEATS and av[0] == av[1] and av[0] <= 16 and len(av[2]) == 1 and av[2][0][0] is C.LITERAL:
            out += [av[2][0]] * av[0]
        else:
            out.append((op, av))
    return out


def _width(op, av) -> tuple[int, int | None]:
    if op is C.AT:
        return 0, 0
    if op is C.BRANCH:
        low, high = zip(*(_widths(_flat(b) or list(b)) for b in av[1]), strict=True)
        return min(low), None if None in high else max(high)
    if op is C.SUBPATTERN:
        return _widths(list(av[3]))
    if op in REPEATS:
        low, high = _widths(list(av[2]))
        return low * av[0], None if high is None or av[1] is C.MAXREPEAT else high * av[1]
    return 1, 1


def _widths(items: list) -> tuple[int, int | None]:
    low, high = 0, 0
    for op, av in items:
        a, b = _width(op, av)
        low, high = low + a, None if b is None or high is None else high + b
    return low, high


def _factors(items, fold: bool) -> list[Factor]:
    """Every factor that the sequence's items give."""
    flat = _flat(items)
    if flat is None:
        return []
    out: list[Factor] = []
    run, at = "", (0, 0)  # the literal so far, and where it began
    low, high = 0, 0

    def done() -> None:
        nonlocal run
        if run:
            out.append(Factor((folded(run) if fold else run,), *at, fold))
        run = ""

    for op, av in flat:
        if op is C.LITERAL:
            if not run:
                at = (low, high)
            run += chr(av)
        elif op is not C.AT:
            done()
            inner = None
            if op is C.BRANCH:
                each = [_best(b, fold) for b in av[1]]
                if all(each):
                    inner = Factor(tuple(dict.fromkeys(t for f in each for t in f.texts)), min(f.low for f in each), None if any(f.high is None for f in each) else max(f.high for f in each), fold)
            elif op in REPEATS and av[0]:
                inner = _best(av[2], fold)
            if inner and len(inner.texts) <= MOST:
                out.append(Factor(inner.texts, low + inner.low, None if high is None or inner.high is None else high + inner.high, fold))
        a, b = _width(op, av)
        low, high = low + a, None if b is None or high is None else high + b
    done()
    return out


def _best(items, fold: bool) -> Factor | None:
    return max(_factors(items, fold), key=Factor.worth, default=None)


def factor(pattern: Pattern) -> Factor | None:
    """The pattern's best factor. Letters whose case does not count fold as ASCII only, so there is none under Unicode's rules."""
    if pattern.case_insensitive and pattern.ucp:
        return None
    found = _best(pattern.tree, pattern.case_insensitive)
    # a single letter, digit or space is in every text
    return None if found is None or any(len(t) == 1 and (t.isalnum() or t.isspace()) for t in found.texts) else found


def exact(pattern: Pattern) -> Exact | None:
    """The pattern as a literal, if it is one."""
    if pattern.case_insensitive and pattern.ucp or pattern.ucp and pattern.word_boundary:
        return None
    items = _flat(pattern.tree) or []
    begins, ends = (len(items) > 2 and items[i] == (C.AT, C.AT_BOUNDARY) for i in (0, -1))
    body = items[begins : len(items) - ends]
    if not body or any(op is not C.LITERAL for op, _ in body) or (begins or ends) and pattern.ucp:
        return None
    text = "".join(chr(c) for _, c in body)
    return Exact(folded(text) if pattern.case_insensitive else text, pattern.case_insensitive, begins, ends)


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


class Scanner:
    """The patterns of all members, ready to read texts. It is made where it is used: automata do not travel."""

    def __init__(self, members: Sequence):
        self.members = list(members)
        self.words: dict[str, list[tuple]] = {}
        self.exact: dict[int, Exact] = {}
        self.placed: dict[int, object] = {}
        self.loose: dict[int, object] = {}
        self.rest: list[int] = []
        folds = []
        for k, m in enumerate(self.members):
            if m.ident:
                self.rest.append(k)
            elif e := exact(m.pattern):
                self.exact[k] = e
                folds.append(e.fold)
            elif f := factor(m.pattern):
                placed = f.high is not None and f.high - f.low <= STARTS
                (self.placed if placed else self.loose)[k] = f
                folds.append(f.fold)
            else:
                self.rest.append(k)
        self.fold = any(folds)
        put = lambda text, use: self.words.setdefault(folded(text) if self.fold else text, []).append(use)
        for k, e in self.exact.items():
            put(e.text, ("exact", k, e.text if self.fold and not e.fold else None, e.begins, e.ends))
        for kind, found in (("placed", self.placed), ("loose", self.loose)):
            for k, f in found.items():
                for t in f.texts:
                    put(t, (kind, k, f.low, f.high, None))
        self.automaton = None
        if self.words:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for text, uses in self.words.items():
                self.automaton.add_word(text, (len(text), uses))
            self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int]]:
        """(from, member, to) by from, then member; each member's longest, not overlapping matches."""
        out: list[tuple[int, int, int]] = []
        places: dict[int, list[tuple[int, int]]] = {}
        seen: set[int] = set()
        after: dict[int, int] = {}
        n = len(text)
        for last, (size, uses) in self.automaton.iter(folded(text) if self.fold else text) if self.automaton else ():
            end = last + 1
            start = end - size
            for kind, k, a, b, c in uses:
                if kind == "exact":
                    if start < after.get(k, 0) or a is not None and text[start:end] != a:
                        continue
                    if b and (start > 0 and _word(text[start - 1])) == _word(text[start]) or c and (end < n and _word(text[end])) == _word(text[last]):
                        continue
                    out.append((start, k, end))
                    after[k] = end
                elif kind == "placed":
                    places.setdefault(k, []).append((start - b, start - a))
                else:
                    seen.add(k)
        for k, spans in places.items():
            out += _tried(self.members[k].pattern.matcher, text, k, spans)
        for k in [*seen, *self.rest]:
            m = self.members[k]
            if m.ident:
                out += [(s, k, e) for s, e in lexers.identifiers(text) if lexers.identifier_matches(text[s:e], list(m.ident))]
            else:
                out += [(x.start(), k, x.end()) for x in m.pattern.matcher.finditer(text) if x.end() > x.start()]
        out.sort()
        return out


def _tried(matcher, text: str, k: int, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Matches that start inside the spans: at each free place in order, as a search would find them."""
    out, at = [], 0
    spans.sort()
    for low, high in spans:
        at = max(at, low)
        while at <= high:
            m = matcher.match(text, at)
            if m and m.end() > at:
                out.append((at, k, m.end()))
                at = m.end()
            else:
                at += 1
    return out


def required(members: Sequence) -> list[tuple[str, bool]] | None:
    """(text, fold): a text without any of these has no match; None if some member needs none, or if they are too many to ask for."""
    out: dict[tuple[str, bool], None] = {}
    for m in members:
        if m.ident:
            found = Factor((folded(max(m.ident, key=len)),), 0, None, True)
        elif e := exact(m.pattern):
            found = Factor((e.text,), 0, 0, e.fold)
        else:
            found = factor(m.pattern)
        if found is None:
            return None
        out |= dict.fromkeys((t, found.fold) for t in found.texts)
        if len(out) > ASKED:
            return None
    return list(out)


_SURROGATE = re.compile("[\ud800-\udfff]")


def native_filter(content, members: Sequence):
    """`required` as a condition on a column of bytes, or None."""
    from pyspark.sql import functions as F

    asked = required(members)
    if not asked or any(_SURROGATE.search(t) for t, _ in asked):
        return None
    out = F.lit(False)
    for text, fold in sorted(asked, key=lambda x: x[1]):
        # lower() may fold more than ASCII letters, which only keeps more texts; what it leaves as it is must be ASCII for that
        if fold and not text.isascii():
            return None
        out |= F.contains(F.lower(content.cast("string")), F.lit(text)) if fold else F.contains(content, F.lit(text.encode()))
    return out
