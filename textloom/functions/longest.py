"""Leftmost-longest search for patterns on which greedy search may stop short: a set-of-states machine over Python's parse tree."""

from __future__ import annotations

import re
import re._constants as C
from collections.abc import Iterator


class Span:
    __slots__ = ("_end", "_start", "_text")

    def __init__(self, text: str, start: int, end: int):
        self._text, self._start, self._end = text, start, end

    def start(self) -> int:
        return self._start

    def end(self) -> int:
        return self._end

    def group(self) -> str:
        return self._text[self._start : self._end]


class Longest:
    """States are numbers; edges[s] lists (test, target), where a test takes a character; jumps[s] lists (assertion or None, target)."""

    def __init__(self, tree, flags: int):
        self.flags = flags
        self.edges: list[list] = []
        self.jumps: list[list] = []
        self.begin = self._state()
        self.end = self._sequence(list(tree), self.begin)
        self.moves: dict = {}
        self.starts = self._starts()

    def _starts(self) -> re.Pattern:
        """Where a match may begin: characters that some edge out of the first states takes (of those that are not ASCII, all), after a word boundary if every match needs one."""
        jumps, edges, bound = self.jumps[self.begin], self.edges[self.begin], ""
        if not edges and len(jumps) == 1 and jumps[0][0] is C.AT_BOUNDARY:
            bound = r"\b"
        seen, todo = {self.begin}, [self.begin]
        while todo:
            for _, to in self.jumps[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        tests = [test for s in seen for test, _ in self.edges[s]]
        first = [c for c in map(chr, range(128)) if any(test(c) for test in tests)]
        return re.compile(f"{bound}[{''.join(map(re.escape, first))}\x80-\U0010ffff]", self.flags & re.A)

    def _state(self) -> int:
        self.edges.append([])
        self.jumps.append([])
        return len(self.edges) - 1

    def _test(self, op, av):
        fold = bool(self.flags & re.I)
        flags = self.flags & (re.I | re.A | re.S)
        if op is C.ANY:
            return (lambda c: True) if self.flags & re.S else (lambda c: c != "\n")
        if op in (C.LITERAL, C.NOT_LITERAL):
            want, same = chr(av), op is C.LITERAL
            if fold:
                rx = re.compile(re.escape(want), flags)
                return lambda c: (rx.fullmatch(c) is not None) == same
            return lambda c: (c == want) == same
        rx = re.compile(_class(av), flags)
        return lambda c: rx.fullmatch(c) is not None

    def _sequence(self, items: list, at: int) -> int:
        for op, av in items:
            if op in (C.LITERAL, C.NOT_LITERAL, C.ANY, C.IN):
                to = self._state()
                self.edges[at].append((self._test(op, av), to))
                at = to
            elif op is C.AT:
                to = self._state()
                self.jumps[at].append((av, to))
                at = to
            elif op is C.SUBPATTERN:
                at = self._sequence(list(av[3]), at)
            elif op is C.BRANCH:
                to = self._state()
                for branch in av[1]:
                    self.jumps[self._sequence(list(branch), self._fork(at))].append((None, to))
                at = to
            else:  # a repeat, greedy or lazy alike
                low, high, inner = av
                for _ in range(low):
                    at = self._sequence(list(inner), at)
                to = self._state()
                if high is C.MAXREPEAT:
                    loop = self._fork(at)
                    self.jumps[self._sequence(list(inner), loop)].append((None, loop))
                    self.jumps[loop].append((None, to))
                else:
                    for _ in range(high - low):
                        self.jumps[at].append((None, to))
                        at = self._sequence(list(inner), at)
                    self.jumps[at].append((None, to))
                at = to
        return at

    def _fork(self, at: int) -> int:
        to = self._state()
        self.jumps[at].append((None, to))
        return to

    def _kind(self, c: str) -> int:
        if not c:
            return 0
        if c == "\n":
            return 1
        return 2 if c == "_" or (c.isalnum() and (c.isascii() or not self.flags & re.A)) else 3

    def _closed(self, states: frozenset[int], before: int, after: int, last: bool) -> frozenset[int]:
        key = (states, before, after, last)
        if (found := self.moves.get(key)) is None:
            seen, todo = set(states), list(states)
            while todo:
                for when, to in self.jumps[todo.pop()]:
                    if to not in seen and (when is None or _holds(when, before, after, last)):
                        seen.add(to)
                        todo.append(to)
            found = self.moves[key] = frozenset(seen)
        return found

    def _longest(self, text: str, start: int) -> int:
        kinds, best, at, n = self._kind, -1, start, len(text)
        before = kinds(text[start - 1]) if start else 0
        states = frozenset((self.begin,))
        while states:
            after = kinds(text[at]) if at < n else 0
            states = self._closed(states, before, after, at == n)
            if self.end in states and at > start:
                best = at
            if at == n:
                break
            c = text[at]
            key = (states, c)
            if (to := self.moves.get(key)) is None:
                to = self.moves[key] = frozenset(t for s in states for test, t in self.edges[s] if test(c))
                if len(self.moves) > 50_000:
                    self.moves.clear()
            states, before, at = to, after, at + 1
        return best

    def match(self, text: str, at: int) -> Span | None:
        end = self._longest(text, at)
        return Span(text, at, end) if end > at else None

    def finditer(self, text: str) -> Iterator[Span]:
        at = 0
        while (found := self.starts.search(text, at)) is not None:
            at = found.start()
            end = self._longest(text, at)
            if end > at:
                yield Span(text, at, end)
                at = end
            else:
                at += 1


def _holds(when, before: int, after: int, last: bool) -> bool:
    if when is C.AT_BEGINNING:
        return before in (0, 1)
    if when is C.AT_END:
        return after in (0, 1)
    if when is C.AT_BEGINNING_STRING:
        return before == 0
    if when is C.AT_END_STRING:
        return last
    return ((before == 2) != (after == 2)) == (when is C.AT_BOUNDARY)


CLASSES = {C.CATEGORY_DIGIT: r"\d", C.CATEGORY_NOT_DIGIT: r"\D", C.CATEGORY_SPACE: r"\s", C.CATEGORY_NOT_SPACE: r"\S", C.CATEGORY_WORD: r"\w", C.CATEGORY_NOT_WORD: r"\W"}


def _class(items) -> str:
    out = []
    for kind, v in items:
        if kind is C.NEGATE:
            out.append("^")
        elif kind is C.LITERAL:
            out.append(re.escape(chr(v)))
        elif kind is C.RANGE:
            out.append(f"{re.escape(chr(v[0]))}-{re.escape(chr(v[1]))}")
        else:
            out.append(CLASSES[v])
    return f"[{''.join(out)}]"
