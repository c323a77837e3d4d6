"""Filters over match rows, all as windows and joins that share one partitioning by file."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.errors import QueryError
from textloom.operators import order


def _near(rows: DataFrame, a: str, b: str, lines: int) -> Column:
    """Per row: other rows of b within so many lines."""
    w = Window.partitionBy("file").orderBy("line").rangeBetween(-lines, lines)
    n = F.sum((F.col("pattern_id") == b).cast("int")).over(w)
    return n - F.lit(1 if a == b else 0)


def near(rows: DataFrame, a: str, b: str, lines: int) -> DataFrame:
    """Keeps a's rows that have some row of b within so many lines (a itself does not count); other patterns' rows stay."""
    return relations(rows, [("near", a, b, lines)])


def far(rows: DataFrame, a: str, b: str, lines: int) -> DataFrame:
    return relations(rows, [("far", a, b, lines)])


def relations(rows: DataFrame, asked: list[tuple]) -> DataFrame:
    """All relations at once, each against the rows before any filter: (near|far, a, b, lines), (same_scope|not_same_scope, a, b)."""
    keep, flagged = F.lit(True), rows
    for i, (kind, a, b, *more) in enumerate(asked):
        name = f"__r{i}"
        if kind in ("near", "far"):
            flagged = flagged.withColumn(name, _near(rows, a, b, more[0]) > 0)
            ok = F.col(name) if kind == "near" else ~F.col(name)
        elif kind in ("same_scope", "not_same_scope"):
            w = Window.partitionBy("file", F.col("enclosing.from"), F.col("enclosing.to"))
            n = F.sum((F.col("pattern_id") == b).cast("int")).over(w) - (1 if a == b else 0)
            flagged = flagged.withColumn(name, F.col("enclosing").isNotNull() & (n > 0))
            ok = F.col(name) if kind == "same_scope" else ~F.col(name)
        else:
            raise QueryError(f"unknown relation {kind}")
        keep &= (F.col("pattern_id") != a) | ok
    return flagged.filter(keep).select(*rows.columns)


def in_scope(rows: DataFrame, scopes: DataFrame, name: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows inside any region whose name holds a match of the pattern and whose kind is the one asked for.

    One sweep over each file: beginnings and ends of regions and rows in order, with the number of regions that are open. Rows and regions do not meet in pairs.
    """
    wanted = scopes
    if name is not None:
        wanted = wanted.filter(F.col("name").rlike(name))
    if kind is not None:
        wanted = wanted.filter(F.col("kind") == kind)
    points = rows.select("file", F.col("from").alias("at"), F.lit(2).alias("kind"), F.lit(0).alias("step"), F.struct("*").alias("row"))
    none = F.lit(None).cast(points.schema["row"].dataType)
    # at one place, regions end first, then others begin, then rows stand
    ends = wanted.select("file", F.explode(F.array(F.struct(F.col("from").alias("at"), F.lit(1).alias("kind"), F.lit(1).alias("step")), F.struct(F.col("to").alias("at"), F.lit(0).alias("kind"), F.lit(-1).alias("step")))).alias("e"))
    swept = points.unionByName(ends.select("file", "e.at", "e.kind", "e.step", none.alias("row")))
    opened = F.sum("step").over(Window.partitionBy("file").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return swept.withColumn("open", opened).filter("kind = 2 and open > 0").select("row.*")


def lines(rows: DataFrame, spec: str) -> DataFrame:
    """Rows whose line is in one of the comma-separated N, A:B, A: and :B."""
    keep = F.lit(False)
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d*)(:?)(\d*)\s*", part)
        if not m or not (m[1] or m[3]):
            raise QueryError(f"bad line range {part!r}")
        low, high = int(m[1] or 1), int(m[3]) if m[3] else None if m[2] else int(m[1])
        if high is not None and high < low:
            raise QueryError(f"bad line range {part!r}")
        keep |= (F.col("line") >= low) & (F.lit(True) if high is None else F.col("line") <= high)
    return rows.filter(keep)


def added_lines(rows: DataFrame, added: DataFrame) -> DataFrame:
    """Rows whose line is among (file, line)."""
    return rows.join(added.select("file", "line").distinct(), ["file", "line"], "left_semi")


def per_file_cap(rows: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("file").orderBy("from", "pattern_index")
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= most).drop("__n")


ORDER = ("walk_ord", "from", "pattern_index")


def first_rows(rows: DataFrame, most: int) -> DataFrame:
    """The first rows in scan order (top-k, no full sort)."""
    return rows.orderBy(*ORDER).limit(most)


def byte_budget(rows: DataFrame, most: int, text: Column) -> DataFrame:
    """Rows in scan order, over all files, until the bytes of `text` and its line end have reached the budget (the row that reaches it is the last).

    The sums run over ranges of the order, so no task sees more than a range.
    """
    return order.running(rows, list(ORDER), F.octet_length(text) + 1, "__before").filter(F.col("__before") < most).drop("__before")


# --- a condition over whole files

TOKEN = re.compile(r"\s*(?:(\()|(\))|(&&|\|\||!(?!=))|(==|!=|<=|>=|<|>|=)|(\d+)|(\"[^\"]*\"|'[^']*')|([A-Za-z_][\w.-]*))")


class FileWhere:
    """`A AND NOT B`, `count(p) >= 3`, `churn(30) > 2`, `lang == go`; &&, || and ! too; parentheses up to 256 deep."""

    def __init__(self, text: str, patterns: list[str]):
        self.patterns, self.tokens, at = patterns, [], 0
        self.counted: set[str] = set()
        self.churns: set[int] = set()
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"unexpected {text[at:].strip()[:20]!r}")
            self.tokens.append((m.lastindex, m.group(m.lastindex)))
            at = m.end()
        self.at = 0
        self.column = self._either(0)
        if self.at < len(self.tokens):
            raise QueryError(f"unexpected {self.tokens[self.at][1]!r}")

    def _next(self, *words: str) -> bool:
        if self.at < len(self.tokens) and self.tokens[self.at][1].upper() in words and self.tokens[self.at][0] != 6:
            self.at += 1
            return True
        return False

    def _either(self, depth: int) -> Column:
        out = self._both(depth)
        while self._next("OR", "||"):
            out |= self._both(depth)
        return out

    def _both(self, depth: int) -> Column:
        out = self._one(depth)
        while self._next("AND", "&&"):
            out &= self._one(depth)
        return out

    def _one(self, depth: int) -> Column:
        if depth > 256:
            raise QueryError("condition nests too deep")
        if self._next("NOT", "!"):
            return ~self._one(depth + 1)
        if self._next("("):
            out = self._either(depth + 1)
            if not self._next(")"):
                raise QueryError("missing )")
            return out
        kind, word = self._take()
        if kind not in (5, 7):
            raise QueryError(f"unexpected {word!r}")
        if word in ("count", "churn") and self._next("("):
            _, inner = self._take()
            if not self._next(")"):
                raise QueryError("missing )")
            value = self._count(inner) if word == "count" else self._churn(inner)
            return self._compare(value)
        if word == "lang":
            _, op = self._take()
            _, name = self._take()
            if op not in ("==", "=", "!="):
                raise QueryError("lang is compared by == or !=")
            same = F.col("language") == name.strip("\"'")
            return ~same if op == "!=" else same
        return self._count(word) > 0

    def _take(self) -> tuple[int, str]:
        if self.at >= len(self.tokens):
            raise QueryError("condition ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def _count(self, name: str) -> Column:
        if name not in self.patterns:
            if not (name.isdigit() and int(name) < len(self.patterns)):
                raise QueryError(f"unknown pattern {name}")
            name = self.patterns[int(name)]
        self.counted.add(name)
        return F.coalesce(F.col(f"`n_{name}`"), F.lit(0))

    def _churn(self, days: str) -> Column:
        if not days.isdigit():
            raise QueryError("churn(days) takes a number")
        self.churns.add(int(days))
        return F.coalesce(F.col(f"churn_{days}"), F.lit(0))

    def _compare(self, value: Column) -> Column:
        _, op = self._take()
        kind, n = self._take()
        if kind != 5:
            raise QueryError("a number is needed")
        n = int(n)
        return {"==": value == n, "=": value == n, "!=": value != n, "<": value < n, "<=": value <= n, ">": value > n, ">=": value >= n}[op]

    def files(self, corpus: DataFrame, rows: DataFrame, churn: dict[int, DataFrame] | None = None) -> DataFrame:
        """Files (with language) for which the condition holds; files without any match are judged too."""
        counts = [F.count(F.when(F.col("pattern_id") == p, 1)).alias(f"n_{p}") for p in sorted(self.counted)]
        found = corpus.select("file", "walk_ord", "language")
        if counts:
            found = found.join(rows.groupBy("file").agg(*counts), "file", "left")
        for days in sorted(self.churns):
            found = found.join((churn or {})[days].select("file", F.col("n").alias(f"churn_{days}")), "file", "left")
        return found.filter(self.column).select("file", "walk_ord", "language")


def file_where(corpus: DataFrame, rows: DataFrame, condition: str, patterns: list[str], churn: dict[int, DataFrame] | None = None) -> DataFrame:
    """Match rows of the files for which the condition holds."""
    return rows.join(FileWhere(condition, patterns).files(corpus, rows, churn).select("file"), "file", "left_semi")
