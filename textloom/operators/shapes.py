"""What a search returns: files, counts, absences, co-occurrence, rollups, templates and text records."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from textloom.functions.patterns import Pattern
from textloom.sources.corpus import Corpus


def files_with_match(rows: DataFrame) -> DataFrame:
    return rows.groupBy("file").agg(F.min("walk_ord").alias("walk_ord"))


def counts(corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """Every scanned file and its number of matches, also 0."""
    n = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return corpus.select("file", "walk_ord").join(n, "file", "left").select("file", "walk_ord", F.coalesce("n", F.lit(0)).alias("n"))


def absent_files(corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """Files without any match."""
    return corpus.select("file", "walk_ord").join(rows.select("file"), "file", "left_anti")


def absent_lines(lines: DataFrame, rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Each line with text, and each pattern of which no match begins on it."""
    asked = lines.filter(F.length("text") > 0).select("file", "walk_ord", "line", F.col("text").alias("record"), F.explode(F.array(*map(F.lit, patterns))).alias("pattern_id"))
    return asked.join(rows.select("file", "line", "pattern_id"), ["file", "line", "pattern_id"], "left_anti")


def absent_patterns(corpus: DataFrame, rows: DataFrame, patterns: list[str]) -> DataFrame:
    """Each file and each pattern that has no match in it."""
    asked = corpus.select("file", "walk_ord", F.explode(F.array(*map(F.lit, patterns))).alias("pattern_id"))
    return asked.join(rows.select("file", "pattern_id"), ["file", "pattern_id"], "left_anti")


def patterns_without_match(rows: DataFrame, patterns: list[str]) -> DataFrame:
    asked = rows.sparkSession.createDataFrame([(p,) for p in patterns], "pattern_id string")
    return asked.join(rows.select("pattern_id").distinct(), "pattern_id", "left_anti")


def files_per_pattern(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pattern_id").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("matches"))


def co_occurrence(rows: DataFrame) -> DataFrame:
    """Files with two patterns or more, and which."""
    return rows.groupBy("file").agg(F.min("walk_ord").alias("walk_ord"), F.sort_array(F.collect_set("pattern_id")).alias("patterns")).filter(F.size("patterns") >= 2)


def rollup(rows: DataFrame) -> DataFrame:
    """By file and innermost scope: matches of each pattern, the first line as a sample, and the scope's place."""
    scope = [F.col("enclosing.name").alias("scope"), F.col("enclosing.kind").alias("kind"), F.col("enclosing.line_start").alias("line_start"), F.col("enclosing.line_end").alias("line_end")]
    keyed = rows.select("file", "walk_ord", "pattern_id", "from", "line", "context", *scope)
    by_pattern = keyed.groupBy("file", "walk_ord", "scope", "kind", "line_start", "line_end", "pattern_id").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("from", "line", "context"), "from").alias("first"))
    return by_pattern.groupBy("file", "walk_ord", "scope", "kind", "line_start", "line_end").agg(
        F.sum("n").alias("matches"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("pattern_id", "n")))).alias("counts"), F.min_by("first.line", "first.from").alias("first_line"), F.min_by("first.context", "first.from").alias("sample")
    )


def matched_text(rows: DataFrame) -> DataFrame:
    """The matched text, or the whole block where one was asked for."""
    return rows.select("walk_ord", "file", "from", "pattern_index", F.coalesce("block.full", "match").alias("text"))


def record(rows: DataFrame) -> DataFrame:
    """One JSON line for each match, fields in fixed order, nulls left out."""
    fields = ["file", F.col("pattern_id").alias("pat"), "line", F.col("column").alias("col"), "from", "to", "match", "context", F.col("block.text").alias("block"), F.col("block.full").alias("block_full"), *(F.col(f"block.{c}").alias(f"block_{c}") for c in ("start", "end", "line_start", "line_end"))]
    fields += [F.when(F.array_contains("cut", k), True).alias(f"{k}_truncated") for k in ("match", "context", "block", "block_full")] + [F.when(F.size("cut") > 0, True).alias("truncated")]
    fields += [F.when(F.size("captures") > 0, F.col("captures")).alias("extracted"), F.when(F.col("enclosing").isNotNull(), F.struct("enclosing.name", "enclosing.kind", "enclosing.line_start", "enclosing.line_end")).alias("enclosing"), "role"]
    return rows.select("walk_ord", "from", "pattern_index", F.to_json(F.struct(*fields)).alias("json"))


# Tokens of templates and their columns.
TOKENS = {
    "FILE": "file", "PAT_ID": "pattern_id", "LINE": "line", "COL": "column", "FROM": "from", "TO": "to", "MATCH": "match", "CONTEXT": "context",
    "BLOCK": "block.text", "BLOCK_FULL": "block.full", "BLOCK_START": "block.start", "BLOCK_END": "block.end", "BLOCK_LINE_START": "block.line_start", "BLOCK_LINE_END": "block.line_end",
    "ENCLOSING_NAME": "enclosing.name", "ENCLOSING_KIND": "enclosing.kind", "ENCLOSING_LINE_START": "enclosing.line_start", "ENCLOSING_LINE_END": "enclosing.line_end", "ROLE": "role",
}


def template(text: str) -> Column:
    """A template as a column: $NAME by the longest token that fits, $EXTRACT_name a capture, \\n \\t \\\\ escapes; what is unknown stays."""
    names = "|".join(sorted(TOKENS, key=len, reverse=True))
    parts, at = [], 0
    for m in re.finditer(rf"\$EXTRACT_([A-Za-z_]\w*)|\$({names})|\\([nt\\])", text):
        if m.start() > at:
            parts.append(F.lit(text[at : m.start()]))
        if m[1]:
            parts.append(F.coalesce(F.try_element_at("captures", F.lit(m[1])), F.lit("")))
        elif m[2]:
            parts.append(F.coalesce(F.col(TOKENS[m[2]]).cast("string"), F.lit("")))
        else:
            parts.append(F.lit({"n": "\n", "t": "\t", "\\": "\\"}[m[3]]))
        at = m.end()
    parts.append(F.lit(text[at:]))
    return F.concat(*parts)


def legend(patterns: Sequence[Pattern], inputs: Sequence[str]) -> list[str]:
    """Lines that say what was asked, if any pattern has a description: a pattern's own, or else its expression."""
    if not any(p.description for p in patterns):
        return []
    flat = lambda x: re.sub("[\n\r\t]", " ", x)
    told = [f"  {p.id} — {flat(p.description) or (f'/{flat(p.regexp)}/' if p.regexp else '(ident group)')}" for p in patterns]
    return [f"query: {len(patterns)} pattern{'s' * (len(patterns) != 1)} over {', '.join(inputs)}", *told]


def tabbed(rows: DataFrame) -> tuple[str, DataFrame]:
    """A header and rows of text with tabs between cells; tabs and line ends in cells become spaces, nulls nothing, lists and maps JSON."""
    cells = []
    for name, kind in rows.dtypes:
        c = F.col(f"`{name}`")
        c = F.to_json(c) if kind.startswith(("array", "map", "struct")) else c.cast("string")
        cells.append(F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\r\n]", " "))
    return "\t".join(rows.columns), rows.select(F.concat_ws("\t", *cells).alias("text"))


def compact(rows: DataFrame) -> DataFrame:
    """Text for readers: file (once), then line, pattern, text, role and scope of each match."""
    line = F.concat(F.lit("  "), F.col("line").cast("string"), F.lit(": ["), F.col("pattern_id"), F.lit("] "), F.coalesce("context", "match"), F.coalesce(F.concat(F.lit(" ["), F.col("role"), F.lit("]")), F.lit("")), F.coalesce(F.concat(F.lit(" in "), F.col("enclosing.kind"), F.lit(" "), F.col("enclosing.name")), F.lit("")))
    first = F.row_number().over(Window.partitionBy("file").orderBy("from", "pattern_index")) == 1
    return rows.select("walk_ord", "from", "pattern_index", F.concat(F.when(first, F.concat("file", F.lit("\n"))).otherwise(""), line).alias("text"))


def elided(corpus: DataFrame, rows: DataFrame, context: int = 0) -> DataFrame:
    """Per file: the first line of each scope with a match, windows around matches (merged if at most two lines apart), what was left out, and the scope's last line."""

    def run(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table({"file": pa.array([], pa.string()), "walk_ord": pa.array([], pa.int64()), "text": pa.array([], pa.string())})
        file = left.column("file")[0].as_py()
        text = left.column("content")[0].as_py().decode("utf-8", "replace").split("\n")
        out, groups = [file], {}
        for r in right.to_pylist():
            groups.setdefault((r["first"], r["last"]), []).append(r["line"])
        for (first, last), at in sorted(groups.items()):
            want = {first, last} | {x for line in at for x in range(max(first, line - context), min(last, line + context) + 1)}
            previous = first - 1
            for n in sorted(want):
                if 0 < n - previous - 1 <= 2:
                    out += [f"  {k}: {text[k - 1]}" for k in range(previous + 1, n)]
                elif n - previous > 1:
                    out.append(f"  … (+{n - previous - 1} lines)")
                out.append(f"  {n}: {text[n - 1]}")
                previous = n
        return pa.table({"file": pa.array([file]), "walk_ord": left.column("walk_ord").slice(0, 1).combine_chunks(), "text": pa.array(["\n".join(out)])})

    need = rows.select("file", "line", F.coalesce("enclosing.line_start", "line").alias("first"), F.coalesce("enclosing.line_end", "line").alias("last")).groupBy("file")
    return corpus.select("file", "content", "walk_ord").groupBy("file").cogroup(need).applyInArrow(run, "file string, walk_ord long, text string")


class Accounting:
    """Counters of a scan that Spark takes while it runs, so that nothing is read twice: scan `corpus`, pass what is shown through `shown`, run one action on that, then ask for the `record`."""

    def __init__(self, corpus: Corpus):
        self.given, self._read, self._shown, self.limit = corpus, Observation(), Observation(), None
        size = F.octet_length("content")
        counters = F.count("content").alias("files_scanned"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes_scanned"), F.coalesce(F.max(size), F.lit(0)).alias("buffered_bytes_peak")
        self.corpus = Corpus(corpus.df.observe(self._read, *counters), corpus.missing, corpus.warnings)

    def shown(self, rows: DataFrame, limit: int | None = None) -> DataFrame:
        """rows, or the first `limit` of them in scan order."""
        self.limit = limit
        rows = rows.orderBy("walk_ord", "from", "pattern_index").limit(limit) if limit else rows
        return rows.observe(self._shown, F.count(F.lit(1)).alias("matches"), F.coalesce(F.sum(F.octet_length("match") + F.coalesce(F.octet_length("context"), F.lit(0))), F.lit(0)).alias("bytes_shown"))

    def record(self) -> dict:
        """After the action. Complete is what lost nothing to a limit, a missing path or a file that could not be read."""
        codes = {} if self.given.warnings is None else {r.code: r["count"] for r in self.given.warnings.groupBy("code").count().collect()}
        out = {"type": "summary"} | self._read.get | {"files_skipped_binary": codes.get("binary_skip", 0), "files_failed": codes.get("read_error", 0), "missing_paths": len(self.given.missing)} | self._shown.get
        stop = "limit" if self.limit and out["matches"] >= self.limit else None
        return out | {"complete": not (stop or out["files_failed"] or out["missing_paths"])} | ({"stop_reason": stop} if stop else {})


def summary(corpus: DataFrame, rows: DataFrame) -> DataFrame:
    """One row of counters, as a table of its own; `Accounting` takes them on the way."""
    scanned = corpus.agg(F.count(F.lit(1)).alias("files_scanned"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes_scanned"))
    found = rows.agg(F.count(F.lit(1)).alias("matches"), F.count_distinct("file").alias("files_matched"))
    return scanned.join(F.broadcast(found)).select(F.lit("summary").alias("type"), "*", F.lit(True).alias("complete"))
