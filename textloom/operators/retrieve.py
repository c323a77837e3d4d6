"""Budgeted retrieval in two scans: seeds, then the identifiers found next to them; ranked files, categories and a byte budget."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import lexers
from textloom.functions.patterns import Pattern, escape
from textloom.operators import chunks, rank, references, scan
from textloom.sources.corpus import Corpus
from textloom.sources.shared import kept

CATEGORIES = ("seed_implementation", "related_helper", "caller", "associated_test", "configuration", "documentation", "other")
STOP_WORDS = frozenset("if else for while return func function fn def class struct enum import package const var let int string bool void auto static public private protected new delete this self nil null none true false error err the and or not in of to is".split())
RELATED, NAME_CHARS, AROUND = 64, 80, 2
# For each role, what a lower-cased path holds or ends with.
ROLES = {
    "test": (("/test/", "/tests/", "/spec/", ".test.", ".spec."), ("_test.go",)),
    "config": (("/config/", "/configs/"), (".json", ".yaml", ".yml", ".toml", ".ini", ".env")),
    "documentation": (("/docs/", "/doc/"), (".md", ".rst")),
    "build": (("/build/", "/.github/workflows/"), ("makefile", "cmakelists.txt", ".mk")),
    "generated": (("/generated/", "/vendor/", "/node_modules/"), (".generated.go",)),
    "fixture": (("/fixture/", "/fixtures/", "/testdata/"), ()),
}


@dataclass
class Report:
    """summary and evidence rows that fit the budget, in order; what was left out is counted."""

    summary: dict
    evidence: list[dict]
    files: list[dict]
    related: list[dict]
    sources: chunks.Packed | None = None

    def lines(self) -> list[str]:
        return [json.dumps(x, ensure_ascii=False) for x in (self.summary, *self.evidence, *self.files, *self.related)]


def seeds(corpus: Corpus, names: list[str]) -> DataFrame:
    """Whole-word matches of the seeds with scope, role and a guess at what each occurrence is."""
    patterns = [Pattern(f"s{i}", escape(n), word_boundary=True) for i, n in enumerate(names)]
    return scan.match(corpus, patterns, options=scan.Options(frozenset(("context", "scope", "role", "occurrence")), before=AROUND, after=AROUND))


def file_roles(path: Column) -> Column:
    """All roles of a path, in fixed order, in native expressions; a path with none, or a test alone, is source too."""
    low, tests = F.lower(path), {}
    for role, (inside, ends) in ROLES.items():
        test = F.lit(False)
        for x in inside:
            test |= F.contains(low, F.lit(x))
        for x in ends:
            test |= F.endswith(low, F.lit(x))
        tests[role] = test
    found = F.array_compact(F.array(*(F.when(t, F.lit(r)) for r, t in tests.items())))
    return F.when((F.size(found) == 0) | (found == F.array(F.lit("test"))), F.concat(found, F.array(F.lit("source")))).otherwise(found)


def categorised(rows: DataFrame) -> DataFrame:
    """Rows with file_role (the first of the file's roles) and category."""
    rows = rows.withColumn("file_role", F.get(file_roles(F.col("file")), F.lit(0)))
    definition = F.col("occurrence") == "probable_definition"
    seed = F.col("pattern_id").startswith("s")
    category = (
        F.when(F.col("file_role") == "test", "associated_test").when(F.col("file_role") == "config", "configuration").when(F.col("file_role") == "documentation", "documentation")
        .when(seed & definition, "seed_implementation").when(~seed & definition, "related_helper").when(seed & (F.col("occurrence") == "call_or_reference"), "caller").otherwise("other")
    )
    return rows.withColumn("category", category)


def candidates(corpus: Corpus, rows: DataFrame, names: list[str], most: int = RELATED) -> list[str]:
    """Identifiers in the seeds' definitions or next to their matches: by how many scopes, windows and files they share."""
    spans = rows.filter(F.col("role").isNull() | ~F.col("role").isin("comment", "string")).select("file", "pattern_id", (F.col("occurrence") == "probable_definition").alias("inside"), "enclosing", "line", "context")
    near = spans.select("file", "inside", F.explode(F.regexp_extract_all("context", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    bodies = spans.filter("inside and enclosing is not null").select("file", "enclosing.line_start", "enclosing.line_end").distinct()
    lines = corpus.lines()
    body = lines.join(bodies, "file").filter("line between line_start and line_end").select("file", F.lit(True).alias("inside"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name"))
    found = near.unionByName(body).filter((F.length("name") > 2) & (F.length("name") <= NAME_CHARS) & ~F.col("name").isin(list(STOP_WORDS | set(names))))
    scored = found.groupBy("name").agg((4 * F.sum(F.col("inside").cast("int")) + 2 * F.count(F.lit(1)) + F.count_distinct("file")).alias("score"))
    return [r.name for r in scored.orderBy(F.desc("score"), "name").limit(most).collect()]


def investigate(spark: SparkSession, corpus: Corpus, names: list[str], budget: int = 65_536, examples: int = 3, top_files: int = 10, related: int = RELATED, source_budget: int = 0) -> Report:
    """Seeds, then one scan for related identifiers; examples of each category in fair turns, packed into the byte budget. source_budget: bytes of source chunks around the examples, beside it."""
    first = kept(categorised(seeds(corpus, names)), "seeds")
    more = candidates(corpus, first, names, related)
    patterns = [Pattern(f"r{i}", escape(n), word_boundary=True) for i, n in enumerate(more)]
    options = scan.Options(frozenset(("context", "scope", "role", "occurrence")), before=AROUND, after=AROUND)
    second = categorised(scan.match(corpus, patterns, options=options)) if patterns else first.limit(0)
    every = first.unionByName(second.filter("occurrence = 'probable_definition'"))
    turn = Window.partitionBy("category", "pattern_id").orderBy(F.desc(F.col("occurrence") == "probable_definition"), "walk_ord", "from")
    order = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    picked = every.withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= examples).orderBy(order, "turn", "walk_ord", "from").limit(examples * len(CATEGORIES) * (len(names) + len(more)))
    counts = corpus.df.select("file", F.size(F.split(F.col("content").cast("string"), "\n")).alias("line_count"))
    ranked = rank.files(first, counts, len(names), use_surprise=True, rich=True).orderBy(F.desc("score"), F.desc("density"), "file").limit(top_files).collect()
    used, evidence, left_out, shown = 0, [], 0, set()
    for r in picked.toLocalIterator():
        e = r.enclosing
        key = (r.file, e.name, e.line_start) if e else (r.file, r.line)
        if key in shown:
            continue
        row = {"type": "evidence", "category": r.category, "file": r.file, "line": r.line, "pattern": r.pattern_id, "scope": e.name if e else None, "text": r.context}
        size = len(json.dumps(row, ensure_ascii=False).encode()) + 1
        if used + size > budget:
            left_out += 1
            continue
        used += size
        shown.add(key)
        evidence.append(row)
    status = {c: "found" if any(x["category"] == c for x in evidence) else "none" for c in CATEGORIES}
    summary = {"type": "summary", "seeds": names, "categories": status, "left_out": left_out, "complete": left_out == 0, "bytes": used}
    sources = None
    if source_budget and evidence:
        places = spark.createDataFrame([(i, x["file"], x["line"]) for i, x in enumerate(evidence)], "turn int, file string, line int")
        turns = places.groupBy("file").agg(F.min("turn").alias("turn"))
        sources = chunks.pack(chunks.chunks(corpus, places).join(turns, "file"), ["turn", "first"], source_budget)
        summary |= {"source_complete": sources.complete, "source_omitted": sources.omitted}
    return Report(summary, evidence, [{"type": "file", "file": r.file, "score": round(r.score, 6), "matched": r.matched_patterns} for r in ranked], [{"type": "related", "name": n} for n in more], sources)


def budget_pack(rows: DataFrame, ranked: DataFrame, budget: int, most_files: int = 10_000) -> tuple[list[str], list[str]]:
    """Text of files in score order within a byte budget: whole, else one line for each file, else dropped (named in the second list).

    Greedy packing depends on order, so it runs on the driver, over the rows of at most `most_files` files as they stream in.
    """
    out, dropped, used = [], [], 0
    order = ranked.orderBy(F.desc("score"), F.desc("density"), "file").limit(most_files)
    texts = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "context"))).alias("lines"))
    for r in order.join(texts, "file").orderBy(F.desc("score"), F.desc("density"), "file").toLocalIterator():
        full = "\n".join([r.file, *(f"  {x.line}: {x.context}" for x in r.lines)])
        compact = f"{r.file} ({len(r.lines)} matches)"
        for text in (full, compact):
            if used + len(text.encode()) + 1 <= budget:
                out.append(text)
                used += len(text.encode()) + 1
                break
        else:
            dropped.append(r.file)
    return out, dropped


__all__ = ["Report", "budget_pack", "candidates", "categorised", "investigate", "references", "seeds"]
