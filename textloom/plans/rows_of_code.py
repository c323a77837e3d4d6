"""Registered queries over small programs, one made of each row of a table, and over scripts' remaining actions; with their SQL twins.

A program is a text with known places, so that SQL can say where its scopes, roles and matches are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import Pattern
from textloom.operators import filters, rank, retrieve, scan, shapes
from textloom.plans.catalogue import BY_ID, RX, _script, _sql_matches, corpus, matches, query
from textloom.plans.query import run_query
from textloom.plans.script import run_script
from textloom.sources.corpus import Corpus

#: A program for each customer: two functions, a comment between them, an import and a string.
PROGRAM = ["package p\n", "import \"seg_{s}\"\n", "func first_{k}() {{\n", "  open(name_{k})\n", "  use(\"{s}\")\n", "}}\n", "// {s} stands here\n", "func second_{k}() {{\n", "  {s}(1)\n", "}}\n"]
WHERE = "'c' || c_custkey || '.go'"
SEGMENTS = Pattern("seg", "AUTOMOBILE|BUILDING|FURNITURE|HOUSEHOLD|MACHINERY")
SEG = {"id": "seg", "regexp": SEGMENTS.regexp}
NAMED = Pattern("name", "name_[0-9]+")


def _column(text: str):
    parts = [F.lit(p) if i % 2 == 0 else F.col("c_custkey").cast("string") if p == "k" else F.col("c_mktsegment") for i, p in enumerate(text.replace("{{", "\0").replace("}}", "\1").replace("{", "\2").replace("}", "\2").replace("\0", "{").replace("\1", "}").split("\2"))]
    return F.concat(*parts)


def programs(spark, sf_dir: str) -> Corpus:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    rows = rows.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(".go")).alias("file"), _column("".join(PROGRAM)).alias("text"), "c_custkey")
    return Corpus.from_table(rows, "file", "text", "c_custkey")


def found(spark, sf_dir, *patterns: Pattern, need: tuple[str, ...] = ("scope",)) -> DataFrame:
    return scan.match(programs(spark, sf_dir), list(patterns), options=scan.Options(frozenset(need)))


#: Lines with a segment's name: import 2, string 5, comment 7, call 9.
SEG_LINES = f"(SELECT {WHERE} AS file, c_custkey AS k, c_mktsegment AS s, unnest([2, 5, 7, 9]) AS line FROM customer)"
SCOPE_OF = "CASE WHEN line = 5 THEN 'first_' || k WHEN line = 9 THEN 'second_' || k END"


@query(f"SELECT {WHERE} AS file, unnest(['first_' || c_custkey, 'second_' || c_custkey]) AS name, 'func' AS kind, unnest([3, 8]) AS line_start, unnest([6, 10]) AS line_end FROM customer")
def scopes_listed(spark, sf_dir):
    return scan.list_scopes(programs(spark, sf_dir)).select("file", "name", "kind", "line_start", "line_end")


@query(f"SELECT file, line, {SCOPE_OF} AS scope FROM {SEG_LINES}")
def enclosing_scope(spark, sf_dir):
    return found(spark, sf_dir, SEGMENTS).select("file", "line", F.col("enclosing.name").alias("scope"))


@query(f"SELECT file, line, CASE line WHEN 2 THEN 'string' WHEN 5 THEN 'string' WHEN 7 THEN 'comment' END AS role FROM {SEG_LINES}")
def roles_of_matches(spark, sf_dir):
    return found(spark, sf_dir, SEGMENTS, need=("role",)).select("file", "line", "role")


@query(f"SELECT file, line FROM {SEG_LINES} WHERE line = 9")
def in_scope(spark, sf_dir):
    regions = scan.list_scopes(programs(spark, sf_dir))
    return filters.in_scope(found(spark, sf_dir, SEGMENTS, need=()), regions, "^second_", "func").select("file", "line")


@query(f"SELECT file, line FROM {SEG_LINES} WHERE line = 5")
def same_scope_filter(spark, sf_dir):
    rows = filters.relations(found(spark, sf_dir, SEGMENTS, NAMED), [("same_scope", "seg", "name")])
    return rows.filter("pattern_id = 'seg'").select("file", "line")


@query(f"SELECT file, line FROM {SEG_LINES} WHERE line IN (2, 7)")
def not_same_scope_and_near(spark, sf_dir):
    """Two relations at once, each judged on all rows: no name in the scope, but one within three lines."""
    rows = filters.relations(found(spark, sf_dir, SEGMENTS, NAMED), [("not_same_scope", "seg", "name"), ("near", "seg", "name", 3)])
    return rows.filter("pattern_id = 'seg'").select("file", "line")


@query(f"SELECT file, {SCOPE_OF} AS scope, CASE WHEN min(line) IN (5, 9) THEN min(line) ELSE 2 END AS first_line, CAST(count(*) AS BIGINT) AS matches FROM {SEG_LINES} GROUP BY file, {SCOPE_OF}")
def rollup_by_scope(spark, sf_dir):
    return shapes.rollup(found(spark, sf_dir, SEGMENTS, need=("scope", "context"))).select("file", "scope", "first_line", "matches")


def _code_query(spark, sf_dir, query_: dict) -> DataFrame:
    sets = [{"id": p.id, "scan": ["table:programs"], "scope": "auto", "patterns": [{"id": p.id, "regexp": p.regexp}]} for p in (SEGMENTS, NAMED)]
    return run_query(spark, {"version": 1, "sets": sets, "query": query_}, {"table:programs": programs(spark, sf_dir)}).df


@query(f"SELECT {WHERE} AS file, 'name_' || c_custkey AS name, c_mktsegment AS segment FROM customer")
def join_same_scope(spark, sf_dir):
    on = [{"op": "same_scope", "left": "a", "right": "b"}]
    return _code_query(spark, sf_dir, {"from": {"set": "name", "as": "a"}, "joins": [{"type": "inner", "set": "seg", "as": "b", "on": on}], "select": {"file": "a.file", "name": "a.match", "segment": "b.match"}})


@query(f"SELECT file, {SCOPE_OF} AS scope, CAST(CASE line WHEN 5 THEN 3 ELSE 8 END AS BIGINT) AS begins FROM {SEG_LINES} WHERE line IN (5, 9)")
def enclosing_fields(spark, sf_dir):
    q = {"from": {"set": "seg", "as": "a"}, "where": {"op": "is_not_null", "left": "a.enclosing.name"}, "select": {"file": "a.file", "scope": "a.enclosing.name", "begins": "a.enclosing.line_start"}}
    return _code_query(spark, sf_dir, q).withColumn("begins", F.col("begins").cast("long"))


@query("SELECT c_mktsegment AS segment, 4 * count(*) AS n, min(c_custkey) AS least FROM customer GROUP BY c_mktsegment")
def counts_by_segment(spark, sf_dir):
    rows = found(spark, sf_dir, SEGMENTS, need=())
    return rows.groupBy(F.col("match").alias("segment")).agg(F.count(F.lit(1)).alias("n"), F.min("walk_ord").alias("least"))


@query(f"SELECT {WHERE} AS file, 'go' AS language FROM customer")
def languages(spark, sf_dir):
    return programs(spark, sf_dir).languages().select("file", "language")


@query("SELECT 4 * count(*) AS n, count(DISTINCT c_mktsegment) AS kinds, 2 AS low, 9 AS high FROM customer")
def whole_aggregate(spark, sf_dir):
    select = {"n": {"count": "*"}, "kinds": {"count_distinct": "a.match"}, "low": {"min": "a.line"}, "high": {"max": "a.line"}}
    return _code_query(spark, sf_dir, {"from": {"set": "seg", "as": "a"}, "select": select}).select("n", "kinds", F.col("low").cast("int").alias("low"), F.col("high").cast("int").alias("high"))


@query(f"SELECT {WHERE} AS file, chr(10) || '  open(name_' || c_custkey || ')' || chr(10) || '  use(' || chr(34) || c_mktsegment || chr(34) || ')' || chr(10) AS inside FROM customer")
def block_of_function(spark, sf_dir):
    rows = found(spark, sf_dir, Pattern("f", "func first_[0-9]+"), need=("block",))
    return rows.select("file", F.col("block.text").alias("inside"))


@query(f"SELECT {WHERE} AS file, 4 AS lines, 3 AS first_line FROM customer")
def script_block(spark, sf_dir):
    out = [{"action": "block", "on_block": [{"action": "emit", "data": {"file": "$FILE", "lines": "$BLOCK_LINE_COUNT", "first_line": "$BLOCK_LINE_START"}}]}]
    return _script(spark, sf_dir, {"patterns": [{"id": "f", "regexp": "func first_[0-9]+", "on_match": out}]}, "file string, lines int, first_line int", programs(spark, sf_dir))


#: Paths by a part's number, and what roles they have.
PATHS = [("src/Main.go", "source"), ("a/tests/Deep.py", "test,source"), ("pkg/io_test.go", "test,source"), ("web/x.spec.ts", "test,source"), ("etc/CONFIG.yml", "config"), ("a/docs/index.html", "documentation"), ("README.md", "documentation"), ("cc/Makefile", "build"), ("a/vendor/b/tests/c.json", "test,config,generated"), ("x/testdata/in.txt", "fixture"), ("a/.github/workflows/ci.yaml", "config,build")]


@query(f"SELECT p_partkey AS k, CASE p_partkey % {len(PATHS)} {' '.join(f'WHEN {i} THEN {chr(39)}{r}{chr(39)}' for i, (_, r) in enumerate(PATHS))} END AS roles FROM part")
def file_roles(spark, sf_dir):
    path = F.get(F.array(*(F.lit(p) for p, _ in PATHS)), (F.col("p_partkey") % len(PATHS)).cast("int"))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.array_join(retrieve.file_roles(path), ",").alias("roles"))


# --- documents


@query(f"WITH {_sql_matches('mail')} SELECT file, from_ AS from_byte, regexp_extract(match, '@([a-z0-9.]+)', 1) AS host FROM m")
def submatch_host(spark, sf_dir):
    rows = matches(spark, sf_dir, "mail").select("file", "from", "match")
    return scan.submatch(rows, "match", [Pattern("host", "@[a-z0-9.]+")]).select("file", F.col("from").alias("from_byte"), F.expr("substring(sub.match, 2)").alias("host"))


@query(f"WITH {_sql_matches('mail')} SELECT file, from_ + position('@' IN match) - 1 AS at_byte FROM m")
def submatch_offsets(spark, sf_dir):
    rows = matches(spark, sf_dir, "mail").select("file", "from", "match")
    return scan.submatch(rows, "match", [Pattern("at", "@")], "from").select("file", F.col("sub.from").alias("at_byte"))


@query(f"WITH {_sql_matches('lic', 'num')} SELECT file, pattern_id, from_ AS from_byte FROM m a WHERE pattern_id <> 'num' OR (EXISTS (SELECT 1 FROM m b WHERE b.file = a.file AND b.pattern_id = 'num' AND b.from_ <> a.from_ AND abs(b.line - a.line) <= 3) AND NOT EXISTS (SELECT 1 FROM m b WHERE b.file = a.file AND b.pattern_id = 'lic' AND abs(b.line - a.line) <= 30))")
def relations_at_once(spark, sf_dir):
    rows = filters.relations(matches(spark, sf_dir, "lic", "num"), [("near", "num", "num", 3), ("far", "num", "lic", 30)])
    return rows.select("file", "pattern_id", F.col("from").alias("from_byte"))


@query(f"WITH {_sql_matches('num')}, a AS (SELECT doc_id, 1 + doc_id % 3 AS line FROM documents) SELECT file, m.line, from_ AS from_byte FROM m JOIN a USING (doc_id) WHERE m.line = a.line")
def added_lines(spark, sf_dir):
    added = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("file"), (F.col("doc_id") % 3 + 1).cast("int").alias("line"))
    return filters.added_lines(matches(spark, sf_dir, "num"), added).select("file", "line", F.col("from").alias("from_byte"))


@query("SELECT 'never' AS pattern_id")
def patterns_without_match(spark, sf_dir):
    rows = scan.match(corpus(spark, sf_dir), [BY_ID["num"], Pattern("never", "\x02\x03never")], options=scan.Options(frozenset()))
    return shapes.patterns_without_match(rows, ["num", "never"])


@query(f"WITH {_sql_matches('num', 'mail')} SELECT file, match AS text FROM m")
def matched_text(spark, sf_dir):
    return shapes.matched_text(matches(spark, sf_dir, "num", "mail", need=("block",)).withColumn("block", F.lit(None).cast("struct<full: string>"))).select("file", "text")


@query("SELECT CAST(doc_id AS VARCHAR) AS file, n, CAST(row_number() OVER (ORDER BY n DESC, doc_id) AS BIGINT) AS place FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, '[0-9]{3,}')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL) ORDER BY place LIMIT 50")
def files_by_count(spark, sf_dir):
    """A top-k report: the 50 files of most matches."""
    listed = shapes.counts(corpus(spark, sf_dir).df, matches(spark, sf_dir, "num")).withColumnRenamed("n", "count")
    top = rank.order_files(listed, "count").limit(50)
    place = F.row_number().over(rank.Window.orderBy(F.desc("count"), "walk_ord")).cast("long")
    return top.select("file", F.col("count").alias("n"), place.alias("place"))


THREE = f"WITH {_sql_matches('lic', 'num', 'mail')}, a AS (SELECT * FROM m WHERE pattern_id = 'lic'), b AS (SELECT * FROM m WHERE pattern_id = 'num'), c AS (SELECT * FROM m WHERE pattern_id = 'mail')"


@query(f"{THREE} SELECT b.file AS file, b.match AS number, c.match AS mail, a.match AS word FROM b JOIN c ON b.file = c.file AND b.to_ <= c.from_ LEFT JOIN a ON a.file = c.file AND abs(a.line - c.line) <= 2")
def join_three_sets(spark, sf_dir):
    sets = [{"id": i, "scan": ["table:documents"], "patterns": [{"id": i, "regexp": BY_ID[i].regexp, "case_insensitive": BY_ID[i].case_insensitive}]} for i in ("lic", "num", "mail")]
    joins = [{"type": "inner", "set": "mail", "as": "c", "on": [{"op": "before", "left": "b", "right": "c"}]}, {"type": "left", "set": "lic", "as": "a", "on": [{"op": "within_lines", "left": "c", "right": "a", "lines": 2}]}]
    q = {"from": {"set": "num", "as": "b"}, "joins": joins, "select": {"file": "b.file", "number": "b.match", "mail": "c.match", "word": "a.match"}}
    return run_query(spark, {"version": 1, "sets": sets, "query": q}, {"table:documents": corpus(spark, sf_dir)}).df


# --- scripts

NUMBERS = f"WITH {_sql_matches('num')}"


@query(f"{NUMBERS}, f AS (SELECT file, count(*) AS n, CAST(sum(line) AS BIGINT) AS total FROM m GROUP BY file) SELECT file, n, total, 3 * n AS thrice, total // 2 AS half, total - n AS less FROM f")
def script_arithmetic(spark, sf_dir):
    every = [{"action": "increment", "var": "n"}, {"action": "add", "var": "total", "value": "$LINE"}]
    made = [{"action": "set", "var": "thrice", "value": "$n"}, {"action": "multiply", "var": "thrice", "value": 3}, {"action": "set", "var": "half", "value": "$total"}, {"action": "divide", "var": "half", "value": 2}, {"action": "set", "var": "less", "value": "$total"}, {"action": "subtract", "var": "less", "value": "$n"}]
    names = ("n", "total", "thrice", "half", "less")
    end = [{"action": "if", "condition": {"op": "gt", "args": ["$n", 0]}, "then": [*made, {"action": "emit", "data": {"file": "$FILE"} | {x: f"${x}" for x in names}}]}, {"action": "reset", "vars": list(names)}]
    doc = {"variables": {x: {"type": "int"} for x in names}, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": every}], "on_file_end": end}
    return _script(spark, sf_dir, doc, "file string, n long, total long, thrice long, half long, less long")


@query(f"{NUMBERS} SELECT file || ':' || line || ' ' || match AS text FROM m")
def script_print(spark, sf_dir):
    doc = {"patterns": [{"id": "num", "regexp": RX["num"], "on_match": [{"action": "print", "value": "$FILE:$LINE $MATCH"}]}]}
    return run_script(spark, doc, corpus(spark, sf_dir)).rows.select(F.col("line").alias("text"))


@query(f"{NUMBERS} SELECT file, count(*) AS n, count(DISTINCT match) AS kinds FROM m GROUP BY file")
def script_lists(spark, sf_dir):
    every = [{"action": "append", "target": "all", "value": "$MATCH"}, {"action": "unique_append", "target": "kinds", "value": "$MATCH"}]
    count = lambda var, to: {"action": "for_each", "var": var, "as": "x", "do": [{"action": "increment", "var": to}]}
    end = [count("all", "n"), count("kinds", "k"), {"action": "if", "condition": {"op": "gt", "args": ["$n", 0]}, "then": [{"action": "emit", "data": {"file": "$FILE", "n": "$n", "kinds": "$k"}}]}, {"action": "reset", "vars": ["all", "kinds", "n", "k"]}]
    doc = {"variables": {"all": {"type": "list"}, "kinds": {"type": "list"}, "n": {"type": "int"}, "k": {"type": "int"}}, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": every}], "on_file_end": end}
    return _script(spark, sf_dir, doc, "file string, n long, kinds long")


@query(f"WITH {_sql_matches('num', 'loud')}, s AS (SELECT file, list_sort(list(DISTINCT substr(match, 1, 1)) FILTER (pattern_id = 'num')) AS x, list_sort(list(DISTINCT substr(match, 1, 1)) FILTER (pattern_id = 'loud')) AS y FROM m GROUP BY file) SELECT file, CAST(len(list_distinct(coalesce(x, []) || coalesce(y, []))) AS BIGINT) AS either FROM s")
def script_set_union(spark, sf_dir):
    first = lambda target: [{"action": "submatch", "text": "$MATCH", "patterns": [{"id": "c", "regexp": "^.", "on_match": [{"action": "unique_append", "target": target, "value": "$MATCH"}]}]}]
    end = [{"action": "set_union", "target": "z", "a": "x", "b": "y"}, {"action": "for_each", "var": "z", "as": "v", "do": [{"action": "increment", "var": "n"}]}, {"action": "if", "condition": {"op": "gt", "args": ["$n", 0]}, "then": [{"action": "emit", "data": {"file": "$FILE", "either": "$n"}}]}, {"action": "reset", "vars": ["x", "y", "z", "n"]}]
    doc = {"variables": {"x": {"type": "list"}, "y": {"type": "list"}, "z": {"type": "list"}, "n": {"type": "int"}}, "patterns": [{"id": i, "regexp": RX[i], "on_match": first(t)} for i, t in (("num", "x"), ("loud", "y"))], "on_file_end": end}
    return _script(spark, sf_dir, doc, "file string, either long")


@query(f"WITH {_sql_matches('mail')} SELECT file, regexp_extract(match, '@([a-z0-9.]+)', 1) AS host, from_ + position('@' IN match) - 1 AS at_byte FROM m")
def script_submatch(spark, sf_dir):
    inner = {"id": "h", "regexp": "@(?P<host>[a-z0-9.]+)", "extract": ["host"], "on_match": [{"action": "emit", "data": {"file": "$FILE", "host": "$EXTRACT_HOST", "at_byte": "$FROM"}}]}
    doc = {"patterns": [{"id": "mail", "regexp": RX["mail"], "on_match": [{"action": "submatch", "text": "$MATCH", "patterns": [inner]}]}]}
    return _script(spark, sf_dir, doc, "file string, host string, at_byte long")


@query(f"WITH {_sql_matches('lic', 'num')} SELECT file, line, match AS number FROM m a WHERE pattern_id = 'num' AND EXISTS (SELECT 1 FROM m b WHERE b.file = a.file AND b.pattern_id = 'lic' AND abs(b.line - a.line) <= 10)")
def script_relations(spark, sf_dir):
    out = [{"action": "emit", "data": {"file": "$FILE", "line": "$LINE", "number": "$MATCH"}}]
    patterns = [{"id": "lic", "regexp": "license", "case_insensitive": True, "on_match": []}, {"id": "num", "regexp": RX["num"], "on_match": out}]
    return _script(spark, sf_dir, {"relations": [{"kind": "near", "a": "num", "b": "lic", "lines": 10}], "patterns": patterns}, "file string, line int, number string")


@query(f"{NUMBERS} SELECT file, from_ AS start FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY from_) AS r FROM m) WHERE r <= 2")
def script_limit_per_file(spark, sf_dir):
    doc = {"limit_per_file": 2, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": [{"action": "emit", "data": {"file": "$FILE", "start": "$FROM"}}]}]}
    return _script(spark, sf_dir, doc, "file string, start long")


@query(f"{NUMBERS}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY from_) AS j, row_number() OVER (ORDER BY doc_id, from_) AS r FROM m), k AS (SELECT *, greatest(0, 15 - (r - j)) AS out FROM f) SELECT file, from_ AS start FROM k WHERE j > out AND j <= out + 2")
def script_skip_and_limit(spark, sf_dir):
    """Two rows of each file after the first fifteen of all."""
    doc = {"skip": 15, "limit_per_file": 2, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": [{"action": "emit", "data": {"file": "$FILE", "start": "$FROM"}}]}]}
    return _script(spark, sf_dir, doc, "file string, start long")


@query(f"""{NUMBERS}, f AS (SELECT *, strlen('{{"file":"' || file || '","start":' || from_ || '}}') + 1 AS size FROM m), k AS (SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id, from_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f) SELECT file, from_ AS start FROM k WHERE before < 5000""")
def script_output_budget(spark, sf_dir):
    """Rows until 5,000 bytes of output are reached."""
    doc = {"max_output_bytes": 5000, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": [{"action": "emit", "data": {"file": "$FILE", "start": "$FROM"}}]}]}
    return _script(spark, sf_dir, doc, "file string, start long")


@query(f"{NUMBERS} SELECT file, from_ AS start FROM m ORDER BY doc_id, from_ LIMIT 40 OFFSET 15")
def script_page(spark, sf_dir):
    doc = {"skip": 15, "limit": 40, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": [{"action": "emit", "data": {"file": "$FILE", "start": "$FROM"}}]}]}
    return _script(spark, sf_dir, doc, "file string, start long")


@query(f"{NUMBERS}, f AS (SELECT file, min(from_) FILTER (TRY_CAST(match AS DOUBLE) < 200) AS stop FROM m GROUP BY file) SELECT m.file, from_ AS start FROM m JOIN f ON f.file = m.file WHERE stop IS NULL OR from_ < stop")
def script_stop(spark, sf_dir):
    out = [{"action": "if", "condition": {"op": "lt", "args": ["$MATCH", 200]}, "then": [{"action": "stop"}]}, {"action": "emit", "data": {"file": "$FILE", "start": "$FROM"}}]
    return _script(spark, sf_dir, {"patterns": [{"id": "num", "regexp": RX["num"], "on_match": out}]}, "file string, start long")


@query(f"{NUMBERS} SELECT match AS number, CAST(count(DISTINCT file) AS BIGINT) AS files FROM m GROUP BY match")
def script_map_lists(spark, sf_dir):
    count = [{"action": "set", "var": "n", "value": 0}, {"action": "for_each", "var": "v", "as": "x", "do": [{"action": "increment", "var": "n"}]}, {"action": "emit", "data": {"number": "$k", "files": "$n"}}]
    doc = {"variables": {"by": {"type": "map"}, "n": {"type": "int"}, "v": {"type": "list"}}, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": [{"action": "map_unique_append", "target": "by", "key": "$MATCH", "value": "$FILE"}]}], "on_complete": [{"action": "for_each", "var": "by", "key_as": "k", "as": "v", "do": count}]}
    return _script(spark, sf_dir, doc, "number string, files long")


@query(f"SELECT file, {SCOPE_OF} AS scope, line FROM {SEG_LINES} WHERE line IN (5, 9)")
def script_enclosing(spark, sf_dir):
    out = [{"action": "if", "condition": {"op": "ne", "args": ["$ENCLOSING_NAME", ""]}, "then": [{"action": "emit", "data": {"file": "$FILE", "scope": "$ENCLOSING_NAME", "line": "$LINE"}}]}]
    return _script(spark, sf_dir, {"scope": "auto", "patterns": [SEG | {"on_match": out}]}, "file string, scope string, line int", programs(spark, sf_dir))


@query("SELECT 'summary' AS type, count(text) AS files_scanned, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes_scanned, CAST(sum(len(regexp_extract_all(text, '[0-9]{3,}'))) AS BIGINT) AS emitted, true AS complete FROM documents")
def script_summary(spark, sf_dir):
    doc = {"summary": True, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": [{"action": "emit", "data": {"n": "$MATCH"}}]}]}
    return _script(spark, sf_dir, doc, "type string, files_scanned long, bytes_scanned long, emitted long, complete boolean").filter("type = 'summary'")
