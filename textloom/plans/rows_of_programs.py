"""Registered queries over programs of three languages, one of each row of `part`, with nested functions, and braces, quotes and names in strings and comments; with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.patterns import Pattern
from textloom.operators import filters, references, scan, shapes
from textloom.plans.catalogue import BY_ID, RX, _script, _sql_matches, corpus, query
from textloom.plans.query import run_query
from textloom.sources.corpus import Corpus

#: The programs, by p_partkey % 3; {k} is the key, {z} the size.
JS = """import x from "tok{z}"
function outer_{k}() {{
  const s = "}} tok{z} {{";
  function inner_{k}() {{
    // }} tok{z}
    tok{z}("{{")
  }}
  return inner_{k}
}}
"""
JAVA = """import a.tok{z};
class C {{
  int run_{k}(int a) {{
    String s = "{{ tok{z} }}";
    /* }} tok{z}
    */
    if (a > 0) {{ go(tok{z}); }}
    return a;
  }}
}}
"""
RUST = """use m::tok{z};
fn outer_{k}() {{
    /* {{ /* nested }} */ tok{z} */
    let s = "tok{z} }}";
    fn deep_{k}() {{
        let c = tok{z};
    }}
}}
"""
TOKEN = Pattern("tok", r"tok[0-9]+")
P = "p AS (SELECT p_partkey AS k, p_size AS z, CAST(p_partkey % 3 AS INTEGER) AS g, 'd' || p_partkey || '/m' || p_partkey || ['.js', '.java', '.rs'][CAST(p_partkey % 3 AS INTEGER) + 1] AS file FROM part)"
#: Scopes: name before the key, kind, first and last line.
SCOPES = """s AS (SELECT file, k, u.name || k AS name, u.kind AS kind, u.a AS line_start, u.b AS line_end FROM (SELECT file, k, unnest(CASE g
    WHEN 0 THEN [{'name': 'outer_', 'kind': 'func', 'a': 2, 'b': 9}, {'name': 'inner_', 'kind': 'func', 'a': 4, 'b': 7}]
    WHEN 1 THEN [{'name': 'run_', 'kind': 'method', 'a': 3, 'b': 9}]
    ELSE [{'name': 'outer_', 'kind': 'fn', 'a': 2, 'b': 8}, {'name': 'deep_', 'kind': 'fn', 'a': 5, 'b': 7}] END) AS u FROM p))"""
#: Tokens: line, role and the name of the innermost scope before the key.
TOKENS = """t AS (SELECT file, k, z, u.line AS line, u.role AS role, u.scope || k AS scope FROM (SELECT file, k, z, unnest(CASE g
    WHEN 0 THEN [{'line': 1, 'role': 'string', 'scope': NULL}, {'line': 3, 'role': 'string', 'scope': 'outer_'}, {'line': 5, 'role': 'comment', 'scope': 'inner_'}, {'line': 6, 'role': NULL, 'scope': 'inner_'}]
    WHEN 1 THEN [{'line': 1, 'role': 'import', 'scope': NULL}, {'line': 4, 'role': 'string', 'scope': 'run_'}, {'line': 5, 'role': 'comment', 'scope': 'run_'}, {'line': 7, 'role': NULL, 'scope': 'run_'}]
    ELSE [{'line': 1, 'role': 'import', 'scope': NULL}, {'line': 3, 'role': 'comment', 'scope': 'outer_'}, {'line': 4, 'role': 'string', 'scope': 'outer_'}, {'line': 6, 'role': NULL, 'scope': 'deep_'}] END) AS u FROM p))"""


def programs(spark, sf_dir: str) -> Corpus:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    text = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for g, (form, ending) in enumerate(((JS, ".js"), (JAVA, ".java"), (RUST, ".rs"))):
        mine = F.col("p_partkey") % 3 == g
        pieces = form.replace("{{", "\0").replace("}}", "\1").replace("{k}", "\2k\2").replace("{z}", "\2z\2").replace("\0", "{").replace("\1", "}").split("\2")
        filled = F.concat(*(F.lit(x) if i % 2 == 0 else F.col("p_partkey" if x == "k" else "p_size").cast("string") for i, x in enumerate(pieces)))
        text = F.when(mine, filled).otherwise(text)
        key = F.col("p_partkey").cast("string")
        name = F.when(mine, F.concat(F.lit("d"), key, F.lit("/m"), key, F.lit(ending))).otherwise(name)
    return Corpus.from_table(rows.select(name.alias("file"), text.alias("text"), "p_partkey"), "file", "text", "p_partkey")


def tokens(spark, sf_dir: str, *need: str) -> DataFrame:
    return scan.match(programs(spark, sf_dir), [TOKEN], options=scan.Options(frozenset(need)))


@query(f"WITH {P}, {SCOPES} SELECT file, name, kind, line_start, line_end FROM s")
def nested_scopes(spark, sf_dir):
    return scan.list_scopes(programs(spark, sf_dir)).select("file", "name", "kind", "line_start", "line_end")


@query(f"WITH {P}, {TOKENS} SELECT file, line, role, scope FROM t")
def nested_roles(spark, sf_dir):
    return tokens(spark, sf_dir, "scope", "role").select("file", "line", "role", F.col("enclosing.name").alias("scope"))


@query(f"WITH {P}, {SCOPES}, {TOKENS} SELECT t.file, t.line FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.file = t.file AND s.name LIKE 'outer%' AND t.line BETWEEN s.line_start AND s.line_end)")
def in_outer_scope(spark, sf_dir):
    """Any region around counts, not the innermost alone."""
    return filters.in_scope(tokens(spark, sf_dir), scan.list_scopes(programs(spark, sf_dir)), "^outer_").select("file", "line")


@query(f"WITH {P} SELECT ['js', 'java', 'rust'][g + 1] AS language, count(*) AS n FROM p GROUP BY g")
def languages_counted(spark, sf_dir):
    return programs(spark, sf_dir).languages().groupBy("language").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P}, {TOKENS} SELECT scope, CAST(count(*) AS BIGINT) AS n, string_agg(line::VARCHAR, ',' ORDER BY line) AS lines FROM t WHERE scope IS NOT NULL GROUP BY file, scope")
def grouped_by_scope(spark, sf_dir):
    """A declarative query groups by fields of the enclosing scope."""
    q = {"from": {"set": "tok", "as": "a"}, "where": {"op": "is_not_null", "left": "a.enclosing.name"}, "group_by": ["a.file", "a.enclosing.name"], "select": {"scope": "a.enclosing.name", "n": {"count": "*"}, "lines": {"collect": "a.line"}}}
    doc = {"version": 1, "sets": [{"id": "tok", "scan": ["table:programs"], "scope": "auto", "patterns": [{"id": "tok", "regexp": TOKEN.regexp}]}], "query": q}
    found = run_query(spark, doc, {"table:programs": programs(spark, sf_dir)}).df
    return found.select("scope", "n", F.array_join(F.col("lines").cast("array<string>"), ",").alias("lines"))


@query(f"WITH {P} SELECT file, ['inner_', 'run_', 'deep_'][g + 1] || k AS name FROM p UNION ALL SELECT file, 'inner_' || k FROM p WHERE g = 0")
def identifier_groups(spark, sf_dir):
    """Identifiers with a part that begins with one of some words (two groups' terms), whole."""
    found = scan.match(programs(spark, sf_dir), [], idents=[["inner"], ["run"], ["deep"]], options=scan.Options(frozenset()))
    return found.select("file", F.col("match").alias("name"))


@query(f"""WITH RECURSIVE {P}, c AS (SELECT file, k, g, CASE g WHEN 0 THEN 'import x from "tok' || z || '"' WHEN 1 THEN 'import a.tok' || z || ';' ELSE 'use m::tok' || z || ';' END AS line FROM p),
    h AS (SELECT file, line, list_reduce(list_transform(range(1, length(line) + 1), lambda i: ascii(line[i])::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT) AS h FROM c)
    SELECT file || ':1@' || right('000000' || lower(to_hex((h % 16777216)::BIGINT)), 6) AS ref FROM h""")
def line_references(spark, sf_dir):
    """References to the first lines, with their hashes."""
    first = tokens(spark, sf_dir, "context").filter("line = 1")
    return references.with_references(first).select("ref")


@query(f"WITH {P}, r AS (SELECT file, k, g, line FROM (SELECT *, unnest([2, 6, 40]) AS line FROM p)), n AS (SELECT *, [9, 10, 8][g + 1] + 1 AS n FROM r) SELECT file || ':' || line AS ref, CASE WHEN line > n THEN 'stale' ELSE 'ok' END AS status, CASE WHEN line > n THEN NULL WHEN g = 1 THEN CASE line WHEN 2 THEN 1 ELSE 3 END WHEN line = 2 THEN 2 ELSE [4, 3, 5][g + 1] END AS line_start FROM n")
def references_expanded(spark, sf_dir):
    """Three references without a hash to each file, in a table: into a scope, or around a line, or beyond the file's end."""
    c = programs(spark, sf_dir)
    refs = c.df.select(F.explode(F.transform(F.lit([2, 6, 40]), lambda n: F.concat("file", F.lit(":"), n.cast("string")))).alias("ref"))
    return references.expand(spark, c, refs).select("ref", "status", "line_start")


@query(f"WITH {P} SELECT file, 'd' || k AS folder, 'm' || k || ['.js', '.java', '.rs'][g + 1] AS name FROM p")
def names_and_folders(spark, sf_dir):
    q = {"from": {"set": "tok", "as": "a"}, "where": {"op": "eq", "left": "a.line", "right": 1}, "select": {"file": "a.file", "folder": {"dirname": "a.file"}, "name": {"basename": "a.file"}}}
    doc = {"version": 1, "sets": [{"id": "tok", "scan": ["table:programs"], "patterns": [{"id": "tok", "regexp": TOKEN.regexp}]}], "query": q}
    return run_query(spark, doc, {"table:programs": programs(spark, sf_dir)}).df


@query("SELECT count(*) AS files_scanned, sum(strlen(text)) AS bytes_scanned, (SELECT count(*) FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{3,}')) FROM documents)) AS matches, true AS complete FROM documents WHERE text IS NOT NULL")
def accounted_scan(spark, sf_dir):
    """Counters that Spark took while the scan ran."""
    account = shapes.Accounting(corpus(spark, sf_dir))
    account.shown(scan.match(account.corpus, [Pattern("num", RX["num"])], options=scan.Options(frozenset()))).write.format("noop").mode("overwrite").save()
    told = account.record()
    return spark.createDataFrame([(told["files_scanned"], told["bytes_scanned"], told["matches"], told["complete"])], "files_scanned long, bytes_scanned long, matches long, complete boolean")


@query(f"WITH {_sql_matches('loud')} SELECT file, from_ AS start, left(match, 6) AS match, CASE WHEN length(match) > 6 THEN true END AS match_truncated, CASE WHEN length(match) > 6 THEN true END AS truncated FROM m")
def records_cut(spark, sf_dir):
    """JSON records of matches within six bytes, with flags on those that are longer."""
    found = shapes.record(scan.match(corpus(spark, sf_dir), [BY_ID["loud"]], options=scan.Options(frozenset(), max_match=6)))
    r = F.from_json("json", "file string, `from` long, match string, match_truncated boolean, truncated boolean")
    return found.select(r.alias("r")).select("r.file", F.col("r.from").alias("start"), "r.match", "r.match_truncated", "r.truncated")


@query("SELECT CAST(doc_id AS VARCHAR) AS file, array_to_string(list_sort(ms), ',') AS sorted FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]{3,}') AS ms FROM documents) WHERE len(ms) > 0")
def script_sorted(spark, sf_dir):
    """Each document's numbers as a sorted list (as texts)."""
    end = [{"action": "if", "condition": {"op": "isset", "args": ["all"]}, "then": [{"action": "sort", "var": "all", "key": "n"}, {"action": "emit", "data": {"file": "$FILE", "all": "$all"}}]}, {"action": "reset", "vars": ["all"]}]
    doc = {"variables": {"all": {"type": "list"}}, "patterns": [{"id": "num", "regexp": RX["num"], "on_match": [{"action": "append", "target": "all", "value": {"n": "$MATCH"}}]}], "on_file_end": end}
    found = _script(spark, sf_dir, doc, "file string, `all` array<struct<n: string>>")
    return found.select("file", F.array_join("all.n", ",").alias("sorted"))


@query("""WITH a AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[0-9]{3}')) AS x, list_distinct(regexp_extract_all(text, 'v[0-9]+')) AS y FROM documents WHERE text IS NOT NULL),
    b AS (SELECT doc_id, x, list_transform(y, lambda v: substr(v, 2)) AS y FROM a) SELECT CAST(doc_id AS VARCHAR) AS file, CAST(len(list_distinct(list_concat(x, y))) AS BIGINT) AS either, CAST(len(list_intersect(x, y)) AS BIGINT) AS both_, CAST(len(list_filter(x, lambda v: NOT list_contains(y, v))) AS BIGINT) AS first_only FROM b""")
def script_set_algebra(spark, sf_dir):
    """Union, intersection and difference of two sets of each document: a map's keys and a list."""
    x = {"id": "x", "regexp": "[0-9]{3}", "on_match": [{"action": "map_set", "target": "x", "key": "$MATCH", "value": 1}]}
    y = {"id": "y", "regexp": "v([0-9]+)", "extract": ["n"], "on_match": [{"action": "unique_append", "target": "y", "value": "$EXTRACT_N"}]}
    ends = [{"action": f"set_{op}", "target": op, "a": "x", "b": "y"} for op in ("union", "intersection", "difference")]
    ends += [{"action": "emit", "data": {"file": "$FILE", "either": "$union", "both_": "$intersection", "first_only": "$difference"}}, {"action": "reset", "vars": ["x", "y", "union", "intersection", "difference"]}]
    doc = {"variables": {n: {"type": "map" if n == "x" else "list"} for n in ("x", "y", "union", "intersection", "difference")}, "patterns": [x, y], "on_file_end": ends}
    found = _script(spark, sf_dir, doc, "file string, either array<string>, both_ array<string>, first_only array<string>")
    return found.select("file", *(F.size(c).cast("long").alias(c) for c in ("either", "both_", "first_only")))


@query(f"WITH n AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RX['lic']}')) AS m FROM documents), c AS (SELECT doc_id, count(*) AS n FROM n GROUP BY doc_id) SELECT CAST(doc_id AS VARCHAR) AS file, CAST(sum(n) OVER (ORDER BY doc_id) AS BIGINT) AS so_far FROM c")
def script_running_total(spark, sf_dir):
    """Licences up to and with each document that has some: every file reads what all before it have added."""
    end = [{"action": "if", "condition": {"op": "isset", "args": ["own"]}, "then": [{"action": "emit", "data": {"file": "$FILE", "so_far": "$n"}}]}, {"action": "reset", "vars": ["own"]}]
    doc = {"variables": {"n": {"type": "int"}, "own": {"type": "bool"}}, "patterns": [{"id": "lic", "regexp": "license", "case_insensitive": True, "on_match": [{"action": "increment", "var": "n"}, {"action": "set", "var": "own", "value": True}]}], "on_file_end": end}
    return _script(spark, sf_dir, doc, "file string, so_far long")


@query(f"WITH m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{RX['num']}')) AS m FROM documents) SELECT CAST(doc_id AS VARCHAR) AS file, m AS number FROM m ORDER BY m, file LIMIT 50")
def limited_output(spark, sf_dir):
    """The first fifty rows under a limit on output that allows a part."""
    q = {"from": {"set": "num", "as": "a"}, "select": {"file": "a.file", "number": "a.match"}, "order_by": [{"field": "number"}, {"field": "file"}], "max_output_rows": 50}
    doc = {"version": 1, "on_limit": "partial", "sets": [{"id": "num", "scan": ["table:documents"], "patterns": [{"id": "num", "regexp": RX["num"]}]}], "query": q}
    return run_query(spark, doc, {"table:documents": corpus(spark, sf_dir)}).df
