"""The registered queries of the text-relational engine with their SQL twins, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.patterns import Pattern, literal
from textloom.operators import filters, rank, scan, shapes
from textloom.plans.query import run_query
from textloom.plans.script import run_script
from textloom.sources.corpus import Corpus
from textloom.streaming import tail

#: Patterns of the registered queries; their text means the same to Java, RE2 and Python.
RX = {"lic": "(?i)license", "num": "[0-9]{3,}", "mail": "[a-z0-9.]+@[a-z0-9.]+", "loud": "[A-Z]{5,}", "ver": "[Vv]ersion [0-9]"}
PATTERNS = [Pattern("lic", "license", case_insensitive=True), Pattern("num", "[0-9]{3,}"), Pattern("mail", "[a-z0-9.]+@[a-z0-9.]+"), Pattern("loud", "[A-Z]{5,}"), Pattern("ver", "[Vv]ersion [0-9]")]
BY_ID = {p.id: p for p in PATTERNS}


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    return Corpus.from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")


def matches(spark: SparkSession, sf_dir: str, *ids: str, need: tuple[str, ...] = ()) -> DataFrame:
    return scan.match(corpus(spark, sf_dir), [BY_ID[i] for i in ids], options=scan.Options(frozenset(need)))


def _sql_matches(*ids: str) -> str:
    """CTE m: doc_id, pattern_id, pattern_index, from_, to_, line, match; offsets from the lengths of what the pattern splits."""
    parts = []
    for i, name in enumerate(ids):
        rx = RX[name]
        parts.append(f"""SELECT doc_id, '{name}' AS pattern_id, {i} AS pattern_index, k, ms[k] AS match, list_sum(list_transform(ps[1:k], lambda x: strlen(x))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: strlen(x))), 0) AS from_,
            1 + list_sum(list_transform(ps[1:k], lambda x: length(x) - length(replace(x, chr(10), '')))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x) - length(replace(x, chr(10), '')))), 0) AS line
            FROM (SELECT doc_id, ms, ps, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{rx}') AS ms, string_split_regex(text, '{rx}') AS ps FROM documents WHERE text IS NOT NULL) WHERE len(ms) > 0)""")
    return "m AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS file, pattern_id, CAST(pattern_index AS INTEGER) AS pattern_index, CAST(from_ AS BIGINT) AS from_, CAST(from_ + strlen(match) AS BIGINT) AS to_, CAST(line AS INTEGER) AS line, match FROM (" + " UNION ALL ".join(parts) + "))"


QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""
    SELECT doc_id, count(*) AS n_lines, CAST(min(line) AS BIGINT) AS first_line, CAST(max(line) AS BIGINT) AS last_line
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)
    WHERE regexp_matches(t, '(?i)license') GROUP BY doc_id""")
def licence_lines(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t"))
    line = (F.col("pos") + 1).cast("long")
    return lines.filter(F.col("t").rlike("(?i)license")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.min(line).alias("first_line"), F.max(line).alias("last_line"))


@query(f"WITH {_sql_matches('lic', 'num', 'mail', 'loud', 'ver')} SELECT pattern_id, count(DISTINCT file) AS files, count(*) AS matches FROM m GROUP BY pattern_id")
def scan_counts_by_pattern(spark, sf_dir):
    return shapes.files_per_pattern(matches(spark, sf_dir, "lic", "num", "mail", "loud", "ver"))


@query(f"WITH {_sql_matches('lic', 'num')} SELECT file, pattern_id, from_ AS from_byte, to_ AS to_byte, line, match FROM m")
def match_offsets(spark, sf_dir):
    return matches(spark, sf_dir, "lic", "num").select("file", "pattern_id", F.col("from").alias("from_byte"), F.col("to").alias("to_byte"), "line", "match")


@query(f"WITH {_sql_matches('lic')}, l AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents) SELECT m.file, m.line, t[m.line] AS context, from_ AS from_byte FROM m JOIN l USING (doc_id)")
def match_lines_context(spark, sf_dir):
    return matches(spark, sf_dir, "lic", need=("context",)).select("file", "line", "context", F.col("from").alias("from_byte"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file FROM documents WHERE regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+')")
def files_with_match(spark, sf_dir):
    return shapes.files_with_match(matches(spark, sf_dir, "mail")).select("file")


@query("SELECT CAST(doc_id AS VARCHAR) AS file FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+|[0-9]{3,}')")
def files_absent(spark, sf_dir):
    return shapes.absent_files(corpus(spark, sf_dir).df, matches(spark, sf_dir, "mail", "num")).select("file")


@query("SELECT CAST(doc_id AS VARCHAR) AS file, CAST(len(regexp_extract_all(text, '[0-9]{3,}')) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL")
def counts_incl_zero(spark, sf_dir):
    return shapes.counts(corpus(spark, sf_dir).df, matches(spark, sf_dir, "num")).select("file", "n")


@query("""SELECT file, line, pattern_id, record FROM (SELECT CAST(conv_id AS VARCHAR) || '/' || CAST(turn AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS record, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line FROM conversations),
    (VALUES ('the', 'the'), ('ing', 'ing')) p(pattern_id, rx) WHERE record <> '' AND NOT regexp_matches(record, rx)""")
def records_absent_line(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("key", F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    c = Corpus.from_table(rows, "key", "text")
    found = scan.match(c, [Pattern("the", "the"), Pattern("ing", "ing")], options=scan.Options(frozenset()))
    return shapes.absent_lines(c.lines(), found, ["the", "ing"]).select("file", "line", "pattern_id", "record")


@query("""SELECT CAST(event_id AS VARCHAR) AS file, regexp_extract(m, '"k": ([0-9]+)', 1) AS k FROM (SELECT event_id, unnest(regexp_extract_all(props, '"k": [0-9]+')) AS m FROM events WHERE props IS NOT NULL)""")
def captures_kv(spark, sf_dir):
    c = Corpus.from_table(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props")
    rows = scan.match(c, [Pattern("kv", '"k": ([0-9]+)', extract=("k",))], options=scan.Options(frozenset(("captures",))))
    return rows.select("file", F.col("captures")["k"].alias("k"))


@query("SELECT CAST(p_partkey AS VARCHAR) AS file, unnest(regexp_extract_all(p_type, 'ECONOMY|PROMO')) AS match FROM part")
def literal_branches(spark, sf_dir):
    c = Corpus.from_table(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey", "p_type")
    return scan.match(c, [Pattern("kind", "ECONOMY|PROMO")], options=scan.Options(frozenset())).select("file", "match")


@query("SELECT CAST(doc_id AS VARCHAR) AS file, CAST(len(regexp_extract_all(text, '\\bof\\b')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '\\bof\\b')")
def whole_word(spark, sf_dir):
    rows = scan.match(corpus(spark, sf_dir), [Pattern("of", "of", word_boundary=True)], options=scan.Options(frozenset()))
    return rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_sql_matches('lic', 'num')} SELECT a.file, a.pattern_id, a.from_ AS from_byte FROM m a WHERE a.pattern_id <> 'lic' OR EXISTS (SELECT 1 FROM m b WHERE b.file = a.file AND b.pattern_id = 'num' AND abs(b.line - a.line) <= 5)")
def near(spark, sf_dir):
    return filters.near(matches(spark, sf_dir, "lic", "num"), "lic", "num", 5).select("file", "pattern_id", F.col("from").alias("from_byte"))


@query(f"WITH {_sql_matches('lic', 'num')} SELECT a.file, a.pattern_id, a.from_ AS from_byte FROM m a WHERE a.pattern_id <> 'lic' OR NOT EXISTS (SELECT 1 FROM m b WHERE b.file = a.file AND b.pattern_id = 'num' AND abs(b.line - a.line) <= 5)")
def far(spark, sf_dir):
    return filters.far(matches(spark, sf_dir, "lic", "num"), "lic", "num", 5).select("file", "pattern_id", F.col("from").alias("from_byte"))


@query(f"WITH {_sql_matches('num')} SELECT a.file, a.from_ AS from_byte FROM m a WHERE EXISTS (SELECT 1 FROM m b WHERE b.file = a.file AND b.from_ <> a.from_ AND abs(b.line - a.line) <= 1)")
def near_self(spark, sf_dir):
    return filters.near(matches(spark, sf_dir, "num"), "num", "num", 1).select("file", F.col("from").alias("from_byte"))


@query(f"WITH {_sql_matches('num')} SELECT file, line, from_ AS from_byte FROM m WHERE line = 2 OR line BETWEEN 4 AND 6 OR line >= 20")
def target_lines(spark, sf_dir):
    return filters.lines(matches(spark, sf_dir, "num"), "2,4:6,20:").select("file", "line", F.col("from").alias("from_byte"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file FROM documents WHERE text IS NOT NULL AND ((regexp_matches(text, '(?i)license') AND NOT regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+')) OR len(regexp_extract_all(text, '[0-9]{3,}')) >= 3)")
def file_where(spark, sf_dir):
    c = corpus(spark, sf_dir)
    condition = filters.FileWhere("lic AND NOT mail || count(num) >= 3", ["lic", "num", "mail"])
    return condition.files(c.languages(), matches(spark, sf_dir, "lic", "num", "mail")).select("file")


@query(f"WITH {_sql_matches('num', 'loud')} SELECT file, pattern_id, from_ AS from_byte FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY from_, pattern_index) AS r FROM m) WHERE r <= 2")
def per_file_cap(spark, sf_dir):
    return filters.per_file_cap(matches(spark, sf_dir, "num", "loud"), 2).select("file", "pattern_id", F.col("from").alias("from_byte"))


@query(f"WITH {_sql_matches('num', 'loud')} SELECT file, pattern_id, from_ AS from_byte FROM m ORDER BY doc_id, from_, pattern_index LIMIT 25")
def global_limit(spark, sf_dir):
    return filters.first_rows(matches(spark, sf_dir, "num", "loud"), 25).select("file", "pattern_id", F.col("from").alias("from_byte"))


@query(f"WITH {_sql_matches('loud')} SELECT file, from_ AS from_byte FROM (SELECT *, coalesce(sum(strlen(match) + 1) OVER (ORDER BY doc_id, from_ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM m) WHERE b < 4000")
def byte_budget(spark, sf_dir):
    return filters.byte_budget(matches(spark, sf_dir, "loud"), 4000, F.col("match")).select("file", F.col("from").alias("from_byte"))


@query(f"WITH {_sql_matches('lic', 'num', 'mail')} SELECT file, list_sort(list(DISTINCT pattern_id)) AS patterns FROM m GROUP BY file HAVING count(DISTINCT pattern_id) >= 2")
def co_occurrence(spark, sf_dir):
    return shapes.co_occurrence(matches(spark, sf_dir, "lic", "num", "mail")).select("file", "patterns")


RANKED = """c AS (SELECT *, sum(CASE WHEN line - prev > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line, pattern_index, from_ ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, lag(line) OVER (PARTITION BY file ORDER BY line, pattern_index, from_) AS prev FROM m)),
    k AS (SELECT file, island, min(line) AS line_start, max(line) AS line_end, count(DISTINCT pattern_id) AS ids, count(*) AS points, list_sort(list(DISTINCT pattern_id)) AS patterns FROM c GROUP BY file, island),
    b AS (SELECT file, sum(CASE WHEN ids >= 2 THEN {bonus} ELSE 0.0 END) AS bonus FROM k GROUP BY file),
    n AS (SELECT count(DISTINCT file) AS files FROM m), d AS (SELECT pattern_id, count(DISTINCT file) AS df FROM m GROUP BY pattern_id),
    w AS (SELECT DISTINCT m.file, m.pattern_id, {weight} AS weight FROM m JOIN d USING (pattern_id), n),
    s AS (SELECT file, count(*) AS ids, sum(weight) AS weights FROM w GROUP BY file),
    l AS (SELECT CAST(doc_id AS VARCHAR) AS file, len(string_split(text, chr(10))) AS line_count FROM documents),
    r AS (SELECT s.file, least(1.0, pow(s.ids / 3.0, 1.5)) * weights / ln(line_count + 10) + bonus AS score, weights / greatest(line_count, 1) AS density FROM s JOIN b USING (file) JOIN l USING (file))"""


def _line_counts(spark, sf_dir):
    return corpus(spark, sf_dir).df.select("file", F.size(F.split(F.col("content").cast("string"), "\n")).alias("line_count"))


@query(f"WITH {_sql_matches('lic', 'num', 'mail')}, {RANKED.format(bonus='0.5', weight='1.0')} SELECT file, CAST(round(score, 6) AS DOUBLE) AS score, CAST(round(density, 6) AS DOUBLE) AS density FROM r")
def rank_files(spark, sf_dir):
    found = rank.files(matches(spark, sf_dir, "lic", "num", "mail"), _line_counts(spark, sf_dir), 3)
    return found.select("file", F.round("score", 6).alias("score"), F.round("density", 6).alias("density"))


@query(f"WITH {_sql_matches('lic', 'num', 'mail')}, {RANKED.format(bonus='0.5 * (ids - 1)', weight='CASE WHEN files >= 3 THEN greatest(1.0, ln((files + 1.0) / (df + 1)) + 1) ELSE 1.0 END')} SELECT file, CAST(round(score, 6) AS DOUBLE) AS score, CAST(round(density, 6) AS DOUBLE) AS density FROM r")
def rank_surprise(spark, sf_dir):
    found = rank.files(matches(spark, sf_dir, "lic", "num", "mail"), _line_counts(spark, sf_dir), 3, use_surprise=True, rich=True)
    return found.select("file", F.round("score", 6).alias("score"), F.round("density", 6).alias("density"))


@query(f"WITH {_sql_matches('lic', 'num', 'mail')}, {RANKED.format(bonus='0.5', weight='1.0')}, t AS (SELECT * FROM r ORDER BY round(score, 9) DESC, round(density, 9) DESC, file LIMIT 15), x AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ids DESC, points DESC, line_start) AS best FROM k) SELECT t.file, CAST(round(score, 6) AS DOUBLE) AS score, x.line_start, x.line_end, x.patterns FROM t JOIN x USING (file) WHERE best = 1")
def hotspots(spark, sf_dir):
    found = rank.hotspots(matches(spark, sf_dir, "lic", "num", "mail"), _line_counts(spark, sf_dir), 3, 15)
    return found.select("file", F.round("score", 6).alias("score"), "line_start", "line_end", "patterns")


@query(f"""WITH {_sql_matches('num')}, l AS (SELECT m.*, regexp_replace(regexp_replace(t[m.line], '[0-9]+', '0', 'g'), '[A-Za-z_]+', 'a', 'g') AS shape FROM m JOIN (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents) USING (doc_id)),
    a AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY from_) AS at_, row_number() OVER (PARTITION BY file, shape ORDER BY from_) AS in_ FROM l), b AS (SELECT *, min(at_) OVER (PARTITION BY file, shape) AS first_ FROM a),
    c AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY first_, in_) AS turn FROM b) SELECT file, from_ AS from_byte FROM c ORDER BY turn, doc_id LIMIT 40""")
def sample_shapes(spark, sf_dir):
    return rank.sample(matches(spark, sf_dir, "num", need=("context",)), 40).select("file", F.col("from").alias("from_byte"))


@query(f"WITH {_sql_matches('num')} SELECT 'file ' || file || ':' || CAST(line AS VARCHAR) || ' ' || match || chr(9) || CAST(from_ AS VARCHAR) AS text FROM m")
def format_template(spark, sf_dir):
    return matches(spark, sf_dir, "num").select(shapes.template("file $FILE:$LINE $MATCH\\t$FROM").alias("text"))


# --- declarative queries


def _run(spark, sf_dir, sets: dict[str, str | Pattern], query_: dict, tables: dict[str, Corpus] | None = None) -> DataFrame:
    specs = []
    for name, rx in sets.items():
        pattern = {"id": name, "regexp": rx} if isinstance(rx, str) else {"id": name, "regexp": rx.regexp, "case_insensitive": rx.case_insensitive, "extract": list(rx.extract)}
        specs.append({"id": name, "scan": [f"table:{name}" if tables and f"table:{name}" in tables else "table:documents"], "patterns": [pattern]})
    return run_query(spark, {"version": 1, "sets": specs, "query": query_}, {"table:documents": corpus(spark, sf_dir), **(tables or {})}).df


def _pair(kind: str, on: list[dict], select: dict, **more) -> dict:
    return {"from": {"set": "lic", "as": "a"}, "joins": [{"type": kind, "set": "num", "as": "b", "on": on}], "select": select, **more}


LIC_NUM = {"lic": BY_ID["lic"], "num": RX["num"]}
TWO = f"WITH {_sql_matches('lic', 'num')}, a AS (SELECT * FROM m WHERE pattern_id = 'lic'), b AS (SELECT * FROM m WHERE pattern_id = 'num')"


@query(f"{TWO} SELECT a.file AS file, a.line AS aline, b.match AS number FROM a JOIN b ON a.file = b.file".replace("a.line AS aline", "CAST(a.line AS BIGINT) AS aline"))
def join_same_file(spark, sf_dir):
    return _run(spark, sf_dir, LIC_NUM, _pair("inner", [{"op": "same_file", "left": "a", "right": "b"}], {"file": "a.file", "aline": "a.line", "number": "b.match"}))


@query(f"{TWO} SELECT a.file AS file, b.match AS number FROM a JOIN b ON a.file = b.file AND abs(a.line - b.line) <= 3")
def join_within_lines(spark, sf_dir):
    return _run(spark, sf_dir, LIC_NUM, _pair("inner", [{"op": "within_lines", "left": "a", "right": "b", "lines": 3}], {"file": "a.file", "number": "b.match"}))


@query(f"WITH {_sql_matches('loud', 'num')}, a AS (SELECT * FROM m WHERE pattern_id = 'loud'), b AS (SELECT * FROM m WHERE pattern_id = 'num') SELECT a.file AS file, b.match AS number FROM a JOIN b ON a.file = b.file AND a.to_ <= b.from_")
def join_before(spark, sf_dir):
    return _run(spark, sf_dir, {"lic": RX["loud"], "num": RX["num"]}, _pair("inner", [{"op": "before", "left": "a", "right": "b"}], {"file": "a.file", "number": "b.match"}))


@query(f"{TWO} SELECT a.file AS file, b.match AS number FROM a LEFT JOIN b ON a.file = b.file AND a.from_ >= b.to_")
def join_left_after(spark, sf_dir):
    return _run(spark, sf_dir, LIC_NUM, _pair("left", [{"op": "after", "left": "a", "right": "b"}], {"file": "a.file", "number": "b.match"}))


@query(f"{TWO} SELECT a.file AS file, a.from_ AS start FROM a WHERE EXISTS (SELECT 1 FROM b WHERE a.file = b.file)")
def join_semi(spark, sf_dir):
    return _run(spark, sf_dir, LIC_NUM, _pair("semi", [{"op": "same_file", "left": "a", "right": "b"}], {"file": "a.file", "start": "a.from"}))


@query(f"{TWO} SELECT a.file AS file, a.from_ AS start FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.file = b.file)")
def join_anti(spark, sf_dir):
    return _run(spark, sf_dir, LIC_NUM, _pair("anti", [{"op": "same_file", "left": "a", "right": "b"}], {"file": "a.file", "start": "a.from"}))


@query(f"WITH {_sql_matches('num')} SELECT a.file AS one, b.file AS two, a.match AS number FROM m a JOIN m b ON a.match = b.match AND a.file <> b.file")
def join_inner_eq(spark, sf_dir):
    return _run(spark, sf_dir, {"lic": RX["num"], "num": RX["num"]}, _pair("inner", [{"op": "eq", "left": "a.match", "right": "b.match"}, {"op": "ne", "left": "a.file", "right": "b.file"}], {"one": "a.file", "two": "b.file", "number": "a.match"}))


@query("WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, 'v?ersion ([0-9]+)')) AS m FROM documents), v AS (SELECT CAST(doc_id AS VARCHAR) AS file, regexp_extract(m, 'v?ersion ([0-9]+)', 1) AS x FROM p) SELECT a.file AS one, count(*) AS n FROM v a JOIN v b ON a.x IS NOT DISTINCT FROM b.x GROUP BY a.file")
def join_captures(spark, sf_dir):
    v = Pattern("v", "v?ersion ([0-9]+)", extract=("x",))
    q = _pair("inner", [{"op": "eq", "left": "a.capture.x", "right": "b.capture.x"}], {"one": "a.file", "n": {"count": "*"}}, group_by=["a.file"])
    return _run(spark, sf_dir, {"lic": v, "num": v}, q)


@query(f"WITH {_sql_matches('num', 'loud')}, a AS (SELECT * FROM m WHERE pattern_id = 'num'), b AS (SELECT doc_id, file, l, CAST(sum(strlen(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(l) - 1 AS BIGINT) AS f FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS file, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) SELECT b.file, a.match AS number FROM b JOIN a ON a.file = b.file AND regexp_matches(b.l, 'token = ') AND b.f <= a.from_ AND b.f + strlen(b.l) >= a.to_")
def join_contains_span(spark, sf_dir):
    return _run(spark, sf_dir, {"lic": "^.*token = .*$", "num": RX["num"]}, _pair("inner", [{"op": "contains_span", "left": "a", "right": "b"}], {"file": "a.file", "number": "b.match"}))


@query("SELECT r_name AS one, n_name AS two FROM region, nation WHERE r_name < n_name")
def cartesian_allowed(spark, sf_dir):
    tables = {"table:lic": Corpus.from_table(spark.read.parquet(f"{sf_dir}/region.parquet"), "r_regionkey", "r_name"), "table:num": Corpus.from_table(spark.read.parquet(f"{sf_dir}/nation.parquet"), "n_nationkey", "n_name")}
    q = _pair("inner", [{"op": "lt", "left": "a.match", "right": "b.match"}], {"one": "a.match", "two": "b.match"})
    q["joins"][0]["allow_cartesian"] = True
    return _run(spark, sf_dir, {"lic": "^.+$", "num": "^.+$"}, q, tables)


@query(f"WITH {_sql_matches('num')} SELECT file, match AS number FROM m WHERE (starts_with(match, '4') OR ends_with(match, '00') OR match IN ('100', '200', '555')) AND NOT contains(match, '99') AND line >= 2")
def predicates(spark, sf_dir):
    either = {"op": "or", "args": [{"op": "starts_with", "left": "a.match", "right": "4"}, {"op": "ends_with", "left": "a.match", "right": "00"}, {"op": "in", "left": "a.match", "right": ["100", "200", "555"]}]}
    where = {"op": "and", "args": [either, {"op": "not", "arg": {"op": "contains", "left": "a.match", "right": "99"}}, {"op": "gte", "left": "a.line", "right": 2}, {"op": "is_null", "left": "a.enclosing.name"}]}
    return _run(spark, sf_dir, {"num": RX["num"]}, {"from": {"set": "num", "as": "a"}, "where": where, "select": {"file": "a.file", "number": "a.match"}})


@query("SELECT upper(url) AS up, regexp_extract(url, '([^/]*)$', 1) AS base, regexp_extract(url, '^(.*)/[^/]*$', 1) AS dir, '<' || url || '>' AS marked, 'none' AS scope FROM pages WHERE url IS NOT NULL AND regexp_full_match(url, '[ -~]+')")
def expressions(spark, sf_dir):
    pages = Corpus.from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url")
    select = {"up": {"upper": "a.match"}, "base": {"basename": "a.match"}, "dir": {"dirname": "a.match"}, "marked": {"concat": ["<", "a.match", {"literal": ">"}]}, "scope": {"coalesce": ["a.enclosing.name", {"literal": "none"}]}}
    return _run(spark, sf_dir, {"url": "^[ -~]+$"}, {"from": {"set": "url", "as": "a"}, "select": select}, {"table:url": pages})


@query(f"WITH {_sql_matches('num', 'loud')} SELECT file, count(*) AS n, count(DISTINCT match) AS kinds, min(match) AS low, CAST(max(line) AS BIGINT) AS high, CAST(sum(line) AS BIGINT) AS total, list(match ORDER BY from_) AS every, arg_min(match, from_) AS first FROM m WHERE pattern_id = 'num' GROUP BY file")
def aggregates(spark, sf_dir):
    select = {"file": "a.file", "n": {"count": "*"}, "kinds": {"count_distinct": "a.match"}, "low": {"min": "a.match"}, "high": {"max": "a.line"}, "total": {"sum": "a.line"}, "every": {"collect": "a.match"}, "first": {"first": "a.match"}}
    return _run(spark, sf_dir, {"num": RX["num"]}, {"from": {"set": "num", "as": "a"}, "group_by": ["a.file"], "select": select})


@query(f"WITH {_sql_matches('num')} SELECT match AS number, count(*) AS n, list_sort(list(DISTINCT file)) AS files FROM m GROUP BY match HAVING count(*) > 1")
def having_groups(spark, sf_dir):
    q = {"from": {"set": "num", "as": "a"}, "group_by": ["a.match"], "select": {"number": "a.match", "n": {"count": "*"}, "files": {"collect_distinct": "a.file"}}, "having": {"op": "gt", "left": "n", "right": 1}}
    return _run(spark, sf_dir, {"num": RX["num"]}, q).withColumn("files", F.sort_array("files"))


@query(f"WITH {_sql_matches('num')} SELECT file, match AS number, from_ AS start FROM m ORDER BY length(match) * 0, match DESC, file, from_ LIMIT 30 OFFSET 10")
def order_skip_limit(spark, sf_dir):
    q = {"from": {"set": "num", "as": "a"}, "select": {"file": "a.file", "number": "a.match", "start": "a.from"}, "order_by": [{"field": "number", "direction": "desc"}, {"field": "file"}, {"field": "start"}], "skip": 10, "limit": 30}
    return _run(spark, sf_dir, {"num": RX["num"]}, q)


@query("""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS v FROM documents) SELECT CAST(doc_id AS VARCHAR) AS file, v AS value, CAST((length(text) - length(replace(text, v, ''))) // length(v) AS BIGINT) AS n FROM documents JOIN s ON contains(text, v)""")
def derived_patterns(spark, sf_dir):
    sets = [{"id": "keys", "scan": ["table:documents"], "patterns": [{"id": "key", "regexp": 'token = "[0-9a-f]+"'}]}, {"id": "hits", "scan": ["table:documents"], "derive_patterns": {"from_set": "keys", "field": "match"}}]
    q = {"from": {"set": "hits", "as": "a"}, "group_by": ["a.file", "a.derived.value"], "select": {"file": "a.file", "value": "a.derived.value", "n": {"count": "*"}}}
    return run_query(spark, {"version": 1, "sets": sets, "query": q}, {"table:documents": corpus(spark, sf_dir)}).df


@query("""WITH p AS (SELECT DISTINCT array_to_string(w[i:i + 2], ' ') AS phrase FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT string_split(text, ' ') AS w FROM benchmark WHERE text IS NOT NULL)))
    SELECT phrase, CAST(sum((length(text) - length(replace(text, phrase, ''))) // length(phrase)) AS BIGINT) AS n, count(*) AS n_files FROM documents JOIN p ON contains(text, phrase) GROUP BY phrase""")
def many_literals(spark, sf_dir):
    """All phrases of three words of the benchmark's items, as they stand, as literals of one scan over all documents."""
    words = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("text is not null").select(F.split("text", " ").alias("w"))
    phrases = words.select(F.explode(F.transform(F.slice("w", F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda _, i: F.array_join(F.slice("w", i + 1, F.lit(3)), " "))).alias("p")).distinct().orderBy("p")
    found = scan.match(corpus(spark, sf_dir), [literal(f"p{i}", r.p) for i, r in enumerate(phrases.collect())], options=scan.Options(frozenset()))
    return found.groupBy(F.col("match").alias("phrase")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("n_files"))


@query("""WITH s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Z]{5,}')) AS v FROM documents), t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS file, v AS value, count(*) AS n FROM t JOIN s ON w = v GROUP BY ALL""")
def derived_words(spark, sf_dir):
    """Every loud word, looked up as a whole word in all documents: a join, however many words there are."""
    sets = [{"id": "loud", "scan": ["table:documents"], "patterns": [{"id": "loud", "regexp": RX["loud"]}]}, {"id": "hits", "scan": ["table:documents"], "derive_patterns": {"from_set": "loud", "field": "match", "word_boundary": True}}]
    q = {"from": {"set": "hits", "as": "a"}, "group_by": ["a.file", "a.derived.value"], "select": {"file": "a.file", "value": "a.derived.value", "n": {"count": "*"}}}
    return run_query(spark, {"version": 1, "sets": sets, "query": q}, {"table:documents": corpus(spark, sf_dir)}).df


@query(f"WITH {_sql_matches('num')} SELECT row_number() OVER (ORDER BY doc_id, from_) - 1 AS id, file, from_ AS start, match AS number FROM m")
def row_ids(spark, sf_dir):
    """Every number with its place among all, numbered in ranges."""
    q = {"from": {"set": "num", "as": "a"}, "select": {"id": "a.row_id", "file": "a.file", "start": "a.from", "number": "a.match"}}
    return _run(spark, sf_dir, {"num": BY_ID["num"]}, q)


@query(f"WITH {_sql_matches('lic', 'num')} SELECT file, from_ AS start FROM m a WHERE pattern_id = 'num' AND EXISTS (SELECT 1 FROM m b WHERE b.pattern_id = 'lic' AND b.file = a.file AND a.to_ <= b.from_)")
def join_before_any(spark, sf_dir):
    """Numbers before some licence of their document: the document's last one tells."""
    q = {"from": {"set": "num", "as": "a"}, "joins": [{"type": "semi", "set": "lic", "as": "b", "on": [{"op": "before", "left": "a", "right": "b"}]}], "select": {"file": "a.file", "start": "a.from"}}
    return _run(spark, sf_dir, {"num": BY_ID["num"], "lic": BY_ID["lic"]}, q)


def _values(spark, sf_dir, name: str, key: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return scan.match(Corpus.from_table(rows, key, "text"), [Pattern("long", "[a-z]{9,}")], options=scan.Options(frozenset())).select("match")


def _both(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return _values(spark, sf_dir, "documents", "doc_id"), _values(spark, sf_dir, "conversations", "conv_id")


VALUES = "(SELECT unnest(regexp_extract_all(text, '[a-z]{{9,}}')) AS match FROM {})"


@query(f"SELECT match FROM {VALUES.format('documents')} UNION SELECT match FROM {VALUES.format('conversations')}")
def set_union(spark, sf_dir):
    one, two = _both(spark, sf_dir)
    return one.union(two).distinct()


@query(f"SELECT match FROM {VALUES.format('documents')} INTERSECT SELECT match FROM {VALUES.format('conversations')}")
def set_intersection(spark, sf_dir):
    one, two = _both(spark, sf_dir)
    return one.intersect(two)


@query(f"SELECT match FROM {VALUES.format('documents')} EXCEPT SELECT match FROM {VALUES.format('conversations')}")
def set_difference(spark, sf_dir):
    one, two = _both(spark, sf_dir)
    return one.subtract(two)


# --- scripts


def _script(spark, sf_dir, doc: dict, schema: str, tables: Corpus | None = None) -> DataFrame:
    out = run_script(spark, doc, tables or corpus(spark, sf_dir))
    return out.rows.select(F.from_json("line", schema).alias("r")).select("r.*")


@query("SELECT m AS number, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{3,}')) AS m FROM documents) GROUP BY m")
def script_map_increment(spark, sf_dir):
    end = [{"action": "for_each", "var": "by", "key_as": "k", "as": "n", "do": [{"action": "emit", "data": {"number": "$k", "n": "$n"}}]}]
    doc = {"variables": {"by": {"type": "map"}}, "patterns": [{"id": "num", "regexp": "[0-9]{3,}", "on_match": [{"action": "map_increment", "target": "by", "key": "$MATCH"}]}], "on_complete": end}
    return _script(spark, sf_dir, doc, "number string, n long")


@query("SELECT CAST(doc_id AS VARCHAR) AS file, CAST(len(regexp_extract_all(text, '[0-9]{3,}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '(?i)license')")
def script_flag_per_file(spark, sf_dir):
    end = [{"action": "if", "condition": {"op": "isset", "args": ["seen"]}, "then": [{"action": "emit", "data": {"file": "$FILE", "n": "$k"}}]}, {"action": "reset", "vars": ["seen", "k"]}]
    patterns = [{"id": "lic", "regexp": "license", "case_insensitive": True, "on_match": [{"action": "set", "var": "seen", "value": True}]}, {"id": "num", "regexp": "[0-9]{3,}", "on_match": [{"action": "increment", "var": "k"}]}]
    return _script(spark, sf_dir, {"variables": {"seen": {"type": "bool"}, "k": {"type": "int"}}, "patterns": patterns, "on_file_end": end}, "file string, n long")


@query("""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, 'token = "[0-9a-f]+"')) AS m FROM documents), f AS (SELECT m, arg_max(doc_id, doc_id) AS last FROM p GROUP BY m) SELECT CAST(p.doc_id AS VARCHAR) AS file, CAST(f.last AS VARCHAR) AS seen FROM p JOIN f USING (m)""")
def script_phases_lookup(spark, sf_dir):
    rx = 'token = "[0-9a-f]+"'
    one = [{"id": "t", "regexp": rx, "on_match": [{"action": "map_set", "target": "at", "key": "$MATCH", "value": "$FILE"}]}]
    two = [{"id": "t", "regexp": rx, "on_match": [{"action": "lookup", "map": "at", "key": "$MATCH", "on_hit": [{"action": "emit", "data": {"file": "$FILE", "seen": "$LOOKUP_VALUE"}}]}]}]
    return _script(spark, sf_dir, {"variables": {"at": {"type": "map"}}, "phases": [{"patterns": one}, {"patterns": two}]}, "file string, seen string")


@query("SELECT CAST(doc_id AS VARCHAR) AS key, CAST(len(regexp_extract_all(text, '[A-Z]{5,}')) AS BIGINT) AS n FROM documents WHERE regexp_matches(text, '[A-Z]{5,}')")
def script_group_by(spark, sf_dir):
    doc = {"group_by": "f", "patterns": [{"id": "loud", "regexp": "[A-Z]{5,}", "on_match": [{"action": "emit", "data": {"f": "$FILE", "m": "$MATCH"}}]}]}
    found = _script(spark, sf_dir, doc, "key string, `group` array<struct<f: string, m: string>>")
    return found.select("key", F.size("group").cast("long").alias("n"))


@query("SELECT CAST(doc_id AS VARCHAR) AS file, 'mail' AS missing FROM documents WHERE text IS NOT NULL AND NOT regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+')")
def script_absent(spark, sf_dir):
    return _script(spark, sf_dir, {"patterns": [{"id": "mail", "regexp": "[a-z0-9.]+@[a-z0-9.]+", "absent": True, "on_match": [{"action": "emit", "data": {"file": "$FILE", "missing": "$PAT_ID"}}]}]}, "file string, missing string")


# --- rows-only checks: lexers over markup


@query()
def block_braces(spark, sf_dir):
    """The first balanced braces after each style element's start, over all pages."""
    c = Corpus.from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")
    rows = scan.match(c, [Pattern("style", "<style>")], options=scan.Options(frozenset(("block",))))
    return rows.select("file", F.col("block.text").alias("inside"), F.col("block.start").alias("start"), F.col("block.end").alias("end"))


@query("SELECT CAST(page_id AS VARCHAR) AS file, unnest(regexp_extract_all(html, '\\btrack[A-Za-z0-9_]*')) AS name FROM pages")
def ident_terms(spark, sf_dir):
    c = Corpus.from_table(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")
    return scan.match(c, [], [("track",)], options=scan.Options(frozenset())).select("file", F.col("match").alias("name"))


@query()
def streaming_window_counts(spark, sf_dir):
    """The streaming aggregate's plan over a static table: matches by window of event time."""
    return tail.counts(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_id", "props", "ts", [Pattern("k", '"k": [0-9]+')]).select(F.col("window.start").alias("start"), "pattern_id", "matches")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers by document with the licence lines near them, most numbers first."""
    join = {"type": "left", "set": "lic", "as": "b", "on": [{"op": "within_lines", "left": "a", "right": "b", "lines": 10}]}
    select = {"file": "a.file", "numbers": {"count_distinct": "a.from"}, "licence_lines": {"collect_distinct": "b.line"}}
    q = {"from": {"set": "num", "as": "a"}, "joins": [join], "group_by": ["a.file"], "select": select, "order_by": [{"field": "numbers", "direction": "desc"}, {"field": "file"}]}
    return _run(spark, sf_dir, LIC_NUM, q)


def _all() -> None:
    from textloom.plans import rows_of_code, rows_of_programs  # noqa: F401  add their own


def queries() -> dict:
    _all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _all()
    return dict(SQL)
