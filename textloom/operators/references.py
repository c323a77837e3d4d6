"""Line references (file:line@hash), their expansion, and what earlier runs have shown."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.errors import QueryError
from textloom.functions import lexers
from textloom.operators import scan, seen
from textloom.operators.scan import Text
from textloom.operators.seen import unseen
from textloom.sources.corpus import PARTS, Corpus

# The 64-bit FNV-1a hash; a reference shows its low 24 bits.
BASIS, PRIME = 0xCBF29CE484222325, 0x100000001B3
REFERENCE = r"^(?:([^@]+):([0-9]{1,9})|(.+):([0-9]{1,9})@([0-9A-Fa-f]{1,16}))$"
AROUND = 5


def fnv(data: bytes) -> int:
    h = BASIS
    for b in data:
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def line_hash(line: str) -> str:
    return f"{fnv(line.strip(' \t\r\n').encode('utf-8', 'surrogateescape')) & 0xFFFFFF:06x}"


def reference(file: str, line: int, text: str) -> str:
    return f"{file}:{line}@{line_hash(text)}"


def with_references(rows: DataFrame) -> DataFrame:
    """Match rows (with context of one line) with ref."""
    import pyarrow as pa

    names = rows.columns
    at = [names.index(n) for n in ("file", "line", "context")]

    def run(batches):
        for batch in batches:
            refs = [reference(f, n, c or "") for f, n, c in zip(*(batch.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(refs, pa.string())], names=[*names, "ref"])

    return rows.mapInArrow(run, rows.withColumn("ref", F.lit("")).schema)


EXPANDED = "ref string, file string, status string, line int, line_start int, line_end int, scope string, text string"


def expand(spark: SparkSession, corpus: Corpus, refs: list[str] | DataFrame) -> DataFrame:
    """Each reference (file:line or file:line@hash; a list, or a table with a column ref) with its scope's body or the lines around it.

    A line whose hash differs is looked for in its file: found once, it has moved; more than once, it is ambiguous; else the reference is stale, as it is without a hash if the file has no such line. References
    meet their files in a join, and each file is read once for all of them.
    """
    table = spark.createDataFrame([(r,) for r in refs], "ref string") if isinstance(refs, list) else refs.select("ref")
    part = lambda *groups: F.coalesce(*(F.nullif(F.regexp_extract("ref", REFERENCE, g), F.lit("")) for g in groups))
    wanted = table.select("ref", part(1, 3).alias("file"), part(2, 4).cast("int").alias("line"), F.lower(part(5)).alias("hash"))
    bad = wanted.filter("file is null or line < 1").limit(1).collect()
    if bad:
        raise QueryError(f"bad reference {bad[0].ref}")
    # a stated number of parts: adaptive execution would merge them by their compressed bytes, which say little about the work on many small files
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * spark.sparkContext.defaultParallelism)
    by_file = wanted.repartition(count, "file").groupBy("file").agg(F.collect_list(F.struct("ref", "line", "hash")).alias("refs"))
    texts = corpus.df.filter("content is not null").select("file", "content").repartition(count, "file")
    joined = by_file.join(texts, "file", "left").select("file", "refs", "content")

    def run(batches):
        import pyarrow as pa

        for batch in (p for b in batches for p in scan.parts(b)):
            rows: list[tuple] = []
            for file, some, content in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if content is None:
                    rows += [(x["ref"], file, "missing", None, None, None, None, None) for x in some]
                    continue
                t = Text(content)
                lines = t.text.split("\n")
                scopes = lexers.Nest(lexers.scopes(t.text, file))
                count, first_at = None, {}
                for x in some:
                    at, status, there = x["line"], "ok", x["line"] <= len(lines)
                    if not there or x["hash"] is not None and line_hash(lines[at - 1]) != x["hash"]:
                        if count is None:
                            hashes = [line_hash(y) for y in lines]
                            count, first_at = Counter(hashes), dict(zip(reversed(hashes), range(len(hashes), 0, -1), strict=True))
                        if count[x["hash"]] != 1:
                            rows.append((x["ref"], file, "ambiguous" if count[x["hash"]] else "stale", None, None, None, None, None))
                            continue
                        at, status = first_at[x["hash"]], "moved"
                    s = scopes.innermost(t.lines[at - 1] + len(lines[at - 1]) - len(lines[at - 1].lstrip()))
                    first, last = (t.line(s.start), t.line(s.end - 1)) if s else (max(1, at - AROUND), min(len(lines), at + AROUND))
                    rows.append((x["ref"], file, status, at, first, last, s.name if s else None, t.line_text(first, last)))
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[n.split()[0] for n in EXPANDED.split(", ")])

    return joined.mapInArrow(run, EXPANDED)


def load_seen(spark: SparkSession, path: str) -> DataFrame:
    """The state that earlier runs have left in a folder (`seen.Store`)."""
    return seen.Store(spark, path).load()


def save_seen(shown: DataFrame, path: str) -> None:
    seen.Store(shown.sparkSession, path).commit(shown)
