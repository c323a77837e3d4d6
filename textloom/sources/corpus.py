"""A corpus: a DataFrame with file (string), content (binary) and walk_ord (long), from any table or from files."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import lexers
from textloom.sources import paths

#: Bytes of a table below which one task will do (files are compressed, and texts may be made of short keys, so that few bytes can stand for much work), and of a part of one that is worth dealing out.
SMALL, PART = 64 << 10, 64 << 20
#: Parts for each core: a task's rows are a quarter of a core's share, and an uneven one holds up less.
PARTS = 4
SCHEMA = "file string, content binary, walk_ord long"


@dataclass
class Corpus:
    """df, and what was named but could not be read."""

    df: DataFrame
    missing: list[str] = field(default_factory=list)
    warnings: DataFrame | None = None

    @classmethod
    def from_table(cls, df: DataFrame, key: str, text: str, order: str | None = None) -> Corpus:
        """Rows of a table as files: the key as text is the file's name; order (by default the key, if it is a number) the walk order."""
        kind = dict(df.dtypes)[order or key]
        ord_ = F.col(order or key).cast("long") if kind in ("bigint", "int", "smallint", "tinyint") else F.xxhash64(key)
        rows = df.filter(F.col(text).isNotNull())
        return cls(rows.select(F.col(key).cast("string").alias("file"), F.col(text).cast("binary").alias("content"), ord_.alias("walk_ord")))

    @classmethod
    def from_text(cls, spark: SparkSession, texts: dict[str, str | bytes]) -> Corpus:
        """Small texts by name, in the order given; piped input is one text named <stdin>."""
        rows = [(k, bytearray(v.encode() if isinstance(v, str) else v), i) for i, (k, v) in enumerate(texts.items())]
        return cls(spark.createDataFrame(rows, SCHEMA))

    @classmethod
    def from_files(cls, spark: SparkSession, scan: Iterable[str] = (), exclude: Iterable[str] = (), files: Iterable[str] = ()) -> Corpus:
        """Files by glob, folder or list, in walk order. The driver walks; tasks read. Binary files (a NUL in the first 512 bytes) are left out with a warning.

        The paths must be readable where tasks run, as with any file:// input.
        """
        found, missing = paths.walk(scan, exclude, files)
        listed = spark.createDataFrame([(p, i) for i, p in enumerate(found)], "file string, walk_ord long").repartition(max(1, min(len(found) // 16, 4 * spark.sparkContext.defaultParallelism)))
        read = listed.mapInArrow(_read, "file string, content binary, walk_ord long, code string")
        return cls(read.filter("code is null").drop("code"), missing, read.filter("code is not null").select(F.lit("warning").alias("type"), "code", "file"))

    def spread(self) -> DataFrame:
        """df for work in Python: a table of some megabytes, which often is one row group and so one task, is dealt over all cores; larger tables come in enough parts."""
        if self.df.isStreaming:
            return self.df
        size = int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        cores = self.df.sparkSession.sparkContext.defaultParallelism
        return self.df.repartition(PARTS * cores if size > PARTS * SMALL else cores) if SMALL < size < cores * PART else self.df

    def lines(self) -> DataFrame:
        """file, walk_ord, line (from 1), text of every line."""
        split = self.df.select("file", "walk_ord", F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("pos", "text"))
        return split.select("file", "walk_ord", (F.col("pos") + 1).alias("line"), "text")

    def languages(self) -> DataFrame:
        """df with language, by suffix, in native expressions."""
        ending = F.regexp_extract("file", r"\.([^./]*)$", 1)
        table = F.create_map(*[F.lit(x) for pair in lexers.LANGUAGES.items() for x in pair])
        return self.df.withColumn("language", F.coalesce(F.try_element_at(table, ending), F.lit("")))


def _read(batches):
    for batch in batches:
        out: list[tuple] = []
        for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with open(path, "rb") as f:
                    data = f.read()
            except OSError:
                out.append((path, None, at, "read_error"))
                continue
            out.append((path, None, at, "binary_skip") if b"\0" in data[:512] else (path, data, at, None))
            if len(out) >= 64:
                yield _rows(out)
                out = []
        yield _rows(out)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.int64(), pa.string())
    columns = list(zip(*rows, strict=True)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "content", "walk_ord", "code"])


def stdin(spark: SparkSession, data: bytes) -> Corpus:
    return Corpus.from_text(spark, {"<stdin>": data})


__all__ = ["Corpus", "stdin"]
