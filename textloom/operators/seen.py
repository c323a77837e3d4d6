"""What earlier runs have shown: a state table that grows by commits.

A run writes its new rows as a folder of their own and then publishes them by a commit file, which names all folders of the state and can be created only once. A run that finds its number taken reads the state again and
takes the next, so that runs at the same time lose nothing, and readers see whole commits only.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEEN = "file string, line_start int, line_end int, hash string"
KEYS = ["file", "line_start", "line_end", "hash"]


def span_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def keyed(shown: DataFrame) -> DataFrame:
    """Rows (file, line_start, line_end, text) with the text's hash."""
    return shown.withColumn("hash", span_hash(F.col("text")))


def unseen(shown: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (file, line_start, line_end, text) that no earlier run has shown with the same text."""
    return keyed(shown).join(seen.select(*KEYS), KEYS, "left_anti").drop("hash")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """A state as tab-separated lines; fields are plain text without quotes, and lines that do not parse are left out."""
    line = F.split(F.regexp_replace("value", "\r$", ""), "\t", 4)
    number = lambda i: F.when(F.get(line, F.lit(i)).rlike(r"^\s*\+?[0-9]{1,9}$"), F.trim(F.get(line, F.lit(i))).cast("int"))
    rows = spark.read.option("wholetext", "false").text(path).select(F.get(line, F.lit(0)).alias("file"), number(1).alias("line_start"), number(2).alias("line_end"), F.get(line, F.lit(3)).alias("hash"))
    return rows.filter("line_start is not null and line_end is not null and hash rlike '^[0-9a-fA-F]+$'")


class Store:
    """The state in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self.root = jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _latest(self) -> tuple[int, list[str]]:
        """The last commit's number and its folders."""
        if not self.fs.exists(self.root):
            return 0, []
        found = [int(n.removeprefix("commit-")) for s in self.fs.listStatus(self.root) if (n := s.getPath().getName()).startswith("commit-")]
        if not found:
            return 0, []
        stream = self.fs.open(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/commit-{max(found)}"))
        try:
            return max(found), json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def load(self) -> DataFrame:
        return self._read(self._latest()[1])

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SEEN)
        return self.spark.read.schema(SEEN).parquet(*(f"{self.path}/{f}" for f in folders))

    def commit(self, shown: DataFrame, compact: bool = False) -> int:
        """Adds rows (file, line_start, line_end, text); the commit's number. compact: the whole state becomes one folder."""
        own = f"data-{uuid.uuid4().hex}"
        rows = keyed(shown).select(*KEYS).na.drop().distinct()
        if not compact:
            rows.write.parquet(f"{self.path}/{own}")
        while True:
            number, folders = self._latest()
            if compact:
                own = f"data-{uuid.uuid4().hex}"
                self._read(folders).union(rows).distinct().write.parquet(f"{self.path}/{own}")
                folders = []
            if self._publish(number + 1, [*folders, own]):
                return number + 1

    def _publish(self, number: int, folders: list[str]) -> bool:
        """Whether this commit could be created; False if another run has it."""
        jvm, body = self.spark._jvm, json.dumps(folders).encode()
        draft, target = f"{self.path}/.draft-{uuid.uuid4().hex}", f"{self.path}/commit-{number}"
        out = self.fs.create(jvm.org.apache.hadoop.fs.Path(draft), False)
        out.write(bytearray(body))
        out.close()
        if self.fs.getUri().getScheme() == "file":
            plain = lambda p: p.removeprefix("file://").removeprefix("file:")
            try:
                os.link(plain(draft), plain(target))  # fails if it is there, and shows the whole file at once
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(plain(draft))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(jvm.org.apache.hadoop.fs.Path(draft), jvm.org.apache.hadoop.fs.Path(target), none)
            return True
        except Exception as e:  # Java's FileAlreadyExistsException
            if "FileAlreadyExists" not in str(e):
                raise
            self.fs.delete(jvm.org.apache.hadoop.fs.Path(draft), False)
            return False


def batches(path: str, show: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: shows each batch's rows that no earlier batch or run has shown, then commits them."""

    def each(rows: DataFrame, number: int) -> None:
        store = Store(rows.sparkSession, path)
        new = unseen(rows, store.load())
        show(new, number)
        store.commit(new)

    return each
