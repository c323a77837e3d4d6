"""Packing by concatenate and cut.

Pass one encodes each partition of the input and writes its ids with their place inside the partition. The partitions' token totals are summed up (one
row for each partition), which gives each partition its global offset. Pass two cuts each document where its global
interval crosses a multiple of the sequence length: a boundary record for each piece. Nothing is sorted or shuffled but the totals,
and only the very last sequence can have room left.

Defined cases: null and empty texts are documents of one token, the end id; a text longer than a sequence gives several pieces; repeated rows are packed
as often as they come; an empty table gives no piece. Other columns of the input are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.bpe import encoder
from textloom.llm.common import slices, table, written

LENGTH, END = 2048, 1


def tokens(docs: DataFrame, key: str, text: str, end: int, path: str | None) -> DataFrame:
    """part, key, begun (tokens before it in its partition), ids with the end id."""

    def run(batches):
        e, begun, part = encoder(path), 0, TaskContext.get().partitionId()
        wide = max(e.names) > 0xFFFF
        for batch in slices(batches, text):
            ids = [x + end.to_bytes(4, "little") for x in e.encode(batch.column(1).to_pylist())]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            at = begun + np.cumsum(n) - n
            begun += int(n.sum())
            kept = ids if wide else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), batch.column(0), pa.array(at), pa.array(n), pa.array(kept, pa.binary())], names=["part", "key", "begun", "n", "ids"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias(text)).mapInArrow(run, "part int, key long, begun long, n long, ids binary")


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """Pieces: key, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    told = written(tokens(docs, key, text, end, path), "packed-ids")
    totals = told.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))

    def cut(batches):
        for batch in slices(batches, "ids"):
            out: list[tuple] = []
            for k, at, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                full = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4")
                done = 0
                while done < n:
                    sequence, offset = divmod(at + done, length)
                    take = min(n - done, length - offset)
                    out.append((k, done, take, full[done : done + take].tobytes(), n, sequence, offset))
                    done += take
            columns = list(zip(*out, strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(columns)], names=list("abcdefg"))

    # one row for each task of pass one, whatever the input
    placed = told.join(F.broadcast(offsets), "part").select("key", (F.col("base") + F.col("begun")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, f"`{key}` long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame, key: str = "doc_id") -> DataFrame:
    return pieces.select(key, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document's pieces in sequences of 2048 tokens."""
    return digest(pack(table(spark, sf_dir, "documents", "doc_id", "text")))
