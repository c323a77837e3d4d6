"""Vectors in packed blocks: a row holds up to some thousand ids and vectors as bytes, so that tasks meet blocks, not pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """key and v (array of double) of the rows whose vector is not null and holds finite components only (nonzero: and not only zeros)."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    found = df.select(F.col(key).cast("long").alias("key"), v.alias("v")).filter(F.col("key").isNotNull() & F.col("v").isNotNull()).filter(finite.isNull() | finite)
    return found.filter(F.exists("v", lambda x: x != 0)) if nonzero else found


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of numbers as rows; shorter ones end in zeros."""
    lengths = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(lengths.max(initial=0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def packed(ids: np.ndarray, rows: np.ndarray) -> tuple[bytes, bytes]:
    return ids.astype(np.int64).tobytes(), np.ascontiguousarray(rows, np.float64).tobytes()


def unpacked(ids: bytes, rows: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = np.frombuffer(ids, np.int64)
    return found, np.frombuffer(rows, np.float64).reshape(len(found), -1)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def blocks(df: DataFrame, count: int, *more: str) -> DataFrame:
    """df (key, v and columns `more`) dealt by hash into `count` blocks: block, rows (an array of structs)."""
    return df.groupBy(F.pmod(F.xxhash64("key"), F.lit(count)).cast("int").alias("block")).agg(F.collect_list(F.struct("key", "v", *more)).alias("rows"))


def struct_rows(value: pa.ListScalar) -> tuple[np.ndarray, np.ndarray, pa.StructArray]:
    inner = value.values
    return inner.field("key").to_numpy(zero_copy_only=False).astype(np.int64), matrix(inner.field("v")), inner


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of a row of scores: highest first, ties to the smaller id."""
    if scores.dtype == np.int64:
        scores = np.maximum(scores, 1 - 2**63)  # its negative must exist
    if len(scores) > 4 * k:
        cut = np.partition(scores, -k)[-k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def best_ids(scores: np.ndarray, ids: np.ndarray, k: int, repeated: bool) -> np.ndarray:
    """As `best`, but each id once, at its best place. repeated: whether ids repeat at all."""
    if not repeated:
        return best(scores, ids, k)
    order = np.lexsort((ids, -np.maximum(scores, 1 - 2**63) if scores.dtype == np.int64 else -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


Batches = Iterator[pa.RecordBatch]
