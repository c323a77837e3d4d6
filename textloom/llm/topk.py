"""Exact top-k inner products in three phases with a uniform threshold.

A vector's components lie in `SLICES` slices; within a block of rows each slice has a score list of its own, and a full score is the sum over the lists. Phase one gathers, for each query, the head of every
list and adds up the full scores of these entries alone; the k-th best of them bounds the true k-th score from below. Phase two sends that cutoff, attached to the queries, to all blocks: a row whose
score reaches it must reach cutoff / SLICES in some list, so only such entries are collected, with what their lists say. Entries that cannot reach the cutoff even if every list that did not name them stood
just below its share are dropped; phase three resolves the missing lists' scores of the rest, entry by entry, and keeps those that reach the cutoff. Rows and queries meet as packed blocks (a query block goes to each row
block once), no single task holds all rows or all queries, and what goes on is at most k rows for a query and block.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id; an empty vector's scores are all 0; vectors of different lengths are compared as if the shorter ended in
zeros; scores outside 64 bits stand as the nearest 64-bit number; rows that repeat a vec_id are candidates each and queries each, but never candidates for a query of the same vec_id, and a query_id's k results are different
vec_ids, each with the best score of any of its pairs of rows; ties go to the smaller vec_id; with fewer than k candidates all are returned; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import vectors
from textloom.llm.common import table, written

SLICES, ROWS, QUERIES = 2, 4096, 512
#: Bytes of the cells that one task may hold as one Arrow batch (a batch has up to 10,000 rows, whatever their size).
CELLS = 32 << 20


LOWEST, HIGHEST = -(2**63), 2**63 - 1


def _whole(x: np.ndarray) -> np.ndarray:
    """floor(1024 x): float64 where that is exact everywhere, else Python's integers."""
    if np.abs(x).max(initial=0) < 2**40:
        return np.floor(x * 1024)
    return np.array([[math.floor(v * 1024) if abs(v) < 2**52 else int(v) * 1024 for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)


def _exact(q: np.ndarray, r: np.ndarray) -> bool:
    """Whether float64 holds every sum of products."""
    return q.dtype != object and r.dtype != object and np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * max(1, q.shape[1]) < 2**52


def _clipped(x: np.ndarray) -> np.ndarray:
    return np.clip(x, LOWEST, HIGHEST).astype(np.int64)


def _products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of each row of q with each row of r: float64 if that is exact, else Python's integers."""
    if _exact(q, r):
        return q @ r.T
    r = [[int(v) for v in row] for row in r.tolist()]
    return np.array([[sum(map(mul, x, y)) for y in r] for x in ([int(v) for v in row] for row in q.tolist())], dtype=object).reshape(len(q), len(r))


def _cells(queries: DataFrame, rows: DataFrame, count: int, query_blocks: int, cell: int) -> DataFrame:
    """Every query block with every row block. A block of rows goes to groups of query blocks, and both sides are dealt into a stated number of parts, which adaptive execution doesn't merge: a part holds some groups' cells, however
    many blocks there are. cell: bytes of one cell."""
    size = max(1, CELLS // max(1, cell))
    groups = math.ceil(query_blocks / size)
    parts = count * groups
    place = F.col("block") * groups + F.col("group")
    spread = queries.select(F.col("rows").alias("queries"), F.pmod("block", F.lit(groups)).alias("group"), F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("block"))
    dealt = rows.select("rows", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), "block")
    one, two = (x.withColumn("place", place).drop("block", "group").repartition(parts, "place") for x in (spread, dealt))
    return one.hint("merge").join(two, "place").select("queries", "rows")


def _each(heads: bool, k: int):
    """Per cell: phase one (heads) or phases two and three."""

    def run(batches: vectors.Batches) -> vectors.Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, told = vectors.struct_rows(batch.column(0)[i])
                ids, r, _ = vectors.struct_rows(batch.column(1)[i])
                q, r = map(_whole, vectors.same_width(q, r))
                edges = np.linspace(0, q.shape[1], SLICES + 1).astype(int)
                cuts = list(zip(edges, edges[1:], strict=False))
                lists = [_products(q[:, a:b], r[:, a:b]) for a, b in cuts]
                cutoffs = None if heads else [LOWEST if x is None else x for x in told.field("cutoff").to_pylist()]
                out: list[tuple[int, int, int]] = []
                repeated = len(np.unique(ids)) < len(ids)
                for n, query in enumerate(q_ids):
                    other = np.flatnonzero(ids != query)
                    if heads:
                        at = np.unique(np.concatenate([other[vectors.best_ids(_clipped(p[n][other]), ids[other], k, repeated)] for p in lists]))
                        score = sum(p[n][at] for p in lists)
                    else:
                        share = -(-cutoffs[n] // SLICES)
                        named = [p[n][other] >= share for p in lists]
                        some = np.logical_or.reduce(named)
                        at, named = other[some], [x[some] for x in named]
                        zero = np.zeros(len(at), dtype=lists[0].dtype)
                        score = sum((np.where(x, p[n][at], zero) for x, p in zip(named, lists, strict=True)), zero)
                        most = score + sum((~x).astype(np.int64) for x in named).astype(object) * (share - 1)
                        can = np.asarray(most >= cutoffs[n], bool)
                        at, score, named = at[can], score[can], [x[can] for x in named]
                        for x, (a, b) in zip(named, cuts, strict=True):
                            missing = np.flatnonzero(~x)
                            if len(missing):
                                score[missing] += _products(q[n : n + 1, a:b], r[at[missing], a:b])[0]
                    score = _clipped(score)
                    if not heads:
                        at, score = at[score >= cutoffs[n]], score[score >= cutoffs[n]]
                    top = vectors.best_ids(score, ids[at], k, repeated)
                    out += [(int(query), int(ids[at[j]]), int(score[j])) for j in top]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", rows_in_block: int = ROWS, queries_in_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where the condition over `key` holds, the k other rows of highest inner product of floor(1024 x)."""
    good = vectors.usable(df, key, vector)
    asked = good.filter(is_query(F.col("key")))
    n, width = good.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    m = asked.count()
    count = max(1, math.ceil(n / rows_in_block))
    rows = written(vectors.blocks(good, count), "topk-blocks")
    query_blocks = max(1, math.ceil(m / queries_in_block))
    cell = (min(n, rows_in_block) + min(m, queries_in_block)) * 8 * (width + 2)
    schema = "query_id long, vec_id long, score long"
    heads = _cells(vectors.blocks(asked, query_blocks), rows, count, query_blocks, cell).mapInArrow(_each(True, k), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = lambda found: found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = once(heads).withColumn("rank", F.row_number().over(order))
    cutoffs = ranked.filter(F.col("rank") == k).select(F.col("query_id").alias("key"), F.col("score").alias("cutoff"))
    told = asked.join(cutoffs, "key", "left")
    found = once(_cells(vectors.blocks(told, query_blocks, "cutoff"), rows, count, query_blocks, cell).mapInArrow(_each(False, k), schema))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op2: every hundredth vec_id against all rows, 10 best."""
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda k: k % 100 == 0)


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT)) AS score
    FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id GROUP BY q.vec_id, c.vec_id
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
