"""Approximate nearest neighbours by shifted space-filling curves.

Each of `CURVES` orderings projects the vectors to `DIMS` random directions, adds a random shift, and sorts by the Hilbert key of the cell. Spark range-partitions
the keys; sorted partitions are cut into blocks of `BLOCK` rows, blocks are numbered along the curve, and the queries of a block
visit the `STEPS` blocks on either side, however many rows there are, so the work grows with the rows. Every visit reranks by exact cosine; visits and curves merge by query.
The projections need no training, and every row is on every curve.

Vectors without any structure (isotropic ones, as most test rows are) are the hardest: their nearest are hardly nearer than others, and with a fixed window recall falls as rows are added; the README has measured figures.
More steps or curves raise it, and `steps` of all blocks is the exact search.

Defined cases: vectors that are null, zero or empty or hold null or non-finite components take no part, nor do rows without vec_id; rows that repeat a vec_id are candidates and queries each, and
a vec_id's score is the best of its pairs of rows; rows equal in vec_id and vector count once; finite components of any size are compared
rightly, as rows are scaled by powers of two; vectors of different lengths are compared as if the shorter ended in zeros; ties go to the smaller vec_id; with fewer than k candidates
all are returned; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import vectors
from textloom.llm.common import table, written

CURVES, DIMS, BITS, STEPS, BLOCK = 20, 12, 4, 2, 512


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of rows of cell numbers (Skilling's transpose, then interleaved bits)."""
    x = cells.astype(np.uint64).T.copy()
    m, one = len(x), np.uint64(1)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        below = q - one
        for i in range(m):
            hit = (x[i] & q) != 0
            swap = np.where(hit, np.uint64(0), (x[0] ^ x[i]) & below)
            x[0] ^= np.where(hit, below, swap)
            x[i] ^= swap
    for i in range(1, m):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, 0, -1):
        q = one << np.uint64(b)
        turn ^= np.where((x[m - 1] & q) != 0, q - one, np.uint64(0))
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key


def keyed(good: DataFrame, curves: int, dims: int, bits: int, seed: int) -> DataFrame:
    """curve, place, key, v: every row once for each curve."""

    def run(batches: vectors.Batches) -> vectors.Batches:
        made: dict[int, list] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                rows = vectors.matrix(part.column(1))
                unit = rows / np.linalg.norm(rows / np.abs(rows).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(rows).max(1, keepdims=True)
                width = rows.shape[1]
                if width not in made:
                    rng = np.random.default_rng(seed)
                    made[width] = [(rng.normal(size=(width, dims)), rng.uniform(0, 1, dims)) for _ in range(curves)]
                for c, (directions, shift) in enumerate(made[width]):
                    # a unit vector's projection is about standard normal: eight deviations are the range
                    spread = (unit @ directions + 4) / 8 * (1 << bits) + shift - 0.5
                    place = hilbert_key(np.clip(spread, 0, (1 << bits) - 1), bits).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int32)), pa.array(place), part.column(0), part.column(1)], names=["curve", "place", "key", "v"])

    return good.mapInArrow(run, "curve int, place long, key long, v array<double>")


def _cut(size: int):
    """Blocks of sorted partitions: curve, part, number within the part, ids, rows."""

    def run(batches: vectors.Batches) -> vectors.Batches:
        part, number, held = TaskContext.get().partitionId(), 0, []

        def block(rows: list[pa.RecordBatch]):
            nonlocal number
            number += 1
            ids = np.concatenate([b.column(2).to_numpy() for b in rows])
            ids, body = vectors.packed(ids, np.concatenate([vectors.matrix(b.column(3)) for b in rows]))
            return pa.RecordBatch.from_arrays([pa.array([rows[0].column(0)[0].as_py()], pa.int32()), pa.array([part], pa.int32()), pa.array([number], pa.int64()), pa.array([ids]), pa.array([body])], names=["curve", "part", "number", "ids", "body"])

        n = 0
        for batch in batches:
            while batch.num_rows:
                curve = batch.column(0)[0].as_py()
                if held and (n == size or held[0].column(0)[0].as_py() != curve):
                    yield block(held)
                    held, n = [], 0
                same = int(np.searchsorted(batch.column(0).to_numpy(), curve, "right"))
                take = min(size - n, same)
                held.append(batch.slice(0, take))
                n += take
                batch = batch.slice(take)
        if held:
            yield block(held)

    return run


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, which change no digit, with the largest component near one."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True, initial=0))[1])


def _visit(k: int):
    """Each visit of queries to a block: the block's k nearest by exact cosine."""

    def run(batches: vectors.Batches) -> vectors.Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q = vectors.unpacked(batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                ids, r = vectors.unpacked(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                q, r = map(_scaled, vectors.same_width(q, r))
                q_size, r_size = np.sqrt((q * q).sum(1)), np.sqrt((r * r).sum(1))
                near = (q @ r.T) / q_size[:, None] / r_size[None, :]
                out, repeated = [], len(np.unique(ids)) < len(ids)
                for n, query in enumerate(q_ids):
                    others = np.flatnonzero(ids != query)
                    # a few more than k, as the matrix product may round otherwise than the measure itself
                    for j in others[vectors.best_ids(near[n][others], ids[others], k + 3, repeated)]:
                        out.append((int(query), int(ids[j]), float((q[n] * r[j]).sum() / (q_size[n] * r_size[j]))))
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], pa.float64() if c == 2 else pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    return run


def search(df: DataFrame, every: int, k: int = 5, key: str = "vec_id", vector: str = "embedding", curves: int = CURVES, dims: int = DIMS, bits: int = BITS, steps: int = STEPS, block: int = BLOCK, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score (cosine): for the rows whose key is divisible by `every`, the k nearest found."""
    spark = df.sparkSession
    good = vectors.usable(df, key, vector, nonzero=True).dropDuplicates(["key", "v"])
    n = df.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), curves * n // (4 * block) or 1))
    lined = keyed(good, curves, dims, bits, seed).repartitionByRange(parts, "curve", "place", "key").sortWithinPartitions("curve", "place", "key")
    cut = written(lined.mapInArrow(_cut(block), "curve int, part int, number long, ids binary, body binary"), "hilbert-blocks")
    # how many blocks of the curve come before a partition's: a row for each partition and curve in it
    counts = cut.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("here"), F.min("number").alias("first"))
    before = F.sum("here").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("curve", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("offset"))
    numbered = cut.join(F.broadcast(counts), ["curve", "part"]).select("curve", (F.col("number") + F.col("offset")).cast("int").alias("at"), "ids", "body")

    def asked(batches: vectors.Batches) -> vectors.Batches:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows = vectors.unpacked(batch.column(2)[i].as_py(), batch.column(3)[i].as_py())
                hit = ids % every == 0
                if hit.any():
                    found = vectors.packed(ids[hit], rows[hit])
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([found[0]]), pa.array([found[1]])], names=["curve", "at", "ids", "body"])

    queries = numbered.mapInArrow(asked, "curve int, at int, q_ids binary, q_body binary")
    visits = queries.select("curve", "q_ids", "q_body", F.explode(F.sequence(F.col("at") - steps, F.col("at") + steps)).alias("at"))
    met = visits.join(numbered, ["curve", "at"]).select("q_ids", "q_body", "ids", "body").mapInArrow(_visit(k), "query_id long, vec_id long, score double")
    best = written(met, "hilbert-visits").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """op4: every fiftieth vec_id against all rows, 5 nearest found."""
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 50)
