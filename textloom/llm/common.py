"""What the operators share: tables, the shared folder, bounded slices of Arrow batches and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one numpy step holds at once; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20

#: Word separators of every contract here: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only on one machine, where none may be set (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        where = context._jsc.sc().getCheckpointDir()
        if where.isDefined():
            return str(where.get())
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='textloom-')}"
        context.setCheckpointDir(found)
    return found


#: Settings of a job that writes a table: its shuffle files go when the table is written (no later job can want them), Python gets batches of some megabytes, however long the texts,
#: and nothing is broadcast but what says so, so that plans are alike at every size.
WRITING = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage, and a lost executor costs no rework."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Deletes the files of written tables that no later plan reads."""
    for df in tables:
        jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(jsc.hadoopConfiguration()).delete(at, True)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column's bytes stay near `most` in each piece."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
        at, held = 0, 0
        for i, n in enumerate(lengths):
            if i > at and held + n > most:
                yield batch.slice(at, i - at)
                at, held = i, 0
            held += n
        yield batch.slice(at)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes end to end, and where each row begins (null: empty)."""
    column = pa.compute.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each row the index of its first word (one more at the end)."""
    full = np.zeros(len(data) + 2, bool)
    full[1:-1] = ~SPACE[data]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    begins, ends = full[1:-1] & ~full[:-2], full[1:-1] & ~full[2:]
    begins[inner] |= full[1:-1][inner]
    ends[inner - 1] |= full[1:-1][inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words and of runs of words, for whole slices at once.

    A word's hash is a polynomial in an odd base over random byte values modulo 2^64, taken from prefix
    sums, then mixed with the length; a run's is the same over its words' hashes. Hashes find candidates; where a contract is
    exact, a wrong match needs a 64-bit collision (two hashers give 128 bits).
    """

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1, 2**62)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", self.inverse)):
                run = np.full(n, base, np.uint64)
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))
        return self.up, self.down

    def sums(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        up, down = self.powers(len(values) + 1)
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=total[1:])
        return (total[ends] - total[starts]) * down[starts]

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.sums(self.values[data], starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def runs(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix(self.sums(words, starts, ends) + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def sliced(docs: DataFrame, key: str, text: str, most: int = SLICE_BYTES) -> DataFrame:
    """docs as rows of some megabytes: slice (its number), keys and offsets (int64), body (the texts' bytes, zstd), words (their count). Null text: empty."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        press, number = zstandard.ZstdCompressor(3), TaskContext.get().partitionId() << 32
        for batch in slices(batches, text, most):
            data, offsets = column_bytes(batch.column(1))
            keys = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            words = len(word_spans(data, offsets)[0])
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([keys.tobytes()]), pa.array([offsets.tobytes()]), pa.array([press.compress(data.tobytes())]), pa.array([words])], names=["slice", "keys", "offsets", "body", "words"])
            number += 1

    return docs.filter(docs[key].isNotNull()).select(docs[key].cast("long"), docs[text]).mapInArrow(run, "slice long, keys binary, offsets binary, body binary, words long")


def unsliced(keys: bytes, offsets: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, bytes and offsets of a slice."""
    import zstandard

    return np.frombuffer(keys, np.int64), np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), np.frombuffer(offsets, np.int64)
