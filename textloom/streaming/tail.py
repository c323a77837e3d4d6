"""The scan over a stream of texts: the matcher keeps no state, so each micro-batch is an ordinary scan."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.patterns import Pattern
from textloom.operators import scan
from textloom.sources.corpus import Corpus


def matches(stream: DataFrame, key: str, text: str, patterns: Iterable[Pattern], options: scan.Options = scan.Options()) -> DataFrame:
    """Match rows of a streaming (or static) table."""
    return scan.match(Corpus.from_table(stream, key, text), patterns, options=options)


def counts(stream: DataFrame, key: str, text: str, time: str, patterns: Iterable[Pattern], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Matches of each pattern by window of event time; rows later than the watermark are dropped."""
    names = [p.id for p in patterns]
    timed = stream.withWatermark(time, late).filter(F.col(text).isNotNull())
    hit = F.array(*[F.struct(F.lit(p.id).alias("pattern_id"), F.regexp_count(F.col(text), F.lit(f"{'(?i)' if p.case_insensitive else ''}(?md){p.regexp}")).alias("n")) for p in patterns])
    assert names
    return timed.select(time, F.explode(hit).alias("h")).groupBy(F.window(time, window), F.col("h.pattern_id").alias("pattern_id")).agg(F.sum("h.n").alias("matches"))


def follow(spark: SparkSession, folder: str, schema: str, key: str, text: str, patterns: list[Pattern], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A query over Parquet files as they arrive in a folder; the sink gets the match rows of each batch."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return matches(stream, key, text, patterns).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()
