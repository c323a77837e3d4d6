"""Row numbers and running sums in a total order, without bringing all rows to one task.

Rows are range-partitioned and sorted, and written so that they keep their places; a number for each range (its rows, or its sum) gives every range its offset, and rows add their own place within the range.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.shared import kept

def _range() -> Column:
    return F.shiftright("__place", 33).cast("int")


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df in written ranges of the order, with __place: the range above 33 bits, the row's number in it below."""
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = kept(df, "rows").repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    return kept(rows.withColumn("__place", F.monotonically_increasing_id()), "ranges")


def numbered(df: DataFrame, order: list[str], name: str, first: int = 0) -> DataFrame:
    """df with the rows' numbers in the order, from `first`. Ties are numbered in any order."""
    placed = _placed(df, order)
    counts = {r.at: r.n for r in placed.groupBy(_range().alias("at")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one for each range
    before = [0, *accumulate(counts.get(i, 0) for i in range(max(counts, default=0)))]
    return placed.withColumn(name, F.get(F.lit(before).cast("array<long>"), _range()) + F.col("__place").bitwiseAND((1 << 33) - 1) + first).drop("__place")


def prefixes(df: DataFrame, order: list[str], sums: dict[str, Column], lasts: dict[str, Column] | None = None) -> DataFrame:
    """df with what stands before each row in the order: the sum of some values, the last text that is not null of others, by the names of the new columns."""
    lasts = lasts or {}
    own = {n: F.coalesce(c.cast("long"), F.lit(0)).alias(f"__{n}") for n, c in sums.items()} | {n: c.cast("string").alias(f"__{n}") for n, c in lasts.items()}
    placed = _placed(df.select("*", *own.values()), order)
    value = lambda n: F.col(f"__{n}")
    totals = [F.sum(value(n)).alias(n) for n in sums] + [F.max_by(value(n), F.when(value(n).isNotNull(), F.col("__place"))).alias(n) for n in lasts]
    ranges = {r["__at"]: r for r in placed.groupBy(_range().alias("__at")).agg(*totals).collect()}  # one for each range
    before, held = [], dict.fromkeys(sums, 0) | dict.fromkeys(lasts)
    for i in range(max(ranges, default=-1) + 1):
        before.append(dict(held))
        if i in ranges:
            held |= {n: held[n] + ranges[i][n] for n in sums} | {n: ranges[i][n] for n in lasts if ranges[i][n] is not None}
    run = Window.partitionBy(_range()).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1)
    earlier = lambda n, kind: F.get(F.array(*(F.lit(b[n]).cast(kind) for b in before)).cast(f"array<{kind}>"), _range())
    columns = {n: earlier(n, "long") + F.coalesce(F.sum(value(n)).over(run), F.lit(0)) for n in sums} | {n: F.coalesce(F.last(value(n), ignorenulls=True).over(run), earlier(n, "string")) for n in lasts}
    return placed.withColumns(columns).drop("__place", *(f"__{n}" for n in columns))


def running(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of the values of the rows before each one in the order."""
    return prefixes(df, order, {name: value})
