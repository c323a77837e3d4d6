"""Ranking files by coverage, weight and closeness of their matches; hotspots; stratified samples. Grouped aggregates and windows only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the score.
COVERAGE_POWER, SIZE_OFFSET, CLUSTER_GAP, CLUSTER_BONUS, POINTS, SURPRISE_FILES = 1.5, 10, 20, 0.5, 4096, 3


def _weights(weights: dict[str, float] | None, pattern: Column) -> Column:
    out = F.lit(1.0)
    for name, w in sorted((weights or {}).items()):
        out = F.when(pattern == name, F.lit(float(w))).otherwise(out)
    return out


def clusters(rows: DataFrame) -> DataFrame:
    """file, island, first and last line, distinct patterns and points of runs of matches whose lines differ by at most 20; 4096 points of a file at most."""
    return _islands(rows).filter("island >= 0")


def _islands(rows: DataFrame) -> DataFrame:
    """The clusters, and as island -1 what lies beyond a file's 4096 points."""
    order = Window.partitionBy("file").orderBy("from", "pattern_index")
    points = rows.withColumn("__late", F.row_number().over(order) > POINTS)
    by_line = Window.partitionBy("file").orderBy("__late", "line", "pattern_index", "from")
    gap = F.col("line") - F.lag("line").over(by_line) > CLUSTER_GAP
    island = F.sum(F.coalesce(gap, F.lit(False)).cast("int")).over(by_line.rowsBetween(Window.unboundedPreceding, 0))
    keyed = points.withColumn("island", F.when(F.col("__late"), -1).otherwise(island))
    return keyed.groupBy("file", "island").agg(F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.sort_array(F.collect_set("pattern_id")).alias("patterns"), F.count(F.lit(1)).alias("points"))


def surprise(rows: DataFrame) -> DataFrame:
    """pattern_id, surprise: max(1, ln((N + 1) / (df + 1)) + 1) over the N files with a match; 1 for all if there are fewer than three."""
    n = rows.agg(F.count_distinct("file").alias("files"))
    df = rows.groupBy("pattern_id").agg(F.count_distinct("file").alias("df"))
    value = F.greatest(F.lit(1.0), F.log((F.col("files") + 1) / (F.col("df") + 1)) + 1)
    return df.join(F.broadcast(n)).select("pattern_id", F.when(F.col("files") >= SURPRISE_FILES, value).otherwise(1.0).alias("surprise"))


def files(rows: DataFrame, line_counts: DataFrame, queried: int, weights: dict[str, float] | None = None, use_surprise: bool = False, rich: bool = False) -> DataFrame:
    """file, score, density, matched_patterns of every file with a match. line_counts: file, line_count.

    score = (matched / queried)^1.5 * sum of weights / ln(lines + 10) + bonus; a cluster of two or more patterns gives 0.5 (rich: 0.5 for each pattern but one).
    """
    return _scored(rows, line_counts, queried, weights, use_surprise, rich).drop("best")


def _scored(rows: DataFrame, line_counts: DataFrame, queried: int, weights: dict[str, float] | None, use_surprise: bool = False, rich: bool = False) -> DataFrame:
    """files(), with the best window of each. One pass over the rows; surprise takes a second one."""
    inside, ids = F.col("island") >= 0, F.size("patterns")
    bonus = F.when(inside & (ids >= 2), CLUSTER_BONUS * (ids - 1) if rich else F.lit(CLUSTER_BONUS)).otherwise(0.0)
    window = F.when(inside, F.struct(ids.alias("ids"), "points", (-F.col("line_start")).alias("early"), "line_end", "patterns"))
    per_file = _islands(rows).groupBy("file").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("patterns")))).alias("matched_patterns"), F.sum(bonus).alias("bonus"), F.max(window).alias("best"))
    if use_surprise:
        seen = per_file.select("file", F.explode("matched_patterns").alias("pattern_id")).join(F.broadcast(surprise(rows)), "pattern_id")
        summed = seen.groupBy("file").agg(F.sum(_weights(weights, F.col("pattern_id")) * F.col("surprise")).alias("weights"))
        per_file = per_file.join(summed, "file")
    else:
        per_file = per_file.withColumn("weights", F.aggregate("matched_patterns", F.lit(0.0), lambda total, x: total + _weights(weights, x)))
    cover = F.least(F.lit(1.0), F.pow(F.size("matched_patterns") / F.lit(float(queried)), F.lit(COVERAGE_POWER)))
    joined = per_file.join(line_counts.select("file", "line_count"), "file")
    score = cover * F.col("weights") / F.log(F.col("line_count") + SIZE_OFFSET) + F.col("bonus")
    return joined.select("file", score.alias("score"), (F.col("weights") / F.greatest(F.col("line_count"), F.lit(1))).alias("density"), "matched_patterns", "best")


def hotspots(rows: DataFrame, line_counts: DataFrame, queried: int, top: int, weights: dict[str, float] | None = None) -> DataFrame:
    """The top files with their best window: most patterns, then most points, then the earliest."""
    ranked = _scored(rows, line_counts, queried, weights).orderBy(F.desc("score"), F.desc("density"), "file").limit(top)
    return ranked.select(F.lit("hotspot").alias("type"), "file", "score", (-F.col("best.early")).alias("line_start"), F.col("best.line_end").alias("line_end"), F.col("best.patterns").alias("patterns"))


def order_files(listed: DataFrame, by: str) -> DataFrame:
    """A file list by score, count or path; ties in walk order."""
    key = {"score": F.desc("score"), "count": F.desc("count"), "path": F.asc("file")}[by]
    return listed.orderBy(key, "walk_ord")


def sample(rows: DataFrame, most: int) -> DataFrame:
    """Stratified sample: files in turn, within a file one line shape after the other. A shape is the line with digits and words blurred."""
    shape = F.regexp_replace(F.regexp_replace("context", "[0-9]+", "0"), "[A-Za-z_]+", "a")
    order = Window.partitionBy("file").orderBy("from", "pattern_index")
    in_shape = Window.partitionBy("file", "__shape").orderBy("from", "pattern_index")
    marked = rows.withColumn("__shape", shape).withColumn("__at", F.row_number().over(order)).withColumn("__first", F.min("__at").over(Window.partitionBy("file", "__shape"))).withColumn("__in", F.row_number().over(in_shape))
    turn = Window.partitionBy("file").orderBy("__first", "__in")
    return marked.withColumn("__turn", F.row_number().over(turn)).orderBy("__turn", "walk_ord").limit(most).select(*rows.columns)
