"""Audit of how filters interact, over every order of them.

Filters: A too few words, B too many repeated words, C too many capitals, D marks of markup, E a text that a smaller doc_id has too.

1. Sort: rows are range-sorted by text fingerprint (SHA-256), full text and doc_id. A range holds parts of a group of copies, however large, because doc_id is a sort key; ranges are cut
   by fingerprint and doc_id only, so that the sample that places them holds no texts.
2. Predecessors: each task reads its range in order, compares each text with the one before and so knows the smallest doc_id of its copies; in the same pass it works out filters A to D. A range's first
   group may have begun in an earlier range: its rows of the range's smallest doc_id wait for what the boundary records (one for each range: first and last fingerprint with its smallest doc_id) say.
3. Masks: a row is now doc_id, part and a mask of five failures. Equal ones are counted before they meet the labels, and every part ends as at most 32 counters, which are additive.
4. Orders: from a part's counters alone, every step of every order: a filter at work removes those masks that hold its bit and none of the filters before it.

Defined cases: null texts are empty ones and copies of each other; rows without doc_id are copies of none and make none; rows that repeat a doc_id with the same text are copies of a smaller one only; labels that repeat a doc_id count
as 1 if any is; a null part is the empty string; long texts are read whole; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices, table, written

FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS = 50, 65, 5  # words at least; distinct words and capitals at most, in hundredths
_CAPITALS, _MARKS = bytes(range(65, 91)), b"#$%&*|"


def failures(text: bytes) -> int:
    """Bits 0 to 3: which of A to D the text fails."""
    words = text.split()  # of bytes: by \x20 and \x09-\x0D
    n = len(text)
    points = n if text.isascii() else len(text.decode())
    capitals = n - len(text.translate(None, _CAPITALS))
    marks = len(text.translate(None, _MARKS)) < n
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * capitals > CAPITALS * points) << 2 | marks << 3


class Copies:
    """Reads a range's rows in order and tells each one's place among its copies."""

    def __init__(self):
        self.first_print = self.print = self.text = None
        self.least = self.first_least = None

    def take(self, fingerprint: bytes, text: bytes, doc: int) -> tuple[bool, bool]:
        """Whether a smaller doc_id of the range has the text; whether that hangs on earlier ranges."""
        if fingerprint != self.print or text != self.text:
            self.print, self.text, self.least = fingerprint, text, doc
            if self.first_print is None:
                self.first_print, self.first_least = fingerprint, doc
        copy = doc > self.least
        return copy, not copy and fingerprint == self.first_print


_KINDS = [("range", pa.int32()), ("doc", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("waits", pa.bool_()), ("first", pa.binary()), ("first_least", pa.int64()), ("last", pa.binary()), ("last_least", pa.int64())]
_SCHEMA = "range int, doc long, part string, mask int, waits boolean, first binary, first_least long, last binary, last_least long"


def _batch(n: int, **given) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(given[c], k) if c in given else pa.nulls(n, k) for c, k in _KINDS], names=[c for c, _ in _KINDS])


def _texts(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _audited(batches):
    """Of fp, text, doc, part in order: a row for each, then the range's boundary record."""
    from pyspark import TaskContext

    copies, at = Copies(), TaskContext.get().partitionId()
    for batch in slices(batches):
        masks, waits = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, bool)
        before, mask = None, 0
        for i, (fp, text, doc) in enumerate(zip(batch.column(0).to_pylist(), _texts(batch.column(1)), batch.column(2).to_pylist(), strict=True)):
            copy, waits[i] = copies.take(fp, text, doc)
            if text != before:
                before, mask = text, failures(text)
            masks[i] = mask | copy << 4
        yield _batch(batch.num_rows, range=np.full(batch.num_rows, at, np.int32), doc=batch.column(2), part=batch.column(3), mask=masks, waits=waits)
    if copies.first_print is not None:
        yield _batch(1, range=[at], first=[copies.first_print], first_least=[copies.first_least], last=[copies.print], last_least=[copies.least])


def _unnamed(batches):
    """Rows without doc_id: copies of nothing."""
    for batch in slices(batches):
        masks = [failures(t) for t in _texts(batch.column(1))]
        yield _batch(batch.num_rows, part=batch.column(3), mask=masks, waits=np.zeros(batch.num_rows, bool))


def continued(edges: list[tuple]) -> list[int]:
    """Ranges whose waiting rows are copies: their first group began in an earlier range, with a smaller doc_id. edges: (range, first, first_least, last, last_least) in order."""
    out, held, least = [], None, None
    for at, first, first_least, last, last_least in edges:
        goes_on = first == held
        if goes_on and least < first_least:
            out.append(at)
        if not (goes_on and last == first):
            held, least = last, last_least
    return out


def masks(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc, part, mask (bit i: fails filter i) and n: how many rows have these."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(F.unhex(F.sha2(whole, 256)).alias("fp"), whole.alias("text"), docs[key].cast("long").alias("doc"), F.coalesce(docs[part], F.lit("")).alias("part"))
    ordered = rows.filter("doc is not null").repartitionByRange(ranges, "fp", "doc").sortWithinPartitions("fp", "text", "doc")
    found = written(ordered.mapInArrow(_audited, _SCHEMA).union(rows.filter("doc is null").mapInArrow(_unnamed, _SCHEMA)), "audit")
    edges = found.filter("first is not null").select("range", "first", "first_least", "last", "last_least").orderBy("range").collect()  # one for each range
    late = continued([(r["range"], bytes(r["first"]), r.first_least, bytes(r["last"]), r.last_least) for r in edges])
    mask = F.when(F.col("waits") & F.array_contains(F.lit(late or [-1]), F.col("range")), F.col("mask").bitwiseOR(16)).otherwise(F.col("mask"))
    return found.filter("first is null").groupBy("doc", "part", mask.alias("mask")).agg(F.count(F.lit(1)).alias("n"))


def counters(masked: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, n, good, toxic: arrays of 32 counts by mask."""
    flags = labels.filter(labels[key].isNotNull()).groupBy(labels[key].cast("long").alias("doc")).agg(F.max((F.col("quality") == 1).cast("long")).alias("good"), F.max((F.col("toxic") == 1).cast("long")).alias("toxic"))
    named = masked.filter("doc is not null").join(flags, "doc", "left").select("part", "mask", "n", "good", "toxic")
    rows = named.union(masked.filter("doc is null").select("part", "mask", "n", F.lit(0).cast("long"), F.lit(0).cast("long")))
    added = rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic")))
    slot = lambda c: F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in range(1 << len(FILTERS)))).alias(c)
    return added.groupBy("part").agg(*(slot(c) for c in ("n", "good", "toxic")))


def _steps() -> list[tuple[str, int, int, int]]:
    """(order, step, the filter's bit, bits of those before it) of every order."""
    return [("".join(order), k + 1, 1 << FILTERS.index(order[k]), sum(1 << FILTERS.index(f) for f in order[:k])) for order in permutations(FILTERS) for k in range(len(order))]


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step."""
    steps = _steps()
    listed = F.arrays_zip(*(F.lit([s[i] for s in steps]).alias(c) for i, c in enumerate(("filter_order", "step", "bit", "before"))))
    rows = counters(masks(docs, key, text, part), labels, key).select("*", F.explode(listed).alias("s")).select("part", "n", "good", "toxic", "s.*")
    every = range(1 << len(FILTERS))

    def total(column: str, holds) -> F.Column:
        return F.aggregate(F.arrays_zip(F.lit(list(every)).alias("m"), F.col(column).alias("c")), F.lit(0).cast("long"), lambda a, x: a + F.when(holds(x["m"]), x["c"]).otherwise(0))

    bit, before = F.col("bit"), F.col("before")
    fails, out = (lambda m: m.bitwiseAND(bit) != 0), (lambda m: m.bitwiseAND(before) != 0)
    goes = lambda m: fails(m) & ~out(m)
    # of a document that fails k filters, each is the first of the k in a k-th of all orders
    share = F.lit([0] + [len(steps) // len(FILTERS) // m.bit_count() for m in every if m])
    shapley = F.aggregate(F.arrays_zip(F.lit(list(every)).alias("m"), F.col("n").alias("c"), share.alias("s")), F.lit(0).cast("long"), lambda a, x: a + F.when(fails(x["m"]), x["c"] * x["s"]).otherwise(0))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: ~fails(m) & ~out(m)).alias("kept"),
        total("n", goes).alias("removed"),
        total("n", lambda m: fails(m) & out(m)).alias("redundant"),
        total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", goes).alias("good_lost"),
        total("toxic", goes).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op13: every order of five filters over all documents, by source."""
    return audit(table(spark, sf_dir, "documents", "doc_id", "text", "source"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


SQL = r"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, (len(w) < 50)::INTEGER AS a, (100 * len(list_distinct(w)) < 65 * len(w))::INTEGER AS b, (100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 5 * length(t))::INTEGER AS c,
      regexp_matches(t, '[#$%&*|]')::INTEGER AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS e, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM d LEFT JOIN l USING (doc_id)),
g AS (SELECT part, [a, b, c, d, e] AS f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
i AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [p.k, q.k, r.k, s.k, u.k] AS o FROM i p, i q, i r, i s, i u WHERE len(list_distinct([p.k, q.k, r.k, s.k, u.k])) = 5),
z AS (SELECT part, o, k AS step, f, n, good, toxic, f[o[k]] = 1 AS fails, list_sum(list_transform(o[1:k - 1], lambda j: f[j])) > 0 AS out FROM g, o, i),
y AS (SELECT part, o, step, any_value(o[step]) AS filter, sum(CASE WHEN NOT fails AND NOT coalesce(out, false) THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails AND NOT coalesce(out, false) THEN n ELSE 0 END) AS removed,
      sum(CASE WHEN fails AND out THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails AND list_sum(f) = 1 THEN n ELSE 0 END) AS unique_fails,
      sum(CASE WHEN fails AND NOT coalesce(out, false) THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails AND NOT coalesce(out, false) THEN toxic ELSE 0 END) AS toxic_lost FROM z GROUP BY part, o, step)
SELECT part, array_to_string(list_transform(o, lambda j: 'ABCDE'[j]), '') AS filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM y
"""
