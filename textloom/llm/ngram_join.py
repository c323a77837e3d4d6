"""N-gram Jaccard join by a token-group matrix.

A document's set is its distinct word shingles. Only classes of equal sets and the links between different sets are found; the result is each document's
component under links, so groups of copies are never expanded into pairs.

1. Counts: one pass gives each set's size and 128-bit mark and a table of `CELLS` shingle counts, of fixed size.
2. Order and prefixes: shingles are ordered by the class of their count, then by hash. Two sets that link share at least L shingles among the first
   n - ceil(0.8 n) + L of each in any fixed order, so only these prefixes travel (L is 2 + n / 16, for small sets 1); common passages come last in the order and rarely travel.
3. Groups: in each token's bucket, sets of similar size meet the first of them; each set is compared with the first that it meets most often, and verified links give the first components, which are the groups.
4. Matrix: before it, `TURNS` rounds compare each set with one neighbour in its tokens' lists, which joins near copies without their pairs. Then a set keeps the tokens that a similar holder of them could share
   (`_reduced`), all but the last L - 1 of them in the order of their holders. For each such token the matrix has the groups whose members hold it, with their sizes and tokens of their own. Two groups meet once at a token, unless
   they have met at the one before, and only groups of more than one holder are opened, for members of which the same holds. Pairs that are left must share L tokens (`_alike`); then they are verified exactly. Nothing is capped, so no link is lost.

Verification reads the texts of the documents in opened pairs again; a Bloom filter of fixed size spares the others.
Shingles match by 64-bit hashes.

Defined cases: null and empty texts have the empty set and link with nothing; texts of fewer words than a shingle are one shingle; rows that repeat a doc_id have their own sets and links, and are one node of the
components: what one of them reaches, all reach (`copies` leaves them apart); rows whose doc_id is null link with nothing and have no component; ties go to the smallest doc_id; an empty table gives an empty
result. Other columns are not read.

A set's row is named by its doc_id; rows of a doc_id that stands with several sets are named by a 63-bit hash of doc_id and set instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, Hasher, column_bytes, forget, mix, slices, table, word_spans, written

SHINGLE = 5
CELLS, CHUNK = 1 << 20, 1 << 16
BLOOM_BITS, BLOOM_CHUNK = 1 << 25, 1 << 19
ENTRIES = 1_200_000
TURNS = 1
#: Similarity of four fifths, as whole numbers.
NUM, DEN = 4, 5


class Sets:
    """The shingle sets of a slice's documents: sorted distinct hashes end to end, and where each document's begin."""

    def __init__(self, column: pa.Array, hasher: Hasher, size: int = SHINGLE):
        data, offsets = column_bytes(column)
        starts, ends, first = word_spans(data, offsets)
        words = hasher.words(LOWER[data], starts, ends)
        count = np.diff(first)
        shingles = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(count)), shingles)
        begin = np.arange(len(owner)) - np.repeat(np.cumsum(shingles) - shingles, shingles) + first[:-1][owner]
        hashed = hasher.runs(words, begin, np.minimum(begin + size, first[1:][owner]))
        order = np.lexsort((hashed, owner))
        hashed, owner = hashed[order], owner[order]
        new = np.ones(len(hashed), bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (owner[1:] != owner[:-1])
        self.hash, self.owner = hashed[new], owner[new]
        self.n = np.bincount(self.owner, minlength=len(count))
        self.begin = np.concatenate(([0], np.cumsum(self.n)))

    def marks(self) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for salt in (0x1234567, 0x89ABCDE):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(self.hash ^ np.uint64(salt)), dtype=np.uint64)))
            out.append((total[self.begin[1:]] - total[self.begin[:-1]]).view(np.int64))
        return out[0], out[1]


def hasher() -> Hasher:
    return Hasher(303)


def _counted(text: str, size: int):
    def run(batches):
        h, counts = hasher(), np.zeros(CELLS, np.int64)
        for batch in slices(batches, text):
            s = Sets(batch.column(1), h, size)
            counts += np.bincount((s.hash % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
            one, two = s.marks()
            n = len(s.n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(s.n.astype(np.int64)), pa.array(one), pa.array(two), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc", "th", "n", "one", "two", "chunk", "salt", "cells"])
        part, k = TaskContext.get().partitionId() % 64, CELLS // CHUNK
        cells = [counts[i * CHUNK : (i + 1) * CHUNK].tobytes() for i in range(k)]
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 5 + [pa.array(range(k), pa.int32()), pa.array([part] * k, pa.int32()), pa.array(cells)], names=["doc", "th", "n", "one", "two", "chunk", "salt", "cells"])

    return run


def _merged(column: str, kind, join):
    """Rows of a group whose bytes are joined to one row."""

    def run(group: pa.Table) -> pa.Table:
        total = None
        for x in group.column(column):
            x = np.frombuffer(x.as_py(), kind)
            total = x.copy() if total is None else join(total, x, out=total)
        return group.slice(0, 1).set_column(group.column_names.index(column), column, pa.array([total.tobytes()]))

    return run


def _ordered(s: Sets, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the prefix shingles in s, by document and order, and their positions in the order."""
    order = np.lexsort((s.hash, classes[(s.hash % np.uint64(CELLS)).astype(np.int64)], s.owner))
    need = -(-NUM * s.n // DEN)
    length = np.minimum(s.n, s.n - need + np.where(s.n >= 10, 2 + s.n // 16, 1))
    within = np.arange(len(order)) - s.begin[s.owner[order]]
    kept = within < length[s.owner[order]]
    return order[kept], within[kept]


def _named(ids: np.ndarray, one: np.ndarray, two: np.ndarray, several) -> np.ndarray:
    """A row's name: its doc_id, or a hash of that and its set's mark if the doc_id is in the filter `several` (None: no doc_id has several sets)."""
    if several is None:
        return ids
    hashed = mix(one.view(np.uint64) ^ mix(two.view(np.uint64) ^ mix(ids.view(np.uint64)))) | np.uint64(1 << 63)
    return np.where(_has(several.value, ids), hashed.view(np.int64), ids)


def _meta(several):
    """name, doc, th, n, one, two of the rows doc, th, n, one, two."""

    def run(batches):
        for batch in batches:
            doc, one, two = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3, 4))
            yield pa.RecordBatch.from_arrays([pa.array(_named(doc, one, two, several)), *batch.columns], names=["name", *batch.schema.names])

    return run


def _prefixes(text: str, size: int, buckets: int, classes, several):
    def run(batches):
        h = hasher()
        for batch in slices(batches, text):
            s = Sets(batch.column(1), h, size)
            one, two = s.marks()
            keys = _named(batch.column(0).to_numpy(zero_copy_only=False), one, two, several)
            _, first = np.unique(np.stack([one, two, s.n]), axis=1, return_index=True)
            alone = np.zeros(len(keys), bool)
            alone[first] = True  # one of each class of equal sets in the slice
            at, position = _ordered(s, classes.value)
            at, position = at[alone[s.owner[at]]], position[alone[s.owner[at]]]
            bucket = (s.hash[at] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            at, position, bucket = at[order], position[order], bucket[order]
            found, begin = np.unique(bucket, return_index=True)
            end = np.append(begin, len(bucket))[1:]  # none of none
            columns = (s.hash[at], keys[s.owner[at]].astype(np.int64), s.n[s.owner[at]].astype(np.int32), position.astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *(pa.array([c[b:e].tobytes() for b, e in zip(begin, end, strict=True)], pa.binary()) for c in columns)], names=["bucket", "tokens", "docs", "sizes", "places"])

    return run


def _met(group: pa.Table) -> pa.Table:
    """Per bucket: edge rows (kind 0: first document of the token's size band, other document, hits) and the rows of tokens that two documents hold (kind 1: token, document, size, position)."""
    token, doc, n, i = (np.concatenate([np.frombuffer(x, k) for x in group.column(c).to_pylist()]) for c, k in (("tokens", np.uint64), ("docs", np.int64), ("sizes", np.int32), ("places", np.int32)))
    order = np.lexsort((doc, token))
    token, doc, n, i = token[order], doc[order], n[order], i[order]
    same = token[1:] == token[:-1]
    several = np.zeros(len(token), bool)
    several[1:] |= same
    several[:-1] |= same
    token, doc, n, i = token[several], doc[several], n[several], i[several]
    band = np.floor(np.log(np.maximum(n, 1)) / np.log(DEN / NUM) + 1e-9).astype(np.int64)
    order = np.lexsort((doc, band, token))
    t, b, d = token[order], band[order], doc[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (b[1:] != b[:-1])
    leader = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(d) else d
    pairs, hits = np.unique(np.stack([leader, d])[:, leader != d], axis=1, return_counts=True)
    return pa.table(
        {
            "kind": pa.array(np.repeat([0, 1], [pairs.shape[1], len(token)]).astype(np.int32)),
            "x": pa.array(np.concatenate([pairs[0], token.view(np.int64)])),
            "y": pa.array(np.concatenate([pairs[1], doc])),
            "n": pa.array(np.concatenate([hits, n]).astype(np.int32)),
            "i": pa.array(np.concatenate([np.zeros(len(hits)), i]).astype(np.int32)),
        }
    )


class Bloom:
    """A filter of fixed size over document ids, built by Spark in chunks."""

    def __init__(self, ids: DataFrame, column: str):
        def run(batches):
            bits = np.zeros(BLOOM_BITS // 8, np.uint8)
            for batch in batches:
                for p in self.probes(batch.column(0).to_numpy()):
                    np.bitwise_or.at(bits, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
            size = BLOOM_CHUNK // 8
            full = [i for i in range(len(bits) // size) if bits[i * size : (i + 1) * size].any()]
            part = TaskContext.get().partitionId() % 64
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([part] * len(full), pa.int32()), pa.array([bits[i * size : (i + 1) * size].tobytes() for i in full], pa.binary())], names=["chunk", "salt", "cells"])

        schema = "chunk int, salt int, cells binary"
        told = ids.select(column).mapInArrow(run, schema)
        join = _merged("cells", np.uint8, np.bitwise_or)
        rows = told.groupBy("chunk", "salt").applyInArrow(join, schema).groupBy("chunk").applyInArrow(join, schema).collect()  # BLOOM_BITS at most
        self.bits = np.zeros(BLOOM_BITS // 8, np.uint8)
        for r in rows:
            self.bits[r.chunk * (BLOOM_CHUNK // 8) : (r.chunk + 1) * (BLOOM_CHUNK // 8)] = np.frombuffer(r.cells, np.uint8)

    @staticmethod
    def probes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77))
        return (x % np.uint64(BLOOM_BITS)).astype(np.int64), (mix(x) % np.uint64(BLOOM_BITS)).astype(np.int64)


def _has(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    out = np.ones(len(ids), bool)
    for p in Bloom.probes(ids):
        out &= (bits[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
    return out


def _needed(text: str, size: int, bits, several):
    def run(batches):
        h = hasher()
        for batch in slices(batches, text):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(_has(bits.value, ids) if several is None else _has(bits.value, ids) | _has(several.value, ids)))
            if not batch.num_rows:
                continue
            s = Sets(batch.column(1), h, size)
            found = pa.RecordBatch.from_arrays([pa.array(_named(batch.column(0).to_numpy(zero_copy_only=False), *s.marks(), several)), pa.array([s.hash[b:e].tobytes() for b, e in zip(s.begin[:-1], s.begin[1:], strict=True)], pa.binary())], names=["doc", "tokens"])
            yield found if several is None else found.filter(pa.array(_has(bits.value, found.column(0).to_numpy())))

    return run


def _linked(batches):
    """Pairs (a, b, tokens of both) that link: 100 * intersection >= 80 * union."""

    for batch in batches:
        keep, last, held = [], None, None
        for a, x, y in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if a != last:
                last, held = a, np.frombuffer(x.as_py(), np.uint64)
            y = np.frombuffer(y.as_py(), np.uint64)
            common = 0
            if len(held) and len(y):
                at = np.searchsorted(held, y)
                common = int((held[np.minimum(at, len(held) - 1)] == y).sum())
            keep.append(common > 0 and 100 * common >= 80 * (len(held) + len(y) - common))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def verified(docs: DataFrame, text: str, pairs: DataFrame, size: int, several=None) -> DataFrame:
    """The pairs (a, b) that link, written."""
    spark = docs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    bits = spark.sparkContext.broadcast(Bloom(ids, "doc").bits)
    needed = docs.mapInArrow(_needed(text, size, bits, several), "doc long, tokens binary").dropDuplicates(["doc"])
    right = pairs.join(needed.select(F.col("doc").alias("b"), F.col("tokens").alias("y")), "b")
    both = right.join(needed.select(F.col("doc").alias("a"), F.col("tokens").alias("x")), "a")
    return written(both.select("a", "b", "x", "y").mapInArrow(_linked, "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node and its component's smallest node, for the nodes in links: smallest labels of neighbours, then the label's own label, until nothing changes."""
    sides = written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a")).distinct(), "sides")
    labels = written(sides.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("comp")), "labels")
    while True:
        near = sides.join(labels.select(F.col("node").alias("v"), "comp"), "v").groupBy(F.col("u").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        up = step.select(F.col("node").alias("comp"), F.col("comp").alias("upper"))
        after = written(step.join(up, "comp").select("node", "old", F.col("upper").alias("comp")), "labels")
        labels = after.select("node", "comp")
        if after.filter("old <> comp").limit(1).count() == 0:
            return labels


def _neighbours(held: DataFrame, turn: int) -> DataFrame:
    """Each set and, of the sets of other components that stand before it in its tokens' shuffled lists, the one it meets most often."""
    before = F.lag(F.struct("rep", "comp", "n")).over(Window.partitionBy("token").orderBy(F.xxhash64("rep", F.lit(turn)), "rep"))
    met = held.withColumn("p", before).filter(f"p is not null and p.comp <> comp and {DEN} * n >= {NUM} * p.n and {DEN} * p.n >= {NUM} * n")
    best = met.groupBy("rep", F.col("p.rep").alias("other")).agg(F.count(F.lit(1)).alias("hits")).groupBy("rep").agg(F.max_by("other", F.struct("hits", -F.col("other"))).alias("other"))
    return best.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct()


def _reduced(held: DataFrame) -> DataFrame:
    """token, rep, comp, n, i, own (tokens up to this one that no other component's prefix holds), rare (whether the set meets others by it), prev (the rare token before) of the tokens that a similar set can share.

    A set's tokens up to a common one that nobody else holds are in no similar set: it has n - ceil(4 n / 5) such at most. Of the tokens that are left, similar sets share L or more; so they
    share one of all but the last L - 1 in any order, here that of the tokens' holders, in which what a large family has in common comes last.
    """
    all_of = f"ceil({NUM} * n / {DEN})"
    by_token = Window.partitionBy("token")
    ranked = held.withColumn("own", F.col("i") + 1 - F.row_number().over(Window.partitionBy("rep").orderBy("i", "token")))
    # what a similar set has in common with this one at least: it holds the token, so it has `least` shingles or more
    common = f"greatest({all_of}, ceil(4 * (n + least) / 9))"
    close = ranked.withColumn("least", F.min("n").over(by_token)).filter(f"n - own >= {common} and n - i >= {common} - {_least('n')} + 1")
    apart = close.withColumns({"low": F.min("comp").over(by_token), "high": F.max("comp").over(by_token), "holders": F.count(F.lit(1)).over(by_token)}).filter("low < high")
    by_rep = Window.partitionBy("rep")
    rare = by_rep.orderBy("holders", "token")
    placed = apart.withColumns({"tokens": F.count(F.lit(1)).over(by_rep), "turn": F.row_number().over(rare), "prev": F.lag("token").over(rare)})
    return placed.filter(f"tokens >= {_least(all_of)}").select("token", "rep", "comp", "n", "i", "own", F.expr(f"turn <= tokens - {_least(all_of)} + 1").alias("rare"), "prev")


def _alike(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that share L tokens of rows, with at most (n + m) / 9 tokens of one only up to the L-th."""
    place = F.struct("i", "token")
    lists = rows.groupBy("rep").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(place)).alias("p")).select("rep", "n", F.col("p.token").alias("tokens"), F.col("p.i").alias("places"))
    side = lambda x: lists.select(F.col("rep").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("n", "tokens", "places")))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumns({"l": F.expr(_least("least(a_n, b_n)")).cast("int"), "common": F.array_intersect("a_tokens", "b_tokens")}).filter("size(common) >= l")
    at = lambda x: f"element_at({x}_places, cast(array_position({x}_tokens, element_at(common, l)) as int))"
    return both.filter(f"9 * ({at('a')} + {at('b')} + 2 - 2 * l) <= a_n + b_n").select("a", "b")


def _opened(held: DataFrame) -> DataFrame:
    """Pairs of sets of different components that the matrix and then the members' own tokens leave possible.

    Where the reduced tokens before are equal, too, a pair has met there already.
    """
    every = written(_reduced(held), "reduced")
    rows = every.filter("rare")
    matrix = rows.groupBy("token", F.col("comp").alias("group")).agg(F.min("n").alias("least"), F.max("n").alias("most"), F.min("own").alias("fewest"), F.max(F.col("n") - F.col("own")).alias("rest"), F.min("rep").alias("one"), F.max("rep").alias("two"), F.count(F.lit(1)).alias("holders"), F.min("prev").alias("before"), F.max("prev").alias("after"), F.count("prev").alias("later"))
    # of two groups, the members of the one with fewer holders meet the other's row
    sides = rows.withColumn("beside", F.count(F.lit(1)).over(Window.partitionBy("token", "comp")))
    possible = f"n - own >= ceil(4 * (n + least) / 9) and rest >= ceil(4 * (n + least) / 9) and 9 * (own + fewest) <= n + most"
    begins = "prev is null or later < holders or before < after or prev <> before"
    foreign = sides.join(matrix, "token").filter("comp <> group and (beside < holders or beside = holders and comp < group)").filter(f"{DEN} * n >= {NUM} * least and {NUM} * n <= {DEN} * most and {possible} and ({begins})")
    fits = lambda size, own: f"{DEN} * n >= {NUM} * {size} and {DEN} * {size} >= {NUM} * n and least(n - own, {size} - {own}) >= ceil(4 * (n + {size}) / 9)"
    foreign = foreign.select("token", "rep", "n", "own", "prev", "group", "one", "two", "least", "fewest").filter(f"one <> two or {fits('least', 'fewest')}")
    single = foreign.filter("one = two").select("rep", F.col("one").alias("other"))
    members = rows.select("token", F.col("comp").alias("group"), F.col("rep").alias("other"), F.col("n").alias("size"), F.col("own").alias("their"), F.col("prev").alias("last"))
    met = foreign.filter("one <> two").join(members, ["token", "group"])
    found = met.filter(f"{fits('size', 'their')} and 9 * (own + their) <= n + size and (prev is null or last is null or prev <> last)")
    found = found.select("rep", "other").union(single)
    return _alike(every, found.select(F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")).distinct())


def _least(n: str) -> str:
    """SQL for L of a set of n shingles."""
    return f"if({n} >= 10, 2 + floor({n} / 16), 1)"


def _read(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("text"), F.xxhash64(docs[text]).alias("th"))


def _linked_sets(docs: DataFrame, size: int) -> tuple[DataFrame, DataFrame, bool]:
    """Of docs (doc, text, th): rows (name, doc, th, n, rep: the name of the first row of an equal set) and links between reps; whether any doc has several sets."""
    spark = docs.sparkSession
    told = written(docs.mapInArrow(_counted("text", size), "doc long, th long, n long, one long, two long, chunk int, salt int, cells binary"), "counts")
    summed = _merged("cells", np.int64, np.add)
    cells = "chunk int, salt int, cells binary"
    chunks = told.filter("chunk is not null").select("chunk", "salt", "cells").groupBy("chunk", "salt").applyInArrow(summed, cells).groupBy("chunk").applyInArrow(summed, cells).collect()  # CELLS numbers in all
    counts = np.zeros(CELLS, np.int64)
    for r in chunks:
        counts[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.cells, np.int64)
    total = int(counts.sum())
    common = counts / (1.5 * max(1.0, total / CELLS))
    classes = spark.sparkContext.broadcast(np.where(common > 1, 2 * np.log2(np.maximum(common, 1)) + 1, 0).astype(np.int8))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (4 * ENTRIES))

    meta = told.filter("chunk is null").select("doc", "th", "n", "one", "two")
    mark = F.struct("n", "one", "two")
    repeats = meta.groupBy("doc").agg(F.min(mark).alias("low"), F.max(mark).alias("high")).filter("low <> high").select("doc")
    several = None if repeats.isEmpty() else spark.sparkContext.broadcast(Bloom(repeats, "doc").bits)
    meta = meta.mapInArrow(_meta(several), "name long, doc long, th long, n long, one long, two long")
    reps = meta.filter("n > 0").groupBy("n", "one", "two").agg(F.min("name").alias("rep"))
    rep_of = written(meta.join(reps, ["n", "one", "two"], "left").select("name", "doc", "th", "n", F.coalesce("rep", "name").alias("rep")), "classes")
    forget(told)
    one_rep = rep_of.filter("n > 0").groupBy(F.col("name").alias("doc")).agg(F.min("rep").alias("rep"))

    sent = docs.mapInArrow(_prefixes("text", size, buckets, classes, several), "bucket int, tokens binary, docs binary, sizes binary, places binary")
    met = written(sent.groupBy("bucket").applyInArrow(_met, "kind int, x long, y long, n int, i int"), "tokens")

    # round one: each document and the first document with which it shares most tokens
    best = met.filter("kind = 0").groupBy("x", "y").agg(F.sum("n").alias("hits")).groupBy("y").agg(F.max_by("x", F.struct("hits", -F.col("x"))).alias("x"))
    left = best.join(one_rep.select(F.col("doc").alias("x"), F.col("rep").alias("a")), "x")
    both = left.join(one_rep.select(F.col("doc").alias("y"), F.col("rep").alias("b")), "y").filter("a <> b")
    pairs = written(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    links = verified(docs, "text", pairs, size, several)
    comps = components(links)
    by_token = Window.partitionBy("token")
    held = None
    # rounds over neighbours in shuffled token lists, a row for each token at most, join what hangs together; the last round opens every group that the bounds leave
    for turn in range(1, TURNS + 2):
        named = comps.withColumnRenamed("node", "rep")
        if held is None:
            labels = one_rep.join(named, "rep", "left").select("doc", "rep", F.coalesce("comp", "rep").alias("comp"))
            rows = met.filter("kind = 1").select(F.col("x").alias("token"), F.col("y").alias("doc"), "n", "i").join(labels, "doc").drop("doc")
        else:
            rows = held.drop("comp").join(named, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        apart = rows.withColumn("low", F.min("comp").over(by_token)).withColumn("high", F.max("comp").over(by_token)).filter("low < high")
        read = met if held is None else held
        held = written(apart.groupBy("token", "rep", "comp").agg(F.max("n").alias("n"), F.max("i").alias("i")), "held")
        forget(read)
        if turn <= TURNS:
            found = _neighbours(held, turn)
        else:
            found = _opened(held)
        found = found.join(pairs, ["a", "b"], "left_anti")
        more = written(found, "pairs")
        if more.limit(1).count():
            pairs = pairs.union(more)
            links = links.union(verified(docs, "text", more, size, several))
            comps = components(links)
    return rep_of, links, several is not None


def _with_components(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows with comp: the smallest rep that links reach."""
    return rows.join(components(links).withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def join(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """key, n_shingles, component_id of every row."""
    read = _read(docs, key, text)
    rows, links, several = _linked_sets(read.filter("doc is not null"), size)
    if several:  # rows of one doc_id hang together, and names are no doc_ids any more
        first = rows.groupBy("doc").agg(F.min("rep").alias("a"))
        links = links.union(rows.join(first, "doc").filter("a <> rep").select("a", F.col("rep").alias("b")).distinct())
        found = written(_with_components(rows, links).select("doc", "n", "comp"), "components")
        found = found.join(found.groupBy("comp").agg(F.min("doc").alias("least")), "comp").select("doc", "n", F.col("least").alias("comp"))
    else:
        found = _with_components(rows, links)
    named = found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
    unnamed = read.filter("doc is null").mapInArrow(_counted("text", size), "doc long, th long, n long, one long, two long, chunk int, salt int, cells binary").filter("chunk is null")
    return named.union(unnamed.select("doc", "n", F.lit(None).cast("long")))


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE) -> DataFrame:
    """doc and th (its text's hash, as xxhash64 gives it) of the rows that are not the first, by doc and th, of a component; here rows of one doc_id with different sets are nodes of their own."""
    rows, links, _ = _linked_sets(_read(docs, key, text).filter("doc is not null"), size)
    found = written(_with_components(rows.filter("n > 0"), links).select("doc", "th", "comp"), "components")
    first = found.groupBy("comp").agg(F.min(F.struct("doc", "th")).alias("first"))
    return found.join(first, "comp").filter(F.struct("doc", "th") != F.col("first")).select("doc", "th").distinct()


def query(spark, sf_dir: str) -> DataFrame:
    """op7: set size and component of every document."""
    return join(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS i, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT DISTINCT i, doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT i, doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT i, count(*) AS n FROM g GROUP BY i),
c AS (SELECT a.i, b.i AS j, any_value(a.doc_id) AS x, any_value(b.doc_id) AS y, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT DISTINCT x, y FROM c JOIN n p ON p.i = c.i JOIN n q ON q.i = c.j WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (i) LEFT JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) m USING (doc_id)
"""
