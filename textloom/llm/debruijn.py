"""Substring dedup by a join of window hashes.

Windows of `WINDOW` words would be the edges of a token de Bruijn graph, but no graph is built here: there are no nodes, degrees or branching, and nothing is compacted by joins (the README has the figures of what
runs instead). A window is repeated if documents of smaller id hold it too; repeated windows that follow each other cover spans of words. Three passes over the texts, which lie in packed slices of some megabytes:

1. Anchors: each window's smallest hash of `GRAM` words in a row (about one anchor for five windows). Anchors that stand in one slice
   only cannot belong to a repeated edge. The others fill a Bloom filter of fixed size, each bucket its own segment.
2. Windows: those with a kept anchor, each once for a slice with its smallest doc_id, meet in buckets by hash. A bucket answers each slice with
   one bit for each window it sent: whether a smaller doc_id holds it. A passage that every document holds is one window for each slice,
   so no bucket grows with the number of copies.
3. Spans: a join gives each slice its answers; windows are lined up with their source coordinates (document, word), consecutive repeated
   ones become spans, and the words they cover go.

A filter that is too full only lets more windows into pass 2; results stay whole. A window matches by its 64-bit hash inside buckets of equal anchors, which is a second hash.

Defined cases: null and empty texts have no words; a text of fewer words than a window keeps them all; rows that repeat a doc_id are read each, and neither
counts as smaller; rows whose doc_id is null keep all their words and count for no other; long texts are a slice of their own; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import Hasher, column_bytes, mix, sliced, slices, table, unsliced, word_spans, written

WINDOW, GRAM = 13, 5
#: Bits of the filter over repeated anchors: 16 MB, whatever the input.
FILTER_BITS = 1 << 27
ENTRIES = 1_500_000  # of a bucket, about


class Edges:
    """The windows of a slice: word spans, first word of each document, and of each window its first word, hash, anchor and document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, words: Hasher, grams: Hasher, window: int):
        self.starts, self.ends, self.first = word_spans(data, offsets)
        n = len(self.starts)
        owner = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        at = np.arange(max(0, n - window + 1))
        self.at = at[owner[at] == owner[at + window - 1]]
        hashed = words.words(data, self.starts, self.ends)
        self.hash = words.runs(hashed, self.at, self.at + window)
        gram = min(GRAM, window)
        i = np.arange(max(0, n - gram + 1))
        g = grams.runs(hashed, i, i + gram)
        width, have, low = window - gram + 1, 1, g
        while have < width:
            step = min(have, width - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        self.anchor = low[self.at]
        self.owner = owner[self.at]


def hashers() -> tuple[Hasher, Hasher]:
    return Hasher(101), Hasher(202)


def _probes(anchor: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(anchor ^ np.uint64(0xA5A5A5A5DEADBEEF))
    return (x % np.uint64(bits)).astype(np.int64), (mix(x) % np.uint64(bits)).astype(np.int64)


def _sent(slice_number: int, bucket: np.ndarray, **arrays: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket; the arrays are ordered by bucket."""
    found, begin = np.unique(bucket, return_index=True)
    ends = np.append(begin, len(bucket))[1:]  # none of none
    columns = [pa.array(found.astype(np.int32)), pa.array(np.full(len(found), slice_number, np.int64))]
    columns += [pa.array([a[s:e].tobytes() for s, e in zip(begin, ends, strict=True)], pa.binary()) for a in arrays.values()]
    return pa.RecordBatch.from_arrays(columns, names=["bucket", "slice", *arrays])


def anchors_sent(window: int, buckets: int):
    def run(batches):
        words, grams = hashers()
        for batch in batches:
            for i in range(batch.num_rows):
                _, data, offsets = unsliced(*(batch.column(c)[i].as_py() for c in (1, 2, 3)))
                e = Edges(data, offsets, words, grams, window)
                if not len(e.at):
                    continue
                # one document's own windows share anchors too: an anchor counts as repeated if two documents hold it
                order = np.lexsort((e.owner, e.anchor))
                a, o = e.anchor[order], e.owner[order]
                begin = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
                anchor, several = a[begin], o[begin] != o[np.append(begin[1:], len(a)) - 1]
                order = np.argsort(anchor % np.uint64(buckets), kind="stable")
                anchor, several = anchor[order], several[order]
                yield _sent(batch.column(0)[i].as_py(), (anchor % np.uint64(buckets)).astype(np.int64), anchors=anchor, several=several)

    return run


def filter_segments(bits: int):
    """Per bucket: the segment of the filter with the anchors that two documents hold."""

    def run(group: pa.Table) -> pa.Table:
        anchors = np.concatenate([np.frombuffer(x, np.uint64) for x in group.column("anchors").to_pylist()])
        several = np.concatenate([np.frombuffer(x, bool) for x in group.column("several").to_pylist()])
        found, where, count = np.unique(anchors, return_inverse=True, return_counts=True)
        kept = count > 1
        kept[where[several]] = True
        segment = np.zeros(bits, bool)
        for p in _probes(found[kept], bits):
            segment[p] = True
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "segment": pa.array([np.packbits(segment).tobytes()])})

    return run


class Filter:
    def __init__(self, segments: dict[int, bytes], buckets: int, bits: int):
        self.buckets, self.bits, self.size = buckets, bits, (bits + 7) // 8
        self.bytes = np.zeros(buckets * self.size, np.uint8)
        for b, s in segments.items():
            self.bytes[b * self.size : (b + 1) * self.size] = np.frombuffer(s, np.uint8)

    def has(self, anchor: np.ndarray) -> np.ndarray:
        base = (anchor % np.uint64(self.buckets)).astype(np.int64) * self.size
        out = np.ones(len(anchor), bool)
        for p in _probes(anchor, self.bits):
            out &= (self.bytes[base + (p >> 3)] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
        return out


class Candidates:
    """A slice's windows with a kept anchor: which the slice settles itself, and which stand for all that are equal."""

    def __init__(self, e: Edges, keys: np.ndarray, kept: Filter, buckets: int):
        at = np.flatnonzero(kept.has(e.anchor))
        hashed, doc = e.hash[at], keys[e.owner[at]]
        order = np.lexsort((at, doc, e.anchor[at], hashed))
        h, a, d = hashed[order], e.anchor[at][order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (a[1:] != a[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        self.windows = at[order]  # candidate windows, by group
        self.group = group
        self.local = d > d[first][group] if len(h) else np.zeros(0, bool)
        # what is sent: one for each group, by bucket, then document, so that documents are runs
        bucket = (a[first] % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((at[order][first], d[first], bucket))
        self.bucket, self.hash, self.doc = bucket[self.order], h[first][self.order], d[first][self.order]
        self.anchor = a[first][self.order]


def edges_sent(window: int, buckets: int, kept):
    def run(batches):
        words, grams = hashers()
        for batch in batches:
            for i in range(batch.num_rows):
                keys, data, offsets = unsliced(*(batch.column(c)[i].as_py() for c in (1, 2, 3)))
                c = Candidates(Edges(data, offsets, words, grams, window), keys, kept.value, buckets)
                if len(c.hash):
                    yield _sent(batch.column(0)[i].as_py(), c.bucket, hashes=mix(c.hash ^ mix(c.anchor)), docs=c.doc)

    return run


def answers(group: pa.Table) -> pa.Table:
    """Per bucket: for each slice one bit for each edge it sent, whether a smaller doc_id holds it."""
    hashes = [np.frombuffer(x, np.uint64) for x in group.column("hashes").to_pylist()]
    sizes = np.array([len(x) for x in hashes])
    hashed = np.concatenate(hashes)
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in group.column("docs").to_pylist()])
    order = np.argsort(hashed, kind="stable")
    h = hashed[order]
    begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    least = np.minimum.reduceat(docs[order], begin)
    repeated = np.empty(len(h), bool)
    repeated[order] = docs[order] > np.repeat(least, np.diff(np.append(begin, len(h))))
    ends = np.cumsum(sizes)
    masks = [np.packbits(repeated[e - n : e]).tobytes() for n, e in zip(sizes, ends, strict=True)]
    return pa.table({"slice": group.column("slice"), "bucket": group.column("bucket"), "mask": pa.array(masks, pa.binary())})


def _resolved(window: int, buckets: int, kept, made, names: list[str], kinds: list):
    """Per slice with its answers: rows of made(keys, words' bytes by document, removed words, spans)."""

    def run(batches):
        words, grams = hashers()
        for batch in batches:
            for i in range(batch.num_rows):
                keys, data, offsets = unsliced(*(batch.column(c)[i].as_py() for c in (1, 2, 3)))
                e = Edges(data, offsets, words, grams, window)
                c = Candidates(e, keys, kept.value, buckets)
                masks = {x["bucket"]: x["mask"] for x in batch.column(4)[i].as_py() or ()}
                verdict = np.zeros(len(c.hash), bool)
                found, begin = np.unique(c.bucket, return_index=True)
                for b, s, t in zip(found, begin, np.append(begin, len(c.bucket))[1:], strict=True):
                    verdict[s:t] = np.unpackbits(np.frombuffer(masks[int(b)], np.uint8), count=t - s).astype(bool)
                by_group = np.empty(len(verdict), bool)
                by_group[c.order] = verdict
                repeated = np.zeros(len(e.at), bool)
                repeated[c.windows] = c.local | by_group[c.group]
                cover = np.zeros(len(e.starts) + 1, np.int64)
                np.add.at(cover, e.at[repeated], 1)
                np.add.at(cover, e.at[repeated] + window, -1)
                removed = np.cumsum(cover[:-1]) > 0
                rows = made(keys, data, offsets, e, removed)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=names)

    return run


def _kept(window: int, text: str, made, names, kinds):
    """Rows of made(...) for texts without a key, nothing removed."""

    def run(batches):
        words, grams = hashers()
        for batch in slices(batches, text):
            data, offsets = column_bytes(batch.column(1))
            e = Edges(data, offsets, words, grams, window)
            rows = made(np.zeros(batch.num_rows, np.int64), data, offsets, e, np.zeros(len(e.starts), bool))
            rows = [(None, *row[1:]) for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def _digested(keys, data, offsets, e: Edges, removed: np.ndarray) -> list[tuple]:
    body, out = data.tobytes(), []
    for d, key in enumerate(keys.tolist()):
        words = body[offsets[d] : offsets[d + 1]].split()
        gone = removed[e.first[d] : e.first[d + 1]]
        n = int(gone.sum())
        if n:
            words = compress(words, ~gone)
        out.append((key, len(gone), n, hashlib.sha256(b" ".join(words)).hexdigest()))
    return out


def _texts(keys, data, offsets, e: Edges, removed: np.ndarray) -> list[tuple]:
    body, out = data.tobytes(), []
    for d, key in enumerate(keys.tolist()):
        gone = removed[e.first[d] : e.first[d + 1]]
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
        words = compress(body[offsets[d] : offsets[d + 1]].split(), ~gone)
        out.append((key, b" ".join(words).decode(), [{"start": int(s), "words": int(t - s)} for s, t in edge.reshape(-1, 2)]))
    return out


def _solved(docs: DataFrame, key: str, text: str, window: int, made, names, kinds, schema: str) -> DataFrame:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = written(sliced(docs, key, text), "slices")
    total = held.agg(F.sum("words")).first()[0] or 0
    buckets = max(parts, total // ENTRIES)
    bits = max(64, FILTER_BITS // buckets)
    told = held.mapInArrow(anchors_sent(window, buckets), "bucket int, slice long, anchors binary, several binary")
    segments = told.groupBy("bucket").applyInArrow(filter_segments(bits), "bucket int, segment binary").collect()  # FILTER_BITS in all
    kept = spark.sparkContext.broadcast(Filter({r.bucket: bytes(r.segment) for r in segments}, buckets, bits))
    sent = held.mapInArrow(edges_sent(window, buckets, kept), "bucket int, slice long, hashes binary, docs binary")
    answered = sent.groupBy("bucket").applyInArrow(answers, "slice long, bucket int, mask binary")
    by_slice = answered.groupBy("slice").agg(F.collect_list(F.struct("bucket", "mask")).alias("masks"))
    joined = held.join(by_slice, "slice", "left").select("slice", "keys", "offsets", "body", "masks")
    unnamed = docs.filter(docs[key].isNull()).select(docs[key].cast("long"), docs[text]).mapInArrow(_kept(window, text, made, names, kinds), schema)
    return joined.mapInArrow(_resolved(window, buckets, kept, made, names, kinds), schema).union(unnamed)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, kept text (words joined by one space) and the removed spans (start and number of words)."""
    kinds = [pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))]
    return _solved(docs, key, text, window, _texts, ["k", "t", "s"], kinds, f"`{key}` long, text string, spans array<struct<start: long, words: long>>")


def query(spark, sf_dir: str) -> DataFrame:
    """op3: words of every document, how many go, digest of the rest."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return _solved(docs, "doc_id", "text", WINDOW, _digested, list("abcd"), kinds, "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') AS w FROM documents),
e AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 11, 1))) AS i, w FROM d),
h AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM e),
f AS (SELECT g, min(doc_id) AS least FROM h GROUP BY g HAVING count(*) > 1),
r AS (SELECT DISTINCT h.doc_id, unnest(range(h.i, h.i + 13)) AS p FROM h JOIN f USING (g) WHERE h.doc_id > f.least),
s AS (SELECT doc_id, list(p) AS gone FROM r GROUP BY doc_id),
k AS (SELECT d.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g, list_filter(list_transform(w, lambda x, i: CASE WHEN list_contains(coalesce(gone, []), i) THEN NULL ELSE x END), lambda x: x IS NOT NULL) AS kept FROM d LEFT JOIN s USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""
