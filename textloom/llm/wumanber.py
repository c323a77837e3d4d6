"""Benchmark decontamination by Wu-Manber multi-pattern search.

The test strings are the windows of `WINDOW` words of the benchmark items (an item of fewer words is one window), with one space around every word. Texts are brought to the same form, so that byte
search finds whole words. For each class of lengths, so that one short item does not spoil the shifts of all others:

1. The shift table holds, for the hash of each block of bytes, how far the search may move on without passing a window: the distance from the block's last place in any window's first m bytes
   (m: the class's shortest window) to their end. Blocks of no window move it by m less a block. Different blocks of one hash can only shorten a shift.
2. Where the shift is 0 the block may end some window's first m bytes: the bucket of its hash has the windows in question, ordered by a digest of all their bytes.
3. The text's words from there, as many as windows of the class have, are looked up in the bucket and compared with the window byte by byte.

Every window is found, overlapping ones too. The benchmark reaches the tasks in blocks of at most `BLOCK` bytes, whatever its size (one piece of 4,096 words of an item may exceed that); each block is a pass
over the documents, and passes after the first return only documents with hits, joined by key and text hash. Nothing else is shuffled.

Defined cases: null and empty texts have no words, null and empty items no windows; an item without id marks words but is not listed; rows that repeat a doc_id are judged each, items that repeat an id are listed
once; long texts and long items are searched whole; an empty table of documents gives an empty result, an empty benchmark no hits; other columns, whatever their names, are kept by `drop`.
"""

from __future__ import annotations

import uuid
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices, table

WINDOW = 10
#: Bytes of benchmark text and ids that a task holds at once; its tables take about ten times as much.
BLOCK = 8 << 20
PIECE_WORDS = 4096
#: Windows are searched by class of their bytes, from each of these on.
CLASSES = (0, 8, 16, 32)

#: Every byte as it is compared: A-Z in lower case, word bytes (digits, letters, all beyond ASCII) as they are, others a space.
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FORM).split()


def _pieces(window: int):
    """(item, its words joined by a space), long items in pieces that share window - 1 words."""

    def run(batches):
        for batch in slices(batches):
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                for at in range(0, max(1, len(words) - window + 1) if words else 0, PIECE_WORDS):
                    rows.append((item, b" ".join(words[at : at + PIECE_WORDS + window - 1])))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "words"])

    return run


def _crc_blocks(body: np.ndarray, size: int) -> np.ndarray:
    """crc32 of the block that begins at each byte."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, (steps >> 1) ^ np.uint32(0xEDB88320), steps >> 1)
    n = len(body) - size + 1
    crc = np.full(max(n, 0), 0xFFFFFFFF, np.uint32)
    for k in range(size if n > 0 else 0):
        crc = steps[(crc ^ body[k : k + n]) & 0xFF] ^ (crc >> 8)
    return ~crc


class Search:
    """The tables of one class of windows: body[start:end] of each window, words its count, uid its number among different windows."""

    def __init__(self, body: bytes, starts: np.ndarray, ends: np.ndarray, counts: np.ndarray, uids: np.ndarray, digests: np.ndarray):
        self.least = int((ends - starts).min())
        self.size = 8 if self.least >= 16 else max(2, self.least // 2)
        self.counts = np.unique(counts).tolist()
        crc = _crc_blocks(np.frombuffer(body, np.uint8), self.size)
        slots = 1 << max(12, min(24, int(8 * len(starts)).bit_length()))
        self.mask, shift = slots - 1, np.full(slots, self.least - self.size + 1, np.uint8 if self.least < 256 else np.uint32)
        for end in range(self.size, self.least + 1):  # later blocks of the first `least` bytes shorten the shift
            shift[crc[starts + end - self.size] & np.uint32(self.mask)] = self.least - end
        self.shift = shift.tobytes() if self.least < 256 else shift.tolist()
        last = crc[starts + self.least - self.size]
        order = np.lexsort((digests, last))
        self.bucket, self.digest, self.uid = last[order], digests[order], uids[order]


class Windows:
    """All windows of a block of the benchmark and the search for them."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], window: int = WINDOW):
        from xxhash import xxh3_64_intdigest

        self.items = sorted({i for i, _ in pieces if i is not None})
        number = {x: k for k, x in enumerate(self.items)}
        body, at, starts, ends, counts, owners = [], 0, [], [], [], []
        for item, words in pieces:
            text = b" %s " % words
            spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + at
            n = min(window, len(spaces) - 1)
            starts.append(spaces[: len(spaces) - n])
            ends.append(spaces[n:] + 1)
            counts.append(np.full(len(spaces) - n, n))
            owners.append(np.full(len(spaces) - n, number.get(item, -1)))
            body.append(text)
            at += len(text)
        self.body = b"".join(body)
        if not self.body:
            self.searches: list[Search] = []
            return
        starts, ends, counts, owners = (np.concatenate(x) for x in (starts, ends, counts, owners))
        whole = self.body
        digests = np.fromiter((xxh3_64_intdigest(whole[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
        _, first, uids = np.unique(digests, return_index=True, return_inverse=True)
        # windows of one digest that differ: none is to be expected, but they are held apart
        self.odd: dict[bytes, set[int]] = {}
        for k in np.flatnonzero(first[uids] != np.arange(len(uids))).tolist():
            f = first[uids[k]]
            if whole[starts[k] : ends[k]] != whole[starts[f] : ends[f]]:
                self.odd.setdefault(whole[starts[k] : ends[k]], set()).add(int(owners[k]))
        order = np.lexsort((owners, uids))
        self.owners, self.owned = owners[order], np.searchsorted(uids[order], np.arange(len(first) + 1))
        self.starts, self.ends = starts[first], ends[first]
        lengths = (ends - starts)[first]
        self.searches = []
        for low, high in zip(CLASSES, (*CLASSES[1:], 1 << 62), strict=True):
            k = np.flatnonzero((lengths >= low) & (lengths < high))
            if len(k):
                self.searches.append(Search(whole, self.starts[k], self.ends[k], counts[first][k], k, digests[first][k]))

    def _places(self, s: Search, text: bytes) -> list[int]:
        """Where windows of the class may begin: the search itself."""
        found, at, n, size, least, shift, mask = [], s.least, len(text), s.size, s.least, s.shift, s.mask
        while at <= n:
            step = shift[crc32(text[at - size : at]) & mask]
            if step:
                at += step
            else:
                if text[at - least] == 32:
                    found.append(at - least)
                at += 1
        return found

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """(first word, words) of each occurrence of a window, and the items that have them."""
        from xxhash import xxh3_64_intdigest

        text = b" %s " % b" ".join(words)
        spans, uids, owners, spaces = [], set(), set(), None
        for s in self.searches:
            for at in self._places(s, text):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                first = int(np.searchsorted(spaces, at))
                low, high = np.searchsorted(s.bucket, np.uint32(crc32(text[at + s.least - s.size : at + s.least])), "left"), None
                if low == len(s.bucket):
                    continue
                high = np.searchsorted(s.bucket, s.bucket[low], "right")
                for count in s.counts:
                    if first + count >= len(spaces):
                        break
                    candidate = text[at : int(spaces[first + count]) + 1]
                    d = np.uint64(xxh3_64_intdigest(candidate))
                    k = low + int(np.searchsorted(s.digest[low:high], d))
                    if k < high and s.digest[k] == d:
                        uid = int(s.uid[k])
                        if self.body[self.starts[uid] : self.ends[uid]] == candidate:
                            uids.add(uid)
                        elif candidate in self.odd:
                            owners |= self.odd[candidate]
                        else:
                            continue
                        spans.append((first, count))
        for uid in uids:
            owners.update(self.owners[self.owned[uid] : self.owned[uid + 1]].tolist())
        return spans, owners - {-1}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (first, count) without overlap, in order."""
    out: list[list[int]] = []
    for first, count in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], first + count)
        else:
            out.append([first, first + count])
    return [(a, b - a) for a, b in out]


#: The last block's tables of this Python worker.
_BUILT: dict[str, Windows] = {}

_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def _scanned(block, window: int, every: bool):
    def run(batches):
        name, pieces = block.value
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Windows(pieces, window)
        windows = _BUILT[name]
        for batch in slices(batches):
            take, counts, spans, items = [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words = words_of(text or "")
                found, owners = windows.find(words) if words else ([], ())
                if every or found:
                    take.append(i)
                    counts.append(len(words))
                    spans.append([{"start": a, "words": n} for a, n in merged(found)])
                    items.append([windows.items[k] for k in sorted(owners)])
            rows = batch.take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], names=["key", "th", "n_words", "spans", "items"])

    return run


def _blocks(benchmark: DataFrame, item: str, text: str, window: int, most: int) -> list:
    """Broadcasts of the benchmark's pieces, each of at most `most` bytes."""
    spark = benchmark.sparkSession
    pieces = benchmark.select(benchmark[item].cast("string").alias("item"), benchmark[text].alias("text")).filter("text is not null").mapInArrow(_pieces(window), "item string, words binary").distinct()
    size = F.octet_length("words") + F.coalesce(F.octet_length("item"), F.lit(0)) + 16
    total = pieces.agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("n")).first()
    k = -(-(total["size"] or 0) // most) or 1
    while True:
        dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(k)))
        if k == 1 or k >= 4 * total["n"] or dealt.groupBy("block").agg(F.sum(size).alias("size")).filter(F.col("size") > most).isEmpty():
            break
        k *= 2
    for b in range(k):
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.item, bytes(r.words)) for r in dealt.filter(F.col("block") == b).collect()]))


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """A row for each document: key, th (the text's hash), n_words, spans (start and number of words inside windows, without overlap), items (ids, as sorted strings)."""
    rows = docs.select(docs[key].alias("key"), F.xxhash64(docs[text]).alias("th"), docs[text].alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, th long, n_words long, spans array<struct<start: long, words: long>>, items array<string>"
    found = more = None
    for b in _blocks(benchmark, item, item_text, window, block):
        if found is None:
            found = rows.mapInArrow(_scanned(b, window, True), schema)
        else:
            hits = rows.mapInArrow(_scanned(b, window, False), schema).dropDuplicates(["key", "th"])
            more = hits if more is None else more.union(hits)
    if more is None:
        return found
    more = more.groupBy("key", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    a, b = found.alias("a"), more.alias("b")
    both = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")) & (F.col("a.th") == F.col("b.th")), "left")
    joined = lambda c: F.when(F.col(f"b.{c}").isNull(), F.col(f"a.{c}")).otherwise(F.concat(f"a.{c}", f"b.{c}"))
    return both.select("a.key", "a.th", "a.n_words", _without_overlap(joined("spans")).alias("spans"), F.array_sort(F.array_distinct(joined("items"))).alias("items"))


def _without_overlap(spans):
    """What `merged` does, for spans of several blocks."""
    end = lambda x: x["start"] + x["words"]

    def add(out, x):
        last = F.get(out, F.size(out) - 1)
        longer = F.struct(last["start"].alias("start"), (F.greatest(end(last), end(x)) - last["start"]).alias("words"))
        apart = (F.size(out) == 0) | (x["start"] > end(last))
        return F.when(apart, F.concat(out, F.array(x))).otherwise(F.concat(F.slice(out, 1, F.size(out) - 1), F.array(longer)))

    return F.when(F.size(spans) < 2, spans).otherwise(F.aggregate(F.array_sort(spans), F.array().cast("array<struct<start: long, words: long>>"), add))


def drop(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the contaminated ones; all columns stay."""
    gone = find(docs, benchmark, key, text, **options).filter(F.size("spans") > 0).select("key", "th").distinct()
    rows = docs.select(F.struct("*").alias("d"), docs[key].alias("key"), F.xxhash64(docs[text]).alias("th")).alias("r")
    kept = rows.join(gone.alias("g"), F.col("r.key").eqNullSafe(F.col("g.key")) & (F.col("r.th") == F.col("g.th")), "left_anti")
    return kept.select(*(F.col("d").getField(c).alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """op12: words of every document inside windows of benchmark items, and these items."""
    found = find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return found.select(F.col("key").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS c, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
v AS (SELECT r, c, i, array_to_string(w[i:i + c - 1], ' ') AS s FROM (SELECT r, w, c, unnest(range(1, len(w) - c + 2)) AS i FROM d, (SELECT DISTINCT c FROM p) WHERE len(w) >= c)),
h AS (SELECT r, i, c, item_id FROM v JOIN p USING (c, s)),
n AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(i, i + c)) AS x FROM (SELECT DISTINCT r, i, c FROM h)) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN t USING (r)
"""
