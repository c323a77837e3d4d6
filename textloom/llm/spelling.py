"""Spelling variants by letter-parity bitmask bands.

1. Words: maximal runs of Latin letters, counted within each task by document and added up by one shuffle of partial counts. A stated rule deletes one letter of some runs first.
2. Masks: a word's mask has one bit for each letter of the alphabet, set if the letter stands in it an odd number of times. One inserted or deleted letter flips one bit and a
   replaced one flips two, so of three bands of the mask at least one is equal. Letters are dealt to the bands by their frequency, so that no band is nearly constant.
3. Join: equal bands meet under a length filter. An edit also leaves the first or the last half of the shorter word as it is, so the key of a band holds the shorter length, which half, and that half;
   a band's value alone would be shared by a fixed part of all words, and the join would grow with their square. A pair that several keys bring together is taken at the first of them only.
4. Pairs are verified by their edit distance. A word's form is its near word of most occurrences; roots follow the forms by pointer doubling, in as many rounds as the logarithm of the longest chain.

Defined cases: null and empty texts have no words; a row without doc_id stands for an empty one in the deletion rule; rows that repeat a doc_id count each; very long texts are read in pieces cut between words;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices, table, written

LETTERS = 5  # a word's least length
LEAST = 3  # a word's least count
EVERY = 97  # of the deletion rule
BANDS = 3
#: Different words that a task holds before it sends their counts on.
HELD = 400_000
#: Characters of a text that are read at once.
PIECE = 1 << 20

_BREAK = re.compile("[^A-Za-zÀ-ÿ]")


def _pieces(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > PIECE:
        cut = _BREAK.search(text, at + PIECE)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def counted(letters: int, every: int, held: int = HELD):
    """Partial counts of the words of (key, text) batches. Latin-1 bytes stand for the text: what has no place there is no letter either."""
    runs = re.compile(b"[a-z\xc0-\xff]{%d,}" % letters).findall

    def batch_of(total: dict[bytes, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

    def run(batches):
        total: dict[bytes, int] = {}
        for batch in slices(batches):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seed = crc32(b"%s:" % (b"" if key is None else str(key).encode()))
                for piece in _pieces(text or ""):
                    for word, n in Counter(runs(piece.encode("latin-1", "replace").lower())).items():
                        h = crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                        if not h % every:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]  # noqa: PLW2901
                            if len(word) < letters:
                                continue
                        total[word] = total.get(word, 0) + n
                    if len(total) >= held:
                        yield batch_of(total)
                        total = {}
        yield batch_of(total)

    return run


def words(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word and n of the words of at least `letters` letters and `least` occurrences."""
    rows = docs.select(docs[key].cast("string").alias("key"), docs[text].alias("text"))
    return rows.mapInArrow(counted(letters, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _alphabet(vocabulary: DataFrame) -> str:
    """The letters of the words, most frequent first: at most as many as the alphabet has."""
    found = vocabulary.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").count()
    return "".join(r.c for r in found.orderBy(F.desc("count"), "c").collect())


def _masks(word: Column, alphabet: str) -> list[Column]:
    """A band's letters are every third of the alphabet."""

    def mask(letters: str) -> Column:
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.instr(F.lit(letters), c))  # noqa: E731  others: bit 0 ...
        return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, c: a.bitwiseXOR(bit(c))).bitwiseAND(-2)  # ... which goes

    return [mask(alphabet[b::BANDS]) for b in range(BANDS)]


def _half(word: Column, shorter: Column, side: int) -> Column:
    """The first half of the shorter length, or what a word ends with beyond it."""
    first = F.floor(shorter / 2).cast("int")
    return F.substring(word, F.lit(1), first) if side == 0 else F.right(word, shorter - first)


def _keyed(masked: DataFrame, shorter: Column) -> DataFrame:
    """word, n, low (the first two bands) and band once for each key: hash of the shorter length, the half and the band."""
    keys = [F.struct(F.lit(2 * b + side).alias("of"), F.xxhash64(F.lit(2 * b + side), shorter, _half(F.col("word"), shorter, side), F.col(f"m{b}")).alias("key")) for b in range(BANDS) for side in (0, 1)]
    return masked.select("word", "n", "m0", "m1", F.explode(F.array(*keys)).alias("k")).select("k.key", "k.of", "word", "n", "m0", "m1")


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """x, x_n, y, y_n: each pair of words that one inserted, deleted or replaced letter tells apart, once."""
    masks = _masks(F.col("word"), _alphabet(vocabulary))
    masked = vocabulary.select("word", "n", *(m.alias(f"m{b}") for b, m in enumerate(masks)))
    size = F.char_length("word")
    same, longer = _keyed(masked, size), _keyed(masked, size - 1)
    a, b = same.alias("a"), same.withColumn("more", F.lit(False)).union(longer.withColumn("more", F.lit(True))).alias("b")
    first = F.floor(F.char_length("a.word") / 2).cast("int")
    start = lambda w: F.substring(w, F.lit(1), first)
    of = F.col("a.of")
    # bands before this one differ, and so does the first half if the keys hold the last one
    earliest = ((of < 2) | (F.col("a.m0") != F.col("b.m0"))) & ((of < 4) | (F.col("a.m1") != F.col("b.m1"))) & ((of % 2 == 0) | (start(F.col("a.word")) != start(F.col("b.word"))))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (of == F.col("b.of")) & (F.col("b.more") | (F.col("a.word") < F.col("b.word"))) & earliest & (F.char_length("b.word") - F.char_length("a.word") == F.col("b.more").cast("int")))
    return met.filter(F.levenshtein("a.word", "b.word", 1) == 1).select(F.col("a.word").alias("x"), F.col("a.n").alias("x_n"), F.col("b.word").alias("y"), F.col("b.n").alias("y_n"))


def roots(links: DataFrame) -> DataFrame:
    """word and top: the end of each word's chain of forms. links: word, top (its form)."""
    reached = written(links, "spelling-roots")
    while True:
        on = reached.alias("b")
        step = reached.alias("a").join(on, F.col("a.top") == F.col("b.word"), "left")
        further = written(step.select("a.word", F.coalesce("b.top", "a.top").alias("top"), F.col("b.top").isNotNull().alias("moved")), "spelling-roots")
        if further.filter("moved").isEmpty():
            return further.select("word", "top")
        reached = further.select("word", "top")


def group(docs: DataFrame, key: str = "doc_id", text: str = "text", letters: int = LETTERS, least: int = LEAST, every: int = EVERY) -> DataFrame:
    """word, n, form, root, n_near and form_n of every word."""
    vocabulary = written(words(docs, key, text, letters, least, every), "spelling-words")
    pairs = near_pairs(vocabulary)
    side = lambda w, n, o, m: F.struct(F.col(w).alias("word"), F.col(n).alias("n"), F.col(o).alias("other"), F.col(m).alias("other_n"))
    both = pairs.select(F.explode(F.array(side("x", "x_n", "y", "y_n"), side("y", "y_n", "x", "x_n"))).alias("s")).select("s.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    chosen = -F.col("best.less") >= 2 * F.col("n")
    found = vocabulary.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(chosen, F.col("best.other")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    found = written(found, "spelling-forms")
    tops = roots(found.filter("form is not null").select("word", F.col("form").alias("top")))
    return found.join(tops, "word", "left").select("word", "form", F.coalesce("top", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the words of all documents with their forms and roots."""
    return group(table(spark, sf_dir, "documents", "doc_id", "text"))


SQL = r"""
WITH RECURSIVE steps AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) ORDER BY i) AS t FROM range(256) r(i)),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents),
each AS (SELECT doc_id, w, count(*) AS n, hex(coalesce(doc_id::VARCHAR, '') || ':' || w) AS x FROM runs WHERE length(w) >= 5 GROUP BY ALL),
bytes AS (SELECT doc_id, w, n, list_transform(range(0, length(x), 2), lambda i: (instr('0123456789ABCDEF', x[i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[i + 2]) - 1) AS b FROM each),
hashed AS (SELECT w, n, xor(list_reduce(b, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM bytes, steps),
written AS (SELECT CASE WHEN h % 97 = 0 THEN left(w, (h % length(w))::INTEGER) || substr(w, (h % length(w))::INTEGER + 2) ELSE w END AS word, n FROM hashed),
v AS (SELECT word, sum(n)::BIGINT AS n FROM written WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i::INTEGER) || substr(word, i::INTEGER + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS (SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
         UNION SELECT a.word, v.word, v.n FROM cut a JOIN v ON a.d = v.word UNION SELECT v.word, a.word, a.n FROM cut a JOIN v ON a.d = v.word),
best AS (SELECT word, count(*) AS n_near, min((-m, other)) AS b FROM near GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 2 * v.n THEN b[2] END AS form, CASE WHEN -b[1] >= 2 * v.n THEN -b[1] END AS form_n FROM v LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM f UNION ALL SELECT chain.word, f.form FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NOT NULL),
ends AS (SELECT chain.word, chain.at AS root FROM chain JOIN f ON f.word = chain.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM f JOIN ends USING (word)
"""
