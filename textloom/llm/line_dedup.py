"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line's set is its distinct words. A line goes if an earlier line has Jaccard similarity of at least four fifths with it, whether that one stays or not.
Lines come in the order of doc_id, then of the text's hash (rows that repeat a doc_id), then of the line number.

1. Rarity: one pass counts words in `CELLS` hash cells; a cell's logarithm is one letter of a string of fixed size. Every line's words are
   ordered by their cell's class, rare ones first, then by hash.
2. Classes: lines with equal sets are one class, with its first line; all others of it go. Only the first lines, with their leading words, travel on; sorted by place they are numbered, and this number
   is what tells classes apart and says which is earlier.
3. Prefixes. Single words of a prefix come ever more often as the corpus grows, so the keys are pairs of words that stand side by side in the order. Two similar sets have at most n / 5 words of one's own; every break
   between two shared words costs one of them, so that some pair stands side by side in both sets, within the bound of `_keys`. Such a prefix of pairs is the set's keys.
4. Round one: each class with the first one of each of its keys, under length, positional and parity filters (the parities of similar sets differ in no more bits than the sets in words).
   Then each class meets the `BEFORE` ones before it in a random order, which is all there is to short lists. Round two, a self-join by key of the longer ones under the same filters: classes that are still there, with
   all earlier ones, once for each run of common keys. So a large group of near copies makes no pairs of all its lines.
5. Every pair that passed is verified by its words.

Defined cases: null and empty texts have no lines to remove; lines without words stay and match nothing; very long lines are sets as any; rows equal in doc_id and text count as one document
and lose the same lines; rows that repeat a doc_id with another text are documents of their own; rows without doc_id are left as they are and remove nothing; an empty table gives an
empty result; other columns, whatever their names, are kept by `dedup`. Words are compared by their hashes, of 58 bits within a class and of 64 bits in the verification.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import forget, table, written

CELLS, CHUNK = 1 << 21, 1 << 11
#: A cell's class stands above this many bits of a word's hash.
LOW = 58
#: Round one takes the keys in so many turns (a power of two), each a part of them by hash, so that one turn's shuffle is on disk at a time.
TURNS = 4
#: Between the rounds, a class meets so many others before it in each longer list.
BEFORE = 12
#: Bits of a set's parity; those that stand in the code, beside the others of their own.
SLOTS, ODD = 100, 36


def _spaced(text: Column) -> Column:
    """The text with each separator but the line feed as a space."""
    for c in "\t\x0b\f\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def _judged(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, th (the text's hash), text of the rows whose lines are judged."""
    rows = docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("text"))
    return rows.filter("doc is not null and text is not null").select("doc", _text_hash(F.col("text")).alias("th"), "text")


def _lines(rows: DataFrame) -> DataFrame:
    return rows.select("doc", "th", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("pos", "line"))


def _hashes(line: Column) -> Column:
    """The distinct words' hashes."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def rarity(rows: DataFrame) -> Column:
    """One letter for each cell, how often its words come as a logarithm: CELLS bytes in all, read by a scalar subquery."""
    spark = rows.sparkSession
    words = rows.select(F.explode(F.split(F.replace(_spaced(F.col("text")), F.lit("\n"), F.lit(" ")), " ")).alias("w")).filter("w <> ''")
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(CELLS - 1).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    cells = spark.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    letter = F.char((F.lit(65) + F.least(F.lit(25), F.floor(F.log2(F.coalesce("n", F.lit(0)) + 1))).cast("int")).cast("long"))
    joined = lambda name, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(name, c))), lambda x: x["c"]), "")
    chunks = written(cells.groupBy((F.col("cell") / CHUNK).cast("int").alias("chunk")).agg(joined("cell", letter.alias("c")).alias("c")), "line-rarity")
    return chunks.agg(joined("chunk", F.col("c")).cast("binary").alias("letters")).scalar()


def _ranked(lines: DataFrame, cells: Column) -> DataFrame:
    """doc, th, pos, sig (of the set), n, parity and wide (a bit for each of `SLOTS` remainders of the words: how often they come, odd or even), head (its first words, rare ones first)."""

    def key(h: Column) -> Column:
        rank = F.ascii(F.substring(F.col("cells"), h.bitwiseAND(CELLS - 1).cast("int") + 1, F.lit(1)).cast("string")) - 65
        return F.shiftleft(rank.cast("long"), LOW).bitwiseOR(F.shiftrightunsigned(h, 64 - LOW))

    lines = lines.filter(F.trim("line") != "").select("*", cells.alias("cells"))  # the optimizer puts it where it is used, so no row carries it
    keyed = lines.select("doc", "th", "pos", F.sort_array(F.transform(_hashes(F.col("line")), key)).alias("keys"))
    n = F.size("keys")

    def parity(first: int, bits: int) -> Column:
        def step(a, x):
            slot = x % SLOTS - first
            return a.bitwiseXOR(F.call_function("shiftleft", ((slot >= 0) & (slot < bits)).cast("long"), slot.cast("int")))

        return F.aggregate("keys", F.lit(0).cast("long"), step)

    return keyed.select("doc", "th", "pos", F.xxhash64("keys").alias("sig"), n.alias("n"), parity(0, ODD).alias("parity"), parity(ODD, SLOTS - ODD).alias("wide"), F.slice("keys", F.lit(1), (n * 2 / 5).cast("int") + 2).alias("head"))


def _keys(classes: DataFrame) -> DataFrame:
    """word (hash of two words side by side), prev (that of the pair before), id, code (see `_part`), wide of the first lines.

    Of a set's n words at most n / 5 are its own, and the other set has one own word for every four that it takes less. Before the first unbroken gap there are as many broken ones as own words of both
    at most, so its second word's position is 1 + 2 floor(n / 5) + floor((n mod 5) / 4) at most.
    """
    n = F.col("n")
    code = F.shiftleft(F.col("parity"), 16).bitwiseOR((F.least(F.lit(255), n) * 256).cast("long"))
    most = F.least(F.size("head") - 1, 1 + 2 * (n / 5).cast("int") + (n % 5 / 4).cast("int"))
    pairs = F.zip_with(F.slice("head", F.lit(1), most), F.slice("head", F.lit(2), most), lambda a, b: F.xxhash64(a, b))
    some = classes.filter("n > 1").select("id", "wide", code.alias("code"), pairs.alias("pairs"))
    every = some.select("id", "wide", "code", F.posexplode(F.arrays_zip(F.col("pairs").alias("word"), F.concat(F.array(F.lit(0).cast("long")), F.col("pairs")).alias("prev"))).alias("i", "z")).filter("z.word is not null")
    return every.select("z.word", "z.prev", "id", F.col("code").bitwiseOR(F.least(F.lit(255), F.col("i") + 1).cast("long")).alias("code"), "wide")


def _part(code: Column, part: str) -> Column:
    """A code's parts, from the top: `ODD` bits of parity; size and position, 255 or more as 255."""
    low, bits = {"parity": (16, ODD), "n": (8, 8), "i": (0, 8)}[part]
    return F.shiftright(code, low).bitwiseAND((1 << bits) - 1)


def _similar(a, b) -> Column:
    """What similar sets a and b satisfy at the first common key: sizes, words that can still be common, and as many odd bits of both at most as there are own words. Sizes of 255 may be larger ones."""
    (n, m), (i, j), (one, two) = ([_part(x["code"], part) for x in (a, b)] for part in ("n", "i", "parity"))
    odd = F.bit_count(one.bitwiseXOR(two)) + F.bit_count(a["wide"].bitwiseXOR(b["wide"]))
    # before the first common key there are, of both sets together, at most (n + m) / 9 own words and as many broken gaps
    close = (9 * odd <= n + m) & (3 * (i + j) <= n + m + 6)
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & ((n == 255) | (m == 255) | close) & (a["id"] != b["id"])


def _numbered(ranked: DataFrame) -> DataFrame:
    """A row for each class, with its first line: id (in the order of these lines), sig, doc, th, pos, n, parity, wide, head. Written, so that a class keeps its id."""
    firsts = ranked.groupBy("sig").agg(F.min(F.struct("doc", "th", "pos", "n", "parity", "wide", "head")).alias("f")).select("sig", "f.*")
    parts = int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ("doc", "th", "pos")
    return written(firsts.repartitionByRange(parts, *place).sortWithinPartitions(*place).select(F.monotonically_increasing_id().alias("id"), "*"), "line-classes")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc, th and pos of every line that goes."""
    rows = _judged(docs, key, text)
    ranked = written(_ranked(_lines(rows), rarity(rows)), "lines")
    firsts = _numbered(ranked)
    lines, classes = written(ranked.select("doc", "th", "pos"), "lines"), written(firsts.select("id", "doc", "th", "pos"), "line-classes")
    forget(ranked)

    # round one: the first class of the key
    sides = lambda *names: [{c: F.col(f"{x}.{c}") for c in ("id", "code", "wide")} for x in names]
    every, near = _keys(firsts), None
    for turn in range(TURNS):
        keys = every.filter(F.col("word").bitwiseAND(TURNS - 1) == turn).repartition("word")
        leaders = keys.groupBy("word").agg(F.min("id").alias("id"), F.min_by("code", "id").alias("code"), F.min_by("wide", "id").alias("wide"), F.count(F.lit(1)).alias("many")).filter("many > 1")
        met = keys.alias("b").join(leaders.alias("a"), "word").select("word", "b.prev", "b.id", "b.code", "b.wide", F.when(_similar(*sides("a", "b")), F.col("a.id")).alias("a"), "many")
        met = written(met.filter("many > 2 or a is not null"), "line-near")
        near = near.union(met) if near else met
    forget(firsts)
    pairs = written(near.filter("a is not null").select(F.col("id").alias("y"), F.col("a").alias("x")).distinct(), "line-pairs")
    late = _verified(rows, classes, pairs)

    # between the rounds: each class with those before it in an order of the word's own. That is all there is to lists of up to BEFORE + 1; in longer ones, few classes of a large group of near copies are left
    some = near.filter(f"many > {BEFORE + 1}").select("word", "prev", "id", "code", "wide")
    row, run = F.struct("id", "code", "wide"), Window.partitionBy("word").orderBy(F.xxhash64("word", "b.id"), "b.id", "b.code")
    before = near.filter("many > 2").select("word", row.alias("b")).select("b", *(F.lag("b", k).over(run).alias(f"a{k}") for k in range(1, BEFORE + 1)))
    b = {c: F.col(f"b.{c}") for c in ("id", "code", "wide")}
    met = F.array_compact(F.array(*(F.when(_similar({c: F.col(f"a{k}.{c}") for c in b}, b), F.col(f"a{k}.id")) for k in range(1, BEFORE + 1))))
    two = before.select("b.id", F.explode(met).alias("a"))
    more = two.select(F.greatest("a", "id").alias("y"), F.least("a", "id").alias("x")).distinct()
    more = written(more.join(late.select(F.col("id").alias("y")), "y", "left_anti").join(pairs, ["y", "x"], "left_anti"), "line-pairs")
    pairs, late = pairs.union(more), late.union(_verified(rows, classes, more))

    # round two: classes that are still there, with all earlier ones of their keys
    rest = some.join(late.distinct(), "id", "left_anti")
    # where the pair before is common too, the two have met there already
    begins = (F.col("a.prev") != F.col("b.prev")) | (_part(F.col("a.code"), "i") == 1) | (_part(F.col("b.code"), "i") == 1)
    more = some.alias("a").join(rest.alias("b"), "word").filter((F.col("a.id") < F.col("b.id")) & begins & _similar(*sides("a", "b")))
    more = more.select(F.col("b.id").alias("y"), F.col("a.id").alias("x")).distinct()
    more = written(more.join(pairs, ["y", "x"], "left_anti"), "line-pairs")
    late = late.union(_verified(rows, classes, more)).distinct()

    stays = classes.join(late, "id", "left_anti").select("doc", "th", "pos")
    return lines.join(stays, ["doc", "th", "pos"], "left_anti")


def _mask(pos: str) -> Column:
    """The line numbers as a string with 1 at each of them, 0 before and between."""
    at = F.sort_array(F.collect_set(pos))
    before = F.concat(F.array(F.lit(-1)), F.slice(at, F.lit(1), F.size(at) - 1))
    return F.array_join(F.zip_with(at, before, lambda p, q: F.concat(F.repeat(F.lit("0"), p - q - 1), F.lit("1"))), "").cast("binary")


def _marked(mask: str | Column, pos: Column) -> Column:
    return F.coalesce(F.ascii(F.substring(F.col(mask) if isinstance(mask, str) else mask, pos + 1, F.lit(1)).cast("string")), F.lit(0)) == 49


def _verified(rows: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """id of the later class of each of the pairs (y, x) that is similar by its words, written."""
    ids = pairs.select(F.explode(F.array("y", "x")).alias("id")).distinct()
    wanted = written(classes.join(ids, "id"), "line-wanted")
    texts = rows.join(wanted.groupBy("doc", "th").agg(_mask("pos").alias("mask")), ["doc", "th"])
    lines = texts.select("doc", "th", F.posexplode(F.split(_spaced(F.col("text")), "\n")).alias("pos", "line"), "mask").filter(_marked("mask", F.col("pos")))
    got = lines.select("doc", "th", "pos", _hashes(F.col("line")).alias("words")).dropDuplicates(["doc", "th", "pos"]).join(wanted, ["doc", "th", "pos"])
    got = written(got.select("id", "words"), "line-words")
    side = lambda x: got.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    common = F.size(F.array_intersect("x_words", "y_words"))
    similar = both.filter(5 * common >= 4 * (F.size("x_words") + F.size("y_words") - common))
    found = written(similar.select(F.greatest("x", "y").alias("id")).distinct(), "line-later")
    forget(got, wanted)
    return found


def _with(docs: DataFrame, found: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """docs as struct d, joined with found's column `name` of the row's doc and th (null: none)."""
    rows = docs.select(F.struct("*").alias("d"), docs[key].cast("long").alias("doc"), _text_hash(docs[text]).alias("th"))
    return rows.join(found.select("doc", "th", name), ["doc", "th"], "left").select("d", name)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the lines that go; all columns stay."""
    gone = removed_lines(docs, key, text).groupBy("doc", "th").agg(_mask("pos").alias("gone"))
    joined = _with(docs, gone, key, text, "gone")
    kept = F.array_join(F.filter(F.split(F.col("d").getField(text), "\n"), lambda _, i: ~_marked("gone", i)), "\n")
    return joined.select(*[F.when(F.col("gone").isNotNull(), kept).otherwise(F.col("d").getField(c)).alias(c) if c == text else F.col("d").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op5: lines of every document, how many go and which (numbers from 0, comma-joined)."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    gone = removed_lines(docs).groupBy("doc", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    found = docs.select("doc_id", n.alias("n_lines"), F.col("doc_id").cast("long").alias("doc"), _text_hash(F.col("text")).alias("th")).join(gone, ["doc", "th"], "left")
    return found.select("doc_id", "n_lines", F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(F.array_join(F.col("gone").cast("array<string>"), ","), F.lit("")).alias("removed"))


SQL = r"""
WITH l AS (SELECT doc_id, CAST(i AS INTEGER) - 1 AS pos, list_distinct(list_filter(regexp_split_to_array(line, '[ \t\n\v\f\r]+'), lambda w: w <> '')) AS w
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
s AS (SELECT doc_id, pos, w, len(w) AS n, array_to_string(list_sort(w), ' ') AS k FROM l WHERE len(w) > 0),
u AS (SELECT k, min((doc_id, pos)) AS spot, any_value(n) AS n FROM s GROUP BY k),
t AS (SELECT k, n, spot, unnest(string_split(k, ' ')) AS word FROM u),
f AS (SELECT word, count(*) AS df FROM t GROUP BY word),
r AS (SELECT t.*, row_number() OVER (PARTITION BY k ORDER BY df, word) AS i FROM t JOIN f USING (word)),
p AS (SELECT * FROM r WHERE i <= n - CAST(ceil(n * 4 / 5) AS INTEGER) + 1),
c AS (SELECT DISTINCT a.k AS x, b.k AS y FROM p a JOIN p b ON a.word = b.word AND a.spot < b.spot AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
v AS (SELECT x, y, len(list_intersect(string_split(x, ' '), string_split(y, ' '))) AS m, len(string_split(x, ' ')) + len(string_split(y, ' ')) AS z FROM c),
g AS (SELECT DISTINCT y AS k FROM v WHERE 5 * m >= 4 * (z - m)),
o AS (SELECT s.doc_id, s.pos FROM s JOIN u USING (k) LEFT JOIN g USING (k) WHERE g.k IS NOT NULL OR (s.doc_id, s.pos) <> u.spot),
q AS (SELECT doc_id, list(pos ORDER BY pos) AS gone FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, coalesce(array_to_string(gone, ','), '') AS removed
FROM documents d LEFT JOIN q USING (doc_id)
"""
