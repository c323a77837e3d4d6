import random
import re
from itertools import permutations

import pytest

from textloom.llm import filter_audit


def brute(docs, labels):
    rows = []
    for key, text, part in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        copy = key is not None and any(k is not None and k < key and (o or "") == t for k, o, _ in docs)
        fails = "".join(f for f, yes in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), copy), strict=True) if yes)
        good, toxic = (key is not None and any(x[i] == 1 for x in labels if x[0] == key) for i in (1, 2))
        rows.append((part or "", fails, good, toxic))
    out = []
    for part in {r[0] for r in rows}:
        own, removed = [r for r in rows if r[0] == part], {}
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[f] = removed.get(f, 0) + len(gone)
                failing = sum(f in r[1] for r in own)
                out.append([part, "".join(order), step, len(left), len(gone), failing - len(gone), sum(r[1] == f for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f])
        for x in out:
            if x[0] == part:
                x[9] = removed[x[9]] if x[9] in removed else x[9]
    return sorted(tuple(x) for x in out)


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rows_of(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


@pytest.mark.parametrize("ranges", [1, 4, 23])
def test_equals_brute_force(spark, ranges):
    """A third of the rows are one text over many ranges; ids repeat with it, and some are missing."""
    rng = random.Random(ranges)
    text = lambda: " ".join(rng.choice(["Word", "a", "b", "été", "x%", "longer", f"n{rng.randint(0, 200)}"]) + rng.choice(["", "", "\n", "\x0b"]) for _ in range(rng.choice((0, 3, 49, 50, 51, 80, 120))))
    hot, other = "the same text here " * 20, "another TEXT | " * 3
    docs = [(rng.choice([k, k // 3, 7]), rng.choice([hot, hot, other, text(), text(), "", None]), rng.choice(["a", "b", None, "c'", ""])) for k in range(150)]
    docs += [(None, hot, "a"), (None, None, None), (3, hot, "a"), (3, hot, "b"), (500, "UPPER " * 30_000, "long")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 60)] + [(7, 1, 0), (7, 0, 1), (None, 1, 1)]
    d = spark.createDataFrame([(*r, "z") for r in docs], "doc_id long, text string, source string, mask string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = rows_of(filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute(docs, labels)


def test_empty_tables(spark):
    d, lab = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(d, lab).count() == 0
    one = spark.createDataFrame([(1, "a", "s")], d.schema)
    assert rows_of(filter_audit.audit(one, lab)) == brute([(1, "a", "s")], [])


def test_groups_over_many_ranges():
    """A group that begins in range 0 and ends in range 3, with equal smallest ids in two of them."""
    edges = [(0, b"a", 1, b"g", 5), (1, b"g", 5, b"g", 5), (2, b"g", 6, b"g", 6), (4, b"g", 9, b"h", 2), (5, b"h", 2, b"i", 0), (6, b"j", 0, b"j", 0)]
    assert filter_audit.continued(edges) == [2, 4]
    assert filter_audit.continued([]) == []
