import random
import re

import pytest

from textloom.llm import wumanber

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def brute(docs, benchmark, window=10):
    tests = []
    for item, text in benchmark:
        w = WORD.findall(lower(text or ""))
        tests += [(None if item is None else str(item), w[i : i + window]) for i in range(max(1, len(w) - window + 1)) if w]
    out = []
    for key, text in docs:
        w = WORD.findall(lower(text or ""))
        hit, items = set(), set()
        for item, t in tests:
            for i in range(len(w) - len(t) + 1):
                if w[i : i + len(t)] == t:
                    hit.update(range(i, i + len(t)))
                    items.add(item)
        out.append((key, len(w), tuple(sorted(hit)), tuple(sorted(items - {None}))))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.key, r.n_words, tuple(i for s in r.spans for i in range(s.start, s.start + s.words)), tuple(r["items"])) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [wumanber.BLOCK, 700])
def test_equals_brute_force(spark, block):
    """Items of 0 to 40 words of few letters, texts cut and pasted from them, separators and cases of all kinds; with small blocks, several passes."""
    rng = random.Random(5)
    words = ["a", "b", "ab", "ba", "É", "é", "x1", "long" * 9, "naïve", "ÿ z", "7"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "  ", "-", "_", "\x7f"]) for _ in range(n))
    items = [text(rng.choice([0, 1, 2, 3, 9, 10, 11, 25, 40])) for _ in range(40)]
    benchmark = [(i, t) for i, t in enumerate(items)] + [(3, items[7]), (None, items[8]), (None, "ba ab " * 6), (99, None), (98, ""), (97, ". ,"), (96, items[12]), (95, items[12])]
    docs = []
    for k in range(60):
        parts = [text(rng.randint(0, 30))]
        if rng.random() < 0.7:
            cut = WORD.findall(rng.choice(items))
            at = rng.randint(0, max(0, len(cut) - 10))
            parts.append(" ".join(cut[at : at + rng.randint(9, 14)]).upper().replace("É", "é") + " ")
        docs.append((k, "".join(parts) + text(rng.randint(0, 5))))
    docs += [(1, docs[2][1]), (1, docs[2][1]), (None, docs[3][1]), (None, None), (200, ""), (201, None), (202, text(40_000))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(benchmark, "item_id long, text string")
    assert found(wumanber.find(d, b, block=block)) == brute(docs, benchmark)
    if block == 700:
        assert len(list(wumanber._blocks(b, "item_id", "text", 10, block))) > 2


def test_empty_tables_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "one two three four", 5, "x"), (None, "one two", 6, "y"), (2, "zero", 7, "z")], "doc_id long, text string, th long, `key` string")
    b = spark.createDataFrame([(1, "two THREE")], "item_id long, text string")
    assert found(wumanber.find(d, b.limit(0))) == [(1, 4, (), ()), (2, 1, (), ()), (None, 2, (), ())]
    assert wumanber.find(d.limit(0), b).count() == 0
    kept = wumanber.drop(d, b)
    assert kept.columns == d.columns and sorted(r.th for r in kept.collect()) == [6, 7]
    assert found(wumanber.find(d, b))[0] == (1, 4, (1, 2), ("1",))


def test_shifts_skip_bytes():
    """A long text without windows is looked at in few places."""
    w = wumanber.Windows([("i", b" ".join(b"benchmark%d" % i for i in range(30)))])
    (s,) = w.searches
    looked = []

    class Counting:
        def __getitem__(self, k):
            looked.append(k)
            return table[k]

    table, s.shift = s.shift, Counting()
    text = b" %s " % b" ".join(b"word%d" % (i % 1000) for i in range(20_000))
    assert w._places(s, text) == []
    assert len(looked) < len(text) / 50
