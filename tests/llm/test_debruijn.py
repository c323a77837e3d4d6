import random

import pytest

from textloom.llm import debruijn


def brute(rows, window):
    words = [(k, (t or "").encode().split()) for k, t in rows]
    least = {}
    for k, w in words:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(k, least.get(g, k))
    out = []
    for k, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        out.append((k, b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode(), sum(gone)))
    return sorted(out)


@pytest.mark.parametrize("window", [13, 3])
def test_equals_brute_force(spark, window):
    rng = random.Random(window)
    shared = [" ".join(rng.choice("ab cd ef gh ij kl mn é 🙂".split()) for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = [(i, "\n".join(rng.choice([*shared, " ".join(str(rng.randint(0, 99)) for _ in range(30))]) for _ in range(rng.randint(0, 4)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \t "), (203, "x " * 30000), (204, "x " * 30000), (205, shared[0]), (205, shared[0])]
    rng.shuffle(rows)
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, spans string").repartition(5)
    got = sorted((r.doc_id, r.text, sum(s.words for s in r.spans)) for r in debruijn.dedup(df, window=window).collect())
    assert got == brute(rows, window)
    assert debruijn.dedup(df.limit(0)).count() == 0


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(debruijn, "FILTER_BITS", 64)
    rows = [(i, " ".join(str((i % 7) * 100 + j) for j in range(40))) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text, sum(s.words for s in r.spans)) for r in debruijn.dedup(df).collect()) == brute(rows, 13)


def test_rows_without_a_key_stay_whole(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, words), (5, words), (None, words), (7, words), (None, None), (None, "é  x\n" + words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text, len(r.spans)) for r in debruijn.dedup(df).collect()]
    assert sorted(got, key=repr) == sorted([(5, words, 0), (7, "", 1), (None, words, 0), (None, words, 0), (None, "", 0), (None, f"é x {words}", 0)], key=repr)
    alone = debruijn.dedup(spark.createDataFrame(rows[:1], df.schema))
    assert [tuple(r)[:2] for r in alone.collect()] == [(None, words)]


def test_slices_without_any_repeated_window(spark):
    """One slice holds short and empty texts only, another one no window that comes twice."""
    rows = [(1, "a b"), (2, ""), (3, None), (4, " ".join(f"only{i}" for i in range(40)))]
    for some in (rows[:3], rows[3:], rows):
        df = spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
        assert {r.doc_id: r.text for r in debruijn.dedup(df).collect()} == {k: " ".join((t or "").split()) for k, t in some}
