import random

import pytest

from textloom.llm import line_dedup


def brute(rows):
    lines = sorted((k, i, frozenset(x.split())) for k, t in rows if t is not None for i, x in enumerate(t.split("\n")))
    gone, earlier = {}, []
    for k, i, s in lines:
        if s:
            if any(5 * len(s & e) >= 4 * len(s | e) for e in earlier):
                gone.setdefault(k, set()).add(i)
            earlier.append(s)
    return {k: None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone.get(k, ())) for k, t in rows}


def test_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("the of and a in".split()) if rng.random() < 0.4 else f"w{rng.randint(0, 60)}"
    base = [[word() for _ in range(rng.randint(1, 25))] for _ in range(25)]
    rows = []
    for k in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                w[rng.randrange(len(w))] = word()
            lines.append(rng.choice((" ", "  ")).join(w))
        rows.append((k * 7 % 60, "\n".join(lines)))
    rows += [(900, None), (901, ""), (902, "\n \n"), (903, "one line\none line\nline one"), (904, "y " * 30000 + "\nz")]
    df = spark.createDataFrame([(k, t, k, "x") for k, t in rows], "doc_id long, text string, pos long, sig string")
    got = line_dedup.dedup(df)
    assert got.columns == df.columns
    assert {r.doc_id: r.text for r in got.collect()} == brute(rows)
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c\na b c")], "doc_id long, text string")
    plan = line_dedup.dedup(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("seed", [11, 14, 19])
def test_edits_up_to_the_limit(spark, seed):
    """Lines of 4 to 40 words with as many edits as similar lines can have, and one more."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(70)]
    rows = []
    for g in range(60):
        n = rng.randint(4, 40)
        base = rng.sample(vocabulary, n)
        for c in range(4):
            w, own = list(base), n // 9 + rng.randint(0, 1)
            for _ in range(rng.randint(0, own)):
                w.pop(rng.randrange(len(w)))
            for _ in range(rng.randint(0, own)):
                w.append(rng.choice(vocabulary))
            rng.shuffle(w)
            rows.append((4 * g + c, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup(df).collect()} == brute(rows)


def test_repeated_and_missing_ids_and_clashing_names(spark):
    """A row that repeats an id with another text is a document of its own; equal rows lose the same lines; rows without id stay."""
    rows = [(1, "alpha beta gamma\nsame line here now"), (2, "same line here now\nkeep me one"), (2, "other text entirely\nkeep me two"), (None, "same line here now"), (None, None), (3, "twice\ntwice"), (3, "twice\ntwice")]
    names = ("gone", "doc", "th", "sig", "d", "pos", "__gone")
    df = spark.createDataFrame([(*r, *[1] * len(names)) for r in rows], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    got = line_dedup.dedup(df)
    assert got.columns == df.columns
    out = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    want = [(1, rows[0][1]), (2, "keep me one"), (2, "other text entirely\nkeep me two"), (None, "same line here now"), (None, None), (3, "twice"), (3, "twice")]
    assert out == sorted(want, key=str)


def test_many_similar_pairs_of_one_document(spark):
    """20,000 pairs of similar lines: of each pair the later line goes."""
    rng = random.Random(1)
    lines = []
    for k in range(20_000):
        w = [f"w{rng.randrange(10**9)}" for _ in range(10)]
        lines += [" ".join(w), " ".join([*w, f"x{k}"])]
    got = line_dedup.removed_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    assert sorted(r.pos for r in got.collect()) == list(range(1, 40_000, 2))
