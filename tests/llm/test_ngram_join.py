import random

from textloom.llm import ngram_join


def brute(rows, size):
    """A row's own set; components over doc_ids."""
    sets, root = [], {}
    for k, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split()
        sets.append((k, {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()))
        root[k] = k

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    named = [x for x in sets if x[0] is not None]
    for i, (a, x) in enumerate(named):
        for b, y in named[:i]:
            c = len(x & y)
            if a != b and c and 100 * c >= 80 * len(x | y):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return sorted(((k, len(x), None if k is None else find(k)) for k, x in sets), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh ij kl mn op qr é".split()) + str(rng.randint(0, 40))
    passage = [word() for _ in range(30)]
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.randint(3, 120))]
        for _ in range(rng.choice((1, 1, 2, 5, 30))):
            w = list(base)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                w[rng.randrange(len(w))] = word()
            if rng.random() < 0.2:
                w += passage
            rows.append((len(rows) * 3 + 1, " ".join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "one two"), (5004, "ONE two"), (5005, "one"), (5006, "É a b c d"), (5007, "é a b c d"), (5008, "x " * 40000)]
    order = list(rows)
    rng.shuffle(order)
    df = spark.createDataFrame([(k, t, 7) for k, t in order], "doc_id long, text string, n long").repartition(4)
    got = sorted((tuple(r) for r in ngram_join.join(df).collect()), key=repr)
    assert got == brute(rows, 5)


def test_a_chain_is_one_component(spark):
    base = [f"w{i}" for i in range(80)]
    rows = [(i + 1, " ".join(base[i * 3 : i * 3 + 40])) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in ngram_join.join(df).collect()), key=repr) == brute(rows, 5)


def test_empty_table(spark):
    assert ngram_join.join(spark.createDataFrame([], "doc_id long, text string, rep long")).count() == 0


def test_rows_without_a_key_are_no_nodes(spark):
    """They have their size, but no links and no component."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (5, text), (None, "x"), (7, text + " y"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.join(df).collect()), key=repr)
    assert got == brute(rows, 5) and got[0][2] == got[1][2] == 5 and len(got) == 5


def test_rows_that_repeat_a_key(spark):
    """Each row has links of its own; together they are one node. In `copies` they stay apart."""
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(5, a), (5, b), (7, a + " more"), (9, b + " more"), (9, None), (11, "another text of some words"), (11, a), (12, b), (5, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in ngram_join.join(df).collect()), key=repr)
    assert got == brute(rows, 5) and {r[2] for r in got} == {5}
    texts = {r.th: r.text for r in df.selectExpr("xxhash64(text) as th", "text").collect()}
    gone = {(r.doc, texts[r.th]) for r in ngram_join.copies(df).collect()}
    assert gone == {(7, a + " more"), (9, b + " more"), (11, a), (12, b)}


def test_many_repeated_keys(spark):
    rng = random.Random(8)
    base = [[f"{g}w{rng.randint(0, 60)}" for _ in range(rng.randint(6, 60))] for g in range(12)]
    rows = []
    for _ in range(150):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2))):
            w[rng.randrange(len(w))] = "other"
        rows.append((rng.choice((1, rng.randint(-40, 40), rng.randint(100, 200))), " ".join(w)))
    rows += [(1, None), (1, ""), (150, "one")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(r) for r in ngram_join.join(df).collect()), key=repr) == brute(rows, 5)


def _join_rows(spark, run):
    """What run returns, and how many rows the joins of its queries made."""
    store = spark._jvm.org.apache.spark.sql.classic.SparkSession.active().sharedState().statusStore()
    before, found, made = store.executionsCount(), run(), 0
    runs = store.executionsList()
    for k in range(before, runs.size()):
        values, nodes = store.executionMetrics(runs.apply(k).executionId()), store.planGraph(runs.apply(k).executionId()).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            metrics = [node.metrics().apply(i) for i in range(node.metrics().size())]
            made += sum(int(values.get(m.accumulatorId()).get().replace(",", "")) for m in metrics if "Join" in node.name() and m.name() == "number of output rows" and values.get(m.accumulatorId()).isDefined())
    return found, made


def test_sets_of_a_family_meet_at_few_tokens(spark):
    """60 sets of 100 shingles, each with 10 of its own and then 18 that all hold: a pair meets once, not at each token, and is not lost; sets with 12 of their own can link with nothing."""
    rows = [(1000 + t, rep, rep, 100, own + t) for rep in range(80) for own in [10 if rep < 60 else 12] for t in range(18)]
    held = spark.createDataFrame(rows, "token long, rep long, comp long, n int, i int")
    found, made = _join_rows(spark, lambda: ngram_join._opened(held).collect())
    assert sorted((r.a, r.b) for r in found) == [(a, b) for a in range(60) for b in range(a + 1, 60)]
    assert 0 < made <= 5 * len(found)
