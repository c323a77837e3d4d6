import itertools

from textloom.llm import toxicity as T

LEXICON = {"idiot": 3.0, "moro*": 3.0}


def test_composition_multiplies_the_machines():
    machines = (T.INSULTS, T.TARGETS, T.THREATS, T.NEGATED, T.REPORTED)
    for tags in itertools.product(range(6), repeat=4):
        clause = [(t, 1.0) for t in tags]
        states, total = [0] * len(machines), 0.0
        for tag, w in clause:
            f = w
            for k, m in enumerate(machines):
                states[k], x = m.arcs[states[k]][tag]
                f *= x
            total += f
        assert abs(T.GRAMMAR.score(clause)[0] - total) < 1e-9


def test_patterns_change_the_score():
    best = lambda t: T.Lexicon(LEXICON).features(t)[0]
    assert best("you are an idiot") > best("an idiot") > best("he said idiot") > 0
    assert best("not an idiot") < best("an idiot")
    assert best("you morons!") > best("moro") == best("nice day") == best("") == best(None) == 0
    assert best("i will kill you") > 0


def test_frames(spark):
    rows = [(i, ("you idiot " if i % 3 == 0 else "fine day ") + f"word{i} other{i * 7}", "x", "en") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.scores(docs, model).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(120))
    odd = spark.createDataFrame([(1, None, "x", None), (2, "", "x", None), (2, "", "x", None), (3, "good " * 50000 + "idiot", "x", None)], docs.schema)
    assert len([r for r in T.scores(odd, model).collect() if r.score < 0.5]) >= 3
    assert {r.doc_id for r in T.kept(docs, model).collect()} == {i for i in range(120) if i % 3} and T.kept(odd, model).columns == odd.columns
    assert T.scores(docs.limit(0), model).count() == 0
    empty = T.fit(docs, labels.limit(0))
    assert {r.doc_id: r.score >= 0.5 for r in T.scores(docs, empty).collect()}[0]


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        return
    got = T.query(spark, sf).filter("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in got) / len(got) > 0.9
