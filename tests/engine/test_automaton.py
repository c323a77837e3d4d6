import random
import time

import pytest

from textloom.functions.automaton import Factor, Scanner, exact, factor, required
from textloom.functions.patterns import Pattern, escape
from textloom.operators import scan
from textloom.operators.scan import Member
from textloom.sources.corpus import Corpus


def loop(text, members):
    """One search for each pattern."""
    out = [(x.start(), k, x.end()) for k, m in enumerate(members) for x in m.pattern.matcher.finditer(text) if x.end() > x.start()]
    return sorted(out)


def some_pattern(rng):
    lit = lambda: "".join(rng.choice("abABéK1_-") for _ in range(rng.randint(1, 4)))
    part = lambda: rng.choice([lit, lit, lambda: rf"[ab{rng.choice('1é')}]", lambda: r"\w+", lambda: r"\d?", lambda: ".", lambda: f"(?:{lit()}|{lit()})", lambda: f"({lit()})", lambda: f"(?:{lit()}){{2}}", lambda: rf"\b{lit()}", lambda: f"{lit()}|{lit()}{lit()}", lambda: rf"\s*{lit()}", lambda: "^", lambda: "$", lambda: f"(?:{lit()}|[ab])+", lambda: "a{3}", lambda: f"(?:x{lit()}?)+?"])()
    while True:
        rx = "".join(part() for _ in range(rng.randint(1, 4)))
        try:
            return Pattern("p", rx, case_insensitive=rng.random() < 0.4, word_boundary=rng.random() < 0.3, ucp=rng.random() < 0.2).check()
        except Exception:  # noqa: BLE001  matches the empty text, or is no pattern
            continue


@pytest.mark.parametrize("seed", range(6))
def test_equals_a_search_for_each_pattern(seed):
    rng = random.Random(seed)
    for _ in range(60):
        members = [Member(some_pattern(rng), "", i) for i in range(rng.randint(1, 12))]
        s = Scanner(members)
        asked = required(members)
        for _ in range(12):
            text = "".join(rng.choice(["a", "b", "A", "B", "é", "É", "K", "K", "k", "1", "_", "-", " ", "\n", "x", "\udc80", "ab", "aaa"]) for _ in range(rng.randint(0, 60)))
            found = s.hits(text)
            assert found == loop(text, members), (text, [m.pattern for m in members])
            if asked is not None and found:
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
                assert any(t in (low if fold else text) for t, fold in asked), (text, asked)


def test_factors():
    f = lambda rx, **o: factor(Pattern("p", rx, **o))
    assert f("foo[0-9]+bar") == Factor(("foo",), 0, 0, False)
    assert f("[a-z]+@[a-z]+") == Factor(("@",), 1, None, False)
    assert f("(?:error|warning): x") == Factor(("error", "warning"), 0, 0, False) or f("(?:error|warning): x").texts == (": x",)
    assert f("[a-z]{2,3}Foo", case_insensitive=True) == Factor(("foo",), 2, 3, True)
    assert f("[0-9]{3,}") is None and f("e[0-9]") is None and f("foo", case_insensitive=True, ucp=True) is None
    assert exact(Pattern("p", r"a\.b", word_boundary=True)).text == "a.b" and exact(Pattern("p", "a+")) is None
    assert required([Member(Pattern("p", "foo")), Member(Pattern("q", "[0-9]+"))]) is None
    assert required([Member(Pattern("p", "Foo", case_insensitive=True)), Member(Pattern("", ""), ident=("a", "Parse"))]) == [("foo", True), ("parse", True)]


def test_native_filter_keeps_every_row(spark):
    """The filter stands below Python, keeps each text with a hit, and is left out where no text is required."""
    texts = [(i, t) for i, t in enumerate(["has LICENSE here", "none", "é license", "a ticket-77", "Key", "x" * 50, "TICKET-1", ""])] + [(99, None)]
    c = Corpus.from_table(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    patterns = [Pattern("lic", "license", case_insensitive=True), Pattern("t", r"ticket-\d+"), Pattern("k", "key", case_insensitive=True)]
    df = scan.match(c, patterns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.lower().index("contains(")
    got = sorted((r.file, r.pattern_id) for r in df.collect())
    assert got == [("0", "lic"), ("2", "lic"), ("3", "t")]
    every = scan.match(c, [*patterns, Pattern("any", "[0-9]+")])
    assert "contains(" not in every._jdf.queryExecution().executedPlan().toString().lower()
    assert sorted((r.file, r.pattern_id) for r in every.filter("pattern_id <> 'any'").collect()) == got
    binary = Corpus.from_text(spark, {"a": b"\xff\xfeLICENSE\xff", "b": b"\xe9ticket-5", "c": b"\xff"})
    assert sorted((r.file, r.pattern_id, r["from"]) for r in scan.match(binary, patterns).collect()) == [("a", "lic", 2), ("b", "t", 1)]


def test_many_literals_cost_little():
    """10,000 literals take a few times the time of 10, not a thousand times, with the same hits."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(4, 9)))
    texts = [" ".join(word() for _ in range(400)) for _ in range(300)]
    ten = [Member(Pattern("", escape(texts[i][10:30])), "", i) for i in range(10)]
    many = ten + [Member(Pattern("", escape(f"{word()}#{i}")), "", i) for i in range(10, 10_000)]

    def took(members):
        s = Scanner(members)
        best, found = 9.0, None
        for _ in range(5):
            began = time.process_time()
            found = [s.hits(t) for t in texts]
            best = min(best, time.process_time() - began)
        return best, found

    (a, x), (b, y) = took(ten), took(many)
    assert x == y and sum(map(len, x)) >= 10
    assert b < 10 * a, (a, b)
