import re

from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), m.end(), 0) for m in EMAIL.finditer(text)]
    out += [(m.start(), m.end(), 1) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), m.end(), 2) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="012459.@+-_ (ab\nñ", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def found(text):
    base = pii.base_spans(text)
    return [(pii.KINDS[k], text[s:e]) for s, e, k in pii.added_spans(text, base, pii.fitted())]


def test_added_spans():
    assert found("call me at (212) 555-0199 or 555-123-4567, tel 0171 5550199.") == [("phone", "(212) 555-0199"), ("phone", "555-123-4567"), ("phone", "0171 5550199")]
    assert found("mail john (at) mail (dot) com now") == [("email", "john (at) mail (dot) com")]
    assert found("the +1 (269) 555-3296 4524132264652876 end") == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    for clean in ("on 2024-05-06 order 12345678 version 1.2.3 at 10:11:12", 'token = "0641917ea4e9feb9cda83477b57ac2654884f485"', "meet at noon, 12,345,678.90 paid", "no data at all"):
        assert found(clean) == []


def test_written_forms_anywhere():
    for ip in ("10[.]0[.]0[.]1", "10 . 0 . 0 . 1", "8(.)8(.)8(.)8"):
        assert found(f"the server {ip} is down") == [("ip", ip)]
    mail = "john (at) mail (dot) com"
    assert found(f"İstanbul mail {mail} now") == [("email", mail)]
    assert found("mail john ( at ) mail\tdot\tcom now") == [("email", "john ( at ) mail\tdot\tcom")]
    for clean in ("rows 1, 2, 3, 4 and 5", "0 1 0 0\n1 1 0 1", "(1)(2)(3)(4)", "sections 2.1, 2.2 and 3.4", "scores 10-12-3-4", "1. a 2. b 3. c 4. d"):
        assert found(clean) == []


def test_best_equals_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    for _ in range(30):
        n = 6
        segments = [(i, j) for i in range(n) for j in range(i + 1, min(n, i + 3) + 1)]
        score = rng.normal(size=(len(segments), 4))
        options = []
        for r in range(n + 1):
            for chosen in itertools.combinations(range(len(segments)), r):
                spans = [segments[k] for k in chosen]
                if all(a[1] <= b[0] for a, b in itertools.pairwise(sorted(spans))):
                    options.append(sum(score[k].max() for k in chosen))
        got = pii.best(n, segments, score)
        assert abs(sum(score[segments.index((i, j)), k] for i, j, k in got) - max(options)) < 1e-9
        p = pii.marginals(n, segments, score)
        assert (p >= 0).all() and all(sum(p[k].sum() for k, (i, j) in enumerate(segments) if i <= t < j) <= 1 + 1e-9 for t in range(n))


def test_frames(spark):
    rows = [(1, "a@b.co and 10.0.0.1", "en"), (2, None, "en"), (3, "", None), (4, "x " * 60000 + "+1 (269) 555-3296", "en"), (4, "a@b.co and 10.0.0.1", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {(r.doc_id, r.base): r for r in pii.find(df).collect()}
    assert got[1, "email:0:6,ip:11:19"].n_ip == 1 and got[2, ""].spans == "" and got[3, ""].n_email == 0
    assert got[4, "phone:120000:120017"].spans == "phone:120000:120017"
    red = {(r.doc_id, r.text and r.text[:20]) for r in pii.redact(df).collect()}
    assert (1, "[EMAIL] and [IP]") in red and (2, None) in red
    assert pii.find(df.limit(0)).count() == 0


def test_many_base_spans_take_linear_time():
    import time

    text = "1.2.3.4 a@b.co " * 25_000
    base = pii.base_spans(text)
    assert len(base) == 50_000
    began = time.process_time()
    pii.added_spans(text, base, pii.fitted())
    assert time.process_time() - began < 30
