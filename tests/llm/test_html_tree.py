import itertools
import math
import random

from textloom.llm import html_tree as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/a>Home</a></li></ul></nav><!-- x -->
<div class="ad">Buy this now.</div><article><h1>Title &amp; more</h1><p><b>First  line.<br>second<p>Next &copy; para.</p><div class=comments><p>Nice one, thanks.</p></div></article><footer>&copy; us</footer></body>"""


def test_page():
    w, edge = H.potentials(H.fitted())
    assert H.main_text(PAGE, w, edge) == "Title & more\nFirst line. second\nNext © para."
    for odd in (None, "", "<", "<p", "plain", "<p>a<p>b", "</div></p>", "<!--", "<script>", "<a href='", "&#0;&#xFFFFFFF;&bogus;"):
        assert isinstance(H.main_text(odd, w, edge), str)


def test_hidden_elements():
    shown = ('style="overflow: hidden"', 'class="hidden-xs"', 'class="js-hidden article"', 'title="Hidden costs"', "href=/hidden/x", 'data-hidden="1"', 'aria-hidden="false"', 'data-x="display:none"', 'style="display:none;display:block"', "title='a hidden b'", 'class=hidden', "style='background:url(x?display:nonex)'")
    shut = ("hidden", "HIDDEN", 'hidden=""', 'class="x" hidden="hidden"', "hidden=until-found", "aria-hidden=true", "aria-hidden='TRUE'", 'style="color:red; DISPLAY : none !important"', "style=display:none", 'style="/* x */display:none"')
    texts = lambda s: [t for t in H.parse(s).texts if t is not None]
    for a in shown:
        assert texts(f"<div {a}><p>One.</p></div><p>Two.") == ["One.", "Two."], a
        assert texts(f"<p>One <a {a}>more</a> word.</p>") == ["One more word."], a
    for a in shut:
        assert texts(f"<div {a}><p>One.<br>&lt;</p></div><p>Two.") == ["Two."], a
        assert texts(f"<p>One <a {a}>mo<b>r<br>e</b></a> word.</p>") == ["One word."], a
        assert texts(f"<p>One <span {a}>x<div>y</div>z</span> word.</p>")[0] == "One", a
    w, edge = H.potentials(H.fitted())
    assert H.main_text(PAGE.replace("<article>", '<article style="overflow: hidden">'), w, edge) == H.main_text(PAGE, w, edge)


def test_marginals_equal_enumeration():
    page = H.parse(PAGE.split("<article>")[0] + "<p>One.</p>")
    w, edge = H.potentials(H.fitted())
    node = [sum(w[k] for k in f) for f in page.features]
    n = len(node)
    assert n < 18
    total, on = 0.0, [0.0] * n
    for y in itertools.product((0, 1), repeat=n):
        s = math.exp(sum(b for b, v in zip(node, y, strict=True) if v))
        for i in range(1, n):
            s *= edge[page.edges[i]][2 * y[page.parents[i]] + y[i]]
        total += s
        for i in range(n):
            on[i] += s * y[i]
    for b, p in zip(H.marginals(page, w, edge), on, strict=True):
        assert abs(1 / (1 + math.exp(-b)) - p / total) < 1e-6


def test_held_out_accuracy():
    w, edge = H.potentials(H.fitted())
    rng = random.Random(12345)
    right = total = 0
    for _ in range(150):
        page = H.parse(H.generated(rng))
        y, b = H.labels(page), H.marginals(page, w, edge)
        for i, t in enumerate(page.texts):
            if t is not None:
                right += (b[i] >= 0) == bool(y[i])
                total += 1
    assert right / total > 0.98


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (3, "u", "", None), (1, "u", PAGE, "t"), (4, "u", "<p>" + "x " * 200000, "t")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.n_chars) for r in H.extract(df).collect()]
    assert sorted(got)[:2] == [(1, 44), (1, 44)] and (2, 0) in got and (3, 0) in got
    assert H.extract(df.limit(0)).count() == 0


def test_hostile_pages_take_linear_time():
    import time

    n = 60_000
    began = time.process_time()
    for page in ("<b>" * n + "</i>" * n, "<i><div>" + "<b>" * n + "</i>" * n, "<b>" * n + "<p>" * n, "<" * 10 * n, "<ul>" + "<li>x" * n):
        H.parse(page)
    assert time.process_time() - began < 30
