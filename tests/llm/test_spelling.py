import random
import re
from collections import Counter
from zlib import crc32

from textloom.llm import spelling


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            count[w] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    by = {w: [o for o in n if near(w, o)] for w in n}
    form = {}
    for w, others in by.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(by[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def variant(rng, w, letters):
    i = rng.randrange(len(w))
    return rng.choice((w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]))


def test_equals_brute_force(spark):
    rng = random.Random(2)
    letters = "abcéñÿÀ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 11))) for _ in range(40)]
    words = []
    for w in base:
        for k, many in enumerate((40, 14, 6, 3, 3, 3)):  # chains: variants of variants, ever rarer
            words += [w] * many
            for _ in range(k % 3):
                words += [variant(rng, w, letters)] * 3
            w = variant(rng, w, letters)
    rng.shuffle(words)
    sep = ["1", " ", ", ", "\n", "-", "ß ", "Ā", "😀", "'"]
    docs = [(k % 37 if k % 19 else None, "".join((w.upper() if rng.random() < 0.1 and w.isascii() else w) + rng.choice(sep) for w in words[k * 15 : k * 15 + 15])) for k in range(len(words) // 15 + 1)]
    docs += [(7, None), (None, None), (8, ""), (9, "1 2 3"), (10, "abcab " * 2000), (docs[0][0], docs[0][1])]
    df = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, word string")
    got = rows_of(spelling.group(df))
    assert got == brute(docs) and len(got) > 60 and max(r[4] for r in got) > 3
    assert any(r[2] != r[1] and r[1] for r in got), "some chain has two steps"
    assert rows_of(spelling.group(df.limit(0))) == []


def test_texts_in_pieces_and_counts_in_parts(spark, monkeypatch):
    """Long texts are cut between words, and partial counts add up."""
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "abcdefghijklmnop xyzxyz 12 éééééé" * 20
    assert "".join(spelling._pieces(text)) == text
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["1"]), pa.array([text])], names=["key", "text"])
    parts = list(spelling.counted(5, 10**9, held=1)([batch]))
    total = Counter()
    for b in parts:
        for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            total[w] += n
    assert len(parts) > 2 and total == Counter(re.findall("[a-zé]{5,}", text))


def test_every_edit_shares_a_key(spark):
    """All one-letter edits of a word are found, wherever they are."""
    word = "abcdef"
    others = {word[:i] + c + word[i:] for i in range(7) for c in "axz"} | {word[:i] + word[i + 1 :] for i in range(6)} | {word[:i] + "z" + word[i + 1 :] for i in range(6)} | {word[:i] + "x" + word[i + 1 :] for i in range(6)}
    others -= {word}
    v = spark.createDataFrame([(w, 3) for w in [word, *others]], "word string, n long")
    pairs = [frozenset((r.x, r.y)) for r in spelling.near_pairs(v).collect()]
    want = {frozenset((a, b)) for a in [word, *others] for b in [word, *others] if near(a, b)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want
