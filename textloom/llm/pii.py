"""Personal data by fixed patterns and, added to them, a semi-Markov conditional random field.

Base spans come from four patterns with checks (parts, Luhn, digit counts); they always stay. The field adds spans that the
patterns cannot see (numbers in national form, written-out addresses, other separators): around every place that could hold an
entity it scores whole candidate segments of at most `MOST` tokens - digit grouping, separators, Luhn, edges, cue words before the segment -
and one dynamic program chooses boundaries and types together. A segment can only be an entity if it holds an anchor (enough digits, four short digit groups with dots between them, or an at-sign or its
written form), and only text around anchors is scored: the result is the exact best segmentation there, and the rest is outside. A bare word "at" is no anchor, so
an address written with it is found only near another one, such as a bare word "dot". Weights are fitted by exact likelihood on generated sentences, so they do not depend on the corpus.

Defined cases: null and empty text have no spans; long texts are read whole in linear time; repeated rows give equal rows; an empty table gives an empty result. Other
columns are not read.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import slices, table

KINDS = ("email", "ip", "card", "phone")

LOCAL = "A-Za-z0-9._%+-"
# A run of local characters before an at-sign, from its first character on, so that long runs are read once.
AT = re.compile(rf"(?<![{LOCAL}])[{LOCAL}]+@")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile("[^0-9]+")
DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    out, at = [], 0
    for m in AT.finditer(text):
        begin = max(at, m.start())
        if begin < m.end() - 1 and (d := DOMAIN.match(text, m.end())):
            out.append((begin, d.end(), 0))
            at = d.end()
    return out


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) in code points, by start and kind."""
    out = emails(text) if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), m.end(), 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda s: (s[0], s[2]))


# --- the field

#: Tokens in a segment at most, and so in an added span.
MOST = 16
TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|[^\w\s]|_|\n")
#: Seven digits with short gaps, or an at-sign; and the written forms of an at-sign.
ANCHOR = re.compile(r"[0-9](?:[^0-9\n]{0,4}[0-9]){6,}|@")
WRITTEN = (re.compile(r"[\[({]\s?(?:[aA][tT]|[dD][oO][tT])\s?[\])}]"), re.compile(r"[dD][oO][tT](?<=\s...)(?=\s)"))
#: Four groups of at most three digits with dots between them, written or not.
GROUPS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:[^0-9\n]{0,3}?(?:\.|[dD][oO][tT])[^0-9\n]{0,3}[0-9]{1,3}(?![0-9])){3}")
CUES = {
    1: frozenset("mail email e-mail mailto contact correo courriel".split()),
    2: frozenset("ip host server addr address ping node".split()),
    3: frozenset("card visa mastercard amex credit kreditkarte carte tarjeta cc".split()),
    4: frozenset("phone tel telephone call mobile cell fax telefon handy téléphone teléfono whatsapp".split()),
}
SHAPES = {"3-3-4": 0, "4-4-4-4": 1, "16": 2, "4-6-5": 3, "10": 4, "3-4": 5}


def featured(tokens: list[tuple[str, int, int]], i: int, j: int, text: str) -> list[int]:
    """Features of the segment tokens[i:j] as a whole."""
    words = [t[0] for t in tokens[i:j]]
    groups = [w for w in words if w[0].isascii() and w[0].isdigit()]
    digits = "".join(groups)
    n = len(digits)
    letters = [w for w in words if w[0].isalpha()]
    marks = {w for w in words if not w[0].isalnum()}
    low = [w.lower() for w in letters]
    has_at = "@" in marks or any(w == "at" for w in low)
    has_dot = "." in marks or "dot" in low
    out = [0]  # bias
    out.append(1 + (0 if n == 0 else 1 if n < 7 else 2 if n < 9 else 3 if n <= 11 else 4 if n == 12 else 5 if n <= 15 else 6 if n <= 19 else 7))
    if 12 <= n <= 19:
        out.append(9 if luhn(digits) else 10)
    shape = SHAPES.get("-".join(str(len(g)) for g in groups))
    if shape is not None:
        out.append(11 + shape)
    out.append(17 + min(len(groups), 5))
    if len(groups) == 4 and n <= 12 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append(23)
    if letters:
        out.append(24)
    else:
        out.append(25)
    if has_at:
        out.append(26 if has_dot else 27)
        if letters and words[0][0].isalnum() and words[-1][0].isalpha() and len(words[-1]) >= 2:
            out.append(28)
    for k, mark in enumerate("+(-./:"):
        if mark in marks:
            out.append(29 + k)
    if "\n" in marks:
        out.append(35)
    if marks - set("+()-./@[]{}:_%"):
        out.append(36)
    first, last = tokens[i], tokens[j - 1]
    out.append(37 if first[0] == "+" else 38 if first[0] == "(" else 39 if first[0][0].isalnum() else 40)
    out.append(41 if last[0][0].isalnum() else 42)
    before, after = text[first[1] - 1 : first[1]], text[last[2] : last[2] + 1]
    if before.isalnum() or before in "=\"'#$%&_.-" and before:
        out.append(43)
    if after.isalnum() or after in "\"'#$%&_-=" and after:
        out.append(44)
    if letters and groups and not has_at:
        out.append(45)
    near = {t[0].lower() for t in tokens[max(0, i - 4) : i]}
    for k, cues in CUES.items():
        if near & cues:
            out.append(45 + k)
    if any(len(g) == 4 and g[:2] in ("19", "20") for g in groups) and n == 8:
        out.append(50)  # a date
    if {w for w in low if w not in ("at", "dot")} and has_at and " " in text[first[1] : last[2]] and not {"(", "[", "{"} & marks:
        out.append(51)
    out.append(52 if j - i <= 3 else 53 if j - i <= 8 else 54)
    gap = max((b[1] - a[2] for a, b in zip(tokens[i : j - 1], tokens[i + 1 : j], strict=True)), default=0)
    if gap > 1:
        out.append(55)
    return out


N_FEATURES, N_TYPES = 56, 5  # type 0: outside, always one token


def possible(tokens: list[tuple[str, int, int]], i: int, j: int, digits: list[int], ats: list[int], shorts: list[int], dots: list[int]) -> bool:
    """Whether tokens[i:j] holds an anchor and begins and ends like an entity."""
    first, last = tokens[i][0], tokens[j - 1][0]
    return (ats[j - 1] > ats[i + 1] or digits[j] - digits[i] >= 7 or shorts[j] - shorts[i] >= 4 and dots[j] - dots[i] >= 3) and (first[0].isalnum() or first in "+(") and last[0].isalnum() and last.lower() not in ("at", "dot")


def lattice(tokens, text):
    """Candidate segments (i, j) with their features, and for each token the features of leaving it outside."""
    digits, ats, shorts, dots = [0], [0], [0], [0]
    after = [w[0].isalpha() or w in "])}" for w, _, _ in tokens[1:]] + [False]
    for (w, _, _), named in zip(tokens, after, strict=False):
        digits.append(digits[-1] + (len(w) if w[0].isdigit() and w[0].isascii() else 0))
        shorts.append(shorts[-1] + (len(w) <= 3 and w[0].isdigit() and w[0].isascii()))
        dots.append(dots[-1] + (w == "." or w.lower() == "dot"))
        ats.append(ats[-1] + (w == "@" or named and w.lower() == "at"))
    segments = [(i, j) for i in range(len(tokens)) for j in range(i + 1, min(len(tokens), i + MOST) + 1) if possible(tokens, i, j, digits, ats, shorts, dots)]
    return segments, [featured(tokens, i, j, text) for i, j in segments]


def scores(weights: np.ndarray, features: list[list[int]]) -> np.ndarray:
    """Entity types' scores of each segment against its tokens left outside."""
    if not features:
        return np.zeros((0, N_TYPES - 1))
    flat = np.concatenate(features)
    return np.add.reduceat(weights[flat], np.cumsum([0, *map(len, features[:-1])]), axis=0)


def best(n: int, segments, score: np.ndarray) -> list[tuple[int, int, int]]:
    """The best joint choice of boundaries and types: dynamic programming over segment ends."""
    ending: list[list[int]] = [[] for _ in range(n + 1)]
    for k, (_, j) in enumerate(segments):
        ending[j].append(k)
    top, value = score.argmax(1).tolist() if len(segments) else [], score.max(1).tolist() if len(segments) else []
    total, back = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        total[j] = total[j - 1]
        for k in ending[j]:
            if (v := total[segments[k][0]] + value[k]) > total[j]:
                total[j], back[j] = v, k
    out, j = [], n
    while j:
        if back[j] < 0:
            j -= 1
        else:
            out.append((*segments[back[j]], top[back[j]]))
            j = segments[back[j]][0]
    return out[::-1]


def marginals(n: int, segments, score: np.ndarray) -> np.ndarray:
    """Probability of each (segment, type): forward and backward sums over all segmentations."""
    ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = behind[n] = 0.0
    whole = np.logaddexp.reduce(score, axis=1)
    ending, starting = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
    for k, (i, j) in enumerate(segments):
        ending[j].append(k)
        starting[i].append(k)
    for j in range(1, n + 1):
        ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[segments[k][0]] + whole[k] for k in ending[j])])
    for i in range(n - 1, -1, -1):
        behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[segments[k][1]] + whole[k] for k in starting[i])])
    at = np.array(segments).reshape(-1, 2)
    return np.exp(ahead[at[:, 0]] + behind[at[:, 1]] - ahead[n])[:, None] * np.exp(score)


def sentence(rng: random.Random) -> tuple[str, list[Span]]:
    """A generated sentence with its entities: forms with and without cue words, and look-alikes that are none."""
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "er", "th", "ing", "on", "re", "st", "ou", "le", "qu", "ä", "é")) for _ in range(rng.randint(1, 4)))

    def card() -> str:
        head = rng.choice("3456") + d(rng.choice((14, 14, 14, 13)))
        for c in "0123456789":
            if luhn(head + c):
                head += c
                break
        return rng.choice((head, rng.choice(" -./").join(head[i : i + 4] for i in range(0, len(head), 4))))

    def phone() -> str:
        a, b, c = d(3), d(3), d(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b}{c}", f"0{d(3)} {d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"))

    def mail() -> str:
        at, dot = rng.choice((("@", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" at ", " dot ")))
        return f"{word()}{rng.choice(('', '.' + word(), d(2)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"

    def ip() -> str:
        return rng.choice((".", ".", "[.]", " . ")).join(str(rng.randint(0, 255)) for _ in range(4))

    nothing = (
        lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", lambda: d(rng.randint(7, 12)), lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
        lambda: f"{rng.randint(10, 23)}:{d(2)}:{d(2)}", lambda: f"{d(3)},{d(3)},{d(3)}.{d(2)}", lambda: bad(16), lambda: f"{d(4)}-{d(4)}", lambda: f"id={d(16)}", lambda: f"{word()} at {word()}", lambda: f"{d(20)}{d(9)}", lambda: f"@{word()}", lambda: f"{d(4)} {d(4)} {d(2)}",
    )

    def bad(n: int) -> str:
        while luhn(x := d(n)):
            pass
        return x

    text, spans = "", []
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(2, 7))) + " "
        kind = rng.choice((0, 1, 2, 3, None, None, None))
        if kind is None:
            made = rng.choice(nothing)()
        else:
            made = (mail, ip, card, phone)[kind]()
            plain = kind == 3 and re.fullmatch(r"0\d+ \d+|[\d.]+", made) or kind == 0 and " at " in made
            if plain or rng.random() < 0.3:
                text += rng.choice(sorted(CUES[kind + 1])) + rng.choice((" ", ": "))
            spans.append((len(text), len(text) + len(made), kind))
        text += made + rng.choice((" ", ", ", ". ", "\n"))
    return text + word(), spans


@lru_cache(maxsize=2)
def fitted(sentences: int = 500, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Weights by stochastic gradient on the exact log-likelihood of generated sentences."""
    rng = random.Random(seed)
    cases = []
    for _ in range(sentences):
        text, spans = sentence(rng)
        tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text)]
        segments, features = lattice(tokens, text)
        if not segments:
            continue
        gold = np.zeros((len(segments), N_TYPES - 1))
        place = {(tokens[i][1], tokens[j - 1][2]): k for k, (i, j) in enumerate(segments)}
        for s, e, kind in spans:
            if (s, e) in place:
                gold[place[s, e], kind] = 1
        flat = np.concatenate(features)
        cases.append((len(tokens), segments, features, flat, np.repeat(np.arange(len(features)), list(map(len, features))), gold))
    weights = np.zeros((N_FEATURES, N_TYPES - 1))
    weights[0] = -2
    squares = np.full_like(weights, 0.1)
    for _ in range(rounds):
        rng.shuffle(cases)
        for n, segments, features, flat, owner, gold in cases:
            off = (gold - marginals(n, segments, scores(weights, features)))[owner]
            step = np.zeros_like(weights)
            np.add.at(step, flat, off)
            step -= 0.002 * weights
            squares += step**2
            weights += 0.3 * step / np.sqrt(squares)
    return weights


def regions(text: str) -> list[tuple[int, int]]:
    """Character intervals around anchors; overlapping ones are one."""
    found = [(m.start(), m.end()) for m in ANCHOR.finditer(text)] if "@" in text or DIGIT.search(text) else []
    if DIGIT.search(text):
        found += [(m.start(), m.end()) for m in GROUPS.finditer(text)]
    found += [(m.start(), m.end()) for w in WRITTEN for m in w.finditer(text)]
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        s, e = max(0, s - 60), e + 60
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def added_spans(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """The field's spans that no base span overlaps."""
    out = []
    begins, ends = [], []  # the base spans, overlapping ones as one
    for s, e, _ in sorted(base):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)

    def busy(token: tuple[str, int, int]) -> bool:
        at = bisect_left(begins, token[2]) - 1
        return at >= 0 and ends[at] > token[1]

    for s, e in regions(text):
        tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, s, e)]
        if tokens and tokens[0][1] == s and s and text[s - 1].isalnum():
            tokens = tokens[1:]  # cut in the middle of a word
        runs, run = [], []
        for t in tokens:
            if busy(t):
                runs.append(run)
                run = []
            else:
                run.append(t)
        for run in (*runs, run):
            segments, features = lattice(run, text)
            if segments:
                out += [(run[i][1], run[j - 1][2], kind) for i, j, kind in best(len(run), segments, scores(weights, features))]
    return out


def rendered(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], x[2], x[1])))


def _each(columns: str, text: str, made, kinds: list):
    weights = fitted()

    def run(batches):
        for batch in slices(batches, text):
            rows = []
            for t in batch.column(1).to_pylist():
                base = base_spans(t or "")
                rows.append(made(t, base, added_spans(t or "", base, weights)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=columns.split())

    return run


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts of the base spans by kind, base and spans (kind:start:end, comma-joined)."""

    def made(_, base, more):
        return (*(sum(s[2] == k for s in base) for k in range(4)), rendered(base), rendered(base + more))

    run = _each("key n_email n_ip n_card n_phone base spans", text, made, [pa.int64()] * 4 + [pa.string()] * 2)
    return docs.select(key, text).mapInArrow(run, f"`{key}` long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; all columns stay. Overlapping spans are replaced as one, under the first's kind."""
    weights = fitted()
    names = docs.columns
    at = names.index(text)

    def run(batches):
        for batch in slices(batches, text):
            out = []
            for t in batch.column(at).to_pylist():
                if t:
                    base = base_spans(t)
                    end, parts = 0, []
                    for s, e, k in sorted(base + added_spans(t, base, weights), key=lambda x: (x[0], x[2])):
                        if s >= end:
                            parts += [t[end:s], f"[{KINDS[k].upper()}]"]
                        end = max(end, e)
                    t = "".join(parts) + t[end:]
                out.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(out, pa.string()), *batch.columns[at + 1 :]], names=names)

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: counts, digest of the base spans and all spans of every document."""
    found = find(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")


